"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from urbanframe.llm.quality import ABUSE

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = rf"""
with docs as (
  select row_number() over () as k, doc_id, w, len(w) as n from (select doc_id, {_TERMS} as w from documents) d where len(w) > 0),
total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from docs),
items as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
counts as (
  select k, t, count(*) as tf from (select k, unnest(w) as t from docs) u where t in (select t from items) group by k, t),
weights as (
  select t, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as weight
  from (select t, count(*) as df from counts group by t) f cross join total),
scores as (
  select item_id, k, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
  from items join weights using (t) join counts using (t) join docs using (k) cross join total group by item_id, k)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score,
         row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
  from scores join docs using (k) where score > 0) r
where rank <= 10
"""

# the checksum of a text, byte by byte, from a table that a rule makes
_CRC_TABLE = """
crc_steps(n, k, c) as (
  select n, 0, cast(n as bigint) from range(256) r(n)
  union all
  select n, k + 1, case when c % 2 = 1 then xor(cast(3988292384 as bigint), c // 2) else c // 2 end from crc_steps where k < 8),
crc_table as (select list(c order by n) as entries from crc_steps where k = 8)"""


def _crc(key: str) -> str:
    """CRC-32 of an ASCII text; ``crc_table`` must be joined."""
    octets = f"list_transform(string_split({key}, ''), lambda ch: cast(ord(ch) as bigint))"
    step = "lambda c, b: xor(c // 256, entries[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {octets}), {step}), cast(4294967295 as bigint))"


def _state(base: str, cost: int | str, letter: str, role: str | None = None, text: str = "''") -> str:
    """An audit one edit longer; with a role, that row is added to the repaired ones."""
    rows = f"{base}.r" if role is None else f"list_append({base}.r, {role} || ':' || {text})"
    return f"struct_pack(c := {base}.c + {cost}, a := {base}.a || '{letter}', r := {rows})"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _best_after_row() -> str:
    """The four states after a row, before inserts (``s0`` .. ``s3`` become ``b0`` .. ``b3``)."""
    never = "struct_pack(c := cast(1000000000 as bigint), a := '', r := cast([] as varchar[]))"

    def kept(base: str, initial: str) -> str:
        return f"case when not doomed and initial = '{initial}' then {_state(base, 'stays', 'K', 'role', 'text')} else {never} end"

    def reroled(base: str, role: str) -> str:
        return f"case when not doomed then {_state(base, '1 + stays', 'R', repr(role), 'text')} else {never} end"

    to_user = [f(b, x) for b in ("s0", "s1", "s3") for f, x in ((kept, "u"), (reroled, "user"))]
    return ", ".join(
        (
            f"{_state('s0', 2, 'D')} as b0",
            f"{_least(_state('s1', 2, 'D'), kept('s0', 's'))} as b1",
            f"{_least(_state('s2', 2, 'D'), *to_user)} as b2",
            f"{_least(_state('s3', 2, 'D'), kept('s2', 'a'), reroled('s2', 'assistant'))} as b3",
        )
    )


def _with_inserts(source: str) -> str:
    """The states ``b0`` .. ``b3`` of ``source`` after the best inserts."""
    user = _least("b2", *(_state(b, 5, "I", "'user'") for b in ("b0", "b1", "b3")))
    return f"""select cid, i, b0 as s0, b1 as s1, s2, {_least('b3', _state('s2', 5, 'I', "'assistant'"))} as s3
  from (select *, {user} as s2 from ({source}) x) y"""


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_START = """select cid, cast(0 as bigint) as i, struct_pack(c := cast(0 as bigint), a := '', r := cast([] as varchar[])) as b0,
         struct_pack(c := cast(1000000000 as bigint), a := '', r := cast([] as varchar[])) as b1,
         struct_pack(c := cast(1000000000 as bigint), a := '', r := cast([] as varchar[])) as b2,
         struct_pack(c := cast(1000000000 as bigint), a := '', r := cast([] as varchar[])) as b3 from convs"""

CONVERSATION_REPAIR = f"""
with recursive {_CRC_TABLE},
keyed as (
  select dense_rank() over (order by conv_id nulls first) as cid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate
  from conversations cross join crc_table),
convs as (select cid, any_value(conv_id) as conv_id from keyed group by cid),
spoilt as (
  select cid, turn, case when fate = 4 then 'user' else role end as role,
         case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fate = 3 then [1, 2] else [1] end) as copy
  from keyed where fate <> 0),
numbered as (
  select *, row_number() over (partition by cid order by turn nulls first, role, md5(text)) as i,
         rtrim(text, {_SPACES}) as body from spoilt),
judged as (
  select *, left(role, 1) as initial, body = '' as blank,
         row_number() over (partition by cid, role, text order by i) > 1 as seen,
         right(body, 1) not in ('.', '!', '?') as open,
         lag(left(role, 1)) over (partition by cid order by i) || left(role, 1) as pair from numbered),
faults as (
  select *, blank or seen as doomed, case when not blank and not seen and open then 5 else 0 end as stays from judged),
audits as (
  {_with_inserts(_START)}
  union all
  {_with_inserts(f"select a.cid, f.i, {_best_after_row()} from audits a join faults f on a.cid = f.cid and f.i = a.i + 1")}),
ends as (
  select cid, {_least('s0', 's3')} as best from audits qualify row_number() over (partition by cid order by i desc) = 1),
measures as (
  select cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
         count_if(not blank and seen) as duplicate, count_if(stays > 0) as truncated,
         count_if(pair not in ('su', 'ua', 'au')) as illegal
  from faults group by cid)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank,
       cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
       cast(coalesce(illegal, 0) as bigint) as illegal, best.c as cost, best.a as audit,
       sha256(array_to_string(best.r, chr(10))) as repaired_sha256
from convs join ends using (cid) left join measures using (cid)
"""

REPEATED_PASSAGES = r"""
with docs as (
  select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select k, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
windows as (
  select k, p, md5(string_agg(word, ' ') over (partition by k order by p rows between current row and 34 following)) as window_key,
         count(*) over (partition by k order by p rows between current row and 34 following) as n from words),
repeated as (select window_key from windows where n = 35 group by window_key having count(*) > 1),
covered as (
  select distinct k, p + j as p
  from windows join repeated using (window_key) cross join range(35) r(j) where n = 35),
kept as (select k, string_agg(word, ' ' order by p) as kept from words anti join covered using (k, p) group by k),
removed as (select k, count(*) as n from covered group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(removed.n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from docs left join removed using (k) left join kept using (k)
"""

_ABUSE = ", ".join(f"'{w}'" for w in sorted(ABUSE))
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
words as (select k, unnest({_WORDS}) as word, unnest(range(1, len({_WORDS}) + 1)) as p from docs),
windows as (
  select k, p, md5(string_agg(word, ' ') over w) as window_key, count(*) over w as n from words
  window w as (partition by k order by p rows between current row and 2 following)),
repeated as (select k, window_key from windows where n = 3 group by all having count(*) > 1),
covered as (
  select k, count(distinct p + j) as n_repeat_words
  from windows join repeated using (k, window_key) cross join range(3) r(j) where n = 3 group by k),
line_counts as (
  select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select k, unnest(string_split(text, chr(10))) as line from docs) l
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by k),
abuse as (
  select k, count(*) as n_abuse from (select k, unnest(regexp_split_to_array(lower(text), '\s+')) as word from docs) a
  where word in ({_ABUSE}) or trim(word, '.,;:!?"()' || chr(39)) in ({_ABUSE}) group by k),
measures as (
  select doc_id, cast(len({_WORDS}) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(n_abuse, 0) as n_abuse,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) as n_upper,
         length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as n_letters
  from docs left join covered using (k) left join line_counts using (k) left join abuse using (k)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measures),
named as (
  select *, case
    when base_failed then 'base'
    when 10 * n_symbols > greatest(n_words, 1) then 'symbols'
    when n_lines >= 4 and 2 * n_dup_lines > n_lines then 'duplicate_lines'
    when n_words > 0 and not word_chars::double / n_words between 2 and 12 then 'word_length'
    when 2 * n_upper > n_letters then 'shouting'
    when n_abuse >= 2 and 500 * n_abuse >= n_words then 'abuse' end as rejected_by
  from judged)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by is null as kept, rejected_by
from named
"""

ORACLES: dict[str, str] = {
    "op5_quality": QUALITY,
    "op2_substrings": REPEATED_PASSAGES,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
