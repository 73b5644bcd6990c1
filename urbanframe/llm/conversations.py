"""Conversation structure repair: cheapest audits by a persistent dynamic program.

A conversation's rows are read in order.  An audit names one edit per row, and the
inserts between them, by its initial: ``K`` keep (0), ``R`` rerole to user or
assistant (1), ``D`` delete (2; the only edit of a blank or duplicate row), ``I``
insert an empty user or assistant row (5).  A truncated row that stays adds 5.  The
roles left must read ``(s?(ua)+)?`` by their initials; of the cheapest audits the
least in ASCII order is taken.

After each row the program holds, for each of the four states of that pattern, the
best audit so far.  Audits are nodes of a trie: a node is one edit and a link to the
prefix before it, so all states share their prefixes.  Ties are decided at the first
difference, which binary lifting finds in logarithmic time: two ancestors of equal
rolling hash are the same prefix.  Within a trie equal prefixes are one node (the
edits fix the row and the state reached), so node identity verifies every hash match.
No audit that ties is a prefix of another, as the difference would be inserts, which
cost; the order at the first difference therefore holds for every continuation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urbanframe.llm.batches import BoundedCache, text_slices

# fixed values: white space, sentence ends, legal neighbours
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
ROLES = {"u": "user", "a": "assistant"}

# states of the role pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
EXPECTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # role that a rerole or an insert takes
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5

# a row's code: index of its role's initial, and two flags
INITIALS = "sua?"
TRUNCATED, DOOMED = 4, 8

_PRIME, _BASE = (1 << 61) - 1, 0x9E3779B97F4A7C1
BATCH_BYTES = 4 << 20
CACHED_ROWS = 64


class AuditTrie:
    """Prefixes of audits as linked nodes; node 0 is the empty prefix."""

    def __init__(self) -> None:
        self.letter = bytearray(1)
        self.depth = array("q", [0])
        self.hash = array("Q", [0])
        self.up = [array("q", [0])]  # up[j][node]: the prefix that is 2**j edits shorter (node 0 if there is none)
        self.collisions = 0

    def add(self, parent: int, letter: int) -> int:
        node, depth = len(self.depth), self.depth[parent] + 1
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * _BASE + letter) % _PRIME)
        if depth >> len(self.up):
            self.up.append(array("q", bytes(8 * node)))
        ancestor = parent
        for level in self.up:
            level.append(ancestor)
            ancestor = level[ancestor]
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of ``node`` that is ``depth`` edits long."""
        j, rest = 0, self.depth[node] - depth
        while rest:
            if rest & 1:
                node = self.up[j][node]
            j, rest = j + 1, rest >> 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of equal length are equal; a hash match is verified."""
        if self.hash[a] != self.hash[b]:
            return False
        self.collisions += a != b
        return a == b

    def less(self, a: int, x: int, b: int, y: int) -> bool:
        """Whether prefix ``a`` followed by edit ``x`` is less than ``b`` followed by ``y``."""
        n = min(self.depth[a], self.depth[b])
        left, right = self.ancestor(a, n), self.ancestor(b, n)
        if self.same(left, right):
            if self.depth[a] > n:
                x = self.letter[self.ancestor(a, n + 1)]
            if self.depth[b] > n:
                y = self.letter[self.ancestor(b, n + 1)]
            return x < y
        for level in reversed(self.up):
            p, q = level[left], level[right]
            if not self.same(p, q):
                left, right = p, q
        return self.letter[left] < self.letter[right]

    def text(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.up[0][node]
        return out[::-1].decode()


def cheapest_audit(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the rows with these codes; time n log n."""
    trie = AuditTrie()
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
    _insert(trie, best)
    for code in codes:
        kept = INITIALS[code & 3]
        stays = TRUNCATED_COST if code & TRUNCATED else 0
        offers: list[tuple[int, int, int] | None] = [None] * 4
        for state, entry in enumerate(best):
            if entry is None:
                continue
            cost, node = entry
            edits = [(cost + DELETE_COST, state, 68)]
            if not code & DOOMED:
                if (state, kept) in STEP:
                    edits.append((cost + KEEP_COST + stays, STEP[state, kept], 75))
                edits.append((cost + REROLE_COST + stays, STEP[state, EXPECTED[state]], 82))
            for total, reached, letter in edits:
                held = offers[reached]
                if held is None or total < held[0] or total == held[0] and trie.less(node, letter, held[1], held[2]):
                    offers[reached] = (total, node, letter)
        best = [None if o is None else (o[0], trie.add(o[1], o[2])) for o in offers]
        _insert(trie, best)
    ends = [best[s] for s in ACCEPTING if best[s] is not None]
    least = min(cost for cost, _ in ends)
    tied = [node for cost, node in ends if cost == least]
    winner = tied[0]
    for node in tied[1:]:
        # an edit below every letter closes both, so that a prefix would come first
        if trie.less(node, 0, winner, 0):
            winner = node
    return least, trie.text(winner)


def _insert(trie: AuditTrie, best: list[tuple[int, int] | None]) -> None:
    """Improve the states by inserts until nothing changes (every insert costs, so it ends)."""
    changed = True
    while changed:
        changed = False
        for state, entry in enumerate(best):
            if entry is None:
                continue
            cost, (reached, letter) = entry[0] + INSERT_COST, (STEP[state, EXPECTED[state]], 73)
            held = best[reached]
            if held is None or cost < held[0] or (
                cost == held[0] and held[1] and trie.less(entry[1], letter, trie.up[0][held[1]], trie.letter[held[1]])
            ):
                best[reached] = (cost, trie.add(entry[1], letter))
                changed = True


class _Conversation:
    """What is gathered of one conversation while its rows pass, without their texts."""

    def __init__(self, key) -> None:
        self.key, self.codes, self.seen = key, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.last = 0, None, None
        self.before: str | None = None

    def add(self, turn: int | None, role: str, mark: bytes, blank: bool, ended: bool) -> None:
        if turn is not None:  # turns rise, so another one than the last is new
            if self.last != turn:
                self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = initial
        code = INITIALS.find(initial) if initial and initial in INITIALS[:3] else 3
        if blank:
            self.blank += 1
            code |= DOOMED
        elif (role, mark) in self.seen:
            self.duplicate += 1
            code |= DOOMED
        elif not ended:
            self.truncated += 1
            code |= TRUNCATED
        self.seen.add((role, mark))
        self.codes.append(code)

    def summary(self, cached: BoundedCache) -> tuple:
        codes = bytes(self.codes)
        cost, audit = cached[codes] if len(codes) <= CACHED_ROWS else cheapest_audit(codes)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Summaries of a partition's conversations; its rows are in order."""
    cached = BoundedCache(cheapest_audit, 200_000)
    now: _Conversation | None = None
    for batch in batches:
        for key, present, turn, role, mark, blank, ended in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.key != key:
                if now is not None:
                    yield now.summary(cached)
                now = _Conversation(key)
            if present:
                now.add(turn, role, mark, blank, ended)
    if now is not None:
        yield now.summary(cached)


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, audit row or None, place, role, text) as the rows pass behind their audit.

    The audit's own row comes first, with a place of -1.  Nothing but the audit is held.
    """
    key, audit, at, state, place = None, "", 0, START, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role = ROLES[EXPECTED[state]]
            yield key, None, place, role, ""
            at, place, state = at + 1, place + 1, STEP[state, role[0]]

    for batch in text_slices(batches, "text"):
        for k, kind, role, text, summary in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "s"))):
            if kind == 0:
                key, audit, at, state, place = k, summary["audit"], 0, START, 0
                yield key, summary, -1, None, None
                yield from inserts()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                role = role if edit == "K" else ROLES[EXPECTED[state]]
                yield key, None, place, role, text
                place, state = place + 1, STEP[state, role[:1]]
            yield from inserts()


def _plain(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    kept = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(
        F.col(conv_col).alias("conv"),
        kept.alias("present"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.when(kept, F.coalesce(F.col(text_col), F.lit(" "))).alias("text"),
    )
    return rows.withColumn("mark", F.unhex(F.md5("text")))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.asc_nulls_first("turn"), "role", "mark")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _summaries(rows: DataFrame) -> DataFrame:
    """``conv``, the counts and the audit of every conversation; no text travels."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    flagged = rows.select(
        "conv", "present", "turn", "role", "mark",
        (F.length(body) == 0).alias("blank"),
        F.right(body, F.lit(1)).isin(*ENDS).alias("ended"),
    )
    key_type = to_arrow_type(rows.schema["conv"].dataType)
    fields = (["conv", *_COUNTS, "audit"], [key_type, *[pa.int64()] * len(_COUNTS), pa.string()])
    shown = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {shown}, {', '.join(f'{n} long' for n in _COUNTS)}, audit string"
    return _ordered(flagged).mapInArrow(lambda batches: _in_batches(_audits(batches), fields), schema)


def _behind_audits(rows: DataFrame) -> DataFrame:
    """Every conversation's audit (kind 0), then its rows in order (kind 1)."""
    summaries = _summaries(rows)
    audits = summaries.select("conv", F.lit(0).alias("kind"), F.struct(*_COUNTS, "audit").alias("s"))
    texts = rows.filter("present").select("conv", F.lit(1).alias("kind"), "turn", "role", "mark", "text")
    return _ordered(audits.unionByName(texts, allowMissingColumns=True), "kind")


def audit_conversations(
    df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None = None
) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its cheapest audit,
    and ``repaired_sha256`` of the repaired ``role:text`` rows joined by line breaks.

    ``gaps`` counts missing turns between the least and the largest; ``blank``,
    ``duplicate`` and ``truncated`` count rows by their first fault; ``illegal`` counts
    neighbours whose initials are none of su, ua, au.  Rows are taken by turn (nulls
    first), ties by role and the text's digest, so repeated rows are neighbours and the
    second is a duplicate.  A null role or text counts as one space; null ids form one
    conversation.  Rows where ``present`` is not true only name their conversation: without
    other rows it has zeros, an empty audit and the hash of nothing.  An empty role and
    roles of other initials have no legal place and are reroled or deleted.  Other columns
    are never read; an empty table gives an empty result.

    The hash is a running one, so a conversation's rows pass through one task in order.
    The first pass carries no texts and holds a code, a digest and the trie's nodes of each
    row of a conversation (about 1 KB); the second holds its audit and one batch of rows.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(_digested(batches), fields)

    rows = _behind_audits(_plain(df, conv_col, turn_col, role_col, text_col, present))
    key_type = to_arrow_type(rows.schema["conv"].dataType)
    names = ["conv", *_COUNTS, "audit", "repaired_sha256"]
    fields = (names, [key_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()])
    longs = ", ".join(f"{n} long" for n in _COUNTS)
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {longs}, audit string, repaired_sha256 string"
    return rows.mapInArrow(digests, schema).withColumnRenamed("conv", conv_col)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    head, digest = None, hashlib.sha256()
    for key, summary, place, role, text in _repaired(batches):
        if summary is not None:
            if head is not None:
                yield (*head, digest.hexdigest())
            head, digest = (key, *(summary[n] for n in _COUNTS), summary["audit"]), hashlib.sha256()
        else:
            digest.update((b"\n" if place else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if head is not None:
        yield (*head, digest.hexdigest())


def repair_conversations(
    df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None = None
) -> DataFrame:
    """The repaired rows: ``<conv_col>, place, role, text``, places from 0.

    Inserted rows have an empty text.  Nulls, ties and repeated rows as in
    :func:`audit_conversations`; conversations without a row left give none.
    """

    def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_only = ((key, place, role, text) for key, summary, place, role, text in _repaired(batches) if summary is None)
        return _in_batches(rows_only, fields, lambda row: 64 + len(row[3]))

    rows = _behind_audits(_plain(df, conv_col, turn_col, role_col, text_col, present))
    key_type = to_arrow_type(rows.schema["conv"].dataType)
    fields = (["conv", "place", "role", "text"], [key_type, pa.int64(), pa.string(), pa.string()])
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, place long, role string, text string"
    return rows.mapInArrow(repaired, schema).withColumnRenamed("conv", conv_col)


def _in_batches(
    rows: Iterable[tuple], fields: tuple[list[str], list[pa.DataType]], size: Callable[[tuple], int] = lambda row: 1024
) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``BATCH_BYTES`` by ``size``."""
    names, kinds = fields
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``df`` with its columns and ``present``: rows spoilt by the checksum of ``conv:turn``.

    Of 20 remainders 0 drops the row (``present`` is false), 1 empties its text, 2 takes
    away its sentence ends, 3 repeats it, 4 makes its role user.  Nulls read as one space.
    """
    names = [conv_col, turn_col, role_col, text_col]
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in names]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(shown[3], ENDS, "")).otherwise(shown[3])
    return df.select(
        F.col(conv_col),
        F.col(turn_col),
        F.when(fate == 4, "user").otherwise(shown[2]).alias(role_col),
        text.alias(text_col),
        (fate != 0).alias("present"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
