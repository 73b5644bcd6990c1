"""Quality rules as a short-circuit cascade.

A rule rejects a document.  On a sample each rule's mean cost and share of
rejections are measured, and the rules are ordered by rejections per cost: cheap
rules that reject much run first, and a document leaves the cascade at the first
rule that rejects it.  The order changes only the work, never the verdict, so the
sample needs no representative draw.

Words are maximal runs of characters other than space and 09-0D, unchanged.  Null
text has no words.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import text_slices

# fixed values: word separators and symbol characters
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# terms of abuse
ABUSE = frozenset(
    "idiot idiots moron morons imbecile scum scumbag loser losers pathetic worthless disgusting "
    "stupid trash clown retard dumbass bastard bitch asshole".split()
)


class TextView:
    """Measures of one text, each computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() parts at exactly the ASCII separators above
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SEPARATORS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SEPARATORS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that occurs twice or more in the text."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        covered, end = 0, 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def upper_share(self) -> float:
        upper = sum(map(str.isupper, self.text))
        letters = sum(map(str.isalpha, self.text))
        return upper / letters if letters else 0.0

    @cached_property
    def abuse(self) -> int:
        hits = 0
        for word in self.text.lower().split():
            if word in ABUSE or word.strip(".,;:!?\"'()") in ABUSE:
                hits += 1
        return hits


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextView], bool]


def base_failed(v: TextView) -> bool:
    """Fewer than 50 words, or over half of the words in repeated 3-word windows."""
    n = len(v.words)
    return n < 50 or 100 * v.n_repeat_words > 50 * n


def _mean_word_length(v: TextView) -> bool:
    return bool(v.words) and not 2.0 <= v.word_chars / len(v.words) <= 12.0


def _abusive(v: TextView) -> bool:
    """One term of abuse among 500 words at least, or a single one among 100: a long text may use the word trash."""
    return v.abuse > 0 and (500 if v.abuse >= 2 else 100) * v.abuse >= len(v.words)


BASE_RULE = Rule("base", base_failed)
DEFAULT_RULES = (
    BASE_RULE,
    Rule("symbols", lambda v: 10 * v.n_symbols > max(len(v.words), 1)),
    Rule("duplicate_lines", lambda v: len(v.lines) >= 4 and 2 * v.n_dup_lines > len(v.lines)),
    Rule("word_length", _mean_word_length),
    Rule("shouting", lambda v: v.upper_share > 0.5),
    Rule("abuse", _abusive),
)


def order_rules(
    df: DataFrame, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 256, seed: int = 7
) -> list[Rule]:
    """Rules by falling rejections per second, measured on ``sample_rows`` sampled texts.

    The sampling stops reading once it has its rows.  Sampled texts are cut to
    20,000 characters for timing only.  Without rows the given order stays.
    """
    rows = df.select(F.substring(F.col(text_col), 1, 20_000).alias("t")).sample(fraction=0.05, seed=seed)
    texts = [r["t"] for r in rows.limit(sample_rows).collect()]
    if not texts:
        return list(rules)
    merit = {}
    for rule in rules:
        began, rejected = time.perf_counter(), 0
        for text in texts:
            rejected += rule.rejects(TextView(text))  # a fresh view: the cost of running first
        cost = time.perf_counter() - began
        merit[rule.name] = rejected / len(texts) / max(cost, 1e-9)
    return sorted(rules, key=lambda r: -merit[r.name])


def first_rejection(view: TextView, rules: Iterable[Rule]) -> str | None:
    """Name of the first rule that rejects, or ``None``; later rules are not run."""
    for rule in rules:
        if rule.rejects(view):
            return rule.name
    return None


def quality_verdicts(
    df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 256
) -> DataFrame:
    """Per row: ``id_col``, base measures, ``base_failed``, ``kept`` and ``rejected_by``.

    ``rejected_by`` names the first rejecting rule in the order of ``rules`` (``base`` first
    if that fails), which does not depend on the measured order.  A null, empty or blank
    text has no words and fails the base rule.  Row-wise: no shuffle; repeated rows stay
    repeated; an empty table gives an empty result; other columns are never read.
    """
    ordered = order_rules(df, text_col, rules, sample_rows)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [r for r in ordered if r.name != BASE_RULE.name]
        declared = [r for r in rules if r.name != BASE_RULE.name]
        for batch in text_slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                v = TextView(text)
                failed = base_failed(v)  # its measures are returned for every row
                by = BASE_RULE.name if failed else first_rejection(v, others) and first_rejection(v, declared)
                rows.append(
                    (len(v.words), v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, failed, by is None, by)
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *_NAMES])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, {_SCHEMA}").withColumnRenamed("id", id_col)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, rejected_by string"
)


def keep_quality(df: DataFrame, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 256) -> DataFrame:
    """The rows of ``df``, all columns unchanged, that no rule rejects (full short circuit).

    Null, empty and blank texts go, as they have no words; rows that repeat all stay or all go.
    """
    ordered = order_rules(df, text_col, rules, sample_rows)
    at = df.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [first_rejection(TextView(t.as_py()), ordered) is None for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(keep, df.schema)
