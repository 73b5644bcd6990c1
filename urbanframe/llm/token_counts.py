"""Token counts of a unigram vocabulary, without the tokens.

An Aho-Corasick automaton reports every vocabulary piece that ends at each
character; a Viterbi pass keeps, per character, only the best score and the
number of pieces on the best way there.  Ties fall as in the ``tokenizers``
library: of equal scores the way whose last piece starts earlier stays.  A
character that is no piece costs the least score less 10, joins its neighbours
that are no pieces either, and counts one token a byte (byte fallback).

The text is read with spaces as U+2581 and one U+2581 in front, as sentencepiece
vocabularies are.  No piece holds U+2581 after another character, so words are
counted apart and cached.  Empty and null text have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import BoundedCache, text_slices

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0  # fixed value of the library


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = {piece for piece, _ in vocabulary}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.cache = BoundedCache(self.best)

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best way through ``text`` (spaces already marked)."""
        n, pieces, unknown = len(text), self.pieces, self.unknown
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        run = [0] * (n + 1)  # start + 1 of the run of unknown characters that ends here
        matches: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            matches[end].append(match)
        for end in range(1, n + 1):
            top, tokens, began = None, 0, 0
            # longest piece first, that is the earliest start: later ones must be better
            for length, value in sorted(matches[end - 1], reverse=True):
                start = end - length
                if top is None or score[start] + value > top:
                    top, tokens = score[start] + value, count[start] + 1
            if text[end - 1] not in pieces and (top is None or score[end - 1] + unknown > top):
                top = score[end - 1] + unknown
                began = run[end - 1] or end
                before = count[began - 1]
                joined = text[began - 1 : end]
                tokens = before + (1 if joined in pieces else len(joined.encode("utf-8", "surrogatepass")))
            score[end], count[end], run[end] = top, tokens, began
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.cuttable or MARK in text:
            return self.best(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = _CHUNKS.findall(MARK + text.replace(" ", MARK))
        else:
            chunks = [MARK + w for w in text.split(" ")]
        found = list(map(self.cache.__getitem__, chunks))
        return sum(c for c, _ in found), sum(s for _, s in found)


@lru_cache(maxsize=2)
def counter(model_path: str) -> UnigramCounter:
    return UnigramCounter(piece_scores(model_path))


def count_tokens(df: DataFrame, id_col: str, text_col: str, model_path: str) -> DataFrame:
    """Per row: ``id_col, n_tokens, score`` (of the best way) of the whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = counter(model_path)
        for batch in text_slices(batches, "text"):
            found = [unigram.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c for c, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["id", "n_tokens", "score"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)
