"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled texts, near copies taken once, so that no
chance word of a much copied text looks typical.  Terms are words in lower case and
their beginnings, so that inflected and compound forms meet; the vocabulary holds
the terms that go with label 1 in the examples.  Vectors are TF-IDF, document
frequencies counted over all documents.  The examples stand in an inverted index in
blocks of similar ones with each term's largest weight in each block: a text opens
blocks by falling upper bound of its cosine and stops when no bound reaches its k-th
best, so the neighbours are exact.  Their votes, weighted by similarity and by how
many labelled rows an example stands for, are calibrated by an isotonic fit on the
examples' own votes, each without itself.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urbanframe.llm.batches import BoundedCache, list_array, text_slices
from urbanframe.session import materialize

PER_LABEL = 1_000  # examples of either label at most
MAX_CHARS = 8_000  # longer labelled texts are no examples
MAX_TERMS = 4_096
MIN_CHI_SQUARE = 24.0  # about one in a million by chance
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
BLOCK_EXAMPLES = 64
SLACK = 1 + 1e-9  # bounds are widened by more than their rounding

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def terms_of_word(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in words_of(text).items():
        for term in terms_of_word(word):
            out[term] += n
    return out


@dataclass(frozen=True)
class Example:
    id: object
    label: int
    text: str
    copies: int = 1  # sampled texts of this label that it stands for, itself included


def distinct_examples(examples: list[Example]) -> list[Example]:
    """One example, the first, for each group of near copies with one label.

    Texts are near copies if two of their eight least hashed 5-word shingles agree (short
    texts: all of their words), and groups are closed under that.
    """
    parent = list(range(len(examples)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, e in enumerate(examples):
        words = e.text.lower().split()
        shingles = {zlib.crc32(" ".join(words[j : j + 5]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(words) - 4))}
        least = heapq.nsmallest(8, shingles)
        pairs = [(a, b) for j, a in enumerate(least) for b in least[j + 1 :]] or [(least[0], None)]
        for pair in pairs:
            parent[root(i)] = root(seen.setdefault((e.label, *pair), i))
    groups: dict[int, list[Example]] = {}
    for i, e in enumerate(examples):
        groups.setdefault(root(i), []).append(e)
    return [Example(g[0].id, g[0].label, g[0].text, len(g)) for g in groups.values()]


def draw_examples(
    docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id_col: str, label_col: str,
    may_learn: Column, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS,
) -> tuple[list[Example], dict[int, int]]:
    """At most ``per_label`` texts of each label, those of least hashed id, near copies
    once, and the labels' counts over all rows.

    A document labelled more than once has its largest label; null ids and labels are left out.
    """
    known = (
        labels.select(F.col(label_id_col).alias("id"), F.col(label_col).alias("label"), may_learn.alias("may"))
        .filter(F.col("may") & F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id")
        .agg((F.max("label") > 0).cast("int").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fit = texts.select("id", F.length("text").between(1, max_chars).alias("fit")).filter("fit")
    usable = known.join(fit.groupBy("id").agg(F.first("fit").alias("fit")).hint("merge"), "id")
    spread = F.xxhash64("id")
    chosen: dict = {}
    for label in sorted(totals):
        rows = usable.filter(F.col("label") == label).orderBy(spread, "id").limit(per_label).select("id").collect()
        chosen.update((r["id"], label) for r in rows)
    if not chosen:
        return [], totals
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], texts.select("id").schema)
    found = texts.filter(F.length("text").between(1, max_chars)).join(F.broadcast(wanted), "id")
    pairs = found.groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    return distinct_examples([Example(r["id"], chosen[r["id"]], r["text"]) for r in pairs]), totals


def marking_terms(examples: list[Example], counts: list[Counter]) -> dict[str, int]:
    """Terms that go with label 1 beyond chance, numbered; the strongest if there are too many."""
    n = len(examples)
    positive = sum(e.label for e in examples)
    total: Counter = Counter()
    hits: Counter = Counter()
    for e, own in zip(examples, counts):
        total.update(own.keys())
        if e.label:
            hits.update(own.keys())
    strength = []
    for term, a in hits.items():
        held = total[term]
        excess = a * n - held * positive
        spread = held * (n - held) * positive * (n - positive)
        if excess > 0 and spread and n * excess * excess / spread >= MIN_CHI_SQUARE and a > 1:
            strength.append((-n * excess * excess / spread, term))
    return {term: i for i, (_, term) in enumerate(sorted(strength)[:MAX_TERMS])}


class BlockMaxIndex:
    """Examples' unit vectors, in blocks, with every term's largest weight in a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK_EXAMPLES):
        present = [i for i, (t, _) in enumerate(vectors) if len(t)]
        # examples of one strongest term come together, which keeps the blocks' maxima tight
        present.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
        self.numbers = np.array(present, dtype=np.int64)
        sizes = np.array([len(vectors[i][0]) for i in present], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.terms = np.concatenate([vectors[i][0] for i in present] or [np.zeros(0, np.int64)])
        self.weights = np.concatenate([vectors[i][1] for i in present] or [np.zeros(0)])
        self.width = terms
        self.cuts = np.append(np.arange(0, len(present), block), len(present))
        self.maxima = np.zeros((terms, len(self.cuts) - 1))
        owner = np.repeat(np.arange(len(present)) // block, sizes)
        np.maximum.at(self.maxima, (self.terms, owner), self.weights)
        self.opened = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the ``k`` nearest, nearest first, ties by example; 0 is not near."""
        if not len(terms) or not len(self.numbers):
            return []
        bounds = weights @ self.maxima[terms] * SLACK
        query = np.zeros(self.width)
        query[terms] = weights
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0]:
                break
            self.opened += 1
            lo, hi = self.cuts[b], self.cuts[b + 1]
            x, y = self.starts[lo], self.starts[hi]
            near = np.add.reduceat(query[self.terms[x:y]] * self.weights[x:y], self.starts[lo:hi] - x)
            floor = -best[-1][0] if len(best) == k else 0.0
            for i in np.flatnonzero((near >= floor) & (near > 0)):
                if self.numbers[lo + i] != leave_out:
                    best.append((-float(near[i]), int(self.numbers[lo + i])))
            best.sort()
            del best[k:]
        return [(-s, i) for s, i in best]


@dataclass
class ToxicityModel:
    """What a scored text needs: vocabulary, weights, index and calibration, all of bounded size."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list
    labels: list[int]
    shares: list[float]  # labelled rows that an example stands for
    index: BlockMaxIndex
    base: float
    steps: list[float] = field(default_factory=list)  # calibration: votes ...
    values: list[float] = field(default_factory=list)  # ... and scores, both rising
    k: int = NEIGHBOURS

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit_vector(terms, counts, self.idf)

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [s * self.shares[i] for s, i in near]
        return sum(w for w, (_, i) in zip(weights, near) if self.labels[i]) / sum(weights)

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        at = bisect_right(self.steps, self.vote(near) + 1e-12) - 1
        return self.values[max(at, 0)]


def unit_vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * idf[terms]
    return terms, weights / math.sqrt(float(weights @ weights)) if len(terms) else weights


def isotonic(votes: list[float], labels: list[int], weights: list[float]) -> tuple[list[float], list[float]]:
    """Rising steps of least squared error (adjacent violators pooled); each holds half a row of either label more."""
    pools: list[list[float]] = []  # first vote, weight of label 1, weight
    for v, y, w in sorted(zip(votes, labels, weights)):
        if pools and pools[-1][0] == v:
            pools[-1][1] += w * y
            pools[-1][2] += w
        else:
            pools.append([v, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, one, all_ = pools.pop()
            pools[-1][1] += one
            pools[-1][2] += all_
    return [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def vocabulary_vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> DataFrame:
    """``id, terms, counts``: the vocabulary's terms in every whole text."""

    def known(word: str) -> tuple[int, ...]:
        return tuple(vocabulary[t] for t in terms_of_word(word) if t in vocabulary)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = BoundedCache(known, 300_000)
        for batch in text_slices(batches, "text"):
            lengths, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                for word, n in words_of(text).items():
                    for t in cache[word]:
                        found[t] += n
                lengths.append(len(found))
                terms.extend(found)
                counts.extend(found.values())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    list_array(np.array(terms, np.int32), lengths, pa.int32()),
                    list_array(np.array(counts, np.int64), lengths, pa.int64()),
                ],
                names=["id", "terms", "counts"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(vectors, f"id {kind}, terms array<int>, counts array<bigint>")


def fit_model(
    examples: list[Example], counts: list[Counter], vocabulary: dict[str, int], totals: dict[int, int],
    documents: int, holding: np.ndarray, k: int = NEIGHBOURS,
) -> ToxicityModel:
    """Index and calibration from the examples, with document frequencies over ``documents`` rows."""
    idf = np.log((1 + documents) / (1 + holding)) + 1
    vectors = []
    for own in counts:
        pairs = sorted((vocabulary[t], n) for t, n in own.items() if t in vocabulary)
        terms = np.array([t for t, _ in pairs], dtype=np.int64)
        vectors.append(unit_vector(terms, np.array([n for _, n in pairs], dtype=np.float64), idf))
    drawn: Counter = Counter()
    for e in examples:
        drawn[e.label] += e.copies
    shares = [totals[e.label] * e.copies / drawn[e.label] for e in examples]
    model = ToxicityModel(
        vocabulary, idf, [e.id for e in examples], [e.label for e in examples], shares,
        BlockMaxIndex(vectors, len(vocabulary)), 0.0, k=k,
    )
    votes, of, weights = [], [], []
    bare = [0.0, 0.0]
    for i, (vector, e) in enumerate(zip(vectors, examples)):
        near = model.index.nearest(*vector, k, leave_out=i)
        if near:
            votes.append(model.vote(near))
            of.append(e.label)
            weights.append(shares[i])
        else:
            bare[e.label] += shares[i]
    model.base = bare[1] / (sum(bare) + 1)
    model.steps, model.values = isotonic(votes, of, weights) if votes else ([0.0], [model.base])
    return model


def toxicity_scores(
    docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id_col: str, label_col: str,
    may_learn: Column, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS, k: int = NEIGHBOURS,
) -> DataFrame:
    """``<id_col>, score, evidence`` for every row: ``evidence`` is a list of the nearest
    examples (``example, label, similarity``), nearest first.

    Learns from at most ``per_label`` labelled texts of either label with at most
    ``max_chars`` characters, among the rows of ``labels`` for which ``may_learn`` holds;
    whole texts are scored, and document frequencies cover all rows.  Texts without a term
    of the vocabulary (null and empty ones too) have no evidence and the examples' share of
    label 1 among such texts; without labelled rows the score is 0.  Repeated rows stay
    repeated and score alike; equal similarities rank by example id.  The score depends on
    the text alone.
    """
    examples, totals = draw_examples(
        docs, id_col, text_col, labels, label_id_col, label_col, may_learn, per_label, max_chars
    )
    counts = [term_counts(e.text) for e in examples]
    vocabulary = marking_terms(examples, counts)
    vectors = materialize(vocabulary_vectors(docs, id_col, text_col, vocabulary), "toxicity-vectors")
    documents = vectors.count()
    holding = np.zeros(len(vocabulary))
    # at most one row per term of the vocabulary
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        holding[row["t"]] = row["count"]
    model = fit_model(examples, counts, vocabulary, totals, documents, holding, k)
    kind = to_arrow_type(vectors.schema["id"].dataType)
    entry = pa.struct([("example", kind), ("label", pa.int32()), ("similarity", pa.float64())])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = [], []
            for terms, n in zip(batch.column(1), batch.column(2)):
                near = []
                if len(terms):
                    t = terms.values.to_numpy()
                    order = np.argsort(t)  # one order of summation for one vector
                    weighed = n.values.to_numpy()[order].astype(np.float64)
                    near = model.index.nearest(*model.vector(t[order].astype(np.int64), weighed), model.k)
                scores.append(model.score(near))
                evidence.append([{"example": model.ids[i], "label": model.labels[i], "similarity": s} for s, i in near])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(entry))],
                names=["id", "score", "evidence"],
            )

    shown = vectors.schema["id"].dataType.simpleString()
    out = f"id {shown}, score double, evidence array<struct<example: {shown}, label: int, similarity: double>>"
    return vectors.mapInArrow(judge, out).withColumnRenamed("id", id_col)
