"""Every stage of the pipeline against a plain version, on the rows its predecessor kept."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urbanframe.llm import langid, library_ids, near_duplicates, packing, quality
from urbanframe.llm.queries import held_out
from urbanframe.session import ARROW_BYTES

SF = "/root/testdata/sf0.001"


def kept_by_rules(docs):
    return {d: t for d, t in docs.items() if not any(r.rejects(quality.TextView(t)) for r in quality.DEFAULT_RULES)}


def kept_by_language(docs, net):
    named = {d: langid.predict_text(net, [t]) for d, t in docs.items()}
    return {d: docs[d] for d, ((lang,), (score,)) in named.items() if lang != langid.UNDETERMINED and score >= 0.35}


def first_of_each_class(docs):
    words = {d: near_duplicates.word_hashes((t or "").encode()) for d, t in docs.items()}
    label = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and label[a] != label[b] and near_duplicates.similar(words[a], words[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d: docs[d] for d in set(label.values())}


def without_repeats(docs, window=35):
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else docs[d]
    return out


def pieces(docs, capacity=2048):
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = set()
    for d, t in docs.items():
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        for n, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start : start + (capacity if n else first)]
            out.add((d, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_every_stage_against_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
    plain = {
        "quality_rules": lambda docs, t: kept_by_rules(t),
        "language_id": lambda docs, t: kept_by_language(
            t, langid.train_language_model(docs, "doc_id", "text", "lang", ~held_out())
        ),
        "near_duplicates": lambda docs, t: first_of_each_class(t),
        "substring_dedup": lambda docs, t: without_repeats(t),
    }
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        texts = plain[name](docs, texts)
        assert after.columns == table.columns
        got = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
        assert got == texts, name
        docs = after
    name, packing = corpus_pipeline.STAGES[-1]
    rows = packing(spark, docs, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == pieces(texts)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_stages_hand_small_batches_to_the_workers(spark, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(ARROW_BYTES, None)
    try:
        stage(spark, empty, SF)
        large = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
        got = [r["size"] for r in large.mapInArrow(sizes, "size long").collect()]
        assert sum(got) > 24_000_000 and max(got) < 5_000_000
        long = spark.range(1).select(F.repeat(F.lit("x"), 6_000_000).alias("text"))  # a row is never cut
        assert [r["size"] >= 6_000_000 for r in long.mapInArrow(sizes, "size long").collect()] == [True]
        spark.conf.set(ARROW_BYTES, "9m")
        stage(spark, empty, SF)
        assert spark.conf.get(ARROW_BYTES) == "9m"
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


def test_packing_remembers_few_words_in_a_worker(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(40)]
    reference, small = Tokenizer.from_file(path), library_ids.LibraryEncoder(path, 500)
    for text in texts:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        assert len(small.cache) <= 500
    docs = spark.createDataFrame(list(enumerate(texts)) + [(50, None)], "doc_id long, text string")
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "pack_sequences", lambda *a, **k: asked.update(k) or packing.pack_sequences(*a, **k))
    rows = [tuple(r) for r in corpus_pipeline.packing(spark, docs, SF).collect()]
    assert asked["remembered"] <= 200_000 < library_ids.REMEMBERED
    assert sorted(rows) == sorted(tuple(r) for r in packing.pack_sequences(docs, "doc_id", "text", path).collect())
