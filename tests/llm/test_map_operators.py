"""Row-wise operators: libraries, brute force and hostile rows."""

import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from urbanframe.llm import byte_bpe, langid, library_ids, lm_scoring, quality, token_counts
from urbanframe.llm.queries import op1_byte_bpe
from urbanframe.session import ARROW_BYTES

LONG = "ab" * 3000 + " " + "-" * 999
HOSTILE = [None, "", " ", "\n\t", "  a", "a  b ", "\x1c a\x1d b", "é́ x", "漢字 テスト", "😀😀 😀", "it's we'll  I'M",
           "a\u0085b \u0085 c", "<|endoftext|>", "İΣß Σ", LONG, "same text here", "same text here"]


def hostile(spark):
    """Nulls, empty, long and repeated rows, with columns whose names the operators use inside."""
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(HOSTILE)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, node int")


def random_texts(n=800, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab \n\t'sé漢1-!\x1c ́") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_tiktoken_and_round_trips(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = random_texts() + [t or "" for t in HOSTILE]
    got = byte_bpe.encoder(path, P.PATTERN).encode_texts(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    coded = byte_bpe.byte_bpe_encode(hostile(spark), "doc_id", "text", path, P.PATTERN)
    rows = byte_bpe.byte_bpe_decode(coded, "doc_id", "ids", path).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == sorted(t or "" for t in HOSTILE)
    assert byte_bpe.byte_bpe_encode(hostile(spark).limit(0), "doc_id", "text", path, P.PATTERN).count() == 0


def test_segment_tree_for_long_pretokens_equals_the_matrix_form():
    bpe = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdethin") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    one = [byte_bpe.merge_one(bpe.pairs.base[np.frombuffer(w, np.uint8)].tolist(), bpe.pairs) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merge_many(words, bpe.pairs)] == one


def test_bpe_cache_is_bounded_by_bytes():
    bpe = byte_bpe.ByteBpe({bytes([b]): b for b in range(256)}, P.PATTERN)  # no merges: a word's ids are its bytes
    held = []
    for n in range(200):
        words = [f"{n * 1000 + i:06}".ljust(60, "z") for i in range(1000)]
        text = " ".join(words)
        assert bpe.encode_texts([text]) == [np.frombuffer(text.encode(), np.uint8).astype("<u4").tobytes()]
        if n % 10 == 9:
            held.append(sum(sys.getsizeof(x) for kept in (bpe.older, bpe.cache) for entry in kept.items() for x in entry))
    assert byte_bpe.CACHE_BYTES // 2 < max(held) < byte_bpe.CACHE_BYTES


def test_bpe_cache_keeps_words_in_use_when_it_is_full(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 8_000)
    bpe = byte_bpe.ByteBpe(byte_bpe.load_ranks(path), P.PATTERN)
    for n in range(40):
        text = " ".join(["it", "often", "a\nb", "", *(f"wörd{n}x{i}" for i in range(10)), "often"])
        assert np.frombuffer(bpe.encode_texts([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
        assert "often" in bpe.cache or "often" in bpe.older
    assert len(bpe.cache) + len(bpe.older) < 70 and "wörd0x0" not in bpe.cache | bpe.older


def test_op1_hands_small_batches_to_the_workers_and_keeps_whole_texts(spark, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    text = F.concat(F.repeat(F.concat_ws(" ", F.col("doc_id"), F.lit("text ")), F.lit(500)), F.lit("end"))
    docs = spark.range(0, 2500, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", text)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.unset(ARROW_BYTES)
    try:
        got = op1_byte_bpe(spark, str(tmp_path)).join(docs, "doc_id")
        whole = F.col("decoded_sha256") == F.sha2(F.col("text").cast("binary"), 256)
        assert got.filter(whole).count() == 2500
        batches = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
        assert sum(batches) > 10_000_000 and max(batches) < 5_000_000
        spark.conf.set(ARROW_BYTES, "9m")
        op1_byte_bpe(spark, str(tmp_path))
        assert spark.conf.get(ARROW_BYTES) == "9m"
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_ids_equal_the_library(name):
    e = library_ids.encoder(P.path(name))
    for t in random_texts(600) + [t or "" for t in HOSTILE]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_of_letters_are_not_split_by_the_pattern():
    """A word of plain letters is one pre-token; other plain pieces are split as the library splits them."""
    e = library_ids.LibraryEncoder(P.path("word_bpe_49k.json"))
    plain, split, asked = [c for c in map(chr, range(0x130)) if library_ids._PLAIN.fullmatch(c)], e.pattern, []

    class Asked:
        def findall(self, text):
            asked.append(text)
            return split.findall(text)

    e.pattern = Asked()
    rng = random.Random(3)
    signs = plain + ["'", "s", "t", "r", "e", "l", "1", ",", "."] * 20
    pieces = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 10))) for _ in range(3000)]
    pieces += ["".join(rng.choice([c for c in plain if c.isalpha()]) for _ in range(rng.randint(1, 10))) for _ in range(1000)]
    for p in pieces + plain:
        assert np.frombuffer(e.encode(p), "<u4").tolist() == e.tokenizer.encode(p, add_special_tokens=False).ids
    assert asked and not any(x.isalpha() for x in asked)


def test_token_counts_equal_the_unigram_library(spark):
    path = P.path("piece_bpe_32k.model")
    reference = Tokenizer(models.Unigram(token_counts.piece_scores(path), unk_id=0, byte_fallback=True))

    def expected(t):
        return len(reference.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0

    counter = token_counts.counter(path)
    for t in random_texts(800) + ["▁a b", "x ▁", "<0x0A>"]:
        assert counter.count(t)[0] == expected(t)
    rows = token_counts.count_tokens(hostile(spark), "doc_id", "text", path).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(expected(t) for t in HOSTILE)


def test_quality_measures_against_brute_force(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c#", "d|e", "\nx", "x\n", "lang"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    for text in texts + [t or "" for t in HOSTILE]:
        v, w = quality.TextView(text), word.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 300 else None
        lines = [line for line in text.split("\n") if word.search(line)]
        assert (len(v.words), v.word_chars, v.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert v.n_dup_lines == sum(line in lines[:i] for i, line in enumerate(lines))
        assert covered is None or v.n_repeat_words == len(covered)
    rows = quality.quality_verdicts(hostile(spark), "doc_id", "text").collect()
    assert len(rows) == len(HOSTILE) and all(r["base_failed"] and not r["kept"] for r in rows)


def test_cascade_order_changes_no_verdict_and_stops_early(spark):
    ran = []
    rules = [quality.Rule(n, lambda v, n=n, bad=bad: ran.append(n) or bad in v.text) for n, bad in (("a", "x"), ("b", "y"))]
    assert quality.first_rejection(quality.TextView("x y"), rules) == "a" and ran == ["a"]
    clean = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, clean), (2, clean + " idiot"), (3, "### " * 60 + clean), (4, clean)], "doc_id int, text string")
    for order in (quality.DEFAULT_RULES, quality.DEFAULT_RULES[::-1]):
        assert {r[0] for r in quality.quality_verdicts(df, "doc_id", "text", order).filter("kept").select("doc_id").collect()} == {1, 4}
        assert quality.keep_quality(df, "text", order).count() == 2


def test_language_model_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "of", "that"], "bb": ["der", "und", "nicht", "schön"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(40)), g) for i in range(200) for g in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !!", None), (902, "", None)], "doc_id int, text string, lang string")
    net = langid.train_language_model(df, "doc_id", "text", "lang", F.col("doc_id") % 4 != 2, per_language=60)
    got = {r["doc_id"]: r for r in langid.identify_language(df, "doc_id", "text", net).collect()}
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in rows if i % 4 == 2]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    none = langid.train_language_model(df.limit(0), "doc_id", "text", "lang")
    assert langid.identify_language(df, "doc_id", "text", none).filter("lang_pred <> 'und'").count() == 0


def test_lm_score_equals_a_direct_computation(spark):
    rows = [(1, "abcabc", True), (2, "abd", False), (3, None, None), (4, "", True), (5, "zéz", False)]
    df = spark.createDataFrame(rows, "doc_id int, text string, good boolean")
    losses = lm_scoring.train_losses(df, "text", F.col("good"), classes=16)
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, "doc_id", "text", losses).collect()}
    assert got[3]["score"] is None and got[4]["n_tokens"] == 0
    for i, text, _ in rows:
        codes = [0, 0] + [int(losses.class_of[b]) for b in (text or "").encode()]
        bits = [losses.target[(codes[j - 2] * 16 + codes[j - 1]) * 16 + codes[j]] for j in range(2, len(codes))]
        if bits:
            assert got[i]["target_bits"] == pytest.approx(np.mean(bits, dtype=float), rel=1e-5)
    p = 2.0 ** -losses.target.astype(float).reshape(-1, 16)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_word_score_equals_a_direct_computation_over_all_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 2000)
    rng = random.Random(5)
    vocab = [f"слово{i}" if i % 2 else f"字{i}" for i in range(900)]  # more words and bytes than any class table
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40))), rng.choice([True, False, None])) for i in range(300)]
    rows += [(900, None, True), (901, " \n", None), rows[0], (None, rows[1][1], False)]
    df = spark.createDataFrame(rows, "doc_id int, text string, good boolean").repartition(5)
    got = lm_scoring.score_by_words(df, "doc_id", "text", F.col("good")).collect()
    one, two = ({True: Counter(), False: Counter()} for _ in range(2))
    for _, text, good in rows:
        if words := (text or "").split():
            one[bool(good)].update([*words, 0])
            two[bool(good)].update(zip([0, *words], [*words, 0]))
    kinds = len(one[True] | one[False])

    def bits(words, side):
        def p(before, w):
            smooth = lm_scoring.PRIOR * (one[side][w] + 1) / (one[side].total() + kinds)
            return (two[side][before, w] + smooth) / (one[side][before] + lm_scoring.PRIOR)

        return -sum(np.log2(p(*pair)) for pair in zip([0, *words], words)) / len(words)

    expected = []
    for i, text, _ in rows:
        words = (text or "").split()
        both = [bits(words, side) for side in (True, False)] if words else [None, None]
        expected.append((str(i), len(words), *(x if x is None else round(x, 6) for x in both)))
    rounded = [(str(r[0]), r[1], *(x if x is None else round(x, 6) for x in r[2:4])) for r in got]
    assert sorted(rounded, key=str) == sorted(expected, key=str)
    assert lm_scoring.score_by_words(df.limit(0), "doc_id", "text", F.col("good")).count() == 0


def test_language_sample_is_bounded_and_full_for_common_and_rare_languages(spark):
    rows = [(i, f"text number {i}", "common") for i in range(4000)] + [(9000 + i, f"rare {i}", "rare") for i in range(7)]
    df = spark.createDataFrame(rows + [(9900, None, "rare"), (9901, "x", None)], "doc_id int, text string, lang string")
    drawn = langid.labelled_sample(df, "doc_id", "text", "lang", per_language=100)
    assert [sum(lang == g for _, lang in drawn) for g in ("common", "rare")] == [100, 7] and len(set(drawn)) == 107
    assert drawn == langid.labelled_sample(df.orderBy(F.desc("doc_id")), "doc_id", "text", "lang", per_language=100)


def test_language_tables_equal_a_plain_convolution(spark):
    from urbanframe.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train_language_model(docs, "doc_id", "text", "lang", F.col("doc_id") % 4 != 2)
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    windows[0] = 0
    plain = np.zeros((40, net.dense.shape[1]))
    for i, window in enumerate(windows):
        pooled = []
        for bank in net.filters:
            width = len(bank)
            places = range(langid.WINDOW - langid.OVERLAP)  # all widths see the same starts
            each = np.array([sum(bank[j][window[p + j]].astype(float) for j in range(width)) for p in places])
            pooled.append(each.max(axis=0))
        z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense + net.dense_bias
        plain[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.abs(net.probabilities(windows) - plain).max() < 1e-4
    held = docs.filter("doc_id % 4 = 2 and lang is not null")
    found = langid.identify_language(held, "doc_id", "text", net).join(held.select("doc_id", "lang"), "doc_id").collect()
    told = [r for r in found if r["lang_pred"] != langid.UNDETERMINED]
    assert sum(r["lang_pred"] == r["lang"] for r in told) >= 0.9 * len(told)


def test_a_single_term_of_abuse_rejects_short_texts_only():
    def verdict(words, terms):
        return quality._abusive(quality.TextView(" ".join(["word"] * (words - terms) + ["trash"] * terms)))

    assert verdict(61, 1) and verdict(100, 1) and not verdict(101, 1)
    assert verdict(1000, 2) and not verdict(1001, 2) and not verdict(60, 0)
