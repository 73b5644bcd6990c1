"""Operators with shuffles: brute force on small tables."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urbanframe.llm import near_duplicates, neighbours, packing, substrings, wavelet
from urbanframe.llm.components import components


def documents(spark, seed=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    # near copies are made of texts long enough to share 5-word shingles after an edit
    base = [[rng.choice(vocab) for _ in range(rng.randint(80 if 8 <= i < 12 else 0, 150))] for i in range(30)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(b[:20] + passage + b[20:]) for b in base[:8]]
    for b in base[8:12]:
        near = list(b)
        for _ in range(max(1, len(b) // 50)):
            if near:
                near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(near), " ".join(b)]
    texts += [None, "", "x " * 200, "x " * 300]
    rows = [(i if i != 2 else None, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, hash long"), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("window, hot", [(35, 128), (35, 0), (9, 2)])
def test_repeated_passages_against_brute_force(spark, window, hot):
    df, rows = documents(spark)
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    expected = []
    for (doc, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        expected.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substrings.remove_repeated_passages(df, "doc_id", "text", window, min(8, window), hot).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("copies", [0, 120])
def test_hot_buckets_are_dealt_out_by_longer_grams_first(spark, monkeypatch, copies):
    """A phrase in many contexts makes no row a window; what stays hot among near copies does, and is counted exactly."""
    rng = random.Random(9)
    phrase, base = [f"p{i}" for i in range(10)], [f"w{i}" for i in range(60)]
    texts = [[f"c{i}_{j}" for j in range(40)] + phrase + [f"d{i}_{j}" for j in range(40)] for i in range(150)]
    texts += [[rng.choice(base) if rng.random() < 0.05 else w for w in base] for _ in range(copies)]
    made, plain = [], type(spark.range(0)).mapInArrow

    def counted(self, run, schema, *rest):
        out = plain(self, run, schema, *rest)
        if "window binary" in schema:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substrings.remove_repeated_passages(df, "doc_id", "text", hot_strings=16).select("doc_id", "kept").collect()
    seen = Counter(tuple(t[i : i + 35]) for t in texts for i in range(len(t) - 34))
    gone = [{i + j for i in range(len(t) - 34) if seen[tuple(t[i : i + 35])] > 1 for j in range(35)} for t in texts]
    assert dict(map(tuple, got)) == {i: " ".join(w for j, w in enumerate(t) if j not in gone[i]) for i, t in enumerate(texts)}
    assert bool(sum(made)) == bool(copies) and sum(made) < 26 * copies + 1 and (not copies or any(gone))


def test_super_kmers_cover_every_window_once():
    hashes = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    _, first, n = substrings.super_kmers(hashes, 20, 4)
    assert [i for a, k in zip(first, n) for i in range(a, a + k)] == list(range(181))


def test_banded_distance_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(800):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 16))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        band = rng.randint(0, 18)
        assert near_duplicates.banded_distance(a, b, band) == (row[-1] if row[-1] <= band else None)


def test_near_duplicate_classes_against_brute_force(spark):
    df, rows = documents(spark)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [near_duplicates.word_hashes((t or "").encode()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if near_duplicates.similar(words[i], words[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    expected = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    got = near_duplicates.near_duplicate_classes(df, "doc_id", "text").collect()
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in got) == expected
    kept = near_duplicates.keep_one_of_each(df, "doc_id", "text")
    assert kept.columns == df.columns and kept.count() == len(groups)


def edited(rng, words, share, prefix):
    """``words`` with a share of them, anywhere, replaced by new ones."""
    out = list(words)
    for n, i in enumerate(rng.sample(range(len(out)), int(share * len(out)))):
        out[i] = f"{prefix}x{n}"
    return out


def test_every_similar_pair_of_a_bucket_is_found(spark):
    rng = random.Random(11)
    original = [f"w{i}" for i in range(300)]
    texts = [original] + [edited(rng, original, rng.uniform(0.10, 0.15), f"v{v}") for v in range(300)]
    words = [near_duplicates.word_hashes(" ".join(t).encode()) for t in texts]
    keys = [set(near_duplicates.text_sketches(w).tolist()) for w in words]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and label[i] != label[j]:
                if near_duplicates.similar(words[i], words[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_duplicates.near_duplicate_classes(df, "doc_id", "text").collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label))
    assert Counter(label)[0] > 150


def test_a_loose_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts that share three quarters of their words share buckets; they must not make rows as the square of their number."""
    rng = random.Random(4)
    block = [f"w{i}" for i in range(150)]
    texts = [block + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(50, 56))] for _ in range(240)]
    texts += [edited(rng, t, 0.1, "x") for t in texts[:5]]
    compared, verified = [], near_duplicates._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_duplicates, "_verified", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_duplicates.near_duplicate_classes(df, "doc_id", "text").collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i % 240 for i in range(245)}
    assert sum(compared) < 20 * len(texts)


@pytest.mark.parametrize("similarity", [0.8, 0.3])
def test_word_bitmaps_never_show_more_than_the_words_differ(spark, similarity):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 15, 17, 63, 64, 65, 130, 600, 2100, 2600]))]
        b = edited(rng, a[: max(1, int(len(a) * rng.uniform(0.3, 1)))], rng.uniform(0, 0.3), f"v{i}")
        bitmaps = [near_duplicates.word_parity(near_duplicates.word_hashes(" ".join(t).encode())).tolist() for t in (a, b)]
        rows.append((i, *bitmaps, (Counter(a) - Counter(b)).total() + (Counter(b) - Counter(a)).total()))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, d long")
    got = df.select("d", near_duplicates._differ(F.col("a"), F.col("b")), F.size("a"), F.size("b")).collect()
    assert all((x is None) == (max(m, n) > 2 * min(m, n)) and (x is None or x <= d) for d, x, m, n in got)
    assert {max(m, n) // min(m, n) for *_, m, n in got} >= {1, 2, 4}
    # whatever the sizes, a similar pair of one bucket is kept
    texts = [["w%d" % i for i in range(40)], ["w%d" % i for i in range(14)]]
    words = [near_duplicates.word_hashes(" ".join(t).encode()) for t in texts]
    opened = spark.createDataFrame([(7, b"a", 40, b"a"), (7, b"b", 14, b"b")], "bucket long, node binary, n long, label binary")
    parity = spark.createDataFrame(
        [(x, near_duplicates.word_parity(w).tolist()) for x, w in zip((b"a", b"b"), words)], "node binary, parity array<long>"
    )
    assert near_duplicates._untested(opened, parity, similarity).count() == near_duplicates.similar(*words, similarity)


@pytest.mark.parametrize("similarity", [0.95, 0.9, 0.85, 0.8])
@pytest.mark.parametrize("n", [10, 15, 20, 35, 60, 300])
def test_sketches_reach_the_similarity_that_is_asked_for(n, similarity):
    rng = random.Random(n)
    met = 0
    for trial in range(400):
        a = [f"w{rng.randrange(5000)}" for _ in range(n)]
        b = edited(rng, a, 1 - similarity + 1e-9, f"e{trial}")
        x, y = (near_duplicates.word_hashes(" ".join(t).encode()) for t in (a, b))
        assert near_duplicates.similar(x, y)
        both = set(near_duplicates.text_sketches(x).tolist()) & set(near_duplicates.text_sketches(y).tolist())
        met += bool(both)
    assert met >= 0.98 * 400


def test_a_repeated_kmer_does_not_part_near_copies():
    # one text repeats 3-mers, the other has none twice
    words = [f"w{i}" for i in range(200)]
    for copy in ([*words, *words[10:13]], [*words[:50], *words[:6], *words[50:]], words * 2):
        x, y = (near_duplicates.word_hashes(" ".join(t).encode()) for t in (words, copy))
        shared = np.intersect1d(near_duplicates.labelled_kmers(x), near_duplicates.labelled_kmers(y))
        assert len(shared) >= 190
        both = set(near_duplicates.text_sketches(x).tolist()) & set(near_duplicates.text_sketches(y).tolist())
        assert both


def test_order_sketches_follow_the_order_of_the_text():
    rng = random.Random(2)
    kmers = near_duplicates.labelled_kmers(near_duplicates.word_hashes(" ".join(f"w{i}" for i in range(60)).encode()))
    mixed_up = np.array(rng.sample(kmers.tolist(), len(kmers)), dtype=np.uint64)
    same = near_duplicates.order_sketches(kmers) == near_duplicates.order_sketches(mixed_up)
    assert 10 <= same.sum() <= 38  # equal sets of k-mers, but two picked ones stand in order half of the time


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r[0], r[1]) for r in components(links).collect()} == {(i, 0) for i in range(21)} | {(100, 100), (101, 100)}
    assert components(links.limit(0)).count() == 0


def test_packing_places_every_piece(spark):
    df, rows = documents(spark)
    path = P.path("byte_bpe_50k.json")
    got = packing.pack_sequences(df, "doc_id", "text", path, end_id=0, capacity=100).collect()
    reference = Tokenizer.from_file(path)
    expected = []
    for doc, text in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 100 or 100
        for piece, start in enumerate([0, *range(first, len(ids), 100)]):
            part = ids[start : start + (first if not piece else 100)]
            expected.append((str(doc), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 100
    assert len(sequences) <= 1.05 * sum(e[3] for e in expected) / 100 + 2


def test_plan_holds_each_piece_once_and_beats_its_bound():
    counts = dict(zip(*(x.tolist() for x in np.unique(np.random.default_rng(2).integers(300, 1100, 3000), return_counts=True))))
    plan, bound = packing.plan_sequences(counts, 2048)
    assert sum(n for _, n in plan) <= 1.02 * bound
    held = Counter()
    for pattern, n in plan:
        for length, times in pattern:
            held[length] += times * n
    sequences = sum(n for _, n in plan)
    assert held == counts and bound <= sequences + 1e-6
    assert sequences <= sum(n for _, n in packing.best_fit_decreasing(counts, 2048))


@pytest.mark.parametrize("bits", [1, 6, 16, 17, 20])
def test_wavelet_planes_of_every_width(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000).astype(np.uint32)
    for some in (ids, ids[:1], ids[:0], np.zeros(70, np.uint32), np.full(70, (1 << bits) - 1, np.uint32)):
        m = wavelet.WaveletMatrix.build(some, bits)
        assert m.all_ids().dtype == np.uint32 and (m.all_ids() == some).all()
        if len(some):
            assert (m.access(np.arange(len(some))) == some).all()


def test_wavelet_planes_take_less_time_than_masks():
    """Mixed bits, parted by masks, took most of the time of a plane."""
    ids = np.random.default_rng(1).integers(0, 1 << 16, 1 << 18).astype(np.uint32)

    def masks():
        current = ids.astype(np.uint16)
        for level in range(15, -1, -1):
            bit = (current & np.uint16(1 << level)) != 0
            current = np.concatenate((current[~bit], current[bit]))

    def least(run):
        taken = []
        for _ in range(5):
            began = time.process_time()
            run()
            taken.append(time.process_time() - began)
        return min(taken)

    assert least(lambda: wavelet.WaveletMatrix.build(ids, 16)) < 0.8 * least(masks)


def test_wavelet_matrix_operations():
    ids = np.random.default_rng(3).integers(0, 40, 1000).astype("u4")
    m = wavelet.Shard(wavelet.write_shard([1, None], [400, 600], ids, 6)).matrix
    assert (m.all_ids() == ids).all() and (m.access(np.arange(1000)) == ids).all()
    for s in range(42):
        at = np.flatnonzero(ids == s)
        assert m.count(s) == len(at) and m.count(s, 100, 300) == ((at >= 100) & (at < 300)).sum()
        assert [m.occurrence(s, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        m.occurrence(41, 0)


def test_token_shards_round_trip(spark):
    df, rows = documents(spark)
    path = P.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    got = wavelet.token_shards(df, "doc_id", "text", path, end_id=2).collect()
    ids = {(str(d), zlib.crc32(np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in rows}
    assert {(str(r["doc_id"]), r["ids_crc32"]) for r in got} == ids and len(got) == len(rows)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert known == sorted(known)


def test_neighbours_recall_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x[100:200] = x[50]  # many equal vectors: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = neighbours.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect()
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert sorted(found[q]) == list(range(1, 21))
        hits += len({v for v, _ in found[q].values()} & set(best))
    assert hits / (30 * 20) >= 0.9 and set(found) == set(range(0, 600, 20))
    assert neighbours.nearest_neighbours(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_two_lengths_in_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 12)
    monkeypatch.setattr(neighbours, "LEAST_QUERIES", 12)
    rng = np.random.default_rng(9)
    tables = {8: rng.normal(size=(500, 8)), 24: rng.normal(size=(460, 24))}
    rows = [(2 * i + (d == 24), v.tolist()) for d, x in tables.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    got = defaultdict(dict)
    for r in neighbours.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 <= 1, k=20).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for d, x in tables.items():
        ids = np.arange(len(x)) * 2 + (d == 24)
        for q in np.flatnonzero(ids % 20 <= 1):
            s = x @ x[q]
            best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
            found = got.pop(int(ids[q]))
            assert sorted(found) == list(range(1, 21))
            hits += len({v for v, _ in found.values()} & {int(ids[i]) for i in best})
            total += 20
    assert not got and hits >= 0.9 * total


def test_pipeline_stages_on_whole_small_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    good = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id").filter(F.size(F.split("text", r"\s+")) >= 60)
    lost = good.join(kept.select("doc_id"), "doc_id", "left_anti")
    assert lost.count() <= 0.01 * good.count()
    named = corpus_pipeline.language_id(spark, kept, sf)
    assert named.count() >= 0.98 * kept.count()
    assert corpus_pipeline.packing(spark, named.limit(0), sf).count() == 0


def test_hot_window_rows_follow_the_words_of_a_group():
    """Rows of a large group of near copies, counted window by window: one a window, so twice the group, twice the rows."""

    def rows(copies):
        draw = random.Random(5)
        base = [f"w{i}" for i in range(60)]
        strings, words = set(), 0
        for _ in range(copies):
            text = [draw.choice(base) if draw.random() < 0.05 else w for w in base]
            words += len(text)
            found = substrings.super_kmers(substrings.word_hashes(" ".join(text).encode()))
            strings |= {(h, " ".join(text[a : a + n + 34]).encode()) for h, a, n in zip(*(x.tolist() for x in found))}
        sizes = Counter(h for h, _ in strings)
        hot = [packed for h, packed in strings if sizes[h] > substrings.HOT_STRINGS]
        made = sum(len(substrings.windows_of(packed, substrings.WINDOW)) for packed in hot)
        assert made <= words
        return made

    few, many = rows(1000), rows(2000)
    assert few > 1000 and many < 2.5 * few
