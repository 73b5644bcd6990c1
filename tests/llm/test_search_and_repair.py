"""Toxicity, ranked search and conversation repair against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanframe.llm import conversations, lexical, toxicity
from urbanframe.llm.conversations import DOOMED, INITIALS, TRUNCATED, AuditTrie, cheapest_audit


# ------------------------------------------------------------------ conversation repair
def exhaustive_audit(codes):
    """Every sequence of edits with at most two inserts in a place."""
    best = [(2 * len(codes), "D" * len(codes))]

    def go(i, roles, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit))
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(codes):
            code = codes[i]
            stays = 5 if code & TRUNCATED else 0
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if not code & DOOMED:
                go(i + 1, roles + INITIALS[code & 3], cost + stays, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + stays, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def test_cheapest_audit_against_every_sequence_of_edits():
    rng = random.Random(3)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 9]) for _ in range(rng.randint(0, 5)))
        assert cheapest_audit(codes) == exhaustive_audit(codes)


def whole_string_audit(codes):
    """The same recurrence with whole strings in place of linked nodes."""
    step, expected = conversations.STEP, conversations.EXPECTED
    best = {0: (0, "")}

    def inserts(held):
        for _ in range(4):
            for s, (c, a) in list(held.items()):
                r = step[s, expected[s]]
                held[r] = min(held.get(r, (math.inf, "")), (c + 5, a + "I"))

    inserts(best)
    for code in codes:
        stays, new = 5 if code & TRUNCATED else 0, {}
        for s, (c, a) in best.items():
            offers = [(c + 2, a + "D", s)]
            if not code & DOOMED:
                offers.append((c + 1 + stays, a + "R", step[s, expected[s]]))
                if (s, INITIALS[code & 3]) in step:
                    offers.append((c + stays, a + "K", step[s, INITIALS[code & 3]]))
            for c2, a2, s2 in offers:
                new[s2] = min(new.get(s2, (math.inf, "")), (c2, a2))
        inserts(new)
        best = new
    return min(best[s] for s in (0, 3) if s in best)


def test_long_audits_against_whole_strings():
    rng = random.Random(5)
    for n in (40, 130, 700):
        for alphabet in ([0, 1, 2, 3, 5, 9], [1, 1, 1, 2], [3], [4, 5, 6]):
            codes = bytes(rng.choice(alphabet) for _ in range(n))
            assert cheapest_audit(codes) == whole_string_audit(codes)


def test_prefixes_compare_as_strings_and_hash_matches_are_verified(monkeypatch):
    for prime in (conversations._PRIME, 3):  # with three hash values nearly every pair collides
        monkeypatch.setattr(conversations, "_PRIME", prime)
        rng, trie, nodes, shown = random.Random(1), AuditTrie(), [0], {"": 0}
        for _ in range(300):
            parent, letter = rng.choice(nodes), rng.choice("DIKR")
            text = trie.text(parent) + letter
            if text not in shown:
                shown[text] = trie.add(parent, ord(letter))
                nodes.append(shown[text])
        for _ in range(2000):
            a, b, x, y = rng.choice(list(shown)), rng.choice(list(shown)), rng.choice("DIKR"), rng.choice("DIKR")
            if (a + x) != (b + y) and not (a + x).startswith(b + y) and not (b + y).startswith(a + x):
                assert trie.less(shown[a], ord(x), shown[b], ord(y)) == (a + x < b + y)
        assert (trie.collisions > 0) == (prime == 3)


def plain_summary(rows):
    """Contract of one conversation, row by row; ``rows``: (turn, role, text) in order."""
    seen, codes, counts = set(), [], Counter()
    for _, role, text in rows:
        body = re.findall("[^\x20\x09-\x0d]", text)
        code = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
        if not body:
            counts["blank"] += 1
            code |= DOOMED
        elif (role, text) in seen:
            counts["duplicate"] += 1
            code |= DOOMED
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            code |= TRUNCATED
        seen.add((role, text))
        codes.append(code)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = whole_string_audit(codes)
    left, out, want = list(rows), [], "u"
    for edit in audit:
        if edit == "I":
            out.append(("user" if want == "u" else "assistant", ""))
        else:
            _, role, text = left.pop(0)
            if edit == "D":
                continue
            out.append((role if edit == "K" else "user" if want == "u" else "assistant", text))
        want = "a" if out[-1][0][:1] == "u" else "u"
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, out, text


def conversation_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append(
                (
                    conv,
                    rng.choice([turn, turn, turn, turn + 1, None]),
                    rng.choice(["user", "assistant", "system", "tool", "", None]),
                    rng.choice(["Hi.", "Hi.", "no end", "", " \t", None, "Well?\n", "a "]) if rng.random() < 0.7 else f"T{rng.random()}!",
                    7,
                )
            )
    rows += [(500, 0, "user", "x" * 400_000, 1), (500, 1, "assistant", "Done.", 1)]
    rows += [(501, i, "user" if i % 2 else "assistant", f"row {i}.", 1) for i in range(5_000)]
    return rows


def test_conversations_against_plain_reading(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int")
    expected, repaired = {}, {}
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        *head, out, text = plain_summary(own)
        expected[conv] = (*head, hashlib.sha256(text.encode()).hexdigest())
        repaired[conv] = out
    names = ("conv_id", "turn", "role", "text")
    got = conversations.audit_conversations(df.repartition(5), *names)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected
    found = {}
    for r in conversations.repair_conversations(df, *names).orderBy("place").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {c: o for c, o in repaired.items() if o}


def test_damage_and_conversations_without_rows(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two! {c} {t}?") for c in range(40) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ("conv_id", "turn", "role", "text")
    got = sorted(tuple(r) for r in conversations.damaged(df, *names).collect())
    expected = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        expected += [(c, t, "user" if fate == 4 else role, text, fate != 0)] * (2 if fate == 3 else 1)
    assert got == sorted(expected)
    none = df.withColumn("present", F.lit(False))
    summary = conversations.audit_conversations(none, *names, present=F.col("present")).collect()
    assert {tuple(r)[1:] for r in summary} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert len(summary) == 40
    assert conversations.audit_conversations(df.limit(0), *names).count() == 0
    assert conversations.repair_conversations(df.limit(0), *names).count() == 0


# ------------------------------------------------------------------ ranked search
def search_tables(spark, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["été", "ß", "Ünder", "W1", "a_b"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 90]))) for _ in range(400)]
    texts += [None, "", "...", texts[7], texts[7], "w1 " * 30_000, "y" * 300_000]
    docs = [(i if i != 9 else None, t, i % 3) for i, t in enumerate(texts)] + [(3, texts[3], 0)]
    items = [(i, " ".join(rng.sample(vocab, rng.randint(1, 12))), 1) for i in range(40)]
    items += [(None, "w2 W3"), (77, None), (78, ""), (79, "unseen"), (1, "w5 w6")]
    items = [(i, t, 1) for i, t, *_ in items]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, id int"),
        spark.createDataFrame(items, "item_id long, text string, score int"),
        [(d, t) for d, t, _ in docs],
        [(i, t) for i, t, _ in items],
    )


def plain_ranking(docs, items, k=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(d, Counter(pattern.findall((t or "").translate(low)))) for d, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(pattern.findall((t or "").translate(low)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, b in bags:
            if b:
                m = 10 + 90 * sum(b.values()) * n // total
                s = sum(
                    math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in terms
                    if t in b
                )
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        scored.sort()
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(scored[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk, leaf, block", [(4096, 64, 256), (50, 4, 7), (3, 1, 1)])
def test_ranked_search_against_brute_force(spark, chunk, leaf, block, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "CHUNK_POSTINGS", 40 * chunk)
    docs, items, d, i = search_tables(spark)
    if block == 1:
        items, i = items.filter("item_id < 3 or item_id is null"), [x for x in i if x[0] is None or x[0] < 3]
    got = lexical.ranked_search(docs, "doc_id", "text", items, "item_id", "text")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_ranking(d, i)


def test_ranked_search_on_empty_tables(spark):
    docs, items, _, _ = search_tables(spark)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items)):
        assert lexical.ranked_search(d, "doc_id", "text", i, "item_id", "text").count() == 0


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    rows, width = 600, 40
    # two far groups of documents, as two languages would be
    dense = np.zeros((rows, width), dtype=np.int64)
    for i in range(rows):
        half = rng.choice(width // 2, 6, replace=False) + (width // 2 if i % 2 else 0)
        dense[i, half] = rng.integers(1, 10**6, 6)
    sizes = (dense > 0).sum(axis=1)
    owner, terms = np.nonzero(dense)
    weights = rng.integers(1, 9000, width)
    tree = lexical.BallTree(np.arange(rows), sizes.copy(), terms.copy(), dense[owner, terms].copy(), np.sqrt(weights))
    queries = np.zeros((width, 20))
    for j in range(20):
        own = rng.choice(width // 2, 3, replace=False)
        queries[own, j] = weights[own]
    bounds = tree.bounds(queries)
    exact = dense[tree.ids] @ queries
    for node, (lo, hi) in enumerate(tree.range):
        assert (exact[lo:hi].max(axis=0) <= bounds[node]).all()
    opened = sum(tree.search(queries[:, j].astype(np.int64), bounds[:, j].tolist(), [], 10) for j in range(20))
    assert opened < 20 * sum(c is None for c in tree.children)


# ------------------------------------------------------------------ toxicity
def toxic_tables(spark, seed=6, n=600):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}ing" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    bad = ["vilo", "grotzen", "schmarr"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "erei", "ung"]))
        rows.append((i, " ".join(words), "en"))
        if i % 4:
            labels.append((i, int(toxic), "x"))
    rows += [(n, None, "en"), (n + 1, "", "de"), (n + 2, "vilo " * 50_000, "fr"), (None, rows[0][1], None), (0, rows[0][1], "en")]
    labels += [(None, 1, "x"), (5, None, "x"), (10**6, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(
        labels, "doc_id long, toxic int, text string"
    )


def may_learn():
    return F.col("doc_id") % 3 != 1


def test_toxicity_of_held_out_texts(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.toxicity_scores(docs, "doc_id", "text", labels, "doc_id", "toxic", may_learn())
    rows = got.collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 3 == 1]
    caught = [r["score"] >= 0.7 for r in held if r["doc_id"] % 6 == 0]
    alarms = [r["score"] >= 0.7 for r in held if r["doc_id"] % 6]
    assert not caught or sum(caught) >= 0.95 * len(caught)
    assert sum(alarms) <= 0.02 * len(alarms)
    odd = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] in (600, 601, 602)}
    assert odd[600] == odd[601] < 0.1 and odd[602] >= 0.7
    copies = {r["score"] for r in rows if r["doc_id"] in (0, None)}
    assert len(copies) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(e["similarity"] > 0 for r in rows for e in r["evidence"])


def test_toxicity_without_examples(spark):
    docs, labels = toxic_tables(spark, n=30)
    for d, l in ((docs, labels.limit(0)), (docs, labels.filter("toxic = 0")), (docs.limit(0), labels)):
        rows = toxicity.toxicity_scores(d, "doc_id", "text", l, "doc_id", "toxic", may_learn()).collect()
        assert len(rows) == d.count() and all(r["score"] == 0.0 and r["evidence"] == [] for r in rows)


def test_nearest_examples_against_all_cosines():
    rng = np.random.default_rng(8)
    idf = rng.uniform(1, 6, 50)
    vectors = []
    for i in range(300):
        terms = np.sort(rng.choice(50, rng.integers(0, 8), replace=False))
        vectors.append(toxicity.unit_vector(terms, rng.integers(1, 5, len(terms)).astype(float), idf))
    vectors += vectors[:40]  # ties
    index = toxicity.BlockMaxIndex(vectors, 50, block=8)
    dense = np.zeros((len(vectors), 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i, (t, w) in enumerate(vectors):
        for leave_out in (-1, i):
            got = index.nearest(t, w, 15, leave_out)
            near = [(round(float(s), 9), -j) for j, s in enumerate(dense @ dense[i]) if s > 0 and j != leave_out]
            expected = [s for s, _ in sorted(near, reverse=True)[:15]]
            assert [round(s, 9) for s, _ in got] == expected
            assert len({j for _, j in got}) == len(got) and leave_out not in {j for _, j in got}
    assert index.opened < 2 * len(vectors) * (len(index.cuts) - 1)


def test_isotonic_steps_rise_and_pool():
    steps, values = toxicity.isotonic([0.1, 0.2, 0.3, 0.4, 0.4], [0, 1, 0, 1, 1], [1.0] * 5)
    assert steps == [0.1, 0.2, 0.4] and values == sorted(values)


def test_near_copies_are_one_example():
    rng = random.Random(1)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(5)]
    texts = [" ".join(b) for b in base] + [" ".join([*base[0][:-1], "other"]), " ".join(base[1])]
    examples = [toxicity.Example(i, 1, t) for i, t in enumerate(texts)] + [toxicity.Example(9, 0, texts[0])]
    kept = toxicity.distinct_examples(examples)
    assert {(e.id, e.label, e.copies) for e in kept} == {(0, 1, 2), (1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1), (9, 0, 1)}
