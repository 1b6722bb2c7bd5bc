"""Toxicity, filter audit and hard negatives: against plain Python, on held-out labels, and on the stated cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from tarazu.llm import audit, negatives, toxicity

rng = random.Random(5)
WORDS = [f"w{k}" for k in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, id long, part string, fp long, mask int, edge string, n long, toxic int, quality int, words string, h long, score double"
SHARED = prose(210)
TEXTS = [None, "", " \n", SHARED, SHARED, prose(300), "A B " + prose(250), prose(220) + " $", "UPPER CASE ONLY", prose(20_000), "wörd " * 230, "x"]


def own_rows():
    rows = [(i, rng.choice(TEXTS) if i % 3 else prose(rng.choice([5, 250])) + rng.choice(["", "#", " QQQQQQQQQQQQQQQQQQQQQQ" * 9]), rng.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [rows[4], rows[4], (4, SHARED, "en"), (None, SHARED, "en"), (None, SHARED, "en"), (None, None, None), (2, "", None)]
    return rows


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    tallies = defaultdict(Counter)
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (i is None or least[t] < i)}
        failed = "".join(f for f in "ABCDE" if fails[f])
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                c = tallies[part or "", "".join(order), k + 1]
                fail = f in failed
                c["kept"] += not gone and not fail
                c["removed"] += fail and not gone
                c["redundant"] += fail and gone
                c["unique_fails"] += failed == f
                c["good_lost"] += fail and not gone and labels.get(i, (0, 0))[0] == 1
                c["toxic_lost"] += fail and not gone and labels.get(i, (0, 0))[1] == 1
                gone = gone or fail
    shapley = Counter()
    for (part, order, k), c in tallies.items():
        shapley[part, order[k - 1]] += c["removed"]
    return {key: (*(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[key[0], key[1][key[2] - 1]]) for key, c in tallies.items()}


def test_audit_counts_what_plain_python_counts(spark):
    """Nulls, repeated rows, ties, long and empty texts, labels that repeat, and columns named like the operator's own."""
    rows = own_rows()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3, "e", 4, 1, 1, "w", 5, 0.5) for r in rows], DOCS).repartition(5)
    table = spark.createDataFrame([(*r, "x", 9) for r in [*labels, labels[0]]], "doc_id long, quality int, toxic int, mask string, n int")
    found = audit.interactions(docs, table).collect()
    known = {i: (q, t) for i, q, t in labels if i is not None}
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found} == brute_audit(rows, known)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in found)
    assert audit.interactions(docs.filter("false"), table).count() == 0
    assert audit.interactions(docs, table.filter("false")).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_settles_texts_that_cross_partitions(spark):
    """One text holds most rows, so that partitions begin with it; only its least id isn't a duplicate."""
    rows = [(i, "one text", "en") for i in range(3000)] + [(i, f"text {i}", "en") for i in range(3000, 3100)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        found = audit.masks(docs)
        edges = found.filter("edge = 'first'").count()
        counted = {r["mask"]: r["n"] for r in audit.counters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert edges > 5 and counted == {1: 101, 17: 2999}


def test_colliding_fingerprints_are_told_apart_by_text():
    rows = [("en", 1, b"a", 7), ("en", 5, b"a", 7), ("en", 2, b"b", 7), ("en", 2, b"b", 7), ("en", 9, b"c", 8)]
    out = list(audit.sorted_masks(iter(rows)))
    assert [(r[1], r[2] >> 4, r[3], r[6]) for r in out] == [(1, 0, 1, "first"), (5, 1, 1, None), (2, 0, 2, "first"), (9, 0, 1, None), (9, 0, 0, "last")]


VECTORS = "vec_id long, embedding array<float>, label int, id long, v array<long>, d string, tie long, c int, b int, anchor long, score double"


def brute_negatives(rows, every=10):
    vectors = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors[i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)] = 1
    out = []
    for a, ya, va in vectors:
        if a % every:
            continue
        scored = [(sum(p * q for p, q in zip(va, v, strict=False)), i, y) for i, y, v in vectors if i != a]
        same = sorted((-s, i) for s, i, y in scored if y == ya)[:5]
        for s, p in same:
            fit = sorted((-n, i) for n, i, y in scored if y != ya and 80 * -s <= 100 * n <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def vector_rows():
    g = np.random.default_rng(3)
    centres = g.normal(0, 0.3, (6, 12))
    rows = [(i, (centres[i % 6] + g.normal(0, 0.1, 12)).tolist(), int(g.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, rows[10][1], 1 + i % 2) for i in range(80)]  # a hot vector
    rows += [(1000, None, 1), (1001, rows[0][1], None), (1002, [1.0, None], 1), (1003, [float("nan")] * 12, 2), (1004, [float("inf")] * 12, 2), (None, rows[0][1], 1), (1010, [], 1), (1020, [0.5, 0.25], 2), (1030, [0.0] * 12, 3)]
    return rows + rows[:30]


def test_negatives_are_those_of_brute_force(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, [2], "d", 3, 4, 5, 6, 0.5) for r in rows], VECTORS).repartition(4)
    found = sorted(tuple(r) for r in negatives.mined(table, anchors_every=10).collect())
    expected = brute_negatives(rows)
    assert found == expected and len(found) > 500 and any(a >= 400 for a, *_ in found)
    assert negatives.mined(table.filter("false")).count() == 0
    assert negatives.mined(table.filter("vec_id = 0")).count() == 0


def test_rows_that_share_an_id_are_each_ranked(spark):
    rows = [(10, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.9, 0.0], 2), (4, [0.85, 0.0], 2), (10, [0.9, 0.1], 2)]
    found = negatives.mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), anchors_every=10).collect()
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in found) == [(10, 3, 1, 4), (10, 3, 2, 4)]


def test_brackets_hold_and_drop_rows():
    """Scores lie in their brackets, and on rows in clusters few brackets reach the best."""
    g = np.random.default_rng(1)
    rows = np.round(g.normal(0, 40, (8, 16))[g.integers(0, 8, 600)] + g.normal(0, 4, (600, 16)))
    most = float((rows**2).sum(axis=1).max())
    pivots = negatives.pivots_of(rows[:300].astype(int).tolist(), 16, most)
    d = negatives.distances(negatives.augmented(rows, most), pivots)
    kept = []
    for q in rows[::29]:
        dq = negatives.distances(np.r_[q, 0][None], pivots)[0]
        low, high = negatives.brackets(q, dq, d.T, most)
        scores = rows @ q
        assert (low <= scores).all() and (scores <= high).all()
        kept.append((high >= negatives.kth(low, 5)).mean())
    assert np.mean(kept) < 0.6


def toxic_rows(n=1500):
    bad = [f"insult{k}" for k in range(8)]
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.12
        words = [rng.choice(WORDS) for _ in range(rng.choice([20, 90, 400]))]
        for _ in range(3 if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(y)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows()
    rows += [(None, None), (5000, ""), (5001, None), (5002, "x" * 50_000), rows[0], rows[0], (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, "en", 1, "p", 2, 3, "e", 4, 1, 1, "w", 5, 0.5) for r in rows], DOCS).repartition(4)
    table = spark.createDataFrame([(*x, 1) for x in [*labels, (None, 1), (7, None)]], "doc_id long, toxic int, h long")
    return docs, table, labels


def test_toxicity_on_held_out_labels(toxic):
    docs, table, labels = toxic
    found = toxicity.scored(docs, table).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert len({r["score"] for r in found if r["doc_id"] in (5000, 5001)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    known = dict(labels)
    held = [(known[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 150
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.01 * len(held)


def test_held_out_labels_teach_nothing(spark, toxic):
    """Flipping every held-out label changes no score; reruns agree."""
    docs, table, labels = toxic
    flipped = table.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    scores = lambda t: sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.scored(docs.repartition(3), t).collect())
    assert scores(table) == scores(flipped)


def test_toxicity_without_labels_or_rows(toxic):
    docs, table, _ = toxic
    assert {r["score"] for r in toxicity.scored(docs, table.filter("false")).collect()} == {0.0}
    assert toxicity.scored(docs.filter("false"), table).count() == 0


def test_the_risk_is_corrected_by_the_prior():
    """Unlabelled rows hold positives: the fit tells them from negatives though it sees them as unlabelled."""
    g = np.random.default_rng(0)
    names = {("bad$", 0): 0}
    some = lambda n, share: [[("bad", 1)] if g.random() < share else [("good", 2)] for _ in range(n)]
    w = toxicity.non_negative_fit(toxicity.design(some(200, 0.95), names), toxicity.design(some(300, 0.95) + some(700, 0.02), names), 0.3)
    assert toxicity.sigmoid(w.sum()) > 0.7 and toxicity.sigmoid(w[-1]) < 0.15


def test_finding_features_skips_none():
    bases = {"a$", "ab$", "abc", "abcd$", "xyzz"}
    find = toxicity.finder(bases)
    for w in ("a", "ab", "abc", "abcd", "abcde", "xyz", "xyzzy", "q", "axyzz"):
        assert find(w) == [f for f in toxicity.features_of(w) if f in bases]


def test_neighbours_whatever_the_ids_are(spark):
    """Hashed, repeated and null ids, repeated rows and clashing names: each document's edited text is made of the one after it, by id and then by a hash of the text."""
    import hashlib

    from tarazu.llm import sampling

    own = random.Random(12)
    rows = [(own.choice([own.randrange(-(1 << 62), 1 << 62), own.randrange(30), None]), " ".join(own.choice(WORDS) for _ in range(own.choice([0, 1, 40])))) for _ in range(300)]
    rows += [rows[0], rows[0], (5, None), (5, ""), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, "en", 1, "p", 2, 3, "e", 4, 1, 1, "w", 5, 0.5) for r in rows], DOCS).repartition(4)
    found = sampling.edited_neighbours(docs).collect()
    keyed = sorted((r["id"], r["h"], r["text"]) for r in docs.select(sampling.F.coalesce("doc_id", sampling.F.lit((1 << 63) - 1)).alias("id"), sampling.F.xxhash64(sampling.F.coalesce("text", sampling.F.lit(""))).alias("h"), sampling.F.coalesce("text", sampling.F.lit("")).alias("text")).collect())
    expected = []
    for k, (i, _, t) in enumerate(keyed):
        after, cut = keyed[(k + 1) % len(keyed)][2], len(t) // 4
        expected.append((None if i == (1 << 63) - 1 else i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=key) == sorted(expected, key=key)
    assert sampling.edited_neighbours(docs.filter("false")).count() == 0 and sampling.edited_neighbours(docs.limit(1)).count() == 1
