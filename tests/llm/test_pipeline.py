import random

import corpus_pipeline
import numpy as np
from tarazu.llm import minhash, overlap, simhash


def test_stages_keep_clean_documents_and_drop_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = corpus_pipeline.materialize(stage(spark, rows, sf_dir), "test")
        assert rows.columns == columns and rows.count() > 0
    out = corpus_pipeline.STAGES[4][1](spark, rows, sf_dir)
    assert out.count() == rows.count()
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()


def staying(rows):
    """Brute force: of each group of texts that links of Jaccard 0.8 or more connect, the row with the least id."""
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted(least.values())


def test_near_dedup_finds_what_brute_force_finds(spark, sf_dir):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for k in range(60):  # copies with one to eight words changed, on both sides of 0.8
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 200]))]
        rows.append((10_000 + 10 * k, " ".join(words)))
        for j in range(1, 4):
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((10_000 + 10 * k + j, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "only four words here"), (20_003, "Only four words HERE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    expected = staying(rows)
    assert len(rows) - len(expected) > 80
    # two texts without words are equal by definition, though their Jaccard similarity is 0 / 0
    assert sorted(r["doc_id"] for r in out) == expected


def test_near_dedup_takes_simhash_links_as_candidates(spark):
    """Fingerprints three bits apart are candidates though no band is shared; four bits apart and texts without words aren't."""
    signed = spark.createDataFrame([(1, 0, [1]), (2, 0b111, [2]), (3, 0b1111 << 20, [3]), (4, 0, []), (5, 0b111, [5])], "g long, fp long, bands array<long>")
    assert {tuple(sorted(r)) for r in minhash.candidates(signed).collect()} == {(1, 2), (2, 5)}
    text = b"one two three four five six seven one two three four five"
    assert simhash.of_values(minhash.shingle_values(text)) == simhash.fingerprint(text, minhash.SHINGLE)
    assert simhash.of_values(minhash.shingle_values(b"")) == 0


def test_near_dedup_links_what_fingerprints_and_bands_miss(spark, sf_dir):
    """Pairs of 5 and 4 shingles, similarity 4/5, that share no band and differ in over three bits."""
    rows = []
    for k in (573997, 1115215, 1813793):
        whole = " ".join(f"{x}{k}" for x in "abcdefghi")
        rows += [(k, whole), (-k, whole.rsplit(" ", 1)[0]), (k + 1, whole.rsplit(" ", 2)[0])]  # the third is similar to the second only by 3/4
        one, two = (minhash.shingle_values(t.encode()) for _, t in rows[-3:-1])
        assert not set(minhash.bands(one)) & set(minhash.bands(two)) and (simhash.of_values(one) ^ simhash.of_values(two)).bit_count() > simhash.RADIUS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [-1813793, -1115215, -573997, 573998, 1115216, 1813794]


def test_overlap_rules_out_no_similar_pair(spark):
    """Without any candidates, every pair of similarity 4/5 or more ends in one component, whatever its sizes."""
    own, sets = np.random.default_rng(5), []
    for k in range(400):
        base = own.integers(0, 1 << 63, own.choice([1, 2, 3, 4, 5, 9, 16, 40, 200, 700]), dtype=np.uint64)
        some = base[own.random(len(base)) < own.choice([0.8, 0.9, 1])]
        more = own.integers(0, 1 << 63, own.integers(0, 1 + len(base) // 5), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.r_[some, more])]
    sets = [s for s in sets if len(s)]
    rows = [(int(v) - (1 << 63), g, len(s), g) for g, s in enumerate(sets) for v in s ^ np.uint64(1 << 63)]
    lowest = [(int(v) - (1 << 63), g, len(s), g) for g, s in enumerate(sets) for v in overlap.lowest(s) ^ np.uint64(1 << 63)]
    schema = "key long, g long, n long, c long"
    may = {r["g"] for r in overlap.by_lowest(spark.createDataFrame(lowest, schema)).select("g").distinct().collect()}
    found = overlap.links(spark.createDataFrame([r for r in rows if r[1] in may], schema))
    linked = {r["u"]: r["v"] for r in minhash.connect(found).collect()}
    similar = 0
    for a in range(len(sets)):
        for b in range(max(0, a - 3), a):  # others share nothing
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                similar += 1
                assert linked.get(a, a) == linked.get(b, b)
    assert similar > 100 and len(linked) < 1.2 * similar and len(may) < len(sets)


def test_rows_of_very_common_shingles_count_as_shared(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MOST_HELD", 10)
    rows = spark.createDataFrame([(0, g, 4, 9) for g in range(40_000)] + [(5, 1, 4, 1), (7, 1, 4, 1), (7, 2, 5, 2), (7, 3, 7, 3), (8, 1, 4, 9), (8, 2, 4, 9)], "key long, g long, n long, c long").coalesce(1)
    found = [(r["key"], r["g"]) for r in overlap.shared(rows).collect()]
    assert sorted(x for x in found if x[0]) == [(7, 1), (7, 2)] and sum(x[0] == 0 for x in found) == 40_000
