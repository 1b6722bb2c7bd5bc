"""The corpus operators against brute-force versions, on small fixtures with nulls, ties, repeats, empty and long texts."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tarazu.llm import bpe, hmm, mixture, phrases, quality, queries, quotes, sampling, simhash, templates, warc

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


PASSAGE = prose(70)
NEAR = prose(300).split(" ")
TEXTS = [prose(200), PASSAGE, prose(30) + " " + PASSAGE + " " + prose(40), PASSAGE + " " + prose(10), " ".join(NEAR), " ".join(NEAR[:150] + ["changed"] + NEAR[151:]), " ".join(NEAR), None, "", " \n\t ", "one", "A b " * 400, prose(3000), "x" * 5000, prose(49), prose(50)]
ROWS = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s0"), (None, PASSAGE, None), (99, TEXTS[0], "s1"), (99, "other text", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "clash", 7) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, _id int").repartition(3)


def words(t):
    return (t or "").encode().split()


def last(i):
    return math.inf if i is None else i


def test_phrases(docs):
    first = {}
    for i, t, _ in ROWS:
        w = words(t)
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, math.inf), last(i))
    expected = []
    for i, t, _ in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < last(i):
                gone[a : a + 50] = [True] * 50
        expected.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in phrases.without_repeats(docs).collect()]
    assert sorted(got) == sorted(expected)
    assert sum(x[2] for x in expected) > 300


def test_simhash(docs):
    def fp(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[a : a + 3]) for a in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0

    values = [fp(t) for _, t, _ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for a in range(len(ROWS)):
            for b in range(len(ROWS)):
                if bin(values[a] ^ values[b]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min(last(ROWS[k][0]) for k in range(len(ROWS)) if group[k] == g) for g in set(group)}
    expected = sorted((str(r[0]), f"{v:016x}", str(None if least[g] == math.inf else least[g])) for r, v, g in zip(ROWS, values, group, strict=True))
    got = simhash.near_duplicates(docs).select("id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 7])
def test_bit_sliced_links_are_all_links(radius):
    g = np.random.default_rng(radius)
    base = g.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.concatenate([base, *(base ^ (np.uint64(1) << g.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 30).astype(np.uint64)) for _ in range(3))])

    def groups(n, pairs):
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(i) for i in range(n)]

    brute = lambda v: groups(len(v), [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i] ^ v[j])).count("1") <= radius])
    assert groups(len(values), simhash.large_links(values, radius)) == brute(values)
    some = values[20:65]
    assert groups(45, simhash.small_links(some, np.zeros(45, int), radius)) == brute(some)


def test_fingerprint_blocks_find_every_link():
    for n in (10, 1 << 23, 1 << 40):
        blocks, equal = simhash.blocks_for(n)
        assert blocks - simhash.RADIUS >= equal  # RADIUS differing bits leave this many blocks untouched


def test_templates(docs):
    line = "please visit our {} store number {} for more great offers today"
    rows = [(i, f"own words of document {i} are here in this line\n" + line.format("new" if i % 2 else "old", i), "s") for i in range(12)]
    out = templates.drop_recurring_lines(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in out] == [0] + [2] * 11
    assert out[0]["text"] == rows[0][1]
    whole = templates.drop_recurring_lines(docs)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in whole.collect()) == sorted((str(i), str(t)) for i, t, _ in ROWS)  # nothing recurs ten times
    assert [c for c in whole.columns if c not in ("n_lines", "n_dropped")] == docs.columns


def test_identical_lines_recur_from_two_or_three_documents(spark):
    long, middle = " ".join(f"l{k}" for k in range(60)), "a line of nine words is in these three"
    rows = [(0, f"one\n{long}"), (1, f"two\n{long}"), (2, f"three\n{middle}"), (3, f"four\n{middle}"), (4, f"five\n{middle}")]
    copied = "this line is only in two copies of one text " + long
    rows += [(5, copied), (6, copied), (7, "a line of nine words is in two others"), (8, "x\na line of nine words is in two others"), (9, "short line"), (10, "y\nshort line"), (11, "z\nshort line"), (12, f"one\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["n_dropped"] for r in templates.drop_recurring_lines(df, identical=True).collect()}
    assert {i for i, n in out.items() if n} == {1, 3, 4} and sum(out.values()) == 3
    assert templates.drop_recurring_lines(df).filter("n_dropped > 0").isEmpty()


def test_quality(docs):
    def base(t):
        w = words(t)
        windows = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
        twice, covered = Counter(windows), set()
        for a, x in enumerate(windows):
            if twice[x] > 1:
                covered |= set(range(a, a + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    got = quality.judged(docs).select("doc_id", *quality.BASE).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *base(t))) for i, t, _ in ROWS)


def test_frequent_lines_deplete_documents(spark):
    shared = "the very same line of text on all of these pages here"
    rows = [(i, f"{shared}\npage {i} says", "host") for i in range(40)] + [(100, prose(60), "host"), (101, f"{shared}\n{prose(80)}", "host"), (102, shared + "\npage 102 says", "elsewhere")]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0]["kept"] and not out[1]["kept"] and not out[39]["kept"]
    assert out[100]["kept"] and out[101]["kept"] and out[101]["n_removed"] == 12 and out[102]["kept"]
    kept = quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, 100, 101, 102}


def test_repeated_rows_lose_what_one_row_loses(spark):
    shared = "the very same line of text on all of these pages here"
    own = " ".join(f"w{k}" for k in range(100))
    rows = [(i, f"{shared}\npage {i} says", "host") for i in range(40)] + [(200, f"{shared}\n{shared}\n{own}", "host")] * 4 + [(200, f"{shared}\n{shared}\n{own}", "elsewhere"), (201, f"{shared}\n{own}", "host")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.judged(df).filter("doc_id >= 200").collect()
    n = len(shared.split())
    assert sorted((r["doc_id"], r["source"], r["n_removed"], r["kept"]) for r in out) == [(200, "elsewhere", 0, True)] + [(200, "host", 2 * n, True)] * 4 + [(201, "host", n, True)]
    assert quality.accepted(df).filter("doc_id = 200").count() == 5


def test_quotes(spark):
    rows = [
        (1, 0, "Shall we meet on Monday?\n\nOr some day later in the week?"),
        (1, 1, "> Shall we meet on  monday?\nYes."),
        (1, 2, "> > Or some day later in the week?\n> no idea\nHm"),
        (1, 3, "> Yes.\nGood then."),
        (1, 4, None),
        (1, 5, "> never said by anyone\nx"),
        (2, 1, "> Yes.\nother conversation"),
        (None, 0, ""),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [(out[1, t]["reply_to"], out[1, t]["root"], out[1, t]["depth"], out[1, t]["body"]) for t in range(6)] == [(None, 0, 0, rows[0][2]), (0, 0, 1, "Yes."), (None, 2, 0, "Hm"), (1, 0, 2, "Good then."), (None, 4, 0, ""), (None, 5, 0, "x")]
    assert out[2, 1]["reply_to"] is None and out[1, 2]["max_level"] == 2 and len(out) == len(rows)


def test_passages_of_every_level_are_linked_and_threads_ordered(spark):
    rows = [(1, 0, "first question of all"), (1, 1, "another start"), (1, 2, "> > first question of all\n> an edited line\nHm"), (1, 3, "> another start\n> > first question of all\nsecond reply"), (1, 4, "> first question of all\nreply"), (2, 0, "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.linked(df).collect()}
    links = {k: [tuple(x) for x in r["quote_links"]] for k, r in out.items()}
    assert links == {(1, 0): [], (1, 1): [], (1, 2): [(0, 2, 0)], (1, 3): [(0, 1, 1), (1, 2, 0)], (1, 4): [(0, 1, 0)], (2, 0): []}
    assert [out[1, t]["reply_to"] for t in range(5)] == [None, None, None, 1, 0]
    assert [t for _, t in sorted((out[1, t]["position"], t) for t in range(5))] == [0, 4, 1, 3, 2] and out[2, 0]["position"] == 0


def test_mixture(spark):
    rows = [(i, prose(rng.randint(0, 60)), f"s{i % 7}" if i % 11 else None) for i in range(700)] + [(5, None, "s1"), (None, "a b c", "s2"), (8, "x y", "z"), (8, "x y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mixed(df).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixture.mixed(df.repartition(5)).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    taken = Counter()
    for r in out:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 120 for s in order)
    assert mixture.emitted(mixture.mixed(df)).count() == sum(r["copies"] for r in out)


def brute_forward(fit, emit, words):
    alpha, logs = fit.start * emit[words[0]], 0.0
    for w in words[1:]:
        alpha = (alpha @ fit.move) * emit[w]
        logs, alpha = logs + math.log10(alpha.sum()), alpha / alpha.sum()
    return logs + math.log10(alpha.sum())


def test_hmm(spark, docs):
    out = hmm.scored(docs).collect()
    assert len(out) == len(ROWS)
    counts, n = Counter(), 0
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    for i, t, _ in ROWS:
        if fold(i) != 2:
            counts.update(hmm.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), fold(i) == 2, len(w := hmm.tokens((t or "").encode())), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    fit, weight = brute_fit([hmm.tokens((t or "").encode()) for i, t, _ in ROWS if fold(i) != 2], hmm.ROUNDS)
    got = {}
    for r in out:
        got.setdefault(str(r["doc_id"]), []).append(round(r["score"], 6))
    for i in {str(r[0]) for r in ROWS}:
        scores = [brute_score(fit, weight, hmm.tokens((t or "").encode())) for k, t, _ in ROWS if str(k) == i]
        assert np.allclose(sorted(got[i]), sorted(scores), rtol=1e-4), i


def brute_fit(texts, rounds):
    """Baum-Welch in plain Python, text by text -> ((start, move), weights by word; None: an unseen word)."""
    k, counts = hmm.STATES, Counter(w for t in texts for w in t)
    n, v = sum(counts.values()), len(counts)
    share = lambda w: (counts[w] + 1) / (n + v + 1)
    signed = lambda w: hmm.word_key(w) - (1 << 64) * (hmm.word_key(w) >> 63)
    often = sorted((w for w in counts if share(w) >= hmm.TILTED_SHARE), key=signed)
    tilt = np.random.default_rng(7).gamma(0.5, 2.0, (k, len(often)))
    weight = {w: np.full(k, share(w)) for w in [*counts, None]}
    for j, w in enumerate(often):
        weight[w] = weight[w] * tilt[:, j]
    start, move, state = np.full(k, 1 / k), np.full((k, k), 0.02 / (k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(move, 0.98)
    for _ in range(rounds):
        total = sum(weight.values())
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), {w: np.zeros(k) for w in counts}
        for t in texts:
            e = [weight[w] / total for w in t]
            alpha = [start * e[0]]
            for x in e[1:]:
                alpha.append(alpha[-1] @ move * x)
                alpha[-1] /= alpha[-1].sum()
            beta = [np.ones(k)]
            for x in e[:0:-1]:
                beta.append(move @ (x * beta[-1]))
                beta[-1] /= beta[-1].sum()
            beta.reverse()
            for j, w in enumerate(t):
                gamma = alpha[j] * beta[j] / (alpha[j] @ beta[j])
                emits[w] += gamma
                if j:
                    xi = alpha[j - 1][:, None] * move * (e[j] * beta[j])[None, :]
                    moves += xi / xi.sum()
                else:
                    starts += gamma
        start, move = (starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
        mass = sum(emits.values())
        state, u = mass / mass.sum(), hmm.PRIOR / (n + v + 1)
        once = [emits[w] for w in counts if counts[w] == 1]
        weight = {w: (counts[w] + 1) * ((emits[w] + hmm.BACK_OFF * state) / (counts[w] + hmm.BACK_OFF) + u) for w in counts}
        weight[None] = (sum(once, np.zeros(k)) + hmm.BACK_OFF * state) / (len(once) + hmm.BACK_OFF) + u
    return (start, move), weight


def brute_score(fit, weight, words):
    (start, move), total, alpha, logs = fit, sum(weight.values()), None, 0.0
    for w in words:
        e = weight.get(w, weight[None]) / total
        alpha = start * e if alpha is None else (alpha @ move) * e
        logs, alpha = logs + math.log10(alpha.sum()), alpha / alpha.sum()
    return logs


def test_hmm_likelihoods_are_those_of_the_plain_recursion():
    k, n = hmm.STATES, 50
    some = np.random.default_rng(1)
    fit = hmm.Fit(9, 9, some.dirichlet(np.ones(k)), some.dirichlet(np.ones(k), k), np.full(k, 1 / k), np.ones(k), np.ones(k))
    emit = some.random((n, k))
    seqs = [some.integers(0, n, m) for m in (1, 2, 70, 3, 700)]
    assert np.allclose(hmm.InStep(seqs).log_likelihoods(fit, emit), [brute_forward(fit, emit, s) for s in seqs])


def test_hmm_every_word_has_emissions(spark):
    """More words than any cap there was, some of them seen once: each has its own expected counts, which sum to its count."""
    kinds = [[f"{x}{j}" for j in range(15_000)] for x in "ab"]
    rows = [(i, f"once{i} " + " ".join(kinds[i // 2 % 2][(i // 4 * 100 + j) % 15_000] for j in range(100))) for i in range(1200)]
    training = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    counts = {hmm.word_key(w): n for w, n in Counter(x for _, t in rows for x in hmm.tokens(t.encode())).items()}
    blocked = hmm.in_blocks(training)
    fit, state = hmm.baum_welch(blocked, hmm.in_shards(blocked, 7), 7, rounds=2)
    found = state.select("words", "c", "s").toArrow()
    shards = [hmm.words_of_shard(found, k) for k in range(found.num_rows)]
    keys, c, s = (np.concatenate([x[k] for x in shards]) for k in range(3))
    assert dict(zip(keys.tolist(), c.astype(int).tolist(), strict=True)) == counts and len(counts) > 24_096 and len(shards) == 7
    assert np.allclose(s.sum(axis=1), c, rtol=1e-3) and np.allclose(fit.move.sum(axis=1), 1)
    assert np.allclose((fit.weights(keys, c, s).sum(axis=0) + fit.unseen) / fit.total, 1, rtol=1e-5)


def test_hmm_blocks_of_any_size_give_the_same_scores(spark, docs, monkeypatch):
    scores = lambda: [(str(r["doc_id"]), r["score"]) for r in hmm.scored(docs, rounds=2).orderBy("doc_id", "n_tokens", "score").collect()]
    whole = scores()
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(hmm, "SHARD_WORDS", 100)
    small = scores()
    assert [x for x, _ in whole] == [x for x, _ in small] and np.allclose([x for _, x in whole], [x for _, x in small], rtol=1e-4)


def test_hmm_without_training_rows_scores_words_as_unseen(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == hmm.HELD_OUT]
    df = spark.createDataFrame([(i, "a b" * (i % 3)) for i in held], "doc_id long, text string")
    for r in hmm.scored(df).collect():
        assert r["held_out"] and r["n_known"] == 0 == r["train_tokens"] and abs(r["base_score"]) < 1e-12 and math.isfinite(r["score"])
    assert hmm.scored(df.limit(0)).count() == 0


def test_hmm_beats_base_on_held_out_text(spark, sf_dir):
    out = queries.op8_hmm(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_sampling(spark):
    rows = [(i, prose(rng.randint(20, 120)) + " " + PASSAGE * (i % 3)) for i in range(120)] + [(500, None), (501, "")]
    out = {r["doc_id"]: r for r in sampling.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        for other, name in ((edited, "edited"), (following, "following")):
            a, b = Counter(words(t)), Counter(words(other))
            union = sum((a | b).values())
            j = sum((a & b).values()) / union if union else 1.0
            errors.append(np.mean(np.array(out[i]["signature"]) == np.array(out[i][name])) - j)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(open(path, encoding="utf-8").read())
    odd = ["<|endoftext|>x <|startoftext|> a<|endoftext|>b", "I'LL don't 'S it's", "Ünïcode ÇA İstanbul ΣΑΣ", "é à̖x", "12345 a1b2 !!! $5", " x y​z　", "日本語", "a" * 3000, "😀😃 zz", "\x1c\x1f a\x85b", "ﬁne Ⅷ ²³"]
    for text in odd + [t or "" for t in TEXTS]:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode([text.encode()])[0]
        assert ids == expected and encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)
    out = bpe.encoded(docs, path)
    assert out.count() == len(ROWS)
    assert {str(r["doc_id"]): r["n_tokens"] for r in out.filter("doc_id < 16").collect()} == {str(i): len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in ROWS[:16]}


def test_bpe_digests_over_a_whole_table_are_the_librarys(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    out = queries.op10_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)


def test_a_lower_rank_that_a_merge_makes_goes_first():
    ranks = {(1, 2): (5, 10), (10, 3): (1, 11), (11, 1): (0, 12)}
    index = bpe.PairIndex(ranks)
    place = index.add([1, 2, 3, 1, 2])
    index.apply()
    assert index.piece(*place) == (12, 2)


def test_pairs_of_all_pieces_are_indexed_at_once():
    ranks = {(1, 2): (5, 10), (2, 1): (3, 20), (10, 10): (1, 30)}
    index = bpe.PairIndex(ranks)
    for piece in ([1, 2, 1, 2], [], [2], [1, 2]):
        index.add(piece)
    assert index.places() == {3: [2], 5: [1, 3, 9]}  # no pair across pieces
    index.apply()
    assert [np.frombuffer(x, np.int32).tolist() for x in index.packed()] == [[1, 20, 2], [], [2], [10]]


def test_warc(spark):
    rows = [(1, "http://a", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://b c\n", None), (4, "u", ""), (None, "n", "only"), (7, "x", "y" * 300_000), (7, "x", "y" * 300_000)]
    rows += [(100 + i, f"http://{i}", f"<html><body>{prose(200)}</body></html>") for i in range(300)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and all(r["error"] is None for r in out)
    by = {r["record_id"]: r for r in out}
    assert by[1]["record_type"] == "revisit" and by[1]["refers_to"] == 2 and by[1]["payload_bytes"] == 9 and by[2]["record_type"] == "response"
    assert by[3]["refers_to"] == 4 and by[4]["payload_bytes"] == 0 and by[None]["record_type"] == "response"
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_reports_damage():
    records = [warc.build_record(i, "u", p := prose(300).encode(), len(p), warc.base64.b32encode(hashlib.sha1(p).digest()).decode(), None, False) for i in range(200)]
    data = warc.pack_archive(records)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_MAGIC
    assert [raw for _, raw, _ in warc.frames(data)] == records
    assert list(warc.frames(data[:-5]))[-1][2] is not None
    with pytest.raises(ValueError, match="length"):
        warc.parse_record(records[0][:-1])
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(records[0][:-5] + b"!" + records[0][-4:])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    for run in (phrases.without_repeats, templates.drop_recurring_lines, simhash.near_duplicates, quality.judged, mixture.mixed, hmm.scored, sampling.edited_neighbours, lambda d: bpe.encoded(d, queries.tokenizer_path()), lambda d: quotes.linked(d.selectExpr("doc_id conv_id", "doc_id turn", "text"))):
        assert run(empty).count() == 0
