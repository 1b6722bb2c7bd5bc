"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names, for the pipeline's stages and the operators that they call."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tarazu.llm import bpe, mixture, quality, queries, warc
from tarazu.llm.common import discard, materialize, shared_dir

rng = random.Random(11)
WORDS = [f"w{k}" for k in range(900)]
CLASHING = "doc_id long, text string, source string, n_chars long, _id long, _h long, size long, own string, copies long, _s string, _before long, _copy long, kept string, row string, target string"


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(20) for _ in range(2000))
TEXTS = [prose(60), prose(60), None, "", " \n ", "three short words", LONG, LONG, prose(60) + "\nshared line of the site here", "x" * 20_000]
ROWS = [(i, t, "s0" if i % 3 else None, len(t or ""), 77, 78, 79, "own", 80, "s", 81, 82, "k", "r", "t") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], (0, prose(60), *ROWS[0][2:]), (None, TEXTS[1], *ROWS[1][2:]), (None, prose(60), *ROWS[1][2:]), (None, None, *ROWS[1][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, CLASHING).repartition(3)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_whatever_their_names(spark, sf_dir, docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    for r in out.collect():
        assert (r["_id"], r["_h"], r["size"], r["own"], r["copies"], r["_s"], r["_before"], r["_copy"], r["kept"], r["row"], r["target"]) == (77, 78, 79, "own", 80, "s", 81, 82, "k", "r", "t")
        assert k > 1 or r["text"] is None or r["n_chars"] == len(r["text"])
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_stages_on_nulls_and_repeats(spark, sf_dir, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({0: 3, 1: 1, 6: 1, 7: 1, 8: 1, None: 2})
    assert corpus_pipeline.line_dedup(spark, docs, sf_dir).count() == len(ROWS)
    left = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    # the empty ones are one group (2), the long ones another (6), a null id goes after 1; the two texts of id 0 and the other null stay
    assert left == Counter({0: 2, 1: 1, 2: 1, 5: 1, 6: 1, 8: 1, 9: 1, None: 1})
    assert corpus_pipeline.encode(spark, docs, sf_dir).filter("n_tokens = 0").count() == 4


def test_lines_of_many_documents_go_and_depleted_documents_are_rejected(spark):
    """Brute force over documents, copies included, by host."""
    pool = [prose(rng.choice([3, 8])) for _ in range(12)]
    rows = [(i, "\n".join([*rng.sample(pool, rng.randrange(0, 4)), *(prose(rng.choice([1, 12])) for _ in range(rng.randrange(0, 3)))]), rng.choice(["a", "b", None])) for i in range(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    seen = defaultdict(set)
    for i, t, h in rows:
        for x in t.split("\n"):
            if x.strip():
                seen[h, x].add(i)
    expected = {}
    for i, t, h in rows:
        gone = [x for x in t.split("\n") if len(seen.get((h, x), ())) > quality.LINE_LIMIT and i > min(seen[h, x])]
        expected[i] = "\n".join(x for x in t.split("\n") if x not in gone), sum(len(x.split()) for x in gone)
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in out} == expected and sum(n for _, n in expected.values()) > 500
    for r in out:
        assert r["kept"] == (not r["base_failed"] and 100 * r["n_removed"] <= quality.MOST_REMOVED * r["n_words"])
    texts = {r["doc_id"]: r["text"] for r in quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert texts == {r["doc_id"]: r["kept_text"] for r in out if r["kept"]} and any(t != dict((i, t) for i, t, _ in rows)[k] for k, t in texts.items())


def test_mixture_on_columns_named_like_its_own(spark, docs):
    mix = mixture.mixed(docs)
    assert mix.count() == len(ROWS) and mixture.emitted(mix).count() == mix.agg(F.sum("copies")).first()[0]
    assert mix.agg(F.sum("size")).first()[0] == sum(len((r[1] or "").split()) for r in ROWS)


def test_equal_pages_are_revisits_of_the_largest_id(spark):
    pages = [f"<p>{prose(30)}</p>" for _ in range(20)] + ["", None]
    rows = [(i, f"http://h/{i}", rng.choice(pages), 1, "x") for i in range(500)]
    largest = {}
    for i, _, html, *_ in rows:
        largest[html or ""] = max(largest.get(html or "", 0), i)
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int, payload string")).collect()
    assert {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["error"]) for r in out} == {i: ("response" if largest[h or ""] == i else "revisit", None if largest[h or ""] == i else largest[h or ""], len((h or "").encode()), None) for i, _, h, *_ in rows}


def test_every_archive_leads_with_a_dictionary():
    record = warc.build_record(1, "u", b"small", 5, "x", None, False)
    data = warc.pack_archive([record])
    assert warc.struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_MAGIC and [raw for _, raw, _ in warc.frames(data)] == [record]


def test_spent_tables_are_deleted(spark):
    import os

    df = materialize(spark.range(5), "spent")
    assert df.count() == 5 and os.path.isdir(df._folder)
    discard(df)
    assert not os.path.exists(df._folder) and shared_dir(spark)


def test_the_automaton_decides_what_is_removed():
    from tarazu.llm import phrases

    passage = [f"p{k}".encode() for k in range(80)]
    texts = [b" ".join([*(f"{x}{k}".encode() for k in range(30)), *passage, *(f"{x}{k}".encode() for k in range(40))]) for x in "ab"] + [b"short text"]
    rolling = phrases.Rolling(phrases.hashed(texts[0].split(), phrases.Words()))
    p, position, *_ = phrases.selections(rolling, len(texts[0].split()))
    inside = [(0, int(at)) for at in position if 30 <= at and at + phrases.PHRASE <= 110]
    found = dict(phrases.spans_in_shard(texts, inside, phrases.WINDOW, phrases.PHRASE))
    assert set(found) == {0, 1} and (found[0][0] == found[1][0]).all() and len(inside) > 1
    assert not list(phrases.spans_in_shard(texts, inside, phrases.WINDOW, phrases.PHRASE, build=lambda _: phrases.compiled([])))


def test_an_automatons_nodes_have_few_children_however_many_words_there_are():
    from tarazu.llm import phrases

    own = random.Random(5)
    texts = [" ".join(f"w{own.randrange(9000)}" for _ in range(own.choice([20, 60, 400]))).encode() for _ in range(120)]
    chosen = {}
    for k, text in enumerate(texts):
        if len(words := text.split()) >= phrases.WINDOW:
            _, position, *_ = phrases.selections(phrases.Rolling(phrases.hashed(words, phrases.Words())), len(words))
            chosen[k] = position.tolist()
    holders = [(k, at) for k, places in chosen.items() for at in places[::2]]
    built = []
    found = dict(phrases.spans_in_shard(texts, holders, phrases.WINDOW, phrases.PHRASE, build=lambda x: built.append(phrases.compiled(x)) or built[0]))
    children = Counter(parent for parent, *_ in built[0].dump()[1])
    assert len({texts[k].split()[at] for k, at in holders}) > 300 and max(children.values()) <= 64
    assert {k: len(x[0]) for k, x in found.items()} == {k: len(places[::2]) for k, places in chosen.items()}


def brute_templates(rows, least=10):
    """Templates in plain Python -> lines that each document drops."""
    own = {i: {tuple("<*>" if any(c.isdigit() for c in w) else w for w in x.split()) for x in t.split("\n")} for i, t in rows}
    own = {i: {w for w in lines if len(w) >= 4} for i, lines in own.items()}
    leaf = lambda w: (len(w), w[:2])
    leaves = Counter(leaf(w) for lines in own.values() for w in lines)
    places = Counter((leaf(w), k, x) for lines in own.values() for w in lines for k, x in enumerate(w) if k >= 2 and x != "<*>")
    shapes = {w: (*w[:2], *(x if places[leaf(w), k, x] >= least else "<*>" for k, x in enumerate(w) if k >= 2)) for lines in own.values() for w in lines if leaves[leaf(w)] >= least}
    shapes = {w: s for w, s in shapes.items() if 5 * sum(x != "<*>" for x in s) >= 3 * len(s)}
    docs = defaultdict(set)
    for i, lines in own.items():
        for w in lines:
            if w in shapes:
                docs[shapes[w]].add(i)
    return {i: {w for w in lines if w in shapes and len(docs[shapes[w]]) >= least and i > min(docs[shapes[w]])} for i, lines in own.items()}


def test_templates_generalise_what_varies(spark):
    from tarazu.llm import templates

    names = [f"name{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(8)]
    rows = []
    for i in range(120):
        half = " ".join(f"t{chr(97 + j)}" for j in range(21))  # the same first half, each with its own second half
        lines = [f"Posted by {rng.choice(names)} in Gardening", f"{half} " + " ".join(rng.choice(names) for _ in range(19)), prose(4), f"Read {i} more of the {rng.choice(names)} stories"]
        rows.append((i, "\n".join(rng.sample(lines, rng.randrange(1, 5)))))
    expected = brute_templates(rows)
    out = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    for r, (i, t) in zip(sorted(out, key=lambda r: r["doc_id"]), rows, strict=True):
        kept = [x for x in t.split("\n") if tuple("<*>" if any(c.isdigit() for c in w) else w for w in x.split()) not in expected[i]]
        assert r["text"].split("\n") == kept or (not kept and r["text"] == "")
    text = "\n".join(r["text"] for r in out)
    assert text.count("Posted by") == 1 and text.count("stories") == 1  # words in fields, not digits only
    assert text.count("ta tb tc") == sum("ta tb tc" in t for _, t in rows)  # lines with different second halves stay


def test_mixing_and_near_dedup_dont_depend_on_how_rows_lie(spark, sf_dir):
    """Null and repeated ids with different texts, and rows that differ in other columns only, in two orders."""
    own = random.Random(2)
    rows = [(own.choice([None, own.randrange(40)]), prose(own.choice([1, 5, 60])), own.choice(["a", "b", None]), own.choice(["x", "y"])) for _ in range(300)]
    rows += [(k, t, s, o) for k, t, _, _ in rows[:60] for s in ("a", "b") for o in ("x", "z")]
    schema = "doc_id long, text string, source string, other string"
    several = [spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(rows[::-1], schema).repartition(3, "other")]
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.near_dedup):
        one, two = (Counter(tuple(r) for r in stage(spark, d, sf_dir).collect()) for d in several)
        assert one == two and sum(one.values()) > 50


def test_a_damaged_dictionary_is_an_error_row():
    data = bytearray(warc.pack_archive([warc.build_record(1, "u", b"x" * 500, 500, "A", None, False)]))
    packed = warc.zstd.ZstdCompressor().compress(b"dictionary " * 50)
    for raw in (packed[:-4], packed[:9] + b"\xff" * (len(packed) - 9)):
        broken = warc.struct.pack("<II", warc.SKIPPABLE_MAGIC, len(raw)) + raw + bytes(data[8:])
        found = list(warc.frames(broken))
        assert found[0][1] is None and found[0][2] is not None


def test_blocks_without_new_pairs_are_encoded():
    """Words that are known, single characters and texts without words give no pair to index, in any order of blocks."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(open(path, encoding="utf-8").read())
    for texts in ([""], ["a"], ["known words"], ["known words", "words"], [" ", "words a"], ["<|endoftext|>"], ["knownwords!", "a b"], ["!"], []):
        assert encoder.encode([t.encode() for t in texts]) == [library.encode(t, add_special_tokens=False).ids for t in texts]
