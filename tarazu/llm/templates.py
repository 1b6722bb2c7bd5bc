"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its token count, then its first ``LEADING`` tokens; tokens with a digit are
variable fields and read ``<*>``. What the lines of a leaf share is learnt from them: at each further place
a token that ``MIN_DOCUMENTS`` lines of the leaf have there (each counted once a document) is constant, any
other is a field ``<*>``. A line of which at least ``AGREE`` of all tokens are constant stands for the
template so made; one with more fields has none. A template that ``MIN_DOCUMENTS`` documents share recurs;
the document with the least id keeps its lines, and all others drop the lines that stand for it. Lines of
under ``MIN_TOKENS`` tokens are in no template.

Identical lines: where asked for, a line of ``IDENTICAL_TOKENS`` tokens or more also stands for itself, tokens
as they are, and recurs in ``IDENTICAL_DOCUMENTS`` documents (one of ``LONG_TOKENS`` tokens in ``LONG_DOCUMENTS``),
unless all of these have the same text; copies of the text that keeps its lines keep them too, so that
they stay copies.

Leaves are counted before anything else, and only lines of leaves that could hold a template are looked at
further, each distinct line once. A leaf is never gathered: its places and tokens are counted by key, so a
leaf, a template or a line that a third of all rows share is pre-aggregated like any other.

Defined cases: a null text has no lines and stays null; a null doc_id comes after all others; rows with the
same doc_id and text are one document, those with other texts documents of their own, and all rows with the
least id keep their lines; lines without words are kept; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_column, keyed_rows, made, materialize

LEADING, MIN_TOKENS, MIN_DOCUMENTS = 2, 4, 10
#: The least share of constant tokens, as a fraction: 3 / 5.
AGREE = (3, 5)
IDENTICAL_TOKENS, IDENTICAL_DOCUMENTS = 8, 3
LONG_TOKENS, LONG_DOCUMENTS = 50, 2
FIELD = b"<*>"
_digit = re.compile(rb"[0-9]").search


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, those with a digit as fields."""
    return [FIELD if _digit(t) else t for t in line.split()] if _digit(line) else line.split()


def _long(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def leaf_of(tokens: list[bytes], leading: int = LEADING) -> int:
    return _long(b"%d " % len(tokens) + b" ".join(tokens[:leading]))


def line_key(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def same_key(line: bytes) -> bytes:
    """A line as it is, but for its spaces."""
    return xxhash.xxh3_128_digest(b"= " + b" ".join(line.split()))


def line_rows(keyed: DataFrame, leading: int = LEADING, identical: bool = False) -> DataFrame:
    """(leaf, line, _id, _h, least): each distinct line of a row; leaf is null for a line as it is, with the documents that it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            leaves, lines, least, rows = [], [], [], []
            for k, text in enumerate(byte_column(batch, "text")):
                own: dict[tuple[int | None, bytes], int] = {}
                for line in set(text.split(b"\n")):
                    tokens = masked(line)
                    if len(tokens) >= MIN_TOKENS:
                        own[leaf_of(tokens, leading), line_key(tokens)] = 0
                    if identical and (n := len(tokens)) >= IDENTICAL_TOKENS:
                        own[None, same_key(line)] = LONG_DOCUMENTS if n >= LONG_TOKENS else IDENTICAL_DOCUMENTS
                leaves.extend(leaf for leaf, _ in own)
                lines.extend(line for _, line in own)
                least.extend(own.values())
                rows.extend([k] * len(own))
            place = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.binary()), batch.column(0).take(place), batch.column(1).take(place), pa.array(least, pa.int32())], ["leaf", "line", "_id", "_h", "least"])

    return keyed.select("_id", "_h", "text").mapInArrow(run, "leaf long, line binary, _id long, _h long, least int")


def tokens_of(holders: DataFrame, leading: int = LEADING) -> DataFrame:
    """holders(text, wanted array<line>) -> (leaf, line, tokens array<long>): the wanted lines of each text; a null token is a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            leaves, lines, out = [], [], []
            for k, text in enumerate(byte_column(batch, "text")):
                wanted = set(batch.column(1)[k].as_py())
                for line in set(text.split(b"\n")):
                    tokens = masked(line)
                    if len(tokens) >= MIN_TOKENS and (key := line_key(tokens)) in wanted:
                        wanted.discard(key)
                        leaves.append(leaf_of(tokens, leading))
                        lines.append(key)
                        out.append([None if t == FIELD else _long(t) for t in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["leaf", "line", "tokens"])

    return holders.select("text", "wanted").mapInArrow(run, "leaf long, line binary, tokens array<long>")


def learnt(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, leading: int = LEADING) -> DataFrame:
    """lines(leaf, line, tokens, n) -> (line, t1, t2): the template that each line stands for, as two hashes."""
    places = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    constants = places.filter(F.col("token").isNotNull() & (F.col("at") >= leading)).groupBy("leaf", "at", "token").agg(F.sum("n").alias("lines")).filter(F.col("lines") >= min_documents)
    constants = materialize(constants.select("leaf", "at", "token", F.lit(True).alias("constant")), "constants")
    marked = places.join(constants, ["leaf", "at", "token"], "left")
    kept = F.when(F.col("constant") | (F.col("at") < leading), F.col("token"))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("at", kept.alias("token")))), lambda x: F.coalesce(x["token"].cast("string"), F.lit("*")))
    shaped = marked.groupBy("leaf", "line").agg(shape.alias("shape"), F.count("*").alias("all"), F.count(kept).alias("same"))
    agreed = shaped.filter(AGREE[1] * F.col("same") >= AGREE[0] * F.col("all"))
    return agreed.select("line", *(F.xxhash64(F.lit(k), "leaf", F.array_join("shape", " ")).alias(f"t{k}") for k in (1, 2)))


def recurring_lines(rows: DataFrame, keyed: DataFrame, min_documents: int = MIN_DOCUMENTS, leading: int = LEADING) -> DataFrame:
    """(line, _id, _h): the lines that each document drops, for rows of line_rows()."""
    leafed = rows.filter("leaf is not null")
    leaves = materialize(leafed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("leaf"), "leaves")
    candidates = materialize(leafed.join(leaves, "leaf").select("leaf", "line", "_id", "_h"), "candidates")
    distinct = candidates.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_h")).alias("holder"))
    holders = distinct.groupBy("holder").agg(F.collect_list("line").alias("wanted")).select("holder._id", "holder._h", "wanted")
    texts = keyed.select("_id", "_h", "text").join(holders, ["_id", "_h"])
    tokens = materialize(tokens_of(texts, leading), "tokens").dropDuplicates(["leaf", "line"])
    lines = materialize(tokens.join(distinct.select("leaf", "line", "n"), ["leaf", "line"]), "lines")
    named = materialize(learnt(lines, min_documents, leading), "shapes")
    stood = candidates.select("line", "_id", "_h").distinct().join(named, "line")
    recurring = materialize(stood.select("t1", "t2", "_id", "_h").distinct().groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("_id").alias("first")).filter(F.col("n") >= min_documents).select("t1", "t2", "first"), "recurring")
    dropped = stood.join(recurring, ["t1", "t2"]).filter("_id > first").select("line", "_id", "_h")
    # identical lines, where there are rows of them
    same = rows.filter("leaf is null").groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_h")).alias("head"), F.max("least").alias("least"), (F.min("_h") != F.max("_h")).alias("texts"))
    same = materialize(same.filter("n >= least and texts").select("line", "head"), "identical")
    return dropped.unionByName(rows.filter("leaf is null").join(same, "line").filter("_id > head._id and _h <> head._h").select("line", "_id", "_h"))


def drop_recurring_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = MIN_DOCUMENTS, leading: int = LEADING, identical: bool = False) -> DataFrame:
    """The rows with their text without recurring lines, and n_lines and n_dropped."""
    keyed = keyed_rows(df, id_column, text_column, ("n_lines", "n_dropped"))
    found = materialize(line_rows(keyed, leading, identical), "line-rows")
    dropped = recurring_lines(found.distinct(), keyed, min_documents, leading).groupBy("_id", "_h").agg(F.collect_set("line").alias("dropped"))
    rows = keyed.join(dropped, ["_id", "_h"], "left").select("own", "text", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            valid, kept, n_lines, n_dropped = batch.column(1).is_valid().to_pylist(), [], [], []
            for row, text in enumerate(byte_column(batch, "text")):
                lines = text.split(b"\n") if valid[row] else []
                gone = set(batch.column(2)[row].as_py() or ())
                left = [x for x in lines if line_key(masked(x)) not in gone and not (identical and same_key(x) in gone)] if gone else lines
                kept.append(b"\n".join(left) if valid[row] else None)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["own", "kept", "n_lines", "n_dropped"])

    out = rows.mapInArrow(run, made(rows, kept="string", n_lines="long", n_dropped="long"))
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("kept").alias(c) if c == text_column else F.col("own").getField(c).alias(c) for c in names], "n_lines", "n_dropped")
