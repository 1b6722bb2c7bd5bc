"""Near-duplicates by SimHash and MinHash, confirmed on whole shingle sets, for the near-dedup stage of the pipeline.

Shingles are ``SHINGLE`` words (runs of non-space characters, A-Z lower-cased) as XXH64 values; a text of
fewer words is one shingle, a text without words has none. Texts with the same words are one text. Candidates are
the links of SimHash fingerprints of these shingles, compared bit-sliced as in op4, and, as similar texts can lie
beyond that radius, the buckets of MinHash values in ``BANDS`` bands of ``ROWS``. A pair of similarity s shares no band with probability
(1 - s^ROWS)^BANDS, 5e-6 at 0.8 and less above; ``overlap`` links those that neither finds, so no pair is lost. The candidates' components
are then taken apart: in each one, texts are compared on their whole shingle sets, and only similarities of ``LEAST`` or more link.

A bucket gives links to its least member, not its pairs; a linked text drops out of later comparisons.

Defined cases: a null text is the empty text; texts without words are equal; a null doc_id comes after all
others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import overlap, simhash
from .common import blocks, byte_column, discard, forget, materialize, with_key
from .components import connect
from .overlap import LEAST

SHINGLE, SEED, BANDS, ROWS = 5, 42, 40, 6
_draw = np.random.default_rng(SEED)
_flip = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_odd = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 11


def shingle_values(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The values of a text's shingles, repeats included."""
    words = text.lower().split()  # for bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of shingle values, ascending."""
    return np.unique(shingle_values(text, shingle))


def bands(values: np.ndarray) -> list[int]:
    """A key for each band; none for the empty set."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), CHUNK):
        np.minimum(least, ((values[at : at + CHUNK, None] ^ _flip) * _odd).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(raw[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def same_words(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - (1 << 63)


def components(sets: list[np.ndarray]) -> list[int]:
    """For each set the least index that it reaches by links."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root.tolist()
    sizes = np.array([len(s) for s in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark, left = np.zeros(len(distinct), np.int64), np.arange(len(sets))
    a, b = LEAST
    while len(left):
        start, queue, left = left[0], [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = left[(b * sizes[left] >= a * sizes[x]) & (a * sizes[left] <= b * sizes[x])]
            if not len(close):
                continue
            mark[own[x]] = 1
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in close])], np.r_[0, np.cumsum(sizes[close])[:-1]])
            mark[own[x]] = 0
            found = close[b * shared >= a * (sizes[close] + sizes[x] - shared)]
            if len(found):
                root[found] = start
                queue.extend(found.tolist())
                left = np.setdiff1d(left, found, assume_unique=True)
    return root.tolist()


def near_links(members: DataFrame) -> DataFrame:
    """members(c long, g long, text) -> (g, root): candidates' components taken apart; root is a text of the same group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([names[k] for k in components(sets)], pa.int64())], ["g", "root"])

        for batch in batches:
            for c, g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_column(batch, "text"), strict=True):
                if c != now and names:
                    yield closed()
                    names, sets = [], []
                now = c
                names.append(g)
                sets.append(shingles(text))
        if names:
            yield closed()

    return members.repartition("c").sortWithinPartitions("c", "g").select("c", "g", "text").mapInArrow(run, "g long, root long")


def candidates(signed: DataFrame) -> DataFrame:
    """signed(g long, fp long, bands array<long>) -> (u, v): links of texts that may be similar, by fingerprints and by bands."""
    texts = signed.filter("size(bands) > 0").dropDuplicates(["g"])
    keys = texts.select("g", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("g").alias("v"), F.max("g").alias("most")).filter("v < most").select("key", "v")
    shared = keys.join(buckets, "key").filter("g <> v").select(F.col("g").alias("u"), "v")
    owners = materialize(texts.groupBy("fp").agg(F.min("g").alias("g")), "fingerprints")
    equal = texts.join(owners.select("fp", F.col("g").alias("v")), "fp").filter("g <> v").select(F.col("g").alias("u"), "v")
    found = simhash.links(owners.select("fp")).select(F.col("u").alias("fp"), F.col("v").alias("other"))
    close = found.join(owners.select("fp", F.col("g").alias("u")), "fp").join(owners.select(F.col("fp").alias("other"), F.col("g").alias("v")), "other").select("u", "v")
    return shared.unionByName(equal).unionByName(close)


def shingled(rows: DataFrame) -> DataFrame:
    """rows(g long, c long, text) -> (key, g, n, c): each shingle of each set, n in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 18):
            sets = [shingles(t) for t in byte_column(batch, "text")]
            n = np.array([len(s) for s in sets])
            g, c = (np.repeat(batch.column(k).to_numpy(), n) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(sets).view(np.int64), g, np.repeat(n, n), c)], ["key", "g", "n", "c"])

    return rows.select("g", "c", "text").mapInArrow(run, "key long, g long, n long, c long")


def labels(near: DataFrame) -> DataFrame:
    """(g, c): the component of each text that is in one, from connect()."""
    return near.select(F.col("u").alias("g"), F.col("v").alias("c")).unionByName(near.select(F.col("v").alias("g"), F.col("v").alias("c")).distinct())


def grouped(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _h, first_id, first_h): the key of each row (see with_key) and that of the first row of its group."""
    keyed = with_key(df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))).select("_id", "_h", "text")
    names = ["_id", "_h", "g", "fp", "bands", "n", "lowest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            texts = byte_column(batch, "text")
            prints, keys, sizes, lowest = [], [], [], []
            for t in texts:
                values = shingle_values(t)
                prints.append(simhash.of_values(values))
                values = np.unique(values)
                keys.append(bands(values))
                sizes.append(len(values))
                lowest.append(overlap.lowest(values).view(np.int64).copy())  # a view would hold the whole set
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            ends = np.cumsum([0, *map(len, lowest)])
            deciding = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lowest)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([same_words(t) for t in texts], pa.int64()), fp, pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), deciding], names)

    wide = materialize(keyed.mapInArrow(run, "_id long, _h long, g long, fp long, bands array<long>, n long, lowest array<long>"), "bands")
    signed = materialize(wide.select("_id", "_h", "g"), "signed")
    heads = signed.groupBy("g").agg(F.min(F.struct("_id", "_h")).alias("head"))
    alike = materialize(overlap.by_lowest(wide.select("g", "n", F.explode("lowest").alias("key"))), "alike")
    forget(alike)
    near = connect(candidates(wide.select("g", "fp", "bands")), "candidates")
    discard(wide)
    alike = overlap.by_lowest(overlap.with_component(alike, labels(near)))
    alike = materialize(alike.select("g").distinct(), "alike")
    forget(alike)
    wanted = labels(near).select("g").unionByName(alike).distinct().join(heads, "g").select("g", "head._id", "head._h")
    texts = materialize(keyed.join(wanted, ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("g", "text"), "texts")
    missed = materialize(overlap.links(shingled(overlap.with_component(texts.join(alike, "g"), labels(near)))), "missed")
    if not missed.isEmpty():
        near = connect(near.unionByName(missed), "candidates")
    links = materialize(near_links(labels(near).join(texts, "g")), "near-links")
    forget(links)
    rooted = heads.join(links, "g", "left").select("g", "head", F.coalesce("root", "g").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("head").alias("first"))
    named = rooted.join(firsts, "root").select("g", F.col("first._id").alias("first_id"), F.col("first._h").alias("first_h"))
    return signed.join(named, "g").select("_id", "_h", "first_id", "first_h")
