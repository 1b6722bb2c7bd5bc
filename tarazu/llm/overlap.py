"""Near-duplicates that candidates by fingerprints and bands can miss: what can't have one is ruled out, the rest is linked.

Sets of similarity ``LEAST`` (4/5) or more differ in size by that factor at most, and share 4/5 of either's shingles.
So of the shingles of lowest value, n - 4n/5 + k of each set's n, the two share k (the lesser k if theirs differ): at
most the 4n/5 - k above the lower of the two last ones can be left over. A set that shares fewer than that with all
other sets of such sizes has no near-duplicate. Among what is left only sets of another component of the candidates
count, as texts of one component are compared anyhow, and then whole sets are counted instead of the lowest shingles.
Sets that still share 4/5 of their shingles are linked by each shingle, for ``minhash.near_links`` to confirm.

Each step only rules out, so no pair is lost; rows are dealt by shingle, and no pairs of texts are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: The least similarity that links, as a fraction.
LEAST = (4, 5)
#: k is 1, and 1 more for each so many shingles.
STEP = 16
ROUNDS = 2
#: Rows of one shingle that a task holds; all rows of a shingle with more count as shared.
MOST_HELD = 1 << 20


def lowest(values: np.ndarray) -> np.ndarray:
    """The shingles that decide, of a set in ascending order."""
    n, (a, b) = len(values), LEAST
    return values[: n + 1 + n // STEP - -(-a * n // b)] if n else values


def with_others(key: np.ndarray, g: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows have a row of the same key, another c and a size that can be similar; of repeated rows the first. Sorted by key, n, g."""
    at, (a, b) = np.arange(len(key)), LEAST
    new = np.r_[True, key[1:] != key[:-1]]
    bucket = np.cumsum(new)
    turn = new | np.r_[True, c[1:] != c[:-1]]
    before = np.maximum.accumulate(np.where(turn, at, 0)) - 1  # the nearest row of another c, on either side
    after = np.minimum.accumulate(np.where(np.r_[turn[1:], True], at, len(key))[::-1])[::-1] + 1
    found = np.zeros(len(key), bool)
    for other, some in ((before, before >= 0), (after, after < len(key))):
        i, j = at[some], other[some]
        found[i] |= (bucket[i] == bucket[j]) & (a * np.maximum(n[i], n[j]) <= b * np.minimum(n[i], n[j]))
    return found & (new | np.r_[True, g[1:] != g[:-1]])


def shared(rows: DataFrame) -> DataFrame:
    """rows(key, g, n long, and c long, else g stands for it) -> the rows whose key sets of other c's, of sizes that can be similar, have too."""
    own = "c" if "c" in rows.columns else "g"
    names = ["key", "g", "n", *(["c"] if own == "c" else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        often = None

        def marked(some: list[np.ndarray]) -> pa.RecordBatch:
            key, g, n, c = *some[:3], some[names.index(own)]
            keep = with_others(key, g, c, n)
            if often is not None:
                keep |= key == often
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in some], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            key = held[0]
            last = int(np.searchsorted(key, key[-1]))
            if not last and len(key) >= MOST_HELD:
                last, often = len(key), int(key[-1])
            if last:
                yield marked([x[:last] for x in held])
                held = [x[last:] for x in held] if last < len(key) else []
        if held:
            yield marked(held)

    return rows.select(*names).repartition("key").sortWithinPartitions("key", "n", "g").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def enough(found: DataFrame, need: str) -> DataFrame:
    """The rows of the sets that have as many of them as need says of their n."""
    return found.join(found.groupBy("g").agg(F.count("*").alias("k"), F.max("n").alias("n")).filter(f"k >= {need}").select("g"), "g", "left_semi")


def with_component(rows: DataFrame, label: DataFrame) -> DataFrame:
    """c: the component of the candidates that a set is in, by label(g, c); a set in none is its own."""
    return rows.join(label, "g", "left").withColumn("c", F.coalesce("c", "g"))


def least_shared(size: str = "n") -> str:
    a, b = LEAST
    return f"(({a} * {size} + {b - 1}) div {b})"


def by_lowest(rows: DataFrame) -> DataFrame:
    """rows(key, g, n), of lowest(): those of sets that may be similar to another."""
    return enough(materialize(shared(rows), "shared"), f"1 + {least_shared()} div {STEP}")


def links(whole: DataFrame) -> DataFrame:
    """whole(key, g, n, c), all shingles of the sets that may be similar to one of another c -> (u, v): links that connect all that are."""
    for _ in range(ROUNDS):
        whole = materialize(enough(materialize(shared(whole), "shared"), least_shared()), "enough")
    firsts = whole.groupBy("key").agg(F.min("g").alias("v"))
    return whole.join(firsts, "key").filter("g <> v").select(F.col("g").alias("u"), "v").distinct()
