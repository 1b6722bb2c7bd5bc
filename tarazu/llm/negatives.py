"""Hard negatives: for an anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score is close behind.

Components become whole numbers, ``floor(SCALE * x)``, and a row's score is its inner product with
the anchor. Rows are augmented by a component that gives all of them one length, sqrt(M - |x|^2) for
M the largest squared length, and anchors by 0, which makes the inner product a Euclidean distance:
d^2 = |q|^2 + M - 2 score. A pivot table stores the distances of every row to ``PIVOTS`` pivots. By
the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), so the pivots bracket a
row's score; a bracket that ends below what others surely reach, or outside the asked windows, drops
the row, and the survivors' scores are computed exactly.

Rows are dealt by hash into chunks of about ``CHUNK`` rows and anchors into blocks of about
``BLOCK``; a task searches one chunk for one block and returns a few rows for an anchor, never its
pairs. Positives are found over all chunks first, as they set the windows of the negatives.

Defined cases: rows with a null label, vector, or id, or a null or non-finite component take no part
(a null id can't be named); rows that repeat id, label and vector are one; rows that share an id
otherwise are ranked each, by label and vector where id and score tie, but a row isn't a positive or
negative of an anchor of its own id; shorter vectors end in zeros; other columns are ignored; an
empty table gives no rows. Scores have to fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

SCALE, PIVOTS, SAMPLE, BLOCK, CHUNK = 256, 16, 1024, 16384, 32768
N_POSITIVES, N_NEGATIVES, LEAST_SHARE = 5, 5, 80
#: Float error of bounds, as a share of the squared lengths in them.
SLACK = 1e-9


def whole_rows(df: DataFrame, relabel: int | None = 7) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part, each once. Labels of ids divisible by relabel go up by one, modulo 10."""
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % 10).otherwise(label) if relabel else label
    rows = df.filter(ok).filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")).distinct()


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)
    return np.c_[vectors, np.sqrt(np.maximum(most - squares, 0))]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as float rows of one width; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def pivots_of(sample: list[list[int]], width: int, most: float, k: int = PIVOTS) -> np.ndarray:
    """Rows that lie far from one another, each the farthest from those before."""
    if not sample:
        return np.zeros((0, width + 1))
    rows = augmented(matrix(pa.array(sample, pa.list_(pa.int64())), width), most)
    chosen, near = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(k, len(rows)):
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T, 0))


def pivot_table(rows: DataFrame, pivots: np.ndarray, width: int, most: float) -> DataFrame:
    """rows with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(augmented(matrix(b.column(2), width), most), pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), max(1, d.shape[1])).cast(pa.list_(pa.float64()))], ["id", "label", "v", "d"])

    return rows.mapInArrow(run, "id long, label long, v array<long>, d array<double>")


def brackets(q: np.ndarray, dq: np.ndarray, d: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the scores of an anchor with rows; d has a row for each pivot."""
    total = float(q @ q) + most
    slack = SLACK * total + 1e-6
    near = np.abs(d - dq[:, None]).max(axis=0, initial=0)
    far = (d + dq[:, None]).min(axis=0, initial=np.inf)
    return (total - far**2) / 2 - slack, (total - near**2) / 2 + slack


def exact(vectors: np.ndarray, at: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Inner products of some rows as whole numbers; floats hold them where no partial sum reaches 2^53."""
    if most < 2**52:
        # where most rows are asked for, a product with all is cheaper than their copy
        products = (vectors @ q)[at] if 2 * len(at) > len(vectors) else vectors[at] @ q
        return np.rint(products).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in vectors[at]], object).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def searched(rows: DataFrame, anchors: DataFrame, find, out: pa.Schema, n_rows: int, n_anchors: int) -> DataFrame:
    """find(anchor's columns, the chunk's arrays) for each anchor and chunk: rows meet anchors in a grid of chunks and blocks."""
    n_chunks = max(-(-n_rows // CHUNK), rows.sparkSession.sparkContext.defaultParallelism)
    n_blocks = max(1, -(-n_anchors // BLOCK))
    at = lambda n: F.pmod(F.xxhash64("id", "label", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(at(n_chunks).alias("c"), "*").select("*", every(n_blocks).alias("b"))
    right = anchors.select(at(n_blocks).alias("b"), "*").select("*", every(n_chunks).alias("c"))

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(find(mine, asked))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.types, strict=True)], schema=out) if found else out.empty_table()

    return left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInArrow(run, ", ".join(f"{f.name} long" for f in out))


POSITIVE = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_label", "k", "id", "score", "tie")])
NEGATIVE = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_label", "k", "j", "positive", "positive_score", "id", "score", "tie")])


def mined(df: DataFrame, anchors_every: int = 100, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, least_share: int = LEAST_SHARE, relabel: int | None = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = materialize(whole_rows(df, relabel), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n_rows, n_anchors, most, width = rows.agg(F.count("*"), F.count(F.when(F.col("id") % anchors_every == 0, 1)), F.max(square), F.max(F.size("v"))).first()
    most, width = float(most or 0), int(width or 0)
    # a bounded sample, by hash, suffices to choose pivots: any rows give right brackets
    drawn = rows.filter(F.pmod(F.xxhash64("v", "id"), F.lit(max(1, n_rows // SAMPLE))) == 0).select("v").orderBy("v").limit(2 * SAMPLE)
    pivots = pivots_of([r["v"] for r in drawn.collect()], width, most)
    rows = materialize(pivot_table(rows, pivots, width, most), "pivot-table").withColumn("tie", F.xxhash64("label", "v"))
    anchors = rows.filter(F.col("id") % anchors_every == 0)

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        one = lambda c: t.column(c).to_numpy()
        return one("id"), one("label"), one("tie"), matrix(t.column("v"), width), matrix(t.column("d"), len(pivots))

    def anchor_rows(t: pa.Table) -> Iterator[tuple]:
        """As queries, anchors are augmented by 0, so their distances to the pivots aren't those that they have as rows."""
        ids, labels, ties, vectors, _ = arrays(t)
        return zip(ids, labels, ties, vectors, distances(np.c_[vectors, np.zeros(len(vectors))], pivots), strict=True)

    def positives(mine: pa.Table, asked: pa.Table) -> Iterator[tuple]:
        ids, labels, ties, vectors, d = arrays(mine)
        of = {}
        for y in np.unique(labels).tolist():
            at = np.nonzero(labels == y)[0]
            of[y] = ids[at], ties[at], vectors[at], np.ascontiguousarray(d[at].T)
        for a, y, tie, q, dq in anchor_rows(asked):
            if int(y) not in of:
                continue
            own_ids, own_ties, own_vectors, own_d = of[int(y)]
            low, high = brackets(q, dq, own_d, most)
            other = own_ids != a
            at = np.nonzero(other & (high >= kth(low[other], n_positives)))[0]
            scores = exact(own_vectors, at, q, most)
            for k in best(scores, own_ids[at], n_positives):
                yield a, y, tie, own_ids[at[k]], scores[k], own_ties[at[k]]

    near = searched(rows, anchors, positives, POSITIVE, n_rows, n_anchors)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "tie"))
    near = near.withColumn("rank", rank("anchor", "anchor_label", "k")).filter(F.col("rank") <= n_positives)
    near = near.groupBy("anchor", "anchor_label", "k").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("p"), "score"))).alias("found"))
    asked = anchors.join(near, (F.col("id") == F.col("anchor")) & (F.col("label") == F.col("anchor_label")) & (F.col("tie") == F.col("k"))).select("id", "label", "v", "d", "tie", F.transform("found", lambda x: x["p"]).alias("p"), F.transform("found", lambda x: x["score"]).alias("s"))
    asked = materialize(asked, "positives")

    def negatives(mine: pa.Table, wanted: pa.Table) -> Iterator[tuple]:
        ids, labels, ties, vectors, d = arrays(mine)
        by_pivot = np.ascontiguousarray(d.T)
        for (a, y, tie, q, dq), ps, ss in zip(anchor_rows(wanted), wanted.column("p").to_pylist(), wanted.column("s").to_pylist(), strict=True):
            if max(ss) < 0:
                continue  # no score is both over 80 % of a negative one and under it
            low, high = brackets(q, dq, by_pivot, most)
            at = np.nonzero((high >= min(s for s in ss if s >= 0) * least_share / 100) & (low <= max(ss)) & (labels != y) & (ids != a))[0]
            scores = exact(vectors, at, q, most)
            for j, (p, s) in enumerate(zip(ps, ss, strict=True)):
                fit = np.nonzero((100 * scores >= least_share * s) & (scores <= s))[0]
                for k in fit[best(scores[fit], ids[at[fit]], n_negatives)]:
                    yield a, y, tie, j, p, s, ids[at[k]], scores[k], ties[at[k]]

    found = searched(rows, asked, negatives, NEGATIVE, n_rows, n_anchors)
    ranked = found.withColumn("rank", rank("anchor", "anchor_label", "k", "j")).filter(F.col("rank") <= n_negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
