"""SimHash near-duplicates, compared bit-sliced.

Fingerprint: words are runs of non-space characters of the text with A-Z lower-cased, shingles are
``SHINGLE`` words joined by a space (fewer words: the whole sequence; no words: fingerprint 0). A
bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Linking: fingerprints are made distinct, then dealt into tables by blocks of bits such that two
that differ in ``RADIUS`` bits at most share a key in one table. In a bucket, bit planes are stored
vertically (one machine word holds one bit of 64 fingerprints); carry-save counters add the
differing planes for all lanes at once, and words whose lanes all exceed the radius are abandoned.
A bucket returns links that connect it, not its pairs. Components join across buckets.

Defined cases: a null text is the empty text; a null doc_id comes after all others, and is the
component's id only where no member has one (then it is null); repeated rows are linked as equal;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import NULL_ID, byte_column, materialize, row_id
from .components import connect

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Buckets up to this size are compared by lag, all of a chunk at once; larger ones by growing components.
SMALL_BUCKET = 48
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # for bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    return of_values(values)


def of_values(values: np.ndarray) -> int:
    """The fingerprint of shingle values, repeats included; 0 of none."""
    return sum(1 << j for j in np.nonzero(2 * bit_counts(values) > len(values))[0].tolist())


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many values have each bit set: full adders turn three words into a sum and a carry, level by level."""
    total, weight = np.zeros(BITS, np.int64), 1
    while True:
        carries = []
        while len(values) >= 3:
            k = len(values) // 3
            a, b, c = values[:k], values[k : 2 * k], values[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            values = np.concatenate([half ^ c, values[3 * k :]])
        if len(values):
            total += weight * np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if not carries:
            return total
        values, weight = np.concatenate(carries), 2 * weight


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x, shingle) for x in byte_column(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): plane j's word w holds bit j of values 64w to 64w+63."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes(flags: np.ndarray) -> np.ndarray:
    """Booleans as packed words."""
    padded = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def unpacked(words: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))[0]


def within(planes: np.ndarray, others: np.ndarray, dead: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes, packed, whose distance is at most radius and that aren't dead. others: (64, words) or (64, 1)."""
    counters = [np.zeros(len(dead), "<u8") for _ in range(radius.bit_length())]
    over, live, one = dead.copy(), np.arange(len(dead)), others.shape[1] == 1
    for first in range(0, BITS, 8):
        keep = over != FULL
        if not keep.all():  # abandon words all of whose lanes exceed the radius
            live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
        if not len(live):
            break
        whole = len(live) == len(dead)
        for j in range(first, first + 8):
            mine = planes[j] if whole else planes[j, live]
            carry = mine ^ (others[j] if one or whole else others[j, live])
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
    more, equal = np.zeros_like(over), np.full_like(over, FULL)
    for k in reversed(range(len(counters))):  # counters above a radius that isn't 2^k - 1
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    out = np.zeros(len(dead), "<u8")
    out[live] = ~(over | more)
    return out


def shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes whose lane i is the given planes' lane i + by."""
    q, r = divmod(by, 64)
    out = np.zeros_like(planes)
    n = planes.shape[1]
    out[:, : n - q] = planes[:, q:] >> np.uint64(r)
    if r and n - q > 1:
        out[:, : n - q - 1] |= planes[:, q + 1 :] << np.uint64(64 - r)
    return out


def small_links(values: np.ndarray, groups: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect near values of the same group; groups is sorted, its runs are short."""
    planes, parent, out = bit_planes(values), {}, []

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    for lag in range(1, min(SMALL_BUCKET, len(values))):
        same = np.zeros(len(values), bool)
        same[:-lag] = groups[lag:] == groups[:-lag]
        if not same.any():
            break
        for i in unpacked(within(planes, shifted(planes, lag), ~lanes(same), radius)).tolist():
            a, b = root(i), root(i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + lag))
    return out


def large_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect near values of one group. A component grows from a member and drops out of later comparisons."""
    left, out = np.arange(len(values)), []
    planes, gone = bit_planes(values), np.zeros(len(values), bool)
    wide = np.array([0, FULL], "<u8")
    while len(left):
        start = int(np.argmin(gone)) if not gone.all() else -1
        if start < 0:
            break
        gone[start] = True
        queue = [int(left[start])]
        while queue:
            x = queue.pop()
            query = wide[(int(values[x]) >> np.arange(BITS, dtype=object) & 1).astype(np.int64)][:, None]
            dead = ~lanes(~gone)
            for i in unpacked(within(planes, query, dead, radius)).tolist():
                gone[i] = True
                out.append((x, int(left[i])))
                queue.append(int(left[i]))
            if gone.sum() * 2 > len(gone) > 256:
                left = left[~gone]
                planes, gone = bit_planes(values[left]), np.zeros(len(left), bool)
    return out


def blocks_for(n_distinct: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, blocks that must be equal): wider keys for more fingerprints. Each choice finds every link."""
    for extra, most in ((1, 1 << 22), (2, 1 << 32)):
        if n_distinct <= most:
            return radius + extra, extra
    return radius + 3, 3


def table_keys(fp: Column, blocks: int, equal: int) -> Column:
    """array<struct<t int, key long>>: one key for each choice of blocks that may be equal."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), equal)):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp long) -> (u, v): links that connect every two fingerprints within the radius, directly or by others."""
    rows = distinct.select("fp", F.explode(table_keys(F.col("fp"), *blocks_for(distinct.count(), radius))).alias("k")).select("k.t", "k.key", "fp")

    def of_groups(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.nonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[0]
        sizes = np.diff(np.r_[starts, len(fp)])
        number, pairs, values = np.repeat(np.arange(len(starts)), sizes), [], fp.view(np.uint64)
        small = np.nonzero((np.repeat(sizes, sizes) <= SMALL_BUCKET) & (np.repeat(sizes, sizes) > 1))[0]
        at = 0
        while at < len(small):
            end = min(len(small), at + CHUNK)
            while end < len(small) and number[small[end]] == number[small[end - 1]]:
                end += 1
            own = small[at:end]
            pairs += [(own[i], own[j]) for i, j in small_links(values[own], number[own], radius)]
            at = end
        for k in np.nonzero(sizes > SMALL_BUCKET)[0].tolist():
            pairs += [(starts[k] + i, starts[k] + j) for i, j in large_links(values[starts[k] : starts[k] + sizes[k]], radius)]
        if pairs:
            ij = np.array(pairs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[ij[:, 0]]), pa.array(fp[ij[:, 1]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            if held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1]:
                continue  # one bucket so far
            t, key, fp = (np.concatenate([h[k] for h in held]) for k in range(3))
            last = int(np.nonzero((t != t[-1]) | (key != key[-1]))[0][-1]) + 1
            yield from of_groups(t[:last], key[:last], fp[:last])
            held = [[t[last:], key[last:], fp[last:]]]
        if held:
            yield from of_groups(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for each row."""
    own = materialize(fingerprints(df, id_column, text_column, shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min(row_id("id")).alias("rep"))
    edges = connect(links(distinct.select("fp"), radius))
    rooted = distinct.join(edges.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "rep", F.coalesce("v", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(roots, "root").select("fp", F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))
    return own.join(named, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
