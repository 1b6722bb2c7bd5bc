"""Language-model scoring with a hidden Markov model.

Tokens are the words of the text with A-Z lower-cased, then one end. P(text) = sum over state paths of
product P(state | state before) P(word | state). Every word of the training text has emissions of its own in
every round; a word that it lacks goes with those seen once. So what is learnt grows with the text, and its
vocabulary has no cap.

Texts are read once, into blocks of word numbers (bucketed by block), and each block's words are dealt by
their hashes into shards (bucketed by shard). Then ``ROUNDS`` rounds of Baum-Welch start from states that
chance tilts. In each round shards send every block the emissions of its words, tasks run the scaled forward
and backward recursions over all whole training texts, and blocks send the expected counts back, which shards
add up by word: two shuffles of packed numbers, while neither texts nor shards move. A word's share of a state
leans on the state's share of all tokens by ``BACK_OFF`` tokens. Scoring runs the forward recursion over the
whole text, so the likelihood is exact.

Size: a shard holds about ``SHARD_WORDS`` words of blocks, a block ``BLOCK_BYTES`` of text or one longer text,
so neither the driver nor a task holds the vocabulary. Words are told apart by 64-bit hashes.

Defined cases: a null text is the empty text (one end token); a null doc_id is hashed as an empty
name and belongs to training; repeated rows are counted and scored each; other columns are ignored;
an empty table, or one without training rows, gives unseen-word scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, bucketed, byte_column, discard, forget

FOLDS, HELD_OUT = 7, 2
STATES, ROUNDS = 4, 4
PRIOR, BACK_OFF, TILTED_SHARE = 50.0, 3.0, 0.001
BLOCK_BYTES, SHARD_WORDS = 16 << 20, 1 << 20
END = b""


class Numbers(dict):
    """Word -> small number in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def fold(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % FOLDS


@dataclass
class Fit:
    """What every task needs beside its words' counts; no part grows with the vocabulary. unseen: the weight of a word without counts; total: of all words; tilts: of the frequent words, in the first round."""

    n: int
    v: int
    start: np.ndarray
    move: np.ndarray
    share: np.ndarray
    unseen: np.ndarray
    total: np.ndarray
    tilts: dict[int, np.ndarray] | None = None

    def weights(self, keys: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        """(word, state) from the words' counts and expected counts by state."""
        if self.tilts is None:
            return (c[:, None] + 1) * ((s + BACK_OFF * self.share) / (c[:, None] + BACK_OFF) + PRIOR / (self.n + self.v + 1))
        out = np.repeat((c[:, None] + 1.0) / (self.n + self.v + 1), STATES, axis=1)
        for key, tilt in self.tilts.items():
            out[keys == key] *= tilt
        return out


class InStep:
    """Texts (arrays of word numbers) side by side, the longest first: ``order[at[t] : at[t + 1]]`` are the t-th tokens of those that have one."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.rows = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.rows]
        starts = np.cumsum(sizes) - sizes
        self.live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        self.at = np.r_[0, np.cumsum(self.live)]
        flat = np.concatenate([sequences[k] for k in self.rows])
        self.order = np.empty(len(flat), np.int32)
        for t, n in enumerate(self.live):
            self.order[self.at[t] : self.at[t + 1]] = flat[starts[:n] + t]

    def forward(self, fit: Fit, emit: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """The scale of each token's step; kept takes the scaled messages."""
        move, start = fit.move.astype(emit.dtype), fit.start.astype(emit.dtype)
        scales, ones, alpha = np.empty(len(self.order), emit.dtype), np.ones(STATES, emit.dtype), None
        for t, n in enumerate(self.live):
            a, b = self.at[t], self.at[t + 1]
            alpha = (np.broadcast_to(start, (n, STATES)) if alpha is None else alpha[:n] @ move) * emit[self.order[a:b]]
            scales[a:b] = scale = alpha @ ones
            alpha /= scale[:, None]
            if kept is not None:
                kept[a:b] = alpha
        return scales

    def expected_counts(self, fit: Fit, emit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Baum-Welch counts (start, move, word by state) of the whole texts."""
        emit = emit.astype(np.float32)
        gamma = np.empty((len(self.order), STATES), np.float32)
        scales = self.forward(fit, emit, gamma)
        move, back, beta = np.zeros((STATES, STATES)), fit.move.T.astype(np.float32), np.ones((0, STATES), np.float32)
        for t in range(len(self.live) - 1, -1, -1):
            a, b, n = self.at[t], self.at[t + 1], self.live[t]
            ahead = np.ones((n, STATES), np.float32)
            ahead[: len(beta)] = beta
            gamma[a:b] *= ahead
            if t:
                ahead *= emit[self.order[a:b]] / scales[a:b, None]
                before = self.at[t - 1]
                move += gamma[before : before + n].T @ ahead
                beta = ahead @ back
        counts = np.stack([np.bincount(self.order, weights=gamma[:, s], minlength=len(emit)) for s in range(STATES)], axis=1)
        return gamma[: self.live[0]].sum(axis=0, dtype=np.float64), move * fit.move, counts

    def log_likelihoods(self, fit: Fit, emit: np.ndarray) -> np.ndarray:
        """log10 P of each text, in the order given."""
        logs, out = np.log10(self.forward(fit, emit)), np.zeros(len(self.rows))
        for t, n in enumerate(self.live):
            out[:n] += logs[self.at[t] : self.at[t + 1]]
        given = np.empty(len(out))
        given[self.rows] = out
        return given


def packed(numbers: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).astype(kind).tobytes(), 1)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, train) -> (b, doc_id, train, seq, words, counts): texts as numbers of their block's words; the block's first row has the words' hashes, with their counts in training texts, and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK_BYTES):
            numbers, train = Numbers(), batch.column(2).to_pylist()
            seqs = [np.fromiter(map(numbers.__getitem__, tokens(x)), np.uint32) for x in byte_column(batch, "text")]
            learnt = [x for x, t in zip(seqs, train, strict=True) if t]
            counts = np.bincount(np.concatenate(learnt), minlength=len(numbers)) if learnt else np.zeros(len(numbers))
            words, rest = np.fromiter(map(word_key, numbers), np.uint64, len(numbers)), [None] * (len(seqs) - 1)
            columns = [pa.array(np.full(len(seqs), b)), batch.column(0), batch.column(2), pa.array([packed(x, "<u4") for x in seqs], pa.binary())]
            columns += [pa.array([packed(words, "<u8"), *rest], pa.binary()), pa.array([packed(counts, "<u4"), *rest], pa.binary()), pa.array([len(words), *rest], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["b", "doc_id", "train", "seq", "words", "counts", "n_words"])
            b += 1

    schema = "b long, doc_id {}, train boolean, seq binary, words binary, counts binary, n_words long".format(rows.schema["doc_id"].dataType.simpleString())
    return bucketed(rows.select("doc_id", "text", "train").mapInArrow(run, schema), "blocks", "b")


def by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of a block's words by shard, and (shard, from, to) of each shard that has any."""
    h = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    cuts = np.r_[0, np.nonzero(np.diff(h[order]))[0] + 1, len(h)]
    return order, [(int(h[order[a]]), int(a), int(z)) for a, z in zip(cuts, cuts[1:], strict=False)]


def in_shards(blocked: DataFrame, shards: int) -> DataFrame:
    """(h, b, words, counts): each block's words, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, counts = unpacked(words, "<u8"), unpacked(counts, "<u4")
                order, parts = by_shard(words, shards)
                out = [(h, b, packed(words[order[a:z]], "<u8"), packed(counts[order[a:z]], "<u4")) for h, a, z in parts]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["h", "b", "words", "counts"])

    rows = blocked.filter("words is not null").select("b", "words", "counts").mapInArrow(run, "h long, b long, words binary, counts binary")
    return bucketed(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h"), "places", "h")


#: What a shard adds up, beside its words with their counts and expected counts by state; parameters are made from these.
SUMS = ["n", "v", "n_once", "leaning", *(f"{x}{s}" for x in ("mass", "once", "lean") for s in range(STATES)), *(f"step{k}" for k in range(STATES + STATES**2))]
STATE_TYPES = {"h": pa.int64(), **dict.fromkeys(("words", "c", "s"), pa.binary()), **dict.fromkeys(SUMS, pa.float64())}
STATE_SCHEMA = "h long, words binary, c binary, s binary, " + ", ".join(f"{x} double" for x in SUMS)


def added_up(places: pa.Table, parts: pa.Table | None = None) -> pa.Table:
    """A shard's row from its blocks' words and, if given, what the blocks send: expected counts, and those of starts and moves with one of a block's parts."""
    places = places.sort_by("b")
    words = [unpacked(x, "<u8") for x in places.column("words").to_pylist()]
    found, place = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(place, weights=np.concatenate([unpacked(x, "<u4") for x in places.column("counts").to_pylist()]), minlength=len(found))
    s, steps = np.zeros((len(found), STATES)), np.zeros(STATES + STATES**2)
    if parts is not None:
        parts = parts.sort_by("b")
        sent = dict(zip(parts.column("b").to_pylist(), parts.column("s").to_pylist(), strict=True))
        moved = np.concatenate([unpacked(sent[b], "<f4").reshape(-1, STATES) if b in sent else np.zeros((len(w), STATES), np.float32) for b, w in zip(places.column("b").to_pylist(), words, strict=True)])
        s = np.stack([np.bincount(place, weights=moved[:, k], minlength=len(found)) for k in range(STATES)], axis=1)
        steps = sum((np.frombuffer(x) for x in parts.column("steps").to_pylist() if x is not None), steps)
    known = c > 0
    found, c, s = found[known], c[known], s[known]
    once, part = c == 1, (c + 1) / (c + BACK_OFF)
    sums = [c.sum(), len(c), once.sum(), part.sum(), *s.sum(axis=0), *s[once].sum(axis=0), *(part @ s), *steps]
    row = [places.column("h")[0].as_py(), packed(found, "<u8"), packed(c, "<u8"), packed(s, "<f4"), *map(float, sums)]
    return pa.table({f: pa.array([x], t) for (f, t), x in zip(STATE_TYPES.items(), row, strict=True)})


def words_of_shard(state: pa.Table | pa.RecordBatch, row: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes in order, counts, expected counts by state)."""
    words, c, s = (unpacked(state.column(x)[row].as_py(), kind) for x, kind in (("words", "<u8"), ("c", "<u8"), ("s", "<f4")))
    return words, c.astype(np.float64), s.reshape(-1, STATES)


def emissions(places: DataFrame, state: DataFrame, fit: Fit, counts: bool = False) -> DataFrame:
    """(b, h, e, c): for each block and shard the weights of its words there, with their training counts if asked for."""

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        keys, c, s = words_of_shard(state)
        weights, often, e, n = np.vstack([fit.weights(keys, c, s), fit.unseen]), np.r_[c, 0], [], []
        for x in rows.column("words").to_pylist():
            words = unpacked(x, "<u8")
            place = np.searchsorted(keys, words)
            place[np.r_[keys, np.uint64(0)][place] != words] = len(keys)
            e.append(packed(weights[place], "<f4"))
            n.append(packed(often[place], "<u8") if counts else None)
        return pa.table({"b": rows.column("b"), "h": rows.column("h"), "e": pa.array(e, pa.binary()), "c": pa.array(n, pa.binary())})

    return places.select("h", "b", "words").groupBy("h").cogroup(state.select("h", "words", "c", "s").groupBy("h")).applyInArrow(run, "b long, h long, e binary, c binary")


def as_sent(words: np.ndarray, sent: pa.ChunkedArray, kind: str, shards: int) -> np.ndarray:
    """What the shards, in their order, sent of a block's words, in the words' order."""
    values = np.concatenate([unpacked(x, kind) for x in sent.to_pylist()])
    values = values.reshape(len(words), -1)
    out = np.empty_like(values)
    out[by_shard(words, shards)[0]] = values
    return out


def expected(blocked: DataFrame, sent: DataFrame, fit: Fit, shards: int) -> DataFrame:
    """(h, b, s, steps): each block's expected counts by shard; one row of a block has those of its starts and moves."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        out, b = [], rows.column("b")[0].as_py()
        words = unpacked(rows.column("words").drop_null()[0].as_py(), "<u8")
        seqs = [unpacked(x, "<u4").astype(np.int32) for x in rows.column("seq").drop_null().to_pylist()]
        if seqs:
            emit = as_sent(words, sent.sort_by("h").column("e"), "<f4", shards) / fit.total
            start, move, counts = InStep(seqs).expected_counts(fit, emit)
            order, parts = by_shard(words, shards)
            steps = {b % len(parts): np.r_[start, move.ravel()].astype("<f8").tobytes()}
            out = [(h, b, packed(counts[order[a:z]], "<f4"), steps.get(k)) for k, (h, a, z) in enumerate(parts)]
        return pa.table({f: pa.array([x[k] for x in out], t) for k, (f, t) in enumerate((("h", pa.int64()), ("b", pa.int64()), ("s", pa.binary()), ("steps", pa.binary())))})

    texts = blocked.filter("train or words is not null").select("b", F.when(F.col("train"), F.col("seq")).alias("seq"), "words")
    return texts.groupBy("b").cogroup(sent.select("b", "h", "e").groupBy("b")).applyInArrow(run, "h long, b long, s binary, steps binary")


def uniform_moves(k: int = STATES) -> np.ndarray:
    return np.full((k, k), 0.02 / (k - 1)) + np.eye(k) * (0.98 - 0.02 / (k - 1)) if k > 1 else np.ones((1, 1))


def summed(state: DataFrame) -> dict[str, float]:
    return {k: x or 0.0 for k, x in state.agg(*(F.sum(x).alias(x) for x in SUMS)).first().asDict().items()}


def first_guess(state: DataFrame) -> Fit:
    """States that differ by chance in their frequent words only (at most 1 / TILTED_SHARE of them); others follow their neighbours."""
    sums, k = summed(state), STATES
    n, v = int(sums["n"]), int(sums["v"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, c, _ = words_of_shard(batch, row)
                often = (c + 1) / (n + v + 1) >= TILTED_SHARE
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(c[often])], ["w", "c"])

    often = sorted((r["w"], r["c"]) for r in state.select("h", "words", "c", "s").mapInArrow(frequent, "w long, c double").collect())
    tilts = np.random.default_rng(7).gamma(0.5, 2.0, (k, len(often))).T
    total = np.full(k, 1.0) + sum(((c + 1) / (n + v + 1) * (x - 1) for (_, c), x in zip(often, tilts, strict=True)), np.zeros(k))
    return Fit(n, v, np.full(k, 1 / k), uniform_moves(), np.full(k, 1 / k), np.full(k, 1 / (n + v + 1)), total, {w % (1 << 64): x for (w, _), x in zip(often, tilts, strict=True)})


def refitted(fit: Fit, sums: dict[str, float]) -> Fit:
    """Parameters from what the shards have added up."""
    mass, once, lean = (np.array([sums[f"{x}{s}"] for s in range(STATES)]) for x in ("mass", "once", "lean"))
    steps = np.array([sums[f"step{k}"] for k in range(STATES + STATES**2)]) + 1
    start, move = steps[:STATES], steps[STATES:].reshape(STATES, STATES)
    share, u = mass / mass.sum(), PRIOR / (fit.n + fit.v + 1)
    unseen = (once + BACK_OFF * share) / (sums["n_once"] + BACK_OFF) + u
    total = lean + BACK_OFF * share * sums["leaning"] + u * (fit.n + fit.v) + unseen
    return Fit(fit.n, fit.v, start / start.sum(), move / move.sum(axis=1, keepdims=True), share, unseen, total)


def baum_welch(blocked: DataFrame, places: DataFrame, shards: int, rounds: int = ROUNDS) -> tuple[Fit, DataFrame]:
    """Rounds over all training text -> the fit and the shards' words with their expected counts."""
    state = bucketed(places.groupBy("h").applyInArrow(lambda rows: added_up(rows), STATE_SCHEMA), "state", "h")
    fit = first_guess(state)
    for _ in range(rounds if fit.n else 0):
        parts = expected(blocked, emissions(places, state, fit), fit, shards)
        after = bucketed(places.groupBy("h").cogroup(parts.groupBy("h")).applyInArrow(added_up, STATE_SCHEMA), "state", "h")
        discard(state)
        state, fit = after, refitted(fit, summed(after))
        del parts, after
        forget(state)
    return fit, state


def scored(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("train", fold("doc_id") != held_out)
    blocked = in_blocks(rows)
    shards = 1 + (blocked.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS
    places = in_shards(blocked, shards)
    forget(places)
    fit, state = baum_welch(blocked, places, shards, rounds)
    names = ["doc_id", "n_tokens", "n_known", "base", "score"]

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        words, sent = unpacked(rows.column("words").drop_null()[0].as_py(), "<u8"), sent.sort_by("h")
        seqs = [unpacked(x, "<u4").astype(np.int32) for x in rows.column("seq").to_pylist()]
        emit, c = as_sent(words, sent.column("e"), "<f4", shards) / fit.total, as_sent(words, sent.column("c"), "<u8", shards)[:, 0]
        logs = np.log10(c + 1.0)
        columns = [rows.column("doc_id"), pa.array([len(x) for x in seqs], pa.int64()), pa.array([int((c[x] > 0).sum()) for x in seqs], pa.int64()), pa.array([float(logs[x].sum()) for x in seqs]), pa.array(InStep(seqs).log_likelihoods(fit, emit))]
        return pa.table(dict(zip(names, columns, strict=True)))

    schema = "doc_id {}, n_tokens long, n_known long, base double, score double".format(rows.schema["doc_id"].dataType.simpleString())
    out = blocked.select("b", "doc_id", "seq", "words").groupBy("b").cogroup(emissions(places, state, fit, counts=True).groupBy("b")).applyInArrow(run, schema)
    return out.select(
        "doc_id",
        (fold("doc_id") == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(fit.n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(fit.n + fit.v + 1)))).alias("base_score"),
        "score",
    )
