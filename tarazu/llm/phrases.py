"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. A word is removed if a window that covers
it also starts, word for word, in a document with a smaller id. Windows are judged on the input.

1. Phrases: in each window the ``PHRASE``-word phrase of least hash is selected (of equal ones the
   last), so equal windows select equal phrases, some 6 % of positions. A phrase that documents of
   different ids selected is confirmed as recurring.
2. Automata: documents are dealt by a hash into shards of about ``SHARD_BYTES`` of text. Each shard
   compiles the recurring phrases of its documents, as words spelt in digits, into one Aho-Corasick
   automaton, and every document of the shard is streamed through it. Its hits are the places where
   phrases recur; nothing else is looked at from here on.
3. Exact check: the windows that selected a located phrase form a span. Spans are compared whole
   (two hashes and the length); where a phrase has different spans, their windows are compared one
   by one. Hashes of ranges are made of 64-bit hashes of words, so different ranges agree where
   words clash (at 10^9 words, some 3 % of vocabularies have one pair) or, by chance, in 2^-128.

Work grows with the text: no list of a phrase's documents is built, hot phrases are pre-aggregated
by shard and by span, and an automaton never holds more than its shard's own phrases.

Defined cases: a null text has no words; a null doc_id comes after all others; rows with the same
doc_id never remove each other's words; other columns are kept as they are; an empty table gives no
rows; a text of any length is a shard of its own at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks, by_block, byte_column, keyed_rows, made, materialize, read_blocks

WINDOW, PHRASE = 50, 16
SHARD_BYTES = 8 << 20
#: Multipliers of the two rolling hashes, odd and 3 modulo 8, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
POSITION_BITS = np.uint64(26)
CACHE_WORDS = 400_000
#: The automaton's alphabet: a node has at most 2^DIGIT_BITS children, however many words there are.
DIGIT_BITS = 6


class Words(dict):
    """Word -> hash; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Word -> small number in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Rolling:
    """Hashes of word ranges of one document, by prefix sums modulo 2^64."""

    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if not Rolling._powers or len(Rolling._powers[0][0]) < n:
            size, Rolling._powers = max(n, 4096), []
            for b, inverse in zip(BASES, INVERSES, strict=True):
                powers = [np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(x))]) for x in (b, inverse)]
                Rolling._powers.append((powers[0], powers[1]))
        self.sums = [np.r_[np.uint64(0), np.cumsum(h * p[:n])] for h, (p, _) in zip((hashes, mixed(hashes)), Rolling._powers, strict=True)]

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mixed((s[ends] - s[starts]) * Rolling._powers[which][1][starts])

    def windows(self, size: int, which: int) -> np.ndarray:
        s = self.sums[which]
        n = len(s) - size
        return mixed((s[size:] - s[:n]) * Rolling._powers[which][1][:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, values
    while done * 2 <= width:
        out, done = np.minimum(out[:-done], out[done:]), done * 2
    return out if done == width else np.minimum(out[: len(values) - width + 1], out[width - done :])


def selections(rolling: Rolling, n_words: int, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
    """(hash, position, first window, last window) of each selected phrase."""
    grams = rolling.windows(phrase, 0)
    mask = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    ranked = (grams & ~mask) | (mask - (np.arange(len(grams), dtype=np.uint64) & mask))
    least = sliding_min(ranked, window - phrase + 1)
    first = np.nonzero(np.r_[True, least[1:] != least[:-1]])[0]
    last = np.r_[first[1:], len(least)] - 1
    at = mask - (least[first] & mask)
    position = first + ((at - (first.astype(np.uint64) & mask)) & mask).astype(np.int64)
    return grams[position], position, first, last


def hashed(words: list[bytes], cache: Words) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _rows(columns: list[tuple[str, list[np.ndarray]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)) for _, parts in columns], [name for name, _ in columns])


def selected_phrases(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    """keyed(b, _id, _h, text) -> (p, at, b, _id, _h): the phrases that each document's windows select, each once."""
    names = ["p", "at", "b", "_id", "_h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in blocks(batches, "text"):
            found, at, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, text in enumerate(byte_column(batch, "text")):
                words = text.split()
                if len(words) >= window:
                    p, position, *_ = selections(Rolling(hashed(words, cache)), len(words), window, phrase)
                    p, first = np.unique(p, return_index=True)
                    found.append(p)
                    at.append(position[first])
                    rows.append(np.full(len(p), k))
            place = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), *(batch.column(c).take(place) for c in range(3))], names)

    return keyed.select("b", "_id", "_h", "text").mapInArrow(run, "p long, at int, b long, _id long, _h long")


class Spelling:
    """Word numbers as strings of digits, one string a word and all of one length; words that no phrase has are spelt alike.

    The automaton looks for a node's child one by one, and over whole words its root has a child for each
    word that begins a phrase. Each place of a digit has symbols of its own, so matches begin and end with words.
    """

    def __init__(self, phrases: np.ndarray, n_words: int):
        used = np.unique(phrases)
        self.digits = max(1, -(-(len(used) - 1).bit_length() // DIGIT_BITS))
        self.symbols = np.zeros((n_words, self.digits), "<u2")
        for d in range(self.digits):
            self.symbols[used, d] = 1 + (d << DIGIT_BITS) + (np.arange(len(used)) >> d * DIGIT_BITS) % (1 << DIGIT_BITS)

    def of(self, words: np.ndarray) -> str:
        return self.symbols[words].tobytes().decode("utf-16-le")


def compiled(phrases: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, spelt in enumerate(phrases):
        automaton.add_word(spelt, k)
    if phrases:
        automaton.make_automaton()
    return automaton


def spans_in_shard(texts: list[bytes], holders: list[tuple[int, int]], window: int, phrase: int, build=compiled) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """holders: a text and a position of each recurring phrase. Yields (text, (p, s1, s2, n, at)) where the automaton has hits: n windows from word at selected p."""
    if not holders:
        return
    numbers = Numbers()
    coded = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in map(bytes.split, texts)]
    held = np.array([coded[k][at : at + phrase] for k, at in holders])
    spelling = Spelling(held, len(numbers))
    automaton = build([spelling.of(words) for words in held])
    if not len(automaton):
        return
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    for k, sequence in enumerate(coded):
        if len(sequence) < window:
            continue
        ends = [end for end, _ in automaton.iter(spelling.of(sequence))]
        if not ends:
            continue
        rolling = Rolling(hashes[sequence])
        p, position, first, last = selections(rolling, len(sequence), window, phrase)
        keep = np.isin(position, np.array(ends, np.int64) // spelling.digits - (phrase - 1))
        if keep.any():
            p, first, last = p[keep], first[keep], last[keep]
            yield k, (p.view(np.int64), rolling.of(first, last + window, 0).view(np.int64), rolling.of(first, last + window, 1).view(np.int64), last - first + 1, first)


def located_spans(keyed: DataFrame, lists: DataFrame, window: int, phrase: int) -> DataFrame:
    """keyed(b, _id, _h, text), lists(b, own array<struct<_id, _h, at>>) -> the spans of located phrases: (p, s1, s2, n, at, _id, _h)."""
    names = ["p", "s1", "s2", "n", "at", "_id", "_h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, rows in read_blocks(batches):
            keys = list(zip(rows.column("_id").to_pylist(), rows.column("_h").to_pylist(), strict=True))
            row_of = {key: k for k, key in reversed(list(enumerate(keys)))}
            texts = [x or b"" for x in rows.column("text").cast(pa.large_binary()).to_pylist()]
            holders = [(row_of[i, h], at) for i, h, at in zip(*(x.to_pylist() for x in own.flatten()), strict=True)] if own else []
            found = list(spans_in_shard(texts, holders, window, phrase))
            if found:
                ids = [np.concatenate([np.full(len(x[0]), keys[k][c], np.int64) for k, x in found]) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([x[c] for _, x in found])) for c in range(5)), *map(pa.array, ids)], names)

    return by_block(keyed, lists).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def single_windows(ranged: DataFrame, window: int) -> DataFrame:
    """ranged(_id, _h, text, ranges) -> (w1, w2, _id, _h, at) for each window of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in blocks(batches, "text", 2 << 20):
            names = ["w1", "w2", "_id", "_h", "at"]
            out: list[list[np.ndarray]] = [[] for _ in names]
            for row, text in enumerate(byte_column(batch, "text")):
                rolling = Rolling(hashed(text.split(), cache))
                ranges = batch.column(3)[row].values
                starts = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(ranges.field(0).to_pylist(), ranges.field(1).to_pylist(), strict=True)]))
                for k, x in enumerate((rolling.of(starts, starts + window, 0), rolling.of(starts, starts + window, 1), np.full(len(starts), batch.column(0)[row].as_py(), np.int64), np.full(len(starts), batch.column(1)[row].as_py(), np.int64), starts)):
                    out[k].append(x)
            yield _rows(list(zip(names, out, strict=True)))

    return ranged.select("_id", "_h", "text", "ranges").mapInArrow(run, "w1 long, w2 long, _id long, _h long, at long")


def removals(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(_id, _h, ranges array<struct<at long, n long>>): n windows from word at are removed."""
    keyed = keyed_rows(df.select(id_column, text_column), id_column, text_column, ()).select("_id", "_h", "text")
    shards = 1 + (keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES
    keyed = keyed.select(F.expr(f"pmod(xxhash64(_id, _h), {shards})").alias("b"), "_id", "_h", "text")
    chosen = materialize(selected_phrases(keyed, window, phrase), "phrases")
    recurring = chosen.groupBy("p").agg(F.min("_id").alias("a"), F.max("_id").alias("z")).filter("a < z").select("p")
    heads = chosen.groupBy("b", "p").agg(F.min(F.struct("_id", "_h", "at")).alias("head"))
    lists = heads.join(recurring, "p").groupBy("b").agg(F.collect_list("head").alias("own"))
    spans = materialize(located_spans(keyed, lists, window, phrase), "spans")
    span = ["p", "s1", "s2", "n"]
    # written, so that both sides of each join are plain tables and skewed ones can be split
    least = materialize(spans.groupBy(*span).agg(F.min("_id").alias("least")), "least")
    several = materialize(least.groupBy("p").agg(F.count("*").alias("spans")).filter("spans > 1"), "several")
    marked = spans.join(least, span).join(several, "p", "left").filter("_id > least or spans is not null")
    marked = materialize(marked.select("_id", "_h", "at", "n", (F.col("_id") > F.col("least")).alias("whole")), "marked")
    ranges = lambda d: d.groupBy("_id", "_h").agg(F.collect_set(F.struct("at", "n")).alias("ranges"))
    open_ranges = ranges(marked.filter("not whole"))
    single = materialize(single_windows(keyed.join(open_ranges, ["_id", "_h"]), window), "windows")
    earlier = single.groupBy("w1", "w2").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).filter("least < most").select("w1", "w2", "least")
    removed = single.join(earlier, ["w1", "w2"]).filter("_id > least").select("_id", "_h", "at", F.lit(1).cast("long").alias("n"))
    return ranges(marked.filter("whole").select("_id", "_h", "at", "n").unionByName(removed))


def without_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The rows with kept_text (words joined by one space), n_words and n_removed, and all their own columns but the text."""
    found = removals(df, id_column, text_column, window, phrase)
    rows = keyed_rows(df, id_column, text_column, ("kept_text", "n_words", "n_removed")).join(found, ["_id", "_h"], "left").select("own", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            n_words, n_removed, kept = [], [], []
            ranges = batch.column(2)
            for row, text in enumerate(byte_column(batch, "text")):
                words = text.split()
                n_words.append(len(words))
                if not ranges[row].is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                values = ranges[row].values
                steps = np.zeros(len(words) + 1, np.int64)
                at, n = (values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                np.add.at(steps, at, 1)
                np.add.at(steps, at + n + (window - 1), -1)
                gone = np.cumsum(steps[:-1]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["own", "kept_text", "n_words", "n_removed"])

    return rows.mapInArrow(run, made(rows, kept_text="string", n_words="long", n_removed="long")).select("own.*", "kept_text", "n_words", "n_removed")
