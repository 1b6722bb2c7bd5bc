"""BPE encoding and decoding with a pair occurrence index.

A text is cut into pieces by the tokenizer file's own normaliser and pre-tokeniser. The new pieces
of a block of texts are laid out in one sequence of symbols with links to their neighbours, and each
adjacent pair that has a rank is indexed with all its positions. Active ranks are applied in
ascending order, each at all its positions from left to right, and the lists of the pairs that a
merge makes are updated; where a new pair has a lower rank it goes first. Encoded words and pieces
are kept for later blocks as packed numbers, twice ``CACHE_WORDS`` of each at most.

Special tokens in a text are found before normalising. Decoding joins tokens with a space, as the
tokenizers library does for a file that names no decoder.

Defined cases: a null text is the empty text (no ids, empty decoded text); a null id is kept;
repeated rows are encoded each; other columns are kept, but for those named like the new ones; an
empty table gives no rows.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import blocks, byte_column, made

#: Words, and pieces, of one generation that a worker keeps.
CACHE_WORDS = 150_000
BLOCK_BYTES = 1 << 20
#: Stands between words that are cut together: a private character, which normalising leaves alone.
MARK = "\ue000"
pack = struct.Struct("=i").pack
NEW = ("ids", "decoded", "n_tokens")


#: Characters that regular expression libraries don't agree on as white space.
_ODD_SPACE = re.compile("[\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ue000\ufeff]").search


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes are themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairIndex:
    """The positions of each ranked pair in a sequence of symbols. Pieces stand between symbols of -1, which no pair has."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks, self.symbols, self.ends = ranks, [-1], [0]

    def add(self, symbols: list[int]) -> tuple[int, int]:
        """Appends a piece; returns where it starts and ends."""
        first = len(self.symbols)
        self.symbols += symbols
        self.ends.append(len(self.symbols))
        self.symbols.append(-1)
        return first, self.ends[-1]

    def places(self) -> dict[int, list[int]]:
        """The positions of each rank, ascending ones, in ascending order of ranks."""
        found = map(self.ranks.get, pairwise(self.symbols), repeat((-1, -1)))
        rank = np.fromiter(map(itemgetter(0), found), np.int64, len(self.symbols) - 1)
        at = np.nonzero(rank >= 0)[0]
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, starts = np.unique(rank[at], return_index=True)
        at = at.tolist()
        return {r: at[a:b] for r, (a, b) in zip(ranks.tolist(), pairwise([*starts.tolist(), len(at)]), strict=True)}

    def apply(self) -> None:
        symbols, places, get, n = self.symbols, self.places(), self.ranks.get, len(self.symbols)
        before, after, active = list(range(-1, n - 1)), list(range(1, n + 1)), list(places)  # sorted, so a heap
        while active:
            rank = heapq.heappop(active)
            own = places.pop(rank)
            if len(own) > 1:
                own.sort()
            for k, i in enumerate(own):
                j = after[i]
                if (found := get((symbols[i], symbols[j]))) is None or found[0] != rank:
                    continue  # an earlier merge took one of the two
                merged = symbols[i] = found[1]
                symbols[j] = -1
                after[i] = n = after[j]
                before[n] = i
                lower = False
                if (new := get((merged, symbols[n]))) is not None:
                    if (r := new[0]) in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
                        heapq.heappush(active, r)
                    lower = r < rank
                p = before[i]
                if (new := get((symbols[p], merged))) is not None:
                    if (r := new[0]) in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
                        heapq.heappush(active, r)
                    lower |= r < rank
                if lower and k + 1 < len(own):  # the lower rank goes first, the rest of this list after it
                    if rank in places:
                        places[rank] += own[k + 1 :]
                    else:
                        places[rank] = own[k + 1 :]
                        heapq.heappush(active, rank)
                    break

    def piece(self, first: int, end: int) -> tuple[int, ...]:
        return tuple([s for s in self.symbols[first:end] if s >= 0])

    def packed(self) -> list[bytes]:
        """What is left of each piece, as packed 32-bit numbers."""
        symbols = np.array(self.symbols, np.int32)
        keep = symbols >= 0
        left = (np.r_[0, np.cumsum(keep)][self.ends] * 4).tolist()
        whole = symbols[keep].tobytes()
        return [whole[a:b] for a, b in pairwise(left)]


class Kept(dict):
    """Word or piece -> ids as packed 32-bit numbers, in two generations: what a full generation's time didn't use goes."""

    def __init__(self, most: int = CACHE_WORDS):
        super().__init__()
        self.most, self.older = most, {}

    def known(self, keys: Iterable) -> list:
        """The keys that aren't here; those of the older generation are moved to the younger."""
        missing, older = [], self.older
        for k in keys:
            if k not in self:
                if (found := older.get(k)) is None:
                    missing.append(k)
                else:
                    self[k] = found
        return missing

    def age(self) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


class Encoder:
    """A tokenizer file's BPE model; words are cut at ASCII white space, which the file's pieces must not hold."""

    def __init__(self, file: str):
        data = json.loads(file)
        model = data["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or data.get("decoder"):
            raise ValueError("this encoder is for BPE files without dropout, byte fallback, unknown token and decoder")
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocabulary = {x: i for x, i in vocabulary.items() if len(x) == 1}
        self.last = {x[0]: i for x, i in vocabulary.items() if len(x) == 1 + len(suffix) and x.endswith(suffix)}
        self.ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.plain = all(t.startswith("<") for t in special)
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in special.items()}
        self.names = pa.array([names.get(i) for i in range(max(names, default=-1) + 1)], pa.string())
        # the library cuts texts; its vocabulary isn't needed for that
        self.library = Tokenizer.from_str(json.dumps(data | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "truncation": None, "padding": None}))
        self.letters = byte_letters()
        self.from_bytes = dict(enumerate(self.letters))
        pattern = self._pattern(data)
        self.pattern = regex.compile("\n|" + pattern) if pattern else None
        if any(" " in p or "\u0120" in p for x in ("a b", "a  b", " a") for p in self.cut_text(x)):
            raise ValueError("this encoder is for files whose pieces hold no white space")
        self.words, self.pieces = Kept(), Kept()

    @staticmethod
    def _pattern(data: dict) -> str | None:
        """The pattern of a file that normalises to NFC and lower case, and takes what a pattern matches as bytes."""
        try:
            steps, (split, level) = [x["type"] for x in data["normalizer"]["normalizers"]], data["pre_tokenizer"]["pretokenizers"]
            plain = steps == ["NFC", "Replace", "Lowercase"] and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True) and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            return split["pattern"]["Regex"] if plain else None
        except (KeyError, TypeError, ValueError):
            return None

    def symbols(self, piece: str) -> list[int]:
        found = [*map(self.vocabulary.get, piece[:-1]), self.last.get(piece[-1])]
        return [i for i in found if i is not None] if None in found else found

    def cut_text(self, text: str) -> list[str]:
        """Pieces of one text by the library, in the alphabet of the vocabulary."""
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.library.pre_tokenizer else [text]

    def cut_many(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word by the file's own pattern, all words in one go; they hold no white space and no MARK."""
        if not words:
            return []
        joined = MARK.join(words)
        joined = joined.lower() if joined.isascii() else self.library.normalizer.normalize_str(joined)
        out: list[list[str]] = [[]]
        for p in self.pattern.findall(joined.replace(MARK, "\n")):
            if p == "\n":
                out.append([])
            else:
                out[-1].append(p if p.isascii() else p.encode().decode("latin-1").translate(self.from_bytes))
        return out

    def cut_word(self, word: str) -> list[str | int]:
        """Pieces, and ids of special tokens."""
        out: list[str | int] = []
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.cut_text(part)
        return out

    def cut_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[str | int]]]:
        texts, special = b"\n".join(words).decode().split("\n"), "<" if self.plain else ""
        simple: tuple[list[int], list[int]] = [], []
        for k, text in enumerate(texts if words else ()):
            if not self.pattern or self.cut and special in text or not text.isascii() and _ODD_SPACE(text) or not text.isprintable():
                yield words[k], self.cut_word(text)
            else:
                simple[text.isascii()].append(k)
        for some in simple:
            yield from zip([words[k] for k in some], self.cut_many([texts[k] for k in some]), strict=True)

    def learn(self, words: list[bytes]) -> None:
        """Encodes new words, their new pieces all in one index."""
        known, pieces = self.words, self.pieces
        cut = list(self.cut_words(words))
        new = pieces.known(dict.fromkeys(p for _, parts in cut for p in parts if isinstance(p, str)))
        index = PairIndex(self.ranks)
        for p in new:
            index.add(self.symbols(p))
        index.apply()
        pieces.update(zip(new, index.packed(), strict=True))
        for w, parts in cut:
            known[w] = pieces[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else b"".join([pack(p) if isinstance(p, int) else pieces[p] for p in parts])
        pieces.age()

    def ids_of(self, texts: list[bytes]) -> pa.ListArray:
        """The ids of each text."""
        split = [t.split() for t in texts]
        # millions of lists and tuples are made here, and no cycles
        was = gc.isenabled()
        gc.disable()
        try:
            self.learn(self.words.known(set(chain.from_iterable(split))))
        finally:
            if was:
                gc.enable()
        get = self.words.__getitem__
        packed = [b"".join(map(get, words)) for words in split]
        self.words.age()
        ends = np.cumsum([0, *map(len, packed)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def texts_of(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        return pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return self.ids_of(texts).to_pylist()

    def decode(self, ids: list[int]) -> str:
        return self.texts_of(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_encoders: dict[int, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """One encoder for each file and worker process."""
    if (key := hash(file)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(file)
    return _encoders[key]


def encoded(df: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """The rows with ids array<int>, decoded and n_tokens. tokenizer: the path of a tokenizers file, read by the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    own = [F.col(f"`{c}`") for c in df.columns if c not in NEW]
    rows = df.select(F.struct(*own).alias("own"), F.col(text_column).cast("string").alias("text"))
    schema = made(rows, ids="array<int>", decoded="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids = encoder.ids_of(byte_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, encoder.texts_of(ids)], schema.names)

    return rows.mapInArrow(run, schema).select("own.*", "ids", "decoded", F.size("ids").cast("long").alias("n_tokens"))
