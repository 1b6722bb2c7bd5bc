"""Toxicity by positive-unlabelled learning with a non-negative risk.

Positives are texts labelled toxic; unlabelled texts are those of all documents whose labels may be
learnt from, whatever these labels say. With the class prior p, the risk of a score function is
p * R+(positives as 1) + max(0, R-(unlabelled as 0) - p * R-(positives as 0)): the second part can't
be negative for a true risk, so where a step makes it so, that step climbs instead of fitting it
further. The prior is the share of toxic rows among the labels that may be learnt from.

A text's features are its words in lower case (runs of letters), whole and as stems, their first
``STEMS`` letters; whether it has one once, twice, and ``LEVELS`` times or more. A model is a logistic classifier in numpy over the
``FEATURES`` that positives have most beyond chance. ``MODELS`` of them are trained, a task
each, on at most about ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` distinct texts drawn by hash for
each (all, where there are fewer); their mean is the score of every whole text of the table.

Defined cases: a null text is the empty text, which has no features and the score of none; a null id
is 'held out' by neither rule (its crc32 is null), and has no label; rows that repeat are scored each
and learnt from once; of several labels of an id any toxic one counts; without a toxic label to learn
from every score is 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_column

STEMS = range(3, 9)
FEATURES, MODELS, MOST_POSITIVE, MOST_UNLABELLED = 2048, 4, 1500, 4500
STEPS, RATE, DECAY, LEAST_TEXTS, LEAST_GAIN = 400, 0.05, 1e-4, 3, 5.0
HELD_OUT, OF, TOXIC_FROM = 1, 3, 0.7
LETTERS = re.compile(r"[^\W\d_]+")
LEVELS = 3
CACHED = 200_000
#: Weights by feature and level, and the bias.
Model = tuple[dict[tuple[str, int], float], float]


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % OF == HELD_OUT, F.lit(False))


def features_of(word: str) -> list[str]:
    """A word whole, marked by its end, and its stems."""
    return [word + "$", *(word[:k] for k in STEMS if k <= len(word))]


def finder(bases: set[str]) -> Callable[[str], list[str]]:
    """features_of(), of the given ones only. All features of a word begin alike, which most words tell at once."""
    heads = {f[: STEMS.start] for f in bases}
    return lambda w: [f for f in features_of(w) if f in bases] if f"{w[: STEMS.start]}$"[: STEMS.start] in heads else []


def words_in(text: bytes) -> dict[str, int]:
    return Counter(LETTERS.findall(text.decode().lower()))


def leveled(words: Iterable[tuple[str, int]], known: Callable[[str], Iterable[Hashable]]) -> Iterator[tuple[Hashable, int]]:
    """(feature, level) of a text, by what known() makes of a word."""
    counts: dict[Hashable, int] = {}
    for w, n in words:
        for f in known(w):
            counts[f] = counts.get(f, 0) + n
    return ((f, k) for f, n in counts.items() for k in range(min(n, LEVELS)))


def chosen(positive: list[list[tuple[str, int]]], unlabelled: list[list[tuple[str, int]]], k: int = FEATURES) -> dict[tuple[str, int], int]:
    """The features that positives have beyond chance: by how many standard deviations, from LEAST_GAIN on; ties by name."""
    ours, others = (Counter(f for words in texts for f in leveled(words, features_of)) for texts in (positive, unlabelled))
    share = {f: (others.get(f, 0) + 0.5) / (len(unlabelled) + 1) for f, n in ours.items() if n >= LEAST_TEXTS}
    gain = {f: (ours[f] - len(positive) * q) / (len(positive) * q * (1 - q)) ** 0.5 for f, q in share.items()}
    names = sorted((f for f, g in gain.items() if g >= LEAST_GAIN), key=lambda f: (-gain[f], f))[:k]
    return {f: j for j, f in enumerate(names)}


@dataclass
class Marks:
    """Which texts have which features, as pairs of places; the last column is of ones."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        """A score for each text."""
        return np.bincount(self.row, weights=w[self.column], minlength=self.shape[0]) + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        """A sum of the texts' values for each weight."""
        out = np.bincount(self.column, weights=v[self.row], minlength=self.shape[1])
        out[-1] += v.sum()
        return out


def design(texts: list[list[tuple[str, int]]], names: dict[tuple[str, int], int]) -> Marks:
    known = cache(finder({f for f, _ in names}))
    found = [[names[f] for f in leveled(words, known) if f in names] for words in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    return Marks(row, np.array([j for x in found for j in x], np.int64), (len(texts), len(names) + 1))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def non_negative_fit(positive: Marks, unlabelled: Marks, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights, the bias last, by Adam on the non-negative risk with the logistic loss."""
    w = np.zeros(positive.shape[1])
    w[-1] = logit(prior)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = positive.times(w), unlabelled.times(w)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = unlabelled.back(sigmoid(zu)) / len(zu) - prior * positive.back(sigmoid(zp)) / len(zp)
        of_positive = -prior * positive.back(sigmoid(-zp)) / len(zp)
        slope = of_positive + of_negative if negative_risk >= 0 else -of_negative
        slope[:-1] += DECAY * w[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def training_texts(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int, models: int) -> tuple[DataFrame, float]:
    """(h, toxic, words, times, model) to learn from, and the prior."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    n_unlabelled = docs.filter(~held_out("doc_id")).count()
    rows = docs.filter(~held_out("doc_id")).filter("doc_id is not null").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    # shares by a hash of the text, so copies are drawn together and learnt from once
    shares = {1: min(1.0, most_positive / max(1, n_toxic or 0)), 0: min(1.0, most_unlabelled / max(1, n_unlabelled))}
    drawn = lambda kind: F.array_compact(F.array(*(F.when(F.pmod(F.xxhash64("h", F.lit(m), F.lit(kind)), F.lit(1 << 30)) < int(shares[kind] * (1 << 30)), m) for m in range(models))))
    unlabelled = rows.select("h", "text", F.lit(0).alias("toxic"), drawn(0).alias("models"))
    positive = rows.join(known.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("h", "text", F.lit(1).alias("toxic"), drawn(1).alias("models"))
    texts = unlabelled.unionByName(positive).filter("size(models) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [words_in(t) for t in byte_column(b, "text")]
            words, times = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), words, times, b.column(2), b.column(3)], ["h", "words", "times", "toxic", "models"])

    found = texts.mapInArrow(run, "h long, words array<string>, times array<int>, toxic int, models array<int>").dropDuplicates(["h", "toxic"])
    return found.select("h", "toxic", "words", "times", F.explode("models").alias("model")), (n_toxic or 0) / max(1, n_known)


def trained(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, models: int = MODELS) -> list[Model]:
    """The models; none where there is nothing to learn from. A model has FEATURES weights at most."""
    texts, prior = training_texts(docs, labels, most_positive, most_unlabelled, models)
    if not 0 < prior < 1:
        return []

    def fit(group: pa.Table) -> pa.Table:
        toxic, h, *texts = (group.column(c).to_pylist() for c in ("toxic", "h", "words", "times"))
        words = [list(zip(w, n, strict=True)) for w, n in zip(*texts, strict=True)]
        order = np.lexsort((h, toxic)).tolist()
        positive, unlabelled = ([words[i] for i in order if toxic[i] == y] for y in (1, 0))
        names = chosen(positive, unlabelled) if positive and unlabelled else {}
        w = non_negative_fit(design(positive, names), design(unlabelled, names), prior) if names else [logit(prior)]
        features, levels = zip(*names, strict=True) if names else ([], [])
        return pa.table({"names": pa.array([features], pa.list_(pa.string())), "levels": pa.array([levels], pa.list_(pa.int32())), "weights": pa.array([list(w)], pa.list_(pa.float64()))})

    found = texts.groupBy("model").applyInArrow(fit, "names array<string>, levels array<int>, weights array<double>").collect()
    return [({(f, k): w for f, k, w in zip(r["names"], r["levels"], r["weights"], strict=False)}, r["weights"][-1]) for r in sorted(found)]


def scorer(models: list[Model]) -> Callable[[bytes], float]:
    """The mean of the models' probabilities, by the features of a text that any model has."""
    number = {f: j for j, f in enumerate(sorted({f for weights, _ in models for f in weights}))}
    bases = {f for f, _ in number}
    table = np.array([[weights.get(f, 0.0) for f in number] for weights, _ in models]).reshape(len(models), len(number))
    bias = np.array([b for _, b in models])
    find, held = finder(bases), {}

    def score(text: bytes) -> float:
        counts: dict[str, int] = {}
        for w, n in words_in(text).items():
            if (found := held.get(w)) is None:
                if len(held) >= CACHED:
                    held.clear()
                found = held[w] = find(w)
            for f in found:
                counts[f] = counts.get(f, 0) + n
        at = sorted(number[f, k] for f, n in counts.items() for k in range(min(n, LEVELS)) if (f, k) in number)
        return float(sigmoid(bias + table[:, at].sum(axis=1)).mean())

    return score if models else lambda text: 0.0


def scored(docs: DataFrame, labels: DataFrame, **settings: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    docs, labels = docs.select("doc_id", F.col("text").cast("string").alias("text")), labels.select("doc_id", "toxic")
    models = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(models.value)
        for b in batches:
            values = [score(t) for t in byte_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
