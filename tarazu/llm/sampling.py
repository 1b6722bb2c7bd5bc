"""Consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by their counts. For each of ``SAMPLES`` hash functions every
term draws r and c from Gamma(2, 1) and b from [0, 1), all by hashes of the term; with weight S,
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). The term of least a is the sample. Two texts
draw the same (term, t) with the probability sum min / sum max of their weights, the generalised
Jaccard similarity. As ln a is made of the term, its hash function and t alone, equal least values
stand for equal samples, and the signature is the vector of least ln a.

Order: a document is compared with the next one. Documents are dealt by runs of ``RUN`` ids, so a
text moves once and each run finds its successors inside; the first document of a run is also sent
to the run before (the first of all to the last run).

Defined cases: a null text is the empty text; a text without words has a signature of its own, equal
to that of other such texts; a null id comes after all others; repeated rows follow each other;
other columns are ignored; an empty table gives no rows; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keyed_rows, materialize, words_of

SAMPLES, RUN, COARSE = 32, 256, 4096
NO_TERMS = 1e300


def draw(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term (long) for hash function k."""
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda bits, n: (bits.cast("double") + 0.5) / float(1 << n)
    low, high = (lambda h: h.bitwiseAND(F.lit((1 << 31) - 1))), (lambda h: F.shiftrightunsigned(h, 33))
    r = -F.log(unit(low(first), 31) * unit(high(first), 31))
    log_c = F.log(-F.log(unit(low(second), 31) * unit(high(second), 31)))
    b = unit(F.shiftrightunsigned(F.xxhash64(first), 11), 53)
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def weighted_terms(df: DataFrame, text_column: str, keys: list[str]) -> DataFrame:
    """keys, term long, log_weight double; a text without words gives one row of nulls."""
    out = df.select(*keys, F.sort_array(F.transform(words_of(text_column), lambda w: F.xxhash64(w))).alias("_t"))
    ends = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: ~F.get("_t", i).eqNullSafe(F.get("_t", i + 1)))
    out = out.select(*keys, "_t", F.when(F.size("_t") > 0, ends).alias("_e"))
    pairs = F.transform("_e", lambda e, i: F.struct(F.get("_t", e).alias("term"), (e - F.coalesce(F.get("_e", i - 1), F.lit(-1))).alias("n")))
    return out.select(*keys, F.explode_outer(pairs).alias("x")).select(*keys, F.col("x.term").alias("term"), F.log(F.col("x.n").cast("double")).alias("log_weight"))


def signatures(df: DataFrame, text_column: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, signature array<double>. Rows that agree in keys are one text; rows already dealt by a key aren't moved."""
    draws = [F.min(draw(F.col("term"), F.col("log_weight"), k)).alias(f"_m{k}") for k in range(samples)]
    out = weighted_terms(df, text_column, keys).groupBy(*keys).agg(*draws)
    return out.select(*keys, F.array(*(F.coalesce(f"_m{k}", F.lit(NO_TERMS)) for k in range(samples))).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def as_string(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def in_runs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_run, _guest, _pos, doc_id, text, next_text): guests are the first documents of the following run."""
    rows = keyed_rows(df.select(id_column, text_column), id_column, text_column, ()).select("_id", "_h", F.col("own").getField(id_column).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_run", F.floor(F.col("_id") / RUN))
    runs = rows.groupBy("_run").agg(F.min("_id").alias("_id")).withColumn("_coarse", F.floor(F.col("_run") / COARSE))
    coarse = runs.groupBy("_coarse").agg(F.max("_run").alias("_most"))
    coarse = coarse.select("_coarse", F.coalesce(F.lag("_most").over(Window.orderBy("_coarse")), F.max("_most").over(Window.partitionBy())).alias("_before"))
    runs = runs.withColumn("_lag", F.lag("_run").over(Window.partitionBy("_coarse").orderBy("_run"))).join(coarse, "_coarse")
    firsts = materialize(runs.select("_id", F.coalesce("_lag", "_before").alias("_to")), "runs")
    guests = rows.join(firsts, "_id").select(F.col("_to").alias("_run"), F.lit(1).alias("_guest"), "_id", "_h", "doc_id", "text")
    every = rows.select("_run", F.lit(0).alias("_guest"), "_id", "_h", "doc_id", "text").unionByName(guests)
    order = Window.partitionBy("_run").orderBy("_guest", "_id", "_h")
    return every.select("_run", "_guest", F.row_number().over(order).alias("_pos"), "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_neighbours(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each document's signature beside that of its edited text and that of the next document.

    The edited text has the last quarter of its code points replaced by as many first ones of the next document.
    """
    rows = in_runs(df, id_column, text_column).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))
    keys = ["_run", "_pos", "which", "_guest", "doc_id", "n_chars", "sha"]
    both = rows.select("_run", "_pos", "_guest", "doc_id", "n_chars", F.explode(texts).alias("x")).filter("x.which = 0 or _guest = 0")
    both = both.select("_run", "_pos", F.col("x.which").alias("which"), "_guest", "doc_id", "n_chars", F.when(F.col("x.which") == 1, F.sha2("x.t", 256)).alias("sha"), F.col("x.t").alias("t"))
    signed = signatures(both, "t", keys, samples)
    order = Window.partitionBy("_run").orderBy("_pos", "which")
    out = signed.withColumns({"edited": F.lead("signature", 1).over(order), "edited_sha256": F.lead("sha", 1).over(order), "following": F.lead("signature", 2).over(order)})
    return out.filter("which = 0 and _guest = 0").select("doc_id", "n_chars", "edited_sha256", "signature", "edited", "following")
