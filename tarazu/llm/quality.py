"""Quality rules, with DataFrame functions only: rules on each text, then cross-document line frequency.

Line frequency: lines are normalised (lower case, runs of white space to one space, trimmed) and
hashed. For each host the distinct documents with a line are counted; a line in more than
``LINE_LIMIT`` of them is removed from all documents but the one with the least id, which keeps what
would else be lost with all of its copies. A document that loses more than ``MOST_REMOVED`` per cent of
its words is depleted and rejected.

Defined cases: a null text has no words and fails the base rules; a null host is a host; a null
doc_id comes after all others; repeated rows get one verdict each; other columns are kept, but
for those named like the new ones, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_rows, materialize, restored, words_of

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
LINE_LIMIT, MOST_REMOVED = 30, 70
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
NEW = (*BASE, "n_removed", "kept_text", "kept")


def covered_words(windows: Column, size: int) -> Column:
    """Words in the windows (array<long> of hashes by position) that occur twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        places = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return F.get(F.transform(F.array(ordered), count), F.lit(0))


def base_rules(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds the BASE columns."""
    n = REPEAT_WINDOW
    columns = [c for c in df.columns if c not in BASE]
    out = df.select(*columns, words_of(text_column).alias("_w"))
    out = out.select(*columns, "_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"))
    windows = F.when(F.size("_wh") >= n, F.transform(F.sequence(F.lit(0), F.size("_wh") - n), lambda i: F.xxhash64(*(F.get("_wh", i + k) for k in range(n))))).otherwise(F.array().cast("array<long>"))
    out = out.select(*columns, "_w", windows.alias("_win"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        *columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_win")) == F.size("_win"), F.lit(0)).otherwise(covered_words(F.col("_win"), n)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def normalised(text: Column) -> Column:
    """Lower case, and runs of white space other than line ends to one space; lines are trimmed once they are cut."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")


def line_rows(keyed: DataFrame) -> DataFrame:
    """(host, line, _id, _h, n): each line with a word by hash, with its words, and a null line for each row."""
    lines = F.filter(F.transform(F.split(normalised(F.col("text")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n")))
    return keyed.select("host", "_id", "_h", F.explode(F.concat(pairs, F.array(F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("n"))))).alias("x")).select("host", "x.line", "_id", "_h", "x.n")


def removed_words(keyed: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, _id, _h, n_removed, lines) of the rows that lose lines. times has the lines of all rows that repeat (host, _id, _h), so it is divided by their number."""
    rows = line_rows(keyed).groupBy("host", "line", "_id", "_h").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    rows = materialize(rows, "lines")
    frequent = rows.filter("line is not null").groupBy("host", "line").agg(F.count("*").alias("documents"), F.min("_id").alias("first")).filter(F.col("documents") > limit)
    found = rows.join(frequent, ["host", "line"]).filter("_id > first")
    lost = found.groupBy("host", "_id", "_h").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.collect_set("line").alias("lines"))
    repeated = rows.filter("line is null and times > 1").select("host", "_id", "_h", F.col("times").alias("rows"))
    return lost.join(repeated, ["host", "_id", "_h"], "left").select("host", "_id", "_h", F.expr("n div coalesce(rows, 1)").alias("n_removed"), "lines")


def judged(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """The rows with the BASE columns, which are those of the text as it is, n_removed (words in removed lines), kept_text (the text without these) and kept."""
    keyed = keyed_rows(df, id_column, text_column, NEW).withColumn("host", F.coalesce(F.concat(F.lit("="), F.col("own").getField(host_column).cast("string")), F.lit("null")))
    removed = removed_words(keyed.select("host", "text", "_id", "_h"), limit)
    out = base_rules(keyed).join(removed, ["host", "_id", "_h"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    kept = ~F.col("base_failed") & (100 * F.col("n_removed") <= MOST_REMOVED * F.col("n_words"))
    stays = lambda x: ~F.array_contains("lines", F.xxhash64(F.trim(normalised(x))))
    left = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n"))
    return out.select(*restored(out, [c for c in df.columns if c not in NEW], text_column), *BASE, "n_removed", left.alias("kept_text"), kept.alias("kept"))


def accepted(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """The rows that are kept, without the lines that are removed. Verdicts are written first: a filter on them would be pushed into the rules and repeat them many times over."""
    rows = df.select(F.struct(*[c for c in df.columns if c != text_column]).alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(host_column).alias("source"))
    verdict = materialize(judged(rows, limit=limit).select("row", "kept_text", "kept"), "verdicts").filter("kept")
    return verdict.select(*[F.col("kept_text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in df.columns])
