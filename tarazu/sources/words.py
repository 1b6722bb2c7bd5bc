"""Statements printed without rules: words with their places on pages, as rows. Headings tell where columns lie, dates where rows start.

words(statement_id, page, top, x0, x1, text[, fontname]) in points. All work is by page: windows and folds over one page's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, money
from ..functions.bind import bind
from ..session import shuffled
from .statements import CLOSING, KEY, OPENING, SUMMARY, column_map, may_name, names_columns

#: How far words of one line lie apart vertically; the gaps inside a heading; a gap that sets a line apart; how far below a label its value stands.
LINE_TOLERANCE, LABEL_GAP, GAP_RATIO, MIN_LABEL_GAP, BREAK_RATIO, VALUE_DROP = 3.0, 12.0, 3.0, 4.0, 1.6, 40.0
PAGE, LINE = [KEY, "page"], [KEY, "page", "line"]


def lines(words: DataFrame) -> DataFrame:
    """words with line, from 0 down the page. A word joins the line whose first word it is level with; glyphs of a rupee font are the sign."""
    text = F.when(F.lower("fontname").contains("rupee"), "₹").otherwise(F.col("text")) if "fontname" in words.columns else F.col("text")
    item = F.struct(*(F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1")), text.alias("text"))
    none = F.array().cast("array<struct<line:int,top:double,x0:double,x1:double,text:string>>")

    def step(acc: Column, w: Column) -> Column:
        level = F.coalesce(F.abs(w["top"] - acc["anchor"]) <= LINE_TOLERANCE, F.lit(False))
        line = F.when(level, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(level, acc["anchor"]).otherwise(w["top"]).alias("anchor"), line.alias("line"), F.array_append(acc["out"], F.struct(line.alias("line"), *(w[c].alias(c) for c in ("top", "x0", "x1", "text")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), none.alias("out"))
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("w"))
    return pages.select(*PAGE, F.inline(F.aggregate("w", start, step, lambda acc: acc["out"])))


def labels(placed: DataFrame) -> DataFrame:
    """(statement_id, page, line, top, labels array<struct<text, x0, x1>>): words of a line joined where the gap is a space of that line."""
    along = Window.partitionBy(*LINE).orderBy("x0", "x1")
    rows = placed.withColumn("gap", F.col("x0") - F.lag("x1").over(along))
    whole = Window.partitionBy(*LINE)
    spaces = F.when(F.count("gap").over(whole) < 2, LABEL_GAP).otherwise(F.least(F.lit(LABEL_GAP), F.greatest(F.lit(MIN_LABEL_GAP), GAP_RATIO * F.min(F.greatest("gap", F.lit(0.0))).over(whole))))
    rows = rows.withColumn("new", F.coalesce(F.col("gap") > spaces, F.lit(True)).cast("int")).withColumn("label", F.sum("new").over(along))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    joined = rows.groupBy(*LINE, "label").agg(F.array_join(words, " ").alias("text"), F.min("x0").alias("x0"), F.max_by("x1", "x0").alias("x1"), F.min_by("top", "x0").alias("top"))
    ordered = F.array_sort(F.collect_list(F.struct("label", "text", "x0", "x1")))
    return joined.groupBy(*LINE).agg(F.min_by("top", "x0").alias("top"), F.transform(ordered, lambda s: F.struct(s["text"].alias("text"), s["x0"].alias("x0"), s["x1"].alias("x1"))).alias("labels"))


def page_columns(labelled: DataFrame) -> DataFrame:
    """(statement_id, page, header, names, fields, edges): each page's columns, by its own header or the last one before. Boundaries lie midway between headings."""
    texts = F.transform("labels", lambda x: x["text"])
    heads = labelled.filter((F.size("labels") >= 3) & may_name(texts)).withColumn("fields", column_map(texts))
    heads = heads.filter(names_columns(F.col("fields")))
    first = heads.groupBy(*PAGE).agg(F.min("line").alias("header"), F.min_by(F.struct("labels", "fields"), "line").alias("h"))
    pages = labelled.select(*PAGE).distinct().join(first, PAGE, "left")
    pages = pages.withColumn("h", F.last("h", ignorenulls=True).over(Window.partitionBy(KEY).orderBy("page"))).filter("h is not null")
    edge = lambda x, i: F.struct(F.coalesce((F.get("h.labels", i - 1)["x1"] + x["x0"]) / 2, F.lit(float("-inf"))).alias("left"), F.coalesce((x["x1"] + F.get("h.labels", i + 1)["x0"]) / 2, F.lit(float("inf"))).alias("right"))
    return pages.select(*PAGE, "header", F.transform("h.labels", lambda x: x["text"]).alias("names"), "h.fields", F.transform("h.labels", edge).alias("edges"))


def cells(placed: DataFrame, columns: DataFrame) -> DataFrame:
    """(statement_id, page, line, top, header, fields, cells): each line's words under the columns that their centres fall in."""
    centre = (F.col("x0") + F.col("x1")) / 2
    inside = F.filter(F.transform("edges", lambda e, i: F.when((centre >= e["left"]) & (centre < e["right"]), i)), lambda i: i.isNotNull())
    rows = placed.join(columns, PAGE).withColumn("at", F.get(inside, F.lit(0)))
    held = F.array_sort(F.collect_list(F.struct("x0", "at", "text")))
    by = rows.groupBy(*LINE).agg(F.min_by("top", "x0").alias("top"), F.first("header").alias("header"), F.first("fields").alias("fields"), F.first(F.size("edges")).alias("n"), held.alias("w"))
    cell = lambda i: F.array_join(F.transform(F.filter("w", lambda w: w["at"] == i), lambda w: w["text"]), " ")
    return by.select(*LINE, "top", "header", "fields", F.transform(F.sequence(F.lit(0), F.col("n") - 1), cell).alias("cells"))


def assembled(by_line: DataFrame) -> DataFrame:
    """(statement_id, page, line, cells): a dated line starts a row and takes in those below it, until a line that is set apart or states a balance. What stands before any row is the layout's."""
    body = by_line.filter(F.col("header").isNull() | (F.col("line") > F.col("header")))
    down = Window.partitionBy(*PAGE).orderBy("line")
    body = body.withColumn("gap", F.round(F.col("top") - F.lag("top").over(down), 1))
    pitch = body.filter("gap > 0").groupBy(*PAGE).agg(F.count("gap").alias("gaps"), F.mode("gap", True).alias("pitch")).filter("gaps >= 3").select(*PAGE, "pitch")
    body = body.join(pitch, PAGE, "left")
    joined = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    states = F.exists("cells", lambda c: money.parse_optional_amount(c).isNotNull())
    marker = joined.rlike(SUMMARY) | ((joined.rlike(OPENING) | joined.rlike(CLOSING)) & states)
    dated = F.coalesce(dates.looks_like_date(F.get("cells", F.try_element_at("fields", F.lit("date")))), F.lit(False))
    apart = F.coalesce(F.col("top") - F.lag("top").over(down) > F.col("pitch") * BREAK_RATIO, F.lit(False))
    body = body.withColumns({"dated": dated, "marker": marker, "apart": apart})
    body = body.withColumn("part", F.sum((F.col("dated") | F.col("marker") | F.col("apart")).cast("int")).over(down)).filter("part > 0")
    rows = body.groupBy(*PAGE, "part").agg(F.min_by(F.struct("line", "dated", "marker", "cells", "fields"), "line").alias("head"), F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("all")).filter("head.dated or head.marker")
    texts = lambda i: F.filter(F.transform("all", lambda x: F.get(x["cells"], i)), lambda c: F.coalesce(c != "", F.lit(False)))
    narration = F.try_element_at("head.fields", F.lit("narration"))
    filled = F.transform("head.cells", lambda c, i: bind(texts(i), lambda t: F.when(i == narration, F.array_join(t, " ")).otherwise(F.coalesce(F.get(t, F.lit(0)), F.lit("")))))
    return rows.select(*PAGE, F.col("head.line").alias("line"), F.when(F.col("head.dated"), filled).otherwise(F.col("head.cells")).alias("cells"))


def grid(words: DataFrame) -> DataFrame:
    """(statement_id, number, cells) as delimited files give them: lines above the first header by their labels, the header, the rows of all pages."""
    # lines, labels and columns are read several times each
    placed = shuffled(lines(words), "lines")
    labelled = shuffled(labels(placed), "labels")
    columns = shuffled(page_columns(labelled), "columns")
    rows = assembled(cells(placed, columns)).select(*PAGE, "line", "cells")
    first = columns.filter("header is not null").groupBy(KEY).agg(F.min(F.struct("page", "header")).alias("first"), F.min_by("names", "page").alias("names"))
    texts = F.transform("labels", lambda x: x["text"])
    above = labelled.join(first, KEY).filter((F.col("page") < F.col("first.page")) | ((F.col("page") == F.col("first.page")) & (F.col("line") <= F.col("first.header")))).select(*PAGE, "line", texts.alias("cells"))
    return above.unionByName(rows).select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("page", "line")).alias("number"), "cells")


def labelled_values(words: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(statement_id, field, value): for each field the first label, in reading order, with a figure or a date below it within its width."""
    placed = shuffled(lines(words), "lines")
    named = labels(placed).select(*LINE, "top", F.posexplode("labels").alias("at", "label"))
    wanted = F.array_compact(F.array(*(F.when(F.col("label.text").rlike(f"(?i){p}"), f) for f, p in patterns.items())))
    named = named.select(*PAGE, F.col("line").alias("from"), F.col("top").alias("from_top"), "at", "label", F.explode(wanted).alias("field"))
    below = placed.withColumn("line_top", F.min_by("top", "x0").over(Window.partitionBy(*LINE)))
    near = named.join(below, PAGE).filter("line > from and line_top - from_top <= " + str(VALUE_DROP) + " and x1 > label.x0 and x0 < label.x1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    under = near.groupBy(*PAGE, "field", "from", "at", "line").agg(text.alias("value"))
    values = under.filter(money.parse_optional_amount(F.col("value")).isNotNull() | F.coalesce(dates.looks_like_date(F.col("value")), F.lit(False)))
    return values.groupBy(KEY, "field").agg(F.min_by("value", F.struct("page", "from", "at", "line")).alias("value"))
