"""Tables on pages in three ways, tried in this order for each file: drawn rules, headings over columns, white space.

words(statement_id, page, top, x0, x1, text[, fontname]) as in sources.words; rules(statement_id, page, x0, y0, x1, y1)
are the straight lines that a page draws, y downwards like top. A drawn table states its own geometry, so nothing
inferred overrides it; headings keep columns that white space would cut. All joins are by page and a band of its
height, all windows by page or by file's distinct places. A file that no way gives a header is refused with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffled
from . import words as positions
from .statements import KEY, is_header

#: How far apart rules on one line lie, and how far rules that meet fall short of each other.
SNAP, REACH = 3.0, 3.0
BAND, HALF_LINE = 48.0, 4.0
#: A gutter is as wide, and at most such a share of the lines with several labels reach into it.
GUTTER, STRAY = 4.0, 0.1
PAGE = [KEY, "page"]
NO_TEXT = "no text on the pages: a scan needs character recognition first"
NO_TABLE = "text was read, but no header of a transaction table was recognised in it"


def _bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND)))


def _islands(by: list[str], start: str, end: str, slack: float) -> Column:
    """Numbers intervals from 1 along start: one that begins beyond all before, and the slack, is a new island."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(start) > reach + slack, F.lit(True)).cast("int")


def merged_rules(rules: DataFrame) -> DataFrame:
    """(statement_id, page, across, at, start, end, e): rules that lie on one line and touch are one; slanted ones are none. e numbers a page's rules."""
    x, y = (F.array_sort(F.array(f"{c}0", f"{c}1")) for c in "xy")
    flat, upright = y[1] - y[0] <= SNAP, x[1] - x[0] <= SNAP
    across = F.when(flat & ((x[1] - x[0] > SNAP) | ~upright), True).when(upright & (y[1] - y[0] > SNAP), False)
    place = lambda a, b: F.when(F.col("across"), a).otherwise(b)
    lines = rules.select(*PAGE, across.alias("across"), x.alias("x"), y.alias("y")).filter("across is not null")
    lines = lines.select(*PAGE, "across", place((F.col("y")[0] + F.col("y")[1]) / 2, (F.col("x")[0] + F.col("x")[1]) / 2).alias("at"), place(F.col("x")[0], F.col("y")[0]).alias("start"), place(F.col("x")[1], F.col("y")[1]).alias("end"))
    side = [*PAGE, "across"]
    along = Window.partitionBy(*side).orderBy("at")
    lines = lines.withColumn("far", F.coalesce(F.col("at") - F.lag("at").over(along) > SNAP, F.lit(True)).cast("int")).withColumn("line", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("new", _islands([*side, "line"], "start", "end", REACH))
    lines = lines.withColumn("part", F.sum("new").over(Window.partitionBy(*side, "line").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("at", F.avg("at").over(Window.partitionBy(*side, "line")))
    joined = lines.groupBy(*side, "line", "part").agg(F.first("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(*side, "at", "start", "end", F.row_number().over(Window.partitionBy(*PAGE).orderBy("across", "line", "part")).alias("e"))


def crossings(merged: DataFrame) -> DataFrame:
    """(statement_id, page, h, v, x, y): where a rule across meets an upright one. They meet in a band, so a page's rules aren't all paired."""
    flat = merged.filter("across").select(*PAGE, F.col("e").alias("h"), F.col("at").alias("y"), F.col("start").alias("left"), F.col("end").alias("right"), F.floor(F.col("at") / BAND).alias("band"))
    upright = merged.filter("not across").select(*PAGE, F.col("e").alias("v"), F.col("at").alias("x"), F.col("start").alias("high"), F.col("end").alias("low"), _bands(F.col("start") - REACH, F.col("end") + REACH).alias("band"))
    met = flat.join(upright, [*PAGE, "band"]).filter(f"x between left - {REACH} and right + {REACH} and y between high - {REACH} and low + {REACH}")
    return met.select(*PAGE, "h", "v", "x", "y")


def ruled_cells(points: DataFrame) -> DataFrame:
    """(statement_id, page, x0, y0, x1, y1): from each crossing the smallest rectangle right of and below it whose corners are crossings of the same rules."""
    here = [*PAGE, "h", "v", "x", "y"]
    beside = Window.partitionBy(*PAGE, "h").orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    down = Window.partitionBy(*PAGE, "v").orderBy("y")
    below = F.lead(F.struct("y", "h")).over(down)
    starts = points.select(*here, F.collect_list(F.struct("x", "v")).over(beside).alias("rights"), below.alias("under")).filter("size(rights) > 0 and under is not null")
    corners = points.select(*PAGE, F.col("h").alias("ch"), F.col("v").alias("cv"))

    def closed(tried: DataFrame) -> DataFrame:
        """tried(here, rights, under) -> (here, x1, y1) of those that close, the lowest height first, then the least width."""
        pairs = tried.select(*here, "under", F.explode("rights").alias("r")).select(*here, F.col("under.y").alias("y1"), F.col("under.h").alias("ch"), F.col("r.x").alias("x1"), F.col("r.v").alias("cv"))
        return pairs.join(corners, [*PAGE, "ch", "cv"], "left_semi").groupBy(*here).agg(F.min(F.struct("y1", "x1")).alias("c")).select(*here, "c.x1", "c.y1")

    near = closed(starts)
    # cells that span rows: those that the next rule below doesn't close are tried with all further ones
    open_ = starts.join(near.select(*PAGE, "h", "v"), [*PAGE, "h", "v"], "left_anti")
    further = points.select(*PAGE, "v", F.struct("y", "h").alias("next"))
    spanning = open_.join(further, [*PAGE, "v"]).filter("next.y > under.y").select(*here, "rights", F.col("next").alias("under"))
    found = near.unionByName(closed(spanning))
    return found.select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def ruled_rows(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(statement_id, page, top, table, cells): the rows of every drawn table, a cell for each left edge that its table has; text above a page's tables as rows of its labels, of table 0."""
    cells = ruled_cells(shuffled(crossings(merged_rules(rules)), "crossings"))
    cells = cells.withColumn("i", F.sum(_islands(PAGE, "x0", "x1", 0.5)).over(Window.partitionBy(*PAGE).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, 0)))
    block = [*PAGE, "i"]
    cells = cells.withColumn("j", F.sum(_islands(block, "y0", "y1", 0.5)).over(Window.partitionBy(*block).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, 0)))
    cells = shuffled(cells, "cells")
    placed = shuffled(positions.lines(words), "lines").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": F.col("top") + HALF_LINE})
    inside = placed.select(*PAGE, "line", F.col("x0").alias("wx"), "text", "cx", "cy", F.floor(F.col("cy") / BAND).alias("band")).join(cells.select("*", _bands(F.col("y0"), F.col("y1")).alias("band")), [*PAGE, "band"]).filter("cx >= x0 and cx < x1 and cy >= y0 and cy < y1")
    table = [*block, "j"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "wx", "text"))), lambda w: w["text"]), " ")
    filled = cells.select(*table, "x0", "y0").join(inside.groupBy(*table, "x0", "y0").agg(text.alias("text")), [*table, "x0", "y0"], "left")
    lefts = cells.groupBy(*table).agg(F.array_sort(F.collect_set("x0")).alias("lefts"), F.min("y0").alias("head"))
    rows = filled.groupBy(*table, "y0").agg(F.map_from_entries(F.collect_list(F.struct("x0", F.coalesce("text", F.lit(""))))).alias("at")).join(lefts, table)
    order = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("head", "i", "j"))
    rows = rows.select(*PAGE, F.col("y0").alias("top"), order.alias("table"), F.transform("lefts", lambda x: F.coalesce(F.try_element_at("at", x), F.lit(""))).alias("cells"))
    first = cells.groupBy(*PAGE).agg(F.min("y0").alias("head"))
    above = positions.labels(placed.drop("cx", "cy").join(first, PAGE).filter(f"top + {HALF_LINE} < head"))
    return rows.unionByName(above.select(*PAGE, "top", F.lit(0).alias("table"), F.transform("labels", lambda x: x["text"]).alias("cells")))


def gutters(labelled: DataFrame) -> DataFrame:
    """(statement_id, cuts array<double>): the middles of a file's gutters. A sweep over the places where labels begin and end counts how many lines cover each stretch."""
    rows = labelled.filter(F.size("labels") >= 3)
    spans = rows.select(KEY, F.explode("labels").alias("l")).select(KEY, F.col("l.x0").alias("x0"), F.col("l.x1").alias("x1"))
    events = spans.select(KEY, F.explode(F.array(F.struct(F.round("x0", 1).alias("x"), F.lit(1).alias("d")), F.struct(F.round("x1", 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    places = events.groupBy(KEY, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(KEY).orderBy("x")
    profile = places.withColumns({"depth": F.sum("d").over(along), "until": F.lead("x").over(along)}).join(rows.groupBy(KEY).agg(F.count("*").alias("n")), KEY)
    thin = profile.filter("until is not null").withColumn("thin", F.col("depth") <= F.col("n") * STRAY).withColumn("new", (F.col("thin") != F.coalesce(F.lag("thin").over(along), ~F.col("thin"))).cast("int")).withColumn("part", F.sum("new").over(along))
    wide = thin.filter("thin").groupBy(KEY, "part").agg(F.min("x").alias("x"), F.max("until").alias("until")).filter(F.col("until") - F.col("x") >= GUTTER)
    return wide.groupBy(KEY).agg(F.array_sort(F.collect_list((F.col("x") + F.col("until")) / 2)).alias("cuts"))


def spaced_rows(words: DataFrame) -> DataFrame:
    """(statement_id, page, top, table, cells): each line's words under the columns between a file's gutters."""
    placed = shuffled(positions.lines(words), "lines")
    cuts = gutters(positions.labels(placed))
    centre = (F.col("x0") + F.col("x1")) / 2
    at = placed.join(cuts, KEY).withColumn("at", F.size(F.filter("cuts", lambda c: c <= centre)))
    held = F.array_sort(F.collect_list(F.struct("x0", "at", "text")))
    lines = at.groupBy(*PAGE, "line").agg(F.min_by("top", "x0").alias("top"), F.first(F.size("cuts")).alias("n"), held.alias("w"))
    cell = lambda i: F.array_join(F.transform(F.filter("w", lambda w: w["at"] == i), lambda w: w["text"]), " ")
    return lines.select(*PAGE, "top", F.lit(1).alias("table"), F.transform(F.sequence(F.lit(0), F.col("n")), cell).alias("cells"))


def numbered(rows: DataFrame) -> DataFrame:
    """(statement_id, number, cells) of the files that have a header; headers that later pages repeat are dropped."""
    order = Window.partitionBy(KEY).orderBy("page", "table", "top")
    rows = rows.withColumns({"head": is_header(F.col("cells")), "k": F.row_number().over(order)})
    first = F.min(F.when(F.col("head"), F.col("k"))).over(Window.partitionBy(KEY))
    kept = rows.withColumn("first", first).filter("first is not null and (not head or k = first)")
    return kept.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("k")).alias("number"), "cells")


def recovered(files: DataFrame, words: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((statement_id, number, cells, how), (statement_id, reason)) of files(statement_id): how is ruled, headings or spaces. Each way reads only the files that those before left."""
    ids = lambda grid: grid.select(KEY).distinct().hint("merge")
    words = words.join(ids(files), KEY, "left_semi")
    drawn = words.join(ids(rules), KEY, "left_semi")
    ruled = shuffled(numbered(ruled_rows(drawn, rules)), "ruled")
    words = words.join(ids(ruled), KEY, "left_anti")
    headed = shuffled(positions.grid(words), "headed")
    words = words.join(ids(headed), KEY, "left_anti")
    spaced = shuffled(numbered(spaced_rows(words)), "spaced")
    grid = ruled.withColumn("how", F.lit("ruled")).unionByName(headed.withColumn("how", F.lit("headings"))).unionByName(spaced.withColumn("how", F.lit("spaces")))
    left = files.select(KEY).distinct().join(ids(grid), KEY, "left_anti").join(words.filter("trim(text) <> ''").select(KEY, F.lit(NO_TABLE).alias("found")).distinct().hint("merge"), KEY, "left")
    return grid, left.select(KEY, F.coalesce("found", F.lit(NO_TEXT)).alias("reason"))
