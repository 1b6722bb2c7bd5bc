"""Quotation linking of conversations.

Lines that start with ``>`` marks are quoted at the level of their number of marks; a passage is a
run of lines of one level. Passages, their paragraphs and their lines are normalised (marks off,
white space to one space, lower case) and hashed, and so are every message's own body, paragraphs
and lines. A passage joins the first message of its conversation that has the same text, if that
came before; quote_links has these for passages of every level. A message replies to the message that its
lowest level's passage quotes (of several the whole passage before paragraphs before lines of
``LINE_WORDS`` words, then the latest). Roots and depths follow the links by pointer doubling. A
message's position, from 0, is its place in its conversation read as threads: each message, then its
replies by turn, each with all of theirs. Positions come from the tour of each thread (enter and leave
every message), ranked by pointer doubling too, so neither a conversation nor a path is gathered.

``with_quotes`` is the way back: it writes messages as replies that quote earlier ones.

Defined cases: a null text has no body and no quotes; null conv_id or turn are values that come
last; rows that repeat (conv_id, turn) share one place and one link; a quote of the message itself
or of a later one links nothing; other columns are kept, but for those named like the new ones; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import NULL_ID, byte_column, made, materialize, row_id

LINE_WORDS = 3
_marks = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
NEW = ("body", "n_quotes", "max_level", "reply_to", "root", "depth", "quote_links", "position")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without its quoted lines, and the quoted passages with their levels."""
    body, passages, level = [], [], 0
    for line in text.split("\n"):
        m = _marks.match(line)
        now = m[1].count(">") if m else 0
        if not now:
            body.append(line)
        elif now == level:
            passages[-1][1].append(line[m.end() :])
        else:
            passages.append((now, [line[m.end() :]]))
        level = now
    return "\n".join(body).strip("\n"), [(n, "\n".join(lines)) for n, lines in passages]


def normalised(text: str) -> str:
    return " ".join(text.split()).lower()


def parts(text: str) -> list[tuple[int, str]]:
    """(0, whole), (1, paragraph)..., (2, line)..., normalised and not empty."""
    found = [(0, text), *((1, p) for p in re.split(r"\n[ \t\r]*\n", text)), *((2, x) for x in text.split("\n") if len(x.split()) >= LINE_WORDS)]
    return list(dict.fromkeys((k, n) for k, x in found if (n := normalised(x))))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def parsed(df: DataFrame, conv_column: str, turn_column: str, text_column: str) -> DataFrame:
    """own, _c, _t, body, n_quotes, max_level, has array<long>, quoted array<struct<passage int, level int, lowest boolean, kind int, hash long>>."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in NEW]
    rows = df.select(F.struct(*own).alias("own"), row_id(conv_column).alias("_c"), row_id(turn_column).alias("_t"), F.col(text_column).cast("string").alias("text"))
    schema = made(rows, _c="long", _t="long", body="string", n_quotes="long", max_level="int", has="array<long>", quoted="array<struct<passage:int,level:int,lowest:boolean,kind:int,hash:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, n, most, has, quoted = [], [], [], [], []
            for raw in byte_column(batch, "text"):
                own_text, passages = parse(raw.decode())
                lowest = min((level for level, _ in passages), default=0)
                body.append(own_text)
                n.append(len(passages))
                most.append(max((level for level, _ in passages), default=0))
                has.append(list({_hash(x) for _, x in parts(own_text)}))
                quoted.append([{"passage": i, "level": level, "lowest": level == lowest, "kind": k, "hash": _hash(x)} for i, (level, p) in enumerate(passages) for k, x in parts(p)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(body, pa.string()), pa.array(n, pa.int64()), pa.array(most, pa.int32()), pa.array(has, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("lowest", pa.bool_()), ("kind", pa.int32()), ("hash", pa.int64())])))], schema.names)

    return rows.mapInArrow(run, schema)


def passage_links(messages: DataFrame) -> DataFrame:
    """(_c, _t, passage, level, lowest, best): what each passage quotes, best has its kind (negative) and the turn."""
    first = messages.select("_c", "_t", F.explode("has").alias("hash")).groupBy("_c", "hash").agg(F.min("_t").alias("first"))
    quotes = messages.select("_c", "_t", F.explode("quoted").alias("q")).select("_c", "_t", "q.*").groupBy("_c", "_t", "passage", "level", "lowest", "hash").agg(F.min("kind").alias("kind"))
    found = quotes.join(first, ["_c", "hash"]).filter("first < _t")
    return found.groupBy("_c", "_t", "passage", "level", "lowest").agg(F.max(F.struct((-F.col("kind")).alias("kind"), F.col("first"))).alias("best"))


def reply_links(found: DataFrame) -> DataFrame:
    """(_c, _t, reply, quote_links): the turn that a message replies to (null: only deeper levels quote one), and all passages' links in order."""
    links = F.sort_array(F.collect_set(F.struct("passage", "level", F.col("best.first").alias("turn"))))
    return found.groupBy("_c", "_t").agg(F.max(F.when(F.col("lowest"), F.col("best"))).alias("best"), links.alias("quote_links")).select("_c", "_t", F.col("best.first").alias("reply"), "quote_links")


def reading_order(replies: DataFrame) -> DataFrame:
    """replies(_c, _t, reply) -> (_c, _t, position): the tour of each conversation's threads, ranked from its end."""
    children = replies.withColumn("sibling", F.lead("_t").over(Window.partitionBy("_c", "reply").orderBy("_t")))
    eldest = replies.filter("reply is not null").groupBy("_c", F.col("reply").alias("_t")).agg(F.min("_t").alias("child"))
    enter = children.join(eldest, ["_c", "_t"], "left").select("_c", "_t", F.lit(0).alias("side"), F.coalesce("child", "_t").alias("nt"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("ns"), F.lit(1).cast("long").alias("n"))
    leave = children.select("_c", "_t", F.lit(1).alias("side"), F.coalesce("sibling", "reply").alias("nt"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("ns"), F.lit(0).cast("long").alias("n"))
    tour = materialize(enter.unionByName(leave), "tour")
    ranked, going = tour.filter("nt is null"), tour.filter("nt is not null")
    while not going.isEmpty():  # each step's reach doubles; n counts the messages entered from here to its end; what has reached it drops out
        ahead = tour.select("_c", F.col("_t").alias("nt"), F.col("side").alias("ns"), F.col("nt").alias("ft"), F.col("ns").alias("fs"), F.col("n").alias("more"))
        step = materialize(going.join(ahead, ["_c", "nt", "ns"]).select("_c", "_t", "side", F.col("ft").alias("nt"), F.col("fs").alias("ns"), (F.col("n") + F.col("more")).alias("n")), "tour")
        tour = ranked.unionByName(step)
        ranked, going = ranked.unionByName(step.filter("nt is null")), step.filter("nt is not null")
    entered = tour.filter("side = 0")
    return entered.join(entered.groupBy("_c").agg(F.max("n").alias("all")), "_c").select("_c", "_t", (F.col("all") - F.col("n")).alias("position"))


def with_quotes(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", text_column: str = "text") -> DataFrame:
    """The rows with texts as replies: a turn quotes the one before; every third from 2 on that one with the one it quotes, one level deeper; every third from 3 on the one before it only. Of repeated turns the least text is quoted."""
    own = [c for c in df.columns if c != text_column]
    text = F.coalesce(F.col("x.text"), F.lit(""))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.struct(F.col(text_column).cast("string").alias("text")).alias("x"), F.col(conv_column).alias("_c"), F.col(turn_column).cast("long").alias("_t"))
    heads = keyed.groupBy("_c", "_t").agg(F.min(text).alias("said"))
    back = lambda k: heads.select("_c", (F.col("_t") + k).alias("_t"), F.col("said").alias(f"back{k}"))
    out = keyed.join(back(1), ["_c", "_t"], "left").join(back(2), ["_c", "_t"], "left")
    quote = lambda c, marks: F.concat(F.lit(marks), F.regexp_replace(c, "\n", "\n" + marks), F.lit("\n"))
    one, two, deep = quote("back1", "> "), quote("back2", "> "), quote("back2", "> > ")
    quoted = F.when(F.col("_t") % 3 == 1, one).when(F.col("_t") % 3 == 2, F.concat(F.coalesce(deep, F.lit("")), one)).otherwise(two)
    reply = F.when(quoted.isNotNull(), F.concat(quoted, F.lit("\n"), text)).otherwise(F.col("x.text"))
    return out.select(*[F.col("own").getField(c).alias(c) if c != text_column else reply.alias(c) for c in df.columns])


def linked(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", text_column: str = "text") -> DataFrame:
    """The rows with body (the text without quotes), n_quotes, max_level, reply_to, root, depth (0 for a root), quote_links and position."""
    messages = materialize(parsed(df, conv_column, turn_column, text_column), "messages")
    links = materialize(reply_links(passage_links(messages)), "replies")
    going = links.filter("reply is not null").select("_c", "_t", F.col("reply").alias("root"), F.lit(1).alias("depth"))
    settled, places = going.filter("false"), going
    while True:  # a place's root becomes its root's root, so chains halve; places that have their root drop out
        above = places.select("_c", F.col("_t").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        step = materialize(going.join(above, ["_c", "root"], "left"), "places")
        settled = settled.unionByName(step.filter("up is null").select("_c", "_t", "root", "depth"))
        going = step.filter("up is not null").select("_c", "_t", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        places = settled.unionByName(going)
        if going.isEmpty():
            break
    order = reading_order(messages.select("_c", "_t").distinct().join(links.select("_c", "_t", "reply"), ["_c", "_t"], "left"))
    out = messages.join(links, ["_c", "_t"], "left").join(places, ["_c", "_t"], "left").join(order, ["_c", "_t"])
    turn = lambda c: F.when(c != NULL_ID, c)
    return out.select("own.*", "body", "n_quotes", "max_level", turn(F.col("reply")).alias("reply_to"), turn(F.coalesce("root", "_t")).alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("quote_links", F.array().cast(links.schema["quote_links"].dataType)).alias("quote_links"), "position")
