"""Tables of questions in English, or of queries as JSON that a model wrote, as queries and their figures.

Texts are read by Column expressions; names are found by joins on keys that text and name share, strangers by an
anti join with the ledger's words. Equal texts are read once and equal queries computed once. Figures come from
the ledger summed by day, so a query meets a row for each day of its merchant or category, not each transaction.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.bind import bind
from ..operators import patterns
from ..session import written
from .query import READS, TOP, Answer, Period, Query, run

#: What names an intent, in order of precedence; words of income; month words and those that are also others; ordinary words.
INTENTS = (
    ("refunds", r"\brefund|money back|got it back\b"),
    ("recurring", r"\bsubscription|recurring|every month|regular(ly)?\b"),
    ("duplicates", r"\btwice|duplicate|double[- ]?charg|charged again\b"),
    ("top", r"\bbiggest|largest|top\b|\bmost\b"),
    ("count", r"\bhow many|how often|how frequently\b"),
    ("total", r"\bhow much|total|spend|spent|pay|paid|paying|cost\b"),
)
INCOME = r"\b(received?|income|earn(ed)?|paid me|credited)\b"
MONTHS = {name.lower(): k for k in range(1, 13) for name in (calendar.month_name[k], calendar.month_abbr[k])}
UNSURE_MONTHS = ("may", "march", "august", "mar", "aug")
BEFORE_MONTH = ("in", "during", "for", "of", "from", "since", "through", "until", "till", "by", "to", "and")
SIDES = {"debit": "debit", "out": "debit", "spent": "debit", "credit": "credit", "in": "credit", "received": "credit"}
ORDINARY = """a an and any anything all am are as at average be been biggest bill bills but by can card cards cash cost costs could
credited date dates day days debited did do does doing done each earn earned every everything expense expenses find for from get got
give given had has have her here him his how i in income into is it its largest last least list many may me might money month months
most much must my myself next nothing of often on or order ordered our out paid pay paying please received receive recurring refund
refunds rs rupees inr send sent shall should show smallest so some something spend spending spent statement statements subscription
subscriptions such tell than that the their them then there these they this those time times to top total totals transaction
transactions transfer transferred us was we week weeks were what when where which who why will with would year years you your duplicate
duplicates charge charged charges account accounts bank upi""".split()
WORD = r"[A-Za-z][A-Za-z0-9.&'-]+"
CANNOT = "I can answer totals, counts, largest spends, refunds, duplicates and subscriptions."
TOKEN = r"(?U)\w+|[^\w\s]"
GRAM = 4
QUERY = ["intent", "merchant", "category", "start", "end", "direction", "on_card"]
GUARDED = ("total", "count", "top")


def tokens(text: Column) -> Column:
    """Words, and other signs one by one, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def period(text: Column, as_of: Column) -> Column:
    """struct<start, end> that a text names, or null. Relative periods count from as_of, a ledger's last date, and so does a month without a year.

    Months stand in the order of their first mention. A word that is also another names a month only after a
    preposition or before the text's year. Months written backwards give an end before the start, which no row is in.
    """
    numbers = F.create_map(*(F.lit(x) for item in MONTHS.items() for x in item))
    year = F.nullif(F.regexp_extract(text, r"(?U)\b(20[0-9][0-9])\b", 1), F.lit(""))

    def named(words: Column) -> Column:
        pinned = lambda w, i: ~w.isin(*UNSURE_MONTHS) | F.coalesce(F.get(words, i - 1).isin(*BEFORE_MONTH), F.lit(False)) | F.coalesce(F.get(words, i + 1) == year, F.lit(False))
        found = F.filter(F.transform(words, lambda w, i: F.struct(F.try_element_at(numbers, w).alias("m"), pinned(w, i).alias("sure"))), lambda x: x["m"].isNotNull())
        return bind(found, lambda f: F.array_distinct(F.transform(F.filter(f, lambda x: F.exists(f, lambda y: y["sure"] & (y["m"] == x["m"]))), lambda x: x["m"])))

    def span(months: Column) -> Column:
        of = F.coalesce(year.cast("int"), F.year(as_of))
        day = lambda m: F.make_date(of, m, F.lit(1))
        this = F.trunc(as_of, "month")
        out = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        whole = lambda first: out(first, F.last_day(first))
        return (
            F.when(F.size(months) > 0, out(day(F.get(months, F.lit(0))), F.last_day(day(F.element_at(months, -1)))))
            .when(F.lower(text).rlike(r"\blast month\b"), whole(F.add_months(this, -1)))
            .when(F.lower(text).rlike(r"\bthis month\b"), whole(this))
            .when(year.isNotNull(), out(F.make_date(of, F.lit(1), F.lit(1)), F.make_date(of, F.lit(12), F.lit(31))))
        )

    return F.when(as_of.isNotNull(), bind(bind(tokens(text), named), span))


def label(start: Column, end: Column) -> Column:
    """A period as a reader names it: months by name, a whole year by its number, others by their days."""
    months = (F.day(start) == 1) & (end == F.last_day(end)) & (F.year(start) == F.year(end))
    name = lambda c, form: F.date_format(c, form)
    return (
        F.when(months & (F.month(start) == 1) & (F.month(end) == 12), name(start, "yyyy"))
        .when(months & (F.month(start) == F.month(end)), name(start, "MMMM yyyy"))
        .when(months, F.concat(name(start, "MMMM"), F.lit(" to "), name(end, "MMMM yyyy")))
        .otherwise(F.concat(start.cast("string"), F.lit(" to "), end.cast("string")))
    )


def merchants_in(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """texts(text) -> (text, merchant): the longest name that a text holds, whole or by a first word of four letters or more; of equal ones the first by name. Names meet texts by their first GRAM letters."""
    low = F.lower("name")
    first = F.get(F.filter(F.split(low, r"\s+"), lambda w: w != ""), F.lit(0))
    names = ledger.select("name").distinct().select("name", low.alias("low"), first.alias("first")).filter("first is not null and not startswith(low, '(')").withColumn("gram", F.substring(F.ltrim("low"), 1, GRAM))
    size = F.length("text")
    long = sorted(r[0] for r in names.select(F.length("gram")).distinct().collect())  # GRAM values at most
    of = lambda t, k: F.transform(F.sequence(F.lit(1), F.length(t)), lambda p: F.substring(t, p, F.lit(k)))
    grams = bind(F.lower("text"), lambda t: F.array_distinct(F.concat(*(of(t, k) for k in long or [GRAM]))))
    met = texts.filter(size > 0).select("text", F.explode(grams).alias("gram")).join(names, "gram")
    hit = F.lower("text").contains(F.col("low")) | ((F.length("first") >= 4) & F.array_contains(tokens(F.col("text")), F.col("first")))
    return met.filter(hit).groupBy("text").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("merchant"))


def categories_in(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """texts(text) -> (text, category): the longest category that stands in a text as whole words."""
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " ")), F.lit(" "))
    names = ledger.select("category").distinct().filter("category <> 'uncategorised'").select("category", F.get(tokens(F.col("category")), F.lit(0)).alias("token"), plain(F.col("category")).alias("padded"))
    met = texts.select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(names, "token").filter(plain(F.col("text")).contains(F.col("padded")))
    return met.groupBy("text").agg(F.min_by("category", F.struct(-F.length("category"), "category")).alias("category"))


def strangers(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """texts(text) -> (text, strange): words that are neither ordinary nor months nor words of a name or a category, in order."""
    words = texts.select("text", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("at", "raw")).select("text", "at", F.regexp_replace(F.lower("raw"), "^[.,']+|[.,']+$", "").alias("word"))
    words = words.filter((F.col("word") != "") & ~F.col("word").isin(*ORDINARY, *MONTHS)).groupBy("text", "word").agg(F.min("at").alias("at"))
    known = ledger.select(F.explode(F.array("name", "category")).alias("x")).distinct().select(F.explode(F.split(F.lower("x"), r"\s+")).alias("word")).distinct()
    left = words.join(known, "word", "left_anti")
    return left.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("strange"))


def masked(queries: DataFrame) -> DataFrame:
    """Fields that a query's intent doesn't read are null."""
    reads = F.create_map(*(F.lit(x) if isinstance(x, str) else x for k, fields in READS.items() for x in (k, F.array(*map(F.lit, fields)).cast("array<string>"))))
    field = lambda c: {"start": "period", "end": "period"}.get(c, c)
    return queries.withColumns({c: F.when(F.array_contains(F.try_element_at(reads, F.col("intent")), field(c)), F.col(c)) for c in QUERY[1:]})


def read(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """questions(text, ...) with a query's fields and strange. intent is null where a text is no question that is taken, or the ledger has no rows."""
    texts = written(questions.select("text").distinct().filter("text is not null"), "texts")
    as_of, cards = ledger.agg(F.max("date"), F.max("on_card")).first()  # two values
    low, intent = F.lower(F.trim("text")), F
    for name, pattern in INTENTS:
        intent = intent.when(low.rlike(pattern), name)
    span = period(F.col("text"), F.lit(as_of).cast("date"))
    found = texts.select("text", (intent.otherwise(None) if as_of else F.lit(None).cast("string")).alias("intent"), bind(span, lambda p: p).alias("span"), F.when(low.rlike(INCOME), "credit").otherwise("debit").alias("side"), F.when(low.rlike(r"\bcards?\b") & F.lit(bool(cards)), True).alias("on_card"))
    found = found.withColumns({"start": F.col("span.start"), "end": F.col("span.end"), "direction": F.when(F.col("intent") == "top", "debit").otherwise(F.col("side"))})
    for more in (merchants_in(texts, ledger), categories_in(texts, ledger), strangers(texts, ledger)):
        found = found.join(more, "text", "left")
    # a merchant that was found answers for the text's other words
    guarded = F.col("intent").isin(*GUARDED) & (F.col("intent").isin("top") | F.col("merchant").isNull())
    found = found.withColumn("strange", F.when(guarded, F.col("strange")))
    return questions.join(masked(found).select("text", *QUERY, "strange"), "text", "left")


def figures(queries: DataFrame, ledger: DataFrame) -> DataFrame:
    """The distinct queries (columns QUERY, with a direction where the intent reads one) with amount and n."""
    asked = written(queries.select(*QUERY).filter("intent is not null").distinct().withColumn("q", F.xxhash64(F.to_json(F.struct(*QUERY)))), "queries")
    intents = {r["intent"] for r in asked.select("intent").distinct().collect()}  # six at most
    inside = lambda d: (F.col("start").isNull() | (F.col(d) >= F.col("start"))) & (F.col("end").isNull() | (F.col(d) <= F.col("end")))
    by_day = lambda *keys: ledger.groupBy("direction", "date", F.col("on_card").alias("card"), *keys).agg(F.sum("amount").alias("a"), F.count("*").alias("k"))
    fits = inside("date") & (F.col("on_card").isNull() | (F.col("on_card") == F.col("card")))
    summed = lambda df, *keys: df.groupBy("q", *keys).agg(F.sum("a").alias("a"), F.sum("k").alias("k"))
    parts = []
    if intents & {"total", "count"}:
        some = asked.filter("intent in ('total', 'count')")
        named = some.filter("merchant is not null").withColumnRenamed("category", "cat").join(by_day("name", "category").withColumnRenamed("name", "merchant"), ["direction", "merchant"]).filter(fits & (F.col("cat").isNull() | (F.col("cat") == F.col("category"))))
        kinds = some.filter("merchant is null and category is not null").join(by_day("category"), ["direction", "category"]).filter(fits)
        every = some.filter("merchant is null and category is null").join(by_day(), "direction").filter(fits)
        parts += [summed(x) for x in (named, kinds, every)]
    if "top" in intents:
        some = asked.filter("intent = 'top'")
        kinds = some.filter("category is not null").join(by_day("name", "category"), ["direction", "category"]).filter(fits)
        every = some.filter("category is null").join(by_day("name"), "direction").filter(fits)
        ranked = summed(kinds, "name").unionByName(summed(every, "name")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("a"), "name"))).filter(F.col("rank") <= TOP)
        parts.append(ranked.groupBy("q").agg(F.max("a").alias("a"), F.count("*").alias("k")))
    if "refunds" in intents:
        some, back = asked.filter("intent = 'refunds'"), patterns.refunds(ledger)
        day = lambda *keys: back.groupBy("credit_date", *keys).agg(F.sum("amount").alias("a"), F.count("*").alias("k"))
        named = some.filter("merchant is not null").join(day("name").withColumnRenamed("name", "merchant"), "merchant").filter(inside("credit_date"))
        every = some.filter("merchant is null").join(day().withColumn("intent", F.lit("refunds")), "intent").filter(inside("credit_date"))
        parts += [summed(named), summed(every)]
    for name, rows, column in (("recurring", lambda: patterns.recurring(ledger).filter("active"), "annualised"), ("duplicates", lambda: patterns.duplicates(ledger), "exposure")):
        if name in intents:
            one = rows().agg(F.sum(column).alias("a"), F.count("*").alias("k")).withColumn("intent", F.lit(name))
            parts.append(asked.join(one, "intent").select("q", "a", "k"))
    if not parts:
        return asked.select(*QUERY, F.lit(None).cast("long").alias("amount"), F.lit(0).cast("long").alias("n"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    amount = F.when(F.col("intent").isin("total", "top"), F.col("a")).otherwise(F.coalesce("a", F.lit(0).cast("long")))
    return asked.join(found, "q", "left").select(*QUERY, amount.alias("amount"), F.coalesce("k", F.lit(0).cast("long")).alias("n"))


def with_figures(queries: DataFrame, ledger: DataFrame) -> DataFrame:
    """queries(..., QUERY) with amount and n; those without an intent have none."""
    key = F.to_json(F.struct(*QUERY))
    found = figures(queries, ledger).select(key.alias("_q"), "amount", "n")
    return queries.withColumn("_q", F.when(F.col("intent").isNotNull(), key)).join(found, "_q", "left").drop("_q")


def answered(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """questions(text, ...) with QUERY, understood, refused array<string>, amount and n. A question with a word that the ledger doesn't know is refused, for without it the question would be another."""
    found = written(read(questions, ledger).withColumn("refused", F.coalesce("strange", F.array().cast("array<string>"))).drop("strange"), "questions")
    clear = found.filter("size(refused) = 0")
    out = with_figures(clear, ledger).unionByName(found.filter("size(refused) > 0"), allowMissingColumns=True)
    return out.withColumns({"understood": F.col("intent").isNotNull(), "n": F.coalesce("n", F.lit(0).cast("long"))})


def model_queries(answers: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers(answer_id, text) -> ((answer_id, QUERY, label), rejects (answer_id, field, reason)): every fault of an answer is a row, and an answer without any is a query.

    Text around the outermost object is let be; fields that the intent doesn't read are checked, then dropped.
    """
    v = F.try_parse_json(F.regexp_extract("text", r"(?s)\{.*\}", 0))
    part = lambda path, kind="string": F.try_variant_get("v", path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path, "variant")), F.lit("VOID"))
    given = lambda path: kind(path) != "VOID"
    text = lambda f: F.when(kind(f"$.{f}") == "STRING", F.nullif(F.trim(part(f"$.{f}")), F.lit("")))
    day = lambda f: F.when(part(f"$.period.{f}").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(part(f"$.period.{f}"), "yyyy-MM-dd"))
    side = F.create_map(*(F.lit(x) for item in SIDES.items() for x in item))
    rows = answers.select("answer_id", v.alias("v")).withColumn("shape", F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))).select(
        "answer_id", "v", F.col("shape").startswith("OBJECT").alias("is_object"),
        F.when(kind("$.intent") == "STRING", F.lower(part("$.intent"))).alias("intent"), text("merchant").alias("merchant"), text("category").alias("category"), day("start").alias("start"), day("end").alias("end"),
        F.when(given("$.direction"), F.try_element_at(side, F.lower(F.trim(part("$.direction"))))).otherwise("debit").alias("direction"),
        F.when((kind("$.on_card") == "BOOLEAN") & part("$.on_card", "boolean"), True).alias("on_card"),
        F.nullif(F.trim(part("$.period.label")), F.lit("")).alias("label"),
    )
    fault = lambda when, field, reason: F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(field).alias("field"), reason.alias("reason")))
    said = lambda words, path: F.concat(F.lit(words), F.coalesce(part(path), F.lit("")))
    reads = F.col("intent").isin(*READS)
    faults = F.when(~F.col("is_object"), F.array(F.struct(F.lit("answer").alias("field"), F.lit("not a JSON object").alias("reason")))).otherwise(F.array_compact(F.array(
        fault(~given("$.intent"), "intent", F.coalesce(F.nullif(F.trim(part("$.reason")), F.lit("")), F.lit("no intent"))),
        fault(given("$.intent") & ~F.coalesce(reads, F.lit(False)), "intent", said("no such intent: ", "$.intent")),
        fault(given("$.period") & (F.col("start").isNull() | F.col("end").isNull()), "period", F.lit("a period needs an ISO start and end")),
        fault(F.coalesce(F.col("end") < F.col("start"), F.lit(False)), "period", F.lit("the period ends before it starts")),
        fault(F.col("direction").isNull(), "direction", said("not a direction: ", "$.direction")),
    )))
    rows = written(rows.withColumn("faults", faults).drop("v", "is_object"), "answers")
    rejects = rows.select("answer_id", F.inline("faults"))
    for field, column in (("merchant", "name"), ("category", "category")):
        unknown = rows.filter(f"{field} is not null").join(ledger.select(F.col(column).alias(field)).distinct(), field, "left_anti")
        rejects = rejects.unionByName(unknown.select("answer_id", F.lit(field).alias("field"), F.concat(F.lit("nothing is called "), F.col(field), F.lit(" here")).alias("reason")))
    rejects = written(rejects, "rejects")
    good = rows.join(rejects.select("answer_id").distinct(), "answer_id", "left_anti")
    label_ = F.when(F.col("start").isNotNull(), F.coalesce("label", F.concat(F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"))))
    return masked(good.select("answer_id", *QUERY, "label")).withColumn("label", label_), rejects


# one question


def _query(row) -> Query | None:
    if row is None or row["intent"] is None:
        return None
    span = Period(row["start"], row["end"], row["label"]) if row["start"] is not None else None
    return Query(row["intent"], row["merchant"], row["category"], span, row["direction"], row["on_card"])


def _one(ledger: DataFrame, text: str, **more: str) -> DataFrame:
    return ledger.sparkSession.createDataFrame([(text, *more.values())], ["text", *more])


def _first(queries: DataFrame):
    return (queries if "label" in queries.columns else queries.withColumn("label", label(F.col("start"), F.col("end")))).first()


def parse(text: str, ledger: DataFrame) -> Query | None:
    """A question as a query, with the fields that its intent reads; None if it isn't one that is taken."""
    return _query(_first(read(_one(ledger, text), ledger)))


def ask(text: str, ledger: DataFrame) -> Answer:
    """Read, guard, run."""
    row = _first(read(_one(ledger, text), ledger))
    query = _query(row)
    if query is None:
        return Answer(None, None, 0, None, understood=False)
    return Answer(query, None, 0, None, refused=tuple(row["strange"])) if row["strange"] else run(ledger, query)


def from_json(text: str, ledger: DataFrame) -> tuple[Query | None, str | None]:
    """(query, None), or (None, why not)."""
    good, rejects = model_queries(_one(ledger, text, answer_id="0"), ledger)
    query = _query(_first(good))
    return (query, None) if query else (None, "; ".join(sorted(r["reason"] for r in rejects.collect())))


def from_json_and_run(text: str, ledger: DataFrame) -> Answer:
    query, reason = from_json(text, ledger)
    return run(ledger, query) if query else Answer(None, None, 0, None, understood=False, refused=(reason,))
