"""Narrations: the rail, the parts and the counterparty, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .bind import bind

#: Rails with their keywords in order of precedence, patterns, words that name no one.
CHANNELS = (
    ("upi", ("upi",)),
    ("imps", ("imps",)),
    ("neft", ("neft",)),
    ("rtgs", ("rtgs",)),
    ("ach", ("ach", "nach", "ecs", "si ", "mandate")),
    ("atm", ("atm", "awb", "nwd", "cash wdl")),
    ("pos", ("pos", "vps", "ipos")),
    ("card", ("cc ", "card", "ecom")),
    ("cheque", ("chq", "cheque", "clg")),
    ("interest", ("int.pd", "int pd", "interest", "credit interest")),
    ("charges", ("chrg", "charges", "fee", "gst", "amb ", "sms alert")),
)
VPA = r"(?iU)\b([\w.\-]{2,})@([a-z]{2,})\b"
IFSC = r"(?i)^[A-Z]{4}0[A-Z0-9]{6}$"
REFERENCE = r"(?iU)^[A-Z]{0,4}\d{6,}$"
NOISE = tuple("""upi imps neft rtgs ach nach ecs pos atm wdl awb nwd chq clg p2m p2a dr cr d c payment paymen pay txn ref refno
to from by transfer trf inb sent recd received collect req mandate si ecom card vps ipos in india ltd limited""".split())


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def detect_channel(text: Column) -> Column:
    """The first rail one of whose keywords starts the first 24 characters or follows a space in them."""


    def first(head: Column) -> Column:
        out = F
        for name, keywords in CHANNELS:
            hit = F.lit(False)
            for keyword in keywords:
                hit = hit | head.contains(f" {keyword}")
            out = out.when(hit, name)
        return out.otherwise("unknown")

    return bind(F.concat(F.lit(" "), F.substring(F.lower(text), 1, 24)), first)


def is_identity(segment: Column) -> Column:
    words = F.filter(F.split(F.lower(segment), r"\s+"), lambda w: w != "")
    return segment.rlike(r"\p{IsAlphabetic}") & ~segment.rlike(IFSC) & ~segment.rlike(REFERENCE) & ~segment.rlike(VPA) & (F.size(F.array_except(words, F.array(*map(F.lit, NOISE)))) > 0)


def parse_narration(raw: Column) -> Column:
    """struct(channel, counterparty, vpa, handle, reference)."""

    def read(rows: Column) -> Column:
        paid = F.get(F.filter(rows, lambda r: r["vpa"]), F.lit(0))
        before = F.filter(rows, lambda r: r["who"] & (r["i"] < F.coalesce(paid["i"], F.lit(-1))))
        named = F.transform(F.filter(rows, lambda r: r["who"]), lambda r: F.struct(F.length(r["x"]).alias("n"), (-r["i"]).alias("i"), r["x"].alias("x")))
        reference = F.get(F.filter(rows, lambda r: r["x"].rlike(REFERENCE) & ~r["x"].rlike(IFSC)), F.lit(0))["x"]
        return F.struct(
            F.coalesce(F.get(before, F.size(before) - 1)["x"], F.array_max(named)["x"], F.lit("")).alias("counterparty"),
            F.lower(F.nullif(F.regexp_extract(paid["x"], VPA, 0), F.lit(""))).alias("vpa"),
            F.lower(F.nullif(F.regexp_extract(paid["x"], VPA, 1), F.lit(""))).alias("handle"),
            reference.alias("reference"),
        )

    def parts(text: Column) -> Column:
        segments = F.filter(F.transform(F.split(text, r"[/\-|]+"), lambda s: F.trim(s)), lambda s: s != "")
        rows = F.transform(segments, lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(VPA).alias("vpa"), is_identity(x).alias("who")))
        return bind(bind(rows, read), lambda found: F.struct(detect_channel(text).alias("channel"), *(found[n].alias(n) for n in ("counterparty", "vpa", "handle", "reference"))))

    return bind(collapse(F.coalesce(raw, F.lit(""))), parts)
