"""Money as a whole number of paise, in Column expressions. An amount that can't be read is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .bind import bind

#: Cells that mean absence, characters of placeholder runs, currency prefixes.
BLANKS = ("", "-", "--", ".", "nil", "n/a", "na", "none")
PLACEHOLDER = r"^[*#\-._ ]+$"
CURRENCY = r"(?:(?:₹|rs\.|rs|inr)\s*)"

_NUMBER = r"([, ]*\d[\d, ]*(?:\.[\d, ]+)?)"
_AMOUNT = rf"^{CURRENCY}*([+-]?)\s*{CURRENCY}*(?:\(\s*{CURRENCY}?{_NUMBER}\s*\)|{_NUMBER})\s*(cr|dr)?$"


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def parse_amount(text: Column) -> Column:
    """Paise of an Indian-format amount; null if it isn't one. A leading minus and parentheses toggle the sign, Dr sets it."""
    return _paise(_bare(text))


def _paise(bare: Column) -> Column:
    # one match gives all parts: sign, number in parentheses, number, side; a text that doesn't match stays whole
    parts = F.split(F.regexp_replace(bare, _AMOUNT, "$1\u0001$2\u0001$3\u0001$4"), "\u0001", -1)

    def read(p: Column) -> Column:
        bracketed = F.get(p, 1) != ""
        negative = F.when(F.get(p, 3) == "dr", ~bracketed).otherwise((F.get(p, 0) == "-") != bracketed)

        def paise(number: Column) -> Column:
            fraction = F.when(F.instr(number, ".") > 0, F.substring_index(number, ".", -1)).otherwise("")
            value = F.concat(F.substring_index(number, ".", 1), F.rpad(fraction, 2, "0")).try_cast("long")
            return F.when(number.rlike(r"^\d+(\.\d{1,2})?$"), F.when(negative, -value).otherwise(value))

        return F.when(F.size(p) == 4, bind(F.regexp_replace(F.concat(F.get(p, 1), F.get(p, 2)), "[, ]", ""), paise))

    return bind(parts, read)


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", "").rlike(PLACEHOLDER), F.lit(False))


def parse_optional_amount(text: Column) -> Column:
    """Like parse_amount; blank and placeholder cells are null as absence. See unreadable()."""
    return F.when(~_bare(text).isin(*BLANKS) & ~is_placeholder(text), parse_amount(text))


def reading(text: Column) -> Column:
    """struct<amount, bad>: parse_optional_amount() and unreadable() of a text at once."""

    def read(bare: Column) -> Column:
        absent = bare.isNull() | bare.isin(*BLANKS) | bare.rlike(PLACEHOLDER)
        return F.when(absent, F.struct(F.lit(None).cast("long").alias("amount"), F.lit(False).alias("bad"))).otherwise(bind(_paise(bare), lambda v: F.struct(v.alias("amount"), v.isNull().alias("bad"))))

    return bind(_bare(text), read)


def unreadable(text: Column) -> Column:
    """True where a cell holds something that isn't absence and isn't an amount."""
    return F.coalesce(~_bare(text).isin(*BLANKS) & ~is_placeholder(text) & parse_amount(text).isNull(), F.lit(False))


def format_paise(paise: Column) -> Column:
    """₹ with Indian grouping: the last three digits, then pairs."""
    whole, rest = F.abs(paise).cast("decimal(20,0)"), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0")
    body = F.floor(whole / 100).cast("string")
    head = F.regexp_replace(F.substring(body, F.lit(1), F.greatest(F.length(body) - 3, F.lit(0))), r"(?<=\d)(?=(\d{2})+$)", ",")
    grouped = F.when(F.length(body) > 3, F.concat(head, F.lit(","), F.right(body, F.lit(3)))).otherwise(body)
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), rest)


def rupees(paise: Column) -> Column:
    """Exact decimal rupees, for export only."""
    return (paise.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def signed(direction: Column, amount: Column) -> Column:
    return F.when(direction == "credit", amount).otherwise(-amount)
