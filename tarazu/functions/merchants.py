"""Merchants, categories and kinds of counterparties."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .bind import bind
from .narration import collapse, parse_narration

#: The lexicon by slug (name, category), hints, and the words and patterns of kinds.
LEXICON = {
    "swiggyinstamart": ("Swiggy Instamart", "groceries"), "swiggy": ("Swiggy", "food"), "zomato": ("Zomato", "food"), "zomatoltd": ("Zomato", "food"),
    "blinkit": ("Blinkit", "groceries"), "zepto": ("Zepto", "groceries"), "bigbasket": ("BigBasket", "groceries"), "licious": ("Licious", "groceries"), "dmart": ("DMart", "groceries"),
    "amazon": ("Amazon", "shopping"), "amazonpay": ("Amazon Pay", "shopping"), "flipkart": ("Flipkart", "shopping"), "myntra": ("Myntra", "shopping"), "myntradesigns": ("Myntra", "shopping"),
    "ajio": ("Ajio", "shopping"), "meesho": ("Meesho", "shopping"), "nykaa": ("Nykaa", "shopping"), "lenskart": ("Lenskart", "shopping"), "decathlon": ("Decathlon", "shopping"), "croma": ("Croma", "shopping"),
    "netflix": ("Netflix", "entertainment"), "netflixindia": ("Netflix", "entertainment"), "spotify": ("Spotify", "entertainment"), "hotstar": ("Disney+ Hotstar", "entertainment"),
    "bookmyshow": ("BookMyShow", "entertainment"), "pvr": ("PVR", "entertainment"), "youtube": ("YouTube", "entertainment"),
    "uber": ("Uber", "transport"), "ola": ("Ola", "transport"), "rapido": ("Rapido", "transport"),
    "irctc": ("IRCTC", "travel"), "makemytrip": ("MakeMyTrip", "travel"), "goibibo": ("Goibibo", "travel"), "oyo": ("OYO", "travel"), "indianoil": ("Indian Oil", "fuel"),
    "jio": ("Jio", "utilities"), "airtel": ("Airtel", "utilities"), "vodafone": ("Vi", "utilities"), "bescom": ("BESCOM", "utilities"),
    "pharmeasy": ("PharmEasy", "health"), "netmeds": ("Netmeds", "health"), "apollo": ("Apollo", "health"), "medplus": ("MedPlus", "health"), "practo": ("Practo", "health"), "cult": ("Cult.fit", "health"), "curefit": ("Cult.fit", "health"),
    "zerodha": ("Zerodha", "investments"), "groww": ("Groww", "investments"), "upstox": ("Upstox", "investments"), "smallcase": ("Smallcase", "investments"),
    "cred": ("CRED", "card bill"), "credclub": ("CRED", "card bill"), "razorpay": ("Razorpay", "uncategorised"), "billdesk": ("BillDesk", "utilities"),
}
HINTS = (
    ("salary", ("salary", "payroll", "stipend", "wages")),
    ("rent", ("rent", "housing", "apartments", "society", "maintenance", "landlord")),
    ("utilities", ("electricity", "bescom", "water", "broadband", "recharge", "postpaid")),
    ("investments", ("mutual", "sip", "nps", "ppf", "elss", "folio")),
    ("health", ("hospital", "clinic", "pharma", "medical", "diagnostics", "labs")),
    ("education", ("school", "college", "tuition", "academy", "institute")),
    ("fuel", ("petrol", "fuel", "petroleum", "hpcl", "bpcl")),
)
CHANNEL_CATEGORIES = {"atm": "cash", "charges": "fees", "interest": "interest", "cheque": "transfer"}
KIND_CATEGORIES = {"card bill": "card bill", "person": "transfer", "cash": "cash"}
ORGANISATIONS = tuple("""ltd limited pvt private inc llp opc co corp corporation company technologies technology solutions services
enterprises industries traders agencies store stores mart retail foods hotel hotels restaurant cafe bank finance capital securities
insurance hospital clinic pharmacy school college institute apartments society association builders developers""".split())
MASKED_CARD, PHONE_HANDLE = r"^\d{4,6}[xX*]{4,}\d{3,4}$", r"^(\+?91)?[6-9]\d{9}$"
UNCATEGORISED = "uncategorised"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _pairs(items: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in items.items() for x in pair))


def lexicon_entry(key: Column) -> Column:
    """struct(name, category), or null. The lexicon is a literal of fixed size, so no join is planned."""
    entries = F.create_map(*(x for k, (name, category) in LEXICON.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(category).alias("category")))))
    return F.try_element_at(entries, key)


def infer_category(raw: Column, channel: Column) -> Column:
    def of(low: Column) -> Column:
        out = F
        for category, keywords in HINTS:
            hit = F.lit(False)
            for keyword in keywords:
                hit = hit | low.contains(keyword)
            out = out.when(hit, category)
        return out.otherwise(F.coalesce(F.try_element_at(_pairs(CHANNEL_CATEGORIES), channel), F.lit(UNCATEGORISED)))

    return bind(F.lower(raw), of)


def classify(counterparty: Column, channel: Column, handle: Column) -> Column:
    def of(words: Column) -> Column:
        plain = F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike(r"^\p{IsAlphabetic}{2,}$"))
        return (
            F.when(F.replace(counterparty, F.lit(" "), F.lit("")).rlike(MASKED_CARD), "card bill")
            .when(channel.isin("charges", "interest"), "bank")
            .when(channel == "atm", "cash")
            .when(F.coalesce(handle.rlike(PHONE_HANDLE), F.lit(False)), "person")
            .when(F.arrays_overlap(words, F.array(*map(F.lit, ORGANISATIONS))), "unknown")
            .when(plain, "person")
            .otherwise("unknown")
        )

    return bind(F.filter(F.split(F.lower(counterparty), r"\s+"), lambda w: w != ""), of)


def identify(raw: Column, words: Column | None = None, parts: Column | None = None) -> Column:
    """struct(name, category, kind, source, channel, counterparty, vpa, handle, reference).

    words: the counterparty's words as the segmenter cut them; by default its words at spaces. parts: parse_narration()
    of raw, where it is known.
    """
    raw = F.coalesce(raw, F.lit(""))

    def label(n: Column) -> Column:
        cut = F.filter(F.split(n["counterparty"], r"\s+"), lambda w: w != "") if words is None else F.coalesce(words, F.array().cast("array<string>"))
        return bind(F.struct(n.alias("n"), cut.alias("cut")), look_up)

    def look_up(x: Column) -> Column:
        n, cut = x["n"], x["cut"]
        keys = ((n["counterparty"], "lexicon"), (n["handle"], "vpa"), (F.get(cut, F.lit(0)), "prefix"))
        tried = F.array(*(F.struct(lexicon_entry(slug(k)).alias("m"), F.lit(s).alias("s")) for k, s in keys))
        hit = F.get(F.filter(tried, lambda t: t["m"].isNotNull()), F.lit(0))
        return bind(hit, lambda h: bind(F.when(h.isNotNull(), F.when(h["m"]["category"] == "card bill", "card bill").otherwise("merchant")).otherwise(classify(n["counterparty"], n["channel"], n["handle"])), lambda kind: answer(n, cut, h, kind)))

    def answer(n: Column, cut: Column, hit: Column, kind: Column) -> Column:
        own = F.array_join(F.transform(cut, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
        name = F.coalesce(hit["m"]["name"], F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(raw), F.lit("")), F.lit("(no narration)"))
        first = F.coalesce(F.nullif(hit["m"]["category"], F.lit(UNCATEGORISED)), infer_category(raw, n["channel"]))
        category = bind(first, lambda c: F.when(c == UNCATEGORISED, F.coalesce(F.try_element_at(_pairs(KIND_CATEGORIES), kind), c)).otherwise(c))
        source = F.coalesce(hit["s"], F.when(F.size(cut) > 0, "segmented").otherwise("raw"))
        return F.struct(name.alias("name"), category.alias("category"), kind.alias("kind"), source.alias("source"), *(n[c].alias(c) for c in ("channel", "counterparty", "vpa", "handle", "reference")))

    return bind(parse_narration(raw) if parts is None else parts, label)


def confident(source: Column) -> Column:
    return source.isin("lexicon", "vpa", "prefix")


__all__ = ["LEXICON", "classify", "collapse", "confident", "identify", "infer_category", "lexicon_entry", "slug"]
