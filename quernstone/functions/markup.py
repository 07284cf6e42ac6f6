"""What stands around or inside free text and page markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import without_html

#: An address of mail inside text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def contexts(text: Column, pattern: str, before: int = 80, after: int = 120) -> Column:
    """Every match of ``pattern`` in order, with up to ``before`` and ``after`` characters around it: array of structs ``found, place, context``.

    Places are counted from 1. Cutting the text at its matches gives the places, so
    equal matches keep theirs. Null text gives an empty array.
    """
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)
    between = F.transform(F.split(t, pattern, -1), lambda p: F.length(p))
    # The n-th match begins after n pieces between matches and n - 1 matches.
    begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("end"))
    step = lambda s, x: F.struct(F.concat(s["at"], F.array(s["end"] + x["gap"])).alias("at"), (s["end"] + x["gap"] + F.length(x["f"])).alias("end"))
    places = F.aggregate(F.arrays_zip(found.alias("f"), F.slice(between, F.lit(1), F.size(found)).alias("gap")), begin, step, lambda s: s["at"])
    return F.transform(
        F.arrays_zip(found.alias("f"), places.alias("p")),
        lambda x: F.struct(
            x["f"].alias("found"), x["p"].alias("place"), F.substring(t, F.greatest(x["p"] - before, F.lit(1)), F.length(x["f"]) + after + F.least(x["p"] - 1, F.lit(before))).alias("context")
        ),
    )


def snippet(text: Column, word: Column, reach: int = 60) -> Column:
    """The text around the first place of ``word``, letter case aside, line breaks as spaces; empty where it is not found."""
    at = F.instr(F.lower(text), F.lower(word))
    cut = F.substring(text, F.greatest(at - reach, F.lit(1)), F.length(word) + reach + F.least(at - 1, F.lit(reach)))
    return F.when((at > 0) & (F.length(word) > 0), F.trim(F.translate(cut, "\n\r", "  "))).otherwise(F.lit(""))


def invented(handle: Column, text: Column, network: str = "insta") -> Column:
    """Whether a handle is an artifact of its extraction: not literally in the text, or a name of another network by the 100 characters around it."""
    low, core = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.regexp_replace(handle, "^@+", ""))
    at = F.instr(low, core)
    around = F.substring(low, F.greatest(at - 100, F.lit(1)), F.length(core) + 100 + F.least(at - 1, F.lit(100)))
    return F.when(handle.startswith("@"), (at == 0) | around.contains(network)).otherwise(F.instr(low, F.lower(handle)) == 0)


def page_description(html: Column) -> Column:
    """The description a page gives of itself, else the text of its main part, article or body; empty where there is none."""
    meta = F.regexp_extract(html, r"(?is)<meta[^>]*property=[\"']og:description[\"'][^>]*>", 0)
    own = F.regexp_extract(meta, r"(?is)content=[\"']([^\"']*)[\"']", 1)
    part = lambda tag: without_html(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))
    first = [F.nullif(x, F.lit("")) for x in (own, part("main"), part("article"), part("body"))]
    return F.coalesce(*first, F.lit(""))


def link_targets(html: Column) -> Column:
    """The absolute link targets of a page, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=[\"'](https?://[^\"']+)[\"']"), 1)


def legacy_name_key(name: Column, least: int = 3) -> Column:
    """A name out of its printed record if need be, in lower case, letters and digits only, white space collapsed; null when shorter than ``least``."""
    t = F.trim(name)
    inner = F.regexp_extract(t, r"['\"]name['\"]\s*:\s*['\"](.+?)['\"]\s*[,}]", 1)
    plain = F.when(t.startswith("{") & (inner != ""), inner).otherwise(t)
    key = F.regexp_replace(F.regexp_replace(F.trim(F.lower(plain)), r"[^a-z0-9\s]", ""), r"\s+", " ")
    return F.when(~F.lower(F.trim(plain)).isin("", "nan", "none", "null", "n/a", "na") & (F.length(key) >= least), key)


# Signs of money and the currencies they tell; the dollar sign alone tells none.
CURRENCY_OF_SIGN = {
    "US$": "USD", "CA$": "CAD", "AU$": "AUD", "NZ$": "NZD", "HK$": "HKD", "SG$": "SGD", "€": "EUR", "£": "GBP", "¥": "JPY", "₱": "PHP", "₹": "INR", "₩": "KRW", "₪": "ILS", "฿": "THB", "₫": "VND",
    "₦": "NGN", "₴": "UAH",
}
SIGN = r"(?:US\$|CA\$|AU\$|NZ\$|HK\$|SG\$|\$|€|£|¥|₱|₹|₩|₪|฿|₫|₦|₴)"
# How widgets word what was raised, asked for and given.
RAISED_OF_GOAL = rf"(?i)({SIGN})\s*([\d,]+(?:\.\d+)?)\s+raised\s+of\s+(?:{SIGN})?\s*([\d,]+(?:\.\d+)?)\s+goal"
DONATED = rf"(?i)({SIGN})\s*([\d,]+(?:\.\d+)?)\s+Donated\s+So\s+Far"
DONORS = r"(?i)\b(\d{1,5})\s+Donors?\b"


def widget_amounts(text: Column) -> Column:
    """Struct of ``goal``, ``raised``, ``currency`` and ``donors`` from a widget's wording; null where it says nothing or the sign tells no currency."""
    number = lambda p, i: F.nullif(F.regexp_replace(F.regexp_extract(text, p, i), ",", ""), F.lit("")).try_cast("double")
    whole = F.regexp_extract(text, RAISED_OF_GOAL, 0) != ""
    sign = F.upper(F.when(whole, F.regexp_extract(text, RAISED_OF_GOAL, 1)).otherwise(F.regexp_extract(text, DONATED, 1)))
    currencies = F.create_map(*[F.lit(x) for kv in CURRENCY_OF_SIGN.items() for x in kv])
    return F.struct(
        number(RAISED_OF_GOAL, 3).alias("goal"),
        F.when(whole, number(RAISED_OF_GOAL, 2)).otherwise(number(DONATED, 2)).alias("raised"),
        F.element_at(currencies, sign).alias("currency"),
        F.nullif(F.regexp_extract(text, DONORS, 1), F.lit("")).try_cast("int").alias("donors"),
    )


# Public facts of the numbering plan: calling code and least and greatest number of national digits by region.
NUMBERING = {
    "US": ("1", 10, 10), "CA": ("1", 10, 10), "GB": ("44", 9, 10), "DE": ("49", 6, 11), "FR": ("33", 9, 9), "ES": ("34", 9, 9), "IT": ("39", 6, 11), "NL": ("31", 9, 9), "BE": ("32", 8, 9),
    "CH": ("41", 9, 9), "AT": ("43", 6, 12), "PT": ("351", 9, 9), "AU": ("61", 9, 9), "BR": ("55", 10, 11), "JP": ("81", 9, 10), "IN": ("91", 10, 10), "CN": ("86", 10, 11), "MX": ("52", 10, 10),
    "SE": ("46", 7, 9), "PL": ("48", 9, 9),
}


def e164(phone: Column, regions: Column) -> Column:
    """``+`` and digits: a number written with its country's code (after ``+``, ``00`` or nothing), else a national one of the first of ``regions`` that its length fits.

    Only calling codes and lengths of NUMBERING are known; nothing else of the number plans is checked.
    """
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    codes = "|".join(f"{code}[0-9]{{{lo},{hi}}}" for code, lo, hi in sorted(set(NUMBERING.values())))
    full = lambda d: F.nullif(F.regexp_extract(d, rf"^(?:{codes})$", 0), F.lit(""))
    national = F.regexp_replace(digits, "^0+", "")
    plan = F.create_map(*[x for r, (code, lo, hi) in NUMBERING.items() for x in (F.lit(r), F.struct(F.lit(code).alias("code"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    tried = F.transform(regions, lambda r: F.element_at(plan, r))
    fits = F.filter(tried, lambda p: p.isNotNull() & F.length(national).between(p["lo"], p["hi"]))
    local = F.when(F.size(fits) > 0, F.concat(F.get(fits, F.lit(0))["code"], national))
    written = F.when(digits.startswith("00") & (F.length(digits) >= 10), full(F.substring(digits, 3, 30)))
    return F.when(F.length(digits) >= 7, F.concat(F.lit("+"), F.coalesce(written, full(digits), local)))
