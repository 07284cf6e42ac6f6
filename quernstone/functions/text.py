"""Free text, money, dates and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings that lead a donor away from the platform. One pattern counts once.
PAYMENT_WORDINGS = {
    "hr_paypal_me": r"(?i)\bpaypal\.me/[\w\-.]+",
    "hr_venmo_handle": r"(?i)(?<!\w)@[\w.-]{3,30}\b.{0,80}\bvenmo\b|\bvenmo[: ]+@?[\w.-]{3,30}",
    "hr_cashapp_tag": r"(?i)\$[A-Z]\w{2,20}\b.{0,80}\bcash\s?app\b|\bcash\s?app[: ]+\$?\w{3,20}",
    "hr_zelle": r"(?i)\bzelle\b.{0,40}\b(?:\d{10}|[\w.+-]+@[\w.-]+)",
    "hr_iban_literal": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",
    "hr_btc_literal": r"\b(?:bc1[ac-hj-np-z02-9]{8,87}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "hr_eth_literal": r"\b0x[a-fA-F0-9]{40}\b",
    "hr_wire_transfer": r"(?i)\bwire\s+transfer\b|\bwire\s+the\s+(?:money|funds|amount)\b",
    "hr_western_union": r"(?i)\bwestern\s*union\b",
    "hr_moneygram": r"(?i)\bmoneygram\b",
    "hr_dm_for_payment": r"(?i)\b(?:dm|pm|message|email)\s+me\b[^.]{0,40}\b(?:donate|payment|account|details|info)\b",
    "hr_telegram_pivot": r"(?i)\btelegram\b.{0,40}@[\w.]{3,30}|t\.me/[\w.]{3,30}",
    "hr_whatsapp_pivot": r"(?i)\bwhatsapp\b.{0,40}(?:\+?\d{7,15}|@[\w.]{3,30})",
    "hr_signal_pivot": r"(?i)\bsignal\b.{0,40}\+?\d{7,15}",
    "hr_send_directly": r"(?i)\b(?:send|prefer)\b[^.]{0,40}\b(?:directly|outside)\b[^.]{0,40}\b(?:account|paypal|venmo|cash\s?app|zelle)\b",
    "hr_contact_for_info": r"(?i)\bcontact\s+(?:me|us)\b[^.]{0,40}\b(?:account|payment|details|info|verify|proof)\b",
}
# Words of urgency and of deadlines.
EMERGENCY = r"(?i)\b(?:urgent(?:ly)?|emergency|dying|critical(?:ly)?|asap|immediate(?:ly)?|dire|crisis|life[\s-]?threatening|terminal(?:ly)?|please\s+help|save\s+(?:me|us|him|her))\b"
DEADLINE = (
    r"(?i)\b(?:deadline|last\s+(?:day|chance|hours?)|final\s+hours?|by\s+(?:friday|monday|tuesday|wednesday|thursday|saturday|sunday)|expires?\s+(?:today|tomorrow|soon)|"
    r"running\s+out\s+of\s+time|time\s+is\s+running\s+out|only\s+\d+\s+days?\s+left)\b"
)
# The function words of a writing style, and its pronouns.
STYLE_WORDS = ("a", "and", "for", "i", "in", "is", "it", "me", "my", "of", "our", "that", "the", "they", "this", "to", "we", "with", "you")
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
THIRD_PERSON = ("he", "she", "they", "him", "her", "them", "his", "hers", "theirs")
# Characters that html writes as entities.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
#: Words that stand for a missing value.
NOTHING = ("", "none", "null", "nan", "n/a", "na", "-", "--", "unknown", "undefined")


def wording_hits(text: Column) -> Column:
    """The number of different payment wordings met in a text; null text has none."""
    t = F.coalesce(text, F.lit(""))
    return sum((t.rlike(p).cast("int") for p in PAYMENT_WORDINGS.values()), F.lit(0))


def unescaped(text: Column) -> Column:
    """Common html entities put back; the ampersand last, so nothing is unescaped twice."""
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def without_html(text: Column) -> Column:
    """Tags dropped, entities unescaped, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(text, "<[^>]+>", " ")), r"[\s\x{A0}]+", " "))


def with_link_targets(html: Column) -> Column:
    """Tags dropped, but links kept as ``label [target]`` for http, mailto and tel."""
    linked = F.regexp_replace(html, r"(?is)<a\s[^>]*?href\s*=\s*[\"']((?:https?:|mailto:|tel:)[^\"']*)[\"'][^>]*>(.*?)</a>", "$2 [$1]")
    return without_html(linked)


def text_features(text: Column) -> Column:
    """Struct of counts over a text without tags: characters, upper-case share, exclamations, urgency and deadline words."""
    t = unescaped(F.regexp_replace(text, "<[^>]+>", " "))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    share = F.when(letters > 0, F.bround(F.regexp_count(t, F.lit(r"\p{Lu}")) / letters, 4)).otherwise(F.lit(0.0))
    return F.struct(
        F.length(t).alias("char_count"),
        share.alias("uppercase_ratio"),
        F.regexp_count(t, F.lit("!")).alias("exclamation_count"),
        F.regexp_count(t, F.lit(EMERGENCY)).alias("emergency_keyword_count"),
        F.regexp_count(t, F.lit(DEADLINE)).alias("deadline_keyword_count"),
    )


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def style_vector(text: Column) -> Column:
    """Unit vector of writing habits; null for texts of under 50 characters or 30 words."""
    sentences = F.filter(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s) != "")
    mean_length = let(sentences, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))) / F.size(s))
    rate = lambda x: x / F.greatest(F.length(text), F.lit(1))

    def raw(words: Column) -> Column:
        n = F.size(words)
        count_of = lambda *w: F.size(F.filter(words, lambda x: x.isin(*w)))
        pronouns = let(F.struct(count_of(*FIRST_PERSON).alias("first"), count_of(*THIRD_PERSON).alias("third")), lambda p: p["first"] / F.greatest(p["first"] + p["third"], F.lit(1)))
        return F.array(
            mean_length.cast("double"),
            (F.size(F.array_distinct(words)) / n).cast("double"),
            rate(F.regexp_count(text, F.lit("!"))),
            rate(F.regexp_count(text, F.lit(r"\.\.\."))),
            rate(F.regexp_count(text, F.lit(r"\?"))),
            rate(F.regexp_count(text, F.lit(r"\p{Lu}"))),
            pronouns.cast("double"),
            *[(count_of(w) / n).cast("double") for w in STYLE_WORDS],
        )

    def unit(v: Column) -> Column:
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(v, lambda x: x / norm))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    vector = let(words, lambda w: F.when((F.size(w) >= 30) & (F.size(sentences) > 0), let(raw(w), unit)))
    return F.when(F.length(text) >= 50, vector)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two number arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def present(text: Column) -> Column:
    """The trimmed text, or null where it is one of the words for nothing."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*NOTHING), t)


def amount(text: Column) -> Column:
    """The number in a money text, whether it groups by comma, dot, space or apostrophe; null where there is none.

    The last comma or dot is the decimal sign if one or two digits follow it and
    no other follows; signs, codes and words around the number are dropped.
    """
    t = F.regexp_extract(F.regexp_replace(present(text), r"[\s\x{A0}\x{202F}'’]", ""), r"-?[0-9][0-9.,]*", 0)
    decimal = t.rlike(r"[.,][0-9]{1,2}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_extract(t, r"^(.*)[.,][0-9]{1,2}$", 1)).otherwise(t), "[.,]", "")
    part = F.when(decimal, F.concat(F.lit("."), F.regexp_extract(t, r"([0-9]{1,2})$", 1))).otherwise(F.lit(""))
    return F.when(t != "", F.concat(whole, part).try_cast("double"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole elapsed days between two timestamps, never negative."""
    return F.greatest(F.timestamp_diff("DAY", start, end), F.lit(0))


def answer(text: Column) -> Column:
    """``yes``, ``no`` or ``unclear``."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.startswith("y"), F.lit("yes")).when(t.startswith("n"), F.lit("no")).otherwise(F.lit("unclear"))


def token_key(name: Column, least: int = 2) -> Column:
    """The words of a name of two letters or more, sorted and joined; null with fewer than ``least``. Repeated words stay."""
    words = F.array_sort(F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 2))
    return F.when(F.size(words) >= least, F.array_join(words, " "))


def pseudonym(value: Column, salt: str) -> Column:
    """Twelve hex digits of the salted hash of a value."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 12)


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each group of items equal but for case and outer space, in order; blanks dropped."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(kept, lambda x: F.lower(x))
    return F.filter(F.transform(kept, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
