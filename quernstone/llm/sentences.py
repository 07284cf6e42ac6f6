"""Sentence boundaries in any script, found by SQL expressions alone.

Full stops that end nothing (decimals, addresses of the web and of mail, initials,
abbreviations, list markers, ordinals, ellipses inside a sentence) are masked by
private-use characters, one for one, so offsets stay true. A mark is then set
after every terminator of the script at hand, the text is split at the marks, and
the masked characters are put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Placeholders: a full stop, a dot of an ellipsis, an ellipsis sign, a question mark; and the mark between sentences.
DOT, ELLIPSIS_DOT, ELLIPSIS, QUESTION, MARK = "\ue000", "\ue001", "\ue002", "\ue003", "\ue00f"

#: Abbreviations that a name, a number or the rest of a phrase follows.
LEADING = (
    "dr mr mrs ms prof hr fr frl sr sra srta srs dra mme mlle mm messrs dhr mevr mw ir drs st ste sta rev fig figs abb nr núm num pp pág pag págs vol kap cap "
    "art abs vs incl inkl exkl excl approx aprox env ca bzw sog ggf evtl vgl bijv bv resp ext ex exc max min tel dept gen col lt sgt capt gov sen rep hon av avda blvd z.b d.h u.a o.ä i.e e.g p.ex p.e v.a m.a.w डॉ श्री"
).split()
#: Abbreviations that can end a sentence: they do before a capital letter.
CLOSING = "etc usw ff jr sen lbs lb oz kg km cm mm min std hrs hr ft inc ltd co corp bros dept est a.m p.m u.s u.k e.u o.a u.s.w enz".split()
#: Short names of months, before a number.
MONTHS = "jan feb febr mar apr jun jul aug sep sept oct okt nov dec dez dic déc janv févr avr juil ene abr ago set out mrt".split()
#: What follows the full stop of an ordinal number.
AFTER_ORDINAL = (
    "januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep okt nov dez "
    "klasse stock stockwerk etage platz jahrhundert geburtstag bis und oder"
).split()

_SPACE = r"[ \t\x{A0}\x{202F}\x{3000}]"
_QUOTE = "\"'”“’‘›»«"
_BRACKET = ")\\]"
_STOP = r"[.!?…؟۔।॥]"
_CJK_STOP = "[。！？｡]"


def _any(words: list[str]) -> str:
    """Alternation of the words, longest first, their inner full stops already masked or not."""
    return "|".join(sorted((w.replace(".", f"[.{DOT}]{_SPACE}?") for w in words), key=len, reverse=True))


def masked(text: Column) -> Column:
    """``text`` with every full stop masked that ends nothing; the length is unchanged."""
    x = F.regexp_replace(text, r"[\x{E000}-\x{E00F}]", "\ufffd")
    # Every pattern starts with the character it masks and looks back from there, so nothing is tried at the other characters of a text.
    sub = lambda c, pattern: F.regexp_replace(c, pattern, DOT)
    # A full stop between letters or digits is none, unless a capital follows a small letter or a digit: there only the space is missing.
    x = sub(x, r"\.(?<=[\p{L}\p{N}]\.)(?=[\p{L}\p{N}])(?!(?<=[\p{Ll}\p{N}]{2}\.)\p{Lu}[\p{Ll} ])")
    x = F.regexp_replace(x, r"\?(?<=[\p{L}\p{N}/]\?)(?=[\p{L}\p{N}_]+=)", QUESTION)
    x = F.regexp_replace(x, rf"(?m)^(\s*\(?(?:[0-9]{{1,3}}|\p{{L}}))\.(?={_SPACE})", f"$1{DOT}")
    x = sub(x, rf"\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}{DOT}'’])[\p{{Lu}}b-df-hj-np-tv-xzدأم]\.)(?={_SPACE}+\S|,)")
    x = sub(x, rf"(?i)\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}{DOT}])(?:{_any(LEADING)})\.)(?={_SPACE}*\S)")
    x = sub(x, rf"(?i)\.(?<=(?<![\p{{L}}\p{{N}}{DOT}])(?:no|nos|p|s|ch|{_any(MONTHS)})\.)(?={_SPACE}*[0-9])")
    letters = r"\p{L}{1,3}"
    # What may close a sentence does not before a small letter or a number.
    x = sub(x, rf"\.(?<=(?<![\p{{L}}\p{{N}}{DOT}])(?:(?i:{_any(CLOSING)})|{"|".join(DOT.join([letters] * n) for n in (2, 3, 4))})\.)(?=[{_BRACKET}]?{_SPACE}+[\p{{Ll}}\p{{N}}])")
    x = sub(x, rf"(?i)\.(?<=(?<![\p{{L}}\p{{N}}])[0-9]{{1,2}}\.)(?={_SPACE}+(?:{_any(AFTER_ORDINAL)})(?![\p{{L}}\p{{N}}]))")
    x = F.regexp_replace(x, r"\.\.\.(?=\s*\p{Ll})", ELLIPSIS_DOT * 3)
    return F.regexp_replace(x, r"…(?=\s*\p{Ll})", ELLIPSIS)


def _marked(x: Column) -> Column:
    """A mark after the last character of every sentence, and after line ends."""
    sub = lambda c, pattern: F.regexp_replace(c, pattern, f"$1{MARK}")
    x = sub(x, rf"({_STOP}+)(?=\s)(?!{_SPACE}[»›])")
    # Closing quotes and brackets belong to the sentence; a small letter after them goes on with it.
    x = sub(x, rf"({_STOP}+(?:{_SPACE}?[»›]|[{_QUOTE}{_BRACKET}]+))(?=\s+[^\s\p{{Ll}}])")
    # A bracket that ends with a full stop holds a sentence of its own.
    x = sub(x, rf"(\.[{_BRACKET}]+)(?=\s+\p{{Ll}})")
    x = sub(x, rf"({_STOP}+[{_BRACKET}]?)(?=\p{{Lu}}[\p{{Ll}} ])")
    x = sub(x, rf"({_CJK_STOP}+[）】)\]]*)(?![”’」』）】》\"'。！？｡)\]]|\s)")
    x = sub(x, rf"({_CJK_STOP}+[”’」』\"']+[）】)]*)(?=[“‘「『（]|\s+[^\s\p{{Ll}}])")
    x = sub(x, rf"({_CJK_STOP}+[）】)\]]*)(?=\s)")
    # Thai parts sentences by spaces; spaces around numbers and signs part nothing.
    x = sub(x, rf"(?<=[\x{{0E00}}-\x{{0E3F}}\x{{0E40}}-\x{{0E4E}}&&[^\x{{0E46}}]])({_SPACE}+)(?=[\x{{0E01}}-\x{{0E45}}]|\p{{Lu}}\p{{Ll}}+{_SPACE}+\p{{Ll}})")
    return sub(x, r"(\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}])")


def restored(x: Column) -> Column:
    """The masked characters put back."""
    return F.translate(x, DOT + ELLIPSIS_DOT + ELLIPSIS + QUESTION, "..…?")


#: White space of any script, dropped at the ends of a sentence.
_EDGE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


#: Pieces whose offsets are summed in one go; bounds what a long text costs.
GROUP = 64


def _running(numbers: Column, start: Column) -> Column:
    """For each number, ``start`` plus the sum of those before it."""
    begin = F.struct(F.array().cast("array<int>").alias("at"), start.cast("int").alias("end"))
    return F.aggregate(numbers, begin, lambda s, n: F.struct(F.concat(s["at"], F.array(s["end"])).alias("at"), (s["end"] + n).alias("end")), lambda s: s["at"])


def starts_of(sizes: Column) -> Column:
    """Where each of the pieces of these sizes begins, when they stand one after the other; by groups, so that long arrays stay cheap."""
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / F.lit(GROUP)).cast("int") - 1), lambda g: F.slice(sizes, g * GROUP + 1, F.lit(GROUP)))
    total = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda s, n: s + n))
    return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), _running(total, F.lit(0)).alias("s")), lambda x: _running(x["g"], x["s"])))


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per sentence: ``id``, ``sentence_no`` (from 1), ``start_pos``, ``end_pos``, ``sentence``.

    Offsets are code points from 0, the end exclusive, without outer white space.
    Lines end sentences, so headings, list lines and unpunctuated lines are
    sentences of their own; blank ones give none. Null texts and ids give no rows,
    an empty table none. A row met repeatedly gives its sentences as often. Texts
    are used whole. Characters U+E000 to U+E00F of the source come out as U+FFFD in
    ``sentence``; their offsets are true.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    # Marks take no room in the text: a piece begins where those before it end, which each row sums up for itself.
    pieces = rows.select("id", F.split(_marked(masked(F.col("t"))), MARK, -1).alias("pieces"))
    # The sizes stand in a column of their own: inside the groups' lambda they would be made anew for every group.
    sized = pieces.select("id", "pieces", F.transform("pieces", lambda p: F.length(p)).alias("sizes"))
    placed = sized.select("id", "pieces", starts_of(F.col("sizes")).alias("start"))
    cut = F.transform(
        F.arrays_zip("pieces", "start"),
        lambda x: F.struct(
            (x["start"] + F.length(x["pieces"]) - F.length(F.ltrim(x["pieces"], F.lit(_EDGE)))).alias("start_pos"), F.trim(x["pieces"], F.lit(_EDGE)).alias("body")
        ),
    )
    found = placed.select("id", F.posexplode(F.filter(cut, lambda x: x["body"] != "")).alias("n", "s"))
    return found.select(
        "id",
        (F.col("n") + 1).alias("sentence_no"),
        F.col("s.start_pos").alias("start_pos"),
        (F.col("s.start_pos") + F.length("s.body")).alias("end_pos"),
        restored(F.col("s.body")).alias("sentence"),
    )
