"""Arrays and structs inside records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def appended_once(items: Column, value: Column) -> Column:
    """The array with ``value`` at its end, unless it is there already; a null array starts empty."""
    have = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(have, value), have).otherwise(F.array_append(have, value))


def starts_with_any(text: Column, beginnings: Sequence[str]) -> Column:
    """Whether a text, trimmed and in lower case, begins with one of ``beginnings``; null does not."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.exists(F.array(*[F.lit(b) for b in beginnings]), lambda b: F.startswith(t, b))


def boilerplate(text: Column, beginnings: Sequence[str], least: int = 4) -> Column:
    """Whether a phrase is too short to mean anything or begins like platform text."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < least) | starts_with_any(text, beginnings)


def found_in(items: Column, source: Column) -> Column:
    """The items that stand literally in ``source``, letter case aside: what an extractor made up is dropped."""
    return F.filter(items, lambda x: F.contains(F.lower(source), F.lower(F.trim(x))) & (F.trim(x) != ""))


def parted(items: Column, keep: Callable[[Column], Column]) -> Column:
    """Struct of ``kept`` and ``dropped`` items, each in order; an item on which ``keep`` is null is dropped."""
    sure = lambda x: F.coalesce(keep(x), F.lit(False))
    return F.struct(F.filter(items, sure).alias("kept"), F.filter(items, lambda x: ~sure(x)).alias("dropped"))


def united(first: Column, second: Column, key: Callable[[Column], Column]) -> Column:
    """Both arrays after one another, without items whose key came before; null arrays are empty ones."""
    both = F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array()))
    keys = F.transform(both, key)
    return F.filter(F.transform(both, lambda x, i: F.when(F.array_position(keys, key(x)) == i + 1, x)), lambda x: x.isNotNull())


def tagged(items: Column, name: str, flag: Callable[[Column], Column]) -> Column:
    """Structs ``value`` and flag ``name`` of every item."""
    return F.transform(items, lambda x: F.struct(x.alias("value"), F.coalesce(flag(x), F.lit(False)).alias(name)))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """Whether a text holds one of the markers, letter case aside; null holds none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(t, m))


def scrubbed(value: Column) -> Column:
    """The number, or null for not-a-number and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def humanized(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, or the code with blanks for underscores."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[code], F.replace(code, F.lit("_"), F.lit(" ")))


def sentence(*parts: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, joined by commas and ended by a full stop; empty where none holds."""
    text = F.concat_ws(", ", *[F.when(condition, part) for condition, part in parts])
    return F.when(text == "", text).otherwise(F.concat(text, F.lit(".")))
