"""Title functions as Column expressions (Java regular expressions with Unicode classes; no UDF).

``nfkd`` is the one Arrow UDF: full compatibility decomposition for scripts that the Latin table doesn't cover.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import KEY_ARTICLES, PART_PATTERN, ROMAN_PATTERN, SHOWN_ARTICLES

_FOLDED = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x250)}
_ONE = {k: v for k, v in _FOLDED.items() if v != k and len(v) == 1}
_MANY = {k: v for k, v in _FOLDED.items() if len(v) > 1}
_PARENS = r"\([^()]*\)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it (a fold over one element keeps expressions small)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_accents(c: Column) -> Column:
    """Combining marks and the marks of precomposed Latin letters removed."""

    def spread(plain: Column) -> Column:
        out = plain
        for k, v in _MANY.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        return F.when(plain.rlike("[" + "".join(_MANY) + "]"), out).otherwise(plain)

    return let(F.translate(F.regexp_replace(c, r"\p{M}", ""), "".join(_ONE), "".join(_ONE.values())), spread)


def nfkd(c: Column) -> Column:
    """As strip_accents for every script: decomposes by compatibility and drops marks (Arrow, batch by batch)."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        s = s.str.normalize("NFKD")
        return s.map(lambda t: None if t is None else "".join(x for x in t if not unicodedata.combining(x)))

    return fold(c)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _words(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def _behind_comma(c: Column) -> tuple[Column, Column]:
    """(head, tail) around the last comma, trimmed; both empty without a comma."""
    parts = r"(?s)^(.*),([^,]*)$"
    return strip(F.regexp_extract(c, parts, 1)), strip(F.regexp_extract(c, parts, 2))


def norm_title(c: Column) -> Column:
    """The join key of a title: accents, case, ``&``, a trailing article and punctuation levelled. Null: empty."""

    def turned(s: Column) -> Column:
        head, tail = _behind_comma(s)
        return F.when(F.contains(s, F.lit(",")), let(tail, lambda t: F.when(t.isin(*KEY_ARTICLES), F.concat(t, F.lit(" "), head)).otherwise(s))).otherwise(s)

    plain = strip(F.lower(strip_accents(F.coalesce(c.cast("string"), F.lit("")))))
    return _words(let(F.replace(plain, F.lit("&"), F.lit(" and ")), turned))


def drop_leading_article(key: Column) -> Column:
    rest = F.regexp_extract(key, r"(?s)^[^ ]* (.+)$", 1)
    return let(rest, lambda r: F.when((r != "") & F.substring_index(key, " ", 1).isin(*KEY_ARTICLES), r).otherwise(key))


def title_keys(c: Column) -> Column:
    """Ordered distinct keys: the norm, and the norm without its leading article; none for an empty title."""
    return let(norm_title(c), lambda k: F.when(k == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(k, drop_leading_article(k)))))


def alternates(c: Column) -> Column:
    """Texts of the innermost parentheses, in order."""
    return F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1))


def title_variants(c: Column) -> Column:
    """Every key that a catalogue title answers to: outside its parentheses, each parenthesised alternate, the whole."""
    c = F.coalesce(c, F.lit(""))
    inner = F.transform(alternates(c), lambda x: title_keys(strip(F.regexp_replace(strip(x), r"(?i)^\s*(?:aka|a\.k\.a\.?)\s*", ""))))
    every = F.concat(title_keys(strip(F.regexp_replace(c, _PARENS, ""))), F.flatten(inner), title_keys(c))
    return F.array_distinct(F.filter(every, lambda k: k != ""))


def split_year(c: Column) -> tuple[Column, Column]:
    """(title, year) of ``Title (1999)``; without such an end the trimmed title and null."""
    whole, form = strip(F.coalesce(c, F.lit(""))), r"(?sU)^(.*?)\s*\((\d{4})\)\s*$"
    found = F.regexp_extract(whole, form, 2)
    title = F.when(found != "", F.regexp_extract(whole, form, 1)).otherwise(whole)
    return title, F.when(found != "", found.try_cast("int"))


def unrotate(c: Column) -> Column:
    """``Title, The`` to ``The Title``; an elided article joins without a space."""

    def turned(s: Column) -> Column:
        head, tail = _behind_comma(s)
        joint = lambda t: F.when(F.endswith(t, F.lit("'")) | F.endswith(t, F.lit("’")), F.lit("")).otherwise(F.lit(" "))
        return let(tail, lambda t: F.when(F.lower(t).isin(*SHOWN_ARTICLES), F.concat(t, joint(t), head)).otherwise(s))

    return let(c, lambda s: F.when(F.contains(s, F.lit(",")), turned(s)).otherwise(s))


def simplify(c: Column) -> Column:
    return _words(F.lower(F.regexp_replace(c, _PARENS, " ")))


_PART, _ROMAN = "(?iU)" + PART_PATTERN, "(?iU)" + ROMAN_PATTERN


def strip_parts(c: Column) -> Column:
    """Struct (title, marked): the title without its part marker, and whether it had one. Titles that would shrink below three characters stay.

    "Malcolm X" loses its X here: a bare final numeral counts as a part number."""

    def cut(base: Column) -> Column:
        part = let(F.regexp_replace(base, _PART, ""), lambda p: F.when(p != base, p).otherwise(F.regexp_replace(base, _ROMAN, "")))
        keep = F.struct(base.alias("title"), F.lit(False).alias("marked"))
        return let(part, lambda p: F.when((p != base) & (F.length(simplify(p)) >= 3), F.struct(p.alias("title"), F.lit(True).alias("marked"))).otherwise(keep))

    return let(unrotate(strip(F.regexp_replace(c, _PARENS, " "))), cut)


def work_key(c: Column, year: Column) -> Column:
    """Identity of a work: parts of one share the base title, everything else keeps its year."""
    dated = F.concat(F.lit("::"), F.coalesce(year.cast("int").cast("string"), F.lit("")))
    return let(strip_parts(F.coalesce(c, F.lit(""))), lambda p: F.concat(F.when(p["marked"], F.lit("work::")).otherwise(F.lit("title::")), simplify(p["title"]), F.when(p["marked"], F.lit("")).otherwise(dated)))


def series_key(c: Column) -> Column:
    """The simplified text before the first colon, if it has four characters or more; else null."""
    return F.when(F.locate(":", c) > 0, let(simplify(F.substring_index(c, ":", 1)), lambda head: F.when(F.length(head) >= 4, head)))


def display_title(c: Column) -> Column:
    return let(squeeze(unrotate(strip(F.regexp_replace(c, _PARENS, "")))), lambda shown: F.when(shown != "", shown).otherwise(c))


def base_titles(c: Column) -> Column:
    """Sorted distinct simplified bases of a catalogue title and of its alternates, three characters or more."""
    c = F.coalesce(c, F.lit(""))
    outer = F.regexp_replace(c, _PARENS, " ")
    bases = F.transform(F.concat(F.array(outer, unrotate(outer)), alternates(c)), lambda x: simplify(strip_parts(x)["title"]))
    return F.array_sort(F.array_distinct(F.filter(bases, lambda k: F.length(k) >= 3)))


def catalogue_id(c: Column) -> Column:
    """Trimmed, without a trailing ``.0``, padded with zeros to seven digits (longer ids stay whole)."""
    plain = F.regexp_replace(strip(c), r"\.0$", "")
    return F.when(F.length(plain) < 7, F.lpad(plain, 7, "0")).otherwise(plain)
