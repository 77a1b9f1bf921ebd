"""Text columns: normalising, similarity, validation, tagging.  All return a Column."""

from __future__ import annotations

import sys
import unicodedata
from string import ascii_lowercase, digits

from pyspark.sql import Column, functions as F

def marked_letters() -> tuple[str, str]:
    """Lower-case letters that decompose into one letter and marks, and those letters, by the Unicode tables."""
    plain = {}
    for point in range(0x80, sys.maxunicode + 1):
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if parts != letter and letter == letter.lower():
            bare = "".join(c for c in parts if unicodedata.category(c) != "Mn")
            if len(bare) == 1:
                plain[letter] = bare
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = marked_letters()


def unmarked(c: Column) -> Column:
    """Lower-case text without the marks of its letters, whether they are part of the letter or follow it."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def normalise(c: Column) -> Column:
    """Lower case, trimmed, without marks; empty for null; a final sigma is kept."""
    return unmarked(F.lower(F.trim(F.coalesce(c, F.lit("")))))


def normalise_name(c: Column) -> Column:
    """normalise(), then only letters a-z, Greek letters, digits and spaces."""
    # One by one, since Java looks single letters up and compares ranges in turn.
    return F.regexp_replace(normalise(c), f"[^{ascii_lowercase}{digits} α-ω]+", "")


def ascii_name(c: Column) -> Column:
    """Lower case, trimmed, ASCII letters, digits and white space only; Greek letters vanish."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", "")


def sanitise(c: Column, most: int) -> Column:
    """No NULs, single spaces, at most so many characters; null if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, "\u0000", ""), r"\s+", " "))
    return F.nullif(F.substring(clean, 1, most), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither side has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def language(c: Column) -> Column:
    """el if Greek letters are more than 0.3 of the letters, else en; en without letters."""
    text = F.coalesce(c, F.lit(""))
    # By what is missing without them: regexp_count would make a list of all letters.
    count = lambda letters: F.length(text) - F.length(F.regexp_replace(text, letters, ""))
    return F.when(count(r"[Ͱ-Ͽἀ-῿]+") > count(r"\p{L}+") * 0.3, "el").otherwise("en")


def has_greek(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[Ͱ-Ͽἀ-῿]"), F.lit(False))


def tokens(c: Column) -> Column:
    """The lower-cased runs of letters and digits, in order; null for null."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def cache_key(c: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the lower-cased text."""
    return F.substring(F.sha2(F.lower(c), 256), 1, 16)


def phone_check(c: Column) -> Column:
    """struct(valid, warning) by the Greek numbering plan; valid without a warning for null.

    Separators and a leading +30 or 0030 are dropped first.  Mobile numbers start with
    69 and land lines with 2; both have ten digits.  Five equal digits in a row are
    named, too, in numbers that fit neither.
    """
    digits = F.regexp_replace(F.regexp_replace(c, r"[\s().-]", ""), r"^(\+30|0030)", "")
    size = F.length(digits)
    wrong_size = lambda name: F.concat(F.lit(f"{name} too "), F.when(size < 10, "short: ").otherwise("long: "), size)
    good = c.isNull() | (c == "") | digits.rlike(r"^(69\d{8}|2\d{9})$")
    shape = (
        F.when(digits.rlike(r"\D") | (size == 0), "non-digit characters")
        .when(digits.startswith("69") & (size != 10), wrong_size("mobile"))
        .when(digits.startswith("2") & (size != 10), wrong_size("landline"))
        .when(c.rlike(r"^\s*\(?(\+30|0030)"), "should start with 2 or 69")
        .otherwise("no Greek format")
    )
    repeated = F.when(F.regexp_replace(digits, r"\D", "").rlike(r"(\d)\1{4,}"), "repeated digits")
    warning = F.when(~good, F.concat_ws("; ", shape, repeated))
    return F.struct(warning.isNull().alias("valid"), warning.alias("warning"))


def keyword_bucket(c: Column, buckets: dict[str, str], default: str = "other") -> Column:
    """The first bucket, in order, whose pattern occurs in the lower-cased text."""
    out = F.lit(default)
    for name, pattern in reversed(buckets.items()):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def tag_value(tags: Column, prefix: str) -> Column:
    """The value of the first tag prefix:value in an array."""
    return F.get(F.split(F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix + ":"))), F.lit(0)), ":", 2), F.lit(1))
