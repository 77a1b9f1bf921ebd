"""English words cut to their stems by the published suffix rules of Porter, as Columns.

A rule is (suffix, what takes its place, a pattern that the part before it must match).  Of
a step's rules only that with the longest suffix that a word has can act.  Each step is a
pass over the array of words, so that expressions stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Consonant and vowel runs; y is a vowel after a consonant.  An initial y is a consonant, written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A stem with a vowel; with one, and with more than one, vowel run followed by consonants; with exactly one.
VOWEL, SOME, MORE, ONE = f"^({_C})?[aeiouy]", f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
#: A stem that ends in consonant, vowel, consonant, the last not w, x or y.
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
ANY = ""

# The rules of the published algorithm, with the two later ones for -bli and -logi.
PLURAL = [("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)]
PAST = [("eed", "ee", SOME), ("ed", "", VOWEL), ("ing", "", VOWEL)]
Y_TO_I = [("y", "i", VOWEL)]
SECOND = [
    ("ational", "ate", SOME), ("tional", "tion", SOME), ("enci", "ence", SOME), ("anci", "ance", SOME), ("izer", "ize", SOME), ("bli", "ble", SOME),
    ("alli", "al", SOME), ("entli", "ent", SOME), ("eli", "e", SOME), ("ousli", "ous", SOME), ("ization", "ize", SOME), ("ation", "ate", SOME),
    ("ator", "ate", SOME), ("alism", "al", SOME), ("iveness", "ive", SOME), ("fulness", "ful", SOME), ("ousness", "ous", SOME), ("aliti", "al", SOME),
    ("iviti", "ive", SOME), ("biliti", "ble", SOME), ("logi", "log", SOME),
]
THIRD = [("icate", "ic", SOME), ("ative", "", SOME), ("alize", "al", SOME), ("iciti", "ic", SOME), ("ical", "ic", SOME), ("ful", "", SOME), ("ness", "", SOME)]
FOURTH = [
    ("al", "", MORE), ("ance", "", MORE), ("ence", "", MORE), ("er", "", MORE), ("ic", "", MORE), ("able", "", MORE), ("ible", "", MORE), ("ant", "", MORE),
    ("ement", "", MORE), ("ment", "", MORE), ("ent", "", MORE), ("sion", "s", MORE), ("tion", "t", MORE), ("ou", "", MORE), ("ism", "", MORE), ("ate", "", MORE),
    ("iti", "", MORE), ("ous", "", MORE), ("ive", "", MORE), ("ize", "", MORE),
]
#: Words of fewer letters stay as they are.
LEAST = 3


def step(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The word after the rule of its longest suffix, if the part before it fits.  The last s or t of -sion and -tion counts to the part before."""

    def acted(suffix: str, instead: str, pattern: str) -> Column:
        before = F.left(word, F.length(word) - len(suffix))
        tested = F.concat(before, F.lit(suffix[0])) if suffix in ("sion", "tion") else before
        return F.when(tested.rlike(pattern) if pattern else F.lit(True), F.concat(before, F.lit(instead))).otherwise(word)

    ordered = sorted(rules, key=lambda r: len(r[0]))  # the longest is asked first
    return reduce(lambda out, r: F.when(F.endswith(word, F.lit(r[0])), acted(*r)).otherwise(out), ordered, word)


def mended(word: Column, before: Column) -> Column:
    """What -ed or -ing left behind: an e comes back, or a double consonant becomes single."""
    cut = (word != before) & ~F.endswith(before, F.lit("eed"))
    whole = word.rlike("(at|bl|iz)$") | word.rlike(SHORT)
    return F.when(cut & word.rlike(r"([^aeiouylsz])\1$"), F.left(word, F.length(word) - 1)).when(cut & whole, F.concat(word, F.lit("e"))).otherwise(word)


def last_e(word: Column) -> Column:
    """A last e goes after a long stem, and of two l at the end of one only the first stays."""
    stem = F.left(word, F.length(word) - 1)
    bare = F.endswith(word, F.lit("e")) & (stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT)))
    return F.when(bare, stem).otherwise(word)


def english(words: Column) -> Column:
    """The stems of an array of lower-case words, in their order; words of other letters than a to z stay as they are."""
    able = lambda w: (F.length(w) >= LEAST) & w.rlike("^[a-zY]+$")
    on = lambda f: lambda w: F.when(able(w), f(w)).otherwise(w)
    out = F.transform(words, on(lambda w: F.regexp_replace(w, "^y", "Y")))
    out = F.transform(out, on(lambda w: step(w, PLURAL)))
    # The second form of a word is kept beside it, since what follows depends on what was cut.
    pairs = F.transform(out, lambda w: F.struct(F.when(able(w), step(w, PAST)).otherwise(w).alias("w"), w.alias("was")))
    out = F.transform(pairs, lambda p: F.when(able(p["was"]), mended(p["w"], p["was"])).otherwise(p["w"]))
    for rules in (Y_TO_I, SECOND, THIRD, FOURTH):
        out = F.transform(out, on(lambda w, rules=rules: step(w, rules)))
    out = F.transform(out, on(last_e))
    out = F.transform(out, on(lambda w: F.when(F.endswith(w, F.lit("ll")) & F.left(w, F.length(w) - 1).rlike(MORE), F.left(w, F.length(w) - 1)).otherwise(w)))
    return F.transform(out, lambda w: F.regexp_replace(w, "^Y", "y"))


def english_sql(array: str) -> str:
    """The same as SQL over an array of words, for DuckDB."""

    def case(rules: list[tuple[str, str, str]]) -> str:
        parts = []
        for suffix, instead, pattern in sorted(rules, key=lambda r: -len(r[0])):
            before = f"left(w, length(w) - {len(suffix)})"
            tested = f"{before} || '{suffix[0]}'" if suffix in ("sion", "tion") else before
            parts.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN regexp_matches({tested}, '{pattern}') THEN {before} || '{instead}' ELSE w END")
        return "CASE " + " ".join(parts) + " ELSE w END"

    able = "length(w) >= 3 AND regexp_matches(w, '^[a-zY]+$')"
    on = lambda source, body: f"list_transform({source}, lambda w: CASE WHEN {able} THEN {body} ELSE w END)"
    single = " OR ".join(f"suffix(p.w, '{c}{c}')" for c in "bcdfghjkmnpqrtvwx")
    cut = "(p.was <> '' AND p.w <> p.was AND NOT suffix(p.was, 'eed'))"
    whole = f"regexp_matches(p.w, '(at|bl|iz)$') OR regexp_matches(p.w, '{SHORT}')"
    mend = f"CASE WHEN {cut} AND ({single}) THEN left(p.w, length(p.w) - 1) WHEN {cut} AND ({whole}) THEN p.w || 'e' ELSE p.w END"
    out = on(on(array, "regexp_replace(w, '^y', 'Y')"), case(PLURAL))
    pairs = f"list_transform({out}, lambda w: {{'w': CASE WHEN {able} THEN {case(PAST)} ELSE w END, 'was': CASE WHEN {able} THEN w ELSE '' END}})"
    out = f"list_transform({pairs}, lambda p: {mend})"
    for rules in (Y_TO_I, SECOND, THIRD, FOURTH):
        out = on(out, case(rules))
    stem = "left(w, length(w) - 1)"
    out = on(out, f"CASE WHEN suffix(w, 'e') AND (regexp_matches({stem}, '{MORE}') OR (regexp_matches({stem}, '{ONE}') AND NOT regexp_matches({stem}, '{SHORT}'))) THEN {stem} ELSE w END")
    out = on(out, f"CASE WHEN suffix(w, 'll') AND regexp_matches({stem}, '{MORE}') THEN {stem} ELSE w END")
    return f"list_transform({out}, lambda w: regexp_replace(w, '^Y', 'y'))"
