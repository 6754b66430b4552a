"""Column functions over text; every length is in code points."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextProfile:
    """What counts as a run of a script and what ends a sentence."""

    run: str
    end: str
    unit: str
    low: int = 4
    high: int = 60


LATIN = TextProfile(run="[A-Za-zÀ-ÖØ-öø-ÿ]+", end="[.!?;\n]+", unit="[A-Za-zÀ-ÖØ-öø-ÿ]+")
HAN = TextProfile(run="[一-鿿]+", end="[。！？；!?…\n]+", unit="[一-鿿]")

#: What is scrubbed.  A phone number starts with + and a digit, or with 0 that no digit or dot precedes, and has 8 digits or more.
URL = r"(?i)(?:(?:https?|ftp)://|www\.)[!-~]+"
EMAIL = r"[0-9A-Za-z+%._-]+@(?:[0-9A-Za-z-]+\.)+[0-9A-Za-z-]+"
PHONE = r"(?:\+|(?<![\p{Nd}.])[(（]?(?=[0０]))\p{Nd}(?:[\s()（）-]*\p{Nd}){7,}[)）]?"


def scrub(text: Column) -> Column:
    """URLs, e-mail addresses and phone numbers become a line break, so that their neighbours do not join."""
    for pattern in (URL, EMAIL, PHONE):
        text = F.regexp_replace(text, pattern, "\n")
    return text


def sentences(text: Column, profile: TextProfile = LATIN) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, profile.end), lambda s: F.trim(s)), lambda s: s != "")


def units(text: Column, profile: TextProfile = LATIN) -> Column:
    """Lower-cased units (words, or single characters of a script without spaces)."""
    return F.transform(F.regexp_extract_all(text, F.lit(profile.unit), F.lit(0)), F.lower)


def runs(text: Column, profile: TextProfile = LATIN) -> Column:
    return F.regexp_extract_all(text, F.lit(profile.run), F.lit(0))


def fold(text: Column, source: str, target: str) -> Column:
    return F.translate(text, source, target)


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def kind(text: Column, simplified: str, markers: str, traditional: str) -> Column:
    """Class of a sentence by its characters of three sets: simp (as many simplified as traditional ones, or more), marker (markers only), trad."""
    r, m, t = (count_of(text, x) for x in (simplified, markers, traditional))
    return F.when((r > 0) & (r >= t), "simp").when((r == 0) & (m > 0) & (t == 0), "marker").otherwise("trad")


def tail(prefix: Column, n: int = 2, profile: TextProfile = HAN) -> Column:
    """Last at most n consecutive characters of the profile's script at the end of a text."""
    return F.regexp_extract(prefix, f"({profile.run[:-1]}{{1,{n}}})$", 1)


def pairs(text: Column, last: int = 64, profile: TextProfile = HAN) -> Column:
    """Distinct pairs of neighbouring characters of the profile's script among the last characters of a text."""
    chars = F.split(F.substr(text, F.greatest(F.length(text) - last + 1, F.lit(1)), F.lit(last)), "")
    every = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(every, lambda p: p.rlike(f"^(?:{profile.run})$") & (F.length(p) == 2)))


def hits(text: Column, known: Column) -> Column:
    """Positions of a text whose pair of neighbouring characters is among the known pairs."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    return F.when(F.length(text) < 2, 0).otherwise(F.size(F.filter(at, lambda i: F.array_contains(known, F.substr(text, i, F.lit(2))))))


def recurrence(text: Column, context: Column, gamma: float, least: int = 32, last: int = 64, profile: TextProfile = HAN) -> Column:
    """gamma for each pair that a text shares with the last characters of its context, 0 where the context is short."""
    return F.when(F.length(context) < least, 0.0).otherwise(gamma * hits(text, pairs(context, last, profile)))


def bucket(*parts: Column, n: int = 10) -> Column:
    """Stable bucket of a document from the first byte of a SHA-256 over tab-joined parts."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("\t", *parts), 256), 1, 2), 16, 10).cast("int") % n).cast("int")


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log10(x: Column) -> Column:
    """log10 with minus infinity at zero."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(float("-inf")))


def is_subsequence(short: Column, full: Column) -> Column:
    """Whether the characters of short occur in full in order."""
    found = lambda at, c: F.call_function("locate", c, full, at + 1)
    step = lambda at, c: F.when((at < 0) | (found(at, c) == 0), F.lit(-1)).otherwise(found(at, c))
    return F.aggregate(F.split(short, ""), F.lit(0), step) >= 0


def log10_sum(terms: Column) -> Column:
    """log10 of a sum of powers of ten, by the greatest; null for none."""
    top = F.array_max(terms)
    return top + F.log10(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.pow(F.lit(10.0), t - top)))


def replace_longest(table: dict[str, str]):
    """Column function: from left to right the longest key of the table becomes its value; other characters stay."""
    keys = "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k)))
    pattern = re.compile(keys or r"(?!)")

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else pattern.sub(lambda m: table[m[0]], t))

    return run


def normal_form(text: Column, source: str, target: str, table: dict[str, str]) -> Column:
    """Lenient normal form: a character map, then the longest variants."""
    return replace_longest(table)(fold(text, source, target))


def merged(syllable: Column, pairs_on: list[tuple[str, str]]) -> Column:
    """A syllable with the second symbol of each enabled pair read as the first."""
    return F.translate(syllable, "".join(b for _, b in pairs_on), "".join(a for a, _ in pairs_on))


def record_key(context: Column, following: Column, sentinel: str = "^") -> Column:
    """Key under which a choice is recorded: the context, or at the start of a sentence what follows."""
    return F.when(context != sentinel, context).otherwise(F.concat(F.lit(sentinel), F.coalesce(following, F.lit(""))))


def clauses(text: Column, marks: str = r"[，。、；：！？,.;:!?\s]+", low: int = 2, high: int = 10, profile: TextProfile = HAN) -> Column:
    """Clauses of low to high characters, all of the profile's script."""
    return F.filter(F.split(text, marks), lambda c: c.rlike(f"^(?:{profile.run})$") & F.length(c).between(low, high))


PARENTHESES = r"（[^（）]*）|\([^()]*\)"


def without_parentheses(text: Column, deep: int = 5) -> Column:
    """A text without what stands in parentheses, nested up to a depth."""
    for _ in range(deep):
        text = F.regexp_replace(text, PARENTHESES, "")
    return text


def names(cell: Column, low: int = 2, high: int = 10, profile: TextProfile = HAN) -> Column:
    """Names in a table cell: parentheses go, full-width marks part them, and only names of the script are kept."""
    parts = F.transform(F.split(without_parentheses(cell), "[；，、]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p.rlike(f"^(?:{profile.run})$") & F.length(p).between(low, high))


def optional_forms(text: Column) -> Column:
    """Every form of a text in which what stands in square brackets may be left out; distinct, sorted."""
    parts = F.split(text, r"(?=\[[^\]]*\])|(?<=\])")
    grow = lambda forms, p: F.when(
        p.rlike(r"^\[[^\]]*\]$"), F.flatten(F.transform(forms, lambda f: F.array(f, F.concat(f, F.substr(p, F.lit(2), F.length(p) - 2)))))
    ).otherwise(F.transform(forms, lambda f: F.concat(f, p)))
    return F.array_sort(F.array_distinct(F.aggregate(parts, F.array(F.lit("")), grow)))


def without_suffix(name: Column, suffixes: list[str], least: int = 2) -> Column:
    """A name without the first suffix of the list that it ends in, if least characters remain."""
    out = name
    for x in reversed(suffixes):
        out = F.when(name.endswith(x) & (F.length(name) - len(x) >= least), F.substr(name, F.lit(1), F.length(name) - len(x))).otherwise(out)
    return out


def embedded_tokens(text: Column, profile: TextProfile = HAN) -> Column:
    """Latin tokens of up to 32 letters and digits that begin with a letter, no mark of an address beside them, and the script or an edge on one side at least."""
    han = profile.run.rstrip("+")
    word, free = "[A-Za-z][A-Za-z0-9]{0,31}", "(?<![A-Za-z0-9@./:#])"
    end = r"(?![A-Za-z0-9@./:#])"
    sides = rf"(?:(?<=(?:^|{han})\s{{0,20}}){word}{end}|{free}{word}(?=\s*(?:$|{han})){end})"
    return F.when(text.rlike(han), F.transform(F.regexp_extract_all(text, F.lit(f"({free}{sides})"), F.lit(1)), F.lower)).otherwise(F.array().cast("array<string>"))


def compatible(typed: Column, full: Column) -> Column:
    """Whether each typed unit begins the unit of the full reading at its place, and there are no more units than there."""
    n = F.size(typed)
    return (n <= F.size(full)) & F.forall(F.arrays_zip(typed.alias("a"), F.slice(full, F.lit(1), F.greatest(n, F.lit(1))).alias("b")), lambda x: x["b"].startswith(x["a"]))
