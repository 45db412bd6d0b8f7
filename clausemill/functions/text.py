"""Text expressions: all of them are Column functions that run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Full-width characters and what they fold to.
FULL_WIDTH = "０１２３４５６７８９．ＭｍｍＫｋＮｎ"
HALF_WIDTH = "0123456789.MmmKkNn"
#: Line ends: CR LF together, or any single line separator.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
#: Headings: Chinese ordinal with enumeration comma, or decimal number with a delimiter.
CN_HEADING = r"(?U)^([一二三四五六七八九十百]+)\s*、\s*(\S.*)$"
NUM_HEADING = r"(?U)^([0-9]+(?:\.[0-9]+)*)(?:[、.）)]\s*|\s+)(\S.*)$"
CITATION = "《"
_CHUNK = 512


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (trim would leave U+3000)."""
    return F.when(text.rlike(r"(?U)^\s|\s$"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines by any line separator; no empty line after the last one."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fold(text: Column) -> Column:
    """Full-width digits and unit letters to ASCII."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def normalise(text: Column) -> Column:
    """For matching: folded, without the blanks that break numbers apart, without blanks at all."""
    folded = fold(text)
    joined = F.regexp_replace(folded, r"(?U)([0-9])\s*\.\s*([0-9])", "$1.$2")
    joined = F.regexp_replace(joined, r"(?U)([0-9])\s+(?=[0-9]|mm|米|m|次)", "$1")
    return F.translate(F.when(folded.rlike(r"(?U)[0-9.]\s"), joined).otherwise(folded), " 　", "")


def heading_level(text: Column) -> Column:
    """1 for a Chinese ordinal, dots + 1 for a decimal number, null for text and for cited titles."""
    ordinal = text.rlike(CN_HEADING) & ~F.startswith(F.regexp_extract(text, CN_HEADING, 2), F.lit(CITATION))
    number = F.regexp_extract(text, NUM_HEADING, 1)
    decimal = (number != "") & ~F.startswith(F.regexp_extract(text, NUM_HEADING, 2), F.lit(CITATION))
    return F.when(ordinal, 1).when(decimal, F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def running(lens: Column) -> Column:
    """Sums of the lengths before each element; in chunks, as a fold copies what it has built."""
    fold_ = lambda part: F.aggregate(
        part,
        F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")),
    )
    n = F.ceil(F.size(lens) / _CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda c: fold_(F.slice(lens, c * _CHUNK + 1, _CHUNK)))
    starts = fold_(F.transform(parts, lambda p: p["s"]))["a"]
    return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["a"], lambda x: x + s)))


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (m, s, e): every match of ``pattern`` with its start and end in code points.

    The pieces between the matches give the places, so no match is searched for again.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, 0)
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    before = running(F.zip_with(pieces, matches, lambda p, m: (F.length(p) + F.length(m)).cast("long")))
    zipped = F.arrays_zip(matches.alias("m"), pieces.alias("p"), before.alias("b"))
    return F.transform(
        zipped, lambda x: F.struct(x["m"].alias("m"), (x["b"] + F.length(x["p"])).alias("s"), (x["b"] + F.length(x["p"]) + F.length(x["m"])).alias("e"))
    )


def placed(text: Column, matches: Column) -> Column:
    """As :func:`located`, of the few matches of a pattern without look-around: each match is looked for after the one before.

    An earlier equal substring would itself have been the leftmost match, so the first one found is the match.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("a"))

    def step(acc: Column, m: Column) -> Column:
        s = F.position(m, text, acc["at"] + 1) - 1
        return F.struct((s + F.length(m)).alias("at"), F.array_append(acc["a"], s).alias("a"))

    starts = F.aggregate(matches, start, step, lambda acc: acc["a"])
    return F.transform(F.arrays_zip(matches.alias("m"), starts.alias("s")), lambda x: F.struct(x["m"].alias("m"), x["s"].cast("long").alias("s"), (x["s"] + F.length(x["m"])).cast("long").alias("e")))


def tokens(text: Column) -> Column:
    """Bigrams of the CJK characters, which bridge what stands between them, then ASCII words and numbers in lower case."""
    cjk = F.regexp_replace(text, "[^一-鿿]", "")
    n = F.length(cjk)
    bigrams = F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(cjk, i, F.lit(2))))
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9]+(?:\.[0-9]+)?"), 0), F.lower)
    return F.concat(bigrams, words)


def number(value: Column) -> Column:
    """Whole numbers without a fraction, others as they are, null as a question mark."""
    return F.when(value.isNull(), "?").when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def quoted(literal: str) -> str:
    """A literal as a pattern."""
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|" else c for c in literal)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if any of the (non-empty) words is a substring; no words: false."""
    out = F.lit(False)
    for w in words:
        if w:
            out = out | F.contains(text, F.lit(w))
    return out
