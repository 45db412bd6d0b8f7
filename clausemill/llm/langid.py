"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, a
word's edge counts as a blank) in rank order. A document's own ranking is compared to each
profile by out-of-place distance: the sum of rank differences, with the profile's length for
an n-gram that the profile lacks. The nearest profile wins.

Profiles come from a bounded sample of labelled documents (``per_language`` ids per
language, those with the smallest hashes), so fitting costs the same at any size; every
document is then scored over its whole text, in one pass without a shuffle (one for each ``BLOCK_LANGUAGES`` languages).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language that sorts first; null languages teach nothing; with nothing to learn from all
is ``und``; a very long text is ranked whole; n-grams as frequent go by their code points; repeated rows are scored alike;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.llm import common

FOLDS = 3
RANKS = 400
PER_LANGUAGE = 4000
#: Languages whose profiles are held at once; more are taken in blocks, one pass over the documents each.
BLOCK_LANGUAGES = 500
#: A table of more languages than this isn't broadcast.
BROADCAST_LANGUAGES = 100_000
#: How sharply the score falls with the relative distance.
SHARPNESS = 25.0
UNKNOWN = "und"
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter or a mark within a word."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and their counts; empty without a letter.

    An n-gram's code holds its code points in 21 bits each, so n = 1, 2 and 3 never clash.
    """
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[cp]
    if not letter.any():
        return none, none
    cp = np.where(letter, cp, 32)
    blank = ~letter
    cp = np.concatenate(([32], cp[~(blank & np.concatenate(([True], blank[:-1])))], [32]))
    if cp[-2] == 32:
        cp = cp[:-1]
    inner = cp != 32
    two = (cp[:-1] << _BITS) | cp[1:]
    three = (two[:-1] << _BITS) | cp[2:]
    return np.unique(np.concatenate((cp[inner], two, three[inner[1:-1]])), return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts together."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:ranks]]


class Profiles:
    """Rank of each known n-gram in each language."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS) -> None:
        self.languages, self.ranks = sorted(profiles), ranks
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            p = np.array(profiles[lang], np.int64)
            self.rank[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance (0 to 1) to each language; null without a letter."""
        top = ranked(*ngrams(text), self.ranks)
        if not len(top):
            return None
        if not len(self.codes):
            return np.ones(len(self.languages))
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        rank = self.rank[at]
        return np.where(rank < 0, self.ranks, np.abs(rank - np.arange(len(top))[:, None])).sum(0) / (len(top) * self.ranks)

    def predict(self, text: str | None, before: tuple[str, float, float] = (UNKNOWN, 0.0, 1.0)) -> tuple[str, float, float]:
        """Language, score (share of the nearest profile among all, by distance) and the distance, 0 to 1.

        ``before`` is the result of the blocks of languages before this one.
        """
        out = self.distances(text) if self.languages else None
        if out is None:
            return before
        best, distance = int(out.argmin()), float(out.min())
        lang, score, least = before
        if score == 0 or distance < least:
            lang, low = self.languages[best], distance
        else:
            low = least
        rest = np.exp(-SHARPNESS * (least - low)) / score if score > 0 else 0.0
        return lang, float(1 / (rest + np.exp(-SHARPNESS * (out - low)).sum())), low


class Fitted:
    """Profiles of any number of languages: a table (lang, r, code), and its languages in order."""

    def __init__(self, table: DataFrame, languages: list[str], ranks: int, block: int = BLOCK_LANGUAGES) -> None:
        self.table, self.languages, self.ranks, self.block = table, languages, ranks, block

    def blocks(self) -> Iterable[Profiles]:
        """The profiles of some languages at a time."""
        for at in range(0, len(self.languages), self.block):
            some = self.languages[at : at + self.block]
            mine = self.table.where(F.col("lang").between(some[0], some[-1]))
            profiles: dict[str, list[int]] = {}
            for r in sorted(mine.collect(), key=lambda r: r["r"]):
                profiles.setdefault(r["lang"], []).append(r["code"])
            yield Profiles(profiles, self.ranks)


def fit(docs: DataFrame, ranks: int = RANKS, per_language: int = PER_LANGUAGE, block: int = BLOCK_LANGUAGES) -> Fitted:
    """Profiles of all languages of ``docs`` (text, lang, doc_id): from at most about ``per_language`` documents of each.

    The sample is taken by id alone; texts of the chosen ids are counted on the executors and
    only the ``ranks`` best n-grams per language are kept.
    """
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    u = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.lit(float(per_language)) / F.col("_n")
    cut = known.groupBy("lang").agg(F.count("*").alias("_n")).select("lang", F.when(share >= 1, F.lit(2**63 - 1)).otherwise(F.lit(-(2.0**63)) + F.lit(2.0**64) * share).cast("long").alias("_cut"))
    sample = known.join(common.small(cut, BROADCAST_LANGUAGES, "languages"), "lang").where(u <= F.col("_cut"))

    def count(langs: list, texts: list) -> Iterable:
        per: dict[str, list] = {}
        for lang, text in zip(langs, texts, strict=True):
            parts = per.setdefault(lang, [])
            parts.append(ngrams(text))
            if len(parts) >= 64:  # so that memory holds the distinct n-grams, not those of a whole batch
                parts[:] = [_added(parts)]
        out = [[], [], []]
        for lang, parts in per.items():
            codes, counts = _added(parts)
            for x, y in zip(out, ([lang] * len(codes), codes, counts), strict=True):
                x.extend(y)
        return out

    grams = common.map_rows(sample, ["lang", "text"], count, "lang string, code long, n long", rows=None)
    sums = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= ranks)
    table = common.keep(top.select("lang", "r", "code"), "profiles")
    return Fitted(table, sorted(r["lang"] for r in table.select("lang").distinct().collect()), ranks, block)


def identify(docs: DataFrame, profiles: Fitted, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry``, lang_pred, score and distance for every document."""
    schema = "lang_pred string, score double, distance double"
    names = list(dict.fromkeys((key, *carry, "text")))
    out = docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(1.0).alias("distance"))
    for k, block in enumerate(profiles.blocks()):
        held = docs.sparkSession.sparkContext.broadcast(block)  # ranks x languages of a block

        def score(texts: list, *before: list, held=held) -> Iterable:
            found = [held.value.predict(t, b) for t, *b in zip(texts, *before, strict=True)]
            return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

        if k:  # a block at a time: its profiles are the only ones a worker holds
            out = common.keep(out, "language")
        out = common.map_rows(out, ["text", "lang_pred", "score", "distance"], score, schema, keep=names)
    return out.select(*dict.fromkeys((key, *carry)), "lang_pred", "score", "distance")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit(docs.where(~common.held_out("doc_id", FOLDS)))
    return identify(docs, profiles).select("doc_id", common.held_out("doc_id", FOLDS).alias("held_out"), "lang_pred", "score", "distance")


QUERIES = {"op4_langid": op4_langid}
SQL: dict[str, str] = {}
