"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits that stand for letters), an Aho-Corasick
automaton finds every lexicon entry at a word start in one pass, hits inside an exception
phrase are dropped, and the weights are normalised by the text's length.

Weights are learned from a bounded sample of labelled documents: an entry is a word or a word
start, its weight the log odds of its share in toxic against other documents. One half of
the sample makes a lexicon on which the other half calibrates the score; the lexicon in use is
made from both. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text scores as one without hits; several labels for a document
count as toxic if any is; null labels and null ids teach nothing; with nothing to learn from every score is 0;
a very long text is scored whole; of entries that start at one place the heaviest counts, of equal ones the first found;
repeated rows are scored alike (and each teaches, if labelled); extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.llm import common

FOLDS = 3
THRESHOLD = 0.7
#: Bound of the sample: labelled documents per class.
PER_CLASS = 10_000
#: An entry stands in so many toxic documents of the sample at least, by number and by share. That bounds the lexicon: it has at
#: most 1 / LEAST_SHARE times as many entries as a toxic document of the sample has different words and word starts.
LEAST_DOCS, LEAST_SHARE = 3, 0.004
LEAST_WEIGHT = 2.0
SHORTEST, LONGEST = 4, 12

#: Look-alike letters of other scripts, and signs read as letters inside a word.
HOMOGLYPHS = str.maketrans("аеіорсухѕјԁӏһԛԝвкмнтгпαβεικνορτυχηωγδ", "aeiopcyxsjdlhqwbkmhtrnabeiknoptuxhwyd")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which a lexicon word isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "stupid simple", "idiot proof", "idiot light", "scum of the pond")

_SIGN = re.compile(r"(?<=[^\W\d_])[01345789@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[01345789@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0134578]+(?![\w@$!|])")
#: A sign can only be read as a letter where one of these stands.
_MAY = re.compile(r"[01345789@$!|][^\W\d_]|[^\W\d_][0134578]")
_OTHER = re.compile(r"[\W\d_]+")
_HIGH = re.compile(r"[^\x00-\x7F]+")
#: ASCII characters other than lower-case letters, to blanks.
_BLANKS = {i: " " for i in range(128) if not 97 <= i <= 122}


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    """Accented and wide letters to their base letters, by Unicode decomposition; format characters go."""
    import unicodedata

    out: dict[int, str] = {}
    for i in range(0x80, 0x3000):
        c = chr(i)
        if unicodedata.category(c) in ("Mn", "Cf"):
            out[i] = ""
        elif (d := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) != c and d.isalpha():
            out[i] = d.lower()
    for i in range(0xFF21, 0xFF5B):
        out[i] = unicodedata.normalize("NFKC", chr(i)).lower()
    return out | {0xFEFF: ""} | HOMOGLYPHS


def fold(text: str | None) -> str:
    """Folded words, one blank between and at both ends."""
    t = (text or "").lower()
    if not t.isascii():
        t = _HIGH.sub(lambda m: m[0].translate(_plain()), t)
    if _MAY.search(t):
        t = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    if t.isascii():
        words = t.translate(_BLANKS).split()
        return f" {' '.join(words)} " if words else " "
    return _OTHER.sub(" ", f" {t} ")


@dataclass
class Lexicon:
    """Weighted entries (" idio" is a word start, " idiot " a word), exceptions and calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    model: tuple[float, ...] = ()

    def automaton(self):
        if "_a" not in self.__dict__:
            import ahocorasick

            a = ahocorasick.Automaton()
            for x in self.exceptions:
                a.add_word(f" {x} ", (len(x) + 2, None))
            for x, w in self.weights.items():
                a.add_word(x, (len(x), w))
            a.make_automaton()
            self.__dict__["_a"] = a if len(a) else None
        return self._a

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_a"}

    def features(self, text: str | None) -> tuple[float, float, float, int]:
        """Sum of weights, weight per 100 words (smoothed), distinct entries, hits."""
        t, a = fold(text), self.automaton()
        best: dict[int, tuple[float, int]] = {}
        spans: list[tuple[int, int]] = []
        if a is not None:
            for end, (n, w) in a.iter(t):
                start = end - n + 1
                if w is None:
                    spans.append((start, end))
                elif w > best.get(start, (0.0, 0))[0]:
                    best[start] = (w, end)
        if spans:
            best = {s: x for s, x in best.items() if not any(a <= s and x[1] <= b for a, b in spans)}
        if not best:
            return 0.0, 0.0, 0.0, 0
        total = sum(w for w, _ in best.values())
        return total, 100 * total / (t.count(" ") + 20), float(len({t[s : e + 1] for s, (_, e) in best.items()})), len(best)

    def score(self, text: str | None) -> tuple[float, int]:
        f = self.features(text)
        if not self.model:
            return 0.0, f[3]
        return float(1 / (1 + np.exp(-np.clip(_inputs(np.array([f[:3]])) @ np.array(self.model), -30, 30)))[0]), f[3]


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(x)), np.log1p(x), x[:, 0] > 0))


def calibrate(x: np.ndarray, y: np.ndarray, strength: float = 0.05, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton's method, kept small so that a perfect split stays finite."""
    x = _inputs(x)
    w, ridge = np.zeros(x.shape[1]), strength * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(map(float, w))


def entries(texts: Iterable[str | None]) -> Iterable[set[str]]:
    """Candidate entries of each text: its words and their starts."""
    for t in texts:
        out: set[str] = set()
        for w in set(fold(t).split()):
            if len(w) >= SHORTEST:
                out.add(f" {w} ")
                out.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        yield out


def weight(t: float, n: float, toxic: int, other: int) -> float:
    """Log odds of an entry in ``t`` of ``toxic`` documents and ``n`` of the ``other`` ones."""
    return float(np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (other + 1)))


def least(toxic: int) -> float:
    return max(LEAST_DOCS, LEAST_SHARE * toxic)


def speaks(t: Column, n: Column, toxic: int, other: int) -> Column:
    """Whether an entry in ``t`` toxic and ``n`` other documents of the sample speaks for toxicity."""
    w = F.log((t + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (other + 1))
    return (t >= least(toxic)) & (w >= LEAST_WEIGHT) & (t * max(other, 1) > 4 * n * toxic)


def select(counts: Iterable[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of the entries (entry, toxic documents, other documents); a start that serves as well replaces what it starts."""
    out: dict[str, float] = {}
    for entry, w in sorted(((e, weight(t, n, toxic, other)) for e, t, n in counts), key=lambda x: (len(x[0].rstrip()), x[0])):
        if not any(entry[:n] in out and out[entry[:n]] >= w - 0.75 for n in range(SHORTEST + 1, len(entry))):
            out[entry] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``per_class`` ids of each class (smallest hashes first) are taken; that list of
    ids is bounded, so it is broadcast and no text is shuffled.
    """
    spark = docs.sparkSession
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = truth.select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    take = lambda y: hashed.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_class)
    chosen = F.broadcast(take(0).union(take(1)).select("doc_id", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half")))
    with common.scratch():
        sample = common.keep(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", "half"), "toxic")
        sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
        n = {(h, y): sizes.get((h, y), 0) for h in (0, 1) for y in (0, 1)}
        if not n[0, 1] + n[1, 1] or not n[0, 0] + n[1, 0]:
            return Lexicon({}, exceptions, ())

        def count(texts: list, toxic: list, half: list) -> Iterable:
            seen: dict[str, list[int]] = {}
            for found, y, h in zip(entries(texts), toxic, half, strict=True):
                for e in found:
                    seen.setdefault(e, [0, 0, 0, 0])[2 * h + y] += 1
            return [list(seen), *zip(*seen.values(), strict=True)] if seen else [[], [], [], [], []]

        grams = common.map_rows(sample, ["text", "toxic", "half"], count, "entry string, n00 long, n01 long, n10 long, n11 long", rows=None)
        summed = grams.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")])
        in_both = speaks(F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10"), n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
        in_first = speaks(F.col("n01"), F.col("n00"), n[0, 1], n[0, 0])
        rows = summed.where(in_both | in_first).select("*", in_both.alias("both"), in_first.alias("first")).collect()
        both = select([(r["entry"], r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in rows if r["both"]], n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
        first = select([(r["entry"], r["n01"], r["n00"]) for r in rows if r["first"]], n[0, 1], n[0, 0])
        held = spark.sparkContext.broadcast(Lexicon(first, exceptions))

        def measure(texts: list, toxic: list) -> Iterable:
            f = [held.value.features(t)[:3] for t in texts]
            return [[x[0] for x in f], [x[1] for x in f], [x[2] for x in f], toxic]

        got = common.map_rows(sample.where("half = 1"), ["text", "toxic"], measure, "a double, b double, c double, y int").collect()
        model = calibrate(np.array([[r["a"], r["b"], r["c"]] for r in got]), np.array([r["y"] for r in got], float)) if got else ()
        return Lexicon(both, exceptions, model)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and n_hits for every document."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # its size is bounded by the sample (see LEAST_SHARE)

    def run(texts: list) -> Iterable:
        found = [held.value.score(t) for t in texts]
        return [[f[0] for f in found], [int(f[0] >= threshold) for f in found], [f[1] for f in found]]

    return common.map_rows(docs, ["text"], run, "score double, predicted int, n_hits long", keep=("doc_id",))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").where(~common.held_out("doc_id", FOLDS))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", common.held_out("doc_id", FOLDS).alias("held_out"), "score", "predicted", "n_hits")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
