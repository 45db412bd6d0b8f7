"""Quality rules by tokeniser fertility.

Public vocabularies, read from ``TOKENIZERS`` and never trained, measure each whole text:
characters per token and token entropy of a byte-level BPE, and the share of UTF-8 bytes that
a piece vocabulary could only spell as single bytes. A text is rejected where a measure
leaves the band of its language (a null language: of its script).

Bands are robust: median plus and minus ``WIDTH`` times the median absolute deviation over
all documents of the group, no narrower than ``LEAST_HALF``. Two percentile aggregations over
the narrow table of measures make them; texts are read and tokenised once.

Defined cases: a null or empty text has no words and fails the base rule; a text under
``LEAST_TOKENS`` tokens is too short for the bands; a measure that is null is never out of its
band; a null language takes the bands of its script; a very long text, also one of blanks or letters alone, is measured
whole; a measure on its band's edge is within; scripts with as many letters go by the order of ``SCRIPTS``; repeated
rows are judged alike; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.llm import common

#: Folder of the public vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WIDTH, LEAST_TOKENS = 6.0, 50
#: A table of more languages than this isn't broadcast.
BROADCAST_BANDS = 10_000
#: The bands' half widths at least, as a share of the median (fallback: absolute).
LEAST_HALF = {"chars_per_token": 0.15, "byte_share": 0.05, "entropy": 0.25}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Han", "Other")


@lru_cache(maxsize=2)
def _encoding(folder: str):
    import base64

    import tiktoken

    with open(f"{folder}/{BYTE_BPE}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _fallback(folder: str) -> np.ndarray:
    """For each code point: how many byte pieces the piece vocabulary spells it with (0: it has the character)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    known = {x for x in map(p.id_to_piece, range(p.get_piece_size())) if len(x) == 1}
    cp = np.arange(0x110000)
    out = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    out[[ord(c) for c in known] + [ord(c) for c in " \t\n\v\f\r▁"]] = 0
    return out


#: White space, and how long a run of it goes to the merging step by itself: the pattern's engine recurses over such a run.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = 10_000
_LONG_BLANKS = re.compile(f"[{_BLANK}]{{{LONG_BLANK},}}")


def encode(text: str, folder: str = TOKENIZERS) -> list[int]:
    """Token ids of a text; the same as the vocabulary's own encoder gives, for runs of white space of any length.

    ``PATTERN`` takes such a run without its last character as one piece (at the end of the text: the whole run).
    """
    e = _encoding(folder)
    if len(text) < LONG_BLANK:
        return e.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += e.encode_ordinary(text[at : m.start()])
        out += e._core_bpe.encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + e.encode_ordinary(text[at:])


def script(text: str) -> str:
    """Script of most letters among the first of each kind; by Unicode block, counted over the whole text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.searchsorted([0x41, 0x250, 0x370, 0x400, 0x530, 0x600, 0x780, 0x3400, 0xA000], cp, "right")
    n = np.bincount(at, minlength=10)
    by = {"Latin": n[1], "Greek": n[3], "Cyrillic": n[4], "Arabic": n[6], "Han": n[8], "Other": n[2] + n[5] + n[7] + n[9]}
    return max(by, key=lambda k: (by[k], -SCRIPTS.index(k)))


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII characters only
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = Counter(x for x in text.split("\n") if x.strip(" \t\v\f\r"))
    ids: dict[bytes, int] = {}
    n, repeated = len(words), 0
    if n > 3:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        k = len(ids)
        pair = w[:-1] * k + w[1:]
        if k < 2_000_000:
            key = pair[:-1] * k + w[2:]
        else:
            key = np.unique(pair, return_inverse=True)[1][:-1] * k + w[2:]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.concatenate((count[at] > 1, [False, False]))
        hit[1:] |= hit[:-1].copy()
        hit[2:] |= np.concatenate((count[at] > 1,))[: n - 2]
        repeated = int(hit.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated


def fertility(text: str | None, folder: str = TOKENIZERS) -> tuple[int, float | None, float | None, float | None]:
    """n_tokens, chars_per_token, byte_share, entropy (bits per token over that of as many different tokens)."""
    if not text:
        return 0, None, None, None
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.array(encode(text, folder), np.int64)
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    utf8 = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    bits = float(-(counts * np.log2(counts)).sum())
    return len(ids), len(cp) / len(ids), float(_fallback(folder)[cp].sum() / utf8.sum()), bits / np.log2(len(ids)) if len(ids) > 1 else 0.0


MEASURES = ("chars_per_token", "byte_share", "entropy")


def measure(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, the group of the bands, the base counts and the measures of every whole text."""

    def run(langs: list, texts: list) -> Iterable:
        b, f = [base(t) for t in texts], [fertility(t, folder) for t in texts]
        group = [lang if lang is not None else f"script:{script(t or '')}" for lang, t in zip(langs, texts, strict=True)]
        return [group, *([x[i] for x in b] for i in range(5)), *([x[i] for x in f] for i in range(4))]

    schema = "band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
    return common.map_rows(docs, ["lang", "text"], run, schema, keep=("doc_id",))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """Adds base_failed, rejected_by (measures outside their bands) and kept.

    The table of bands has a row per language or script; it is counted and broadcast up to
    ``BROADCAST_BANDS`` rows, so that a language's documents aren't brought together.
    """
    usable = measured.where(~base_failed() & (F.col("n_tokens") >= LEAST_TOKENS))
    middle = common.small(usable.groupBy("band").agg(*[F.percentile_approx(m, 0.5, 10_000).alias(f"_mid_{m}") for m in MEASURES]), BROADCAST_BANDS, "bands")
    off = usable.join(middle, "band").groupBy("band").agg(
        *[F.first(f"_mid_{m}").alias(f"_mid_{m}") for m in MEASURES],
        *[F.percentile_approx(F.abs(F.col(m) - F.col(f"_mid_{m}")), 0.5, 10_000).alias(f"_mad_{m}") for m in MEASURES],
    )
    out = measured.join(common.small(off, BROADCAST_BANDS, "bands"), "band", "left")
    bad = []
    for m in MEASURES:
        least = F.lit(LEAST_HALF[m]) * (F.lit(1.0) if m == "byte_share" else F.col(f"_mid_{m}"))
        half = F.greatest(F.lit(width) * F.col(f"_mad_{m}"), least)
        gap = F.col(m) - F.col(f"_mid_{m}")
        outside = (gap > half) if m == "byte_share" else (F.abs(gap) > half)
        bad.append(F.when(outside & (F.col("n_tokens") >= LEAST_TOKENS), F.lit(m)))
    out = out.withColumn("rejected_by", F.concat_ws(",", *bad)).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return out.drop(*[f"_{k}_{m}" for k in ("mid", "mad") for m in MEASURES])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = common.keep(measure(common.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "quality")
    return judge(measured)


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
