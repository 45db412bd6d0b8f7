"""Benchmark decontamination by a prefix-filtered join.

Items are cut into windows of ``WINDOW`` words (a shorter item is one window). A window can
only occur where all of its words do, so its rarest word, by document frequency over all
documents, is its necessary prefix: a document is probed with its words, a probe gives the
window's only possible place there (positional bound), which must lie within the document
(length bound), and the words there are compared one by one.

The windows go to the executors in blocks of at most ``BLOCK_BYTES`` of item text, whatever
the size of the benchmark; documents pass each block in turn, without a shuffle.

Defined cases: null and empty texts have no words; an item without words, or with a null id,
has no windows; repeated items count once by id; of words as rare the first is a window's prefix; a very long text is
probed a million places at a time; repeated documents are judged alike; extra columns are left out (``clean`` keeps
them); an empty table gives an empty result, an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm import common

WINDOW = 10
#: Bytes of item text of a block. Its windows take about four times as much in a worker, fifteen times while the driver makes them.
BLOCK_BYTES = 8 << 20
#: ASCII letters (lower-cased) and digits are word bytes, as is every byte of a character beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The windows of a block of items as arrays, sorted by the id of their rarest word.

    The items' words stand one after the other in ``stream``; a window is its place there, its length, its item and
    the distance of its rarest word: twenty bytes a word of the items.
    """

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], frequency: dict[bytes, int], size: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        lens = np.array([len(w) for _, w in items], np.int64)
        self.stream = np.array([self.ids.setdefault(x, len(self.ids)) for _, w in items for x in w], np.int32)
        counts = np.array([frequency.get(x, 0) for x in self.ids], np.int64)
        n = np.minimum(lens, size)
        starts = lens.cumsum() - lens
        many = np.where(n > 0, lens - n + 1, 0)
        item = np.repeat(np.arange(len(lens)), many)
        at = np.repeat(starts, many) + np.arange(len(item)) - np.repeat(many.cumsum() - many, many)
        length, rarest, distance = n[item], np.full(len(item), np.iinfo(np.int64).max), np.zeros(len(item), np.int64)
        for k in range(size):  # the word of the lowest frequency, the first of these
            word = counts[self.stream[np.minimum(at + k, max(len(self.stream) - 1, 0))]] if len(at) else at
            better = (k < length) & (word < rarest)
            rarest, distance = np.where(better, word, rarest), np.where(better, k, distance)
        there = np.nonzero(rarest > 0)[0]  # a word that no document has: no window
        by = there[np.argsort(self.stream[at[there] + distance[there]], kind="stable")] if len(there) else there
        self.at, self.length, self.item, self.distance = at[by], length[by].astype(np.int16), item[by].astype(np.int32), distance[by].astype(np.int16)
        edges = np.searchsorted(self.stream[self.at + self.distance], np.arange(len(self.ids) + 1)) if len(by) else np.zeros(len(self.ids) + 1, np.int64)
        self.edges = edges.astype(np.int64)

    def find(self, w: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Start, end and items of every occurrence of a window in the words of a document."""
        if not len(self.at) or self.ids.keys().isdisjoint(w):
            return []
        ids = np.array([self.ids.get(x, -1) for x in w], np.int32)
        places = np.nonzero(ids >= 0)[0]
        many = self.edges[ids[places] + 1] - self.edges[ids[places]]
        places, many = places[many > 0], many[many > 0]
        found: dict[tuple[int, int], list[str]] = {}
        for a in _slices(many):  # probes of some words at a time
            some, n = places[a], many[a]
            k = np.repeat(self.edges[ids[some]] - (n.cumsum() - n), n) + np.arange(int(n.sum()))
            start = np.repeat(some, n) - self.distance[k]
            fits = (start >= 0) & (start + self.length[k] <= len(ids))
            k, start = k[fits], start[fits]
            for d in range(int(self.length[k].max(initial=0))):
                same = (d >= self.length[k]) | (ids[np.minimum(start + d, len(ids) - 1)] == self.stream[np.minimum(self.at[k] + d, len(self.stream) - 1)])
                k, start = k[same], start[same]
            for i, s in zip(k.tolist(), start.tolist(), strict=True):
                items = found.setdefault((s, s + int(self.length[i])), [])
                if self.names[self.item[i]] not in items:
                    items.append(self.names[self.item[i]])
        return [(s, e, items) for (s, e), items in sorted(found.items())]


def _slices(sizes: np.ndarray, most: int = 1 << 20) -> Iterable[slice]:
    """Slices of rows whose sizes sum to about ``most`` at most."""
    part = sizes.cumsum() // most
    edges = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(sizes)])) if len(sizes) else [0]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Sorted spans without overlaps; touching spans become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a block's vocabulary stands, over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of at most BLOCK_BYTES

    def count(texts: list) -> Iterable:
        c: Counter = Counter()
        for t in texts:
            c.update(held.value.intersection(words(t)))
        return [list(c), list(c.values())]

    sums = common.map_rows(docs, ["text"], count, "word binary, n long", rows=None).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in sums.collect()}


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterable[list[tuple[str, list[bytes]]]]:
    """The items, at most about ``most`` bytes at a time: dealt by a hash of the id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", F.lit(n)), F.lit(n)) == k)
        yield [(r["item"], words(r["text"])) for r in block.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``carry``, n_words, spans (word positions hit, without overlaps) and items of every document."""
    names = ["doc_id", *[c for c in carry if c not in ("doc_id", "text")], "text"]
    now = docs.select(*names, F.lit(0).cast("long").alias("_n"), F.lit([]).cast("array<array<long>>").alias("_spans"), F.lit([]).cast("array<string>").alias("_items"))
    schema, last = "_n long, _spans array<array<long>>, _items array<string>", None
    for k, block in enumerate(blocks(benchmark, most)):
        found = Windows(block, frequencies(docs, {x for _, w in block for x in w}), size)
        held = docs.sparkSession.sparkContext.broadcast(found)  # made from one block

        def run(texts: list, spans: list, items: list, held=held) -> Iterable:
            counts, all_spans, all_items = [], [], []
            for t, s, i in zip(texts, spans, items, strict=True):
                w = words(t)
                hits = held.value.find(w)
                counts.append(len(w))
                all_spans.append(merged([*map(tuple, s), *((a, b) for a, b, _ in hits)]) if hits else s)
                all_items.append(sorted({*i, *(x for _, _, f in hits for x in f)}) if hits else i)
            return [counts, all_spans, all_items]

        if k:  # a block at a time: its windows are the only ones an executor holds
            now = common.keep(now, "decontaminate")
            common.drop(*[last] if last is not None else [])
            last = now
        now = common.map_rows(now, ["text", "_spans", "_items"], run, schema, keep=names)
    text = [F.col("text")] if "text" in carry else []
    return now.select("doc_id", *[c for c in carry if c not in ("doc_id", "text")], *text, F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The counts that the spans and items give."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, all columns kept."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return scan(packed, benchmark, carry=("_row",)).where(F.size("spans") == 0).select("_row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, common.read(spark, sf_dir, "benchmark")))


def scan_sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """The digest in DuckDB: every window of every document against all item windows."""
    w = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {w} AS w FROM {benchmark} WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_sized AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM item_words WHERE len(w) > 0),
item_at AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item_sized),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item_at),
sizes AS (SELECT DISTINCT n FROM windows),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({w}, []) AS w FROM {docs}),
doc_at AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT rid, i, a.n, item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc_at) a JOIN windows v ON v.n = a.n AND v.g = a.g),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p ON p.rid = d.rid LEFT JOIN found f ON f.rid = d.rid"""


QUERIES = {"op9_decontaminate": op9_decontaminate}
SQL = {"op9_decontaminate": scan_sql()}
