"""Near duplicates by SimHash and pigeonhole blocks.

A fingerprint has a bit set if over half of the text's shingle hashes have it set. 64 bits
are cut into ``BLOCKS`` blocks; two fingerprints that differ in at most ``DISTANCE`` bits agree
in ``BLOCKS - DISTANCE`` blocks at least, so they meet under one of the keys made of so many
blocks, and their Hamming distance is then verified.

Exact copies fall together first (one row per distinct fingerprint). Keys are counted with
partial sums; a key of two fingerprints gives its pair straight from its minimum and maximum.
A key of more than ``CHUNK`` members is split by the bits that aren't in it, which are cut into parts again (pigeonhole
within pigeonhole: four rows a member for some hundredth of the group size). What is larger even then is cut into chunks, and
every pair of chunks is a group of its own, so no group grows with the data; a group returns links to the smallest
member of each of its components, not its pairs. Components are joined over all groups.

Defined cases: a null or empty text has fingerprint zero and links like any other; rows
with a null id take part and a component of none but null ids has a null id; a very long text is hashed
65,536 shingles at a time; a bit that is set in just half of the hashes isn't set; repeated
rows stay repeated (``dedupe`` keeps one row of a class, ties by a hash of the row); extra columns are left out, ``dedupe``
keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.llm import common, graph

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
CHUNK = 2048
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = [xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + (1 << 16)))]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every document."""

    return common.map_rows(docs, ["text"], lambda texts: [[fingerprint(t, shingle) for t in texts]], "fp long", keep=("doc_id",))


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed masks of all choices of ``blocks - distance`` blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def parts(mask: int, n: int) -> list[int]:
    """The bits of a signed mask in ``n`` parts of about as many, as signed masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    out = [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _linked(batches: Iterable, distance: int) -> Iterable:
    """Sorted rows (key, lo, hi, fp) to links (a, b): each group's components, as stars around their smallest."""
    import pyarrow as pa

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        vertex, at = np.unique(fp, return_inverse=True)
        root = np.arange(len(vertex))
        end = np.searchsorted(key, key, "right")  # key: number of the group, ascending
        here = np.arange(len(fp))
        bits = fp.view(np.uint64)
        step = 1
        while len(here := here[here + step < end[here]]):
            near = np.bitwise_count(bits[here] ^ bits[here + step]) <= distance
            a, b = at[here[near]], at[here[near] + step]
            while len(a):
                a, b = root[a], root[b]
                low, high = np.minimum(a, b), np.maximum(a, b)
                open_ = low != high
                a, b = low[open_], high[open_]
                if not len(a):
                    break
                np.minimum.at(root, b, a)
                while (root != root[root]).any():
                    root = root[root]
            step += 1
        out = root != np.arange(len(vertex))
        return pa.RecordBatch.from_arrays([pa.array(vertex[out]), pa.array(vertex[root[out]])], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.concatenate(([0], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))).cumsum()
        last = int(np.searchsorted(new, new[-1]))  # the last group may go on in the next batch
        rest = [c[last:] for c in cols]
        if last:
            yield links(new[:last], cols[3][:last])
    if rest is not None:
        yield links(np.zeros(len(rest[3]), np.int64), rest[3])


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``distance`` bits."""
    each = masks(blocks, distance)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(each)])
    members = distinct.select("fp", F.posexplode(keys).alias("i", "key"))
    sizes = common.keep(members.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "keys")
    pairs = sizes.where("n = 2").where(_near(F.col("a"), F.col("b"), distance)).select("a", "b")
    some = members.join(sizes.where(F.col("n").between(3, chunk)).select("key"), "key").select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    # Of a frequent key the other bits are cut again: pairs agree in one of ``distance`` + 1 parts of them.
    rest = F.array(*[F.array(*map(F.lit, parts(~m, distance + 1))) for m in each])
    finer = F.transform(F.element_at(rest, F.col("i") + 1), lambda m, j: F.xxhash64(F.col("key"), j, F.col("fp").bitwiseAND(m)))
    often = members.join(sizes.where(F.col("n") > chunk).select("key"), "key").select("fp", F.explode(finer).alias("key"))
    counted = often.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    many = often.join(counted, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    dealt = many.select("key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"))
    groups = some.union(dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp"))
    sorted_ = groups.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return pairs.union(common.arrow(sorted_, lambda batches: _linked(batches, distance), "a long, b long"))


def _named(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fp, component_id and root (the smallest fingerprint of the class) of every distinct fingerprint."""
    distinct = common.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = graph.components(links(distinct.select("fp"), distance, blocks), "links")
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = common.keep(named, "roots")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return common.keep(named.join(ids, "root").select("fp", "component_id", "root"), "classes")


def classes(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``fps`` (doc_id, fp) with component_id: the smallest doc_id that links reach."""
    return fps.join(_named(fps, distance, blocks).drop("root"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id for every document."""
    return classes(common.keep(fingerprints(docs, shingle), "simhash"), distance)


def dedupe(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents, one of each class: the one with the smallest id, without ids any; ties go by a hash of the text, then of the row.

    Documents are held against the ids that go, the shorter list; all columns are kept. Ids that repeat or are
    missing don't tell which row goes: only where there are such rows do they take a way of their own, by
    their fingerprint.
    """
    fps = common.keep(fingerprints(docs.select("doc_id", "text"), shingle), "simhash")
    of = _named(fps, distance, BLOCKS)
    found = fps.join(of, "fp")
    odd = fps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    again = common.keep(odd.select(F.col("doc_id").alias("__cm_id")), "again")
    gone = common.keep(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return kept
    several = docs.join(again.where("__cm_id is not null"), docs["doc_id"] == again["__cm_id"], "left_semi").union(docs.where("doc_id is null"))
    rows = several.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    marked = common.map_rows(rows, ["text"], lambda texts: [[fingerprint(t, shingle) for t in texts]], "_fp long", keep=("doc_id", "text", "_row"))
    first = marked.join(of, (F.col("_fp") == F.col("fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    order = F.struct(F.xxhash64("text"), F.xxhash64(F.to_json("_row")), F.to_json("_row"))
    back = first.groupBy("root").agg(F.min_by("_row", order).alias("_row")).select("_row.*")
    alone = kept.join(again, kept["doc_id"] == again["__cm_id"], "left_anti")
    return alone.unionByName(back)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
