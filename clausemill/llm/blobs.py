"""Exchange of packed arrays between chunks of documents and buckets of keys.

Corpus statistics that need a row per token are too large to shuffle as rows. Here a chunk of
documents packs what it has for a bucket into one compressed value, buckets answer chunks the
same way, and Spark shuffles, spills and retries these rows as any others. A bucket holds the
keys that hash to it, so the number of buckets, not their size, grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import common

#: Rows of every exchange: to whom, from whom, what kind, and the packed arrays.
SCHEMA = "`to` long, `from` long, kind string, data binary"
MOST_PARTITIONS = 1 << 16


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of numbers as one compressed value; bytes of equal weight stand together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) if a.size else b""
        parts += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        dtype = np.dtype(data[at : at + 8].decode().strip())
        n, size = int.from_bytes(data[at + 8 : at + 16], "little"), int.from_bytes(data[at + 16 : at + 24], "little")
        at += 24
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=n * dtype.itemsize) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.empty(0, dtype))
        at += size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the fewest bytes that hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def splits(df: DataFrame) -> int:
    """Number of partitions in which ``df`` is read: it follows the input."""
    return max(1, df.rdd.getNumPartitions())


def size(n_splits: int, least: int, per_split: int, message: int = 100) -> int:
    """Units (bytes, tokens) of a chunk and of a bucket for so many splits of ``per_split`` units.

    Chunks times buckets are the rows of an exchange. For a row to hold ``message`` units the product of the two sizes
    is ``message`` times the whole: both grow with the root of the input, from ``least`` on.
    """
    return max(least, int((message * n_splits * per_split) ** 0.5))


def meet(table: DataFrame, rows: DataFrame, answer: Callable[[int, dict, list[tuple[int, str, bytes]]], Iterable[tuple]], schema: str = SCHEMA) -> DataFrame:
    """``answer`` (to, the columns of ``table``'s row, [(from, kind, data)]) for every row of ``table``.

    ``table`` is kept in buckets by ``to`` (:func:`common.keep`), so it is read in place and only ``rows`` are shuffled.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(left, right):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(fields)
        out: list[tuple] = []
        got = sorted(zip(*(right.column(c).to_pylist() for c in ("from", "kind", "data")), strict=True), key=lambda r: r[:2])
        for own in left.to_pylist():
            out += answer(own["to"], own, got)
        columns = zip(*out, strict=True) if out else [[]] * len(want)
        return pa.Table.from_arrays([pa.array(x, type=t) for x, t in zip(columns, want.types, strict=True)], schema=want)

    common.ship(table.sparkSession)
    return table.groupBy("to").cogroup(rows.select("to", "from", "kind", "data").groupBy("to")).applyInArrow(run, fields)


def exchange(rows: DataFrame, answer: Callable[[int, list[tuple[int, str, bytes]]], Iterable[tuple]], receivers: int, schema: str = SCHEMA) -> DataFrame:
    """Bring the rows ``to`` the same receiver together; ``answer`` (to, [(from, kind, data)]) yields rows of ``schema``.

    A receiver's rows come sorted by sender and kind, so its answer doesn't depend on the order of arrival. Partitions
    follow the number of receivers, so a task's share doesn't grow with the input.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(fields)

        def out(to, got):
            rows_ = []
            for r in answer(to, got):
                rows_.append(r)
                if len(rows_) >= 256:
                    yield batch(rows_)
                    rows_ = []
            if rows_:
                yield batch(rows_)

        def batch(rows_):
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows_, strict=True), want.types, strict=True)], schema=want)

        now, got = None, []
        for b in batches:
            for to, frm, kind, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if to != now:
                    if got:
                        yield from out(now, got)
                    now, got = to, []
                got.append((frm, kind, data))
        if got:
            yield from out(now, got)

    return common.arrow(rows.select("to", "from", "kind", "data").repartition(max(1, min(receivers, MOST_PARTITIONS)), "to").sortWithinPartitions("to", "from", "kind"), run, fields)


def each(rows: DataFrame, fn: Callable[[int, list[tuple[int, str, bytes]]], Iterable[tuple]]) -> DataFrame:
    """``fn`` over every row by itself, without a shuffle."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(SCHEMA)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(fields)
        for b in batches:
            for to, frm, kind, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out := list(fn(to, [(frm, kind, data)])):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), want.types, strict=True)], schema=want)

    return common.arrow(rows.select("to", "from", "kind", "data"), run, fields)


def of(kind: str) -> object:
    return F.col("kind") == kind
