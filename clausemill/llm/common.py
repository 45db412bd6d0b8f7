"""What the corpus operators share: folds, word counts and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.workers import ship

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Spark's setting to delete a statement's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A temporary folder is set only where the session has none and runs on this machine alone; a cluster's
    executors wouldn't find each other's files there, so without the setting it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and (of_context := sc._jsc.sc().getCheckpointDir()).isDefined():
        found = of_context.get()
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="clausemill-")


#: Lists of the tables kept since a :func:`scratch` began, the innermost last.
_scratch: list[list[DataFrame]] = []


def keep(df: DataFrame, name: str, *by: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read, not the work before it, and
    what is read twice is computed once. The shuffle files behind the table go when it is written;
    they would otherwise stay on the executors' disks until the driver collects its garbage.
    A table with ``buckets`` (number, column) is grouped by that column in later reads without a shuffle.
    """
    spark, mark = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/clausemill/{mark}"
    conf, writer = spark.conf, df.write.option("compression", "zstd")
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    table = f"clausemill_{mark}".replace("-", "_") if buckets else None
    try:
        if table:
            writer.bucketBy(*buckets).option("path", path).saveAsTable(table)
        else:
            (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = spark.table(table) if table else spark.read.schema(df.schema).parquet(path)
    out._kept_at, out._kept_as = path, table
    for inner in _scratch[-1:]:
        inner.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables kept within are deleted at the end, but for those that are to last (:func:`lasting`)."""
    _scratch.append([])
    try:
        yield
    finally:
        drop(*_scratch.pop())


def lasting(df: DataFrame) -> DataFrame:
    """Take a kept table out of the current :func:`scratch`; it belongs to the one around it, if any."""
    if _scratch:
        _scratch[-1][:] = [x for x in _scratch[-1] if x is not df]
        for outer in _scratch[-2:-1]:
            outer.append(df)
    return df


def small(df: DataFrame, most: int, name: str = "small") -> DataFrame:
    """``df`` kept as a table, to be broadcast if it has at most ``most`` rows; else joined as any other."""
    kept = keep(df, name)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def drop(*frames: DataFrame) -> None:
    """Delete tables of :func:`keep` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            if df._kept_as:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._kept_as}")
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % m


def held_out(doc_id: str | Column, m: int) -> Column:
    """True where the remainder is 1; a null id is never held out."""
    return F.coalesce(crc_mod(doc_id, m) == 1, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words of a text, null: 0. Splits once; no array of matches is built."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: F.ascii(c).between(9, 13) | (F.ascii(c) == 32)
    return F.when(t == "", F.lit(0)).otherwise(
        F.size(F.split(t, GAP)) - F.when(edge(F.left(t, F.lit(1))), 1).otherwise(0) - F.when(edge(F.right(t, F.lit(1))), 1).otherwise(0)
    ).cast("long")


def sql_n_words(text: str) -> str:
    """The same in DuckDB."""
    return f"CAST(len(regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT)"


def arrow(df: DataFrame, fn: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` whose workers have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, columns: Sequence[str], fn: Callable[..., Iterable], schema: str, keep: Sequence[str] = (), rows: int | None = 512) -> DataFrame:
    """``fn`` gets the lists of ``columns`` of some rows and returns the columns of ``schema`` as lists or arrays.

    Columns to ``keep`` come first in the result and stay as they are; ``fn`` then returns a value per row.
    It gets ``rows`` rows at a time, so that Python holds few texts at once; None: an Arrow batch, for
    functions that sum up what they are given.
    """
    from pyspark.sql.types import StructType

    kept = [df.schema[c] for c in keep]
    fields = StructType([*kept, *StructType.fromDDL(schema)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(fields)
        for b in batches:
            for at in range(0, b.num_rows, rows or b.num_rows):
                part = b.slice(at, rows) if rows else b
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                out = [*map(column, keep), *fn(*(column(c).to_pylist() for c in columns))]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for f, x in zip(want, out, strict=True)], schema=want)

    return arrow(df.select(*dict.fromkeys([*keep, *columns])), run, fields)
