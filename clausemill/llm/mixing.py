"""Mixing sources to target weights.

Tokens are summed per source, targets are the weighted shares of all tokens, stopped at a
multiple of the source's own size, and every document is emitted floor(rate) times plus one
Bernoulli copy seeded by a hash of its id. All of it is DataFrame code: one scan, one
partial aggregation to a row per source, one join with that table.

What a source takes is near its target by the law of large numbers only: with n documents of like size it differs by some 1 / (2 sqrt(n)) of
its size, more where few long documents hold most of its words. Windows go over the one row per source, in one task.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source
of its own, sorted last; documents with a null id draw by their text; repeated rows with the
same id and source draw alike; a very long text counts whole; sources that reach their stop at the same level go in code-point order; extra
columns are left out, ``mix`` keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clausemill.llm import common

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: A table of more sources than this isn't broadcast.
BROADCAST_SOURCES = 100_000
BITS = 52


def draw(doc_id: Column, text: Column, source: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the id and the source only (a null id: on the text)."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)), F.coalesce(source, F.lit("\0")))
    return F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(2**BITS))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source of ``sizes`` (source, source_size: one row per source).

    Sources take the weights in code-point order, null last. They share the total by weight;
    a target stops at ``most`` times the size and the excess is reshared by weight among the
    others. Sorted by cap per unit of weight the capped sources come first, so running sums
    over the one row per source give the fixed point without iterating. The windows hold one
    row for each source, never documents.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_rank"))
    capped = ranked.withColumns({"_w": w, "_cap": F.col("source_size") * most})
    level = capped.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    stops = F.col("_cap") * F.col("_weight") <= F.col("_left") * F.col("_w")
    sums = level.withColumn("_stops", stops).withColumns({
        "_rest": F.col("_total") - F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0)).over(everything),
        "_open": F.sum(F.when(~F.col("_stops"), F.col("_w")).otherwise(0)).over(everything),
    })
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_rest") / F.col("_open"))
    return sums.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and the columns ``carry``) for every document.

    The one pass over the texts keeps a narrow table (id, source, size, draw); sums and the
    join read that. The table of sources is counted and broadcast up to ``BROADCAST_SOURCES``
    rows; beyond that Spark splits a hot source in the sort-merge join.
    """
    narrow = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), F.col("source"), seed).alias("_u"), *carry)
    kept = narrow if carry else common.keep(narrow, "mix")
    targets = source_targets(kept.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    t = common.small(targets.select(F.col("source").alias("_source"), "source_size", "target"), BROADCAST_SOURCES, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("_rate") + F.when(F.col("_u") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return (
        kept.join(t, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("copies", copies.cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_rate", "_u")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as its rate says, all columns kept."""
    all_columns = [F.col(c) for c in docs.columns]
    packed = docs.select("doc_id", "source", "text", F.struct(*all_columns).alias("_row"))
    return plan(packed, weights, most, seed, carry=("_row",)).select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select("_row.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def plan_sql(docs: str = "documents") -> str:
    """The same plan in DuckDB, over a relation with doc_id, text, source."""
    w = f"CASE r % {len(WEIGHTS)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(WEIGHTS)) + " END"
    return f"""
WITH narrow AS (
  SELECT doc_id, source, {common.sql_n_words('text')} AS size,
         CAST(('0x' || substr(sha256('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))) || '|' || coalesce(source, chr(0))), 1, {BITS // 4})) AS BIGINT) / {float(2**BITS)!r} AS u
  FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM narrow GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sizes),
capped AS (SELECT *, {w} AS w, source_size * {MOST} AS cap FROM ranked),
level AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wt
  FROM capped),
stops AS (SELECT *, cap * wt <= lft * w AS stops FROM level),
sums AS (SELECT *, CAST(total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest, CAST(sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS BIGINT) AS opn FROM stops),
targets AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / opn END AS target FROM sums),
rated AS (
  SELECT n.doc_id, n.source, n.size, t.source_size, t.target, n.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM narrow n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source),
planned AS (
  SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM planned"""


QUERIES = {"op7_mix": op7_mix}
SQL = {"op7_mix": plan_sql()}
