"""Scores against labelled truth: matched values, precision and recall, detections, false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Numbers whose difference is at most this share of the larger one are equal.
CLOSE = 1e-9


def matched(truth: DataFrame, got: DataFrame, keys: tuple[str, ...] = ("doc_id", "param")) -> DataFrame:
    """One-to-one matches by value: ``keys``, value (as text) and how often it is tp, fp and fn.

    Both sides have ``keys``, num (double) and txt (string); a row without either is left out, and texts never match
    numbers. Sorted numbers go on in one class while each is close to the one before; in a class as many values
    match as the side with fewer has, so no value is matched twice, and the rest of either side stays.
    """
    side = lambda df, k: df.select(*keys, "num", "txt", F.lit(k).alias("_side")).where("num is not null or txt is not null")
    w = Window.partitionBy(*keys, F.col("txt").isNull()).orderBy("num")
    before = F.lag("num").over(w)
    apart = before.isNull() | (F.abs(F.col("num") - before) > F.lit(CLOSE) * F.greatest(F.abs("num"), F.abs(before)))
    both = side(truth, 0).union(side(got, 1)).withColumn("_new", F.when(F.col("txt").isNull() & apart, 1).otherwise(0))
    classed = both.withColumn("_class", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = classed.groupBy(*keys, "txt", F.when(F.col("txt").isNull(), F.col("_class")).alias("_class")).agg(
        F.min("num").alias("num"), F.count_if(F.col("_side") == 0).alias("n_truth"), F.count_if(F.col("_side") == 1).alias("n_got")
    )
    tp = F.least("n_truth", "n_got")
    value = F.coalesce(F.concat(F.lit("t"), "txt"), F.concat(F.lit("n"), F.col("num").cast("string")))
    return sums.select(*keys, value.alias("value"), tp.alias("tp"), (F.col("n_got") - tp).alias("fp"), (F.col("n_truth") - tp).alias("fn"))


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def scored(sums: DataFrame) -> DataFrame:
    """Adds precision, recall (1 without cases) and f1 (0 if both are 0) to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def prf(matches: DataFrame, by: str = "param") -> DataFrame:
    """Micro scores per ``by`` and in total (null): one pass with a rollup."""
    sums = matches.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping(by).alias("_all"))
    return scored(sums.select(F.when(F.col("_all") == 0, F.col(by)).alias(by), "tp", "fp", "fn"))


def detections(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``expected`` (doc_id, inj_no, type, rule_id, result, primary) to one row per injection: hit if all its pairs were found."""
    got = found.select("doc_id", "rule_id", "result").distinct().withColumn("_hit", F.lit(1))
    x = expected.join(got, ["doc_id", "rule_id", "result"], "left")
    return x.groupBy("doc_id", "inj_no", "type").agg((F.min(F.coalesce("_hit", F.lit(0))) == 1).alias("hit"))


def detection_rate(detected: DataFrame) -> DataFrame:
    """Hits, total and rate per injection type and over all (null)."""
    sums = detected.rollup("type").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), F.grouping("type").alias("_all"))
    return sums.select(F.when(F.col("_all") == 0, F.col("type")).alias("type"), "hits", "total", ratio(F.col("hits"), F.col("total")).alias("rate"))


def false_positives(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Fail and manual findings that no injection explains: doc_id, rule_id, result."""
    pairs = found.where(F.col("result") != "pass").select("doc_id", "rule_id", "result").distinct()
    return pairs.join(expected.select("doc_id", "rule_id", "result").distinct(), ["doc_id", "rule_id", "result"], "left_anti")


#: The least F1 that is accepted.
LEAST_F1 = 0.95


def gates(total: DataFrame, rate: DataFrame, wrong: DataFrame, least_f1: float = LEAST_F1) -> dict[str, bool]:
    """The acceptance gates, from the one-row totals."""
    f1 = total.where("param is null").select("f1").first()
    r = rate.where("type is null").select("rate").first()
    return {"f1": bool(f1 and f1[0] >= least_f1), "detection": bool(r and r[0] == 1.0), "false_positives": wrong.limit(1).count() == 0}
