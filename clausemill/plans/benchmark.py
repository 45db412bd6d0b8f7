"""The benchmark: labelled plans are rendered, reviewed and scored, and held against the acceptance gates."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.operators import evaluate as E, synth
from clausemill.plans import review as V
from clausemill.sources import files, tables


@dataclass(frozen=True)
class Corpus:
    """Rendered plans, the values and findings that they must give."""

    raw: DataFrame
    docs: DataFrame
    truth: DataFrame
    expected: DataFrame


def generated(spark: SparkSession, pits: int = 30, formwork: int = 10) -> Corpus:
    """Plans whose parameters follow from their numbers."""
    pit, form = synth.specs(spark, pits), synth.specs(spark, formwork, True, pits)
    raw = synth.render(pit).union(synth.render(form, True))
    docs = pit.select("doc_id").union(form.select("doc_id"))
    return Corpus(raw, docs, synth.truth(pit).union(synth.truth(form, True)), synth.expected(pit).union(synth.expected(form, True)))


def labelled(spark: SparkSession, path: str) -> Corpus:
    """Plans of a folder of truth files."""
    rows = files.truth(spark, path).withColumn("doc_id", F.xxhash64("file"))
    pit, form = (rows.where(F.col("category") == c) for c in ("deep_pit", "formwork_support"))
    raw = synth.render(synth.from_truth(pit)).union(synth.render(synth.from_truth(form, True), True))
    return Corpus(raw, rows.select("doc_id", F.col("file").alias("name")), synth.labelled_values(rows), synth.injected(rows))


def run(spark: SparkSession, corpus: Corpus, rules: DataFrame | None = None) -> dict:
    """Scores of the corpus: values by parameter and in total, detections by type, forced findings, gates."""
    r = V.review(corpus.raw, tables.rules(spark) if rules is None else rules, corpus.docs)
    found = r.findings.cache()
    try:
        prf = E.prf(E.matched(corpus.truth, r.cards.selectExpr("doc_id", "param_id AS param", "value AS num", "text_value AS txt")))
        of_param = {row["param"]: row.asDict() for row in prf.collect()}
        of_type = {row["type"]: row.asDict() for row in E.detection_rate(E.detections(corpus.expected, found)).collect()}
        forced = E.false_positives(found, corpus.expected).count()
    finally:
        found.unpersist()
    total, hits = of_param.pop(None, {"f1": 0.0}), of_type.pop(None, {"rate": 0.0})
    gates = {"f1": total["f1"] >= E.LEAST_F1, "detection": hits["rate"] == 1.0, "false_positives": forced == 0}
    return {"values": total, "per_param": of_param, "detection": hits, "per_type": of_type, "forced": forced, "gates": gates}


def table(result: dict) -> str:
    """The result as a Markdown table."""
    v, d, ok = result["values"], result["detection"], lambda *g: "✅" if all(result["gates"][x] for x in g) else "❌"
    return "\n".join([
        "| 基准 | 指标 | 结果 | 目标 | 达标 |", "| --- | --- | --- | --- | --- |",
        f"| 参数解析 | P / R / F1 | {v.get('precision', 0):.4f} / {v.get('recall', 0):.4f} / {v['f1']:.4f} | F1 ≥ {E.LEAST_F1} | {ok('f1')} |",
        f"| 端到端核查 | 检出率 / 误报 | {d['rate'] * 100:.1f}%（{d.get('hits', 0)}/{d.get('total', 0)}） / {result['forced']} | 100% / 0 | {ok('detection', 'false_positives')} |",
    ])


def write(result: dict, path: str) -> None:
    """The result as JSON, without a time, so that equal results are equal files."""
    Path(path).write_text(json.dumps(result, ensure_ascii=False, indent=2, sort_keys=True), "utf-8")


def exit_code(result: dict) -> int:
    return int(not all(result["gates"].values()))
