"""Files, streams, the synthetic corpus and the entry point."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausemill.operators import evaluate as E, synth
from clausemill.plans import catalog, review as V
from clausemill.sources import files, model, tables
from clausemill.streaming import arrivals

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, blocks):
    p = lambda t, s: f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(p(*b) if isinstance(b, tuple) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c, '')}</w:tc>" for c in row) + "</w:tr>" for row in b) + "</w:tbl>" for b in blocks)
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="a0"><w:name w:val="Title"/></w:style></w:styles>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", styles)


def test_docx(spark, tmp_path):
    docx(tmp_path / "a.docx", [("标题", "a0"), ("一、工程概况", "a1"), (" ", ""), ("基坑开挖深度为5.4m。", ""), [["一、甲", "监测频率为2次/d"], ["x", ""]], ("3.2 支护", "")])
    raw = files.docx(spark, str(tmp_path)).withColumn("doc_id", F.lit(1).cast("long"))
    r = V.review(raw, tables.rules(spark))
    assert [(x["text"], x["section_path"]) for x in r.lines.orderBy("line_no").collect()] == [
        ("标题", ""), ("一、工程概况", "一、工程概况"), ("基坑开挖深度为5.4m。", "一、工程概况"), ("一、甲", "一、工程概况"), ("监测频率为2次/d", "一、工程概况"), ("x", "一、工程概况"), ("3.2 支护", "一、工程概况/3.2 支护"),
    ]
    assert [x["title"] for x in r.sections.orderBy("ord").collect()] == ["一、工程概况", "3.2 支护"]
    assert {(x["param_id"], x["value"]) for x in r.cards.collect()} == {("dp.excavation_depth", 5.4), ("dp.monitoring.frequency", 2.0)}
    assert files.zip_entries(spark, str(tmp_path)).where("text like '%开挖深度%'").count() == 1


def test_dispatch(spark):
    df = spark.createDataFrame([("/x/a.DOCX",), ("/x/b.pdf",)], "path string")
    assert [r["suffix"] for r in files.dispatched(df).collect()] == [".docx", ".pdf"]
    with pytest.raises(Exception, match="unknown format"):
        files.dispatched(spark.createDataFrame([("/x/a.txt",)], "path string")).collect()


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"doc": "d", "page": p, "text": t}) for p, t in ((1, "一、概况\n\n深"), (2, " b "))))
    assert [(r["page"], r["text"]) for r in files.pages(spark, str(tmp_path)).orderBy("pos").collect()] == [(1, "一、概况"), (1, "深"), (2, "b")]


def test_configuration(spark, tmp_path):
    rule = {"id": "r2", "name": "n", "check_type": "threshold_max", "param": "p", "op": "<=", "value": 3, "level": "强制", "severity": "error", "basis": {"quote": "q", "status": "s"}}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/b.json").write_text(json.dumps([rule, rule | {"id": "r3", "basis": "plain", "enabled": False}]))
    (tmp_path / "r/a.json").write_text(json.dumps({"rules": [rule | {"id": "r1", "basis": {"standard": "s1"}}]}))
    got = files.rules(spark, str(tmp_path / "r")).orderBy("pos").collect()
    assert [(r["id"], r["basis"], r["enabled"], r["value"]) for r in got] == [("r1", "s1", True, 3.0), ("r2", "q", True, 3.0), ("r3", "plain", False, 3.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/f.json").write_text(json.dumps({"meta": {"status_default": "ok"}, "blocks": [{"text": "t", "doc": "own"}, {"text": "u", "tags": ["x"]}]}))
    assert [(r["doc"], r["status"], r["tags"]) for r in files.blocks(spark, str(tmp_path / "b")).orderBy("block_id").collect()] == [("own", "ok", []), ("f", "ok", ["x"])]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/t.json").write_text(json.dumps({"meta": {"category": "c"}, "thresholds": [{"id": "1", "value": 3, "keywords": ["k"]}, {"id": "2", "value": ["a", "b"], "doc": "d"}]}))
    from clausemill.operators.knowledge import value_text

    assert [(r["id"], r["doc"], r["v"]) for r in files.thresholds(spark, str(tmp_path / "t")).orderBy("pos").select("id", "doc", value_text(F.col("value")).alias("v")).collect()] == [("1", "c", "3"), ("2", "d", "a～b")]
    (tmp_path / "al.json").write_text(json.dumps({"p": ["ab", "abc", "xy"]}))
    assert files.aliases(spark, str(tmp_path / "al.json")) == {"p": ["abc", "ab", "xy"]}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/x.json").write_text(json.dumps({"file": "f", "category": "c", "seed": 1, "title": "t", "expected_cards": {"p": [1.5, "a"]}, "injected": [{"type": "k", "detail": "d", "expect": {"rule_id": "r", "result": "fail"}}]}))
    t = files.truth(spark, str(tmp_path / "g")).first()
    assert t["expected_cards"] == {"p": ["1.5", "a"]} and t["injected"][0]["expect"]["rule_id"] == "r"


def test_resume(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"file": "a", "tp": 1}\n\n{"file": "b", "tp": 2}\n{"file": "a", "tp": 3}\n{"file": "c", "t')
    assert sorted(tuple(r) for r in files.resumed(spark, str(tmp_path / "log.jsonl"), "file string, tp int").collect()) == [("a", 3), ("b", 2)]


def test_model_is_off_without_configuration(monkeypatch):
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    assert model.Model.from_env() is None


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "基坑\n位移控制值35mm"), (2, "基坑")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        q = arrivals.review_stream(stream, tables.rules(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        out = spark.read.parquet(str(tmp_path / "out"))
        assert out.where("rule_id = 'R-DP-021' and result = 'fail'").count() == 1, k


def test_corpus(spark):
    for formwork, n in ((False, 30), (True, 10)):
        spec = synth.specs(spark, n, formwork)
        r = V.review(synth.render(spec, formwork), tables.rules(spark), spec.select("doc_id"))
        got = r.cards.selectExpr("doc_id", "param_id AS param", "value AS num", "text_value AS txt")
        total, rate = E.prf(E.matched(synth.truth(spec, formwork), got)), E.detection_rate(E.detections(synth.expected(spec, formwork), r.findings))
        assert E.gates(total, rate, E.false_positives(r.findings, synth.expected(spec, formwork))) == {"f1": True, "detection": True, "false_positives": True}
        assert r.discarded.count() == spec.where("array_contains(defects, 'unit_error')").count()


def test_catalog():
    assert set(catalog.SQL) == set(catalog.QUERIES)


def test_workers_need_no_path(tmp_path):
    """From another folder, without PYTHONPATH: the workers get the package from the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    docx(tmp_path / "a.docx", [("一、工程概况", "a1"), ("正文", "")])
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from clausemill.sources import files
print("ROWS", files.docx(spark, {str(tmp_path)!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]
