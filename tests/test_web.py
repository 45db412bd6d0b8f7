"""Office documents written here are read back; the HTTP service."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from clausemill import web
from clausemill.operators import synth
from clausemill.plans import review as V
from clausemill.sources import docx, files, tables


def test_docx_round_trip():
    blocks = [("标题", 0), ("一、概况", 1), ("正文 <a> & b", None), [["x", "y"], ["1", "2"]], ("细节", 2)]
    assert list(files.docx_lines(docx.build(blocks))) == [("标题", None), ("一、概况", 1), ("正文 <a> & b", None), ("x", 0), ("y", 0), ("1", 0), ("2", 0), ("细节", 2)]


def test_samples_and_reports(spark, tmp_path):
    spec = synth.specs(spark, 3)
    for r in docx.samples(synth.render(spec)).collect():
        (tmp_path / f"{r['doc_id']}.docx").write_bytes(r["content"])
    raw = files.docx(spark, str(tmp_path)).selectExpr("CAST(split(doc, '[.]')[0] AS BIGINT) AS doc_id", "pos", "text", "level")
    direct, read = V.review(synth.render(spec), tables.rules(spark)), V.review(raw, tables.rules(spark))
    assert sorted(map(tuple, read.summary().collect())) == sorted(map(tuple, direct.summary().collect()))
    made = docx.reports(direct.markdown()).first()["content"]
    lines = [t for t, _ in files.docx_lines(made)]
    assert "专项施工方案审查报告" in lines and "R-DP-021 " .strip() in " ".join(lines)


def test_service(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor/a.js").write_text("1")
    (tmp_path / "b").write_text("2")
    s = web.server(spark, 0, vendor=str(tmp_path / "vendor"))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/api/health"))["status"] == "ok"
    body = docx.build([("一、概况", 1), ("位移控制值为35mm", None), ("开挖深度900m", None)])
    got = json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/api/review?name=a.docx", body)))
    assert got["doc"] == "a.docx" and got["summary"]["fail"] >= 1 and got["discarded"][0]["value"] == 900.0 and got["rules_total"] == 29
    assert json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/api/ask", b'{"query": "x"}')))["route"] == "empty"
    assert {"rule_name", "level", "basis", "result_label", "evidence"} <= set(got["findings"][0]) and got["findings"][0]["basis"] and got["cards"][0]["section"] == "一、概况" and len(got["stages"]) == 4
    assert json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/api/ask", '{"query": "基坑开挖深度超过多少需要专家论证"}'.encode())))["route"] == "threshold"
    assert b"<title>" in urllib.request.urlopen(url).read() and urllib.request.urlopen(f"{url}/vendor/a.js").read() == b"1"
    for path, body, code in (("/api/review?name=a.exe", b"x", "400"), ("/api/review?name=a.docx", b"x", "400"), ("/api/ask", b'{"query": " "}', "400"), ("/vendor/..%2Fb", None, "404"), ("/x", None, "404")):
        with pytest.raises(urllib.error.HTTPError, match=code):
            urllib.request.urlopen(urllib.request.Request(url + path, body))
    s.shutdown()
