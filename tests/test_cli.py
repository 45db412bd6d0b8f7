"""The command line's verbs and exit codes."""

import json

from clausemill import cli


def test_verbs(spark, tmp_path, capsys):
    assert cli.main(["info"]) == 0 and "29 rules" in capsys.readouterr().out
    assert cli.main(["demo"]) == 0
    out = capsys.readouterr().out
    assert "[不合规] R-DP-021" in out and "R-DP-031" in out and "依据: " in out and "未执行" in out and "总体结论: 不合规" in out
    assert cli.main(["rules"]) == 0 and "R-FS-101" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2 and cli.main(["ask", " "]) == 2
    assert cli.main(["ask", "基坑开挖深度超过多少需要专家论证"]) == 0 and "5m" in capsys.readouterr().out
    assert cli.main(["scan", "--mode", "selftest"]) == 0
    assert cli.main(["check", str(tmp_path / "missing.docx")]) == 3


def test_check_and_parse(spark, tmp_path, capsys):
    (tmp_path / "plan.txt").write_text("一、工程概况\n位移控制值为35mm\n")
    assert cli.main(["parse", str(tmp_path / "plan.txt")]) == 0
    got = json.loads(capsys.readouterr().out.strip().split("\n")[0])
    assert (got["doc"], got["sections"], got["lines"], got["cards"][0]["value"], got["meta"]["lines_scanned"]) == ("plan.txt", 1, 2, 35.0, 2)
    assert cli.main(["check", str(tmp_path / "plan.txt"), "--report-dir", str(tmp_path / "out")]) == 1
    assert spark.read.parquet(str(tmp_path / "out/markdown")).first()["name"] == "plan.txt"


def test_ask_and_scan(spark, tmp_path, capsys):
    for k, v in (("thresholds", [{"id": "1", "name": "深度", "op": ">=", "value": 5, "unit": "m", "keywords": ["专家论证"]}]), ("blocks", {"blocks": [{"text": "剪刀撑应连续", "chapter": "c", "article_no": "1"}]})):
        (tmp_path / "k" / k).mkdir(parents=True)
        (tmp_path / "k" / k / "f.json").write_text(json.dumps(v))
    assert cli.main(["ask", "何时需要专家论证", "--knowledge-dir", str(tmp_path / "k")]) == 0 and "5m" in capsys.readouterr().out
    assert cli.main(["ask", "剪刀撑如何设置", "--knowledge-dir", str(tmp_path / "k")]) == 0 and "剪刀撑应连续" in capsys.readouterr().out
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("clean")
    assert cli.main(["scan", str(tmp_path / "s")]) == 0
    (tmp_path / "s/b.txt").write_text("mail a@b.cc")
    assert cli.main(["scan", str(tmp_path / "s")]) == 1


def test_broken_documents_stop_no_other(spark, tmp_path, capsys):
    from clausemill.sources import docx

    (tmp_path / "good.docx").write_bytes(docx.build([("一、工程概况", 1), ("基坑位移控制值为20mm", None)]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    assert cli.main(["check", str(tmp_path)]) == 1
    said = capsys.readouterr()
    assert "bad.docx" in said.err and "bad.pdf" in said.err and "== good.docx ==" in said.out
    assert cli.main(["check", str(tmp_path / "bad.docx")]) == 3 and cli.main(["check", str(tmp_path / "x.odt")]) == 3


def test_git_scans(spark, tmp_path, capsys):
    import subprocess

    from clausemill.sources import docx

    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.net", *a], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "a.txt").write_text("clean")
    (tmp_path / "b.docx").write_bytes(docx.build([("mail c@d.net", None)]))
    (tmp_path / "untracked.txt").write_text("mail e@f.net")
    git("init", "-q")
    git("add", "a.txt")
    git("commit", "-qm", "x")
    assert cli.main(["scan", str(tmp_path), "--mode", "tracked"]) == 0
    git("add", "b.docx")
    assert cli.main(["scan", str(tmp_path), "--mode", "tracked"]) == 1 and "document.xml" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path), "--mode", "metadata"]) == 1 and "author: a@b.net" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path / "nothing"), "--mode", "metadata"]) == 3


def test_benchmark(spark, tmp_path, capsys):
    assert cli.main(["benchmark", "--out", str(tmp_path / "r.json")]) == 0 and "80/80" in capsys.readouterr().out
    assert json.loads((tmp_path / "r.json").read_text())["values"]["tp"] == 180
