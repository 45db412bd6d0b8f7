"""The review engine on small inputs: segmentation, extraction, rules, knowledge, scanner, gap filling."""

import json

import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import evaluate as E, extract, gapfill, knowledge as K, report, rules as R, scan, segment, synth
from clausemill.plans import benchmark, review as V
from clausemill.sources import model, tables
from clausemill.sources.tables import Rule


def value(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def of_lines(spark, *lines):
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    return segment.parse(segment.raw_lines(docs))


def numbers(spark, *lines):
    return [(r["param_id"], r["value"], r["unit"], r["raw_text"]) for r in extract.cards(of_lines(spark, *lines)).orderBy("ord").collect()]


def test_fold(spark):
    assert value(spark, T.normalise, "开挖深度为 5. 4 ｍ", "５．４", "1 2 mm", None) == ["开挖深度为5.4m", "5.4", "12mm", None]


def test_strip_and_lines(spark):
    assert value(spark, T.strip, "　 a b\t", "") == ["a b", ""]
    assert value(spark, T.split_lines, "a\r\nb\u2028c\n", "", None, "x") == [["a", "b", "c"], [], [], ["x"]]


def test_heading_levels(spark):
    texts = ["一、工程概况", "3.2 基坑开挖", "3.2.1 一般规定", "1.《规范》；", "基坑开挖深度为5.4m。", "5.4m是深度", "十二、《名称》"]
    assert value(spark, T.heading_level, *texts) == [1, 2, 3, None, None, 1, None]


def test_tokens(spark):
    assert value(spark, T.tokens, "基坑，开挖5.4m深 ABC", "深", "") == [["基坑", "坑开", "开挖", "挖深", "5.4", "m", "abc"], [], []]


def test_located(spark):
    got = value(spark, lambda c: T.located(c, "[0-9]+"), "1a22😀333", "none", "")
    assert [[tuple(x) for x in row] for row in got] == [[("1", 0, 1), ("22", 2, 4), ("333", 5, 8)], [], []]
    many = " ".join(["7"] * 1500)
    assert value(spark, lambda c: T.located(c, "7"), many)[0][-1]["s"] == len(many) - 1


def test_section_stack(spark):
    docs = spark.createDataFrame([(1, k, t, lv) for k, (t, lv) in enumerate([("T", 0), ("A", 1), ("B", 2), ("x", None), ("C", 1), ("D", 3), ("E", 2), ("y", None)])], "doc_id long, pos int, text string, level int")
    parsed = segment.parse(docs).orderBy("line_no")
    assert [r["section_path"] for r in parsed.collect()] == ["", "A", "A/B", "A/B", "C", "C/D", "C/E", "C/E"]
    assert [(r["ord"], r["title"], r["path"]) for r in segment.sections(parsed).orderBy("ord").collect()] == [(0, "A", "A"), (1, "B", "A/B"), (2, "C", "C"), (3, "D", "C/D"), (4, "E", "C/E")]


def test_offsets(spark):
    rows = of_lines(spark, " ab ", "", "cde", "f").orderBy("line_no").collect()
    assert [(r["text"], r["char_start"], r["char_end"]) for r in rows] == [("ab", 0, 2), ("cde", 3, 6), ("f", 7, 8)]


@pytest.mark.parametrize(
    "line, want",
    [
        ("本坑基坑深度约7.25m，放坡。", [7.25]),
        ("分层施工，每层挖深控制在1.8米", []),
        ("东侧挖深810m", []),
        ("东侧挖深8100mm", [8.1]),
        ("挖深不得小于 3 . 6 ｍ", [3.6]),
        ("挖深见开挖深度5m，基坑深度6.2m", [5.0, 6.2]),
        ("监测频次取 3 次/日", [3.0]),
        ("立杆间距一米二", []),
        ("挖深7.7", []),
    ],
)
def test_extract(spark, line, want):
    assert [v for _, v, _, _ in numbers(spark, line)] == want


def test_extract_order_and_conflicts(spark):
    got = numbers(spark, "支护结构顶部水平位移控制值为28mm。监测频率为2次每日", "采用桩锚支护形式，安全等级为二级", "位移报警值取40毫米", "支护形式为放坡。")
    assert [(p, v) for p, v, *_ in got] == [("dp.retaining.displacement", 28.0), ("dp.monitoring.frequency", 2.0), ("dp.support_type", None), ("dp.safety_grade", None), ("dp.retaining.displacement", 40.0)]
    assert got[1][2] == "次/d" and got[4][2] == "mm"


def test_discarded(spark):
    r = extract.discarded(of_lines(spark, "基坑开挖深度为5400m。")).first()
    assert (r["param"], r["value"], r["reason"]) == ("dp.excavation_depth", 5400.0, "超出物理合理范围(0, 50]")


def cards(spark, *rows):
    """(param, value, text) cards of document 1."""
    data = [(1, i, p, v, "m" if v is not None else "", t, (f"line {i}",)) for i, (p, v, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, ord int, param_id string, value double, unit string, text_value string, evidence struct<line_text:string>")


def check(spark, rules, rows, lines=None, titles=None):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    ls = None if lines is None else spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] or [(2, 0, "")], "doc_id long, line_no int, text string")
    ts = spark.createDataFrame([(1, t) for t in titles or []], "doc_id long, title string") if lines is not None else None
    found = R.findings(cards(spark, *rows), tables.rules(spark, tuple(rules)), docs, ls, ts).where("doc_id = 1").orderBy("pos", "n").collect()
    return [(r["rule_id"], r["result"], r["detail"]) for r in found]


def test_range(spark):
    rule = Rule("r", "within_range", "p", min_value=10, max_value=30, unit="m")
    assert check(spark, [rule], [("p", 20.0, None)]) == [("r", "pass", "实测 20m，要求区间 [10, 30]m")]
    assert check(spark, [rule], [("p", 35.0, None)]) == [("r", "fail", "实测 35m，要求区间 [10, 30]m")]
    assert check(spark, [rule], [("p", 10.0, None)])[0][1] == "pass"
    assert check(spark, [rule], []) == []


def test_threshold_and_conflict(spark):
    rule = Rule("r", "threshold_max", "p", op="<=", value=30, unit="mm")
    assert check(spark, [rule], [("p", 35.0, None)]) == [("r", "fail", "实测 35mm，要求 <= 30mm")]
    assert check(spark, [rule], [("p", 28.0, None), ("p", 40.0, None)]) == [("r", "manual", "同一参数提取到 2 个取值: 28/40（疑似多出处冲突）")]
    assert check(spark, [rule], [("p", 28.0, None), ("p", 28.0, None)])[0][1] == "pass"
    strict = Rule("s", "threshold_min", "p", op="<", value=28)  # the sign decides, not the type's name
    assert check(spark, [strict], [("p", 28.0, None)])[0][1] == "fail"


def test_enum(spark):
    rule = Rule("r", "enum", "p", allowed=("桩锚支护", "放坡"))
    got = check(spark, [rule], [("p", None, "桩锚"), ("p", None, " magic "), ("p", None, "放坡+土钉"), ("p", None, "")])
    assert [x[1] for x in got] == ["pass", "fail", "pass", "fail"]
    assert check(spark, [rule], [("p", 3.0, None)])[0] == ("r", "fail", "取值「None」不在允许集合 桩锚支护/放坡 内")


def test_conditional(spark):
    rule = Rule("r", "conditional_program", "p", condition=(5, None), require_text="专家论证")
    assert check(spark, [rule], [("p", 5.4, None)], ["无"]) == [("r", "fail", "触发条件 ≥5，全文未检出「专家论证」")]
    assert check(spark, [rule], [("p", 5.4, None)], ["已组织专家论证"])[0][1] == "pass"
    assert check(spark, [rule], [("p", 4.6, None)], ["无"]) == []
    assert check(spark, [rule], [("p", 4.6, None), ("p", 6.0, None)], ["无"])[0][1] == "fail"
    assert check(spark, [rule], [("p", 5.4, None)]) == []


def test_checklist(spark):
    rule = Rule("r", "checklist_section", "doc.sections", sections=(("验收要求", ("验收",)), ("应急处置措施", ("应急处置", "应急预案")), ("工程概况", ())))
    assert check(spark, [rule], [], ["x"], ["一、工程概况", "七、验收要求"]) == [("r", "fail", "缺少章节/内容: 应急处置措施")]
    assert check(spark, [rule], [], ["x"], ["工程概况", "验收", "应急预案"]) == [("r", "pass", "必备章节齐套（3 项）")]


def test_gate_and_skips(spark):
    rule = Rule("r", "required", "p", only_if_text=("高支模",))
    assert check(spark, [rule], [], ["基坑"]) == []
    assert check(spark, [rule], [], ["高支模工程"]) == [("r", "fail", "")]
    assert check(spark, [rule], [])[0][1] == "fail"  # no document: no gate
    docs = spark.createDataFrame([(1,)], "doc_id long")
    rules = tables.rules(spark, (Rule("a", "mystery", "p"), Rule("b", "checklist_section", "p"), Rule("c", "required", "p", enabled=False)))
    assert [r["rule_id"] for r in R.skipped(cards(spark), rules, docs, True).collect()] == ["a"]
    assert sorted(r["rule_id"] for r in R.skipped(cards(spark), rules, docs, False).collect()) == ["a", "b"]


def test_rule_validation(spark):
    said = {"name": "n", "basis": "b"}
    rows = [Rule("a", "threshold_max", "p", **said), Rule("b", "enum", "p", **said), Rule("ok", "required", "p", **said), Rule("c", "required", "p", level="x", **said), Rule("d", "required", "p", name="n"), Rule("e", "required", "p", basis="b")]
    bad = tables.rules(spark, tuple(rows))
    assert {r["id"]: r["reason"] for r in R.violations(bad).collect()} == {"a": "threshold without op or value", "b": "enum without values", "c": "unknown level", "d": "missing field", "e": "missing field"}
    with pytest.raises(ValueError, match="rule a"):
        R.validated(bad)
    assert R.violations(tables.rules(spark)).count() == 0


def test_overdue(spark):
    bases = spark.createDataFrame([("a", "2026-01-01"), ("b", "2027-01-01"), ("c", None), ("d", "soon")], "id string, next_review string")
    assert [r["id"] for r in R.overdue(bases, "2026-06-01").collect()] == ["a"] and R.overdue(bases, "2026-01-01").count() == 0


def test_defaults(spark):
    """Every default rule has its texts; thresholds and passages answer without a folder."""
    r = tables.rules(spark)
    assert r.where("name = '' or basis = '' or category = ''").count() == 0 and r.count() == 29
    assert tables.thresholds(spark).count() == 41 and tables.blocks(spark).count() == 43
    q = spark.createDataFrame([(1, "基坑开挖深度超过多少需要专家论证"), (2, "剪刀撑的设置要求"), (3, "zzz")], "query_id int, question string")
    got = {r["query_id"]: r for r in K.ask(q, tables.thresholds(spark), tables.blocks(spark)).collect()}
    assert got[1]["route"] == "threshold" and "5m" in got[1]["answer"] and got[2]["answer"].endswith(K.CLOSING) and got[3]["route"] == "empty"


GEN_0001 = {
    "file": "gen_0001.docx", "category": "deep_pit", "seed": 2026, "title": "t",
    "expected_cards": {"dp.excavation_depth": [4.6], "dp.retaining.displacement": [35.0], "dp.monitoring.frequency": [0.5], "dp.support_type": ["放坡+土钉墙"], "dp.safety_grade": ["二级"]},
    "injected": [
        {"type": "over_disp", "detail": "d", "expect": {"rule_id": "R-DP-021", "result": "fail"}},
        {"type": "low_freq", "detail": "d", "expect": {"rule_id": "R-DP-031", "result": "fail"}, "also_expect": [{"rule_id": "R-DP-061", "result": "fail"}]},
    ],
}
FS_TRUTH = {
    "file": "fs_0002.docx", "category": "formwork_support", "seed": 1, "title": "t",
    "expected_cards": {"fs.support.height": [6.0, 7.0], "fs.formwork.type": ["盘扣式"]},
    "injected": [
        {"type": "multi_height", "detail": "d", "expect": {"rule_id": "R-FS-012", "result": "manual"}},
        {"type": "unit_error", "detail": "立杆间距误写为90m（超物理范围，提取器应丢弃）", "expect": {"rule_id": "R-FS-003", "result": "fail"}},
    ],
}


def test_labelled_plans(spark, tmp_path):
    """The published verdict counts of the first labelled plan: 15 pass, 3 fail, 0 manual; and a plan with a wrong unit."""
    for t in (GEN_0001, FS_TRUTH):
        (tmp_path / f"{t['file']}.truth.json").write_text(json.dumps(t, ensure_ascii=False))
    corpus = benchmark.labelled(spark, str(tmp_path))
    r = V.review(corpus.raw, tables.rules(spark), corpus.docs)
    counts = {x["name"]: (x["n_pass"], x["n_fail"], x["n_manual"]) for x in r.summary().join(corpus.docs, "doc_id").collect()}
    assert counts["gen_0001.docx"] == (15, 3, 0)
    result = benchmark.run(spark, corpus)
    assert result["values"]["tp"] == 8 and result["values"]["f1"] == 1.0 and (result["detection"]["hits"], result["forced"]) == (4, 0)
    assert benchmark.exit_code(result) == 0 and "4/4" in benchmark.table(result)
    benchmark.write(result, str(tmp_path / "results.json"))
    assert json.loads((tmp_path / "results.json").read_text())["gates"] == {"detection": True, "f1": True, "false_positives": True}


def test_truth_files_round_trip(spark, tmp_path):
    """Plans' truth written as JSON and read again gives plans with the same review."""
    for formwork, n in ((False, 10), (True, 5)):
        for r in synth.truth_files(synth.specs(spark, n, formwork), formwork).collect():
            (tmp_path / f"{r['file']}.truth.json").write_text(r["value"])
    result = benchmark.run(spark, benchmark.labelled(spark, str(tmp_path)))
    assert all(result["gates"].values()) and result["values"]["fn"] == 0 and result["detection"]["total"] > 20


def test_model_fills_gaps(spark):
    """A model's answers fill what is missing; its failures leave a document to the rules, with the reason."""
    docs = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "c.txt")], "doc_id long, name string")
    raw = spark.createDataFrame([(1, 0, "基坑最大深处约6.2米"), (2, 0, "基坑最大深处约7.2米"), (3, 0, "无关")], "doc_id long, pos int, text string")
    said = json.dumps({"items": [{"param": "dp.excavation_depth", "line_no": 0, "excerpt": "6.2米", "value": 6.2, "unit": "m"}]}, ensure_ascii=False)

    def complete(p):
        assert all("基坑开挖深度" in r["prompt"] and "(0, 50]" in r["prompt"] and gapfill.HEAD in r["prompt"] for r in p.collect())
        return p.select("doc_id", F.when(F.col("doc_id") == 1, said).alias("answer"), F.when(F.col("doc_id") == 2, "timed out").alias("error"))

    r, states = V.with_model(raw, tables.rules(spark), docs, complete)
    assert {s["doc_id"]: (s["state"], s["detail"]) for s in states.collect()} == {1: ("asked", ""), 2: ("degraded", "timed out"), 3: ("complete", "")}
    assert [(c["doc_id"], c["value"], c["source"]) for c in r.cards.collect()] == [(1, 6.2, "llm")]
    plain, states = V.with_model(raw, tables.rules(spark), docs, None)
    assert plain.cards.count() == 0 and states.where("state = 'off'").count() == 3


def test_environment_file(tmp_path, monkeypatch):
    for k in ("LLM_BASE_URL", "LLM_API_KEY", "LLM_MODEL", "LLM_TIMEOUT"):
        monkeypatch.delenv(k, raising=False)
    assert model.Model.from_env(tmp_path / "none") is None
    monkeypatch.setenv("LLM_MODEL", "set already")
    (tmp_path / ".env").write_text("# note\nLLM_BASE_URL = 'http://x'\nLLM_API_KEY=k=1\nLLM_MODEL=other\nLLM_TIMEOUT=5\nbroken\n")
    m = model.Model.from_env(tmp_path / ".env")
    assert (m.base_url, m.api_key, m.model, m.timeout) == ("http://x", "k=1", "set already", 5.0)
    for k in ("LLM_BASE_URL", "LLM_API_KEY", "LLM_TIMEOUT"):
        monkeypatch.delenv(k, raising=False)


def test_deep_headings(spark):
    """Levels without a bound."""
    rows = [("A", 1), ("B", 9), ("C", 12), ("D", 15), ("x", None), ("E", 13), ("F", 10), ("G", 9), ("H", 11)]
    got = segment.parse(spark.createDataFrame([(1, k, t, lv) for k, (t, lv) in enumerate(rows)], "doc_id long, pos int, text string, level int")).orderBy("line_no").collect()
    assert [r["section_path"] for r in got] == ["A", "A/B", "A/B/C", "A/B/C/D", "A/B/C/D", "A/B/C/E", "A/B/F", "A/G", "A/G/H"]


def test_advice_template(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    rules = tables.rules(spark, (Rule("r", "threshold_max", "p", op="<=", value=3, unit="m", advice="{value} over {limit}{unit} {other}"), Rule("e", "enum", "q", allowed=("z",), advice="keep {value}")))
    got = {r["rule_id"]: r["advice"] for r in R.findings(cards(spark, ("p", 4.5, None), ("q", None, "a")), rules, docs).collect()}
    assert got == {"r": "4.5 over 3m {other}", "e": "keep {value}"}


def test_summary_and_missing(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rules = tables.rules(spark, (Rule("r", "required", "p"),))
    c = cards(spark, ("p", 1.0, None))
    assert sorted(tuple(r) for r in R.summary(R.findings(c, rules, docs), docs).collect()) == [(1, 1, 0, 0, "通过"), (2, 0, 1, 0, "不合规")]
    assert [tuple(r) for r in R.missing_params(c, rules, docs).collect()] == [(2, "p")]


THRESHOLDS = [
    {"id": "A", "name": "一", "op": ">=", "value": 5, "unit": "m", "condition": "时", "keywords": ["专家论证", "论证"], "doc": "文", "article_no": "附件2", "basis": "据", "status": "待核对"},
    {"id": "B", "name": "二", "op": "range", "value": [2, 50], "unit": "m", "keywords": ["专家论证", "论证"], "status": "待核对"},
    {"id": "C", "name": "三", "op": "info", "value": "见规范", "keywords": ["剪刀撑"], "status": "待核对"},
]


def test_ask(spark):
    q = spark.createDataFrame([(1, "多深需要专家论证"), (2, "剪刀撑怎么设置"), (3, "量子力学"), (4, "")], "query_id int, question string")
    b = spark.createDataFrame([("b1", "GB 1", "构造", "3.1", "剪刀撑应连续设置", ["剪刀撑"], "待核对"), ("b2", "GB 2", "其他", "（待核对）", "无关条文", [], "待核对")], "block_id string, doc string, chapter string, article_no string, text string, tags array<string>, status string")
    got = {r["query_id"]: r for r in K.ask(q, tables.thresholds(spark, THRESHOLDS), b).collect()}
    assert [got[i]["route"] for i in (1, 2, 3, 4)] == ["threshold", "blocks", "empty", "empty"]
    assert got[1]["answer"].startswith("【阈值表命中·待核对】一：要求 5m时。\n依据：文 附件2")  # the first of equal scores
    assert "《GB 1》构造 第3.1条（待核对）：剪刀撑应连续设置" in got[2]["answer"] and got[2]["sources"][0]["doc"] == "GB 1"


def test_search_scores(spark):
    q = spark.createDataFrame([(1, "aa bb bb")], "query_id int, question string")
    b = spark.createDataFrame([("x", "d", "1", "aa bb", []), ("y", "d", "2", "cc", ["dd"]), ("z", "c", "9", "aa bb", [])], "block_id string, doc string, article_no string, text string, tags array<string>")
    rows = K.search(q, b, 5).orderBy("rank").collect()
    assert [r["block_id"] for r in rows] == ["z", "x"] and rows[0]["score"] == pytest.approx(3 / (5**0.5 * 2**0.5))


def test_scanner(spark):
    assert scan.self_test(spark).count() == 0
    assert {k for k, yes, _ in scan.SAMPLES if yes} == set(scan.KINDS)
    texts = spark.createDataFrame([("f", "ok\r\na@b.cc 10.0.0.1"), ("g", "x = sk-" + "12345678" + " token: " + "abcdefgh1")], "label string, text string")
    two = scan.hits(texts, "label").orderBy("label", "n").collect()
    assert [(r["label"], r["lineno"], r["kind"], r["excerpt"]) for r in two] == [("f", 2, "email", "a@b.cc"), ("f", 2, "private_ip", "10.0.0.1"), ("g", 1, "secret_sk", "sk-" + "12345678"), ("g", 1, "secret_assign", "token")]
    assert scan.gate(scan.hits(spark.createDataFrame([("f", "clean"), ("g", None)], "label string, text string"), "label")) == 0


def test_commit_addresses(spark):
    commits = spark.createDataFrame([("1+a@users.noreply.github.com", "b@c.net"), ("1+a@users.noreply.github.com", "b@c.net"), ("d@e.org", "1+a@users.noreply.github.com")], "author string, committer string")
    assert scan.commit_pairs(commits).count() == 2
    assert sorted(map(tuple, scan.commit_hits(commits).collect())) == [("author", "d@e.org"), ("committer", "b@c.net")]


def test_crlf_and_binary(spark):
    assert [r[0] for r in scan.crlf(spark.createDataFrame([(1, "a\r\nb"), (2, "a\nb")], "i int, text string"), "i").collect()] == [1]
    df = spark.createDataFrame([(bytearray(b"ab\0c"),), (bytearray(b"abc"),), (bytearray(b"a" * 9000 + b"\0"),)], "content binary")
    assert [r[0] for r in df.select(scan.is_binary(F.col("content"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "text, want",
    [('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": [1, 2,]}', {"a": [1, 2]}), ('so: {"a": 1} done', {"a": 1}), ('```json\n{"items": []}\n```', {"items": []}), ("garbage", None), ('{"a": "b', {"a": "b"}), ('[{"x": 1}, {"y"', None), (None, None)],
)
def test_json_repair(text, want):
    got = gapfill.repaired(text)
    assert (None if got is None else json.loads(got)) == want


def test_gap_filling(spark):
    lines = of_lines(spark, "基坑最大深度约为6.2米左右", "侧壁等级二级", "无数字")
    missing = spark.createDataFrame([(1, "dp.excavation_depth"), (1, "dp.safety_grade"), (1, "dp.monitoring.frequency")], "doc_id long, param string")
    offered = gapfill.candidates(lines, missing)
    assert [r["line_no"] for r in offered.collect()] == [0]
    offered = offered.union(lines.where("line_no = 1").select("doc_id", "line_no", "text"))
    answer = [
        {"param": "dp.excavation_depth", "line_no": 0, "excerpt": "6.2米", "value": 6.2, "unit": "m"}, {"param": "dp.safety_grade", "line_no": 1, "excerpt": "二级", "text_value": "二级"},
        {"param": "dp.excavation_depth", "line_no": 0, "excerpt": "7米", "value": 7.0}, {"param": "dp.monitoring.frequency", "line_no": 0, "excerpt": "6.2", "value": 99.0},
        {"param": "fs.pole.spacing", "line_no": 0, "excerpt": "6.2", "value": 1.0}, {"param": "dp.excavation_depth", "line_no": 0, "excerpt": "6.2米", "value": 6.3},
    ]
    items = gapfill.parse_answers(spark.createDataFrame([(1, "answer: " + json.dumps({"items": answer}, ensure_ascii=False))], "doc_id long, answer string"))
    checked = gapfill.validate(items, missing, offered)
    reasons = [r["reason"] for r in checked.orderBy("n").collect()]
    assert reasons[:2] == [None, None] and "子串" in reasons[2] and "范围" in reasons[3] and "缺失清单" in reasons[4]
    got = gapfill.cards(gapfill.accept(checked), lines).orderBy("ord").collect()
    assert [(r["param_id"], r["value"], r["text_value"], r["source"], r["confidence"]) for r in got] == [("dp.excavation_depth", 6.2, None, "llm", 0.6), ("dp.safety_grade", None, "二级", "llm", 0.6)]
    assert "6.2" in gapfill.prompts(offered, missing, "head", "foot").first()["prompt"]


def test_matching(spark):
    truth = spark.createDataFrame([(1, "p", 1.0, None), (1, "p", 1.0, None), (1, "q", None, "a"), (2, "p", 3.0, None)], "doc_id long, param string, num double, txt string")
    got = spark.createDataFrame([(1, "p", 1.0 + 1e-12, None), (1, "q", None, "b"), (2, "p", 3.0, None), (2, "r", 9.0, None)], "doc_id long, param string, num double, txt string")
    rows = {r["param"]: (r["tp"], r["fp"], r["fn"]) for r in E.prf(E.matched(truth, got)).collect()}
    assert rows == {"p": (2, 0, 1), "q": (0, 1, 1), "r": (0, 1, 0), None: (2, 2, 2)}
    large = lambda *v: spark.createDataFrame([(1, "p", float(x), None) for x in v], "doc_id long, param string, num double, txt string")
    sums = E.matched(large(1e12, 2e12, 0), large(1e12 + 1, 2e12 + 1e4, 0)).agg(*[F.sum(c) for c in ("tp", "fp", "fn")]).first()
    assert tuple(sums) == (2, 1, 1)  # close by a share of the value, not by digits
    none = E.scored(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 1.0, 1.0)


def test_reports(spark):
    docs = spark.createDataFrame([(1, "一、概况\n基坑开挖深度为5.4m|。\n位移控制值35mm\n开挖深度900m")], "doc_id long, text string")
    r = V.of_texts(docs, tables.rules(spark))
    md = r.markdown("2026-01-01").first()["report"]
    assert "| 不合规 |" in md and "5.4m\\|" in md and "R-DP-021" in md and "已丢弃" in md and "签署栏" in md
    j = json.loads(r.json().first()["review"])
    assert j["summary"]["fail"] == r.findings.where("result = 'fail'").count() and j["findings"][0]["result"] == "fail"
    assert V.exit_code(r) == 1
    empty = V.of_texts(spark.createDataFrame([(1, None)], "doc_id long, text string"), tables.rules(spark))
    assert empty.summary().first()["overall"] == "通过" and V.exit_code(empty) == 0
    assert report.label(F.lit("x")) is not None


def test_rules_over_items_with_large_keys(spark, tmp_path):
    """Part keys of a million and more put an item's place before that of an item with a smaller number; evidence goes by the number."""
    import duckdb

    from clausemill.plans import catalog

    d, con = str(tmp_path), duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT k AS o_orderkey, '1-URGENT' AS o_orderpriority, 'F' AS o_orderstatus FROM (VALUES (1::BIGINT), (2), (3)) AS t(k)")
    con.sql(
        "CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 7::BIGINT AS l_suppkey, n AS l_linenumber, v::DOUBLE AS l_quantity, v / 100.0::DOUBLE AS l_discount, v / 100.0::DOUBLE AS l_tax, 'A' AS l_returnflag "
        "FROM (VALUES (1, 1190000, 1, 3), (1, 5, 2, 4), (2, 1190000, 1, 6), (2, 5, 2, 6), (3, 5, 1, 2), (3, 6, 2, 3)) AS t(k, p, n, v)"
    )
    for name in ("orders", "lineitem"):
        con.sql(f"COPY {name} TO '{d}/{name}.parquet'")
    for name in catalog.CHECKS:
        got = catalog.QUERIES[name](spark, d)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
