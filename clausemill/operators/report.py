"""Reports: a Markdown text and a JSON value per document, both made as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.operators import rules as R

# Labels of results and the overall verdict.
LABEL = {"fail": "不合规", "manual": "待人工确认", "pass": "通过"}
HEAD = "| 规则 | 级别 | 结论 | 说明 | 依据条款 | 整改建议 | 原文证据 |\n| --- | --- | --- | --- | --- | --- | --- |"
CARD_HEAD = "| 参数 | 取值 | 单位/类型 | 出处章节 | 原文 |\n| --- | --- | --- | --- | --- |"
SIGN = "| 审查人 | 日期 | 备注 |\n| --- | --- | --- |\n|  |  | 本报告为辅助预审，不替代专家论证 |"
NONE = "（无）"


def label(result: Column) -> Column:
    out = result
    for k, v in LABEL.items():
        out = F.when(result == k, v).otherwise(out)
    return out


def _dash(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)


def _bars(c: Column) -> Column:
    """Bars would end a table cell."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def overall(n_fail: Column, n_manual: Column) -> Column:
    return (
        F.when(n_fail > 0, "**总体结论: 不合规** —— 存在强制条款不满足，须整改后复审。")
        .when(n_manual > 0, F.concat(F.lit("**总体结论: 待人工确认** —— 自动核查未发现违规，但有 "), n_manual.cast("string"), F.lit(" 项需人工复核。")))
        .otherwise("**总体结论: 通过**（基于当前规则库）。")
    )


def finding_row() -> Column:
    cells = [F.concat("rule_id", F.lit(" "), F.coalesce("rule_name", F.lit(""))), F.col("level"), label(F.col("result")), _dash(F.col("detail")), _dash(F.col("basis")), _dash(F.col("advice")), _bars(_dash(F.col("evidence_line")))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def card_row() -> Column:
    value = F.coalesce("text_value", F.col("value").cast("string"))
    unit = F.when(F.col("unit") != "", F.col("unit")).when(F.col("text_value").isNotNull(), "文本").otherwise("")
    cells = [F.concat("param_id", F.lit(" "), F.col("name")), value, unit, F.coalesce("evidence.section", F.lit("-")), _bars(F.coalesce("evidence.line_text", F.lit("-")))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(docs: DataFrame, found: DataFrame, cards: DataFrame, discarded: DataFrame, rules_total: int, when: str = "", tool: str = "clausemill") -> DataFrame:
    """doc_id and report. ``docs`` has doc_id and may have name; ``when`` is stated so that reports can be reproduced."""
    of = R.ranked(found).select("doc_id", "result", F.struct("rank", "rule_id", "n", finding_row().alias("row")).alias("r"))
    tables = of.groupBy("doc_id").agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("result") == k, F.col("r")))), lambda x: x["row"]), "\n").alias(k) for k in LABEL
    ])
    card = cards.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", card_row().alias("row")))).alias("c"))
    bad = F.concat(F.lit("- "), "param", F.lit(" = "), F.col("value").cast("string"), "unit", F.lit("（"), "reason", F.lit("）原文："), "line")
    gone = discarded.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(bad)), "\n").alias("d"))
    x = R.summary(found, docs).join(docs, "doc_id").join(tables, "doc_id", "left").join(card, "doc_id", "left").join(gone, "doc_id", "left")
    name = F.col("name") if "name" in docs.columns else F.col("doc_id").cast("string")
    table = lambda k: F.when(F.coalesce(F.col(k), F.lit("")) == "", NONE).otherwise(F.concat(F.lit(HEAD + "\n"), F.col(k)))
    report = F.concat_ws(
        "\n",
        F.lit("# 专项施工方案审查报告\n"), F.concat(F.lit("- 审查对象: "), name), F.lit(f"- 审查时间: {when}\n- 工具版本: {tool}\n- 规则库规模: {rules_total} 条\n\n## 一、总体结论\n\n| 结论 | 数量 |\n| --- | --- |"),
        F.concat(F.lit("| 不合规 | "), F.col("n_fail").cast("string"), F.lit(" |")), F.concat(F.lit("| 待人工确认 | "), F.col("n_manual").cast("string"), F.lit(" |")),
        F.concat(F.lit("| 通过 | "), F.col("n_pass").cast("string"), F.lit(" |\n")), overall(F.col("n_fail"), F.col("n_manual")),
        F.lit("\n## 二、不合规清单\n"), table("fail"), F.lit("\n## 三、待人工确认清单\n"), table("manual"), F.lit("\n## 四、通过项\n"), table("pass"),
        F.lit(f"\n## 五、附录：参数卡全表\n\n{CARD_HEAD}"), F.when(F.size("c") > 0, F.array_join(F.transform("c", lambda r: r["row"]), "\n")),
        F.lit(f"\n## 六、签署栏\n\n{SIGN}\n"), F.when(F.coalesce(F.col("d"), F.lit("")) != "", F.concat(F.lit("## 附：已丢弃的可疑取值（超出物理合理范围）\n\n"), "d", F.lit("\n"))),
    )
    return x.select("doc_id", report.alias("report"))


def said(n_fail: Column, n_manual: Column) -> Column:
    """The overall verdict as a sentence."""
    return F.regexp_replace(F.regexp_replace(overall(n_fail, n_manual), r"\*\*", ""), "^总体结论: ", "")


def _sorted_findings(found: DataFrame) -> DataFrame:
    """doc_id and _f: the findings in report order."""
    of = R.ranked(found)
    row = F.struct("rank", "rule_id", "n", "rule_name", "level", "result", label(F.col("result")).alias("result_label"), "detail", "basis", "advice", F.col("evidence_line").alias("evidence"))
    return of.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_f"))


def _sorted_cards(cards: DataFrame) -> DataFrame:
    value = F.coalesce("text_value", F.col("value").cast("string"))
    unit = F.when(F.col("unit") != "", F.col("unit")).when(F.col("text_value").isNotNull(), "文本").otherwise("")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c.split(".")[0] in cards.columns else F.lit("")
    section = has("evidence.section") if "section" in cards.schema["evidence"].dataType.names else F.lit("")
    row = F.struct("ord", "param_id", has("name").alias("name"), value.alias("value"), unit.alias("unit"), section.alias("section"), F.coalesce("evidence.line_text", F.lit("")).alias("line"), (F.col("source") if "source" in cards.columns else F.lit("rule")).alias("source"))
    return cards.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_c"))


def review_json(docs: DataFrame, found: DataFrame, cards: DataFrame) -> DataFrame:
    """doc_id and review: a JSON value with summary, verdict, ordered findings and cards."""
    x = R.summary(found, docs).join(_sorted_findings(found), "doc_id", "left").join(_sorted_cards(cards), "doc_id", "left")
    counts = F.struct(F.col("n_pass").alias("pass"), F.col("n_fail").alias("fail"), F.col("n_manual").alias("manual"))
    findings, of_cards = F.transform("_f", lambda r: r.dropFields("rank", "n")), F.transform("_c", lambda r: r.dropFields("ord"))
    none = lambda c, like: F.coalesce(c, F.slice(like, 1, 0))
    return x.select("doc_id", F.to_json(F.struct(counts.alias("summary"), said(F.col("n_fail"), F.col("n_manual")).alias("overall"), none(findings, findings).alias("findings"), none(of_cards, of_cards).alias("cards"))).alias("review"))


def console(docs: DataFrame, found: DataFrame, cards: DataFrame) -> DataFrame:
    """doc_id, n_fail and text: a review as it is printed, with cards, counts, findings with evidence, basis and advice, and the verdict."""
    x = R.summary(found, docs).join(_sorted_findings(found), "doc_id", "left").join(_sorted_cards(cards), "doc_id", "left")
    more = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n           {head}"), c)).otherwise("")
    card = F.transform("_c", lambda c: F.concat(F.lit("  "), c["param_id"], F.lit(" "), c["value"], F.lit(" "), c["unit"], F.lit(" ← "), c["section"]))
    finding = F.transform("_f", lambda f: F.concat(F.lit("  ["), f["result_label"], F.lit("] "), f["rule_id"], F.lit(" "), F.coalesce(f["rule_name"], F.lit("")), more("", f["detail"]), more("原文: ", f["evidence"]), F.lit("\n           依据: "), F.coalesce(f["basis"], F.lit("")), more("建议: ", f["advice"])))
    n = lambda c: F.col(c).cast("string")
    text = F.concat_ws(
        "\n", F.concat(F.lit("提取参数卡 "), F.coalesce(F.nullif(F.size("_c"), F.lit(-1)), F.lit(0)).cast("string"), F.lit(" 张:")), F.array_join(card, "\n"), F.lit(""),
        F.concat(F.lit("核查结论（不合规 "), n("n_fail"), F.lit(" / 待确认 "), n("n_manual"), F.lit(" / 通过 "), n("n_pass"), F.lit("）:")), F.array_join(finding, "\n"), F.lit(""),
        F.concat(F.lit("总体结论: "), said(F.col("n_fail"), F.col("n_manual"))),
    )
    return x.select("doc_id", "n_fail", text.alias("text"))


def parsed_json(docs: DataFrame, lines: DataFrame, sections: DataFrame, cards: DataFrame, discarded: DataFrame) -> DataFrame:
    """doc_id and parsed: a JSON value with the numbers of sections and lines, the cards and what was discarded."""
    from clausemill.operators import extract

    of_sections = sections.groupBy("doc_id").agg(F.count("*").alias("_s"))
    of_cards = cards.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in cards.columns if c not in ("doc_id", "ord")]))).alias("cards"))
    gone = discarded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in discarded.columns if c != "doc_id"]))).alias("discarded"))
    x = docs
    for part in (of_sections, extract.scanned(lines), of_cards, gone):
        x = x.join(part, "doc_id", "left")
    name = F.col("name") if "name" in docs.columns else F.col("doc_id").cast("string")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    listed = F.coalesce(F.transform("cards", lambda c: c.dropFields("ord")), F.slice(F.transform("cards", lambda c: c.dropFields("ord")), 1, 0))
    value = F.struct(name.alias("doc"), n("_s").alias("sections"), n("lines_scanned").alias("lines"), listed.alias("cards"), F.struct(n("lines_scanned").alias("lines_scanned"), "discarded").alias("meta"))
    return x.select("doc_id", F.to_json(value).alias("parsed"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines, e.g. the log that a run resumes from."""
    rows.write.mode("append").json(path)
