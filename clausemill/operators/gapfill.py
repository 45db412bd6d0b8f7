"""Gap filling by a language model: candidate lines, prompt, and checks against invention.

The model itself is outside: proposals come in as a relation (or from :func:`clausemill.sources.model.complete`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill import schemas
from clausemill.functions import text as T
from clausemill.sources.tables import NUMERIC, TEXTUAL, Numeric, Textual
from clausemill.workers import ship

#: Lines offered to the model for a document: the feature's own limit.
MOST_LINES = 120
CONFIDENCE = 0.6


def candidates(lines: DataFrame, missing: DataFrame, params: Sequence[Numeric] = NUMERIC, most: int = MOST_LINES) -> DataFrame:
    """doc_id, line_no, text: the first lines that have a digit or an alias of a missing parameter.

    ``missing`` has doc_id, param; documents without a missing parameter aren't offered.
    """
    asked = missing.groupBy("doc_id").agg(F.collect_set("param").alias("params"))
    named = F.lit(False)
    for p in params:
        named = named | (F.array_contains("params", F.lit(p.id)) & T.contains_any(F.col("text"), p.aliases))
    text = T.strip(F.col("text"))
    picked = lines.join(asked, "doc_id").where((text != "") & (F.col("text").rlike("[0-9]") | named))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return picked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("doc_id", "line_no", text.alias("text"))


# The parts of a prompt.
HEAD = "你是施工方案参数抽取助手。只从给定的原文行中抽取目标参数，禁止编造、禁止使用原文以外的知识。"
FOOT = (
    "输出要求：只输出一个 JSON 对象，不要任何解释文字：\n"
    '{"items": [{"param": "参数id", "line_no": 原文行号, "excerpt": "从该行逐字连续摘录的原文片段（必须包含所依据的数值/取值）", "value": 数值或null, "text_value": 字符串或null, "unit": "单位或空"}]}\n'
    '某参数在原文行中没有依据时，不要输出该参数。全部没有则输出 {"items": []}。'
)


def described(params: Sequence[Numeric] = NUMERIC, texts: Sequence[Textual] = TEXTUAL) -> dict[str, str]:
    """What a prompt says of each parameter: name, unit and range, or that it is a text."""
    numbers = {p.id: f"  {p.id}: {p.name}（单位 m 或 mm，合理范围 ({p.low:g}, {p.high:g}]，单位 mm 时按毫米填写）" for p in params}
    return numbers | {t.id: f"  {t.id}: {t.name}（文本型，text_value 填原文取值）" for t in texts}


def prompts(offered: DataFrame, missing: DataFrame, head: str = HEAD, foot: str = FOOT, names: DataFrame | None = None, about: dict[str, str] | None = None) -> DataFrame:
    """doc_id, prompt: head, document, one line per missing parameter, one per candidate line, foot. ``names`` has doc_id and name."""
    about = described() if about is None else about
    shown = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in about.items() for x in kv]), F.col("param")), F.concat(F.lit("  "), "param")) if about else F.col("param")
    asked = missing.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("param", shown.alias("s")))).alias("_p"))
    of = offered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
    x = of.join(asked, "doc_id")
    x = x.join(names.select("doc_id", "name"), "doc_id", "left") if names is not None else x.withColumn("name", F.lit(None).cast("string"))
    block = F.array_join(F.transform("_l", lambda r: F.concat(F.lit("  "), r["line_no"].cast("string"), F.lit(": "), r["text"])), "\n")
    parts = [F.lit(head), F.concat(F.lit("文档："), F.coalesce("name", F.col("doc_id").cast("string")), F.lit("\n\n目标参数（可能一个也抽不到）：")), F.array_join(F.transform("_p", lambda r: r["s"]), "\n")]
    return x.select("doc_id", F.concat_ws("\n", *parts, F.lit("\n原文行（行号: 内容）："), block, F.lit("\n" + foot)).alias("prompt"))


def validate(items: DataFrame, missing: DataFrame, offered: DataFrame, params: Sequence[Numeric] = NUMERIC, texts: Sequence[Textual] = TEXTUAL) -> DataFrame:
    """``items`` (doc_id, n, param, line_no, excerpt, value, text_value) with ``reason``: why an item is dropped, else null."""
    numeric = {p.id: (p.low, p.high) for p in params}
    want = missing.select("doc_id", "param").distinct().withColumn("_missing", F.lit(True))
    lines = offered.select("doc_id", "line_no", F.col("text").alias("_line"))
    x = items.join(want, ["doc_id", "param"], "left").join(lines, ["doc_id", "line_no"], "left")
    excerpt = T.strip(F.coalesce("excerpt", F.lit("")))
    textual = F.col("param").isin(*[t.id for t in texts]) if texts else F.lit(False)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (a, b) in numeric.items():
        low, high = F.when(F.col("param") == k, a).otherwise(low), F.when(F.col("param") == k, b).otherwise(high)
    reason = (
        F.when(F.col("_missing").isNull(), "param 不在缺失清单")
        .when(F.col("_line").isNull(), "line_no 无效")
        .when((excerpt == "") | ~F.contains("_line", excerpt), "摘录不是原文子串（防幻觉拦截）")
        .when(textual & (F.coalesce("text_value", F.lit("")) == ""), "文本型参数缺少 text_value")
        .when(~textual & F.col("value").isNull(), "数值型参数缺少有效 value")
        .when(~textual & ~((F.col("value") > low) & (F.col("value") <= high)), "数值超出物理合理范围")
    )
    return x.withColumns({"reason": reason, "value": F.when(textual, F.lit(None)).otherwise(F.col("value")), "text_value": F.when(textual, F.col("text_value"))}).drop("_missing", "_line")


def accept(validated: DataFrame) -> DataFrame:
    """The first valid item of each (document, parameter)."""
    w = Window.partitionBy("doc_id", "param").orderBy("n")
    return validated.where("reason is null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "reason")


def cards(accepted: DataFrame, lines: DataFrame, params: Sequence[Numeric] = NUMERIC, texts: Sequence[Textual] = TEXTUAL, after: Column | int = 1_000_000) -> DataFrame:
    """Accepted items as cards, placed after the document's own."""
    every = [*params, *texts]
    of = lambda f: F.coalesce(*[F.when(F.col("param") == p.id, f(p)) for p in every], F.lit(""))
    line = F.struct(F.col("doc_id").cast("string").alias("doc"), F.col("section_path").alias("section"), F.col("page"), F.col("text").alias("line_text"), "char_start", "char_end")
    x = accepted.join(lines.select("doc_id", "line_no", line.alias("evidence")), ["doc_id", "line_no"])
    w = Window.partitionBy("doc_id").orderBy("n")
    first = F.lit(after) if isinstance(after, int) else after
    return x.select(
        "doc_id", (first + F.row_number().over(w)).cast("int").alias("ord"), F.col("param").alias("param_id"), of(lambda p: p.name).alias("name"), "value",
        F.when(F.col("value").isNotNull(), F.coalesce("unit", F.lit(""))).otherwise("").alias("unit"), "text_value", F.substring("excerpt", 1, 60).alias("raw_text"),
        of(lambda p: p.category).alias("category"), F.lit(CONFIDENCE).alias("confidence"), F.lit("llm").alias("source"), "evidence",
    )


def repaired(text: str | None) -> str | None:
    """JSON out of a model's answer: fences and prose off, trailing commas off, open ends closed; null if that fails.

    The scan keeps a stack of open brackets and remembers where the outermost value ended.
    """
    if text is None:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = (fence[1] if fence else text).strip()
    start = re.search(r"[{\[]", body)
    body = body[start.start() :] if start else body
    for attempt in (body, plain := re.sub(r",\s*([}\]])", r"\1", body), _closed(plain)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _closed(t: str) -> str:
    closers, quoted, end = [], False, len(t)
    for m in re.finditer(r'\\.|["{}\[\]]', t, re.S):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted or len(c) > 1:
            continue
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif closers and closers[-1] == c:
            closers.pop()
            if not closers:
                return t[: m.end()]
        else:
            end = m.start()
            break
    return re.sub(r",\s*$", "", t[:end] + ('"' if quoted else "")) + "".join(reversed(closers))


def parse_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """doc_id and the proposed items of model answers: well-formed ones are parsed by Spark, the others repaired first."""

    ship(answers.sparkSession)

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    good = F.when(F.try_parse_json(text).isNotNull(), F.col(text)).otherwise(repair(text))
    items = F.from_json(F.coalesce(F.get_json_object(good, "$.items"), good), schemas.PROPOSAL)
    return answers.select("doc_id", F.posexplode(items).alias("n", "_i")).select("doc_id", "n", "_i.*")
