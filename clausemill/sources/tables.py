"""Configuration relations: parameters, aliases, rules and thresholds.

These are defaults. Every operator takes its own; :mod:`clausemill.sources.files` reads them from JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill import schemas
from clausemill.sources.defaults import BLOCKS, RULE_TEXTS, THRESHOLDS


@dataclass(frozen=True)
class Numeric:
    """A numeric parameter: its aliases, unit pattern, physical range (low, high] and words that may not stand before it."""

    id: str
    name: str
    category: str
    unit: str
    low: float
    high: float
    aliases: tuple[str, ...]
    not_after: tuple[str, ...] = ()
    metres: bool = False

    def ranked(self) -> list[str]:
        """Longer aliases first, equal lengths in the given order."""
        return sorted(self.aliases, key=len, reverse=True)


@dataclass(frozen=True)
class Textual:
    """A parameter whose value is the first group of the first pattern that matches."""

    id: str
    name: str
    category: str
    patterns: tuple[str, ...]


# Parameters, aliases and unit names.
NUMERIC = (
    Numeric("dp.excavation_depth", "基坑开挖深度", "deep_pit", "(?:mm|m|米)", 0.0, 50.0, ("开挖深度", "基坑深度", "挖深"), ("每层", "分层", "层间", "分段"), True),
    Numeric("dp.retaining.displacement", "支护结构顶部水平位移控制值", "deep_pit", "(?:mm|毫米)", 0.0, 500.0, ("水平位移控制值", "位移控制值", "水平位移报警值", "位移报警值")),
    Numeric("dp.monitoring.frequency", "基坑监测频率（开挖至底板期间）", "deep_pit", "(?:次/d|次/天|次/日|次每日|次每天)", 0.0, 24.0, ("监测频率", "监测频次")),
    Numeric("fs.support.height", "高支模支撑体系搭设高度", "formwork_support", "(?:mm|m|米)", 0.0, 100.0, ("支撑体系搭设高度", "搭设高度", "支撑高度", "支模高度"), (), True),
    Numeric("fs.pole.spacing", "高支模立杆间距", "formwork_support", "(?:mm|m|米)", 0.0, 3.0, ("立杆间距", "立杆纵距", "立杆横距"), (), True),
)
TEXTUAL = (
    Textual("dp.support_type", "支护形式", "deep_pit", (r"支护形式为(.{2,12}?)[，。；\s]", "采用(.{2,12}?)支护[形工体]")),
    Textual("dp.safety_grade", "基坑侧壁安全等级", "deep_pit", ("安全等级为([一二三]级)",)),
    Textual("fs.formwork.type", "模板支撑体系类型", "formwork_support", ("支撑体系采用(.{2,8}?)钢管",)),
)
UNITS = {"米": "m", "毫米": "mm", "次/天": "次/d", "次/日": "次/d", "次每日": "次/d", "次每天": "次/d"}

# The sections that a plan must have, each with the words that show it.
PLAN_SECTIONS = (
    ("工程概况", ("工程概况",)),
    ("编制依据", ("编制依据",)),
    ("施工计划", ("施工计划", "进度计划")),
    ("施工工艺技术", ("施工工艺", "施工方案")),
    ("施工安全保证措施", ("安全保证措施", "安全措施")),
    ("施工管理及作业人员配备和分工", ("施工管理", "人员配备")),
    ("验收要求", ("验收",)),
    ("应急处置措施", ("应急处置", "应急预案")),
    ("计算书及相关图纸", ("计算书", "相关图纸")),
)
PIT, FORMWORK = ("基坑",), ("高支模", "模板支撑", "模板工程")


@dataclass(frozen=True)
class Rule:
    """A declarative rule; what its check type doesn't use stays empty."""

    id: str
    check_type: str
    param: str
    only_if_text: tuple[str, ...] = ()
    op: str | None = None
    value: float | None = None
    unit: str = ""
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple[str, ...] = ()
    condition: tuple[float | None, float | None] | None = None
    require_text: str | None = None
    sections: tuple[tuple[str, tuple[str, ...]], ...] = ()
    level: str = "强制"
    severity: str = "error"
    name: str = ""
    basis: str = ""
    advice: str = ""
    category: str = ""
    enabled: bool = True
    stage: str = ""
    note: str = ""


_ADVISED = {"level": "建议", "severity": "warning"}
# The predicates of the rules, in load order.
_PREDICATES = (
    Rule("R-DP-002", "required", "dp.support_type", PIT),
    Rule("R-DP-003", "required", "dp.safety_grade", PIT),
    Rule("R-DP-004", "required", "dp.retaining.displacement", PIT),
    Rule("R-DP-032", "required", "dp.monitoring.frequency", PIT),
    Rule("R-DP-022", "within_range", "dp.retaining.displacement", min_value=5, max_value=100, unit="mm"),
    Rule("R-DP-041", "enum", "dp.safety_grade", allowed=("一级", "二级", "三级")),
    Rule("R-DP-042", "enum", "dp.support_type", allowed=("放坡", "土钉墙", "桩锚", "排桩", "地下连续墙", "地连墙", "钢板桩", "SMW", "内支撑", "锚杆", "重力式挡墙"), **_ADVISED),
    Rule("R-DP-051", "checklist_section", "doc.sections", PIT, sections=PLAN_SECTIONS),
    Rule("R-DP-052", "checklist_section", "doc.sections", PIT, sections=(("监测方案", ("监测方案", "监测")),)),
    Rule("R-DP-061", "threshold_min", "dp.monitoring.frequency", op=">=", value=2, unit="次/d", **_ADVISED),
    Rule("R-DP-062", "threshold_min", "dp.retaining.displacement", op=">=", value=5, unit="mm", **_ADVISED),
    Rule("R-DP-063", "within_range", "dp.excavation_depth", min_value=2, max_value=50, unit="m", **_ADVISED),
    Rule("R-DP-072", "threshold_max", "dp.monitoring.frequency", op="<=", value=24, unit="次/d", **_ADVISED),
    Rule("R-DP-073", "threshold_max", "dp.retaining.displacement", op="<=", value=500, unit="mm", **_ADVISED),
    Rule("R-DP-103", "conditional_program", "dp.excavation_depth", condition=(3, None), require_text="监测"),
    Rule("R-DP-001", "required", "dp.excavation_depth", PIT),
    Rule("R-DP-021", "threshold_max", "dp.retaining.displacement", op="<=", value=30, unit="mm"),
    Rule("R-DP-031", "threshold_min", "dp.monitoring.frequency", op=">=", value=1, unit="次/d"),
    Rule("R-FS-001", "required", "fs.support.height", FORMWORK),
    Rule("R-DP-101", "conditional_program", "dp.excavation_depth", condition=(5, None), require_text="专家论证"),
    Rule("R-FS-002", "required", "fs.support.height", FORMWORK),
    Rule("R-FS-003", "required", "fs.pole.spacing", FORMWORK),
    Rule("R-FS-004", "required", "fs.formwork.type", FORMWORK),
    Rule("R-FS-012", "within_range", "fs.support.height", FORMWORK, min_value=2, max_value=30, unit="m"),
    Rule("R-FS-031", "threshold_max", "fs.pole.spacing", FORMWORK, op="<=", value=1.2, unit="m"),
    Rule("R-FS-041", "enum", "fs.formwork.type", FORMWORK, allowed=("扣件式", "盘扣式", "碗扣式", "门式"), **_ADVISED),
    Rule("R-FS-051", "checklist_section", "doc.sections", FORMWORK, sections=PLAN_SECTIONS),
    Rule("R-FS-101", "conditional_program", "fs.support.height", FORMWORK, condition=(8, None), require_text="专家论证"),
    Rule("R-FS-102", "conditional_program", "fs.support.height", FORMWORK, condition=(5, None), require_text="专项施工方案"),
)


RULES = tuple(replace(r, **dict(zip(("name", "basis", "advice", "category", "stage"), RULE_TEXTS[r.id], strict=True))) for r in _PREDICATES)


def rules(spark: SparkSession, rows: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as a relation, with their place in load order (``pos``)."""
    names = [c.split(" ")[0] for c in _columns(schemas.RULE)]
    data = []
    for i, r in enumerate(rows):
        row = {n: getattr(r, n) for n in names}
        row["sections"] = [(t, list(k)) for t, k in r.sections]
        row["allowed"], row["only_if_text"] = list(r.allowed), list(r.only_if_text)
        for n in ("value", "min_value", "max_value"):
            row[n] = None if row[n] is None else float(row[n])
        row["condition"] = None if r.condition is None else tuple(None if x is None else float(x) for x in r.condition)
        data.append((*[row[n] for n in names], i))
    return spark.createDataFrame(data, f"{schemas.RULE}, pos int")


def _columns(ddl: str) -> list[str]:
    """Top-level columns of a schema string."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


#: The state of an entry that has been put together but not been held against the official text.
UNCHECKED = "待核对"
_THRESHOLD = ("id", "param", "name", "op", "value", "unit", "condition", "basis", "doc", "article_no", "keywords")


def blocks(spark: SparkSession, rows: dict[str, tuple] = BLOCKS) -> DataFrame:
    """Passages as a relation."""
    data = [(f"{doc}#{i:05d}", doc, chapter, article, text, list(tags), UNCHECKED) for doc, items in rows.items() for i, (chapter, article, text, tags) in enumerate(items)]
    return spark.createDataFrame(data, "block_id string, doc string, chapter string, article_no string, text string, tags array<string>, status string")


def thresholds(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """Thresholds as a relation, default: the ones of the library; ``value`` may be a number, a text or a list, so it is a variant."""
    rows = [dict(zip(_THRESHOLD, x, strict=True)) | {"status": UNCHECKED} for x in THRESHOLDS] if rows is None else rows
    names = [c.split(" ")[0] for c in _columns(schemas.THRESHOLD)]
    data = [(*[json.dumps(r.get(n), ensure_ascii=False) if n == "value" else r.get(n, [] if n == "keywords" else "") for n in names], i) for i, r in enumerate(rows)]
    ddl = schemas.THRESHOLD.replace("value variant", "value string") + ", pos int"
    return spark.createDataFrame(data, ddl).withColumn("value", F.parse_json("value"))
