"""A labelled corpus from a rule: plans with known parameters and injected defects.

Everything follows from a document's number by arithmetic, so a corpus of any size is made on
the executors and reads the same every time.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Defects in turn, titles, and what the templates choose from.
PIT_DEFECTS = ("over_disp", "low_freq", "multi_disp", "unit_error", "missing_section")
FORMWORK_DEFECTS = ("over_height", "low_spacing", "multi_height", "unit_error", "missing_section")
PIT_TITLE = "深基坑土方开挖及支护专项施工方案（合成样例）"
FORMWORK_TITLE = "高大模板支撑体系（高支模）专项施工方案（合成样例）"
SUPPORTS = ("放坡+土钉墙", "桩锚支护", "地下连续墙+内支撑", "钢板桩+内支撑")
FORMWORKS = ("扣件式", "盘扣式", "碗扣式", "门式")

# Lines with a parameter, a gate word or a number that must not be read, and section titles, are fixed; the prose between them is free.
# {names} are filled per document, and a line that is null goes.
PIT = (
    ("一、工程概况", "合成项目 G{number}（虚构，只作测试），基坑采用{support}支护形式。"),
    (None, "基坑开挖深度为{depth}m，基坑侧壁安全等级为二级。"),
    ("二、编制依据", "1.《危险性较大的分部分项工程安全管理规定》；"),
    (None, "2.《专项施工方案编制指南》；"),
    (None, "3.《建筑基坑支护技术规程》JGJ 120-2012；"),
    (None, "4.《建筑基坑工程监测技术标准》GB 50497-2019。"),
    ("三、施工计划", "总工期{days}天，土方分3段推进。"),
    ("四、施工工艺技术", "4.1 土方开挖"),
    (None, "自上而下分层出土，每层开挖深度不超过1.5m。"),
    (None, "4.2 支护施工"),
    (None, "支护随土方逐段跟进，上段验收后再进入下段。"),
    ("五、施工安全保证措施", "5.1 组织保障"),
    (None, "安全小组由项目负责人牵头，逐级落实责任。"),
    (None, "5.2 监测方案"),
    (None, "支护结构顶部水平位移控制值为{disp}mm。"),
    (None, "开挖至坑底期间，监测频率为{freq}次/d。"),
    ("六、施工管理及作业人员配备", "安全员两名常驻现场，特种工种凭证作业。"),
    ("七、验收要求", "支护结构按现行规程验收，不合格不得转序。"),
    (None, "{review}"),
    ("八、应急处置措施", "备有应急预案和物资，每季演练一次。"),
    ("九、计算书及相关图纸", "计算书与支护平面图另附（合成样例从略）。"),
    (None, "{second}"),
)
FORMWORK = (
    ("一、工程概况", "合成项目 G{number}（虚构，只作测试），模板支撑体系采用{form}钢管脚手架搭设。"),
    (None, "本工程属危大工程中的混凝土模板支撑工程，编制本专项施工方案。"),
    ("二、编制依据", "1.《危险性较大的分部分项工程安全管理规定》；"),
    (None, "2.《专项施工方案编制指南》；"),
    (None, "3.《建筑施工模板安全技术规范》JGJ 162-2008；"),
    (None, "4.《建筑施工扣件式钢管脚手架安全技术规范》JGJ 130-2011。"),
    ("三、施工计划", "总工期{days}天，搭设与浇筑分3区推进。"),
    ("四、施工工艺技术", "4.1 模板支撑体系设计"),
    (None, "模板支撑体系搭设高度为{height}m。"),
    (None, "支撑体系采用{form}钢管，立杆底部设置垫板与扫地杆。"),
    (None, "4.2 混凝土浇筑"),
    (None, "浇筑分层对称进行，楼面不得集中堆料。"),
    ("五、施工安全保证措施", "5.1 组织保障"),
    (None, "安全小组由项目负责人牵头，逐级落实责任。"),
    (None, "5.2 监测方案"),
    (None, "模板支撑体系立杆间距为{spacing}m，浇筑时专人观测支架变形。"),
    ("六、施工管理及作业人员配备", "安全员两名常驻现场，特种工种凭证作业。"),
    ("七、验收要求", "支架按现行规范验收，不合格不得浇筑。"),
    ("八、应急处置措施", "备有应急预案和物资，每季演练一次。"),
    ("九、计算书及相关图纸", "计算书与模板平面图另附（合成样例从略）。"),
    (None, "{second}"),
)
REVIEWED = "本工程基坑属超过一定规模的危大工程，已按规定组织专家论证，论证意见已落实。"
EMERGENCY = "八、应急处置措施"


def _pick(options: tuple, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (n % len(options) + 1).cast("int"))


def _number(x: Column) -> Column:
    """Shortest decimal: no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(12,2)").cast("string"), r"0+$", ""), r"\.$", "")


def specs(spark: SparkSession, count: int, formwork: bool = False, first_id: int = 0) -> DataFrame:
    """One row per plan: its parameters, its one or two defects, what extraction must give."""
    kinds = FORMWORK_DEFECTS if formwork else PIT_DEFECTS
    i = F.col("i")
    d = spark.range(count).select(F.col("id").alias("i"), (F.col("id") + first_id).alias("doc_id"))
    d = d.withColumns({"d1": _pick(kinds, i), "d2": _pick(kinds, i + count // 2 + 1), "number": F.lpad((i + 1).cast("string"), 4, "0"), "days": (30 + i * 7 % 60).cast("string")})
    d = d.withColumn("defects", F.array_distinct(F.array("d1", "d2")))
    has = lambda k: F.array_contains("defects", F.lit(k))
    if formwork:
        natural, space = 5.5 + (i * 7 % 21) / 10, _pick((0.8, 0.9, 0.9, 1.0, 1.1), i)
        height = F.round(F.when(has("over_height"), 8.5).otherwise(natural), 1)
        spacing = F.when(has("low_spacing"), 1.5).otherwise(space)
        second = F.when(has("multi_height") & ~has("over_height"), F.round(F.least(F.lit(7.8), natural + 1.0), 1))
        return d.withColumns({"form": _pick(FORMWORKS, i), "height": height, "spacing": spacing, "second": second}).withColumns({
            "heights": F.array_sort(F.array_distinct(F.array_compact(F.array("height", "second")))),
            "said_spacing": F.when(has("unit_error"), F.col("spacing") * 100).otherwise(F.col("spacing")),
        })
    depth, disp = F.round(4.0 + (i * 13 % 51) / 10, 1), F.when(has("over_disp"), 35).otherwise(20 + i * 5 % 9).cast("double")
    freq = F.when(has("low_freq"), 0.5).otherwise(_pick((2.0, 2.0, 2.5), i))
    d = d.withColumns({"support": _pick(SUPPORTS, i * 3), "depth": depth, "disp": disp, "freq": freq})
    return d.withColumns({"second": F.when(has("multi_disp"), F.col("disp") + 5), "said_depth": F.when(has("unit_error"), F.col("depth") * 100).otherwise(F.col("depth"))})


@lru_cache(maxsize=2)
def _lines(formwork: bool) -> Column:
    """Array of (text, level) of a plan's lines; made once, as it has some hundred parts."""
    missing = F.array_contains("defects", F.lit("missing_section"))
    if formwork:
        fill = {"number": F.col("number"), "days": F.col("days"), "form": F.col("form"), "height": _number(F.col("height")), "spacing": _number(F.col("said_spacing"))}
        fill["second"] = F.concat(F.lit("计算书中模板支撑体系搭设高度取"), _number(F.col("second")), F.lit("m。"))
    else:
        fill = {"number": F.col("number"), "days": F.col("days"), "support": F.col("support"), "depth": _number(F.col("said_depth")), "disp": _number(F.col("disp")), "freq": _number(F.col("freq"))}
        fill["second"] = F.concat(F.lit("计算书中支护结构顶部水平位移控制值取"), _number(F.col("second")), F.lit("mm。"))
        fill["review"] = F.when(F.col("depth") >= 5, REVIEWED)

    def line(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[fill[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)]) if len(parts) > 1 else F.lit(template)

    rows = [F.struct(F.lit(FORMWORK_TITLE if formwork else PIT_TITLE).alias("text"), F.lit(0).alias("level"))]
    section = ""
    for heading, paragraph in FORMWORK if formwork else PIT:
        section = heading or section
        there = ~missing if section == EMERGENCY else F.lit(True)
        if heading:
            rows.append(F.when(there, F.struct(F.lit(heading).alias("text"), F.lit(1).alias("level"))))
        text = line(paragraph)
        rows.append(F.when(there & text.isNotNull(), F.struct(text.alias("text"), F.lit(None).cast("int").alias("level"))))
    return F.array_compact(F.array(*rows))


def render(spec: DataFrame, formwork: bool = False) -> DataFrame:
    """doc_id, pos, text, level: the title, then headings (level 1) and paragraphs."""
    return spec.select("doc_id", F.posexplode(_lines(formwork)).alias("pos", "_r")).select("doc_id", "pos", "_r.text", "_r.level")


def from_truth(labelled: DataFrame, formwork: bool = False) -> DataFrame:
    """Plans to render (as :func:`specs`) from labelled truth: doc_id, expected_cards (values as text, by parameter), injected.

    A parameter with a wrong unit isn't expected; what the plan says of it stands in the defect's detail.
    """
    got = lambda p, i=1: F.try_element_at(F.col("expected_cards")[p], F.lit(i))
    number = lambda p, i=1: got(p, i).cast("double")
    wrong = F.filter("injected", lambda x: x["type"] == "unit_error")
    said = F.regexp_extract(F.try_element_at(wrong, F.lit(1))["detail"], r"([0-9]+(?:\.[0-9]+)?)m", 1).cast("double")
    out = labelled.withColumns({"defects": F.transform("injected", lambda x: x["type"]), "number": F.lpad(F.regexp_extract("file", r"([0-9]+)", 1), 4, "0"), "days": F.lit("60")})
    if formwork:
        return out.withColumns({
            "form": got("fs.formwork.type"), "height": number("fs.support.height"), "second": number("fs.support.height", 2), "spacing": F.coalesce(number("fs.pole.spacing"), said / 100),
            "said_spacing": F.coalesce(number("fs.pole.spacing"), said), "heights": F.transform(F.col("expected_cards")["fs.support.height"], lambda x: x.cast("double")),
        })
    return out.withColumns({
        "support": got("dp.support_type"), "depth": F.coalesce(number("dp.excavation_depth"), said / 100), "said_depth": F.coalesce(number("dp.excavation_depth"), said),
        "disp": number("dp.retaining.displacement"), "second": number("dp.retaining.displacement", 2), "freq": number("dp.monitoring.frequency"),
    })


def injected(labelled: DataFrame) -> DataFrame:
    """As :func:`expected`, from labelled truth."""
    rows = labelled.select("doc_id", F.posexplode("injected").alias("inj_no", "_x"))
    pairs = F.concat(F.array("_x.expect"), F.coalesce("_x.also_expect", F.array().cast("array<struct<rule_id:string,result:string>>")))
    return rows.select("doc_id", "inj_no", "_x.type", F.explode(pairs).alias("_p")).select("doc_id", "inj_no", "type", "_p.rule_id", "_p.result")


def labelled_values(labelled: DataFrame) -> DataFrame:
    """As :func:`truth`, from labelled truth; what reads as a number is one."""
    rows = labelled.select("doc_id", F.explode("expected_cards").alias("param", "_v")).select("doc_id", "param", F.explode("_v").alias("_v"))
    num = F.expr("try_cast(_v AS DOUBLE)")
    return rows.select("doc_id", "param", num.alias("num"), F.when(num.isNull(), F.col("_v")).alias("txt"))


def truth(spec: DataFrame, formwork: bool = False) -> DataFrame:
    """doc_id, param, num, txt: what extraction must give."""
    bad_unit = F.array_contains("defects", F.lit("unit_error"))
    none = F.array().cast("array<double>")
    if formwork:
        numbers = {"fs.support.height": F.col("heights"), "fs.pole.spacing": F.when(bad_unit, none).otherwise(F.array("spacing"))}
        words = {"fs.formwork.type": F.col("form")}
    else:
        numbers = {
            "dp.excavation_depth": F.when(bad_unit, none).otherwise(F.array("depth")),
            "dp.retaining.displacement": F.array_compact(F.array("disp", "second")),
            "dp.monitoring.frequency": F.array("freq"),
        }
        words = {"dp.support_type": F.col("support"), "dp.safety_grade": F.lit("二级")}
    of = [F.transform(v, lambda x: x.cast("double")) for v in numbers.values()]
    n = [F.transform(v, _fact(k)) for k, v in zip(numbers, of, strict=True)]
    t = [F.array(F.struct(F.lit(k).alias("param"), F.lit(None).cast("double").alias("num"), v.alias("txt"))) for k, v in words.items()]
    return spec.select("doc_id", F.explode(F.concat(*n, *t)).alias("_t")).select("doc_id", "_t.*")


def _fact(param: str):
    return lambda x: F.struct(F.lit(param).alias("param"), x.alias("num"), F.lit(None).cast("string").alias("txt"))


# The findings that each defect must give, the first one first.
EXPECTED = {
    "over_disp": (("R-DP-021", "fail"),),
    "low_freq": (("R-DP-031", "fail"), ("R-DP-061", "fail")),
    "multi_disp": (("R-DP-021", "manual"), ("R-DP-022", "manual"), ("R-DP-062", "manual"), ("R-DP-073", "manual")),
    "unit_error": (("R-DP-001", "fail"),),
    "missing_section": (("R-DP-051", "fail"),),
    "over_height": (("R-FS-101", "fail"),),
    "low_spacing": (("R-FS-031", "fail"),),
    "multi_height": (("R-FS-012", "manual"),),
    "fs:unit_error": (("R-FS-003", "fail"),),
    "fs:missing_section": (("R-FS-051", "fail"),),
}


def expected(spec: DataFrame, formwork: bool = False) -> DataFrame:
    """doc_id, inj_no, type, rule_id, result: the findings that the defects must give.

    Two defects that touch the same parameter hide one another: a second value beside an excess makes
    the check manual, an excess drops the second height, and a wrong unit drops the spacing.
    """
    rows = spec.select("doc_id", F.posexplode("defects").alias("inj_no", "type"), "defects")
    if formwork:
        rows = rows.where(~((F.col("type") == "multi_height") & F.array_contains("defects", F.lit("over_height"))))
        rows = rows.where(~((F.col("type") == "low_spacing") & F.array_contains("defects", F.lit("unit_error"))))
    else:
        rows = rows.where(~((F.col("type") == "over_disp") & F.array_contains("defects", F.lit("multi_disp"))))
    key = F.when(F.col("type").isin("unit_error", "missing_section"), F.concat(F.lit("fs:" if formwork else ""), F.col("type"))).otherwise(F.col("type"))
    pairs = F.lit(None).cast("array<struct<rule_id:string,result:string>>")
    for k, v in EXPECTED.items():
        pairs = F.when(key == k, F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(x).alias("result")) for r, x in v])).otherwise(pairs)
    return rows.select("doc_id", "inj_no", "type", F.explode(pairs).alias("_p")).select("doc_id", "inj_no", "type", "_p.*")


def truth_files(spec: DataFrame, formwork: bool = False, seed: int = 2026) -> DataFrame:
    """file, value: each plan's truth as JSON, as :func:`clausemill.sources.files.truth` reads it."""
    said = F.coalesce("txt", F.regexp_replace(F.col("num").cast("string"), r"\.0$", ""))
    cards = truth(spec, formwork).groupBy("doc_id", "param").agg(F.array_sort(F.collect_list(said)).alias("v"))
    cards = cards.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "v")))).alias("expected_cards"))
    pair = F.struct("rule_id", "result")
    wrong = F.col("said_spacing") if formwork else F.col("said_depth")
    found = expected(spec, formwork).groupBy("doc_id", "inj_no", "type").agg(F.collect_list(pair).alias("_p")).join(spec.select("doc_id", _number(wrong).alias("_said")), "doc_id")
    main = F.coalesce(F.try_element_at(F.filter("_p", lambda x: x["rule_id"].isin(*[v[0][0] for v in EXPECTED.values()])), F.lit(1)), F.col("_p")[0])
    detail = F.when(F.col("type") == "unit_error", F.concat(F.lit("误写为"), "_said", F.lit("m"))).otherwise(F.col("type"))
    each = F.struct("inj_no", "type", detail.alias("detail"), main.alias("expect"), F.filter("_p", lambda x: x != main).alias("also_expect"))
    injections = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("_i"))
    x = spec.select("doc_id", "number").join(cards, "doc_id").join(injections, "doc_id", "left")
    file = F.concat(F.lit("fs_" if formwork else "gen_"), "number", F.lit(".docx"))
    listed = F.coalesce(F.transform("_i", lambda r: r.dropFields("inj_no")), F.slice(F.transform("_i", lambda r: r.dropFields("inj_no")), 1, 0))
    value = F.struct(
        file.alias("file"), F.lit("formwork_support" if formwork else "deep_pit").alias("category"), F.lit(seed).alias("seed"), F.lit(FORMWORK_TITLE if formwork else PIT_TITLE).alias("title"), "expected_cards", listed.alias("injected")
    )
    return x.select(file.alias("file"), F.to_json(value).alias("value"))
