"""Lines to parameter cards (one fact each) with their evidence.

A line is matched within its row: no join with the aliases. A line that has none of a
parameter's aliases is passed over by a plain substring test.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import text as T
from clausemill.sources.tables import NUMERIC, TEXTUAL, UNITS, Numeric, Textual

_SPAN = "array<struct<m:string,s:bigint,e:bigint,a:int>>"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _configured(params: Sequence[Numeric], units: dict[str, str]) -> tuple[Column, Column]:
    """The parameters, and the names of units, as constants of the plan."""
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")

    def of(p: Numeric) -> Column:
        return F.struct(
            F.lit(p.id).alias("param_id"), F.lit(p.name).alias("name"), F.lit(p.category).alias("category"), F.lit(p.low).alias("low"), F.lit(p.high).alias("high"),
            F.lit(p.metres).alias("metres"), words(p.not_after).alias("guards"),
        )

    return F.array(*map(of, params)), F.create_map(*[F.lit(x) for kv in units.items() for x in kv]) if units else F.create_map().cast("map<string,string>")


def _matched(norm: Column, params: Sequence[Numeric]) -> Column:
    """Array of (p, found) of the parameters that the line names: every alias's matches, longer aliases first. Patterns are literals, so each is compiled once."""
    none = F.array().cast("array<string>")

    def of(i: int, p: Numeric) -> Column:
        hits = [F.when(F.contains(norm, F.lit(x)), F.regexp_extract_all(norm, F.lit(f"{T.quoted(x)}[^0-9]{{0,6}}?{NUMBER}{p.unit}"), 0)).otherwise(none) for x in p.ranked()]
        return F.struct(F.lit(i).alias("p"), F.array(*hits).alias("found"))

    return F.filter(F.array(*[of(i, p) for i, p in enumerate(params)]), lambda x: F.exists(x["found"], lambda m: F.size(m) > 0))


def accepted(norm: Column, found: Column, guards: Column) -> Column:
    """Matches of a parameter, longer aliases first, then by place, that overlap no accepted one and
    don't follow a guard word within four characters.

    A match out of the physical range holds its place too; a guarded one doesn't.
    """
    every = F.transform(found, lambda m, a: F.transform(T.placed(norm, m), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), x["e"].alias("e"), a.alias("a"))))

    def guarded(x: Column) -> Column:
        before = F.when(x["s"] == 0, "").otherwise(F.substr(norm, F.greatest(x["s"] - 3, F.lit(1)).cast("int"), F.least(x["s"], F.lit(4)).cast("int")))
        return F.exists(guards, lambda g: F.contains(before, g))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"]))
        return F.when(taken | guarded(x), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(F.flatten(every), F.array().cast(_SPAN), step)


def _read(x: Column, config: Column, units: Column) -> Column:
    """A match with its value and unit, read once: in steps, so that no expression stands in a plan twice."""
    said = F.regexp_extract(x["m"], f"{NUMBER}([^0-9]+)$", 1)
    raw = F.struct(F.regexp_extract(x["m"], f"({NUMBER})", 1).cast("double").alias("v"), F.coalesce(F.element_at(units, said), said).alias("u"))
    shrunk = F.transform(F.array(raw), lambda r: F.when((r["u"] == "mm") & config["metres"], F.struct((r["v"] / 1000.0).alias("v"), F.lit("m").alias("u"))).otherwise(r))
    return F.element_at(
        F.transform(shrunk, lambda r: F.struct(x["a"].alias("a"), x["s"].alias("s"), x["m"].alias("raw_text"), r["v"].alias("value"), r["u"].alias("unit"), ((r["v"] > config["low"]) & (r["v"] <= config["high"])).alias("in_range"))), 1
    )


@lru_cache(maxsize=8)
def _facts(params: tuple[Numeric, ...], units: tuple[tuple[str, str], ...]) -> tuple[str, Column, Column, Column]:
    """The test of a line, its matches by parameter, the parameter's constants, and its facts: made once, as they have some hundred parts."""
    configs, unit_names = _configured(params, dict(units))
    named = "|".join(T.quoted(a) for p in params for a in p.aliases)
    facts = F.transform(accepted(F.col("_norm"), F.col("_p.found"), F.col("_c.guards")), lambda x: _read(x, F.col("_c"), unit_names))
    return named, _matched(F.col("_norm"), params), F.element_at(configs, F.col("_p.p") + 1), facts


def numeric(lines: DataFrame, params: Sequence[Numeric] = NUMERIC, units: dict[str, str] = UNITS) -> DataFrame:
    """Every numeric fact: the line's columns, the parameter's, value, unit, place, in_range (both sides of the range filter)."""
    named, matched, config, facts = _facts(tuple(params), tuple(units.items()))
    norm = lines.withColumn("_norm", T.normalise(F.col("text"))).where(F.col("_norm").rlike(named))  # one test: the filter holds the folding once
    hits = norm.withColumn("_p", F.explode(matched)).withColumn("_c", config)
    out = hits.select(*lines.columns, "_p.p", "_c", F.explode(facts).alias("_x"))
    return out.select(*lines.columns, "p", "_c.param_id", "_c.name", "_c.category", "_c.low", "_c.high", "_x.*", F.lit(1).alias("kind"))


@lru_cache(maxsize=8)
def _said(params: tuple[Textual, ...]) -> Column:
    """Array of the textual parameters' facts in a line."""
    norm = F.col("_norm")

    def of(i: int, p: Textual) -> Column:
        value = raw = F.lit(None).cast("string")
        for pattern in reversed(p.patterns):
            hit = norm.rlike(f"(?d){pattern}")
            value = F.when(hit, T.strip(F.regexp_extract(norm, f"(?d){pattern}", 1))).otherwise(value)
            raw = F.when(hit, F.regexp_extract(norm, f"(?d){pattern}", 0)).otherwise(raw)
        return F.struct(F.lit(i).alias("p"), F.lit(p.id).alias("param_id"), F.lit(p.name).alias("name"), F.lit(p.category).alias("category"), value.alias("text_value"), raw.alias("raw_text"))

    return F.filter(F.array(*[of(i, p) for i, p in enumerate(params)]), lambda x: x["text_value"].isNotNull())


def textual(lines: DataFrame, params: Sequence[Textual] = TEXTUAL) -> DataFrame:
    """The first fact of each textual parameter in a document: patterns in order within a line, lines in order."""
    any_ = "(?d)" + "|".join(f"(?:{x})" for p in params for x in p.patterns)
    some = lines.withColumn("_norm", T.normalise(F.col("text"))).where(F.col("_norm").rlike(any_))
    hits = some.withColumn("_x", F.explode(_said(tuple(params))))
    first = hits.groupBy("doc_id", "_x.param_id").agg(F.min_by(F.struct(*lines.columns, "_x"), "line_no").alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in lines.columns], "_r._x.*")


def _evidence(doc: Column) -> Column:
    return F.struct(doc.alias("doc"), F.col("section_path").alias("section"), F.col("page"), F.col("text").alias("line_text"), "char_start", "char_end")


def cards(lines: DataFrame, params: Sequence[Numeric] = NUMERIC, texts: Sequence[Textual] = TEXTUAL, doc: Column | None = None) -> DataFrame:
    """All cards in order: by line, textual ones first, then by parameter, alias and place."""
    doc = F.col("doc_id").cast("string") if doc is None else doc
    n = numeric(lines, params).where("in_range").withColumn("text_value", F.lit(None).cast("string"))
    t = textual(lines, texts).withColumns({"value": F.lit(None).cast("double"), "unit": F.lit(""), "a": F.lit(0), "s": F.lit(0).cast("long"), "kind": F.lit(0)})
    columns = ["doc_id", "line_no", "kind", "p", "a", "s", "param_id", "name", "value", "unit", "text_value", "raw_text", "category"]
    both = n.select(*columns, _evidence(doc).alias("evidence")).union(t.select(*columns, _evidence(doc).alias("evidence")))
    ordered = both.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "kind", "p", "a", "s")) - 1).cast("int"))
    return ordered.select(
        "doc_id", "ord", "param_id", "name", "value", "unit", "text_value", "raw_text", "category",
        F.lit(1.0).alias("confidence"), F.lit("rule").alias("source"), "evidence",
    )


def discarded(lines: DataFrame, params: Sequence[Numeric] = NUMERIC) -> DataFrame:
    """Facts out of the physical range: doc_id, param, value, unit, line, reason."""
    reason = F.concat(F.lit("超出物理合理范围("), T.number(F.col("low")), F.lit(", "), T.number(F.col("high")), F.lit("]"))
    return numeric(lines, params).where("not in_range").select("doc_id", F.col("param_id").alias("param"), "value", "unit", F.col("text").alias("line"), reason.alias("reason"))


def scanned(lines: DataFrame) -> DataFrame:
    """Lines looked at per document."""
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines_scanned"))
