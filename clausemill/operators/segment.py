"""Documents to ordered lines with offsets and section paths.

A document's lines are numbered, and its section stack followed, by windows over ``doc_id``; a
single document is the unit of order, everything else is independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import text as T

#: Levels that have a window each; deeper headings take a longer way.
DEEPEST = 9


def raw_lines(docs: DataFrame, text: str = "text", by: Column | None = None) -> DataFrame:
    """doc_id, pos, text: the lines of every document (one per array element of ``by``, default: split at newlines)."""
    parts = by if by is not None else F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))


def lines(raw: DataFrame) -> DataFrame:
    """Stripped lines that aren't blank, renumbered from 0, with running code-point offsets.

    ``raw`` has doc_id, pos, text and may have page and level (of a styled heading). An offset is the sum
    of the lengths before, one more each for the line end.
    """
    kept = raw.withColumn("text", T.strip(F.col("text"))).where("text != ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    start = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    out = kept.withColumns({"line_no": (F.row_number().over(w) - 1).cast("int"), "char_start": start})
    page = F.col("page") if "page" in raw.columns else F.lit(None).cast("int")
    styled = F.col("level") if "level" in raw.columns else F.lit(None).cast("int")
    level = F.coalesce(styled, T.heading_level(F.col("text")))
    return out.select(
        "doc_id", "line_no", "text", page.alias("page"), F.when(level > 0, level).cast("int").alias("level"),
        "char_start", (F.col("char_start") + F.length("text")).cast("int").alias("char_end"),
    )


def paths(numbered: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Adds section_path: titles of the headings that are open at each line, a heading's own included.

    The stack without a stack: the last heading of a level is open unless a heading of a
    smaller level came after it. Headings beyond level ``deepest`` are rare and few between two others: there the stack
    is folded from the list of them since the last other one.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("level")
    last = lambda k: F.last(F.when(level == k, F.struct(F.col("line_no").alias("n"), F.col("text").alias("t"))), ignorenulls=True).over(w)
    out = numbered.withColumns({f"_l{k}": last(k) for k in range(1, deepest + 1)} | {"_part": F.count_if(level <= deepest).over(w)})
    within = Window.partitionBy("doc_id", "_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    deep = F.collect_list(F.when(level > deepest, F.struct("level", "text"))).over(within)
    step = lambda acc, x: F.array_append(F.filter(acc, lambda y: y["level"] < x["level"]), x)
    none = F.array().cast("array<struct<level:int,text:string>>")
    parts, latest = [], F.lit(-1)
    for k in range(1, deepest + 1):
        at = F.col(f"_l{k}.n")
        parts.append(F.when(at > latest, F.col(f"_l{k}.t")))
        latest = F.greatest(latest, F.coalesce(at, F.lit(-1)))
    out = out.withColumn("_deep", deep)
    parts.append(F.when(F.size("_deep") > 0, F.array_join(F.transform(F.aggregate("_deep", none, step), lambda x: x["text"]), "/")))
    return out.withColumn("section_path", F.concat_ws("/", *parts)).drop(*[f"_l{k}" for k in range(1, deepest + 1)], "_part", "_deep")


def sections(with_paths: DataFrame) -> DataFrame:
    """The headings in order: doc_id, ord, title, level, page, path."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    heads = with_paths.where("level is not null")
    return heads.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), F.col("text").alias("title"), "level", "page", F.col("section_path").alias("path"))


def parse(raw: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Raw lines to lines with level and section_path; :func:`sections` is a filter of this."""
    return paths(lines(raw), deepest)


def from_array(docs: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, pos, text of documents whose lines are an array already."""
    return docs.select("doc_id", *keep, F.posexplode(column).alias("pos", "text"))
