"""Files to relations: documents in office formats, and JSON configuration.

Bytes are read by Spark's ``binaryFile`` source, so any store that Spark reads will do; the office
format is a zip of XML, taken apart on the executors with the standard library.
"""

from __future__ import annotations

import io
import json
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clausemill import schemas
from clausemill.workers import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUFFIXES = (".docx", ".pdf")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def dispatched(files: DataFrame) -> DataFrame:
    """Adds suffix; a file of another kind is an error that names it."""
    known = suffix(F.col("path")).isin(*SUFFIXES)
    return files.withColumn("suffix", F.when(known, suffix(F.col("path"))).otherwise(F.raise_error(F.concat(F.lit("unknown format: "), F.col("path")))))


def style_level(style: str) -> int | None:
    """Level of a heading style: its first number, if it is one."""
    n = re.search(r"\d+", style or "")
    return int(n[0]) if n and style.startswith(("Heading", "标题", "heading")) else None


def docx_lines(content: bytes) -> Iterator[tuple[str, int | None]]:
    """Text and heading level of paragraphs and table cells in order; cells are never headings (level 0)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    written = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n"}
    said = lambda p: "".join(written[x.tag](x) for x in p.iter() if x.tag in written)
    for block in body if body is not None else ():
        if block.tag == f"{_W}p" and said(block).strip():
            style = block.find(f"{_W}pPr/{_W}pStyle")
            sid = style.get(f"{_W}val") if style is not None else ""
            yield said(block), style_level((names.get(sid) or sid).replace("heading", "Heading"))
        elif block.tag == f"{_W}tbl":
            for cell in block.iter(f"{_W}tc"):
                yield "\n".join(map(said, cell.findall(f"{_W}p"))), 0


_RAW = "doc string, pos int, text string, page int, level int, error string"


def _read_each(spark: SparkSession, path: str, suffixes: str, lines: Callable[[bytes], Iterator[tuple[str, int | None, int | None]]]) -> DataFrame:
    """Lines (text, page, level) of every file; a file that can't be read gives one row with its error, and stops no other."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                try:
                    rows = [(name, i, t, page, lv, None) for i, (t, page, lv) in enumerate(lines(bytes(content)))]
                except Exception as e:  # a broken file may fail anywhere in its zip or XML
                    rows = [(name, -1, "", None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["doc", "pos", "text", "page", "level", "error"]).astype({"page": "Int32", "level": "Int32"})

    return found.mapInPandas(read, _RAW)


def docx(spark: SparkSession, path: str) -> DataFrame:
    """doc (file name), pos, text, page (null), level, error of every docx file under ``path``."""
    return _read_each(spark, path, "*.{docx,DOCX}", lambda content: ((t, None, lv) for t, lv in docx_lines(content)))


def pdf_lines(content: bytes) -> Iterator[tuple[str, int, None]]:
    """Text and page of the lines of a text PDF that aren't blank; needs an optional library."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber; page extracts as JSON lines are read without it") from e
    with pdfplumber.open(io.BytesIO(content)) as document:
        for number, page in enumerate(document.pages, 1):
            yield from ((x.strip(), number, None) for x in (page.extract_text() or "").split("\n") if x.strip())


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """doc, pos, text, page, level (null), error of every PDF file under ``path``."""
    return _read_each(spark, path, "*.{pdf,PDF}", pdf_lines)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the office and PDF files under ``path``; a file named as such that has another format is an error."""
    if "." in path.rsplit("/", 1)[-1] and not path.lower().endswith(SUFFIXES):
        raise ValueError(f"unknown format: {path}")
    return docx(spark, path).unionByName(pdf(spark, path))


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """label, text of the files that a git work tree tracks; binary ones are passed over, of office files all entries are read."""
    names = [n for n in _git(root, "ls-files").splitlines() if n]
    plain = [f"{root}/{n}" for n in names if not n.lower().endswith((".docx", ".xlsx", ".pptx"))]
    office = [f"{root}/{n}" for n in names if n.lower().endswith((".docx", ".xlsx", ".pptx"))]
    out = spark.createDataFrame([], "label string, text string")
    if plain:
        content = spark.read.format("binaryFile").load(plain).where(~F.contains(F.substring("content", 1, 8192), F.lit(b"\0")))
        out = out.union(content.select(F.col("path").alias("label"), F.decode("content", "UTF-8").alias("text")))
    return out.union(zip_entries(spark, office)) if office else out


def commits(spark: SparkSession, root: str) -> DataFrame:
    """author, committer, sha of every commit of a git work tree."""
    rows = [tuple((x.split("\t") + ["", "", ""])[:3]) for x in _git(root, "log", "--all", "--format=%ae%x09%ce%x09%h").splitlines() if x.strip()]
    return spark.createDataFrame(rows, "author string, committer string, sha string")


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "core.quotepath=false", *args], cwd=root, capture_output=True, check=True).stdout.decode("utf-8", "replace")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted page texts (JSON lines doc, page from 1, text) to doc, pos, text, page: one row per line that isn't blank."""
    rows = spark.read.schema("doc string, page int, text string").json(path)
    lines = rows.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("k", "text")).where("trim(text) != ''")
    return lines.select("doc", (F.col("page") * 1_000_000 + F.col("k")).alias("pos"), F.trim("text").alias("text"), "page")


def zip_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """label, text of every entry of office files: each entry's name, and the content of XML entries."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pptx}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(f"{p}!{n}", n) for n in z.namelist()]
                    rows += [(f"{p}!{n}", z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith((".xml", ".rels"))]
                yield pd.DataFrame(rows, columns=["label", "text"])

    return files.mapInPandas(read, "label string, text string")


def _ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files (a list, or an object) with their name; order is file name, then place."""
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path).withColumn("_file", F.col("_metadata.file_name"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file or folder in load order; a structured basis gives its quote, else its standard."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("_file"), F.coalesce(F.get_json_object("value", "$.rules"), F.col("value")).alias("value"))
    items = text.select("_file", F.posexplode(F.from_json("value", "array<string>")).alias("_i", "_r"))
    basis = F.coalesce(F.get_json_object("_r", "$.basis.quote"), F.get_json_object("_r", "$.basis.standard"), F.get_json_object("_r", "$.basis"))
    parsed = items.withColumn("r", F.from_json("_r", schemas.RULE)).withColumn("r", F.col("r").withField("basis", basis).withField("enabled", F.coalesce("r.enabled", F.lit(True))))
    out = parsed.select("r.*", "_file", "_i").collect()
    numbered = [(*row[:-2], i) for i, row in enumerate(sorted(out, key=lambda x: (x["_file"], x["_i"])))]
    return spark.createDataFrame(numbered, f"{schemas.RULE}, pos int")


def rule_bases(spark: SparkSession, path: str) -> DataFrame:
    """id, status, reviewed_at and next_review of the rules with a structured basis."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.coalesce(F.get_json_object("value", "$.rules"), F.col("value")).alias("value"))
    items = text.select(F.explode(F.from_json("value", "array<string>")).alias("_r"))
    of = lambda k: F.get_json_object("_r", f"$.{k}")
    return items.select(of("id").alias("id"), *[of(f"basis.{k}").alias(k) for k in ("status", "reviewed_at", "next_review")]).where("status is not null or next_review is not null")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a folder; an item's own doc and status go before the file's, those before the file name and the default."""
    item = "struct<doc:string,chapter:string,article_no:string,text:string,tags:array<string>,status:string>"
    files = _ordered(spark, path, f"meta struct<doc:string,status_default:string>, blocks array<{item}>")
    rows = files.select("_file", "meta", F.posexplode("blocks").alias("_i", "b"))
    stem = F.regexp_replace("_file", r"\.json$", "")
    return rows.select(
        F.concat_ws("#", "_file", F.format_string("%05d", "_i")).alias("block_id"), F.coalesce("b.doc", "meta.doc", stem).alias("doc"), F.coalesce("b.chapter", F.lit("")).alias("chapter"),
        F.coalesce("b.article_no", F.lit("")).alias("article_no"), "b.text", F.coalesce("b.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("b.status", "meta.status_default", F.lit("待核对")).alias("status"),
    )


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Thresholds of a file or folder in load order; a missing doc is the file's category."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        F.col("_metadata.file_name").alias("_file"), F.coalesce(F.get_json_object("value", "$.thresholds"), F.col("value")).alias("value"), F.get_json_object("value", "$.meta.category").alias("_c")
    )
    items = text.select("_file", "_c", F.posexplode(F.from_json("value", "array<string>")).alias("_i", "_r"))
    t = items.withColumn("t", F.from_json("_r", schemas.THRESHOLD.replace("value variant", "value string")))
    blank = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(""))
    pos = F.row_number().over(Window.orderBy("_file", "_i")) - 1
    return t.select(
        blank("id").alias("id"), blank("param").alias("param"), blank("name").alias("name"), blank("op").alias("op"), F.variant_get(F.parse_json("_r"), "$.value", "variant").alias("value"),
        blank("unit").alias("unit"), blank("condition").alias("condition"), blank("basis").alias("basis"), F.coalesce("t.doc", "_c", F.lit("")).alias("doc"), blank("article_no").alias("article_no"),
        F.coalesce("t.keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("t.status", F.lit("待核对")).alias("status"), pos.alias("pos"),
    )


def aliases(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Aliases by parameter, longer ones first, equal lengths in the given order."""
    text = spark.read.text(path, wholetext=True).first()
    return {k: sorted(v, key=len, reverse=True) for k, v in json.loads(text[0]).items()}


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled truth files: file, category, seed, title, expected_cards (texts and numbers as strings), injected."""
    pair = "struct<rule_id:string,result:string>"
    schema = f"file string, category string, seed int, title string, expected_cards map<string,array<string>>, injected array<struct<type:string,detail:string,expect:{pair},also_expect:array<{pair}>>>"
    return _ordered(spark, path, schema).drop("_file")


def resumed(spark: SparkSession, path: str, schema: str, key: str = "file") -> DataFrame:
    """A JSON-lines log: blank and broken lines are passed over, the last record of each ``key`` counts."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE").withColumn("_at", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    good = rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull())
    names = [c for c in good.columns if c not in ("_corrupt_record", "_at", key)]
    return good.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("_r")).select(key, "_r.*")
