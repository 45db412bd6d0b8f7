"""Office documents out of blocks of text, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from clausemill.workers import ship

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'

#: A paragraph is (text, level): 0 a title, 1 to 9 a heading, None plain; a table is a list of rows of cells.
Block = tuple[str, int | None] | Sequence[Sequence[str]]


def build(blocks: Iterable[Block]) -> bytes:
    """A document of these blocks."""
    def paragraph(text: str, level: int | None = None) -> str:
        style = "" if level is None else f'<w:pPr><w:pStyle w:val="{"Title" if level == 0 else f"Heading{level}"}"/></w:pPr>'
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def table(rows: Sequence[Sequence[str]]) -> str:
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"

    body = "".join(paragraph(*b) if isinstance(b, tuple) else table(b) for b in blocks)
    named = [("Title", "Title"), *((f"Heading{i}", f"heading {i}") for i in range(1, 10))]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in named)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format("officeDocument", "word/document.xml"))
        z.writestr("word/_rels/document.xml.rels", _RELS.format("styles", "styles.xml"))
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def from_markdown(text: str) -> list[Block]:
    """Headings, tables and paragraphs of a report."""
    out: list[Block] = []
    for line in text.split("\n"):
        if line.startswith("|"):
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]]
            if all(c == "---" for c in cells):
                continue
            if not (out and isinstance(out[-1], list)):
                out.append([])
            out[-1].append(cells)
        elif line.strip():
            marks = len(line) - len(line.lstrip("#"))
            out.append((line.lstrip("# ").replace("**", ""), marks - 1 if marks else None))
        elif out and isinstance(out[-1], list):
            out.append(("", None))
    return [b for b in out if b != ("", None)]


def reports(markdown: DataFrame) -> DataFrame:
    """doc_id, content: Markdown reports (doc_id, report) as office documents, made on the executors."""
    ship(markdown.sparkSession)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [build(from_markdown(t)) for t in b["report"]]})

    return markdown.select("doc_id", "report").mapInPandas(run, "doc_id long, content binary")


def samples(lines: DataFrame) -> DataFrame:
    """doc_id, content: rendered lines (doc_id, pos, text, level) as office documents, one group per document."""
    ship(lines.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos")
        blocks = [(t, None if pd.isna(lv) else int(lv)) for t, lv in zip(rows["text"], rows["level"], strict=True)]
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "content": [build(blocks)]})

    return lines.groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")
