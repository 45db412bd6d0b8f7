"""A small HTTP service over the review and the question router.

GET / (a page), /vendor/NAME (files beside it), /api/health; POST /api/review?name=plan.docx with the file as body; POST /api/ask with
{"query": ...}.
"""

from __future__ import annotations

import json
import mimetypes
import time
import zipfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

import clausemill
from clausemill.operators import knowledge as K
from clausemill.plans import review as V
from clausemill.sources import files, tables

#: Larger uploads are refused.
MOST_BYTES = 50 << 20


def review(spark: SparkSession, name: str, body: bytes, rules: DataFrame) -> dict:
    """The review of one uploaded file."""
    suffix = Path(name).suffix.lower()
    if suffix not in (".docx", ".pdf", ".txt"):
        raise ValueError(f"unknown format: {name}")
    stages, began = [], time.perf_counter()

    def stage(what: str) -> None:
        nonlocal began
        stages.append({"name": what, "seconds": round(time.perf_counter() - began, 4), "status": "ok"})
        began = time.perf_counter()

    if suffix == ".pdf":
        raw = spark.createDataFrame([(1, i, t, page) for i, (t, page, _) in enumerate(files.pdf_lines(body))], "doc_id long, pos int, text string, page int")
    elif suffix == ".txt":
        raw = spark.createDataFrame([(1, i, t) for i, t in enumerate(body.decode("utf-8").split("\n"))], "doc_id long, pos int, text string")
    else:
        rows = [(1, i, t, lv) for i, (t, lv) in enumerate(files.docx_lines(body))]
        raw = spark.createDataFrame(rows, "doc_id long, pos int, text string, level int")
    stage("parse")
    r = V.review(raw, rules, spark.createDataFrame([(1,)], "doc_id long"))
    stage("plan")
    out = json.loads(r.json().first()["review"])
    stage("review")
    gone = [row.asDict() for row in r.discarded.select("param", "value", "unit", "line", "reason").collect()]
    stage("discarded")
    return out | {"doc": name, "discarded": gone, "rules_total": rules.count(), "stages": stages}


def answer(spark: SparkSession, question: str, knowledge: str | None = None) -> dict:
    """The answer to a question, of a knowledge folder or the library's own entries."""
    if not question.strip():
        raise ValueError("问题为空")
    q = spark.createDataFrame([(1, question.strip())], "query_id int, question string")
    known = (files.thresholds(spark, f"{knowledge}/thresholds"), files.blocks(spark, f"{knowledge}/blocks")) if knowledge else (tables.thresholds(spark), tables.blocks(spark))
    a = K.ask(q, *known).first()
    return {"route": a["route"], "answer": a["answer"], "sources": [s.asDict() for s in a["sources"]]}


#: The page: a form for each service, without any file from elsewhere.
PAGE = """<!doctype html><meta charset="utf-8"><title>clausemill</title><h1>clausemill</h1>
<p><input type="file" id="f"><button onclick="review()">审查</button></p><p><input id="q" size="60"><button onclick="ask()">问答</button></p><pre id="o"></pre>
<script>
const show = async r => o.textContent = JSON.stringify(await (await r).json(), null, 1);
const review = () => show(fetch('/api/review?name=' + encodeURIComponent(f.files[0].name), {method: 'POST', body: f.files[0]}));
const ask = () => show(fetch('/api/ask', {method: 'POST', body: JSON.stringify({query: q.value})}));
</script>"""


def server(spark: SparkSession, port: int = 8000, rules: DataFrame | None = None, knowledge: str | None = None, vendor: str | None = None) -> ThreadingHTTPServer:
    """The service, not yet started; requests run side by side as Spark jobs. ``vendor``: the folder of files for the page."""
    rules = tables.rules(spark) if rules is None else rules

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, value: dict | bytes, kind: str = "application/json; charset=utf-8") -> None:
            body = value if isinstance(value, bytes) else json.dumps(value, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do(self, work: Callable[[], dict]) -> None:
            try:
                self.reply(200, work())
            except (ValueError, KeyError, AttributeError, OSError, RuntimeError, zipfile.BadZipFile, PySparkException) as e:
                self.reply(400, {"error": str(e).split("\n")[0]})

        def do_GET(self) -> None:  # noqa: N802
            path = urlparse(self.path).path
            name = unquote(path.removeprefix("/vendor/"))
            if path == "/api/health":
                self.reply(200, {"status": "ok", "version": clausemill.__version__})
            elif path == "/":
                self.reply(200, PAGE.encode(), "text/html; charset=utf-8")
            elif path.startswith("/vendor/") and vendor and "/" not in name and name not in ("", "..") and (Path(vendor) / name).is_file():
                self.reply(200, (Path(vendor) / name).read_bytes(), mimetypes.guess_type(name)[0] or "application/octet-stream")
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            url, size = urlparse(self.path), int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                self.reply(413, {"error": "too large"})
                return
            body = self.rfile.read(size)
            if url.path == "/api/review":
                self.do(lambda: review(spark, parse_qs(url.query).get("name", [""])[0], body, rules))
            elif url.path == "/api/ask":
                self.do(lambda: answer(spark, str((json.loads(body or b"{}") or {}).get("query", "")), knowledge))
            else:
                self.reply(404, {"error": "not found"})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
