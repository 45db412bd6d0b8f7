"""Command line: info, demo, rules, parse, check, ask, scan, benchmark.

Exit codes: 0 nothing fails, 1 something does, 2 wrong use, 3 the input can't be read.
"""

from __future__ import annotations

import argparse
import subprocess
import sys
from collections import Counter
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

import clausemill
from clausemill.operators import extract, knowledge as K, report, rules as R, scan, segment
from clausemill.plans import benchmark, review as V
from clausemill.sources import files, model, tables


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("clausemill").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw lines and documents (doc_id, name) of office files, page extracts (.json) or plain texts under ``path``."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        lines = files.pages(spark, path)
    elif kind in ("txt", "md"):
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.posexplode(F.split("value", "\n")).alias("pos", "text"))
        lines = text.withColumns({"page": F.lit(None).cast("int"), "level": F.lit(None).cast("int")})
    else:
        lines = files.documents(spark, path)
    lines = lines.withColumn("doc_id", F.xxhash64("doc"))
    broken = lines.where("error is not null").select("doc", "error").collect() if "error" in lines.columns else []
    for r in broken:
        print(f"error: {r['doc']}: {r['error']}", file=sys.stderr)
    good = lines.where("error is null").drop("error") if broken or "error" in lines.columns else lines
    docs = good.select("doc_id", F.col("doc").alias("name")).distinct()
    if broken and not docs.limit(1).count():
        raise ValueError("no document could be read")
    return good.drop("doc"), docs


def _rules(spark: SparkSession, folder: str | None) -> DataFrame:
    return R.validated(files.rules(spark, folder) if folder else tables.rules(spark))


def _inventory(rows: Sequence) -> str:
    """Rules by category, the largest first."""
    names = {"deep_pit": "深基坑", "formwork_support": "高支模"}
    n = Counter(r["category"] for r in rows)
    return " + ".join(f"{names.get(k, k)} {n[k]}" for k in sorted(n, key=lambda k: (-n[k], k))) + f" = {len(rows)} 条"


def info(args) -> int:
    print(f"clausemill {clausemill.__version__}: {len(tables.RULES)} rules, {len(tables.NUMERIC) + len(tables.TEXTUAL)} parameters")
    print(f"规则库 {_inventory([{'category': r.category} for r in tables.RULES])}; {len(tables.THRESHOLDS)} thresholds, {sum(map(len, tables.BLOCKS.values()))} passages")
    return 0


# The cards of the demonstration.
DEMO = (
    ("dp.excavation_depth", "基坑开挖深度", 5.4, "m", "三、施工工艺技术/3.2 基坑开挖", "基坑开挖深度为5.4m，采用放坡+土钉墙支护。"),
    ("dp.retaining.displacement", "支护结构顶部水平位移控制值", 35.0, "mm", "六、施工安全保证措施/6.3 监测方案", "支护结构顶部水平位移控制值为35mm。"),
    ("dp.monitoring.frequency", "基坑监测频率（开挖至底板期间）", 0.5, "次/d", "六、施工安全保证措施/6.3 监测方案", "开挖至坑底期间，监测频率为0.5次/d。"),
)


def demo(args) -> int:
    spark = _session()
    rows = [(1, i, p, name, v, unit, None, (section, line)) for i, (p, name, v, unit, section, line) in enumerate(DEMO)]
    cards = spark.createDataFrame(rows, "doc_id long, ord int, param_id string, name string, value double, unit string, text_value string, evidence struct<section:string,line_text:string>")
    docs, all_rules = cards.select("doc_id").distinct(), tables.rules(spark)
    code = _show(docs, R.findings(cards, all_rules, docs), cards)
    left = [r["rule_id"] for r in R.skipped(cards, all_rules, docs, False).orderBy("rule_id").collect()]
    print(f"\n注: 没有方案文档，{len(left)} 条规则未执行: {' '.join(left)}")
    return 0 if code in (0, 1) else code


def _show(docs: DataFrame, found: DataFrame, cards: DataFrame) -> int:
    failed = 0
    texts = report.console(docs, found, cards)
    if "name" in docs.columns:
        texts = texts.join(docs.select("doc_id", "name"), "doc_id").orderBy("name")
    for r in texts.toLocalIterator():  # printed one by one, never gathered
        failed |= r["n_fail"] > 0
        print(f"== {r['name'] if 'name' in docs.columns else r['doc_id']} ==\n{r['text']}")
    return int(failed)


def rules(args) -> int:
    spark = _session()
    rows = _rules(spark, args.rules_dir).orderBy("pos").collect()
    print(f"规则共 {len(rows)} 条（其中未启用 {sum(not r['enabled'] for r in rows)} 条）：")
    for r in rows:
        print(f"  {r['id']:<9} {r['name']:<26} {r['check_type']:<18} {r['basis']}{'' if r['enabled'] else '（未启用，' + (r['stage'] or '后续') + ' 起）'}")
    if args.rules_dir and args.on:
        for r in R.overdue(files.rule_bases(spark, args.rules_dir), args.on).orderBy("id").toLocalIterator():
            print(f"  overdue since {r['next_review']}: {r['id']}")
    return 0


def parse(args) -> int:
    spark = _session()
    raw, docs = _raw(spark, args.path)
    parsed = segment.parse(raw)
    lines = parsed.drop("level")
    out = report.parsed_json(docs, lines, segment.sections(parsed), extract.cards(lines), extract.discarded(lines)).join(docs, "doc_id").orderBy("name")
    if args.out:
        out.select(F.col("parsed").alias("value")).write.mode("overwrite").text(args.out)
    else:
        for r in out.toLocalIterator():
            print(r["parsed"])
    return 0


def check(args) -> int:
    spark = _session()
    raw, docs = _raw(spark, args.path)
    if args.llm:
        m = model.Model.from_env(args.env)
        r, states = V.with_model(raw, _rules(spark, args.rules_dir), docs, None if m is None else lambda p: model.complete(p, m))
        for s in states.join(docs, "doc_id").orderBy("name").toLocalIterator():
            print(f"model: {s['name']}: {s['state']} {s['detail']}".rstrip(), file=sys.stderr)
    else:
        r = V.review(raw, _rules(spark, args.rules_dir), docs)
    if args.report_dir:
        when = args.when or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
        r.markdown(when).join(docs.select("doc_id"), "doc_id").join(docs.withColumnRenamed("name", "file"), "doc_id").select(F.col("file").alias("name"), "report").write.mode("overwrite").parquet(f"{args.report_dir}/markdown")
        r.json().join(docs, "doc_id").select("name", "review").write.mode("overwrite").json(f"{args.report_dir}/json")
    return _show(docs, r.findings, r.cards)


def ask(args) -> int:
    if not args.question.strip():
        return 2
    spark = _session()
    q = spark.createDataFrame([(1, args.question)], "query_id int, question string")
    folder = args.knowledge_dir
    known = (files.thresholds(spark, f"{folder}/thresholds"), files.blocks(spark, f"{folder}/blocks")) if folder else (tables.thresholds(spark), tables.blocks(spark))
    a = K.ask(q, *known, args.top).first()
    print(a["answer"])
    for s in a["sources"]:
        print("-", s["doc"], s["article_no"], s["status"])
    return 0


def scan_(args) -> int:
    """Files of a folder, or of a git work tree: what it tracks, or the addresses of its commits; or the self-test."""
    spark = _session()
    if args.mode == "selftest":
        wrong = scan.self_test(spark).collect()
        for r in wrong:
            print(f"sample {r['sample']}: {r['kind']} {'missed' if r['expected'] else 'found'}")
        return int(bool(wrong))
    if args.mode == "metadata":
        found = scan.commit_hits(files.commits(spark, args.path)).distinct().orderBy("role", "address")
        for r in found.toLocalIterator():
            print(f"{r['role']}: {r['address']}")
        return scan.gate(found)
    if args.mode == "tracked":
        texts = files.tracked(spark, args.path)
    else:
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.path)
        office = texts.where(F.lower("path").rlike(r"\.(docx|xlsx|pptx)$")).limit(1).count()
        texts = texts.where(~scan.is_binary(F.col("content"))).select(F.col("path").alias("label"), F.decode("content", "UTF-8").alias("text"))
        texts = texts.union(files.zip_entries(spark, args.path)) if office else texts
    found = scan.hits(texts, "label").orderBy("label", "lineno", "n")
    for r in found.toLocalIterator():
        print(f"{r['label']}:{r['lineno']}: {r['kind']}")
    return scan.gate(found)


def benchmark_(args) -> int:
    spark = _session()
    result = benchmark.run(spark, benchmark.labelled(spark, args.truth) if args.truth else benchmark.generated(spark))
    print(benchmark.table(result))
    if args.out:
        benchmark.write(result, args.out)
    return benchmark.exit_code(result)


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="clausemill", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("info").set_defaults(run=info)
    verbs.add_parser("demo").set_defaults(run=demo)
    for name, run in (("rules", rules), ("parse", parse), ("check", check)):
        v = verbs.add_parser(name)
        v.set_defaults(run=run)
        if name != "rules":
            v.add_argument("path")
        if name != "parse":
            v.add_argument("--rules-dir")
        if name == "parse":
            v.add_argument("--out")
        if name == "rules":
            v.add_argument("--on", help="a date: list the rules whose basis is due for review")
        if name == "check":
            v.add_argument("--report-dir")
            v.add_argument("--when", default="", help="time that reports state; default: now")
            v.add_argument("--llm", action="store_true", help="let a configured model fill missing parameters")
            v.add_argument("--env", default=".env")
    v = verbs.add_parser("ask")
    v.set_defaults(run=ask)
    v.add_argument("question")
    v.add_argument("--knowledge-dir")
    v.add_argument("--top", type=int, default=3)
    v = verbs.add_parser("scan")
    v.set_defaults(run=scan_)
    v.add_argument("path", nargs="?", default=".")
    v.add_argument("--mode", choices=("files", "tracked", "metadata", "selftest"), default="files")
    v = verbs.add_parser("benchmark")
    v.set_defaults(run=benchmark_)
    v.add_argument("--truth")
    v.add_argument("--out")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return args.run(args)
    except (PySparkException, subprocess.CalledProcessError, OSError, ValueError) as e:
        print(f"error: {e}".split("\n")[0], file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
