"""The pipeline's stages against brute force on a small folder of tables, and the catalogue."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from clausemill.llm import catalog, common, decontaminate, mixing
from test_contracts import components, fingerprint, private, size_of


@pytest.fixture(scope="module")
def folder(spark, unique, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    more = [(700, "write to jo@ex.org or 10.0.0.1 about it please today", "a", "s1"), (701, "12 34 !!", None, "s2"), (702, "card 4111 1111 1111 1111 ends here now", "b", "s2")]
    docs = unique.union(spark.createDataFrame(more, unique.schema)).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[20][1].split()[:25])), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = common.read(spark, folder, "documents")
    columns, letters = docs.columns, re.compile(r"[^\W\d_]")
    state = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = common.keep(stage(spark, docs, folder), "stage")
        got = out.collect()
        ids = sorted(r["doc_id"] for r in got)
        if name == "language_id":
            assert ids == sorted(i for i, r in state.items() if r["text"] and letters.search(r["text"]))
        elif name == "near_duplicates":
            of = components({i: fingerprint(r["text"]) for i, r in state.items()}, 3)
            assert ids == sorted(set(of.values()))
        elif name == "benchmark_decontamination":
            item = decontaminate.words(common.read(spark, folder, "benchmark").where("item_id = 1").first()["text"])
            windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
            hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [decontaminate.words(t)] for i in range(len(w) - 9))
            assert ids == sorted(i for i, r in state.items() if not hit(r["text"])) and len(ids) < len(state)
        elif name == "personal_data":
            assert ids == sorted(state) and not any(private(r["text"]) for r in got) and any("[EMAIL]" in r["text"] for r in got)
            assert all(r["text"] == state[r["doc_id"]]["text"] for r in got if not private(state[r["doc_id"]]["text"]) and "[TERM]" not in r["text"])
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.select("doc_id", "text", "source")).collect()}
            assert {i: ids.count(i) for i in state} == copies
            assert all(size_of(r["text"]) == size_of(state[r["doc_id"]]["text"]) for r in got)
        assert out.columns == columns
        docs, state = out, {r["doc_id"]: r for r in got}


def test_stages_odd_rows(spark, docs, rows, folder):
    """Ids that repeat or are missing, repeated rows, clashing columns, a very long text, an empty table: nothing crashes, columns stay."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    more = spark.createDataFrame([(800, long, "a", "s1"), (800, long, "a", "s1"), (None, "a text without an id", "a", None)], "doc_id long, text string, lang string, source string")
    now = docs.unionByName(more, allowMissingColumns=True).withColumn("n_chars", F.length("text"))
    extra = [c for c in now.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        out = common.keep(stage(spark, now, folder), "stage")
        assert out.columns == now.columns and set(extra) < set(out.columns)
        assert stage(spark, now.where("false"), folder).count() == 0
        if name == "near_duplicates":
            assert out.where("text = '" + long[:20] + "' or length(text) > 100000").count() == 1
        now = out
    assert now.where("length(text) > 100000").count() >= 1 and now.where("doc_id is null").count() >= 1


def test_run(spark, folder):
    import os

    kept = f"{common.shared_dir(spark)}/clausemill"
    before = set(os.listdir(kept))
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(kept)) - before}
    assert left <= {"personal_data", "targets"}  # what the result reads
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "personal_data", "source_mix"]


def test_catalogue():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", k)[0] for k in catalog.QUERIES} and "pipeline" in names
    assert set(catalog.SQL) <= set(catalog.QUERIES)
