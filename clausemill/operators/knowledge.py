"""Questions against thresholds and passages: a structured match first, else token cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import text as T

#: A threshold answers from this score on: keyword characters found in the question.
LEAST_SCORE = 4
#: A threshold table beyond this many rows isn't broadcast.
BROADCAST_ROWS = 10_000
#: Term counts of more rows than this aren't broadcast.
BROADCAST_TERMS = 500_000
TOP = 5
# The answer where nothing was found, and the last line of an answer from passages.
NOTHING = "知识库未命中相关条文（当前库为深基坑示例子集）。"
CLOSING = "（整理自公开文件，条目状态：待核对——引用前请以官方现行文本为准）"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term_counts(texts: DataFrame, key: str, text: Column, together: bool = False) -> DataFrame:
    """``key``, token, n: term frequencies. ``together``: texts are shuffled once by key, and what follows by key needs no shuffle."""
    rows = texts.select(key, F.coalesce(text, F.lit("")).alias("_t"))
    if together:  # a stated number, as small texts would be put into few partitions
        rows = rows.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.select(key, F.explode(T.tokens(F.col("_t"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def cosine(queries: DataFrame, blocks: DataFrame, query: str = "query_id", block: str = "block_id") -> DataFrame:
    """Cosine of every (query, block) with a token in common; both are term counts.

    Sums are whole numbers, so they don't depend on the order. A side of at most ``BROADCAST_TERMS`` terms is broadcast; if
    the other one is kept ``together`` (:func:`term_counts`), its rows are scored where they are, and no pair is shuffled.
    """
    square = lambda df, key, name: df.withColumn(name, F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    q, b = square(queries, query, "qq").withColumnRenamed("n", "qn"), square(blocks, block, "bb").withColumnRenamed("n", "bn")
    if queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        q = F.broadcast(q)
    elif blocks.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        b = F.broadcast(b)
    dot = q.join(b, "token").groupBy(query, block).agg(F.sum(F.col("qn") * F.col("bn")).alias("dot"), F.first("qq").alias("qq"), F.first("bb").alias("bb"))
    return dot.select(query, block, (F.col("dot") / (F.sqrt("qq") * F.sqrt("bb"))).alias("score"))


def top(scored: DataFrame, k: int = TOP, query: str = "query_id", order: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """The ``k`` best of each query, ties by ``order``, with their rank."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(questions: DataFrame, blocks: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, score and the passage's columns. ``blocks`` has block_id, doc, article_no, text, tags.

    Many questions meet few passages: passages are broadcast up to ``BROADCAST_ROWS``.
    """
    text = F.concat_ws(" ", "text", F.array_join("tags", " "))
    scored = cosine(term_counts(questions, "query_id", F.col("question"), together=True), term_counts(blocks, "block_id", text))
    return top(scored.join(_small(blocks), "block_id"), k, "query_id", ("doc", "article_no", "block_id"))


def keyword_score(keywords: Column, question: Column) -> Column:
    """Characters of the keywords that stand in the question; empty keywords don't."""
    return F.aggregate(F.filter(keywords, lambda k: (k != "") & F.contains(question, k)), F.lit(0), lambda a, k: a + F.length(k))


def match_threshold(questions: DataFrame, thresholds: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """The best threshold of each question that has one: the highest score, then the first in order."""
    scored = questions.crossJoin(_small(thresholds)).withColumn("score", keyword_score(F.col("keywords"), F.col("question")))
    best = scored.where(F.col("score") >= least).groupBy("query_id").agg(F.max_by(F.struct(*thresholds.columns, "score"), F.struct(F.col("score"), -F.col("pos"))).alias("hit"))
    return best.select("query_id", "hit.*")


def value_text(value: Column) -> Column:
    """A threshold's value as written: lists joined, whole numbers without a fraction."""
    raw = F.to_json(value)
    listed = F.from_json(raw, "array<string>")
    plain = F.regexp_replace(F.regexp_replace(raw, r"^\"|\"$", ""), r"^(-?[0-9]+)\.0$", "$1")
    return F.when(F.startswith(raw, F.lit("[")), F.array_join(listed, "～")).otherwise(plain)


def block_text(doc: Column, chapter: Column, article: Column, status: Column, text: Column) -> Column:
    """A passage with its source; a status that the article names already isn't repeated."""
    a = F.trim(F.coalesce(article, F.lit("")))
    art = F.when(a.rlike("^[0-9]"), F.concat(F.lit("第"), a, F.lit("条"))).otherwise(a)
    s = F.coalesce(status, F.lit(""))
    shown = F.when((s == "") | F.contains(art, s), "").otherwise(F.concat(F.lit("（"), s, F.lit("）")))
    return F.concat(F.lit("《"), doc, F.lit("》"), chapter, F.lit(" "), art, shown, F.lit("："), text)


def ask(questions: DataFrame, thresholds: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """query_id, route (threshold, blocks or empty), answer and sources of every question."""
    hit = match_threshold(questions, thresholds)
    plain = ~F.col("op").isin("info", "enum")
    said = F.concat(
        F.lit("【阈值表命中·"), F.col("status"), F.lit("】"), F.col("name"), F.lit("："), F.when(plain & (F.col("op") != ""), "要求 ").otherwise(""),
        F.when(F.col("op") == "info", "要求：").when(F.col("op") == "enum", "允许取值：").otherwise(""), value_text(F.col("value")), F.col("unit"), F.col("condition"),
        F.lit("。\n依据："), F.col("doc"), F.lit(" "), F.col("article_no"), F.lit("\n"), F.col("basis"),
    )
    source = F.struct(F.col("doc"), F.lit(None).cast("string").alias("chapter"), F.col("article_no"), F.col("status"))
    answered = hit.select("query_id", said.alias("t_answer"), F.array(source).alias("t_sources"))
    rest = questions.join(answered.select("query_id"), "query_id", "left_anti")
    found = search(rest, blocks, k)
    line = F.concat(F.lit("- "), block_text(F.col("doc"), F.col("chapter"), F.col("article_no"), F.col("status"), F.col("text")), F.lit("（相关度 "), F.format_string("%.2f", "score"), F.lit("）"))
    of = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.struct("doc", "chapter", "article_no", "status").alias("source")))).alias("r"))
    lines = F.concat(F.lit("【条文检索 top-"), F.size("r").cast("string"), F.lit("】\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n" + CLOSING))
    passages = of.select("query_id", lines.alias("b_answer"), F.transform("r", lambda x: x["source"]).alias("b_sources"))
    out = questions.join(answered, "query_id", "left").join(passages, "query_id", "left")
    route = F.when(F.col("t_answer").isNotNull(), "threshold").when(F.col("b_answer").isNotNull(), "blocks").otherwise("empty")
    none = F.array().cast("array<struct<doc:string,chapter:string,article_no:string,status:string>>")
    return out.select("query_id", route.alias("route"), F.coalesce("t_answer", "b_answer", F.lit(NOTHING)).alias("answer"), F.coalesce("t_sources", "b_sources", none).alias("sources"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
