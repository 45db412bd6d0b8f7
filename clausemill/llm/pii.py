"""Personal data, and the terms around it that give it away.

Base spans (email, ip, card, phone) come from patterns within the row. Then corpus
co-occurrence tells how strongly a term reveals a protected value: with n(e) documents
naming value e, n(t) having term t, n(e,t) having both, of N documents, the term
discloses PMI(e;t) = log2(n(e,t) N / (n(e) n(t))) of the log2(N / n(e)) bits that e is worth. Terms
that disclose at least the share ``DISCLOSURE`` and are in ``SUPPORT`` documents with e
are spans of kind "term", wherever they stand in these, and are generalised with the base spans.
A document is an id and a text, so copies under other ids count as documents of their own. A term in one
document only has no association to count: every word found nowhere else would disclose all values
beside it (``support`` = 1 does that).

All of it is DataFrame code. One pass keeps a narrow table (ids, spans, and the terms of documents with
spans). As n(e,t) <= n(e), a term of e has n(t) <= n(e)^share N^(1 - share): pairs are formed of the few
values and terms within this bound only, and only candidate terms are counted over all texts in a
second pass. They are broadcast if there are at most ``BROADCAST_TERMS``, and joined by a shuffle of
pre-aggregated counts beyond that.

Defined cases: a null text is an empty one and has no spans; rows with the same id and the
same text get the same spans; a null id is an id like any other; a value in all documents is
worth nothing and discloses nothing; a very long text is matched whole; a term that discloses just the share is one; spans that
overlap are generalised together, named by the first; extra columns are left out, ``sanitise`` keeps them; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.functions.text import located
from clausemill.llm import common

#: The kinds in order, and their patterns. Possessive quantifiers and the
#: look-behinds change no match; they keep long runs linear and the stack flat.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without one of these has no base span.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}_]+"
DISCLOSURE, SUPPORT, LEAST_TERM = 0.9, 2, 3
BROADCAST_TERMS = 100_000
#: Term spans (one row each) up to which the documents that have them are broadcast.
BROADCAST_SPANS = 200_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0)
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
_VALUE = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, value), by kind as listed, then start."""
    none = F.array().cast("array<struct<kind:string,s:bigint,e:bigint,value:string>>")

    def of(kind: str) -> Column:
        valid = F.filter(located(text, PATTERNS[kind]), lambda x: _VALID[kind](x["m"]))
        spans = F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _VALUE[kind](x["m"]).alias("value")))
        return F.when(text.rlike(HINT[kind]), spans).otherwise(none)

    return F.concat(*map(of, KINDS))


def beside(text: Column, spans: Column) -> Column:
    """Array of (term, s, e): the words of the text that touch no span."""
    words = F.transform(located(text, TERM), lambda w: F.struct(F.lower(w["m"]).alias("term"), w["s"].alias("s"), w["e"].alias("e")))
    fits = lambda w: (F.length(w["term"]) >= LEAST_TERM) & w["term"].rlike(r"\p{L}")
    return F.filter(words, lambda w: fits(w) & ~F.exists(spans, lambda x: (w["s"] < x["e"]) & (x["s"] < w["e"])))


def found(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, hash of the text, base spans and the terms beside them: one row per document, narrow without spans; with ``row`` all columns too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = "array<struct<term:string,s:bigint,e:bigint>>"
    kept = [F.struct(*docs.columns).alias("_row")] if row else []
    some = docs.select(F.col("doc_id"), F.xxhash64(text).alias("h"), text.alias("_t"), base_spans(text).alias("base"), *kept)
    terms = F.when(F.size("base") > 0, beside(F.col("_t"), F.col("base"))).otherwise(F.array().cast(none)).alias("beside")
    return some.select("doc_id", "h", "base", terms, *(["_row"] if row else []))


def _values(narrow: DataFrame) -> DataFrame:
    """doc_id, h and value: each document and the values it names."""
    return narrow.where(F.size("base") > 0).select("doc_id", "h", F.explode("base").alias("x")).select("doc_id", "h", F.col("x.value").alias("value")).distinct()


def _of(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by document."""
    named = right.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    return left.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), how).drop("_id", "_h")


def disclosing(narrow: DataFrame, docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(value, term) pairs whose term discloses the value, of the table :func:`found`."""
    total = float(max(docs.count(), 1))
    n_e = common.keep(_values(narrow).groupBy("value").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total)), "values")
    most = n_e.agg(F.max("n_e")).first()[0]
    if most is None:
        return n_e.select("value", F.col("value").alias("term"))
    # A little above the exact bound, as it is only a first cut.
    bound = lambda n: F.pow(n, F.lit(share)) * (total ** (1 - share) * (1 + 1e-9))
    worth = F.log2(F.lit(total) / F.col("n_e"))
    told = lambda n_t: F.log2(F.col("n_et") * total / (F.col("n_e") * n_t))

    named = common.keep(_values(narrow).join(n_e, "value"), "named")
    has = _of(narrow, named.select("doc_id", "h").distinct(), "left_semi").select("doc_id", "h", F.explode(F.array_distinct("beside.term")).alias("term"))
    words = common.keep(has.distinct(), "words")
    seen = common.keep(words.groupBy("term").agg(F.count("*").alias("seen")), "seen")
    fits = (F.col("seen") >= support) & (F.col("seen") <= bound(F.lit(float(most))))
    # Terms that one in some hundred documents has are few, and go before they meet in a task.
    often = seen.where(~fits & (F.col("seen") >= max(support, 100, words.select("doc_id", "h").distinct().count() // 200))).select("term")
    some = words.join(F.broadcast(often), "term", "left_anti").join(seen.where(fits), "term")
    pairs = _of(some, named, "inner").where(F.col("seen") <= bound(F.col("n_e"))).groupBy("value", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("seen").alias("seen"))
    likely = common.keep(pairs.where((F.col("n_et") >= support) & (told(F.col("seen")) >= share * worth)), "terms")
    terms = likely.select("term").distinct()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("term"))
    if likely.limit(1).count() == 0:
        n_t = terms.select("term", F.lit(1).cast("long").alias("n_t"))
    elif terms.count() <= BROADCAST_TERMS:
        n_t = words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        n_t = words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")
    return likely.join(n_t, "term", "left").where(told(F.greatest("n_t", "seen")) >= share * worth).select("value", "term")


def spans(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, h (hash of the text), base and terms (sorted arrays of spans) for every document."""
    narrow = common.keep(found(docs.select("doc_id", "text")), "pii")
    out = _of(narrow, told_spans(narrow, docs, share, support), "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return out.select("doc_id", "h", "base", F.coalesce("terms", none).alias("terms"))


def told_spans(narrow: DataFrame, docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, h and terms of the documents that have term spans, of the table :func:`found`."""
    pairs = common.keep(disclosing(narrow, docs, share, support), "disclosing")
    told = common.keep(_values(narrow).join(pairs, "value").select("doc_id", "h", "term").distinct(), "told")
    words = _of(narrow.select("doc_id", "h", "beside"), told.select("doc_id", "h").distinct(), "left_semi").select("doc_id", "h", F.explode("beside").alias("x")).select("doc_id", "h", "x.*")
    hits = _of(words, told.withColumnRenamed("term", "_term"), "inner").where("term = _term")
    return hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("terms"))


def digest(found_: DataFrame) -> DataFrame:
    said = lambda kind, x: F.concat_ws(":", kind, x["s"], x["e"])
    base = F.array_join(F.transform("base", lambda x: said(x["kind"], x)), ",")
    every = F.array_join(F.concat(F.transform("base", lambda x: said(x["kind"], x)), F.transform("terms", lambda x: said(F.lit("term"), x))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found_.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def replaced(text: Column, base: Column, terms: Column) -> Column:
    """The text with every span generalised to its kind, e.g. [EMAIL]; overlapping spans go together, named by the first."""
    spans_ = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.upper(x["kind"]).alias("k"))),
        F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("TERM").alias("k"))),
    ))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.when(
        x["s"] >= a["at"],
        F.struct(F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.lit("["), x["k"], F.lit("]")).alias("out"), x["e"].alias("at")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at")))
    return F.aggregate(spans_, start, step, lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text))))


def sanitise(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents with all spans generalised in the text, all columns kept.

    Texts are matched once: a table holds each row with its base spans, and only the rare rows with term spans meet a
    join. They are broadcast up to ``BROADCAST_SPANS`` spans, so that no text is shuffled; beyond that Spark splits a hot
    id in the sort-merge join.
    """
    marked = common.keep(found(docs, row=True), "pii")
    terms = told_spans(marked, docs.select("doc_id", "text"), share, support)
    hits = common.keep(terms.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "terms").distinct(), "term-spans")
    if (hits.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    joined = marked.drop("beside").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    every = F.coalesce("terms", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    text = F.col("_row.text")
    clean = F.when(F.size("base") + F.size(every) > 0, replaced(text, F.col("base"), every)).otherwise(text)
    return joined.select(F.col("_row").withField("text", clean).alias("_row")).select("_row.*").select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(common.read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
