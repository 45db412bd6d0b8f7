"""The review of a corpus as one lazy plan: lines, sections, cards, findings, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.operators import extract, gapfill, report, rules as R, segment
from clausemill.sources.tables import NUMERIC, TEXTUAL, Numeric, Textual


@dataclass(frozen=True)
class Review:
    """The relations of a review; each is a plan until something is asked of it."""

    docs: DataFrame
    lines: DataFrame
    sections: DataFrame
    cards: DataFrame
    discarded: DataFrame
    findings: DataFrame
    rules: DataFrame

    def summary(self) -> DataFrame:
        return R.summary(self.findings, self.docs)

    def missing(self) -> DataFrame:
        return R.missing_params(self.cards, self.rules, self.docs, self.lines)

    def markdown(self, when: str = "") -> DataFrame:
        return report.markdown(self.docs, self.findings, self.cards, self.discarded, self.rules.count(), when)

    def json(self) -> DataFrame:
        return report.review_json(self.docs, self.findings, self.cards)


def review(raw: DataFrame, rules: DataFrame, docs: DataFrame | None = None, params: Sequence[Numeric] = NUMERIC, texts: Sequence[Textual] = TEXTUAL, proposals: DataFrame | None = None) -> Review:
    """Raw lines (doc_id, pos, text and maybe level and page) to a review.

    ``docs`` names the documents, so that one without lines is reviewed too. ``proposals`` are a model's
    items (see :mod:`clausemill.operators.gapfill`); the valid ones fill parameters that are missing.
    """
    docs = raw.select("doc_id").distinct() if docs is None else docs
    parsed = segment.parse(raw)
    sections = segment.sections(parsed)
    lines = parsed.drop("level")
    cards = extract.cards(lines, params, texts)
    if proposals is not None:
        missing = R.missing_params(cards, rules, docs, lines)
        valid = gapfill.accept(gapfill.validate(proposals, missing, gapfill.candidates(lines, missing, params), params, texts))
        cards = cards.unionByName(gapfill.cards(valid, lines, params, texts))
    found = R.findings(cards, rules, docs, lines, sections)
    return Review(docs, lines, sections, cards, extract.discarded(lines, params), found, rules)


def with_model(raw: DataFrame, rules: DataFrame, docs: DataFrame, complete: Callable[[DataFrame], DataFrame] | None, keep: Callable[[DataFrame], DataFrame] = lambda df: df.cache()) -> tuple[Review, DataFrame]:
    """A review in which a model fills missing parameters, and what became of it: doc_id, state, detail.

    ``complete`` takes (doc_id, prompt) to (doc_id, answer, error); None: no model. Whatever fails leaves a document to the
    rules alone, with the reason. Answers cost money, so they are kept before they are read twice.
    """
    plain = review(raw, rules, docs)
    known = [*[p.id for p in NUMERIC], *[p.id for p in TEXTUAL]]
    missing = plain.missing().where(F.col("param").isin(known))
    if complete is None:
        return plain, docs.select("doc_id", F.lit("off").alias("state"), F.lit("no model is configured").alias("detail"))
    offered = gapfill.candidates(plain.lines, missing)
    answers = keep(complete(gapfill.prompts(offered, missing, names=docs if "name" in docs.columns else None)))
    done = review(raw, rules, docs, proposals=gapfill.parse_answers(answers))
    state = F.when(F.col("error").isNotNull(), "degraded").when(F.col("answer").isNotNull(), "asked").otherwise("complete")
    return done, docs.select("doc_id").join(answers, "doc_id", "left").select("doc_id", state.alias("state"), F.coalesce("error", F.lit("")).alias("detail"))


def of_texts(docs: DataFrame, rules: DataFrame, text: str = "text", by: Column | None = None) -> Review:
    """The review of whole texts."""
    return review(segment.raw_lines(docs, text, by), rules, docs.select("doc_id").distinct())


def exit_code(r: Review) -> int:
    """1 if anything fails, else 0."""
    return int(r.findings.where(F.col("result") == "fail").limit(1).count() > 0)
