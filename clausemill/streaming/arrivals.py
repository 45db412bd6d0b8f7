"""Reviews of documents as they arrive.

A document is reviewed by itself, so every micro-batch runs the same plan as a corpus does, and
the checkpoint takes the place of a log of finished documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clausemill.plans.review import of_texts


def review_stream(docs: DataFrame, rules: DataFrame, out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Review a stream of (doc_id, text); findings go to ``out`` as Parquet, a folder per batch, so a batch that runs twice writes once."""

    def write(batch: DataFrame, number: int) -> None:
        r = of_texts(batch, rules, text)
        r.findings.drop("n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return start(docs, write, checkpoint)


def start(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that has arrived, then stop; started again, it goes on where it was."""
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
