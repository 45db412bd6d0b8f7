"""Completions of an OpenAI-compatible server, off unless it is configured.

Prompts are sent by the executors, one at a time for each partition; an answer that can't be had is null
and its error is kept, so a document never fails for the model's sake.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from clausemill.workers import ship

#: These say that asking again won't help.
FINAL = (400, 401, 403, 404)


def load_env(path: str | Path) -> list[str]:
    """Put the KEY=VALUE lines of a file into the environment; what is set already stays. Returns the keys that were set."""
    if not Path(path).is_file():
        return []
    pairs = [x.strip().partition("=") for x in Path(path).read_text("utf-8").splitlines() if "=" in x and not x.strip().startswith("#")]
    new = {k.strip(): v.strip().strip("\"").strip("'") for k, _, v in reversed(pairs) if k.strip() and k.strip() not in os.environ}
    os.environ.update(new)
    return list(new)


@dataclass(frozen=True)
class Model:
    base_url: str
    api_key: str
    model: str
    timeout: float = 60
    retries: int = 2
    max_tokens: int = 2000
    temperature: float = 0.1

    @staticmethod
    def from_env(path: str | Path = ".env") -> Model | None:
        """From LLM_BASE_URL, LLM_API_KEY and LLM_MODEL (LLM_TIMEOUT, LLM_MAX_RETRIES) of the environment or a file; None if one is missing."""
        load_env(path)
        found = [os.environ.get(k, "") for k in ("LLM_BASE_URL", "LLM_API_KEY", "LLM_MODEL")]
        return Model(*found, float(os.environ.get("LLM_TIMEOUT", "60")), int(os.environ.get("LLM_MAX_RETRIES", "2"))) if all(found) else None

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        request = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        )
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    text = json.load(r)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code in FINAL or k == self.retries:
                    raise
            except OSError:
                if k == self.retries:
                    raise
            else:
                if not text:
                    raise ValueError("empty answer")
                return text
            time.sleep(2**k)
        raise AssertionError


def complete(prompts: DataFrame, model: Model) -> DataFrame:
    """doc_id, answer, error for ``prompts`` (doc_id, prompt)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append((model.complete(p), None))
                except (OSError, ValueError, KeyError) as e:
                    out.append((None, str(e)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "answer": [a for a, _ in out], "error": [e for _, e in out]})

    ship(prompts.sparkSession)
    return prompts.select("doc_id", "prompt").mapInPandas(run, "doc_id long, answer string, error string")
