"""All queries of the corpus operators and their SQL."""

from clausemill.llm import decontaminate, katz, langid, licenses, mixing, pii, quality, simhash, substrings, toxicity

_MODULES = (licenses, toxicity, quality, langid, simhash, pii, mixing, substrings, decontaminate, katz)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
