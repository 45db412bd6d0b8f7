"""Licence scans by sentence rules.

Sentences are normalised, known licence sentences become identifiers, and the sequence of
identifiers of a document is matched against ordered licence rules. A document is handled
within its row: no shuffle, no join, no Python.

A piece between two ends (line end, or . ! ? ; : before a blank) that is a known sentence is one. Notices
are wrapped and hold such marks themselves, so pieces parted by a single line end, by ; or : or by the
point of "v." also make up a sentence together, where the first of them isn't one; a full stop or an empty
line always ends it. The SQL has single pieces only, of these those with a
word of ``HINT``, and no SPDX rule.

Defined cases: a null or empty text has no sentences and no licence; a sentence repeated in
a text counts each time; of patterns that fit a sentence, and of rules that fit a place, the first listed is taken; a very long text
is scanned whole; rows are never merged, so repeated rows give repeated results; other columns stay, those with the results'
names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.llm import common

#: Normalised licence sentences (pattern, whole sentence) and their identifiers.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("MITref", r"(this (software|work|project|code|file) is )?(released|licensed|distributed) under the (terms of the )?mit (license|licence)"),
    ("MITgrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("MITnotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ASIS", r"(the|this) software is provided (by .* )?as is (without|and any) .*"),
    ("Apache2ref", r"(this (software|work|project|code|file) is )?(licensed|released|distributed) under the (terms of the )?apache (license|licence)( version)? 2 ?0( the license)?"),
    ("ApacheUse", r"you may not use this file except in compliance with the (license|licence)"),
    ("ApacheCopy", r"you may obtain a copy of the (license|licence) at .*"),
    ("ApacheLimit", r"unless required by applicable law or agreed to in writing .*"),
    ("GPL3ref", r"(this (software|work|project|program|code|file) is )?(licensed|released|distributed) under (the terms of )?the gnu general public (license|licence)( version)? 3( 0)?( or later| or any later version)?"),
    ("GPL2ref", r"(this (software|work|project|program|code|file) is )?(licensed|released|distributed) under (the terms of )?the gnu general public (license|licence)( version)? 2( 0)?( or later| or any later version)?"),
    ("GPLfree", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public (license|licence) .*"),
    ("GPLnowarranty", r"this program is distributed in the hope that it will be useful but without any warranty .*"),
    ("GPLreceived", r"you should have received a copy of the gnu general public (license|licence) .*"),
    ("LGPLref", r"(this (software|work|project|program|code|file) is )?(licensed|released|distributed) under (the terms of )?the gnu lesser general public (license|licence).*"),
    ("BSDredist", r"redistribution and use in source and binary forms with or without modification are permitted provided that .*"),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice .*"),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice .*"),
    ("BSDname", r"neither the name of .* may be used to endorse or promote products .*"),
    ("BSDref", r"(this (software|work|project|code|file) is )?(licensed|released|distributed) under the (terms of the )?(2 clause |3 clause |new |simplified )?bsd (license|licence)"),
    ("MPL2ref", r"this source code form is subject to the terms of the mozilla public (license|licence) v ?(ersion)? ?2 0"),
    ("MPL2ref", r"(this (software|work|project|code|file) is )?(licensed|released|distributed) under the mozilla public (license|licence)( version)? 2 ?0"),
    ("CCBYNC4ref", r"(this (work|text|document|article) is )?(licensed|released|distributed) under (a |the )?(cc by nc|creative commons attribution noncommercial)( version)? 4 0.*"),
    ("CCBYSA4ref", r"(this (work|text|document|article) is )?(licensed|released|distributed) under (a |the )?(cc by sa|creative commons attribution sharealike)( version)? 4 0.*"),
    ("CCBY4ref", r"(this (work|text|document|article) is )?(licensed|released|distributed) under (a |the )?(cc by|creative commons attribution)( version)? 4 0( international( license)?)?"),
    ("CC0ref", r"(this (work|text|document|article) is )?(licensed|released|dedicated) (under|to) (cc0|the public domain).*"),
    ("SPDX", r"spdx license identifier .*"),
    ("Reserved", r"(copyright .*)?all rights reserved"),
    ("Copyright", r"copyright .*"),
)

#: Ordered rules: the first that fits takes its sentences; "?" marks a sentence that may be missing.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Apache2ref", "ApacheUse?", "ApacheCopy?", "ApacheLimit?")),
    ("GPL-3.0", ("GPL3ref", "GPLfree?", "GPLnowarranty?", "GPLreceived?")),
    ("GPL-2.0", ("GPL2ref", "GPLfree?", "GPLnowarranty?", "GPLreceived?")),
    ("GPL", ("GPLfree", "GPLnowarranty?", "GPLreceived?")),
    ("LGPL", ("LGPLref",)),
    ("MIT", ("MITgrant", "MITnotice?", "ASIS?", "Liability?")),
    ("MIT", ("MITref", "MITgrant?", "MITnotice?", "ASIS?", "Liability?")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDname", "ASIS?", "Liability?")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary", "ASIS?", "Liability?")),
    ("BSD", ("BSDref",)),
    ("MPL-2.0", ("MPL2ref", "MPLcopy?")),
    ("CC-BY-NC-4.0", ("CCBYNC4ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4ref",)),
    ("CC-BY-4.0", ("CCBY4ref",)),
    ("CC0-1.0", ("CC0ref",)),
    ("Proprietary", ("Reserved",)),
)

#: The SQL looks only at texts and pieces with one of these. The operator has no such filter: listed sentences lack them ("dedicated to the public
#: domain"), a line end may stand inside one, and a caller's own sentences needn't have any.
HINT = r"(?i)licen[sc]ed?|copyright|permission|redistribution|warrant|rights reserved|spdx|mozilla public|as is|mit |released under|neither the name|without any"
#: Sentences end at a line end, or at . ! ? ; : before white space.
ENDS = r"\n+|[.!?;:]+[\x20\x09-\x0D]+"
#: Beyond the SQL: sentences that go before the others, and rules that come after them. SPDX identifiers name a licence.
SPDX: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "apache 2 0"),
    ("GPL-3.0", "gpl 3 0( only| or later)?"),
    ("GPL-2.0", "gpl 2 0( only| or later)?"),
    ("LGPL", "lgpl [23] [01]( only| or later)?"),
    ("MIT", "mit"),
    ("BSD-3-Clause", "bsd 3 clause"),
    ("BSD-2-Clause", "bsd 2 clause"),
    ("MPL-2.0", "mpl 2 0"),
    ("CC-BY-NC-4.0", "cc by nc 4 0"),
    ("CC-BY-SA-4.0", "cc by sa 4 0"),
    ("CC-BY-4.0", "cc by 4 0"),
    ("CC0-1.0", "cc0 1 0"),
)
#: Sentences that are found over several pieces only, so the SQL doesn't have them: notices that name a version, titles and
#: first sentences of whole licences, and what stands beside them.
MORE_SENTENCES = tuple((f"SPDX-{name}", f"spdx license identifier {p}") for name, p in SPDX) + (
    ("ApacheCopy", "you may obtain a copy of the (license|licence) at"),
    ("Apache2title", "apache license version 2 0 january 2004( http.*)?"),
    ("ApacheTerms", "terms and conditions for use reproduction and distribution"),
    ("GPL3free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public (license|licence) as published by the free software foundation either version 3 .*"),
    ("GPL2free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public (license|licence) as published by the free software foundation either version 2 .*"),
    ("GPL3title", "gnu general public license version 3 29 june 2007"),
    ("GPL2title", "gnu general public license version 2 june 1991"),
    ("LGPL3title", "gnu lesser general public license version 3 29 june 2007"),
    ("LGPL2title", "gnu lesser general public license version 2 1 february 1999"),
    ("FSFcopyright", "copyright c [0-9 ]+ free software foundation inc( .*)?"),
    ("GNUverbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("LGPLfree", "this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public (license|licence) .*"),
    ("LGPLnowarranty", "this library is distributed in the hope that it will be useful but without any warranty .*"),
    ("LGPLreceived", "you should have received a copy of the gnu lesser general public (license|licence) .*"),
    ("MPL2title", "mozilla public license version 2 0"),
    ("MPLcopy", "if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("ISCgrant", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCasis", "the software is provided as is and the author disclaims all warranties .*"),
    ("Liability", "in no event shall .* be liable for any .*"),
)
MORE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = tuple((name, (f"SPDX-{name}",)) for name, _ in SPDX) + (
    ("Apache-2.0", ("Apache2title", "ApacheTerms?")),
    ("GPL-3.0", ("GPL3free", "GPLnowarranty?", "GPLreceived?")),
    ("GPL-2.0", ("GPL2free", "GPLnowarranty?", "GPLreceived?")),
    ("GPL-3.0", ("GPL3title", "FSFcopyright?", "GNUverbatim?")),
    ("GPL-2.0", ("GPL2title", "FSFcopyright?", "GNUverbatim?")),
    ("LGPL", ("LGPL3title", "FSFcopyright?", "GNUverbatim?")),
    ("LGPL", ("LGPL2title", "FSFcopyright?", "GNUverbatim?")),
    ("LGPL", ("LGPLfree", "LGPLnowarranty?", "LGPLreceived?")),
    ("MPL-2.0", ("MPL2title",)),
    ("ISC", ("ISCgrant", "ISCasis?", "Liability?")),
)
#: Marks of ends in normalised text: of those that end every sentence, and of those that a sentence may go over.
HARD, SOFT = "\x01", "\x02"
_BLANK = r"[\x20\x09-\x0D]+"
#: A run is looked at from its start only and without a group that repeats, so long runs neither take squared time nor fill the stack.
MARKS = (
    (rf"(?<![a-z0-9])v\.{_BLANK}", f"v{SOFT}"),
    (r"\n[^a-z0-9\x02]*\n", HARD),
    (rf"(?<![.!?;:])[;:]*[.!?][.!?;:]*{_BLANK}", HARD),
    (rf"(?<![;:])[;:]+{_BLANK}|\n", SOFT),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r"(?<![ \x02])[ \x02]*\x01[ \x01\x02]*", HARD),
    (r" *\x02[ \x02]*", SOFT),
)
ADDED = ("n_sentences", "sentence_ids", "licenses", "n_unmatched")


def sentence_id(sentence: Column, sentences: Sequence[tuple[str, str]] = SENTENCES) -> Column:
    """Identifier of a normalised sentence: the first pattern that fits it whole, else null."""
    out = None
    for name, pattern in sentences:
        hit = sentence.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def marked(text: Column) -> Column:
    """The text normalised, with marks where pieces end."""
    out = F.translate(F.lower(text), HARD + SOFT, "  ")
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def known_sentences(sentences: Sequence[tuple[str, str]]) -> str:
    """Pattern of a known sentence in marked text: a piece, or else several pieces."""
    one = "|".join(p.replace(".*", r"[^\x01\x02]*") for _, p in sentences)
    several = "|".join(p.replace(".*", r"[^\x01]*?").replace(" ", r"[ \x02]") for _, p in sentences)
    return rf"(?<![^\x01\x02])(?:(?:{one})(?![^\x01\x02])|(?:{several})(?![^\x01\x02]))"


def rule_pattern(parts: Sequence[str]) -> str:
    """Identifiers stand in a string as ``<A><B>``; a rule is a pattern over it."""
    return "".join(f"(?:<{p[:-1]}>)?" if p.endswith("?") else f"<{p}>" for p in parts)


def scan(docs: DataFrame, sentences: Sequence[tuple[str, str]] = MORE_SENTENCES + SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES + MORE_RULES) -> DataFrame:
    """Adds n_sentences (known ones), sentence_ids (in order), licenses (of the matched rules,
    in text order), n_unmatched (known licence sentences that no rule took); columns of these names are replaced."""
    matches = F.transform(F.regexp_extract_all(marked(F.col("text")), F.lit(known_sentences(sentences)), 0), lambda s: F.translate(s, SOFT, " "))
    ids = F.filter(F.transform(matches, lambda s: sentence_id(s, sentences)), lambda x: x.isNotNull())
    none = F.lit([]).cast("array<string>")
    found = docs.withColumn("__cm_ids", F.coalesce(ids, none))
    left = F.concat(F.lit(""), F.array_join(F.transform("__cm_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    for name, parts in rules:
        left = F.regexp_replace(left, rule_pattern(parts), f"[{name}]")
    out = found.withColumn("__cm_left", F.when(F.size("__cm_ids") > 0, left).otherwise(""))
    known = F.regexp_extract_all("__cm_left", F.lit(r"\[([^\]]*)\]"), 1)
    return out.select(
        *[c for c in docs.columns if c not in ADDED],
        F.size("__cm_ids").cast("long").alias("n_sentences"),
        F.array_join("__cm_ids", ",").alias("sentence_ids"),
        F.array_join(known, ",").alias("licenses"),
        F.size(F.regexp_extract_all("__cm_left", F.lit("<([^>]*)>"), 1)).cast("long").alias("n_unmatched"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text")


def scan_sql(docs: str = "documents") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    case = " ".join(f"WHEN regexp_full_match(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    left = "coalesce(ids, '')"
    for name, parts in RULES:
        left = f"regexp_replace({left}, {quote(rule_pattern(parts))}, '[{name}]', 'g')"
    return f"""
WITH cut AS (SELECT doc_id, rowid_, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (
    SELECT doc_id, row_number() OVER () AS rowid_, regexp_split_to_array(text, {quote(ENDS)}) AS p FROM {docs} WHERE regexp_matches(text, {quote(HINT)}))),
norm AS (SELECT doc_id, rowid_, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut WHERE regexp_matches(s, {quote(HINT)})),
known AS (SELECT doc_id, rowid_, k, CASE {case} END AS id FROM norm),
per AS (SELECT doc_id, rowid_, count(*) AS n, string_agg(id, ',' ORDER BY k) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY k) AS ids FROM known WHERE id IS NOT NULL GROUP BY doc_id, rowid_),
taken AS (SELECT d.doc_id, coalesce(p.n, 0) AS n, coalesce(p.sentence_ids, '') AS sentence_ids, {left} AS lft FROM {docs} d LEFT JOIN per p ON d.doc_id = p.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, sentence_ids, array_to_string(regexp_extract_all(lft, '\\[([^\\]]*)\\]', 1), ',') AS licenses,
  CAST(len(regexp_extract_all(lft, '<([^>]*)>', 1)) AS BIGINT) AS n_unmatched FROM taken"""


QUERIES = {"op1_licenses": op1_licenses}
SQL = {"op1_licenses": scan_sql()}
