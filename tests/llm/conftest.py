import random

import pytest

#: Texts that every operator must take: null, empty, blank, one word, beyond ASCII, ties, repeats.
ODD = [None, "", " \n\t", "word", "Ünïcode ñandú ça va", "a a a a a a", "x" * 5000, "one two three\none two three\n", "\U0001f600 \U0001f600"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{'bcdfghjk'[i % 8]}{'aeiou'[i % 5]}{'lmnprst'[i % 7]}{i:x}" for i in (int(rng.paretovariate(0.6)) % vocabulary for _ in range(n)))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text, lang, source): prose with copies, near copies, shared passages and odd texts; ids repeat and go missing."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 160)) for _ in range(60)]
    passage = prose(rng, 40)
    texts += [texts[i] for i in (3, 3, 9)] + [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)]
    for t in texts[10:14]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ODD
    out = [(i, t, "ab"[i % 2] if i % 7 else None, ("s1", "s2", "s3", None)[min(i % 8, 3)]) for i, t in enumerate(texts)]
    return [*out, out[0], (None, texts[1], "a", "s1"), (None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"size": F.lit("mine"), "score": F.lit(-1), "fp": F.lit("mine"), "terms": F.lit(0), "key": F.lit(0), "licenses": F.lit("mine"), "_row": F.lit(1), "_key": F.lit(2), "_text": F.lit("mine"), "_id": F.lit(3), "_u": F.lit(4)})


@pytest.fixture(scope="session")
def unique(spark, rows):
    """Without repeated or missing ids."""
    found = {r[0]: r for r in rows if r[0] is not None}
    return spark.createDataFrame(list(found.values()), "doc_id long, text string, lang string, source string")
