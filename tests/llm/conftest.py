import random

import pytest

SYLLABLES = {"en": "the re in on ing ed an st er".split(), "fr": "le que eau oi ment é è tion".split(), "de": "der ung sch ein keit ü ge".split()}


def prose(random_, lang, n):
    return " ".join("".join(random_.choice(SYLLABLES[lang]) for _ in range(random_.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """A few hundred texts: prose of three languages, copies, near copies, junk, shared passages."""
    r = random.Random(4)
    out = []
    shared = prose(r, "en", 60)
    for i in range(160):
        lang = ("en", "fr", "de")[i % 3]
        t = prose(r, lang, r.randint(20, 150))
        if i % 10 == 3:
            words = t.split()
            words.insert(len(words) // 2, "inserted")
            out.append((f"{t}", lang))
            t = " ".join(words)
        if i % 13 == 5:
            t = f"{t[:80]} {shared} {t[80:]}"
        if i % 17 == 1:
            t = " ".join(f"{w}%%%" for w in t.split())
        out.append((t, lang))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int("%%%" not in t), 0) for i, (t, _) in enumerate(texts)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, texts):
    words = texts[0][0].split()
    return spark.createDataFrame([(1, " ".join(words[3:18])), (2, "zzz yyy"), (3, None), (4, ""), (None, "the"), (1, " ".join(words[3:18]))], "item_id long, text string")


CLASHING = "rid string, key string, words int, sig int, score string, term int, part int, rank int, place int, kept_rid int, matched_rid int, found_rid int, text_to_score int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, rows of one id, and columns whose names operators use."""
    long = "long text of many words " * 9000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", None, None), (5, "x" * 150_000, None, "a", 1), (6, "the same words again and again for ever", "en", "a", 3),
        (6, "the same words again and again for ever", "en", "a", 3), (6, "other words under one id, none of them like the rest", "de", "a", 3), (None, "no id but text with mail a.b@c.example.com here", "en", "a", 3), (None, None, None, None, None), (7, "the same words again and again for ever", "fr", "a", 3), (8, "é\U0001f642 ,.;", "fr", "a", 3), (9, "1234567890" * 3000, "fr", "a", 3), (10, "a@" * 20000, "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")])
