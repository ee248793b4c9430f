"""A small corpus with what the operators must stand: nulls, empty and long texts, copies, repeated rows, odd columns."""

import random

import pytest

LONG = 30_000


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(90), text(200)
    rows = [(i, f"{text(rng.randint(0, 150))}\n{text(3)}", rng.choice(["en", "fr", "xx", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(100 + i, base, "en", "a") for i in range(8)]
    rows += [(120 + i, " ".join(base.split()[:i] + ["NEU"] + base.split()[i + 1 :]), "en", "b") for i in range(0, 200, 9)]
    rows += [(400 + i, f"{text(30)} {passage}\t{text(25)}", "fr", "c") for i in range(6)]
    rows += [(500, f"{passage} {passage} x {passage}", "en", "a"), (501, None, None, None), (502, "", "en", ""), (503, " \n\t ", "en", "b"), (504, "word", "de", "c")]
    rows += [(505, " ".join(["the same line again"] * 60) + "\n" + "ab ab ab ab\n" * 5, "en", "a"), (506, text(LONG), "en", "b"), (507, "don't  <|endoftext|>　日本 ԱՖ 12345 !!\r\n\n  x", "en", "a")]
    rows += [(None, base, "en", "a"), (None, text(40), "en", None), (60, "same id", "en", "a"), (60, "other text", "en", "a")]
    rows += [rows[0], rows[101 - 60], (508, passage, "en", "a"), (508, passage, "en", "a")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    extra = {c: F.lit(7) for c in ("fp", "component_id", "size", "taken", "target", "n", "key", "band", "doc", "th", "parts", "lo", "range", "order", "w", "g", "id")}
    return df.withColumns(extra).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id < -1")
