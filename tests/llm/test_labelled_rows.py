"""Toxicity learns from every labelled row; near copies count about once."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import labelled, toxicity


def test_words_of_late_rows_are_learned(spark):
    """Six toxic rows that a sample of 6,000 rows by the hash of the id leaves out."""
    rng = random.Random(4)
    ids = [r[0] for r in spark.range(7000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(ids[6500:6506])
    rows = []
    for i in ids:
        words = ["".join(rng.choices("abdeilmnorstu", k=7)) for _ in range(12)]
        rows.append((i, " ".join(words + ["grobian"] * (i in late) + ["villain"] * (i % 10 == 0)), int(i in late or i % 10 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert "villain" in model.shares and "grobian" in model.shares and model.words["grobian"] == 6


@pytest.mark.parametrize("small", [0, 1000])
def test_all_rows_once(spark, monkeypatch, small):
    monkeypatch.setattr(labelled, "SMALL_ROWS", small)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abdeilmnorstu", k=7))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(40)]
    rows += [(0, rows[0][1]), (50, rows[1][1]), (51, "zusatz " + rows[2][1]), (1, "other text of id one"), (60, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(3, None)], "doc_id long, toxic int")
    got = labelled.labelled_rows(docs.repartition(3), labels, "toxic", F.lit(True)).select("label", "text").collect()
    want = labelled.labelled_sample(docs, labels, "toxic", F.lit(True), 1000, once=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 39 <= len(got) <= 44


def test_near_copies_with_words_put_before_them(spark):
    """Places of words do not matter: most copies of a long text that begin or end otherwise are found."""
    rng = random.Random(6)
    base = ["".join(rng.choices("abdeilmnorstu", k=7)) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join([f"x{j}" for j in range(i)] + base[i % 3 :])) for i in range(10)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert labelled.labelled_rows(docs, labels, "toxic", F.lit(True)).count() <= 4
