import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veritab.llm import spans

TEXT = "doc_id bigint, text string"


def fixture(seed, n=60):
    rng = random.Random(seed)

    def run(k):
        return "".join(rng.choice("abcdefgh \né中\U0001f600") for _ in range(k))

    passages = [run(rng.randrange(150, 700)) for _ in range(12)]
    docs = []
    for _ in range(n):
        parts = [run(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts += [p[a : len(p) - rng.randrange(0, 60)], run(rng.randrange(0, 200))]
        docs.append("".join(parts))
    own = run(300)
    docs += [own + own + own, "a" * 500, "a" * 161, "a" * 160, "a" * 159, "ab" * 400, "", None, docs[0], run(30_000)]
    return list(enumerate(docs)) + [(None, docs[1]), (None, docs[1]), (3, docs[3])]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_spans(spark, seed, hot, monkeypatch):
    rows = fixture(seed)
    if hot:  # everything that occurs twice is treated as hot
        monkeypatch.setattr(spans, "PART", 2)
        monkeypatch.setattr(spans, "HOT", 2)
    df = spark.createDataFrame(rows, TEXT).select(F.lit(1).alias("start"), F.lit(2).alias("low"), "text", "doc_id").repartition(5)
    found = [tuple(r) for r in spans.shared_spans(df).collect()]
    assert len(found) == len(set(found))
    truth = brute.shared_spans(rows)
    assert set(found) == truth and len(truth) > 30


@pytest.mark.parametrize("span, gram", [(10, 10), (10, 4), (40, 1), (33, 20)])
def test_other_lengths(spark, span, gram):
    rows = fixture(5, 15)
    found = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, TEXT), span, gram).collect()}
    assert found == brute.shared_spans(rows, span)


def test_a_passage_in_a_third_of_the_rows(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, (f"head {i} " * 30) + (passage if i % 3 == 0 else "") + f" tail {i}" * 20) for i in range(900)]
    found = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, TEXT)).collect()}
    assert found == brute.shared_spans(rows)


def test_characters_and_empty_tables(spark):
    rows = fixture(7, 20)
    df = spark.createDataFrame(rows, TEXT)
    truth = {}
    for i, s, e in brute.shared_spans(rows):
        truth[i] = truth.get(i, 0) + e - s
    out = spans.shared_characters(df.where("doc_id is not null").dropDuplicates(["doc_id"]), spans.shared_spans(df))
    assert {r["doc_id"]: r["n_shared"] for r in out.collect()} == {i: truth.get(i, 0) for i, _ in rows if i is not None}
    assert spans.shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, 10, 11)


def test_minima():
    texts = ["".join(np.random.default_rng(i).choice(list("abcd"), 400)) for i in range(3)]
    p = spans.Passages(texts, 160, 64)
    low = p.minima()
    at = np.arange(len(p.points) - 63)
    grams = p.hashes(at, at + 64)
    assert low.tolist() == [grams[s : s + 97].min() for s in p.first.tolist()]
