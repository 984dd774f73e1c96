import hashlib
import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions import features as X
from veritab.operators import digests, parameters, tokens
from veritab.sources.scorer import Collator, HashTokenizer, code_ids, flat_ids, hash_scorer, left_padded, prompt_ids, score


def arrays(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")


def test_supervised(spark):
    df = spark.createDataFrame([([1, 20, 21], 13), (None, 13), ([1], None)], "p array<int>, a int")
    rows = [r[0] for r in df.select(X.supervised(F.col("p"), F.col("a"), 2)).collect()]
    assert rows[0].asDict() == {"input_ids": [1, 20, 21, 13, 2], "attention_mask": [1] * 5, "labels": [-100, -100, -100, 13, 2]}
    assert rows[1:] == [None, None]
    with pytest.raises(Exception, match="has 5 tokens, more than 4"):
        df.select(X.supervised(F.col("p"), F.col("a"), 2, 4)).collect()
    assert df.limit(1).select(X.labelled(X.supervised(F.col("p"), F.col("a"), 2)["labels"])).first()[0] == 2


def test_padding(spark):
    df = arrays(spark, [[1, 20, 21], [1, 30]]).withColumn("b", F.lit(1)).withColumn("w", X.width_of(F.col("v"), ["b"]))
    rows = df.orderBy("i").select(X.padded_left(F.col("v"), F.col("w"), 2), X.padded_right(F.col("v"), F.col("w"), -100)).collect()
    assert [list(r) for r in rows] == [[[1, 20, 21], [1, 20, 21]], [[2, 1, 30], [1, 30, -100]]]
    assert left_padded([[1, 20, 21], [1, 30]], 2) == ([[1, 20, 21], [2, 1, 30]], [[1, 1, 1], [0, 1, 1]])
    with pytest.raises(ValueError):
        left_padded([], 2)


def test_reference_loss(spark):
    rng = np.random.default_rng(0)
    z, y = rng.normal(0, 1, (5, 6)), [-100, -100, -100, 3, 2]

    def loss(z, y):
        df = spark.createDataFrame([(z.tolist(), y)], "s array<array<double>>, y array<int>")
        return df.select(X.reference_loss(F.col("s"), F.col("y"))).first()[0]

    def expected(z, y):
        terms = [np.log(np.exp(z[t]).sum()) - z[t][y[t + 1]] for t in range(len(y) - 1) if y[t + 1] != -100]
        return np.mean(terms)

    assert loss(z, y) == pytest.approx(expected(z, y))
    padded = np.vstack([z, rng.normal(0, 9, (3, 6))])
    assert loss(padded, y + [-100] * 3) == pytest.approx(loss(z, y))
    moved = z.copy()
    moved[:2] += 50
    assert loss(moved, y) == pytest.approx(loss(z, y))
    better = z.copy()
    better[2][3] += 50
    assert loss(better, y) < loss(z, y)
    assert loss(z, [-100] * 5) is None and loss(z[:1], [1]) is None


def test_token_summary(spark):
    rows = [("train", f"r{n}", n + 5) for n in (1, 2, 3)] + [("validation", f"v{n}", n + 5) for n in (4, 5)]
    lengths = spark.createDataFrame(rows, "split string, row_id string, n_tokens bigint")
    found = {r["split"]: r for r in tokens.token_audit(lengths, 8).collect()}
    assert tuple(found["train"])[1:] == (3, 6, 7.0, 8, 8, 0, True)
    assert found["all rows"]["rows_over"] == 2 and not found["all rows"]["safe"]
    assert found["validation"]["median"] == 9.5
    assert tokens.median_value(7.0) == 7 and type(tokens.median_value(7.0)) is int and tokens.median_value(9.5) == 9.5
    with pytest.raises(RuntimeError):
        tokens.require_safe(tokens.token_audit(lengths, 8))
    tokens.require_safe(tokens.token_audit(lengths, 10))
    digest = {r["split"]: r["token_lengths_sha256"] for r in digests.lengths_digest(lengths, ["split"]).collect()}
    listed = [{"row_id": r, "prompt_plus_answer_tokens": n} for s, r, n in rows if s == "train"]
    assert digest["train"] == digests.json_sha256(listed)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100, 101])
def test_nearest_rank(spark, n):
    df = spark.range(n).selectExpr("id * 3 % 101 as v")
    values = sorted(r[0] for r in df.collect())
    for p in (1, 50, 95, 100):
        assert tokens.nearest_rank(df, [], "v", p, "x").first()[0] == values[max(1, (p * n + 99) // 100) - 1]
    assert tokens.nearest_rank(df.limit(0), [], "v", 95, "x").collect() in ([], [(None,)])
    assert statistics.median([1, 2]) == 1.5


def test_digests(spark):
    rows = spark.createDataFrame([(i, y) for i, y in enumerate([0, 1, 3])], "pos bigint, label int")
    expected = hashlib.sha256(b"0,1,3").hexdigest()
    assert digests.label_digest(rows.withColumn("s", F.lit("x")), ["s"]).first()["label_sha256"] == expected
    assert digests.streamed(rows.repartition(3), "label", "pos", ",") == expected == digests.require_labels([0, 1, 3])
    assert digests.require_labels([0, 1]) != digests.require_labels([1, 0])
    for f in (lambda: digests.require_labels([]), lambda: digests.streamed(rows.limit(0), "label", "pos")):
        with pytest.raises(RuntimeError):
            f()
    z = np.random.default_rng(0).normal(0, 1, (7, 4)).astype("<f4")
    df = spark.createDataFrame([(i, "x", r.tolist()) for i, r in enumerate(z)], "pos bigint, s string, z array<float>")
    own = hashlib.sha256(b"<f4\0(7, 4)\0" + z.tobytes()).hexdigest()
    assert tuple(digests.array_digest(df.repartition(3), ["s"]).first()) == ("x", 7, own)
    # larger arrays: the digests of chunks in order
    z = np.array([r["z"] for r in df.orderBy("pos").collect()], "<f4")
    parts = "".join(hashlib.sha256(z[i : i + 3].tobytes()).hexdigest() for i in (0, 3, 6))
    chunked = hashlib.sha256(f"<f4\0(7, 4)\0{parts}".encode()).hexdigest()
    assert tuple(digests.array_digest(df.repartition(3), ["s"], chunk=3).first()) == ("x", 7, chunked)
    assert digests.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}' == json.dumps({"a": "é", "b": 1}, separators=(",", ":"))


KIND = "name string, numel bigint, requires_grad boolean, is_4bit boolean, element_size int"


def test_parameters(spark):
    def report(rows):
        return parameters.parameter_report(spark.createDataFrame(rows, KIND)).first()

    assert tuple(report([("w", 10_000, False, False, 1), ("a.lora_A", 100, True, False, 1), ("b.lora_B", 100, True, False, 1)]))[:2] == (10_200, 200)
    packed = report([("w", 3_500_000_000, False, True, 1), ("lora_A", 20_000_000, True, False, 1), ("lora_B", 20_000_000, True, False, 1)])
    assert (packed["total"], packed["stored"]) == (7_040_000_000, 3_540_000_000)
    assert packed["trainable_percent"] == pytest.approx(100 * 4e7 / 7.04e9)
    for bad in ([("w", 5, True, False, 1)], [("w", 5, False, False, 1)], []):
        with pytest.raises(Exception, match="parameter"):
            report(bad)


def test_tokenizer_and_scorer(spark):
    t = HashTokenizer()
    assert code_ids(t, "Topic code:") == (10, 11, 12, 13)
    assert flat_ids({"input_ids": [[1, 2]]}) == [1, 2]
    for bad in ([], [[1], [2]]):
        with pytest.raises(ValueError):
            flat_ids(bad)

    class Same(HashTokenizer):
        def encode(self, text):
            return [1] * len(text.split())

    with pytest.raises(ValueError, match="share"):
        code_ids(Same(), "x")
    df = spark.createDataFrame([(i, f"some words {i} " * (i + 1)) for i in range(9)], "pos bigint, t string")
    prompts = df.select("pos", prompt_ids(t)(F.col("t")).alias("ids"))
    one = {r["pos"]: r["z"] for r in score(prompts, hash_scorer).collect()}
    two = {r["pos"]: r["z"] for r in score(prompts.repartition(5), hash_scorer, batch=2).collect()}
    assert one == two and len(one) == 9
    with pytest.raises(Exception, match="more than 5"):
        score(prompts, hash_scorer, longest=5).collect()


def test_collator():
    a = {"input_ids": [1, 20, 30, 10, 2], "attention_mask": [1] * 5, "labels": [-100, -100, -100, 10, 2]}
    b = {"input_ids": [1, 20, 2], "attention_mask": [1] * 3, "labels": [-100, -100, 2]}
    out = Collator(2)([a, b])
    assert out["input_ids"][1] == [1, 20, 2, 2, 2] and out["attention_mask"][1] == [1, 1, 1, 0, 0] and out["labels"][1] == [-100, -100, 2, -100, -100]
    for bad in ([], [a | {"labels": [1]}]):
        with pytest.raises(ValueError):
            Collator(2)(bad)
    with pytest.raises(ValueError):
        Collator(None)
