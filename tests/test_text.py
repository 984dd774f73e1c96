import hashlib

import pytest
from pyspark.sql import functions as F

from veritab.functions import text as T


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", make(F.col("v")).alias("o")).collect())]


def test_normal_form_collapses_what_python_splits_on(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert len(spaces) == 29
    others = [chr(c) for c in (0x200B, 0xFEFF, 0x180E, ord("a"))]
    values = [f"x{c}{c}y{c}" for c in spaces + others] + ["", "   ", None]
    expected = [" ".join(v.split()) if v is not None else None for v in values]
    assert column(spark, values, "string", T.normalize_text) == expected
    assert column(spark, values, "string", T.is_blank) == [not v for v in expected]


def test_ids(spark):
    df = spark.createDataFrame([(5, 2, "a\n b")], "i bigint, y int, t string")
    row, content = df.select(T.row_id("train", F.col("i"), F.col("y"), F.col("t")), T.content_id(F.col("t"))).first()
    assert row == hashlib.sha256("train\0005\0002\0a\n b".encode()).hexdigest()
    assert content == hashlib.sha256(b"a b").hexdigest()


def test_row_ids_see_raw_text_and_content_ids_do_not(spark):
    ids = column(spark, ["same\narticle", "same article"], "string", lambda v: T.row_id("train", F.lit(0), F.lit(0), v))
    assert ids[0] != ids[1]
    contents = column(spark, ["same\narticle", "same article"], "string", T.content_id)
    assert contents[0] == contents[1]


def test_parse_code(spark):
    values = [" A ", "`d`", "The answer is A", '"b"', " c ", "", None, "E", "AB"]
    assert column(spark, values, "string", T.parse_code) == [0, 3, None, 1, 2, None, None, None, None]


def test_messages(spark):
    df = spark.createDataFrame([(" x\ny ", 3), ("z", 4)], "t string, y int")
    one, two = df.select(T.training_messages(F.col("t"), F.col("y")).alias("m"), T.render_chat(T.inference_messages(F.col("t"))).alias("p")).collect()
    assert [m["role"] for m in one["m"]] == ["system", "user", "assistant"]
    assert one["m"][1]["content"] == "Article:\nx y\n\nTopic code:" and one["m"][2]["content"] == "D"
    assert two["m"] is None
    assert one["p"].endswith("Topic code:\n<|assistant|>\n")


@pytest.mark.parametrize("log10, out", [(-316.1471594320514, "e-317"), (-0.5, "e-1"), (-2.0, "1e-2")])
def test_scientific(spark, log10, out):
    assert column(spark, [log10], "double", T.scientific)[0].endswith(out)


def test_parameter_text(spark):
    df = spark.createDataFrame([(200, 100 * 200 / 10200, 10200), (200, 5.0, 10200)], "t bigint, p double, n bigint")
    found = [r[0] for r in df.select(T.parameter_text(F.col("t"), F.col("p"), F.col("n"))).collect()]
    assert found == ["200 (1.9608% of 10,200)", None]


def test_hash_fraction_keeps_the_order(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]
    found = column(spark, digests, "string", T.hash_fraction)
    assert sorted(range(200), key=lambda i: found[i]) == sorted(range(200), key=lambda i: digests[i])
    assert 0 <= min(found) and max(found) < 1


