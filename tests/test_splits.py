import hashlib

import pytest
from pyspark.sql import functions as F

from veritab.config import DataConfig
from veritab.errors import LeakError, LockedSplitError
from veritab.operators import ingest, leaks, splits
from veritab.operators.bottomk import bottom_k, unit_hash
from veritab.sources.corpus import Bundle, load_bundle
from veritab.streaming.leaks import leak_counts, leaking

RAW = "text string, label int, source_index bigint"


def corpus(spark, each):
    return spark.createDataFrame([(f"row {c} {i}", c, 1000 * c + i) for c in range(4) for i in range(each)], RAW)


def expected(rows, config):
    """The rule, by sorting whole classes."""
    start = config.train_per_class if config.validation_start_per_class is None else config.validation_start_per_class
    stop = start + config.validation_per_class
    train, judged = set(), set()
    for label in range(4):
        ids = [r["row_id"] for r in rows if r["label"] == label]
        ids.sort(key=lambda i: hashlib.sha256(f"{config.seed}\0{i}".encode()).hexdigest())
        judged |= set(ids[start:stop])
        train |= set((ids[:start] + ids[stop:])[: config.train_per_class])
    return train, judged


def taken(df):
    rows = df.collect()
    return tuple({r["row_id"] for r in rows if r["split"] == s} for s in ("train", "validation"))


@pytest.mark.parametrize("config", [DataConfig(train_per_class=4, validation_per_class=2), DataConfig(train_per_class=6, validation_per_class=2, validation_start_per_class=2), DataConfig(train_per_class=3, validation_per_class=2, validation_start_per_class=0)])
def test_split_follows_the_rule(spark, config):
    rows = ingest.identified(corpus(spark, 60))
    train, judged = taken(splits.development_split(rows, config))
    assert (train, judged) == expected(rows.collect(), config)
    assert not train & judged
    again = taken(splits.development_split(rows.repartition(7), config))
    assert again == (train, judged)


def test_growing_training_never_moves_validation(spark):
    rows = ingest.identified(corpus(spark, 8))
    small = taken(splits.development_split(rows, DataConfig(train_per_class=2, validation_per_class=2)))
    large = taken(splits.development_split(rows, DataConfig(train_per_class=6, validation_per_class=2, validation_start_per_class=2)))
    assert small[1] == large[1] and small[0] < large[0] and len(large[0]) == 24


def test_too_few_rows_are_refused(spark):
    rows = ingest.identified(corpus(spark, 5).where("label < 3 or source_index < 3003"))
    with pytest.raises(Exception, match="class 3 has 3 rows; 5 required"):
        splits.development_split(rows, DataConfig(train_per_class=4, validation_per_class=1)).collect()
    none = ingest.identified(corpus(spark, 5).where("label < 3"))
    with pytest.raises(Exception, match="class 3 has 0 rows"):
        splits.development_split(none, DataConfig(train_per_class=4, validation_per_class=1)).collect()


def test_violations_name_each_broken_rule(spark):
    bad = spark.createDataFrame([(None, 0, 1), ("", 0, 2), ("  ", None, 3), ("x", 4, 4), ("x", -1, None), ("fine", 3, 6)], RAW)
    found = sorted((r[0] or 0, r[1]) for r in ingest.violations(bad).collect())
    assert found == [(0, "label_out_of_range"), (0, "missing_index"), (1, "blank_text"), (2, "blank_text"), (3, "blank_text"), (3, "missing_label"), (4, "label_out_of_range")]
    assert ingest.identified(bad).count() == 1
    with pytest.raises(Exception, match="blank_text"):
        ingest.strict(bad).collect()


def test_labels_must_be_integers(spark):
    for kind in ("boolean", "double", "string"):
        with pytest.raises(ValueError):
            ingest.identified(spark.createDataFrame([], f"text string, label {kind}, source_index bigint"))
    with pytest.raises(ValueError):
        ingest.identified(spark.createDataFrame([], "text string"))


def test_rows_delivered_again_count_once(spark):
    rows = corpus(spark, 3)
    assert ingest.identified(rows.unionAll(rows)).count() == 12
    assert ingest.identified(rows.limit(0)).count() == 0


def test_counts_keep_empty_classes_and_digests_follow_order(spark):
    rows = ingest.identified(corpus(spark, 3).where("label <> 2")).withColumn("split", F.lit("train"))
    assert sorted(tuple(r) for r in splits.class_counts(rows).collect()) == [(0, 3), (1, 3), (2, 0), (3, 3)]
    ids = sorted(r["row_id"] for r in rows.collect())
    assert splits.split_digests(rows).first()["row_ids_sha256"] == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    by_index = [r["row_id"] for r in rows.orderBy("source_index").collect()]
    assert splits.split_digests(rows, "source_index").first()["row_ids_sha256"] == hashlib.sha256("\n".join(by_index).encode()).hexdigest()


def test_described_unused(spark):
    rows = ingest.identified(corpus(spark, 50))
    members = splits.development_split(rows, DataConfig(train_per_class=10, validation_per_class=2))
    assert {r["unused"] for r in splits.described(members, rows).collect()} == {200 - 48}
    assert {r["unused"] for r in splits.described(members).collect()} == {None}


def ids(spark, rows):
    return spark.createDataFrame(rows, "row_id string, content_id string")


def test_leaks(spark):
    a = ids(spark, [(str(i), f"c{i}") for i in range(100)])
    leaks.require_disjoint(a, ids(spark, [(str(i), f"c{i}") for i in range(100, 120)]))
    with pytest.raises(LeakError, match="5 of 20 validation rows also appear in train"):
        leaks.require_disjoint(a, ids(spark, [(str(i), f"c{i}") for i in range(95, 115)]))
    with pytest.raises(LeakError, match="same normalised text"):
        leaks.require_disjoint(a, ids(spark, [("x", "c7")]))
    report = leaks.leak_report(a, ids(spark, [("1", "c1"), ("1", "c1"), ("x", "c2")])).first()
    assert tuple(report) == (1, 2, 1, 3)


def test_leak_matrix(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("a", "2"), ("b", "2"), ("b", "2"), (None, "1"), ("c", None)], "split string, content_id string")
    assert sorted(tuple(r) for r in leaks.leak_matrix(rows).collect()) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_bundle_keeps_the_test_split_locked(spark, tmp_path):
    corpus(spark, 30).write.parquet(str(tmp_path / "train"))
    config = DataConfig(train_per_class=5, validation_per_class=2, publisher_test_rows=8)
    bundle = load_bundle(spark, str(tmp_path / "train"), config, test_path=str(tmp_path / "absent"))
    with pytest.raises(LockedSplitError):
        bundle.require_test()
    held = spark.createDataFrame([(f"held {i}", i % 4, i) for i in range(8)], RAW)
    held.write.parquet(str(tmp_path / "test"))
    assert load_bundle(spark, str(tmp_path / "train"), config, str(tmp_path / "test"), allow_test=True).require_test().count() == 8
    corpus(spark, 30).limit(0).unionAll(held.limit(7)).unionAll(spark.createDataFrame([("  row 0\n0", 0, 9)], RAW)).write.parquet(str(tmp_path / "leaky"))
    everything = DataConfig(train_per_class=28, validation_per_class=2, publisher_test_rows=8)
    with pytest.raises(LeakError):
        load_bundle(spark, str(tmp_path / "train"), everything, str(tmp_path / "leaky"), allow_test=True)
    assert isinstance(bundle, Bundle)


@pytest.mark.parametrize("k", [0, 1, 7, 300, 5000])
def test_bottom_k_is_exact(spark, k):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"), "id").withColumn("u", unit_hash(F.col("id")))
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    sized = rows.withColumn("k", F.lit(k)).withColumn("size", F.when(F.col("g").isNull(), sizes[None]).otherwise(F.lit(sizes[1])))
    # a skewed hash puts the k-th row far from where it is expected: the whole group is ranked
    for hashed in (F.col("u"), F.col("u") / 50):
        found = {r["id"] for r in bottom_k(sized.withColumn("u", hashed), ["g"], "k", "size", "u", "id").collect()}
        whole = {}
        for r in rows.collect():
            whole.setdefault(r["g"], []).append((r["u"], r["id"]))
        assert found == {i for g in whole.values() for _, i in sorted(g)[:k]}


def test_streaming_leaks(spark, tmp_path):
    judged = ids(spark, []).unionAll(spark.sql("select 'x', sha2('a b', 256)"))
    batch = spark.createDataFrame([("a\nb",), ("c",), (None,), (" ",)], "text string")
    assert [r["text"] for r in leaking(batch, judged).collect()] == ["a\nb"]
    batch.withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = leak_counts(stream, judged, "ts").writeStream.outputMode("complete").format("memory").queryName("leaking_rows").start()
    try:
        q.processAllAvailable()
        assert [r["rows"] for r in spark.table("leaking_rows").collect()] == [1]
    finally:
        q.stop()
