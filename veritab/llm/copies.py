"""Duplicates hidden by formatting differences.

Hot canonical keys are detected exactly with partial counts and salted into a
two-level aggregation; all other keys take one shuffle.  The representative of a
set is its smallest identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veritab.llm import textcodes
from veritab.session import written

KEYS = "row_id string, k1 binary, k2 binary"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = textcodes.copy_keys(batch.column(1).to_pylist())
        rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["row_id", "k1", "k2"])
        yield rows.filter(pa.compute.is_valid(rows.column(1)))


def copy_keys(records: DataFrame) -> DataFrame:
    """(row_id, k1, k2) of the records with a row_id and a text that isn't blank."""
    return records.where(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select("row_id", "text").mapInArrow(_keyed, KEYS)


def linked(keys: DataFrame) -> DataFrame:
    """(k1, class) of the keys of letters that some key of fields links to a smaller one.

    Two tagged texts with the same set of fields are copies though their letters
    come in another order.  Smallest keys are passed along such links until none
    changes; only keys with such a link take part.
    """
    edges = keys.where(F.col("k2").isNotNull()).select("k1", "k2").distinct()
    several = edges.groupBy("k2").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("k2")
    edges = written(edges.join(several, "k2", "left_semi").withColumn("class", F.col("k1")), "copy-links")
    while True:
        by_fields = edges.groupBy("k2").agg(F.min("class").alias("class"))
        by_letters = edges.select("k1", "k2").join(by_fields, "k2").groupBy("k1").agg(F.min("class").alias("now"))
        moved = written(edges.join(by_letters, "k1").select("k1", "k2", "class", "now"), "copy-links")
        edges = moved.select("k1", "k2", F.col("now").alias("class"))
        if moved.where("class <> now").isEmpty():
            return edges.select("k1", "class").distinct().where("k1 <> class")


def copy_sets(records: DataFrame, parts_per_core: int = 4) -> DataFrame:
    """(first_row_id, row_id, n_records): each distinct row_id with its set's smallest one.

    ``records`` needs ``row_id`` and ``text``; other columns are ignored.  Two
    texts are copies if their lower-cased letters and digits are the same in
    order, or if both are tagged with the same set of fields; sets are closed
    under that relation.  A text that isn't blank but holds neither letter nor
    digit is a copy of any other such text.  Null row_ids, null and blank texts
    have no copies and don't come out; the same row_id delivered again counts
    once.  A record without copies is a set of one.

    A key is hot if it has more than 1/(4 x shuffle partitions) of the rows, so
    there are never more hot keys than 4 x partitions and their list can be
    broadcast.  Hot keys of letters are known before any join of rows by key.
    """
    spark = records.sparkSession
    keys = written(copy_keys(records), "copy-keys")
    classes = linked(keys)
    counts = keys.groupBy("k1").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.join(classes, "k1", "left").select("k1", F.coalesce("class", "k1").alias("class"), "n"), "copy-counts")
    share = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) / (parts_per_core * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot_letters = F.broadcast(counts.where(F.col("n") > share).select("k1", F.col("class").alias("hot_class")))
    hot = F.broadcast(counts.groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") > share).select("class"))
    # most rows are in no linked class: only those that are and aren't hot are joined by key
    known = keys.select("row_id", "k1").join(hot_letters, "k1", "left")
    warm_rows = known.where("hot_class is not null").select("row_id", F.col("hot_class").alias("class"))
    cold_rows = known.where("hot_class is null").select("row_id", "k1").join(classes, "k1", "left").select("row_id", F.coalesce("class", "k1").alias("class"))
    keys = warm_rows.unionByName(cold_rows)

    set_ = Window.partitionBy("class")
    cold = (
        keys.join(hot, "class", "left_anti").repartition("class").dropDuplicates(["class", "row_id"])
        .select(F.min("row_id").over(set_).alias("first_row_id"), "row_id", F.count("row_id").over(set_).alias("n_records"))
    )
    warm = keys.join(hot, "class", "left_semi").dropDuplicates(["class", "row_id"])
    salted = warm.groupBy("class", F.pmod(F.xxhash64("row_id"), F.lit(64)).alias("salt")).agg(F.min("row_id").alias("first_row_id"), F.count("row_id").alias("n"))
    heads = salted.groupBy("class").agg(F.min("first_row_id").alias("first_row_id"), F.sum("n").alias("n_records"))
    return cold.unionByName(warm.join(F.broadcast(heads), "class").select("first_row_id", "row_id", "n_records"))


def collapsed(sets: DataFrame) -> DataFrame:
    """One record of each set: (row_id, n_records)."""
    return sets.where("row_id = first_row_id").select("row_id", "n_records")


def found(sets: DataFrame) -> DataFrame:
    """(first_row_id, row_id) of all but the first record of each set of two or more."""
    return sets.where("row_id <> first_row_id").select("first_row_id", "row_id")
