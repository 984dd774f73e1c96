"""Connected groups of links, and joins of rows by keys of which some are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.session import written

#: Parts of a hot key's rows.
SALTS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches.

    Labels are passed to neighbours and then looked up at the label itself, which
    about halves what is left of a chain each round; every round is a written table.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        passed = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("label"))
        jumped = passed.join(labels.select(F.col("node").alias("label"), F.col("component").alias("next")), "label", "left")
        now = written(jumped.select("node", F.col("component").alias("before"), F.least("label", F.coalesce("next", "label")).alias("component")), "components")
        labels = now.select("node", "component")
        if now.where("before <> component").isEmpty():
            return labels


def hot_keys(rows: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """(key) of more than 1/(4 x shuffle partitions) of the rows: never more than 4 x partitions, so it is broadcast."""
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(counts.where(F.col("n") > max(least, total / (4 * parts))).select(key))


def by_key(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """The inner join of rows and values by key, the rows of hot keys spread over SALTS tasks by ``spread``.

    ``values`` are repeated for each of these tasks, so they should be few for a hot key.
    """
    flag = hot.withColumn("_hot", F.lit(True))
    salted = rows.join(flag, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = values.join(flag, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
