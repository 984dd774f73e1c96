"""Hash-ordered, class-balanced development splits and what describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veritab.config import DataConfig
from veritab.functions.text import CLASS_NAMES, hash_fraction, order_hash
from veritab.operators.bottomk import bottom_k
from veritab.session import written


def class_counts(rows: DataFrame, by: list[str] | None = None, classes: int = len(CLASS_NAMES)) -> DataFrame:
    """(*by, label, rows): every class with its count, zeros kept."""
    by = by or []
    spark = rows.sparkSession
    every = spark.range(classes).select(F.col("id").cast("int").alias("label"))
    if by:
        every = rows.select(*by).distinct().withColumn("label", F.explode(F.array(*[F.lit(k) for k in range(classes)])))
    counted = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("rows"))
    return every.join(counted, [*by, "label"], "left").select(*by, "label", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def development_split(rows: DataFrame, config: DataConfig) -> DataFrame:
    """``rows`` of the splits with a ``split`` column: train or validation.

    ``rows`` has row_id and label (see identified()).  The rows of each class are
    ordered by the SHA-256 of seed and row_id.  Validation is the window of
    validation_per_class ranks from validation_start_per_class (default:
    train_per_class); train is the first train_per_class of the other ranks, so
    growing the training set never moves a validation row.  A class with too few
    rows is an error when the split is read.  Only the ranks that are needed are
    sorted, so a class of any size takes no task of its own.
    """
    t, v = config.train_per_class, config.validation_per_class
    if t <= 0 or v <= 0:
        raise ValueError("split counts must be positive")
    start = t if config.validation_start_per_class is None else config.validation_start_per_class
    if start < 0:
        raise ValueError("validation_start_per_class must not be negative")
    need = max(t + v, start + v)
    # read once; texts stay out of it and are joined to the rows that are chosen
    light = [c for c in rows.columns if c != "text"]
    ids = written(rows.select(*light, order_hash(config.seed, F.col("row_id")).alias("_order")), "split-ids")
    hashed = ids.withColumn("_u", hash_fraction(F.col("_order")))
    sizes = class_counts(ids).select(F.col("label").alias("_label"), F.col("rows").alias("_size"))
    short = F.concat(F.lit("class "), F.col("_label").cast("string"), F.lit(" has "), F.col("_size").cast("string"), F.lit(f" rows; {need} required"))
    # one row over the four counts, so a class without any row is noticed too
    enough = sizes.agg(F.max(F.when(F.col("_size") < need, F.raise_error(short).cast("bigint")).otherwise(F.lit(need).cast("bigint"))).alias("_k"))
    sized = hashed.join(F.broadcast(sizes), F.col("label") == F.col("_label")).drop("_label").join(F.broadcast(enough))
    first = bottom_k(sized, ["label"], "_k", "_size", "_u", "_order")
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_order", "row_id")) - 1)
    r = F.col("_r")
    judged = (r >= start) & (r < start + v)
    trained = ~judged & (F.when(r < start, r).otherwise(r - v) < t)
    chosen = ranked.withColumn("split", F.when(judged, "validation").when(trained, "train")).where(F.col("split").isNotNull()).select(*light, "split")
    return chosen if light == rows.columns else chosen.join(rows.select("row_id", "text"), "row_id").select(*rows.columns, "split")


def split_digests(members: DataFrame, order: str = "row_id") -> DataFrame:
    """(split, rows, row_ids_sha256): SHA-256 of the ids of each split joined by line feeds.

    One task joins the ids of one split, whose size is set by the configuration;
    for a split without such a bound use digests.streamed().  A test split in
    publisher's order has ``order`` source_index.
    """
    ids = F.expr(f"listagg(row_id, '\\n') within group (order by {order})")
    return members.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sha2(ids, 256).alias("row_ids_sha256"))


def described(members: DataFrame, publisher_rows: int | DataFrame | None = None) -> DataFrame:
    """(split, rows, n_world ... n_sci_tech, row_ids_sha256, unused): the evidence of a split."""
    counts = members.groupBy("split").agg(*[F.sum((F.col("label") == k).cast("bigint")).alias(f"n_{k}") for k in range(len(CLASS_NAMES))])
    out = counts.join(split_digests(members), "split")
    used = F.sum("rows").over(Window.partitionBy(F.lit("all")))
    if isinstance(publisher_rows, DataFrame):
        all_rows = publisher_rows.agg(F.count(F.lit(1)).alias("publisher_rows"))
        return out.join(F.broadcast(all_rows)).withColumn("unused", (F.col("publisher_rows") - used).cast("bigint")).drop("publisher_rows")
    return out.withColumn("unused", (F.lit(publisher_rows).cast("bigint") - used).cast("bigint"))


def first_of_classes(members: DataFrame, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The train row of smallest row_id of each of the labels."""
    columns = [c for c in members.columns if c not in ("row_id", "label")]
    least = F.min(F.struct("row_id", *columns)).alias("r")
    return members.where((F.col("split") == "train") & F.col("label").isin(*labels)).groupBy("label").agg(least).select("label", "r.*")
