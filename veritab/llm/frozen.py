"""A reproducible sample that stays as it is when data grows: frozen batch bottom-k.

Records arrive in batches that never change once they have arrived.  Within each
batch exactly ceil(rate x size) records with the smallest salted hashes are kept.
What a batch contributes depends on that batch and the seed alone, so the union
over batches only ever grows.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.functions.text import SPACE
from veritab.operators.bottomk import bottom_k, unit_hash
from veritab.session import written

#: Share of each arrival batch that is kept.
RATE = 0.05


def clean_id(row_id: Column) -> Column:
    """A row_id in lower case and without white space around it; null if nothing is left."""
    bare = F.lower(F.regexp_replace(row_id, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(bare != "", bare)


def utc_month(moment: Column) -> Column:
    """The first day of the UTC month of a timestamp, whatever the session's time zone."""
    return F.trunc(F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86_400).cast("int")), "month")


def arrivals(records: DataFrame) -> DataFrame:
    """(key, row_id, source_index, dataset_revision, batch) of each record with a revision once.

    Revision and batch are those of the first delivery that names a revision, so
    no later delivery moves a record; of deliveries at one time the smallest
    revision holds, and of source_index the smallest that isn't null.  The batch
    is the UTC month of arrival, closed once it is over.  A record without row_id
    is identified by its source_index; one with neither is dropped.  A null
    arrival is a batch of its own.
    """
    key = F.coalesce(F.col("row_id"), F.concat(F.lit("#"), F.col("source_index").cast("string")))
    first = F.min(F.when(F.col("dataset_revision").isNotNull(), F.struct(F.col("ingested_at").isNull().alias("unknown"), "ingested_at", "dataset_revision"))).alias("first")
    return (
        records.select(key.alias("key"), "row_id", "source_index", "dataset_revision", "ingested_at").where(F.col("key").isNotNull())
        .groupBy("key").agg(F.min("row_id").alias("row_id"), F.min("source_index").alias("source_index"), first).where("first is not null")
        .select("key", "row_id", "source_index", "first.dataset_revision", utc_month(F.col("first.ingested_at")).alias("batch"))
    )


def latest_arrival(records: DataFrame) -> str:
    """The time of the latest arrival, to the second; 1970 if nothing has arrived."""
    seconds = records.agg(F.max(F.unix_seconds("ingested_at"))).first()[0]
    return str(datetime.fromtimestamp(seconds or 0, timezone.utc))


def frozen_sample(records: DataFrame, configs: DataFrame, rate: float = RATE, closed_at: str | None = None) -> DataFrame:
    """(config_id, seed, row_id, source_index, batch): the sample of each config's revision.

    A batch may only be drawn from once nothing more can arrive in it.  With
    ``closed_at``, an ISO timestamp in UTC unless it names a zone, batches that end
    later, and records without an arrival, are left for a later release; without
    it all batches are taken as closed.  ``configs`` has config_id, seed and dataset_revision.  A record's hash depends
    on its key and the seed only.  A null revision or seed draws nothing; a batch
    of one record is kept (ceil); repeated configs count once; an empty table
    gives an empty sample.
    """
    records = arrivals(records)
    if closed_at is not None:
        records = records.where(F.col("batch") < F.lit(closing_month(closed_at)))
    return drawn_of(written(records, "frozen-arrivals"), configs, rate)


def closing_month(closed_at: str) -> date:
    """The UTC month that is still open at a time."""
    end = datetime.fromisoformat(closed_at)
    return (end.astimezone(timezone.utc) if end.tzinfo else end).date().replace(day=1)


def bottom_of_batches(records: DataFrame, groups: list[str], rate: float, hashed: Column, tie: str) -> DataFrame:
    """The rows of each batch that are kept: ceil(rate x size) of the smallest hashes.

    ``groups`` name the columns that make a batch; other columns stay.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    wanted = F.ceil(F.lit(rate) * F.col("_size") - F.lit(1e-9)).cast("long")
    sizes = records.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.count(F.lit(1)).alias("_size")).withColumn("_k", wanted)
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & records[g].eqNullSafe(sizes[f"_g{i}"])
    sized = records.join(sizes, same).withColumn("_u", hashed)
    return bottom_k(sized, groups, "_k", "_size", "_u", tie).select(*records.columns)


def drawn_of(records: DataFrame, configs: DataFrame, rate: float) -> DataFrame:
    """(config_id, seed, row_id, source_index, batch) drawn from the batches of (key, ..., dataset_revision, batch)."""
    configs = configs.where(F.col("seed").isNotNull()).select("config_id", "seed", "dataset_revision").distinct()
    mine = records.join(configs, "dataset_revision")
    hashed = unit_hash(F.col("seed").cast("long"), F.lit("frozen"), F.col("key"))
    return bottom_of_batches(mine, ["config_id", "batch"], rate, hashed, "key").select("config_id", "seed", "row_id", "source_index", "batch")


def released(ledger: str, spark: SparkSession) -> list[str]:
    """The closing months of the releases that a ledger holds, in order."""
    place, files = _folder(spark, f"{ledger}/releases")
    if not files.exists(place):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(place))


def _folder(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(records: DataFrame, configs: DataFrame, ledger: str, closed_at: str, rate: float = RATE) -> DataFrame:
    """Draw the batches that closed since the last release, and return the whole sample.

    The ledger is a folder of the cluster: ``seen`` holds each record that belongs
    to a drawn batch, with that batch, ``sample`` what was drawn of it; both only
    grow.  A batch is drawn once.  Whatever comes later doesn't change it: a record
    delivered again, be it with an earlier arrival or another revision, keeps its
    batch, and one that is new though its month is drawn already, or whose arrival
    isn't known, joins the first month after the last release.  A release of a
    month that the ledger holds already changes nothing.  A config draws from the
    batches of its revision that close after it was made.  A release that was cut off is drawn
    again, as only a finished one leaves its mark.
    """
    spark, month = records.sparkSession, closing_month(closed_at)
    before = released(ledger, spark)
    kinds = {"seen": "key string, dataset_revision string, batch date", "sample": "config_id bigint, seed int, row_id string, source_index bigint, batch date"}

    def held(name: str) -> DataFrame:
        out = spark.createDataFrame([], kinds[name])
        return out if not before else spark.read.schema(kinds[name]).parquet(*[f"{ledger}/{name}/{m}" for m in before])

    if not before or str(month) > before[-1]:
        rows = arrivals(records).join(held("seen").select("key"), "key", "left_anti")
        if before:
            opened = F.lit(before[-1]).cast("date")
            rows = rows.withColumn("batch", F.greatest(F.coalesce("batch", opened), opened))
        new = written(rows.where(F.col("batch") < F.lit(month)), "frozen-new")
        drawn_of(new, configs, rate).write.mode("overwrite").parquet(f"{ledger}/sample/{month}")
        new.select("key", "dataset_revision", "batch").write.mode("overwrite").parquet(f"{ledger}/seen/{month}")
        place, files = _folder(spark, f"{ledger}/releases/{month}")
        files.create(place, True).close()
        before.append(str(month))
    return held("sample")


def lost_members(members: DataFrame, records: DataFrame) -> DataFrame:
    """(config_id, release_no, row_id): members of an earlier release that this one lost.

    What each release had first is an immutable batch, and the union of the batches
    up to a release is what it should hold.  Every member counts, so nothing is
    drawn here: a share below 1 of a batch can leave lost members out, and a
    share of 1 is the batch itself.  A sample that only grows, as the frozen one,
    gives no row.  A member is its cleaned row_id or, where that is null, the
    record with its source_index; members whose record is gone and repeated rows
    don't count.  Releases are those of the same config and seed with any row at
    all, so a release whose members are all gone loses every earlier member.  Null
    config, release or seed belong to no release.
    """
    members = members.where(F.col("config_id").isNotNull() & F.col("release_no").isNotNull() & F.col("seed").isNotNull())
    members = members.select("config_id", "seed", "release_no", clean_id(F.col("row_id")).alias("id"), "source_index")
    known = records.select("row_id", "source_index").where(F.col("row_id").isNotNull())
    by_id = known.select(clean_id(F.col("row_id")).alias("id"), "row_id").distinct()
    by_index = known.where(F.col("source_index").isNotNull()).distinct()
    present = (
        members.where(F.col("id").isNotNull()).drop("source_index").join(by_id, "id").select("config_id", "seed", "release_no", "row_id")
        .unionByName(members.where(F.col("id").isNull()).join(by_index, "source_index").select("config_id", "seed", "release_no", "row_id"))
    )
    # the batch of a member is the release that first has it; it belongs to all later ones
    held = present.groupBy("config_id", "seed", "row_id").agg(F.collect_set("release_no").alias("drawn")).withColumn("batch", F.array_min("drawn"))
    releases = members.groupBy("config_id", "seed").agg(F.collect_set("release_no").alias("releases"))
    later = F.filter(F.array_except("releases", "drawn"), lambda r: r > F.col("batch"))
    return held.join(releases, ["config_id", "seed"]).select("config_id", F.explode(later).alias("release_no"), "row_id")
