"""A sample whose categories have given shares: swap repair over category signatures.

Records are grouped by their category signature, so the search works on a few
counts instead of on records: it starts from a random sample that satisfies the
floors, exchanges counts between signatures as long as an exchange lowers the
deviation from the targets, and materialises the final counts by random draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritab.functions.text import is_blank
from veritab.operators.bottomk import bottom_k, unit_hash

REPORT = "config_id bigint, label int, supply bigint, share double, min_rows int, size bigint, need double, drawn bigint, unmet boolean"


def holding(configs: DataFrame) -> DataFrame:
    """Of each config_id the row with the latest created_at; of equal ones the greatest."""
    names = [c for c in configs.columns if c not in ("config_id", "created_at")]
    newest = F.max(F.struct("created_at", *names)).alias("r")
    return configs.where(F.col("config_id").isNotNull()).groupBy("config_id").agg(newest).select("config_id", "r.*")


def repaired(supply: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Counts of each signature in a sample of ``size`` (or of all there is).

    ``share`` is nan where a signature has no target.  The deviation is the sum
    of |count - share * size| over targets.  Floors beyond the supply are cut to
    it; if the floors alone exceed the size, they win.
    """
    rng = np.random.default_rng(seed)
    floor = np.minimum(floor, supply)
    size = int(max(min(size, supply.sum()), floor.sum()))
    count = floor.copy()
    if (spare := size - int(count.sum())) > 0:
        left = supply - floor
        while spare > 0:  # random fill; numpy's exact draw wants less than 10^9 records
            take = rng.multivariate_hypergeometric(left, spare) if left.sum() < 10**9 else np.minimum(rng.multinomial(spare, left / left.sum()), left)
            count, left, spare = count + take, left - take, spare - int(take.sum())
    goal = np.where(np.isnan(share), 0, share * size)
    aimed = ~np.isnan(share)

    def deviation(i: int, n: int) -> float:
        return abs(n - goal[i]) if aimed[i] else 0.0

    step = 1 << max(0, int(size).bit_length() - 1)
    while step:
        best = 0.0
        for a in np.flatnonzero(count - step >= floor):
            gain_a = deviation(a, count[a]) - deviation(a, count[a] - step)
            for b in np.flatnonzero(count + step <= supply):
                if a != b and (gain := gain_a + deviation(b, count[b]) - deviation(b, count[b] + step)) > best + 1e-9:
                    best, swap = gain, (a, b)
        if best > 0:
            count[swap[0]] -= step
            count[swap[1]] += step
        else:
            step //= 2
    return count


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("label").reset_index(drop=True)
    supply, need = rows["supply"].to_numpy(np.int64), rows["need"].to_numpy(float)
    # a label that can't get what it needs is drawn whole
    floor = np.where(need > supply, supply, rows["min_rows"].fillna(0).clip(lower=0).to_numpy(np.int64))
    size = int(rows["size"].iloc[0])
    # the config's id as well, so that configs with one seed don't all start alike
    seed = [int(rows["seed"].fillna(0).iloc[0]) & 0xFFFFFFFF, int(rows["config_id"].iloc[0]) & 0xFFFFFFFF]
    drawn = repaired(supply, rows["share"].to_numpy(float), floor, size, seed)
    # what the repaired sample lacks although nothing is left to exchange for it
    return rows.assign(drawn=drawn, unmet=(drawn == supply) & (drawn < need))[[c.split()[0] for c in REPORT.split(", ")]]


def pool(records: DataFrame) -> DataFrame:
    """(dataset_revision, label, row_id): each record that can be drawn, once."""
    return (
        records.where(F.col("row_id").isNotNull() & F.col("label").isNotNull() & F.col("dataset_revision").isNotNull() & ~is_blank(F.col("text")))
        .select("dataset_revision", "label", "row_id").distinct()
    )


def plan(records: DataFrame, configs: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: for each config and label its supply, need and number drawn.

    The need is the larger of min_rows and share x size, null counting as 0, not
    rounded; ``unmet`` marks the labels that the repaired sample holds whole and
    still short of their need, which are those whose need exceeds the supply.  Of each
    config_id the latest row holds; of repeated targets of a label the larger
    values hold.  Records are drawn from the labels named in targets only; a label
    whose share is null fills the sample up.
    A config without targets or with a null size isn't planned; an empty revision
    draws nothing and leaves every positive need unmet.
    """
    size = 4 * (F.coalesce("train_per_class", F.lit(0)) + F.coalesce("validation_per_class", F.lit(0)))
    configs = holding(configs).select("config_id", "dataset_revision", "seed", size.cast("long").alias("size"))
    targets = targets.where("label is not null").groupBy("config_id", "label").agg(F.max("target_share").alias("share"), F.max("min_rows").alias("min_rows"))
    supply = pool(records).groupBy("dataset_revision", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = configs.join(targets, "config_id").join(supply, ["dataset_revision", "label"], "left").withColumn("supply", F.coalesce("n", F.lit(0)))
    need = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce("share", F.lit(0.0)) * 4 * (F.col("size") / 4))
    # few bytes but much search: as many tasks as there are partitions, whatever the bytes
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("need", need).repartition(tasks, "config_id").groupBy("config_id").applyInPandas(_plan, REPORT)


def sample(records: DataFrame, configs: DataFrame, targets: DataFrame, report: DataFrame) -> DataFrame:
    """(config_id, label, row_id): the counts of ``report`` materialised by salted hashes."""
    configs = holding(configs).select("config_id", "dataset_revision", F.coalesce("seed", F.lit(0)).alias("seed"))
    drawn = report.where("drawn > 0").select("config_id", "label", "supply", "drawn").join(configs, "config_id")
    rows = pool(records).join(drawn, ["dataset_revision", "label"])
    rows = rows.withColumn("u", unit_hash(F.col("seed").cast("long"), F.col("config_id"), F.col("row_id")))
    return bottom_k(rows, ["config_id", "label"], "drawn", "supply", "u", "row_id").select("config_id", "label", "row_id")
