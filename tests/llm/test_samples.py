import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import frozen, proportions, queries

EXAMPLE = "row_id string, text string, label int, source_index bigint, dataset_revision string, source string, published_at timestamp, ingested_at timestamp"
CONFIG = "config_id bigint, dataset_revision string, seed int, train_per_class int, validation_per_class int, created_at timestamp"
T0 = dt.datetime(2031, 1, 1)


def example(rows):
    return [(i, t, y, k, r, "s", T0, T0 + dt.timedelta(days=d)) for i, t, y, k, r, d in rows]


def records(n, seed=0, days=90):
    rng = random.Random(seed)
    return example([(f"{k:05d}", "text", rng.choice([0, 0, 0, 1, 1, 2, 3, None, 9]), k, rng.choice(["big", "big", "small", None]), rng.randrange(days)) for k in range(n)])


def make(spark, rows, kind=EXAMPLE):
    df = spark.createDataFrame(rows, kind)
    return df.select("*", *[F.lit(1).alias(c) for c in ("k", "size", "u", "key", "batch") if c not in df.columns]).repartition(4)


def configs(spark, rows):
    return spark.createDataFrame([(*r, T0 + dt.timedelta(days=i)) for i, r in enumerate(rows)], CONFIG)


def test_proportions(spark):
    rows = records(3000)
    rows += rows[:200] + example([("blank", " ", 0, 9999, "small", 1), ("null", None, 0, 9998, "small", 1)])
    df = make(spark, rows)
    held = configs(spark, [(1, "big", 1, 10, 10), (1, "big", 7, 100, 25), (2, "small", 7, 30, 5), (3, "absent", 7, 5, 5), (1, "big", 7, 100, 25), (4, "small", None, 200, 50)])
    targets = spark.createDataFrame([(1, 0, 0.7, None), (1, 1, 0.2, 60), (1, 2, None, 40), (1, 3, 0.02, None), (1, 3, 0.02, None), (2, 0, 0.25, None), (2, 1, 5.0, 9), (3, 0, 0.5, 2), (3, 1, None, None), (4, 0, 0.25, 3), (4, 1, 0.25, 3), (9, 1, 0.5, 1)], "config_id bigint, label int, target_share double, min_rows int")
    report = {(r["config_id"], r["label"]): r for r in proportions.plan(df, held, targets).collect()}
    supply = {}
    for r in {(x[0], x[4], x[2]) for x in rows if x[1] and x[1].strip()}:
        supply[r[1:]] = supply.get(r[1:], 0) + 1
    assert set(report) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)}
    assert all(r["supply"] == supply.get(({1: "big", 2: "small", 3: "absent", 4: "small"}[c], y), 0) for (c, y), r in report.items())
    assert {k for k, r in report.items() if r["unmet"]} == {k for k, r in report.items() if r["need"] > r["supply"]} >= {(2, 1), (3, 0), (4, 0)}
    assert report[1, 0]["need"] == pytest.approx(350) and report[1, 1]["need"] == pytest.approx(100)
    assert report[1, 2]["drawn"] >= 40 and abs(report[1, 0]["drawn"] - 350) <= 1 and report[3, 0]["drawn"] == 0
    kept = spark.createDataFrame(proportions.plan(df, held, targets).collect(), proportions.REPORT)
    drawn = proportions.sample(df, held, targets, kept).collect()
    counts = {}
    for r in drawn:
        counts[r["config_id"], r["label"]] = counts.get((r["config_id"], r["label"]), 0) + 1
    assert counts == {k: r["drawn"] for k, r in report.items() if r["drawn"]}
    assert len({tuple(r) for r in drawn}) == len(drawn)
    assert proportions.plan(df.limit(0), held, targets).where("drawn > 0").count() == 0
    assert proportions.plan(df, held.limit(0), targets).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_repair_finds_the_best_counts(seed):
    rng = np.random.default_rng(seed)
    k = 3
    supply, floor = rng.integers(0, 14, k), rng.integers(0, 6, k)
    share = rng.dirichlet(np.ones(k))
    if seed % 2:
        share[0] = np.nan
    size = int(rng.integers(1, 20))
    got = proportions.repaired(supply, share, floor, size, seed)
    floor = np.minimum(floor, supply)
    want = max(min(size, supply.sum()), floor.sum())
    assert got.sum() == want and (got >= floor).all() and (got <= supply).all()
    goal = np.where(np.isnan(share), 0, share * want)

    def deviation(c):
        return np.abs(c - goal)[~np.isnan(share)].sum()

    every = [np.array(c) for c in np.ndindex(*(supply + 1)) if sum(c) == want and (np.array(c) >= floor).all()]
    assert deviation(got) == pytest.approx(min(map(deviation, every)))


def test_frozen_sample_only_grows(spark):
    rows = records(2000, days=120)
    again = [(*r[:7], r[7] + dt.timedelta(days=200)) for r in rows[:300]]
    held = spark.createDataFrame([(1, 73, "big"), (2, 5, "small"), (1, 73, "big"), (3, None, "big")], "config_id bigint, seed int, dataset_revision string")

    def sample(rs, rate=0.1):
        return {(r["config_id"], r["row_id"]) for r in frozen.frozen_sample(make(spark, rs), held, rate).collect()}

    whole = sample(rows + again)
    assert whole == sample(rows + again + again) == sample(list(reversed(rows)))
    cut = T0 + dt.timedelta(days=59)  # the first two months have arrived
    early = sample([r for r in rows if r[7] < cut])
    assert early and early < whole
    size = {}
    for r in rows:
        if r[4] is not None:
            size[r[4], r[7].month] = size.get((r[4], r[7].month), 0) + 1
    expected = sum(-(-n // 10) for n in size.values())
    assert len(whole) == expected
    assert sample([]) == set()
    with pytest.raises(ValueError):
        sample(rows, 0)


def test_an_open_month_waits(spark):
    rows = records(900, 8, days=80)
    held = spark.createDataFrame([(1, 73, "big")], "config_id bigint, seed int, dataset_revision string")
    whole = {r["row_id"] for r in frozen.frozen_sample(make(spark, rows), held, 0.1).collect()}
    for day in (40, 50, 58, 59, 70):
        now = T0 + dt.timedelta(days=day)
        df = make(spark, [r for r in rows if r[7] < now])
        drawn = frozen.frozen_sample(df, held, 0.1, closed_at=str(now)).collect()
        assert {r["row_id"] for r in drawn} <= whole and {r["batch"].month for r in drawn} == ({1, 2} if day >= 59 else {1})


def test_lost_members(spark):
    known = example([(f"ID{k}" if k % 2 else f"id{k}", "t", 0, k, "r", 1) for k in range(8)] + [(None, "t", 0, 99, "r", 1)])
    members = [
        (1, 1, 7, "id0", 0), (1, 1, 7, " Id1\n", 1), (1, 1, 7, None, 2), (1, 1, 7, "gone", 50), (1, 3, 7, "ID0", None), (1, 3, 7, "ID0", None), (1, 4, 7, "id2", 2), (1, 4, 8, "id4", 4), (1, 9, 8, "gone", 3),
        (2, 1, 7, "id5", 5), (2, 2, 7, "id5", 5), (None, 1, 7, "id6", 6), (3, None, 7, "id6", 6), (1, 1, 7, None, 99), (1, 5, 7, "", 1),
    ]
    df = spark.createDataFrame([(*m, T0) for m in members], "config_id bigint, release_no int, seed int, row_id string, source_index bigint, drawn_at timestamp").withColumn("id", F.lit("x"))
    found = sorted(tuple(r) for r in frozen.lost_members(df, make(spark, known)).collect())
    # release 5 has ID1 by its index, release 9 of the other seed lost id4
    assert found == sorted([(1, 3, "ID1"), (1, 3, "id2"), (1, 4, "id0"), (1, 4, "ID1"), (1, 5, "id0"), (1, 5, "id2"), (1, 9, "id4")])
    assert frozen.lost_members(df.limit(0), make(spark, known)).count() == 0
    assert frozen.lost_members(df, make(spark, known).limit(0)).count() == 0


def test_no_draw_decides_which_losses_are_found(spark, monkeypatch):
    drawing = frozen.bottom_of_batches
    monkeypatch.setattr(frozen, "bottom_of_batches", lambda rows, groups, rate, hashed, tie: drawing(rows, groups, frozen.RATE, hashed, tie))
    known = example([(f"id{k:02d}", "t", 0, k, "r", 1) for k in range(60)])
    members = [(1, 1, 7, f"id{k:02d}", k) for k in range(60)] + [(1, 2, 7, "gone", 99)]
    df = spark.createDataFrame(members, "config_id bigint, release_no int, seed int, row_id string, source_index bigint")
    assert sorted(tuple(r) for r in frozen.lost_members(df, make(spark, known)).collect()) == [(1, 2, f"id{k:02d}") for k in range(60)]


def test_the_frozen_sample_never_loses_a_member(spark):
    rows = records(1500, 4, days=120)
    held = spark.createDataFrame([(1, 73, "big"), (2, 5, "small")], "config_id bigint, seed int, dataset_revision string")
    releases = None
    for no, day in enumerate((31, 59, 90, 200)):
        now = frozen.frozen_sample(make(spark, [r for r in rows if r[7] < T0 + dt.timedelta(days=day)]), held, 0.2)
        one = now.select("config_id", F.lit(no).alias("release_no"), "seed", "row_id", "source_index")
        releases = one if releases is None else releases.unionAll(one)
    assert frozen.lost_members(releases, make(spark, rows)).count() == 0


def test_the_registered_sample_never_loses_a_member(spark, tmp_path):
    rows = records(3000, 5, days=120)
    # delivered again later, under a smaller revision
    rows += [(*r[:4], "a", *r[5:7], r[7] + dt.timedelta(days=45)) for r in rows[:150]]
    configs(spark, [(1, "big", 73, 10, 10), (2, "small", 5, 10, 10), (3, "a", 9, 10, 10)]).write.parquet(f"{tmp_path}/data_config.parquet")
    releases, drawn = None, []
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for no, (day, other) in enumerate(((20, "UTC"), (40, "UTC"), (50, "Asia/Tokyo"), (75, "America/Los_Angeles"), (100, "UTC"), (200, "Asia/Tokyo"))):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            (tmp_path / str(no)).mkdir()
            (tmp_path / str(no) / "data_config.parquet").symlink_to(tmp_path / "data_config.parquet")
            make(spark, [r for r in rows if r[7] < T0 + dt.timedelta(days=day, hours=1)]).drop("batch").write.parquet(f"{tmp_path}/{no}/example.parquet")
            spark.conf.set("spark.sql.session.timeZone", other)
            now = spark.createDataFrame(queries.p4_sample(spark, f"{tmp_path}/{no}").collect(), "config_id bigint, seed int, row_id string, source_index bigint, batch date")
            drawn.append({r["batch"] for r in now.select("batch").distinct().collect()})
            one = now.select("config_id", F.lit(no).alias("release_no"), "seed", "row_id", "source_index")
            releases = one if releases is None else releases.unionAll(one)
        assert frozen.lost_members(releases, make(spark, rows)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    months = [dt.date(2031, m, 1) for m in (1, 2, 3, 4, 5, 6)]
    assert drawn == [set(months[:n]) for n in (0, 1, 1, 2, 3, 5)]


def test_a_ledger_never_loses_a_member(spark, tmp_path):
    rng = random.Random(9)
    rows = records(1200, 6, days=120)
    held = spark.createDataFrame([(1, 73, "big"), (2, 5, "small")], "config_id bigint, seed int, dataset_revision string")
    late = set(rng.sample(range(len(rows)), 150))  # these come in a month after they arrived
    unknown = set(rng.sample(range(len(rows)), 40))
    rows = [(*r[:7], None if k in unknown else r[7]) for k, r in enumerate(rows)]
    ledger, before, drawn_rows = str(tmp_path / "ledger"), set(), []
    for day in (31, 40, 59, 90, 120, 150):
        now = T0 + dt.timedelta(days=day)
        here = [r for k, r in enumerate(rows) if (r[7] or T0) < now - dt.timedelta(days=30 * (k in late))]
        # records of drawn batches again, as if earlier and under a smaller revision
        again = [(*r[:4], "a" if r[4] else None, *r[5:7], T0 - dt.timedelta(days=rng.randrange(90))) for r in rng.sample(drawn_rows, len(drawn_rows) // 3)]
        out = frozen.release(make(spark, here + again), held, ledger, str(now), 0.1).collect()
        drawn = {(r["config_id"], r["row_id"]) for r in out}
        assert len(drawn) == len(out) and before <= drawn
        assert all(r["batch"] < now.date().replace(day=1) for r in out)
        if day in (40, 150):
            assert drawn == before, "the month isn't over"
        before, drawn_rows = drawn, [r for r in here if r[7] and r[7] < T0 + dt.timedelta(days=31)]
    seen = spark.read.parquet(*[f"{ledger}/seen/{m}" for m in frozen.released(ledger, spark)])
    assert seen.count() == seen.select("key").distinct().count()
    # each batch keeps exactly its share
    sizes = {(r["dataset_revision"], r["batch"]): r["count"] for r in seen.groupBy("dataset_revision", "batch").count().collect()}
    kept = {}
    for r in out:
        kept[{1: "big", 2: "small"}[r["config_id"]], r["batch"]] = kept.get(({1: "big", 2: "small"}[r["config_id"]], r["batch"]), 0) + 1
    assert kept == {k: -(-n // 10) for k, n in sizes.items() if k[0] in ("big", "small")}
    assert frozen.released(ledger, spark) == [f"2031-0{m}-01" for m in (2, 3, 4, 5)]
    # all that came in before the last release is in a drawn batch
    assert {r["key"] for r in seen.collect()} >= {r[0] for r in here if r[4] and r[7] and r[7] < T0 + dt.timedelta(days=90)}
