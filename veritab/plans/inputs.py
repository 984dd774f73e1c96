"""The inputs of the catalogue, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritab.config import DataConfig
from veritab.functions.text import SPACE, SYSTEM_PROMPT, content_id, is_blank, normalize_text, user_content
from veritab.operators.ingest import identified, with_texts
from veritab.operators.splits import development_split

SPLIT = DataConfig(seed=73, train_per_class=40, validation_per_class=12)
EXPANDED = DataConfig(seed=73, train_per_class=46, validation_per_class=12, validation_start_per_class=40)
#: The systems: places of the scores in an embedding, and what the true class gains.
SYSTEMS = {"base": (0, 0.4), "tuned": (4, 1.5)}
EPOCHS = {1: (0, 0.4), 2: (4, 0.9), 3: (8, 0.9), 4: (12, 0.7)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """(row_id, content_id, label, source_index[, text]) of the valid example records."""
    return identified(table(spark, sf_dir, "example").select("text", "label", "source_index"), "train", texts)


def development(spark: SparkSession, sf_dir: str, config: DataConfig = SPLIT, texts: bool = False) -> DataFrame:
    members = development_split(corpus(spark, sf_dir), config)
    return with_texts(members, table(spark, sf_dir, "example").select("text", "label", "source_index")) if texts else members


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, row_id, content_id, source) of split_member; names trimmed and in lower case."""
    name = F.lower(F.regexp_replace("split", f"^[{SPACE}]+|[{SPACE}]+$", ""))
    rows = table(spark, sf_dir, "split_member").where(~is_blank(F.col("text")))
    return rows.select(name.alias("split"), "row_id", content_id(F.col("text")).alias("content_id"), "source").where("split is not null")


def logits(spark: SparkSession, sf_dir: str, systems: dict = SYSTEMS, name: str = "system") -> DataFrame:
    """(system, pos, label, z) of both systems: one scan, the systems unfolded."""
    embeddings = table(spark, sf_dir, "embeddings")
    label = (F.col("label") % 4).cast("int")

    def z(offset: int, margin: float):
        return F.array(*[(F.lit(8.0) * F.get("embedding", F.lit(offset + k)).cast("double") + F.lit(margin) * (label == k).cast("int")).cast("float") for k in range(4)])

    each = F.explode(F.array(*[F.struct(F.lit(s).alias(name), z(*at).alias("z")) for s, at in systems.items()])).alias("x")
    return embeddings.select(F.col("vec_id").cast("bigint").alias("pos"), label.alias("label"), each).select(f"x.{name}", "pos", "label", "x.z")


def line_predictions(spark: SparkSession, sf_dir: str, invalid: bool = False) -> DataFrame:
    """(label, base, tuned) of every lineitem, by arithmetic; ``invalid`` puts some base predictions out of range."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey", "l_suppkey")
    label = (F.col("l_linenumber") % 4).cast("int")
    base = F.when(F.col("l_partkey") % 10 < 7, label).otherwise((label + 1) % 4)
    if invalid:
        base = F.when(F.col("l_partkey") % 50 == 0, 9).otherwise(base)
    tuned = F.when(F.col("l_suppkey") % 20 < 18, label).otherwise((label + 2) % 4)
    return lines.select(label.alias("label"), base.alias("base"), tuned.alias("tuned"))


def prompt_lengths(members: DataFrame) -> DataFrame:
    """(split, row_id, n_tokens): words of system prompt and user message, answer and end."""
    whole = normalize_text(F.concat(F.lit(SYSTEM_PROMPT + " "), user_content(F.col("text"))))
    return members.select("split", "row_id", (F.size(F.split(whole, " ")) + 2).cast("bigint").alias("n_tokens"))


def word_ids(text: Column) -> Column:
    """Stable ids of a text's words: 20 plus the first 16 bits of SHA-256."""
    return F.transform(F.split(normalize_text(text), " "), lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 4), 16, 10).cast("int") + 20))


# The same inputs in SQL.

NORM = f"regexp_replace(regexp_replace(text, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"
FILLED = f"coalesce(regexp_matches(text, '[^{SPACE}]'), false)"
CORPUS = f"""corpus as (
  select distinct sha256('train' || chr(0) || source_index || chr(0) || label || chr(0) || text) as row_id, sha256({NORM}) as content_id, label, source_index, text
  from example where {FILLED} and label between 0 and 3 and source_index is not null)"""


def development_sql(config: DataConfig = SPLIT) -> str:
    t, v = config.train_per_class, config.validation_per_class
    s = t if config.validation_start_per_class is None else config.validation_start_per_class
    return f"""{CORPUS}, ranked as (
      select *, row_number() over (partition by label order by sha256('{config.seed}' || chr(0) || row_id), row_id) - 1 as r from corpus),
    dev as (
      select *, case when r >= {s} and r < {s + v} then 'validation' when (case when r < {s} then r else r - {v} end) < {t} then 'train' end as split from ranked),
    members as (select * exclude (r) from dev where split is not null)"""


PUBLISHED = f"""published as (
  select lower(regexp_replace(split, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) as split, row_id, sha256({NORM}) as content_id, source
  from split_member where {FILLED} and split is not null)"""


def logits_sql(systems: dict = SYSTEMS, name: str = "system") -> str:
    parts = []
    for s, (offset, margin) in systems.items():
        z = ", ".join(f"(8.0::double * embedding[{offset + k + 1}]::double + {margin}::double * ((label % 4) = {k})::int)::float" for k in range(4))
        parts.append(f"select {s!r} as {name}, vec_id as pos, (label % 4)::int as label, [{z}] as z from embeddings")
    return "logits as (" + " union all ".join(parts) + ")"


def scores_sql(temperature: float | str = 1.0) -> str:
    """p, pred, confidence, correct, loss from ``logits``."""
    return f"""divided as (select *, list_transform(z, lambda v: ((v::double / (({temperature})::float)::double)::float)::double) as q from logits),
    powers as (select *, list_transform(q, lambda v: exp(v - list_max(q))) as e from divided),
    probs as (select *, list_transform(e, lambda v: v / (e[1] + e[2] + e[3] + e[4])) as p from powers),
    scored as (select *, list_position(p, list_max(p)) - 1 as pred, list_max(p) as confidence,
      (list_position(p, list_max(p)) - 1 = label) as correct, -ln(greatest(1e-12, least(1.0, p[label + 1]))) as loss from probs)"""


BINS = 15
EDGES = "[" + ", ".join(repr(i * (1.0 / BINS)) for i in range(BINS)) + ", 1.0]::double[]"
BIN = f"greatest(0, len(list_filter({EDGES}, lambda e: e < confidence)) - 1)"

LINES = """lines as (
  select (l_linenumber % 4)::int as label, case when l_partkey % 10 < 7 then l_linenumber % 4 else (l_linenumber % 4 + 1) % 4 end as base,
    case when l_suppkey % 20 < 18 then l_linenumber % 4 else (l_linenumber % 4 + 2) % 4 end as tuned, l_partkey from lineitem)"""


def cells_sql(source: str, by: str = "", pred: str = "pred") -> str:
    """Counts of each class in ``source``, by an optional column."""
    group = f"{by}, " if by else ""
    each = ", ".join(f"count(*) filter (where label = {k} and {pred} = {k}) as tp{k}, count(*) filter (where label = {k}) as truth{k}, count(*) filter (where {pred} = {k}) as guess{k}" for k in range(4))
    return f"select {group}count(*) as rows, count(*) filter (where label = {pred}) as correct, count(*) filter (where {pred} not between 0 and 3) as invalid, {each} from {source}" + (f" group by {by}" if by else "")


def f1_sql(k: int) -> str:
    return f"(case when truth{k} + guess{k} > 0 then 2.0::double * tp{k} / (truth{k} + guess{k}) else 0 end)"


MACRO = "((" + " + ".join(f1_sql(k) for k in range(4)) + ") / 4.0)"
