"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm import copies, encode, frozen, neardup, oracles, overlap, packing, paragraphs, proportions, spans
from veritab.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _proportions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(_table(spark, sf_dir, t) for t in ("example", "data_config", "class_target"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose need the revision cannot meet."""
    return proportions.plan(*_proportions(spark, sf_dir)).where("unmet").select("config_id", "label")


def p1_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply and need of each config and label, and whether the sample stays short of it."""
    return proportions.plan(*_proportions(spark, sf_dir)).select("config_id", "label", "supply", F.round("need", 6).alias("need"), "unmet")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply, need and number drawn of each config and label."""
    return proportions.plan(*_proportions(spark, sf_dir))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of each config."""
    tables = _proportions(spark, sf_dir)
    return proportions.sample(*tables, written(proportions.plan(*tables), "proportions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of records whose texts are near."""
    return neardup.near_pairs(_table(spark, sf_dir, "example"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of copies and the number of classes near to it."""
    return neardup.near_classes(_table(spark, sf_dir, "example"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of records that near pairs connect."""
    return neardup.near_groups(_table(spark, sf_dir, "example"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set of copies with the number of records it stands for."""
    return copies.collapsed(copies.copy_sets(_table(spark, sf_dir, "example")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that repeats another with differences of formatting only."""
    return copies.found(copies.copy_sets(_table(spark, sf_dir, "example")))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen sample of each config; the month of the latest arrival is still open and waits."""
    configs, records = proportions.holding(_table(spark, sf_dir, "data_config")), _table(spark, sf_dir, "example")
    return frozen.frozen_sample(records, configs, closed_at=frozen.latest_arrival(records))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of earlier releases that a later release lost."""
    return frozen.lost_members(_table(spark, sf_dir, "sample_member"), _table(spark, sf_dir, "example"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged rows that repeat a train row."""
    return overlap.found(overlap.overlaps(_table(spark, sf_dir, "split_member")))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per split and source."""
    members = _table(spark, sf_dir, "split_member")
    return overlap.report(overlap.overlaps(members), members)


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near texts across splits by representatives, with the matched words."""
    return overlap.links(_table(spark, sf_dir, "split_member"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judged row with its kinds of overlap and what is matched of it."""
    return overlap.overlaps(_table(spark, sf_dir, "split_member"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode.token_ids(_table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    spec = _table(spark, sf_dir, "pack_spec").orderBy("spec_id").first()
    sizes = encode.token_counts(_table(spark, sf_dir, "documents"), encode.tokenizer_path(spec["tokenizer"]))
    return written(sizes, "sizes"), spec["capacity_tokens"]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each part of each document."""
    return packing.packed(*_sizes(spark, sf_dir))


def p7_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound, start, crossovers, migrations and result of each block."""
    return packing.evolution(*_sizes(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that must be split."""
    return packing.split_documents(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each document that stand in another one too."""
    return spans.shared_spans(_table(spark, sf_dir, "documents"))


def p8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate paragraphs, by component."""
    return paragraphs.duplicate_paragraphs(_table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of characters shared with others."""
    documents = _table(spark, sf_dir, "documents")
    return spans.shared_characters(documents, spans.shared_spans(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_needs, p1_report, p1_sample, p2_classes, p2_found, p2_groups, p3_collapsed, p3_found, p4_found, p4_sample, p5_found, p5_links, p5_report, p5_rows, p6_ids, p7_containers, p7_evolution, p7_found, p8_found, p8_paragraphs, p8_shared)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
