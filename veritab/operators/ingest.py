"""Validation of incoming labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.text import content_id, is_blank, row_id

CLASSES = 4

#: Each rule and when a row breaks it.
RULES = {
    "blank_text": lambda: is_blank(F.col("text")),
    "missing_label": lambda: F.col("label").isNull(),
    "label_out_of_range": lambda: F.coalesce(~F.col("label").between(0, CLASSES - 1), F.lit(False)),
    "missing_index": lambda: F.col("source_index").isNull(),
}


def broken_rules() -> Column:
    """The names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(rule(), F.lit(name)) for name, rule in RULES.items()]))


def violations(rows: DataFrame, key: str = "source_index") -> DataFrame:
    """(row_key, rule): one row for each rule a row breaks; repeated rows report again."""
    return rows.select(F.col(key).alias("row_key"), F.explode(broken_rules()).alias("rule"))


def label_is_integer(kind: str) -> bool:
    """Whether a column type can hold labels: integers, but not booleans or fractions."""
    return kind in ("tinyint", "smallint", "int", "bigint")


def require_schema(rows: DataFrame) -> None:
    kinds = dict(rows.dtypes)
    if missing := [c for c in ("text", "label", "source_index") if c not in kinds]:
        raise ValueError(f"rows lack the columns {missing}")
    if kinds["text"] != "string" or not label_is_integer(kinds["label"]):
        raise ValueError(f"text must be a string and label an integer, not {kinds['text']} and {kinds['label']}")


def identified(rows: DataFrame, split: str = "train", texts: bool = False) -> DataFrame:
    """(row_id, content_id, label, source_index[, text]) of the valid rows, each once.

    Rows that break a rule are left out; see violations().  A row delivered again
    has the same id and comes out once.  Without ``texts`` only hashes are shuffled.
    """
    require_schema(rows)
    good = rows.where(F.size(broken_rules()) == 0)
    made = good.select(
        row_id(split, F.col("source_index"), F.col("label"), F.col("text")).alias("row_id"), content_id(F.col("text")).alias("content_id"),
        F.col("label").cast("int").alias("label"), F.col("source_index").cast("bigint").alias("source_index"), *(["text"] if texts else []),
    )
    return made.distinct()  # all columns follow from the row_id, so this hashes where dropDuplicates would sort


def with_texts(members: DataFrame, rows: DataFrame, split: str = "train") -> DataFrame:
    """``members``, some of identified(rows), with their texts: only theirs are shuffled."""
    good = rows.where(F.size(broken_rules()) == 0)
    texts = good.select(row_id(split, F.col("source_index"), F.col("label"), F.col("text")).alias("row_id"), "text")
    return members.join(texts, "row_id").dropDuplicates(["row_id"])


def strict(rows: DataFrame) -> DataFrame:
    """The rows as they are; reading an invalid one is an error that names it."""
    broken = broken_rules()
    message = F.concat(F.lit("row "), F.coalesce(F.col("source_index").cast("string"), F.lit("?")), F.lit(": "), F.array_join(broken, ", "))
    return rows.where(F.when(F.size(broken) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
