"""SHA-256 digests of ordered data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.errors import EvidenceError


def joined_digest(rows: DataFrame, by: list[str], value: str, order: str, separator: str, name: str) -> DataFrame:
    """(*by, name): the digest of the values joined in order; groups without values are left out.

    A SHA-256 is sequential: one task joins one group's values, so groups must be
    as bounded as a split or a test set is; streamed() has no such bound.
    """
    text = F.expr(f"listagg(cast({value} as string), '{separator}') within group (order by {order})")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sha2(text, 256).alias(name)).where("_n > 0").drop("_n")


def label_digest(rows: DataFrame, by: list[str], label: str = "label", order: str = "pos", name: str = "label_sha256") -> DataFrame:
    """Digest of the labels joined by commas."""
    return joined_digest(rows, by, label, order, ",", name)


def streamed(rows: DataFrame, value: str, order: str, separator: str = "\n") -> str:
    """The digest of any number of values: sorted and joined by the cluster, read partition by partition."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([separator.join(batch.column(0).to_pylist())])], ["joined"])

    digest, first = hashlib.sha256(), True
    values = rows.where(F.col(value).isNotNull()).orderBy(order).select(F.col(value).cast("string"))
    for (joined,) in values.mapInArrow(join, "joined string").toLocalIterator(prefetchPartitions=True):
        digest.update((("" if first else separator) + joined).encode())
        first = False
    if first:
        raise EvidenceError("an empty sequence has no digest")
    return digest.hexdigest()


#: Places of an array that one task digests.
CHUNK = 1 << 20


def array_digest(logits: DataFrame, by: list[str], columns: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(*by, rows, array_sha256) of z ordered by pos, as a float32 array.

    The header ``<f4``, NUL, shape, NUL precedes the little-endian values, as in
    published digests, where all places are below ``chunk``.  For larger arrays,
    each ``chunk`` places are digested in a task of their own, and the header
    precedes the digests of the chunks in order.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows.sort_values("pos")["z"].to_numpy()).astype("<f4")
        if values.shape[1] != columns or not np.isfinite(values).all():
            raise EvidenceError("scores must be finite and of the right number")
        part = hashlib.sha256(values.tobytes()).hexdigest()
        return pd.DataFrame([[*key, len(values), array_sha256(values), part]], columns=[*by, "_chunk", "_n", "_alone", "_part"])

    kinds = dict(logits.dtypes)
    rows = logits.select(*by, "pos", "z").withColumn("_chunk", F.expr(f"pos div {chunk}"))
    parts = rows.groupBy(*by, "_chunk").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "_chunk bigint", "_n bigint", "_alone string", "_part string"]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"]), "")
    whole = parts.groupBy(*by).agg(F.sum("_n").alias("rows"), F.max("_chunk").alias("_last"), F.first("_alone").alias("_alone"), joined.alias("_joined"))
    tree = F.sha2(F.concat(F.lit("<f4\0("), F.col("rows").cast("string"), F.lit(f", {columns})\0"), "_joined"), 256)
    return whole.select(*by, "rows", F.when(F.col("_last") == 0, F.col("_alone")).otherwise(tree).alias("array_sha256"))


def array_sha256(values: np.ndarray) -> str:
    values = np.ascontiguousarray(values, "<f4")
    return hashlib.sha256(f"<f4\0{values.shape}\0".encode() + values.tobytes()).hexdigest()


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def json_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def lengths_digest(lengths: DataFrame, by: list[str]) -> DataFrame:
    """(*by, token_lengths_sha256): canonical JSON of (row_id, length) in row_id order."""
    one = F.concat(F.lit('{"prompt_plus_answer_tokens":'), F.col("n_tokens").cast("string"), F.lit(',"row_id":"'), F.col("row_id"), F.lit('"}'))
    rows = lengths.withColumn("_one", one)
    text = F.concat(F.lit("["), F.expr("listagg(_one, ',') within group (order by row_id)"), F.lit("]"))
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("token_lengths_sha256"))


def require_labels(labels: list[int]) -> str:
    """The digest of a list of labels; an empty one is refused."""
    if not labels:
        raise EvidenceError("an empty sequence has no digest")
    return hashlib.sha256(",".join(str(int(x)) for x in labels).encode()).hexdigest()
