"""Near-duplicate paragraphs: MinHash banding, exact verification, components.

Paragraphs of five words or more are banded by MinHash for a high recall at a
Jaccard similarity of 0.8 of their five-word n-grams, colliding ones are joined
and verified on the full sets, and each component keeps its first paragraph.
Shorter paragraphs are grouped as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from veritab.llm import neardup
from veritab.llm.groups import by_key, components, hot_keys
from veritab.session import written

#: Fewer bands than for a lower similarity give the same recall: 18 of 5 rows.
MOST_BANDS = 20
WORDS = 5
SIMILARITY = (4, 5)
PARAGRAPHS = "row_id string, doc_id bigint, start int, stop int, text string"
#: A paragraph ends at a line end of any kind.
_BREAK = regex.compile("[" + "".join(map(chr, (10, 11, 12, 13, 0x85, 0x2028, 0x2029))) + "]+")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = 0
            for end in [m.span() for m in _BREAK.finditer(text)] + [(len(text), len(text))]:
                if text[at : end[0]].strip():
                    rows.append((f"{doc}:{at}:{end[0]}", doc, at, end[0], text[at : end[0]]))
                at = end[1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["row_id", "doc_id", "start", "stop", "text"])


def paragraphs(documents: DataFrame) -> DataFrame:
    """(row_id, doc_id, start, stop, text) of the paragraphs that aren't blank."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_cut, PARAGRAPHS)


def duplicate_paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, start, stop, component, removed): the paragraphs that have a near one.

    ``component`` names the component's first paragraph as doc_id:start, which is
    the one that isn't ``removed``.  Copies, which have the same words in order
    or, without any word, the same characters, count as near; paragraphs of fewer
    than five words have no other near ones.  Null texts and null doc_ids have none;
    places are code points; an empty table gives no rows.
    """
    pairs, members = neardup.class_pairs(paragraphs(documents).select("row_id", "text"), SIMILARITY, WORDS, copies=True, most_bands=MOST_BANDS)
    found = components(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    # a paragraph's name holds its place, so the texts needn't be joined again
    part = F.split("row_id", ":")
    placed = members.distinct().select("class", "row_id", part[0].cast("bigint").alias("doc_id"), part[1].cast("int").alias("start"), part[2].cast("int").alias("stop"))
    placed = written(placed, "paragraph-members")
    # components are told by class; only then are they joined to rows, those of a hot class spread over tasks
    classes = placed.groupBy("class").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    whole = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("component", "first")
    named = classes.select("class", "component").join(whole, "component").select("class", "first")
    rows = by_key(placed, named, "class", hot_keys(placed, "class"), F.xxhash64("row_id"))
    name = F.concat_ws(":", F.col("first.doc_id"), F.col("first.start"))
    removed = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.start") != F.col("start"))
    return rows.select("doc_id", "start", "stop", name.alias("component"), removed.alias("removed"))
