"""Long exact spans shared between records.

Every passage of SPAN characters is banded by its minimum hash: the least hash of
its GRAM-grams, one band of one row, which equal passages share with certainty.
Consecutive passages of a text with one minimum form a block.  Blocks collide on
their minimum and are compared whole by a fingerprint of their characters; only
blocks at the edge of a shared span, whose minimum occurs elsewhere but whose
characters don't, are compared passage by passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veritab.llm import textcodes
from veritab.session import written

SPAN = 160
GRAM = 64
BATCH = 1 << 18
#: One document in PART is looked at first; what HOT or more of these share is hot.
#: The lists of hot blocks and passages have the MOST_HOT most frequent, or four for
#: each part if that is more: what isn't among them has less than a quarter of an
#: average part's records and goes the ordinary way, which is exact as well.
PART, HOT, MOST_HOT = 64, 8, 20_000
#: Blocks or passages that one task compares.
PART_RECORDS = 2_000_000
PIECES = "doc_id bigint, start int, stop int, kind int"
#: Kinds of pieces: a run of passages that are shared; an edge block to be compared
#: by passages; a block known to be in two documents, to be compared with edges.
SHARED, EDGE, TWICE = 0, 1, 2
_U64 = np.uint64


class Passages:
    """The passages of some texts: ``first`` is each one's place in the joined text."""

    def __init__(self, texts: list[str], span: int, gram: int):
        points, starts, ends = textcodes.codes(texts)
        self.points, self.starts, self.span, self.gram = points, starts, span, gram
        count = np.maximum(ends - starts - span + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), count)
        self.first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        self.prefixes: dict[int, np.ndarray] = {}

    def hashes(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        if k not in self.prefixes:
            self.prefixes[k] = textcodes.prefix(textcodes.code_values(k + 1)[self.points], k)
        return textcodes.segments(self.prefixes[k], start, stop, k)

    def minima(self) -> np.ndarray:
        """The least gram hash of each passage."""
        width = self.span - self.gram + 1
        at = np.arange(len(self.points) - self.gram + 1)
        low = self.hashes(at, at + self.gram)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        return low[self.first]

    def blocks(self) -> tuple[np.ndarray, ...]:
        """(text, start, passages, minimum, fingerprint) of each block."""
        if not len(self.first):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U64, _U64))
        low = self.minima()
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (self.text[1:] != self.text[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(low)))
        start, text = self.first[at], self.text[at]
        return text, start - self.starts[text], size, low[at], self.hashes(start, start + size + self.span - 1, 1)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], int]]:
    ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    for a, b in textcodes.chunks(texts, BATCH):
        yield ids[a:b], texts[a:b], a


def _sampled_blocks(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, _ in _texts(batch):
                text, start, size, low, print_ = Passages(texts, span, gram).blocks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (low.view(np.int64), print_.view(np.int64), ids[text], start.astype(np.int32), size.astype(np.int32))],
                    ["low", "print", "doc_id", "start", "size"],
                )

    return run


def _packed(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> list[tuple[int, list[bytes]]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    return [(p, [c[s:e].tobytes() for c in columns]) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]


def _rows(docs: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), docs.shape)
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(kinds)], ["doc_id", "start", "stop", "kind"])


CHUNKS = "part int, docs binary, a binary, b binary, start binary, size binary"


def _chunk_batch(chunks: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    columns = [pa.array([p for p, _ in chunks], pa.int32())] + [pa.array([c[i] for _, c in chunks], pa.binary()) for i in range(5)]
    return pa.RecordBatch.from_arrays(columns, ["part", "docs", "a", "b", "start", "size"])


def _block_chunks(span: int, gram: int, parts: int, hot_prints: np.ndarray, hot_lows: np.ndarray):
    """Chunks of blocks by minimum.  Hot blocks come with part -1 as SHARED, other
    blocks of a hot minimum as EDGE: they needn't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, _ in _texts(batch):
                text, start, size, low, print_ = Passages(texts, span, gram).blocks()
                docs = ids[text]
                known = np.isin(print_, hot_prints)
                edge = ~known & np.isin(low, hot_lows)
                out = []
                for pick, kind in ((known, SHARED), (edge, EDGE)):
                    if pick.any():
                        out.append((-1, [docs[pick].tobytes(), np.full(pick.sum(), kind, _U64).tobytes(), b"", start[pick].astype(np.int32).tobytes(), size[pick].astype(np.int32).tobytes()]))
                rest = ~(known | edge)
                part = ((low[rest] >> _U64(3) & _U64(0xFFFFF)) * _U64(parts) >> _U64(20)).astype(np.int64)
                out += _packed(part, parts, [c[rest] for c in (docs, low, print_, start.astype(np.int32), size.astype(np.int32))])
                if out:
                    yield _chunk_batch(out)

    return run


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    for batch in batches:
        for part, *raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
            yield part, [np.frombuffer(r, t) for r, t in zip(raw, (np.int64, _U64, _U64, np.int32, np.int32))]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The number of the group of equal neighbours that each row is in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _several(group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row, whether its group has more than one document."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return (np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at))[group]


def _compared(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for part, columns in _loaded(batches):
            if part >= 0:
                kept.append(columns)
                continue
            docs, kind, _, start, size = columns
            yield _rows(docs, start, start + size + span - 1, kind.astype(np.int32))
        if not kept:
            return
        docs, low, print_, start, size = (np.concatenate(c) for c in zip(*kept))
        kept.clear()
        # first only the minima of several documents
        order = np.argsort(low, kind="stable")
        low, docs = low[order], docs[order]
        keep = _several(_groups(low), docs)
        low, docs, print_, start, size = low[keep], docs[keep], print_[order][keep], start[order][keep], size[order][keep]
        if not len(low):
            return
        order = np.lexsort((docs, print_, low))
        docs, low, print_, start, size = (c[order] for c in (docs, low, print_, start, size))
        block, group = _groups(low, print_), _groups(low)
        same = _several(block, docs)
        stop = start + size + span - 1
        yield _rows(docs[same], start[same], stop[same], SHARED)
        yield _rows(docs[~same], start[~same], stop[~same], EDGE)
        edged = np.bincount(group[~same], minlength=group[-1] + 1 if len(group) else 0) > 0
        lead = np.concatenate(([True], block[1:] != block[:-1]))
        twice = same & lead & edged[group]
        yield _rows(docs[twice], start[twice], stop[twice], TWICE)

    return run


def _cut(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, start, kind, hash) of the passages of each document's pieces."""
    for batch in batches:
        lists = batch.column(2).to_pylist()
        for ids, texts, base in _texts(batch):
            p = Passages(texts, span, span)
            own = [(i, q["start"], q["stop"] - span + 1, q["kind"]) for i in range(len(texts)) for q in lists[base + i]]
            text, start, stop, kind = np.array(own, np.int64).reshape(-1, 4).T
            size = np.maximum(stop - start, 0)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text, start, kind = np.repeat(text, size), np.repeat(start, size) + at, np.repeat(kind, size)
            place = p.starts[text] + start
            yield ids[text], start, kind, p.hashes(place, place + span)


def _sampled_passages(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, _, _, h in _cut(batches, span):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs)], ["h", "doc_id"])

    return run


def _passage_chunks(span: int, parts: int, hot: np.ndarray):
    """Chunks of passages by hash, their kind in ``size``.  Hot ones come with part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, start, kind, h in _cut(batches, span):
            known = np.isin(h, hot)
            out = []
            if (pick := known & (kind == EDGE)).any():
                out.append((-1, [docs[pick].tobytes(), b"", b"", start[pick].astype(np.int32).tobytes(), b""]))
            rest = ~known
            part = ((h[rest] >> _U64(3) & _U64(0xFFFFF)) * _U64(parts) >> _U64(20)).astype(np.int64)
            packed = _packed(part, parts, [docs[rest], h[rest], start[rest].astype(np.int32), kind[rest].astype(np.int32)])
            out += [(q, [d, x, b"", s, k]) for q, (d, x, s, k) in packed]
            if out:
                yield _chunk_batch(out)

    return run


def _runs(docs: np.ndarray, start: np.ndarray, span: int) -> pa.RecordBatch:
    """Passages as runs of consecutive ones."""
    order = np.lexsort((start, docs))
    docs, start = docs[order], start[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    return _rows(docs[at], start[at], start[last] + span, SHARED)


def _matched(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for part, (docs, h, _, start, kind) in _loaded(batches):
            if part < 0:
                yield _runs(docs, start, span)
            else:
                kept.append((docs, h, start, kind))
        if not kept:
            return
        docs, h, start, kind = (np.concatenate(c) for c in zip(*kept))
        kept.clear()
        order = np.argsort(h, kind="stable")
        docs, h, start, kind = docs[order], h[order], start[order], kind[order]
        group = _groups(h)
        known = np.bincount(group[kind == TWICE], minlength=group[-1] + 1) > 0
        keep = (kind == EDGE) & (known[group] | _several(group, docs))
        yield _runs(docs[keep], start[keep], span)

    return run


def merged(pieces: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of the characters in ``pieces``."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = pieces.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    runs = begun.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("span_start"), F.max("stop").alias("span_end")).select("doc_id", "span_start", "span_end")


def shared_spans(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, span_start, span_end): what of each text stands verbatim in another's.

    ``documents`` needs doc_id and text.  A character is shared if it lies in a run
    of at least ``span`` characters that occurs in the text of another doc_id;
    spans are maximal, in code points, the end exclusive.  Null and shorter texts
    and null doc_ids share nothing; repeats within one text, or between rows of
    one doc_id, don't count; an empty table gives no spans.  Passages are compared
    by 64-bit fingerprints, blocks by two of them.
    """
    spark = documents.sparkSession
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parts_for(records: int) -> int:
        return min(1 << 20, max(least_parts, -(-records // PART_RECORDS)))

    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= span))

    def in_part(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0)

    several = (F.col("n") >= HOT) & (F.col("x") < F.col("y"))
    stats = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")]
    blocks = in_part(texts).mapInArrow(_sampled_blocks(span, gram), "low bigint, print bigint, doc_id bigint, start int, size int")
    blocks = written(blocks, "span-part")
    # as many parts as the records need, however many partitions the session has
    parts = parts_for(blocks.count() * PART)
    most_hot = max(MOST_HOT, 4 * parts)
    one = F.min(F.struct("doc_id", "start", "size")).alias("one")
    top_prints = blocks.groupBy("low", "print").agg(*stats, one).where(several).orderBy(F.desc("n"), "print").limit(most_hot).collect()
    top_lows = blocks.groupBy("low").agg(*stats).where(several).orderBy(F.desc("n"), "low").limit(most_hot).collect()
    hot_prints = np.array([r["print"] for r in top_prints], np.int64).view(_U64)
    hot_lows = np.array(sorted({r["low"] for r in [*top_prints, *top_lows]}), np.int64).view(_U64)

    chunks = texts.mapInArrow(_block_chunks(span, gram, parts, hot_prints, hot_lows), CHUNKS)
    pieces = written(chunks.repartitionById(parts, F.pmod("part", F.lit(parts))).mapInArrow(_compared(span), PIECES), "span-pieces")
    known = [(r["one"]["doc_id"], r["one"]["start"], r["one"]["start"] + r["one"]["size"] + span - 1, TWICE) for r in top_prints]
    open_ = pieces.where(F.col("kind") != SHARED)
    if known:
        open_ = open_.unionByName(spark.createDataFrame(known, PIECES))
    lists = open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("pieces"))
    edges = texts.join(lists, "doc_id").select("doc_id", "text", "pieces")
    hot = np.zeros(0, _U64)
    parts = parts_for(open_.agg(F.sum(F.col("stop") - F.col("start") - span + 1).cast("bigint")).first()[0] or 0)
    if len(hot_lows):
        passages = in_part(texts).join(in_part(lists), "doc_id").select("doc_id", "text", "pieces").mapInArrow(_sampled_passages(span), "h bigint, doc_id bigint")
        top = passages.groupBy("h").agg(*stats).where(several).orderBy(F.desc("n"), "h").limit(max(MOST_HOT, 4 * parts)).select("h").collect()
        hot = np.array([r["h"] for r in top], np.int64).view(_U64)
    found = edges.mapInArrow(_passage_chunks(span, parts, hot), CHUNKS).repartitionById(parts, F.pmod("part", F.lit(parts))).mapInArrow(_matched(span), PIECES)
    return merged(pieces.where(F.col("kind") == SHARED).unionByName(found).select("doc_id", "start", "stop"))


def shared_characters(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_shared): each row's number of shared characters, 0 where none is."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    return documents.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"))
