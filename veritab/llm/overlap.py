"""Same or near-same records across splits by a compressed full-text index of the evaluation texts.

The distinct evaluation texts are dealt into shards of bounded size, and each shard
gets a compressed index over its words (see textindex).  Training texts stream by
once: a task gathers some, passes them through all shards in turn, and loads a shard
only if its filter of word runs lets a text through.  Backward search finds the
runs of words that occur; texts whose matches cover enough have their rarest runs
located, and the texts found there are read from the index and compared on full
n-gram sets.  For each two near texts the maximal matches come out merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.text import SPACE
from veritab.llm import textcodes
from veritab.llm.neardup import SIMILARITY, WORDS
from veritab.llm.spans import merged
from veritab.llm.textindex import Filter, WordIndex
from veritab.session import new_path, written

TRAIN, JUDGED = "train", ("validation", "test")
#: Words of a shard.  Loaded it takes some 6 bytes a word, but building it takes many times that.
SHARD_WORDS = 1_000_000
#: Words of training texts that pass through the shards together.
SWEEP_WORDS = 2_000_000
#: Occurrences located, and words compared, at once.
AT_ONCE = 1 << 20
#: Parts of a hot key's rows in a lookup.
SALTS = 16
LINK = "train_class binary, class binary, n_shared int, n_either int, longest int, spans array<struct<start: int, stop: int>>"
_U64 = np.uint64
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start+size] of each, one after the other."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return values[np.repeat(start, size) + at]


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)))


class Texts:
    """Words of some texts, all their runs of WORDS words, and each text's distinct runs."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.hashes, self.offsets = hashes, offsets
        self.size = np.diff(offsets)
        self.runs, self.run_at = textcodes.shingles(hashes, offsets, WORDS)
        n = np.diff(self.run_at)
        own = np.repeat(np.arange(len(n)), n)
        # each distinct run with the place of one occurrence
        order = np.lexsort((self.runs, own))
        gram, of = self.runs[order], own[order]
        first = np.ones(len(order), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
        pick = order[first]
        self.gram, self.own = gram[first], of[first]
        self.at = pick - self.run_at[self.own] + offsets[self.own]
        self.n = np.bincount(self.own, minlength=len(n))
        self.gram_at = _offsets(self.n)


def _within(values: np.ndarray, pair: np.ndarray, others: np.ndarray, other_pair: np.ndarray) -> np.ndarray:
    """Whether each value is among the others of its pair (by 64-bit hashes of both)."""
    keys = np.sort(textcodes.mix(others ^ textcodes.mix(other_pair.astype(_U64) + _U64(1))))
    mine = textcodes.mix(values ^ textcodes.mix(pair.astype(_U64) + _U64(1)))
    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
    return keys[at] == mine if len(keys) else np.zeros(len(mine), bool)


def _shared(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> np.ndarray:
    """Distinct runs that text i of x and text j of y have in common, for each pair."""
    nx, ny = x.n[i], y.n[j]
    pair = np.arange(len(i))
    hit = _within(_slices(x.gram, x.gram_at[i], nx), np.repeat(pair, nx), _slices(y.gram, y.gram_at[j], ny), np.repeat(pair, ny))
    return np.bincount(np.repeat(pair, nx)[hit], minlength=len(i))


def _covered(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, stop): the words of text j of y in matches with text i of x, merged to spans."""
    size = np.diff(y.run_at)[j]
    pair = np.repeat(np.arange(len(j)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    nx = x.n[i]
    hit = _within(_slices(y.runs, y.run_at[j], size), pair, _slices(x.gram, x.gram_at[i], nx), np.repeat(np.arange(len(i)), nx))
    pair, place = pair[hit], place[hit]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (place[1:] > place[:-1] + WORDS)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(pair)) - 1
    return pair[begin], place[begin], place[end] + WORDS


def _widest(pair: np.ndarray, start: np.ndarray, stop: np.ndarray, pairs: int) -> np.ndarray:
    out = np.zeros(pairs, np.int64)
    np.maximum.at(out, pair, stop - start)
    return out


def _have(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each pair has a run of ``length`` words in common."""

    def segments(t: Texts, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(t.size[k] - length + 1, 0)
        pair = np.repeat(np.arange(len(k)), count)
        start = np.repeat(t.offsets[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return textcodes.segments(t.prefix, start, start + length[pair], 0), pair

    for t in (x, y):
        if not hasattr(t, "prefix"):
            t.prefix = textcodes.prefix(t.hashes, 0)
    (a, p), (b, q) = segments(x, i), segments(y, j)
    return np.bincount(p[_within(a, p, b, q)], minlength=len(i)) > 0


def longest_common(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words of the longest match of each pair, between WORDS and ``most``; tried from above first."""
    low, high = np.full(len(i), WORDS), most.copy()
    live, trial = np.flatnonzero(high > low), high
    while len(live):
        ok = _have(x, i[live], y, j[live], trial[live])
        low[live[ok]] = trial[live[ok]]
        high[live[~ok]] = trial[live[~ok]] - 1
        trial = (low + high + 1) >> 1
        live = np.flatnonzero(high > low)
    return low


def matched(index: WordIndex, texts: Texts, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, text of the index, shared, either, longest, (pair, start, stop) of spans) of the near pairs of the ``chosen`` texts."""
    up, down = SIMILARITY
    ask = chosen[texts.own]
    own, at = texts.own[ask], texts.at[ask]
    words = np.zeros(len(texts.hashes), np.int64)
    mine = np.repeat(chosen, texts.size)
    words[mine] = index.numbers(texts.hashes[mine])
    low, high = index.runs(words, at, WORDS)
    # matches cover at least this many runs of a text that is near to any
    covered = np.bincount(own[high > low], minlength=len(texts.n))
    good = chosen & (texts.n > 0) & (covered * down >= texts.n * up)
    keep = good[own] & (high > low)
    own, low, high = own[keep], low[keep], high[keep]
    # of n runs at least ceil(s n) are shared, so one of any n - ceil(s n) + 1 is: take the rarest
    order = np.lexsort((high - low, own))
    own, low, high = own[order], low[order], high[order]
    absent = texts.n - np.bincount(own, minlength=len(texts.n))
    rank = np.arange(len(own)) - np.searchsorted(own, own) + absent[own]
    keep = rank <= texts.n[own] - -(-texts.n[own] * up // down)
    own, low, high = own[keep], low[keep], high[keep]
    ends = np.cumsum(high - low)
    done = 0
    while done < len(own):
        # whole texts, as many as stay below the bound, one at least
        upto = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right"))
        upto = int(np.searchsorted(own, own[min(upto, len(own) - 1)], "left"))
        if upto <= done:
            upto = int(np.searchsorted(own, own[done], "right"))
        a, b, mine = low[done:upto], high[done:upto], own[done:upto]
        done = upto
        pair = np.zeros(0, np.int64)
        for s in _pieces(b - a):
            hit = index.texts_at(index.located(_slices(np.arange(index.n), a[s], (b - a)[s])))
            pair = np.union1d(pair, np.repeat(mine[s], (b - a)[s]) * len(index.starts) + hit)
        i, y = np.divmod(pair, len(index.starts))
        # texts of fewer or many more runs can't be near
        n_y = np.append(index.starts[1:], index.n)[y] - 1 - index.starts[y] - WORDS + 1
        fits = n_y * down >= texts.n[i] * up
        i, y = i[fits], y[fits]
        for s in _pieces(texts.size[i] + n_y[fits]):
            yield from _compared(index, texts, i[s], y[s], words)


def _pieces(size: np.ndarray) -> Iterator[slice]:
    """Slices of about AT_ONCE in sum, each of one element at least."""
    ends, done = np.cumsum(size), 0
    while done < len(size):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
        yield slice(done, upto)
        done = upto


def _compared(index: WordIndex, texts: Texts, i: np.ndarray, y: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    up, down = SIMILARITY
    there, j = np.unique(y, return_inverse=True)
    other = Texts(*index.words_of(there))
    shared = _shared(texts, i, other, j)
    either = texts.n[i] + other.n[j] - shared
    near = (shared * down >= either * up) & (shared > 0)
    i, j, y, shared, either = i[near], j[near], y[near], shared[near], either[near]
    if not len(i):
        return
    spans = _covered(texts, i, other, j)
    most = np.minimum(_widest(*spans, len(i)), _widest(*_covered(other, j, texts, i), len(i)))
    # no match of a pair is longer than the maximal one of backward search
    which, back = np.unique(i, return_inverse=True)
    lengths = index.longest(_slices(words, texts.offsets[which], texts.size[which]), _offsets(texts.size[which]))
    most = np.minimum(most, np.maximum.reduceat(lengths, _offsets(texts.size[which])[:-1])[back])
    yield i, y, shared, either, longest_common(texts, i, other, j, most), spans


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class")
    texts = rows["text"].tolist()
    blobs = WordIndex.built(texts).blobs
    filter_ = Filter.built(np.unique(textcodes.shingles(*textcodes.words(texts), WORDS)[0]))
    values = {"classes": b"".join(rows["class"])} | blobs | {"filter": filter_}
    return pd.DataFrame({"shard": key[0], "kind": ["filter" if k == "filter" else "index" for k in values], "name": list(values), "blob": list(values.values())})


def _read(path: str, shard: int, kind: str) -> dict[str, bytes]:
    where = f"{path}/shard={shard}/kind={kind}"
    filesystem = None
    if "://" in where or where.startswith("file:"):
        filesystem, where = pa.fs.FileSystem.from_uri(where)
    table = ds.dataset(where, filesystem=filesystem, format="parquet").to_table(["name", "blob"])
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


class Shards:
    """The shards of an index; filters are kept up to a bound, of the indices the last one."""

    MOST_KEPT = 64 << 20

    def __init__(self, path: str, shards: list[int]):
        self.path, self.shards = path, shards
        self.filters: dict[int, bytes] = {}
        self.loaded: tuple = (None, None, None)

    def filter(self, shard: int) -> Filter:
        raw = self.filters.get(shard)
        if raw is None:
            raw = _read(self.path, shard, "filter")["filter"]
            if sum(map(len, self.filters.values())) + len(raw) <= self.MOST_KEPT:
                self.filters[shard] = raw
        return Filter(raw)

    def index(self, shard: int) -> tuple[WordIndex, bytes]:
        if self.loaded[0] != shard:
            self.loaded = (None, None, None)
            blobs = _read(self.path, shard, "index")
            classes = blobs.pop("classes")
            self.loaded = (shard, WordIndex(blobs), classes)
        return self.loaded[1:]


def _link_batch(index_classes: bytes, classes: list[bytes], found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    i, y, shared, either, longest, (pair, start, stop) = found
    at = pa.array(np.searchsorted(pair, np.arange(len(i) + 1)).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["start", "stop"])
    columns = [pa.array([classes[k] for k in i.tolist()], pa.binary()), pa.array([index_classes[16 * k : 16 * k + 16] for k in y.tolist()], pa.binary())]
    columns += [pa.array(c.astype(np.int32)) for c in (shared, either, longest)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, spans).cast(_SPANS)], ["train_class", "class", "n_shared", "n_either", "longest", "spans"])


def _swept(path: str, shards: list[int], sweep_words: int):
    def sweep(index_of: Shards, hashes: list[np.ndarray], sizes: list[np.ndarray], classes: list[bytes]) -> Iterator[pa.RecordBatch]:
        up, down = SIMILARITY
        texts = Texts(np.concatenate(hashes), _offsets(np.concatenate(sizes)))
        for shard in shards:
            may = np.bincount(texts.own[index_of.filter(shard)(texts.gram)], minlength=len(texts.n))
            chosen = (texts.n > 0) & (may * down >= texts.n * up)
            if chosen.any():
                index, own = index_of.index(shard)
                for found in matched(index, texts, chosen):
                    yield _link_batch(own, classes, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_of = Shards(path, shards)
        hashes, sizes, classes, seen, words = [], [], [], set(), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            once = list({k: i for i, k in enumerate(keys) if k not in seen}.values())
            own = [texts[i] for i in once]
            for a, b in textcodes.chunks(own):
                h, offsets = textcodes.words(own[a:b])
                hashes.append(h), sizes.append(np.diff(offsets))
                classes += [keys[i] for i in once[a:b]]
                seen.update(classes[len(classes) - (b - a) :])
                words += len(h)
                if words >= sweep_words:
                    yield from sweep(index_of, hashes, sizes, classes)
                    hashes, sizes, classes, seen, words = [], [], [], set(), 0
        if classes:
            yield from sweep(index_of, hashes, sizes, classes)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        one, two = textcodes.copy_keys(texts)
        classes: list[bytes | None] = []
        counts: list[int] = []
        filled = [t or "" for t in texts]
        for a, b in textcodes.chunks(filled):
            hashes, offsets = textcodes.words(filled[a:b])
            n = np.diff(offsets)
            classes += [k if c >= WORDS else None for k, c in zip(textcodes.word_keys(hashes, offsets), n.tolist())]
            counts += n.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (one, two, classes)), pa.array(counts, pa.int64()), batch.column(2)],
            ["split", "row_id", "k1", "k2", "class", "n_words", "text"],
        )


KEYED = "split string, row_id string, k1 binary, k2 binary, class binary, n_words bigint, text string"


def split_name(split: Column) -> Column:
    return F.lower(F.regexp_replace(split, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def near_links(judged: DataFrame, train: DataFrame, shard_words: int = SHARD_WORDS, sweep_words: int = SWEEP_WORDS) -> DataFrame:
    """The near pairs of a class of ``judged`` and one of ``train``, each once: see LINK.

    Both have class and text, ``judged`` n_words too.  Spans are words of the judged
    text, from 0, the end exclusive; ``longest`` is the longest run of words of the
    two; nothing depends on shards or partitions.
    """
    spark = judged.sparkSession
    classes = judged.groupBy("class").agg(F.first("n_words").alias("n_words"), F.first("text").alias("text"))
    classes = written(classes, "overlap-classes")
    total = classes.agg(F.sum("n_words")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], LINK)
    shards = -(-total // shard_words)
    path = new_path(spark, "overlap-index")
    sharded = classes.select("class", "text", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"))
    # a task for each shard, however small
    sharded = sharded.repartition(max(int(shards), int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    built = sharded.groupBy("shard").applyInPandas(_build, "shard int, kind string, name string, blob binary")
    built.write.partitionBy("shard", "kind").option("compression", "none").parquet(path)
    present = sorted(r[0] for r in spark.read.parquet(path).where("kind = 'filter'").select("shard").distinct().collect())
    links = written(train.select("class", "text").mapInArrow(_swept(path, present, sweep_words), LINK), "overlap-hits")
    return links.dropDuplicates(["train_class", "class"])


def lookup(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``values``, with what those hold; a hot key's rows are spread over SALTS tasks.

    ``values`` has a key once at most; null keys match nothing.
    """
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [key, "_salt"]).drop("_salt")


def keyed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, judged): the rows of the splits with their keys, written once; see KEYED."""
    name = split_name(F.col("split"))
    rows = members.select(name.alias("split"), "row_id", "text").where(name.isin(TRAIN, *JUDGED))
    rows = written(rows.mapInArrow(_keys, KEYED), "overlap-keys")
    return rows.where(F.col("split") == TRAIN), rows.where((F.col("split") != TRAIN) & F.col("row_id").isNotNull())


def links(members: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The near pairs of texts across splits, by representatives.

    (row_id, train_row_id, n_rows, n_train_rows, n_shared, n_either, longest, spans):
    the smallest row_id with the words of the judged text and of the train text, the
    numbers of row_ids with these words, the distinct runs of three words in both and
    in either, the words of the longest match, and the matched words of the judged
    text.  Row_ids without any count as none.
    """
    train, judged = keyed(members)
    found = near_links(judged.where("class is not null"), train.where("class is not null"), shard_words)

    def named(rows: DataFrame, name: str, row: str, n: str) -> DataFrame:
        once = rows.where("class is not null").select(F.col("class").alias(name), "row_id").distinct()
        return once.groupBy(name).agg(F.min("row_id").alias(row), F.count("row_id").alias(n))

    out = found.join(named(judged, "class", "row_id", "n_rows"), "class").join(named(train, "train_class", "train_row_id", "n_train_rows"), "train_class")
    return out.select("row_id", "train_row_id", "n_rows", "n_train_rows", "n_shared", "n_either", "longest", "spans")


FLAGS = ("same_row", "copy", "near")


def overlaps(members: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(split, row_id, same_row, copy, near, train_row_id, n_links, longest, n_spans, n_words) of each judged row_id of each split, once.

    ``members`` has split, row_id and text.  ``same_row``: train has the row_id;
    ``copy``: train has a copy of a text of the row; ``near``: train has a text
    whose distinct runs of three words are shared to 3/5 at least.  Of near texts:
    ``train_row_id`` is the smallest row_id of the most similar one, ``n_links``
    their number by words, ``longest`` the words of the longest match, ``n_spans``
    and ``n_words`` the spans of the text that stand in any of them and their words.
    Split names are trimmed and in lower case; other and null splits take no part;
    null row_ids are left out; null, blank and, for ``near``, shorter texts match
    nothing.  A row_id with several texts has the greatest of each number.
    """
    train, judged = keyed(members)
    found = written(near_links(judged.where("class is not null"), train.where("class is not null"), shard_words), "overlap-links")
    likeness = F.struct(F.col("n_shared") / F.col("n_either"), "train_class")
    best = found.groupBy("class").agg(F.max_by("train_class", likeness).alias("train_class"), F.count(F.lit(1)).alias("n_links"), F.max("longest").alias("longest"))
    pieces = found.select(F.col("class").alias("doc_id"), F.explode("spans").alias("x")).select("doc_id", "x.start", "x.stop").distinct()
    covered = merged(pieces).groupBy(F.col("doc_id").alias("class")).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).cast("bigint").alias("n_words"))
    linked = found.select("train_class").distinct()
    named = train.select(F.col("class").alias("train_class"), "row_id").join(linked, "train_class", "left_semi").groupBy("train_class").agg(F.min("row_id").alias("train_row_id"))
    near = best.join(covered, "class").join(named, "train_class", "left").select("class", "train_row_id", "n_links", "longest", "n_spans", "n_words")

    numbers = ("n_links", "longest", "n_spans", "n_words")

    def flagged(rows: DataFrame, flag: str | None) -> DataFrame:
        kinds = {"train_row_id": "string", "n_links": "bigint", "longest": "int", "n_spans": "bigint", "n_words": "bigint"}
        more = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        return rows.select("split", "row_id", *[F.lit(f == flag).alias(f) for f in FLAGS], *more)

    plain = judged.select("split", "row_id", "k1", "k2", "class")
    ids = plain.select("split", "row_id").distinct()
    out = flagged(ids, None).unionByName(flagged(ids.join(train.select("row_id").where("row_id is not null").distinct(), "row_id"), "same_row"))
    for key in ("k1", "k2"):
        here, there = (rows.select(key).where(F.col(key).isNotNull()).distinct() for rows in (plain, train))
        out = out.unionByName(flagged(lookup(plain.select("split", "row_id", key), here.join(there, key), key), "copy"))
    out = out.unionByName(flagged(lookup(plain.select("split", "row_id", "class"), near, "class"), "near"))
    return out.groupBy("split", "row_id").agg(*[F.max(f).alias(f) for f in FLAGS], F.min("train_row_id").alias("train_row_id"), *[F.max(n).alias(n) for n in numbers])


def found(overlaps_: DataFrame) -> DataFrame:
    return overlaps_.where("same_row or copy or near").select("split", "row_id")


def report(overlaps_: DataFrame, members: DataFrame) -> DataFrame:
    """Counts per split and source of the judged rows and of each kind of overlap.

    A row counts under each source it came with; a null source is a group.
    """
    sources = members.select(split_name(F.col("split")).alias("split"), "row_id", "source").distinct()
    joined = overlaps_.join(sources, ["split", "row_id"])

    def count(condition: Column, name: str) -> Column:
        return F.sum(condition.cast("bigint")).alias(name)

    return joined.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), count(F.col("same_row"), "n_same_row"), count(F.col("copy"), "n_copy"),
        count(F.col("near"), "n_near"), count(F.col("same_row") | F.col("copy") | F.col("near"), "n_found"),
    )
