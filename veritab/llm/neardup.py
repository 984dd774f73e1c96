"""Near-duplicate records by MinHash banding, verified on full n-gram sets.

Copies are folded into classes first.  Each class emits one record for each band;
records are packed into binary chunks, one for each batch and target partition, so
the shuffle carries 6 bytes a record.  Bands that a fixed part of the classes
shows to be crowded, and any bucket of more than CROWD classes, go another, exact
way: a prefix filter on the n-gram sets with its groups cut into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm import textcodes
from veritab.llm.groups import by_key, components, hot_keys
from veritab.session import written

WORDS = 3
SIMILARITY = (3, 5)
RECALL = 0.999
MOST_BANDS = 50
CROWD = 32
#: One class in so many is looked at to find crowded bands: those with HOT records
#: or more there, and more than a quarter of an average part's, go the exact way at
#: once.  So there are at most four such bands for each part.
PART, HOT = 64, 8
BLOCK = 1024
#: Records of bands that one task compares.
PART_RECORDS = 4_000_000
#: Counters of the sketch that orders n-grams by frequency: 2 MB, whatever the data.
COUNTERS = 1 << 18
#: A number of n-grams that stands for itself and all above.
MOST_SIZE = 0xFFFF
MEMBERS = "row_id string, class binary"
CLASSES = "class binary, k1 binary, k2 binary, text string"
_U64 = np.uint64


def banding(similarity: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose recall at ``similarity`` needs no more bands.

    A pair of similarity s shares a band of r rows with probability s^r, and one
    of b bands with 1 - (1 - s^r)^b.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands > most_bands:
            break
        best = (bands, rows)
    return best


def _classed(batches: Iterator[pa.RecordBatch], n: int, copies: bool) -> Iterator[tuple[list, list[bytes], list, list, list]]:
    """Rows of ``n`` words or more: (row_ids, class, k1, k2, texts); with ``copies``, classes are of words only, of the bare text where it has none."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in textcodes.chunks(texts):
            own = texts[a:b]
            hashes, offsets = textcodes.words(own)
            enough = np.flatnonzero(np.diff(offsets) >= n).tolist()
            keys = textcodes.word_keys(hashes, offsets)
            if copies:
                for i in np.flatnonzero(np.diff(offsets) == 0).tolist():
                    keys[i] = b"\0" + blake2b(own[i].strip().encode("utf-8", "surrogatepass"), digest_size=16).digest()
            ones, twos = ([None] * len(own),) * 2 if copies else (textcodes.letter_keys(own), textcodes.field_keys(own))
            yield [ids[a + i] for i in enough], [keys[i] + (twos[i] or b"") for i in enough], [ones[i] for i in enough], [twos[i] for i in enough], [own[i] for i in enough]


def _members(n: int, copies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, _, _, _ in _classed(batches, 0 if copies else n, copies):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["row_id", "class"])

    return run


def _classes(n: int, copies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, ones, twos, texts in _classed(batches, n, copies):
            once = list({k: i for i, k in enumerate(keys)}.values())
            columns = [[c[i] for i in once] for c in (keys, ones, twos, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.binary(), pa.string()))], ["class", "k1", "k2", "text"])

    return run


def sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return textcodes.distinct_per_text(*textcodes.shingles(*textcodes.words(texts), n))


def bands_of(texts: list[str], bands: int, rows: int, n: int = WORDS) -> np.ndarray:
    """The 64-bit hash of each band (rows) of each text (columns); each text has n-grams."""
    h, offsets = textcodes.shingles(*textcodes.words(texts), n)
    # two independent 32-bit halves; all arithmetic is modulo 2^32
    x = (h >> _U64(32)).astype(np.uint32)
    rng = np.random.default_rng(20240607)
    mul = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    at = offsets[:-1]
    out = np.zeros((bands, len(texts)), _U64)
    for band in range(bands):
        key = np.full(len(texts), band + 1, _U64)
        for k in range(band * rows, band * rows + rows):
            y = x ^ add[k]
            y *= mul[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            key = textcodes.mix(key * _U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, at).astype(_U64))
        out[band] = key
    return out


def _sampled_bands(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textcodes.chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(bands_of(texts[a:b], bands, rows, n).ravel().view(np.int64))], ["band"])

    return run


def _fit(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes can have the similarity; sizes from MOST_SIZE on always can."""
    up, down = similarity
    small, large = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    return (small * down >= large * up) | (large >= MOST_SIZE)


def _packed(bands: int, rows: int, n: int, parts: int, hot: np.ndarray):
    """Chunks (part, ids, sizes, keys, places): of each record 32 bits of the band's hash, behind those that chose the part, and its 16-bit place in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in ((s, min(s + 50_000, e)) for c, e in textcodes.chunks(texts) for s in range(c, e, 50_000)):
                own = ids[a:b]
                keys = bands_of(texts[a:b], bands, rows, n)
                size = np.minimum(np.diff(sets(texts[a:b], n)[1]), MOST_SIZE).astype(np.uint16)
                crowded = np.isin(keys, hot)
                cold = ~crowded
                place = np.broadcast_to(np.arange(b - a), keys.shape)[cold]
                keys = keys[cold]
                part = ((keys & _U64(0xFFFF)) * _U64(parts) >> _U64(16)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                keys, place = (keys[order] >> _U64(32)).astype(np.uint32), place[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if e > s:
                        # only the ids that this part needs
                        used = np.zeros(b - a, bool)
                        used[place[s:e]] = True
                        at = (np.cumsum(used) - 1)[place[s:e]].astype(np.uint16)
                        out.append((p, np.diff(own[used], prepend=0).astype(np.int64).tobytes(), size[used].tobytes(), keys[s:e].tobytes(), at.tobytes()))
                if crowded.any():
                    # the members of crowded bands, spread over the parts
                    out.append((int(own[0]) % parts, own[crowded.any(0)].tobytes(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], ["part", "ids", "sizes", "keys", "places"])

    return run


def _pairs(similarity: tuple[int, int]):
    """(a, b) of the classes that share a band and may be near by size; b is null for a member of a crowded band."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(a), second], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes = [], [], []
        for batch in batches:
            for own, size, key, place in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
                if key is None:
                    yield out(np.frombuffer(own, np.int64), None)
                    continue
                at = np.frombuffer(place, np.uint16)
                keys.append(np.frombuffer(key, np.uint32))
                ids.append(np.cumsum(np.frombuffer(own, np.int64))[at])
                sizes.append(np.frombuffer(size, np.uint16)[at])
        if not keys:
            return
        key, id_, size = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
        keys.clear(), ids.clear(), sizes.clear()
        order = np.argsort(key, kind="stable")
        key, id_, size = key[order], id_[order], size[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        each = np.repeat(count, count)
        yield out(np.unique(id_[each > CROWD]), None)
        small = (each > 1) & (each <= CROWD)
        key, id_, size = key[small], id_[small], size[small]
        for gap in range(1, CROWD):
            same = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(same):
                break
            same = same[_fit(size[same], size[same + gap], similarity)]
            a, b = id_[same], id_[same + gap]
            for s in range(0, len(a), 1 << 16):
                yield out(np.minimum(a, b)[s : s + (1 << 16)], np.maximum(a, b)[s : s + (1 << 16)])

    return run


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams & _U64(COUNTERS - 1)).astype(np.int64)


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textcodes.chunks(texts):
                counts += np.bincount(_counter(sets(texts[a:b], n)[0]), minlength=COUNTERS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["counter", "n"])

    return run


def _prefixes(similarity: tuple[int, int], n: int, counts):
    """(gram, id, size) of the n-grams of each set's prefix, rare ones first by the sketch of ``counts``."""
    up, down = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in textcodes.chunks(texts):
                h, offsets = sets(texts[a:b], n)
                size = np.diff(offsets)
                text = np.repeat(np.arange(b - a), size)
                h = h[np.lexsort((h, frequency[_counter(h)], text))]
                take = size - -(-size * up // down) + 1
                keep = np.arange(len(h)) - offsets[text] < take[text]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(ids[a:b][text[keep]]), pa.array(size[text[keep]])], ["gram", "id", "size"])

    return run


def _block_pairs(similarity: tuple[int, int]):
    """Pairs (a, b) of one block group that may be near by size: rows are (diagonal, left, left sizes, right, right sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for diagonal, *lists in zip(*(batch.column(c).to_pylist() for c in range(5))):
                left, left_size, right, right_size = (np.array(x, np.int64) for x in lists)
                if diagonal:
                    right, right_size = left, left_size
                for s in range(0, len(left), 64):
                    a, b = np.meshgrid(left[s : s + 64], right, indexing="ij")
                    x, y = np.meshgrid(left_size[s : s + 64], right_size, indexing="ij")
                    keep = (a < b if diagonal else a != b) & _fit(x, y, similarity)
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def crowded_pairs(ids: DataFrame, classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, n: int = WORDS) -> DataFrame:
    """Candidates (a, b) among the crowded classes by a prefix filter: none is lost.

    Two sets of similarity s share an n-gram of the prefixes of n - ceil(s n) + 1
    n-grams under any common order.  The order is by frequency among the crowded
    classes, as far as a sketch of COUNTERS counters tells it, so that what a
    template gives to all of them comes last and joins none.  A prefix n-gram's
    group is cut into blocks of about BLOCK classes, and each pair of blocks is a
    row of its own.
    """
    spark = classes.sparkSession
    texts = written(classes.select("id", "text").join(ids, "id", "left_semi"), "near-crowded")
    sums = texts.mapInArrow(_counted(n), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[sums["counter"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    grams = texts.mapInArrow(_prefixes(similarity, n, spark.sparkContext.broadcast(counts)), "gram bigint, id bigint, size bigint")
    grams = written(grams, "near-prefixes")
    blocks = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = grams.join(blocks, "gram").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = placed.groupBy("gram", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_set(F.struct("id", "size"))).alias("x"))
    lists = written(lists.select("gram", "block", "blocks", F.col("x.id").alias("ids"), F.col("x.size").alias("sizes")), "near-blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = lists.select("gram", "block", "ids", "sizes", other.alias("other")).where("other > block")
    theirs = lists.select(F.col("gram").alias("g"), F.col("block").alias("o"), F.col("ids").alias("right"), F.col("sizes").alias("right_sizes"))
    names = [F.col("ids").alias("left"), F.col("sizes").alias("left_sizes"), "right", "right_sizes"]
    across = mine.join(theirs, (mine.gram == theirs.g) & (mine.other == theirs.o)).select(F.lit(False).alias("diagonal"), *names)
    none = F.array().cast("array<bigint>")
    within = lists.where(F.size("ids") > 1).withColumns({"right": none, "right_sizes": none}).select(F.lit(True).alias("diagonal"), *names)
    return within.unionByName(across).mapInArrow(_block_pairs(similarity), "a bigint, b bigint")


def near(left: list[str], right: list[str], similarity: tuple[int, int] = SIMILARITY, n: int = WORDS) -> np.ndarray:
    """Whether the n-gram sets of each two texts have the similarity."""
    up, down = similarity
    (x, p), (y, q) = sets(left, n), sets(right, n)
    each = np.arange(len(left))
    pair = np.concatenate([np.repeat(each, np.diff(p)), np.repeat(each, np.diff(q))])
    h = np.concatenate([x, y])
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(left))
    either = np.diff(p) + np.diff(q) - both
    return (both * down >= either * up) & (both > 0)


def _verified(similarity: tuple[int, int], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in textcodes.chunks(left, textcodes.BATCH_CHARS // 2):
                keep = pa.array(near(left[a:b], right[a:b], similarity, n))
                yield batch.slice(a, b - a).select([0, 1]).filter(keep)

    return run


def class_pairs(records: DataFrame, similarity: tuple[int, int] = SIMILARITY, n: int = WORDS, copies: bool = False, most_bands: int = MOST_BANDS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near classes as (class_a, class_b), and (row_id, class).

    ``records`` needs row_id and text.  A class is one sequence of words together
    with the fields of a tagged text; copies of one class have the same n-grams.
    Texts of fewer than ``n`` words, null texts and null row_ids belong to none;
    with ``copies``, short texts have classes too, which are in no pair.  Pairs whose letters and digits or whose fields agree are copies, not near, and
    come out only with ``copies``.
    """
    spark = records.sparkSession
    bands, rows = banding(similarity[0] / similarity[1], most_bands=most_bands)
    records = records.where(F.col("row_id").isNotNull() & F.col("text").isNotNull()).select("row_id", "text")
    members = written(records.mapInArrow(_members(n, copies), MEMBERS), "near-members")
    kept = records.mapInArrow(_classes(n, copies), CLASSES).groupBy("class").agg(*[F.first(c).alias(c) for c in ("k1", "k2", "text")])
    classes = written(kept.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    texts = classes.select("id", "text")
    # as many parts as the records need, however many partitions the session has
    parts = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * bands // PART_RECORDS)))

    sampled = written(texts.where(F.pmod(F.xxhash64("id"), F.lit(PART)) == 0).mapInArrow(_sampled_bands(bands, rows, n), "band bigint"), "near-sampled")
    least = max(HOT, sampled.count() / (4 * parts))
    hot = np.array([r.band for r in sampled.groupBy("band").count().where(F.col("count") >= least).select("band").collect()], np.int64).view(_U64)

    chunks = texts.mapInArrow(_packed(bands, rows, n, parts, hot), "part int, ids binary, sizes binary, keys binary, places binary")
    out = written(chunks.repartitionById(parts, "part").mapInArrow(_pairs(similarity), "a bigint, b bigint"), "near-candidates")
    candidates = out.where("b is not null")
    crowded = out.where("b is null").select(F.col("a").alias("id")).distinct()
    if not crowded.isEmpty():
        candidates = candidates.unionByName(crowded_pairs(crowded, classes, similarity, n))
    candidates = candidates.distinct()
    one = classes.select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.col("k1").alias("k1_a"), F.col("k2").alias("k2_a"))
    two = classes.select(F.col("id").alias("b"), F.col("text").alias("text_b"), F.col("k1").alias("k1_b"), F.col("k2").alias("k2_b"))
    both = candidates.join(one, "a").join(two, "b")
    if not copies:
        both = both.where("k1_a <> k1_b and (k2_a is null or k2_b is null or k2_a <> k2_b)")
    named = both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(similarity, n), "a bigint, b bigint")
    named = written(named, "near-verified")
    of = classes.select("id", "class")
    return (
        named.join(of.select(F.col("id").alias("a"), F.col("class").alias("class_a")), "a")
        .join(of.select(F.col("id").alias("b"), F.col("class").alias("class_b")), "b").select("class_a", "class_b"),
        members,
    )


def near_pairs(records: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): each two distinct row_ids whose texts are near, once.

    An empty table gives no pairs; a record delivered again counts once.  The
    members of a class of many copies are spread over tasks.
    """
    pairs, members = class_pairs(records)
    members = written(members.distinct(), "near-members")
    hot = hot_keys(members, "class")
    rows = pairs
    for side, name in (("class_a", "x"), ("class_b", "y")):
        one = members.select(F.col("class").alias(side), F.col("row_id").alias(name))
        rows = by_key(one, rows, side, hot.withColumnRenamed("class", side), F.xxhash64(name))
    rows = rows.where("x <> y")
    return rows.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def near_classes(records: DataFrame) -> DataFrame:
    """(row_id, class_row_id, n_links): each record of three words or more, its class and the number of classes near to it.

    A class are the records with the same words in order and the same fields; it is
    named by its smallest row_id.  A record delivered with several texts comes out
    once for each class it is in.
    """
    pairs, members = class_pairs(records)
    members = written(members.distinct(), "near-members")
    links = pairs.select(F.col("class_a").alias("class")).unionAll(pairs.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.groupBy("class").agg(F.min("row_id").alias("class_row_id")).join(links, "class", "left")
    out = by_key(members, classes, "class", hot_keys(members, "class"), F.xxhash64("row_id"))
    return out.select("row_id", "class_row_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def near_groups(records: DataFrame) -> DataFrame:
    """(row_id, group): the records with a near one, grouped by what such pairs connect.

    A group is named by its smallest row_id and holds all records of its classes; a
    record delivered with several texts may be in several groups.
    """
    pairs, members = class_pairs(records)
    members = written(members.distinct(), "near-members")
    found = components(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).withColumnRenamed("node", "class")
    least = members.groupBy("class").agg(F.min("row_id").alias("least")).join(found, "class")
    named = least.groupBy("component").agg(F.min("least").alias("group"))
    classes = least.join(named, "component").select("class", "group")
    return by_key(members, classes, "class", hot_keys(members, "class"), F.xxhash64("row_id")).select("row_id", "group").distinct()
