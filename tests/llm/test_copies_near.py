import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veritab.llm import copies, neardup, overlap, queries, textcodes, textindex

TEXT = "row_id string, text string"
ALPHABET = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def story(rng, n=None):
    return " ".join(rng.choice(ALPHABET) + str(rng.randrange(9)) for _ in range(n or rng.randrange(3, 40)))


def edited(rng, text, most=3):
    w = text.split()
    for _ in range(rng.randrange(0, most + 1)):
        k = rng.randrange(len(w) + 1)
        what = rng.random()
        if what < 0.4:
            w.insert(k, rng.choice(ALPHABET))
        elif what < 0.7 and len(w) > 3:
            del w[min(k, len(w) - 1)]
        elif k < len(w):
            w[k] = rng.choice(ALPHABET)
    return " ".join(w)


def reformatted(rng, text):
    text = rng.choice([str.upper, str.title, str.lower])(text)
    return rng.choice(["", "  ", "\n"]) + text.replace(" ", rng.choice([" ", "  ", "\n", " - ", ", "])) + rng.choice(["", ".", "!!"])


def tagged(rng, values):
    names = ["Headline", "Place", "Desk", "Story"]
    rng.shuffle(names)
    return rng.choice(["", " | "]).join(f"{rng.choice([n, n.upper()])}{rng.choice(['', ' '])}: {values[n]} " for n in names)


ODD = [
    None, "", "   ", "  ", "!!!", "...", "one", "one two", "one two three", "ONE, two\nthree", "İstanbul İzmir İçel", "i̇stanbul i̇zmir i̇çel",
    "Été chaud très", "été chaud très", "foot ball club city", "football club city", "\U0001f600 \U0001f600", "a_b c_d e_f", "a b c d e f", "Headline: x y", "headline x y", "Headline:",
    "Story: b Headline: a", "Headline: a Story: b", "headline a story b", "Headline: a Headline: a", "xHeadline: a", "中文 字 符", "x" * 5000, ("long words in a row " * 20000).strip(),
]


def fixture(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = story(rng)
        rows.append(base)
        rows += [edited(rng, base) for _ in range(rng.randrange(3))]
        rows += [reformatted(rng, base) for _ in range(rng.randrange(2))]
        if k % 6 == 0:
            values = {x: story(rng, 4) for x in ("Headline", "Place", "Desk", "Story")}
            rows += [tagged(rng, values) for _ in range(3)]
            rows.append(reformatted(rng, tagged(rng, values)).replace(":", ""))
    rows = [(f"{i:04x}", t) for i, t in enumerate(rows + ODD)]
    rng.shuffle(rows)
    return rows + rows[:10] + [(None, "no id has this text"), (None, None)]


def wide(spark, rows):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, TEXT)
    return df.select(*[F.lit(1).alias(c) for c in ("class", "k1", "id", "n", "band", "salt")], "text", "row_id").repartition(5)


def test_kernels():
    texts = [t for t in ODD if t is not None] + [story(random.Random(i)) for i in range(50)]
    hashes, offsets = textcodes.words(texts)
    seen = {}
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        w = brute.words(t)
        assert len(w) == b - a
        for x, h in zip(w, hashes[a:b].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    keys = textcodes.letter_keys(texts)
    assert {(brute.letters(a) == brute.letters(b)) == (x == y) for a, x in zip(texts, keys) for b, y in zip(texts, keys)} == {True}
    fields = textcodes.field_keys(texts)
    assert [k is None for k in fields] == [brute.fields(t) is None for t in texts]
    assert [r for r in textcodes.chunks(["a" * 9, "b" * 30, "", "c"], 10)] == [(0, 1), (1, 2), (2, 4)]
    grams, at = neardup.sets(texts)
    assert np.diff(at).tolist() == [len(brute.grams(t)) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_copies(spark, seed):
    rows = fixture(seed)
    sets = copies.copy_sets(wide(spark, rows))
    assert {tuple(r) for r in copies.found(sets).collect()} == brute.copy_sets(rows)
    kept = copies.collapsed(sets).collect()
    distinct = {i for i, t in rows if i is not None and not brute.blank(t)}
    assert sum(r["n_records"] for r in kept) == len(distinct) and len({r["row_id"] for r in kept}) == len(kept)


def test_a_hot_key(spark):
    df = spark.range(9000).select(F.format_string("%05d", "id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("The same"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")), F.lit("story."))).otherwise(F.concat(F.lit("story "), "id")).alias("text"))
    rows = copies.found(copies.copy_sets(df.unionAll(df.limit(50)))).collect()
    assert len(rows) == 2999 and {r["first_row_id"] for r in rows} == {"00000"}


def test_copies_of_nothing(spark):
    for rows in ([], [("a", None), ("b", " "), (None, "x")]):
        assert copies.copy_sets(spark.createDataFrame(rows, TEXT)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_near_pairs(spark, seed):
    rows = fixture(seed)
    found = [tuple(r) for r in neardup.near_pairs(wide(spark, rows)).collect()]
    assert len(found) == len(set(found))
    # banding has a recall of RECALL at the very threshold and more above it
    truth = brute.near_pairs(rows)
    assert set(found) <= truth and len(found) >= 0.99 * len(truth) > 50
    assert neardup.near_pairs(spark.createDataFrame([], TEXT)).count() == 0


def test_crowded_bands_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = story(rng, 40)
    rows = [(f"{i:03d}", edited(rng, base, 6)) for i in range(90)] + [(f"x{i:03d}", story(rng)) for i in range(60)]
    truth = brute.near_pairs(rows)
    assert len(truth) > 1000
    for name, value in (("CROWD", 4), ("BLOCK", 16)):
        monkeypatch.setattr(neardup, name, value)
    for part in (64, 1):  # with 1, hot bands are known before the shuffle
        monkeypatch.setattr(neardup, "PART", part)
        found = {tuple(r) for r in neardup.near_pairs(wide(spark, rows)).collect()}
        assert found <= truth and len(found) >= 0.998 * len(truth)
    # the exact way itself loses nothing
    classes = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "id bigint, text string")
    exact = {tuple(r) for r in neardup.crowded_pairs(classes.select("id"), classes).collect()}
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert {tuple(sorted((place[a], place[b]))) for a, b in truth} <= exact


@pytest.mark.parametrize("seed", [3, 5])
def test_near_groups_and_classes(spark, seed):
    rows = fixture(seed, 40)
    truth = {tuple(r) for r in neardup.near_pairs(wide(spark, rows)).collect()}
    neighbours = {}
    for a, b in truth:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    groups = {}
    for i in sorted(neighbours):
        waiting = [i] if i not in groups else []
        while waiting:
            j = waiting.pop()
            if j not in groups:
                groups[j] = i
                waiting += neighbours[j]
    assert {tuple(r) for r in neardup.near_groups(wide(spark, rows)).collect()} == set(groups.items()) and len(groups) > 20
    classes = neardup.near_classes(wide(spark, rows)).collect()
    assert {r["row_id"] for r in classes} == {i for i, t in rows if i is not None and t is not None and len(brute.words(t)) >= 3}
    assert {r["row_id"] for r in classes if r["n_links"]} == set(neighbours)
    assert len({r["class_row_id"] for r in classes}) == len({(tuple(brute.words(t)), brute.fields(t)) for i, t in rows if i is not None and t is not None and len(brute.words(t)) >= 3})
    assert neardup.near_groups(spark.createDataFrame([], TEXT)).count() == 0


def test_a_class_in_a_third_of_the_rows(spark):
    rng = random.Random(3)
    hot, other = story(rng, 30), story(rng, 30)
    near = hot + " epilogue"
    texts = {f"h{i:04d}": hot for i in range(1500)} | {f"o{i:04d}": story(rng, 8) for i in range(1500)} | {"n0": near, "n1": near.upper(), "z": other}
    found = neardup.near_pairs(spark.createDataFrame(list(texts.items()), TEXT)).collect()
    assert {tuple(r) for r in found} >= {(f"h{i:04d}", n) for i in range(1500) for n in ("n0", "n1")} and len(found) == 3000
    groups = neardup.near_groups(spark.createDataFrame(list(texts.items()), TEXT)).collect()
    assert {r["group"] for r in groups} == {"h0000"} and len(groups) == 1502


def test_a_template_below_the_threshold(spark):
    # 50,000 texts of one template; all pairs of it would be 1.25 billion
    rng = np.random.default_rng(1)
    template = " ".join(f"t{i}" for i in range(40))
    own = rng.integers(0, 1 << 40, (50_000, 45))
    texts = [f"{template} " + " ".join(f"w{x:x}" for x in r) for r in own.tolist()]
    texts[7] = texts[11] + " more"
    df = spark.createDataFrame([(f"{i:05d}", t) for i, t in enumerate(texts)], TEXT)
    assert [tuple(r) for r in neardup.near_pairs(df).collect()] == [("00007", "00011")]


def test_banding():
    assert neardup.banding(0.6) == (50, 4)
    for s in (0.5, 0.6, 0.8, 0.95):
        b, r = neardup.banding(s)
        assert 1 - (1 - s**r) ** b >= neardup.RECALL


@pytest.mark.parametrize("shard_words", [60, 10**6])
def test_overlaps(spark, shard_words):
    rng = random.Random(5)
    rows = fixture(6, 60)
    members = []
    for i, t in rows:
        s = rng.choice([" Train", "train", "VALIDATION ", "test\n", None, "other"])
        members.append((s, i, t, 1, rng.choice(["x", None])))
    members += [("train", "0001", "another text of this row here", 1, "x"), ("test", "0001", "and one more text there", 1, "x"), ("validation", None, "one two three", 1, "x")]
    df = spark.createDataFrame(members, "split string, row_id string, text string, label int, source string").select("*", F.lit(1).alias("class"), F.lit(2).alias("shard")).repartition(3)
    name = lambda s: (s or "").strip().lower()
    train = [(i, t) for s, i, t, *_ in members if name(s) == "train"]
    ids = {i for i, _ in train} - {None}
    truth = {(name(s), i) for s, i, t, *_ in members if name(s) in ("validation", "test") and i is not None and (i in ids or any(brute.copies(t, u) or brute.near(t, u) for _, u in train))}
    out = overlap.overlaps(df, shard_words)
    assert {tuple(r) for r in overlap.found(out).collect()} == truth and len(truth) > 20
    report = overlap.report(out, df).collect()
    assert {(r["split"], r["source"]) for r in report} == {(name(s), x) for s, i, _, _, x in members if name(s) in ("validation", "test") and i is not None}
    assert overlap.found(overlap.overlaps(df.limit(0))).count() == 0


def runs_of(a, b):
    """Longest common run of words, distinct common runs of three, and the words of b in common runs."""
    x, y = brute.words(a), brute.words(b)
    g = {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
    inside = {k for i in range(len(y) - 2) if tuple(y[i : i + 3]) in g for k in range(i, i + 3)}
    best, row = 0, [0] * (len(y) + 1)
    for w in x:
        row = [0] + [row[j] + 1 if w == y[j] else 0 for j in range(len(y))]
        best = max(best, max(row))
    spans = [(s, next(e for e in range(s, len(y) + 1) if e not in inside)) for s in sorted(inside) if s - 1 not in inside]
    return best, len(g & brute.grams(b)), spans


@pytest.mark.parametrize("sweep", [50, 10**6])
def test_links(spark, sweep):
    rng = random.Random(8)
    base = [story(rng) for _ in range(25)] + ["a b " * 12, "x y z " * 9]
    rows = [("train", f"t{k}", edited(rng, rng.choice(base))) for k in range(70)] + [("test", f"j{k}", edited(rng, rng.choice(base))) for k in range(70)]
    df = spark.createDataFrame(rows, "split string, row_id string, text string").repartition(3)
    train, judged = overlap.keyed(df)
    found = overlap.near_links(judged.where("class is not null"), train.where("class is not null"), 300, sweep).collect()
    key = lambda t: textcodes.word_keys(*textcodes.words([t]))[0]
    truth = {}
    for s, _, t in rows:
        for _, _, u in (r for r in rows if s == "train" and r[0] == "test"):
            x, y = brute.grams(t), brute.grams(u)
            if x and y and 5 * len(x & y) >= 3 * len(x | y):
                best, shared, spans = runs_of(t, u)
                truth[key(t), key(u)] = (shared, len(x | y), best, spans)
    out = {(bytes(r[0]), bytes(r[1])): (r[2], r[3], r[4], [tuple(x) for x in r[5]]) for r in found}
    assert out == truth and len(out) == len(found) > 30
    rows_ = {(r["split"], r["row_id"]): r for r in overlap.overlaps(df, 300).collect()}
    for s, i, u in rows:
        if s == "test":
            mine = [(k, v) for k, v in truth.items() if k[1] == key(u)]
            words = {w for _, v in mine for a, b in v[3] for w in range(a, b)}
            r = rows_[s, i]
            assert (r["n_links"] or 0, r["longest"] or 0, r["n_words"] or 0) == (len(mine), max((v[2] for _, v in mine), default=0), len(words)), i
            assert (r["train_row_id"] is None) == (not mine)
    pairs = overlap.links(df, 300).collect()
    assert len(pairs) == len(truth) and all(r["row_id"][0] == "j" and r["train_row_id"][0] == "t" for r in pairs)


def test_a_text_in_a_third_of_both_sides(spark):
    rng = random.Random(2)
    hot = story(rng, 40)
    rows = [(s, f"{s}{k}", hot if k % 3 == 0 else story(rng, 12)) for s in ("train", "test") for k in range(300)]
    out = overlap.overlaps(spark.createDataFrame(rows, "split string, row_id string, text string"), 500).where("near").collect()
    assert {r["row_id"] for r in out} == {f"test{k}" for k in range(0, 300, 3)}
    assert {(r["copy"], r["n_links"], r["longest"], r["n_spans"], r["n_words"], r["train_row_id"]) for r in out} == {(True, 1, 40, 1, 40, "train0")}


def test_word_index():
    rng = random.Random(0)
    texts = [story(rng, 60) for _ in range(300)] + ["a b a b a b a b a b", "a b a b", "x " * 5000]
    index = textindex.WordIndex(textindex.WordIndex.built(texts).blobs)
    lines = [brute.words(t) for t in texts]
    got, want = index.words_of(np.arange(len(texts))), textcodes.words(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    for query in ("a b a", "b a b", "x x x", " ".join(lines[3][5:8]), "never seen words"):
        hashes, _ = textcodes.words([query])
        low, high = index.runs(index.numbers(hashes), np.array([0]), 3)
        w = query.split()
        place = index.located(np.arange(low[0], high[0]))
        text = index.texts_at(place)
        assert sorted(zip(text.tolist(), (place - index.starts[text]).tolist())) == [(k, i) for k, l in enumerate(lines) for i in range(len(l)) if l[i : i + 3] == w]
    hashes, offsets = textcodes.words([" ".join(lines[4][10:31]) + " unseen " + " ".join(lines[7][:5])])
    longest = index.longest(index.numbers(hashes), offsets)
    assert longest[20] == 21 and longest[21] == 0 and longest.max() == 21


def test_the_filter_misses_nothing():
    grams = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    held = textindex.Filter(textindex.Filter.built(grams[:20_000]))
    assert held(grams[:20_000]).all() and held(grams[20_000:]).mean() < 0.08
    assert not textindex.Filter(textindex.Filter.built(grams[:0]))(grams).any()


@pytest.mark.parametrize("n", [0, 1, 2, 50, 400])
def test_suffix_array(n):
    line = np.random.default_rng(n).integers(0, 3, n)
    order = textindex.suffix_array(line)
    assert order.tolist() == sorted(range(n), key=lambda i: line[i:].tolist())


def test_queries_are_all_named_for_their_problem():
    assert all(q[0] == "p" and q[1].isdigit() for q in queries.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
