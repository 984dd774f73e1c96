import random

from pyspark.sql import functions as F

from tests.llm import brute
from veritab.llm import paragraphs

TEXT = "doc_id bigint, text string"


def grams(text):
    w = brute.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = {n for e in edges for n in e}
    assert dict(map(tuple, paragraphs.components(df).collect())) == roots(nodes, edges)
    assert paragraphs.components(df.limit(0)).count() == 0


def test_places(spark):
    text = "one\r\n\r\n two \n\n\nthree" + chr(0x2029) + "four\n"
    rows = paragraphs.paragraphs(spark.createDataFrame([(7, text), (8, None), (9, " \n "), (None, "x")], TEXT)).collect()
    assert [text[r["start"] : r["stop"]] for r in sorted(rows, key=lambda r: r["start"])] == ["one", " two ", "three", "four"]
    assert {r["doc_id"] for r in rows} == {7}


def test_duplicate_paragraphs(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(5000))
    stock = [[word() for _ in range(rng.randrange(30, 80))] for _ in range(15)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(stock)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(2, 50))]
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            parts.append(" ".join(p))
        docs.append("\n\n".join(parts))
    rows = list(enumerate(docs)) + [(100, docs[0]), (101, ""), (102, None)]
    df = spark.createDataFrame(rows, TEXT).withColumn("component", F.lit("taken"))
    units = [(r["doc_id"], r["start"], r["text"]) for r in paragraphs.paragraphs(df).collect()]
    units = [u for u in units if len(brute.words(u[2])) >= 5]
    edges = [(a[:2], b[:2]) for k, a in enumerate(units) for b in units[:k] if 5 * len(grams(a[2]) & grams(b[2])) >= 4 * len(grams(a[2]) | grams(b[2]))]
    truth = {n: r for n, r in roots({n for e in edges for n in e}, edges).items()}
    found = {(r["doc_id"], r["start"]): (r["component"], r["removed"]) for r in paragraphs.duplicate_paragraphs(df).collect()}
    assert found == {n: (f"{r[0]}:{r[1]}", n != r) for n, r in truth.items()} and len(found) > 60
    assert paragraphs.duplicate_paragraphs(df.limit(0)).count() == 0


def test_copies_of_short_paragraphs(spark):
    docs = ["Thank you!\n---\none two three four\nalone", "thank  you\n***\none two three five", "x\n ---\nThank you.\nyou thank", "one two three four\n\n***\nSee a b c d e"]
    df = spark.createDataFrame(list(enumerate(docs)), TEXT)
    units = [(r["doc_id"], r["start"], r["text"]) for r in paragraphs.paragraphs(df).collect()]
    groups = {}
    for doc, start, text in sorted(units):
        groups.setdefault(tuple(brute.words(text)) or text.strip(), []).append((doc, start))
    truth = {m: (f"{g[0][0]}:{g[0][1]}", m != g[0]) for g in groups.values() if len(g) > 1 for m in g}
    found = {(r["doc_id"], r["start"]): (r["component"], r["removed"]) for r in paragraphs.duplicate_paragraphs(df).collect()}
    assert found == truth and len(found) == 9
