"""Plain versions of the operators, by their definitions."""

from __future__ import annotations

import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")
TAG = regex.compile(r"(?<![\p{L}\p{N}])(headline|place|desk|story)\s*:", regex.I)


def words(text):
    return WORD.findall((text or "").lower())


def letters(text):
    return "".join(words(text))


def fields(text):
    first = WORD.search(text)
    tags = list(TAG.finditer(text))
    if not tags or not first or tags[0].start() != first.start():
        return None
    ends = [t.start() for t in tags[1:]] + [len(text)]
    return frozenset((t[1].lower(), letters(text[t.end() : e])) for t, e in zip(tags, ends))


def blank(text):
    return text is None or not text.strip()


def copies(a, b):
    if blank(a) or blank(b):
        return False
    return letters(a) == letters(b) or (fields(a) is not None and fields(a) == fields(b))


def grams(text):
    w = words(text)
    return set(zip(w, w[1:], w[2:]))


def near(a, b):
    x, y = grams(a), grams(b)
    return bool(x and y) and not copies(a, b) and 5 * len(x & y) >= 3 * len(x | y)


def copy_sets(rows):
    """{(first, other)} of (row_id, text), closed under being copies."""
    rows = sorted({(i, t) for i, t in rows if i is not None and not blank(t)})
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if copies(t, u):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(root(i), i) for i, _ in rows if root(i) != i}


def near_pairs(rows):
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    return {tuple(sorted((i, j))) for k, (i, t) in enumerate(rows) for j, u in rows[:k] if i != j and near(t, u)}


def shared_spans(rows, span=160):
    first, several = {}, set()
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    for i, t in rows:
        for s in range(len(t) - span + 1):
            if first.setdefault(t[s : s + span], i) != i:
                several.add(t[s : s + span])
    out = set()
    for i, t in rows:
        shared = set()
        for s in range(len(t) - span + 1):
            if t[s : s + span] in several:
                shared.update(range(s, s + span))
        for s in shared:
            if s - 1 not in shared:
                e = s
                while e in shared:
                    e += 1
                out.add((i, s, e))
    return out
