"""Vectorised text kernels shared by the operators of this subpackage.

A batch of texts becomes one array of code points; words, canonical keys and
n-gram hashes come out of array operations over it, with no loop over words or
characters.  Every kernel works on whole texts of any length: batches are cut by
characters, and a text longer than a batch is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: The names of the tags that begin a field.
TAGS = ("headline", "place", "desk", "story")
BATCH_CHARS = 1 << 20
_TAG = regex.compile(r"(?<![\p{L}\p{N}])(headline|place|desk|story)\s*:", regex.IGNORECASE)
_FIRST = regex.compile(r"[^\p{L}\p{N}]*(?:headline|place|desk|story)\s*:", regex.IGNORECASE)
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two rounds of shift, xor, multiply)."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


@lru_cache(1)
def letters_and_digits() -> np.ndarray:
    """For each code point, whether its category is L or N."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.zeros(0x110000, bool)
    for found in regex.finditer(r"[\p{L}\p{N}]+", every):
        a, b = ord(found[0][0]), ord(found[0][-1])
        table[a : b + 1] = True
    table[0xD800:0xE000] = False
    return table


@lru_cache(2)
def code_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each code point."""
    with np.errstate(over="ignore"):
        return mix(np.arange(0x110000, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


#: Odd bases of the polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse."""
    if k not in _powers or len(_powers[k][0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for base in (BASES[k], pow(BASES[k], -1, 1 << 64)):
            row = np.full(size, base, _U64)
            row[0] = 1
            out.append(np.cumprod(row, dtype=_U64))
        _powers[k] = tuple(out)
    return _powers[k]


def prefix(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * powers(k, len(values))[0][: len(values)], out=out[1:])
    return out


def segments(pre: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the segments [start, end) from ``prefix``; the length enters too."""
    h = (pre[end] - pre[start]) * powers(k, len(pre))[1][start]
    return mix(h + (end - start).astype(_U64) * _U64(0xA0761D6478BD642F))


def chunks(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed; starts and ends."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    return points, ends - lengths, ends


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words) of lower-cased texts."""
    points, _, ends = codes([t.lower() for t in texts])
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = letters_and_digits()[points]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = segments(prefix(code_values(1)[points], 0), start, end, 0)
    return hashes, np.concatenate(([0], np.searchsorted(start, ends)))


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, offsets of each text's runs)."""
    if len(hashes) < n:
        return np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
    h = np.zeros(len(hashes) - n + 1, _U64)
    for i in range(n):
        h = mix(h * _U64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = text[: len(h)] == text[n - 1 :]
    return h[own], np.concatenate(([0], np.cumsum(np.bincount(text[: len(h)][own], minlength=len(offsets) - 1))))


def distinct_per_text(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values, sorted, without repeats."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(text[keep], minlength=len(offsets) - 1))))


def pairs128(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    raw = np.stack([a, b], 1).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def word_keys(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit key of each text's sequence of words."""
    return pairs128(*(segments(prefix(mix(hashes + _U64(k)), k), offsets[:-1], offsets[1:], k) for k in (0, 1)))


def letter_keys(texts: list[str]) -> list[bytes]:
    """A 128-bit key of each text's lower-cased letters and digits, in order."""
    points, starts, ends = codes([t.lower() for t in texts])
    inside = letters_and_digits()[points]
    count = np.concatenate(([0], np.cumsum(inside)))
    kept = points[inside]
    return pairs128(*(segments(prefix(code_values(k + 1)[kept], k), count[starts], count[ends], k) for k in (0, 1)))


def fields(text: str) -> list[tuple[str, str]] | None:
    """The fields of a tagged text as (tag, value); null if it isn't tagged."""
    if not _FIRST.match(text):
        return None
    tags = list(_TAG.finditer(text))
    ends = [t.start() for t in tags[1:]] + [len(text)]
    return [(t[1].lower(), text[t.end() : e]) for t, e in zip(tags, ends)]


def field_keys(texts: list[str]) -> list[bytes | None]:
    """A 128-bit key of each tagged text's set of fields; null for other texts."""
    out: list[bytes | None] = [None] * len(texts)
    found = [(i, f) for i, t in enumerate(texts) if (f := fields(t))]
    values = letter_keys([v for _, f in found for _, v in f]) if found else []
    k = 0
    joined = []
    for _, f in found:
        own = {(tag, values[k + j]) for j, (tag, _) in enumerate(f)}
        k += len(f)
        joined.append("".join(f"{tag}={key.hex()};" for tag, key in sorted(own)))
    for (i, _), key in zip(found, letter_keys(joined) if joined else []):
        out[i] = key
    return out


def copy_keys(texts: list[str | None]) -> tuple[list[bytes | None], list[bytes | None]]:
    """(key of the letters and digits, key of the fields); both null for a blank text."""
    one: list[bytes | None] = [None] * len(texts)
    two: list[bytes | None] = [None] * len(texts)
    real = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    for a, b in chunks(own := [texts[i] for i in real]):
        for i, x, y in zip(real[a:b], letter_keys(own[a:b]), field_keys(own[a:b])):
            one[i], two[i] = x, y
    return one, two
