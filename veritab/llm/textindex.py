"""A compressed full-text index over the words of some texts.

The texts stand in one line of word numbers, a 0 behind each.  Of the transform of
that line (the word before each suffix, in the order of suffixes) backward search
needs, for each word, the sorted places where it stands.  These lists are kept in
blocks: the first place plain, the others as packed distances to it.  The line
itself is packed at the width of the greatest word number, and of the suffix array
only the places divisible by SAMPLED and the ends of texts are kept; the other ones are found by walking
on from suffix to suffix, which the same lists allow.  A Bloom filter of the runs of
words tells which texts needn't ask this index at all.
"""

from __future__ import annotations

import numpy as np

from veritab.llm import textcodes

BLOCK = 64
SAMPLED = 16
#: Bits of the filter for each run of words, before rounding up to a power of two.
FILTER_BITS = 8
_U64 = np.uint64


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; values are below 2^53."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


class Bits:
    """Unsigned numbers of up to 56 bits at given places of a string of bits."""

    def __init__(self, raw: bytes):
        self.raw = raw
        # every byte begins a 64-bit number
        self.at = np.ndarray((max(0, len(raw) - 7),), np.dtype("<u8"), raw, strides=(1,))

    def __call__(self, place: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.asarray(width, np.int64).astype(_U64)
        value = self.at[place >> 3] >> (place & 7).astype(_U64)
        return (value & ((_U64(1) << width) - _U64(1))).astype(np.int64)


def packed(values: np.ndarray, place: np.ndarray, bits: int) -> bytes:
    """The values as a string of bits; places rise, and no two values overlap."""
    out = np.zeros(bits // 64 + 3, _U64)
    if len(values):
        v, word, shift = values.astype(_U64), place >> 6, (place & 63).astype(_U64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] |= np.bitwise_or.reduceat(v << shift, first)
        over = np.where(shift > 0, v >> ((_U64(64) - shift) & _U64(63)), _U64(0))
        out[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    return out.tobytes()


def suffix_array(line: np.ndarray) -> np.ndarray:
    """By prefix doubling, as many symbols at once as 63 bits hold."""
    n = len(line)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(line.max()).bit_length() + 1
    rank = line.astype(np.int64) + 1  # 0 stands for the end of everything
    reach = 1
    while True:
        together = max(2, 62 // max(bits, 1))
        key = np.zeros(n, np.int64)
        for k in range(together):
            key <<= bits
            if k * reach < n:
                key[: n - k * reach] |= rank[k * reach :]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        del key
        rank[order] = np.cumsum(new)
        reach *= together
        if new.all():
            return order
        bits = n.bit_length() + 1


class Filter:
    """A Bloom filter of run hashes with two bits for each."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw, np.uint8)
        self.mask = _U64(8 * len(self.bytes) - 1)

    @staticmethod
    def built(grams: np.ndarray) -> bytes:
        size = 1 << max(9, int(FILTER_BITS * max(1, len(grams)) - 1).bit_length())
        bits = np.zeros(size, bool)
        for h in (grams, grams >> _U64(31)):
            bits[(h & _U64(size - 1)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Whether each run may occur; one that does is never missed."""
        out = np.ones(len(grams), bool)
        for h in (grams, grams >> _U64(31)):
            at = np.flatnonzero(out)
            place = h[at] & self.mask
            out[at] = (self.bytes[(place >> _U64(3)).astype(np.int64)] >> (place & _U64(7)).astype(np.uint8)) & 1 == 1
        return out


class WordIndex:
    """Backward search, location and extraction over the words of some texts."""

    NAMES = ("vocabulary", "starts", "word_at", "base", "bit_at", "width", "distances", "line", "marked", "samples")
    TYPES = {"vocabulary": _U64, "starts": np.int32, "word_at": np.int32, "base": np.int32, "bit_at": np.uint32, "width": np.uint8, "marked": _U64, "samples": np.int32}

    def __init__(self, blobs: dict[str, bytes]):
        self.blobs = blobs
        for name, kind in self.TYPES.items():
            setattr(self, name, np.frombuffer(blobs[name], kind))
        self.n = int(self.word_at[-1])
        self.distances, self.line = Bits(blobs["distances"]), Bits(blobs["line"])
        self.line_width = len(self.vocabulary).bit_length()
        # what follows from the rest: each word's first block, the order of all blocks, counts of marks
        size = np.diff(self.word_at).astype(np.int64)
        self.first_block = np.concatenate(([0], np.cumsum(-(-size // BLOCK))))
        word = np.repeat(np.arange(len(size)), -(-size // BLOCK))
        self.block_key = word * self.n + self.base
        self.marks_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marked), dtype=np.int64)))

    @classmethod
    def built(cls, texts: list[str]) -> WordIndex:
        hashes, offsets = textcodes.words(texts)
        vocabulary, ids = np.unique(hashes, return_inverse=True)
        del hashes
        # word numbers from 1; 0 ends each text
        line = np.zeros(len(ids) + len(texts), np.int64)
        line[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = ids + 1
        del ids
        starts = offsets[:-1] + np.arange(len(texts))
        n = len(line)
        suffixes = suffix_array(line)
        before = line[suffixes - 1]  # the last end of text precedes the first suffix
        row = np.argsort(before, kind="stable")
        size = np.bincount(before, minlength=len(vocabulary) + 1)
        del before
        word_at = np.concatenate(([0], np.cumsum(size)))
        blocks = -(-size // BLOCK)
        first_block = np.concatenate(([0], np.cumsum(blocks)))
        inside = np.arange(n) - np.repeat(word_at[:-1], size)
        block = np.repeat(first_block[:-1], size) + inside // BLOCK
        lead = np.flatnonzero(inside % BLOCK == 0)
        base = row[lead]
        count = np.diff(np.append(lead, n))
        distance = row - base[block]
        width = bit_lengths(distance[lead + count - 1])
        bit_at = np.concatenate(([0], np.cumsum(count * width)))
        some = width[block] > 0
        place = bit_at[block] + inside % BLOCK * width[block]
        distances = packed(distance[some], place[some], int(bit_at[-1]))
        w = len(vocabulary).bit_length()
        # ends of texts too, so that no walk leaves its text
        marked = (suffixes % SAMPLED == 0) | (line[suffixes] == 0)
        bits = np.packbits(np.concatenate((marked, np.zeros(-n % 64, bool))), bitorder="little").tobytes()
        values = {"vocabulary": vocabulary, "starts": starts, "word_at": word_at, "base": base, "bit_at": bit_at[:-1], "width": width, "samples": suffixes[marked]}
        blobs = {k: np.ascontiguousarray(v, cls.TYPES[k]).tobytes() for k, v in values.items()}
        return cls(blobs | {"distances": distances, "line": packed(line, np.arange(n) * w, n * w), "marked": bits})

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0, which no search matches, for words that don't occur."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def _row(self, word: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The place, in the order of suffixes, of the first suffix that ``word`` begins and that goes on at ``bound`` or behind."""
        first = self.first_block[word]
        block = np.searchsorted(self.block_key, word * self.n + bound) - 1
        none = block < first
        block = np.maximum(block, first)
        begin = self.word_at[word].astype(np.int64) + (block - first) * BLOCK
        low = np.where(none, 0, 1)
        high = np.where(none, 0, np.minimum(BLOCK, self.word_at[word + 1] - begin))
        bit, width = self.bit_at[block].astype(np.int64), self.width[block].astype(np.int64)
        rest = bound - self.base[block]
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = self.distances(bit[live] + mid * width[live], width[live]) < rest[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return begin + low

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with ``word`` followed by what [low, high) begin with."""
        return self._row(word, low), self._row(word, high)

    def runs(self, words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the runs of n words that begin at ``at``; empty ones where none occurs."""
        low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        whole = words[at] > 0
        for k in range(1, n):
            whole &= words[at + k] > 0
        live = np.flatnonzero(whole)
        word = words[at[live] + n - 1]
        low[live], high[live] = self.word_at[word], self.word_at[word + 1]
        for k in range(n - 2, -1, -1):
            low[live], high[live] = self.step(words[at[live] + k], low[live], high[live])
            live = live[high[live] > low[live]]
        high[low >= high] = low[low >= high]
        return low, high

    def onward(self, row: np.ndarray) -> np.ndarray:
        """The suffix one word further on of each suffix."""
        word = np.searchsorted(self.word_at, row, "right") - 1
        inside = row - self.word_at[word]
        block = self.first_block[word] + inside // BLOCK
        width = self.width[block].astype(np.int64)
        return self.base[block] + self.distances(self.bit_at[block].astype(np.int64) + inside % BLOCK * width, width)

    def located(self, row: np.ndarray) -> np.ndarray:
        """Where in the line the suffixes begin."""
        out = np.empty(len(row), np.int64)
        live, row = np.arange(len(row)), row.astype(np.int64)
        for steps in range(SAMPLED):
            word, bit = row >> 6, (row & 63).astype(_U64)
            here = (self.marked[word] >> bit) & _U64(1) == 1
            w, b = word[here], bit[here]
            rank = self.marks_before[w] + np.bitwise_count(self.marked[w] & ((_U64(1) << b) - _U64(1)))
            out[live[here]] = self.samples[rank] - steps
            live, row = live[~here], row[~here]
            if not len(live):
                break
            row = self.onward(row)
        return out

    def texts_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def words_of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, offsets) of the given texts, as textcodes.words() gives them."""
        ends = np.append(self.starts[1:], self.n) - 1  # without the 0 behind
        start = self.starts[texts].astype(np.int64)
        size = ends[texts] - start
        offsets = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
        return self.vocabulary[self.line(place * self.line_width, self.line_width) - 1], offsets

    def size(self) -> int:
        """Bytes of the index; what is derived on loading takes about 8 for each block and mark word more."""
        return sum(map(len, self.blobs.values()))

    def longest(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each place, the words of the maximal match with any text of the index that ends with it."""
        begin = np.repeat(offsets[:-1], np.diff(offsets))
        live = np.flatnonzero(words > 0)
        low, high = self.word_at[words[live]].astype(np.int64), self.word_at[words[live] + 1].astype(np.int64)
        length = np.zeros(len(words), np.int64)
        length[live] = 1
        while len(live):
            at = live - length[live]
            inside = (at >= begin[live]) & (words[at] > 0)
            live, at, low, high = live[inside], at[inside], low[inside], high[inside]
            low, high = self.step(words[at], low, high)
            more = high > low
            live, low, high = live[more], low[more], high[more]
            length[live] += 1
        return length
