"""Encoding with a public BPE tokenizer by a pair occurrence index.

The distinct pretokens of a block of rows are laid out as one sequence of
symbols.  An index maps each mergeable pair to all its positions there; active
ranks are applied in ascending order, each to all positions of its pair at once,
and only the lists of the pairs next to a merge are updated.

Three kinds of files are read: byte-level BPE, BPE with word ends, and ranks of
byte strings.  Any other setting in a file is refused, not ignored.
"""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: How byte-level BPE, and BPE with word ends, cut a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The settings of the two kinds of JSON files.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": BYTES | {"use_regex": True}, "end_of_word_suffix": None}
WORD_ENDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, BYTES | {"use_regex": False}]},
    "end_of_word_suffix": "</w>",
}
#: Settings of a model that change ids and that no supported file has.
OFF = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
#: The largest tokenizer file that is sent to the executors.
MOST_BYTES = 64 << 20
#: Pretokens kept between batches of a partition; beyond it the store starts anew.
MOST_KEPT = 1 << 20
DEAD = -1


class PairIndex:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".tiktoken"):
            self._from_ranks(data)
        elif name.endswith(".json"):
            self._from_json(name, json.loads(data))
        else:
            raise ValueError(f"{name} is no tokenizer of a supported kind")

    def _from_json(self, name: str, file: dict) -> None:
        model = file["model"]
        found = {"normalizer": file.get("normalizer"), "pre_tokenizer": file.get("pre_tokenizer"), "end_of_word_suffix": model.get("end_of_word_suffix")}
        if model.get("type", "BPE") != "BPE" or found not in (BYTE_LEVEL, WORD_ENDS) or any(model.get(k) for k in OFF):
            raise ValueError(f"{name} has settings that aren't supported: {found | {k: model.get(k) for k in OFF}}")
        end = found["end_of_word_suffix"]
        vocab = model["vocab"]
        # the printable stand-ins of the 256 bytes: themselves, or 256 upwards in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = [vocab[stand_in[b]] for b in range(256)]
        self.last_ids = [vocab[stand_in[b] + end] for b in range(256)] if end else self.byte_ids
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in merges]
        self.width = max(vocab.values()) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.pattern, self.words = (WORDS, True) if end else (PRETOKEN, False)
        # a pair is learned after its parts, so no merge makes a pair of a lower rank
        self.ordered = True

    def _from_ranks(self, data: bytes) -> None:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.byte_ids = self.last_ids = [ids[bytes([b])] for b in range(256)]
        self.width = max(ids.values()) + 1
        # a token's id is its rank, whatever two tokens it is put together of
        self.rank = {ids[t[:k]] * self.width + ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.made = list(range(self.width))
        self.pattern, self.words, self.ordered = PRETOKEN, False, False

    def pretokens(self, texts: list[str | None]) -> list[list[str]]:
        find = regex.compile(self.pattern).findall
        if self.words:
            # lower case by single characters: the last sigma of a word is no other one
            texts = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() if t else t for t in texts]
        return [find(t) if t else [] for t in texts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        sym: list[int] = [DEAD]
        first = []
        byte_ids, last_ids = self.byte_ids, self.last_ids
        for w in words:
            first.append(len(sym))
            sym.extend([byte_ids[b] for b in w])
            if w:
                sym[-1] = last_ids[w[-1]]
            sym.append(DEAD)  # no pair reaches over it
        before = list(range(-1, len(sym) - 1))
        after = list(range(1, len(sym) + 1))
        rank, width, ordered = self.rank, self.width, self.ordered
        places: dict[int, list[int]] = {}
        active: list[int] = []

        def note(i: int, j: int) -> None:
            a, b = sym[i], sym[j]
            if a >= 0 and b >= 0 and (r := rank.get(a * width + b)) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
                    heappush(active, r)

        for i in range(len(sym) - 1):
            note(i, i + 1)
        while active:
            r = heappop(active)
            made = self.made[r]
            where = places.pop(r)
            where.sort()  # overlapping pairs merge from the left
            for at, i in enumerate(where):
                j = after[i]
                a, b = sym[i], sym[j] if j < len(sym) else DEAD
                if a < 0 or b < 0 or rank.get(a * width + b) != r:
                    continue
                k = after[j]
                sym[i], sym[j] = made, DEAD - 1
                after[i] = k
                before[k] = i
                note(before[i], i)
                note(i, k)
                if not ordered and active and active[0] < r:
                    # the merge made a pair of a lower rank, which comes first
                    if r in places:
                        places[r] += where[at + 1 :]
                    elif at + 1 < len(where):
                        places[r] = where[at + 1 :]
                        heappush(active, r)
                    break
        alive = np.array(sym, np.int32)
        starts = np.array([*first, len(sym)], np.int64)
        keep = alive >= 0
        ends = np.concatenate(([0], np.cumsum(keep)))[starts] * 4
        raw = alive[keep].tobytes()
        return [raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


@lru_cache(4)
def pair_index(name: str, data: bytes) -> PairIndex:
    return PairIndex(name, data)


class Store(dict):
    """Ids of the pretokens met so far in a partition."""

    def __init__(self, index: PairIndex):
        super().__init__()
        self.index = index

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > MOST_KEPT:
            self.clear()
            new = set().union(*texts)
        words = list(new)
        self.update(zip(words, self.index.encode([w.encode() for w in words])))


def _each(documents: DataFrame, path: str, out: Callable[[Store, list[list[str]]], pa.Array], name: str, kind: str) -> DataFrame:
    """The column ``name`` of each document; the tokenizer's file goes from the driver to the executors."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    file = os.path.basename(path)
    pair_index(file, data)  # an unsupported file is refused before any task starts
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(pair_index(file, sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                texts = store.index.pretokens(rows.column(1).to_pylist())
                store.learn(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), out(store, texts)], ["doc_id", name])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {name} {kind}")


def _ids(store: Store, texts: list[list[str]]) -> pa.Array:
    raw = [b"".join(map(store.__getitem__, t)) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def _counts(store: Store, texts: list[list[str]]) -> pa.Array:
    return pa.array([sum(map(len, map(store.__getitem__, t))) // 4 for t in texts], pa.int64())


def tokenizer_path(name: str = TOKENIZER, folder: str = TOKENIZERS) -> str:
    """The file of a public tokenizer: its settings as JSON or, where there are none, its ranks."""
    places = [f"{folder}/{name}.{kind}" for kind in ("json", "tiktoken")]
    return next((p for p in places if os.path.exists(p)), places[0])


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): each row's token ids, without special tokens.

    Strings of special tokens are ordinary text.  A null and an empty text give an
    empty list; white space is encoded as the tokenizer does any text.  Rows stay as they are:
    repeated and null doc_ids come out once for each row, other columns are
    ignored, an empty table gives no rows.  A text of any length is encoded whole.
    """
    return _each(documents, path or tokenizer_path(), _ids, "ids", "array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the lengths of the lists of token_ids()."""
    return _each(documents, path or tokenizer_path(), _counts, "n_tokens", "bigint")
