"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of text is its bytes.  Leaf i of the tree holds the rank of the pair that starts at byte
i (none: infinity) together with i, and every inner node the smaller of its two children, so the root is the
leftmost pair of the lowest rank.  A merge changes three leaves (the merged pair's, its right part's
and its left neighbour's) and the paths above them; neighbours are kept in linked
lists of the live positions.  Trees of many pieces of about the same length are worked on together, as rows
of numpy arrays; a long piece that has no such company has its tree to itself, so that a merge costs some
twenty steps and a megabyte without blanks seconds.

Pieces repeat, so a worker keeps the ids of those it has met; that is a cache and bounded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import U64, pieces

_NONE = np.int64(1 << 62)
_LOW = np.int64((1 << 32) - 1)
#: Pieces a worker remembers at most.
REMEMBER = 400_000
#: Bytes of pieces that a worker remembers at most.
REMEMBER_BYTES = 1 << 26
#: Trees that are worked on together at most, in leaves; of these many leaves, and fewer rows, a tree is worked on alone.
_LEAVES, _LONG, _ROWS = 1 << 18, 256, 24
#: White space as the tiktoken library's patterns see it.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def pattern(text: str) -> regex.Pattern:
    """Compiles a splitting pattern with Unicode's White_Space for \\s."""
    text = text.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
    return regex.compile(text)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Pairs:
    """Ranks of mergeable pairs of ids, as an open hash table in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) that start at byte `at`; b may be -1 for none."""
        out = np.full(len(a), _NONE)
        left = np.flatnonzero(b >= 0)
        keys = a[left] << 32 | b[left]
        slot = self._slot(keys)
        while len(left):
            found = self.keys[slot]
            hit = found == keys
            out[left[hit]] = self.values[slot[hit]] << 32 | at[left[hit]]
            go = ~hit & (found != -1)
            left, keys, slot = left[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], split: str):
        self.ranks, self.split, self.pairs = ranks, pattern(split), Pairs(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.bytes_known = 0
        self.start, self.length, self.flat, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def merge(self, words: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each) of words of at most `leaves` bytes; leaves is a power of two."""
        n, m, pairs = len(words), leaves, self.pairs
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(n, m)
        ids = self.bytes[raw]
        place = np.arange(m)
        ids[place >= size[:, None]] = -1
        live = ids >= 0
        after = np.broadcast_to(np.append(place[1:], m), (n, m)).copy()
        before = np.broadcast_to(place - 1, (n, m)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)  # a place past the end
        tree = np.full((n, 2 * m), _NONE)
        tree[:, m:] = pairs.leaf(ids[:, :m].ravel(), ids[:, 1:].ravel(), np.tile(place, n)).reshape(n, m)
        level = m
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & _LOW
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = top >> 32
            live[rows, j] = False
            after[rows, i] = k
            inner = k < m
            before[rows[inner], k[inner]] = i[inner]
            tree[rows, m + j] = _NONE
            tree[rows, m + i] = pairs.leaf(ids[rows, i], ids[rows, k], i)
            p = before[rows, i]
            has = p >= 0
            p = np.where(has, p, i)
            r, q = rows[has], p[has]
            tree[r, m + q] = pairs.leaf(ids[r, q], ids[r, i[has]], q)
            r3 = np.concatenate([rows, rows, rows])
            up = np.concatenate([i, j, p]) + m
            while up[0] > 1:
                up >>= 1
                tree[r3, up] = np.minimum(tree[r3, 2 * up], tree[r3, 2 * up + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return ids[:, :m][live], live.sum(1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word, as merge()."""
        m, pairs, none = 1 << (len(word) - 1).bit_length(), self.pair_ranks, int(_NONE)
        first = self.bytes[np.frombuffer(word, np.uint8)]
        leaves = np.full(m, _NONE)
        leaves[: len(word)] = self.pairs.leaf(first, np.append(first[1:], -1), np.arange(len(word)))
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(1))
        tree = array("q", np.concatenate([[_NONE], *levels[::-1]]).tobytes())
        ids, live = array("q", first.tobytes()), np.ones(len(word), bool)
        end = len(word)
        after, before = array("q", range(1, end + 1)), array("q", range(-1, end - 1))

        def put(place: int, value: int) -> None:
            p = m + place
            tree[p] = value
            while p > 1:
                p >>= 1
                a, b = tree[2 * p], tree[2 * p + 1]
                least = a if a < b else b
                if tree[p] == least:
                    break
                tree[p] = least

        while tree[1] < none:
            top = tree[1]
            i = top & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i] = top >> 32
            live[j] = False
            after[i] = k
            put(j, none)
            rank = none
            if k < end:
                before[k] = i
                rank = pairs.get(ids[i] << 32 | ids[k], -1)
            put(i, rank << 32 | i if 0 <= rank < none else none)
            p = before[i]
            if p >= 0:
                rank = pairs.get(ids[p] << 32 | ids[i], -1)
                put(p, rank << 32 | p if rank >= 0 else none)
        return np.frombuffer(ids, np.int64)[live]

    @cached_property
    def pair_ranks(self) -> dict[int, int]:
        there = self.pairs.keys >= 0
        return dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist(), strict=True))

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        groups: dict[int, list[int]] = {}
        done: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        whole: list[int] = []
        for i, b in enumerate(raw):
            if b in self.ranks:
                whole.append(i)
            else:
                groups.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        if whole:
            done.append((whole, np.array([self.ranks[raw[i]] for i in whole]), np.ones(len(whole), np.int64)))
        for m, members in groups.items():
            step = max(1, _LEAVES // m)
            if m >= _LONG and len(members) < _ROWS:
                each = [self.merge_long(raw[i]) for i in members]
                done.append((members, np.concatenate(each), np.array([len(x) for x in each])))
                continue
            for a in range(0, len(members), step):
                part = members[a : a + step]
                done.append((part, *self.merge([raw[i] for i in part], m)))
        for members, ids, count in done:
            at = len(self.known)
            while at + len(members) > len(self.start):
                self.start, self.length = np.concatenate([self.start, self.start * 0]), np.concatenate([self.length, self.length * 0])
            while self.size + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat * 0])
            self.flat[self.size : self.size + len(ids)] = ids
            self.start[at : at + len(members)] = self.size + np.cumsum(count) - count
            self.length[at : at + len(members)] = count
            self.size += len(ids)
            self.bytes_known += sum(len(raw[i]) for i in members)
            self.known.update(zip((words[i] for i in members), range(at, at + len(members)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last one's end)."""
        find = self.split.findall
        each = [find(t) for t in texts]
        flat = [w for ws in each for w in ws]
        bounds = np.cumsum([0, *map(len, each)])
        if len(self.known) > REMEMBER or self.bytes_known > REMEMBER_BYTES:
            self._forget()
        if new := set(flat).difference(self.known):
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        count = self.length[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - ends + count, count) + np.arange(total)]
        return ids, np.append(0, ends)[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_made: dict[tuple, Encoder] = {}


def encoder(data: bytes, split: str) -> Encoder:
    """An encoder of this process; one for each rank file and pattern."""
    key = hashlib.sha256(data).digest(), split
    if key not in _made:
        _made[key] = Encoder(load_ranks(data), split)
    return _made[key]


def _spread(docs: DataFrame, ranks_path: str, split: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), split))


def encode(docs: DataFrame, ranks_path: str, split: str) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers; null text is empty, other columns are ignored.

    ranks_path is a file of the driver; it reaches the executors as a broadcast of its own, fixed size.
    """
    shared = _spread(docs, ranks_path, split)

    def run(batches):
        e = encoder(*shared.value)
        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text"):
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ids, at = e.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, to - row), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, split: str) -> DataFrame:
    """(doc_id, bytes) from encode()'s rows; null ids are empty."""
    shared = _spread(encoded, ranks_path, split)

    def run(batches):
        e = encoder(*shared.value)
        for batch in batches:
            out = [e.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, split: str, *, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): the rows of encode() and of decode() after it, as digests, in one pass.

    Null text is empty and has no ids; each row is encoded for itself, repeated or not, and whole, also a piece of megabytes
    without a blank; other columns are ignored, and an empty table gives an empty one.
    """
    shared = _spread(docs, ranks_path, split)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches):
        e = encoder(*shared.value)
        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text"):
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                flat, at = e.encode(texts)
                own = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                raw = [x.astype("<u4").tobytes() for x in own]
                columns = [
                    batch.column("doc_id").slice(row, to - row),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in own]),
                    pa.array(raw, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
