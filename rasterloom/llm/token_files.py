"""Token ids in binary files: patched frame-of-reference blocks.

A file is a row of segments of about `SEGMENT` ids.  A segment holds whole documents, in blocks
of `BLOCK` ids: each block's minimum is subtracted and the rest packed at the width that the
`PERCENT` of its values fit in; larger ones are exceptions, kept with their places in a list.
The index has, for each block, where its packed bits and its exceptions start.

Documents are dealt out by ranges of doc_id and sorted, so the files are in ascending order.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, pieces

BLOCK = 128
PERCENT = 90
SEGMENT = 1 << 21
#: Segments of a file at most, so that files stay well below the 2 GB that a row can hold.
SEGMENTS = 100
MAGIC = b"PFORIDS1"
#: Chunks of text between blanks that a worker remembers at most, and as many of their letters and signs.
REMEMBER = 400_000
_HEAD = struct.Struct("<8sQQQQQQQ")  # magic, bytes, part, segment, documents, ids, packed bytes, exceptions


def pack(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of ids: minimum, width, starts of the packed bits and of the exceptions, and both of these."""
    n = -(-len(ids) // BLOCK)
    x = np.zeros(n * BLOCK, np.int64)
    x[: len(ids)] = ids
    if n:
        x[len(ids) :] = ids[-1]
    x = x.reshape(n, BLOCK)
    least = x.min(1) if n else np.zeros(0, np.int64)
    x = x - least[:, None]
    cut = np.partition(x, BLOCK * PERCENT // 100, 1)[:, BLOCK * PERCENT // 100] if n else least
    width = np.frexp(cut.astype(np.float64))[1].astype(np.uint8)
    over = x >> width[:, None].astype(np.int64) > 0
    block, place = np.nonzero(over)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    bits = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for a in range(0, len(own), 4096):
            part = own[a : a + 4096]
            each = np.unpackbits(x[part].astype(">u2" if w <= 16 else ">u4").view(np.uint8), axis=1).reshape(len(part), BLOCK, -1)[:, :, -w:]
            bits[starts[part][:, None] + np.arange(w * (BLOCK // 8))] = np.packbits(each.reshape(len(part), -1), axis=1)
    return {"least": least.astype("<u4"), "width": width, "starts": starts.astype("<u8"), "patches": np.concatenate([[0], np.cumsum(over.sum(1))]).astype("<u8"), "place": place.astype(np.uint8), "value": x[over].astype("<u4"), "bits": bits}


def unpack(p: dict[str, np.ndarray], first: int, last: int) -> np.ndarray:
    """Ids of the blocks from first to before last, padded to whole blocks."""
    width, starts, patches = p["width"][first:last], p["starts"].astype(np.int64), p["patches"].astype(np.int64)
    out = np.zeros((last - first, BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for a in range(0, len(own), 4096):
            part = own[a : a + 4096]
            raw = p["bits"][starts[first + part][:, None] + np.arange(w * (BLOCK // 8))]
            kind = ">u2" if w <= 16 else ">u4"
            each = np.zeros((len(part), BLOCK, 8 * np.dtype(kind).itemsize), np.uint8)
            each[:, :, -w:] = np.unpackbits(raw, axis=1).reshape(len(part), BLOCK, w)
            out[part] = np.packbits(each.reshape(len(part), -1), axis=1).view(kind)
    a, b = patches[first], patches[last]
    block = np.repeat(np.arange(last - first), np.diff(patches[first : last + 1]))
    out[block, p["place"][a:b]] = p["value"][a:b]
    return (out + p["least"][first:last, None]).ravel()


def segment(part: int, number: int, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> bytes:
    p = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join([known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype("<u8").tobytes(), p["least"].tobytes(), p["width"].tobytes(), p["starts"].tobytes(), p["patches"].tobytes(), p["place"].tobytes(), p["value"].tobytes(), p["bits"].tobytes()])
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), part, number, len(doc_ids), len(ids), len(p["bits"]), len(p["place"])) + body


def segments(content: bytes):
    """(part, segment, doc_ids, counts, blocks) of a file's segments, each followed by a line feed."""
    at = 0
    while at < len(content):
        magic, size, part, number, docs, n, packed, patched = _HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        to, blocks = at + _HEAD.size, -(-n // BLOCK)

        def take(kind, count):
            nonlocal to
            x = np.frombuffer(content, kind, count, to)
            to += x.nbytes
            return x

        known, doc_ids, counts = take("u1", docs), take("<i8", docs), take("<u8", docs).astype(np.int64)
        p = {"least": take("<u4", blocks).astype(np.int64), "width": take("u1", blocks), "starts": take("<u8", blocks + 1), "patches": take("<u8", blocks + 1), "place": take("u1", patched), "value": take("<u4", patched), "bits": take("u1", packed)}
        yield part, number, [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], counts, p
        at += size + 1


#: A chunk's leading letters and its closing signs, each surely one piece for the pre-tokeniser, or the whole chunk.
_LETTER, _SIGN, _END = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])", rb"[!-&(-/:-@\[-`{-~]", rb"(?=[\x20\x09-\x0d]|\Z)"
_CHUNK = re.compile(_LETTER + rb"++(?=" + _SIGN + rb"*+" + _END + rb")|" + _SIGN + rb"++" + _END + rb"|[^\x20\x09-\x0d]+")
_SIMPLE = re.compile(_LETTER + rb"+|" + _SIGN + rb"+")
#: The characters that stand for the bytes of longer letters in a byte-level vocabulary; other bytes stand for themselves.
_BYTES = {b: 290 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 323}


class _Ids:
    """Ids of chunks, which learn(new chunks) gives, one after another, and how many of each."""

    def __init__(self, learn):
        self.learn, self.known = learn, dict[bytes, int]()
        self.start, self.length, self.flat, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def take(self, chunks: list[bytes], which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Those of the chunks, or of the chunks with the numbers `which`."""
        if new := list(dict.fromkeys(filterfalse(self.known.__contains__, chunks))):
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self._add(base, *self.learn(new))
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        at = at if which is None else at[which]
        count = self.length[at]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.start[at] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)], count

    def _add(self, base: int, ids: np.ndarray, count: np.ndarray) -> None:
        while len(self.known) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start * 0]), np.concatenate([self.length, self.length * 0])
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.size : self.size + len(ids)] = ids
        self.start[base : base + len(count)] = self.size + np.cumsum(count) - count
        self.length[base : base + len(count)] = count
        self.size += len(ids)


class Tokens:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's normaliser makes every blank one space and its pre-tokeniser drops it, so a text's ids are those of
    its chunks between blanks, and of a chunk's letters and closing signs, each encoded as a text of its own; chunks and their parts
    repeat, and a worker remembers both, so that a chunk is taken apart and a part encoded where it is new.  Letters or signs alone are one piece, of which the last token alone ends a word:
    many are encoded as one text, and words of letters by the vocabulary's merges alone.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.model = self.library.model
        # letters go to the merges directly, unless an added token, which is looked for before all else, is letters alone, or the library gives these others
        each = [b"Letters", *"ÀÖØÞßöøÿ".encode().split(), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])).encode()]
        self.plain = not any(t.content.isalpha() for t in self.library.get_added_tokens_decoder().values())
        self.plain = self.plain and [x.tolist() for x in self._merged(each)] == [x.tolist() for x in self._apart(each)]
        self._forget()

    def _forget(self):
        self.parts = _Ids(self._encoded)
        self.chunks = _Ids(self._taken_apart)

    def _ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, how many of each)."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(chunks).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) == len(chunks) and (not len(ids) or ends[-1] == len(ids) - 1):
            return ids, np.diff(ends, prepend=-1)
        return self._apart(chunks)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _ids(), of words of letters as _LETTER has them, by the vocabulary's merges alone."""
        merge = self.model.tokenize
        letters = b" ".join(words).decode().lower().encode().decode("latin-1").translate(_BYTES)
        got = [[t.id for t in merge(w)] for w in letters.split(" ")]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(count.sum())), count

    def _apart(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got])

    def _encoded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _ids(), of chunks of any kind."""
        # 0: letters, of which the normaliser changes no more than their case, 1: signs, or letters otherwise, 2: others
        kind = np.array([(0 if self.plain and (c[0] > 127 or c[:1].isalpha()) else 1) if c.isalpha() or _SIMPLE.fullmatch(c) else 2 for c in new], np.int8)
        order, ids, count = [], [], []
        for own, of in ((np.flatnonzero(kind == k), of) for k, of in enumerate((self._merged, self._ids, self._apart))):
            for a in range(0, len(own), 1024):
                part = own[a : a + 1024]
                x, n = of([new[i] for i in part.tolist()])
                order.append(part), ids.append(x), count.append(n)
        order, ids, count = (np.concatenate(x).astype(np.int64) for x in (order, ids, count))
        starts, length = np.empty_like(count), np.empty_like(count)
        starts[order], length[order] = np.cumsum(count) - count, count
        ends = np.cumsum(length)
        return ids[np.repeat(starts - ends + length, length) + np.arange(len(ids))], length

    def _taken_apart(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _ids(), by the chunks' letters and closing signs."""
        parts, to = [], []
        for c in new:
            if c:
                parts += _CHUNK.findall(c)
            to.append(len(parts))
        ids, count = self.parts.take(parts)
        return ids, np.diff(np.append(0, np.cumsum(count))[to], prepend=0)

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, one after another; how many of each)."""
        if len(self.parts.known) > REMEMBER:
            self._forget()
        elif len(self.chunks.known) > REMEMBER:
            self.chunks = _Ids(self._taken_apart)
        # special tokens are the only strings that depend on the case of A-Z
        lower = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary())
        # a blank at a text's end leaves an empty chunk, which has no ids; each different chunk of these texts is looked up once
        each = pc.ascii_split_whitespace(lower.view(pa.large_string()))
        coded = each.flatten().dictionary_encode()
        ids, count = self.chunks.take(coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy())
        bounds = np.append(0, np.cumsum(count))[each.offsets.to_numpy()]
        return np.insert(ids, bounds[1:], end), np.diff(bounds) + 1


_made: dict[bytes, Tokens] = {}


def tokens(data: str) -> Tokens:
    key = hashlib.sha256(data.encode()).digest()
    if key not in _made:
        _made[key] = Tokens(data)
    return _made[key]


def write(docs: DataFrame, path: str, vocabulary_path: str, *, end: int = 1) -> None:
    """Encodes every text (null: empty), appends the end id and writes the ids in ascending doc_id order (null first; equal ids by text).

    vocabulary_path is a file of the driver, for the tokenizers library; it is broadcast at its own, fixed size.
    doc_id is an integer; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        t, part, number = tokens(shared.value), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal number, size
            out = segment(part, number, doc_ids, np.concatenate(ids), np.concatenate(counts))
            number, size = number + 1, 0
            doc_ids.clear(), ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["content"])

        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text", min(PIECE_BYTES, SEGMENT)):
                x, n = t.encode([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], end)
                doc_ids += batch.column("doc_id").slice(row, to - row).to_pylist()
                ids.append(x)
                counts.append(n)
                size += len(x)
                if size >= SEGMENT:
                    yield close()
        if doc_ids:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    # the text writer puts a value's bytes and a line feed
    dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before it; the checksum is of its ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for part, number, doc_ids, counts, p in segments(content.as_py()):
                    ids = unpack(p, 0, len(p["width"])).astype("<u4")
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    k = len(doc_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(k, part)), pa.array(np.full(k, number)), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "part", "number", "local", "n_tokens", "ids_crc32"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, part long, number long, local long, n_tokens long, ids_crc32 long")
    return _with_starts(rows)


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents of these doc_ids, ids in the order of the file.

    The index gives the blocks that a document's ids lie in, and only these are unpacked.  The list goes to every task.
    """
    wanted = set(doc_ids)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for _, _, own, counts, p in segments(content.as_py()):
                    ends = np.cumsum(counts)
                    hit = [k for k, d in enumerate(own) if d in wanted]
                    got = []
                    for k in hit:
                        a, b = int(ends[k] - counts[k]), int(ends[k])
                        first, last = a // BLOCK, -(-b // BLOCK)
                        got.append(unpack(p, first, last)[a - first * BLOCK : b - first * BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in hit], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<long>")


def _with_starts(rows: DataFrame) -> DataFrame:
    from .common import stash

    rows = stash(rows, "ids")
    each = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    inside = each.withColumn("before", F.sum("size").over(W.partitionBy("part").orderBy("number")) - F.col("size"))
    # a row for each file
    files = each.groupBy("part").agg(F.sum("size").alias("size")).withColumn("base", F.sum("size").over(W.orderBy("part")) - F.col("size")).drop("size")
    where = inside.join(files, "part").select("part", "number", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(where, ["part", "number"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
