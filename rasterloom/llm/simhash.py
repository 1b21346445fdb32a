"""Document fingerprints: SimHash.

Terms are a text's distinct words (weight 1) and all its three-word sequences (weight 2), A-Z
lower-cased.  Each term's 128-bit hash votes, with its weight, for or against every bit; a bit is
set where the votes for it prevail.  A text without words has no bit set.

within() finds all fingerprints within a Hamming radius of given ones by permuted block tables: of `blocks`
blocks at most `radius` differ, so some choice of blocks - radius of them agrees, and each
choice is a table keyed by its blocks.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_BLANK, PIECE_BYTES, U64, Words, mix, pieces, stash

BITS = 128
_SECOND = U64(0x2545F4914F6CDD1D)
#: Terms of which the bits are laid out at once.
_TERMS = 1 << 14


def _votes(h: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _TERMS):
        part = h[i : i + _TERMS]
        both = np.stack([part, mix(part ^ _SECOND)], 1)
        bits = np.unpackbits(both.view(np.uint8), axis=1)
        total += 2 * bits.sum(0, dtype=np.int64) - len(part)
    return total


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 16 bytes per document."""
    w = Words(data, offsets, NOT_BLANK, LOWER)
    g = w.grams(3)
    out = np.zeros((len(offsets) - 1, BITS // 8), np.uint8)
    for i, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if hi > lo:
            votes = _votes(np.unique(w.hash[lo:hi]))
            if hi - lo > 2:
                votes += 2 * _votes(g[lo : hi - 2])
            out[i] = np.packbits(votes > 0)
    return out


def _of(texts: list[str]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    return np.concatenate([fingerprints(d, o) for _, _, d, o in pieces(batch, "text")]) if texts else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(-1) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, in hexadecimal; null text is empty.  Other columns are ignored."""

    def run(batches):
        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, to - row), pa.array([x.tobytes().hex() for x in fingerprints(data, offsets)])], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many first code points of the next one."""
    n = len(text)
    return text[: n - n // 2] + after[: n // 2]


def _rows(ids: list, texts: list[str], afters: list[str]) -> list[list]:
    changed = [edited(t, a) for t, a in zip(texts, afters, strict=True)]
    own = _of([*texts, afters[-1]])
    # all but the last one's next text is the following one
    other = own[1:]
    new = _of(changed)
    return [ids, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed], [x.tobytes().hex() for x in own[:-1]], [x.tobytes().hex() for x in new], likeness(own[:-1], new).tolist(), likeness(own[:-1], other).tolist()]


_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _arrow(rows: list[list], kind: pa.DataType) -> list[pa.Array]:
    types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.array(x, t) for x, t in zip(rows, types, strict=True)]


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its text after an edit, and their likeness (share of equal bits) to each other and to the next document's.

    The next document is the one of the next doc_id (null first; equal ids by text), after the last the first.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text is empty.  Other columns of the input are ignored.

    Documents are dealt out by ranges of doc_id.  A task pairs neighbours as they pass; the ends of the
    ranges, two rows for each, are paired afterwards.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        part = TaskContext.get().partitionId()
        held_ids: list = []
        held: list[str] = []
        size, first, id_type = 0, True, None

        def end(name, i, t):
            none = [pa.nulls(1, x.type) for x in _arrow([[i], [0], [""], [""], [""], [0.0], [0.0]], id_type)]
            none[0] = pa.array([i], id_type)
            return pa.RecordBatch.from_arrays([*none, pa.array([name]), pa.array([part], pa.int64()), pa.array([t])], [*_COLUMNS, "end", "part", "text"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = t or ""
                if first:
                    yield end("first", i, t)
                    first = False
                held_ids.append(i)
                held.append(t)
                size += len(t)
                if size > PIECE_BYTES and len(held) > 1:
                    rows = _arrow(_rows(held_ids[:-1], held[:-1], held[1:]), id_type)
                    n = len(held) - 1
                    yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], [*_COLUMNS, "end", "part", "text"])
                    held_ids, held, size = held_ids[-1:], held[-1:], len(held[-1])
        if held:
            if len(held) > 1:
                rows = _arrow(_rows(held_ids[:-1], held[:-1], held[1:]), id_type)
                n = len(held) - 1
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], [*_COLUMNS, "end", "part", "text"])
            yield end("last", held_ids[-1], held[-1])

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    done = stash(dealt.mapInArrow(run, f"{_schema(kind)}, end string, part long, text string"), "fingerprints")
    # one row for each range: its number, so that the next range that has rows is known
    parts = [r[0] for r in done.where("end = 'first'").select("part").orderBy("part").collect()]
    ends = done.where("end is not null")
    if parts:
        after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part long, other long")
        firsts = ends.where("end = 'first'").select(F.col("part").alias("other"), F.col("text").alias("after"))
        pairs = ends.where("end = 'last'").select("doc_id", "part", "text").join(after, "part").join(firsts, "other").select("doc_id", "text", "after")

        def last(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = _rows([batch.column("doc_id")[i].as_py()], [batch.column("text")[i].as_py()], [batch.column("after")[i].as_py()])
                    yield pa.RecordBatch.from_arrays(_arrow(rows, batch.column("doc_id").type), list(_COLUMNS))

        return done.where("end is null").select(*_COLUMNS).unionAll(pairs.mapInArrow(last, _schema(kind)))
    return done.select(*_COLUMNS)


def _tables(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The choices of blocks that are keys: one of them agrees wherever at most `radius` bits differ."""
    if not 0 <= radius < blocks <= BITS // 4:
        raise ValueError(f"radius must be less than blocks, which are at most {BITS // 4}")
    return list(combinations(range(blocks), blocks - radius))


def within(prints: DataFrame, queries: DataFrame, *, radius: int = 6, blocks: int = 8, salt: int = 4) -> DataFrame:
    """(query, fingerprint, distance): for every different fingerprint of `queries` all of `prints` at most `radius` bits away, itself included.

    Both have a hexadecimal column fingerprint, of which nulls are left out and equal ones are one: copies cost nothing, and
    membership is the input itself.  The rows of one key are dealt to `salt` tasks, to which that key's queries go all.  A pair that
    agrees in several tables is given by the first.
    """
    cuts = [BITS // 4 * i // blocks for i in range(blocks + 1)]
    part = lambda c, i: F.substring(c, cuts[i] + 1, cuts[i + 1] - cuts[i])
    tables = _tables(radius, blocks)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *[part("fingerprint", i) for i in chosen]).alias("key")) for k, chosen in enumerate(tables)])

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.explode(keys).alias("t")).select("fingerprint", "t.k", "t.key")

    each = keyed(prints).withColumn("to", F.pmod(F.xxhash64("fingerprint"), F.lit(salt)).cast("int"))
    asked = keyed(queries).withColumnRenamed("fingerprint", "query").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    # sizes are estimated without what explode makes of a row, so either side could be sent to the driver and every executor though it is many times the limit
    pairs = each.hint("merge").join(asked, ["k", "key", "to"])
    word = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word("query", i).bitwiseXOR(word("fingerprint", i))) for i in (9, 17, 25)), F.bit_count(word("query", 1).bitwiseXOR(word("fingerprint", 1))))
    pairs = pairs.select("query", "fingerprint", "k", distance.alias("distance")).where(F.col("distance") <= radius)
    equal = F.array_compact(F.array(*[F.when(part("query", i) == part("fingerprint", i), F.lit(i)) for i in range(blocks)]))
    first = F.slice(equal, 1, blocks - radius)
    chosen = F.array(*[F.array(*[F.lit(i) for i in c]) for c in tables])
    return pairs.where(first == F.get(chosen, F.col("k"))).select("query", "fingerprint", "distance")


def near_counts(prints: DataFrame, asked: Column, *, radius: int = 6, blocks: int = 8) -> DataFrame:
    """The rows of prints (doc_id, fingerprint, ..) with near_docs: for those `asked`, how many other rows have a fingerprint at most `radius` bits away; else null."""
    many = prints.groupBy("fingerprint").agg(F.count("*").alias("many"))
    hits = within(many, prints.where(asked), radius=radius, blocks=blocks).join(many, "fingerprint")
    near = stash(hits.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("many") - 1).alias("near_docs")), "near")
    both = prints.join(near, "fingerprint", "left")
    return both.select(*prints.columns, F.when(asked, F.col("near_docs")).alias("near_docs"))
