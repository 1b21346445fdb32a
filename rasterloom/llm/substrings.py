"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of the hashes of all runs of `SEED` words in a window of `window`
words the smallest (the last of equal ones).  Equal windows have equal anchors at equal places,
so a window is looked up under its anchor only.  The consecutive windows of a document that
share one anchor are a run; joining runs on their anchors seeds the matches.  Runs whose
anchors' whole surroundings agree match in full.  For the others the match is extended window by window on
both sides of the anchor, by hashes of the words around it.  Overlapping windows join up to
the maximal repeats.

Rows of an anchor pass through a task as a sorted stream of which it keeps only the last row.  Before they
are dealt out, each task settles those whose equal it has seen in an earlier document itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, SAME, U64, Words, mix, pieces, signed, spans, stash

#: Words of a seed.
SEED = 12
_PLACE = 28
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Runs of which a task remembers the first document at a time.
_REMEMBER = 200_000


def anchors(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: (document, anchor's hash, hash of the run's surroundings, first and last window in the document)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, np.int64))
    g = w.grams(SEED)
    reach = window - SEED + 1
    if len(g) < reach:
        return none
    place = U64((1 << _PLACE) - 1)
    key = (g & ~place) | (place - np.arange(len(g), dtype=U64))
    size = 1
    while 2 * size <= reach:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: len(g) - reach + 1], key[reach - size :][: len(g) - reach + 1])
    at = (place - (key & place)).astype(np.int64)
    doc = np.searchsorted(w.first, np.arange(len(at)), "right") - 1
    valid = np.arange(len(at)) + window <= w.first[doc + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1
    start, end = start[valid[start]], end[valid[start]]
    around = spans(w.sums(), start, end + window)
    around = mix(around + (at[start] - start).astype(U64) * U64(1 << 32))
    base = w.first[doc[start]]
    return doc[start], g[at[start]], around, start - base, end - base


def _run_rows(window: int):
    def run(batches):
        least: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for row, _, data, offsets in pieces(batch, "text"):
                doc, a, c, s1, s2 = anchors(Words(data, offsets, NOT_BLANK, SAME), window)
                if not len(doc):
                    continue
                a, c, own, tag = signed(a), signed(c), ids[row + doc], tags[row + doc]
                done = np.zeros(len(doc), bool)
                for i, k in enumerate(zip(a.tolist(), c.tolist(), own.tolist(), strict=True)):
                    was = least.setdefault(k[:2], k[2])
                    if was < k[2]:
                        done[i] = True
                    elif was > k[2]:
                        least[k[:2]] = k[2]
                if len(least) > _REMEMBER:
                    least.clear()
                a = np.where(done, signed(mix(tag.view(U64) + s1.astype(U64))), a)  # settled: dealt out anywhere
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, own, tag, s1 << 32 | s2, done)], ["a", "c", "doc", "tag", "run", "done"])

    return run


def _matches(batches):
    """Of rows sorted by (done, a, c, doc): runs that an earlier document has in full (done), and the rest of anchors with several surroundings."""
    held: list[tuple] = []  # rows of the anchor's first surroundings, until there are others
    anchor = around = first = None
    several = False
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "c", "doc", "tag", "run", "done")}
        n = batch.num_rows
        if not n:
            continue
        a, c, doc, done = cols["a"], cols["c"], cols["doc"], cols["done"]
        # anchors of a single row need no look
        lone = np.ones(n, bool)
        lone[1:] &= a[1:] != a[:-1]
        lone[:-1] &= a[:-1] != a[1:]
        lone[0] &= a[0] != anchor
        lone[-1] = False
        out, flag = np.flatnonzero(done).tolist(), [True] * int(done.sum())
        extra: list[tuple] = []
        for i in np.flatnonzero(~done & ~lone).tolist():
            if a[i] != anchor:
                anchor, around, first, several, held = a[i], c[i], doc[i], False, []
            elif c[i] != around:
                around, first, several = c[i], doc[i], True
                extra += held
                held = []
            if doc[i] != first:
                out.append(i)
                flag.append(True)
            elif several:
                out.append(i)
                flag.append(False)
            else:
                held.append((doc[i], cols["tag"][i], cols["run"][i]))
        got = [np.concatenate([cols[k][out], np.array([e[j] for e in extra], np.int64)]) for j, k in enumerate(("doc", "tag", "run"))]
        flag = np.array(flag + [False] * len(extra), bool)
        if len(flag):
            yield pa.RecordBatch.from_arrays([*map(pa.array, got), pa.array(flag)], ["doc", "tag", "run", "done"])


def _window_rows(window: int):
    def run(batches):
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            runs = batch.column("runs")
            for row, to, data, offsets in pieces(batch, "text"):
                w = Words(data, offsets, NOT_BLANK, SAME)
                g, h = w.grams(window), w.grams(window, 0x5DEECE66D)
                for r in range(row, to):
                    own = runs[r].values.to_numpy()
                    s = np.unique(np.concatenate([np.arange(x >> 32, (x & 0xFFFFFFFF) + 1) for x in own.tolist()]))
                    at = w.first[r - row] + s
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g[at])), pa.array(signed(h[at])), pa.array(np.full(len(s), ids[r])), pa.array(np.full(len(s), tags[r])), pa.array(s << 32 | s)], ["g", "h", "doc", "tag", "run"])

    def joined(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def keep_words(text: bytes, runs: list[int], window: int) -> tuple[int, int, bytes]:
    """(words, words removed, the kept ones joined by a blank)."""
    words = _WORD.findall(text)
    if not runs:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for x in runs:
        cover[x >> 32] += 1
        cover[(x & 0xFFFFFFFF) + window] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(x for x, no in zip(words, gone.tolist(), strict=True) if not no)


def repeats(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """(doc_id, tag, runs) of documents with windows of which the words also start in a document with a smaller doc_id.

    tag is the text's xxhash64; runs are arrays of first << 32 | last window, by number of the first word.
    Rows without doc_id neither lose words nor make others lose any; rows that share a doc_id don't affect each other.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").where("doc_id is not null and text is not null")
    rows = own.mapInArrow(_run_rows(window), "a long, c long, doc long, tag long, run long, done boolean")
    found = stash(rows.repartition("a").sortWithinPartitions("done", "a", "c", "doc").mapInArrow(_matches, "doc long, tag long, run long, done boolean"), "matches")
    open_ = found.where("not done").groupBy(F.col("doc").alias("doc_id"), "tag").agg(F.collect_list("run").alias("runs"))
    some = stash(own.join(open_, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).mapInArrow(_window_rows(window), "g long, h long, doc long, tag long, run long"), "windows")
    first = stash(some.groupBy("g", "h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "first")
    extended = some.join(first, ["g", "h"]).where("doc > least").select("doc", "tag", "run")
    return found.where("done").select("doc", "tag", "run").unionAll(extended).groupBy(F.col("doc").alias("doc_id"), "tag").agg(F.collect_list("run").alias("runs"))


def dedup(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept are the bytes of the kept words, joined by one blank.

    Words are `[^\\x20\\x09-\\x0D]+`; null text has none.  Removed is each word in a window of `window`
    words that also starts in a document with a smaller doc_id, as the input stands.  Rows without doc_id lose
    nothing, rows that share a doc_id don't affect each other, texts of fewer words stay whole, however long
    a text is all of it counts, other columns are ignored, and an empty table gives an empty one.
    """
    return _with_words(docs, window, "kept binary", lambda kept: pa.array(kept, pa.binary()))


def digests(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """As dedup(), with the kept words' SHA-256 as kept_sha256 in their place."""
    return _with_words(docs, window, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(x).hexdigest() for x in kept]))


def _with_words(docs: DataFrame, window: int, column: str, of) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    gone = repeats(docs, window=window).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "runs")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("tag"))
    both = text.join(gone, (text.doc_id == gone._id) & (text.tag == gone._tag), "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                got = [keep_words(t, r or [], window) for t, r in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), of([x[2] for x in got])], ["doc_id", "n_words", "n_removed", column.split()[0]])

    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {column}")


SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') w from documents),
k as (select doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) k from w where len(w) >= 50)),
f as (select h, min(doc_id) m from k group by 1),
g as (select distinct doc_id, p from (select doc_id, unnest(range(k, k + 50)) p from k join f using (h) where m < doc_id)),
t as (select doc_id, unnest(w) t, unnest(range(1, len(w) + 1)) p from w),
s as (select t.doc_id, count(*) n_words, count(g.p) n_removed, string_agg(t.t, ' ' order by t.p) filter (where g.p is null) kept
      from t left join g on t.doc_id = g.doc_id and t.p = g.p group by 1)
select w.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from w left join s on w.doc_id = s.doc_id
"""
