"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The short test items are the indexed sets.  They are partitioned by size, and each partition has
one sketch length: the m smallest hashes (bottom-m MinHash) of an item's shingles, where
m = q - ceil(share * q) + 1 for the partition's largest size q.  An item of which at least
`share` lies in a document has lost at most m - 1 shingles, so one of its m smallest is there:
the search loses nothing, however long the document is.  A document probes each partition only
with its own shingles below the partition's largest sketch hash.  Every candidate is then
verified on the words themselves.

Words are runs of ASCII letters and digits and of all other code points above U+007F; A-Z are
lower-cased.  A shingle is `shingle` words; an item with fewer words is one shingle of its own
length.  Items without words match nothing, nor do documents without text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, U64, Words, pieces, texts

#: Item text that goes to the executors at once; more items take more passes over the documents.
BLOCK_BYTES = 8_000_000


def shingles_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    """Items of one block, partitioned by shingle length and size."""

    def __init__(self, items: list[tuple], shingle: int, percent: int):
        self.ids, self.sets, self.need = [], [], []
        parts = defaultdict(list)
        w_data, w_off = texts(pa.array([t for _, t in items], pa.string()))
        w = Words(w_data, w_off, LETTERS, LOWER)
        raw = LOWER[w_data].tobytes()
        for k, (item, _) in enumerate(items):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            n = min(shingle, hi - lo)
            if not n:
                continue
            own = [raw[a:b] for a, b in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
            grams, one = Words.grams(w, n)[lo : hi - n + 1], {}
            for i, g in enumerate(grams.tolist()):
                one.setdefault(g, b" ".join(own[i : i + n]))
            q = len(one)
            self.ids.append(item)
            self.sets.append(one)
            self.need.append(-(-percent * q // 100))
            parts[n, q.bit_length()].append(len(self.ids) - 1)
        self.parts = []
        for (n, size), members in sorted(parts.items()):
            most = max(len(self.sets[i]) for i in members)
            m = most - -(-percent * most // 100) + 1
            pairs = sorted((g, i) for i in members for g in sorted(self.sets[i])[:m])
            self.parts.append((n, np.array([g for g, _ in pairs], U64), [i for _, i in pairs]))
        self.lengths = sorted({n for n, _, _ in self.parts})

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """(row, [(item, its shingles, those in the row's text)]) of rows with a match."""
        w = Words(data, offsets, LETTERS, LOWER)
        found: dict[int, set[int]] = defaultdict(set)
        grams = {n: w.grams(n) for n in self.lengths}
        for n, sketch, owner in self.parts:
            g = grams[n]
            low = np.flatnonzero(g <= sketch[-1])
            at = np.searchsorted(sketch, g[low])
            hit = low[sketch[np.minimum(at, len(sketch) - 1)] == g[low]]
            row = np.searchsorted(w.first, hit, "right") - 1
            for r, i in zip(row[hit + n <= w.first[row + 1]].tolist(), hit[hit + n <= w.first[row + 1]].tolist(), strict=True):
                k = int(np.searchsorted(sketch, g[i]))
                while k < len(sketch) and sketch[k] == g[i]:
                    found[r].add(owner[k])
                    k += 1
        for r in sorted(found):
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            own, out = {}, []
            for i in sorted(found[r]):
                one = self.sets[i]
                n = next(iter(one.values())).count(b" ") + 1
                if n not in own:
                    g = grams[n][lo : hi - n + 1]
                    order = np.argsort(g, kind="stable")
                    own[n] = g[order], order
                g, order = own[n]
                keys = np.fromiter(one, U64, len(one))
                at = np.minimum(np.searchsorted(g, keys), len(g) - 1)
                shared = 0
                for key, k in zip(keys[g[at] == keys].tolist(), order[at[g[at] == keys]].tolist(), strict=True):
                    text = b" ".join(LOWER[data[w.start[j] : w.end[j]]].tobytes() for j in range(lo + k, lo + k + n))
                    shared += text == one[key]
                if shared >= self.need[i]:
                    out.append((self.ids[i], len(one), shared))
            if out:
                yield r, out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1]) * 2
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of items of which `percent` of the shingles are in a document.

    Null or empty texts match nothing; repeated rows give repeated matches; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kind[0]}, item_id {kind[1]}, n_item long, n_shared long"
    out = None
    for block in _blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, shingle, percent))

        def run(batches, index=index):
            for batch in batches:
                ids = batch.column("doc_id")
                for row, _, data, offsets in pieces(batch, "text"):
                    rows = [(row + r, *m) for r, ms in index.value.matches(data, offsets) for m in ms]
                    if rows:
                        at, item, n, shared = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(item), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with all their columns, whatever the names.

    Rows without text or words stay, repeated rows stay or go together, whole texts count however long they are,
    items without words are in no document, and with no documents or no items the table stays as it is.
    """
    for block in _blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, shingle, percent))

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, data, offsets in pieces(batch, "text"):
                    for r, _ in index.value.matches(data, offsets):
                        keep[row + r] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: Words as the operator sees them, for DuckDB.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
with d as (select doc_id, {_WORDS} w from documents),
i as (select item_id, {_WORDS} w from benchmark),
s as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') g
      from (select item_id, w, least(5, len(w)) n, unnest(range(1, len(w) - least(5, len(w)) + 2)) k from i where len(w) > 0)),
q as (select item_id, count(*) n_item from s group by 1),
t as (select distinct doc_id, n, array_to_string(w[k : k + n - 1], ' ') g
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from s)))
select doc_id, item_id, n_item, count(*) n_shared
from t join s using (n, g) join q using (item_id)
group by all having count(*) * 100 >= n_item * 80
"""
