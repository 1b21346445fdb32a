"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct n-word shingles (64-bit hashes).  Sets whose Jaccard similarity
is at least t have sizes within a factor t and differ in at most k = 2 (1-t)/(1+t) * size elements.
Sizes are cut into bands; a set signs for its own band and, if it may have a partner there, for
the next one.  For a band the hashed domain is cut into blocks of partitions, of three parts
each.  With m blocks one holds at most d = k // m differing elements, so of its d // 2 + 3
partitions three hold at most one each, which leaves two of their three parts equal: the three
pairs of parts of every partition are a set's signatures, and sufficiently similar sets share
three of them for certain, of different partitions of one block.  A pair of parts without elements says nothing; such
signatures count by threes only, so that sets share a signature with elements or a combination of
three empty ones.

Equal sets are one node, so copies cost nothing.  A node of which too many shingles are in no
other candidate cannot have a partner and goes.  The other members of a signature are compared with its
smallest node, the hub.  A pair that could still join two components of these links shares a signature of three
members or more that lie in several components; nodes that such signatures tie together are a cluster, and only
its sets are compared in blocks, each pair of blocks in a task of its own that returns no more links than it joins
components.  So no link that would join two components is lost, and no table of pairs is made.

A node is named by 64 bits.  Where two sets share a name both are compared, so that a clash adds work and no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.components import components
from .common import LOWER, NOT_BLANK, U64, Words, drop, mix, pieces, signed, stash

#: Shingles and documents of a block of a cluster.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 21, 2048
#: Shingles that are counted in one matrix product.
_COLUMNS = 4096
#: Differing elements that a block of partitions may hold, about.
SPREAD = 30
#: Each band's upper end is this many times its lower end; a partner lies in the next band at most from LEAST percent on.
BAND, LEAST = 1.5, 67
#: Sets of which a task remembers that it has signed for them.
_REMEMBER = 1_000_000


def bands(most: int) -> list[int]:
    """Lower ends of the size bands up to `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


_BANDS = bands(1 << 40)


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; with fewer than n words the whole sequence is one shingle."""
    w = Words(data, offsets, NOT_BLANK, LOWER)
    grams = {m: w.grams(m) for m in range(1, n + 1)} if len(offsets) > 1 else {}
    out, first = [], w.first.tolist()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        m = min(n, hi - lo)
        out.append(np.unique(grams[m][lo : hi - m + 1]) if m else np.zeros(0, U64))
    return out


def names(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    return int(mix(mix(s).sum(keepdims=True))[0]), int(mix(s ^ U64(0xA5A5A5A5DEADBEEF)).sum())


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    size, out = len(s), []
    band = int(np.searchsorted(_BANDS, size, "right")) - 1
    tags = [band, band + 1] if size * 100 // percent >= _BANDS[band + 1] else [band]
    for tag in tags:
        k = (100 - percent) * 2 * (_BANDS[tag + 1] - 1) // (100 + percent)
        if not k:
            continue  # sets of these sizes are equal or not similar enough
        blocks = max(1, k // SPREAD)
        each = k // blocks // 2 + 3
        n1 = blocks * each
        x = mix(s + U64(tag))
        place = ((x >> U64(32)) * U64(3 * n1) >> U64(32)).astype(np.int64)
        sums = np.zeros(3 * n1, U64)
        np.add.at(sums, place, mix(x))
        part, count = mix(sums + U64(0x51ED270B)).reshape(n1, 3), np.bincount(place, minlength=3 * n1).reshape(n1, 3)
        where = (np.arange(n1, dtype=U64) * U64(3) + U64(tag << 40))[:, None]
        pairs = np.stack([part[:, 1] * U64(3) + part[:, 2], part[:, 0] * U64(3) + part[:, 2], part[:, 0] * U64(3) + part[:, 1]], 1)
        sig = mix(pairs + mix(where + np.arange(3, dtype=U64))).ravel()
        empty = np.flatnonzero((count.sum(1, keepdims=True) - count).ravel() == 0)
        out.append(np.delete(sig, empty))
        if len(empty) > 2:
            by_block: dict[int, list[int]] = {}
            for i in empty.tolist():
                by_block.setdefault(i // 3 // each, []).append(i)
            threes = [t for b in by_block.values() for t in combinations(b, 3) if len({i // 3 for i in t}) == 3]
            if threes:
                a, b, c = sig[np.array(threes)].T
                out.append(mix((a * U64(5) + b) * U64(7) + c))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _name_rows(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, to, data, offsets in pieces(batch, "text"):
                each = sets(data, offsets, n)
                named = [names(s) for s in each]
                yield pa.RecordBatch.from_arrays([ids.slice(row, to - row), pa.array([len(s) for s in each], pa.int64()), *(pa.array(signed(np.array([x[i] for x in named], U64))) for i in (0, 1))], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _signature_rows(n: int, percent: int):
    def run(batches):
        seen = set()
        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                sig, node = [], []
                for s in sets(data, offsets, n):
                    if not len(s):
                        continue
                    name, other = names(s)
                    if (name, other) in seen:
                        continue
                    if len(seen) >= _REMEMBER:
                        seen.clear()
                    seen.add((name, other))
                    x = signatures(s, percent)
                    sig.append(x)
                    node.append(np.full(len(x), name, U64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sig))), pa.array(signed(np.concatenate(node)))], ["sig", "node"])

    return run


def _stars(batches):
    """Of rows sorted by (sig, node): (sig, hub, node) for every node but the first of its signature."""
    sig = hub = last = None
    for batch in batches:
        s, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node"))
        if not len(s):
            continue
        new, same = np.ones(len(s), bool), np.zeros(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        same[1:] = n[1:] == n[:-1]
        if sig is not None:
            new[0], same[0] = s[0] != sig, n[0] == last
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        hubs = np.where(at >= 0, n[at], hub if hub is not None else 0)
        sig, hub, last = int(s[-1]), int(hubs[-1]), int(n[-1])
        keep = ~new & ~same
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, hubs, n)], ["sig", "hub", "node"])


def _set_rows(n: int):
    """Of rows (node, rep, text): (node, rep, size, set), without texts that are not the node's."""

    def run(batches):
        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text"):
                each = sets(data, offsets, n)
                nodes = batch.column("node").slice(row, to - row).to_pylist()
                own = [i for i, s in enumerate(each) if len(s) and signed(np.array([names(s)[0]], U64))[0] == nodes[i]]
                part = batch.slice(row, to - row).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("rep"), pa.array([len(each[i]) for i in own], pa.int64()), pa.array([each[i].tobytes() for i in own], pa.binary())], ["node", "rep", "size", "set"])

    return run


def _elements(percent: int, kind: pa.DataType):
    """Shingles of the sets, of a part of the hash range: twice the share of a set that a partner may lack."""
    top = U64(min((1 << 32) - 1, int((1 << 33) * (100 - percent) / percent)))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                each = [x[mix(x) >> U64(32) <= top] for x in (np.frombuffer(x, U64) for x in batch.column("set").slice(a, 200).to_pylist())]
                own = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(each))), batch.column("rep").slice(a, 200).take(pa.array(own)).cast(kind)], ["x", "rep"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def _verify(percent: int):
    """Of rows (ra, sa, rb, sb): (ra, rb) of the similar sets."""

    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, U64), np.frombuffer(y, U64), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column("ra"), batch.column("rb")], ["a", "b"]).filter(pa.array(keep))

    return run


def block_links(each: list[np.ndarray], comp: list, left: list[bool], right: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between sets of the left and of the right block, as many as join components."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    sizes = np.array([len(s) for s in each])
    flat = np.concatenate(each)
    who = np.repeat(np.arange(len(each)), sizes)
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    who, number = who[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    who, number = who[order], number[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    at = {"a": np.full(len(each), -1), "b": np.full(len(each), -1)}
    at["a"][a], at["b"][b] = np.arange(len(a)), np.arange(len(b))
    for start in range(0, int((count > 1).sum()), _COLUMNS):
        lo, hi = np.searchsorted(number, [start, start + _COLUMNS])
        sides = []
        for side, rows in (("a", a), ("b", b)):
            m = np.zeros((len(rows), _COLUMNS), np.float32)
            w = at[side][who[lo:hi]]
            m[w[w >= 0], number[lo:hi][w >= 0] - start] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    both = shared.astype(np.int64)
    found = np.argwhere(100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both))
    root = {c: c for c in comp}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in found.tolist():
        x, y = top(comp[a[i]]), top(comp[b[j]])
        if x != y:
            root[x] = y
            out.append((int(a[i]), int(b[j])))
    return out


def _block_rows(percent: int, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, U64) for x in table.column("set").to_pylist()]
        i, j, b = (table.column(c).to_pylist() for c in ("i", "j", "block"))
        links = block_links(each, table.column("comp").to_pylist(), [x == y for x, y in zip(b, i, strict=True)], [x == y for x, y in zip(b, j, strict=True)], percent)
        rep = table.column("rep").to_pylist()
        return pa.table({"a": pa.array([rep[x] for x, _ in links], kind), "b": pa.array([rep[y] for _, y in links], kind)})

    return run


def classes(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its shingle set and the smallest doc_id reachable by links.

    Two documents link when their sets' Jaccard similarity is at least `percent`/100.  Texts without
    words are linked with nothing.  A row without doc_id links with nothing, and its component_id is null;
    rows that repeat a doc_id are documents that happen to share it.  Other columns are ignored.
    """
    if percent < LEAST:
        raise ValueError(f"signatures are made for similarities of {LEAST} percent or more")
    docs = docs.select("doc_id", "text")
    id_type = dict(docs.dtypes)["doc_id"]
    rows = stash(docs.mapInArrow(_name_rows(n), f"doc_id {id_type}, n_shingles long, h1 long, h2 long"), "sets")
    known = docs.where(F.col("doc_id").isNotNull())
    # a class is a set; its representative is the smallest doc_id that has it
    reps = stash(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    signed_rows = known.select("doc_id", "text").mapInArrow(_signature_rows(n, percent), "sig long, node long")
    members = stash(signed_rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_stars, "sig long, hub long, node long"), "members")
    all_ = members.select("sig", "node").unionAll(members.select("sig", F.col("hub").alias("node")).distinct())
    wanted = reps.join(all_.select(F.col("node").alias("h1")).distinct(), "h1").select(F.col("h1").alias("node"), "rep")
    found = stash(known.join(wanted, known.doc_id == wanted.rep).select("node", "rep", "text").mapInArrow(_set_rows(n), f"node long, rep {id_type}, size long, set binary"), "node-sets")
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    # a shingle that one candidate alone has is in no intersection; a part of them is enough to tell those that have too many
    alone = found.mapInArrow(_elements(percent, kind), f"x long, rep {id_type}").groupBy("x").agg(F.count("*").alias("many"), F.min("rep").alias("rep")).where("many = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    kept = found.select("node", "rep", "size").join(alone, "rep", "left").where(F.coalesce("alone", F.lit(0)) * percent <= F.col("size") * (100 - percent)).select("node").distinct()
    kept = stash(kept, "kept")
    each = stash(all_.join(kept, "node"), "each")
    drop(members, kept)
    hubs = each.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").select("sig", "hub")
    tested = stash(each.join(hubs, "sig").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "tested")
    side = lambda x: found.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}"), F.col("set").alias(f"s{x}"))
    links = stash(tested.join(side("a"), "a").join(side("b"), "b").select("ra", "sa", "rb", "sb").mapInArrow(_verify(percent), f"a {id_type}, b {id_type}"), "links")
    drop(tested)
    of = stash(components(links), "components")
    # clusters of signatures that the links leave in several components
    placed = found.select("node", "rep", "size").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    placed = stash(placed.select("node", "rep", "size", F.coalesce("component", "rep").alias("comp")), "placed")
    torn = each.join(placed.select("node", "comp"), "node").groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("a"), F.count("*").alias("many"))
    torn = torn.where("lo <> hi and many > 2").select("sig", "a")
    ties = stash(each.join(torn, "sig").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "ties")
    if not ties.isEmpty():
        clusters = stash(placed.join(components(ties).withColumnRenamed("component", "cluster"), "node"), "clusters")
        several = clusters.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("size").alias("shingles"))
        several = several.select("cluster", F.greatest(F.ceil(F.col("many") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
        dealt = clusters.join(several, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cluster", "node", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        dealt = dealt.join(found.select("node", "rep", "set"), ["node", "rep"])
        more = stash(dealt.groupBy("cluster", "i", "j").applyInArrow(_block_rows(percent, kind), f"a {id_type}, b {id_type}"), "more-links")
        of = stash(components(links.unionAll(more)), "components")
        drop(clusters, more)
    drop(each, found, placed, ties, links)
    of = of.select(F.col("node").alias("rep"), "component")
    named = rows.join(reps, ["h1", "h2", "n_shingles"], "left").join(of, "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents but those whose component has a smaller doc_id; of equal rows of the smallest doc_id all stay.

    Rows without doc_id and texts without words stay, an empty table stays empty, and so do other columns, whatever their names.
    """
    name = "gone"
    while name in (c.lower() for c in docs.columns):
        name = "_" + name
    of = classes(docs, n=n, percent=percent).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(of, F.col("doc_id") == F.col(name), "left_anti")


SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') w from documents),
s as (select distinct doc_id, array_to_string(w[k : k + least(3, len(w)) - 1], ' ') g
      from (select doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) k from w where len(w) > 0)),
z as (select w.doc_id, count(g) n from w left join s using (doc_id) group by 1),
b as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
p as (select x, y from b join z u on u.doc_id = x join z v on v.doc_id = y where 100 * c >= 90 * (u.n + v.n - c)),
l as (select x, y from p union select y, x from p),
r as (select doc_id x, doc_id y from z union select r.x, l.y from r join l on r.y = l.x)
select z.doc_id, z.n n_shingles, min(r.y) component_id from z join r on r.x = z.doc_id group by 1, 2
"""
