"""The nearest row in time among those whose boxes touch, without pairs of rows.

Rows of both sides are dealt to cells and time buckets and sorted there; a task reads a cell's right rows, and then its left rows
as a stream, each of which looks at the right rows from its own time outwards until one touches it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import BOX
from ..functions.numeric import micros

#: Rows that are searched together, and candidates that are looked at together, about.
_ROWS, _LOOKS = 65_536, 1 << 20
_CELL = ["_g", "_cx", "_cy", "_t"]


def _middle(of: str) -> Column:
    return (micros(f"{of}.start_time") + micros(f"{of}.end_time")) / 2 / 1e6


def _size(reach: float) -> Column:
    """The power of two that holds the longer side of p's box, widened by `reach`."""
    side = F.greatest(F.col("p.xmax") - F.col("p.xmin"), F.col("p.ymax") - F.col("p.ymin")) + 2.000001 * reach
    return F.when(side > 2.0**-60, F.least(F.ceil(F.log2(side)), F.lit(60))).otherwise(-60).cast("int")


def grids(rows: DataFrame, reach: float = 0.0) -> list[int]:
    """Powers of two as widths of grids for rows with a struct p: one that holds nine in ten boxes, and those of larger ones."""
    counts = sorted((r[0], r[1]) for r in rows.groupBy(_size(reach)).count().collect())
    total, seen, out = sum(n for _, n in counts), 0, []
    for k, n in counts:
        seen += n
        if seen * 10 >= total * 9:
            out.append(k)
    return out or [0]


def _touching(m_p, p, m_s, s, order, at, step, lo, hi, limit):
    """For each left row the first right row from `at` on, in steps of `step`, that touches it within the limit; -1 if there is none."""
    import numpy as np

    best, rows, wide = np.full(len(m_p), -1), np.flatnonzero((at >= lo) & (at < hi)), 4
    at = at.copy()
    while len(rows):
        wide = max(1, min(wide, _LOOKS // len(rows)))
        i = at[rows, None] + step * np.arange(wide)
        j = order[np.clip(i, 0, len(order) - 1)]
        fits = (i >= lo[rows, None]) & (i < hi[rows, None]) & (np.abs(m_p[rows, None] - m_s[j]) <= limit[rows, None])
        hit = fits & (p[0][rows, None] <= s[2][j]) & (p[2][rows, None] >= s[0][j]) & (p[1][rows, None] <= s[3][j]) & (p[3][rows, None] >= s[1][j])
        some, first = hit.any(1), hit.argmax(1)
        best[rows[some]] = j[some, first[some]]
        rows = rows[~some & fits[:, -1]]
        at[rows] += step * wide
        wide *= 2
    return best


def search(g_p, m_p, p, g_s, m_s, rank, s, seconds: float):
    """Numbers of the nearest right rows in time, of equal ones that of the lowest rank, or -1; g are numbers of cells, p and s boxes."""
    import numpy as np

    n, k = len(m_p), len(m_s)
    if not n or not k:
        return np.full(n, -1)
    up, down = np.lexsort((rank, m_s, g_s)), np.lexsort((-rank, m_s, g_s))
    right = np.arange(n + k) >= n
    both = np.lexsort((right, np.concatenate([m_p, m_s]), np.concatenate([g_p, g_s])))
    at = np.empty(n + k, dtype=np.int64)
    at[both] = np.cumsum(right[both])
    at, g = at[:n], g_s[up]
    lo, hi = np.searchsorted(g, g_p, "left"), np.searchsorted(g, g_p, "right")
    limit = np.full(n, float(seconds))
    before = _touching(m_p, p, m_s, s, down, at - 1, -1, lo, hi, limit)
    far = np.where(before >= 0, np.abs(m_p - m_s[before]), np.inf)
    after = _touching(m_p, p, m_s, s, up, at, 1, lo, hi, np.minimum(limit, far))
    near = np.where(after >= 0, np.abs(m_p - m_s[after]), np.inf)
    return np.where((near < far) | ((near == far) & (after >= 0) & (rank[after] < rank[before])), after, before)


def _searched(seconds: float, only: bool, columns: list[str], name: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        floats = lambda t, c: t.column(c).to_numpy().astype(float)
        kept, waiting, rows = None, [], 0

        def flush():
            nonlocal kept, waiting, rows
            t = pa.concat_tables(([kept] if kept is not None else []) + [pa.Table.from_batches([b]) for b in waiting]).combine_chunks()
            waiting, rows = [], 0
            keys = [t.column(c).fill_null(0).to_numpy() for c in _CELL]
            new = np.zeros(len(t), dtype=bool)
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            g, is_right = np.cumsum(new), ~t.column("_left").to_numpy().astype(bool)
            right, left = t.filter(pa.array(is_right)), t.filter(pa.array(~is_right))
            # the last cell's left rows may go on
            kept = t.filter(pa.array(is_right & (g == g[-1])))
            if not len(left):
                return None
            rank = pc.rank(right.column("_r").combine_chunks().field("id"), null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64) if len(right) else np.zeros(0, dtype=np.int64)
            box = lambda side: [floats(side, f"_{c}") for c in BOX]
            found = search(g[~is_right], floats(left, "_m"), box(left), g[is_right], floats(right, "_m"), rank, box(right), seconds)
            if only:
                left, found = left.filter(pa.array(found >= 0)), found[found >= 0]
            if not len(left):
                return None
            match = right.column("_r").combine_chunks().take(pa.array(found, mask=found < 0))
            own = left.column("_l").combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            return pa.RecordBatch.from_arrays([own.field(k) for k in range(len(columns))] + [match.chunk(0) if isinstance(match, pa.ChunkedArray) else match], names=[*columns, name])

        for b in batches:
            waiting.append(b)
            rows += b.num_rows
            if rows >= max(_ROWS, 0 if kept is None else len(kept)):
                out = flush()
                if out is not None:
                    yield out
        if waiting:
            out = flush()
            if out is not None:
                yield out

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, seconds: float, name: str, *, widths: list[int], reach: float = 0.0, only: bool = True) -> DataFrame:
    """Rows of `left` with a further column: the row of `right` of the nearest midpoint among those whose boxes touch that of p, or null.

    p is a struct of box and interval, widened by `reach`; midpoints are at most `seconds` apart, ties go to the smallest id.
    `only`: rows that have such a row.  Of right rows with the same box and interval only that of the smallest id takes part.
    """
    c, width = F.col, max(2 * seconds, 1.0)
    r = right.groupBy(*BOX, "start_time", "end_time").agg(F.min("id").alias("id")).select(F.struct("id", *BOX, "start_time", "end_time").alias("_r"))
    empty = lambda t: F.lit(None).cast(t)
    sign = dict(zip(BOX, (-1, -1, 1, 1), strict=True))
    a = left.select(F.struct("*").alias("_l"), "p", _middle("p").alias("_m"), *[(c(f"p.{k}") + sign[k] * reach if reach else c(f"p.{k}")).cast("double").alias(f"_{k}") for k in BOX])
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), "_g")).cast("long")
    a = a.withColumn("_g", F.greatest(_size(reach), F.lit(widths[0])))
    a = a.withColumns({"_cx": cell(c("_xmin")), "_cy": cell(c("_ymin")), "_t": F.floor(c("_m") / width).cast("long")})
    b = r.select("_r", _middle("_r").alias("_m"), *[c(f"_r.{k}").cast("double").alias(f"_{k}") for k in BOX], F.explode(F.array(*map(F.lit, widths))).alias("_g"))
    for k in ("_m", *[f"_{k}" for k in BOX]):
        b = b.where(~F.isnan(k))
    # a left box is no wider than its cell, and lies in that of its lower corner; the small amounts are more than roundings
    span = lambda lo, hi: F.sequence(cell(F.least(lo, hi) - 1.000001 * F.pow(F.lit(2.0), "_g")), cell(F.greatest(lo, hi)))
    b = b.withColumn("_t", F.explode(F.sequence(F.floor((c("_m") - seconds) / width - 1e-6).cast("long"), F.floor((c("_m") + seconds) / width + 1e-6).cast("long"))))
    b = b.withColumn("_cx", F.explode(span("_xmin", "_xmax"))).withColumn("_cy", F.explode(span("_ymin", "_ymax")))
    columns = [*_CELL, "_left", "_m", *[f"_{k}" for k in BOX], "_l", "_r"]
    both = a.withColumns({"_left": F.lit(True), "_r": empty(b.schema["_r"].dataType)}).select(*columns).unionAll(b.withColumns({"_left": F.lit(False), "_l": empty(a.schema["_l"].dataType)}).select(*columns))
    both = both.repartition(*_CELL).sortWithinPartitions(*_CELL, "_left")
    schema = T.StructType([*left.schema.fields, T.StructField(name, b.schema["_r"].dataType)])
    return both.mapInArrow(_searched(float(seconds), only, left.columns, name), schema)
