"""Comparing the rows of a bucket without meeting in one task or emitting all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows of a bucket that are compared in one go; larger buckets are split.
BLOCK = 2048


def colliding(rows: DataFrame, key: str, by: str, block: int = BLOCK) -> DataFrame:
    """The rows whose ``key`` occurs again, with ``run``: what is to be compared together.

    A bucket of over ``block`` rows is dealt by a hash of ``by`` into blocks
    of about that size, and each pair of blocks is a run of its own, so every
    two rows of a bucket meet in a run however large it is.
    """
    # written first, so that the join has exchanges of its own and a hot key can be split
    sizes = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("run", F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other")))
        .drop("_n", "_blocks", "_mine", "_other")
    )


def meetings(rows: DataFrame, key: str, node: str, *others: str, block: int = BLOCK) -> DataFrame:
    """``run`` and ``node``: which nodes are to be compared together, from narrow ``rows`` (key, node).

    ``others`` are columns that depend on the node and go along.  As
    :func:`colliding`, but keys that the same nodes have are one meeting, so
    nodes that share several keys meet once.  Two meetings with the same
    signature by chance would only be compared together.
    """
    h = F.xxhash64(node)
    # written first, so that the join has exchanges of its own and a hot key can be split
    sizes = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(h).alias("_x"), F.min(h).alias("_m")).filter("_n > 1"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(h, F.col("_blocks")).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(F.xxhash64("_n", "_x", "_m", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("run"), node, *others)
        .distinct()
    )


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by ``run``, tables of whole runs with the bounds of each run of two rows or more."""

    def bounds(run: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]])

    def out(table: pa.Table):
        at = bounds(table["run"].to_numpy())
        some = np.flatnonzero(at[1:] - at[:-1] > 1)
        return table, np.stack([at[some], at[some + 1]], axis=1)

    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        last = bounds(table["run"].to_numpy())[-2]
        if last:
            yield out(table.slice(0, last).combine_chunks())
        carry = table.slice(last)
    if carry is not None:
        yield out(carry.combine_chunks())


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``n`` rows the first row of its component.

    ``near(i, rest)`` tells which of the rows ``rest`` are linked to row i.
    Each row is compared with the rows not reached yet, so every component
    comes out whole, yet with one link a row.
    """
    root, rest = np.arange(n), np.arange(1, n)
    for start in range(n):
        if root[start] != start:
            continue
        todo = [start]
        rest = rest[rest != start]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                root[rest[hit]] = start
                todo.extend(rest[hit].tolist())
                rest = rest[~hit]
    return root


def overlaps(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """For set i of sorted numbers, how many it shares with each of ``sets``."""
    size = np.array(list(map(len, sets)))
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def shared(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(sets))

    return shared


#: Rows of a run up to which all its pairs are compared in one go with those of other runs.
FEW = 24
#: Elements of sets that are compared in one go.
ELEMENTS = 1 << 21


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _shared(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers the sets i and j of each pair share."""
    pair = np.arange(len(i), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = flat[_ranges(start[i], size[i])] + np.repeat(pair, size[i])
    b = flat[_ranges(start[j], size[j])] + np.repeat(pair, size[j])
    return np.bincount(np.repeat(np.arange(len(i)), size[j])[np.isin(b, a)], minlength=len(i))


def similar_rows(sets: list[np.ndarray], at: np.ndarray, near: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows, within each run of rows ``at`` (from, to), whose sets of sorted numbers have that Jaccard similarity.

    The pairs of small runs are compared together; a large run is compared row
    by row, each with those not reached yet.
    """
    size = np.array(list(map(len, sets)), np.int64)
    count = at[:, 1] - at[:, 0]
    first, second, a, b = [], [], [], []
    for n in np.unique(count[count <= FEW]).tolist():
        x, y = np.triu_indices(n, 1)
        base = at[count == n, :1]
        first.append((base + x).ravel())
        second.append((base + y).ravel())
    if first:
        i, j = np.concatenate(first), np.concatenate(second)
        # sets of too different sizes can't be similar
        ok = near[1] * np.minimum(size[i], size[j]) >= near[0] * np.maximum(size[i], size[j])
        i, j = i[ok], j[ok]
        flat, start = np.concatenate(sets), np.cumsum(size) - size
        work = np.cumsum(size[i] + size[j])
        for k in range(int(work[-1] // ELEMENTS) + 1 if len(work) else 0):
            lo, hi = np.searchsorted(work, [k * ELEMENTS, (k + 1) * ELEMENTS])
            x, y = i[lo:hi], j[lo:hi]
            both = _shared(flat, start, size, x, y)
            hit = near[1] * both >= near[0] * (size[x] + size[y] - both)
            a.append(x[hit])
            b.append(y[hit])
    for lo, hi in at[count > FEW].tolist():
        shared, own = overlaps(sets[lo:hi]), size[lo:hi]

        def close(i: int, rest: np.ndarray, shared=shared, own=own) -> np.ndarray:
            both = shared(i)[rest]
            return near[1] * both >= near[0] * (own[i] + own[rest] - both)

        root = forest(hi - lo, close)
        moved = np.flatnonzero(root != np.arange(hi - lo))
        a.append(lo + moved)
        b.append(lo + root[moved])
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def linked_sets(rows: DataFrame, sets: Callable[[pa.Table], list[np.ndarray]], near: tuple[int, int], schema: str = "a long, b long") -> DataFrame:
    """Links (a, b) of the nodes of each run of ``rows`` (run, node, ...) whose ``sets`` are similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches):
            if not len(at):
                continue
            i, j = similar_rows(sets(table), at, near)
            node = table["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(each, schema)


def linked(rows: DataFrame, compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], schema: str = "a long, b long") -> DataFrame:
    """Links (a, b) that ``compare`` finds in each run of ``rows`` (see :func:`colliding`)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_runs(batches):
            a, b = [], []
            for lo, hi in at.tolist():
                x, y = compare(table.slice(lo, hi - lo))
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(each, schema)
