"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length.  Each source takes whole passes over
its documents; bounded-knapsack dynamic programming over all its lengths then
fits the words that are left over exactly, or as near from below as sums of
lengths come.  Where these words are more than a table holds, an even share of
every length goes first and half a table is left to fit, from all documents
that are left.  Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, words

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
SEED = 42
#: Words that a table of the dynamic programming reaches, or four times the longest document if that is more.
TABLE = 1 << 20
#: Documents of one source and length that are ranked together.
RANKED = 512


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> dict:
    """source -> words to take; a source's excess over ``most`` times its size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    rest, weight, out = share * sum(n for _, n in sizes), sum(w for *_, w in left), {}
    for s, n, w in sorted(left, key=lambda x: x[1] / x[2]):
        out[s] = float(min(most * n, rest * w / weight)) if weight else 0.0
        rest, weight = rest - out[s], weight - w
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near ``budget`` from below as sums allow."""
    reach, first, items = 1, np.full(budget + 1, -1, np.int32), []
    whole = (1 << (budget + 1)) - 1
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, part = min(counts[i], budget // lengths[i] if lengths[i] else 0), 1
        while n > 0 and not reach >> budget & 1:
            k = min(part, n)
            new = (reach << (k * lengths[i])) & whole & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(raw)
                at, bit = np.nonzero(np.unpackbits(raw[some, None], axis=1, bitorder="little"))
                first[8 * some[at] + bit] = len(items)
            items.append((i, k))
            reach, n, part = reach | new, n - k, part * 2
    at, take = reach.bit_length() - 1, [0] * len(lengths)
    while at > 0:
        i, k = items[first[at]]
        take[i] += k
        at -= k * lengths[i]
    return take


def plan_source(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """Whole passes over a source, and how many documents of each length to take once more."""
    size = sum(a * n for a, n in zip(lengths, counts))
    if size == 0:
        return 0, [0] * len(lengths)
    passes, rest = divmod(int(target + 0.5), size)
    if passes >= MOST_PASSES:
        return MOST_PASSES, [0] * len(lengths)
    take, table = [0] * len(lengths), max(TABLE, 4 * max(lengths))
    if rest > table:
        aim, due, taken = rest - table // 2, 0, 0
        # what rounding leaves of one length falls to the shorter ones
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            due += lengths[i] * counts[i] * aim
            if lengths[i]:
                take[i] = min(counts[i], (due // size - taken) // lengths[i])
                taken += take[i] * lengths[i]
        rest -= taken
    more = fit(lengths, [n - k for n, k in zip(counts, take)], rest)
    return passes, [a + b for a, b in zip(take, more)]


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    passes, take = plan_source([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], float(pdf["target"].iloc[0]))
    return pdf[["s", "size", "n", "target", "source_size"]].assign(passes=passes, take=take)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, times, taken.

    ``times`` is how often the mix takes the document (0 to 2) and ``taken``
    its words, repeats counted.  A null text has size 0, null is a source of
    its own, and an empty document is taken with its source's whole passes.
    Rows repeated with the same id are documents of their own.  The driver
    plans the table of sources, a name and a number each; counts by source and
    length stay on the executors, where a source's are one task.  An empty
    table gives none.  Reruns agree.
    """
    spark = docs.sparkSession
    base = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            # the null source and an empty name stay apart
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
            F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        )
    )
    counts = base.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect()
    name = lambda s: s[1:] if s else None
    aims = targets([(name(r["s"]), r["w"]) for r in sizes])
    goal = spark.createDataFrame(
        [(r["s"], aims[name(r["s"])], r["w"]) for r in sizes], "s string, target double, source_size long"
    )
    plan = (
        counts.join(goal, "s")
        .groupBy("s")
        .applyInPandas(_plan, "s string, size long, n long, target double, source_size long, passes long, take long")
    )
    # A group of one source and length can hold any number of documents: it is
    # ranked in parts of about RANKED, by the hash that orders it anyway.
    parts = F.ceil(F.col("n") / RANKED)
    part = F.shiftright(F.shiftrightunsigned("h", 33) * parts, 31)
    # written, so that the join can split a source and length of very many rows
    rows = checkpointed(base.join(plan, ["s", "size"]).withColumn("part", part))
    keys = ["s", "size", "part"]
    before = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).select(*keys, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
    times = F.col("passes") + (F.col("first") + rank <= F.col("take")).cast("bigint")
    return rows.join(starts, keys).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows not taken go, rows taken twice come twice.

    Columns are unchanged.  Rows that share id, source and size share what
    the mix takes of them.
    """

    def key(doc_id: Column, source: Column, size: Column) -> Column:
        return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), F.concat(F.lit("="), source.cast("string")))

    took = (
        mix(docs, id_col, text_col, source_col)
        .groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("_loom_key"))
        .agg(F.sum("times").alias("_loom_t"), F.count(F.lit(1)).alias("_loom_n"))
        .filter("_loom_t > 0")
    )
    size = F.size(words(F.coalesce(docs[text_col], F.lit("")))).cast("bigint")
    keyed = docs.withColumn("_loom_key", key(docs[id_col], docs[source_col], size))
    # the join has sorted by the key, so the rank costs no further exchange
    rank = F.row_number().over(Window.partitionBy("_loom_key").orderBy(F.lit(1)))
    times = F.floor(F.col("_loom_t") / F.col("_loom_n")) + (F.col("_loom_r") <= F.col("_loom_t") % F.col("_loom_n")).cast("int")
    return (
        keyed.join(took, "_loom_key")
        .withColumn("_loom_r", rank)
        .withColumn("_loom_times", times.cast("int"))
        .filter("_loom_times > 0")
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_loom_times"))).alias("_loom_k"))
        .drop("_loom_k")
    )
