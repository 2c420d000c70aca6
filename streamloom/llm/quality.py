"""Quality rules as a short-circuit cascade of native expressions."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, strip_white, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows at most on which a rule's cost and selectivity are estimated.  They
#: decide the order of the rules only, never a verdict.
SAMPLE_ROWS = 300
#: Code points of a text in the sample at most, which bounds what the driver gets.
SAMPLE_CHARS = 20_000
#: Seconds below which timings on the sample are noise.
NOISE = 0.03


def _windows(w: Column) -> Column:
    """(hash, position) of each window of ``w``, sorted."""
    at = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(w, i, WINDOW)).alias("k"), i.alias("i"))))


def _repeated(pairs: Column) -> Column:
    """Of sorted (key, position) pairs, the positions whose key occurs again."""

    def again(s: Column, j: Column) -> Column:
        key = F.get(s, j)["k"]
        return F.coalesce(key == F.get(s, j - 1)["k"], F.lit(False)) | F.coalesce(key == F.get(s, j + 1)["k"], F.lit(False))

    return let(
        pairs,
        lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: again(s, j)), lambda j: F.get(s, j)["i"]
        ),
    )


def _covered(positions: Column) -> Column:
    """Words in the union of the windows that start at ``positions``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last"))
    return F.aggregate(F.sort_array(positions), start, step, lambda a: a["n"])


def _exact(w: Column, at: Column) -> Column:
    """Windows at ``at`` that share a hash, compared word for word."""
    text = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("k"), i.alias("i"))))
    return let(_repeated(text), lambda p: F.when(F.size(p) > 0, _covered(p)).otherwise(0))


def repeat_words(w: Column) -> Column:
    """Words of ``w`` in windows of 8 words that ``w`` holds twice or more."""
    found = let(_repeated(_windows(w)), lambda at: F.when(F.size(at) > 0, _exact(w, at)).otherwise(0))
    return F.when(F.size(w) > WINDOW, found).otherwise(0)


def symbol_count(text: Column) -> Column:
    left = text
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("bigint")


def line_counts(text: Column) -> Column:
    """struct(n_lines, n_dup_lines) of the lines that hold a word."""
    some = F.filter(F.split(text, "\n"), lambda x: F.length(strip_white(x)) > 0)
    return let(
        some,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )


def word_chars(text: Column) -> Column:
    return F.char_length(strip_white(text)).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """``fails`` maps metrics by name to a boolean; it takes those it needs, so others aren't computed for it."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


RULES = (
    Rule("short", lambda m: m["n_words"] < 20),
    Rule("symbols", lambda m: m["n_symbols"] * 2 > m["n_words"]),
    Rule("word_length", lambda m: m["word_chars"] > 40 * m["n_words"]),
    Rule("same_lines", lambda m: let(m["lines"], lambda x: x["n_dup_lines"] * 2 > x["n_lines"])),
    Rule("repeats", lambda m: m["n_repeat_words"] * 100 > 30 * m["n_words"]),
)


def metrics(text: Column, w: Column) -> dict[str, Column]:
    """The metrics of a text with the words ``w``, as expressions."""
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": word_chars(text),
        "n_symbols": symbol_count(text),
        "lines": line_counts(text),
        "n_repeat_words": repeat_words(w).cast("bigint"),
    }


def ordered_rules(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second, both estimated on at most ``sample_rows`` rows.

    The sample is drawn by seed from texts of ``SAMPLE_CHARS`` at most, partition
    after partition until it is full.  A rule's cost is what it takes over the
    words, which all rules share: the least of three runs after a first one,
    in steps of a factor of two above what is noise, so that reruns mostly
    agree.  With no row to estimate on, the given order stays.  A rule
    that rejects nothing comes after those that do, cheapest first.
    """
    text = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("t")).filter(F.char_length("t") <= SAMPLE_CHARS)
    rows = text.sample(0.1, seed=7).limit(sample_rows).collect()
    if not rows:
        return list(rules)
    sample = docs.sparkSession.createDataFrame(rows, "t string").coalesce(1)

    def timed(fails: Callable[[dict[str, Column]], Column]) -> tuple[float, int]:
        verdict = let(words(F.col("t")), lambda w: fails(metrics(F.col("t"), w)))
        job = sample.select(F.coalesce(F.sum(verdict.cast("int")), F.lit(0)))
        least = math.inf
        for k in range(4):
            began = time.perf_counter()
            n = job.collect()[0][0]
            if k:
                least = min(least, time.perf_counter() - began)
        return least, n

    base, _ = timed(lambda m: m["n_words"] < 0)
    found = {}
    for r in rules:
        cost, rejected = timed(r.fails)
        step = max(round(math.log2(max(cost - base, NOISE) / NOISE)), 0)
        found[r.name] = (-rejected / 2**step, step)
    return sorted(rules, key=lambda r: found[r.name])


def cascade(rules: list[Rule], m: dict[str, Column]) -> Column:
    """True where a rule rejects; rules after the first that does are not run."""
    out = F.lit(False)
    for r in reversed(rules):
        out = F.when(r.fails(m), F.lit(True)).otherwise(out)
    return out


def rejects(rules: list[Rule], text: Column) -> Column:
    """The cascade over a text, whose words are split once for all rules."""
    return let(text, lambda t: let(words(t), lambda w: cascade(rules, metrics(t, w))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with its metrics, base verdict and verdict.

    A null text counts as empty: it has no word, fails and isn't kept.
    Repeated rows each get their row.  Other columns of ``docs`` are not read.
    The metrics are part of the report, so each is computed once for every
    row and the cascade runs over them; it saves work where only the verdict
    is asked for, in :func:`drop_low_quality`.
    """
    rules = ordered_rules(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"))).alias("_w"),
        line_counts(text).alias("lines"),
        word_chars(text).alias("word_chars"),
        symbol_count(text).alias("n_symbols"),
    )
    flat = counted.select("doc_id", "_w.n_words", "word_chars", "n_symbols", "lines.n_dup_lines", "_w.n_repeat_words", "lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    m = {c: F.col(c) for c in flat.columns}
    return flat.withColumns({"base_failed": failed, "kept": ~(failed | cascade(rules, m))}).drop("lines")


def drop_low_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged.

    The rules run on each text in the estimated order and stop at the first
    that rejects it.  Null and empty texts are rejected; repeated rows are
    judged alike; a very long text is judged whole.
    """
    rules = ordered_rules(docs, text_col)
    return docs.filter(~rejects(rules, F.coalesce(docs[text_col], F.lit(""))))
