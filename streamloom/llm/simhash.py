"""SimHash near-dedup with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import golay
from .common import checkpointed, scratch
from .components import components
from .runs import colliding, forest, linked, meetings, overlaps
from .textarrays import text_shingles

SHINGLE = 3
SEED = 42
BITS = 3
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, a piece at a time; pieces end where a word does."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, repeats included."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text.lower()):
        w = tail + piece
        if len(w) >= shingle:
            parts = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
            h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(w) - shingle + 1)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        tail = w[-(shingle - 1) :] if shingle > 1 else []
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of each row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), shingle) for x in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return base.mapInArrow(each, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        row, key = golay.keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])


def _compare(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp, node = run["fp"].to_numpy().view(np.uint64), run["node"].to_numpy()
    root = forest(len(fp), lambda i, rest: np.bitwise_count(fp[rest] ^ fp[i]) <= BITS)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return node[moved], node[root[moved]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint, component_id.

    Fingerprints link at 3 or fewer differing bits, and component_id is the
    smallest id that links reach.  Null and empty texts have fingerprint 0
    and link like any other.  Rows with the same id are one document.  A row
    with a null id gets its fingerprint and takes part in no link; its
    component_id is null.  Ids are integers; other columns are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    some = prints.filter("doc_id is not null")
    # copies share a fingerprint: one row stands for all of them; written, so
    # that joins to it can split a fingerprint of very many copies
    nodes = checkpointed(some.groupBy("fp").agg(F.min("doc_id").alias("node")))
    keys = nodes.mapInArrow(_keys, "key long, fp long, node long")
    links = linked(meetings(keys, "key", "fp", "node"), _compare)
    same = some.join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = same.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo < hi")
    found = components(links.unionAll(repeated.select(F.col("lo").alias("a"), F.col("hi").alias("b"))))
    of = nodes.join(found, nodes["node"] == found["node"], "left").select("fp", F.coalesce("root", nodes["node"]).alias("component_id"))
    return prints.join(of, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


#: The stage's shingles, similarity (as a fraction) and samples; see similar_documents.
WORDS, NEAR, SAMPLES, SKETCH = 5, (4, 5), 8, 512
#: What sketches have to estimate for a pair to be compared whole: over five standard errors below NEAR.
MAYBE = (7, 10)
#: Whole shingle sets that are compared in one go.
WHOLE = 256
_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 2**63, 3 * SAMPLES, np.uint64)
_ODD = _random.integers(0, 2**63, 3 * SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def whole_print(h: np.ndarray) -> int:
    """The SimHash of a text with the shingle hashes ``h``, as a signed number."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def samples(h: np.ndarray) -> np.ndarray:
    """SimHashes of samples of three shingles, each the smallest under a hash of its own: the majority of their bits."""
    least = np.array([((h ^ x) * o).min() for x, o in zip(_XOR, _ODD)])
    a, b, c = ((m ^ (m >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) for m in (least[0::3], least[1::3], least[2::3]))
    return (a & b) | (a & c) | (b & c)


def sketch(h: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` smallest of a set's hashes, to 32 bits."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    for b in batches:
        rows = []
        for i, h in zip(b.column(0).to_pylist(), text_shingles((t.as_buffer().to_pybytes() for t in b.column(1)), WORDS)):
            if len(h):
                fp, h = whole_print(h), np.unique(h)
                rows.append((i, xxhash.xxh3_128_digest(h.tobytes()), fp, samples(h).view(np.int64).tolist(), sketch(h).tobytes()))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "name", "fp", "samples", "sketch"])


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, fp, samples) -> a row for each Golay key of the text's SimHash, and for each sample."""
    for b in batches:
        name, fp = b.column(0), b.column(1).to_numpy().view(np.uint64)
        row, key = golay.keys(fp)
        drawn = b.column(2).flatten().to_numpy().reshape(len(fp), SAMPLES).view(np.uint64)
        # of a sample its number and as many bits as leave room for that
        own = (drawn >> np.uint64(8) | np.arange(SAMPLES, dtype=np.uint64) << np.uint64(56) | np.uint64(1 << 63)).view(np.int64)
        at = np.concatenate([row, np.repeat(np.arange(len(fp)), SAMPLES)])
        yield pa.RecordBatch.from_arrays([name.take(pa.array(at)), pa.array(np.concatenate([key, own.ravel()]))], ["name", "key"])


def similarity_at_least(a: np.ndarray, b: np.ndarray, near: tuple[int, int] = NEAR, size: int = SKETCH) -> bool:
    """Whether two shingle sets are that similar; of sets over ``size``, by the smallest hashes of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    if len(a) == size or len(b) == size:
        low = np.union1d(a, b)[:size]
        both, union = len(np.intersect1d(np.intersect1d(low, a, True), b, True)), len(low)
    return near[1] * both >= near[0] * union


def _maybe(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links of names that may be similar: by whole sketches, or by ``MAYBE`` where one is cut at ``SKETCH``."""
    name = np.array(run["name"].to_pylist(), object)
    sets = [np.frombuffer(x, np.uint32) for x in run["sketch"].to_pylist()]
    size, shared = np.array(list(map(len, sets))), overlaps(sets)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        both = shared(i)[rest]
        union = size[i] + size[rest] - both
        full = (size[rest] == SKETCH) | (size[i] == SKETCH)
        ok = np.where(full, MAYBE[1] * both >= MAYBE[0] * np.minimum(SKETCH, union), NEAR[1] * both >= NEAR[0] * union)
        full &= ok
        ok[full] = [similarity_at_least(sets[i], sets[j], MAYBE) for j in rest[full].tolist()]
        return ok

    root = forest(len(name), near)
    moved = np.flatnonzero(root != np.arange(len(name)))
    return name[moved], name[root[moved]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, node, runs, text) -> a row for each run with the whole shingle set, where the text is the name's."""

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["run", "node", "shingles"])

    rows, size = [], 0
    for b in batches:
        texts = text_shingles((t.as_buffer().to_pybytes() for t in b.column(3)), WORDS)
        for name, node, runs, h in zip(*(b.column(c).to_pylist() for c in range(3)), texts):
            h = np.unique(h).tobytes()
            if xxhash.xxh3_128_digest(h) != name:
                continue
            for run in runs:
                rows.append((run, node, h))
                size += len(h)
                if size > PIECE:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def _verify(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    node = run["node"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in run["shingles"].to_pylist()]
    size, shared = np.array(list(map(len, sets))), overlaps(sets)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        both = shared(i)[rest]
        return NEAR[1] * both >= NEAR[0] * (size[i] + size[rest] - both)

    root = forest(len(node), near)
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[moved], node[root[moved]]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root for each id that isn't the smallest of its group of near duplicates.

    Two texts link at a Jaccard similarity of their five-word shingles of 0.8
    or more.  Candidates share a Golay key of their SimHashes, as in
    :func:`near_duplicates`.  At a similarity of 0.8 SimHashes of whole texts
    differ in about 10 bits, which no selective key bridges.  So each text
    also has ``SAMPLES`` SimHashes of three shingles each, where similar texts
    mostly draw the same ones; texts that share one are candidates as well.
    Eight samples miss three in a thousand pairs at 0.8, fewer above.
    Sketches only choose what is compared (of texts of over ``SKETCH``
    shingles with a margin of over five standard errors): texts that may be
    similar form groups, and within these the whole shingle sets are compared.
    Null ids and texts without a word link to nothing here.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    text = base.filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    with scratch() as kept:
        drawn = kept(text.mapInArrow(_sketches, "node long, name binary, fp long, samples array<long>, sketch binary"), "sketches")
        # texts with the same shingles: one stands for all of them
        first = checkpointed(drawn.groupBy("name").agg(F.min("node").alias("first")))
        same = drawn.select("node", "name").join(first, "name").select(F.col("node").alias("a"), F.col("first").alias("b"))
        # texts that share an id have names, and sketches, of their own
        alone = drawn.select("name", "node", "fp", "samples").join(first, "name").filter("node = first").dropDuplicates(["name"])
        keys = alone.select("name", "fp", "samples").mapInArrow(_all_keys, "name binary, key long")
        met = meetings(keys, "key", "name")
        maybe = components(linked(met.join(drawn.select("name", "sketch").dropDuplicates(["name"]), "name"), _maybe, "a binary, b binary"))
        group = maybe.unionAll(maybe.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("name"), "root")
        # each text is read and sent once, unless its group is very large
        runs = colliding(group.join(first, "name"), "root", "name", WHOLE).groupBy("name", "first").agg(F.collect_list("run").alias("runs"))
        whole = text.join(runs, F.col("doc_id") == F.col("first")).select("name", "first", "runs", "text")
        pairs = linked(whole.mapInArrow(_whole, "run long, node long, shingles binary"), _verify)
        return components(same.unionAll(pairs))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each group of :func:`similar_documents` left, columns unchanged.

    One row stays of rows that share an id, any of them; rows with a null id
    all stay, and so do texts without a word.  Very long texts are compared
    whole.
    """
    gone = similar_documents(docs, id_col, text_col).select(F.col("node").alias("_loom_id")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.filter(docs[id_col].isNotNull()).withColumn("_loom_id", docs[id_col].cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("_loom_id").orderBy(F.lit(1)))
    kept = keyed.join(gone, "_loom_id", "left_anti").withColumn("_loom_r", rank).filter("_loom_r = 1")
    return kept.select(*names).unionAll(docs.filter(docs[id_col].isNull()))
