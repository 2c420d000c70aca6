"""The parts that operators share: folders, word arrays, meetings, comparisons."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamloom.llm import common, runs, simhash, textarrays
from streamloom.llm.components import components


class Context:
    def __init__(self, master, by_call=None, by_conf=None):
        self.master, self.dir, self.named = master, by_call, by_conf
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named if key == common.CHECKPOINT_CONF else default


def test_shared_folder():
    assert common.shared_folder(Context("yarn", by_call="/shared/call", by_conf="/shared/conf")) == "/shared/call"
    assert common.shared_folder(Context("yarn", by_conf="/shared/conf")) == "/shared/conf"
    assert os.path.isdir(common.shared_folder(Context("local[4]")))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=common.CHECKPOINT_CONF):
            common.shared_folder(Context(master))


def test_scratch_tables_are_deleted(spark):
    with common.scratch() as kept:
        df = kept(spark.range(10), "ten")
        files = df.inputFiles()
        assert df.count() == 10 and files
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def words_of(texts):
    coded = [t.encode() for t in texts]
    size = np.array(list(map(len, coded)), np.int64)
    return textarrays.Words(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size) - size, size), coded


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_words(monkeypatch, piece):
    monkeypatch.setattr(textarrays, "PIECE", piece)
    rng = np.random.default_rng(1)
    texts = ["", " ", "One two", "", "two\nOne.\v\x0btwo", "é a b", "x" * 5000, *("".join(rng.choice(list("aAb.\n \té"), 40)) for _ in range(200)), ""]
    w, coded = words_of(texts)
    want = [(d, x) for d, t in enumerate(coded) for x in t.split()]
    got = [(d, w.data[a:z].tobytes()) for d, a, z in zip(w.doc.tolist(), w.at, w.to)]
    assert got == want and w.counts().tolist() == [len(t.split()) for t in coded]
    known = {}
    for h, (_, x) in zip(w.hash.tolist(), want):
        assert known.setdefault(x.lower(), h) == h
    assert len(set(known.values())) == len(known)
    line, sentence = w.ends()
    at = 0
    for t in coded:
        for k, x in enumerate(parts := t.split()):
            gap = t[len(t) if k + 1 == len(parts) else w.to[at] - w.starts[w.doc[at]] :]
            gap = gap[: len(gap) - len(gap.lstrip())]
            assert line[at] == (k + 1 == len(parts) or b"\n" in gap)
            assert sentence[at] == (line[at] or x[-1:] in (b".", b"!", b"?"))
            at += 1


def test_text_shingles():
    texts = ["a b c d e f", "A b  c\nd e", "x a b c d e", "a b", "A B", "b a", "", "a b c d e f " * 3]
    h = [x.tolist() for x in textarrays.text_shingles((t.encode() for t in texts), 5)]
    assert list(map(len, h)) == [2, 1, 2, 1, 1, 1, 0, 14]
    assert h[0][0] == h[1][0] == h[2][1] == h[7][0] and h[3] == h[4] != h[5] and h[7][:6] == h[7][6:12]


@pytest.mark.parametrize("few", [2, 24])
def test_similar_rows(monkeypatch, few):
    monkeypatch.setattr(runs, "FEW", few)
    monkeypatch.setattr(runs, "ELEMENTS", 50)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 12, np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 12))) for _ in range(300)]
    cut = [0, 2, 5, 6, 30, 150, 300]
    at = np.array([x for x in zip(cut, cut[1:]) if x[1] - x[0] > 1])
    a, b = runs.similar_rows(sets, at, (4, 5))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        root[:] = range(len(sets))
        for x, y in pairs:
            p, q = sorted((find(x), find(y)))
            root[q] = p
        return [find(x) for x in range(len(sets))]

    near = lambda x, y: 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y]))
    want = [(x, y) for lo, hi in at.tolist() for x, y in itertools.combinations(range(lo, hi), 2) if near(x, y)]
    # a large run's links are to the first row of a group
    assert joined(zip(a.tolist(), b.tolist())) == joined(want) and want


def test_meetings_bring_every_pair_together(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.integers(0, 12, 150), rng.integers(0, 60, 150))} | {(99, n) for n in range(60)} | {(100, n) for n in range(60)})
    met = runs.meetings(spark.createDataFrame(rows, "key long, node long").withColumn("more", F.col("node") * 2), "key", "node", "more", block=9).collect()
    assert all(r["more"] == 2 * r["node"] for r in met)
    of = {}
    for r in met:
        of.setdefault(r["run"], set()).add(r["node"])
    together = {p for s in of.values() for p in itertools.combinations(sorted(s), 2)}
    by_key = {}
    for k, n in rows:
        by_key.setdefault(k, set()).add(n)
    assert {p for s in by_key.values() for p in itertools.combinations(sorted(s), 2)} <= together
    # the two keys with the same nodes are one meeting, in blocks
    assert max(map(len, of.values())) < 60 and len([1 for s in of.values() for _ in s]) == len(met)


def test_hot_node(spark):
    star = [(0, n) for n in range(1, 3000)] + [(n, n + 1) for n in range(5000, 5040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(1, 3000)} | {n: 5000 for n in range(5001, 5041)}


def test_very_long_texts_have_fingerprints(spark):
    long = "Some words that go on. " * 200_000
    df = spark.createDataFrame([(1, long), (2, long + "end"), (3, "z" * 2_000_000), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert got[2]["component_id"] == 1 and got[4]["fingerprint"] == "0" * 16
    assert {r["node"]: r["root"] for r in simhash.similar_documents(df).collect()} == {2: 1}


def test_runs_that_span_batches():
    batches = [pa.RecordBatch.from_pydict({"run": pa.array(x, pa.int64())}) for x in ([1, 1, 2], [2], [], [2, 3, 4], [4])]
    got = [t.slice(a, z - a)["run"].to_pylist() for t, at in runs.whole_runs(iter(batches)) for a, z in at.tolist()]
    assert got == [[1, 1], [2, 2, 2], [4, 4]]
