import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from streamloom.llm import mixing, quality, sentencepiece_codec

WS = "[\x20\x09-\x0d]"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed=3):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []

    def add(text):
        rows.append((len(rows), text, "en", rng.choice(["src0", "src0", "src1", "src2", None]), len(text or "")))

    for _ in range(60):
        base = sentence(rng.randrange(30, 160))
        add(base)
        if rng.random() < 0.3:
            add(base.replace(" ", rng.choice(["  ", "\n"])))
        if rng.random() < 0.3:
            w = base.split()
            w[rng.randrange(len(w))] = "edited"
            add(" ".join(w))
    add("short text")
    add(None)
    add("")
    add("spam " * 200)
    add(" ".join(f"w{k}%%%" for k in range(50)))
    return rows


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def slow(rows):
    """The rows that the first three stages leave, by brute force."""
    good = []
    for r in rows:
        w = (r[1] or "").split()
        symbols = sum(c in quality.SYMBOLS for c in r[1] or "")
        if len(w) >= 20 and 2 * symbols <= len(w) and len(set(w)) > 5:
            good.append(r)
    best = {}
    for r in good:
        k = re.sub(WS, "", r[1])
        if k not in best or (-len(r[1]), r[0]) < (-len(best[k][1]), best[k][0]):
            best[k] = r
    left = sorted(best.values())
    parent = {r[0]: r[0] for r in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {r[0]: shingles(r[1]) for r in left}
    for a in left:
        for b in left:
            if b[0] < a[0] and 5 * len(sets[a[0]] & sets[b[0]]) >= 4 * len(sets[a[0]] | sets[b[0]]):
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    return {r[0] for r in good}, {r[0] for r in left}, {r[0] for r in left if find(r[0]) == r[0]}


def test_stages(spark, tmp_path):
    rows = make()
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = slow(rows)
    assert len(want[0]) > len(want[1]) > len(want[2])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, path)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        assert {r["doc_id"] for r in docs.collect()} == want[k], name
    kept = docs.collect()
    sizes = Counter()
    for r in kept:
        sizes[r["source"]] += len(r["text"].split())
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += len(r["text"].split())
    for s, aim in mixing.targets(list(sizes.items())).items():
        assert abs(got[s] - aim) <= 60
    texts = {r["doc_id"]: r["text"] for r in kept}
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in mixed.collect())
    for r in out:
        assert list(r["ids"]) == sentencepiece_codec.codec().encode(texts[r["doc_id"]])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tmp_path):
    rows = [(*r, "x", 1, None) for r in make(5)[:40]]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string, size int, node string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after
    assert docs.count() > 0


@pytest.mark.parametrize("rows", [[(None, None, None, None, None)] * 2, [(1, "a b", "en", "s", 3)] * 3])
def test_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).collect()
