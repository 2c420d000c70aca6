import hashlib

import numpy as np
import pytest

from streamloom.llm import chunks
from streamloom.llm import suffix_dedup as m


def slow(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = m.LAST if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (m.LAST if i is None else i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])])
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fast(df):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(((tuple(r[c] for c in cols)) for r in m.remove_repeats(df).collect()), key=str)


def corpus():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (9, 12, 30, 200)]
    out = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[rng.integers(0, 4)]
            a, z = sorted(rng.integers(0, len(p) + 1, 2))
            parts += [p if rng.random() < 0.5 else p[a:z], text(int(rng.integers(0, 20)))]
        out.append(" ".join(parts))
    out += [out[3], out[3] + "x", "x" + out[4][:-1], "a" * 400, "a" * 300 + "b", "ab" * 100, "", "a" * 49, "a" * 50, "a" * 50]
    return out


@pytest.mark.parametrize("chunk, bucket, hot, piece", [(1 << 21, 150_000, 1 << 16, 1 << 19), (1500, 40, 1 << 16, 100), (1500, 40, 3, 333)])
def test_against_all_substrings(spark, monkeypatch, chunk, bucket, hot, piece):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    monkeypatch.setattr(m, "BUCKET", bucket)
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(m, "PIECE", piece)
    texts = corpus()
    rng = np.random.default_rng(8)
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow(rows)
    assert fast(df) == want
    assert sum(r[2] for r in want) > 1000


def test_line_in_every_chunk(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 200)
    monkeypatch.setattr(m, "HOT", 20)
    line = "This one line of some sixty bytes stands in each of the documents."
    rows = [(i, f"{i * i * 7919:030d} {line} {i * 104729:025d}") for i in range(150)]
    assert fast(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_very_long_text(spark):
    rng = np.random.default_rng(10)
    long = rng.integers(97, 123, 6 << 20).astype(np.uint8).tobytes().decode()
    rows = [(1, long), (2, "x" + long[1 << 20 : 3 << 20] + "y"), (3, "z" * 3_000_000), (4, "z" * 60)]
    got = fast(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[1:4] for r in got] == [(6 << 20, 0, 0), ((2 << 20) + 2, 2 << 20, 1), (3_000_000, 0, 0), (60, 60, 1)]


def test_odd_rows(spark):
    long = "The same sixty bytes or so stand in each of these documents, whole."
    rows = [(5, long), (5, long), (3, None), (None, long), (4, "x" + long), (9, "")]
    schema = "doc_id long, text string, kept string, chunk int, blob int"
    df = spark.createDataFrame([(*r, "k", 1, None) for r in rows], schema)
    want = sorted(((None if r[0] == m.LAST else r[0], *r[1:]) for r in slow(rows)), key=str)
    assert fast(df) == want
    assert fast(df.limit(0)) == []
    kept = {r["doc_id"]: bytes(r["kept"]) for r in m.remove_repeats(df, texts=True).collect()}
    assert kept[4] == ("x" + long).encode() and kept[5] == b""


def test_smallest_ids():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 3, 90).astype(np.uint8)
    data = np.concatenate([np.roll(base, -k)[:80] if k % 2 else base for k in range(0, 30)])
    start = np.arange(len(data) - m.LENGTH + 1)
    ids = rng.integers(0, 1000, len(start))
    best = {}
    for s, i in zip(start, ids):
        w = data[s : s + m.LENGTH].tobytes()
        best[w] = min(best.get(w, 1000), i)
    assert m.smallest_ids(data, start, ids).tolist() == [best[data[s : s + m.LENGTH].tobytes()] for s in start]
