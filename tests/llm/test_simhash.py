import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.llm import golay, simhash
from streamloom.llm.components import components
from streamloom.llm.runs import colliding, forest, linked

WS = " \t\n\x0b\x0c\r"


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in WS:
            words, now = words + [now] * bool(now), ""
        else:
            now += c
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, prints, bits=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                x, y = sorted((find(a), find(ids[j])))
                parent[y] = x
    return [find(i) for i in ids]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ é\t\n\x0b  x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = "one Two  three\nfour five six seven Eight nine ten"
    whole = simhash.fingerprint(text.encode())
    for piece in (1, 3, 7, 11):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 4000, np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    of = []
    for f in (a, b):
        row, key = golay.keys(f)
        assert len(set(zip(row.tolist(), key.tolist()))) == len(row)
        got = [set() for _ in f]
        for r, k in zip(row.tolist(), key.tolist()):
            got[r].add(k)
        of.append(got)
    assert all(x & y for x, y in zip(*of))
    assert np.mean([len(x) for x in of[0]]) > 16  # several keys each


def test_golay_decodes_three_errors():
    rng = np.random.default_rng(2)
    index = rng.integers(0, 1 << 12, 500)
    words = np.array([i << 11 | golay._remainder(i << 11) for i in index.tolist()])
    for i in range(len(words)):
        for bit in rng.choice(23, 3, replace=False):
            words[i] ^= 1 << bit
    assert (golay.indices(words)[:, 0] == index).all()


def test_forest_is_whole():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 900, 300))
    root = forest(len(x), lambda i, rest: np.abs(x[rest] - x[i]) <= 2)
    want, at = [0], 0
    for i in range(1, len(x)):
        at = at if x[i] - x[i - 1] <= 2 else i
        want.append(at)
    assert root.tolist() == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_bucket_links_everything(spark):
    rows = spark.range(50).selectExpr("1L key", "id node", "id fp")

    def chain(t):
        x = t["node"].to_numpy()
        root = forest(len(x), lambda i, rest: np.abs(x[rest] - x[i]) == 1)
        moved = np.flatnonzero(root != np.arange(len(x)))
        return x[moved], x[root[moved]]

    links = linked(colliding(rows, "key", "fp", block=7), chain)
    assert {r["root"] for r in components(links).collect()} == {0}
    assert components(links).count() == 49


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(6):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, 120)] = "changed"
            texts.append(" ".join(t))
    texts += ["", None, " \n", "a", "A", "one two", "one two"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()
    prints = [slow_print(t) for t in texts]
    want = slow_components(list(range(len(texts))), prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [
        (i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want))
    ]
    assert len(set(want)) < 120


def test_near_duplicates_odd_rows(spark):
    schema = "doc_id long, text string, _loom_r int, key string, source string"
    rows = [(5, "a b c d", 1, "k", None), (5, "a b c d", 1, "k", None), (3, "a b c d", 2, None, "s"), (None, "a b c d", 3, "k", "s"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (None, None), (None, None)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["3", "None", "None"]
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def jaccard(a, b):
    of = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)} or {tuple(t.lower().split())}
    return len(of(a) & of(b)) / len(of(a) | of(b))


def test_samples_meet():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(200):
        h = rng.integers(0, 2**63, 900, np.uint64)
        a, b = np.unique(h[:800]), np.unique(np.concatenate([h[:711], h[800:889]]))
        met += bool((simhash.samples(a) == simhash.samples(b)).any())
    assert met >= 198


def test_similar_documents_against_all_pairs(spark):
    rng = np.random.default_rng(14)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        for _ in range(4):
            t = list(base)
            for at in rng.integers(0, len(t), int(rng.integers(0, 1 + len(t) // 40))):
                t[at] = "changed"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    clear = {(i, j) for i, a in rows for j, b in rows[:i] if jaccard(a, b) >= 0.8}
    found = {r["node"]: r["root"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(clear) > 60
    missed = [p for p in clear if found.get(p[0], p[0]) != found.get(p[1], p[1])]
    assert len(missed) <= 0.01 * len(clear)
    # nothing links but what is similar: each group is connected by pairs above 0.8
    for node, root in found.items():
        group = [i for i in range(len(texts)) if found.get(i, i) == root and i != node]
        assert any(jaccard(texts[node], texts[i]) >= 0.8 for i in group)


def test_sketch_of_long_sets():
    rng = np.random.default_rng(15)
    h = np.unique(rng.integers(0, 2**63, 6000, np.uint64))
    a, b, c = np.sort(h[:5500]), np.sort(np.concatenate([h[:5200], h[5500:5700]])), np.sort(h[2000:])
    cut = simhash.sketch
    assert simhash.similarity_at_least(cut(a), cut(b)) and not simhash.similarity_at_least(cut(a), cut(c))


def test_long_texts_are_judged_exactly(spark):
    rng = np.random.default_rng(16)
    texts = []
    for changes in [88, 90] * 8:  # Jaccard 0.8018 and 0.7978
        w = [f"w{x}" for x in rng.permutation(1 << 20)[:4000]]
        texts.append(" ".join(w))
        for k in range(changes):
            w[20 + 40 * k] = f"changed{k}"
        texts.append(" ".join(w))
    assert all((jaccard(texts[i], texts[i + 1]) >= 0.8) == (i % 4 == 0) for i in range(0, len(texts), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["node"]: r["root"] for r in simhash.similar_documents(docs).collect()}
    assert found == {i + 1: i for i in range(0, len(texts), 4)}


def test_texts_that_share_an_id(spark):
    rng = np.random.default_rng(17)
    text = lambda: [f"w{x}" for x in rng.permutation(1 << 20)[:300]]
    rows, want = [], {}
    for i in range(0, 40, 4):
        a, b = text(), text()
        near = [[*t[:150], "changed", *t[151:]] for t in (a, b)]
        # both texts of id i + 1 have a near copy of a smaller or larger id
        rows += [(i + 1, " ".join(a)), (i + 1, " ".join(b)), (i, " ".join(near[0])), (i + 2, " ".join(near[1]))]
        want |= {i + 1: i, i + 2: i}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        assert {r["node"]: r["root"] for r in simhash.similar_documents(docs.repartition(parts)).collect()} == want
