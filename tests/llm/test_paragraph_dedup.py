import hashlib
import re

import numpy as np
import pytest

from streamloom.llm import chunks
from streamloom.llm import paragraph_dedup as m


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def sentences(text):
    """[(sentence with the white space behind it, its words, whether a line ends)] of a text that has a word."""
    out, white = [], rb"[ \t\n\x0b\x0c\r]"
    for m_ in re.finditer(rb"([^ \t\n\x0b\x0c\r]+)(" + white + rb"*)", text):
        line = b"\n" in m_[2]
        if not out or out[-1][3]:
            out.append([b"", [], False, False])
        own = out[-1]
        own[0] += m_[0]
        own[1].append(m_[1].lower())
        own[2], own[3] = line, line or m_[1][-1:] in (b".", b"!", b"?")
    if out:
        lead = len(text) - sum(len(x[0]) for x in out)
        out[0][0] = text[:lead] + out[0][0]
        out[-1][2] = True
    return out


def units(parts):
    """(level, first, behind the last) of what is compared of a text's sentences."""
    size = [len(w) for _, w, *_ in parts]
    out, first = [], 0
    for k, (_, _, line, _) in enumerate(parts):
        if size[k] >= m.MIN_WORDS:
            out.append((m.SENTENCE, k, k + 1))
        else:
            a, z = k, k + 1
            while sum(size[a : k + 1]) < m.MIN_WORDS and a:
                a -= 1
            while sum(size[k:z]) < m.MIN_WORDS and z < len(size):
                z += 1
            left, right = sum(size[a : k + 1]) >= m.MIN_WORDS, sum(size[k:z]) >= m.MIN_WORDS
            out += [(m.WINDOW, a, k + 1)] * left + [(m.WINDOW, k, z)] * right + [(m.WINDOW, a, z)] * (not left and not right)
        if line:
            if k > first and sum(size[first : k + 1]) >= m.MIN_WORDS:
                out.append((m.LINE, first, k + 1))
            first = k + 1
    return sorted(set(out))


def slow(rows):
    """Every pair of units is compared."""
    own = lambda i: m.LAST if i is None else i
    nodes, texts = [], []
    for i, t in rows:
        parts = sentences((t or "").encode())
        texts.append(parts)
        for level, a, z in units(parts):
            w = sum((parts[k][1] for k in range(a, z)), [])
            nodes.append(((own(i), 4 * a + level), level == m.WINDOW, w, shingles(w)))
    nodes.sort(key=lambda u: u[0])
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, window, w, s) in enumerate(nodes):
        for y in range(x):
            _, other, v, t = nodes[y]
            if window == other and (w == v if window else 5 * len(s & t) >= 4 * len(s | t)):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    # rows that share an id share places, so a place may have several units
    root = {}
    for x, (at, window, w, _) in enumerate(nodes):
        root[at, window, tuple(w)] = nodes[find(x)][0]
    out = []
    for (i, t), parts in zip(rows, texts):
        b, gone, of = (t or "").encode(), set(), set()
        for level, a, z in units(parts):
            at = (own(i), 4 * a + level)
            r = root[at, level == m.WINDOW, tuple(sum((parts[k][1] for k in range(a, z)), []))]
            if r != at:
                of.add(r[0])
                gone |= {k for k in range(a, z) if level != m.WINDOW or len(parts[k][1]) < m.MIN_WORDS}
        kept = b"".join(x[0] for k, x in enumerate(parts) if k not in gone) if parts else b
        out.append((i, len(parts), len(gone), hashlib.sha256(kept).hexdigest(), sorted(of - {own(i)})))
    return sorted(out, key=str)


def fast(df):
    return sorted(((r["doc_id"], r["n_paragraphs"], r["n_removed"], r["kept_sha256"], list(r["repeats_of"])) for r in m.remove_paragraphs(df).collect()), key=str)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}é" for a in "klmnprst" for b in "aeiou"]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize()
    common = [sentence(int(rng.integers(6, 40))) for _ in range(15)]
    out = []
    for _ in range(90):
        parts = []
        for _ in range(rng.integers(1, 6)):
            s = sentence(int(rng.integers(3, 25)))
            if rng.random() < 0.4:
                s = common[rng.integers(0, 15)]
                w = s.split()
                if rng.random() < 0.4:
                    w[rng.integers(0, len(w))] = "other"
                s = " ".join(w)
            parts.append(s)
        out.append(rng.choice([". ", ".\n", "!\n\n"]).join(parts) + ".")
    return out


def test_tuned():
    bands, rows = m.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= m.RECALL


@pytest.mark.parametrize("chunk, bucket", [(1 << 21, 150_000), (700, 20)])
def test_against_all_pairs(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    monkeypatch.setattr(m, "BUCKET", bucket)
    texts = corpus()
    ids = np.random.default_rng(12).permutation(len(texts)).tolist()
    rows = list(zip(ids, texts))
    want = slow(rows)
    assert fast(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert sum(r[2] for r in want) > 40


def test_odd_rows(spark):
    s = "One sentence of more than eight words that stands in several texts."
    rows = [(5, s), (5, s), (3, None), (None, s), (4, "Else. " + s + " So it goes.\n" + s), (9, ""), (-2, "a " * 5000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kept string, place int")
    assert fast(df) == slow(rows)
    assert fast(df.limit(0)) == []
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in m.remove_paragraphs(df, texts=True).collect()}
    assert kept[4] == "Else. " + s + " So it goes.\n" and kept[5] == ""


def test_passage_within_a_line(spark):
    passage = "The quick brown fox jumps over the lazy dog every day. Nobody has asked it why it does so until now."
    rows = [(1, "First " + passage + " After one"), (2, "An other line of some words goes before, then " + passage + " Behind")]
    got = {r["doc_id"]: r for r in m.remove_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert got[1]["n_removed"] == 0 and list(got[2]["repeats_of"]) == [1]
    assert b"Nobody" not in bytes(got[2]["kept"])


def kept(spark, rows):
    return {r["doc_id"]: bytes(r["kept"]).decode() for r in m.remove_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}


def test_short_sentences(spark):
    passage = "He came. They saw him there. Nobody spoke at all. Then the old man who had waited since the morning stood up. He left. It rained."
    alone = "One two three. Four five six. Seven eight nine."
    rows = [(1, "Start here.\n" + passage + "\nBut yes."), (2, "Other words.\n" + passage + "\nAnd no."), (3, alone), (4, "Go on.\n" + alone + "\nBut yes."), (5, "Hi all."), (6, "Hi all.")]
    got = kept(spark, rows)
    assert got[1] == rows[0][1] and got[3] == alone and got[5] == "Hi all."
    assert got[2] == "Other words.\nAnd no." and got[4] == "Go on.\nBut yes." and got[6] == ""


def test_unique_short_sentence_stays(spark):
    a = "This sentence of more than eight words stands in both of them."
    b = "And so does this one, which has as many words as that."
    assert kept(spark, [(1, f"{a} {b}"), (2, f"{a} Dosage: 50 mg. {b}")])[2] == "Dosage: 50 mg. "


def test_packed_numbers(spark):
    rows = [(a, b) for a in (-(2**63), -7, -1, 0, 5, 2**63 - 1) for b in (0, 1, 2**31, 2**32 - 1)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", m._packed(("a", 32), ("b", 32)).alias("p"))
    got = df.select("a", "b", "p", *m._unpacked("p", 32)).orderBy("p").collect()
    assert [tuple(r)[:2] for r in got] == sorted(rows) and all(tuple(r)[:2] == tuple(r)[3:] for r in got)


def test_hot_bucket_is_split(spark, monkeypatch):
    from streamloom.llm import runs

    monkeypatch.setitem(runs.meetings.__kwdefaults__, "block", 8)
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(60)]
    got = kept(spark, list(enumerate(near)))
    assert got[0] == near[0] and [i for i, t in got.items() if t] == [0]


def test_very_long_text(spark):
    rng = np.random.default_rng(13)
    words = [f"w{k}" for k in range(5000)]
    long = ". ".join(" ".join(rng.choice(words, 12)) for _ in range(80_000)) + "."
    got = kept(spark, [(1, "Start.\n" + long), (2, long + "\nEnd."), (3, "y" * 3_000_000)])
    assert got[1] == "Start.\n" + long and got[2] == "End." and got[3] == "y" * 3_000_000


def test_lines_beside_sentences(spark):
    words = [f"w{k}" for k in range(120)]
    line = lambda w: ". ".join(" ".join(w[k : k + 12]) for k in range(0, 120, 12)) + "."
    near = [*words[:30], "changed", *words[31:]]
    far = [f"changed{k}" if k % 12 == 6 else w for k, w in enumerate(words)]
    got = kept(spark, [(1, line(words)), (2, "Before this line.\n" + line(near)), (3, line(far))])
    assert got == {1: line(words), 2: "Before this line.\n", 3: line(far)}
