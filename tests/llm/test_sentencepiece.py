import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from streamloom.llm import sentencepiece_codec as m


@pytest.fixture(scope="module")
def library():
    proto = pb.ModelProto.FromString(open(m.MODEL, "rb").read())
    proto.trainer_spec.model_type = m.UNIGRAM
    for p, s in zip(proto.pieces, m.codec().scores):
        p.score = float(s)
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


TEXTS = ["", " ", "a", "  a  b ", "\n\ta b", "日本語 ゼ☃ 🙂", "a▁b", "x" * 300, "The licence of the work.", "Éê ñandú größer", "日 " * 40]


def score(c, ids):
    return sum(float(c.scores[i]) for i in ids if not c.is_byte[i])


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(library, text):
    assert m.codec().encode(text) == library.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_round_trip(text):
    assert m.codec().decode(m.codec().encode(text)) == text.replace(m.SPACE, " ")


def test_best_path(library):
    rng = np.random.default_rng(5)
    c = m.codec()
    texts = ["".join(rng.choice(list("abeinrst  ,$%é"), 80)) for _ in range(200)]
    for t, ids in zip(texts, c.encode_batch(texts)):
        want = library.encode(t)
        assert len(want) == len(ids) and abs(score(c, want) - score(c, ids)) < 0.05


def test_double_array():
    words = [b"a", b"ab", b"abc", b"b", b"bd", b"\xc3\xa9"]
    trie = m.DoubleArray(words, list(range(len(words))))
    data = np.frombuffer(b"abcbd\xc3\xa9", np.uint8).astype(np.int32)
    got = sorted(zip(*(x.tolist() for x in trie.matches(data, np.arange(len(data))))))
    assert got == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 3), (3, 1, 3), (3, 2, 4), (5, 2, 5)]


def test_forgetting_changes_nothing(monkeypatch):
    c = m.codec()
    want = c.encode_batch(TEXTS)
    monkeypatch.setattr(m, "REMEMBERED", 5)
    for t, w in zip(TEXTS, want):
        assert c.encode(t) == w.tolist()


def test_rows(spark):
    schema = "doc_id long, text string, ids int, n_tokens string"
    rows = [(1, "one two", 1, "x"), (1, "one two", 1, "x"), (None, None, None, None), (2, "", 0, ""), (3, "word " * 30000, 0, "")]
    docs = spark.createDataFrame(rows, schema)
    coded = m.encode(docs)
    got = {r["doc_id"]: list(r["ids"]) for r in coded.collect()}
    assert got == {i: m.codec().encode(t or "") for i, t, *_ in rows}
    assert sorted((str(r["doc_id"]), r["text"]) for r in m.decode(coded).collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    report = m.encode_report(docs).collect()
    assert len(report) == 5 and all(r["round_trip"] for r in report)
    assert m.encode(docs.limit(0)).count() == 0 and m.encode_report(docs.limit(0)).count() == 0
