import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from streamloom.llm import common, exact_dedup, mixing, pii, quality
from streamloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WS = "[\x20\x09-\x0d]"


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df, columns) == sorted(want.fetchall(), key=repr)


def test_prefix_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 700)]
    df = spark.createDataFrame([(x,) for x in lists], "a array<int>").select("a", common.prefix_sums(F.col("a")).alias("s"))
    for r in df.collect():
        assert list(r["s"]) == [sum(r["a"][:k]) for k in range(len(r["a"]))]


ODD = [
    (1, "a b\tc", "x"), (1, "a b\tc", "x"), (2, "ab c", "y"), (3, "a  b \n c", "y"), (4, None, None), (5, "", None), (None, " ", "z"),
    (None, "abc", "z"), (6, "word " * 30000, "z"), (7, "Ünïcode 日本", "z"), (8, "Ünïcode日本", "z"),
]
ODD_SCHEMA = "doc_id long, text string, source string, kept string, size int, n_words string, _loom_x int"


def odd(spark):
    return spark.createDataFrame([(*r, "k", 1, "n", None) for r in ODD], ODD_SCHEMA)


def test_exact_duplicates(spark):
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[re.sub(WS, "", t or "")].append((-len(t or ""), 2**63 if i is None else i))
    want = []
    for i, t, _ in ODD:
        n = re.sub(WS, "", t or "")
        best = min(groups[n])
        me = (-len(t or ""), 2**63 if i is None else i)
        want.append((i, None if best[1] == 2**63 else best[1], len(groups[n]), me == best, hashlib.sha256(n.encode()).hexdigest()))
    got = rows_of(exact_dedup.exact_duplicates(odd(spark)), ("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(odd(spark).limit(0)).count() == 0


def test_drop_exact_duplicates(spark):
    df = odd(spark)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    left = Counter(re.sub(WS, "", r["text"] or "") for r in out.collect())
    assert set(left.values()) == {1} and set(left) == {re.sub(WS, "", t or "") for _, t, _ in ODD}
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def slow_quality(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(2)
    texts = [t for _, t, _ in ODD]
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(rng.randrange(0, 60))]
        texts.append(rng.choice([" ", "\n"]).join(w) + rng.choice(["", "#$%", "\n\n"]))
    base = [f"w{k}" for k in range(100)]
    return texts + [" ".join(base), " ".join(base + base[:9]), " ".join(base + base), "x" * 5000 + " y" * 30]


def test_quality_metrics(spark):
    texts = quality_texts()
    df = spark.createDataFrame([(k, t, 1, "m") for k, t in enumerate(texts)], "doc_id long, text string, kept int, n_lines string")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for k, t in enumerate(texts):
        m = slow_quality(t)
        want.append((k, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    report = quality.quality_report(df)
    assert rows_of(report, cols) == sorted(want, key=repr)
    kept = {r["doc_id"] for r in report.filter("kept").collect()}
    stage = quality.drop_low_quality(df)
    assert stage.columns == df.columns
    assert {r["doc_id"] for r in stage.collect()} == kept and kept
    assert quality.quality_report(df.limit(0)).count() == 0 and quality.drop_low_quality(df.limit(0)).count() == 0


def test_rule_order_changes_no_verdict(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(quality_texts())], "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    results = set()
    for order in (quality.RULES, quality.RULES[::-1]):
        results.add(tuple(sorted(r[0] for r in df.filter(~quality.rejects(list(order), text)).select("doc_id").collect())))
    assert len(results) == 1
    assert {r.name for r in quality.ordered_rules(df)} == {r.name for r in quality.RULES}


def slow_pii(t):
    spans = []
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    for o, (kind, pattern, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )):
        for m in re.finditer(pattern, t or ""):
            if ok(m.group()):
                spans.append((m.start(), o, kind, m.end()))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(spans))


PII = [
    "", None, "a@b", "x a.b@c.d-e.f, y", "a@b@c.com", "a@b.com_c@d.org", "é a@b.co 1.2.3.4 256.1.1.1 001.02.3.0255", "1.2.3.4.5.6.7.8", "1.2.3.",
    "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "x4111111111111111x", "+1 (555) 555-0100", "+1 555", "+49 30 1234567-89 +2 ((", "12345678901234567890",
    "a" * 50000 + "@", "1" * 50000, "@" * 1000, "+" * 500, "1.1.1.1" * 300, "x@y.zz " * 700, "日本 a@b.cd", "0000000000000000", "5 5 5 5 5 5 5 5 5 5 5 5 5 5",
    "IBAN GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB00WEST12345698765432", "ssn 123-45-6789", "123-45-6789",
]


def test_pii(spark):
    rng = random.Random(5)
    texts = PII + ["".join(rng.choice("0123456789.@a+- ()") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r["doc_id"]: r for r in pii.pii_report(df).collect()}
    for k, t in enumerate(texts):
        want = slow_pii(t)
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[k])
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
        assert got[k]["n_email"] == want.count("email:")
    at = PII.index("IBAN GB82 WEST 1234 5698 7654 32")
    assert got[at]["spans"] == "iban:5:32" and got[at + 1]["spans"].startswith("iban:0:22") and got[at + 2]["spans"] == ""
    assert got[at + 3]["spans"] == "ssn:4:15" and got[at + 4]["spans"] == ""
    assert pii.pii_report(df.limit(0)).count() == 0


def brute_sum(lengths, counts, budget):
    reach = {0}
    for a, n in zip(lengths, counts):
        for _ in range(n):
            reach |= {x + a for x in reach if x + a <= budget}
    return max(reach)


def test_fit_comes_as_near_as_sums_do():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(0, 40), rng.randrange(1, 7))
        counts = [rng.randrange(0, 5) for _ in lengths]
        budget = rng.randrange(0, 120)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        assert sum(a * k for a, k in zip(lengths, take)) == brute_sum(lengths, counts, budget)


def test_plan_comes_as_near_as_sums_do(monkeypatch):
    rng = random.Random(6)
    for table in (mixing.TABLE, 1):
        monkeypatch.setattr(mixing, "TABLE", table)
        for _ in range(200):
            lengths = rng.sample(range(0, 12), rng.randrange(1, 7))
            counts = [rng.randrange(0, 9) for _ in lengths]
            size = sum(a * n for a, n in zip(lengths, counts))
            target = rng.randrange(0, 2 * size + 1)
            passes, take = mixing.plan_source(lengths, counts, target)
            assert all(0 <= k <= n for k, n in zip(take, counts))
            words = passes * size + sum(a * k for a, k in zip(lengths, take))
            best = 0 if not size else target // size * size + brute_sum(lengths, counts, target % size)
            assert words == best or table == 1 and best - max(lengths) <= words <= best
    monkeypatch.setattr(mixing, "TABLE", 1 << 20)
    assert mixing.plan_source([9, 7], [2, 3], 21) == (0, [0, 3])
    assert mixing.plan_source([90_000, 70_000], [2, 3], 210_000) == (0, [0, 3])


def test_plan_of_a_large_source():
    lengths = list(range(1, 4000, 7))
    counts = [1 + 60_000 // a for a in lengths]
    size = sum(a * n for a, n in zip(lengths, counts))
    target = size * 13 // 19
    passes, take = mixing.plan_source(lengths, counts, target)
    assert passes == 0 and all(0 <= k <= n for k, n in zip(take, counts))
    assert sum(a * k for a, k in zip(lengths, take)) == target


def test_targets():
    got = mixing.targets([("b", 100), (None, 50), ("a", 10), ("c", 100)])
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 260) < 1e-9
    assert all(got[s] <= 2 * n for s, n in (("b", 100), (None, 50), ("a", 10), ("c", 100)))
    assert abs(got["c"] / 2 - got["b"] / 1) < 1e-9 or got["c"] == 200
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_plan_with_long_documents():
    passes, take = mixing.plan_source([10, 200_000, 5_000_000], [3, 20, 2], 9_500_017.0)
    words = sum(a * k for a, k in zip([10, 200_000, 5_000_000], take)) + passes * 14_000_030
    assert words == 9_000_030  # the next sum is 10 million


def test_mix(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.randrange(1, 400)), rng.choice(["a", "b", "é", None, ""])) for k in range(400)] + [(1, "x y", "a"), (None, None, "a"), (None, "x", None)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    one = rows_of(mixing.mix(df), ("doc_id", "source", "size", "source_size", "target", "times", "taken"))
    assert one == rows_of(mixing.mix(df.repartition(7)), ("doc_id", "source", "size", "source_size", "target", "times", "taken"))
    assert len(one) == len(rows) and all(r[6] <= 2 * r[2] for r in one)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    aims = mixing.targets(list(sizes.items()))
    for s, aim in aims.items():
        assert abs(sum(r[6] for r in one if r[1] == s) - aim) <= 1
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == Counter({k: v for k, v in sum((Counter({(r[0], r[1]): r[5]}) for r in one), Counter()).items() if v})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_mix_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    df = spark.range(1000).selectExpr("id doc_id", "'a b c' text", "if(id < 500, 'x', 'y') source")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 3 for r in got)
