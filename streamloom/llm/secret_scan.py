"""Secret scan: candidates by pattern, false positives out by a random forest.

A candidate is a run of token characters that is long and mixed, has a known
form, or is assigned to a name like ``token``.  The forest judges it by its
length, the character transitions in it, how much of it a dictionary covers,
its document's path (here: source) and the words around it.  The dictionary
and the transitions that are usual are counted in all documents.  The forest
is trained on the driver from labelled findings that ``labelled_findings``
makes by seed, as many as ``FINDINGS``, with words of the dictionary.
"""

from __future__ import annotations

import base64
import math
import re
import string
from bisect import bisect_right
from collections.abc import Collection, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Labelled findings the forest is trained from.
FINDINGS = 3000
TREES, DEPTH, LEAF = 25, 9, 4
SEED = 42
THRESHOLD = 0.5
CONTEXT = 60
#: Words of the dictionary: those that most documents have.
DICTIONARY = 20_000

_NAMED = re.compile(
    r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)"
    r"[\"']?[ \t]*(?:[:=]|=>)[ \t]*[\"']?(?P<v>[A-Za-z0-9_+/=.~!@#$%^&*-]{8,})"
)
_KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"
_PREFIX = re.compile(rf"(?:{_KNOWN})")
_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{_KNOWN})(?![A-Za-z0-9])")
#: One of these stands in whatever ``_KEY`` matches.
_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "eyJ")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=~-])[A-Za-z0-9_+/=~-]{16,}")
_DIGIT = re.compile("[0-9]")
_KEYWORD = re.compile(r"(?i)token|secret|passw|pwd|api[_ -]?key|access[_ -]?key|private|auth|credential|bearer|key")
_INNOCENT = re.compile(r"(?i)example|sample|dummy|placeholder|your|xxx|changeme|test|fake|sha-?[0-9]|md5|commit|checksum|digest|hash|uuid|revision|etag|integrity")
_TESTPATH = re.compile(r"(?i)test|example|doc|fixture|sample|mock|spec")
_WORDS = set(
    "the of and to in is for on with that this from are was not have you all can had her one our out day get has him his how man new now old "
    "see two way who its did yes said each which their time will about many then them write would like these long make thing look more come number "
    "sound most people over know water than call first down side been find work part take place made live where after back little only round year "
    "came show every good give under name very through just form great think help low line before turn cause same mean differ move right boy "
    "example sample test value string file path user index config default content version image button header footer module package function".split()
)


class Language:
    """A dictionary, and how usual each letter is after each other in it."""

    def __init__(self, counts: dict[str, int]):
        self.words = _WORDS | counts.keys()
        self.vocabulary = sorted(self.words)
        n = np.ones((26, 26))
        for w in self.vocabulary:
            for a, b in zip(w, w[1:]):
                n[ord(a) - 97, ord(b) - 97] += counts.get(w, 1)
        self.usual = np.log2(n / n.sum(1, keepdims=True)).tolist()

    def share(self, text: str) -> float:
        """Share of the letters that words of the dictionary make up."""
        runs = re.findall("[A-Za-z][a-z]*|[A-Z]+", text)
        n = sum(map(len, runs))
        return sum(len(w) for w in runs if w.lower() in self.words) / n if n else 0.0

    def transitions(self, text: str) -> float:
        """The mean log probability of letters after letters."""
        low = text.lower()
        pairs = [self.usual[ord(a) - 97][ord(b) - 97] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
        return sum(pairs) / len(pairs) if pairs else math.log2(1 / 26)


@cache
def plain() -> Language:
    """The words that need no corpus."""
    return Language({})


def language(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> Language:
    """The ``size`` words of three letters or more that most documents have, of those with the same count the first.

    The driver gets a histogram of the counts, then the words from a step of
    it on, so not a number of words for each partition.
    """
    found = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+"))
    words = docs.select(F.explode(found).alias("w")).filter(F.length("w").between(3, 30))
    with scratch() as kept:
        counts = kept(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.floor(32 * F.log2("n")).cast("int")), "words")
        left, least = size, 0
        for step, n in sorted(map(tuple, counts.groupBy("step").count().collect()), reverse=True):
            least, left = step, left - n
            if left <= 0:
                break
        some = counts.filter(F.col("step") >= least)
        return Language({r["w"]: r["n"] for r in some.orderBy(F.desc("n"), "w").limit(size).collect()})


def features(value: str, before: str, after: str, path: str, named: bool, of: Language) -> list[float]:
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    n = len(value)
    share = [kind.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kind, kind[1:])) / max(n - 1, 1)
    between = sum(a == 2 and b < 2 or a < 2 and b == 2 for a, b in zip(kind, kind[1:])) / max(n - 1, 1)
    repeats = sum(a == b for a, b in zip(value, value[1:])) / max(n - 1, 1)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / max(n - 1, 1)
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    near = f"{before} {after}"
    return [
        n, *share, changes, between, repeats, steps, entropy, entropy / math.log2(n + 1), len(counts) / n,
        of.share(value), of.transitions(value),
        float(all(c in string.hexdigits for c in value)),
        float(bool(re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", value))),
        float(bool(_PREFIX.fullmatch(value)) or value.startswith("-----BEGIN")),
        float(bool(_INNOCENT.search(value))),
        float(named), float(bool(_KEYWORD.search(before[-30:]))), float(bool(_INNOCENT.search(near))),
        float(before.rstrip()[-1:] in "=:\"'"), float(bool(_TESTPATH.search(path))),
    ]


def _outside(span: tuple[int, int], keys: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``span`` that no key of the sorted ``keys`` covers."""
    at, end = span
    out = []
    for a, z in keys[max(bisect_right(keys, (at, at)) - 1, 0) :]:
        if a >= end:
            break
        if a > at:
            out.append((at, a))
        at = max(at, z)
    return [*out, (at, end)] if at < end else out


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, named) of what may be secrets, by start; of overlapping ones the first and longest.

    A key of a known form goes before the run it stands in, whose other parts
    are runs of their own; within a named value it is that value's.
    """
    found = {}
    if "=" in text or ":" in text:
        for m in _NAMED.finditer(text):
            found[m.span("v")] = True
    keys = [m.span() for m in _KEY.finditer(text)] if any(s in text for s in _STARTS) else []
    named = sorted(found)
    for a, z in keys:
        at = bisect_right(named, (a, len(text))) - 1
        if at < 0 or named[at][1] < z:
            # a named value that ends or starts within the key is a part of it
            cut = [s for s in named if s[0] < z and s[1] > a]
            for s in cut:
                del found[s]
            named = [s for s in named if s not in cut]
            found[a, z] = bool(cut)
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            for a, z in _outside(m.span(), keys):
                v = text[a:z]
                if z - a >= 16 and _DIGIT.search(v) and re.search("[A-Za-z]", v):
                    found.setdefault((a, z), False)
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            found[m.span()] = True
    out: list[tuple[int, int, bool]] = []
    for (a, z), named in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if not out or a >= out[-1][1]:
            out.append((a, z, named))
        elif named and not out[-1][2]:
            # the same run, found with its name in front
            out[-1] = (out[-1][0], max(z, out[-1][1]), True)
    return out


def labelled_findings(
    of: Language, seed: int = SEED, n: int = FINDINGS, real_kinds: Collection[int] = range(11), false_kinds: Collection[int] = range(12)
) -> tuple[list[list[float]], list[int]]:
    """Findings with their labels, made by seed: keys in the forms they have, and what is taken for them."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    words = of.vocabulary
    word = lambda: words[int(rng.integers(len(words)))]
    b64 = lambda k: base64.b64encode(rng.bytes(k)).decode()
    size = lambda a, b: int(rng.integers(a, b + 1))
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    real = [
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, size(20, 30)),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum, size(20, 40)) + "." + pick(alnum, size(30, 60)) + "." + pick(alnum, 43),
        lambda: pick(hexa, int(rng.choice([32, 40, 64]))),
        lambda: b64(size(18, 48)),
        lambda: pick(alnum, size(16, 48)),
        lambda: pick(alnum + "!@#$%^&*", size(10, 24)),
        lambda: word().capitalize() + str(size(1950, 2030)) + pick("!@#$%&*", size(1, 2)) + pick(alnum, size(0, 3)),
    ]
    false = [
        lambda: f"your_{word()}_{word()}_here{size(0, 9)}",
        lambda: "".join(word().capitalize() for _ in range(size(3, 5))) + str(size(0, 99)),
        lambda: "_".join(word() for _ in range(size(3, 6))) + "_" + str(size(1, 30)),
        lambda: "/".join(word() for _ in range(size(3, 6))) + f"/v{size(1, 9)}/" + word(),
        lambda: "x" * size(8, 30) + str(size(0, 9)),
        lambda: "0123456789abcdef"[: size(10, 16)] * size(1, 2),
        lambda: "=" * size(10, 40) + word() + str(size(0, 9)),
        lambda: "changeme" + str(size(0, 9999)),
        lambda: f"{size(1990, 2030)}-{size(10, 12)}-{size(10, 28)}T{size(10, 23)}-{size(10, 59)}-{size(10, 59)}Z",
        lambda: word() + "-" + word() + "-" + "".join(str(size(0, 9)) for _ in range(size(4, 12))),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 9) + "EXAMPLE",
        lambda: str(rng.choice(["ghp_", "sk_live_", "xoxb-"])) + str(rng.choice(["x" * 36, "your_key_goes_here_" + word(), "example" + pick(alnum, 29), "0" * 36])),
    ]
    names = ["token", "secret", "password", "api_key", "access_key", "Authorization", "credential"]
    rows, labels = [], []
    for k in range(n):
        good = k % 2 == 0
        context = " ".join(word() for _ in range(size(0, 6)))
        path = str(rng.choice(["src1", "web", "crawl", "repo/app/main", "repo/config", "repo/tests/fixture", "docs/example"], p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05]))
        named = rng.random() < (0.75 if good else 0.25)
        if good:
            # bare random letters or hex digits are secrets only where a name says so
            kind = int(rng.choice(list(real_kinds)))
            value, named = real[kind](), named or kind >= 6
        elif rng.random() < 0.35:
            # real-looking values that a digest's name explains
            value, named = str(rng.choice([pick(hexa, int(rng.choice([32, 40, 64]))), uuid(), b64(32)])), False
            context += " " + str(rng.choice(["commit", "sha256", "md5 checksum", "uuid", "etag", "integrity", "revision", ""]))
        else:
            value = false[int(rng.choice(list(false_kinds)))]()
        before = context + (f' {rng.choice(names)} {rng.choice(["=", ":"])} "' if named else " ")
        rows.append(features(value, before, '" ' + word(), path, named, of))
        labels.append(int(good))
    return rows, labels


class Forest:
    """Binary trees as arrays; a row goes left where its feature is at most the cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED, trees: int = TREES):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows].astype(float), rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (value, float(y[rows].mean()))):
                a.append(v)
            if depth == DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
                return at
            best = self._split(x[rows], y[rows], rng)
            if best is not None:
                feature[at], cut[at] = best
                low = x[rows, best[0]] <= best[1]
                left[at], right[at] = node(rows[low], depth + 1), node(rows[~low], depth + 1)
            return at

        node(np.arange(len(x)), 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, value))

    def _split(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
        """The cut with the least Gini impurity among a random third of the features."""
        best, least = None, 2.0
        for f in rng.choice(x.shape[1], max(x.shape[1] // 3, 1), replace=False).tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v) + 1)
            ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= LEAF) & (n[::-1][1:] >= LEAF))
            if not len(ok):
                continue
            a, b = n[ok], len(v) - n[ok]
            p, q = ones[ok] / a, (ones[-1] - ones[ok]) / b
            gini = (a * p * (1 - p) + b * q * (1 - q)) / len(v)
            k = int(gini.argmin())
            if gini[k] < least:
                least, best = float(gini[k]), (f, float((v[ok[k]] + v[ok[k] + 1]) / 2))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(low, left[at], right[at]))
            out += value[at]
        return out / len(self.trees)


def forest(of: Language, seed: int = SEED, **kinds) -> Forest:
    x, y = labelled_findings(of, seed, **kinds)
    return Forest(np.array(x), np.array(y), seed)


def held_out_accuracy(of: Language, seed: int = SEED) -> dict[str, list[float]]:
    """Of each kind of finding the share judged right by a forest that hasn't seen this kind."""
    out: dict[str, list[float]] = {"real": [], "false": []}
    for name, kinds, label in (("real_kinds", range(11), 1), ("false_kinds", range(12), 0)):
        for k in kinds:
            own = forest(of, seed, **{name: [x for x in kinds if x != k]})
            x, y = labelled_findings(of, seed + 1, 600, **{name: [k]})
            judged = own.predict(np.array(x)[np.array(y) == label]) >= THRESHOLD
            out["real" if label else "false"].append(float((judged == label).mean()))
    return out


_FOUND = "doc_id long, n_candidates long, found array<struct<start:int,stop:int,score:double>>"


class Scanner:
    """A dictionary with the forest trained for it."""

    def __init__(self, of: Language, threshold: float = THRESHOLD):
        self.of, self.forest, self.threshold = of, forest(of), threshold

    def scan(self, text: str, path: str) -> tuple[int, list[dict]]:
        """How many candidates ``text`` has, and those that are secrets."""
        spots = candidates(text)
        if not spots:
            return 0, []
        x = np.array([features(text[a:z], text[max(0, a - CONTEXT) : a], text[z : z + CONTEXT // 2], path, named, self.of) for a, z, named in spots])
        score = np.round(self.forest.predict(x), 6)
        return len(spots), [{"start": a, "stop": z, "score": s} for (a, z, _), s in zip(spots, score.tolist()) if s >= self.threshold]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates and ``found``: start, stop (code points, end exclusive) and score of each secret.

    A row for each row of ``docs``, repeated ones too; a null text has none
    and a null path is empty.  Candidates that overlap count once (see
    :func:`candidates`).  Texts are scanned whole, however long.  Other
    columns are not read.  What is broadcast is the forest and ``DICTIONARY``
    words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(language(docs, text_col), threshold))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [shared.value.scan(t.as_py(), p.as_py()) for t, p in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([f for _, f in got], kind)], ["doc_id", "n_candidates", "found"])

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    return base.mapInArrow(each, _FOUND)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets and ``spans``: start:stop:score of each secret, comma-joined."""
    item = lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"), F.format_number(s["score"], 3))
    return secrets(docs, id_col, text_col, path_col).select("doc_id", "n_candidates", F.size("found").cast("bigint").alias("n_secrets"), F.array_join(F.transform("found", item), ",").alias("spans"))
