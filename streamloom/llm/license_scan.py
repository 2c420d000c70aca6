"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line with the lines that continue it: a line without a mark
at its end goes on in the next one if that starts with a small letter or if
both are in capitals; comment marks before the continuation don't count.

Sparse logistic regression over word uni- and bigrams tells licence families
and ``unknown`` apart.  It is trained on the driver from the notices in
``license_texts`` and from licence names in the usual ways to name one, each in
a fixed number of variants, so the bound on its labelled rows is known.  In
``FOLDS`` folds whole notices, names and unknown texts are held out: the
temperature that calibrates its probabilities and the threshold, which lets at
most ``FALSE_RATE`` of the named ones be wrong, come from these.  Scoring is
native: a paragraph that has none of the grams with a positive weight can't
leave ``unknown``, and only the others are scored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_texts import NAMES, OTHER, OTHER_NAMES, PATTERNS, TEMPLATES, UNSEEN

#: Variants made of each notice, and of each licence name in each of the usual ways.
VARIANTS, NAMED = 12, 3
FOLDS = 3
SEED = 42
#: Share of the named texts that may be wrong, of those held out.
FALSE_RATE = 0.01
#: Share of a paragraph's grams that have to be in its family's templates.
CONFIRM = 0.5
_TRIM = "[^a-z0-9]+"
UNKNOWN = "unknown"
#: Breaks within a paragraph, with the mark before them; $1 stays.
_WRAPS = (
    r"([^.!?:; \t\n\x0B\x0C\r])[ \t\r]*\n[ \t]*(?:(?:[#*]|//)[ \t]*)?(?=[a-z(])",
    r"([A-Z,\"])[ \t\r]*\n[ \t]*(?:(?:[#*]|//)[ \t]*)?(?=[A-Z]{2,}[ ,.])",
)


def paragraphs(text: str) -> list[str]:
    """The paragraphs of ``text`` that hold a word; the scan has the same in expressions."""
    for wrap in _WRAPS:
        text = re.sub(wrap, r"\1 ", text)
    return [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]


def tokens(line: str) -> list[str]:
    return [w for w in re.split(_TRIM, line.lower()) if w]


def grams(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _variant(rng: np.random.Generator, w: list[str], filler: list[str]) -> list[str]:
    """A paragraph as it is found: some words gone, some around it, fewer around a short one."""
    most = min(3, 1 + len(w) // 4)
    w = [x for x in w if rng.random() > 0.06] or w
    extra = lambda: rng.choice(filler, rng.integers(0, most + 1)).tolist()
    return extra() + w + extra()


def notices(fold: int | None = None, held: bool = False) -> list[tuple[str, str, int]]:
    """(family, text, variants) of all notices, or of those that a fold holds out or doesn't."""
    out, texts = [], {f: list(t) for f, t in TEMPLATES.items()} | {UNKNOWN: OTHER + UNSEEN}
    names = NAMES | {UNKNOWN: OTHER_NAMES}
    for family in [*TEMPLATES, UNKNOWN]:
        own = [(t, VARIANTS, k) for k, t in enumerate(texts[family])]
        own += [(x.format(n), NAMED, i + j) for i, n in enumerate(names[family]) for j, x in enumerate(PATTERNS)]
        out += [(family, t, v) for t, v, k in own if fold is None or (k % FOLDS == fold) == held]
    return out


def labelled(seed: int, texts: list[tuple[str, str, int]]) -> tuple[list[list[str]], list[str]]:
    """Paragraphs as words with their families; the first variant of a text is the text."""
    rng = np.random.default_rng(seed)
    filler = [x for t in OTHER for x in tokens(t)]
    lines, names = [], []
    for family, t, variants in texts:
        for k in range(variants):
            lines.append(tokens(t) if k == 0 else _variant(rng, tokens(t), filler))
            names.append(family)
    pool = filler + [x for f, t, _ in texts if f != UNKNOWN for x in tokens(t)]
    for _ in range(30 * VARIANTS):  # words of notices in no order
        lines.append(rng.choice(pool, rng.integers(3, 20)).tolist())
        names.append(UNKNOWN)
    return lines, names


@dataclass(frozen=True)
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float
    templates: dict[str, list[str]]

    def scores(self, w: list[str]) -> np.ndarray:
        return np.array(self.bias) + sum((np.array(self.weights[g]) for g in set(grams(w)) if g in self.weights), np.zeros(len(self.bias)))

    def best(self, w: list[str]) -> tuple[str, float]:
        s = self.scores(w)
        p = np.exp(s - s.max())
        p /= p.sum()
        return self.families[int(p.argmax())], float(p.max())

    def named(self, w: list[str]) -> bool:
        """Whether a family leads that the templates confirm, however sure it is."""
        family = self.best(w)[0]
        g = set(grams(w))
        return family != UNKNOWN and len(g & set(self.templates[family])) >= CONFIRM * len(g)

    def predict(self, paragraph: str) -> tuple[str, float]:
        """The family and its probability, ``unknown`` where it isn't sure or the templates disagree."""
        w = tokens(paragraph)
        family, p = self.best(w)
        return (family if p >= self.threshold and self.named(w) else UNKNOWN), p


def _fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200, rate: float = 2.0, l1: float = 4e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression; proximal steps make the weights sparse."""
    x = x.astype(np.float32)
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    want = np.eye(classes, dtype=np.float32)[y]
    for _ in range(rounds):
        s = x @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - want) / len(x)
        w -= rate * (x.T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w.astype(float), b.astype(float)


def train(seed: int, texts: list[tuple[str, str, int]], scale: float = 1.0, threshold: float = 0.0) -> Model:
    lines, names = labelled(seed, texts)
    families = [*TEMPLATES, UNKNOWN]
    kept: dict[str, int] = {}
    for w, name in zip(lines, names):
        if name != UNKNOWN:
            for g in grams(w):
                kept.setdefault(g, len(kept))
    x = np.zeros((len(lines), len(kept)), np.float32)
    for i, w in enumerate(lines):
        x[i, [kept[g] for g in set(grams(w)) if g in kept]] = 1
    w, b = _fit(x, np.array([families.index(n) for n in names]), len(families))
    # numbers as they will be in the plan
    weights = {g: np.round(w[i] / scale, 4).tolist() for g, i in kept.items() if np.abs(w[i]).max() > 0.01}
    known = {f: sorted({g for own, t, _ in texts if own == f for g in grams(tokens(t))}) for f in TEMPLATES}
    return Model(families, weights, np.round(b / scale, 4).tolist(), threshold, known)


@cache
def _held_out(seed: int) -> tuple[list[tuple[np.ndarray, int, bool]], float]:
    """(scores, true family, confirmed) of each held-out text by a model that didn't see it, and the temperature."""
    out = []
    for k in range(FOLDS):
        m = train(seed, notices(k))
        lines, names = labelled(seed + 1, notices(k, held=True))
        out += [(m.scores(w), m.families.index(n), m.named(w)) for w, n in zip(lines, names)]
    s, right = np.array([x[0] for x in out]), np.array([x[1] for x in out])

    def loss(scale: float) -> float:
        z = s / scale
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]).mean())

    return out, min(np.linspace(0.2, 4, 77).tolist(), key=loss)


def held_out_accuracy(threshold: float, seed: int = SEED) -> dict[str, float]:
    """Precision and recall on the held-out texts, with templates and this threshold."""
    out, scale = _held_out(seed)
    named = right = true = 0
    for s, family, confirmed in out:
        p = np.exp((s - s.max()) / scale)
        if confirmed and (p / p.sum()).max() >= threshold:
            named, right = named + 1, right + (int(s.argmax()) == family)
        true += family < len(s) - 1
    return {"precision": right / max(named, 1), "recall": right / max(true, 1)}


@cache
def model(seed: int = SEED) -> Model:
    out, scale = _held_out(seed)
    levels = sorted({round(float(1 / np.exp((s - s.max()) / scale).sum()), 4) for s, _, confirmed in out if confirmed})
    threshold = next((x for x in levels if held_out_accuracy(x, seed)["precision"] >= 1 - FALSE_RATE), levels[-1])
    return train(seed, notices(), scale, threshold)


def _table(values: dict, kind: str) -> Column:
    """A constant map; it is folded once, not built for each row."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


#: Words that most paragraphs of any text have; tried last below.
_COMMON = set("a an and any are as at be but by for from has have he if in is it may not of on one or other that the this to was will with you".split())


def needed_words(m: Model) -> list[str]:
    """Words of which every paragraph that isn't ``unknown`` has one.

    Words are added until the grams without any of them, all of them at once
    and only where they speak against ``unknown``, can't lift a family over it.
    """
    unknown = m.families.index(UNKNOWN)
    margin = {g: np.maximum(np.array(w[:unknown]) - w[unknown], 0) for g, w in m.weights.items()}
    start = np.array(m.bias[:unknown]) - m.bias[unknown]
    chosen: list[str] = []
    while True:
        left = {g: v for g, v in margin.items() if not set(g.split(" ")) & set(chosen)}
        over = start + sum(left.values(), np.zeros(unknown))
        if (over <= 0).all():
            return sorted(chosen)
        f = int(over.argmax())
        worth: dict[str, float] = {}
        for g, v in left.items():
            for x in g.split(" "):
                worth[x] = worth.get(x, 0.0) + v[f]
        rare = {x: v for x, v in worth.items() if x not in _COMMON and v > 0}
        pool = rare or {x: v for x, v in worth.items() if v > 0}
        if not pool:
            return sorted({x for g in margin for x in g.split(" ")})
        chosen.append(max(sorted(pool), key=pool.get))


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and ``found``: (paragraph, family, probability) of each that names a licence.

    A row for each row of ``docs``, repeated ones too; a null text has no
    paragraphs.  They count from 0; lines without a word are none.  Of two
    families with the same score the first in ``TEMPLATES`` counts.  Very long
    texts are scanned whole.  Other columns are not read.
    """
    m = model()
    unknown = len(m.families) - 1
    weights, templates = _table(m.weights, "array<double>"), _table(m.templates, "array<string>")
    zero = F.lit([0.0] * len(m.families)).cast("array<double>")
    evidence, vocabulary = needed_words(m), list(m.weights)
    names = F.lit(m.families)

    def split_words(line: Column) -> Column:
        return F.array_remove(F.split(F.lower(line), _TRIM), "")

    def gram_set(w: Column) -> Column:
        pairs = F.when(
            F.size(w) > 1,
            F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))),
        ).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(w, pairs))

    def judged(g: Column) -> Column:
        bias = F.lit(m.bias).cast("array<double>")
        add = lambda a, x: F.zip_with(a, F.coalesce(F.try_element_at(weights, x), zero), lambda p, q: p + q)
        # a set test is much cheaper than a look into the map, and most grams have no weight
        weighted = F.filter(g, lambda x: x.isin(vocabulary))
        return let(F.aggregate(weighted, bias, add), lambda s: let(best(s), lambda b: confirm(g, b)))

    def best(s: Column) -> Column:
        top = F.array_max(s)
        p = F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct(F.element_at(names, F.array_position(s, top).cast("int")).alias("family"), p.alias("p"))

    def confirm(g: Column, b: Column) -> Column:
        same = F.size(F.array_intersect(g, F.element_at(templates, b["family"])))
        ok = (b["family"] != UNKNOWN) & (b["p"] >= m.threshold)
        return F.when(ok & F.coalesce(same >= CONFIRM * F.size(g), F.lit(False)), b)

    def scan(text: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            got = let(
                split_words(line),
                lambda w: F.when(F.exists(w, lambda x: x.isin(evidence)), let(gram_set(w), judged)),
            )
            return let(got, lambda b: F.when(b.isNotNull(), F.struct(k.alias("paragraph"), b["family"].alias("family"), F.round(b["p"], 6).alias("p"))))

        for wrap in _WRAPS:
            text = F.regexp_replace(text, wrap, "$1 ")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(lines, lambda all_: F.struct(F.size(all_).cast("bigint").alias("n_paragraphs"), F.filter(F.transform(all_, one), lambda x: x.isNotNull()).alias("found")))

    assert unknown == m.families.index(UNKNOWN)
    base = docs.select(F.col(id_col).alias("doc_id"), scan(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    return base.select("doc_id", "s.n_paragraphs", "s.found")


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_paragraphs, n_licence_paragraphs, families, licence_paragraphs."""
    item = lambda s: F.concat_ws(":", s["paragraph"].cast("string"), s["family"], F.format_number(s["p"], 3))
    return licence_paragraphs(docs, id_col, text_col).select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("bigint").alias("n_licence_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", item), ",").alias("licence_paragraphs"),
    )
