"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities: of insults from a fixed lexicon and from one learned on the labelled sample, of those near a
word in the second person, of capitals, of punctuation and of obfuscated words. Trees and calibration are fitted here,
on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import bounded_batches, parts, releasing
from quillspan.llm.words import stretches
from quillspan.session import scratch

#: Labelled rows that a fit uses at most; which ones depends on a hash of their key.
MAX_LABELLED = 8000
#: A learned lexicon has so many entries at most, each in so many texts of the sample and this much likelier in toxic ones.
#: An entry is a word, or the first letters of words with any ending (written with a star).
LEXICON_WORDS, LEXICON_TEXTS, LEXICON_ODDS, STEMS = 200, 12, math.log(8), (4, 5)
THRESHOLD = 0.7
#: Insults in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown dumb fool jerk creep "
    "imbecile vermin filth filthy ugly liar coward retard bitch bastard asshole shit fuck fucking "
    "dumm dummkopf trottel depp arschloch abschaum versager drecksack idioten "
    "idiote imbécile connard crétin débile ordure minable salaud "
    "estúpido imbécil basura inútil asqueroso payaso cabrón idiota".split()
)
#: Second-person words of the same languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes ti tus".split())
#: What a sign in a disguised word stands for.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
FEATURES = ["fixed", "learned", "known", "kinds", "log_known", "burst", "near_you", "you", "capitals", "shouted", "exclaim", "question", "signs", "disguised", "disguised_known", "log_words"]

_word = re.compile(r"[^\W_]+").findall
_mixed = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*]++[^\W\d_][\w@$!*]*").findall  # each run of letters is tried once
_led = re.compile(r"(?<![\w@$!*])[0-9@$!*]++[^\W\d_][\w@$!*]*").findall
_spelt = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b").findall
_shout = re.compile(r"\b[A-Z]{3,}\b").findall
_apart = re.compile(r"[ .\-_*]")
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*@^~|<>=+_"


def _has(learned: frozenset[str], word: str) -> bool:
    return word in learned or any(word[:n] + "*" in learned for n in STEMS if len(word) > n)


def lexicon_heads(learned: frozenset[str]) -> frozenset[str]:
    """The first letters of a lexicon's words, for a quick look."""
    return frozenset(w.rstrip("*")[: STEMS[0]] for w in learned)


def is_disguised(word: str) -> bool:
    """Whether a word with signs stands for an insult: signs for letters that look like them, a star for any."""
    plain = [w.translate(DISGUISE) for w in {word.lower(), word.lower().rstrip("!*")}]
    return any(p in INSULTS or "*" in p and any(len(x) == len(p) and all(c in ("*", d) for c, d in zip(p, x)) for x in INSULTS) for p in plain)


def features_by_lexicon(text: str | None, lexicons: list[frozenset[str]], heads: frozenset[str]) -> list[list[float]]:
    """The features of one text, in the order of FEATURES, under each lexicon; all zero for a text without words. ``heads``: of all lexicons.

    A long text is read in stretches; a word that is spelt out over the end of one isn't seen as such.
    """
    fixed: list[int] = []
    likely: list[tuple[int, str]] = []
    you: list[int] = []
    kinds: dict[int, str] = {}
    n = size = capitals = exclaim = question = signs = shouted = mixed = hidden = 0
    for raw in stretches(text):
        part = raw.decode()
        words = _word(part.lower())
        for i, w in enumerate(words, n):
            if w in INSULTS:
                fixed.append(i)
                kinds[i] = w
            if w in SECOND_PERSON:
                you.append(i)
        if heads:
            likely += [(i, w) for i, w in enumerate(words, n) if w[:4] in heads]
        less = lambda signs: len(raw) - len(raw.translate(None, signs))  # noqa: B023, E731
        own = _mixed(part)
        n += len(words)
        size += len(raw)
        capitals, exclaim, question, signs = capitals + less(_CAPITALS), exclaim + less(b"!"), question + less(b"?"), signs + less(_SIGNS)
        shouted, mixed = shouted + len(_shout(part)), mixed + len(own)
        hidden += sum(map(is_disguised, own)) + sum(map(is_disguised, _led(part))) + sum(_apart.sub("", w).lower() in INSULTS for w in _spelt(part))
    if not n:
        return [[0.0] * len(FEATURES) for _ in lexicons]
    person, out = np.array(you, np.int64), []
    for learned in lexicons:
        taught = [(i, w) for i, w in likely if _has(learned, w)]
        at = np.array(sorted({*fixed, *(i for i, _ in taught)}), np.int64)
        near = burst = 0
        if len(at):
            burst = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
            near = int((np.searchsorted(person, at + NEAR, side="right") > np.searchsorted(person, at - NEAR)).sum())
        out.append([
            100 * len(fixed) / n,
            100 * len(taught) / n,
            100 * len(at) / n,
            float(len({*kinds.values(), *(w for _, w in taught)})),
            math.log1p(len(at)),
            float(burst),
            100 * near / n,
            100 * len(you) / n,
            100 * capitals / size,
            100 * shouted / n,
            100 * exclaim / size,
            100 * question / size,
            100 * signs / size,
            100 * mixed / n,
            100.0 * hidden / n,
            math.log1p(n),
        ])
    return out


def text_features(text: str | None, learned: frozenset[str] = frozenset(), heads: frozenset[str] = frozenset()) -> list[float]:
    """The features of one text under one lexicon; heads: of ``learned``."""
    return features_by_lexicon(text, [learned], heads)[0]


@dataclass
class Trees:
    """Boosted regression trees of one depth on the logit; node i of a level has the nodes 2i and 2i + 1 below it."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each: features and thresholds by level and node, leaves
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[k]] > cut[k])
            out += leaves[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 8.0, l2: float = 1.0) -> Trees:
    """Logistic boosting by second-order gain over histograms of feature quantiles."""
    if not len(y):
        return Trees(0.0, [], depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [np.union1d(e, [0.0]) for e in edges]  # densities are often zero: that is worth a cut
    code = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)
    width = max(len(e) for e in edges) + 1
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(math.log(mean / (1 - mean)), [], depth)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            n, best = 1 << level, np.full(1 << level, 1e-9)
            picked = np.zeros(n, np.int64), np.full(n, width)
            for f in range(x.shape[1]):
                at = node * width + code[:, f]
                gs, hs, cs = (np.bincount(at, w, n * width).reshape(n, width).cumsum(1) for w in (g, h, np.ones(len(y))))
                G, H, C = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
                gain[(cs < least) | (C - cs < least)] = -1
                b = gain.argmax(1)
                top = gain[np.arange(n), b]
                won = top > best + 1e-12
                best[won], picked[0][won], picked[1][won] = top[won], f, b[won]
            for i in range(n):
                k = n - 1 + i
                if picked[1][i] < len(edges[picked[0][i]]):
                    feature[k], cut[k] = picked[0][i], edges[picked[0][i]][picked[1][i]]
            k = n - 1 + node
            node = 2 * node + (x[np.arange(len(x)), feature[k]] > cut[k])
        G, H = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaves = rate * G / (H + l2)
        raw += leaves[node]
        model.trees.append((feature, cut, leaves))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y to score: neighbours that break the order are pooled."""
    at, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place, minlength=len(at)).astype(float)
    blocks: list[list[float]] = []  # weight, mean, first and last score
    for x, w, v in zip(at.tolist(), weight.tolist(), (np.bincount(place, y, len(at)) / weight).tolist()):
        blocks.append([w, v, x, x])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, _, last = blocks.pop()
            b = blocks[-1]
            b[1] = (b[0] * b[1] + w * m) / (b[0] + w)
            b[0] += w
            b[3] = last
    knots = [(x, b[1]) for b in blocks for x in ((b[2],) if b[2] == b[3] else (b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    """A fitted scorer; ``score`` gives numbers between 0 and 1."""

    learned: frozenset[str]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        fit = np.interp(raw, self.knots, self.values) if len(self.knots) else 1 / (1 + np.exp(-raw))
        # The trees' own order breaks the ties of a flat stretch.
        return np.clip(0.998 * fit + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def _entries(text: str | None) -> dict[str, int]:
    """Each word and stem of a text, with a hash of the words around its first place."""
    words = _word((text or "").lower())
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        for entry in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
            if entry not in found:
                found[entry] = crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
    return found


def _lexicons(sample: DataFrame, folds: int) -> list[frozenset[str]]:
    """For each fold the lexicon of the others, and last that of all.

    An entry is a word or stem that is far likelier in toxic texts, in many contexts: what only copies share has few. Texts that
    are equal count once, as toxic if any of them is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 100):
            own = [(w, y, c, k) for t, y, k in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "fold"))) for w, c in _entries(t).items()]
            cols = list(zip(*own)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], ["word", "toxic", "c", "fold"])

    once = scratch(sample.groupBy("t", "fold").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", "fold"), "texts")
    of = lambda value: [F.coalesce(F.sum(F.when(F.col("fold") == f, value)), F.lit(0)) for f in range(folds)]
    n, bad = [f"n{f}" for f in range(folds)], [f"bad{f}" for f in range(folds)]
    counts = [*[c.alias(a) for c, a in zip(of(F.lit(1)), n)], *[c.alias(a) for c, a in zip(of(F.col("toxic")), bad)]]
    totals = once.agg(*counts).first()
    but = lambda names, k: [x for f, x in enumerate(names) if f != k]
    stats = once.mapInArrow(releasing(run), "word string, toxic int, c long, fold int").groupBy("word", "c").agg(*counts)
    some = [F.count_if(reduce(Column.__add__, map(F.col, but(n, k))) > 0).alias(f"c{k}") for k in range(folds + 1)]
    stats = stats.groupBy("word").agg(*[F.sum(x).alias(x) for x in (*n, *bad)], *some)
    stats = scratch(stats.where(reduce(Column.__add__, map(F.col, n)) >= LEXICON_TEXTS), "words")
    out = []
    for k in range(folds + 1):
        total, toxic = sum(totals[x] for x in but(n, k)), sum(totals[x] for x in but(bad, k))
        if not toxic or toxic == total:
            out.append(frozenset())
            continue
        all_, yes = (reduce(Column.__add__, map(F.col, but(x, k))) for x in (n, bad))
        odds = F.log((yes + 0.5) / F.lit(float(toxic))) - F.log((all_ - yes + 0.5) / F.lit(float(total - toxic)))
        top = stats.where((all_ >= LEXICON_TEXTS) & (F.col(f"c{k}") >= 0.8 * all_)).withColumn("odds", odds).where(F.col("odds") >= LEXICON_ODDS)
        out.append(frozenset(r.word for r in top.orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS).collect()))
    return out


def held_out(key: str):
    """crc32 of the key as text, modulo 3, is 1; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED, folds: int = 5) -> Model:
    """A model from at most ``most`` labelled rows that aren't held out; of a key's labels the largest counts, null labels don't.

    Of a repeated key's texts the least counts. Which rows are taken and how they fold depends on hashes alone, so a fit can
    be repeated. Equal texts are in the same fold, and what a fold is scored with - lexicon and trees - has seen none of its
    labels; the calibration is fitted to those scores. Without labels of both kinds every score is the mean label, or 1/2.

    The sample's keys and labels (16 bytes each) are broadcast to the scan of the texts; its features, some 130 bytes a row and
    fold, go to the driver. The session's Arrow batches are bounded from then on.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(labels[key].cast("long").alias("key"), labels[label].cast("int").alias("toxic")).where("key is not null and toxic is not null")
    known = known.where(~held_out("key")).groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(most)
    slim = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    sample = slim.join(F.broadcast(known), "key").groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = sample.withColumn("t", F.xxhash64("text")).withColumn("fold", F.pmod("t", F.lit(folds)).cast("int"))
    sample = scratch(sample, "labelled")
    lexicons = _lexicons(sample, folds)
    heads = lexicon_heads(frozenset().union(*lexicons))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = [[v for x in features_by_lexicon(t, lexicons, heads) for v in x] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), batch.column("fold"), pa.array(own, pa.list_(pa.float64()))], ["key", "toxic", "fold", "x"])

    rows = sorted(sample.mapInArrow(releasing(run), "key long, toxic int, fold int, x array<double>").collect())
    x = np.array([r.x for r in rows], float).reshape(len(rows), folds + 1, len(FEATURES))
    y, fold = np.array([r.toxic for r in rows], float), np.array([r.fold for r in rows], np.int64)
    trees = fit_trees(x[:, folds], y)
    if len(set(y.tolist())) < 2:
        return Model(lexicons[folds], trees, np.zeros(0), np.zeros(0))
    raw = np.zeros(len(y))
    for k in range(folds):
        raw[fold == k] = fit_trees(x[fold != k, k], y[fold != k]).raw(x[fold == k, k])
    return Model(lexicons[folds], trees, *isotonic(raw, y))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with score (0 to 1) and predicted (1 at THRESHOLD or more) added; one row for each, no shuffle.

    Null and empty texts get the score of a text without any feature; a very long one is read in stretches. Null and repeated
    keys don't matter, equal texts get equal scores, an empty table gives none. Columns named score or predicted are replaced.
    The session's Arrow batches are bounded from then on.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names, heads = docs.columns, lexicon_heads(model.learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = np.array([text_features(t, model.learned, heads) for t in part.column(text).to_pylist()], float)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{kinds}, score double, predicted int")


def op10(spark, sf_dir: str) -> DataFrame:
    """The query: every document's score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
