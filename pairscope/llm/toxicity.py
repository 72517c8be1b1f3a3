"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of a fixed and of a learned lexicon, their nearness to second-person words, and rates of
capitals, punctuation and obfuscated spellings. Lexicon, trees and calibration are each fitted on their own part of a
bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import bounded_sample, columns, held_out, least, read, settle, unused

#: Labelled rows of each class that are learned from, at most.
SAMPLE = 2000

#: Words of abuse, and words that address the reader.
ABUSE = {
    "idiot", "idiots", "idiotic", "moron", "morons", "stupid", "dumb", "loser", "losers", "clown", "clowns", "scum", "trash", "garbage",
    "worthless", "pathetic", "disgusting", "filth", "filthy", "vermin", "imbecile", "fool", "freak", "jerk", "bastard", "shit", "fuck",
    "fucking", "bitch", "asshole", "crap", "useless", "ugly", "liar", "coward", "degenerate", "subhuman", "retard",
    "dummkopf", "arschloch", "abschaum", "schwachkopf", "dreck", "connard", "salaud", "ordure", "imbécile", "abruti", "crétin",
    "idiota", "imbécil", "estúpido", "basura", "escoria", "tonto", "idiote", "blöd",
}
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros",
}

_PUNCT = {i: " " for i in range(128) if not chr(i).isalnum()}
#: Letters broken by digits or signs; letters set apart. Each starts at the first letter of a run and never goes back over
#: one, so time grows with the text alone.
_BROKEN = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[0-9@$*!|+]++[A-Za-z]++)++")
_SPACED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z][.\-_* ]){3,}[A-Za-z](?![A-Za-z])")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", ".": None, "-": None, "_": None, " ": None})
NAMES = ["abuse", "abuse_count", "abuse_near_you", "learned", "learned_count", "learned_top", "learned_near_you", "capitals", "capital_words", "exclaims", "questions", "runs", "obfuscated", "obfuscated_abuse", "log_words"]


def words_of(text: str) -> list[str]:
    return text.lower().translate(_PUNCT).split()


def learn_lexicon(texts: list[str], toxic: list[int], least: int = 3, odds: float = 1.0) -> dict[str, float]:
    """word -> log-odds of being in a toxic text, for words in `least` toxic texts or more with odds enough."""
    counts = (Counter(), Counter())
    n = [sum(1 for t in toxic if not t), sum(1 for t in toxic if t)]
    for text, t in zip(texts, toxic, strict=True):
        counts[bool(t)].update(set(words_of(text)))
    out = {}
    for word, k in counts[1].items():
        if k >= least:
            score = math.log((k + 0.5) / (n[1] + 1)) - math.log((counts[0][word] + 0.5) / (n[0] + 1))
            if score > odds:
                out[word] = min(score, 4.0)
    return out


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = words_of(text)
    n = max(1, len(words))
    listed = set(words)
    abuse_at = [i for i, w in enumerate(words) if w in ABUSE] if not listed.isdisjoint(ABUSE) else []
    known = listed.intersection(lexicon)
    learned_at = [i for i, w in enumerate(words) if w in known] if known else []
    you_at = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON]) if (abuse_at or learned_at) and not listed.isdisjoint(SECOND_PERSON) else np.empty(0, np.int64)

    def near(places: list[int]) -> float:
        if not places or not len(you_at):
            return 0.0
        at = np.searchsorted(you_at, places)
        p = np.array(places)
        gap = np.minimum(np.abs(you_at[np.clip(at, 0, len(you_at) - 1)] - p), np.abs(you_at[np.clip(at - 1, 0, len(you_at) - 1)] - p))
        return float((gap <= 5).sum())

    raw = text.split()
    letters = sum(map(len, words)) or 1
    upper = sum(w.isupper() and len(w) > 1 for w in raw)
    odd = _BROKEN.findall(text) + _SPACED.findall(text)
    hidden = sum(_undone(w) in ABUSE or _undone(w) in lexicon for w in odd)
    scores = [lexicon[words[i]] for i in learned_at]
    capitals = sum(1 for c in text if "A" <= c <= "Z") if len(text) < 200 else len(text) - len(text.translate(_NO_CAPITALS))
    return [
        len(abuse_at) / n, math.log1p(len(abuse_at)), near(abuse_at), sum(scores) / n, math.log1p(len(scores)), max(scores, default=0.0), near(learned_at),
        capitals / letters, upper / n, text.count("!") / n, text.count("?") / n, (text.count("!!") + text.count("??")) / n, len(odd) / n, math.log1p(hidden), math.log1p(len(words)),
    ]


_NO_CAPITALS = {i: None for i in range(ord("A"), ord("Z") + 1)}


def _undone(word: str) -> str:
    return word.lower().translate(_PLAIN).replace("*", "")


@dataclass
class Trees:
    """Boosted trees of depth `depth` on the log-odds, split at quantiles."""

    rate: float = 0.15
    rounds: int = 60
    depth: int = 3
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # column and bound a node, value a leaf

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        cuts = [c if len(c) > 1 else np.unique(np.r_[c, np.unique(x[:, j])[:64][:-1]]) for j, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
        self.start = math.log(mean / (1 - mean))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            column = np.zeros((1 << self.depth) - 1, np.int64)
            bound = np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                base = (1 << level) - 1
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 20:
                        continue
                    best = 1e-6
                    g, h = grad[rows].sum(), hess[rows].sum()
                    for j, c in enumerate(cuts):
                        gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        gain[(nl < 5) | (len(rows) - nl < 5)] = -1
                        if len(gain) and gain.max() > best:
                            best = gain.max()
                            column[base + k], bound[base + k] = j, c[int(gain.argmax())]
                node = 2 * node + (x[np.arange(len(x)), column[base + node]] > bound[base + node])
            value = np.bincount(node, grad, 1 << self.depth) / (np.bincount(node, hess, 1 << self.depth) + 1.0)
            self.trees.append((column, bound, value))
            raw += self.rate * value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for column, bound, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                base = (1 << level) - 1
                node = 2 * node + (x[rows, column[base + node]] > bound[base + node])
            out += self.rate * value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising function, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, mean, least x, most x
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([w, b, a, a])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, _, hi = pools.pop()
            w1, m1, lo, _ = pools.pop()
            pools.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), lo, hi])
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([v for p in pools for v in (p[1], p[1])])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        if self.trees is None:
            return np.full(len(texts), self.base)
        raw = self.trees.raw(np.array([features(t or "", self.lexicon) for t in texts]))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def fit(texts: list[str], toxic: list[int], counts: dict[int, int]) -> Model:
    """counts: rows of each class in all; the sample's classes are weighted back to them."""
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    y = np.array(toxic, np.float64)
    if len(y) < 50 or y.min() == y.max():
        return Model({}, None, None, share)
    # rows arrive by hash; each class is dealt out alike: half to the lexicon, a third to the trees, the rest to calibration
    place = np.empty(len(y), np.int64)
    for c in (0.0, 1.0):
        own = np.flatnonzero(y == c)
        place[own] = np.arange(len(own)) % 10
    lexicon = learn_lexicon([t for t, p in zip(texts, place, strict=True) if p < 5], [t for t, p in zip(toxic, place, strict=True) if p < 5])
    rest = np.flatnonzero(place >= 5)
    x = np.array([features(texts[i], lexicon) for i in rest])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    on, by = place[rest] < 8, place[rest] >= 8
    trees = Trees().fit(x[on], y[rest][on], weight[rest][on])
    knots = isotonic(trees.raw(x[by]), y[rest][by], weight[rest][by])
    return Model(lexicon, trees, knots, share)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model from at most `most` labelled rows of each class.

    Rows without text, id or label are not learned from. An id whose labels differ is toxic; repeated rows count once, and
    of rows that share an id but not the text each is learned from.
    """
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).filter("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids, counts = least(marked, "toxic", F.xxhash64("id"), "id", most)
    if not ids:
        return Model({}, None, None, 0.0)
    chosen = docs.sparkSession.createDataFrame(ids, marked.select("id", "toxic").schema)
    rows = settle(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "id"))
    found, _ = bounded_sample(rows, "toxic", F.xxhash64("id"), "text", most)
    return fit([t for t, _ in found], [v for _, v in found], counts)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, score, predicted, a row for each row of docs. A null text is scored as empty; texts are read whole.

    Repeated rows and null ids each get a row; columns that are not kept are not read, and a kept column called score or
    predicted is an error of the caller (name it otherwise). Empty in, empty out.
    """
    keep = keep if keep is not None else ["doc_id"]
    chosen = docs.select(*columns(keep), F.col(text).alias(unused(keep, "__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = batch.num_columns - 1
                found = own.score(batch.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*batch.schema.names[:n], "score", "predicted"])

    return chosen.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    fold = held_out("doc_id", 5, 0)
    model = learn(docs.filter(~fold), read(spark, sf_dir, "labels", "doc_id", "toxic").filter(~fold))
    return score(docs.select("doc_id", "text", fold.alias("held_out")), model, keep=["doc_id", "held_out"])
