"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed character n-grams predicts each bit. A text's language is
the codeword nearest to its bit scores under a loss weighted by how well each classifier did for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import bounded_sample, columns, held_out, read, unused

#: log2 of the hashed n-grams; n-gram lengths; training rows a language and in all, at most; rounds of gradient descent.
BITS = 13
ORDERS = (1, 2, 3)
SAMPLE = 600
SAMPLE_ROWS = 6000
ROUNDS = 120
UNKNOWN = "und"


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams of the letters of the whole text (other characters part words), as places in a table."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_PARTS)
    code = np.frombuffer(" ".join(["", *kept.split(), ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(code) < n:
                continue
            value = np.full(len(code) - n + 1, n, np.uint64)
            for i in range(n):
                value = value * np.uint64(0x100000001B3) + code[i : len(code) - n + 1 + i]
            value *= np.uint64(0x9E3779B97F4A7C15)
            out.append((value >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


_PARTS = {i: " " for i in range(128) if not chr(i).isalpha()}


def profile(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of n-gram counts, at length one."""
    counts = np.sqrt(np.bincount(features(text, bits), minlength=1 << bits)).astype(np.float32)
    return counts / max(1e-9, float(np.sqrt(counts @ counts)))


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: the exhaustive code for up to 6 languages, else pseudo-random columns, all distinct."""
    if k == 1:
        return np.ones((1, 1), np.float32)
    if k <= 6:
        columns = [[1 if c >> i & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(columns, np.float32).T
    length = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(k)
    best, most = None, -1
    for _ in range(50):
        code = np.where(rng.random((k, length)) < 0.5, -1, 1)
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if apart > most and not (abs(code.sum(axis=0)) == k).any():
            best, most = code, apart
    return best.astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # n-gram places by bits
    bias: np.ndarray
    trust: np.ndarray  # languages by bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), whether two codewords are about as near."""
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, False
        found = features(text)
        if len(found) > 4096:
            counts = np.sqrt(np.bincount(found, minlength=len(self.weights))).astype(np.float32)
            margin = counts @ self.weights / np.sqrt(counts @ counts)
        else:
            places, n = np.unique(found, return_counts=True)
            counts = np.sqrt(n).astype(np.float32)
            margin = counts @ self.weights[places] / np.sqrt(counts @ counts)
        margin = margin + self.bias
        loss = (np.logaddexp(0, -2 * self.code * margin) * self.trust).sum(axis=1)
        chance = np.exp(-(loss - loss.min()) * self.code.shape[1])
        chance /= chance.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < 0.05
        return self.langs[order[0]], float(np.clip(chance[order[0]], 0, 1)), bool(close)


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names)) if names else np.ones((0, 1), np.float32)
    bits = code.shape[1]
    if len(names) < 2:
        return Model(names, code, np.zeros((1 << BITS, bits), np.float32), np.ones(bits, np.float32), np.ones((len(names), bits), np.float32))
    x = np.stack([profile(t) for t in texts])
    y = np.array([names.index(v) for v in langs])
    target = code[y]
    share = np.bincount(y, minlength=len(names))
    row = (1.0 / share[y])[:, None] / len(names)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        pull = (-target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * row).astype(np.float32)
        speed_w = 0.9 * speed_w - 8.0 * (x.T @ pull + 1e-5 * w)
        speed_b = 0.9 * speed_b - 2.0 * pull.sum(axis=0)
        w += speed_w
        b += speed_b
    right = (np.sign(x @ w + b) == target).astype(np.float32)
    trust = np.stack([right[y == i].mean(axis=0) for i in range(len(names))])
    trust = np.maximum(trust - 0.5, 0.01)
    return Model(names, code, w, b, trust / trust.sum(axis=1, keepdims=True))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE, in_all: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of the rows given: per_lang rows a language, fewer of each where there are so many
    languages that all would exceed in_all (ten at least). Rows without text or language are not learned from; repeated
    rows count once; every language is learned."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    kinds = rows.agg(F.count_distinct("lang")).first()[0]
    got, _ = bounded_sample(rows, "lang", F.xxhash64("id"), "text", min(per_lang, max(10, in_all // max(1, kinds))))
    return fit([t for t, _ in got], [v for _, v in got])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, lang_pred, score, ambiguous, a row for each row of docs. Texts are read whole.

    A null text, or one with no letter, is `und` with score 0; so is every text if nothing was learned. Codewords equally
    near give the language first by name and are ambiguous. Repeated rows and null ids each get a row; columns that are
    not kept are not read; empty in, empty out.
    """
    keep = keep if keep is not None else ["doc_id"]
    chosen = docs.select(*columns(keep), F.col(text).alias(unused(keep, "__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", lang_pred string, score double, ambiguous boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_columns - 1
            found = [own.predict(v.as_py()) for v in batch.column(n)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], [*batch.schema.names[:n], "lang_pred", "score", "ambiguous"])

    return chosen.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.filter(~held_out("doc_id", 4, 2)))
    return identify(docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out")), model, keep=["doc_id", "held_out"])

