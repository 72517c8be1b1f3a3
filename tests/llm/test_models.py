"""The learned operators against plain loops over their definitions, and on awkward rows."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from pairscope.llm import langid, lmscore, packing, toxicity
from test_llm import AWKWARD, SCHEMA, brute_losses, corpus, table


def slow_features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split()
    n = max(1, len(words))
    abuse = [i for i, w in enumerate(words) if w in toxicity.ABUSE]
    known = [i for i, w in enumerate(words) if w in lexicon]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = lambda places: float(sum(any(abs(i - j) <= 5 for j in you) for i in places))
    raw = text.split()
    broken = []
    for run in re.findall(r"[A-Za-z0-9@$*!|+]+", text):
        letters = [i for i, c in enumerate(run) if c.isalpha()]
        if letters and any(not c.isalpha() for c in run[letters[0] : letters[-1] + 1]):
            broken.append(run[letters[0] : letters[-1] + 1])
    odd = broken + toxicity._SPACED.findall(text)
    hidden = sum(toxicity._undone(w) in toxicity.ABUSE or toxicity._undone(w) in lexicon for w in odd)
    scores = [lexicon[words[i]] for i in known]
    return [
        len(abuse) / n, math.log1p(len(abuse)), near(abuse), sum(scores) / n, math.log1p(len(scores)), max(scores, default=0.0), near(known),
        sum("A" <= c <= "Z" for c in text) / (sum(map(len, words)) or 1), sum(w.isupper() and len(w) > 1 for w in raw) / n, text.count("!") / n, text.count("?") / n, (text.count("!!") + text.count("??")) / n, len(odd) / n, math.log1p(hidden), math.log1p(len(words)),
    ]


def test_features_by_plain_loops():
    rng = random.Random(5)
    bits = ["idiot", "You", "u", "ID10T", "i.d.i.o.t", "m o r o n s", "st*pid", "WOW", "fine!!", "why??", "é", "b@d", "zork", "a1b2c3", "123", "your", "--", "x", "I", "don't"]
    lexicon = {"zork": 2.0, "fine": 1.5}
    for _ in range(500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) * rng.randint(1, 3)
        assert np.allclose(toxicity.features(text, lexicon), slow_features(text, lexicon)), text


@pytest.mark.parametrize("word", ["a" * 10_000_000, "a" + "3" * 10_000_000, "a1" * 2_000_000, "a." * 1_000_000])
def test_one_long_word_takes_time_in_proportion(word):
    import time

    began = time.process_time()
    assert len(toxicity.features(word, {})) == len(toxicity.NAMES)
    assert time.process_time() - began < 6


def test_trees_and_isotonic_by_definition():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(float)
    trees = toxicity.Trees(rounds=12).fit(x, y, np.ones(400))
    for row, got in zip(x[:50], trees.raw(x[:50]), strict=True):
        total = trees.start
        for column, bound, value in trees.trees:
            node = 0
            for level in range(trees.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + int(row[column[at]] > bound[at])
            total += trees.rate * value[node]
        assert math.isclose(total, got)
    # the fitted value at i is the greatest over starts of the least over ends of the means between
    score, seen, weight = np.sort(rng.random(40)), (rng.random(40) < 0.5).astype(float), rng.random(40) + 0.1
    knots = toxicity.isotonic(score, seen, weight)
    mean = lambda a, b: (weight[a : b + 1] @ seen[a : b + 1]) / weight[a : b + 1].sum()
    for i in range(40):
        assert math.isclose(np.interp(score[i], *knots), max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)), abs_tol=1e-9)


def test_toxicity_on_awkward_rows(spark):
    docs = table(spark, AWKWARD + [(20 + i, t) for i, (_, t) in enumerate(corpus())])
    labels = spark.createDataFrame([(20 + i, i % 2) for i in range(60)] + [(20, 1), (20, 0), (None, 1), (21, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    same = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and len({r.score for r in got if r.doc_id == 6}) == 1
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert again.lexicon == model.lexicon and np.array_equal(again.trees.raw(np.zeros((1, 15))) if again.trees else [0], model.trees.raw(np.zeros((1, 15))) if model.trees else [0])
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0} and toxicity.score(docs.limit(0), none).count() == 0


def test_langid_by_plain_loops():
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "tzer", "ung"], "cc": ["ção", "nho", "eira"], "dd": ["ka", "ung", "zz"]}
    text = lambda v, n=12: " ".join("".join(rng.choice(parts[v]) for _ in range(3)) for _ in range(n))
    langs = [rng.choice(list(parts)) for _ in range(120)]
    model = langid.fit([text(v) for v in langs], langs, rounds=30)
    for t in [text(v) for v in parts] + ["Ka lo, MI! 12", "é", "x" * 30_000]:
        places = langid.features(t)
        counts = {}
        for p in places.tolist():
            counts[p] = counts.get(p, 0) + 1
        size = math.sqrt(sum(counts.values()))
        margins = [sum(math.sqrt(n) * float(model.weights[p, b]) for p, n in counts.items()) / size + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-2 * float(c) * m)) * float(w) for c, m, w in zip(model.code[k], margins, model.trust[k], strict=True)) for k in range(len(model.langs))]
        assert model.predict(t)[0] == model.langs[int(np.argmin(loss))]
        best, second = sorted(loss)[:2]
        assert model.predict(t)[2] == (second - best < 0.05) or abs(second - best - 0.05) < 1e-3


def test_langid_of_many_languages_and_ties(spark):
    """Each of many languages is learned, from few rows, whichever way they are dealt; equal codewords are a tie."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"{chr(97 + i % 20)}{chr(97 + (i + 3) % 20)}{rng.choice('xyz')}" for _ in range(8)), f"l{i % 20:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None, "l00"), (1001, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.learn(docs, per_lang=8)
    assert model.langs == [f"l{i:02d}" for i in range(20)]
    again = langid.learn(docs.repartition(5), per_lang=8)
    assert np.array_equal(model.weights, again.weights)
    tie = langid.Model(["a", "b"], np.ones((2, 3), np.float32), np.zeros((1 << langid.BITS, 3), np.float32), np.zeros(3, np.float32), np.full((2, 3), 1 / 3, np.float32))
    assert tie.predict("word")[0] == "a" and tie.predict("word")[2]
    assert langid.identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("size,part", [(4_000_000, 2_000_000), (60, 25)])
def test_weigh_by_brute_force(spark, monkeypatch, size, part):
    """One exchange gives what dictionaries of exact counts give, however small chunks and parts are."""
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", size)
    monkeypatch.setattr(lmscore, "PART_TOKENS", part)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.random() ** 3 * 60)}" for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(3, "w1 w2 w1"), (None, "w1 w2 W3"), (200, ""), (201, None), (70, "w5 " * 400), (71, "w5 w6"), (71, "w5 w6")]
    good = set(range(0, 60, 4)) | {71}
    docs = lmscore.targets(table(spark, rows), spark.createDataFrame([(i, 1) for i in good], "doc_id bigint, quality int"))
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.difference) for r in lmscore.weigh(docs.repartition(3)).collect()), key=repr)
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute_losses(rows, good), strict=True)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[2], g[3], g[4]) == (None, None, None) if w[2] is None else np.allclose(g[2:], (w[2], w[3], w[2] - w[3]), rtol=1e-9, atol=1e-12), (g, w)
    scored = sorted(((r.doc_id, r.n_tokens, r.target_loss) for r in lmscore.score(docs, lmscore.train(docs), target="target").collect()), key=repr)
    assert all(a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or math.isclose(a[2], b[2], rel_tol=1e-9)) for a, b in zip(scored, got, strict=True))
    assert lmscore.weigh(docs.limit(0)).count() == 0


def test_packing_leaves_little_over(spark):
    """Of a corpus of mixed lengths nearly all tokens lie in sequences of a tier's length, and none is padded."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(int(rng.paretovariate(1.1) * 40) % 9000))) for i in range(500)] + [(None, "a null id"), (7, None)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), packing.default_path()).collect()
    lengths = {r.sequence_id: r.sequence_length for r in pieces}
    tokens = sum(r.length for r in pieces)
    assert tokens == sum(lengths.values()) and all(n & (n - 1) == 0 and n <= 4096 for n in lengths.values())
    assert sum(n for n in lengths.values() if n in packing.TIERS) >= 0.99 * tokens
    assert len({r.doc_id for r in pieces}) == len({d for d, _ in rows})
