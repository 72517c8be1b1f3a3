"""The pipeline's stages on awkward tables, each judged on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from conftest import SF
from pairscope.llm import decontaminate, langid, lmscore, packing, pii, quality, simhash, toxicity
from pairscope.llm.common import read
from test_llm import brute_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, fp bigint, kind string, row int, `a b` array<int>"


def prose(rng: random.Random, n: int = 60) -> str:
    return " ".join(rng.choice(["the", "of", "and", "to", "a", "is", *(f"{c}{d}ing" for c in "bdfglm" for d in "aeiou")]) for _ in range(n))


def awkward(spark) -> list[tuple]:
    rng = random.Random(11)
    texts = [prose(rng) for _ in range(12)]
    item = next(r.text for r in read(spark, SF, "benchmark").orderBy("item_id").collect() if r.text and len(r.text.split()) > 8)
    long = " ".join(prose(rng, 50) for _ in range(300))
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, None), (3, ""), (4, " \n\t "), (5, texts[4]), (6, texts[4]), (7, texts[4] + "!"), (5, texts[4]), (8, texts[5] + " " + item + " " + texts[6]), (9, texts[7] + " write to a.b@c.org or +1 (555) 010-1234 " + texts[8]), (10, "word " * 200), (11, long), (None, texts[2]), (12, "# $ % & " * 40 + texts[9])]
    return [(d, t, None if i % 3 else "en", "s" if i % 2 else None, None if t is None else len(t), i, "k", None, [i] if i % 2 else None) for i, (d, t) in enumerate(rows)]


def held(df) -> Counter:
    return Counter(repr(tuple(r)) for r in df.collect())


def test_stages_on_awkward_rows(spark):
    rows = awkward(spark)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stage = dict(corpus_pipeline.STAGES)
    # quality: a row stays by its text alone, with all its columns
    kept = {r.doc_id for r in quality.assess(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id bigint, text string")).collect() if r.kept}
    first = stage["quality rules"](spark, docs, SF)
    assert first.columns == docs.columns and held(first) == Counter(repr(r) for i, r in enumerate(rows) if i in kept)
    assert {5, 10}.isdisjoint({4, 5, 6} & kept) and 13 not in kept
    # near-dedup: one row of each class; ids that clash or are null lose nothing
    own = [r for i, r in enumerate(rows) if i in kept]
    roots = brute_components([(i, r[1]) for i, r in enumerate(own)])[1]
    second = stage["SimHash near-dedup"](spark, first, SF)
    got = second.collect()
    assert second.columns == docs.columns and len(got) == len(set(roots))
    place = {repr(r): i for i, r in enumerate(own)}
    assert {roots[place[repr(tuple(r))]] for r in got} == set(roots)
    for root in set(roots):
        ids = [own[i][0] for i, x in enumerate(roots) if x == root and own[i][0] is not None]
        chosen = next(r for r in got if roots[place[repr(tuple(r))]] == root)
        assert chosen.doc_id == (min(ids) if ids else None)
    # decontamination: rows that hold an item go, all others stay as they are
    third = stage["benchmark decontamination"](spark, second, SF)
    dirty = {r.text for r in decontaminate.contamination(second.select("text"), read(spark, SF, "benchmark"), keep=["text"]).collect()}
    assert len(dirty) == 1 and held(third) == Counter(repr(tuple(r)) for r in got if r.text not in dirty)
    # personal data: every row stays, with its spans replaced
    fourth = stage["personal data"](spark, third, SF)
    assert fourth.columns == docs.columns and fourth.schema == third.schema
    spans = {r.doc_id: r for r in pii.extract(third).collect()}
    texts = {r.row if False else r.fp: r for r in fourth.collect()}
    for r in third.collect():
        new = texts[r.fp]
        parts = [s.split(":") for s in spans[r.doc_id].spans.split(",") if s]
        assert new.text == pii.redacted(r.text, [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in parts])
        assert new.n_chars == len(new.text) and (new.doc_id, new.lang, new.source, new.kind, new["a b"]) == (r.doc_id, r.lang, r.source, r.kind, r["a b"])
    assert any("<email>" in r.text and "<phone>" in r.text for r in texts.values())
    # packing: every token of every row, once
    whole = packing.tokens(packing.default_path())
    pieces = stage["packing"](spark, fourth, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(whole.ids(r.text.encode())) // 2 + 1 for r in texts.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_and_single(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], SCHEMA)
    out = stage(spark, empty, SF)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == empty.columns


def test_near_copies_of_many_texts_keep_one_each(spark):
    """Groups of exact and near copies over repeated and null ids: as many rows as classes, whichever way they are dealt."""
    rng = random.Random(3)
    rows = []
    for g in range(8):
        words = prose(rng, 120).split()
        for k in range(rng.randint(1, 9)):
            copy = list(words)
            if k % 2:
                copy[rng.randrange(120)] = "zz"
            rows.append((rng.choice([None, g, g + 100, k]), " ".join(copy)))
    want = len(set(brute_components([(i, t) for i, (_, t) in enumerate(rows)])[1]))
    for parts in (1, 6):
        assert simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).count() == want


RESERVED = ["row", "__row", "__text", "__target", "__more", "__id", "__print", "__good", "h1", "h2", "id", "of", "body", "more", "print", "instance", "pattern", "fp", "kind", "first", "none", "root", "node", "anchor", "copy", "part", "item_id", "a.b", "a`b", "spans", "mentions", "n_words", "words", "lines"]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_no_column_of_the_caller_is_lost(spark, bound, monkeypatch):
    """Columns of every name that a stage uses inside, a map, a struct with a map and a null item id, through four stages."""
    monkeypatch.setattr(pii, "BROADCAST", bound)
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(6)]
    texts[3] = texts[3] + " write to a.b@c.org or call me at +1 (555) 010-1234 now"
    item = prose(rng, 30)
    rows = [(i, t, len(t)) for i, t in enumerate([*texts, texts[0], texts[5] + " " + item])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").repartition(3)
    docs = docs.selectExpr("*", *(f"concat('keep {k} ', doc_id) AS `{n.replace('`', '``')}`" for k, n in enumerate(RESERVED)), "map('k', doc_id) AS m", "named_struct('x', map(1, 'v')) AS s")
    bench = spark.createDataFrame([(None, item), (None, None), (4, "")], "item_id bigint, text string")
    second = simhash.keep_one(quality.filter_quality(docs))
    third = decontaminate.clean(second, bench)
    fourth = pii.redact(third)
    assert fourth.schema.fieldNames() == docs.columns and [f.dataType for f in fourth.schema] == [f.dataType for f in docs.schema]
    got = {r[0]: r for r in fourth.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and "<email>" in got[3][1] and "<phone>" in got[3][1]
    for i, r in got.items():
        assert r[2] == len(r[1]) and list(r[3:-2]) == [f"keep {k} {i}" for k in range(len(RESERVED))] and r[-2] == {"k": i} and r[-1][0] == {1: "v"}
    hits = decontaminate.contamination(docs, bench, keep=["doc_id", "__text", "__row", "m"]).collect()
    assert [(r[0], r[1], r[2], r[3], r["item_id"]) for r in hits] == [(7, "keep 2 7", "keep 1 7", {"k": 7}, None)]


def test_kept_columns_of_scores(spark):
    """Learned operators return kept columns as they are, whatever their names."""
    docs = spark.createDataFrame([(1, "the text of one", "x", True), (2, None, "y", None)], "doc_id bigint, text string, __text string, __target boolean")
    keep = ["doc_id", "__text", "__target"]
    want = [(1, "x", True), (2, "y", None)]
    assert sorted(tuple(r)[:3] for r in toxicity.score(docs, toxicity.fit([], [], {}), keep=keep).collect()) == want
    assert sorted(tuple(r)[:3] for r in langid.identify(docs, langid.fit([], []), keep=keep).collect()) == want
    assert sorted(tuple(r)[:3] for r in lmscore.score(docs, lmscore.train(docs.withColumn("target", docs.doc_id == 1)), keep=keep).collect()) == want
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    named = lmscore.targets(docs.withColumnRenamed("__text", "__good").withColumnRenamed("__target", "target"), labels, name="wanted").collect()
    assert sorted((r.doc_id, r["__good"], r.target, r.wanted) for r in named) == [(1, "x", True, True), (2, "y", None, False)]
