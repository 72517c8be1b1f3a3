"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random

import pytest

from pairscope.operators import neardup as N
from pairscope.storage import settle


def shingles(text, k=5):
    words = text.split()
    return {tuple(words[i : i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1)} if words else set()


def links(texts, k=5, least=0.8):
    sets = [shingles(t, k) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}


def brute(rows):
    """(key, copy_of, class_id) by comparing every two texts."""
    plain = {i: " ".join(t.lower().split()) for i, (k, t) in enumerate(rows) if k is not None and t is not None}
    first = {}
    for i in plain:
        first[plain[i]] = min(first.get(plain[i], rows[i][0]), rows[i][0])
    texts = list(first)
    root = {first[t]: first[t] for t in texts}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links(texts):
        a, b = up(first[texts[i]]), up(first[texts[j]])
        root[max(a, b)] = min(a, b)
    return sorted(((k, first[plain[i]], up(first[plain[i]])) if i in plain else (k, k, k) for i, (k, _) in enumerate(rows)), key=repr)


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 150))] + (passage if rng.random() < 0.6 else [])
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            base = copy if rng.random() < 0.3 else base  # chains, whose ends are no near copies
            rows.append(" ".join(copy))
    rows += [rows[0].upper() + " \n", "", " ", "one", "One", "a b", "a b c d e f", "a b c d e f g"]
    return [(None if rng.random() < 0.03 else i, None if rng.random() < 0.03 else t) for i, t in enumerate(rows)] + [(3, rows[5]), (3, rows[5])]


@pytest.mark.parametrize("seed, part", [(1, 500), (2, 2)])
def test_classes_equal_all_pairs(spark, seed, part, monkeypatch):
    monkeypatch.setattr(N._across, "__defaults__", (part,))
    monkeypatch.setattr(N.verified, "__defaults__", (part,))
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "key int, text string").selectExpr("*", "'x' as id", "1 as label", "2 as token").repartition(3)
    assert sorted(map(tuple, N.near_classes(df, "text", "key").collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_no_link_is_missed_by_the_index(spark, seed):
    """Every two similar texts share an indexed shingle, also where common shingles are put last."""
    texts = list(dict.fromkeys(" ".join(t.split()) for _, t in near_copies(seed, 25) if t))
    single = settle(spark.createDataFrame(list(enumerate(texts)), "id int, t string"))
    own: dict = {}
    for r in N.index(single, 5, 0.8).collect():
        own.setdefault(r["id"], set()).add(r["token"])
    assert len(N.common_shingles(single, 5)) > 0
    assert all(own[a] & own[b] for a, b in links(texts))
    assert all(len(own[i]) == N.prefix_size(len(shingles(t)), 0.8) for i, t in enumerate(texts) if shingles(t))


def test_texts_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """Texts with a long passage in common share indexed shingles; their sketches keep them from being compared."""
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        passage = words(120)
        rows += [" ".join(words(40) + passage + words(40)) for _ in range(2)]
    met, real = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *more: met.append(pairs.count()) or real(pairs, *more))
    rows = list(enumerate([*rows, rows[0] + " end"]))
    got = N.near_classes(spark.createDataFrame(rows, "key int, text string"), "text", "key").collect()
    assert sorted(map(tuple, got)) == [(i, i, i) for i in range(80)] + [(80, 80, 0)]
    assert sum(met) < 10


def test_sketches_rule_out_no_similar_text():
    rng = random.Random(7)
    hashes = [h for n in (1, 3, 90, 700) for h in N.shingle_hashes([" ".join(f"w{rng.randrange(900)}" for _ in range(n)).encode() for _ in range(3)], 5)]
    hashes += [h[: max(1, int(len(h) * 0.9))] for h in hashes]
    for a in hashes:
        for b in hashes:
            assert N.differing(N.sketch(a), N.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_hashes_do_not_depend_on_the_texts_beside():
    texts = [b"", b"a", "abcdefgh ijklmnopq".encode(), "é ü ".encode() * 9 + b"x" * 70, b"a b c d e f a b c d e"]
    together = [h.tolist() for h in N.shingle_hashes(texts, 5)]
    assert together == [h.tolist() for t in texts for h in N.shingle_hashes([t], 5)]
    assert [len(h) for h in together] == [len(shingles(t.decode())) for t in texts]


def test_labels_repeat_rows_as_the_adapter_does(spark):
    from pairscope.plans.quality import near_claims

    documents = spark.createDataFrame([(1, "a b", 0), (2, "A  b", 0), (3, None, 0), (None, "c", 0)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 1), (9, 1), (None, 1)], "doc_id long, quality int")
    got = near_claims(documents, labels)
    assert got.columns == ["claim_id", "copy_of", "class_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 3, 3), (None, None, None)], key=repr)


def test_nothing(spark):
    assert N.near_classes(spark.createDataFrame([], "key int, text string"), "text", "key").count() == 0
    got = N.near_classes(spark.createDataFrame([(1, None), (2, None), (None, "a")], "key int, text string"), "text", "key").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 1, 1), (2, 2, 2), (None, None, None)]


@pytest.mark.parametrize("part", [2048, 4])
def test_alike_texts_are_one_class(spark, part):
    """Classes of chains of texts alike in 3-grams, over blocks of any size, against all pairs; a row a row, never a pair."""
    from pairscope.operators import dedup as D

    rng = random.Random(5)
    rows = []
    for _ in range(7):
        text = [rng.choice("abcdefghijklm ") for _ in range(rng.choice([60, 240, 250]))]
        for _ in range(rng.choice([1, 5, 9])):
            for at in rng.sample(range(len(text)), rng.randint(1, len(text) // 40)):
                text[at] = rng.choice("0123456789é")
            rows.append((len(rows) * 17 % 53, "".join(text)))
    rows += [(60, rows[0][1].upper()), (61, None), (62, ""), (63, " "), (64, "ab"), (65, "AB"), (None, "ab")]
    plain = {k: " ".join(t.lower().split()) for k, t in rows if k is not None and t is not None}
    sets = {k: {t[i : i + 3] for i in range(max(1, len(t) - 2))} for k, t in plain.items()}
    root = {k: k for k in plain}
    for a in sorted(plain):
        for b in sorted(plain):
            if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = [(k, min(j for j in plain if plain[j] == plain[k]), root[k]) if k in plain else (k, k, k) for k, _ in rows]
    got = D.near_texts(spark.createDataFrame(rows, "key int, text string"), "text", "key", part=part).collect()
    assert len({r for r in root.values()}) < len(plain) - 12
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def two_languages(rng, texts=48):
    """Texts of one size in two alphabets, a few of them near copies."""
    rows = []
    for k in range(texts):
        letters = ("abcdef", "uvwxyz")[k % 2]
        text = [rng.choice(letters) for _ in range(300)]
        rows.append("".join(text))
        if k % 6 < 2:
            text[rng.randrange(300)] = letters[0] * 2
            rows.append("".join(text))
    return rows


def test_blocks_of_two_languages_do_not_meet(spark):
    from pairscope.operators import dedup as D

    rows = two_languages(random.Random(3))
    sets = [set(D.grams(t).tolist()) for t in rows]
    single = settle(spark.createDataFrame(list(enumerate(rows)), "id int, t string"))
    held = D.blocks(single, 0.85, 8, False)
    language = {r["block"]: {rows[i][0] < "m" for i in r["ids"]} for r in held.collect()}
    assert len(language) >= 8 and all(len(x) == 1 for x in language.values())
    met = D.meeting(held, 0.85, False).select("block", "other").collect()
    assert met and all(language[r["block"]] == language[r["other"]] for r in met)
    want = {(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    got = D.links(D.blocks(single, 0.85, 8, True), 0.85, True).selectExpr("least(a, b) a", "greatest(a, b) b").collect()
    assert len(want) == 16 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("bits", [1 << 16, 0])
def test_sets_are_counted_exactly_and_only_when_sketches_are_near(bits, monkeypatch):
    import numpy as np
    from pairscope.operators import dedup as D

    monkeypatch.setattr(D, "BITS", bits)
    rng = random.Random(9)
    vary = lambda base, k: np.unique(np.array([x if i % 40 >= k else rng.randrange(10**9) for i, x in enumerate(base)]))
    bases = [[rng.randrange(10**9) for _ in range(rng.choice([40, 300, 1500]))] for _ in range(6)]
    make = lambda: sorted((vary(b, rng.choice([0, 1, 3, 5])) for b in bases for _ in range(7)), key=len)
    one, two = make(), make()
    a, b = (D.Block.opened(*D.Block.of(x).packed()) for x in (one, two))
    for x, y, left, right in ((a, b, one, two), (a, a, one, one)):
        got = {(i, j): s for i, js, found in D.similar(x, y, 0.85, True) for j, s in zip(js.tolist(), found.tolist(), strict=True)}
        want = {}
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                both = len(set(p.tolist()) & set(q.tolist()))
                if (x is not y or i < j) and both >= 0.85 * (len(p) + len(q) - both):
                    want[i, j] = both / (len(p) + len(q) - both)
        assert want and got == pytest.approx(want)
    far = D.Block.opened(*D.Block.of([np.unique([rng.randrange(10**9) for _ in range(300)]) for _ in range(20)]).packed())
    assert not list(D.similar(b, far, 0.85, True)) and isinstance(far._sets, bytes)
