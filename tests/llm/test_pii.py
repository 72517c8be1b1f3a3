"""Contextual extraction against brute force over its graph, on planted identifiers, and on awkward rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from pairscope.llm import pii

NAMES = ["row", "text"]


def brute_instances(texts: list[str], rounds=pii.ROUNDS, growth=None) -> dict[str, int]:
    """token -> kind by plain loops over all mentions; patterns and tokens as text."""
    contexts = defaultdict(set)
    kind_of: dict[str, int] = {}
    for text in texts:
        spans = pii.base_spans(text)
        own = [(s, e, k) for s, k, e in spans]
        for word in __import__("re").finditer(r"\S+", text):
            s, e = word.span()
            while s < e and not text[s].isalnum():
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            token = text[s:e]
            if e - s >= 5 and ("@" in token or sum(c.isdigit() for c in token) >= 4) and not any(a < e and b > s for a, b, _ in own):
                own.append((s, e, -1))
        for s, e, k in own:
            token = text[s:e].lower()
            kind_of[token] = max(kind_of.get(token, -1), k)
            contexts[token].add(tuple(pii.Contexts(text).patterns(s, e)))
    holds = defaultdict(set)
    for token, found in contexts.items():
        for patterns in found:
            for p in patterns:
                holds[p].add(token)
    score = {t: (k, 1.0) for t, k in kind_of.items() if k >= 0}
    named: dict[str, tuple[int, float]] = {}
    for turn in range(rounds):
        fresh = {}
        grows = growth is not None and turn < rounds - 1
        needed, trusted = (growth, pii.BELIEF * growth / pii.CONFIDENCE) if grows else (pii.CONFIDENCE, pii.BELIEF)
        for token, k in kind_of.items():
            if k >= 0:
                continue
            best = None
            for kind in range(len(pii.KINDS)):
                total = whole = 0.0
                for patterns in contexts[token]:
                    known = [p for p in patterns if len(holds[p]) > pii.SUPPORT]
                    whole += 1.0 if known else pii.RARE
                    sure = [0.0]
                    for p in known:
                        rest = sum(v for t in holds[p] if t != token and t in score | named and (w := (score | named)[t])[0] == kind for v in [w[1]])
                        if rest >= pii.SUPPORT - 1e-9 and rest / (len(holds[p]) - 1) >= needed - 1e-9:
                            sure.append(rest / (len(holds[p]) - 1))
                    if not grows or max(sure) >= pii.CONFIDENCE - 1e-9 or len(sure) > pii.AGREE:
                        total += max(sure)
                if total / whole >= trusted - 1e-9 and (best is None or total / whole > best[1] + 1e-12):
                    best = (kind, total / whole)
            if best:
                fresh[token] = best
        named = fresh
    return {t: k for t, (k, _) in named.items()}


def planted(seed: int, n: int = 240, every: int = 16, decoys: tuple = ()) -> tuple[list[tuple[int, str]], set[str], set[str]]:
    """Texts with base entities in set phrases, identifiers of other forms in the same phrases, and numbers that are none.
    One row in `every` has such an identifier; decoys are more words that stand before numbers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    phrases = {3: [("call me at", "tonight"), ("phone number is", "ok")], 0: [("write to", "soon"), ("mail address", "thanks")], 1: [("connect from host", "via"), ("server at", "port")]}
    seed_of = {3: lambda: f"+1 (555) 010-{rng.randint(1000, 9999)}", 0: lambda: f"{word()}@{word()}.org", 1: lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))}
    other = {3: lambda: f"555{rng.randint(1000000, 9999999)}", 0: lambda: f"{word()}_{rng.randint(1000, 9999)}@local", 1: lambda: f"node{rng.randint(1000, 9999)}x{rng.randint(10, 99)}"}
    rows, identifiers, numbers = [], set(), set()
    for i in range(n):
        kind = rng.choice([0, 1, 3])
        left, right = rng.choice(phrases[kind])
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 9))), " ".join(word() for _ in range(rng.randint(0, 9)))
        if i % every == 0:
            token = other[kind]()
            identifiers.add(token.lower())
            rows.append((i, f"{lead} {left} {token} {right} {tail}"))
            rows.append((10_000 + i, f"{word()} {token} {word()}"))
        elif i % every == 1:
            token = str(rng.randint(10_000, 999_999))
            numbers.add(token)
            rows.append((i, f"{lead} {rng.choice(['order', 'in year', 'page', *decoys])} {token} {word()} {tail}"))
        else:
            rows.append((i, f"{lead} {left} {seed_of[kind]()} {right} {tail}"))
    return rows, identifiers, numbers


def found_tokens(spark, rows, growth=None) -> dict[str, int]:
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS kind", "1 AS pattern", "2 AS instance", "3 AS row").repartition(3)
    out = {}
    scanned = pii.scan(df)
    for r in pii.discovered(scanned, pii.instances(scanned, growth=growth)).collect():
        out[texts[r.doc_id][r.start : r.end].lower()] = r.kind
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_scores_by_brute_force(spark, seed):
    rows, _, _ = planted(seed)
    rng = random.Random(seed)
    rows += [(5000 + i, " ".join(rng.choice(["at", "is", "to", "12345", "a1234", "9.9.9.9", "x@y.z", "77777", "me"]) for _ in range(12))) for i in range(40)]
    assert found_tokens(spark, rows) == brute_instances([t for _, t in rows])


def test_precision_and_recall(spark):
    """Unseen identifiers in known contexts (one in fifteen there) are found, wherever else they stand; numbers elsewhere are not."""
    rows, identifiers, numbers = planted(7, 640)
    got = set(found_tokens(spark, rows))
    assert len(got & identifiers) >= 0.95 * len(identifiers) and len(got & identifiers) >= 0.95 * len(got)
    assert not got & numbers
    redacted = pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert not any(token in r.text.lower() for r in redacted for token in got)


def test_one_trusted_context_among_many_rare_ones(spark):
    """A token in one trusted and ten rare contexts is no identifier, as the rare ones count too."""
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} now") for i in range(9)] + [(50, "please call me at 55512349 now")]
    assert found_tokens(spark, rows) == {"55512349": 3}
    assert found_tokens(spark, rows + [(60 + i, f"w{c}x 55512349 z{c}y") for i, c in enumerate("abcdefghij")]) == {}


@pytest.mark.parametrize(("bound", "hot"), [(pii.BROADCAST, pii.HOT), (7, 20)])
def test_growth_by_brute_force(spark, monkeypatch, bound, hot):
    """Growth rounds as plain loops have them, hot patterns broadcast and others joined or all of them broadcast."""
    rows, _, _ = planted(4, 240, 7, ("order number is", "room at"))
    want = brute_instances([t for _, t in rows], growth=pii.GROWTH)
    monkeypatch.setattr(pii, "BROADCAST", bound)
    monkeypatch.setattr(pii, "HOT", hot)
    assert found_tokens(spark, rows, pii.GROWTH) == want and want


def test_recall_where_one_in_seven_is_of_no_base_form(spark):
    """Growth finds what one rule for all rounds leaves, and names no more of the numbers that share words with identifiers."""
    for seed, decoys in ((1, ()), (5, ("order number is",)), (2, ("order number is", "room at"))):
        rows, identifiers, numbers = planted(seed, 640, 7, decoys)
        got, plain = set(found_tokens(spark, rows, pii.GROWTH)), brute_instances([t for _, t in rows])
        assert len(got & identifiers) >= 0.95 * len(identifiers)
        assert len(got & numbers) <= len(set(plain) & numbers)
    spans = pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert spans.agg({"n_discovered": "sum"}).first()[0] >= len(got)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_joined_and_broadcast_agree(spark, bound, monkeypatch):
    rows, _, _ = planted(3)
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1]), (7, None), (8, ""), (rows[2][0], "another text of the same id 12345678"), (9, "x" * 300_000 + " call me at 5551112223 tonight")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "length(text) AS n_chars", "'a' AS kind", "1 AS `a b`")
    plain = sorted((repr(tuple(r)) for r in pii.redact(df).collect()))
    monkeypatch.setattr(pii, "BROADCAST", bound)
    held = pii.redact(df)
    assert held.columns == df.columns and sorted(repr(tuple(r)) for r in held.collect()) == plain and len(plain) == len(rows)
    spans = sorted(repr((r.doc_id, r.spans)) for r in pii.extract(df).collect())
    monkeypatch.undo()
    assert spans == sorted(repr((r.doc_id, r.spans)) for r in pii.extract(df).collect())


def test_long_token_and_many_spans(spark):
    """A candidate of any length counts, and one that overlaps any of many base spans does not."""
    token = "a1" * 50_000
    rows = [(i, f"call me at +1 (555) 010-{1000 + i} now") for i in range(9)] + [(20, f"call me at {token} now")]
    assert found_tokens(spark, rows) == {token: 3}
    text = "1.1.1.1@a.b," * 9 + "12345"
    spans = pii.base_spans(text)
    assert all(not (s < b and e > a) for s, e, k, *_ in pii.mentions(text, spans) if k < 0 for a, _, b in spans)
