"""The corpus operators against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from conftest import SF
from pairscope.llm import decontaminate, langid, lmscore, packing, pii, quality, quotes, registry, simhash, substrings, toxicity
from pairscope.llm.common import rolling

#: Null, empty, blank, tie, repeated and very long texts.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five"), (6, "one two three four five"), (6, "one two three four five"), (7, "word " * 30_000), (8, "été İs ﬁ   \x1c ΑΣ <|endoftext|> it's"), (None, "a null id with some words in it")]
SCHEMA = "doc_id bigint, text string"


def table(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS fp", "1 AS seed", "2 AS kind", "cast(null AS int) AS n_words") if extra else df


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(18, 70))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((d * 7 % 61, "\n".join(parts)))
    return rows + rows[:3]


# 5: quality


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("rows", [AWKWARD, corpus()])
def test_quality(spark, rows):
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(table(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_quality(t) for _, t in rows)
    kept = quality.filter_quality(table(spark, rows))
    assert kept.columns == table(spark, rows).columns


# 7: SimHash


def brute_components(rows):
    prints = [simhash.fingerprint(t.encode() if t else None) for _, t in rows]
    first = list(range(len(rows)))

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                first[b] = a
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return prints, [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("rows", [AWKWARD, corpus()])
def test_simhash(spark, rows):
    prints, roots = brute_components(rows)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.classes(table(spark, rows)).collect()), key=repr)
    assert got == sorted(((d, int(np.uint64(p).view(np.int64)), c) for (d, _), p, c in zip(rows, prints, roots, strict=True)), key=repr)


def test_keep_one_of_each_class(spark):
    """Null ids, repeated ids and null columns: every class of texts keeps one row, whichever way the rows are dealt."""
    rng = random.Random(6)
    texts = [" ".join(f"t{k}w{rng.randrange(50)}" for _ in range(60)) for k in range(7)]
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (None, texts[5]), (9, texts[5]), (8, texts[5]), (5, texts[3]), (6, None), (None, None), (5, texts[6])]
    assert len({root for root in brute_components([(i, t) for i, (_, t) in enumerate(rows)])[1]}) == 8
    want = sorted([(1, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (8, texts[5]), (5, texts[6]), (6, None)], key=repr)
    for order in (rows, rows[::-1]):
        docs = table(spark, order).repartition(5)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want


def test_fingerprint_by_hand():
    import xxhash

    for _, text in corpus(3, 20) + AWKWARD[:9]:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        assert simhash.fingerprint((text or "").encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_of_planted_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    points = [base]
    for k in range(1, 6):
        near = base[:150].copy()
        for i in range(150):
            for b in rng.choice(64, k, replace=False):
                near[i] ^= np.uint64(1 << int(b))
        points.append(near)
    hub = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # one dense group
    points = np.unique(np.concatenate([*points, hub]))
    df = spark.createDataFrame([(int(v),) for v in points.view(np.int64)], "fp bigint")
    place = {int(v): i for i, v in enumerate(points.view(np.int64))}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    want = simhash.merge(np.arange(len(points)), *np.nonzero(near))
    for hot, blocks in ((20_000, None), (10, None), (10, simhash.layouts()[1])):
        links = simhash.near_links(df, hot=hot, blocks=blocks).collect()
        got = simhash.merge(np.arange(len(points)), np.array([place[x.a] for x in links]), np.array([place[x.b] for x in links]))
        assert (got == want).all()


# 10: passages


def brute_passages(rows):
    texts = {d if d is not None else substrings.NO_ID: (t or "").encode().split() for d, t in rows}
    first, out = {}, {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 19):
            first.setdefault(tuple(texts[d][i : i + 20]), (d, i))
    for d, w in texts.items():
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i) for j in range(i, i + 20)}
        out[d] = len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
    return out


@pytest.mark.parametrize("part,batch", [(5000, 10_000), (2, 3)])
@pytest.mark.parametrize("rows", [AWKWARD, corpus(), corpus(2)])
def test_passages(spark, rows, part, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        want = brute_passages(rows)
        got = substrings.dedup_passages(table(spark, rows), part=part).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id if r.doc_id is not None else substrings.NO_ID] == (r.n_words, r.n_removed, r.kept_sha256)


# 2: decontamination


def test_contamination(spark):
    rows = [(d + 100, t) for d, t in corpus()]
    items = [(1, rows[4][1]), (2, " ".join(rows[9][1].split()[5:30]).upper()), (3, None), (4, "?!"), (5, "w1 w2"), (6, "never seen words in any text at all"), (7, rows[9][1] + " extra")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    shingle = lambda t: set(decontaminate.shingles(decontaminate.words_of((t or "").encode())))
    want = set()
    for d, t in rows + AWKWARD:
        words = decontaminate.words_of((t or "").encode())
        for i, body in items:
            s = shingle(body)
            k = len(next(iter(s)).split()) if s else 0
            own = {b" ".join(words[j : j + k]) for j in range(len(words) - k + 1)}
            if s and 5 * len(s & own) >= 4 * len(s):
                want.add((d, i, len(s), len(s & own)))
    for limit in (2_000_000, 10):
        got = decontaminate.contamination(table(spark, rows + AWKWARD), bench, limit=limit)
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in got.collect()} == want
    clean = decontaminate.clean(table(spark, rows + AWKWARD), bench, limit=10)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows + AWKWARD} - {w[0] for w in want}


# 3: personal data


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        odd, even = digits[-1::-2], digits[-2::-2]
        if 14 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    bits = ["1.2.3.4", "255.", "300", "a@b.c", "@", "+1", "4111111111111111", "-", " ", ".", "001", "0000255", "x", "378282246310005", "(555) 123-4567", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_discovery_and_redaction(spark):
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} now") for i in range(6)] + [(10, "please call me at 5550107788 now"), (11, "ref 5550107788 again"), (12, "order 123456 shipped")] + AWKWARD[:3]
    got = {r.doc_id: (r.spans, r.n_phone) for r in pii.extract(table(spark, rows)).collect()}
    assert got[10] == ("phone:18:28", 0) and got[11] == ("phone:4:14", 0) and got[12] == ("", 0) and got[0] == ("phone:18:35", 1)
    redacted = {r.doc_id: r.text for r in pii.redact(table(spark, rows)).collect()}
    assert redacted[11] == "ref <phone> again" and redacted[12] == "order 123456 shipped" and redacted[1] is None


# 8: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = AWKWARD[:9] + [(100 + i, t) for i, (_, t) in enumerate(corpus(7, 40))]
    whole = Tokenizer.from_file(packing.default_path())
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(table(spark, rows).coalesce(2), packing.default_path()).collect():
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, copies in ids.items():
        count = np.zeros(len(copies[0]), int)
        for start, length in pieces[d]:
            count[start : start + length] += 1
        assert (count == len(copies)).all()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


# 9, 1, 6: learned operators


def test_language_codes():
    code = langid.codewords(9)
    assert code.shape[0] == 9 and min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "tzer", "ung"], "cc": ["ção", "nho", "eira"]}
    text = lambda v: " ".join("".join(rng.choice(parts[v]) for _ in range(3)) for _ in range(20))
    langs = [rng.choice(list(parts)) for _ in range(150)]
    model = langid.fit([text(v) for v in langs], langs)
    held = [rng.choice(list(parts)) for _ in range(50)]
    assert all(model.predict(text(v))[0] == v for v in held)
    assert model.predict(None)[:2] == ("und", 0.0) and model.predict("12 !")[0] == "und"


def test_langid_held_out(spark):
    rows = registry.QUERIES["op9_language_codes"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == len(lang) and all(r.held_out == (r in held) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    empty = langid.identify(table(spark), langid.fit([], []))
    assert {(r.lang_pred, r.score) for r in empty.collect()} == {("und", 0.0)}


def test_toxicity_model():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(1200):
        body = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            body[rng.randrange(40)] = rng.choice(["idiot", "zorgling"])
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:1000], labels[:1000], {0: 750, 1: 250})
    scores = model.score(texts[1000:])
    assert ((scores >= 0.5) == np.array(labels[1000:], bool)).mean() > 0.95
    assert 0 <= model.score(["", None])[1] <= 1 and (np.diff(model.knots[1]) >= 0).all()
    assert toxicity.fit([], [], {}).score(["x"])[0] == 0.0


def test_toxicity_query(spark):
    rows = toxicity.op1(spark, "/root/testdata/sf0.01").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)


def test_lm_scores(spark):
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(50))) for i in range(80)] + AWKWARD[:3]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60, 2)], "doc_id bigint, quality int")
    docs = lmscore.targets(table(spark, rows), labels)
    model = lmscore.train(docs.filter("doc_id < 60"))
    got = {r.doc_id: r for r in lmscore.score(docs.filter("doc_id >= 60 OR doc_id <= 3"), model).collect()}
    assert all((got[i].difference < 0) == (i % 2 == 1) for i in range(60, 80))
    # counts by hand
    single = Counter(w for i, t in rows if i is not None and i < 60 and t for w in t.split())
    assert model.tokens.sum() > 0 and round(float(model.words.sum() / model.scale.max()), 0) <= sum(single.values())
    one = lmscore.score(docs.filter("doc_id = 3"), model).first()
    assert one.n_tokens in (0, 50)


def brute_losses(rows, good, size_of=lambda words: len(words) + 1):
    """By place of the row: the two mean losses, by dictionaries of exact counts, each row left out of its own model."""
    texts = [(t or "").lower().split() for _, t in rows]
    side = [0 if d in good else 1 for d, _ in rows]
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    for k, w in zip(side, texts, strict=True):
        single[k].update(w)
        pair[k].update(zip(w, w[1:], strict=False))
    total = [sum(c.values()) for c in single]
    size = size_of(set(single[0]) | set(single[1]))
    out = []
    for own, w in zip(side, texts, strict=True):
        losses = []
        for k in (0, 1):
            scale = min(total) / total[k]
            s, p, t = single[k], pair[k], total[k]
            if own == k:
                s, p, t = s - Counter(w), p - Counter(zip(w, w[1:], strict=False)), t - len(w)
            sum_ = 0.0
            for i, x in enumerate(w):
                plain = (s[x] * scale + 0.5) / (t * scale + 0.5 * size)
                before = max(s[w[i - 1]], p[w[i - 1], x]) if i else 0
                sum_ -= np.log(0.7 * p[w[i - 1], x] / before + 0.3 * plain if before else plain)
            losses.append(sum_ / len(w) if w else None)
        out.append((len(w), *losses))
    return out


def test_lm_counts_are_exact(spark):
    """More distinct pairs than cells of a hashed table once had: no two of them share a count."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(12) if rng.random() < 0.5 else rng.randrange(9000)}" for _ in range(rng.randint(1, 900)))) for i in range(90)]
    rows += [(3, "w1 w2 w1"), (None, "w1 w2 W3"), (200, ""), (201, None)]
    good = {i for i in range(0, 90, 3)}
    docs = lmscore.targets(table(spark, rows), spark.createDataFrame([(i, 1) for i in good], "doc_id bigint, quality int"))
    model = lmscore.train(docs)
    assert model.pairs.count() > 1 << 14
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.score(docs, model, target="target").collect()), key=repr)
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute_losses(rows, good), strict=True)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == w[2:] if w[2] is None else np.allclose(g[2:], w[2:], rtol=1e-9), (g, w)


# 4: quotes


QUOTES = [(1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "> Hello there\nHi!\n"), (1, 2, "a", "> > Hello THERE\n> Hi!\nbye"), (1, 3, "b", ">How are you?\n\tfine"), (1, 4, "c", "> unknown\nwell"), (2, 0, "a", None), (2, 1, "b", "> Hi!"), (None, 0, "x", "> Hi!"), (1, 5, None, ">   >>Hi!\n> bye\n"), (1, 5, None, ">   >>Hi!\n> bye\n")]


def test_quotes(spark):
    df = spark.createDataFrame(QUOTES, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link(df.selectExpr("*", "'x' AS lines", "1 AS clean")).collect()}
    assert (got[1, 1].parent_turn, got[1, 2].parent_turn, got[1, 3].parent_turn, got[1, 5].parent_turn) == (0, 1, 0, 2)
    assert (got[1, 2].root_turn, got[1, 2].depth, got[1, 5].depth) == (0, 2, 3)
    assert got[1, 4].parent_turn is None and got[2, 1].parent_turn is None and got[1, 2].clean_text == "bye"
    assert got[1, 5].max_level == 3 and got[2, 0].clean_text == ""


def test_rewrapped_quotes(spark):
    rows = [(1, 0, "Thanks!"), (1, 1, "The quick brown fox jumps\nover the lazy dog.\n\nThanks!\nBest, A"), (1, 2, "> The quick brown\n> fox jumps over the\n> lazy dog.\n>\n> Thanks!\n> Best, A\nyes"), (1, 3, ">> the quick brown fox\n>> jumps over the lazy dog.\n> yes\nno"), (1, 4, "> over the lazy dog.\n> unknown")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.parent_turn, r.n_linked_lines, r.root_turn, r.depth) for r in quotes.link(df).collect()}
    assert got == {0: (None, 0, 0, 0), 1: (None, 0, 1, 0), 2: (1, 5, 1, 1), 3: (2, 3, 1, 2), 4: (1, 1, 1, 1)}


# registry, empty tables, pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), registry.QUERIES[name], registry.ORACLES[name], SF) is None


def test_empty(spark):
    empty = table(spark, [])
    assert quality.assess(empty).count() == 0
    assert simhash.classes(empty).count() == 0
    assert substrings.dedup_passages(empty).count() == 0
    assert pii.extract(empty).count() == 0
    assert packing.pack(empty, packing.default_path()).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert quotes.link(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    _, quality_stage = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in quality_stage(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in quality.assess(docs).collect() if r.kept}
    rows = [(d, texts[d].text) for d in sorted(kept)]
    roots = brute_components(rows)[1]
    single = {d for (d, _), root in zip(rows, roots, strict=True) if d == root}
    dirty = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == single - dirty
    whole = packing.tokens(packing.default_path())
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    for d in single - dirty:
        text = texts[d].text
        redacted = pii.redacted(text, pii.base_spans(text))
        assert tokens[d] == len(whole.ids(redacted.encode())) // 2 + 1


def test_rolling():
    a = np.arange(10, dtype=np.uint64)
    assert rolling(a, 3)[4] == rolling(a[4:7], 3)[0] and len(rolling(a, 11)) == 0


def test_quotes_in_sql(spark):
    """The SQL twin on quotes that the driver's table does not hold: re-wrapped, nested, repeated, by single lines."""
    import duckdb
    import pandas as pd

    rng = random.Random(4)
    rows = [(1, 0, "a", "Thanks!"), (1, 1, "b", "The quick brown fox jumps\nover the lazy dog.\n\nThanks!\nBest, A"), (1, 2, "a", "> The quick brown\n> fox jumps over the\n> lazy dog.\n>\n> Thanks!\n> Best, A\nyes"), (1, 3, "b", ">> the quick brown fox\n>> jumps over the lazy dog.\n> yes\nno"), (1, 4, "a", "> over the lazy dog.\n> unknown"), *((c, t, r, x) for c, t, r, x in QUOTES if c is not None)]
    lines = [" ".join(rng.choice("abcde") * 3 for _ in range(rng.randint(1, 6))) for _ in range(12)]
    for c in range(20, 50):
        rows += [(c, t, "r", "\n".join(rng.choice(["", "> ", ">> ", "> > > "]) + rng.choice([*lines, ""]) for _ in range(rng.randint(0, 7)))) for t in range(rng.randint(1, 6))]
    con = duckdb.connect()
    con.register("held", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    con.sql("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM held")
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = con.sql(quotes.OP4_SQL)
    got = quotes.link(df).drop("clean_text")
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got.columns, got.collect()) == oracle.rows(want.columns, want.fetchall())


def test_stretches_of_documents_end_to_end():
    """Documents that are searched together have the stretches that each has alone, and no window runs over an end."""
    rng = random.Random(3)
    docs = [b" ".join(b"w%d" % rng.randrange(30) for _ in range(n)) for n in (19, 20, 1, 300, 45, 20, 19, 64)] + ["日本 é".encode() * 30, b"x" * 9000]
    whole = substrings.Chunk(docs)
    seeds, which, first, n = whole.stretches(20, 8)
    got = sorted(zip(which.tolist(), first.tolist(), n.tolist(), seeds.tolist(), whole.passages(which, first, n, 20), strict=True))
    want = []
    for d, doc in enumerate(docs):
        one = substrings.Chunk([doc])
        s, w, f, k = one.stretches(20, 8)
        want += zip([d] * len(s), f.tolist(), k.tolist(), s.tolist(), one.passages(w, f, k, 20), strict=True)
        assert sum(k) == max(0, len(doc.split()) - 19) and all(p == b" ".join(doc.split()[a : a + m + 19]) for p, a, m in zip(one.passages(w, f, k, 20), f, k, strict=True))
    assert got == sorted(want) and len(got) > 40


def test_remembered_words_are_bounded_and_ids_stay_the_same(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    coder = packing.Tokens(packing.default_path())
    words = [f"{a}{b}" for a in ("Re", "un", "über", "x-", "don't", "7", "<|") for b in ("act", "Known", "mark,", "(9)", "s", "42", "é")]
    for text in [" ".join(words[i::3]) for i in range(3)] * 2:
        assert np.frombuffer(coder.ids(text.encode()), "<u2").tolist() == coder.whole.encode(text, add_special_tokens=False).ids
        kept = [d for d in vars(coder).values() if isinstance(d, dict) and all(isinstance(v, bytes) for v in d.values())]
        assert len(coder) + sum(map(len, kept)) <= 40
