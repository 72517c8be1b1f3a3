"""Personal data: bootstrapped contextual extraction.

One scan finds the base entities (e-mail, IP, card, phone) by their forms and, around them and around other tokens that
look like identifiers, their contexts. A context gives patterns: the two words before, the word before, the word after,
both words beside, and the token's shape with either. Seeds (base entities) induce patterns; a graph of patterns and
instances is scored in rounds, each a few aggregates over its distinct edges. High-confidence patterns name further
identifiers, which are then marked wherever they occur.

A pattern is judged for an instance by its other instances only: the share of them believed to be of a kind, where that
is CONFIDENCE or more and they weigh SUPPORT or more. A context is worth its best pattern. An instance's score is the mean
over its distinct contexts; a context none of whose patterns has more than SUPPORT instances says little, and counts RARE.

Where many identifiers are not of a base form they are what keeps a pattern from CONFIDENCE. So before the last round a
context also counts if AGREE of its patterns, more than see the words of one side alone, reach GROWTH each; what such
rounds name makes patterns surer, and only what the last round names by full confidence is reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairscope.llm.common import packed, read, settle

KINDS = ["email", "ip", "card", "phone"]
#: Rounds; other instances a pattern needs; confidence a pattern and an instance need; weight of a context of rare patterns.
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8
BELIEF = 0.6
RARE = 0.25
#: Before the last round: confidence of each pattern, and how many of a context's patterns must agree on it.
GROWTH = 0.6
AGREE = 3
#: Patterns or instances that are broadcast, at most (16 bytes each); more are joined. Edges a pattern is called hot beyond.
BROADCAST = 500_000
HOT = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits that were passed over cannot start a match in their middle, so a match may start a run only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[0-9@]\S*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start, then kind: leftmost, not overlapping per kind; matches that fail are dropped."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                out.append((start, 0, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _shape(token: str) -> str:
    return re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", token))


class Contexts:
    """The words of one text, to look up what stands beside a mention."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts, self.ends = [s for s, _ in found], [e for _, e in found]

    def word(self, s: int, e: int) -> str:
        return re.sub(r"[0-9]+", "0", self.text[s:e].lower())

    def patterns(self, start: int, end: int) -> list[str]:
        """Patterns of the mention text[start:end]; what is joined to it on either side counts as a word."""
        i = bisect_left(self.ends, start + 1)  # the word the mention starts in
        left = [self.word(self.starts[k], self.ends[k]) for k in range(max(0, i - 2), i)]
        if self.starts[i] < start:
            left.append(self.word(self.starts[i], start))
        j = bisect_right(self.starts, end - 1) - 1  # the word it ends in
        if end < self.ends[j]:
            right = self.word(end, self.ends[j])
        else:
            right = self.word(self.starts[j + 1], self.ends[j + 1]) if j + 1 < len(self.starts) else ""
        before, shape = left[-1] if left else "", _shape(self.text[start:end])
        out = ["L2 " + " ".join(left[-2:])] if len(left) > 1 else []
        if before:
            out += ["L1 " + before, f"SL {shape} {before}"]
        if right:
            out += ["R1 " + right, f"SR {shape} {right}"]
        if before and right:
            out.append(f"M {before} _ {right}")
        return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind's number or -1, hash of the token, hashes of its patterns) of base entities and other
    identifier-like tokens: five characters or more with four digits or an at sign, outside every base entity."""
    import xxhash

    hashed = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)
    found = [(s, e, k) for s, k, e in spans]
    taken = sorted((s, e) for s, e, _ in found)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    end = 0
    for m in _CANDIDATE.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        s, e = start, end
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        token = text[s:e]
        if e - s < 5 or "@" not in token and sum(map(str.isdigit, token)) < 4:
            continue
        before = bisect_left(begins, e)
        if not before or reach[before - 1] <= s:
            found.append((s, e, -1))
    if not found:
        return []
    contexts = Contexts(text)
    return [(s, e, k, hashed(text[s:e].lower()), [hashed(p) for p in contexts.patterns(s, e)]) for s, e, k in found]


#: Spans that were discovered in a row.
_MORE = "array<struct<start:int,kind:int,end:int>>"
_MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, doc_id, print, four counts, base_sha256, spans, mentions): one row a row of docs; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                columns: list[list] = [[] for _ in range(8)]
                for value in batch.column(2):
                    body = value.as_py() or ""
                    spans = base_spans(body)
                    text_form = shown(spans)
                    kinds = [k for _, k, _ in spans]
                    found = [dict(zip(("start", "end", "kind", "instance", "patterns"), m, strict=True)) for m in mentions(body, spans)]
                    for column, v in zip(columns, (row, *(kinds.count(i) for i in range(4)), hashlib.sha256(text_form.encode()).hexdigest(), text_form, found), strict=True):
                        column.append(v)
                    row += 1
                types = [*[pa.int64()] * 5, pa.string(), pa.string(), _MENTION]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), batch.column(1), *arrays[1:]], ["row", "doc_id", "print", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "mentions"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"row bigint, doc_id {kind}, print bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, mentions array<struct<start:int,end:int,kind:int,instance:bigint,patterns:array<bigint>>>")


def _known(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """edges joined with what is known of their patterns, whose column edges says how many each has at most.

    Beyond BROADCAST patterns only hot ones are broadcast, and only edges of others are shuffled. Hot is a pattern with more
    than HOT edges and more than one in BROADCAST of all, so there are fewer than BROADCAST of them.
    """
    counted = patterns.agg(F.count("*").alias("n"), F.sum("edges").alias("edges")).first()
    if counted["n"] <= BROADCAST:
        return edges.join(F.broadcast(patterns), "pattern")
    hot = patterns.filter(F.col("edges") > max(HOT, counted["edges"] // max(1, BROADCAST)))
    rest = edges.join(F.broadcast(hot.select("pattern")), "pattern", "left_anti")
    return edges.join(F.broadcast(hot), "pattern").unionByName(rest.join(patterns, "pattern"))


def instances(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, belief: float = BELIEF, rare: float = RARE, growth: float | None = None) -> DataFrame:
    """(instance, kind): tokens beyond the base that the graph of all rows' patterns and instances names.

    growth, if given, is the confidence that AGREE patterns of a context need before the last round; without it one rule
    holds in all rounds.
    Equal scores of two kinds go to the kind listed first. No mention or no seed gives none.
    """
    each = scanned.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", "m.patterns")
    contexts = settle(each.groupBy("instance", F.xxhash64("patterns").alias("context")).agg(F.max("kind").alias("kind"), F.first("patterns").alias("patterns")))
    edges = contexts.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("times"))
    seeds = [F.count_if(F.col("kind") == k).alias(f"seeds{k}") for k in range(len(KINDS))]
    known = edges.groupBy("pattern").agg(F.count("*").alias("degree"), F.sum("times").alias("edges"), F.count_if(F.col("kind") < 0).alias("others"), *seeds).filter((F.col("degree") > support) & (F.col("others") > 0))
    known = settle(known.withColumn("seeds", F.array(*(F.col(f"seeds{k}") for k in range(len(KINDS))))).select("pattern", "degree", "edges", "seeds"))
    # candidates only from here on: their contexts, and in each the known patterns
    graph = settle(_known(contexts.filter("kind < 0").select("instance", "context", F.explode("patterns").alias("pattern")), known))
    weight = contexts.filter("kind < 0").select("instance", "context").join(graph.select("instance", "context").distinct().withColumn("shared", F.lit(1.0)), ["instance", "context"], "left")
    weights = settle(weight.groupBy("instance").agg(F.sum(F.coalesce("shared", F.lit(rare))).alias("whole")).join(graph.select("instance").distinct(), "instance"))
    stats = known
    believed = None
    for turn in range(rounds):
        grows = growth is not None and turn < rounds - 1
        needed, trusted = (growth, belief * growth / confidence) if grows else (confidence, belief)
        if believed is not None:  # what the last round named counts for its patterns
            more = graph.select("pattern", "instance").distinct().join(believed, "instance").groupBy("pattern").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"m{k}") for k in range(len(KINDS))))
            stats = settle(known.join(more.select("pattern", F.array(*(F.col(f"m{k}") for k in range(len(KINDS)))).alias("more")), "pattern", "left"))
        sums = F.transform("seeds", lambda x: x.cast("double")) if believed is None else F.zip_with("seeds", F.coalesce("more", F.array_repeat(F.lit(0.0), len(KINDS))), lambda x, y: x + y)
        # a pattern can serve an instance only if all others together reach the support and, less one, the confidence
        hopeful = stats.withColumn("sums", sums).filter(F.array_max("sums") >= F.greatest(F.lit(float(support)), needed * (F.col("degree") - 1) - 1e-9)).select("pattern", "degree", "edges", "sums")
        edge = _known(graph.select("instance", "context", "pattern"), settle(hopeful))
        if believed is not None:
            edge = edge.join(believed.select("instance", F.col("kind").alias("own"), F.col("score").alias("own_score")), "instance", "left")
        else:
            edge = edge.withColumn("own", F.lit(-1)).withColumn("own_score", F.lit(0.0))
        rest = edge.select("instance", "context", "degree", "own", "own_score", F.posexplode("sums").alias("to", "sum")).withColumn("rest", F.col("sum") - F.when(F.col("own") == F.col("to"), F.col("own_score")).otherwise(0.0))
        sure = rest.withColumn("sure", F.col("rest") / (F.col("degree") - 1)).filter((F.col("rest") >= support - 1e-9) & (F.col("sure") >= needed - 1e-9))
        best = sure.groupBy("instance", "context", "to").agg(F.max("sure").alias("sure"), F.count("*").alias("agree"))
        if grows:
            best = best.filter((F.col("sure") >= confidence - 1e-9) | (F.col("agree") >= AGREE))
        best = best.groupBy("instance", "to").agg(F.sum("sure").alias("sum"))
        scored = best.join(weights, "instance").select("instance", F.col("to").alias("kind"), (F.col("sum") / F.col("whole")).alias("score")).filter(F.col("score") >= trusted - 1e-9)
        believed = settle(scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")))
    return believed.select("instance", "kind")


def discovered(scanned: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, print, start, end, kind): every mention of the instances found."""
    found = instances(scanned) if found is None else found
    each = scanned.select("row", "doc_id", "print", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m")).select("row", "doc_id", "print", "m.start", "m.end", "m.instance")
    held = F.broadcast(found) if found.count() <= BROADCAST else found
    return each.join(held, "instance").select("row", "doc_id", "print", "start", "end", "kind")


def extract(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts and hash of the base spans, spans (base and discovered), n_discovered: a row a row of docs.

    A null text is empty. Repeated rows and null ids each get a row. Empty in, empty out; other columns are not read.
    """
    scanned = settle(scan(docs, text, key))
    more = discovered(scanned, instances(scanned, growth=GROWTH)).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    joined = scanned.drop("mentions").join(more, "row", "left")
    names = F.array(*(F.lit(k) for k in KINDS))
    parsed = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), (F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("int").alias("end")))
    every = F.array_join(F.transform(F.sort_array(F.concat(parsed, "more")), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("more").isNull(), F.col("spans")).otherwise(every).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_discovered"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with personal data replaced by its kind; a column n_chars, if there is one, is counted anew.

    Every row stays: null ids, repeated rows, null texts (as they are) and columns of any name. What was discovered is
    broadcast up to BROADCAST instances, so that texts are not moved; beyond, its spans are joined by id and text.
    """
    scanned = settle(scan(docs, text, key))
    found = instances(scanned, growth=GROWTH)
    held = docs.select(packed(docs).alias("row"), F.col(text).alias("body"))
    if found.count() <= BROADCAST:
        shared = docs.sparkSession.sparkContext.broadcast({r["instance"]: r["kind"] for r in found.collect()})
        held = held.withColumn("more", F.lit(None).cast(_MORE))
    else:
        shared = None
        more = settle(discovered(scanned, found).groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")).select(F.col("doc_id").alias("of"), "print", F.col("more").cast(_MORE).alias("more")))
        keyed = docs.select(packed(docs).alias("row"), F.col(text).alias("body"), F.col(key).alias("id"))
        held = keyed.join(more, F.col("id").eqNullSafe(F.col("of")) & (F.xxhash64(F.coalesce(F.col("body"), F.lit(""))) == F.col("print")), "left").select("row", "body", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value if shared else {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                for value, more in zip(batch.column(1), batch.column(2), strict=True):
                    body = value.as_py()
                    spans = base_spans(body) if body else []
                    if body and kinds:
                        spans = spans + [(s, kinds[h], e) for s, e, k, h, _ in mentions(body, spans) if k < 0 and h in kinds]
                    elif body and more.is_valid:
                        spans = spans + [(x["start"], x["kind"], x["end"]) for x in more.as_py()]
                    out.append(redacted(body, spans) if spans else body)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.column(1).type)], ["row", "body"])

    form = held.schema["row"].dataType
    done = held.mapInArrow(run, StructType([StructField("row", form), StructField("body", docs.schema[text].dataType)]))
    parts = [F.col("row").getField(n) for n in docs.columns]
    new = {text: F.col("body")} | ({"n_chars": F.length("body").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns and text == "text" else {})
    return done.select(*(new.get(n, p).alias(n) for n, p in zip(docs.columns, parts, strict=True)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "documents", "doc_id", "text"))
