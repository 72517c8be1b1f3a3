"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at 4 or fewer differing bits. The bits are cut into blocks with a share of the
threshold each, such that two fingerprints that link are within its share in one block at least (shares plus blocks
less one add up to the threshold). On each block a linear covering code gives the anchors: every block value lies within
the covering radius R of one (a Hamming code, R = 1; on a block without a share the trivial code, R = 0, every value an
anchor of its own). A fingerprint is at home at its nearest anchor and is copied to every anchor within
R + share; if x and y agree within the share, y has a copy at x's home. Per anchor, homes are compared with copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import LOWER_BYTES, columns, packed, read, settle, unused
from pairscope.llm.graph import components

SHINGLE = 4
SEED = 42
THRESHOLD = 4


@dataclass(frozen=True)
class Block:
    """Bits [low, low + width) with a share of the threshold; the first `coded` bits carry a Hamming code, the rest are free."""

    low: int
    width: int
    share: int
    coded: int

    @property
    def radius(self) -> int:
        return 1 if self.coded else 0

    def syndromes(self) -> np.ndarray:
        """The syndrome of every value of the coded bits: the place (from 1) of the bit to turn, 0 for a codeword."""
        values = np.arange(1 << self.coded, dtype=np.uint32)
        out = np.zeros(len(values), np.uint32)
        for i in range(self.coded):
            out ^= np.where((values >> i) & 1, i + 1, 0).astype(np.uint32)
        return out

    def masks(self, reach: int) -> list[np.ndarray]:
        """By syndrome: what to XOR onto a value to get each anchor within reach."""
        out: list[list[int]] = [[] for _ in range(self.coded + 1)]
        for weight in range(reach + 1):
            for places in combinations(range(self.width), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= p + 1 if p < self.coded else 0
                if syndrome <= self.coded:
                    out[syndrome].append(sum(1 << p for p in places))
        return [np.array(x, np.uint64) for x in out]


#: What a copy dealt out and a comparison cost, in comparisons: a layout is chosen by their sum.
COPY_COST = 500


def layouts(threshold: int = THRESHOLD) -> list[list[Block]]:
    """Ways to cut the bits. For 4: coded blocks that tolerate one bit each and one that must agree (33 copies, a pair in
    8,000 compared), or two coded blocks that tolerate two and one (about 380 copies, a pair in 700,000)."""
    if threshold == 4:
        return [[Block(0, 22, 1, 15), Block(22, 22, 1, 15), Block(44, 20, 0, 0)], [Block(0, 32, 2, 15), Block(32, 32, 1, 15)]]
    n = threshold + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [[Block(edges[i], edges[i + 1] - edges[i], 0, 0) for i in range(n)]]


def cost(blocks: list[Block], points: int) -> float:
    """Copies and comparisons of so many distinct fingerprints, if their bits are even."""
    out = 0.0
    for b in blocks:
        masks = b.masks(b.radius + b.share)
        copies = float(np.bincount(b.syndromes(), minlength=b.coded + 1) @ [len(m) for m in masks]) / (1 << b.coded)
        anchors = 2.0**b.width / (b.coded + 1)
        out += points * copies * (COPY_COST + points / anchors)
    return out


def layout(threshold: int = THRESHOLD, points: int = 0) -> list[Block]:
    """The cut that costs least for so many distinct fingerprints; all of them find the same links."""
    return min(layouts(threshold), key=lambda blocks: cost(blocks, points)) if points else layouts(threshold)[0]


def check_layout(blocks: list[Block], threshold: int) -> None:
    if sum(b.share for b in blocks) + len(blocks) - 1 < threshold or sum(b.width for b in blocks) != 64:
        raise ValueError("the blocks' shares do not cover the threshold")


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(found), 8192):
        bits += np.unpackbits(found[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * bits[i] > len(found)))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns and fp (a signed long with the fingerprint's bits). One pass, no shuffle; a null text is empty."""
    keep = keep if keep is not None else ["doc_id"]
    chosen = docs.select(*columns(keep), F.col(text).alias(unused(keep, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            column = batch.column(n).cast(pa.binary())
            fp = np.array([fingerprint(x.as_py()) for x in column], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(fp)], [*batch.schema.names[:n], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", fp bigint"
    return chosen.mapInArrow(run, schema)


def anchored(points: DataFrame, blocks: list[Block], copies: bool = True) -> DataFrame:
    """(anchor, copy, fp): each fingerprint at its home anchor (copy false) and, if copies, at every anchor within R + share (copy true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(b, b.syndromes(), b.masks(b.radius), b.masks(b.radius + b.share)) for b in blocks]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for k, (b, syndromes, near, far) in enumerate(tables):
                    value = (fp >> np.uint64(b.low)) & np.uint64((1 << b.width) - 1)
                    syndrome = syndromes[(value & np.uint64((1 << b.coded) - 1)).astype(np.int64)] if b.coded else np.zeros(len(value), np.uint32)
                    for masks, copy in ((near, False), (far, True))[: 1 + copies]:
                        for s in np.unique(syndrome):
                            at_s = syndrome == s
                            turns = masks[s][:1] if not copy else masks[s]
                            anchors = (value[at_s][:, None] ^ turns[None, :]).ravel()
                            owners = np.repeat(fp[at_s], len(turns))
                            yield pa.RecordBatch.from_arrays([pa.array((anchors | np.uint64(k << 32)).view(np.int64)), pa.array(np.full(len(anchors), copy)), pa.array(owners.view(np.int64))], ["anchor", "copy", "fp"])

    return points.select("fp").mapInArrow(run, "anchor bigint, copy boolean, fp bigint")


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component once the links (a, b) are added."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _compare(group: np.ndarray, copy: np.ndarray, fp: np.ndarray, threshold: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and copies of the same group, thinned to a forest; rows are sorted by group, homes first."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(group)])
    homes = np.add.reduceat((~copy).astype(np.int64), first)
    copies = n - homes
    labels = np.arange(len(fp))
    pairs = homes * copies
    linked = np.zeros(len(fp), bool)
    at = 0
    while at < len(first):
        if pairs[at] > block:  # a large anchor: home by home, in stretches
            lo, h, c = first[at], homes[at], copies[at]
            other = np.arange(lo + h, lo + h + c)
            step = max(1, block // max(1, c))
            for i in range(0, h, step):
                x = np.arange(lo + i, lo + min(h, i + step))
                i_, j_ = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[other][None, :]) <= threshold)
                linked[x[i_]] = linked[other[j_]] = True
                labels = merge(labels, x[i_], other[j_])
            at += 1
            continue
        to = at + max(1, int(np.searchsorted(np.cumsum(pairs[at:]), block, "right")))
        big = np.flatnonzero(pairs[at:to] > block)
        to = at + int(big[0]) if len(big) else to
        size = pairs[at:to]
        which = np.repeat(np.arange(at, to), size)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        x = first[which] + inner // np.maximum(copies[which], 1)
        y = first[which] + homes[which] + inner % np.maximum(copies[which], 1)
        near = np.bitwise_count(fp[x] ^ fp[y]) <= threshold
        x, y = x[near], y[near]
        linked[x] = linked[y] = True
        labels = merge(labels, x, y)
        at = to
    moved = np.flatnonzero(linked & (fp != fp[labels]))
    return fp[moved], fp[labels[moved]]


def near_links(points: DataFrame, threshold: int = THRESHOLD, blocks: list[Block] | None = None, hot: int = 20_000) -> DataFrame:
    """(a, b): links among distinct fingerprints that join exactly those that a chain of links joins.

    An anchor with more than `hot` homes is dealt to several tasks: its homes are split, its copies go to each part.
    """
    blocks = blocks or layout(threshold, points.count())
    check_layout(blocks, threshold)
    rows = anchored(points, blocks)
    homes = anchored(points, blocks, copies=False).groupBy("anchor").count().filter(F.col("count") > hot)
    parts = homes.select("anchor", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    dealt = (
        rows.join(parts, "anchor", "left")
        .withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("copy"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))))
        .select("anchor", "part", "copy", "fp")
    )
    together = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "copy", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(last: bool):
            anchor, part, copy, fp = (np.concatenate([h[i] for h in held]) for i in range(4))
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            end = len(anchor) if last else (int(change[-1]) if len(change) else 0)
            held[:] = [(anchor[end:], part[end:], copy[end:], fp[end:])]
            if not end:
                return None
            group = np.zeros(end, np.int64)
            group[change[change < end]] = 1
            a, b = _compare(np.cumsum(group), copy[:end], fp[:end].view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()))
            n += batch.num_rows
            if n >= 200_000:
                if (out := flush(False)) is not None:
                    yield out
                n = 0
        if held and (out := flush(True)) is not None:
            yield out

    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) a row of docs: component_id is the least doc_id that links reach, itself included.

    A null text has no words, hence fingerprint zero, which links like any other. Repeated rows each get a row. A row
    with a null id is grouped with its class; a class of null ids only has a null component_id. Empty in, empty out.
    """
    prints = settle(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))))
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = components(near_links(points, threshold))
    root = points.join(member.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = root.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Twice 64 bits that tell rows apart by all their columns; a null counts as a value of its own, a map by its JSON."""
    parts: list[Column] = []
    for c, field in zip(columns(docs.columns), docs.schema.fields, strict=True):
        parts += [F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c, c.isNull()]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts[::-1]).alias("h2")]


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """One row of docs for each class: the least id, a null id after all others, and of rows with that id the least hash.

    Rows are told apart by two hashes of all columns, so ids may repeat or be null. Equal rows stand for one. Columns of
    any name and kind, maps as well, are returned as they are.
    """
    hashes = _row_hashes(docs)
    prints = settle(fingerprints(docs.select(F.col(key).alias("doc_id"), *hashes, F.col(text).alias("text")), keep=["doc_id", "h1", "h2"]))
    points = settle(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("first")))
    member = components(near_links(points, threshold))
    root = points.join(member.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stay = root.groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2")
    return docs.select(packed(docs).alias("row"), *hashes).join(stay, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
