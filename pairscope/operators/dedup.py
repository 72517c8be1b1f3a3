"""Duplicates among texts: exact groups, and near duplicates by their sets of character 3-grams, exactly.

Which two texts are near duplicates is asked of every two of them, as no index helps where texts share most of their
3-grams. But no pair is ever a row: texts are put into blocks by kind and by the size of their sets, and a task compares
two blocks.

1. 3-grams are put into a few groups, learned from a sample, so that texts of a language have most of theirs in one. Two
   texts share no more 3-grams of a group than the lesser has, so most blocks of two languages need not meet.
2. The parity of a set in a number of places (the xor of its members' places) is a sketch: two sketches differ in no more
   places than the sets differ in members. Similar sets differ in few, so almost all pairs go by a few words of each text:
   by sketches folded to about half a set's size in places, and what these leave by whole ones.
3. What is left is counted on the sets. For classes, only texts that the task does not know to be of one class are.
4. A block's own classes are found when it is made; two blocks hand on at most a link for each of their classes.

What is settled is the blocks, about as large as the texts; comparisons grow with the square of the distinct texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions.text import normalized
from pairscope.operators.graph import components
from pairscope.storage import settle

#: Texts of a block, and members of their sets, at most (but one text at least).
BLOCK, MEMBERS = 4096, 4_000_000
GRAM, LEAST = 3, 0.85
#: Places of a folded sketch for each member of the largest set of a block, at least; a whole sketch has twice as many.
PLACES, LEAST_PLACES = 0.38, 64
#: Members of a block, at most, for which a text's set is held as a bit each where it is counted.
BITS = 1 << 16
#: Texts, and characters of each, from which groups of 3-grams are learned, and how many these are. A text of which less
#: than a PURE part is of one group is of no kind. All this bears on cost alone.
SAMPLE, HEAD, GROUPS, PURE = 1000, 4000, 4, 0.65


def exact_groups(rows: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """Groups of equal normalized text: size, least key, whether all labels agree."""
    held = rows.filter(F.col(text).isNotNull()).groupBy(F.sha2(normalized(F.col(text)), 256).alias("digest"))
    return held.agg(F.count("*").alias("size"), F.min(key).alias("first"), (F.count_distinct(label) == 1).alias("same_label")).filter("size > 1").select("first", "size", "same_label")


def grams(text: str) -> np.ndarray:
    """The distinct character 3-grams of a text as ordered longs, each told apart; the text itself where it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.array([-1 - sum((int(p) + 1) << 21 * i for i, p in enumerate(points))], np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def gram_groups(sample: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a sample of texts, in order, and the group of each: texts are put to the nearest of a few centres, and a gram
    to the centre where its share is largest."""
    sets = [grams(t) for t in sample]
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    vocabulary, members = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    held = np.zeros((len(sets), len(vocabulary)), np.float32)
    held[np.repeat(np.arange(len(sets)), n), members] = 1
    held /= np.sqrt(n)[:, None]
    centres = held[[int(np.argsort(n, kind="stable")[len(n) // 2])]]
    far = n < np.median(n) / 4  # short texts are far from all
    while len(centres) < GROUPS:
        centres = np.vstack([centres, held[np.argmin((held @ centres.T).max(axis=1) + far)]])
    for _ in range(8):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-9)[:, None]
        own = (held @ centres.T).argmax(axis=1)
        centres = np.array([held[own == g].sum(axis=0) for g in range(GROUPS)])
    return vocabulary, (centres / np.maximum(centres.sum(axis=1), 1e-9)[:, None]).argmax(axis=0)


def group_counts(own: np.ndarray, vocabulary: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many of a text's grams are of each group; grams that the sample did not hold are the last one."""
    if not len(vocabulary):
        return np.bincount([GROUPS], minlength=GROUPS + 1) * len(own)
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    return np.bincount(np.where(vocabulary[at] == own, group[at], GROUPS), minlength=GROUPS + 1)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer places: those that are one in it are put together."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words, sketch.shape[1]), axis=0)


class Block:
    """Texts' ids with their sets: members numbered within the block, end to end; sketches; classes within the block.

    Sets are unpacked when they are first asked for: most pairs of blocks are told by sketches."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray, label: np.ndarray, sets: tuple[np.ndarray, np.ndarray] | bytes) -> None:
        self.n, self.sketch, self.label, self._sets = n, sketch, label, sets
        self.ends = np.cumsum(n)
        self.starts = self.ends - n

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Block:
        vocabulary, members = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.array([len(s) for s in sets])
        places = 2 * max(LEAST_PLACES, 1 << math.ceil(math.log2(PLACES * n.max())))
        mixed = vocabulary.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) & (places - 1)
        odd = np.bincount(np.repeat(np.arange(len(n)) * places, n) + place[members], minlength=len(n) * places) & 1
        sketch = np.packbits(odd.astype(np.uint8).reshape(len(n), places), axis=1).view(np.uint64).T.copy()
        return cls(n, sketch, np.arange(len(n)), (vocabulary, members.astype(np.int32)))

    @property
    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary, members)"""
        if isinstance(self._sets, bytes):
            import zstandard

            body = zstandard.ZstdDecompressor().decompress(self._sets)
            words = len(body) // 4 - int(self.ends[-1]) >> 1
            self._sets = np.frombuffer(body, "<i8", words), np.frombuffer(body, "<i4", offset=8 * words)
        return self._sets

    def packed(self) -> tuple[bytes, bytes]:
        """(sizes, classes and sketches; sets)"""
        import zstandard

        vocabulary, members = self.sets
        head = [np.array([len(self.n)]), self.n, self.label, self.sketch.reshape(-1).view(np.int64)]
        return np.concatenate(head).astype("<i8").tobytes(), zstandard.ZstdCompressor(level=1).compress(vocabulary.astype("<i8").tobytes() + members.astype("<i4").tobytes())

    @classmethod
    def opened(cls, head: bytes, body: bytes) -> Block:
        whole = np.frombuffer(head, "<i8")
        texts = int(whole[0])
        return cls(whole[1 : texts + 1], whole[2 * texts + 1 :].view(np.uint64).reshape(-1, texts), whole[texts + 1 : 2 * texts + 1], body)


def apart_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places each sketch of a differs from each of b. Four words are added up in a byte: where all of their
    places differ this comes out as none, which rules no pair out."""
    out = None
    for first in range(0, len(a), 4):
        some = np.bitwise_count(a[first][:, None] ^ b[first][None, :])
        for ours, other in zip(a[first + 1 : first + 4], b[first + 1 : first + 4], strict=True):
            some += np.bitwise_count(ours[:, None] ^ other[None, :])
        out = some if out is None else np.add(out, some, dtype=np.uint16)
    return out


def shared_with(a: Block, b: Block) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function that counts the members which a text of a shares with texts of b, exactly: over a bit for each member that
    a knows, or for many members over those of the texts. A text's bits are made when they are first asked for."""
    (mine, members), (yours, theirs) = a.sets, b.sets
    if a is b:
        number = members
    else:
        where = np.minimum(np.searchsorted(mine, yours), len(mine) - 1)
        number = np.where(mine[where] == yours, where, len(mine)).astype(np.int32)[theirs]

    def places(js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = b.n[js]
        starts = np.cumsum(sizes) - sizes
        return number[np.repeat(b.starts[js] - starts, sizes) + np.arange(sizes.sum())], starts

    if len(mine) > BITS:
        mark = np.zeros(len(mine) + 1, np.int64)

        def marked(i: int, js: np.ndarray) -> np.ndarray:
            own = members[a.starts[i] : a.ends[i]]
            mark[own] = 1
            each, starts = places(js)
            out = np.add.reduceat(mark[each], starts)
            mark[own] = 0
            return out

        return marked
    width = (len(mine) >> 6) + 1  # at least one bit more than there are members, for those that a does not know
    bits, done = np.zeros((len(b.n), width), np.uint64), np.zeros(len(b.n), bool)

    def counted(i: int, js: np.ndarray) -> np.ndarray:
        new = js[~done[js]]
        for first in range(0, len(new), 256):
            some = new[first : first + 256]
            held = np.zeros((len(some), 64 * width), np.uint8)
            held[np.repeat(np.arange(len(some)), b.n[some]), places(some)[0]] = 1
            bits[some] = np.packbits(held, axis=1, bitorder="little").view(np.uint64)
        done[new] = True
        own = np.zeros(64 * width, np.uint8)
        own[members[a.starts[i] : a.ends[i]]] = 1
        return np.bitwise_count(bits[js] & np.packbits(own, bitorder="little").view(np.uint64)).sum(axis=1, dtype=np.int64)

    return counted


def similar(a: Block, b: Block, least: float, every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in a, places in b, Jaccard): the links between two blocks, or within one; sizes rise within a block.

    Unless `every`, links within a class that is known already are left out, and classes are joined as links are found.
    """
    same = a is b
    label = np.concatenate([a.label, a.label if same else b.label + len(a.n)])
    theirs = 0 if same else len(a.n)  # where b's classes begin
    shared = None
    apart = (1 - least) / (1 + least)
    words = min(len(a.sketch), len(b.sketch))
    ours, other = folded(a.sketch, words), folded(b.sketch, words)
    some, few = folded(ours, words // 2), folded(other, words // 2)
    for first in range(0, len(a.n), 16):
        last = min(first + 16, len(a.n))
        low = int(np.searchsorted(b.n, math.ceil(least * a.n[first] - 1e-9)))
        high = int(np.searchsorted(b.n, math.floor(a.n[last - 1] / least + 1e-9), side="right"))
        low = max(low, first + 1) if same else low
        if low >= high:
            continue
        differ = apart_in(some[:, first:last], few[:, low:high])
        most = np.minimum(np.floor(apart * (a.n[last - 1] + b.n[low:high]) + 1e-6), np.iinfo(differ.dtype).max).astype(differ.dtype)
        at = np.flatnonzero(differ <= most)
        if not len(at):
            continue
        left, right = np.divmod(at, high - low)
        left, right = left + first, right + low
        fit = np.minimum(a.n[left], b.n[right]) >= least * np.maximum(a.n[left], b.n[right]) - 1e-9
        if same:
            fit &= right > left
        if not every:
            fit &= label[theirs + right] != label[left]
        left, right = left[fit], right[fit]
        near = np.bitwise_count(ours[:, left] ^ other[:, right]).sum(axis=0, dtype=np.int64) <= apart * (a.n[left] + b.n[right]) + 1e-6
        left, right = left[near], right[near]
        if len(left) and shared is None:
            shared = shared_with(a, b)
        for i, js in zip(*_runs(left, right), strict=True):
            if not every:
                js = js[label[theirs + js] != label[i]]
            if not len(js):
                continue
            both = shared(i, js)
            whole = a.n[i] + b.n[js] - both
            linked = both >= least * whole - 1e-9
            js, jaccard = js[linked], (both / whole)[linked]
            if not every:  # a link a class
                _, one = np.unique(label[theirs + js], return_index=True)
                js, jaccard = js[one], jaccard[one]
                old = label[theirs + js]
                if len(js):
                    label[np.isin(label, old)] = label[i]
            if len(js):
                yield i, js, jaccard
    if same and not every:
        a.label = label[: len(a.n)]


def _runs(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each value of left, which is in order, with its values of right."""
    if not len(left):
        return [], []
    begin = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    return left[begin].tolist(), np.split(right, begin[1:])


def blocks(single: DataFrame, least: float, block: int, every: bool) -> DataFrame:
    """(block, low, high, most, ids, reps, head, body): single's texts (id, t) in blocks by their kind and by the size of their
    sets, settled.

    reps: for each text one of its class within the block. low and high: the least and the largest size. most: the most
    3-grams of each group that a text has."""
    kind = single.schema["id"].dataType.simpleString()
    vocabulary, group = gram_groups([r["t"] for r in single.select(F.substring("t", 1, HEAD).alias("t")).limit(SAMPLE).collect()])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [group_counts(grams(t), vocabulary, group) for t in batch.column(1).to_pylist()]
            kinds = [int(c.argmax()) if c.max() >= PURE * c.sum() else GROUPS for c in counts]
            columns = [pa.array(kinds, pa.int32()), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "t", "kind", "n", "counts"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, counts, size, now = [], [], [], 0, None

        def out() -> pa.RecordBatch:
            held = Block.of(sets)
            if not every:
                for _ in similar(held, held, least, False):
                    pass
            head, body = held.packed()
            row = [[int(held.n[0])], [int(held.n[-1])], [np.max(counts, axis=0).tolist()], [ids], [[ids[k] for k in held.label.tolist()]], [head], [body]]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names)
            ids.clear(), sets.clear(), counts.clear()
            return batch

        for batch in batches:
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(batch.column(0).type), pa.list_(batch.column(0).type), pa.binary(), pa.binary()]
            names = ["low", "high", "most", "ids", "reps", "head", "body"]
            for key, text, k, c in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                own = grams(text)
                if ids and (len(ids) >= block or size + len(own) > MEMBERS or k != now):
                    yield out()
                    size = 0
                now = k
                ids.append(key)
                sets.append(own)
                counts.append(c)
                size += len(own)
        if ids:
            yield out()

    whole = settle(single.select("id", "t").mapInArrow(sized, f"id {kind}, t string, kind int, n bigint, counts array<bigint>"))
    some = math.ceil(whole.count() / block)
    parts = max(1, math.ceil(some / 4), min(some, whole.sparkSession.sparkContext.defaultParallelism))  # several blocks each, so that few are small
    dealt = whole.repartitionByRange(parts, "kind", "n", "id").sortWithinPartitions("kind", "n", "id").select("id", "t", "kind", "counts")
    return settle(dealt.mapInArrow(made, f"low bigint, high bigint, most array<bigint>, ids array<{kind}>, reps array<{kind}>, head binary, body binary").withColumn("block", F.monotonically_increasing_id()))


def meeting(held: DataFrame, least: float, every: bool) -> DataFrame:
    """The pairs of blocks() that can hold similar texts, by their sizes and by how many 3-grams of each group they have."""
    left = held.select("block", "low", "high", F.col("most").alias("least_of"), F.col("ids").alias("ours"), F.col("head").alias("mine"), F.col("body").alias("my_sets"))
    right = held.select(F.col("block").alias("other"), F.col("low").alias("from"), F.col("high").alias("to"), F.col("most").alias("or_of"), F.col("ids").alias("theirs"), F.col("head").alias("yours"), F.col("body").alias("your_sets"))
    reach = (F.col("high") >= least * F.col("from") - 1e-9) & (F.col("to") >= least * F.col("low") - 1e-9)
    order = F.col("block") <= F.col("other") if every else F.col("block") < F.col("other")
    shared = sum((F.least(F.col("least_of")[g], F.col("or_of")[g]) for g in range(GROUPS + 1)), F.lit(0))
    enough = shared >= least / (1 + least) * (F.col("low") + F.col("from")) - 1e-6
    return left.join(right.hint("shuffle_replicate_nl"), order & reach & enough)  # tasks read the settled blocks, nothing is moved


def links(held: DataFrame, least: float, every: bool) -> DataFrame:
    """(a, b, jaccard): the links of blocks() with each other, and with `every` those within blocks too."""
    kind = held.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if block != now:
                    now, a = block, Block.opened(batch.column("mine")[k].as_py(), batch.column("my_sets")[k].as_py())
                b = a if batch.column("other")[k].as_py() == block else Block.opened(batch.column("yours")[k].as_py(), batch.column("your_sets")[k].as_py())
                ours, theirs = batch.column("ours")[k].values, batch.column("theirs")[k].values
                for i, js, jaccard in similar(a, b, least, every):
                    yield pa.RecordBatch.from_arrays([ours.take(pa.array([i] * len(js))), theirs.take(pa.array(js)), pa.array(jaccard)], ["a", "b", "jaccard"])

    return meeting(held, least, every).select("block", "other", "ours", "theirs", "mine", "yours", "my_sets", "your_sets").mapInArrow(run, f"a {kind}, b {kind}, jaccard double")


def near_pairs(rows: DataFrame, text: str, key: str, least: float = LEAST, part: int = BLOCK) -> DataFrame:
    """Pairs (a < b) of distinct normalized texts with shingle Jaccard of `least` or more: all of them, so as many rows as
    links. Exact copies are represented by the least key first."""
    single = settle(rows.filter(F.col(text).isNotNull()).groupBy(normalized(F.col(text)).alias("t")).agg(F.min(key).alias("id")))
    found = links(blocks(single, least, part, True), least, True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def near_texts(rows: DataFrame, text: str, key: str, least: float = LEAST, part: int = BLOCK) -> DataFrame:
    """(key, copy_of, class_id), a row a row: the least key with an equal text, and the least key of its near-duplicate class.

    Texts are compared in lower case with white space runs as one space; classes are what chains of links of near_pairs()
    join. A null text, and a row with a null key, is a class of its own. Repeated rows each get a row; empty in, empty out.
    """
    held = rows.select(F.col(key).alias("key"), normalized(F.col(text)).alias("t"))
    single = settle(held.filter("key is not null and t is not null").groupBy("t").agg(F.min("key").alias("id")).select("id", "t", F.sha2("t", 256).alias("print")))
    found = blocks(single, least, part, False)
    own = found.select(F.inline(F.arrays_zip(F.col("ids").alias("a"), F.col("reps").alias("b")))).filter("a <> b")
    roots = components(settle(own.unionByName(links(found, least, False).select("a", "b"))))
    named = single.select("id", "print").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("print", F.col("id").alias("copy_of"), F.coalesce("root", "id").alias("class_id"))
    out = held.withColumn("print", F.when(F.col("key").isNotNull(), F.sha2("t", 256))).join(named, "print", "left")
    return out.select(F.col("key").alias(key), F.coalesce("copy_of", "key").alias("copy_of"), F.coalesce("class_id", "key").alias("class_id"))
