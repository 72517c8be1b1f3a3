"""Near-duplicate classes of texts: an exact join on word shingles by prefix filtering, and its connected components.

Equal texts stand for one. A text's distinct shingles are put in one order for all texts, common ones last. Two texts of
Jaccard similarity t or more have sizes within t of each other and share a shingle among the first n - ceil(t n) + 1 of
each, so only these are indexed, with a text's id, size and the shingle's place, and no set of shingles is ever copied
into a pair. Texts are read once: words, shingles and what is kept of them are made in that pass, and whole texts are
written; only those of pairs move. Pairs that the index finds meet by their sketches, of about a thirtieth of their texts, which
rule out most that are not similar and none that is; the texts of the others meet in one task and are compared as they are.

What is asked for is classes, not pairs: first the texts of an indexed shingle are compared with two of them, and what
that links is a class; then only texts of different classes that share an indexed shingle are compared, all of them. So
a group of n near copies costs about n comparisons, and no link between two classes is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.graph import components
from pairscope.storage import settle

SHINGLE, LEAST = 5, 0.8
#: Texts from which common shingles are learned (so many, or a SHARE-th of all where that is more, so that the texts of a
#: shingle that is not known as common do not grow with the input), and how many of these are kept; this bears on cost alone.
SAMPLE, SHARE, COMMON, OFTEN = 20_000, 10, 100_000, 3
#: Texts that are compared with one text in one task, and ids of a shingle that meet all its ids in one task.
PART = 500
#: Bytes of text that a task hashes and hands on together.
BYTES = 2_000_000
#: Places of a sketch for each shingle, at least; and the least number of places.
PLACES, LEAST_PLACES = 2, 64


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, for arrays of unsigned longs."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text with one space between words and none at its ends, by eight bytes of all words at once."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray(len(text) + 1, "<u8", data, strides=(1,))
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    length = np.concatenate([gaps, [len(text)]]) - starts
    out, left, at = length.astype(np.uint64), np.arange(len(starts)), 0
    while len(left):
        rest = np.minimum(length[left] - at, 8)
        part = eight[starts[left] + at] & (np.uint64(2**64 - 1) >> (64 - 8 * rest).astype(np.uint64))
        out[left] = mixed((out[left] + np.uint64(0x9E3779B97F4A7C15)) ^ part)
        at += 8
        left = left[length[left] > at]
    return out


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words."""
    n = len(words)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(31) + words[i : i + len(out)])
    return out


def shingle_hashes(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text, with one space between words: distinct hashes of k consecutive words, in order; of all words where there are fewer,
    none where there are none."""
    words = word_hashes(b" ".join(filter(None, texts))) if any(texts) else np.empty(0, np.uint64)
    every, at = rolled(words, k), 0
    for n in (t.count(b" ") + 1 if t else 0 for t in texts):
        own = np.sort(every[at : at + n - k + 1]) if n >= k else rolled(words[at : at + n], n)[:n]
        at += n
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array, by a search of each: its cost hardly grows with the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def prefix(own: np.ndarray, common: np.ndarray, size: int) -> np.ndarray:
    """The first `size` of a text's shingles in the order of all, common ones last."""
    for head in (own[: 2 * size], own):
        last = among(head, common)
        if len(last) - last.sum() >= size:
            return head[~last][:size]
    return np.concatenate([own[~last], own[last]])[:size]


def sketch(own: np.ndarray) -> bytes:
    """The parity of a set of hashes in a power of two of places, as bits: two sets differ in no fewer members than places."""
    places = max(LEAST_PLACES, 1 << (PLACES * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many places two sketches differ; of the larger one, places that are one in the other are put together."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def prefix_size(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts at a time, white space runs as one space, and where these begin; a null text is empty."""
    held, size, begin = [], 0, 0
    for at, t in enumerate(texts):
        held.append(b" ".join((t.as_py() or b"").split()))
        size += len(held[-1])
        if size >= BYTES or at == len(texts) - 1:
            yield begin, held
            held, size, begin = [], 0, at + 1


def common_shingles(single: DataFrame, k: int, least: float = LEAST) -> np.ndarray:
    """Hashes of shingles that several texts of a sample hold, in order. They are put last in the order of all.

    Only the head of a text's shingles is counted, twice as many as are indexed: what comes later is indexed by few texts."""
    n = single.count()
    drawn = single.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(max(1, min(SHARE, math.ceil(n / SAMPLE))))) == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in grouped(batch.column(0)):
                heads = [own[: 2 * prefix_size(len(own), least)] for own in shingle_hashes(texts, k) if len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *heads]).view(np.int64))], ["h"])

    often = drawn.select(F.col("t").cast("binary")).mapInArrow(run, "h bigint").groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON)
    return np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))


def described(single: DataFrame, k: int, least: float) -> DataFrame:
    """(id, print, t, n, tokens, sketch) of rows (id, t), a row a row, in one pass: a digest of the text, the text with white
    space runs as one space, how many distinct shingles it has, those of them that are indexed, and their sketch. Of a row
    with a null id or text there is only the id."""
    common = common_shingles(single, k, least)
    kind = single.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in grouped(batch.column(1)):
                held = []
                for at, (text, own) in enumerate(zip(texts, shingle_hashes(texts, k), strict=True), begin):
                    if batch.column(0)[at].is_valid and batch.column(1)[at].is_valid:
                        n = len(own)
                        held.append((hashlib.sha256(text).digest(), text, n, prefix(own, common, prefix_size(n, least)).view(np.int64) if n else own.view(np.int64), sketch(own)))
                    else:
                        held.append((None,) * 5)
                columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), *columns], ["id", "print", "t", "n", "tokens", "sketch"])

    types = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return single.select("id", F.col("t").cast("binary")).mapInArrow(run, f"id {kind}, print binary, t binary, n int, tokens array<bigint>, sketch binary")


def postings(told: DataFrame) -> DataFrame:
    """(token, id, n, place): of each text of described() the shingles that are indexed, with its number of shingles and their places."""
    return told.select("id", "n", F.posexplode("tokens").alias("place", "token")).select("token", "id", "n", "place")


def index(single: DataFrame, k: int, least: float) -> DataFrame:
    return postings(described(single, k, least))


def fitting(pairs: DataFrame, told: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of ids that can be similar by their sketches and numbers of shingles."""
    kind = told.schema["id"].dataType.simpleString()
    side = lambda x: told.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    apart = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
            near = [i for i in range(batch.num_rows) if differing(sa[i], sb[i]) <= apart * (na[i] + nb[i]) + 1e-6]
            yield batch.select(["a", "b"]).take(pa.array(near, pa.int64()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, single: DataFrame, k: int, least: float, part: int = PART) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts have the similarity; b's text comes to a's, in parts of `part` texts.
    Texts of no pair are left where they are."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = settle(single.select("id", "t").join(ids, "id", "left_semi"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    kind = single.schema["id"].dataType.simpleString()
    own = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("b", F.lit(None).cast(kind)).join(texts.select(F.col("id").alias("a"), "t"), "a")
    other = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b").join(texts.select(F.col("id").alias("b"), "t"), "b")
    together = own.select("a", "part", "b", "t").unionByName(other.select("a", "part", "b", "t")).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def shingles(text: bytes) -> set[bytes]:
        words = text.split(b" ")
        m = min(k, len(words))
        return {b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: set[bytes] = set()
        for batch in batches:
            near = []
            for i, (b, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                own = shingles(t.as_py())
                if not b.is_valid:
                    mine = own
                    continue
                shared = len(mine & own)
                if shared >= least * (len(mine) + len(own) - shared) - 1e-9:
                    near.append(i)
            taken = pa.array(near, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(2).take(taken)], ["a", "b"])

    return together.mapInArrow(run, f"a {kind}, b {kind}")


def _alike(na: Column, nb: Column, least: float) -> Column:
    """Whether two sets of these sizes can have the similarity."""
    return F.least(na, nb) >= least * F.greatest(na, nb) - 1e-9


def _needed(na: Column, nb: Column, least: float) -> Column:
    """Shingles that two sets of these sizes must share."""
    return least / (1 + least) * (na + nb) - 1e-9


def _most(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """How many shingles two sets can share that share the ones at these places: no more before, nor after, than the lesser has."""
    return F.lit(1) + F.least(na - pa - 1, nb - pb - 1) + F.least(pa, pb)


def _plausible(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that can be similar, of a row a pair and indexed shingle that both have, with sizes na and nb.

    Of two texts, the one whose index ends first in the order of all shingles can share, beyond indexed ones, only what it
    has not indexed; so shared indexed shingles and the larger rest of the two are no fewer than what they share."""
    counts = shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    rest = lambda n: F.ceil(F.lit(least) * F.col(n) - 1e-9) - 1
    return counts.filter(F.col("shared") + F.greatest(rest("na"), rest("nb")) >= _needed(F.col("na"), F.col("nb"), least)).select("a", "b")


def _labelled(tokens: DataFrame, roots: DataFrame | None) -> DataFrame:
    """tokens with the class of each text; roots has the texts that have a link."""
    if roots is None:
        return tokens.withColumn("label", F.col("id"))
    return tokens.join(roots, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _stars(held: DataFrame, least: float) -> DataFrame:
    """Pairs of texts of an indexed shingle and of about one size with the first and the last of them, where sizes and places
    allow the similarity."""
    held = held.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least)))
    place = F.struct("id", "label", "n", "place")
    centre = held.groupBy("token", "size").agg(F.array(F.min(place), F.max(place)).alias("both"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token", "size", "both")
    pairs = held.join(centre, ["token", "size"]).withColumn("c", F.explode("both")).filter(F.col("label") != F.col("c.label"))
    fit = _alike(F.col("n"), F.col("c.n"), least) & (_most(F.col("n"), F.col("place"), F.col("c.n"), F.col("c.place")) >= _needed(F.col("n"), F.col("c.n"), least))
    return pairs.filter(fit).select(F.col("c.id").alias("a"), F.col("id").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(held: DataFrame, least: float, part: int = PART) -> DataFrame:
    """All pairs of texts of different classes that can be similar by their sizes and by the indexed shingles they share.

    Places that leave too little room before or after rule a pair out where it meets. A shingle with more than `part` texts is dealt to several tasks: its texts are split, and each part meets all."""
    several = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / part).cast("int").alias("parts")).filter("low <> high").select("token", "parts")
    rows = held.join(several, "token")
    left = rows.select("token", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"))
    fit = _alike(F.col("na"), F.col("nb"), least) & (_most(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")) >= _needed(F.col("na"), F.col("nb"), least))
    return _plausible(left.join(right, ["token", "part"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fit), least)


def near_classes(rows: DataFrame, text: str, key: str, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(key, copy_of, class_id), a row a row: the least key with an equal text, and the least key of its near-duplicate class.

    Texts are compared in lower case with white space runs as one space; similarity is that of their sets of k words in a
    row (all words where there are fewer). Classes are what chains of similar texts join. Texts without a word are all
    equal; a null text, and a row with a null key, is a class of its own. Repeated rows each get a row; other columns are
    not read; empty in, empty out.
    """
    told = settle(described(rows.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("t")), k, least).withColumn("row", F.monotonically_increasing_id()))
    copies = settle(told.filter("print is not null").groupBy("print").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("print", "first"))
    one_each = lambda df: df.filter("n > 0").join(copies, "print", "left").filter("first is null or row = first.row")
    single = one_each(told)
    tokens = postings(single)
    tokens = settle(tokens.join(tokens.groupBy("token").count().filter("count > 1").select("token"), "token"))
    links = roots = None
    for step in (lambda t: _stars(t, least), lambda t: _across(t, least)):
        pairs = settle(fitting(step(_labelled(tokens, roots)), single, least))
        met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = settle(verified(pairs, one_each(told.join(met, "id", "left_semi")), k, least))  # only their texts meet the copies
        links = found if links is None else links.unionByName(found)
        roots = settle(components(links).withColumnsRenamed({"node": "id", "root": "label"}))
    own = told.select("id", "print").join(copies, "print", "left").select("id", F.when(F.col("print").isNotNull(), F.coalesce("first.id", "id")).alias("copy_of"))
    out = own.join(roots.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    return out.select(F.col("id").alias(key), F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("label", "copy_of", "id").alias("class_id"))
