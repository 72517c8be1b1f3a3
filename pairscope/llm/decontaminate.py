"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n word 5-shingles counts as contained if at least ceil(0.8 n) of them are in the document. Items are
partitioned by size: class c holds those of 2**c to 2**(c + 1) - 1 shingles. A class has a sketch size of its own, what
an item of its largest size may lack plus MATCHES, and every item keeps the MinHash sketch of that many least shingle
hashes (all of them, if it has fewer). Of a sketch as many hashes must be in the document as the class's worst item cannot
lack: that is the class's threshold, so a document under it cannot contain the item, however long the document is. All
shingles of a document are looked up in each class's table; every candidate is verified on the shingles themselves.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import LOWER_BYTES, WordHashes, columns, packed, read, rolling, unused

SHINGLE = 5
SHARE = 0.8
#: Sketch hashes that must match beyond what the largest item of a class may lack.
MATCHES = 3
#: Shingles of all items that one index holds; a larger benchmark is searched in several passes, each with such an index.
INDEX_SHINGLES = 2_000_000

#: Fixed value: the ASCII punctuation that parts words like white space does.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NORMAL = bytes(32 if chr(i) in PUNCTUATION else LOWER_BYTES[i] for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the text in lower case (A-Z), parted by white space and ASCII punctuation."""
    return (text or b"").translate(_NORMAL).split()


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    """Distinct shingles in order; fewer words than k make one shingle of all."""
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))))


class SizeClass:
    """The sketches of the items of one size class and shingle length: hash -> items, and how many matches make a candidate."""

    def __init__(self, size: int, share: float):
        self.most = (2 << size) - 1
        self.sketch = math.floor((1 - share) * self.most + 1e-9) + MATCHES
        self.share = share
        self.threshold = self.sketch
        self.table: dict[int, list[int]] = defaultdict(list)

    def add(self, item: int, n: int, keyed: list[int]) -> None:
        own = keyed[: self.sketch]
        lacking = n - math.ceil(self.share * n - 1e-9)
        self.threshold = max(1, min(self.threshold, len(own) - lacking))
        for h in own:
            self.table[h].append(item)

    def freeze(self) -> None:
        self.keys = np.array(sorted(self.table), np.uint64)
        self.owners = [np.array(self.table[int(h)], np.int64) for h in self.keys]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.table.clear()

    def candidates(self, grams: np.ndarray) -> list[int]:
        """Items with as many sketch hashes among a document's shingles as the threshold asks."""
        near = grams[self.bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        if not len(near):
            return []
        at = np.searchsorted(self.keys, near)
        at[at == len(self.keys)] = 0
        found = np.unique(at[self.keys[at] == near])
        if not len(found):
            return []
        items, matches = np.unique(np.concatenate([self.owners[i] for i in found]), return_counts=True)
        return items[matches >= self.threshold].tolist()


class Index:
    """The items of one pass: sketches by shingle length and size class, all shingles for verification."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = SHINGLE, share: float = SHARE):
        self.k, self.share = k, share
        self.items: list[tuple[int, list[bytes]]] = []
        hashes = WordHashes()
        self.classes: dict[tuple[int, int], SizeClass] = {}  # by shingle length and size class
        for item, text in items:
            words = words_of(text)
            found = shingles(words, k)
            if not found:
                continue
            length, size = min(k, len(words)), len(found).bit_length() - 1
            keyed = sorted({int(rolling(hashes.of(s.split()), length)[0]) for s in found})
            # shingles whose hashes fall together leave fewer to match
            self.classes.setdefault((length, size), SizeClass(size, share)).add(len(self.items), len(found), keyed)
            self.items.append((item, found))
        for c in self.classes.values():
            c.freeze()

    def contained(self, words: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(item, its shingles, those found) for the items that the document contains."""
        if not words or not self.items:
            return []
        coded = hashes.of(words)
        grams = {length: rolling(coded, length) for length in {length for length, _ in self.classes}}
        candidates = sorted(i for (length, _), c in self.classes.items() for i in c.candidates(grams[length]))
        own: dict[int, set[bytes]] = {}
        out = []
        for c in candidates:
            item, found = self.items[c]
            length = found[0].count(b" ") + 1
            if length not in own:
                own[length] = {b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)}
            n = sum(s in own[length] for s in found)
            if n >= math.ceil(self.share * len(found) - 1e-9):
                out.append((item, len(found), n))
        return out


_built: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, bytes]], k: int, share: float) -> Index:
    """The index of this worker process, built once for all its tasks; one is held at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, k, share)
    return _built[name]


def _passes(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in bounded parts, in the order of its ids; streamed, so the driver holds one part at a time."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for row in items.select(F.col(item).alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        if row["t"] is None:
            continue
        held.append((row["i"], row["t"].encode()))
        size += row["t"].count(" ") + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", k: int = SHINGLE, share: float = SHARE, limit: int = INDEX_SHINGLES) -> DataFrame:
    """keep columns, item_id, n_item_shingles, n_found, containment: a row for each document row and item it contains.

    An item with a null or wordless text is in no document; a null text contains none; an item of fewer than k words must
    occur as a whole. Items that share an id, and items with a null id, are each searched. Repeated document rows are each reported. Empty in, empty out.
    """
    keep = keep if keep is not None else ["doc_id"]
    chosen = docs.select(*columns(keep), F.col(text).alias(unused(keep, "__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + (", " if keep else "") + "item_id bigint, n_item_shingles bigint, n_found bigint"
    spark = docs.sparkSession
    parts = []
    for items in _passes(benchmark, item, item_text, limit):
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, k, share)
            hashes = WordHashes()
            for batch in batches:
                n = batch.num_columns - 1
                rows, found = [], []
                for at, value in enumerate(batch.column(n).cast(pa.binary())):
                    hits = index.contained(words_of(value.as_py()), hashes)
                    rows += [at] * len(hits)
                    found += hits
                taken = pa.array(rows, pa.int64())
                columns = [batch.column(i).take(taken) for i in range(n)] + [pa.array([f[j] for f in found], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "item_id", "n_item_shingles", "n_found"])

        parts.append(chosen.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", containment double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no item: contaminated rows are marked in place, with no join.

    Rows with a null or wordless text, null ids and repeated rows stay or go by their text alone; columns stay as they are.
    Items without an id count like any other. An empty benchmark leaves all.
    """
    kept = docs.select(packed(docs).alias("row"), F.col(text).alias("body"))
    form = kept.schema
    spark = docs.sparkSession
    k, share, limit = options.get("k", SHINGLE), options.get("share", SHARE), options.get("limit", INDEX_SHINGLES)
    for items in _passes(benchmark, options.get("item", "item_id"), options.get("item_text", "text"), limit):
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, k, share)
            hashes = WordHashes()
            for batch in batches:
                stay = [not index.contained(words_of(v.as_py()), hashes) for v in batch.column(1).cast(pa.binary())]
                yield batch.filter(pa.array(stay, pa.bool_()))

        kept = kept.mapInArrow(run, form)
    return kept.select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


#: The same pairs in SQL.
OP2_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), l AS (
  SELECT kind, id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM w
), lens AS (SELECT DISTINCT least(len(ws), 5) AS k FROM l WHERE kind = 'i' AND len(ws) > 0
), items AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 5) AS k, unnest([list_aggregate(ws[i : i + least(len(ws), 5) - 1], 'string_agg', ' ') FOR i IN generate_series(1, greatest(len(ws) - 4, 1))]) AS s
  FROM l WHERE kind = 'i' AND len(ws) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id
), docs AS (
  SELECT DISTINCT id AS doc_id, k, unnest([list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') FOR i IN generate_series(1, len(ws) - k + 1)]) AS s
  FROM l, lens WHERE kind = 'd' AND len(ws) >= k
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM docs JOIN items USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_item_shingles, n_found, n_found / n AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_found >= ceil(0.8 * n - 1e-9)
"""
