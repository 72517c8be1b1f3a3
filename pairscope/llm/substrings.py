"""Repeated-phrase automata: words inside a 20-word window that also starts earlier are removed.

1. A scan deals a document's windows to their least 8-gram (the leftmost of equal hashes), the seed; consecutive windows
   with one seed make a stretch. Equal windows have equal seeds, so all occurrences of a window meet at its seed. Seeds are
   counted, each once a batch of documents with its number: those that occur twice or more may hold recurring passages.
2. A second scan streams all documents and deals every stretch of such a seed, with its words, to a shard of the seeds; a
   seed with very many stretches is dealt to several parts of it, which the scan itself knows, before anything is moved.
3. A shard confirms what recurs (whole stretches, and windows that different stretches share), compiles it into an
   Aho-Corasick automaton over word numbers and streams its stretches through it to locate every occurrence: of each
   phrase all but the first go. Parts of a hot seed also report where each window starts first; the least of these is
   settled by an aggregate.
4. The ranges are gathered by document and taken out of its words.

Only words are compared in a shard; hashes route (a seed that two 8-grams share by chance costs work and changes nothing).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import bitmap, in_bitmap, read, rolling, settle, spread_hash

WINDOW = 20
GRAM = 8
#: Stretches of one seed in one part, or more where the corpus would have more hot seeds than may be broadcast (12 MB);
#: words of stretches that one automaton is built for.
PART = 5_000
HOT_SEEDS = 1_000_000
#: Stretches of a bucket, on average, which is read by one task at once; stretches a scan holds before it sends them off.
BUCKET = 100_000
CUT_ROWS = 400_000
SHARD_WORDS = 150_000
NO_ID = 2**63 - 1


#: Weights of the bytes of a word by their place, which repeat in longer words.
_WEIGHTS = spread_hash(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
#: Words that are hashed at a time, and that a chunk of documents has at most (one document at least).
TOGETHER = 100_000


def hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text, of its bytes and their places: it depends on the word alone."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), TOGETHER):
        first, last = starts[at : at + TOGETHER], ends[at : at + TOGETHER]
        own = np.diff(first, append=last[-1])  # with the gap behind it
        offset = np.arange(last[-1] - first[0]) - np.repeat(first - first[0], own)
        part = body[first[0] : last[-1]].astype(np.uint64)
        part[last[:-1] - first[0]] = 0
        sums = np.add.reduceat(part * _WEIGHTS[offset & 4095], first - first[0])
        out[at : at + TOGETHER] = spread_hash(sums + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


class Chunk:
    """Some documents, their words joined by one space, end to end; no document is empty."""

    def __init__(self, docs: list[bytes]) -> None:
        self.text = b" ".join(docs)
        body = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero(body == 32)
        self.starts, self.ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(body)]])
        self.words = hashed(body, self.starts, self.ends)
        lengths = np.array([len(d) + 1 for d in docs])
        self.first = np.searchsorted(self.starts, np.cumsum(lengths) - lengths)  # words before each document

    def stretches(self, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seed hash, document, first window, windows) of each stretch; windows that run over a document's end are left out."""
        sizes = np.diff(self.first, append=len(self.words))
        own = np.maximum(sizes - window + 1, 0)  # windows of each document
        which = np.repeat(np.arange(len(own)), own)
        if not len(which):
            return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        grams = rolling(self.words, gram)
        n = len(self.words) - window + 1
        span = window - gram + 1
        place = np.empty(n, np.int64)
        low = np.uint64((1 << 20) - 1)
        for at in range(0, n, 500_000):
            part = grams[at : min(at + 500_000, n) + span - 1]
            least = (part & ~low) | np.arange(len(part), dtype=np.uint64)  # of equal hashes the leftmost
            reach = 1
            while 2 * reach <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < span:
                least = np.minimum(least[: -(span - reach)], least[span - reach :])
            place[at : at + 500_000] = (least & low).astype(np.int64) + at
        within = np.arange(len(which)) - (np.cumsum(own) - own)[which]
        place = place[within + self.first[which]]  # no two documents share a place
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        return grams[place[first]], which[first], within[first], np.diff(first, append=len(which))

    def passages(self, which: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> list[bytes]:
        """The words of stretches."""
        at = self.first[which] + first
        return [self.text[a:z] for a, z in zip(self.starts[at].tolist(), self.ends[at + n + window - 2].tolist(), strict=True)]


def chunks(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], Chunk]]:
    """Rows that end with a text, less those without a word, and their texts, some documents at a time."""
    held, docs, size = [], [], 0
    for *row, text in rows:
        words = (text.as_py() or b"").split()
        if not words:
            continue
        held.append(tuple(row))
        docs.append(b" ".join(words))
        size += len(words)
        if size >= TOGETHER:
            yield held, Chunk(docs)
            held, docs, size = [], [], 0
    if docs:
        yield held, Chunk(docs)


MARK = (1 << 28) - 1


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(seed, n): how many stretches each seed has in a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            seed, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], ["seed", "n"])

        for batch in batches:
            for _, docs in chunks((text,) for text in batch.column(0).cast(pa.binary())):
                seed = docs.stretches(window, gram)[0]
                if len(seed):
                    held.append(seed)
                    size += len(seed)
                if size >= 1_000_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "seed bigint, n bigint")


_FIELDS = ["seed", "part", "parts", "doc", "mark", "start"]


def squeezed(columns: list[np.ndarray], passages: list[bytes]) -> bytes:
    """The fields of some stretches and their words (which hold no line end), compressed together."""
    import zstandard

    body = b"".join([np.int64(len(passages)).tobytes(), *(c.astype("<i8").tobytes() for c in columns), b"\n".join(passages)])
    return zstandard.ZstdCompressor(level=1).compress(body)


def opened(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    head = 8 * (1 + len(_FIELDS) * n)
    return np.frombuffer(body[8:head], "<i8").reshape(len(_FIELDS), n), body[head:].split(b"\n")


def _cut(docs: DataFrame, recurring: np.ndarray, hot: tuple[np.ndarray, np.ndarray], buckets: int, window: int, gram: int) -> DataFrame:
    """(bucket, blob): the stretches of all seeds that the bitmap lets through, those of a batch of documents that go to
    one bucket of seeds (and of parts of a hot seed) together."""
    shared = docs.sparkSession.sparkContext.broadcast((recurring, *hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seeds_hot, parts_hot = shared.value
        held: list[list] = [[] for _ in _FIELDS]
        passages: list[bytes] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in held]
            spread = spread_hash(columns[0].view(np.uint64) + columns[1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            bucket = (spread % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.r_[np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1, len(order)]
            rows, at = [], 0
            for end in ends.tolist():
                own = order[at:end]
                rows.append((int(bucket[own[0]]), squeezed([c[own] for c in columns], [passages[i] for i in own.tolist()])))
                at = end
            for c in (*held, passages):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for rows, docs in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)):
                seeds, which, first, n = docs.stretches(window, gram)
                chosen = np.flatnonzero(in_bitmap(table, seeds.view(np.int64)))
                if not len(chosen):
                    continue
                seeds, which, first, n = seeds[chosen].view(np.int64), which[chosen], first[chosen], n[chosen]
                doc, mark = np.array(rows, np.int64).T[:, which]
                parts = np.ones(len(seeds), np.int64)
                if len(seeds_hot):
                    place = np.searchsorted(seeds_hot, seeds)
                    place[place == len(seeds_hot)] = 0
                    known = seeds_hot[place] == seeds
                    parts[known] = parts_hot[place[known]]
                dealt = (spread_hash((doc ^ mark).view(np.uint64)) >> np.uint64(33)).astype(np.int64)
                for column, value in zip(held, (seeds, dealt % parts, parts, doc, mark, first), strict=True):
                    column.append(value)
                passages += docs.passages(which, first, n, window)
                if len(passages) >= CUT_ROWS:
                    yield out()
        if passages:
            yield out()

    return docs.mapInArrow(run, "bucket int, blob binary")


class Shard:
    """The stretches of some seeds: confirms what recurs, compiles it, locates it."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.groups: dict[tuple, dict[bytes, list[tuple[int, int, int]]]] = defaultdict(dict)
        self.size = 0

    def add(self, seed: int, part: int, parts: int, doc: int, mark: int, start: int, passage: bytes) -> None:
        found = self.groups[seed, part, parts].setdefault(passage, [])
        self.size += 4 if found else passage.count(b" ") + 1  # occurrences take memory too
        found.append((doc, start, mark))

    def located(self) -> Iterator[tuple[int, int, int, int, int, bytes | None]]:
        """(kind, doc, mark, start, windows, digest): kind 0 is a range to remove, kind 1 a first start in its part of a hot seed."""
        import ahocorasick

        numbers, window = self.numbers, self.window
        number = lambda w: numbers.setdefault(w, len(numbers) + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        coded = {}
        lengths: list[int] = []
        known: set[tuple[int, ...]] = set()
        for key, passages in self.groups.items():
            own = coded[key] = {p: tuple(map(number, p.split())) for p in passages}
            shared: dict[tuple[int, ...], int] = {}
            if len(own) > 1:  # windows of two different stretches
                for ids in own.values():
                    for piece in {ids[j : j + window] for j in range(len(ids) - window + 1)}:
                        shared[piece] = shared.get(piece, 0) + 1
            for phrase in [ids for p, ids in own.items() if len(passages[p]) > 1] + [w for w, n in shared.items() if n > 1]:
                if phrase not in known:
                    known.add(phrase)
                    automaton.add_word(phrase, len(lengths))
                    lengths.append(len(phrase))
        if lengths:
            automaton.make_automaton()
        for key, passages in self.groups.items():
            first: dict[int, tuple[int, int]] = {}
            hits = {}
            for p, ids in coded[key].items():
                passages[p].sort()
                doc, start, _ = passages[p][0]
                hits[p] = [(end - lengths[n] + 1, n) for end, n in automaton.iter(ids)] if lengths else []
                for at, n in hits[p]:
                    first[n] = min(first.get(n, (doc, start + at)), (doc, start + at))
            for p, ids in coded[key].items():
                # the longest phrases come first, so that a whole stretch goes as one range
                places = sorted(hits[p], key=lambda h: (-lengths[h[1]], h[0]))
                for doc, start, mark in passages[p]:
                    gone: set[int] = set()
                    for at, n in places:
                        if first[n] != (doc, start + at) and at not in gone:
                            yield 0, doc, mark, start + at, lengths[n] - window + 1, None
                            gone.update(range(at, at + lengths[n] - window + 1))
                    if key[2] > 1 and len(gone) < len(ids) - window + 1:
                        words = p.split()
                        for at in range(len(ids) - window + 1):
                            if at not in gone:
                                yield 1, doc, mark, start + at, 1, hashlib.blake2b(b" ".join(words[at : at + window]), digest_size=16).digest()


_LOCATED = "kind int, doc bigint, mark bigint, start int, n int, digest binary"


def _locate(cut: DataFrame, window: int) -> DataFrame:
    """Streams the stretches of each bucket, seed by seed, through one automaton after the other."""

    def run(table: pa.Table) -> pa.Table:
        found = [opened(blob.as_py()) for blob in table.column("blob")]
        fields = np.concatenate([f for f, _ in found], axis=1)
        passages = [p for _, ps in found for p in ps]
        order = np.lexsort((fields[1], fields[0]))
        rows: list[list] = [[] for _ in range(6)]

        def finish(shard: Shard) -> None:
            for row in shard.located():
                for column, value in zip(rows, row, strict=True):
                    column.append(value)

        shard, last = Shard(window), None
        for i, row in zip(order.tolist(), fields[:, order].T.tolist(), strict=True):
            if row[:2] != last:
                if shard.size >= SHARD_WORDS:
                    finish(shard)
                    shard = Shard(window)
                last = row[:2]
            shard.add(*row, passages[i])
        finish(shard)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["kind", "doc", "mark", "start", "n", "digest"])

    return cut.groupBy("bucket").applyInArrow(run, _LOCATED)


def _removed(held: DataFrame, window: int) -> DataFrame:
    """(doc, n_words, n_removed, kept): ranges taken out of every document; kept where some words went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                n_words, n_removed, kept, sha = [], [], [], []
                for text, ranges in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                    words = (text.as_py() or b"").split()
                    left = words
                    if ranges.is_valid:
                        places = ranges.values.to_numpy()
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, places >> 33, 1)
                        np.add.at(change, (places >> 33) + (places >> 28 & 31) + window - 1, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    body = b" ".join(left)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(body if len(left) < len(words) else None)
                    sha.append(hashlib.sha256(body).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], ["doc", "n_words", "n_removed", "kept", "sha"])

    return held.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept binary, sha string")


def dedup_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, part: int = PART) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): kept is the words left, joined by spaces, where some went, else null.

    A null text has no words. Repeated rows (same id and text) have the same result, as no window starts before itself.
    A null id counts as the largest. Texts under `window` words keep all. Of equal windows that start at one place of
    rows with one id, none starts earlier. Empty in, empty out. Extra columns are not read.
    """
    if not 0 < window - gram + 1 < 32:
        raise ValueError("window - gram must be under 31")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).bitwiseAND(F.lit(MARK)).alias("mark"), body.alias("text"))
    counted = settle(_seeds(base, window, gram).groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(part, -(-total // HOT_SEEDS))  # so that at most HOT_SEEDS seeds are hot
    hot = counted.filter(F.col("n") > most).select("seed", F.ceil(F.col("n") / most).cast("int").alias("parts")).toArrow()
    order = np.argsort(hot.column("seed").to_numpy())
    hot_seeds = (hot.column("seed").to_numpy()[order], hot.column("parts").to_numpy()[order])
    located = settle(_locate(_cut(base, bitmap(counted, "seed"), hot_seeds, max(1, -(-total // BUCKET)), window, gram), window))
    at = F.shiftleft(F.col("start").cast("bigint"), 33).bitwiseOR(F.shiftleft(F.col("n").cast("bigint"), 28)).alias("at")
    firsts = located.filter("kind = 1").groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    late = located.filter("kind = 1").join(firsts, "digest").filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    gone = located.filter("kind = 0").select("doc", "mark", at).unionByName(late.select("doc", "mark", at))
    ranges = gone.groupBy("doc", "mark").agg(F.collect_set("at").alias("ranges"))
    done = _removed(base.join(ranges, ["doc", "mark"], "left").select("doc", "text", "ranges"), window)
    return done.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", F.col("sha").alias("kept_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
