"""Cross-entropy difference between two n-gram models of one vocabulary.

Both models are interpolated bigram models over the same vocabulary, counted over every document: the target over
documents of good quality, the background over all others. They are matched: one vocabulary, one smoothing, and the
larger corpus is scaled to the tokens of the smaller. A document's own counts are left out of the model it helped to
count, so that every document is scored as one not seen. Its score is the mean over its tokens of the target's loss
less the background's; lower means nearer to the target.

Counts are exact, by n-gram, each told apart by 64 bits, over all documents; they grow with the corpus and no task holds
more than a share of them. Documents are gathered into chunks of bounded size. A chunk sends its distinct n-grams with
their counts to the parts of the key space, once; a part sums them and answers each chunk with the totals, in the order
of the chunk's keys, so that no key travels back. Chunks and answers meet, and the losses are worked out from the texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import LOWER_BYTES, WordHashes, columns, read, settle, spread_hash, unused

#: Weight of the bigram against the unigram estimate; mass added to a unigram.
LAMBDA = 0.7
ADD = 0.5
#: What stands before the first word of a text.
START = 1
#: Ids of target documents that are broadcast, at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text in a chunk (or one longer text); tokens whose n-grams one part of the key space holds, on average.
CHUNK_BYTES = 4_000_000
PART_TOKENS = 2_000_000
#: The chunk that a part's number of words is filed under.
SUMS = -1

_BLOB = "target binary, background binary"


def token_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or b"").translate(LOWER_BYTES).split())


def squeezed(values: np.ndarray) -> bytes:
    """64-bit values as compressed planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Rising keys as the steps between them."""
    return np.diff(keys, prepend=np.uint64(0))


@dataclass
class Text:
    """The words of some documents end to end, and their n-grams: even keys are words, odd ones pairs."""

    words: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], hashes: WordHashes) -> Text:
        parts = [token_hashes(t, hashes) & ~np.uint64(1) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate([np.empty(0, np.uint64), *parts])
        before = np.r_[np.uint64(START), words[:-1]] if len(words) else words.copy()
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
        return cls(words, before, np.repeat(np.arange(len(texts)), sizes), sizes)

    def pairs(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return spread_hash(self.before * np.uint64(0x9E3779B97F4A7C15) + self.words) | np.uint64(1)


def chunks(docs: DataFrame, text: str, keep: list[str], target: str | None) -> DataFrame:
    """(chunk, n_tokens, n_target, payload): all rows of docs, in bounded chunks, settled; payload holds keep columns,
    target and text."""
    size = CHUNK_BYTES
    chosen = docs.select(*columns(keep), (F.col(target) if target else F.lit(None)).cast("boolean").alias(unused(keep, "__target")), F.col(text).cast("binary").alias(unused(keep, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            sink = io.BytesIO()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            tokens = np.array([len((t or b"").split()) for t in table.column(table.num_columns - 1).to_pylist()], np.int64)
            good = np.array([bool(t) for t in table.column(table.num_columns - 2).to_pylist()], bool)
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([int(tokens.sum())]), pa.array([int(tokens[good].sum())]), pa.array([sink.getvalue()], pa.binary())], ["chunk", "n_tokens", "n_target", "payload"])

        filled = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False) + 64)
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + size - filled, "right")))
                held.append(batch.slice(at, to - at))
                filled += int(ends[to - 1]) - done
                at = to
                if filled >= size or at < batch.num_rows:
                    yield out()
                    filled = 0
        if held:
            yield out()

    return settle(chosen.mapInArrow(run, "chunk bigint, n_tokens bigint, n_target bigint, payload binary"))


def _read(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _grams(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of words and pairs, rising, and the places of all tokens' words, then of their pairs."""
    return np.unique(np.r_[text.words, text.pairs()], return_inverse=True)


def asked(held: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, keys, target, background): each chunk's distinct n-grams with its counts, by part of the key space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _read(payload.as_py())
                texts = Text.of(table.column(table.num_columns - 1).to_pylist(), hashes)
                keys, place = _grams(texts)
                if not len(keys):
                    continue
                good = np.array([bool(t) for t in table.column(table.num_columns - 2).to_pylist()], bool)[texts.doc]
                target = np.bincount(place, np.r_[good, good], len(keys)).astype(np.uint64)
                background = np.bincount(place, minlength=len(keys)).astype(np.uint64) - target
                part = part_of(keys, parts)
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                rows = [(int(part[a]), chunk, squeezed(_steps(keys[a:b])), squeezed(target[a:b]), squeezed(background[a:b])) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "keys", "target", "background"])

    return held.select("chunk", "payload").mapInArrow(run, f"part int, chunk bigint, keys binary, {_BLOB}")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _summed(table: pa.Table) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The chunks' keys, and all keys of the part with their counts by corpus."""
    chunk = table.column("chunk").to_pylist()
    sent = [np.cumsum(opened(b), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    keys, place = np.unique(np.concatenate([np.empty(0, np.uint64), *sent]), return_inverse=True)
    counts = []
    for corpus in ("target", "background"):
        values = np.concatenate([np.empty(0, np.uint64), *(opened(b) for b in table.column(corpus).to_pylist())])
        counts.append(np.zeros(len(keys), np.int64))
        np.add.at(counts[-1], place, values.astype(np.int64))
    return list(zip(chunk, sent, strict=True)), keys, *counts


def _answers(part: int, chunks_: list[tuple[int, np.ndarray]], keys: np.ndarray, target: np.ndarray, background: np.ndarray) -> list[tuple]:
    rows = []
    for chunk, sent in chunks_:
        at = np.searchsorted(keys, sent)
        at[at == len(keys)] = 0
        known = keys[at] == sent if len(keys) else np.zeros(len(sent), bool)
        rows.append((chunk, part, len(sent), *(squeezed(np.where(known, c[at] if len(c) else 0, 0)) for c in (target, background))))
    return rows


_ANSWER = f"chunk bigint, part int, n bigint, {_BLOB}"


def _answer_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "part", "n", "target", "background"])


def exchanged(sent: DataFrame) -> DataFrame:
    """Answers to each chunk from the counts that the same chunks sent, and each part's number of words; settled."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        chunks_, *counts = _summed(table)
        return _answer_table([(SUMS, part, int((counts[0] & np.uint64(1) == 0).sum()), None, None), *_answers(part, chunks_, *counts)])

    return settle(sent.groupBy("part").applyInArrow(run, _ANSWER))


@dataclass
class Model:
    """Counts of all documents; the first of two is the target's, the second the background's.

    table: (part, keys, target, background), the n-grams of a part of the key space. size: words of the vocabulary and one
    for those not seen. tokens: scaled tokens by corpus.
    """

    table: DataFrame | None
    parts: int
    size: int
    tokens: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, table: DataFrame | None, parts: int, size: int, tokens: np.ndarray) -> Model:
        least = tokens[tokens > 0].min() if (tokens > 0).any() else 0
        scale = np.where(tokens > 0, least / np.maximum(tokens, 1), 1)
        return cls(table, parts, size, tokens * scale, scale)

    @property
    def words(self) -> np.ndarray:
        """Scaled counts of all words, by corpus."""
        return self.tokens

    def _rows(self, odd: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, *counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    keys = np.cumsum(opened(keys), dtype=np.uint64)
                    own = keys & np.uint64(1) == odd
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)[own]) for x in (keys, *map(opened, counts))], ["key", "target", "background"])

        return self.table.select("keys", "target", "background").mapInArrow(run, "key bigint, target bigint, background bigint")

    @property
    def singles(self) -> DataFrame:
        """(key, target, background): a row a word."""
        return self._rows(0)

    @property
    def pairs(self) -> DataFrame:
        """(key, target, background): a row a pair of word before and word."""
        return self._rows(1)


def _parts(held: DataFrame) -> tuple[int, np.ndarray]:
    """Parts of the key space for these chunks, and tokens by corpus."""
    row = held.agg(F.sum("n_tokens").alias("n"), F.sum("n_target").alias("t")).first()
    n, t = row["n"] or 0, row["t"] or 0
    return max(1, -(-n // PART_TOKENS)), np.array([t, n - t], np.float64)


def train(docs: DataFrame) -> Model:
    """docs: (target boolean, text); what is no target is background. An empty table gives a model of no words."""
    held = chunks(docs, "text", [], "target")
    parts, tokens = _parts(held)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, keys, target, background = _summed(table)
        return pa.table([pa.array([part], pa.int32()), pa.array([int((keys & np.uint64(1) == 0).sum())]), *(pa.array([squeezed(x)], pa.binary()) for x in (_steps(keys), target, background))], ["part", "n_words", "keys", "target", "background"])

    table = settle(asked(held, parts).groupBy("part").applyInArrow(run, f"part int, n_words bigint, keys binary, {_BLOB}"))
    return Model.of(table, parts, (table.agg(F.sum("n_words")).first()[0] or 0) + 1, tokens)


def _losses(texts: Text, counted: np.ndarray, place: np.ndarray, totals: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """The mean loss of each document under both corpora; counted: 1 target, 0 background, -1 neither, by document."""
    n, doc = len(texts.words), texts.doc
    word, pair = place[:n], place[n:]
    # how often the document itself has each token's word, pair and word before
    kinds = int(place.max()) + 1 if n else 1
    held, back, times = np.unique(np.r_[doc, doc] * kinds + place, return_inverse=True, return_counts=True)
    own_word, own_pair = times[back[:n]], times[back[n:]]
    first = texts.before == START
    prev, own_prev = np.r_[0, word[:-1]] if n else word, np.r_[0, own_word[:-1]] if n else own_word
    sizes = texts.sizes.astype(np.float64)
    out = []
    for k, all_ in enumerate(totals):
        own = (counted == (1 - k))[doc]
        scale = float(model.scale[k])
        rest = lambda at, less: np.maximum(all_[at] - np.where(own, less, 0), 0) * scale  # noqa: B023, E731
        both, single = rest(pair, own_pair), rest(word, own_word)
        before = np.where(first, 0.0, np.maximum(rest(prev, own_prev), both))
        tokens = np.maximum(float(model.tokens[k]) - np.where(counted == (1 - k), sizes, 0) * scale, 0.0)[doc]
        plain = (single + ADD) / (tokens + ADD * model.size)
        chance = np.where(before > 0, LAMBDA * both / np.where(before > 0, before, 1.0) + (1 - LAMBDA) * plain, plain)
        out.append(np.bincount(doc, -np.log(chance), len(sizes)) / np.maximum(sizes, 1))
    return out


def _scored(held: DataFrame, answers: DataFrame, model: Model, keep: list[str], schema: str) -> DataFrame:
    """Chunks with the answers to them; a chunk without a word has none."""
    tokens, scale, size, parts = model.tokens, model.scale, model.size, model.parts
    plain = Model(None, parts, size, tokens, scale)
    hashes = WordHashes()

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        table = _read(chunk.column("payload")[0].as_py())
        texts = Text.of(table.column(table.num_columns - 1).to_pylist(), hashes)
        _, place = _grams(texts)
        order = np.argsort(found.column("part").to_numpy())
        totals = [np.concatenate([np.empty(0, np.int64), *(opened(column[int(i)].as_py()).astype(np.int64) for i in order)]) for column in (found.column("target"), found.column("background"))]
        counted = np.array([-1 if t is None else int(t) for t in table.column(table.num_columns - 2).to_pylist()], np.int64)
        none = texts.sizes == 0
        losses = _losses(texts, counted, place, totals, plain)
        columns = [pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1])]
        return pa.table([*(table.column(i) for i in range(len(keep))), pa.array(texts.sizes), *columns], names)

    names = [*keep, "n_tokens", "target_loss", "background_loss", "difference"]
    return held.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns(keep)).schema.fields) + "n_tokens bigint, target_loss double, background_loss double, difference double"


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, target: str | None = None) -> DataFrame:
    """keep columns, n_tokens, target_loss, background_loss, difference (target's less background's), a row a row of docs.

    target names a column that tells which corpus counted the row, if any; its counts are left out there. A text without
    words (or null) has 0 tokens and null losses. Repeated rows, equal texts and null ids each get a row; columns that
    are not kept are not read. Texts are read whole. Empty in, empty out.
    """
    keep = keep if keep is not None else ["doc_id"]
    held = chunks(docs, text, keep, target)

    def run(sent: pa.Table, known: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return _answer_table([])
        asked_ = [(c, np.cumsum(opened(b), dtype=np.uint64)) for c, b in zip(sent.column("chunk").to_pylist(), sent.column("keys").to_pylist(), strict=True)]
        keys = np.cumsum(opened(known.column("keys")[0].as_py()), dtype=np.uint64) if known.num_rows else np.empty(0, np.uint64)
        counts = [opened(known.column(c)[0].as_py()).astype(np.int64) if known.num_rows else np.empty(0, np.int64) for c in ("target", "background")]
        return _answer_table(_answers(sent.column("part")[0].as_py(), asked_, keys, *counts))

    answers = settle(asked(held, model.parts).groupBy("part").cogroup(model.table.drop("n_words").groupBy("part")).applyInArrow(run, _ANSWER))
    return _scored(held, answers, model, keep, _schema(docs, keep))


def weigh(docs: DataFrame, text: str = "text", keep: list[str] | None = None, target: str = "target") -> DataFrame:
    """score() of docs under the model that docs themselves train, in one exchange: what is no target is background."""
    keep = keep if keep is not None else ["doc_id"]
    held = chunks(docs.withColumn(target, F.coalesce(F.col(target), F.lit(False))), text, keep, target)
    parts, tokens = _parts(held)
    answers = exchanged(asked(held, parts))
    size = (answers.filter(F.col("chunk") == SUMS).agg(F.sum("n")).first()[0] or 0) + 1
    return _scored(held, answers.filter(F.col("chunk") != SUMS), Model.of(None, parts, size, tokens), keep, _schema(docs, keep))


def targets(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", name: str = "target") -> DataFrame:
    """docs and `name`: true where a label row of its id is 1; a null id or no label is background. A column of docs with
    that very name gives way to it; choose another name to keep it."""
    mark = unused(docs.columns, "__good")
    good = settle(labels.filter(F.col(label) == 1).select(F.col(key).alias(mark)).distinct())
    if good.count() <= BROADCAST_IDS:  # beyond, both sides are dealt out by id
        good = F.broadcast(good)
    return docs.join(good, F.col(key) == F.col(mark), "left").withColumn(name, F.col(mark).isNotNull()).drop(mark)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(targets(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")))
