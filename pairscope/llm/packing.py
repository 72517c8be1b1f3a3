"""Hierarchical multi-length packing of tokenized documents.

Each task packs the documents of its own partition, so nothing is shuffled and any partition can be redone alone.
Whole windows of a long document stand by themselves. What is left of each is routed to the tier of the least context
size that holds it; the longest tier is packed first, the gap of each of its windows is filled from the shorter tiers
(largest that fits, then a cut of the least that does not), and so on down. What remains at the end of a round is laid
out in powers of two, which need no padding. Sequences of one length form step groups of equal tokens.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import read

CONTEXT = 4096
TIERS = (4096, 2048, 1024, 512)
END = 2
#: Documents and tokens whose remainders are packed together, at most; tokens of a step group.
ROUND_DOCS = 4096
ROUND_TOKENS = 4_000_000
STEP_TOKENS = 65_536
#: Words and pieces of words whose ids a worker remembers, at most: the half met last, and the half before it.
CACHED_WORDS = 400_000


class Tokens(dict):
    """A word's ids as little-endian unsigned 16-bit bytes, by the tokenizer file; words end at ASCII white space.

    The tokenizer drops white space, so words can be encoded alone. Plain words go straight to its merge model;
    others through the whole tokenizer.
    """

    PLAIN = re.compile(rb"[A-Za-z]+[.,;:!?]*\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 65_536:
            raise ValueError("ids beyond 16 bits")
        self.before: dict[bytes, bytes] = {}
        letters = r"a-zß-öø-ÿ"
        self.latin = re.compile("[" + letters + r"0-9!-/:-@\[-`{-~]+\Z")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+")
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        # the short way holds only for the pipeline it copies; a probe text tells
        probe = "Thé qüick, don't we'll 12a «x» <|b|> ßø THE.,"
        expected = self.whole.encode(probe, add_special_tokens=False).ids
        self.short = True
        self.short = expected == np.frombuffer(self.ids(probe.encode()), "<u2").tolist()
        self.clear()
        self.before.clear()

    def _keep(self, word: bytes, value: bytes) -> bytes:
        if len(word) < 200:
            if len(self) >= CACHED_WORDS // 2:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece of a word; as a word by itself it has the same, so both are remembered once."""
        key = piece.encode()
        found = self.get(key)
        if found is None:
            found = self.before.get(key)
            if found is None:
                shown = piece if piece.isascii() else key.decode("latin-1").translate(self.shown)
                found = np.array([t.id for t in self.whole.model.tokenize(shown)], "<u2").tobytes()
            self._keep(key, found)
        return found

    def __missing__(self, word: bytes) -> bytes:
        value = self.before.get(word)
        if value is None and self.short and len(word) < 1000:
            if word.isalpha():
                value = self._piece(word.lower().decode())
            elif not any(s in word for s in self.special):
                text = word.decode()
                low = text.lower()
                if self.latin.match(low) and len(low) == len(text) and unicodedata.is_normalized("NFC", text):
                    value = b"".join(map(self._piece, self.split.findall(low)))
        if value is None:
            value = np.array(self.whole.encode(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        return self._keep(word, value)

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The tokenizer of this worker process, loaded once."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack_round(left: list[tuple[int, int]], tiers: tuple[int, ...] = TIERS) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document's place, tokens before, tokens) for remainders (place, tokens) under the longest tier.

    All but the last few sequences have a tier's length; the last are powers of two. Nothing is padded.
    """
    spare: list[tuple[int, int, int]] = sorted((n, k, 0) for k, n in left if n)  # (tokens, place, tokens before)
    for i, tier in enumerate(tiers):
        floor = tiers[i + 1] if i + 1 < len(tiers) else 0
        while spare and spare[-1][0] > floor:
            gap, window = tier, []
            while gap and spare:
                at = bisect_right(spare, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    n, k, before = spare.pop(at)
                    window.append((k, before, n))
                    gap -= n
                else:
                    n, k, before = spare.pop(0)
                    window.append((k, before, gap))
                    insort(spare, (n - gap, k, before + gap))
                    gap = 0
            if not gap:
                yield window
                continue
            for size in powers(tier - gap):
                cut: list[tuple[int, int, int]] = []
                while size:
                    k, before, n = window.pop(0)
                    take = min(n, size)
                    cut.append((k, before, take))
                    if take < n:
                        window.insert(0, (k, before + take, n - take))
                    size -= take
                yield cut


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end: int = END, tiers: tuple[int, ...] = TIERS, step: int = STEP_TOKENS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group.

    Every row of docs is a document of its own, a repeated or null id too (its pieces share sequences as any other's).
    A null text is empty and yields the end id alone. A document of any length is cut at the longest tier. Empty in,
    empty out; other columns are not read.
    """
    context = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        space = TaskContext.get().partitionId() << 40
        n_sequences = 0
        steps: dict[int, int] = {}
        close = np.array([end], "<u2").tobytes()
        rows: list[tuple] = []
        held: list[tuple] = []  # (doc_id, doc_tokens, tokens before, ids)
        size = 0

        def emit(sequence: list[tuple], length: int) -> None:
            nonlocal n_sequences
            group = steps.get(length, 0)
            steps[length] = group + 1
            offset = 0
            for doc, total, start, ids in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, space | n_sequences, offset, length, space | (length.bit_length() << 32) | (group * length // step)))
                offset += len(ids)
            n_sequences += 1

        def finish() -> None:
            for sequence in pack_round([(k, len(h[3])) for k, h in enumerate(held)], tiers):
                emit([(held[k][0], held[k][1], held[k][2] + before, held[k][3][before : before + n]) for k, before, n in sequence], sum(n for _, _, n in sequence))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = np.frombuffer(coder.ids(value.as_py() or b"") + close, "<u2")
                whole = len(ids) // context * context
                for at in range(0, whole, context):
                    emit([(doc, len(ids), at, ids[at : at + context])], context)
                if whole < len(ids):
                    held.append((doc, len(ids), whole, ids[whole:]))
                    size += len(ids) - whole
                if len(held) >= ROUND_DOCS or size >= ROUND_TOKENS:
                    finish()
                    held, size = [], 0
                if len(rows) >= 20_000:
                    yield out()
        finish()
        yield out()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), default_path())
