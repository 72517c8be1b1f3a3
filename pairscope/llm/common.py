"""What the corpus operators share: words, scratch tables, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.storage import scratch, settle, shared_dir  # noqa: F401

#: White space that ends a word: space and the characters 0x09 to 0x0D. bytes.split() ends words at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bars(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, dict]:
    """(__value, __bar) for rows of a uniform long under which there are `most` of each value of `by`, or somewhat more,
    and the rows of each value."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    held = [(value, 2**63 - 1 if (share := 1.5 * most / n + 50 / n) >= 1 else int(-(2**63) + share * 2**64)) for value, n in counts.items()]
    return rows.sparkSession.createDataFrame(held, f"__value {rows.schema[by].dataType.simpleString()}, __bar bigint"), counts


def least(rows: DataFrame, by: str, order: Column, key: str, most: int) -> tuple[list[tuple[object, object]], dict]:
    """(key, value of `by`) of `most` rows of each value, those of the least hashes, and the rows of each value in all."""
    under, counts = bars(rows, by, most)
    near = rows.select(key, by, order.alias("o")).join(F.broadcast(under), F.col(by) == F.col("__value")).filter(F.col("o") <= F.col("__bar")).select(key, by, "o").collect()
    taken: dict = dict.fromkeys(counts, 0)
    out = []
    for r in sorted(near, key=lambda r: (r["o"], str(r[key]))):
        taken[r[by]] += 1
        if taken[r[by]] <= most:
            out.append((r[key], r[by]))
    return out, counts


#: Bytes of text that a sample brings to the driver, at most.
SAMPLE_BYTES = 64_000_000


def bounded_sample(rows: DataFrame, by: str, order: Column, text: str, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, object]], dict]:
    """(text, value of `by`) of at most `most` rows of each value and `most_bytes` in all, and the rows of each value in all.

    The rows taken have the least hashes (`order`, a uniform long, then the text's), so the choice does not depend on how
    rows are dealt; rows equal in both stand for one. One pass counts the values without reading texts, a second settles
    the rows under each value's threshold, somewhat more than are wanted. Every value is counted and learned from.
    """
    spark = rows.sparkSession
    under, counts = bars(rows, by, most)
    if not counts:
        return [], {}
    ordered = rows.select(F.col(text).alias("text"), F.col(by).alias("value"), order.alias("o"))
    near = settle(ordered.join(F.broadcast(under), F.col("value") == F.col("__value")).filter(F.col("o") <= F.col("__bar")).withColumn("h", F.xxhash64("text")).drop("__value", "__bar"))
    drawn = sorted(near.groupBy("value", "o", "h").agg(F.max(F.octet_length("text")).alias("bytes")).collect(), key=lambda r: (r["o"], r["h"], str(r["value"])))
    taken: dict = dict.fromkeys(counts, 0)
    chosen, size = [], 0
    for r in drawn:
        if taken[r["value"]] < most and size + r["bytes"] <= most_bytes:
            taken[r["value"]] += 1
            size += r["bytes"]
            chosen.append((r["value"], r["o"], r["h"]))
    if not chosen:
        return [], counts
    keys = spark.createDataFrame(chosen, f"__v {rows.schema[by].dataType.simpleString()}, __o bigint, __h bigint")
    same = (F.col("value") == F.col("__v")) & (F.col("o") == F.col("__o")) & (F.col("h") == F.col("__h"))
    found = near.join(F.broadcast(keys), same).groupBy("value", "o", "h").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["o"], r["h"], str(r["value"])))
    return [(r["text"], r["value"]) for r in found], counts


def unused(names: list[str], wish: str) -> str:
    """wish, or that with underscores added until no column has the name, whatever the case of letters."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


def columns(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def packed(docs: DataFrame) -> Column:
    """A row of docs as one struct, so that no name of its columns can meet another."""
    return F.struct(*columns(docs.columns))


def held_out(key: str, of: int, value: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder (a null id has the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == value


#: A-Z to a-z for bytes, all else as it is.
LOWER_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def spread_hash(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), for arrays of unsigned longs."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all beyond a fixed number of words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[i : i + n]
    return spread_hash(out)


def bitmap(keys: DataFrame, column: str, least: int = 20, most: int = 29) -> np.ndarray:
    """Which places of a table of bits the longs of a column fall on: a filter that lets through all of them.

    The table has eight places a key, but 2**most (64 MB) at most, so it can be broadcast whatever the input; other keys
    that it lets through by chance cost work only.
    """
    n = keys.count()
    bits = int(min(most, max(least, np.ceil(np.log2(8 * max(1, n))))))
    words = keys.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    held = settle(words)
    parts = 8
    for k in range(parts):
        table = held.filter(F.pmod(F.col("w"), F.lit(parts)) == k).toArrow()
        out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) >> np.uint64(64 - (6 + len(table).bit_length() - 1))
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
