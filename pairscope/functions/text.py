"""Text measures as columns: tokens, pattern counts, overlap, shingles, hashes."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words left out of content tokens.
STOP = [
    "a", "an", "the", "is", "was", "are", "were", "be", "been", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "that", "this", "it", "its", "he", "she", "they", "his", "her", "their", "and", "or", "but", "if",
    "then", "than", "so", "such", "not", "no", "nor", "do", "does", "did", "has", "have", "had", "will", "would", "can", "could", "may", "might", "must", "should",
]
#: Counted patterns.
PATTERNS = {
    "negation": r"(?i)\b(not|no|never|n't|neither|nor|without)\b",
    "comparative": r"(?i)\b(more|less|fewer|most|least|\w+er than|\w+est)\b",
    "number": r"\d+(?:[.,]\d+)*",
    "date": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,4}\b|\b\d{4}\b|\b(?:19|20)\d{2}s?\b",
    "pronoun": r"(?i)\b(he|she|it|they|him|her|his|hers|its|their|them|this|that|these|those)\b",
    "modal": r"(?i)\b(can|could|may|might|must|shall|should|will|would)\b",
    "conjunction": r"(?i)\b(and|but|or|so|because|while|whereas|however|although)\b",
}
TOKEN = r"[A-Za-z0-9']+"


def normalized(c: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def plain(c: Column) -> Column:
    """The text with every character beyond ASCII as a space, so that word ends are the same for any regex engine."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content(c: Column) -> Column:
    """Distinct tokens without function words."""
    return F.array_except(tokens(c), F.array(*(F.lit(w) for w in STOP)))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PATTERNS["number"]), F.lit(0)))


def overlap(claim: Column, evidence: Column) -> dict[str, Column]:
    """Share of the claim's content tokens in the evidence, Jaccard, share of its numbers (1 if it has none), length ratio."""
    a, b = content(claim), content(evidence)
    na, nb = numbers(claim), numbers(evidence)
    return {
        "lexical_overlap": F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a)),
        "jaccard": F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))),
        "numeric_overlap": F.when(F.size(na) == 0, 1.0).otherwise(F.size(F.array_intersect(na, nb)) / F.greatest(F.lit(1), F.size(na))),
        "length_ratio": F.size(tokens(claim)) / F.greatest(F.lit(1), F.size(tokens(evidence))),
        "date_missing": plain(claim).rlike(PATTERNS["date"]) & ~plain(evidence).rlike(PATTERNS["date"]),
    }


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the normalized text, in one pass of a regex that looks ahead."""
    t = normalized(c)
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nfc(c: Column) -> Column:
    """Canonical composition, which Spark has no function for."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return composed(c)


def page_key(title: Column) -> Column:
    return F.replace(nfc(F.trim(title)), F.lit(" "), F.lit("_"))


def entities(c: Column) -> Column:
    """Distinct runs of capitalized words: a stand-in for a model of named entities, and not equal to one."""
    return F.array_distinct(F.regexp_extract_all(plain(c), F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))


def seeds(n: int) -> list[int]:
    """n fixed 32-bit masks, from the md5 of their numbers."""
    return [int(hashlib.md5(f"mask{i}".encode()).hexdigest()[:8], 16) for i in range(n)]


def minhash(grams: Column, n: int = 200) -> Column:
    """The least of a shingle's 32-bit md5 hash under each of n masks; null for no shingle."""
    hashes = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint"))
    return F.transform(F.array(hashes), lambda h: F.transform(F.array(*(F.lit(s).cast("bigint") for s in seeds(n))), lambda s: F.array_min(F.transform(h, lambda x: x.bitwiseXOR(s)))))[0]


def digest_status(now: Column, recorded: Column, recorded_lf: Column) -> Column:
    """Whether bytes are the recorded ones, the same but for line ends (CRLF for LF), or changed."""
    lf = F.sha2(F.replace(now, F.lit("\r\n"), F.lit("\n")), 256)
    return F.when(F.sha2(now, 256) == recorded, "exact_recorded_bytes").when(lf == recorded_lf, "eol_only_equivalent").otherwise("changed")
