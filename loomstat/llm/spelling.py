"""Spelling variants: words one edit apart, found by generating the full neighbourhood of every word.

Words are counted, those that are long and frequent enough are the vocabulary. For every word all distinct deletions,
replacements and insertions over the observed alphabet are generated in numpy, as hashes that follow from prefix sums of the
word. A filter of the vocabulary's hashes drops those that cannot be words; what passes is spelled out and joined to the
vocabulary as whole strings, so that no distance is ever computed. A word's form is its most frequent near word, if that is
``ratio`` times as frequent; roots follow forms by pointer jumping.

The filter is a bit table of at most MOST_BITS bits (32 MB), whatever the vocabulary; a fuller table lets more candidates
through to the join and loses none. The alphabet has at most the letters of the word pattern.

Defined results: a null text has no words; a null id counts as an empty one in the hash that plants typos; repeated rows count again;
runs of any length are words, their neighbourhoods are generated in slabs; equal counts go to the word that is least in code
points; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, keep
from .textbytes import mix

U64 = np.uint64
#: Bits of the filter a word, before rounding up to a power of two, and its bounds.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Candidates generated at once.
SLAB = 1 << 19
#: Odd factors, one for each place of a hash in the filter.
_SPREAD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93))

_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, typo_every: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, of at least min_length letters and min_count occurrences.

    typo_every plants typos: where it divides h, the crc32 of "<id>:<run>", letter h % length of the run is deleted.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % min_length), F.lit(1)))
    words = docs.select(F.col(id_col).cast("string").alias("id"), run.alias("run"))
    high = F.col("run").rlike(r"[À-Þ]")  # capitals beyond ASCII stay as they are
    word = F.when(high, F.translate("run", UPPER, UPPER.lower())).otherwise(F.lower("run"))
    words = words.select("id", word.alias("word"))
    if typo_every:
        words = words.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        typo = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % typo_every == 0, typo).otherwise(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points as bytes, and where each begins."""
    data = [w.encode("latin-1") for w in words]
    ends = np.cumsum([0, *map(len, data)], dtype=np.int64)
    return np.frombuffer(b"".join(data), np.uint8), ends


def _sums(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix sums of code * base^place with one more entry a word, the powers of each such entry, where each word's begin)."""
    size = np.diff(ends)
    first = ends[:-1] + np.arange(len(size))
    place = np.arange(ends[-1] + len(size)) - np.repeat(first, size + 1)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(int(size.max(initial=0)), _BASE, U64)]), dtype=U64)[place]
    terms = np.zeros(len(place), U64)
    inner = np.ones(len(place), bool)
    inner[first + size] = False
    terms[inner] = _CODE[data] * power[inner]
    before = np.cumsum(terms, dtype=U64) - terms
    return before - np.repeat(before[first], size + 1), power, first


def word_hashes(words: list[str]) -> np.ndarray:
    data, ends = _packed(words)
    sums, _, first = _sums(data, ends)
    return mix(sums[first + np.diff(ends)])


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the filter that belong to each hash."""
    return [((h * f) >> U64(65 - bits.bit_length())).astype(np.int64) for f in _SPREAD]


def passes(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes all of whose bits are set in the table of 64-bit words."""
    left = np.arange(len(h))
    for f in _SPREAD:
        at = (h[left] * f) >> U64(65 - bits.bit_length())
        left = left[(table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1]
    return left


def neighbourhood(words: list[str], alphabet: np.ndarray, least: int = 0) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs of (kind, hash, word, place, letter) of all distinct deletions, replacements and insertions of the words.

    A deletion or insertion beside an equal letter is made at one place only, so every candidate comes once. Candidates
    shorter than `least` are left out.
    """
    data, ends = _packed(words)
    sums, power, first = _sums(data, ends)
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(owner)) - first[owner]
    whole = sums[first + size]
    last = place == size[owner]
    letter = np.zeros(len(owner), np.uint8)
    letter[~last] = data
    before = np.concatenate([[0], letter[:-1]]).astype(np.uint8)
    step = max(1, SLAB // max(1, len(alphabet)))
    for a in range(0, len(owner), step):
        s = slice(a, a + step)
        own, at, here, prior, edge, low, up = owner[s], place[s], letter[s], before[s], last[s], sums[s], power[s]
        inside = ~edge
        rest = whole[own] - low
        can = inside & ~((at > 0) & (here == prior)) & (size[own] > least)
        tail = (rest - _CODE[here] * up) * _BACK
        yield "delete", mix((low + tail)[can]), own[can], at[can], np.zeros(can.sum(), np.uint8)
        codes = _CODE[alphabet][None, :] * up[:, None]
        for kind, base, good in (
            ("replace", whole[own] - _CODE[here] * up, inside[:, None] & (alphabet[None, :] != here[:, None])),
            ("insert", low + rest * _BASE, (at == 0)[:, None] | (alphabet[None, :] != prior[:, None])),
        ):
            h = mix((base[:, None] + codes)[good])
            i, c = np.nonzero(good)
            yield kind, h, own[i], at[i], alphabet[c]


def _spelled(word: str, kind: str, at: int, letter: int) -> str:
    return word[:at] + (chr(letter) if kind != "delete" else "") + word[at + (kind != "insert") :]


def _filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the vocabulary's hashes as 64-bit words: bits are set by an aggregation, bits / 64 rows at most come back."""

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(probes(word_hashes(batch.column("word").to_pylist()), bits)))
            bit = np.left_shift(U64(1), (at & 63).astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit)], ["slot", "bit"])

    found = vocabulary.select("word").mapInArrow(places, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, U64)
    table[found["slot"].to_numpy()] = found["bit"].to_numpy().view(U64)
    return table


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all words of vocabulary(word, n) that differ by exactly one edit. The vocabulary is a written table."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # 90 at most
    size, least = vocabulary.agg(F.count(F.lit(1)), F.min(F.length("word"))).first()
    schema = "word string, n long, near string"
    if not size:
        return spark.createDataFrame([], f"{schema}, near_n long")
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(size * BITS_A_WORD))))
    sent = spark.sparkContext.broadcast(_filter(vocabulary, bits))

    def generate(batches):
        table = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                for kind, h, own, at, letter in neighbourhood(words, alphabet, least):
                    on = passes(h, table, bits)
                    own = own[on]
                    near = [_spelled(words[i], kind, p, c) for i, p, c in zip(own.tolist(), at[on].tolist(), letter[on].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in own.tolist()], pa.string()), pa.array(n[own], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = vocabulary.repartition(tasks, "word").mapInArrow(generate, schema)
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def variant_forms(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of vocabulary(word, n): word, form, root, n, n_near, form_n. The vocabulary is a written table."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    near = near_words(vocabulary)
    first = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))  # most frequent, then least
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    words = vocabulary.join(best, "word", "left")
    strong = -F.col("best.rank") >= ratio * F.col("n")
    words = keep(words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.rank")).alias("form_n")), "word-forms")
    jumps = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # a form is `ratio` times as frequent as its word, so that chains are short; each turn doubles the steps taken
    chain = math.ceil(math.log(words.agg(F.max("n")).first()[0] or 1, ratio)) + 1
    for _ in range(math.ceil(math.log2(chain + 1))):
        jumps = keep(jumps, "word-roots")
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = jumps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return words.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int | None = None) -> DataFrame:
    """Per word of the texts: word, form, root, n, n_near, form_n."""
    return variant_forms(keep(count_words(docs, id_col, text_col, min_length, min_count, typo_every), "words"), ratio)
