"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its runs of 1 to GRAMS consecutive words, and a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. Words
are looked up in an Aho-Corasick dictionary: each distinct word stands in it between two delimiters, so a scan reports whole words only, and
carries the CRC and the length of its bytes. A scan of a text gives these payloads, and the CRC of a run of words follows from its words' payloads
alone, as CRC(ab) is CRC(a) moved on by the length of b, xor CRC(b). A word that the dictionary lacks is a gap between matches; it is
hashed once and enters the dictionary, which is built anew whenever a quarter is new. It holds at most WORDS words of at most LONG letters,
so its size is fixed; other words are hashed as they are met, with the same result.

Counts of all documents and of the target give each bucket's gain, a floored log-ratio; a document's weight is the sum of its
features' gains, and its score adds noise drawn from a hash of its id. Buckets are BUCKETS rows at most, which is all that reaches the
driver. The highest scores are ranked by one range partition: a row's number is its place in its partition and the rows before that one.

Defined results: A-Z is lower-cased, nothing else; a null or empty text has no features, weight 0, and is never drawn; a null id draws as an empty one and comes
last among equal scores; rows that repeat or share an id are each counted, scored and ranked; a text of any length is read whole, in pieces; with an empty target all
counts of it are 0; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from loadscape.llm.common import kept, partitions

BUCKETS, GRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
WORDS, LONG, _SLICE = 1 << 17, 64, 1 << 20

# what a character becomes: itself, its lower case, or the delimiter
_FOLD = np.full(128, 32, np.uint32)
for _c in (*range(48, 58), *range(97, 123)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def _moved_by_one() -> np.ndarray:
    """What a zero byte makes of each bit of a CRC-32 register."""
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


def _applied(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after `size` more zero bytes: the bits of size select from one operator, squared again and again."""
    crc, columns, bit = crc.copy(), _moved_by_one(), 0
    while len(size) and int(size.max()) >> bit:
        some = np.flatnonzero(size >> bit & 1)
        crc[some] = _applied(columns, crc[some])
        columns, bit = _applied(columns, columns), bit + 1
    return crc


def joined(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of left, a blank and right, from theirs."""
    blank = moved(np.full(len(right[0]), zlib.crc32(b" "), np.uint32), right[1]) ^ right[0]
    return moved(left[0], right[1] + 1) ^ blank, left[1] + 1 + right[1]


def folded(text: str) -> np.ndarray:
    """Code points of a text, lower-cased, with a blank for each delimiter."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)


class Dictionary:
    """Distinct words, each between two blanks, with the CRC and the length of its bytes."""

    def __init__(self, most: int = WORDS, long: int = LONG):
        self.most, self.long, self.known, self.fresh, self.automaton = most, long, {}, {}, None

    def payloads(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of folded text end (exclusive), and their payloads: the CRC, and the length from bit 32 on."""
        edge = np.diff(np.concatenate(([True], codes == 32, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        text, out = f" {codes.astype('<u4').tobytes().decode('utf-32-le')} ", np.full(len(ends), -1, np.int64)
        if self.automaton is not None:
            # a match ends with the blank behind the word, one further on for the blank in front of the text
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            out[np.searchsorted(ends, found[:, 0] - 1)] = found[:, 1]
        gaps = np.flatnonzero(out < 0)
        words, new = [text[a + 1 : b + 1] for a, b in zip(starts[gaps].tolist(), ends[gaps].tolist())], {}
        for w in set(words):
            data = w.encode()
            new[w] = self.fresh.get(w) or zlib.crc32(data) | len(data) << 32
        out[gaps] = np.fromiter(map(new.__getitem__, words), np.int64, len(words))
        self._learn(new)
        return ends, out

    def _learn(self, new: dict[str, int]) -> None:
        room = self.most - len(self.known) - len(self.fresh)
        for w in new if room > 0 else ():
            if len(w) <= self.long and len(self.fresh) + len(self.known) < self.most:
                self.fresh[w] = new[w]
        if self.fresh and (len(self.fresh) * 4 >= len(self.known) or len(self.known) + len(self.fresh) >= self.most):
            self.known |= self.fresh
            self.fresh = {}
            self.automaton = ahocorasick.Automaton()
            for w, payload in self.known.items():
                self.automaton.add_word(f" {w} ", payload)
            self.automaton.make_automaton()


@lru_cache(maxsize=1)
def _dictionary(most: int) -> Dictionary:
    """One for all tasks of a worker process; what it has learnt changes no result."""
    return Dictionary(most)


def _long_text(words: Dictionary, text: str) -> np.ndarray:
    """Payloads of a long text, scanned in pieces that end between two words."""
    out, rest = [], np.zeros(0, np.uint32)
    for at in range(0, len(text), _SLICE):
        codes = np.concatenate((rest, folded(text[at : at + _SLICE])))
        blanks = np.flatnonzero(codes == 32)
        cut = len(codes) if at + _SLICE >= len(text) else int(blanks[-1]) if len(blanks) else 0
        out.append(words.payloads(codes[:cut])[1])
        rest = codes[cut:]
    return np.concatenate(out)


def payloads(words: Dictionary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of the words of all texts, and the number of words of each."""
    out, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        if len(texts[at]) > _SLICE:
            out.append(_long_text(words, texts[at]))
            counts[at], at = len(out[-1]), at + 1
            continue
        some, held = [], 0
        while at + len(some) < len(texts) and held + len(texts[at + len(some)]) <= _SLICE:
            some.append(texts[at + len(some)])
            held += len(some[-1])
        ends, found = words.payloads(folded(" ".join(some)))
        upto = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in some]), side="left")
        counts[at : at + len(some)] = np.diff(upto, prepend=0)
        out.append(found)
        at += len(some)
    return np.concatenate([np.zeros(0, np.int64), *out]), counts


def feature_buckets(found: np.ndarray, counts: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of the features of texts, in the order of texts."""
    text = np.repeat(np.arange(len(counts)), counts)
    word = (found & 0xFFFFFFFF).astype(np.uint32), found >> 32
    run, keys = word, [text * buckets + word[0] % np.uint32(buckets)]
    for n in range(2, grams + 1):
        # runs that start at each word and stay in its text; the last n - 1 words have none
        whole = text[n - 1 :] == text[: len(text) - n + 1]
        if not len(whole):
            break
        run = joined((run[0][: len(whole)], run[1][: len(whole)]), (word[0][n - 1 :], word[1][n - 1 :]))
        keys.append((text[: len(whole)] * buckets + run[0] % np.uint32(buckets))[whole])
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    return key // buckets, key % buckets, times


def features(docs: DataFrame, *keep: str, grams: int = GRAMS, buckets: int = BUCKETS, words: int = WORDS, text_col: str = "text") -> DataFrame:
    """The columns in keep, n_words, n_features, and buckets and times (arrays) of every row."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("n_words", "long").add("n_features", "long").add("buckets", ArrayType(IntegerType())).add("times", ArrayType(IntegerType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = payloads(_dictionary(words), [t or "" for t in batch["_text"].to_pylist()])
            text, bucket, times = feature_buckets(found, counts, grams, buckets)
            ends = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
            n = sum((np.maximum(counts - k, 0) for k in range(grams)), np.zeros(len(counts), np.int64))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (bucket, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), pa.array(n), *lists], names=schema.fieldNames())

    return rows.mapInArrow(scan, schema)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket has a feature in all rows; at most `buckets` rows reach the driver."""
    rows = found.select(F.explode(F.arrays_zip("buckets", "times")).alias("b")).groupBy("b.buckets").agg(F.sum("b.times").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["buckets"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of how much likelier it is in the target, rounded down."""
    ratio = ((target + 1) * (source.sum() + len(source))).astype(float) / ((source + 1) * (target.sum() + len(target))).astype(float)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found, with weight in place of buckets and times."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # of fixed size
    rest = [c for c in found.columns if c not in ("buckets", "times")]
    schema = found.select(rest).schema.add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = (batch[c].flatten().to_numpy() for c in ("buckets", "times"))
            ends = np.concatenate(([0], np.cumsum(batch["buckets"].value_lengths().to_numpy())))
            sums = np.concatenate(([0], np.cumsum(shared.value[bucket] * times)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=schema.fieldNames())

    return found.select(*rest, "buckets", "times").mapInArrow(weigh, schema)


def noise(id_col: str, seed: int = SEED) -> F.Column:
    """A Gumbel draw in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: F.Column) -> DataFrame:
    """rows with their number (from 1) in a global order: one range partition, then the rows before each part are added."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    # such an id is the partition's number, then the row's in it
    placed = kept(ordered.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)), "importance-order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, "_part").withColumn("number", number).drop("_part", "_place", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, grams: int = GRAMS, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; a rank is drawn by percent of those with least_words words."""
    shape = {"grams": grams, "buckets": buckets, "words": words}
    found = kept(features(docs, "doc_id", **shape), "importance-features")
    gain = gains(bucket_counts(features(target, **shape), buckets), bucket_counts(found, buckets))
    scored = kept(weighted(found, gain).withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    enough = F.col("n_words") >= least_words
    n = percent * scored.filter(enough).count() // 100
    ranked = numbered(scored, enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc())
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("number") <= n, F.col("number")).alias("rank"))
