"""Language of a text: multinomial naive Bayes over hashed character trigrams.

Counts come from labelled texts of which documents with held_out true have no part; scoring reads whole texts, in batches. The trigrams of a batch are
a sparse matrix of counts with a row for each text. A language's log-probability of a trigram that it never had is one number, so the matrix of log-probabilities is
sparse as well, what a bucket's languages have above that number, and it is broadcast in blocks of languages of at most ENTRIES numbers. A task holds one block at a
time, and no more than CELLS products.

Parameter BOUND: at most about so many labelled documents of each language, chosen by a hash of id and text, are counted; a language with fewer gives all it
has. There is no bound on the number of languages; a row for each reaches the driver, and its counts one block at a time.

Defined results: a null text, an empty one and one without a letter is `und` with score 0; ties go to the first language by code point; with nothing to learn from,
all are `und`; a null id is not held out and trains as any other; rows that repeat or share an id are each judged (and each count in training); a text of any length is
read whole, in pieces of fixed size; no rows give no rows; other columns are ignored, whatever their names, or kept by `accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.llm.common import kept

BUCKETS, BOUND, SMOOTHING, ENTRIES, CELLS = 1 << 15, 4000, 0.5, 4_000_000, 2_000_000
_CHUNK = 1 << 20
_ASCII_LETTER = re.compile("[A-Za-z]")
_SPACE, _M1, _M2, _M3 = 32, np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_FOLD = np.full(128, _SPACE, np.uint32)
for _c in range(97, 123):
    _FOLD[_c] = _c


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Of UTF-32 codes, the buckets of the trigrams."""
    codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
    h = codes[:-2] * _M1 + codes[1:-1] * _M2 + codes[2:] * _M3
    return (h ^ (h >> np.uint32(15))) * _M1 >> np.uint32(17)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of a lower-cased text with a blank at either end, some at a time."""
    for at in range(0, len(text), _CHUNK):
        # each piece but the first starts with the two characters before it
        yield _buckets(_codes((text[at - 2 : at + _CHUNK] if at else " " + text[:_CHUNK]).lower() + " " * (at + _CHUNK >= len(text))))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start to start + size, for each, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Block:
    """Some languages: of each, its prior and the log-probability of a trigram it never had; by bucket, what others have above that."""

    def __init__(self, langs: list[str], prior: np.ndarray, totals: np.ndarray, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs, self.prior, self.base = langs, prior, np.log(SMOOTHING / (totals + SMOOTHING * BUCKETS))
        by = np.argsort(bucket, kind="stable")
        self.lang, self.above = lang[by].astype(np.int32), np.log((n[by] + SMOOTHING) / SMOOTHING)
        self.start = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))

    def totals(self, text: np.ndarray, bucket: np.ndarray, times: np.ndarray, n_texts: int) -> np.ndarray:
        """(text, language): log-probabilities of texts by their sparse counts."""
        size, out = self.start[bucket + 1] - self.start[bucket], np.zeros(n_texts * len(self.langs))
        upto = np.cumsum(size)
        at = 0
        while at < len(text):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, side="right")))
            some = slice(at, stop)
            places = _spans(self.start[bucket[some]], size[some])
            cell = np.repeat(text[some] * len(self.langs), size[some]) + self.lang[places]
            out += np.bincount(cell, np.repeat(times[some], size[some]) * self.above[places], len(out))
            at = stop
        n = np.bincount(text, times, n_texts)
        return out.reshape(n_texts, -1) + n[:, None] * self.base + self.prior


class Model:
    """Blocks of languages, or broadcasts of them, in the order of languages."""

    def __init__(self, blocks: list, width: int):
        self.blocks, self.width = blocks, width  # width: languages of the largest

    def _each(self):
        for b in self.blocks:
            if isinstance(b, Block):
                yield b
                continue
            yield b.value
            if len(self.blocks) > 1:
                vars(b).pop("_value", None)  # a task holds one block at a time

    def _judged(self, text: np.ndarray, bucket: np.ndarray, times: np.ndarray, n_texts: int) -> list[tuple[str, float]]:
        """Language and score of texts by their sparse counts."""
        # the posterior of a text as sure as this one in every trigram, but of at most 50 trigrams
        flat = np.minimum(1.0, 50 / np.maximum(np.bincount(text, times, n_texts), 1))
        best, lang, mass = np.full(n_texts, -np.inf), np.full(n_texts, "", object), np.zeros(n_texts)
        for block in self._each():
            total = block.totals(text, bucket, times, n_texts)
            top = total.argmax(axis=1)
            most = total[np.arange(n_texts), top]
            new = np.maximum(best, most)
            with np.errstate(invalid="ignore"):
                mass = np.where(mass > 0, mass * np.exp((best - new) * flat), 0.0) + np.exp((total - new[:, None]) * flat[:, None]).sum(axis=1)
            lang = np.where(most > best, np.array(block.langs, object)[top], lang)
            best = new
        return list(zip(lang.tolist(), (1 / mass).tolist()))

    def predict_many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found, batch, held = [("und", 0.0)] * len(texts), [], 0

        def settle() -> None:
            text, bucket, times = _sparse([texts[i] for i in batch])
            for i, best in zip(batch, self._judged(text, bucket, times, len(batch))):
                found[i] = best

        for i, text in enumerate(texts):
            if not self.blocks or not has_letter(text):
                continue
            if len(text) > _CHUNK:
                counts = np.zeros(BUCKETS, np.int64)
                for ids in trigrams(text):
                    counts += np.bincount(ids, minlength=BUCKETS)
                some = np.flatnonzero(counts)
                found[i] = self._judged(np.zeros(len(some), np.int64), some, counts[some], 1)[0]
                continue
            batch.append(i)
            held += len(text)
            if held >= _CHUNK or len(batch) * self.width >= CELLS:
                settle()
                batch, held = [], 0
        if batch:
            settle()
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_many([text])[0]

    def shared(self, spark: SparkSession) -> Model:
        """The same, each block broadcast on its own."""
        return Model([spark.sparkContext.broadcast(b) for b in self.blocks], self.width)


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of the trigrams of texts."""
    pieces = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(p) for p in pieces])
    ids = _buckets(_codes("".join(pieces)))
    # the two trigrams that reach into the next text belong to none
    across = (np.cumsum(sizes)[:-1, None] + np.array([-2, -1])).ravel()
    ids = np.delete(ids, across)
    key, times = np.unique(np.repeat(np.arange(len(texts)) * BUCKETS, sizes - 2) + ids, return_counts=True)
    return key // BUCKETS, key % BUCKETS, times


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = BOUND, entries: int = ENTRIES) -> Model:
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = kept(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    shares = sizes.select(F.col("lang"), F.least(F.lit(1.0), bound / F.col("n")).alias("share"))
    # one row a language, as the driver gets them
    sample = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                some = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": some.astype(np.int32), "n": own[some]})
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for ids in trigrams(text):
                    own += np.bincount(ids, minlength=BUCKETS)
                if len(counts) >= 256:
                    yield from told()
        yield from told()

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = kept(counted, "language-counts")
    by_lang = {r["lang"]: r for r in counted.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).join(sizes.select("lang", F.col("n").alias("docs")), "lang", "right").collect()}
    names, all_docs = sorted(by_lang, key=lambda x: x.encode()), sum(r["docs"] for r in by_lang.values())
    groups: list[list[str]] = []
    held = entries
    for lang in names:
        if held + (by_lang[lang]["rows"] or 0) > entries or len(groups[-1]) * 64 >= entries:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += by_lang[lang]["rows"] or 0
    blocks = []
    for group in groups:
        of = {lang: i for i, lang in enumerate(group)}
        got = (counted if len(groups) == 1 else counted.filter(F.col("lang").isin(group))).toArrow()
        lang = np.array([of[x] for x in got["lang"].to_pylist()], np.int64)
        prior = np.log(np.array([by_lang[x]["docs"] for x in group]) / all_docs)
        blocks.append(Block(group, prior, np.array([by_lang[x]["total"] or 0 for x in group], float), got["bucket"].to_numpy(), lang, got["n"].to_numpy()))
    return Model(blocks, max(map(len, groups), default=0))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, the columns in more, lang_pred and score of every row."""
    shared = model.shared(docs.sparkSession)
    rows = docs.select(id_col, *more, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.predict_many(batch["_text"].to_pylist())
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.fieldNames())

    return rows.mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model fitted on those that are not held out."""
    model = fit(docs)
    flagged = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(flagged, model, "doc_id", "text", "held_out")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a known language by a score of at least `least`."""
    shared = model.shared(docs.sparkSession)

    def sure(texts: pd.Series) -> pd.Series:
        found = shared.predict_many(texts.tolist())
        return pd.Series([lang != "und" and score >= least for lang, score in found], dtype=bool)

    return docs.filter(F.pandas_udf(sure, "boolean")(F.col(text_col)))
