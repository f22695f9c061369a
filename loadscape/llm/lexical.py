"""Exact ranked lexical search by per-term geometric blocking.

Documents are read once: of each, the number of its terms, and the terms asked for with how often they occur. What is asked for is known by
a bitmap of hashes of fixed size, which lets some other terms pass; these meet no query. Such documents travel packed, and are dealt by a hash to
groups of about POSTINGS postings; queries come in blocks of about QUERIES. Where a group meets a block of queries, each term's posting list is clustered
by the similarity of its documents (cosine of random projections, to centres taken evenly from the list) into blocks of at most 2 * LIST_BLOCK,
and a block keeps the largest impact of any of its documents in every term: its summary.

A query reads the lists of its terms, the heaviest first, so a list only has to bring documents without any earlier term. A summary times the query's weights
bounds the score of such documents of its block; a block is skipped only if that bound is under the k-th best score known, and
the rest of the lists only if the summary of all documents shows the same. Blocks are read by falling bound. Terms commoner than a list's own
are all that its summaries hold and all that is added up for its documents.

The k-th best score of one group in SEEDS, found first, is where all other groups start, so most of them have little to open.

Defined results: only A-Z is lower-cased; a null text has no terms; rows that share an id are documents, or items, of their own; a document with
a null id ranks last among equal scores (as if its id were the largest of all, which therefore reads as null); terms are told apart by 64 bits, so m asked for
among n in all are mistaken with a chance of m n / 2^64; a text of any length is read whole; an item without terms, or without a
document that scores, gives no rows, as do no documents or no items; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.llm.common import kept, word_starts_and_hashes

K, LIST_BLOCK, POSTINGS, QUERIES, SEEDS = 50, 64, 1 << 19, 1024, 16
#: Postings and documents of a packed row at most (a document with more is a row of its own), and bits of the bitmap of terms.
PACKED, PACKED_DOCS, BITS = 1 << 16, 4096, 23
_SLICE, _CELLS, _SIGNS = 1 << 20, 1 << 22, 16
_LAST = (1 << 63) - 1

# what a byte becomes: itself, its lower case, or a blank
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and the text that each is of."""
    hashes, of, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        some, held = [], 0
        while at + len(some) < len(texts) and (not some or held < _SLICE):
            some.append((texts[at + len(some)] or "").encode().translate(_TERM))
            held += len(some[-1])
        starts, found = word_starts_and_hashes(b" ".join(some))
        ends = np.cumsum([len(t) + 1 for t in some])
        hashes.append(found)
        of.append(np.searchsorted(ends, starts, side="right") + at)
        at += len(some)
    return np.concatenate(hashes), np.concatenate(of)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start to start + size, for each, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, item_id and terms (array<long>, distinct) of each item that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, of = term_hashes(batch["text"].to_pylist())
            lists = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(*(np.searchsorted(of, np.arange(batch.num_rows), side=s) for s in ("left", "right")))]
            terms = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["item_id"], terms], names=["row", "item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, item_id {kind}, terms array<long>").filter("size(terms) > 0")


def _asked(queries: DataFrame) -> np.ndarray:
    """A bit for each value of the first BITS bits of a term's hash; 2^BITS bits whatever the queries."""
    at = F.shiftrightunsigned("term", 64 - BITS) + 1
    parts = queries.select(F.explode("terms").alias("term")).groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << BITS, bool)
    for r in parts.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        first = (r["part"] - 1) * len(bits)
        out[first : first + len(bits)] = bits[: len(out) - first]
    return np.packbits(out)


_PACKED = "ids array<long>, lengths array<long>, counts binary, codes binary, times binary, terms array<long>, df array<long>, n_docs long, n_terms long, postings long"


def _forward(docs: DataFrame, asked: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Packed documents: ids, lengths and numbers of postings (counts) of those with a term asked for, their postings (codes into terms, times), terms
    with their numbers of documents (df), and of all documents the number of those with a term and of their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def pack(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
        distinct, codes = np.unique(terms, return_inverse=True)
        row = (ids, lengths, counts.astype(np.int32).tobytes(), codes.astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), distinct.view(np.int64), np.bincount(codes, minlength=len(distinct)), n_docs, n_terms, len(terms))
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            ids = batch["id"].fill_null(_LAST).to_numpy()
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held < _SLICE) and stop - at < PACKED_DOCS:
                    held += len(texts[stop] or "")
                    stop += 1
                hashes, of = term_hashes(texts[at:stop])
                n = np.bincount(of, minlength=stop - at)
                some = bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
                hashes, of = hashes[some], of[some]
                by = np.lexsort((hashes, of))
                hashes, of = hashes[by], of[by]
                first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
                terms, doc, times = hashes[first], of[first], np.diff(np.append(first, len(of)))
                n_docs, n_terms = int((n > 0).sum()), int(n.sum())
                have = np.flatnonzero(np.bincount(doc, minlength=stop - at))
                counts = np.bincount(doc, minlength=stop - at)[have]
                upto = np.cumsum(counts)
                a = 0
                while True:  # rows of PACKED postings
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PACKED, side="right"))) if len(have) else 0
                    x, y = (int(upto[a - 1]) if a else 0), (int(upto[b - 1]) if b else 0)
                    yield pack(ids[at:stop][have[a:b]], n[have[a:b]], counts[a:b], terms[x:y], times[x:y], n_docs, n_terms)
                    n_docs = n_terms = 0  # told once
                    a = b
                    if a >= len(have):
                        break
                at = stop

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _PACKED)


class Index:
    """Blocked posting lists of some documents over terms that are numbered from the heaviest on.

    counts: postings of each document; terms and impacts: of the postings, in the order of documents and, in one, of terms.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int, block: int = LIST_BLOCK):
        self.ids, self.terms, self.impacts, self.block, self.n_terms = ids, terms, impacts, block, n_terms
        doc = np.repeat(np.arange(len(ids)), counts)
        self.end = np.cumsum(counts)
        by = np.argsort(terms, kind="stable")
        self.at, self.doc = by, doc[by]  # by term: where its postings are, and of which document
        self.list = np.searchsorted(terms[by], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)  # the summary of all documents
        np.maximum.at(self.most, terms, impacts)
        self.near = self._projected(doc)
        self.blocks: dict[int, tuple] = {}
        self.told = {"lists": 0, "lists skipped": 0, "blocks": 0, "blocks skipped": 0, "documents": 0, "documents scored": 0}

    def _projected(self, doc: np.ndarray) -> np.ndarray:
        """Unit vectors of the documents in a few dimensions, in which similar documents are close."""
        signs = np.random.default_rng(7).choice(np.array((-1, 1), np.float32), (self.n_terms, _SIGNS))
        out = np.zeros((len(self.ids), _SIGNS), np.float32)
        for i in range(0, len(self.ids), 1024):
            a, b = (int(self.end[i - 1]) if i else 0), int(self.end[min(i + 1024, len(self.ids)) - 1])
            part = signs[self.terms[a:b]] * self.impacts[a:b, None].astype(np.float32)
            out[i : i + 1024] = np.add.reduceat(part, np.flatnonzero(np.diff(doc[a:b], prepend=-1)), axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def blocked(self, term: int) -> tuple:
        """Of a term's list: the postings in the order of blocks, the blocks' starts; terms and maxima of the summaries, and their starts."""
        if term in self.blocks:
            return self.blocks[term]
        at, doc = self.at[self.list[term] : self.list[term + 1]], self.doc[self.list[term] : self.list[term + 1]]
        own, centres = self.near[doc], self.near[doc[:: self.block]]
        of = np.concatenate([(own[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(own), 4096)])
        by = np.argsort(of, kind="stable")
        at, doc, of = at[by], doc[by], of[by]
        head = np.flatnonzero(np.diff(of, prepend=-1))
        sizes = np.diff(np.append(head, len(of)))
        starts = head.repeat(-(-sizes // (2 * self.block))) + 2 * self.block * _spans(np.zeros(len(sizes), np.int64), -(-sizes // (2 * self.block)))
        # the largest impact in each term from this one on, for some blocks at once
        width, terms, most, counts = self.n_terms - term, [], [], []
        step = max(1, _CELLS // width)
        for i in range(0, len(starts), step):
            a, b = starts[i], starts[i + step] if i + step < len(starts) else len(at)
            n = min(step, len(starts) - i)
            size = self.end[doc[a:b]] - at[a:b]
            places = _spans(at[a:b], size)
            of_block = np.repeat(np.searchsorted(starts[i : i + n], np.arange(a, b), side="right") - 1, size)
            cells = np.zeros(n * width, np.int64)
            np.maximum.at(cells, of_block * width + self.terms[places] - term, self.impacts[places])
            some = np.flatnonzero(cells)
            terms.append(some % width + term)
            most.append(cells[some])
            counts.append(np.bincount(some // width, minlength=n))
        ends = np.cumsum(np.concatenate(counts))
        self.blocks[term] = found = (at, doc, np.append(starts, len(at)), np.concatenate(terms), np.concatenate(most), np.append(0, ends[:-1]))
        return found

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = K, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents of at least `floor`, for terms in rising order; equal scores by id."""
        weight = np.zeros(self.n_terms, np.int64)
        weight[terms] = weights
        rest = np.cumsum((self.most[terms] * weights)[::-1])[::-1]
        decided = np.zeros(len(self.ids), bool)
        ids, scores, told = np.zeros(0, np.int64), np.zeros(0, np.int64), self.told
        told["lists"] += len(terms)
        told["documents"] += len(self.ids)
        for i, term in enumerate(terms.tolist()):
            if rest[i] < floor:
                told["lists skipped"] += len(terms) - i
                break
            if self.list[term] == self.list[term + 1]:
                continue
            at, doc, starts, own, most, first = self.blocked(term)
            bound = np.add.reduceat(most * weight[own], first)
            order, done, step = np.argsort(-bound, kind="stable"), 0, 4
            told["blocks"] += len(bound)
            while done < len(order) and bound[order[done]] >= floor:
                some = order[done : done + step]
                some = some[bound[some] >= floor]
                done, step = done + len(some), 2 * step
                places = _spans(starts[some], starts[some + 1] - starts[some])
                places = places[~decided[doc[places]]]
                told["documents scored"] += len(places)
                if not len(places):
                    continue
                size = self.end[doc[places]] - at[places]
                postings = _spans(at[places], size)
                got = np.add.reduceat(self.impacts[postings] * weight[self.terms[postings]], np.cumsum(size) - size)
                ids, scores = np.append(ids, self.ids[doc[places]]), np.append(scores, got)
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, int(scores[-1]))
            told["blocks skipped"] += len(order) - done
            decided[doc] = True
        good = scores >= floor
        return ids[good], scores[good]


def index(packed: pd.DataFrame, terms: np.ndarray, n: int, total: int, block: int = LIST_BLOCK) -> Index:
    """Of packed documents, over the terms (hashes, the heaviest first); n documents hold total terms."""
    order = np.argsort(terms)
    known, parts = terms[order], []
    for row in packed.itertuples():
        counts, codes, times = (np.frombuffer(x, np.int32) for x in (row.counts, row.codes, row.times))
        own = np.asarray(row.terms, np.int64)
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        number = np.where(known[at] == own, order[at], -1)[codes]
        doc = np.repeat(np.arange(len(counts)), counts)
        asked = number >= 0
        doc, number, times = doc[asked], number[asked], times[asked].astype(np.int64)
        length = 50 + 50 * np.asarray(row.lengths, np.int64) * n // total
        impact = 1_000_000_000 * times // (1000 * times + 20 * length[doc])
        by = np.lexsort((number, doc))
        have = np.bincount(doc, minlength=len(counts))
        parts.append((np.asarray(row.ids, np.int64)[have > 0], have[have > 0], number[by], impact[by]))
    none = np.zeros(0, np.int64)
    return Index(*(np.concatenate([none, *x]) for x in (zip(*parts) if parts else ((),) * 4)), len(terms), block)


def _search(packed: DataFrame, queries: DataFrame, n: int, total: int, k: int, block: int) -> DataFrame:
    """row, doc_id, score: of each group, a query's k best; packed has g and qb, queries have g, qb, row, terms, weights and floor."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            every, first = np.unique(np.concatenate(list(right["terms"])), return_index=True)
            heavy = np.concatenate(list(right["weights"]))[first]
            every = every[np.lexsort((every, -heavy))]
            order = np.argsort(every)
            held = index(left, every, n, total, block)
            for row, terms, weights, floor in zip(right["row"], right["terms"], right["weights"], right["floor"]):
                number = order[np.searchsorted(every[order], terms)]
                by = np.argsort(number)
                ids, scores = held.search(number[by], np.asarray(weights)[by], k, int(floor))
                out[0].append(np.full(len(ids), row))
                out[1].append(ids)
                out[2].append(scores)
        none = np.zeros(0, np.int64)
        return pd.DataFrame({c: np.concatenate([none, *x]) for c, x in zip(("row", "doc_id", "score"), out)})

    return packed.groupBy("g", "qb").cogroup(queries.groupBy("g", "qb")).applyInPandas(run, "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = LIST_BLOCK, postings: int = POSTINGS, queries_at_once: int = QUERIES, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    asked = kept(_items(items, "item_id", "text"), "lexical-items")
    packed = kept(_forward(docs, _asked(asked), "doc_id", "text"), "lexical-documents")
    n, total, many = (int(x or 0) for x in packed.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum("postings")).first())
    df = packed.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighted = asked.select("row", "item_id", F.explode("terms").alias("term")).join(df, "term").withColumn("weight", weight).filter("weight > 0")
    n_g, n_q = max(1, -(-many // postings)), max(1, -(-asked.count() // queries_at_once))
    queries = weighted.groupBy("row", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    queries = kept(queries.select("row", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("row"), F.lit(n_q)).cast("int").alias("qb")), "lexical-queries")
    each = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last)))
    dealt = packed.filter("postings > 0").select("ids", "lengths", "counts", "codes", "times", "terms", F.pmod(F.xxhash64("terms", "ids"), F.lit(n_g)).cast("int").alias("g"))
    best = lambda found, by: found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "doc_id"))).filter(F.col("rank") <= by)
    group = F.col("g") % seeds == 0

    def over(which: F.Column, started: DataFrame) -> DataFrame:
        every = started.withColumn("g", each(n_g - 1)).filter(which)
        return _search(dealt.filter(which).withColumn("qb", each(n_q - 1)), every, n, total, k, block)

    first = kept(over(group, queries.withColumn("floor", F.lit(1).cast("long"))), "lexical-seeds")
    floors = best(first, k).filter(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    started = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    found = best(first.unionByName(over(~group, started)), k)
    number = F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id")
    return found.join(queries.select("row", "item_id"), "row").select("item_id", "rank", number, "score")
