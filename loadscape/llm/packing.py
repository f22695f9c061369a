"""Best-fit packing of documents into sequences of at most CAPACITY tokens, by large-item matching.

A document is its ids and an end id. Only a document longer than a sequence is cut, into pieces of a whole sequence
after a first one that may be shorter. A piece over a third of the capacity has at most one other such piece in its
sequence: from the longest down, each is matched with the longest of the rest that fits beside it. Shorter pieces
follow from the longest down, each into the smallest gap that holds it, and into a new sequence if none does.

Which document a piece is of makes no difference to the packing, so pieces are packed by their length: the input of the packing is the number of
pieces of each length, at most CAPACITY rows whatever the corpus, and its output is runs of equal sequences. A run's
slots take pieces of one length by their number. Tasks number the pieces of each length as they cut them, counts by task
and length give the first number of each task, and a join by length brings slot and piece together, so no piece is
sorted, and no length, however common, meets in one task.

Defined results: a null or empty text is the end id alone; null and repeated ids are documents of their own; a text of any
length is encoded whole; pieces of equal length are packed in any order, so sequence numbers may change from run to run, the
number of sequences does not; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.llm.common import kept

CAPACITY, END, VOCABULARY, CACHE = 2048, 0, "byte_bpe_50k.json", 600_000
#: Such a tokenizer starts a new token at white space behind any other character, and at a stop behind a letter; these are none, or letters, by every edition of Unicode.
_CUT = re.compile(r"(?<=[!-~À-ɏ])(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,])")
#: A blank and letters: one word for such a tokenizer.
_WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_AT_ONCE = 10_000


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones are themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - printable))}


_LETTERS = _byte_letters()


def _kinds() -> np.ndarray:
    """By UTF-16 unit: 1 what white space is cut behind, 2 what a stop is cut behind (surrogates are neither), 4 white space, 8 a stop."""
    units = "".join(map(chr, range(0x250)))
    out = np.zeros(1 << 16, np.uint8)
    for bit, found in ((1, re.finditer("[!-~À-ɏ]", units)), (2, re.finditer("[A-Za-zÀ-ÖØ-öø-ɏ]", units)), (4, re.finditer("[ \n]", units)), (8, re.finditer("[.,]", units))):
        out[[m.start() for m in found]] |= bit
    return out


_KINDS = _kinds()


def irregular(texts: list[str]) -> list[bool]:
    """Whether each text has white space or a stop that may be no cut, or a zero character."""
    zero = ["\0" in t for t in texts]
    units = np.frombuffer("\0".join(["", *("" if z else t for z, t in zip(zero, texts)), ""]).encode("utf-16-le"), np.uint16)
    kind = _KINDS[units]
    odd = np.flatnonzero((kind[1:] >> 2) & ~kind[:-1] & 3)  # white space (4) not behind 1, or a stop (8) not behind 2
    for i in np.unique(np.searchsorted(np.flatnonzero(units == 0), odd, side="right") - 1).tolist():
        zero[i] = True
    return zero


_SLICE = 1 << 21


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a tokenizer; what stands between two cuts is encoded once and remembered.

    Two sets of up to `cache` chunks are held: what was met since the first was last full, and the one that was full then.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.size, self.known, self.before = Tokenizer.from_file(path), cache, {}, {}
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made["pre_tokenizer"] or {}
        by_words = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        added = made["added_tokens"]
        self.by_words = by_words and not any(re.search(r"[\s.,]", t["content"]) or t["lstrip"] or t["rstrip"] for t in added)
        self.mark = next(((t["content"], t["id"]) for t in added if t["special"]), None)
        self.words = Tokenizer.from_file(path)  # the same, for words that are cut and written in byte letters
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def parts(self, text: str, irregular: bool) -> list[str]:
        if not self.by_words:
            return [text]
        if irregular:
            return _CUT.split(text)
        for c in " \n.,":
            text = text.replace(c, f"\0{c}")
        return text.split("\0")

    def _learn(self, new: list[str]) -> None:
        """Encode what is new: words many at once, what else is whole with the vocabulary's special token between."""
        alone = new
        if self.by_words and self.mark:
            mark, number = self.mark
            alone, words, others = [], [], []
            for c in new:
                (alone if mark in c else words if _WORD.fullmatch(c) else others).append(c)
            in_bytes = _LETTERS | {10: mark}  # no word holds a line feed
            written = lambda some: "\n".join(some).encode().decode("latin-1").translate(in_bytes)
            for kind, by, joined in ((words, self.words, written), (others, self.tokenizer, mark.join)):
                for at in range(0, len(kind), _AT_ONCE):
                    some = kind[at : at + _AT_ONCE]
                    ids = np.array(by.encode_batch_fast([joined(some)], add_special_tokens=False)[0].ids, "<u4")
                    ends = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
                    data = ids.tobytes()
                    self.known.update((c, data[4 * (a + 1) : 4 * b]) for c, a, b in zip(some, ends, ends[1:]))
        for chunk, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[chunk] = np.array(found.ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.parts(t, odd) for t, odd in zip(texts, irregular(texts) if self.by_words else [False] * len(texts))]
        met = set().union(*parts)
        if len(self.known) > self.size:
            self.known, self.before = {}, self.known
        need = met.difference(self.known)
        again = need.intersection(self.before)
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        self._learn(list(need.difference(again)))
        return [b"".join(itemgetter(*own)(self.known)) if len(own) > 1 else self.known[own[0]] for own in parts]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>) of every piece; task, nth: it is the task's nth of this length."""
    path = path or vocabulary()
    tail = np.array([end], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met, task = _encoder(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            texts, at = batch["text"].to_pylist(), 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held < _SLICE):
                    held += len(texts[stop] or "")
                    stop += 1
                rows, data = [], []
                for i, own in enumerate(encoder.encode_many([t or "" for t in texts[at:stop]]), at):
                    own += tail
                    for k, (start, length) in enumerate(cuts(len(own) // 4, capacity)):
                        part = own[4 * start : 4 * (start + length)]
                        rows.append((i, k, start, length, zlib.crc32(part), task, met[length]))
                        met[length] += 1
                        if ids:
                            data.append(np.frombuffer(part, np.int32))
                who, *cols = zip(*rows)
                cols = [batch["id"].take(pa.array(who)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, data)]).astype(np.int32), np.concatenate(data)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = stop

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class Packing:
    """Packs so many pieces of each length; slots: (length, first, many, each, sequence, place).

    Pieces `first` to first + many - 1 of the length stand in the sequences from `sequence` on, `each` in one, from `place` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.slots = capacity, 0, []
        self.left, self.next = {n: c for n, c in counts.items() if c}, Counter()
        self.gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences) of runs that are alike
        self._match()
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _place(self, length: int, bins: int, each: int, sequence: int, place: int) -> None:
        self.slots.append((length, self.next[length], bins * each, each, sequence, place))
        self.next[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def _match(self) -> None:
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        while large:
            a = large[-1]
            fit = bisect_right(large, self.capacity - a) - 1
            if fit == len(large) - 1 and self.left[a] < 2:
                fit -= 1  # it has no other of its own length
            b = large[fit] if fit >= 0 else None
            bins = self.left[a] if b is None else self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
            self._place(a, bins, 1, self.sequences, 0)
            if b is not None:
                self._place(b, bins, 1, self.sequences, a)
            self._open(self.capacity - a - (b or 0), self.sequences, bins)
            self.sequences += bins
            large = [n for n in large if n in self.left] if a not in self.left or b is not None and b not in self.left else large

    def _open(self, gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            insort(self.gaps, (gap, sequence, bins))

    def _best_fit(self, length: int) -> None:
        while length in self.left:
            at = bisect_left(self.gaps, (length, -1, 0))
            if at == len(self.gaps):
                bins = -(-self.left[length] // (self.capacity // length))
                self._open(self.capacity, self.sequences, bins)
                self.sequences += bins
            gap, sequence, bins = self.gaps.pop(at)
            # a gap that holds several takes them one after another, as it is still the smallest
            each = min(gap // length, self.left[length])
            used = min(bins, self.left[length] // each)
            self._place(length, used, each, sequence, self.capacity - gap)
            self._open(gap - each * length, sequence, used)
            self._open(gap, sequence + used, bins - used)


_SLOTS = "length long, first long, many long, each long, sequence long, place long"


def slots(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The slots for pieces counted by length (length, n). Rows in and out are bounded by the capacity alone."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        found = Packing(dict(zip(rows["length"].tolist(), rows["n"].tolist())), capacity)
        return pd.DataFrame(found.slots, columns=[c.split()[0] for c in _SLOTS.split(", ")])

    return counts.groupBy(F.lit(0).alias("all")).applyInPandas(plan, _SLOTS)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, with sequence_id and offset in place of task and nth."""
    by_task = kept(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    plan = kept(slots(by_task.groupBy("length").agg(F.sum("n").alias("n")), capacity), "packing-slots")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_number"))
    numbered = cut.join(starts, ["length", "task"]).withColumn("number", F.col("start_number") + F.col("nth"))
    slot = plan.select(F.col("length").alias("of"), "first", "many", "each", "sequence", "place")
    within = (F.col("length") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("many"))
    nth = F.col("number") - F.col("first")
    placed = numbered.join(F.broadcast(slot), within)
    kept_columns = [c for c in cut.columns if c not in ("task", "nth")]
    return placed.select(*kept_columns, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False, **settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with ids, these too."""
    return place(kept(pieces(docs, capacity, ids=ids, **settings), "packing-pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **settings) -> DataFrame:
    """sequence_id and ids (array<int>) of every sequence, and doc_ids and offsets of its pieces, in order; a sequence holds at most `capacity` tokens."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows")
    packed = pack(docs, capacity, ids=True, **settings).groupBy("sequence_id").agg(rows)
    return packed.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))
