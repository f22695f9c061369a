"""Exact removal of passages that repeat across documents, by repeated-phrase automata.

A window is WINDOW consecutive words; its phrase is the PHRASE-word run inside it with the smallest hash, so equal
windows have equal phrases at equal places. Phrases (the winnowed ones, about one for every 16 words) that occur
in at least two different texts are recurring; the smallest doc_id that holds one is its origin. A recurring phrase
is confirmed by its words, taken from the origin's text, and compiled with the others of its shard into an
Aho-Corasick automaton over word symbols; phrases of one origin share a shard, so the documents that hold parts of
one passage stream past the same automaton. Every document with a recurring phrase is streamed past the automata of
the shards it needs (one without any has no window to remove), and what the automata locate decides which windows
are compared: those around a located phrase, by two hashes made from two word hashes that do not depend on each
other (128 bits), against the smallest doc_id that has them.

Texts that are equal word for word are settled before: of those with at least WINDOW words only the first keeps
any. Windows are pre-aggregated in each task: of equal windows of a batch only the first document's travels, the
others' are settled on the spot; so a passage that a third of all documents share does not meet in one task. A shard
that many words stream past is dealt to several tasks, and the numbers of shards and of partitions of windows follow
the amount of data, so a task's share does not grow with it.

Defined results: a null or empty text has no words and keeps an empty text; runs of separators count as one and the
kept words are joined by one space; documents with fewer words than a window keep all; rows that share a doc_id,
with one text or several, are each judged and reported, and are not duplicates of each other (ties between rows of
one passage go to the smaller doc_id, and rows with that id all keep it); a null doc_id takes no part and keeps all
its words; a text of any length is read whole, by one task; no rows give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import WORD, WORD_PATTERN, kept, run_hashes, word_hash_pair, word_hashes

WINDOW, PHRASE, PHRASES_PER_SHARD = 50, 20, 20_000
#: Words that stream past one copy of a shard's automaton, and words whose windows are matched at once.
STREAM_WORDS, MATCH_WORDS = 4_000_000, 1_000_000
SALTS = 16
_B1, _B2, _B3, _FLUSH = 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 1 << 21
_SYMBOL = np.uint64((1 << 31) - 1)


def phrase_positions(phrases: np.ndarray, span: int) -> np.ndarray:
    """For every window, where its phrase starts: the first smallest of `span` phrase hashes in a row."""
    n = len(phrases) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # smallest of runs of doubling length; ties to the left, as the pair (hash, place) is compared by hash first
    place, size = np.arange(len(phrases)), 1
    while size * 2 <= span:
        a, b = place[:-size], place[size:]
        place = np.where(phrases[b] < phrases[a], b, a)
        size *= 2
    a, b = place[:n], place[span - size : span - size + n]
    return np.where(phrases[b] < phrases[a], b, a)


def _phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes of a text, and each window's phrase position."""
    phrases = run_hashes(words, PHRASE, _B1)
    return phrases, phrase_positions(phrases, WINDOW - PHRASE + 1)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, which names the text among those that share a doc_id."""
    return docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("row"))


def _profile(rows: DataFrame) -> DataFrame:
    """Per row: doc_id, row, n_words, same1 and same2 (hash of the words), all_sha256 (of the text with every word kept), p1 and p2 (both hashes of its windows' distinct phrases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, same, sha, lists = [], [], [], []
                for t in part["text"]:
                    text = t.as_py() or ""
                    first, second = word_hash_pair(text.encode())
                    digest = hashlib.sha256(" ".join(WORD.findall(text)).encode())
                    n.append(len(first))
                    sha.append(digest.hexdigest())
                    same.append(np.frombuffer(digest.digest()[:16], np.int64))
                    phrases, where = _phrases(first)
                    found, at_ = np.unique(phrases[where], return_index=True)
                    other = run_hashes(second, PHRASE, _B2)[where][at_] if len(where) else found
                    lists.append((found.view(np.int64), other.view(np.int64)))
                ends = np.cumsum([0, *(len(x) for x, _ in lists)]).astype(np.int32)
                p1, p2 = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in lists)]))) for i in (0, 1))
                same1, same2 = (pa.array([x[i] for x in same], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(n, pa.int64()), same1, same2, pa.array(sha), p1, p2], names=["doc_id", "row", "n_words", "same1", "same2", "all_sha256", "p1", "p2"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row binary, n_words long, same1 long, same2 long, all_sha256 string, p1 array<long>, p2 array<long>")


_STREAM = "shard long, sub long, rid long, doc_id long, phrase binary, text string"


def _streams(texts: DataFrame) -> DataFrame:
    """What each copy of a shard reads: its phrases' words first (rid null), then documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, doc_id, t, needs, own, own_shard, copies in zip(*(batch[c].to_pylist() for c in ("rid", "doc_id", "text", "needs", "own", "own_shard", "copies"))):
                if own:
                    words = word_hashes(t.encode())
                    symbols = (words & _SYMBOL).astype(np.uint32)
                    mine, first = np.unique(run_hashes(words, PHRASE, _B1), return_index=True)
                    for i in first[np.isin(mine, np.array(own, np.int64).view(np.uint64))].tolist():
                        phrase = symbols[i : i + PHRASE].tobytes()
                        out += [(own_shard, sub, None, None, phrase, None) for sub in range(copies)]
                out += [(x["shard"], x["sub"], rid, doc_id, None, t) for x in needs or ()]
                if len(out) > 1000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return texts.mapInArrow(run, _STREAM)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "sub", "rid", "doc_id", "phrase", "text"])


def _automaton(phrases: list[bytes]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        found.add_word(tuple(np.frombuffer(phrase, np.uint32).tolist()), 1)
    found.make_automaton()
    return found


_REMOVED = "rid long, starts array<int>"
_NAMES = ["p", "rid", "starts", "rids", "docs", "places", "w1", "w2"]
_WINDOWS = "p int, rid long, starts array<int>, rids binary, docs binary, places binary, w1 binary, w2 binary"


def _late(rid: np.ndarray, doc: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The windows in the order of their words and doc_ids, and which of them start in a smaller doc_id too."""
    by = np.lexsort((doc, b, a))
    rid, doc, place, a, b = rid[by], doc[by], place[by], a[by], b[by]
    same = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    return doc > doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))], (rid, doc, place, a, b)


def _located(streams: DataFrame, n: int) -> DataFrame:
    """Windows around located phrases: those settled within a batch (starts), and packed ones for partition p."""

    def pack(ids: list[tuple[int, int]], places: list[np.ndarray], w1: list[np.ndarray], w2: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        many = [len(x) for x in places]
        rid, doc = (np.repeat(np.array([x[i] for x in ids], np.int64), many) for i in (0, 1))
        late, (rid, doc, place, a, b) = _late(rid, doc, np.concatenate(places).astype(np.int32), np.concatenate(w1), np.concatenate(w2))
        yield from _as_lists(rid[late], place[late])
        rid, doc, place, a, b = (x[~late] for x in (rid, doc, place, a, b))
        p = (b % np.uint64(n)).astype(np.int32)
        by = np.argsort(p, kind="stable")
        at = np.flatnonzero(np.diff(p[by], prepend=-1))
        for i, j in zip(at, [*at[1:], len(by)]):
            some = by[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([p[some[0]]], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), *(pa.array([x[some].tobytes()], pa.binary()) for x in (rid, doc, place, a, b))], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, automaton = None, [], None
        held, ids, places, w1, w2 = 0, [], [], [], []
        for batch in batches:
            for shard, sub, rid, doc_id, phrase, t in zip(*(batch[c].to_pylist() for c in ("shard", "sub", "rid", "doc_id", "phrase")), batch["text"]):
                if (shard, sub) != now:
                    now, phrases, automaton = (shard, sub), [], None
                if phrase is not None:
                    phrases.append(phrase)
                    continue
                if automaton is None:
                    automaton = _automaton(phrases) if phrases else ()
                if not phrases:
                    continue
                words, second = word_hash_pair(t.as_py().encode())
                ends = np.fromiter((end for end, _ in automaton.iter(tuple((words & _SYMBOL).tolist()))), np.int64)
                _, where = _phrases(words)
                hit = np.zeros(len(words), bool)
                hit[ends - (PHRASE - 1)] = True
                windows = np.flatnonzero(hit[where]) if len(where) else where
                if len(windows):
                    ids.append((rid, doc_id))
                    places.append(windows)
                    w1.append(run_hashes(words, WINDOW, _B2)[windows])
                    w2.append(run_hashes(second, WINDOW, _B3)[windows])
                    held += len(windows)
                if held >= _FLUSH:
                    yield from pack(ids, places, w1, w2)
                    held, ids, places, w1, w2 = 0, [], [], [], []
        if held:
            yield from pack(ids, places, w1, w2)

    return streams.mapInArrow(run, _WINDOWS)


def _as_lists(rid: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (rid, starts) in the columns of _WINDOWS."""
    if len(rid):
        by = np.argsort(rid, kind="stable")
        rid, place = rid[by], place[by]
        at = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
        n, ends = len(at), np.append(at, len(rid)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(rid[at]), pa.ListArray.from_arrays(ends, pa.array(place)), *(pa.nulls(n, pa.binary()) for _ in range(5))], names=_NAMES)


def _matched(windows: DataFrame, n: int) -> DataFrame:
    """rid, starts of the windows that start in a smaller doc_id too, from the packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def match() -> Iterator[pa.RecordBatch]:
            late, (rid, _, place, _, _) = _late(*(np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int64, np.int64, np.int32, np.uint64, np.uint64))))
            for part in _as_lists(rid[late], place[late]):
                yield part.select(["rid", "starts"])

        for batch in batches:
            for p, *row in zip(*(batch[c].to_pylist() for c in ("p", "rids", "docs", "places", "w1", "w2"))):
                if p != now and rows:
                    yield from match()
                    rows = []
                now = p
                rows.append(row)
        if rows:
            yield from match()

    return windows.filter("p is not null").select("p", "rids", "docs", "places", "w1", "w2").repartition(n, "p").sortWithinPartitions("p").mapInArrow(run, _REMOVED)


def _cut(texts: DataFrame) -> DataFrame:
    """doc_id, row, n_removed, kept_sha256, kept of (doc_id, row, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, left = [], [], []
            for t, starts in zip(batch["text"], batch["starts"].to_pylist()):
                words = WORD.findall(t.as_py())
                cover = np.zeros(len(words) + 1, np.int32)
                at = np.array([s for some in starts for s in some], np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                text = " ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                left.append(text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=["cut_id", "cut_row", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "cut_id long, cut_row binary, n_removed long, kept_sha256 string, kept string")


def _judged(docs: DataFrame, texts: bool) -> DataFrame:
    """doc_id, row, n_words, n_removed, kept_sha256 of every row, and kept (null where no word goes) if texts are asked for."""
    rows = _rows(docs)
    profile = kept(_profile(rows), "phrase-profiles")
    long_enough = profile.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    same = ["same1", "same2"]
    # texts equal word for word: all but the first lose every word. A group of copies is dealt to SALTS tasks.
    slim = long_enough.select("doc_id", "row", *same, F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = slim.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    groups = groups.select(*same, "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = kept(slim.join(groups, [*same, "salt"]).filter("doc_id > first").select(F.col("doc_id").alias("copy_id"), F.col("row").alias("copy_row")).distinct(), "phrase-copies")
    is_copy = (F.col("doc_id") == F.col("copy_id")) & (F.col("row") == F.col("copy_row"))
    phrase = F.explode(F.arrays_zip("p1", "p2")).alias("p")
    occurrences = long_enough.select("doc_id", *same, phrase).select("doc_id", *same, "p.p1", "p.p2")
    recurring = (
        occurrences.groupBy("p1", "p2")
        .agg(F.min("doc_id").alias("origin"), *(f(c).alias(f"{n}_{c}") for c in same for f, n in ((F.min, "low"), (F.max, "high"))))
        .filter("low_same1 <> high_same1 or low_same2 <> high_same2")
        .select("p1", "p2", "origin")
    )
    recurring = kept(recurring, "recurring-phrases")
    n_shards = max(1, -(-recurring.count() // PHRASES_PER_SHARD))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(n_shards))
    wanted = long_enough.join(copies, is_copy, "left_anti").select("doc_id", "row", "n_words", phrase).select("doc_id", "row", "n_words", "p.p1", "p.p2")
    needs = kept(wanted.join(recurring, ["p1", "p2"]).select("doc_id", "row", "n_words", shard("origin").alias("shard")).distinct(), "phrase-needs")
    # a shard that many words stream past has several copies, each with all of its phrases
    loads = needs.groupBy("shard").agg(F.sum("n_words").alias("words")).withColumn("copies", F.greatest(F.lit(1), F.ceil(F.col("words") / STREAM_WORDS)).cast("long"))
    loads = kept(loads, "phrase-shards")
    load = loads.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_streams, n_matches = max(1, load[0]), max(1, -(-load[1] // MATCH_WORDS))
    sub = F.pmod(F.xxhash64("doc_id", "row"), F.col("copies")).alias("sub")
    needs = needs.join(loads.select("shard", "copies"), "shard").groupBy("doc_id", "row").agg(F.collect_list(F.struct("shard", sub)).alias("needs"))
    own = recurring.groupBy(F.col("origin").alias("doc_id")).agg(F.collect_list("p1").alias("own")).withColumn("own_shard", shard("doc_id"))
    own = own.join(loads.select(F.col("shard").alias("own_shard"), "copies"), "own_shard")
    found = rows.join(needs, ["doc_id", "row"]).join(own, "doc_id", "left").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "row", "text", "needs", "own", "own_shard", "copies")
    found = kept(found, "phrase-texts")
    streams = _streams(found).repartition(min(4 * n_streams, 100_000), "shard", "sub").sortWithinPartitions("shard", "sub", F.col("rid").asc_nulls_first())
    windows = kept(_located(streams, min(n_matches, 1 << 30)), "phrase-windows")
    removed = windows.filter("p is null").select("rid", "starts").unionByName(_matched(windows, min(n_matches, 100_000)))
    starts = removed.groupBy("rid").agg(F.collect_list("starts").alias("starts"))
    cut = _cut(found.select("rid", "doc_id", "row", "text").join(starts, "rid").select("doc_id", "row", "text", "starts"))
    cut = (cut if texts else cut.drop("kept")).dropDuplicates(["cut_id", "cut_row"])
    out = (
        profile.select("doc_id", "row", "n_words", "all_sha256")
        .join(copies, is_copy, "left")
        .join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("row") == F.col("cut_row")), "left")
    )
    copied = F.col("copy_id").isNotNull()
    return out.select(
        "doc_id",
        "row",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        *([F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return _judged(docs, False).drop("row")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space) of every document."""
    judged = _judged(docs, True).filter("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row"), "n_removed", "kept").dropDuplicates(["cut_id", "cut_row"])
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1))
    joined = _rows(docs).join(judged, (F.col("doc_id") == F.col("cut_id")) & (F.col("row") == F.col("cut_row")), "left")
    return joined.select("doc_id", F.size(words).cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.col("kept"), F.array_join(words, " ")).alias("text"))
