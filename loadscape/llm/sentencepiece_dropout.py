"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The vocabulary and the scores of a public BPE model drive an agenda of candidate merges, best score first and then
leftmost. Each candidate that comes up is skipped if a hash of the seed, the text's id, the chunk's position and the
candidate's span falls under the dropout rate: every occurrence of a chunk draws for itself, one text gets different
segmentations under different seeds and the same one whenever it is encoded again with the same seed. A repeated text
draws anew where the number of its copy is given. At rate 0 the result is the library's own.

A chunk is a run of blanks with what follows up to the next blank: no piece of such a model holds a blank behind
another character, so merges never cross chunks. What a task remembers does not depend on the draws: a chunk's agenda
when nothing is skipped, and what it becomes when a certain candidate of it is skipped, and so on. An occurrence goes
from one to the next by its own draws. Characters without a piece, and U+2581 itself, are written as bytes, so decode(encode(text)) == text.

Defined results: a null or empty text has no ids and decodes to an empty text; a null id counts as its own id; rows that repeat or share an id draw alike unless their
copies are numbered; a text of any length is encoded whole, and so is a chunk; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import giving_back, mix

MODEL, DROPOUT, SEED, CACHE = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 17, 100_000
_CHUNK = re.compile("▁+[^▁]*|[^▁]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_ESCAPE = "\ue000"  # stands for U+2581 while a text is cut into chunks, if the text has no such character itself


_M = (1 << 64) - 1
_WIDE = 32  # longer chunks go through their agenda one by one
_BLOCK = 1 << 16  # occurrences whose draws are made at once
_SLICE = 1 << 20  # bytes of text whose chunks are held at once
_NONE = np.int32(1 << 30)


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


_MASK = (1 << 20) - 1
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, with room for n."""
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n - len(x), len(x)), x.dtype)))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * _K1 >> np.uint64(44)).astype(np.int64)


class Codec:
    """Encodes batches of texts.

    A node is a chunk's agenda after some skips: the ids it ends in and the candidates that come up after the last
    skip, each with the node that skipping it leads to (-1: not met). Up to `cache` chunks are remembered, and four
    nodes a chunk.
    """

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threshold, self.seed, self.size = int(dropout * (1 << 64)), seed, cache
        self.ids, self.byte, self.out = {}, [0] * 256, []
        rank = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            m = _BYTE.fullmatch(piece)
            if m:
                self.byte[int(m[1], 16)] = i
                self.out.append(bytes([int(m[1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.out.append(b"")
            else:
                self.ids[piece] = i
                rank[i] = -int(model.get_score(i))
                self.out.append(piece.replace("\u2581", " ").encode())
        # (left id, right id) -> (rank, merged id), for every way to put a piece together from two
        self.pairs = {(self.ids[p[:k]], self.ids[p[k:]]): (rank[i], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        # the same as a hash table in arrays; a free slot has key -1
        self.keys, self.pair_rank, self.pair_id = np.full(_MASK + 1, -1, np.int64), np.full(_MASK + 1, _NONE, np.int32), np.zeros(_MASK + 1, np.int32)
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        for key, slot, (r, i) in zip(keys.tolist(), _slot(keys).tolist(), self.pairs.values()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & _MASK
            self.keys[slot], self.pair_rank[slot], self.pair_id[slot] = key, r, i
        self.forget()

    def forget(self) -> None:
        """Drop the chunks learned so far."""
        self.known: dict[str, int] = {}
        self.chunks: list[str] = []
        self.root = np.zeros(0, np.int32)  # by chunk; -1: not met, or longer than _WIDE
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)  # by node: its ids in pool
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int32)  # its candidates
        self.chunk, self.parent, self.step = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)  # what it comes from; step: place of the skipped candidate in the agenda
        self.pool, self.span, self.child = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.nodes = self.used = self.spans = 0

    def merge(self, chunk: str, key: int) -> list[int]:
        """Ids of one chunk, by its agenda and the draws of the key; characters without a piece become bytes."""
        part: list = [self.ids.get(c, c) for c in chunk]
        n, pairs = len(part), self.pairs
        left, right, size = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        agenda = [(hit[0], i, i + 1, 1, 2, hit[1]) for i in range(n - 1) if (hit := pairs.get((part[i], part[i + 1])))]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, both, merged = heapq.heappop(agenda)
            if size[i] != a or right[i] != j or size[i] + (size[j] if j < n else 0) != both or part[i] is None:
                continue  # one of its parts has been merged meanwhile
            if self.threshold and _mix(key + i * int(_K1) + a * int(_K2) + both * int(_K3) & _M) < self.threshold:
                continue
            part[i], size[i], part[j], right[i] = merged, both, None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (hit := pairs.get((part[x], part[y]))):
                    heapq.heappush(agenda, (hit[0], x, y, size[x], size[x] + size[y], hit[1]))
        return self._as_ids(p for p in part if p is not None)

    def _as_ids(self, parts) -> list[int]:
        out: list[int] = []
        for p in parts:
            if isinstance(p, str):
                out += [self.byte[b] for b in p.replace(_ESCAPE, "\u2581").encode()]
            else:
                out.append(p)
        return out

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs of ids; rank _NONE where they make no piece (an id below 0 makes none)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        slot = _slot(key)
        have = self.keys[slot]
        wrong = np.flatnonzero((have != key) & (have != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & _MASK
            have = self.keys[slot[wrong]]
            wrong = wrong[(have != key[wrong]) & (have != -1)]
        return self.pair_rank[slot], self.pair_id[slot]

    def merge_many(self, chunks: list[str], skip_row: np.ndarray, skip_step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Many chunks of up to _WIDE characters, all agendas step by step together, with the given skips (chunk, step).

        Returns the ids, end to end, the length of each, and the candidates after the last skip, end to end, with how many.
        """
        n = len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, n)
        row = int(size.max()) + 1  # each chunk's characters, and a place behind the last
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        some_chars, back = np.unique(codes, return_inverse=True)
        own = np.array([self.ids.get(chr(c), -2) for c in some_chars], np.int32)
        ends = np.cumsum(size)
        place = np.repeat(np.arange(n) * row - (ends - size), size) + np.arange(len(codes))
        part = np.full(n * row, -1, np.int32)
        part[place] = own[back]
        rank, merged = np.full(n * row, _NONE, np.int32), np.zeros(n * row, np.int32)
        rank[place], merged[place] = self._lookup(part[place], part[place + 1])
        left, right = np.arange(-1, n * row - 1), np.arange(1, n * row + 1)
        left[::row] = -1
        width = np.ones(n * row, np.int32)
        last = np.full(n, -1, np.int64)
        np.maximum.at(last, skip_row, skip_step)
        by_step = np.argsort(skip_step, kind="stable")
        skip_row, edges = skip_row[by_step], np.searchsorted(skip_step[by_step], np.arange(last.max() + 2))
        marked, seen, spans, step = np.zeros(n, bool), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        ranks, rows = rank.reshape(n, row), np.arange(n)
        while len(rows):
            local = ranks[rows].argmin(axis=1)
            i = rows * row + local
            going = rank[i] < _NONE
            rows, i = rows[going], i[going]
            if self.threshold:
                a, late = width[i], step > last[rows]
                seen.append(rows[late])
                spans.append((local[going].astype(np.uint64) * _K1 + a.astype(np.uint64) * _K2 + (a + width[right[i]]).astype(np.uint64) * _K3)[late])
            if step + 1 < len(edges):
                now = skip_row[edges[step] : edges[step + 1]]
                marked[now] = True
                skip = marked[rows]
                marked[now] = False
                rank[i[skip]] = _NONE
                i = i[~skip]
            step += 1
            j = right[i]
            k = right[j]
            part[i] = merged[i]
            width[i] += width[j]
            part[j], rank[j] = -1, _NONE
            right[i] = k
            left[k % (n * row)] = i  # behind a chunk's last place stands no part
            h = left[i]
            some = h >= 0
            h, x = h[some], i[some]
            both_rank, both_id = self._lookup(np.concatenate((part[i], part[h])), np.concatenate((part[k], part[x])))
            rank[i], merged[i] = both_rank[: len(i)], both_id[: len(i)]
            rank[h], merged[h] = both_rank[len(i) :], both_id[len(i) :]
        owner = np.concatenate(seen)
        span, many = np.concatenate(spans)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n).astype(np.int32)
        # a character without a piece becomes its bytes
        odd, times = np.flatnonzero(part == -2), (part >= 0).astype(np.int32)
        if not len(odd):
            return part[part >= 0], times.reshape(n, row).sum(axis=1, dtype=np.int32), span, many
        written = [self._as_ids([chr(c)]) if i == -2 else [] for i, c in zip(own.tolist(), some_chars.tolist())]
        table, lengths = np.array([i for w in written for i in w], np.int32), np.fromiter(map(len, written), np.int32, len(written))
        which = np.zeros(n * row, np.int64)
        which[place] = back
        which = which[odd]
        times[odd] = lengths[which]
        ids = np.repeat(part, times)
        lengths_of, firsts = lengths[which].astype(np.int64), np.cumsum(lengths) - lengths
        nth = np.arange(lengths_of.sum()) - np.repeat(np.cumsum(lengths_of) - lengths_of, lengths_of)
        ids[np.repeat((np.cumsum(times) - times)[odd], lengths_of) + nth] = table[np.repeat(firsts[which], lengths_of) + nth]
        return ids, times.reshape(n, row).sum(axis=1, dtype=np.int32), span, many

    def _new(self, chunk: np.ndarray, parent: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Numbers for nodes, still without ids and candidates."""
        new = np.arange(self.nodes, self.nodes + len(chunk))
        self.nodes += len(chunk)
        for name in ("at", "length", "first", "many", "chunk", "parent", "step"):
            setattr(self, name, _room(getattr(self, name), self.nodes))
        self.chunk[new], self.parent[new], self.step[new] = chunk, parent, step
        return new

    def _learn(self, chunk: np.ndarray, parent: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The nodes of chunks of up to _WIDE characters, each by skipping one more candidate of its parent (-1: none skipped)."""
        new = self._new(chunk, parent, step)
        texts = [self.chunks[c] for c in chunk.tolist()]
        size = np.fromiter(map(len, texts), np.int32, len(texts))
        for low, high in ((0, 8), (8, 14), (14, _WIDE)):
            some = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(some), 20_000):
                now = some[at : at + 20_000]
                self._store(new[now], *self.merge_many([texts[i] for i in now.tolist()], *self._skips(new[now])))
        return new

    def _skips(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All skips on the way to each node: its place in nodes, and the step."""
        row, rows, steps = np.arange(len(nodes)), [], []
        while len(row):
            down = self.parent[nodes] >= 0
            row, nodes = row[down], nodes[down]
            rows.append(row)
            steps.append(self.step[nodes].astype(np.int64))
            nodes = self.parent[nodes]
        return np.concatenate(rows), np.concatenate(steps)

    def _store(self, nodes: np.ndarray, ids: np.ndarray, length: np.ndarray, span: np.ndarray, many: np.ndarray) -> None:
        self.pool = _room(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[nodes], self.length[nodes] = self.used + np.cumsum(length) - length, length
        self.used += len(ids)
        self.span, self.child = _room(self.span, self.spans + len(span)), _room(self.child, self.spans + len(span))
        self.span[self.spans : self.spans + len(span)], self.child[self.spans : self.spans + len(span)] = span, -1
        self.first[nodes], self.many[nodes] = self.spans + np.cumsum(many) - many, many
        self.spans += len(span)

    def _drawn(self, nodes: np.ndarray, keys: np.ndarray) -> None:
        """Take each occurrence from its chunk's first node (-1: stays) to the one that its key's draws lead to."""
        going = np.flatnonzero(nodes >= 0)
        while len(going):
            now = nodes[going]
            many = self.many[now].astype(np.int64)
            begins = np.cumsum(many) - many
            owner = np.repeat(np.arange(len(now)), many)
            place = np.arange(len(owner)) - begins[owner]
            slot = self.first[now][owner] + place
            hits = np.flatnonzero(mix(keys[going][owner] + self.span[slot]) < np.uint64(self.threshold))
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]  # the first of each occurrence
            slot, place, going = slot[hits], place[hits], going[owner[hits]]
            parent = now[owner[hits]]
            some, at = np.unique(slot, return_index=True)
            fresh = self.child[some] < 0
            if fresh.any():
                some, at = some[fresh], at[fresh]
                before = parent[at]
                begin = np.where(self.parent[before] >= 0, self.step[before] + 1, 0)
                self.child[some] = self._learn(self.chunk[before], before, begin + place[at])
            nodes[going] = self.child[slot]

    def encode_many(self, texts: list[str | None], doc_ids: list, copies: list[int | None] | None = None) -> list[np.ndarray]:
        """Ids of each text; copies number texts that come with the same id (null and 0 are the first)."""
        if len(self.known) > self.size or self.nodes > 4 * self.size or self.used > 32 * self.size:
            self.forget()
        chunks: list[str] = []
        ends, whole = [], {}
        for i, text in enumerate(texts):
            if text:
                if "\u2581" in text:
                    if _ESCAPE in text:
                        whole[i] = self._bytes_only(text)
                    text = text.replace("\u2581", _ESCAPE)
                if i not in whole:
                    chunks += _CHUNK.findall("\u2581" + text.replace(" ", "\u2581"))
            ends.append(len(chunks))
        known, begin = self.known, len(self.chunks)
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        known.update(zip(new, itertools.count(begin)))
        number = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        self.chunks += new
        self.root = np.concatenate((self.root[:begin], np.full(len(new), -1, np.int32)))
        short = begin + np.flatnonzero(np.fromiter(map(len, new), np.int64, len(new)) <= _WIDE)
        if len(short):
            none = np.full(len(short), -1)
            self.root[short] = self._learn(short, none, none)
        ends = np.array(ends, np.int64)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        of = [f"{self.seed}:{d}:{c}" if c else f"{self.seed}:{d}" for d, c in zip(doc_ids, copies or itertools.repeat(0))]
        start = np.array([xxhash.xxh3_64_intdigest(x) for x in of], np.uint64)
        place = np.arange(len(chunks)) - np.repeat(begins, ends - begins)
        keys = mix(np.repeat(start, ends - begins) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        nodes = self.root[number]
        if self.threshold:
            for at in range(0, len(nodes), _BLOCK):
                self._drawn(nodes[at : at + _BLOCK], keys[at : at + _BLOCK])
        for i in np.flatnonzero(nodes < 0).tolist():
            ids = np.array(self.merge(chunks[i], int(keys[i])), np.int32)
            none = np.zeros(0, np.uint64)
            nodes[i : i + 1] = self._new(number[i : i + 1], -1, -1)
            self._store(nodes[i : i + 1], ids, np.array([len(ids)], np.int32), none, np.zeros(1, np.int32))
        length = self.length[nodes].astype(np.int64)
        stop = np.concatenate(([0], np.cumsum(length)))
        ids = self.pool[np.repeat(self.at[nodes] - stop[:-1], length) + np.arange(stop[-1])]
        return [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(stop[begins].tolist(), stop[ends].tolist()))]

    def encode(self, text: str | None, doc_id: int | None = None, copy: int | None = None) -> np.ndarray:
        return self.encode_many([text], [doc_id], [copy])[0]

    def _bytes_only(self, text: str) -> np.ndarray:
        return np.array([self.ids["▁"], *(self.byte[b] for b in text.encode())], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        return b"".join([out[i] for i in ids.tolist()]).decode()[1:]


@lru_cache(maxsize=1)
def _codec(settings: tuple) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(**dict(settings))


def slices(batch: pa.RecordBatch, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with texts of up to `most` bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = held = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield batch.slice(at, stop - at)
        at, held = stop, int(ends[stop - 1])


def _map(docs: DataFrame, schema: str, row, forget: bool = False, **settings) -> DataFrame:
    """forget: what a task has learned goes with it, for less memory between tasks and more CPU."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tuple(sorted(settings.items())))
        for batch in batches:
            for part in slices(batch):
                yield row(codec, part)
        if forget:
            codec.forget()

    return docs.mapInArrow(giving_back(run), schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None, adjacent: bool = False, **settings) -> DataFrame:
    """id and ids (array<int>) of every row; copy_col numbers rows that repeat an id, so that each draws for itself; adjacent: rows that follow each other
    with the same id are numbered as they come, as where a table repeats a row in place."""
    last, nth = None, 0

    def row(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal last, nth
        keys, copies = part["id"].to_pylist(), part["copy"].to_pylist()
        if adjacent:
            for i, key in enumerate(keys):
                last, nth = key, nth + 1 if key is not None and key == last else 0
                copies[i] = nth
        ids = codec.encode_many(part["text"].to_pylist(), keys, copies)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(copy_col) if copy_col else F.lit(0)).alias("copy")), f"{id_col} {kind}, ids array<int>", row, forget=True, **settings)


def roundtrip(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian int32), text_sha256 (of the decoded text) and lossless, of every row."""

    def row(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [t or "" for t in part["text"].to_pylist()]
        ids = codec.encode_many(rows, part["doc_id"].to_pylist())
        back = [codec.decode(i) for i in ids]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(i.astype("<i4").tobytes()) for i in ids]), pa.array([sha(b.encode()) for b in back]), pa.array([b == t for b, t in zip(back, rows)])]
        return pa.RecordBatch.from_arrays([part["doc_id"], *cols], names=["doc_id", "n_ids", "ids_sha256", "text_sha256", "lossless"])

    return _map(docs.select("doc_id", "text"), "doc_id long, n_ids long, ids_sha256 string, text_sha256 string, lossless boolean", row, **settings)
