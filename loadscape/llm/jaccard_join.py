"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles. Each shingle flips one bit of a sketch of 2^40 bits, so
bits on which two sketches differ are at most the shingles on which the sets differ, and a link of sizes a and b
allows at most (a + b)(1 - s) / (1 + s) of those, s being the similarity. Per size band the sketch is cut into
parts. Two linked sets differ in at most H parts, so if both take the first H + 1 of their non-empty parts in one
global order, they share one that is equal in both: an equi-join of parts finds every link (pigeonhole). The order
puts parts made of frequent shingles last; frequent ones are counted over all documents, and a wrong or missing
count costs time, never a link. A set is joined in its own band and in the next if a partner may be there.

Equal sets are one class from the start: parts carry the class, not the document. A class is named by 64 bits of its
shingles' hashes; where a second, independent 64 bits show that two sets share a name, those take both. Parts travel
packed, one row for each batch and target partition, and are matched there by sorting; the number of partitions follows
the number of parts. A bucket of many classes is not paired off: it is cut into blocks of BLOCK, and pairs of blocks
are tasks of their own, in which members of different components are held against each other by the Hamming distance
of folded sketches. What passes with one member is verified against that one, and only members that are then still
in different components are compared further, all of them in the end. A class lists its largest buckets, and two classes
that list a bucket in common meet in one of these only, so copies with many parts in common are one pair, not one a part.
Of the texts and sketches that a join would move, those that cannot have a partner in it are left out before by a mark of bits.

Defined results: A-Z is lower-cased, nothing else; a document with fewer words than a shingle has one, the whole
sequence; one without words or text has an empty set and links with nothing; a link at exactly the least similarity
counts; rows that share a doc_id are one document, linked as any of their texts is, and each is reported with the
size of its own set; a null doc_id takes no part in links and is its own row with a null component; a text of any
length is read whole (the parts of a long one are dealt to several tasks); no rows give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.common import giving_back, kept, lowered, mix, run_hashes, word_hash_pair, word_hashes
from loadscape.llm.components import components

WORDS, PERCENT, FREQUENT, LOCAL_FREQUENT, SKETCH = 5, 75, 1 << 16, 6, 512
#: Members of a bucket that one task holds against each other, parts that are matched at once, shingles of a class whose parts go to one task, and pairs that share a copy of a text.
BLOCK, MATCH_PARTS, LONG_SET, PAIRS = 1024, 2_000_000, 1024, 128
SALTS = 16
#: How many of its buckets with so many members a class lists.
LISTED, LARGE = 8, 16
#: Bits of the mark by which rows are chosen before they move; a power of two, 64 at least.
MARK = 1 << 23
_BASE, _SECOND, _FLUSH = 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93, 1 << 21


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = word_hashes(lowered(text)) if text else np.zeros(0, np.uint64)
    return np.unique(run_hashes(words, min(k, len(words)), _BASE)) if len(words) else words


def shingles_and_check(text: str | None, k: int = WORDS) -> tuple[np.ndarray, int]:
    """The shingles, and a hash of the set that does not depend on theirs."""
    first, second = word_hash_pair(lowered(text)) if text else (np.zeros(0, np.uint64),) * 2
    if not len(first):
        return first, 0
    n = min(k, len(first))
    first, second = run_hashes(first, n, _BASE), run_hashes(second, n, _SECOND)
    found = np.unique(first)
    if len(found) < len(first):
        second = second[np.unique(first, return_index=True)[1]]
    return found, int(second.sum(dtype=np.uint64).view(np.int64))


def set_class(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


class Names:
    """The class of a text's set: 64 bits, or both hashes where two sets share these."""

    def __init__(self, shared: list[int], k: int, name):
        self.shared, self.k, self.name = frozenset(shared), k, name

    def __call__(self, hashes: np.ndarray, text: str) -> int:
        name = self.name(hashes)
        return name ^ shingles_and_check(text, self.k)[1] if name in self.shared else name


def sketches(sets: list[np.ndarray]) -> pa.ListArray:
    """The parity sketch of each set, folded to two to four bits a shingle (a power of two, SKETCH at least): one bit flipped by each shingle."""
    rows = []
    for x in sets:
        n = max(SKETCH, 2 << len(x).bit_length())
        rows.append(np.packbits((np.bincount((x >> np.uint64(24)).astype(np.int64) % n, minlength=n) & 1).astype(np.uint8)).view(np.int64))
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch folded further, to a smaller number of words."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _near(a: np.ndarray, b: np.ndarray, total: int, percent: int) -> bool:
    words = min(len(a), len(b))
    return int(np.bitwise_count((folded(a, words) ^ folded(b, words)).view(np.uint64)).sum()) * (100 + percent) <= total * (100 - percent)


_PAIR = "a long, b long, a_rep long, b_rep long, part long"


def _near_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, both sizes, sketches and reps, part) whose sketches admit a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch["a_size"].to_numpy().astype(np.int64) + batch["b_size"].to_numpy()).tolist()
            keep = [_near(x.values.to_numpy(), y.values.to_numpy(), n, percent) for x, y, n in zip(batch["a_sketch"], batch["b_sketch"], sizes)]
            yield batch.select(["a", "b", "a_rep", "b_rep", "part"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(giving_back(run), _PAIR)


def most_different(a: int, percent: int = PERCENT) -> int:
    """On how many shingles a set of size a and its largest partner may differ."""
    largest = a * 100 // percent
    return (a + largest) * (100 - percent) // (100 + percent)


def part_keys(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The parts by which a set is joined, as 64-bit keys of (band, part, bits)."""
    n, out = len(hashes), []
    often = np.zeros(n, np.uint64)
    if len(frequent):
        often = (frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes).astype(np.uint64)
    bit = mix(hashes & np.uint64((1 << 40) - 1))  # a random word for each bit; the words of a part's odd bits, xored, name its pattern
    band = n.bit_length()
    for b in range(band, (n * 100 // percent).bit_length() + 1):
        # at least as many parts as shingles; small sets get so many that more than H are filled, as they must be
        parts = np.uint64(1 << (b if b >= 8 else 16))
        part = mix(hashes + np.uint64(b)) >> np.uint64(20)
        part = part % parts
        by = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[by], prepend=np.uint64(1 << 63)))
        bits = np.bitwise_xor.reduceat(bit[by], at)
        filled = bits != 0
        common = np.minimum.reduceat(often[by], at)[filled]
        key = mix(bits[filled] ^ mix(part[by][at][filled] + (np.uint64(b) << np.uint64(50))))
        take = most_different(n, percent) + 1
        order = np.lexsort((key, common))
        out.append(key[order[:take]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size, class and sketch of every document, and check, which tells sets of one class apart; and, here and there, shingles frequent in a batch with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, checks = zip(*(shingles_and_check(t.as_py(), k) for t in batch["text"])) if batch.num_rows else ((), ())
            hot, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            hot, counts = hot[counts >= LOCAL_FREQUENT], counts[counts >= LOCAL_FREQUENT]
            at = np.full(len(sets) + 1, 0, np.int32)
            at[1:] = len(hot)  # with the batch's first document
            lists = lambda x: pa.ListArray.from_arrays(at, pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()), pa.array(checks, pa.int64()), sketches(sets), lists(hot.view(np.int64)), lists(counts)],
                names=["doc_id", "size", "class", "check", "sketch", "hot", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, size long, class long, check long, sketch array<long>, hot array<long>, counts array<long>")


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest ones first: of small numbers the higher ones are zeros, which compress."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _packed_parts(docs: DataFrame, k: int, percent: int, frequent, names: Names, n: int) -> DataFrame:
    """p and, packed: classes, their sizes, numbers of keys, and keys that belong to partition p."""

    def pack(classes: list[int], sizes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(classes)), [len(x) for x in keys])
        key = np.concatenate(keys)
        p = ((key >> np.uint64(32)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int32)
        by = np.argsort(p, kind="stable")  # who ascends
        p, who, key = p[by].astype(np.int64), who[by], key[by].astype(np.uint32)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        rows, classes, sizes = [], np.array(classes, np.int64), np.array(sizes, np.int32)
        for a, b in zip(first, [*first[1:], len(p)]):
            starts = np.flatnonzero(np.diff(who[a:b], prepend=-1))
            own = who[a:b][starts]
            rows.append((int(p[a]), classes[own].tobytes(), _planes(sizes[own]), _planes(np.diff(np.append(starts, b - a))), key[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["p", "classes", "sizes", "counts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        classes, sizes, keys, met, held = [], [], [], set(), 0
        for batch in batches:
            for text, doc_id in zip(batch["text"], batch["doc_id"].to_pylist()):
                s = shingles(text.as_py(), k) if doc_id is not None else ()
                if not len(s) or (c := names(s, text.as_py())) in met:
                    continue  # equal sets of a batch travel once
                met.add(c)
                own = part_keys(s, hot, percent)
                classes.append(c)
                sizes.append(len(s))
                keys.append(own)
                held += len(own)
                if held >= _FLUSH:
                    yield pack(classes, sizes, keys)
                    classes, sizes, keys, met, held = [], [], [], set(), 0
        if keys:
            yield pack(classes, sizes, keys)

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "p int, classes binary, sizes binary, counts binary, keys binary")


def _buckets(packed: DataFrame, percent: int, n: int) -> DataFrame:
    """The classes that share a part; equal lists of a partition come once. Two: class, size, other, other_size; more: bucket, class, size, and the block of the bucket's blocks (own; the bucket's first class visits the other blocks too), and many, the bucket's members."""
    names = ["bucket", "class", "size", "block", "blocks", "own", "many", "other", "other_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        key_now = None

        def match(p: int, rows: list) -> Iterator[pa.RecordBatch]:
            classes = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
            sizes = np.concatenate([_from_planes(r[1]) for r in rows])
            counts = np.concatenate([_from_planes(r[2]) for r in rows])
            keys = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            who, cls = np.repeat(np.arange(len(classes)), counts), np.repeat(classes, counts)
            by = np.lexsort((cls, keys))
            key, cls, who = keys[by], cls[by], who[by]
            same_key = np.append(False, key[1:] == key[:-1])
            again = same_key & np.append(False, cls[1:] == cls[:-1])  # the same class from several batches
            key, cls, who = key[~again], cls[~again], who[~again]
            starts = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
            lengths = np.diff(np.append(starts, len(key)))
            some = lengths > 1
            # a list of classes as one hash: the sum of its classes' mixed ids
            digest = np.add.reduceat(mix(cls.view(np.uint64)), starts) if len(starts) else starts
            _, first = np.unique(digest[some], return_index=True)
            starts, lengths, digests = starts[some][first], lengths[some][first], digest[some][first]
            two = starts[lengths == 2]
            small, large = sizes[who[two]], sizes[who[two + 1]]
            two = two[np.minimum(small, large).astype(np.int64) * 100 >= np.maximum(small, large).astype(np.int64) * percent]
            small, large = sizes[who[two]], sizes[who[two + 1]]
            none = lambda kind: pa.nulls(len(two), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(cls[two]), pa.array(small), none(pa.int32()), none(pa.int32()), none(pa.bool_()), none(pa.int32()), pa.array(cls[two + 1]), pa.array(large)], names=names)
            starts, lengths, digests = starts[lengths > 2], lengths[lengths > 2], digests[lengths > 2]
            for at in range(0, len(starts), 20_000):
                st, ln = starts[at : at + 20_000], lengths[at : at + 20_000]
                nth = np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
                pos = np.repeat(st, ln) + nth
                bucket = np.repeat(mix(digests[at : at + 20_000] ^ ln.astype(np.uint64)).view(np.int64), ln)  # the same for the same list anywhere
                many = np.repeat(ln, ln).astype(np.int32)
                block, blocks = (nth // BLOCK).astype(np.int32), -(-many // BLOCK)
                visit = (nth % BLOCK == 0) & (nth > 0)  # once for every further block
                head = (pos - nth)[visit]
                at_once = [np.append(a, b) for a, b in ((bucket, bucket[visit]), (cls[pos], cls[head]), (sizes[who[pos]], sizes[who[head]]), (block, block[visit]), (blocks, blocks[visit]), (np.ones(len(pos), bool), np.zeros(len(head), bool)), (many, many[visit]))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, at_once), pa.nulls(len(pos) + len(head), pa.int64()), pa.nulls(len(pos) + len(head), pa.int32())], names=names)

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != key_now and key_now is not None:
                    yield from match(key_now, held.pop(key_now))
                key_now = p
                held.setdefault(p, []).append(row)
        if key_now is not None:
            yield from match(key_now, held.pop(key_now))

    return packed.repartition(n, "p").sortWithinPartitions("p").mapInArrow(giving_back(run), "bucket long, class long, size int, block int, blocks int, own boolean, many int, other long, other_size int")


def _among(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose `name`, a long, is not in ids, which has that column alone; none that is there goes.

    ids are marked in MARK bits by a hash, which go to all tasks as a table of words, so nothing else moves. The more
    ids there are, the more other rows stay: an eighth of them at a million.
    """
    at = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(MARK))
    word, bit = F.shiftright(F.col("_at"), 6).alias("_word"), F.expr("shiftleft(1L, cast(_at & 63 as int))")
    words = ids.select(at.alias("_at")).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_at", at).withColumn("_word", word).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _sets(docs: DataFrame, classes: DataFrame, names: Names, k: int) -> DataFrame:
    """class and text of each class's representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), k) for t in batch["text"]]
            right = pa.array([len(x) > 0 and names(x, t.as_py()) == c for x, c, t in zip(found, batch["class"].to_pylist(), batch["text"])], pa.bool_())  # an id may repeat with another text
            yield pa.RecordBatch.from_arrays([batch["class"], batch["text"]], names=["class", "text"]).filter(right)

    # rows of an id are together after the join, so equal ones go without another move of texts
    classes = classes.withColumnRenamed("rep", "doc_id")
    reps = _among(docs.select("doc_id", "text"), "doc_id", classes.select("doc_id")).join(classes, "doc_id").select("doc_id", "class", "text").dropDuplicates()
    found = kept(reps.select("class", "text").mapInArrow(giving_back(run), "class long, text string"), "jaccard-sets")
    # texts of one id that differ and have the same set: as a rule there are none
    if found.groupBy("class").count().filter("count > 1").isEmpty():
        return found
    return kept(found.dropDuplicates(["class"]), "jaccard-sets")


def _listed(buckets: DataFrame) -> DataFrame:
    """class and listed: of its buckets with LARGE members or more, the LISTED largest."""
    large = buckets.filter((F.col("many") >= LARGE) & F.col("own")).groupBy("class").agg(F.collect_list(F.struct((-F.col("many")).alias("order"), "bucket")).alias("all"))
    return large.select("class", F.slice(F.sort_array("all"), 1, LISTED)["bucket"].alias("listed"))


def _halved(sketch: str) -> F.Column:
    """A sketch of more than SKETCH bits folded once, as folded() does; a pair that a sketch admits, its fold admits."""
    half = (F.size(sketch) / 2).cast("int")
    fold = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(sketch) * 64 > SKETCH, fold).otherwise(F.col(sketch))


def _elsewhere(bucket: int, lists: list[list[int]]):
    """For i and rows: which of the rows meet member i in another bucket. Members that list buckets in common meet in the lowest of these."""
    known, at = np.unique(np.array([b for x in lists for b in x], np.int64), return_inverse=True)
    lengths, n = np.fromiter(map(len, lists), np.int64, len(lists)), len(known)
    codes = np.full((len(lists), max(1, lengths.max())), n)  # n: nothing more is listed
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = at
    own, mark = int(np.searchsorted(known, bucket)), np.zeros(n + 1, bool)
    here = (codes == own).any(axis=1) & (bucket in known)

    def met(i: int, rows: np.ndarray) -> np.ndarray:
        mark[codes[i, : lengths[i]]] = True
        common = mark[codes[rows]]
        mark[codes[i]] = False
        return (common & (codes[rows] < own)).any(axis=1) | common.any(axis=1) & ~(here[rows] & here[i])

    return met


def _candidates(tasks: DataFrame, percent: int, most: int) -> DataFrame:
    """For blocks of buckets (bucket, block, class, size, own, active, rep, component, sketch, listed): pairs to verify, and the active members that wait for the next round (bucket, class).

    One after another, active members are held against the block's own of other components by size and by the
    Hamming distance of their sketches; those that pass are verified, up to 8 x `most` for the same two components. An
    active member that already is in `most` of a round's pairs, or has more than these with one component, waits, as many are in
    one component by then; one that does not wait in any block has been held against all. Members that list other buckets in
    common may meet in one of those, and are then not held against each other here. In the first round, when every
    class is its own component, an active member is paired with those that are in no pair and with 8 others; if there are more, it waits as
    these do, and the second round holds them against each other if they are in different components still. So a bucket's pairs grow with its members.
    """
    names = ["bucket", "class", "a", "b", "a_rep", "b_rep", "part"]

    def pairs_of(bucket, cls, size, own, active, comp, sk, lists) -> tuple[list, np.ndarray]:
        elsewhere = None
        paired, waits, out, met = np.zeros(len(cls), int), np.zeros(len(cls), bool), [], {}
        for i in np.flatnonzero(active).tolist():
            if paired[i] >= most:
                waits[i] = True
                continue
            near = own & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent) & (comp != comp[i])
            if own[i]:
                near[:i] &= waits[:i] | ~active[:i]  # the others before were held against this one
            rows = np.flatnonzero(near)
            rows = rows[np.bitwise_count(sk[rows] ^ sk[i]).sum(axis=1) * (100 + percent) <= (size[rows] + size[i]) * (100 - percent)]
            if len(rows) and lists[i]:
                elsewhere = elsewhere or _elsewhere(bucket, lists)
                rows = rows[~elsewhere(i, rows)]
            if not len(rows):
                continue
            rows = rows[np.argsort(comp[rows], kind="stable")]
            at = np.flatnonzero(np.append(True, np.diff(comp[rows]) != 0))
            keep = []
            for c, x, y in zip(comp[rows[at]].tolist(), at.tolist(), [*at[1:].tolist(), len(rows)]):
                pair = (min(c, comp[i]), max(c, comp[i]))
                used = met.get(pair, 0)
                some = rows[x : min(y, x + 8 * most - used)]
                met[pair] = used + len(some)
                waits[i] |= len(some) < y - x
                keep.append(some)
            rows = np.concatenate(keep)
            if most == 1:  # all components are single classes
                again = np.flatnonzero(paired[rows] > 0)[8:]
                waits[i] |= len(again) > 0
                rows = np.delete(rows, again)
            paired[rows] += 1
            out.append((np.full(len(rows), i), rows))
        return out, waits

    def flush(key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[0])
        cls, size, own, active, rep, comp = (np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.int64, bool, bool, np.int64, np.int64)))
        words = min(len(r[6]) for r in rows)
        sk = np.stack([folded(r[6], words) for r in rows]).view(np.uint64)
        out, waits = pairs_of(key[0], cls, size, own, active, comp, sk, [r[7] for r in rows])
        i, j = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in (0, 1))
        part = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(o[1])) // PAIRS for o in out)]) + hash(key) % (1 << 32) * (1 << 24)
        i, j = np.minimum(i, j), np.maximum(i, j)  # in the order of classes
        n, m = len(i), int(waits.sum())
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m, pa.int64()), pa.array(cls[waits]), *(pa.nulls(m, pa.int64()) for _ in range(5))], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(2)), pa.array(cls[i]), pa.array(cls[j]), pa.array(rep[i]), pa.array(rep[j]), pa.array(part)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, block, *row, bits, listed in zip(*(batch[c].to_pylist() for c in ("bucket", "block", "class", "size", "own", "active", "rep", "component")), batch["sketch"], batch["listed"].to_pylist()):
                if (bucket, block) != now:
                    if rows:
                        yield from flush(now, rows)
                    now, rows = (bucket, block), []
                rows.append((*row, bits.values.to_numpy(), listed or []))
        if rows:
            yield from flush(now, rows)

    if "listed" not in tasks.columns:
        tasks = tasks.withColumn("listed", F.lit(None).cast("array<long>"))
    return tasks.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(giving_back(run), "bucket long, class long, a long, b long, a_rep long, b_rep long, part long")


def _block_tasks(named: DataFrame, second: bool) -> tuple[DataFrame, DataFrame]:
    """What the blocks hold in a later round: their own members, and the active ones of the bucket's other blocks; and these members, without what is done.

    Members of a bucket's largest component are held by all others, so in the second round only these are active;
    from then on, those that waited. Buckets in one component, or with no active member, are done.
    """
    sizes = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("blocks"), F.max("active").alias("any"))
    tops = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("components"), F.max("blocks").alias("blocks"), F.max("any").alias("any")).filter("components > 1 and any")
    # a bucket's blocks meet its row apart
    tops = tops.select("bucket", "major", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    members = named.join(tops, ["bucket", "block"])
    members = kept(members.withColumn("active", F.col("component") != F.col("major") if second else F.col("active")).drop("major"), "jaccard-members")
    visit = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))).alias("to")
    visitors = members.filter("active and blocks > 1").select("*", visit).withColumn("block", F.col("to")).drop("to")
    return members.withColumn("own", F.lit(True)).unionByName(visitors.withColumn("own", F.lit(False))), members.select("bucket", "class", "size", "block", "blocks", "active")


def _verify(pairs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The pairs with inter and either, the sizes of their sets' intersection and union; sets: class, text.

    The text of a travels once for all pairs of its part, then come those of the partners.
    """
    heads = pairs.select("a", "part").distinct().join(sets.select(F.col("class").alias("a"), "text"), "a")
    heads = heads.select("a", "part", *(F.lit(None).cast("long").alias(c) for c in ("b", "a_rep", "b_rep")), "text")
    stream = heads.unionByName(pairs.join(sets.select(F.col("class").alias("b"), "text"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            at, found = [], []
            for i, (b, text) in enumerate(zip(batch["b"].to_pylist(), batch["text"])):
                own = shingles(text.as_py(), k)
                if b is None:
                    x = own
                else:
                    both = len(np.intersect1d(x, own, assume_unique=True))
                    at.append(i)
                    found.append((both, len(x) + len(own) - both))
            rows = batch.select(["a", "b", "a_rep", "b_rep"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], names=["a", "b", "a_rep", "b_rep", "inter", "either"])

    key = ["a", "part"]
    return stream.repartition(*key).sortWithinPartitions(*key, F.col("b").asc_nulls_first()).mapInArrow(giving_back(run), "a long, b long, a_rep long, b_rep long, inter long, either long")


def profiles(docs: DataFrame, k: int = WORDS) -> tuple[DataFrame, np.ndarray, Names]:
    """doc_id, size, class and sketch of every document, the frequent shingles (sorted, at most FREQUENT), and what names a class."""
    found = kept(_profile(docs, k), "shingle-profiles")
    hot = found.select(F.explode(F.arrays_zip("hot", "counts")).alias("h")).groupBy("h.hot").agg(F.sum("h.counts").alias("n"))
    top = hot.orderBy(F.col("n").desc(), F.col("hot")).limit(FREQUENT).toPandas()["hot"].to_numpy()
    # of n different sets about n^2 / 2^65 share a name: none as a rule, a few at 1e10
    shared = [r["class"] for r in found.filter("class is not null").groupBy("class").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).filter("c0 <> c1").collect()]
    if shared:
        found = found.withColumn("class", F.when(F.col("class").isin(shared), F.col("class").bitwiseXOR(F.col("check"))).otherwise(F.col("class")))
    return found.select("doc_id", "size", "class", "sketch"), np.sort(top.astype(np.int64).view(np.uint64)), Names(shared, k, set_class)


def _salted(rows: DataFrame, classes: DataFrame, name: str = "class") -> DataFrame:
    """rows (name, {name}_size, salt_by) joined with classes; a long set is in many buckets, so its rows are dealt to several tasks."""
    spread = lambda size: 1 + F.floor(size / LONG_SET)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("salt_by"), spread(F.col(f"{name}_size")))).drop("salt_by")
    rest = [F.col(c).alias(f"{name}_{c}") for c in classes.columns if c not in ("class", "size")]
    right = classes.select(F.col("class").alias(name), *rest, F.explode(F.sequence(F.lit(0).cast("long"), spread(F.col("size")) - 1)).alias("_salt"))
    return left.join(right, [name, "_salt"]).drop("_salt")


def linked_classes(docs: DataFrame, profile: DataFrame, frequent: np.ndarray, names: Names, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, component of the representatives (smallest doc_id) of classes that have links."""
    spark = docs.sparkSession
    # a set has at most so many parts: those on which it may differ and one, in two bands
    total = profile.agg(F.coalesce(F.sum(2 * (F.col("size") * (200 - percent) / (100 + percent) + 1)), F.lit(0.0))).first()[0]
    n = max(1, int(total // MATCH_PARTS))
    packed = _packed_parts(docs, k, percent, spark.sparkContext.broadcast(frequent), names, min(n, 1 << 30))
    shared = kept(_buckets(packed, percent, min(2 * n, 100_000)).distinct(), "jaccard-buckets")
    known_classes = profile.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("size").cast("int").alias("size"), F.first("sketch").alias("sketch"))
    met = shared.select("class").unionByName(shared.select(F.col("other").alias("class"))).distinct()
    buckets = shared.filter("bucket is not null").drop("other", "other_size")
    classes = kept(met.join(known_classes, "class").join(_listed(buckets), "class", "left"), "jaccard-classes")
    alone = classes.drop("listed")
    twos = shared.filter("other is not null").select(F.col("class").alias("a"), F.col("size").alias("a_size"), F.col("other").alias("b"), F.col("other_size").alias("b_size"), F.pmod(F.xxhash64("other"), F.lit(8)).alias("part"))
    twos = _salted(_salted(twos.withColumn("salt_by", F.col("b")), alone, "a").withColumn("salt_by", F.col("a")), alone, "b")
    pairs = _near_pairs(twos, percent)
    with_class = lambda rows, labelled: _salted(rows.withColumnRenamed("size", "class_size").withColumn("salt_by", F.col("bucket")), labelled).withColumnsRenamed({f"class_{c}": c for c in ("size", "rep", "sketch", "component", "listed")})
    # at first every class is its own component
    buckets = buckets.drop("many")
    tasks = with_class(buckets, _among(classes, "class", buckets.select("class")).withColumn("component", F.col("rep")).withColumn("sketch", _halved("sketch"))).withColumn("active", F.lit(True))
    sets = found = known = pool = None
    most = 1
    while True:
        round_ = kept(_candidates(tasks, percent, most), "jaccard-round")
        made = round_.filter("a is not null").select("a", "b", "a_rep", "b_rep", "part")
        made = (pairs.unionByName(made) if pool is None else made).groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("a_rep", "b_rep", "part")))
        waits = round_.filter("bucket is not null").select("bucket", "class").distinct()
        if pool is None:
            # members that wait, and of buckets of several blocks all; later rounds pair only these
            pool = buckets.filter("own").join(waits.withColumn("waits", F.lit(True)), ["bucket", "class"], "left").filter("waits or blocks > 1")
            pool = kept(pool.drop("own", "waits").withColumn("active", F.lit(True)), "jaccard-waiting")
            made = kept(made, "jaccard-first-pairs")
            paired = made.select(F.col("a").alias("class"), F.col("a_rep").alias("rep")).unionByName(made.select(F.col("b").alias("class"), F.col("b_rep").alias("rep")))
            paired = paired.unionByName(pool.select("class").distinct().join(classes.select("class", "rep"), "class")).distinct()
            sets = _sets(docs, paired, names, k)
        else:
            made = made.join(known, ["a", "b"], "left_anti")
            pool = pool.drop("active").join(waits.withColumn("active", F.lit(True)), ["bucket", "class"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
            pool = kept(pool, "jaccard-waiting")
        checked = kept(_verify(made, sets, k), "jaccard-pairs")
        known = checked.select("a", "b") if known is None else known.unionByName(checked.select("a", "b"))
        linked = checked.filter(F.col("inter") * 100 >= F.col("either") * percent).select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"))
        # the components so far stand for all links so far
        found = kept(components(linked if found is None else found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(linked)), "jaccard-components")
        if pool.filter("active").isEmpty():
            return found
        labelled = classes.join(found, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep")).drop("id")
        named = with_class(pool, _among(labelled, "class", pool.select("class")))
        tasks, pool = _block_tasks(kept(named, "jaccard-named"), most == 1)
        if tasks.isEmpty():
            return found
        most *= 8


def components_of(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    profile, frequent, names = profiles(docs, k)
    labels = linked_classes(docs, profile, frequent, names, k, percent)
    named = profile.filter("class is not null and doc_id is not null").select("doc_id", "class")
    reps = named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    # a doc_id with several texts is one node in all their classes
    several = named.groupBy("doc_id").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).filter("c0 <> c1").select("doc_id")
    ties = kept(named.join(several, "doc_id").distinct().join(reps, "class").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "jaccard-ties")
    if not ties.isEmpty():
        labels = kept(components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(ties)), "jaccard-components")
    # only classes that have a smaller doc_id to point to; a class of very many copies is dealt to SALTS tasks
    of_class = reps.join(labels, F.col("rep") == F.col("id"), "left").select("class", F.coalesce("component", "rep").alias("component_id"), "last").filter("component_id <> last").drop("last")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = profile.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(of_class.select("class", "component_id", salts), ["class", "salt"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
