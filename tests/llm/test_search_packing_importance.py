"""Lexical search, packing and importance resampling against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.llm import importance, lexical, packing, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RARE = [None, "", "...", "a", "Zwölf Boxkämpfer, jagen-Viktor!", "x\0y\nz", "日本 日本 текст", "naïve ÀÉ İ ß", "<|endoftext|> a <|endoftext|>"]


def texts(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdkl" for b in ("a", "é", "o") for c in ("", "n", "st", "r")] + ["İx", "ß", "42", "x9"]
    out = [" ".join(rng.choice(words[: rng.choice((5, 20, len(words)))]).capitalize() + rng.choice(("", ".", ",", "\n", "  ")) for _ in range(rng.choice((1, 3, 30, 300)))) for _ in range(n)]
    return out + out[:40] + RARE + ["word " * 30_000, "longword" * 40_000]


def rows_of(spark, some, extra="rank string, score string, g int, qb int, floor int, length string, task string, number int"):
    names = [c.split()[0] for c in extra.split(", ")]
    return spark.createDataFrame([(i, t, *[None] * len(names)) for i, t in some], f"doc_id long, text string, {extra}").repartition(5)


def plain_search(docs, items, k=50):
    lists = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    lists = [(i, c, sum(c.values())) for i, c in lists if c]
    n, total, df, out = len(lists), sum(x[2] for x in lists), Counter(t for x in lists for t in x[1]), []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOW)))}
        scores = []
        for i, c, size in lists:
            m = 50 + 50 * size * n // total
            scores.append((-sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c), i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k]) if s < 0]
    return out


ITEMS = [(0, "bast dar lé"), (1, None), (2, "..."), (3, "42 x9 42 İX"), (4, "nowhere"), (5, "longword ba ba ba"), (5, "BA"), (None, "ba kon lost"), (7, " ".join(f"{a}{b}n" for a in "bdkl" for b in "aéo"))]


@pytest.mark.parametrize(("block", "postings", "at_once"), [(64, 1 << 19, 1024), (2, 300, 2), (1, 1000, 1)])
def test_search_against_plain(spark, block, postings, at_once):
    docs = [*enumerate(texts()), (None, "bast dar"), (None, "bast dar"), (3, "bast"), (3, "bast")]
    items = spark.createDataFrame([(i, t, None) for i, t in ITEMS], "item_id long, text string, row int")
    found = lexical.search(rows_of(spark, docs), items, block=block, postings=postings, queries_at_once=at_once, seeds=3)
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(found.select("item_id", "rank", "doc_id", "score").collect()) == order(plain_search(docs, ITEMS))


def test_search_skips_blocks_and_lists():
    """Documents of 40 kinds, each with terms of its kind, half of them with the heaviest term and all with light ones."""
    rng = np.random.default_rng(1)
    terms = [np.unique(np.concatenate((np.zeros(rng.integers(0, 2), int), 1 + g * 5 + rng.integers(0, 5, 4), 201 + rng.integers(0, 3, 2)))) for g in rng.integers(0, 40, 4000)]
    counts, every = np.array([len(t) for t in terms]), np.concatenate(terms)
    made = lexical.Index(np.arange(4000), counts, every, rng.integers(300_000, 500_000, len(every)), 204, block=16)
    dense = np.zeros((4000, 204), np.int64)
    dense[np.repeat(np.arange(4000), counts), every] = made.impacts
    for g in range(40):
        asked, weights = np.array([0, g * 5 + 1, g * 5 + 2, 201, 202]), np.array([5000, 4900, 4800, 300, 200])
        ids, scores = made.search(asked, weights, k=10)
        want = dense[:, asked] @ weights
        best = np.lexsort((np.arange(4000), -want))[:10]
        assert ids.tolist() == best.tolist() and scores.tolist() == want[best].tolist()
    assert made.told["blocks skipped"] * 2 > made.told["blocks"] and made.told["lists skipped"] * 4 > made.told["lists"]
    assert made.told["documents scored"] * 5 < made.told["documents"]
    at, doc, starts, own, most, first = made.blocked(201)
    for a, b, x, y in zip(starts, starts[1:], first, [*first[1:], len(own)]):
        assert b - a <= 32
        summary = np.zeros(204, np.int64)
        summary[own[x:y]] = most[x:y]
        assert (summary[201:] == dense[doc[a:b], 201:].max(axis=0)).all()


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(rows_of(spark, []), items).count() == 0
    assert lexical.search(rows_of(spark, [(1, None), (2, "")]), items).count() == 0
    assert lexical.search(rows_of(spark, [(1, "a b")]), none).count() == 0
    assert [tuple(r) for r in lexical.search(rows_of(spark, [(1, "A-b")]), items).collect()] == [(1, 1, 1, 2 * 287 * (1_000_000_000 // 3000))]


def plain_ids(found):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.vocabulary())
    return [[*made.encode(t or "", add_special_tokens=False).ids, 0] for t in found]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_is_whole_and_tight(spark, capacity):
    docs = [*enumerate(texts(5)), (None, "a b"), (None, "a b"), (3, None), (3, None)]
    rows = packing.pack(rows_of(spark, docs), capacity).collect()
    want = Counter()
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs])):
        first = len(ids) % capacity or capacity
        cut = [ids[:first]] + [ids[a : a + capacity] for a in range(first, len(ids), capacity)]
        want.update((i, k, sum(map(len, cut[:k])), len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(cut))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= capacity
    assert len(used) == best_fit([r["length"] for r in rows], capacity)[0]


def best_fit(lengths, capacity):
    """The method piece by piece: matching of large ones, then best fit."""
    bins = []
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        a = large.pop(0)
        b = next((n for n in large if a + n <= capacity), None)
        if b is not None:
            large.remove(b)
        bins.append(capacity - a - (b or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [(g, i) for i, g in enumerate(bins) if g >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins), sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_packing_by_length_is_packing_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice((7, 30, 97))
    lengths = [min(capacity, max(1, int(rng.expovariate(1 / rng.choice((3, capacity / 3, capacity / 1.5)))))) for _ in range(rng.choice((0, 1, 5, 200)))]
    made = packing.Packing(Counter(lengths), capacity)
    inside, numbers = {}, Counter()
    for length, first, many, each, sequence, place in sorted(made.slots, key=lambda s: s[5]):
        for i in range(many):
            assert inside.get(sequence + i // each, 0) == place + i % each * length  # gapless, in the order of places
            inside[sequence + i // each] = place + (i % each + 1) * length
        numbers.update((length, n) for n in range(first, first + many))
    assert numbers == Counter((n, i) for n, c in Counter(lengths).items() for i in range(c))
    assert sorted(inside) == list(range(made.sequences)) and all(v <= capacity for v in inside.values())
    assert (made.sequences, sorted(capacity - v for v in inside.values())) == best_fit(lengths, capacity)


def test_packing_slots_do_not_grow_with_the_pieces():
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 50) for n in range(1, 2049)}
    few, many = (packing.Packing({n: c * k for n, c in counts.items()}, 2048) for k in (1, 1_000_000))
    assert len(many.slots) < 4 * len(few.slots) < 40_000
    assert many.sequences * 2048 < 1.02 * sum(n * c for n, c in counts.items()) * 1_000_000


def test_encoder_equals_the_tokenizer(monkeypatch):
    made = packing.Encoder(packing.vocabulary(), cache=500)
    some = texts(9, 200) + ["a  b\n\n c", " lead", "\n", "tail ", "don't 's ' s", "a b c  d", "12 345,6 .. ... !?", "\0 a\0", "é à ö  ñ", "a" * 300]
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in made.encode_many([t or "" for t in some])] == plain_ids(some)


def test_sequences_hold_their_pieces(spark):
    docs = list(enumerate(texts(2, 60)))
    found = packing.sequences(rows_of(spark, docs).select("doc_id", "text"), 128).collect()
    got = Counter(x for r in found for x in r["ids"])
    assert got == Counter(x for ids in plain_ids([t for _, t in docs]) for x in ids) and max(len(r["ids"]) for r in found) <= 128


def plain_importance(docs, target, percent=10, least=20, seed=2024, grams=1, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOW))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1))

    found, want, have = [(i, *features(t)) for i, t in docs], Counter(), Counter()
    for t in target:
        want += features(t)[1]
    for _, _, c in found:
        have += c
    big_s, big_t = have.total(), want.total()
    gain = lambda b: math.floor(1000 * math.log(((want[b] + 1) * (big_s + buckets)) / ((have[b] + 1) * (big_t + buckets))))
    rows = []
    for i, n, c in found:
        weight = sum(k * gain(b) for b, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, drawn[: percent * len(drawn) // 100]


@pytest.mark.parametrize(("grams", "words"), [(1, 1 << 17), (1, 8), (3, 1 << 17)])
def test_importance_against_plain(spark, grams, words):
    docs = [*enumerate(texts()), *[(None, "bast dar " * 20)] * 3, (3, "bast"), (3, "bast")]
    target = [t for _, t in ITEMS]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(rows_of(spark, docs), items, grams=grams, words=words).collect()
    rows, drawn = plain_importance(docs, target, grams=grams)
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(rows)
    ranks = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert ranks == [(n, r[0], r[4]) for n, r in enumerate(drawn, 1)]


def test_importance_without_target_or_words(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(rows_of(spark, []), none).count() == 0
    rows = importance.resample(rows_of(spark, [(1, None), (2, "a b")]), none).collect()
    assert {(r["doc_id"], r["weight"], r["rank"]) for r in rows} == {(1, 0, None), (2, plain_importance([(1, None), (2, "a b")], [])[0][1][3], None)}


def test_crc_of_runs_of_words():
    rng = random.Random(4)
    a, b = ([bytes(rng.randrange(33, 256) for _ in range(rng.choice((1, 2, 7, 300, 5000)))) for _ in range(60)] for _ in range(2))
    pair = lambda xs: (np.array([zlib.crc32(x) for x in xs], np.uint32), np.array([len(x) for x in xs]))
    crc, size = importance.joined(pair(a), pair(b))
    assert crc.tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(a, b)] and size.tolist() == [len(x) + 1 + len(y) for x, y in zip(a, b)]


def test_dictionary_words_are_whole(monkeypatch):
    words = importance.Dictionary()
    for _ in range(3):
        for text in ("he she hers his ushers", "s he\nshe", "a", "", "hers" * 30):
            got = words.payloads(importance.folded(text))[1].tolist()
            assert got == [zlib.crc32(w.encode()) | len(w) << 32 for w in text.split()]
    assert "hers" in words.known and len(max(words.known, key=len)) <= importance.LONG
    monkeypatch.setattr(importance, "_SLICE", 7)
    text = "He shé-hers ushers, a bb ccc dddd eeeeeeeeeeeeeee f " * 3
    found, counts = importance.payloads(words, [text, "", "x", text])
    assert found.tolist() == [zlib.crc32(w.encode()) | len(w.encode()) << 32 for t in (text, "x", text) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))] and counts.tolist()[1:3] == [0, 1]


def test_packing_query_over_a_folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(texts(8, 50))), "doc_id long, text string").withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_packing(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
