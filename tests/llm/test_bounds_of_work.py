"""What long inputs, many languages and broken archives may cost, and that blocks change no result."""

import io
import random
import resource
import time
import zlib

import numpy as np
import pytest

from loadscape.llm import language_id, sentencepiece_dropout, url_filter, warc


def model(n, rng, blocks=1):
    made = []
    for i in range(n):
        some = rng.choice(language_id.BUCKETS, 3000, replace=False)
        made.append((f"l{i:03}", some, rng.integers(1, 50, 3000)))
    out = []
    for part in np.array_split(np.arange(n), blocks):
        own = [made[i] for i in part]
        bucket, lang, times = np.concatenate([m[1] for m in own]), np.repeat(np.arange(len(own)), 3000), np.concatenate([m[2] for m in own])
        out.append(language_id.Block([m[0] for m in own], np.log(np.full(len(own), 1 / n)), np.array([m[2].sum() for m in own], float), bucket, lang, times))
    return language_id.Model(out, max(len(b.langs) for b in out))


TEXTS = ["Der Hund läuft über die Straße", "a", "", None, "12", "el perro corre por la calle " * 30, "x" * 500]


def test_blocks_of_languages_change_nothing(monkeypatch):
    one, many = (model(37, np.random.default_rng(1), b) for b in (1, 6))
    a, b = one.predict_many(TEXTS), many.predict_many(TEXTS)
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
    monkeypatch.setattr(language_id, "_CHUNK", 50)
    monkeypatch.setattr(language_id, "CELLS", 64)
    c = one.predict_many(TEXTS)
    assert [x[0] for x in a] == [x[0] for x in c] and np.allclose([x[1] for x in a], [x[1] for x in c])


def test_many_languages_take_little_memory():
    made, rng = model(300, np.random.default_rng(2)), random.Random(3)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(1000)) * 999 for _ in range(2)] + ["".join(rng.choice("abcdefghij klmnop") for _ in range(80)) for _ in range(3000)]
    assert len(made.predict_many(texts)) == 3002
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 900


def test_languages_are_not_limited(spark):
    rows = [(4 * i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}q " * 20, f"lang{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = language_id.fit(df)
    b = language_id.fit(df, entries=500)
    assert len(a.blocks) == 1 and len(b.blocks) > 5 and sum(len(x.langs) for x in b.blocks) == a.width
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, b).collect()}
    learnt = {x for m in a.blocks for x in m.langs}
    assert a.width > 200 and all(got[i] == lang for i, _, lang in rows if lang in learnt)
    assert got == {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, a).collect()}


def test_a_long_url_is_split_in_linear_time(spark):
    rng = random.Random(5)
    words = ["news", "sport", "page", "on", "in", "weather", "x"]
    path = "".join(rng.choice(words) for _ in range(45_000))
    pages = spark.createDataFrame([(1, f"http://{'newssport' * 5}.org/{path}", " ".join(words) * 50), (2, "http://a.com/newspage", "news page"), (3, "http://b.net/fr/", "")], "page_id long, url string, html string")
    start = time.time()
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(path) > 150_000 and time.time() - start < 120
    assert got[1]["words"].split()[:2] == ["news", "sport"] and got[3]["verdict"] == "block"


@pytest.mark.parametrize("mb", [8, 48])
def test_a_long_member_is_read_once(mb):
    body = np.random.default_rng(1).bytes(mb << 20)
    blob = warc.encode_record(1, "http://a", b"x" * 10, "00" * 20, None) + warc.encode_record(2, "http://b", body, "00" * 20, None) + warc.encode_record(3, None, b"", "00" * 20, None)

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.read_bytes += len(got)
            return got

    Counted.read_bytes, start = 0, time.time()
    found = [warc.decode_record(raw)[0] for _, raw in warc.members(Counted(blob), 0, len(blob), len(blob))]
    assert found == [1, 2, 3] and Counted.read_bytes < 1.2 * len(blob) + (1 << 20) and time.time() - start < mb


def test_members_among_rubbish():
    parts = [warc.encode_record(i, f"http://{i}", bytes([i % 256]) * (i * 37 % 5000), "00" * 20, None) for i in range(40)]
    fake = zlib.compressobj(6, zlib.DEFLATED, 31)
    noise = [warc.MAGIC * 3, fake.compress(b"no archive at all") + fake.flush(), parts[3][: len(parts[3]) // 2], b"\x1f\x8b"]
    blob = b"".join(p + noise[i % 4] * (i % 3 == 0) for i, p in enumerate(parts))
    for size in (len(blob), 900, 101):
        got = [warc.decode_record(r)[0] for s in range(0, len(blob), size) for _, r in warc.members(io.BytesIO(blob), s, min(s + size, len(blob)), len(blob))]
        assert sorted(got) == list(range(40))


def test_adjacent_copies_draw_apart(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 5
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text), (1, text)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], tuple(r["ids"])) for r in sentencepiece_dropout.encode(df, adjacent=True).collect()]
    want = sentencepiece_dropout.Codec().encode_many([text] * 6, [1, 1, 2, None, None, 1], [0, 1, 0, 0, 0, 0])
    assert [x[1] for x in got] == [tuple(w.tolist()) for w in want] and got[0][1] != got[1][1]
