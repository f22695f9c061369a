"""The text operators against plain versions, on small tables with the awkward rows."""

import io
import random
import re
import zlib

import numpy as np
import pytest

from loadscape.llm import cover_tree, jaccard_join, language_id, mixing, pii, sentencepiece_dropout, substring_dedup, topk, url_filter, warc
from loadscape.llm.common import word_count, word_hashes
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(80)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.choice((3, 40, 120, 400)))]
        if i % 3 == 0:
            w[10:10] = passage[rng.randint(0, 20) : rng.randint(60, 80)]
        rows.append((i, " ".join(w)))
    base = rows[5][1].split(" ") * 3
    for i in range(60, 90):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, "\n".join(w)))
    rows += [(100, rows[8][1]), (101, None), (102, ""), (103, " \t\n"), (104, "x"), (105, "x"), (106, "Ab cD"), (107, "aB Cd"), (108, "long " * 20000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_follow_the_pattern():
    for text in ("", " ", "a b", " a\tb\r\nc ", "é\u00a0x y", "a" * 5000):
        assert len(word_hashes(text.encode())) == len(brute.words(text))
    a, b = word_hashes(b"one two one")[[0, 2]]
    assert a == b


def test_substring_dedup(docs, empty):
    got = {tuple(r)[:4] for r in substring_dedup.deduplicate(docs).collect()}
    assert got == set(brute.substring_dedup(corpus()))
    assert substring_dedup.deduplicate(empty).count() == 0


def test_jaccard(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components_of(docs).collect()}
    assert got == brute.jaccard(corpus())
    assert jaccard_join.components_of(empty).count() == 0


def test_jaccard_in_blocks(spark, docs, monkeypatch):
    for name, value in (("BLOCK", 4), ("MATCH_PARTS", 50), ("LONG_SET", 16), ("PAIRS", 2), ("_FLUSH", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components_of(docs).collect()}
    assert got == brute.jaccard(corpus())


def test_jaccard_tells_sets_of_one_name_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "set_class", lambda hashes: len(hashes) % 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components_of(docs).collect()}
    assert got == brute.jaccard(corpus())


def test_jaccard_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (6, a), (6, b), (7, b), (8, b + " x"), (9, "other"), (9, "other"), (None, a), (3, "z " + b), (10, "x y"), (11, "X Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.components_of(df).collect()), key=str)
    assert got == sorted([(5, 26, 3), (6, 26, 3), (6, 26, 3), (7, 26, 3), (8, 27, 3), (9, 1, 9), (9, 1, 9), (None, 26, None), (3, 27, 3), (10, 1, 10), (11, 1, 10)], key=str)


def test_cover_tree(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 1.0)]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, block=64).collect()}
    assert got == brute.cosine(rows)
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", (1.0, 1e6, 1e8))
def test_topk(spark, size):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.normal(size=8) * size]
    rows = [(i, vector()) for i in range(200)] + [(300, None), (301, [None] * 8), (302, [float("inf")] * 8), (None, vector())]
    rows += [(20, vector()), (20, rows[20][1]), (7, vector()), (7, rows[3][1]), (8, rows[3][1]), (1000, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = sorted(brute.topk(rows))
    assert sorted(map(tuple, topk.search(df).collect())) == want
    rows = topk.quantised(df)
    assert sorted(map(tuple, topk.topk(rows.filter("vec_id % 20 = 0"), rows, block=64, query_block=4).collect())) == want


def test_topk_stops_reading():
    rng = np.random.default_rng(4)
    v = np.zeros((4000, 8), np.int64)
    v[np.arange(4000), rng.integers(8, size=4000)] = rng.integers(1, 1000, size=4000)
    rows, q = np.arange(4000), np.arange(0, 4000, 40)
    at, c, s, read = topk.block_topk(q, v[q], rows, rows, v, 5)
    assert (read < 1).mean() > 0.9
    for i in range(len(q)):
        want = sorted((-int(x), j) for j, x in enumerate(v @ v[q[i]]) if j != q[i])[:5]
        assert [(-int(x), int(j)) for x, j in zip(s[at == i], c[at == i])] == want


def test_pii_spans_map_back():
    text = "Mail ana [at] web [dot] org, or bob@x.example.com; ip 10.0.0.999 and 10.0.0.9; ＋4９ 30 1234567; plus four nine three zero one two three four five"
    base, spans = pii.find(text)
    assert [text[a:b] for a, b in base["email"]] == ["bob@x.example.com"] and [text[a:b] for a, b in base["ip"]] == ["10.0.0.9"]
    assert [text[a:b] for a, b in spans["email"]] == ["ana [at] web [dot] org", "bob@x.example.com"]
    assert [text[a:b] for a, b in spans["phone"]] == ["＋4９ 30 1234567", "plus four nine three zero one two three four five"]
    assert pii.find(None) == pii.find("") and not any(pii.find("he is at the river, one of many")[1].values())
    assert pii.redacted("bob@x.com") == "[EMAIL]" and pii.redacted(None) is None
    for bad in ("a" * 50_000, "1" * 50_000, "@" * 50_000, "+1" + " " * 50_000, "1." * 20_000):
        pii.find(bad)


def test_language_id(spark, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 5, "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    rows += [(900, None, "en", None, None), (901, "", "en", None, None), (902, "12 34", None, None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows[:200]) and {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert 40 < sum(r["held_out"] for r in got.values()) < 60
    assert language_id.identify(empty).count() == 0


def test_language_id_against_a_plain_model(spark):
    rng = random.Random(6)
    letters = {"en": "etaoinshr E", "fr": "esaitnru éà", "de": "enisratdh üß"}
    make = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    rows = [(i, make(lang, rng.randint(1, 80)), lang, "s", 0) for i in range(150) for lang in [rng.choice(list(letters))]]
    rows += [(200, "ÀB\n\tc \u0130 \U0001f600 xyz", None, "s", 0), (201, "\U0001f600 12", None, None, None), (202, "a", None, None, None), (203, None, "en", None, None), (7, make("en", 9), None, "s", 0), (None, make("de", 30), "de", "s", 0), (204, "ab é" * 300_000, None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2

    def bucket(gram):
        return int(next(language_id.trigrams(gram))[1])

    plain = brute.language_model([(t, lang) for i, t, lang, *_ in rows if t is not None and lang and not held(i)], bucket, language_id.BUCKETS)
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language_id.identify(df).collect()), key=str)
    want = [(i, held(i), *(lambda x: (x[0], round(x[1], 6)))(plain(t))) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    known = [r for r in want if r[0] is not None and r[0] < 150 and r[1]]
    right = {i: lang for i, _, lang, *_ in rows}
    assert sum(right[r[0]] == r[2] for r in known) >= 0.8 * len(known) > 20


def test_mixing(docs, empty):
    rows = mixing.mix(docs, word_count("text")).collect()
    assert len(rows) == len(corpus()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in rows)  # a very long document may not fit
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7), word_count("text")).collect()))
    assert mixing.mixed_documents(docs, word_count("text")).count() == sum(r["n_taken"] for r in rows)
    assert mixing.mix(empty, word_count("text")).count() == 0


def test_warc_ranges():
    bodies = [b"abc" * (i * 7 % 5000) for i in range(100)]
    blob = b"".join(warc.encode_record(i, f"http://x/{i}", b, warc.sha1_hex(b), None) for i, b in enumerate(bodies))
    for size in (1 << 30, 1000, 77):
        got = [warc.decode_record(r) for s in range(0, len(blob), size) for _, r in warc.members(io.BytesIO(blob), s, min(s + size, len(blob)), len(blob))]
        assert [(g[0], g[6]) for g in got] == list(enumerate(bodies))


def test_warc_roundtrip(spark):
    rows = [(1, "http://a", "x" * 2000), (2, None, "x" * 2000), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (None, "u", "x" * 2000)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 0), 4: ("response", None, 5), 5: ("response", None, 5), None: ("revisit", 2, 2000)}


def test_urls(spark):
    urls = [None, "none", "http://Foo.COM/x?q", "https://example.com/en/1", "https://www.example.com/en/1", "http://a.net/es/", "http://a.org", "x://a.net?z/fr/"]
    rows = [(i, u, "<p>foo bar foobar</p>") for i, u in enumerate(urls)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i][:3] for i in range(8)] == [("", "", None), ("", "", None), ("foo.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.net", "/es/", "net/es/"), ("a.org", "", None), ("a.net", "", None)]
    assert [got[i][3] for i in (2, 3, 4, 5)] == ["allow", "block", "allow", "block"]
    assert url_filter.split("barfoo", {"foo": 5, "bar": 5}, 11) == ["bar", "foo"]


def test_urls_against_a_plain_model(spark, tmp_path):
    rng = random.Random(8)
    words = ["cat", "dog", "catalog", "log", "blue", "sky", "news", "farm", "ing", "a", "run", "w" * 70]
    html = lambda: "<P>" + " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + "</p>"
    name = lambda: "".join(rng.choice(words[:-1]) for _ in range(rng.randint(1, 4)))
    urls = [f"http://{name()}.{rng.choice(('com', 'net', 'org', 'example.com'))}/{rng.choice(('es', 'fr', 'en', 'x'))}/{name()}{rng.randint(0, 3000)}-{name().upper()}?q" for _ in range(150)]
    urls += [None, "", "nothing", urls[0], urls[0], "http://" + "zq" * 3000 + ".org/" + "catdog" * 500, "http://A" + "\u212a" + "b.org/É1"]
    pages = [(u, None if i % 20 == 3 else html()) for i, u in enumerate(urls)]
    rows = [(None if i % 50 == 7 else i // 2, u, h, "x") for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, words string").repartition(3)
    got = url_filter.judge(df).collect()

    def host_path(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        return brute.ascii_lower(m[1]), m[2]

    def verdict_of(host, path):
        fits = [(len(n + p), len(n), v) for v, n, p in url_filter.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    model = brute.url_model(pages, host_path, verdict_of)
    want = [(i, *host_path(u), verdict_of(*host_path(u)) or ("block" if score > 1e-9 else "allow"), said, round(score, 6)) for (i, u, *_), (said, score) in zip(rows, model)]
    assert sorted(((r["page_id"], r["host"], r["path"], r["verdict"], r["words"], round(r["score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_sentencepiece():
    import sentencepiece

    texts = ["", "a  b   c ", "日本語 ok\n\n\tx", "  lead", "trail  ", "a" * 3000, " " * 50, "Hello hello world", None]
    plain, model = sentencepiece_dropout.Codec(dropout=0), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    for t in texts[:-1]:
        assert plain.encode(t).tolist() == model.encode(t)
    a, b = sentencepiece_dropout.Codec(dropout=0.3), sentencepiece_dropout.Codec(dropout=0.3, seed=9)
    many = a.encode_many([*texts, "\u2581 \ue000 \u2581x", "x \u2581"], list(range(11)))
    for i, t in enumerate([*texts, "\u2581 \ue000 \u2581x", "x \u2581"]):
        assert a.decode(many[i]) == (t or "") and a.encode(t, i).tolist() == many[i].tolist()
    assert a.encode("Hello hello world", 1).tolist() != b.encode("Hello hello world", 1).tolist()


def test_substring_dedup_rows_that_share_an_id(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(1000)}" for _ in range(300)]
    text = lambda a, b: " ".join(words[a:b])
    tail = " ".join(f"x{i}" for i in range(60))
    rows = [(1, text(0, 120)), (2, text(40, 180)), (2, text(40, 180)), (2, text(40, 180) + " " + tail), (2, text(40, 180).replace(" ", "\n")), (3, tail), (3, tail + " y"), (None, text(0, 100)), (None, text(0, 100)), (4, None), (4, ""), (5, text(60, 110)), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substring_dedup.deduplicate(df).collect()), key=str)
    assert got == sorted(brute.substring_dedup(rows), key=str)
    kept = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], brute.sha(r["text"])) for r in substring_dedup.cleaned(df).collect())
    assert kept == sorted((i or -1, *rest) for i, *rest in brute.substring_dedup(rows))


def test_substring_dedup_in_many_shards(spark, docs, monkeypatch):
    for name, value in (("PHRASES_PER_SHARD", 3), ("STREAM_WORDS", 500), ("MATCH_WORDS", 200), ("_FLUSH", 64)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = {tuple(r)[:4] for r in substring_dedup.deduplicate(docs).collect()}
    assert got == set(brute.substring_dedup(corpus()))


def test_warc_payloads_are_hashed_on_reading(spark, tmp_path):
    bodies = [b"x" * 1500, b"y" * 900]
    for name, digests in (("good", [warc.sha1_hex(b) for b in bodies]), ("bad", [warc.sha1_hex(b"z"), warc.sha1_hex(bodies[1])])):
        blob = b"".join(warc.encode_record(i, "u", b, d, None) for i, (b, d) in enumerate(zip(bodies, digests)))
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(blob)
        files = spark.createDataFrame([(str(tmp_path / name / "a.warc.gz"), len(blob), 2)], warc.FILES)
        found = warc.read(spark, files, str(tmp_path / name))
        if name == "good":
            assert [(r["page_id"], bytes(r["payload"])) for r in found.orderBy("page_id").collect()] == list(enumerate(bodies))
        else:
            with pytest.raises(Exception, match="not what its header says"):
                found.collect()
