"""The registered queries on tables with awkward rows, against their SQL or plain versions; and the pipeline against a plain one."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from loadscape.llm import language_id, mixing, pii, queries, sentencepiece_dropout
from tests.llm import brute
from tests.llm.test_operators import corpus

# names that the operators use inside, or return
CLASH = "size long, class string, kept string, source_size long, component_id long, id long, words string, target string, taken long, order string, n_words long, copy int, rep long, shard int, rank int, score double, found string, _n long, _text string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
PAGES = f"page_id long, url string, html string, {CLASH}"
VECTORS = f"vec_id long, embedding array<float>, label int, {CLASH}"
NONE = (None,) * len(CLASH.split(","))
ITEMS = f"item_id long, text string, {CLASH}"
TEXT = [q for q in queries.queries() if q not in ("op6_cover_tree", "op7_warc", "op8_topk", "op9_url_filter", "op11_lexical_search")]


def tables():
    rng = random.Random(11)
    docs = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 9 else None, None) for i, t in corpus()]
    docs += [(110, "Write to ana [at] web [dot] org or bob@x.example.com now", None, None, 7), (111, "12 34 56", "en", "s1", 8)]
    pages = [(i, u, h) for i, (u, h) in enumerate([(None, None), ("", ""), ("http://a.com/x", "<p>one</p>" * 300), ("http://B.com", "<p>one</p>" * 300), ("http://www.example.com/en/x?q#f", "é" * 600), ("http://example.com/en/", "é" * 600), ("ftp://c.net/fr/", "x")])]
    vectors = [(i, [rng.choice((-1.0, 0.5, 0.25, 1.0)) for _ in range(6)], None) for i in range(60)]
    vectors += [(60, vectors[0][1], None), (80, None, 1), (100, [None] * 6, 1), (120, [float("nan")] * 6, 1), (140, [float("inf")] * 6, 1), (160, [0.0] * 6, 1)]
    items = [(0, docs[3][1]), (1, None), (2, ""), (3, "Write to BOB, and zzzz"), (3, "12 56"), (None, "the a")]
    return {"documents": (docs, DOCS), "pages": (pages, PAGES), "embeddings": (vectors, VECTORS), "benchmark": (items, ITEMS)}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name, (rows, schema) in tables().items():
        spark.createDataFrame([(*r, *NONE) for r in rows], schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def values(cols, rows):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql_on_awkward_rows(spark, folders, name):
    con = duckdb.connect()
    for table in tables():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folders[0]}/{table}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    df = queries.queries()[name](spark, folders[0])
    assert sorted(cols) == sorted(df.columns)
    assert values(cols, df.collect()) == values(cols, [dict(zip(cols, r)) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, folders, name):
    assert queries.queries()[name](spark, folders[1]).count() == 0


def test_pii_query(spark, folders):
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, folders[0]).collect()}
    texts = {r[0]: r[1] for r in tables()["documents"][0]}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base, spans = pii.find(text)
        assert tuple(got[i][f"n_{k}"] for k in pii.KINDS) == tuple(len(base[k]) for k in pii.KINDS)
        assert got[i]["spans"] == pii.joined(spans) and got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert got[110]["n_email"] == 1 and got[110]["n_added"] == 1


def test_language_query(spark, folders):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, folders[0]).collect()}
    for i, text, *_ in tables()["documents"][0]:
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= got[i]["score"] <= 1


def test_url_query(spark, folders):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in queries.op9_url_filter(spark, folders[0]).collect()}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("a.com", "/x", "com/"), 3: ("b.com", "", None), 4: ("www.example.com", "/en/x", "www.example.com/en/"), 5: ("example.com", "/en/", "example.com/en/"), 6: ("c.net", "/fr/", "net/fr/")}


def test_tokens_query(spark, folders):
    rows = queries.op10_sentencepiece(spark, folders[0]).collect()
    texts = {r[0]: r[1] or "" for r in tables()["documents"][0]}
    assert all(r["lossless"] and r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows) and len(rows) == len(texts)


def test_null_ids_and_repeated_rows(spark, folders, tmp_path):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None), (2, None), (1, "A b c d e f")]
    spark.createDataFrame([(i, t, None, None, None, *NONE) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b c", *NONE)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in TEXT:
        found = queries.queries()[name](spark, str(tmp_path)).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows), name
        if name == "op4_jaccard":
            assert {(r["doc_id"], r["component_id"]) for r in found} == {(None, None), (3, 1), (2, 2), (1, 1)}


def plain_mix(rows):
    """How often the mix takes each of (doc_id, source, size)."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()) * mixing.SHARE, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > mixing.REPEATS * sizes[s]}
        for s in full or free:
            target[s] = mixing.REPEATS * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free -= full or free
    queue, upto = [], defaultdict(int)
    key = lambda r: (hashlib.md5(f"{r[0]}/{mixing.SEED}".encode()).hexdigest(), r[2])
    for doc_id, source, size in sorted(rows, key=key):
        upto[source] += size
        for k in range(mixing.REPEATS):
            time = (upto[source] + k * sizes[source]) / target[source] if target[source] else 0.0
            queue.append((time, source is None, source or "", key((doc_id, source, size)), k, doc_id, size))
    taken, total, budget = Counter(), 0, sum(target.values())
    for *_, doc_id, size in sorted(queue):
        total += size
        if total <= budget:
            taken[doc_id] += 1
    return taken


def test_pipeline_against_a_plain_one(spark, folders):
    docs = [(i, t, s) for i, t, _, s, _ in tables()["documents"][0]]
    model = language_id.fit(spark.read.parquet(f"{folders[0]}/documents.parquet"))
    docs = [(i, t, s) for i, t, s in docs if (lambda lang, score: lang != "und" and score >= 0.5)(*model.predict(t))]
    labels = brute.jaccard([(i, t) for i, t, _ in docs])
    docs = [(i, pii.redacted(t), s) for i, t, s in docs if labels[i][1] == i]
    assert (110, "Write to [EMAIL] or [EMAIL] now", None) in docs
    taken = plain_mix([(i, s, len(brute.words(t))) for i, t, s in docs])
    codec = sentencepiece_dropout.Codec()
    want = Counter((i, tuple(codec.encode_many([t], [i], [copy])[0].tolist())) for i, t, _ in docs for copy in range(taken[i]))
    assert max(taken.values()) == 2
    found = corpus_pipeline.run(spark, folders[0]).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == want and all(r["n_ids"] == len(r["ids"]) for r in found)


def test_pipeline_keeps_columns_and_takes_no_rows(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet").limit(20)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "personal data", "mixing", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folders[0]).schema.simpleString() == docs.schema.simpleString()
