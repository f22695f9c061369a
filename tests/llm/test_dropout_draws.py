"""Merge-dropout draws for every occurrence of a chunk."""

import numpy as np
import xxhash

from loadscape.llm import sentencepiece_dropout as sp


def test_each_occurrence_draws_at_the_rate():
    codec = sp.Codec()
    pair = len(sp.Codec(dropout=0).encode("a"))
    assert pair == 1  # one candidate merge: a blank and the letter
    ids = codec.encode(" ".join("a" * 20_000), 7)
    split = len(ids) - 20_000
    assert 1800 < split < 2200
    some = codec.encode_many(["together " * 3000], [8])[0]
    forms = {tuple(x.tolist()) for x in np.split(some, np.flatnonzero(np.char.startswith([codec.out[i].decode() for i in some], " ")))}
    assert len(forms) > 8


def test_draws_are_those_of_the_plain_agenda():
    codec = sp.Codec(dropout=0.3, cache=50)
    texts = ["Hello hello world, together again " * 20, "日本語 ok\n\n\tx" * 5, "a" * 300, "x é ü " * 40] * 2
    got = codec.encode_many(texts, list(range(8)))
    for i, (text, ids) in enumerate(zip(texts, got)):
        start, want = xxhash.xxh3_64_intdigest(f"{codec.seed}:{i}"), []
        for place, chunk in enumerate(sp._CHUNK.findall("▁" + text.replace(" ", "▁"))):
            want += codec.merge(chunk, sp._mix(start + place * 0x9E3779B97F4A7C15 & sp._M))
        assert ids.tolist() == want and codec.decode(ids) == text
        assert codec.encode(text, i).tolist() == want  # also after it has forgotten what it met


def test_copies_draw_for_themselves(spark):
    text = "the same document is taken twice by the mix " * 20
    rows = [(1, text, 0), (1, text, 1), (1, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nth int")
    first, second, third = (sp.encode(df.filter(which), copy_col="nth").first()["ids"] for which in ("nth = 0", "nth = 1", "nth is null"))
    assert first == third != second
    assert first == sp.encode(df.filter("nth = 0")).first()["ids"] == sp.Codec().encode(text, 1).tolist()
