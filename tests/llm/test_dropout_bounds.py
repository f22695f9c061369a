"""What merge-dropout holds and does at once."""

import numpy as np
import pyarrow as pa

from loadscape.llm import sentencepiece_dropout as sp


def test_only_unknown_characters_are_written_as_bytes(monkeypatch):
    codec, calls = sp.Codec(), []
    plain = codec._as_ids
    monkeypatch.setattr(codec, "_as_ids", lambda parts: calls.append(1) or plain(parts))
    words = [f"w{i:x}ab" for i in range(3000)]
    text = " ".join(words) + " two\nlines 語͸\n\n end\x01"
    ids = codec.encode(text, 1)
    assert codec.decode(ids) == text
    assert len(calls) < 200  # by character, not by chunk
    zero = sp.Codec(dropout=0)
    assert zero.encode(text).tolist() == [i for c in sp._CHUNK.findall("▁" + text.replace(" ", "▁")) for i in zero.merge(c, 0)]


def test_slices_hold_bounded_text():
    texts = ["a" * 10, None, "", "é" * 40, "b" * 200, "c" * 5, None, "d" * 90, "e" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"]).slice(1)
    parts = list(sp.slices(batch, 100))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts[1:]
    sizes = [[len((t or "").encode()) for t in p["text"].to_pylist()] for p in parts]
    assert all(sum(x) <= 100 or len([n for n in x if n]) == 1 for x in sizes) and max(map(sum, sizes)) == 200
    assert list(sp.slices(batch.slice(0, 0), 100)) == []


def test_long_texts_of_a_batch_are_not_held_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 60_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    def run(codec, part):
        return pa.RecordBatch.from_arrays([pa.array([part["text"].nbytes], pa.int64())], names=["held"])

    held = [r["held"] for r in sp._map(docs, "held long", run).collect()]
    assert len(held) == 4 and np.max(held) < 1 << 20
