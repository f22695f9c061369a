"""What a Python worker holds between the tasks of the pipeline."""

import psutil
import pyarrow as pa

from loadscape.llm import sentencepiece_dropout as sd
from loadscape.llm.common import giving_back


def test_encode_keeps_no_chunks_after_a_task(spark):
    docs = spark.createDataFrame([(i, f"word{i} of text {i * i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    held = []
    real = sd._map
    try:
        sd._map = lambda docs, schema, row, **more: held.append(more) or real(docs, schema, row, **more)
        assert sd.encode(docs).count() == 200
    finally:
        sd._map = real
    assert held[0]["forget"]
    codec = sd.Codec()
    first = [x.tolist() for x in codec.encode_many(["one two", "three"], [1, 2])]
    codec.forget()
    assert not codec.known and not codec.nodes and [x.tolist() for x in codec.encode_many(["one two", "three"], [1, 2])] == first


def test_memory_freed_by_a_task_is_given_back():
    def run(batches):
        for batch in batches:
            small = [bytes(5000) for _ in range(40_000)]  # 200 MB of small blocks
            yield batch
            keep.append(small.pop())  # the last block, which holds the heap's end
            del small

    keep = []
    before = psutil.Process().memory_info().rss
    assert sum(b.num_rows for b in giving_back(run)(iter([pa.record_batch({"a": [1]})]))) == 1
    assert keep and psutil.Process().memory_info().rss - before < 60e6
