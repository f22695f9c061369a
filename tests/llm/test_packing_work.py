"""What the packing's encoder does for a text and a new chunk."""

import random
import re

from loadscape.llm import packing

_PLAIN = re.compile(r"(?:^|[^!-~À-ɏ])[ \n]|(?:^|[^A-Za-zÀ-ÖØ-öø-ɏ])[.,]|\x00")


def test_irregular_texts_are_those_of_the_plain_rule():
    draw = random.Random(3)
    alphabet = "aZ0 .,\n\tÀ×÷ɏɐ語😀!~\x00\x7f\xa0"
    texts = ["", " ", ".", "a", "a b", "a. b", "😀 a", "a😀. b", "\x00", "a\x00b", "ab", " a"]
    texts += ["".join(draw.choices("ab" * 6 + alphabet, k=draw.randrange(12))) for _ in range(4000)]
    assert packing.irregular(texts) == [bool(_PLAIN.search(t)) for t in texts]
    assert packing.irregular([]) == []


def test_a_new_chunk_is_looked_at_once(monkeypatch):
    looked = []

    class Word:
        def fullmatch(self, chunk):
            looked.append(chunk)
            return plain.fullmatch(chunk)

    plain = packing._WORD
    monkeypatch.setattr(packing, "_WORD", Word())
    encoder = packing.Encoder(packing.vocabulary())
    texts = ["one two, three.\nOne 2 three <|endoftext|> four", "日本 語. x  y", "", "é÷ à\x00b ."] * 2
    got = encoder.encode_many(texts)
    assert looked and len(looked) == len(set(looked))
    for text, ids in zip(texts, got):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
