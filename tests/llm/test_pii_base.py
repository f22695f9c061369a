"""Plain spans of personal data against the patterns as they are stated."""

import random
import re

from loadscape.llm import pii


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if good(m[0])] for k, (p, good) in keep.items()}


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(12)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "4", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "+49 (30) 123-4567", "x@y.z", "é", "\n", "%", "0", "５", "0" * 17]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        base, spans = pii.find(text)
        want = plain(text)
        assert {k: list(map(tuple, base[k])) for k in want} == want, text
        assert all(set(map(tuple, base[k])) <= set(map(tuple, spans[k])) for k in want)
