"""Identifiers of which the plain text shows only a fragment, and disguises within them."""

import pytest

from loadscape.llm import pii


@pytest.mark.parametrize("whole", ["jоhn.doe@example.com", "john.doe@mail.exаmple.com", "john@example.cоm", "bob@host.co [dot] uk"])
def test_a_fragment_does_not_hide_the_whole(whole):
    text = f"Write to {whole} now"
    base, spans = pii.find(text)
    assert len(base["email"]) == 1 and set(base["email"]) < set(spans["email"])
    assert (9, 9 + len(whole)) in spans["email"]
    assert pii.redacted(text) == "Write to [EMAIL] now"


@pytest.mark.parametrize(
    "kind, whole",
    [
        ("email", "john dot doe at example dot com"),
        ("email", "john dot m dot doe [at] mail dot example dot com"),
        ("email", "john dot doe@example dot com"),
        ("email", "bob at host dot co [dot] uk"),
        ("ip", "10 dot 0 dot 0 dot 9"),
        ("ip", "10 dot 0 dot zero dot nine"),
        ("phone", "plus 4 nine 3 zero one 2 three 45"),
        ("phone", "+49 30 12345 six seven"),
        ("phone", "plus four nine three zero one two three four five"),
    ],
)
def test_disguises_inside(kind, whole):
    text = f"See {whole}, or not"
    assert (4, 4 + len(whole)) in pii.find(text)[1][kind]
    assert pii.redacted(text) == f"See {pii.PLACEHOLDER[kind]}, or not"


def test_plain_text_stays():
    for text in ("Appelez +33 1 23 45 67 89, un ami", "he is at the river, one of many", "see bob@x.com dot", "2 point 5 and 3 dot 5", "the dot is at home"):
        base, spans = pii.find(text)
        assert base == spans
    for bad in ("1 " * 30_000, "one 1 " * 20_000, "a dot " * 20_000 + "@", "a dot b at c dot de " * 5_000, "@a" * 30_000, "a@b.cо " * 10_000):
        pii.find(bad)
        pii.redacted(bad)
