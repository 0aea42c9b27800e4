from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promolift.llm import pii
from tests.llm.helpers import documents, rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            if kind == "ip" and any(int(part) > 255 for part in match.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((match.start(), kind, match.end()))
    return sorted(out, key=lambda span: (span[0], list(PATTERNS).index(span[1])))


PIECES = st.sampled_from(
    ["a.b@c.d", "@", "x@y", ".", "1", "255", "256", "4111 1111 1111 1111", "+1 (743) 555-3824", " ", "-", "é", "１", "a"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_plain_spans_are_those_of_the_patterns(text):
    assert [(s, k, e) for s, k, e, is_plain in pii.find(text) if is_plain] == plain(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail joe.b (at) mail [dot] example {dot} com now", "email", "joe.b (at) mail [dot] example {dot} com"),
        ("write to joe at example dot com please", "email", "joe at example dot com"),
        ("joe@example dot com", "email", "joe@example dot com"),
        ("hein.19 at mail5.example.com", "email", "hein.19 at mail5.example.com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊｏｅ＠ｍａｉｌ．ｏｒｇ", "email", "ｊｏｅ＠ｍａｉｌ．ｏｒｇ"),
        ("jo\u200be@exa\u00admple.com", "email", "jo\u200be@exa\u00admple.com"),
        ("card four one one one one one one one one one one one one one one one.", "card", None),
        ("call plus one five five five one two three four five six seven", "phone", None),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("host 10 [dot] 0 [dot] 0 [dot] 1", "ip", "10 [dot] 0 [dot] 0 [dot] 1"),
        ("at one nine two dot one six eight dot one dot one now", "ip", "one nine two dot one six eight dot one dot one"),
        ("zehn: eins null Punkt null Punkt null Punkt eins", "ip", "eins null Punkt null Punkt null Punkt eins"),
        ("\u03f3oe@ex\u0430mple.com", "email", "\u03f3oe@ex\u0430mple.com"),
        ("\u1d0aoe@x\uff0eorg", "email", "\u1d0aoe@x\uff0eorg"),
        ("\u0405am@\u0408oe.org and jo\u0131n@\u0261mail.com", "email", "\u0405am@\u0408oe.org"),
        ("10.0.0.\u00b9", "ip", "10.0.0.\u00b9"),
        ("john at gmail.com", "email", "john at gmail.com"),
        ("my address is jane at acme.org", "email", "jane at acme.org"),
    ],
)
def test_disguised_identifiers_are_mapped_back(text, kind, found):
    spans = [(start, end) for start, name, end, is_plain in pii.find(text) if name == kind and not is_plain]
    assert spans, text
    if found:
        assert text[spans[0][0] : spans[0][1]] == found


@pytest.mark.parametrize(
    "text", ["Rereat at thon tion onreti. In and", "the dot dota at the end.\nThen", "look at this (at home)", "one two three"]
)
def test_ordinary_text_has_no_spans(text):
    assert pii.find(text) == []


@pytest.mark.parametrize(
    "said", ["john at gmail.com", "joe.b AT gmail.com", "joe.b  at\tgmail.com", "Ann At mail.example.co.uk", "x at\n mail [dot] org"]
)
def test_at_before_a_domain_needs_no_marked_name(said):
    text = f"write ({said}), please"
    assert [(text[start:end], plain) for start, kind, end, plain in pii.find(text) if kind == "email"] == [(said, False)]


@pytest.mark.parametrize("text", ["home at 10.0.0", "we met at noon. Then", "at gmail.com", "look at version 1.2", "what gmail.com is", "see prices at shop.example.de", "look at node.js", "we met at example.com yesterday", "meet @ 5.30", "write to us at example.com", "point one dot two"])
def test_at_without_a_name_or_domain_is_no_address(text):
    assert pii.find(text) == []


def test_at_runs_take_linear_time():
    for unit in ("x at ", "x at a.", "a.", " \t", "x at a.b1 "):
        pii.find("x at " + unit * 100_000)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "+1", "a@", "one "):
        pii.find(unit * 100_000)


def test_texts_in_other_scripts_cost_about_what_ascii_does():
    def seconds(text):
        times = []
        for _ in range(3):
            start = time.process_time()
            pii.normalised(text)
            times.append(time.process_time() - start)
        return min(times)

    pii.normalised("é")
    assert seconds("déjà vu über größere Wörter " * 20_000) < 4 * seconds("deja vu uber grossere Worter " * 20_000) + 0.05


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["а", "ｂ", "é", "漢", "\u200b", "𝐚", "\U0010fffd", "a", " at ", "(at)", "one ", "."]), max_size=20).map("".join))
def test_normalised_characters_know_their_source(text):
    marks = [(pii._ascii_of(mark) if ord(mark) > 0xA0 else mark) for mark in text]
    found = pii._rewritten(pii._plain(text), pii._odd_edits(text))
    assert found.text == "".join(marks)
    kept = [place for place, mark in enumerate(marks) if mark]
    assert found.start.tolist() == kept and found.end.tolist() == [place + 1 for place in kept]
    edits = [(match.start(), match.end(), "xyz"[: len(match.group()) % 4]) for match in re.finditer(r"\(at\)|one |é+", text)]
    spans, done = [], 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        spans += [(place, place + 1) for place in range(done, start)] + [(start, end)] * len(new)
        done = end
    found = pii._rewritten(pii._plain(text), edits)
    assert list(zip(found.start.tolist(), found.end.tolist())) == spans


def test_table(spark):
    frame = documents(spark, [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "+1 222 333 4444")])
    found = pii.personal_data(frame)
    assert found.columns == ["id", "spans"]
    assert sorted((row.id is None, row.id or 0, len(row.spans)) for row in found.collect()) == [
        (False, 1, 0), (False, 2, 0), (False, 3, 1), (False, 3, 1), (True, 0, 1),
    ]
    assert rows(pii.personal_data(frame.limit(0)), "id") == []
