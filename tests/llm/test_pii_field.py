"""The field's spans on lines that its table does not hold, and its likelihood's gradient."""

import re

from quillnet.llm import pii

#: Spans stand in braces: {p ...} a phone number, {i ...} a number of a person.
ASIDE = """
call me on {p 0555-123-456} today
phone: {p 5555-0100} or write
ssn {i 12-345-6789} on file
you may call {p (030) 901820} before noon
my mobile is {p 0160 4455 667} now
tel: {p 0221 998877} in Köln
fax {p 040-112233-44} please
reach me at {p 303-555-0188} tonight
dial {p 1-800-555-0142} for that
contact {p 555.0177} or me
ssn: {i 321-54-9876} is hers
passport no. {i 99-887-766} was found
insurance number {i 33 120945 117} here
the id number {i 410-22-9931} is his
social security no. {i 602-18-4417} he said
in 2021 we had 45 guests and 3 dogs
the price is 45,300.75 or 99.95 now
on 2023-11-02 at 17:45 he left
version 10.4.1 replaced 9.8.2 in 2018
page 88 of 1200 and lines 40-60
order 7712345 has 12 parts
population 3,400,000 in 2015
call at 8 on 12/12/2022 or later
number 12 of 40 is open
the phone was sold for 250 in 2020
room 404 and floor 2 at 10:30
build 20231105 has 17 errors
chapter 3 verses 4-9
scores of 21-19 and 30-28
"""


def test_spans_put_aside():
    texts, want = [], []
    for line in ASIDE.strip().split("\n"):
        text, spans = "", []
        for part in re.split(r"(\{[pi] [^}]*\})", line):
            if part.startswith("{"):
                spans.append((len(text), 4 if part[1] == "p" else 5, len(text) + len(part) - 4))
                part = part[3:-1]
            text += part
        texts.append(text)
        want.append(set(spans))
    got = [set(base + added) for base, added in pii.found(texts)]
    right = sum(len(a & b) for a, b in zip(got, want, strict=True))
    missed = [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b]
    assert right >= 0.85 * sum(map(len, got)), missed
    assert right >= 0.8 * sum(map(len, want)), missed


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"call 0{k}5-55{k}-01{k}2 or ssn 1{k}3-45-67{k}9 in 19{k}0" for k in range(10, 60)]
    whole = pii.found(texts)
    monkeypatch.setattr(pii, "KNOWN_WORDS", 12)
    assert [pii.found([t])[0] for t in texts] == whole
