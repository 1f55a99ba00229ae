import random
import re
import time

import numpy as np
import pytest

from antecede.llm.automaton import Spans, compile_rules
from antecede.llm.secret_scan import BASE, MORE, hit_pieces, joined, scan

PARTS = ["password", "Token", "API_KEY", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJ12", "0" * 31, "f" * 33, "x", "é",
         "\n", "Zz9+/", "passwd", "ghp_" + "a" * 36, "ghp_abc", "-----BEGIN RSA PRIVATE KEY-----", ".", "_", "longvalue123", "😀"]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, r in enumerate(BASE + MORE) for m in re.finditer(r.pattern, text or "", re.ASCII) if re.fullmatch(r.full, m[0])]
    return [(BASE + MORE)[k].kind + f":{a}:{b}" for a, k, b in sorted(spans)]


def test_spans_match_the_rules_over_whole_texts(frame, cases):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, "a" * 200_000 + " token: abcdefgh"), (901, "password = " + "A1" * 5000)]
    rows = [r for r in cases if r[0] != 8] + [(i + 1000, t) for i, t in rows]
    got = scan(frame(rows), BASE + MORE).select("id", joined("spans").alias("spans")).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.id, r.spans) for r in got), key=lambda r: (str(r[0]), r[1])) == sorted(((i, ",".join(brute(t))) for i, t in rows), key=lambda r: (str(r[0]), r[1]))
    assert scan(frame([])).count() == 0


@pytest.mark.parametrize("patterns", [["ab+c", "b(c|d)e?"], ["(?i:key)=[0-9]{2,3}", "[0-9]{4}"], ["a"]])
def test_automaton_finds_every_end(patterns):
    auto = compile_rules(patterns)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("abcdeKEYkey=0123.", k=25))
        state = 0
        for end, byte in enumerate(text.encode(), 1):
            state = auto.step[state, auto.classes[byte]]
            want = sum(1 << k for k, p in enumerate(patterns) if any(re.fullmatch(p, text[a:end]) for a in range(end)))
            assert auto.accepts[state] == want
            assert not auto.breaks[byte] or state == 0


def test_automaton_is_minimal():
    assert len(compile_rules(["abc|xbc"]).accepts) == 4
    with pytest.raises(ValueError):
        compile_rules(["a(?=b)"])
    with pytest.raises(ValueError):
        Spans("a*", "a")


@pytest.mark.parametrize("header", ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN ENCRYPTED PRIVATE KEY-----"])
def test_private_key_headers(frame, header):
    got = scan(frame([(1, f"é {header}\nMIIE"), (2, "-----BEGIN PUBLIC KEY-----")]), MORE).select("id", joined("spans").alias("spans")).collect()
    assert {r.id: r.spans for r in got} == {1: f"pem:2:{2 + len(header)}", 2: ""}


def test_spans_are_those_of_the_rules():
    rng = random.Random(11)
    finders = [Spans(r.pattern, r.full) for r in BASE + MORE]
    for _ in range(300):
        piece = "".join(rng.choices([p for p in PARTS if p.isascii()], k=rng.randint(0, 25)))
        for rule, finder in zip(BASE + MORE, finders):
            assert finder.find(piece.encode()) == [m.span() for m in re.finditer(rule.pattern, piece) if re.fullmatch(rule.full, m[0])]


def test_long_unbroken_text_takes_linear_time():
    auto = compile_rules([r.probe for r in BASE + MORE], [r.pattern for r in BASE + MORE])
    text = (b"token value " * 900_000)[:10_000_000] + b" token=abcdefgh12"
    began = time.perf_counter()
    pieces = list(hit_pieces(auto, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    spans = [Spans(BASE[0].pattern, BASE[0].full).find(text[a:b]) for a, b, _ in pieces]
    assert pieces == [(0, len(text), 1)] and spans == [[(len(text) - 16, len(text))]]
    assert time.perf_counter() - began < 10
