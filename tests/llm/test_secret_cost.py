"""Guess costs of repeats, keyboard walks and words, and the contexts of values."""

import itertools
import random

import pytest

from peakloom.llm import secret_scan

VALUE = "zX9#kq2LmP7v"


def spans(text):
    return [text[a:b] for a, kind, b in secret_scan.scan(text) if kind == 3]


@pytest.mark.parametrize("hit, clean", [("xkqzvjwbtpmh", "xkqxkqxkqxkq"), ("q4mzp8wkx2tv", "1qaz2wsx3edc"), ("Q$mZp8wKx2tv", "!QAZ@WSX"), ("infxrmqtzonw", "information"), ("ogzqnivatxrk", "organization"), ("vqrsxchzrung", "versicherung")])
def test_hit_and_near_miss(hit, clean):
    assert spans(f"pwd: {hit} x") == [hit] and spans(f"pwd: {clean} x") == []


def test_long_repeat_is_cheap():
    assert secret_scan.guess_cost("q7" * 5000) < 7


def test_contexts():
    for before in ("Authorization: Bearer ", "authorization: Basic ", "x-api-key: ", "client-secret=", "secret_key = ", "secret-key: ", "private-key: "):
        assert spans(before + VALUE + " end") == [VALUE], before
        assert spans(before + "information end") == [], before
    assert spans("Authorization: Bearer") == [] and spans("my key " + VALUE) == []


def test_repeats_are_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        v = "".join(draw.choices("ab" if draw.random() < 0.5 else "abc", k=draw.randrange(0, 18)))
        want = set()
        for p, i in itertools.product(range(1, len(v) // 2 + 1), range(len(v))):
            j = i + p
            while j < len(v) and v[j] == v[j - p]:
                j += 1
            block = v[i : i + p]
            primitive = all(block != block[:d] * (p // d) for d in range(1, p) if p % d == 0)
            if j - i >= max(2 * p, 3) and primitive and (i == 0 or v[i - 1] != v[i - 1 + p]):
                want.add((i, j, p))
        assert set(secret_scan.repeats(v)) == want and len(secret_scan.repeats(v)) == len(want), v


def test_cost_is_the_least_of_all_segmentations():
    draw = random.Random(6)
    parts = ["love", "dragon", "1999", "qwer", "aaa", "x9x9", "zk", "7", "abcd", "Pass"]
    for _ in range(150):
        v = "".join(draw.choices(parts, k=draw.randrange(1, 4)))[:12]
        spans = {(a, b): c for a, b, c in sorted(secret_scan.spans_of(v), key=lambda s: -s[2])}
        least = float("inf")
        for cuts in itertools.product((0, 1), repeat=len(v) - 1):  # every way to cut the value
            ends = [0, *(k + 1 for k, cut in enumerate(cuts) if cut), len(v)]
            cost = 0.0
            for a, b in itertools.pairwise(ends):
                brute = sum(map(secret_scan.char_cost, v[a:b]))
                cost += min(brute, spans.get((a, b), brute))
            least = min(least, cost)
        assert secret_scan.guess_cost(v) == pytest.approx(least), v


def test_every_context_value_is_priced():
    text = f"password={VALUE.replace('#', '')} pwd: {VALUE} token = letmein1 pin: 1234"
    found = secret_scan.priced(text)
    assert [(text[a:b], k) for a, k, b, _ in found if k == 3] == [(VALUE.replace("#", ""), 3), (VALUE, 3)]
    base = {text[a:b]: c for a, k, b, c in found if k == 0}
    assert base["token = letmein1"] < 5 < 10 < base[f"password={VALUE.replace('#', '')}"]
