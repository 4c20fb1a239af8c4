"""Shingles and bitmaps of many lines at once (operator 6)."""

import random

import numpy as np
import pytest

from limnos.llm import line_dedup, similarity
from limnos.llm.vectors import char_shingles

LINES = ["", "a", "abcde", "abcdef", "abcdefg", "aaaaaaaaaaaa", "ab" * 40_000, "😀日本語テキスト" * 3, "\ud800abc def", "x" * 70_000,
         *["q" * k for k in range(1, 140, 7)]]


def some_lines():
    rng = random.Random(3)
    return LINES + ["".join(rng.choice("abcd é日") for _ in range(rng.choice([1, 5, 6, 7, 30, 100, 124, 125, 129, 130, 131, 200, 400])))
                    for _ in range(400)]


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_shingles_of_many_lines_are_those_of_each_line(monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    for lines in (some_lines(), some_lines()[::-1], [], ["abc"], ["abcdef"]):
        got, bits = [], []
        for at, to, h, n in line_dedup.line_shingles(lines):
            assert at == len(got) and to - at == len(n)
            got += np.split(h, np.cumsum(n)[:-1])
            bits += similarity.bitmaps(h, n)
        want = [char_shingles(x, line_dedup.CHARS) for x in lines]
        assert [sorted(x.tolist()) for x in got] == [x.tolist() for x in want]
        for x, b in zip(want, bits):
            places = {int(g >> np.uint64(20)) % (64 * similarity.WORDS_OF_BITS) for g in x}
            assert sum((w % (1 << 64)) << (64 * k) for k, w in enumerate(b)) == sum(1 << p for p in places)


def test_signatures_do_not_depend_on_the_chunk_or_call_per_line(monkeypatch):
    lines = some_lines()[1:]
    sizes, full = line_dedup.few_shingles(lines)
    assert sizes.tolist() == [len(char_shingles(x, line_dedup.CHARS)) for x in lines]
    for i in (0, 3, 6, 200, len(lines) - 1):
        grams = char_shingles(lines[i], line_dedup.CHARS)
        if len(grams) <= line_dedup.FEW:
            assert full[i].tolist() == [((grams ^ x) * y).min() for x, y in zip(line_dedup._XOR, line_dedup._TIMES)]
    keys, counts = line_dedup.line_keys(lines)
    monkeypatch.setattr(line_dedup, "CHUNK", 100)
    again, same = line_dedup.line_keys(lines)
    assert (keys == again).all() and (counts == same).all()
    # lines of a window or more are hashed together, not one by one
    monkeypatch.setattr(line_dedup, "char_shingles", lambda *_: pytest.fail("called for a line"))
    line_dedup.line_keys([x for x in lines if len(x) >= line_dedup.CHARS])
