"""The byte kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmeter.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é\n\t\x0b ß中𝄞x "), max_size=30)), max_size=12)


def parts(texts, function, limit):
    for first, data, bounds in words.slices(pa.array(texts, pa.string()), limit):
        yield first, data, bounds, function(data, bounds)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1000]))
def test_words_and_lines_of_slices(texts, limit):
    seen_words = {i: [] for i in range(len(texts))}
    seen_lines = {i: [] for i in range(len(texts))}
    for first, data, bounds, found in parts(texts, words.words, limit):
        for a, b, r in zip(found.start, found.end, found.row):
            seen_words[first + r].append(data[a:b].tobytes().decode())
    for first, data, bounds, found in parts(texts, words.lines, limit):
        start, end = words.strip(data, found)
        for a, b, c, d, r in zip(found.start, found.end, start, end, found.row):
            seen_lines[first + r].append((data[a:b].tobytes().decode(), data[c:d].tobytes().decode()))
    white = "\x20\x09\x0a\x0b\x0c\x0d"
    for i, text in enumerate(texts):
        assert seen_words[i] == re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert seen_lines[i] == [(x, x.strip(white)) for x in (text or "").split("\n")]


def test_equal_spans_hash_alike_wherever_they_stand():
    text = "abc ABC xabc abc"
    (_, data, bounds, found), = parts([text], lambda d, b: words.words(d, b, lower=True), 1000)
    a, b, c, d = found.hash
    assert a == b == d != c
    exact = words.words(data, bounds).hash
    assert exact[0] != exact[1] and exact[0] == exact[3]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    for _, data, bounds, found in parts(texts, words.words, 1 << 20):
        row, value = words.shingles(found, len(texts), 3)
        for i, text in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            expected = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
            mine = value[row == i]
            assert len(mine) == len(expected) and (np.sort(mine) == mine).all()


def test_code_points():
    (_, data, bounds, found), = parts(["é中𝄞 a"], words.words, 1000)
    assert words.code_points(data, found.start, found.end).tolist() == [3, 1]
