import random
import re
import zlib

import numpy as np
import pytest

from jobmeter.llm import periodic, queries
from tests.llm.tables import documents, prose


def brute_force(words):
    """(start, length, period) of every maximal run, by trying every lag."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words):
    gone = {i for s, n, q in brute_force(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x " * 50]
    for seed in range(60):
        kinds = rng.choice([2, 3, 8, 40])
        w = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(0, 3)):
            q = rng.choice([1, 2, 3, 7, 20, 70])
            piece = [f"v{rng.randrange(max(2, q // 2))}" for _ in range(q)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (piece * 9)[: rng.randint(3 * q, 6 * q)]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    # Neighbouring runs that share words, a run within a run, and a nearly periodic text.
    out += ["a b a b a b a b b b b b b", " ".join(["a a a a a a b"] * 5), " ".join(["p q r s"] * 30 + ["p q s"] + ["p q r s"] * 30)]
    out += prose(5, seed=1, words=300) + ["É é " * 9, "\x85a\xa0 " * 8]
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_against_every_lag(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts())] + [(None, "k l " * 9, None, None), (3, "a " * 9, None, None)]
    docs = documents(spark, rows).selectExpr("*", "1 as runs", "'x' as collapsed")
    found = periodic.find_runs(docs)
    assert found.columns == docs.columns
    found = found.collect()
    assert len(found) == len(rows)
    expected = sorted((repr((i, t)), brute_force(words_of(t)), collapsed(words_of(t))) for i, t, _, _ in rows)
    assert sorted((repr((r["doc_id"], r["text"])), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found) == expected


@pytest.mark.parametrize("period", [65, 66, 100, 333, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_long_periods(period, seed):
    rng = np.random.default_rng([seed, period])
    unit = rng.integers(0, 3 if seed % 2 else 10**6, period)
    length = 4 * period + int(rng.integers(0, period))
    run = np.tile(unit, 6)[:length]
    codes = np.concatenate([rng.integers(0, 5, seed * 37), run, rng.integers(0, 5, 100)])
    assert periodic.runs(codes) == brute_force(codes.tolist())


def test_random_codes_of_few_kinds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        codes = rng.integers(0, rng.integers(1, 4), rng.integers(0, 60))
        assert periodic.runs(codes) == brute_force(codes.tolist())


def test_segments_split_until_stable():
    # Taking out z leaves pieces in which y is rare, and so on; the run at the end survives.
    codes = np.array([0, 1, 0, 1, 2, 0, 1, 0, 1, 2, 0, 3, 0, 2, 3, 1, 1, 1, 4, 5, 6, 5, 6, 5, 6, 5, 6, 7])
    assert periodic.segments(codes, np.array([0, len(codes)])) == [(19, 27)]
    assert periodic.segments(np.zeros(0, np.int64), np.array([0, 0])) == []
    two = np.array([1] * 7 + [1] * 7)
    assert sorted(periodic.segments(two, np.array([0, 7, 14]))) == [(0, 7), (7, 14)]


def test_empty_table(spark):
    assert periodic.find_runs(documents(spark, [])).collect() == []


def test_planted_runs(spark):
    rows = [(i, t, None, None) for i, t in enumerate(prose(80, seed=4, words=60) + [None, "", "a"] * 20)] + [(None, "a b", None, None)]
    planted = {(r["doc_id"], tuple(words_of(r["text"]))) for r in queries.with_planted_runs(documents(spark, rows)).collect()}
    expected = set()
    for i, t, _, _ in rows:
        w = words_of(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        expected.add((i, tuple(w)))
    assert planted == expected
