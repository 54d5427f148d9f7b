import math
import random
import re
from collections import Counter

import pytest

from jobmeter.llm import lexical
from tests.llm.tables import documents, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(rows, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    held = Counter(t for _, c, _ in docs for t in c)
    out = []
    for name, text in dict.fromkeys(items):
        scores = []
        for i, counts, n in docs:
            m = 25 + 75 * n * n_docs // total
            score = 0
            for t in terms(text):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += weight * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out += [(name, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    base = prose(60, seed=3, words=30)
    out = list(enumerate(base))
    out += [(100 + i, base[0]) for i in range(15)]  # ties beyond the tenth place
    out += [(200, None), (201, ""), (202, " .,;\n"), (203, "ÉCOLE école Ñandú x1Y2"), (204, " ".join(base * 20))]
    out += [(None, base[1]), (None, base[1]), (7, base[2]), (7, base[2]), (205, "a.b-c_d a a"), (206, "\x85ka\xa0lo mi")]
    return out


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(9)
    words = [w for _, t in rows[:60] for w in t.split()]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    out += [(50, rows[0][1]), (51, "Ñandú ÉCOLE, x1y2!"), (52, "nowhere"), (53, None), (54, ""), (55, "A; a: B?")]
    out += [(None, words[0]), (56, words[0]), (56, words[0]), (57, " ".join([words[1]] * 5)), (57, words[2])]
    return out + [(58, "ka lo\x85ka\xa0lo mi")]


def found(spark, rows, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    df = lexical.search(documents(spark, [(i, t, None, None) for i, t in rows]), table, **options)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_all_documents(spark, rows, items):
    assert found(spark, rows, items) == brute_force(rows, items)


def test_blocks_of_items_do_not_change_the_result(spark, rows, items):
    assert found(spark, rows, items, block_bytes=700, k=3) == brute_force(rows, items, 3)


def test_small_steps_over_documents(spark, rows, items, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 64)
    best = lexical.Best(2, 2)
    import numpy as np

    for score, ids in (([[5, 0], [7, 1]], [3, 4]), ([[7, 0], [7, 1]], [1, 9]), ([[9, 2]], [8])):
        best.add(np.array(score), np.array(ids))
    assert list(zip(best.item, best.score, best.id)) == [(0, 9, 8), (0, 7, 1), (1, 2, 8), (1, 1, 4)]


def test_empty_tables(spark, rows, items):
    assert found(spark, [], items) == [] and found(spark, rows, []) == []
    assert found(spark, [(1, None), (2, " ")], items) == []


def test_clashing_columns(spark, rows):
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).selectExpr("*", "1 as rank", "2 as score", "3 as item")
    item = spark.createDataFrame([("x", rows[0][1], 1)], "item_id string, text string, doc_id int")
    assert [r["doc_id"] for r in lexical.search(docs, item).orderBy("rank").collect()] == [0, *range(100, 109)]
