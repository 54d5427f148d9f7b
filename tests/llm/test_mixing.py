import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobmeter.llm import mixing
from tests.llm.tables import documents, prose, rows_of


def targets_by_rounds(sizes, weights, share, cap):
    """Deal out by weight, fix what is above its cap, deal the rest again."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    wanted, fixed = sum(sizes.values()) * share, {}
    while True:
        free = [k for k in keys if k not in fixed]
        rest = wanted - sum(fixed.values())
        target = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if target[k] > cap * sizes[k]]
        if not over:
            return target | fixed
        fixed |= {k: cap * sizes[k] for k in over}


@pytest.fixture(scope="module")
def docs(spark):
    texts = prose(700, seed=3, words=30) + prose(200, seed=4, words=90) + prose(40, seed=6, words=400)
    sources = ["big", "small", "ü", "Z", None]
    rows = [(i, t, None, sources[0 if i % 3 == 0 else i % 5]) for i, t in enumerate(texts)]
    rows += [(2000 + i, "same words in every copy of this text", None, "copies") for i in range(300)]
    rows += [(3000, None, None, "small"), (3001, "", None, "void"), (3002, " \t", None, "void")]
    rows += [(None, "no id here", None, "small"), (5, texts[5], None, "big"), (5, texts[5], None, "big")]
    return documents(spark, rows).withColumn("size", F.lit("clash"))


def test_targets_and_rounding(spark, docs):
    mixed = mixing.mix(docs)
    assert len(mixed.columns) == len(docs.columns) + 4  # size is replaced
    rows = mixed.collect()
    assert len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    expected = targets_by_rounds(size, (3, 1, 2), 1.5, 2)
    for source in size:
        assert target[source] == pytest.approx(expected[source])
        assert abs(taken[source] - target[source]) <= max(0.02 * target[source], 60)
        assert {r["source_size"] for r in rows if r["source"] == source} == {size[source]}
    # Longer documents of a source that grows are taken more often: the tilt is exponential in size.
    again = mixing.mix(docs.repartition(5))
    assert rows_of(again, "doc_id", "text", "taken") == rows_of(mixed, "doc_id", "text", "taken")


def test_copies_follow_the_tilt(spark):
    rows = [(i, "w " * (10 if i % 2 else 100), None, "a") for i in range(400)]
    rows += [(1000 + i, "w " * 50, None, "b") for i in range(100)]
    found = mixing.mix(documents(spark, rows), weights=(1, 8), share=0.8)
    share = found.groupBy("source", "size").agg(F.avg("copies").alias("rate")).collect()
    rate = {(r["source"], r["size"]): r["rate"] for r in share}
    # Source a shrinks: with rates exp(lambda * size), the rate of size 100 is that of size 10 to the tenth.
    assert 0 < rate["a", 100] < rate["a", 10] < 1
    assert rate["a", 100] == pytest.approx(rate["a", 10] ** 10, abs=0.04)


def test_the_mix_itself(spark, docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counted = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed.count() == counted


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (2, "", None, "a")]])
def test_nothing_to_mix(spark, rows):
    found = mixing.mix(documents(spark, rows))
    assert [(r["size"], r["target"], r["taken"]) for r in found.collect()] == [(0, 0.0, 0)] * len(rows)
