import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmeter.llm import posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int, list int"


def brute_force(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == len(rows[0][1]) and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, v in good:
        if i % 20:
            continue
        scores = {}
        for j, w in good:
            if j != i:
                score = 0.0
                for a, b in zip(v, w):
                    score += a * b
                scores[j] = max(scores.get(j, -np.inf), score)
        out[i] = sorted(((-s, j) for j, s in scores.items()))[:k]
    return {i: [(j, -s) for s, j in x] for i, x in out.items()}


def as_float(v):
    return [float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    points *= rng.uniform(0.5, 2.0, 3000)[:, None]  # lengths differ: inner product is not distance
    return [(i, as_float(v)) for i, v in enumerate(points)]


def found_rows(df, k=20, **options):
    out = {}
    for r in posting_lists.search(df, F.col("vec_id") % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark, clustered):
    found = found_rows(spark.createDataFrame([(i, v, 0, 0) for i, v in clustered], SCHEMA))
    exact = brute_force(clustered, 20)
    assert set(found) == set(exact) and all(len(x) == 20 for x in found.values())
    hits = sum(len({j for j, _ in found[i]} & {j for j, _ in exact[i]}) for i in exact)
    assert hits / (20 * len(exact)) >= 0.9
    vectors = dict(clustered)
    for i, rows in found.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0])) and i not in {j for j, _ in rows}
        for j, score in rows:
            assert score == pytest.approx(float(np.dot(vectors[i], vectors[j])), rel=1e-12)


def test_blocks_of_long_and_popular_lists(spark, clustered, monkeypatch):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in clustered[:600]], SCHEMA)
    whole = found_rows(df)
    monkeypatch.setattr(posting_lists, "SHARD", 50)
    monkeypatch.setattr(posting_lists, "QUERY_BLOCK", 2)
    assert found_rows(df) == whole


def test_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, as_float(v)) for i, v in enumerate(rng.normal(size=(40, 4)))]
    same = rows[20][1]
    rows += [(1000 + i, same) for i in range(70)] + [(1020, same)]  # equal vectors, and a repeated row
    rows += [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0, None, 0.0, 0.0]), (64, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(65, [float("inf"), 1.0, 1.0, 1.0]), (66, [1.0, 2.0]), (None, same), (80, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    found, exact = found_rows(df), brute_force(rows, 20)
    assert set(found) == set(exact)
    for i in exact:  # so few rows that every list is read
        assert [j for j, _ in found[i]] == [j for j, _ in exact[i]]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.5, 0.5])]])
def test_fewer_candidates_than_asked(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    assert found_rows(df) == {i: x for i, x in brute_force(rows, 20).items() if x} if rows else found_rows(df) == {}


def test_parts_are_small_and_dense_regions_get_more(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(900, 4)), 0.01 * rng.normal(size=(900, 4)) + 5])
    centroids = np.stack(posting_lists.split(points, 50))
    near = (np.abs(centroids - 5) < 1).all(axis=1).sum()
    assert 18 <= near <= 120 and posting_lists.split(np.ones((99, 3)), 10)[0].tolist() == [1.0, 1.0, 1.0]


def test_more_lists_are_read_where_neighbours_spread(spark, monkeypatch):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(4000, 32))  # no clusters: neighbours lie in many lists
    rows = [(i, as_float(v)) for i, v in enumerate(points)]
    monkeypatch.setattr(posting_lists, "LIST_SIZE", 8)  # as many lists as a table of 64,000 rows has
    found, exact = found_rows(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)), brute_force(rows, 20)
    hits = sum(len({j for j, _ in found[i]} & {j for j, _ in exact[i]}) for i in exact)
    assert hits / (20 * len(exact)) >= 0.9


def test_further_lists_lie_on_other_sides():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2000, 6))
    index = posting_lists.Index.of(points, 20, float(np.sqrt((points**2).sum(axis=1).max())) * 1.01)
    chosen = posting_lists._lists_of(index, points)
    lifted = posting_lists.lift(points, index.norm)
    assert (chosen[:, 0] >= 0).all() and (chosen[:, 1] >= 0).mean() > 0.05
    for x, lists in zip(lifted, chosen):
        lists = lists[lists >= 0]
        assert len(set(lists.tolist())) == len(lists)
        for j, c in enumerate(lists[1:], 1):
            far = np.linalg.norm(x - index.centroids[c])
            assert all(np.linalg.norm(index.centroids[c] - index.centroids[i]) >= far - 1e-9 for i in lists[:j])


def test_shards_hold_whole_lists_and_long_lists_are_cut(monkeypatch):
    monkeypatch.setattr(posting_lists, "SHARD", 100)
    shards = posting_lists.Shards.of({0: 60, 1: 40, 2: 1, 4: 250, 5: 30}, 6)
    assert shards.first.tolist() == [0, 0, 1, -1, 2, 5] and shards.parts.tolist() == [1, 1, 1, 1, 3, 1]


def test_clustered_vectors_are_read_in_part(spark, clustered):
    """Where vectors form groups a query multiplies with far less than all of them."""
    vectors = np.array([v for _, v in clustered])
    norm = float(np.sqrt((vectors**2).sum(axis=1).max())) * 1.01
    index = posting_lists.Index.of(vectors, 40, norm)
    lists = posting_lists._lists_of(index, vectors, 1)[:, 0]
    kinds = {"vector": vectors.tolist(), "ids": [[i] for i in range(len(vectors))], "list": lists}
    import pyarrow as pa

    class Held:
        value = index

    ranked, far = index.nearest(posting_lists._query_points(vectors[:50], norm), len(index.centroids))
    asked = pa.table({"query_id": list(range(50)), "vector": vectors[:50].tolist(), "lists": ranked.astype(np.int32).tolist(), "far": far.tolist()})
    found = posting_lists._scan(Held, 20, 1)(pa.table(kinds), asked)
    exact = brute_force([(20 * i if i < 50 else 10**6 + 1 + 20 * i, v) for i, v in enumerate(vectors.tolist())], 20)
    for i, ids in enumerate(found["ids"].to_pylist()):
        assert [20 * j if j < 50 else 10**6 + 1 + 20 * j for j in ids] == [j for j, _ in exact[20 * i]]
