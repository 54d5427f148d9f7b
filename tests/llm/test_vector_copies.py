import numpy as np
import pytest

from jobmeter.llm import vector_copies

SCHEMA = "vec_id long, embedding array<double>, label string, node int, n_links string, cell int, row int"


def brute_force(rows, similarity=0.98):
    """(vec_id, n_links, component_id, kept) of every row by comparing all pairs."""
    n = len(rows)
    usable = [
        g is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)
        for _, v, g in rows
    ]
    linked = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[x][1]) / np.abs(rows[x][1]).max() for x in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= similarity:
                    linked[i].append(j)
                    linked[j].append(i)
    out, component = [], [None] * n
    for i in range(n):
        reach, waiting = {i}, [i]
        while waiting:
            for j in linked[waiting.pop()]:
                if j not in reach:
                    reach.add(j)
                    waiting.append(j)
        component[i] = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), component[i], component[i] == rows[i][0]))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, g, 1, "x", 2, 3) for i, v, g in rows], SCHEMA)
    result = vector_copies.near_copies(df, **options)
    assert set(result.columns) == {*df.columns, "component_id", "kept"}
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in result.collect()), key=repr)


def clustered(n, labels, seed, size=8, spread=0.08, centres=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, size))
    points = centre[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))
    points *= rng.uniform(0.1, 9.0, n)[:, None]
    return [(i, p.tolist(), str(rng.integers(0, labels))) for i, p in enumerate(points)]


SMALL = {"cell": 40, "block": 64, "copy_cost": 2}  # so that small tables are split and blocked


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = clustered(60, 2, 1)
    v = rows[0][1]
    rows += [(100 + i, v, rows[0][2]) for i in range(20)]  # copies
    rows += [(5, v, rows[0][2]), (None, v, rows[0][2]), (None, [3.0] * 8, "lone"), (-7, [2 * x for x in v], rows[0][2])]
    rows += [(200, None, "0"), (201, [], "0"), (202, [0.0] * 8, "0"), (203, [-0.0] * 8, "0"), (204, [nan, *v[1:]], "0")]
    rows += [(205, [inf, *v[1:]], "0"), (206, [None, *v[1:]], "0"), (207, v, None), (208, v, None), (209, v[:4], rows[0][2])]
    rows += [(210, [0.0, 1.0], "z"), (211, [-0.0, 1.0], "z"), (212, [1e200, 1e200], "z"), (213, [1e-200, 1e-200], "z")]
    rows += [(214, [1.0, 0.0], "z"), (214, [0.0, -1.0], "z"), (215, [-0.0, -2.0], "z")]
    assert found(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.5])
def test_split_cells(spark, spread):
    rows = clustered(700, 2, 3, spread=spread)
    assert found(spark, rows, **SMALL) == brute_force(rows)


def test_hot_label_of_one_dense_group(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.06 * rng.normal(size=16)).tolist(), "hot") for i in range(400)]
    rows += [(1000 + i, rng.normal(size=16).tolist(), "hot") for i in range(200)]
    assert found(spark, rows, similarity=0.995, **SMALL) == brute_force(rows, 0.995)


def test_visits_cover_every_pair_within_the_radius_once():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 5))
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = rng.normal(size=(9, 5)) * 0.7
    radius = 0.5
    home, near = vector_copies.visits(points, pivots, radius)
    send = vector_copies.sends(9)
    goes = near & send[home]
    goes[np.arange(400), home] = True
    assert not goes.all()  # some cells are spared
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i, j in zip(*np.nonzero(np.triu(apart <= radius, 1))):
        meets = int(home[i] == home[j]) or int(goes[i, home[j]]) + int(goes[j, home[i]])
        assert meets == 1


def test_pivots_only_where_they_pay():
    rng, plan = np.random.default_rng(4), vector_copies.Plan(0.2)
    scattered = rng.normal(size=(512, 64))
    scattered /= np.linalg.norm(scattered, axis=1)[:, None]
    assert vector_copies.pivots_for(scattered, 5000, plan) is None  # every cell would need nearly all vectors
    centres = scattered[:20]
    groups = centres[rng.integers(0, 20, 512)] + 0.01 * rng.normal(size=(512, 64))
    groups /= np.linalg.norm(groups, axis=1)[:, None]
    assert len(vector_copies.pivots_for(groups, 5000, plan)) > 2
    assert vector_copies.pivots_for(scattered[:1].repeat(512, 0), 5000, plan) is None


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 8])
def test_every_two_blocks_meet_in_one_wave(blocks):
    met = [frozenset((b, (b + d) % blocks)) for wave in vector_copies._waves(blocks) for d in wave for b in range(blocks)]
    assert set(met) == {frozenset((i, j)) for i in range(blocks) for j in range(blocks)}
    for wave in vector_copies._waves(blocks):  # before, a vector went to one and a half times as many pairs as there are blocks
        assert len({(w * d) % blocks for d in wave for w in (1, -1)}) <= 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_waves_of_blocks(spark, kind):
    rows = clustered(500, 2, 6, spread=0.5)
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), g) for i, v, g in rows]
    df = spark.createDataFrame([(i, v, g) for i, v, g in rows], f"vec_id long, embedding array<{kind}>, label string")
    options = {**SMALL, "block": 40, "wide": 1}
    plan = vector_copies.Plan(0.2, **options)
    assert plan.blocks(250, 8) == 7 and len(vector_copies._waves(7)) == 4
    result = vector_copies.near_copies(df, **options).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in result), key=repr) == brute_force(rows)


def test_blocks_grow_before_they_become_many():
    plan = vector_copies.Plan(0.2)
    assert [plan.blocks(n, 64) for n in (2048, 2049, 4097, 16384, 40_000, 65_536, 65_537, 720_000)] == [1, 1, 2, 4, 4, 4, 5, 44]
    assert plan.blocks(65_536, 1536) == 16  # of 50 MB each, as before


def test_splitting_makes_a_bounded_number_of_copies():
    rng, plan = np.random.default_rng(7), vector_copies.Plan(0.2)
    scattered = rng.normal(size=(512, 64))
    scattered /= np.linalg.norm(scattered, axis=1)[:, None]
    assert vector_copies.pivots_for(scattered, 60_000, plan) is None  # was split: eight copies of a vector for fewer products
    groups = scattered[:20][rng.integers(0, 20, 512)] + 0.01 * rng.normal(size=(512, 64))
    groups /= np.linalg.norm(groups, axis=1)[:, None]
    assert vector_copies.pivots_for(groups, 60_000, plan) is not None
    assert vector_copies.pivots_for(groups, 60_000, plan, homes=20_000) is None  # two guests for each that lives there already
