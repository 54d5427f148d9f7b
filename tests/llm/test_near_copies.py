import random
import re

import numpy as np
import pyarrow as pa
import pytest

from jobmeter.llm import near_copies, words
from jobmeter.llm.components import components
from tests.llm.tables import documents, prose, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    big = 2**63
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if name is None else name)
    out = []
    for i, (name, _) in enumerate(rows):
        component = least[root(i)]
        out.append((name, len(sets[i]), None if component == big else component, component == (big if name is None else name)))
    return sorted(out, key=repr)


def edited(text, edits, rng):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = prose(12, seed=2, words=90)
    out = [(i, t) for i, t in enumerate(base)]
    # One group of copies with more and more edits: links chain through it, and some copies stay out.
    out += [(100 + i, edited(base[0], i // 4, rng)) for i in range(60)]
    out += [(200 + i, base[1]) for i in range(30)]  # exact copies
    out += [(300, base[2].upper()), (301, base[3].replace(" ", "\n  ")), (302, base[4] + " tail")]
    out += [(303, "one two"), (304, "One  TWO"), (305, "one two three"), (306, ""), (307, None), (308, " \t\n")]
    out += [(309, "É x y z w"), (310, "é x y z w"), (None, base[5]), (None, "no twin of any kind here"), (5, base[5])]
    out += [(400, " ".join(base * 40)), (401, " ".join(base * 40)), (402, "a b c d e"), (403, "a b c d e")]
    out += [(500 + i, base[6][:300] + " " + t) for i, t in enumerate(prose(20, seed=8, words=60))]  # shared passage
    return out


def test_against_all_pairs(spark, rows):
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    found = near_copies.near_copies(docs)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == brute_force(rows)


def test_large_buckets_are_dealt_into_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "PAIRS", 7)
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert rows_of(near_copies.near_copies(docs), "doc_id", "n_shingles", "component_id", "kept") == brute_force(rows)


def test_bounds_of_whole_batches_equal_those_of_single_pairs():
    # Parts of a bucket lie across batches; before, a row was made of each stray and each member.
    rng = np.random.default_rng(3)
    rows = []
    for band in range(40):
        core = rng.integers(0, 2**63, 90, dtype=np.uint64)
        for k in range(int(rng.integers(2, 25))):
            items = np.unique(np.concatenate([rng.choice(core, int(rng.integers(50, 90)), False), rng.integers(0, 2**63, 9, dtype=np.uint64)]))
            node, label = (bytes(rng.integers(0, 256, 16, dtype=np.uint8)) for _ in range(2))
            bits = np.zeros(near_copies.BITMAP * 64, np.uint8)
            bits[items % np.uint64(len(bits))] = 1
            rows.append({
                "band": band // 2, "i": band % 2, "j": 0, "stray": k < 3, "node": node, "n": len(items), "u": int(rng.integers(0, 10)),
                "label": rows[-1]["label"] if k % 4 == 1 else label, "bits": np.packbits(bits).view(np.int64).tolist(),
            })

    def allowed(x, y):
        c, e = x["n"] - x["u"], y["n"] - y["u"]
        own = 100 * min(c, e) >= 75 * (x["u"] + y["u"] + max(c, e))
        count = lambda a, b: sum((v & ~w & (2**64 - 1)).bit_count() for v, w in zip(a["bits"], b["bits"]))
        both = min(x["n"] - count(x, y), y["n"] - count(y, x))
        return x["label"] != y["label"] and own and 100 * both >= 75 * (x["n"] + y["n"] - both)

    part = lambda r: (r["band"], r["i"])
    expected = {(x["node"], y["node"]) for x in rows for y in rows if x["stray"] and not y["stray"] and part(x) == part(y) and allowed(x, y)}
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = [(x, y) for b in near_copies._allowed(75, 100)(iter(batches)) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())]
    assert 0 < len(expected) < sum(x["stray"] and not y["stray"] and part(x) == part(y) for x in rows for y in rows)
    assert len(found) == len(set(found)) and set(found) == expected
    assert list(near_copies._allowed(75, 100)(iter([]))) == []


def test_deduplicated_keeps_one_of_each_group(spark, rows):
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns
    expected = {name for name, _, _, keep in brute_force(rows) if keep}
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_deduplicated_keeps_exactly_one_row_of_each_group(spark):
    base = prose(6, seed=3, words=60)
    near = lambda t, k: t + f" tail{k}"
    rows = [(7, base[0])] * 4 + [(7, near(base[0], 1)), (9, base[0])]  # repeats and near copies under the smallest id
    rows += [(None, base[1]), (None, near(base[1], 1)), (None, near(base[1], 2)), (None, base[1])]  # no id at all
    rows += [(5, base[2]), (5, base[3])]  # two different documents under one id
    rows += [(20, None), (20, None), (21, ""), (21, " ")]  # no words: no copies of each other
    kept = near_copies.deduplicated(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    groups = [[r for r in kept if r["text"] and r["text"].startswith(b)] for b in base[:4]]
    assert [len(g) for g in groups] == [1, 1, 1, 1] and groups[0][0]["doc_id"] == 7 and groups[1][0]["doc_id"] is None
    assert len(kept) == 8


def test_empty_table(spark):
    assert near_copies.near_copies(documents(spark, [])).collect() == []


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(4)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)] + [shared[:1], shared[:3]]
    row = np.repeat(np.arange(4), [len(s) for s in sets])
    coordinates = near_copies.sketch(row, np.concatenate(sets), 4)
    assert (coordinates != 0).all()  # every coordinate is filled, also for one element
    similar = (coordinates[0] == coordinates[1]).mean()
    assert abs(similar - 0.6) < 0.15
    again = near_copies.sketch(np.zeros(len(sets[1]), np.int64), sets[1], 1)
    assert (again[0] == coordinates[1]).all()  # it depends on the set alone


def test_components_of_paths_and_stars(spark):
    key = lambda i: bytes(words.mix(np.array([i], np.uint64)))
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    labels = {bytes(r["node"]): bytes(r["label"]) for r in components(df).collect()}
    groups = [{key(i) for i in range(31)}, {key(i) for i in range(100, 140)}, {key(200), key(201)}]
    assert set(labels) == set().union(*groups)
    assert all(len({labels[n] for n in g}) == 1 for g in groups) and len(set(labels.values())) == 3
    assert components(df.limit(0)).count() == 0
