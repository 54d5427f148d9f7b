import hashlib
from collections import defaultdict

import numpy as np
import pytest

from jobmeter.llm import lines
from tests.llm.tables import documents, rows_of

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_docs, min_chars):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-(2**63) if i is None else i)
    out = []
    for i, text in rows:
        own = -(2**63) if i is None else i
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == own]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    first, second = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    first[:100] = first[100]  # equal in one half only
    table = lines.PerfectHash(first, second)
    assert sorted(table.index(first, second)) == list(range(20_000))
    assert len(lines.PerfectHash(first[:0], second[:0]).index(first[:3], second[:3])) == 3


@pytest.mark.parametrize("probes", [lines.PROBES_PER_GROUP, 1])
def test_against_brute_force(spark, monkeypatch, probes):
    monkeypatch.setattr(lines, "PROBES_PER_GROUP", probes)
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 2)
    notice, other = "This notice stands in many of them", "ÄÖ stays: capitals beyond A-Z differ"
    rows = [(i, f"own {i}\n  {notice.upper() if i % 2 else notice}\t\nshort\nend") for i in range(9)]
    rows += [(20 + i, f"{other}\n{other}\n{'x' * 30}") for i in range(3)]
    rows += [(20, f"{other}\n{other}\n{'x' * 30}")]  # a repeated row
    rows += [(30, other.replace("ÄÖ", "äö")), (None, notice), (40, None), (41, ""), (42, " \n\t\n"), (43, "\n".join(["y" * 25] * 3000))]
    rows += [(50 + i, "z" * 40 + "\r") for i in range(4)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    found = lines.drop_repeated_lines(docs, min_docs=4, min_chars=25)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows_of(found, "doc_id", "text", "n_lines", "n_dropped") == brute_force(rows, 4, 25)


def test_empty_table(spark):
    assert lines.drop_repeated_lines(documents(spark, [])).collect() == []


def test_digest_of_empty_text(spark):
    found = lines.drop_repeated_lines(documents(spark, [(1, None, None, None)])).first()
    assert (found["n_lines"], found["n_dropped"]) == (1, 0)
    assert hashlib.sha256(found["text"].encode()).hexdigest().startswith("e3b0c44298fc")
