"""The registered queries against SQL, and the pipeline stage by stage on awkward documents."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from checks.compare import connect, difference
from jobmeter.llm import queries
from tests.conftest import SF_DIR
from tests.llm.tables import documents, prose
from tests.llm.test_lines import brute_force as lines_by_hand
from tests.llm.test_near_copies import brute_force as groups_by_hand

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(SQL) <= set(names) and corpus_pipeline.ORACLE_SQL is None


def write(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    notice = "this line stands in many of the documents here"
    rows = [] if empty else [(i, f"{t}\n{notice}", "en", f"s{i % 3}") for i, t in enumerate(prose(30, seed=4, words=50))]
    rows += [] if empty else [(100 + i, rows[0][1], "en", None) for i in range(3)]
    rows += [] if empty else [(200, None, "en", "s1"), (201, "123 456", None, "s1"), (202, "", None, None), (203, "w " * 3000, None, "s2")]
    docs = documents(spark, rows)
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = write(stage(spark, docs, SF_DIR), tmp_path / str(i))
        seen.append(docs)
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
    if empty:
        assert [d.count() for d in seen] == [0] * 5
        return
    language, lines, copies, mixed, packed = (d.collect() for d in seen)
    assert {r["doc_id"] for r in language} == {r[0] for r in rows} - {200, 201, 202}
    by_hand = lines_by_hand([(r["doc_id"], r["text"]) for r in language], 5, 40)
    assert sorted((r["doc_id"], r["text"]) for r in lines) == sorted((i, t) for i, t, _, _ in by_hand)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    kept = {i for i, _, _, keep in groups_by_hand([(r["doc_id"], r["text"]) for r in lines]) if keep}
    assert {r["doc_id"] for r in copies} == kept and len(copies) == len(kept) < len(lines)
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= kept and max(times.values()) <= 2
    pieces = Counter()
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert {i: n * tokens[i] for i, n in times.items()} == dict(pieces)


def test_run_is_the_chain_of_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]
