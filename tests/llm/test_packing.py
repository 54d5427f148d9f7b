import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmeter.llm import packing
from tests.llm.tables import documents, prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_deal_fills_every_sequence(sizes):
    pieces, used = packing.deal(sizes, 16, 1.0, 0.1)
    covered, filled = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        covered[d] += range(start, start + n)
        filled[s] += range(offset, offset + n)
    assert {d: sorted(x) for d, x in covered.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    lengths = [len(filled[s]) for s in range(used)]
    assert all(sorted(x) == list(range(len(x))) for x in filled.values())
    assert all(n == 16 or n & (n - 1) == 0 for n in lengths) and sum(n < 16 for n in lengths) <= 4


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 700, 400).tolist()
    pieces, used = packing.deal(sizes, 2048, 1.0, 1 / 1024)
    cost = np.zeros(used)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 1024
    full = cost[: sum(sizes) // 2048]
    in_order = np.zeros(len(full) + 1)  # the same documents one after another
    at = 0
    for n in sizes:
        in_order[min(at // 2048, len(full))] += n + n * n / 1024
        at += n
    assert full.std() / full.mean() < 0.5 * in_order[:-1].std() / in_order[:-1].mean()


def test_round_trip(spark):
    from tokenizers import Tokenizer

    files = packing.default_vocabulary()
    encode = Tokenizer.from_file(files[0]).encode
    texts = [*prose(60, seed=8), "word " * 9000, None, "", " \n", "a<|endoftext|>b", "naïve 中文 𝄞 \x00", prose(1, 9)[0]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None), (3, texts[3], None, None), (3, texts[3], None, None)]
    pieces = packing.pack(documents(spark, rows).repartition(3), group_tokens=2000).collect()
    by_place = defaultdict(list)
    ids = defaultdict(list)
    for p in pieces:
        values = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(values) == p["length"] > 0
        by_place[p["sequence_id"]].append((p["offset"], p["length"]))
        ids[p["doc_id"]].append((p["start"], values, p["doc_tokens"]))
    for spans in by_place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for i, text in {i: t for i, t, _, _ in rows}.items():
        expected = [*encode(text or "", add_special_tokens=False).ids, 1]
        copies = sum(1 for r in rows if r[0] == i)
        assert {n for _, _, n in ids[i]} == {len(expected)}
        found = [(start + k, v) for start, values, _ in ids[i] for k, v in enumerate(values)]
        assert sorted(found) == sorted([(k, v) for k, v in enumerate(expected)] * copies)


def test_digests(spark):
    found = packing.digests(packing.pack(documents(spark, [(7, None, None, None)]))).first()
    assert found["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes()) and found["length"] == 1


def test_no_documents_and_odd_lengths(spark):
    assert packing.pack(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), length=1000)


def test_both_encoders_agree_on_all_given_documents():
    import pyarrow.parquet as pq

    tokens = packing.Tokens(*packing.default_vocabulary())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in texts:
        assert tokens(text or "") == tokens.full.encode(text or "", add_special_tokens=False).ids
    assert len(texts) == 1000
