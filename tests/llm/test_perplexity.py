import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmeter.llm import perplexity, words
from tests.llm.tables import documents, prose, rows_of


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    repeated = {j for i, x in enumerate(windows) if x in often for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é#\n\t|"), max_size=40)), max_size=8))
def test_base_statistics(texts):
    seen = []
    for _, data, bounds in words.slices(pa.array(texts, pa.string()), 50):
        found = perplexity.base_statistics(data, bounds)
        seen += zip(*(found[c].tolist() for c in perplexity._STATISTICS))
    assert seen == [statistics(t) for t in texts]


class KneserNey:
    """Interpolated modified Kneser-Ney, written out for one language."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter()}
        for t in texts:
            t = "\n" * (order - 1) + t
            self.counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, c in self.counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = [0.0]
            for i, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
                value = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] and n[i + 1] else 0
                d.append(value if value > 0 else default)
            self.discounts[k] = d
            table = defaultdict(lambda: [0, 0.0])
            for g, v in c.items():
                table[g[:-1]][0] += v
                table[g[:-1]][1] += d[min(v, 3)]
            self.contexts[k] = table

    def p(self, gram):
        if not gram:
            return 1 / len(self.counts[1])
        k = len(gram)
        total, spared = self.contexts[k][gram[:-1]]
        v = self.counts[k][gram]
        return (max(v - self.discounts[k][min(v, 3)], 0) + spared * self.p(gram[1:])) / total

    def bits(self, text):
        padded = "\n" * (self.order - 1) + text
        logs = [math.log(self.p(padded[i : i + self.order])) for i in range(len(text))]
        return -sum(logs) / len(logs)


@pytest.fixture(scope="module")
def rows():
    texts = prose(40, seed=1, words=60)
    out = [(i, t, "en" if i % 3 else None, None) for i, t in enumerate(texts)]
    out += [(100, None, "en", None), (101, "", "en", None), (102, " \n ", "xx", None), (103, "too short", "en", None)]
    out += [(104, "same three words " * 40, "en", None), (105, " ".join(texts[:30]), "en", None), (1, texts[1], "en", None)]
    out += [(106, " ".join(f"{i:x}Q#{i * 7919 % 997:x}%" for i in range(80)), "en", None), (107, "一二三四五 " * 3, "zh", None)]
    return out


def test_model_bands_and_verdicts(spark, rows):
    docs = documents(spark, rows).withColumn("n_words", F.lit("clash"))
    found = perplexity.judge(docs, order=3).collect()
    assert len(found) == len(rows) and "lang" in found[0].asDict()
    models = {g: KneserNey([t for _, t, h, _ in rows if (h or "") == (g or "") and t], 3) for g in ("en", None, "xx", "zh")}
    for r in found:
        assert tuple(r[c] for c in perplexity._STATISTICS) == statistics(r["text"])
        n = r["n_words"]
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        if r["text"]:
            assert math.log(r["perplexity"]) == pytest.approx(models[r["lang"]].bits(r["text"]), rel=1e-5)
        else:
            assert r["perplexity"] is None
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in found}
    assert verdict[106] == (False, False)  # gibberish lies above the band
    assert all(verdict[i] == (False, True) for i in range(40)) and verdict[105] == (False, True)
    assert not any(verdict[i][1] for i in (100, 101, 102, 103, 104, 107))


def test_routing_through_shards_gives_the_same(spark, rows, monkeypatch):
    docs = documents(spark, rows)
    columns = ("doc_id", "perplexity", "deviation", "kept", *perplexity._STATISTICS)
    whole = rows_of(perplexity.judge(docs), *columns)
    monkeypatch.setattr(perplexity, "BROADCAST_NGRAMS", 0)
    monkeypatch.setattr(perplexity, "SLICE_BYTES", 2000)
    monkeypatch.setattr(perplexity, "HELD_NGRAMS", 100)
    monkeypatch.setattr(perplexity, "PROBE_BYTES", 64)
    assert rows_of(perplexity.judge(docs.repartition(5)), *columns) == whole


def test_empty_table(spark):
    assert perplexity.judge(documents(spark, [])).collect() == []


@pytest.mark.parametrize("near", [False, True])
def test_copies_of_one_document_do_not_set_the_band(spark, near):
    texts = prose(60, seed=4, words=80)
    copy = texts[0].split()
    copies = [" ".join(copy[: 20 + i] + ["tur"] * near + copy[20 + i :]) for i in range(60)]
    short = [(300 + i, "too short", "en", None) for i in range(50)]  # the copies are a third of all rows
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(100 + i, t, "en", None) for i, t in enumerate(copies)]
    found = {r["doc_id"]: r["kept"] for r in perplexity.judge(documents(spark, rows + short)).collect()}
    assert all(found[i] for i in range(1, 60))


def test_given_texts_and_broken_ones(spark):
    """Good texts of the given documents stay; texts with their letters shuffled inside words go.

    These are few beside the good ones of their language: a model that saw many of them would know them.
    """
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    rng = random.Random(5)
    rows = good.where("length(text) > 600 and lang = 'en'").orderBy("doc_id").limit(20).collect()
    mixed = lambda w: "".join(rng.sample(w, len(w)))
    broken = [(-1 - r.doc_id, re.sub(r"\S+", lambda m: mixed(m[0]), r.text), r.lang) for r in rows]
    found = perplexity.judge(docs.unionByName(spark.createDataFrame(broken, docs.schema)), keep=["doc_id"])
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in found.collect()}
    stays = [verdict[r.doc_id] for r in good.select("doc_id").collect()]
    sound = [kept for failed, kept in stays if not failed]
    assert sum(sound) >= 0.98 * len(sound) > 100
    goes = [verdict[i] for i, _, _ in broken]
    assert sum(not kept for _, kept in goes) >= 0.95 * len(goes)


def test_bands_are_narrower_for_longer_texts(spark):
    rng = random.Random(2)
    good = lambda n: " ".join(rng.choice(["kalo", "mitur", "vesan", "orshi", "lomi", "turka"]) for _ in range(n))
    rows = [(i, good(rng.choice([60, 120, 400])), "xx", None) for i in range(200)]
    odd = lambda n: good(n).replace("vesan", "vseaq", max(1, n // 40))
    rows += [(1000, odd(60), "xx", None), (1001, odd(4000), "xx", None)]
    found = {r["doc_id"]: r["deviation"] for r in perplexity.judge(documents(spark, rows)).collect()}
    assert found[1001] > 2 * abs(found[1000])
