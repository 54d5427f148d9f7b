import random

from pyspark.sql import functions as F

from jobmeter.llm import language, queries
from tests.conftest import SF_DIR
from tests.llm.tables import documents, rows_of


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(2)
    for _ in range(60):
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 40)))
        steps = language.suffix_automaton(text)

        def accepts(s):
            state = 0
            for c in s:
                if c not in steps[state]:
                    return False
                state = steps[state][c]
            return True

        for _ in range(60):
            s = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 6)))
            assert accepts(s) == (s in text)


def greedy_phrases(sample, text):
    """Longest matches from left to right; a byte that the sample lacks is a phrase of its own."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_are_greedy_longest_matches(monkeypatch):
    rng = random.Random(5)
    word = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    samples = {"x": word(b"abcd ", 300), "y": word(b"cdef ", 200)}
    model = language.compile_model(samples)
    texts = [word(b"abcdefz ", rng.randint(0, 80)) for _ in range(50)]
    found = language.phrases(model, texts)
    for text, row in zip(texts, found):
        assert row.tolist() == [greedy_phrases(samples[g], text) for g in ("x", "y")]
    monkeypatch.setattr(language, "SEGMENT", 16)
    cut = language.phrases(model, texts)
    for text, row in zip(texts, cut):
        parts = [text[i : i + 16] for i in range(0, len(text), 16)]
        assert row.tolist() == [sum(greedy_phrases(samples[g], p) for p in parts) for g in ("x", "y")]


def test_letters():
    assert language.letters("Ab, 1c--Éß\n") == "ab c éß".encode()
    assert language.letters("12 %́") == b"" and language.letters("") == b""


def test_edges(spark):
    train = [(i, t, g, None) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("12", "xx"), (None, "en"), ("le chat", None)] * 3)]
    model = language.train(documents(spark, train))
    assert model.languages == ("de", "en")
    rows = [(1, "the dog", None, None), (2, "die katze " * 30_000, "en", None), (3, None, None, None), (4, "", None, None), (5, "123 !?", None, None), (1, "the dog", None, None), (6, "ωωω", None, None)]
    docs = documents(spark, rows).withColumn("score", F.lit("clash"))
    found = language.identify(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.columns.count("score") == 1
    assert rows_of(found, "doc_id", "lang_pred") == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en" if model.bits[1] < model.bits[0] else "de")]
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    nothing = language.train(documents(spark, []))
    assert rows_of(language.identify(docs, nothing), "lang_pred") == [("und",)] * 7
    assert language.identify(documents(spark, []), model).collect() == []


def test_sample_is_bounded_and_stable(spark):
    rows = [(i, f"text {'abcdefghij'[i % 10] * (i % 7)} again", "en", None) for i in range(500)]
    one = language.train(documents(spark, rows), sample_docs=5, sample_bytes=60)
    two = language.train(documents(spark, rows[::-1]).repartition(7), sample_docs=5, sample_bytes=60)
    assert (one.table == two.table).all() and len(one.table) <= 2 * 60 * len(set(one.classes.tolist()))


def test_held_out_accuracy(spark):
    found = queries.op1_language(spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count() > 0
    assert found.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_rows_outside_training_are_not_read(spark):
    docs = documents(spark, [(1, "some text", "en", None)])
    assert language.train(docs, where=F.lit(False)).languages == ()


def test_any_number_of_languages(monkeypatch):
    rng = random.Random(6)
    samples = {f"l{i:03}": bytes(rng.choice(b"abcdefgh ") for _ in range(400)) for i in range(150)}
    whole = language.compile_model(samples)
    monkeypatch.setattr(language, "TABLE_STEPS", 60_000)
    cut = language.compile_model(samples)
    assert cut.languages == whole.languages and len(cut.table) <= 60_000 < len(whole.table)
    text = samples["l007"][:20]
    assert language.phrases(cut, [text])[0].argmin() == 7


def test_excerpts_begin_at_the_first_letter_and_copies_count_once(spark):
    rows = [(1, "0" * 1000 + " der hund und die katze im garten", "de", None)]
    rows += [(10 + i, "the very same opening of all these texts " * 12 + f"and tail {i}", "en", None) for i in range(30)]
    rows += [(50, "another english text about something else", "en", None)]
    model = language.train(documents(spark, rows), sample_docs=2)
    assert model.languages == ("de", "en")
    found = language.identify(documents(spark, [(1, "die katze", None, None), (2, "something else", None, None)]), model)
    assert rows_of(found, "doc_id", "lang_pred") == [(1, "de"), (2, "en")]
