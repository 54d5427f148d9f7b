"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled sample text knows all substrings of the sample. A
text is parsed against it greedily: from each position the longest match in the sample is one phrase.
Text of the same language falls into few long phrases. Phrases cost about log2(sample length) bits
each, so phrases times that number compare languages whose samples differ in length; the language
with the lowest cost wins.

Training reads a bounded sample: ``SAMPLE_DOCS`` excerpts and ``SAMPLE_BYTES`` bytes a language. The
automata become one transition table, where a step that ends a phrase counts it and leads on from the
start state, so that parsing is table lookups: numpy walks all segments of a batch of texts at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm.tables import batch, bounded_batches, col, ordered, packed, tidy, unpacked
from jobmeter.operators.lookups import small_side

UNDETERMINED = "und"
SAMPLE_DOCS = 96
SAMPLE_CHARS = 400
SAMPLE_BYTES = 32_768
TABLE_STEPS = 1 << 25  # entries of the transition table, 128 MB; with many languages samples are shorter
SEGMENT = 1024  # bytes parsed in one go; a phrase ends where a segment ends
_BLANK = 0x20
_END = 1 << 30  # a step holds where it leads, plus this times the phrases that it ends


@lru_cache(maxsize=1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case letter or mark, else a blank; and whether it is a letter."""
    table = np.full(sys.maxunicode + 1, _BLANK, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            lower = chr(c).lower()
            table[c] = ord(lower) if len(lower) == 1 else c
            letter[c] = kind == "L"
    return table, letter


def letters(text: str) -> bytes:
    """Lower-case letters in UTF-8; each run of anything else is one blank. Empty without a letter."""
    table, letter = _folded()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not letter[points].any():
        return b""
    folded = table[points]
    blank = folded == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return folded[keep].tobytes().decode("utf-32-le").strip().encode()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``text``; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return step


@dataclass(frozen=True)
class Model:
    """Languages in order, classes of bytes, one transition table, start states, bits of a phrase."""

    languages: tuple[str, ...]
    classes: np.ndarray
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray


def compile_model(samples: dict[str, bytes]) -> Model:
    """The parsing tables of all languages with a sample that is not empty.

    Where the languages are so many that the table would pass ``TABLE_STEPS``, all samples are cut to
    one length (an automaton has at most two states a byte).
    """
    samples = {name: text for name, text in sorted(samples.items()) if text}
    used = sorted({c for text in samples.values() for c in text})
    fits = max(1, TABLE_STEPS // (2 * (len(used) + 1) * max(1, len(samples))) - 1)
    samples = {name: text[:fits] for name, text in samples.items()}
    classes = np.zeros(256, np.int64)  # class 0: a byte that no sample has
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    tables, starts, states = [], [], 0
    for text in samples.values():
        automaton = suffix_automaton(text)
        first = np.zeros(width, np.int64)  # where a phrase goes that begins with a byte of the class
        for c, target in automaton[0].items():
            first[classes[c]] = target
        # A byte that the sample lacks ends the phrase before it and is a phrase of its own.
        table = np.tile((first + states) * width + _END * np.where(first > 0, 1, 2), (len(automaton), 1))
        table[0] = states * width + _END
        for s, steps in enumerate(automaton):
            for c, target in steps.items():
                table[s, classes[c]] = (target + states) * width
        tables.append(table.reshape(-1).astype(np.uint32))
        starts.append(states * width)
        states += len(automaton)
    return Model(
        tuple(samples),
        classes,
        np.concatenate(tables) if tables else np.zeros(0, np.uint32),
        np.array(starts, np.int64),
        np.array([np.log2(len(text) + 1) for text in samples.values()]),
    )


def phrases(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages) numbers of phrases."""
    n = len(model.languages)
    count = np.zeros((len(texts), n), np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(data) or not n:
        return count
    pieces = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(texts)), pieces)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(lengths) - lengths)[row] + turn * SEGMENT
    size = np.minimum(SEGMENT, lengths[row] - turn * SEGMENT)
    order = np.argsort(-size, kind="stable")
    row, start, size = row[order], start[order], size[order]
    code = model.classes[data]
    state = np.repeat(model.starts[:, None], len(row), axis=1)
    ended = np.zeros((n, len(row)), np.int32)
    alive = len(row) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    for t in range(int(size[0])):
        live = alive[t]
        step = model.table[state[:, :live] + code[start[:live] + t]]
        ended[:, :live] += (step >> np.uint32(30)).astype(np.int32)
        state[:, :live] = step & np.uint32(_END - 1)
    open_ = state != model.starts[:, None]  # the phrase that a segment ends in
    np.add.at(count, row, (ended + open_).T)
    return count


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    where: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """A model from the rows that satisfy ``where`` and have a language and a letter.

    An excerpt begins at a text's first letter and has ``sample_chars`` characters. Of each language
    the ``sample_docs`` excerpts with the smallest hashes are read, and at most ``sample_bytes`` bytes
    in all. The sample does not grow with the corpus. Excerpts whose letters agree count once, so
    neither copies nor a shared opening fill the sample.
    """
    rows = docs if where is None else docs.where(where)
    excerpt = F.regexp_extract(col(text), rf"(?s)\p{{L}}.{{0,{sample_chars - 1}}}", 0)
    labelled = (
        rows.select(col(lang).cast("string").alias("lang"), excerpt.alias("text"))
        .where(F.col("lang").isNotNull() & (F.col("text") != ""))
        .withColumn("hash", F.xxhash64(F.lower(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " "))))
    )
    # Keys first, and in two steps: a language may hold most of the corpus.
    keys = labelled.select("lang", "hash").distinct()
    for group in (["lang", F.pmod("hash", F.lit(16))], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*group).orderBy("hash"))
        keys = keys.withColumn("rank", rank).where(F.col("rank") <= sample_docs)
    sample = labelled.join(small_side(keys), ["lang", "hash"]).groupBy("lang", "rank").agg(
        F.min("text").alias("text")
    )
    samples: dict[str, bytes] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["rank"])):
        joined = samples.get(row["lang"], b"") + b" " + letters(row["text"])
        samples[row["lang"]] = joined[:sample_bytes]
    return compile_model(samples)


def _predict(model_: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_.value
        kinds = {"lang_pred": pa.string(), "score": pa.float64()}
        bytes_at_once = 1 << 21
        for given in batches:
            names: list[str] = []
            scores: list[float] = []
            held: list[bytes] = []
            size = 0

            def flush() -> None:
                cost = phrases(model, held) * model.bits
                for text, row in zip(held, cost):
                    if not text or not len(row):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    best = int(row.argmin())
                    others = np.delete(row, best)
                    names.append(model.languages[best])
                    scores.append(float(1 - row[best] / others.min()) if len(others) else 1.0)
                held.clear()

            for text in given["text"]:
                value = letters(text.as_py() or "")
                held.append(value)
                size += len(value)
                if size >= bytes_at_once:
                    flush()
                    size = 0
            flush()
            out = batch({"lang_pred": names, "score": scores}, kinds)
            rest = [given.schema.field(c) for c in ("text", "row")]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, given["text"], given["row"]], schema=pa.schema([*out.schema, *rest])
            )

    return run


def identify(
    docs: DataFrame, model: Model, *, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with lang_pred and score; they replace columns of the same name.

    ``lang_pred`` is the language with the lowest parsing cost over the whole text, the first by name
    among equals; ``score`` is the relative distance to the second (0 at a tie, 1 if the model has
    one language only). Null text, text without a letter, and any text if the model is empty give
    ``und`` with score 0. Repeated rows get equal results; other columns pass through (``keep`` names
    those that do, where not all are wanted).
    """
    spark = docs.sparkSession
    # Bounded by languages * SAMPLE_BYTES * 2 states * classes * 4 bytes, whatever the corpus.
    model_ = spark.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else list(keep)
    carry = [c for c in kept if c != text]
    keyed = packed(bounded_batches(docs), carry, text=col(text).cast("string"))
    kind = keyed.schema["row"].dataType.simpleString()
    found = keyed.mapInArrow(tidy(_predict(model_)), f"lang_pred string, score double, text string, row {kind}")
    results = {"lang_pred": F.col("lang_pred"), "score": F.col("score")}
    own = {text: F.col("text")} if text in kept else {}
    return ordered(unpacked(found, carry, own | results), [c for c in kept if c not in results], *results)
