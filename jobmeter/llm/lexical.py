"""Ranked lexical search by scanning the documents with an automaton of all item terms.

There is no index of the documents. The terms of the items, each between two separators, form an
Aho-Corasick automaton; a text in which every other character is a separator goes through it once
and each output is one occurrence of a whole term. A first scan counts the documents, their terms
and the documents that hold each item term; a second one scores every document for every item that
shares a term with it and keeps the best documents of each task. Only those are shuffled.

Items meet the documents in blocks of bounded size: an automaton is broadcast, and its size follows
from the block and not from the table of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm import words
from jobmeter.llm.tables import batch, bounded_batches, col
from jobmeter.session import materialize

K1_MILLI, B_PERCENT = 8, 75
BLOCK_BYTES = 1 << 20  # item texts of one automaton; a longer item is a block of its own
BLOCK_ITEMS = 4096
CELLS = 2 << 20  # scores of (document, item) held at once
NO_ID = 2**63 - 1

#: Bytes to themselves, A-Z to a-z, all other ASCII characters than 0-9 and a-z to a blank.
_FOLD = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _FOLD[_first : _last + 1] = np.arange(_first, _last + 1)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(text: str | None) -> list[str]:
    """The terms of a text in order, as strings of one character per UTF-8 byte."""
    return [t.decode("latin-1") for t in (text or "").encode().translate(_FOLD.tobytes()).split()]


@dataclass(frozen=True)
class Items:
    """The distinct terms of a block of items, and for each term the items that hold it, with repeats."""

    names: tuple[str, ...]
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        held: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for name, times in Counter(terms(text)).items():
                held.setdefault(name, []).append((i, times))
        pairs = np.array([p for h in held.values() for p in h], np.int64).reshape(-1, 2)
        first = np.concatenate([[0], np.cumsum([len(h) for h in held.values()], dtype=np.int64)])
        return cls(tuple(held), first.astype(np.int64), pairs[:, 0], pairs[:, 1], len(texts))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds each term that stands between two blanks; built once in a worker."""
        found = ahocorasick.Automaton()
        for number, name in enumerate(self.names):
            found.add_word(f" {name} ", number)
        found.make_automaton()
        return found


def _counted(items: Items, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each row, row, term, occurrences) of whole texts, slice by slice."""
    scan, number = (items.automaton.iter if items.names else lambda text: ()), itemgetter(1)
    for first, data, bounds in words.slices(column):
        folded = _FOLD[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = folded != 0x20
        before = inside[:-1].copy()
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        starts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside[1:] & ~before, out=starts[1:])
        raw = folded.tobytes()
        found = [
            Counter(map(number, scan(f" {raw[a:b].decode('latin-1')} ")))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
        ]
        row = np.repeat(np.arange(len(found)), [len(c) for c in found])
        term = np.array([t for c in found for t in c], np.int64)
        times = np.array([t for c in found for t in c.values()], np.int64)
        yield first, np.diff(starts[bounds]), row, term, times


def _statistics(items_: object):
    """Per task: (term, documents that hold it); -1 counts documents with a term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_.value
        held, some, total = np.zeros(len(items.names), np.int64), 0, 0
        for given in batches:
            for _, n, _, term, _ in _counted(items, given["text"]):
                held += np.bincount(term, minlength=len(held))
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        known = np.flatnonzero(held)
        yield batch(
            {"term": np.concatenate([known, [-1, -2]]), "n": np.concatenate([held[known], [some, total]])},
            {"term": pa.int64(), "n": pa.int64()},
        )

    return run


@dataclass
class Best:
    """The ``k`` best (score, id) of every item so far; ties go to the smaller id."""

    items: int
    k: int

    def __post_init__(self) -> None:
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(self.items, np.int64)  # a score below this cannot enter

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer a matrix of scores (document, item)."""
        if len(ids) > self.k:
            bar = np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k]
            self.least = np.maximum(self.least, bar)
        doc, item = np.nonzero(score >= self.least)
        if not len(doc):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, score[doc, item[len(self.item) :]]])
        ids = np.concatenate([self.id, ids[doc]])
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = place < self.k
        self.item, self.score, self.id = item[keep], score[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _ranked(items_: object, weight_: object, documents: int, total: int, k: int):
    """Per task: the ``k`` best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = items_.value, weight_.value
        best = Best(items.size, k)
        spread = np.diff(items.first)
        for given in batches:
            ids = given["id"].to_numpy(zero_copy_only=False)
            for first, n, row, term, times in _counted(items, given["text"]):
                m = 100 - B_PERCENT + (B_PERCENT * n * documents) // total
                value = weight[term] * ((1_000_000_000 * times) // (1000 * times + K1_MILLI * m[row]))
                here = np.searchsorted(row, np.arange(len(n) + 1))
                rows = max(1, CELLS // items.size)
                for a in range(0, len(n), rows):
                    b = min(a + rows, len(n))
                    part = slice(here[a], here[b])
                    wide = spread[term[part]]
                    at = np.repeat(np.arange(here[a], here[b]), wide)
                    step = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                    posting = items.first[term[at]] + step
                    score = np.zeros((b - a) * items.size, np.int64)
                    np.add.at(score, (row[at] - a) * items.size + items.item[posting], value[at] * items.times[posting])
                    best.add(score.reshape(b - a, items.size), ids[first + a : first + b])
        yield batch(
            {"item": best.item, "id": best.id, "score": best.score},
            {"item": pa.int64(), "id": pa.int64(), "score": pa.int64()},
        )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. Scores
    are a BM25 in whole numbers over all documents. Equal scores rank by the smaller doc_id; documents
    without doc_id come last among them, and repeated rows are documents of their own. Null texts have
    no term and count nowhere. Equal items (id and text) are one; different texts under one id are
    ranked apart and share the id. Items without a term, or with none that a document holds, have no
    row; so an empty table on either side gives an empty one. Other columns take no part.

    ``block_bytes`` bounds the item texts that are broadcast at once; documents are scanned twice for
    each block, so the result does not depend on it.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(
        F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), col(text).cast("string").alias("text")
    )
    asked = items.select(col(item_id).alias("item_id"), col(item_text).cast("string").alias("text")).distinct()
    asked = materialize(asked.where("text is not null"), "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = 1 + max(size["bytes"] // block_bytes, size["n"] // BLOCK_ITEMS)
    placed = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    results = []
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).select("item_id", "text").collect()
        table = Items.of([r["text"] for r in rows])
        if not table.names:
            continue
        items_ = spark.sparkContext.broadcast(table)
        counts = texts.select("text").mapInArrow(_statistics(items_), "term long, n long")
        counted = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counted.get(-1, 0), counted.get(-2, 0)
        if n:
            weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(table.names))]
            weight_ = spark.sparkContext.broadcast(np.array(weight, np.int64))
            best = texts.mapInArrow(_ranked(items_, weight_, n, total, k), "item long, id long, score long")
            order = W.partitionBy("item").orderBy(F.desc("score"), "id")
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
            results.append(materialize(best.join(F.broadcast(names), "item").drop("item"), "ranked"))
            weight_.unpersist()
        items_.unpersist()
    empty = f"id long, score long, rank int, item_id {kind}"
    found = reduce(DataFrame.unionByName, results, spark.createDataFrame([], empty))
    return found.select(
        "item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score"
    )
