"""Line dedup by a sharded minimal perfect hash.

The first pass counts the documents of every distinct line key. Keys found often enough go into an
index: shards of bounded size, each a minimal perfect hash with arrays of fingerprints, document
counts and owners (the largest doc_id that holds the key). In the second pass the documents probe
these arrays: each task sends the line hashes of a slice of documents to a shard as one compact row,
the shard answers for all of them at once, and only lines to be dropped come back. Line texts are
never joined or shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobmeter.llm import words
from jobmeter.llm.tables import batch, bounded_batches, col, ordered, packed, tidy, unpacked
from jobmeter.session import materialize

KEYS_PER_SHARD = 1 << 18
PROBES_PER_GROUP = 1 << 20
LINES_PER_ROW = 64  # of a shard, in one row of probes
HELD_LINES = 1 << 20  # lines that a task gathers at most
NO_ID = -(2**63)  # stands for a null doc_id; below every other


class PerfectHash:
    """Minimal perfect hash of pairs of 64-bit values: bitmaps of levels, ranks by counting bits.

    At each level every remaining key picks a bit; keys alone on their bit are placed there, the
    others go on to the next level. A key's index is the number of set bits before its own.
    """

    SLACK = 2

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.levels: list[tuple[int, bytes]] = []
        while len(first):
            size = self.SLACK * len(first) + 1
            place = self._place(first, second, size, len(self.levels))
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((size, np.packbits(alone).tobytes()))
            left = ~alone[place]
            first, second = first[left], second[left]

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, size: int, level: int) -> np.ndarray:
        return (words.mix(first + words.seeded(second, level)) % np.uint64(size)).astype(np.int64)

    def index(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of every key, -1 for some pairs that are none; others that are none get any index."""
        found = np.full(len(first), -1, np.int64)
        open_, before = np.arange(len(first)), 0
        for level, (size, bits) in enumerate(self.levels):
            bitmap = np.unpackbits(np.frombuffer(bits, np.uint8), count=size)
            place = self._place(first[open_], second[open_], size, level)
            rank = np.cumsum(bitmap, dtype=np.int64)
            hit = bitmap[place] == 1
            found[open_[hit]] = before + rank[place[hit]] - 1
            before += int(rank[-1])
            open_ = open_[~hit]
        return found


def _long_lines(
    column: pa.Array, least: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line number, two hashes) of every line whose key has at least ``least`` code points."""
    for first, data, bounds in words.slices(column):
        found = words.lines(data, bounds)
        start, end = words.strip(data, found)
        number = np.arange(len(found.row)) - np.searchsorted(found.row, found.row)
        long_ = words.code_points(data, start, end) >= least
        start, end = start[long_], end[long_]
        yield (
            first + found.row[long_],
            number[long_],
            words.span_hashes(data, start, end, lower=True, which=0),
            words.span_hashes(data, start, end, lower=True, which=1),
        )


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"h1": pa.int64(), "h2": pa.int64(), "id": pa.int64()}
        for rows in batches:
            ids = rows["id"].to_numpy()
            for row, _, h1, h2 in _long_lines(rows["text"], least):
                order = np.lexsort((h2, h1, row))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                yield batch(
                    {"h1": h1[new].view(np.int64), "h2": h2[new].view(np.int64), "id": ids[row[new]]},
                    kinds,
                )

    return run


def _probes(least: int, shards: int, waves: int):
    """Lines by shard, one row a shard; slices are gathered until a row holds ``LINES_PER_ROW`` on average."""
    names = ("h1", "h2", "id", "digest", "line")
    enough = min(LINES_PER_ROW * shards, HELD_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"shard": pa.int32(), "wave": pa.int32()} | {c: pa.binary() for c in names}
        turn = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            nonlocal turn
            h1, *rest = (np.concatenate(x) for x in zip(*held))
            held.clear()
            shard = (h1 % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[s] : cuts[s + 1]] for s in used]
            out = {"shard": used, "wave": np.full(len(used), turn % waves)}
            turn += 1
            return batch(out | {c: [v[p].tobytes() for p in parts] for c, v in zip(names, (h1, *rest))}, kinds)

        for rows in batches:
            ids, digests = rows["id"].to_numpy(), rows["digest"].to_numpy()
            for row, line, h1, h2 in _long_lines(rows["text"], least):
                held.append((h1, h2, ids[row], digests[row], line.astype(np.int32)))
                if sum(len(part[0]) for part in held) >= enough:
                    yield flush()
        if held:
            yield flush()

    return run


def _build(group: pd.DataFrame) -> pd.DataFrame:
    h1 = group["h1"].to_numpy().view(np.uint64)
    h2 = group["h2"].to_numpy().view(np.uint64)
    table = PerfectHash(h1, h2)
    order = np.empty(len(h1), np.int64)
    order[table.index(h1, h2)] = np.arange(len(h1))
    return pd.DataFrame(
        {
            "shard": [group["shard"].iloc[0]],
            "levels": [pickle.dumps(table.levels)],
            "fingerprint": [h2[order].tobytes()],
            "docs": [group["docs"].to_numpy()[order].tobytes()],
            "owner": [group["owner"].to_numpy()[order].tobytes()],
        }
    )


def line_index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, levels, fingerprint, docs, owner): one row of arrays per shard of the keys."""
    shard = F.expr(f"int(pmod(pmod(h1, {shards}) + if(h1 < 0, {2**64 % shards}, 0), {shards}))")
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(
        _build, "shard int, levels binary, fingerprint binary, docs binary, owner binary"
    )


def _answer(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """(id, digest, line) of the probed lines that go."""
    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(probes[name]), kind)

    out = {"id": np.zeros(0, np.int64), "digest": np.zeros(0, np.int64), "line": np.zeros(0, np.int32)}
    if len(probes) and len(index):
        shard = index.iloc[0]
        table = PerfectHash.__new__(PerfectHash)
        table.levels = pickle.loads(shard["levels"])
        fingerprint = np.frombuffer(shard["fingerprint"], np.uint64)
        owner = np.frombuffer(shard["owner"], np.int64)
        h1, h2, ids = joined("h1", np.uint64), joined("h2", np.uint64), joined("id", np.int64)
        place = table.index(h1, h2)
        goes = (place >= 0) & (fingerprint[place] == h2) & (owner[place] != ids)
        out = {"id": ids[goes], "digest": joined("digest", np.int64)[goes],
               "line": joined("line", np.int32)[goes]}
    return pd.DataFrame(out)


def drop_repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 5,
    min_chars: int = 40,
) -> DataFrame:
    """Every row of ``docs`` with repeated lines taken out of ``text``, and n_lines, n_dropped.

    Lines end at ``\\n``. A line's key is the line without white space at both ends, A-Z in lower
    case. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines except those of the largest doc_id that holds them (all its lines of that key).

    Null or empty text is one empty line and becomes empty text. Each row is a document: repeated
    rows count one by one, and all rows of the owner's doc_id keep the line. A null doc_id is below
    every other. ``n_lines`` and ``n_dropped`` replace columns of the same name; other columns pass
    through. An empty table gives an empty table. Keys are compared by 128 bits of hash.
    """
    narrow = bounded_batches(docs).select(
        F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(col(text)).alias("digest"),
        col(text).cast("string").alias("text"),
    )
    seen = Observation()
    counted = (
        narrow.select("id", "text")
        .mapInArrow(tidy(_occurrences(min_chars)), "h1 long, h2 long, id long")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("owner"))
        .observe(seen, F.sum("docs").alias("lines"), F.count_if(F.col("docs") >= min_docs).alias("keys"))
    )
    keys = materialize(counted.where(F.col("docs") >= min_docs), "line-keys")
    found = seen.get
    shards = max(8, -(-(found["keys"] or 0) // KEYS_PER_SHARD))
    waves = -(-(found["lines"] or 1) // (shards * PROBES_PER_GROUP))
    index = materialize(line_index(keys, shards), "line-index")
    probes = narrow.mapInArrow(
        tidy(_probes(min_chars, shards, waves)),
        "shard int, wave int, h1 binary, h2 binary, id binary, digest binary, line binary",
    )
    each_wave = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    gone = (
        probes.groupBy("shard", "wave")
        .cogroup(each_wave.groupBy("shard", "wave"))
        .applyInPandas(_answer, "id long, digest long, line int")
        .groupBy("id", "digest")
        .agg(F.collect_set("line").alias("gone"))
    )
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone"))
    carry = [c for c in docs.columns if c != text]
    joined = (
        packed(
            docs,
            carry,
            id=F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)),
            digest=F.xxhash64(col(text)),
            text=col(text).cast("string"),
            n_lines=(F.length(col(text)) - F.length(F.replace(col(text), F.lit("\n"), F.lit("")))),
        )
        .withColumn("n_lines", F.coalesce(F.col("n_lines"), F.lit(0)) + 1)
        .join(gone, ["id", "digest"], "left")
    )
    done = unpacked(
        joined,
        carry,
        {
            text: F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
            ),
            "n_lines": F.col("n_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        },
    )
    return ordered(done, docs.columns, "n_lines", "n_dropped")
