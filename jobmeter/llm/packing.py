"""Cost-balanced packing of documents into training sequences.

Packing needs no shuffle. Each task tokenizes its rows and packs them in groups of bounded size. A
document's full blocks are sequences of their own. The rests of a group's documents are dealt, the
longest first, to the sequence of the lowest cost so far that has room, where a piece of n tokens
costs ``linear * n + quadratic * n * n`` (attention stays inside a document). A rest that does not
fit is cut. A group's sequences hold exactly its tokens: full ones, and for what is left over ones
whose lengths are different powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.tables import batch, bounded_batches, col, tidy

LENGTH = 2048
END = 1
GROUP_TOKENS = 1 << 21
PIECES = {
    "row": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
}


def default_vocabulary() -> tuple[str, str, str]:
    """(tokenizer file, the same vocabulary as ranks, its word pattern) of the public byte-level BPE."""
    import public_tokenizers

    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Tokens:
    """Token ids as the tokenizer file gives them.

    The ranks file holds the same vocabulary for a faster encoder with the same ids. Only texts that
    spell out a special token go through the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
        with open(tokenizer, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.tokenizer = tokenizer

    @cached_property
    def full(self) -> object:
        """The tokenizer itself; it takes far more memory than the ranks and is seldom needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def __call__(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def deal(
    sizes: list[int], length: int, linear: float, quadratic: float
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """[(document, start, length, sequence, offset)] of documents of up to ``length`` tokens, and the
    number of sequences."""
    total = sum(sizes)
    room = [length] * (total // length)
    room += [1 << k for k in range(length.bit_length(), -1, -1) if (total % length) >> k & 1]
    capacity = list(room)
    # Short sequences come after all full ones, so that they take the ends of documents.
    sequences = [(capacity[s] < length, 0.0, s) for s in range(len(room))]
    heapq.heapify(sequences)
    waiting = [(-n, d, 0) for d, n in enumerate(sizes)]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        size, d, start = heapq.heappop(waiting)
        short, cost, s = heapq.heappop(sequences)
        n = min(-size, room[s])
        pieces.append((d, start, n, s, capacity[s] - room[s]))
        room[s] -= n
        if room[s]:
            heapq.heappush(sequences, (short, cost + linear * n + quadratic * n * n, s))
        if n < -size:
            heapq.heappush(waiting, (size + n, d, start + n))
    return pieces, len(room)


def _pack(files: tuple[str, str, str] | None, length: int, end: int, linear: float, quadratic: float, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(*(files or default_vocabulary()))  # for this task only: it takes 100 MB and more
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray, int]] = []  # id, rest of the ids, tokens of the document

        def written(ids: pa.Array, pieces: list[tuple]) -> pa.RecordBatch:
            row, *values = zip(*pieces)
            arrays = {"doc_id": ids.take(pa.array(row, pa.int32()))}
            kinds = {"doc_id": ids.type} | {k: v for k, v in PIECES.items() if k != "row"}
            return batch(arrays | dict(zip(list(PIECES)[1:], values)), kinds)

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            dealt, used = deal([len(rest) for _, rest, _ in held], length, linear, quadratic)
            pieces = [
                (d, held[d][2] - len(held[d][1]) + start, n, held[d][1][start : start + n].tobytes(),
                 held[d][2], sequence + s, offset)
                for d, start, n, s, offset in dealt
            ]
            sequence += used
            out = written(pa.array([i for i, _, _ in held], kind), pieces)
            held.clear()
            return out

        size = 0
        for given in batches:
            kind = given["id"].type
            names = given["id"].to_pylist()
            for i, text in enumerate(given["text"]):
                ids = np.array([*encode(text.as_py() or ""), end], np.uint32)
                full = len(ids) // length * length
                if full:
                    blocks = range(0, full, length)
                    yield written(
                        given["id"],
                        [(i, a, length, ids[a : a + length].tobytes(), len(ids), sequence + k, 0)
                         for k, a in enumerate(blocks)],
                    )
                    sequence += len(blocks)
                if full < len(ids):
                    held.append((names[i], ids[full:].copy(), len(ids)))
                    size += len(ids) - full
                if size >= group:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    files: tuple[str, str, str] | None = None,
    length: int = LENGTH,
    end: int = END,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents.

    ``ids`` are the piece's token ids as unsigned little-endian 32-bit numbers; ``start`` counts the
    document's ids before it, ``doc_tokens`` all its ids with the end id, and ``offset`` the ids
    before it in its sequence. Pieces of a sequence leave no gap. ``files`` names the tokenizer file,
    its ranks and its pattern; ``length`` must be a power of two.

    Null or empty text is the end id alone. Repeated rows are documents of their own, and so their
    pieces stand in different places. A null doc_id stays null. The same input files and split sizes
    give the same sequences. Extra columns are not read. An empty table gives an empty table.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded_batches(docs).select(col(doc_id).alias("id"), col(text).cast("string").alias("text")).mapInArrow(
        tidy(_pack(files, length, end, linear, quadratic, group_tokens)),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
