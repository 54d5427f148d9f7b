"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketches follow Dahlgaard, Knudsen and Thorup (FOCS 2017): in round i each shingle is thrown into a
hashed bin with a hashed value, a bin keeps the smallest value of its first round, and after as many
rounds as bins each bin takes its turn to look at all shingles. Every coordinate is filled, and the
share of equal coordinates of two documents is concentrated around their similarity.

Documents with equal shingle sets collapse to one node first. Nodes that share a band form a bucket.
No bucket is expanded into pairs: each member is checked against one hub, then members of different
components are checked where a bound still allows a link. The bound is exact: shingles that occur
in one node alone cannot be shared, so nodes with c shared and u own shingles have a similarity of
at most min(c) / (u1 + u2 + max(c)); and a shingle that falls on a bit which the other node's bitmap
does not have is not shared either. The hub is the member with the smallest share of own shingles,
which leaves little for the second step however large a group of copies is. That step takes both
bounds of whole batches at once in numpy; large buckets are dealt into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.llm import words
from jobmeter.llm.components import components
from jobmeter.llm.tables import batch, bounded_batches, col, packed, tidy, unpacked
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

SHINGLE = 5
BANDS, ROWS = 40, 4  # a pair at similarity 0.75 shares no band with probability 2.5e-7
BINS = BANDS * ROWS
BITMAP = 32  # 64-bit words of a node's bitmap of shingles
BLOCK = 1024  # strays of a bucket, or other members, that are compared in one part
PAIRS = 1 << 16  # pairs that are compared at once
_PART = ["band", "i", "j"]
NO_ID = 2**63 - 1  # stands for a null doc_id; above every other


def sketch(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """(rows, BINS) coordinates of the sets given as (row, value) sorted by row; no row is empty."""
    coordinates = np.zeros((rows, BINS), np.uint64)
    empty = np.ones((rows, BINS), bool)
    flat, free = coordinates.reshape(-1), empty.reshape(-1)
    for turn in range(2 * BINS):
        open_ = empty.any(axis=1)
        if not open_.any():
            break
        keep = open_[row]
        row, value = row[keep], value[keep]
        thrown = words.seeded(value, turn)
        low = thrown & np.uint64(0xFFFFFFFF)
        if turn < BINS:
            bins = ((thrown >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
            slot = row.astype(np.uint64) * np.uint64(BINS) + bins
            vacant = free[slot.astype(np.int64)]
            both = np.sort((slot[vacant] << np.uint64(32)) | low[vacant])
            slot, low = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot, low = slot[first], low[first]
        else:
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            slot = row[starts] * BINS + turn - BINS
            low = np.minimum.reduceat(low, starts)
            slot, low = slot[free[slot]], low[free[slot]]
        flat[slot] = words.mix(low + np.uint64(turn << 32))
        free[slot] = False
    return coordinates


def bands(coordinates: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of the groups of coordinates; equal hashes only within a band."""
    groups = coordinates.reshape(len(coordinates), BANDS, ROWS)
    total = words.seeded(np.arange(BANDS, dtype=np.uint64), 77)[None, :].repeat(len(coordinates), 0)
    for k in range(ROWS):
        total = words.mix(total * np.uint64(0x9FB21C651E98DF25) + groups[:, :, k])
    return total.view(np.int64)


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, shingle) per slice of texts."""
    for first, data, bounds in words.slices(column):
        rows = len(bounds) - 1
        yield first, rows, *words.shingles(words.words(data, bounds, lower=True), rows, SHINGLE)


def _set_ids(value: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each set."""
    sums = [np.add.reduceat(words.seeded(value, 500 + k), starts) for k in range(2)]
    return [x.tobytes() for x in np.stack(sums, axis=1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "n": pa.int64(), "node": pa.binary(), "bands": pa.list_(pa.int64())}
    for given in batches:
        ids = given["id"].to_numpy()
        for first, rows, row, value in _sets(given["text"]):
            n = np.bincount(row, minlength=rows)
            some = np.flatnonzero(n)
            node, lists = [None] * rows, [None] * rows
            if len(some):
                compact = np.searchsorted(some, row)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                keys = bands(sketch(compact, value, len(some)))
                for k, name in enumerate(_set_ids(value, starts)):
                    node[some[k]], lists[some[k]] = name, keys[k]
            yield batch({"id": ids[first : first + rows], "n": n, "node": node, "bands": lists}, kinds)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"node": pa.binary(), "items": pa.binary(), "bits": pa.list_(pa.int64())}
    for given in batches:
        for _, _, row, value in _sets(given["text"]):
            if not len(row):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            parts = np.split(value, starts[1:])
            bits = np.zeros((len(parts), BITMAP * 64), np.uint8)
            bits[np.repeat(np.arange(len(parts)), [len(p) for p in parts]), value % np.uint64(BITMAP * 64)] = 1
            packed_bits = np.packbits(bits, axis=1).view(np.int64)
            yield batch(
                {"node": _set_ids(value, starts), "items": [p.tobytes() for p in parts], "bits": list(packed_bits)},
                kinds,
            )


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of each node; the node as two numbers, which Spark aggregates without sorting."""
    kinds = {"high": pa.int64(), "low": pa.int64(), "item": pa.int64()}
    for given in batches:
        items = given["items"].to_pylist()
        node = np.frombuffer(b"".join(given["node"].to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
        node = np.repeat(node, [len(x) // 8 for x in items], axis=0)
        yield batch({"high": node[:, 0], "low": node[:, 1], "item": np.frombuffer(b"".join(items), np.int64)}, kinds)


def _linked(numerator: int, denominator: int):
    """Keep the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": pa.binary(), "b": pa.binary()}
        for given in batches:
            rows = zip(*(given[c].to_pylist() for c in ("a", "b", "a_items", "b_items")))
            found: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in rows:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    found["a"].append(a)
                    found["b"].append(b)
            yield batch(found, kinds)

    return run


def _possible(x: str, y: str, numerator: int, denominator: int) -> Column:
    """Whether own and shared shingles of two nodes leave room for a link."""
    c, u = (lambda t: F.col(f"{t}_n") - F.col(f"{t}_u")), (lambda t: F.col(f"{t}_u"))
    return denominator * F.least(c(x), c(y)) >= numerator * (u(x) + u(y) + F.greatest(c(x), c(y)))


def _halves(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, 2) words of an Arrow column of 16 bytes a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _pairs_allowed(rows: pa.Table, numerator: int, denominator: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stray, member): rows of one part of a bucket whose bounds leave room for a link.

    ``rows`` hold whole parts, one after another, the strays of each first.
    """
    column = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)
    part = np.stack([column(c) for c in _PART], axis=1)
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(part)])
    strays = np.add.reduceat(column("stray").astype(np.int64), starts)
    members = sizes - strays
    ends = np.cumsum(strays * members)
    n, u, label = column("n"), column("u"), _halves(rows["label"])
    c = n - u
    bits = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for first in range(0, int(ends[-1]), PAIRS):
        k = np.arange(first, min(first + PAIRS, int(ends[-1])))
        at = np.searchsorted(ends, k, "right")
        k -= ends[at] - strays[at] * members[at]
        x, y = starts[at] + k // members[at], starts[at] + strays[at] + k % members[at]
        # Shingles that occur in one node alone are not shared.
        room = denominator * np.minimum(c[x], c[y]) >= numerator * (u[x] + u[y] + np.maximum(c[x], c[y]))
        room &= (label[x] != label[y]).any(axis=1)
        x, y = x[room], y[room]
        # Nor are those on a bit that the other node's bitmap does not have.
        shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        both = np.minimum(n[x] - ones[x], n[y] - ones[y]) + shared
        room = denominator * both >= numerator * (n[x] + n[y] - both)
        yield x[room], y[room]


def _allowed(numerator: int, denominator: int):
    """(x, y): nodes of each stray and member of a bucket that two bounds allow to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for given in batches:
            rows = pa.Table.from_batches([given])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # The last part may go on in the next batch.
            part = [rows[c].combine_chunks().to_numpy() for c in _PART]
            other = np.flatnonzero(np.any([p != p[-1] for p in part], axis=0)) if len(rows) else []
            whole = int(other[-1]) + 1 if len(other) else 0
            yield from found(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None:
            yield from found(rest)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = {"x": pa.binary(), "y": pa.binary()}
        node = rows["node"].combine_chunks() if len(rows) else None
        for x, y in _pairs_allowed(rows, numerator, denominator) if len(rows) else ():
            if len(x):
                yield batch({"x": node.take(pa.array(x)), "y": node.take(pa.array(y))}, kinds)

    return run


def _parts(left: DataFrame) -> DataFrame:
    """The strays of each bucket with the members that they are compared with, dealt into bounded parts.

    A part is a block of a bucket's strays and a block of its other members (``stray`` tells which);
    all but very large buckets are one part.
    """
    sizes = left.groupBy("band").agg(F.count_if("stray").alias("strays"), F.count("*").alias("members")).where("strays > 0")
    blocks = sizes.select(
        "band", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("strays", "members")]
    )
    within = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    fields = ["node", "n", "u", "label"]
    dealt = left.join(blocks, "band")
    strays = dealt.where("stray").select(
        "band", within("strays", 1).alias("i"), every("members").alias("j"), F.lit(True).alias("stray"), *fields
    )
    members = dealt.select(
        "band", every("strays").alias("i"), within("members", 2).alias("j"), F.lit(False).alias("stray"), *fields
    )
    return strays.unionByName(members)


def near_copies(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) for every row of ``docs``.

    Options: the names ``doc_id`` and ``text``; ``numerator`` and ``denominator`` (75 and 100).

    Words are runs of other characters than white space, with A-Z in lower case. A document's set
    holds its distinct runs of five words; with fewer words the whole sequence is its one shingle.
    Documents are linked if denominator * intersection >= numerator * union of their sets, and
    component_id is the smallest doc_id that links reach. ``digest`` is xxhash64 of the text.

    Null or empty text, or white space alone: an empty set, linked with nothing, kept. Each row is
    a document; rows of one doc_id with one text are one and stay or go together. A null doc_id is
    above every other; where a component has no other, component_id is null and the rows are kept.
    An empty table gives an empty table. Extra columns are not read.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _judged(docs, **options).select(
        real("id").alias("doc_id"),
        "digest",
        F.col("n").alias("n_shingles"),
        real("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def _judged(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", numerator: int = 75, denominator: int = 100
) -> DataFrame:
    """(id, digest, n, label, component) of every row; ``label`` tells components apart and is null for empty sets."""
    narrow = bounded_batches(docs).select(
        F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        col(text).cast("string").alias("text"),
    )
    digested = narrow.select("id", F.xxhash64("text").alias("digest"), "text")
    sketches = materialize(
        digested.mapInArrow(tidy(_with_digest(_sketches)), "id long, n long, node binary, bands array<long>, digest long"),
        "sketches",
    )
    # The second key depends on the first: it leaves the table dealt otherwise than the join below
    # deals it, and adaptive execution can then split the node of a large group of copies.
    nodes = materialize(
        sketches.where("node IS NOT NULL")
        .groupBy("node", "n")
        .agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(
        banded.join(materialize(crowded.select("band"), "crowded"), "band"), "buckets"
    )
    near = materialize(shared.select("node").distinct().join(nodes.select("node", "n", "id"), "node"), "near")

    texts = narrow.join(small_side(near.select("id").distinct()), "id", "left_semi")
    sets = texts.select("text").mapInArrow(tidy(_full_sets), "node binary, items binary, bits array<long>")
    sets = materialize(
        sets.join(near.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets"
    )
    own = (
        sets.select("node", "items").mapInArrow(tidy(_items), "high long, low long, item long")
        .groupBy("item")
        .agg(F.count("*").alias("holders"), F.min("high").alias("high"), F.min("low").alias("low"))
        .where("holders = 1")
        .groupBy("high", "low")
        .agg(F.count("*").alias("u"))
    )
    halves = [F.lpad(F.hex(c), 16, "0") for c in ("high", "low")]
    own = own.select(F.unhex(F.concat(*halves)).alias("node"), "u")
    near = materialize(
        near.join(own, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u")), "near"
    )
    known = materialize(shared.join(near, "node"), "buckets")
    hub = materialize(
        known.groupBy("band").agg(
            F.min(F.struct(F.expr("u / n").alias("own"), "node", "n", "u")).alias("hub")
        ).select("band", F.col("hub.node").alias("y"), F.col("hub.n").alias("y_n"), F.col("hub.u").alias("y_u")),
        "hubs",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab"]
        pairs = materialize(
            pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs"
        )
        return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(
            tidy(_linked(numerator, denominator)), "a binary, b binary"
        )

    member = known.select(
        "band", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("u").alias("x_u")
    )
    possible = _possible("x", "y", numerator, denominator)
    stars = member.join(hub, "band").where((F.col("x") != F.col("y")) & possible)
    links = materialize(verified(stars), "links")
    labels = components(links)

    # What a hub has not joined: members outside its component meet the others in their buckets, if
    # these are in yet another component and the bound allows a link.
    label = labels.select(F.col("node").alias("x"), F.col("label").alias("x_label"))
    centre = hub.select("band", F.col("y").alias("x")).join(label, "x", "left").select(
        "band", F.col("x").alias("hub"), F.coalesce("x_label", "x").alias("hub_label")
    )
    # A node that its own shingles leave alone has no link at all.
    alone = denominator * (F.col("n") - F.col("u")) < numerator * F.col("n")
    left = (
        member.join(label, "x", "left")
        .withColumn("x_label", F.coalesce("x_label", "x"))
        .join(materialize(centre, "hubs"), "band")
        .where("x <> hub")
        .select(
            "band", F.col("x").alias("node"), F.col("x_n").alias("n"), F.col("x_u").alias("u"),
            F.col("x_label").alias("label"), (F.col("x_label") != F.col("hub_label")).alias("stray"),
        )
        .where(~alone)
    )
    parts = _parts(materialize(left, "members")).join(sets.select("node", "bits"), "node")
    rest = (
        parts.repartition(*_PART).sortWithinPartitions(*_PART, F.desc("stray"))
        .mapInArrow(tidy(_allowed(numerator, denominator)), "x binary, y binary")
    )
    more = materialize(verified(rest), "links")
    labels = components(links.union(more)) if not more.isEmpty() else labels

    grouped = nodes.select("node", "id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    least = grouped.groupBy("label").agg(F.min("id").alias("component"))
    named = materialize(grouped.join(least, "label").select("node", "label", "component"), "named")
    return sketches.join(named, "node", "left").select(
        "id", "digest", "n", "label", F.coalesce("component", "id").alias("component")
    )


def _with_digest(function):
    """Pass the digest of each row along a function of batches whose rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            done = 0
            for out in function(iter([given])):
                digest = given["digest"].slice(done, out.num_rows)
                done += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, digest], [*out.schema.names, "digest"])

    return run


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each group of near copies.

    It is a row of the smallest doc_id, then of the smallest digest of its text; one of its repeats,
    whichever, stays. Documents without a word are no copies of each other and all stay.
    """
    found = materialize(_judged(docs, doc_id=doc_id, text=text, **options), "judged")
    worded = found.where("label is not null").groupBy("label", "id", "digest").agg(F.count("*").alias("times"))
    chosen = worded.groupBy("label").agg(F.min(F.struct("id", "digest", "times")).alias("row")).select("row.*")
    wordless = found.where("label is null").select("id", "digest", F.lit(1).cast("long").alias("times")).distinct()
    stay = materialize(chosen.unionByName(wordless), "stay")
    keyed = packed(
        docs, id=F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)), digest=F.xxhash64(col(text).cast("string"))
    )
    once = keyed.join(stay.where("times = 1"), ["id", "digest"], "left_semi")
    often = stay.where("times > 1")
    if not often.isEmpty():
        repeats = keyed.join(small_side(often), ["id", "digest"]).groupBy("id", "digest")
        once = once.unionByName(repeats.agg(F.any_value("row").alias("row")).select(*once.columns))
    return unpacked(once, docs.columns, {})
