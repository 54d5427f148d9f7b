"""Near duplicates among vectors by an exact metric range join.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so that all links are pairs within one
radius. Cells that are too large are split by pivots: each vector lives in the cell of its nearest
pivot, and by the triangle inequality every way from it into another cell is at least as long as its
distance to the plane halfway between both pivots. Only where that is within the radius does it also
visit the other cell, and of each two cells only one sends its vectors to the other, so every pair
within the radius meets exactly once. Cells are split again until they are small or splitting does
not pay (measured on a sample of the cell); what is still large is joined in blocks of vectors.

Pairs of blocks meet in waves: block i meets block i + d for one distance d at a time, so a wave
shuffles a vector twice at most, and its shuffle files go when its result is written. A
joined pair of blocks does not emit pairs: it counts links and names one root per vector for the
components. Equal vectors are one node with a weight from the start, and vectors of 32-bit
components stay such until they are compared.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from jobmeter.llm.components import components
from jobmeter.llm.tables import batch, bounded_batches, col, ordered, packed, unpacked
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize, shuffles_dropped

SIMILARITY = 0.98
CELL = 2048  # members of a cell that is joined without further splitting
BLOCK = 4096  # members of a block of a larger one
WIDE = 4  # a cell of more than so many blocks gets blocks up to so many times larger first
BLOCK_BYTES = 16 << 20  # bound of these, in doubles
SAMPLE = 512  # members that choose and judge the pivots of a cell
PIVOTS = (4, 8, 16, 32)
LEVELS = 24
COPY_COST = 400  # a copy of a vector, in comparisons of two vectors
COPIES = 1.5  # members of all new cells, guests included, for each vector that lives there
GAIN = 0.7  # splitting must bring the cost below this share of the blocks' cost
SLACK = 1e-9  # rounding room of distances; links are decided by the cosine itself

_MEMBER = ["node", "weight", "home", "vector"]


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column as rows of length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)
    # Scaled first, so that squares of very large or small components stay finite and above zero.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def visits(points: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, which cells a vector within the radius may live in) of every point."""
    square = (points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)
    home = square.argmin(axis=1)
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0))
    to_plane = (square - square.min(axis=1, keepdims=True)) / np.maximum(2 * apart[home], 1e-300)
    near = to_plane <= radius + SLACK
    near[np.arange(len(points)), home] = True
    return home, near


def sends(cells: int) -> np.ndarray:
    """(i, j): whether the vectors of cell i visit cell j; exactly one of both ways, dealt evenly."""
    i, j = np.indices((cells, cells))
    return ((i < j) == ((i + j) % 2 == 0)) & (i != j)


@dataclass(frozen=True)
class Plan:
    """How cells are split: the radius of a link, bounds of cells and blocks, the cost of a copied vector."""

    radius: float
    cell: int = CELL
    block: int = BLOCK
    copy_cost: int = COPY_COST
    wide: int = WIDE

    def widest(self, size: int) -> int:
        """Members of the largest blocks of vectors of ``size`` components."""
        return max(self.block, min(self.wide * self.block, BLOCK_BYTES // (8 * max(size, 1))))

    def blocks(self, members: int, size: int) -> int:
        """Blocks of a cell."""
        if members <= self.cell:
            return 1
        return max(min(-(-members // self.block), self.wide), -(-members // self.widest(size)))


def pivots_for(points: np.ndarray, size: int, plan: Plan, homes: int | None = None) -> np.ndarray | None:
    """Pivots that split a cell of ``size`` members, drawn as ``points``, or None if none of them pays.

    ``homes`` of the members live there (else all). As many members as ``COPIES`` allows are written for
    each of these, however deep cells are split, so that the disk grows with the table.
    """
    n, homes = len(points), homes or size
    rng = np.random.default_rng(0)
    best, least = None, GAIN * (size / 2 + plan.copy_cost * plan.blocks(size, points.shape[1]))
    for k in PIVOTS:
        if k * 8 > n or (k > PIVOTS[0] and k * plan.cell > 4 * size):
            break
        centre = points[rng.choice(n, k, replace=False)]
        for _ in range(6):
            label = ((centre**2).sum(axis=1) - 2 * points @ centre.T).argmin(axis=1)
            counts = np.bincount(label, minlength=k)
            total = np.zeros_like(centre)
            np.add.at(total, label, points)
            centre = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centre)
        centre = np.unique(centre[counts > 0], axis=0)
        if len(centre) < 2:
            continue
        home, near = visits(points, centre, plan.radius)
        guest = near & sends(len(centre))[home]
        lives = np.bincount(home, minlength=len(centre)) / n
        comes = guest.sum(axis=0) / n
        if homes * (1 + comes.sum()) + (size - homes) * near.sum() / n > COPIES * homes:
            continue
        cost = size * (lives * (lives / 2 + comes)).sum() + plan.copy_cost * (1 + comes.sum())
        if cost < least:
            best, least = centre, cost
    return best


def _choose(plan: Plan):
    def run(drawn: pa.Table) -> pa.Table:
        drawn = drawn.sort_by([("order", "ascending"), ("node", "ascending")])
        found = pivots_for(unit(drawn["vector"]), drawn["size"][0].as_py(), plan, drawn["homes"][0].as_py())
        rows = [] if found is None else [found.reshape(-1).tolist()]
        kinds = {"cell": pa.string(), "pivots": pa.list_(pa.float64()), "size": pa.int64()}
        return pa.Table.from_batches(
            [batch({"cell": drawn["cell"].to_pylist()[: len(rows)], "pivots": rows, "size": drawn["size"].to_pylist()[: len(rows)]}, kinds)]
        )

    return run


def _split(radius: float):
    """Members of a part of a cell, in its new cells."""

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not members.num_rows or not pivots.num_rows:
            return members.select(["cell", *_MEMBER]).slice(0, 0)
        points = unit(members["vector"])
        centre = np.array(pivots["pivots"][0].as_py()).reshape(-1, points.shape[1])
        home, near = visits(points, centre, radius)
        lives = members["home"].combine_chunks().to_numpy(zero_copy_only=False)
        own = np.zeros_like(near)
        own[np.arange(len(points)), home] = True
        goes = own | (near & (~lives[:, None] | sends(len(centre))[home]))
        row, cell = np.nonzero(goes)
        path = members["cell"][0].as_py()
        taken = members.select(["node", "weight", "vector"]).take(pa.array(row))
        return pa.table(
            {
                "cell": pa.array([f"{path}/{c}" for c in cell], pa.string()),
                "node": taken["node"],
                "weight": taken["weight"],
                "home": pa.array(lives[row] & own[row, cell]),
                "vector": taken["vector"],
            }
        )

    return run


def _blocks(plan: Plan) -> Column:
    """``Plan.blocks`` of the cell of a row (cell, size)."""
    size, parts = F.col("size"), lambda rows: F.ceil(F.col("size") / rows)
    components_ = F.substring_index("cell", ":", 1).cast("long")
    widest = F.greatest(F.lit(plan.block), F.least(F.lit(plan.wide * plan.block), F.floor(BLOCK_BYTES / (8 * components_))))
    many = F.greatest(F.least(parts(F.lit(plan.block)), F.lit(plan.wide)), parts(widest))
    return F.when(size <= plan.cell, 1).otherwise(many).cast("int")


def _cells(members: DataFrame, plan: Plan) -> DataFrame:
    """Members of the final cells, with the number of blocks of their cell."""
    done = []
    kind = members.schema["vector"].dataType.simpleString()
    for level in range(LEVELS + 1):
        members = materialize(members, "members") if level else members
        sizes = members.groupBy("cell").agg(
            F.count("*").alias("size"), F.count_if("home").alias("homes")
        )
        sizes = small_side(materialize(sizes.where("homes > 0"), "cells"))
        blocks = _blocks(plan)
        large = sizes.where(F.col("size") > plan.cell)
        pivots = None
        if level < LEVELS and not large.isEmpty():
            order = W.partitionBy("cell").orderBy("order", "node")
            drawn = members.where("home").join(large, "cell").withColumn("order", F.xxhash64("node"))
            drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
            pivots = materialize(
                drawn.select("cell", "node", "order", "vector", "size", "homes").groupBy("cell").applyInArrow(
                    _choose(plan), "cell string, pivots array<double>, size long"
                ),
                "pivots",
            )
            if pivots.isEmpty():
                pivots = None
        if pivots is None:
            done.append(members.join(sizes.select("cell", blocks.alias("blocks")), "cell"))
            break
        split = small_side(pivots.select("cell", F.ceil(F.col("size") / plan.block).cast("int").alias("parts")))
        stays = members.join(split, "cell", "left_anti")
        done.append(stays.join(sizes.select("cell", blocks.alias("blocks")), "cell"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
        left = members.join(split, "cell").select("cell", part, *_MEMBER).groupBy("cell", "part")
        every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / plan.block).cast("int") - 1)).alias("part")
        right = pivots.select("cell", every, "pivots").groupBy("cell", "part")
        members = left.cogroup(right).applyInArrow(
            _split(plan.radius), f"cell string, node long, weight long, home boolean, vector {kind}"
        )
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    return final


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = aa = bb = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (aa * bb) ** 0.5


def _linked(some: np.ndarray, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the unit vectors of both arrays whose cosine in double precision is large enough."""
    # 32 bits tell apart what is clear; the margin is above their rounding.
    margin = (some.shape[1] + 8) * 1.2e-7
    i, j = np.nonzero(some.astype(np.float32) @ others.astype(np.float32).T >= np.float32(similarity - margin))
    if len(i) * 16 > len(some) * len(others):
        score = (some @ others.T)[i, j]
    else:
        score = np.empty(len(i))
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            score[part] = np.einsum("ij,ij->i", some[i[part]], others[j[part]])
    linked = score >= similarity
    for k in np.flatnonzero(np.abs(score - similarity) < 1e-12):
        linked[k] = _exact(some[i[k]], others[j[k]]) >= similarity
    return i[linked], j[linked]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots ``label``, after the rows a and b of every link have come to one root."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        label = root[label]


def _join(similarity: float):
    """(node, links, root): links and a component root of the nodes that a pair of blocks links."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = {"node": pa.int64(), "links": pa.int64(), "root": pa.int64()}
        points = unit(rows["vector"])
        node, weight = (rows[c].combine_chunks().to_numpy() for c in ("node", "weight"))
        right, home = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("right", "home"))
        same = rows["i"][0] == rows["j"][0]
        at, to = (np.arange(len(node)), np.arange(len(node))) if same else (np.flatnonzero(~right), np.flatnonzero(right))
        label = np.arange(len(node))
        links = np.zeros(len(node), np.int64)
        for first in range(0, len(at), 512):
            some = at[first : first + 512]
            others = to[first:] if same else to
            i, j = _linked(points[some], points[others], similarity)
            i, j = some[i], others[j]
            # Guests of a cell meet elsewhere; rows of one block meet in their order.
            meet = home[i] | home[j]
            if same:
                meet &= i < j
            i, j = i[meet], j[meet]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = _joined(label, i, j)
        out = np.flatnonzero(links)
        return pa.Table.from_batches([batch({"node": node[out], "links": links[out], "root": node[label[out]]}, kinds)])

    return run


def _waves(blocks: int) -> list[list[int]]:
    """Distances of blocks that meet, wave by wave; a member goes to two pairs of blocks at most."""
    return [[0, 1]] if blocks < 3 else [[d] for d in range(blocks // 2 + 1)]


def _met(cells: DataFrame, similarity: float, distances: list[int]) -> DataFrame:
    """The join of all pairs of blocks at the given distances, around the circle of a cell's blocks."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    ways = F.array_distinct(F.array(*[F.pmod(F.col("own") + sign * d, F.col("blocks")) for d in distances for sign in (1, -1)]))
    cells = cells.where(F.col("blocks") >= 2 * min(distances))  # the others are done
    place = lambda b: F.struct(
        F.least("own", b).alias("i"), F.greatest("own", b).alias("j"), (F.col("own") > b).alias("right")
    )
    dealt = cells.withColumn("own", own).select("cell", *_MEMBER, F.inline(F.transform(ways, place)))
    return dealt.groupBy("cell", "i", "j").applyInArrow(_join(similarity), "node long, links long, root long")


def _all_met(cells: DataFrame, similarity: float) -> DataFrame:
    """(node, links, root) of every pair of blocks; one wave after another is written."""
    most = cells.agg(F.max("blocks")).first()[0] or 1
    found = [materialize(_met(cells, similarity, distances), "links") for distances in _waves(most)]
    return reduce(DataFrame.unionByName, found)


def near_copies(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    similarity: float = SIMILARITY,
    keep: Iterable[str] | None = None,
    **sizes: int,
) -> DataFrame:
    """The rows of ``vectors`` (columns ``keep``, else all) with n_links, component_id and kept.

    Two rows are linked if their labels are equal and not null, their vectors of one length, and the
    cosine is at least ``similarity`` in double precision. ``n_links`` counts the other rows linked with
    a row; ``component_id`` is the smallest vec_id that links reach, its own included; ``kept`` is
    whether that is its own. No link is lost.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor
    do rows without label. Repeated rows are rows of their own and link with each other. A row
    without vec_id links like any other; it is kept only if no id is within reach, and component_id is
    null then. An empty table gives an empty one. Columns of the caller called like a result are
    replaced. Nodes go by 64-bit hashes of (label, vector). ``sizes`` set bounds of ``Plan``; the result
    does not depend on them.
    """
    keep = vectors.columns if keep is None else list(keep)
    element = vectors.select(col(vector)).schema[0].dataType
    kind = "float" if element == ArrayType(FloatType(), element.containsNull) else "double"
    given = col(vector).cast(f"array<{kind}>")
    keyed = packed(
        bounded_batches(vectors), keep, id=col(vec_id).cast("long"), label=col(label).cast("string"), given=given
    )
    sound = F.forall("given", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    valid = F.col("label").isNotNull() & (F.size("given") > 0) & sound & F.exists("given", lambda x: x != 0)
    clean = F.transform("given", lambda x: x + F.lit(0.0).cast(kind))  # no negative zeros
    cell = F.concat_ws(":", F.size("given").cast("string"), "label")
    keyed = keyed.select(
        "id", "row", F.when(valid, cell).alias("cell"), F.when(valid, clean).alias("vector")
    ).withColumn("node", F.when(F.col("cell").isNotNull(), F.xxhash64("cell", "vector")))
    with shuffles_dropped(vectors.sparkSession):
        nodes = materialize(
            keyed.where("node is not null").groupBy("node", "cell", "vector").agg(
                F.count("*").alias("weight"), F.min("id").alias("least")
            ),
            "nodes",
        )
        plan = Plan(float(np.sqrt(max(0.0, 2 - 2 * similarity))), **sizes)
        members = nodes.select("cell", "node", "weight", F.lit(True).alias("home"), "vector")
        found = _all_met(_cells(members, plan), similarity)
        labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "weight", "least").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").join(links, "node", "left")
    named = materialize(
        named.select(
            F.col("node").alias("_node"), "component",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        ),
        "named",
    )
    joined = keyed.drop("cell", "vector").join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    results = {
        "n_links": F.coalesce("links", F.lit(0)).cast("long"),
        "component_id": component,
        "kept": component.eqNullSafe(F.col("id")),
    }
    return ordered(unpacked(joined, keep, results), keep, *results)
