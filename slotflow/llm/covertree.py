"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors of a label are dealt to cells around pivots from a sample (the top of the tree).
A vector visits another cell only if the plane between the two pivots is within the threshold,
and only if it lies within the threshold of the cell's covering radius. In a cell, trees with
nested levels of halving radii are walked in pairs; a pair of nodes is left when its centres
are farther apart than the threshold and both covering radii allow.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotflow.llm.common import only
from slotflow.llm.components import components
from slotflow.session import cut_lineage

_TINY = 1e-9


@dataclass(frozen=True)
class Cells:
    """Sizes that bound what a task holds; they do not change the result."""

    cell: int = 1024  # distinct vectors for each pivot
    pivots: int = 32_768  # most pivots, all labels together: what the driver sends
    chunk: int = 2048  # vectors of a cell that share one tree
    visitors: int = 32_768  # guests of a tree for each copy of it


class CoverTree:
    """Nested nodes over unit vectors: a centre, its covering radius, and children of half the reach."""

    LEAF = 24
    LEAST = 1 / 1024

    def __init__(self, x: np.ndarray, members: np.ndarray | None = None, centre: int = 0, reach: float = 2.0, gap: np.ndarray | None = None) -> None:
        """``gap``: distances of the members from the centre; only such are ever measured."""
        self.x = x
        self.members = np.arange(len(x)) if members is None else members
        self.centre = centre
        if gap is None:
            gap = _distances(x[[centre]], x[self.members])[0]
        self.radius = float(gap.max())
        self.children: list[CoverTree] = []
        while len(self.members) > self.LEAF and reach > self.LEAST and not self.children:
            reach /= 2
            nets = self._net(gap, reach)
            if len(nets) > 1:
                self.children = [CoverTree(x, own, c, reach, near) for c, own, near in nets]

    def _net(self, gap: np.ndarray, reach: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Centres over ``reach`` apart, the node's own first, with the members that each covers and their distances."""
        left, out, centre = self.members, [], self.centre
        while True:
            near = gap <= reach
            out.append((centre, left[near], gap[near]))
            left = left[~near]
            if not len(left):
                return out
            centre = int(left[0])
            gap = _distances(self.x[[centre]], self.x[left])[0]

    def parts(self) -> list[CoverTree]:
        return self.children or [self]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * _cosines(a, b)))


def near_pairs(a: CoverTree, b: CoverTree, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs with a cosine of at least ``least``, from a dual traversal; of a tree with itself each pair i < j once."""
    within, todo, found, same = math.sqrt(max(0.0, 2 - 2 * least)), [(a, b)], [], a is b
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            i, j = np.nonzero(_cosines(p.x[p.members], q.x[q.members]) >= least)
            found.append((p.members[i], q.members[j]))
            continue
        left, right = p.parts(), q.parts()
        ci, cj = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        cosine = _cosines(p.x[ci], q.x[cj])
        ri, rj = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        close = np.sqrt(np.maximum(0.0, 2 - 2 * cosine)) <= within + ri[:, None] + rj[None, :] + _TINY
        si, sj = np.array([len(n.members) == 1 for n in left]), np.array([len(n.members) == 1 for n in right])
        single = si[:, None] & sj[None, :]
        if same and p is q:  # each pair of its children once
            close = np.triu(close)
            single = np.triu(single)
        i, j = np.nonzero(single & (cosine >= least))
        found.append((ci[i], cj[j]))
        todo += [(left[i], right[j]) for i, j in zip(*np.nonzero(close & ~single))]
    if not found:
        return np.array([], dtype=int), np.array([], dtype=int)
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not same:
        return i, j
    low, high = np.minimum(i, j), np.maximum(i, j)
    once = np.unique(np.column_stack([low, high])[low < high], axis=0)
    return once[:, 0], once[:, 1]


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, cells: Cells = Cells()) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors are compared if their labels are equal and not NULL and they have as many
    components. A vector that is NULL, zero or empty, or holds a NULL or non-finite component,
    links with nothing: no links, its own component, kept. Vectors of equal direction are one
    node, so copies are counted and not paired. A row without a key links with nothing and
    has no component; it is not kept. Rows with equal keys are one node of the components.
    """
    rows = cut_lineage(_units(only(vectors, id=key, v=vector, label=label)))
    part = rows.where("u is not null")
    nodes = part.groupBy("g", "d1", "d2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"), F.min("u").alias("u"))
    # A number of its own for each direction: rows with equal keys may have several.
    nodes = cut_lineage(nodes.withColumn("uid", F.monotonically_increasing_id()))
    found = cut_lineage(_linked(nodes, least, cells))
    counted = found.where("other is null").groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    judged = (
        nodes.join(counted, "uid", "left")
        .join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
        .select("g", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    out = rows.join(judged, ["g", "d1", "d2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _units(rows: DataFrame) -> DataFrame:
    """(id, g, u, d1, d2): group (label and length), unit vector, 128-bit hash; NULLs where a row takes no part."""
    v = F.transform("v", lambda x: x.cast("double"))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))  # scaled first: squares cannot overflow or vanish
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & (top > 0)
    fine = F.coalesce(fine & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    scaled = rows.select("id", "label", F.when(fine, F.transform("v", lambda x: x / top)).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    units = scaled.select("id", "label", F.transform("v", lambda x: x / length).alias("u"))
    group = F.when(F.col("u").isNotNull(), F.concat(F.size("u").cast("string"), F.lit(" "), F.col("label")))
    # Rows that take no part differ in d1, so that no task gets them all.
    d1 = F.when(F.col("u").isNotNull(), F.xxhash64("u")).otherwise(F.xxhash64("id"))
    return units.select("id", "u", group.alias("g"), d1.alias("d1"), F.when(F.col("u").isNotNull(), F.xxhash64(F.lit(1), "u")).alias("d2"))


def _linked(nodes: DataFrame, least: float, cells: Cells) -> DataFrame:
    """(uid, node, links, other): counts of linked vectors (other NULL), and links that connect what is near."""
    within = math.sqrt(max(0.0, 2 - 2 * least))
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", "d1"), "node").limit(min(cells.pivots, math.ceil(total / cells.cell))).select("g", "u").collect()
    nets = {g: _apart(np.array([row.u for row in rows]), 2 * within) for g, rows in groupby(sorted(sample, key=lambda r: r.g), key=lambda r: r.g)}
    shape = "g string, uid long, node long, size long, u array<double>"
    placed = cut_lineage(nodes.select("g", "uid", "node", "size", "u").mapInArrow(_homes(nets), f"{shape}, cell int, away double"))
    sizes = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    # Only cells of pivots are known to the driver: at most cells.pivots.
    known = sizes.where(F.col("g").isin(*nets) if nets else F.lit(False)).collect()
    chunks = {(r.g, r.cell): math.ceil(r.n / cells.chunk) for r in known}
    radii = {(r.g, r.cell): r.radius for r in known}
    routed = placed.join(sizes.select("g", "cell", F.ceil(F.col("n") / cells.chunk).cast("int").alias("parts")), ["g", "cell"])
    routed = cut_lineage(routed.select("g", "uid", "node", "size", "u", "cell", "parts"))
    # Guests of each tree first: only trees with many of them are copied.
    counted = routed.mapInArrow(_guests(nets, chunks, radii, within), "g string, cell int, part int, n long")
    crowded = counted.groupBy("g", "cell", "part").agg(F.sum("n").alias("n")).where(F.col("n") > cells.visitors).collect()
    copies = {(r.g, r.cell, r.part): math.ceil(r.n / cells.visitors) for r in crowded}
    kinds = "g string, cell int, part int, salt int, guest boolean, uid long, node long, size long, u array<double>"
    sent = routed.mapInArrow(_visits(nets, chunks, radii, within, copies), kinds)
    by = ["g", "cell", "part", "salt"]
    met = sent.repartition(*by).sortWithinPartitions(*by, "guest", "uid")
    return met.mapInArrow(_meet(least), "uid long, node long, links long, other long")


def _apart(x: np.ndarray, least: float) -> np.ndarray:
    """The vectors that lie farther than ``least`` from all of them before."""
    held = [0]
    out = np.empty_like(x)
    out[0] = x[0]
    for i in range(1, len(x)):
        if _distances(x[i : i + 1], out[: len(held)]).min() > least:
            out[len(held)] = x[i]
            held.append(i)
    return out[: len(held)]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:])]


def _homes(nets: dict[str, np.ndarray]):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, u = batch.column("g").to_pylist(), _matrix(batch.column("u"))
            cell, away = np.zeros(len(u), dtype=np.int32), np.zeros(len(u))
            for g in set(groups) & set(nets):
                at = [i for i, x in enumerate(groups) if x == g]
                d = _distances(np.array([u[i] for i in at]), nets[g])
                cell[at], away[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return nearest


def _routes(batch: pa.RecordBatch, nets, chunks, radii, within: float) -> Iterator[tuple[int, str, int, int, bool]]:
    """(row, g, cell, part, guest): every vector once at home, and as a guest of chunks and cells before its own."""
    columns = {c: batch.column(c).to_pylist() for c in ("g", "uid", "cell", "parts")}
    u = _matrix(batch.column("u"))
    for i, (g, uid, cell, parts) in enumerate(zip(*columns.values())):
        own = _spread(uid) % parts
        yield i, g, cell, own, False
        for k in range(own):
            yield i, g, cell, k, True
        net = nets.get(g)
        if net is None or cell == 0:
            continue
        dots = net @ u[i]
        planes = (dots[cell] - dots[:cell]) <= within * _distances(net[cell : cell + 1], net[:cell])[0] + _TINY
        for other in np.flatnonzero(planes).tolist():
            if (g, other) in radii and math.sqrt(max(0.0, 2 - 2 * dots[other])) <= within + radii[g, other] + _TINY:
                for k in range(chunks[g, other]):
                    yield i, g, other, k, True


def _spread(uid: int) -> int:
    return ((uid * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 20


def _guests(nets, chunks, radii, within: float):
    """How many guests come to each tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter((g, cell, part) for _, g, cell, part, guest in _routes(batch, nets, chunks, radii, within) if guest)
            g, cell, part = zip(*n) if n else ((), (), ())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((g, cell, part, list(n.values())), kinds)], ["g", "cell", "part", "n"])

    return count


def _visits(nets, chunks, radii, within: float, copies: dict[tuple[str, int, int], int]):
    """Every vector at home, in each copy of its tree, and as a guest of one copy of each tree it visits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, out = batch.column("uid").to_pylist(), []
            for i, g, cell, part, guest in _routes(batch, nets, chunks, radii, within):
                salts = copies.get((g, cell, part), 1)
                out += [(i, cell, part, _spread(uids[i] + 1) % salts, True)] if guest else [(i, cell, part, salt, False) for salt in range(salts)]
                if len(out) > 20_000:
                    yield _routed(batch, out)
                    out = []
            if out:
                yield _routed(batch, out)

    return route


def _routed(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    at, cell, part, salt, guest = zip(*out)
    picked = batch.take(pa.array(at, pa.int32()))
    names = ["uid", "node", "size", "u"]
    arrays = [picked.column("g"), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(salt, pa.int32()), pa.array(guest, pa.bool_()), *(picked.column(c) for c in names)]
    return pa.RecordBatch.from_arrays(arrays, ["g", "cell", "part", "salt", "guest", *names])


def _meet(least: float):
    """Walks sorted partitions: the home vectors of a key become a tree, its guests pass by in batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, tree = None, [], None  # home: (numbers, nodes, sizes, vectors) pieces until the tree is built
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "cell", "part", "salt"))))
            guest = batch.column("guest").to_numpy(zero_copy_only=False)
            uid, node, size = (batch.column(c).to_numpy() for c in ("uid", "node", "size"))
            u = _matrix(batch.column("u"))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end - at < 1024 and keys[end] == keys[at] and guest[end] == guest[at]:
                    end += 1
                if keys[at] != key:
                    if home and tree is None:
                        yield from _at_home(key, _settled(home), least)
                    key, home, tree = keys[at], [], None
                rows = (uid[at:end], node[at:end], size[at:end], np.array(u[at:end]))
                if not guest[at]:
                    home.append(rows)
                elif home:
                    if tree is None:
                        tree = _settled(home)
                        yield from _at_home(key, tree, least)
                    yield from _links(tree, (*rows[:3], CoverTree(rows[3])), least)
                at = end
        if home and tree is None:
            yield from _at_home(key, _settled(home), least)

    return walk


def _settled(home):
    return *(np.concatenate([h[i] for h in home]) for i in range(3)), CoverTree(np.concatenate([h[3] for h in home]))


def _at_home(key, tree, least: float) -> Iterator[pa.RecordBatch]:
    if key[3] == 0:  # one copy of the tree is enough
        yield from _links(tree, tree, least)


def _links(a, b, least: float) -> Iterator[pa.RecordBatch]:
    i, j = near_pairs(a[3], b[3], least)
    if not len(i):
        return
    if a is not b:
        a, j = tuple(np.concatenate([a[k], b[k]]) for k in range(3)), j + len(a[0])
    uids, nodes, sizes = a[:3]
    count = np.bincount(i, weights=sizes[j], minlength=len(nodes)) + np.bincount(j, weights=sizes[i], minlength=len(nodes))
    root = _roots(len(nodes), i, j)
    at, child = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(nodes)))
    yield _found(uids[at], nodes[at], np.rint(count[at]).astype(np.int64), None)
    yield _found(uids[child], nodes[child], np.zeros(len(child), dtype=np.int64), nodes[root[child]])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _found(uids, nodes, links, other) -> pa.RecordBatch:
    end = pa.nulls(len(nodes), pa.int64()) if other is None else pa.array(other, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), end], ["uid", "node", "links", "other"])
