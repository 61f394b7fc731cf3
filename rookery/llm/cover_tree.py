"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors of unit length with cosine c lie sqrt(2 - 2c) apart, so pairs are sought
by distance, within one label. A label's tree grows on the cluster, level by level:
centres of a node come from a bounded sample of it, until none of the sample is
farther from one than half the node's radius, and every vector goes to its nearest.
Nodes that fit a task are left as they are. Two trees are walked at once, also level
by level, over centres and covering radii alone: a pair of nodes is dropped if they
lie farther apart than their radii and the threshold allow. Only what is left moves
vectors: each pair of nodes is a task, which builds the levels below, each with half
the radius above, and walks both trees in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stage
from .links import components

COSINE = 0.93
#: Vectors of a node that is a task's, of a leaf; members for each child at least; sampled vectors of a node, its centres at most; levels on the cluster at most.
BLOCK, LEAF, FEW, SAMPLE, CENTRES, LEVELS = 2048, 48, 16, 2048, 64, 16
#: Above the rounding of a distance near 0 (2.1e-8, as a root of a difference).
SLACK = 1e-7


@dataclass
class Node:
    centre: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of `a` and of `b`, all of unit length."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover(points: np.ndarray, radius: float, most: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, farthest first, until all points are within `radius` of one; each point's nearest and the distance."""
    far = distances(points, points[:1])[:, 0]
    centres, nearest = [0], np.zeros(len(points), np.int64)
    while far.max() > radius and (most is None or len(centres) < most):
        new = int(far.argmax())
        d = distances(points, points[new : new + 1])[:, 0]
        closer = d < far
        nearest[closer], far[closer] = len(centres), d[closer]
        centres.append(new)
    return centres, nearest, far


def tree(points: np.ndarray, members: np.ndarray | None = None, radius: float = 2.0) -> Node:
    """The cover tree of `points`: a node's children lie within half its radius of their members. A
    node stays whole if it has few members or would have nearly as many children: no radius would tell them apart for less than a product of matrices takes."""
    members = np.arange(len(points)) if members is None else members
    own = distances(points[members], points[members[:1]])[:, 0]
    node = Node(int(members[0]), float(own.max()), members)
    if len(members) <= LEAF or node.radius <= SLACK:
        return node
    half, most = min(radius, node.radius) / 2, len(members) // FEW
    centres, nearest, far = cover(points[members], half, most)
    if far.max() > half:
        return node
    order = np.argsort(nearest, kind="stable")
    for some in np.split(order, np.searchsorted(nearest[order], np.arange(1, len(centres)))):
        c = centres[int(nearest[some[0]])]
        node.children.append(tree(points, members[np.concatenate([[c], some[some != c]])], half))
    return node


def near_blocks(a: np.ndarray, b: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Yields (i, j, near): rows of `a` and of `b` (or of `a` again), and which of them are near, None
    if all are. A row meets another in one block at most; if i is j, near has both halves and no diagonal.

    A pair of nodes is dropped if centres lie farther apart than radii and the threshold allow,
    and is near as a whole if even the farthest members are close enough."""
    reach = float(np.sqrt(2 - 2 * cosine))
    same = b is None
    left = tree(a)
    right = left if same else tree(b)
    b = a if same else b
    todo = [(left, right)]
    while todo:
        x, y = todo.pop()
        own = same and x is y
        gap = 0.0 if own else float(distances(a[[x.centre]], b[[y.centre]])[0, 0])
        if gap + x.radius + y.radius <= reach - SLACK:
            yield x.members, y.members, None
            continue
        if not x.children and not y.children:
            near = a[x.members] @ b[y.members].T >= cosine
            if own:
                np.fill_diagonal(near, False)
            if near.any():
                yield x.members, y.members, near
            continue
        xs, ys = x.children or [x], y.children or [y]
        d = distances(a[[n.centre for n in xs]], b[[n.centre for n in ys]])
        meet = d <= np.array([n.radius for n in xs])[:, None] + np.array([n.radius for n in ys]) + reach + SLACK
        if own:
            meet = np.triu(meet)
        todo += [(xs[i], ys[j]) for i, j in zip(*np.nonzero(meet), strict=True)]


def near_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`near_blocks` as (i, j) arrays of pairs, each once."""
    for x, y, near in near_blocks(a, b, cosine):
        i, j = np.nonzero(np.ones((len(x), len(y)), bool) if near is None else near)
        i, j = x[i], y[j]
        yield (i[i < j], j[i < j]) if x is y else (i, j)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives all that pairs (i, j) join the smallest of their labels; a label is a row of its own group."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (deeper := label[label]).tolist() != label.tolist():
            label[:] = deeper


def links_of(a: np.ndarray, b: np.ndarray | None, cosine: float, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of `a`, and then of `b`: how many others it's near to (each counts as
    often as `copies` says), and the first row of its group."""
    n = len(a)
    links, label = np.zeros(len(copies), np.int64), np.arange(len(copies))
    for i, j, near in near_blocks(a, b, cosine):
        own = i is j
        j = j if b is None else j + n
        if near is None:
            links[i] += copies[j].sum() - (copies[i] if own else 0)
            unite(label, np.concatenate([i, j]), np.full(len(i) + len(j), i[0]))
        else:
            links[i] += near @ copies[j]
            p, q = np.nonzero(near)
            unite(label, i[p], j[q])
        if not own:
            links[j] += copies[i].sum() if near is None else near.T @ copies[i]
    return links, label


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


_KEYS = ["label", "dim", "path"]


def _split(rows: DataFrame, nodes: DataFrame, block: int, sample: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """The vectors of `nodes` (_KEYS, n, radius), which are open, in their children, and the children's centres (_KEYS of the parent, child, centre)."""
    told = rows.join(nodes.select(*_KEYS, "n", "radius"), _KEYS)
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < sample / F.col("n")

    def pick(group: pa.Table) -> pa.Table:
        points = _matrix(group.column("unit"))
        points = points[np.lexsort(points.T)]
        # No more children than tasks: smaller nodes, where no radius rules a pair out, only mean more copies of each vector.
        most = min(centres, -(-group.column("n")[0].as_py() // block))
        found, _, _ = cover(points, group.column("radius")[0].as_py() / 2, most)
        n, first = len(found), {k: group.column(k)[0].as_py() for k in _KEYS}
        return pa.table({"label": pa.array([first["label"]] * n, pa.string()), "dim": pa.array([first["dim"]] * n, pa.int32()), "path": pa.array([first["path"]] * n, pa.string()), "child": pa.array(range(n), pa.int32()), "centre": pa.array(points[found].tolist(), pa.list_(pa.float64()))})

    tops = stage(told.where(chance).select(*_KEYS, "n", "radius", "unit").groupBy(_KEYS).applyInArrow(pick, "label string, dim int, path string, child int, centre array<double>"), "tops")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * block)))
    spread = tops.join(nodes.select(*_KEYS, "n"), _KEYS).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    dealt = told.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).select(*_KEYS, "salt", "id", "lead", "copies", "unit")

    def assign(own: pa.Table, top: pa.Table) -> pa.Table:
        if not len(own):
            child, d = np.zeros(0, np.int32), np.zeros(0)
        elif not len(top):  # no sampled vector: they stay together
            child, d = np.zeros(len(own), np.int32), np.full(len(own), 2.0)
        else:
            order = np.argsort(top.column("child").to_numpy())
            far = distances(_matrix(own.column("unit")), _matrix(top.column("centre"))[order])
            child, d = far.argmin(axis=1).astype(np.int32), far.min(axis=1)
        return own.drop_columns("salt").append_column("child", pa.array(child, pa.int32())).append_column("far", pa.array(d, pa.float64()))

    keys = [*_KEYS, "salt"]
    placed = dealt.groupBy(keys).cogroup(spread.select(*keys, "child", "centre").groupBy(keys)).applyInArrow(assign, "label string, dim int, path string, id bigint, lead bigint, copies bigint, unit array<double>, child int, far double")
    return stage(placed.select("label", "dim", F.col("path").alias("parent"), F.concat("path", F.lit("."), "child").alias("path"), "far", "id", "lead", "copies", "unit"), "level"), tops


def _meeting(pairs: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """Of `pairs` (label, dim, path, path2) of nodes those of their children, in `nodes` (_KEYS, parent, centre, radius), that may hold near vectors."""
    a = nodes.select("label", "dim", F.col("parent").alias("p"), "path", "centre", "radius")
    b = nodes.select("label", "dim", F.col("parent").alias("q"), *(F.col(c).alias(f"{c}2") for c in ("path", "centre", "radius")))
    both = pairs.toDF("label", "dim", "p", "q").join(a, ["label", "dim", "p"]).join(b, ["label", "dim", "q"]).where("p <> q or path <= path2")
    may = (F.col("path") == F.col("path2")) | F.coalesce(_gap("centre", "centre2") <= F.col("radius") + F.col("radius2") + reach + 1e-6, F.lit(True))
    return both.where(may).select(*_KEYS, "path2")


def _trees(distinct: DataFrame, reach: float, block: int, sample: int, centres: int, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All trees down to nodes that fit a task: the vectors with their node (path), the
    nodes (_KEYS, n), and the pairs of nodes that may hold near vectors (_KEYS, path2)."""
    rows = distinct.select("label", "dim", F.lit("").alias("parent"), F.lit("0").alias("path"), F.lit(2.0).alias("far"), "id", "lead", "copies", "unit")
    info = rows.groupBy("label", "dim", "parent", "path").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    nodes = stage(info.withColumn("centre", F.lit(None).cast("array<double>")).withColumn("open", F.col("n") > block), "nodes")
    pairs, done = nodes.select(*_KEYS, F.col("path").alias("path2")), []
    for _ in range(levels):
        open_ = nodes.where("open")
        if not open_.limit(1).count():
            break
        done.append(rows.join(open_.select(*_KEYS), _KEYS, "left_anti"))
        rows, tops = _split(rows, open_, block, sample, centres)
        info = rows.groupBy("label", "dim", "parent", "path").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        tops = tops.select("label", "dim", F.concat("path", F.lit("."), "child").alias("path"), "centre")
        above = open_.select("label", "dim", F.col("path").alias("parent"), F.col("n").alias("n_above"), F.col("radius").alias("r_above"))
        info = info.join(tops, _KEYS, "left").join(above, ["label", "dim", "parent"])
        # A node goes on if it is too large for a task, and splitting it may tell its vectors apart.
        goes_on = (F.col("n") > block) & (F.col("radius") > reach / 8) & ((F.col("n") < 0.95 * F.col("n_above")) | (F.col("radius") < 0.95 * F.col("r_above")))
        below = info.select(*_KEYS, "parent", "n", "radius", "centre", goes_on.alias("open"))
        stay = nodes.where("not open").select(*_KEYS, F.col("path").alias("parent"), "n", "radius", "centre", "open")
        nodes = stage(below.unionByName(stay), "nodes")
        pairs = stage(_meeting(pairs, nodes, reach), "node_pairs")
    done.append(rows)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed, nodes.select(*_KEYS, "n", "radius", "centre"), pairs


def _gap(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _near_as_wholes(placed: DataFrame, nodes: DataFrame, pairs: DataFrame, reach: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of nodes whose farthest members are close enough need no task. The other `pairs`;
    (id, links) of the vectors in such nodes; and (u, v) that join them."""
    a, b = (nodes.select("label", "dim", *(F.col(c).alias(f"{c}{n}") for c in ("path", "radius", "centre"))) for n in ("", "2"))
    both = pairs.join(a, _KEYS).join(b, ["label", "dim", "path2"])
    apart = F.when(F.col("path") == F.col("path2"), 0.0).otherwise(_gap("centre", "centre2"))
    whole = F.coalesce(apart + F.col("radius") + F.col("radius2") <= reach - 1e-6, F.lit(False))
    both = stage(both.select(*_KEYS, "path2", whole.alias("whole")), "whole_pairs")
    near = both.where("whole").drop("whole")
    held = stage(placed.join(near.select(*_KEYS).union(near.select("label", "dim", "path2")).distinct(), _KEYS).groupBy(_KEYS).agg(F.sum("copies").alias("copies"), F.min("lead").alias("first")), "whole_nodes")
    ways = near.unionByName(near.where("path <> path2").select("label", "dim", F.col("path2").alias("path"), F.col("path").alias("path2")))
    other = held.select("label", "dim", F.col("path").alias("path2"), F.col("copies").alias("many"), F.col("first").alias("first2"))
    met = ways.join(other, ["label", "dim", "path2"])
    sums = met.groupBy(_KEYS).agg(F.sum("many").alias("many"), F.bool_or(F.col("path") == F.col("path2")).alias("self"))
    each = placed.join(sums.join(held.select(*_KEYS, "first"), _KEYS), _KEYS)
    links = each.select("id", (F.col("many") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("links"))
    joined = each.select(F.col("lead").alias("u"), F.col("first").alias("v")).unionByName(met.join(held.select(*_KEYS, "first"), _KEYS).select(F.col("first").alias("u"), F.col("first2").alias("v")))
    return both.where("not whole").drop("whole"), links, joined


def near_embeddings(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE, centres: int = CENTRES, levels: int = LEVELS) -> DataFrame:
    """A row for each row of `vectors`: vec_id, n_links (other vectors of its label
    with that cosine or more), component_id (smallest id reachable) and kept.

    Vectors that are null, of length zero, or hold a null, NaN or infinity, and those
    with a null label or id, link with nothing; a null id is kept. Vectors of other
    dimensions don't meet. Equal vectors of a label are one from the start, with a
    number of copies. Rows of one id are vectors of their own in n_links, and one
    node in components. Other columns aren't read; an empty table gives none.

    The samples decide how vectors are dealt out, never which pairs are found. Each
    level moves the vectors of its open nodes once; then each goes to the tasks of the pairs that its node is left in.
    Vectors that no node of a small radius holds (spread evenly over many dimensions) leave all pairs of nodes to the tasks."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    whole = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()
    whole &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stage(rows.withColumn("ok", F.coalesce(whole, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0)))), "vectors")
    good = rows.where("ok")
    distinct = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count("*").alias("copies"))
    large = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / large)
    distinct = distinct.withColumn("scaled", scaled).withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x)))
    unit = F.transform("scaled", lambda x: x / F.col("norm"))
    # A number of its own for each distinct vector: ids may repeat.
    distinct = distinct.select("label", F.size("v").alias("dim"), "v", unit.alias("unit"), F.col("id").alias("lead"), "copies", F.monotonically_increasing_id().alias("id"))
    distinct = stage(distinct, "distinct")
    reach = float(np.sqrt(2 - 2 * cosine))
    placed, nodes, pairs = _trees(distinct, reach, block, sample, centres, levels)
    pairs, whole_links, whole_joined = _near_as_wholes(placed, nodes, pairs, reach)

    # Nodes that splitting didn't make small go in blocks; two blocks that meet are a task.
    sized = nodes.select(*_KEYS, F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint").alias("blocks"))
    each = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    meet = pairs.join(each, _KEYS).join(each.select("label", "dim", F.col("path").alias("path2"), F.col("block").alias("block2")), ["label", "dim", "path2"])
    meet = meet.where("path <> path2 or block <= block2").select(*_KEYS, "block", "path2", "block2")
    meet = stage(meet.withColumn("task", F.monotonically_increasing_id()), "tasks")
    apart = F.expr("path <> path2 or block <> block2")
    first = meet.select(*_KEYS, "block", "task", F.lit(0).alias("side"), apart.alias("several"))
    second = meet.where(apart).select("label", "dim", F.col("path2").alias("path"), F.col("block2").alias("block"), "task", F.lit(1).alias("side"), F.lit(True).alias("several"))
    dealt = placed.join(sized, _KEYS).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks")).select(*_KEYS, "block", "id", "lead", "copies", "unit")
    tasks = dealt.join(first.unionByName(second), [*_KEYS, "block"]).select("task", "side", "several", "id", "lead", "copies", "unit")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        n = int((group.column("side").to_numpy() == 0).sum())
        ids, lead, copies = (group.column(c).to_numpy() for c in ("id", "lead", "copies"))
        points = _matrix(group.column("unit"))
        several = group.column("several")[0].as_py()
        if not n or (several and n == len(group)):  # one of the two nodes' blocks is empty
            links, label = np.zeros(len(group), np.int64), np.arange(len(group))
        else:
            links, label = links_of(points[:n], points[n:] if several else None, cosine, copies)
        some, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(group)))
        no_id, no_pair = pa.nulls(len(joined), pa.int64()), pa.nulls(len(some), pa.int64())
        columns = {"id": (ids[some], no_id), "links": (links[some], no_id), "u": (no_pair, lead[joined]), "v": (no_pair, lead[label[joined]])}
        return pa.table({k: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in parts]) for k, parts in columns.items()})

    found = stage(tasks.groupBy("task").applyInArrow(compare, "id bigint, links bigint, u bigint, v bigint"), "found")
    links = found.where("id is not null").select("id", "links").unionByName(whole_links).groupBy("id").agg(F.sum("links").alias("links"))
    leads = good.join(distinct.select("label", "v", "id", "lead", "copies").withColumnRenamed("id", "key"), ["label", "v"])
    leads = stage(leads.join(links.withColumnRenamed("id", "key"), "key", "left").select("id", "lead", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "leads")
    several = leads.where("id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v"))  # copies, and ids with several vectors
    joined = components(found.where("u is not null").select("u", "v").unionByName(whole_joined).unionByName(several)).select(F.col("node").alias("id"), F.col("component"))
    told = leads.join(joined, "id", "left").select("id", "n_links", F.coalesce("component", "id").alias("component"))
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return told.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
