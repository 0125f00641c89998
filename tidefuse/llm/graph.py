"""Embedding near-duplicates by a robust-pruned flat graph.

Classes of equal vectors are taken once. Every class goes to its two nearest of
a number of centroids, so clusters overlap; a cluster is cut into shards of
bounded size. Each shard builds a pruned neighbour graph; the adjacency lists of
a class from its shards are united. Every class then searches the shards of its
clusters greedily from the medoid, and the search expands on through all
vertices within the range. Pairs found are verified in double precision, and count
at both ends whichever of the two searches found them.

Centroids are fitted on at most ``SAMPLE`` classes, those with the smallest
hashed ids; all vectors are indexed. A pair that meets in two clusters counts in
the one of smaller number. Shards give sums and local components, never pairs, so
that a large group of near copies stays linear in rows. ``audit`` measures the
recall against brute force.

Null or zero vectors and those with null or non-finite components link with
nothing. Rows of equal id are vectors of their own. Vectors of different
dimension never link. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import kept
from tidefuse.llm.components import connected

LEAST = 0.95
SAMPLE = 16_384
SHARD = 2048
#: Classes per centroid.
PER_CENTROID = 1024
CANDIDATES, DEGREE, ALPHA, BEAM, MEDOIDS = 48, 24, 1.2, 32, 64


def classes_of(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, node null if it takes no part; and (node, copies, v) of every class."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x).alias("v"))
    # 0.0 and -0.0 are one class.
    rows = rows.withColumn("v", F.transform("v", lambda a: F.when(a == 0, 0.0).otherwise(a)))
    rows = kept(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "vectors")
    return rows.select("vec_id", "node"), kept(rows.where("node IS NOT NULL").groupBy("node", "v").agg(
        F.count(F.lit(1)).alias("copies")), "classes")


def units(column) -> np.ndarray:
    v = np.array(column.to_pylist(), np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares cannot overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means, a few rounds."""
    rng = np.random.default_rng(5)
    centers = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(6):
        near = (sample @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(size > 0, total / np.maximum(size, 1e-12), centers)
    return centers


def assign(classes: DataFrame, centers: np.ndarray) -> DataFrame:
    """Each class once per cluster: cluster, node, copies, first and second cluster, v."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = units(batch.column("v")) @ centers.T
            two = np.argsort(-near, axis=1)[:, :2] if len(centers) > 1 else np.zeros((batch.num_rows, 2), int)
            for k in range(1 + (len(centers) > 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, k].astype(np.int32)), batch.column("node"), batch.column("copies"),
                     pa.array(two[:, 0].astype(np.int32)), pa.array(two[:, 1].astype(np.int32)), batch.column("v")],
                    ["cluster", "node", "copies", "first", "second", "v"])

    return classes.select("node", "copies", "v").mapInArrow(
        run, "cluster int, node long, copies long, first int, second int, v array<double>")


def medoids(u: np.ndarray) -> np.ndarray:
    """Vertices nearest to the centres of the shard's own clusters."""
    n = min(MEDOIDS, len(u))
    return np.unique((u @ centroids(u, n).T).argmax(axis=0))


def robust(far: np.ndarray, between: np.ndarray, degree: int) -> np.ndarray:
    """Flags of the candidates taken (rows: vertices, candidates nearest first): each one taken removes
    those that are much nearer to it than to the vertex."""
    rows = np.arange(len(far))
    alive, taken = np.isfinite(far), np.zeros(far.shape, bool)
    for _ in range(min(degree, far.shape[1])):
        k = alive.argmax(axis=1)
        left = alive[rows, k]
        if not left.any():
            break
        taken[rows[left], k[left]] = True
        alive &= ~(left[:, None] & (ALPHA * between[rows, k] <= far))
        alive[rows, k] = False
    return taken


def pruned(u: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vertex of a shard, among its nearest vertices and nearest medoids.

    Edges also go backwards, pruned again, so that a dense group is reached from outside.
    """
    n = len(u)
    if n < 2:
        return [np.zeros(0, int)] * n
    centres = medoids(u)
    c, c2 = min(CANDIDATES, n - 1), min(CANDIDATES // 2, len(centres))
    out, nearest = [np.zeros(0, np.int64)] * n, np.zeros(n, np.int64)
    for start in range(0, n, 256):
        near = u[start:start + 256] @ u.T
        rows = np.arange(len(near))
        near[rows, rows + start] = -2
        nearest[start:start + 256] = near.argmax(axis=1)
        close = np.argpartition(-near, c - 1, axis=1)[:, :c]
        middle = centres[np.argpartition(-near[:, centres], c2 - 1, axis=1)[:, :c2]]
        for cand, degree in ((close, DEGREE), (middle, DEGREE // 3)):
            sim = np.take_along_axis(near, cand, axis=1)
            order = np.argsort(-sim, axis=1)
            cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
            far = np.where(sim > -2, 1 - sim, np.inf)
            taken = robust(far, 1 - np.einsum("icd,ied->ice", u[cand], u[cand]), degree)
            for i, (x, t) in enumerate(zip(cand, taken), start):
                out[i] = np.union1d(out[i], x[t])
    source = np.repeat(np.arange(n), [len(x) for x in out])
    target = np.concatenate(out)
    order = np.argsort(target, kind="stable")
    ends = np.searchsorted(target[order], np.arange(n + 1))
    for v in range(n):
        back = np.setdiff1d(source[order[ends[v]:ends[v + 1]]], out[v])
        if len(back):
            back = back[np.argsort(-(u[back] @ u[v]))]
            taken = robust((1 - u[back] @ u[v])[None], (1 - u[back] @ u[back].T)[None], DEGREE)
            out[v] = np.concatenate([out[v], back[taken[0]]])
    for v in range(n):
        if v not in out[nearest[v]]:
            out[nearest[v]] = np.append(out[nearest[v]], v)
    reached, front = np.zeros(n, bool), centres
    while len(front):
        reached[front] = True
        front = np.unique(np.concatenate([out[v] for v in front]))
        front = front[~reached[front]]
    # What no path from the medoids reaches hangs on its nearest vertex that one does.
    there, lost = np.flatnonzero(reached), np.flatnonzero(~reached)
    for start in range(0, len(lost), 256):
        part = lost[start:start + 256]
        for v, k in zip(part, (u[part] @ u[there].T).argmax(axis=1)):
            out[there[k]] = np.append(out[there[k]], v)
    return out


def build(shards: DataFrame) -> DataFrame:
    """node, neighbours: adjacency lists of all shards, united per class."""

    def run(shard: pa.Table) -> pa.Table:
        # Ordered as in the search, whose medoids are then those that all vertices are reached from.
        shard = shard.sort_by("node")
        nodes = shard["node"].to_numpy()
        lists = [nodes[x] for x in pruned(units(shard["v"]))]
        return pa.table({"node": nodes, "near": pa.array(lists, pa.list_(pa.int64()))})

    lists = shards.groupBy("dim", "cluster", "shard").applyInArrow(run, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def range_search(u: np.ndarray, near: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """For each query a row of flags: which vertices within the range the search came upon.

    ``near`` has the neighbours of each vertex, filled up with the vertex itself.
    """
    n, m = len(u), len(q)
    entry = medoids(u)
    seen, expanded = np.zeros((m, n), bool), np.zeros((m, n), bool)
    sims = np.full((m, n), -2.0)
    seen[:, entry] = True
    sims[:, entry] = q @ u[entry].T
    beam = min(BEAM, n)
    rows = np.arange(m)
    while len(rows):
        # The best of the beam that is not expanded; beyond the beam only vertices within the range are.
        s = sims[rows]
        open_ = np.where(expanded[rows], -2.0, s)
        k = open_.argmax(axis=1)
        top = open_[np.arange(len(rows)), k]
        edge = np.partition(s, n - beam, axis=1)[:, n - beam]
        go = (top > -2) & ((top >= edge) | (top >= least))
        rows, k = rows[go], k[go]
        if not len(rows):
            break
        expanded[rows, k] = True
        next_ = near[k]
        fresh = ~seen[rows[:, None], next_]
        i, j = np.nonzero(fresh)
        r, v = rows[i], next_[i, j]
        seen[r, v] = True
        sims[r, v] = np.einsum("ij,ij->i", q[r], u[v])
    return seen & (sims >= least - 1e-9)


def shard_links(shards: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """node, links (number of other vectors), root (a local component of the shard's links)."""
    rows = shards.join(graph, "node", "left")
    # A cluster of several shards: every two shards meet once, and each is searched for the other.
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    rows = rows.withColumn("other", other).withColumns({
        "low": F.least("shard", "other"), "high": F.greatest("shard", "other")})
    groups = rows.groupBy("dim", "cluster", "low", "high")

    def side(group: pa.Table, shard: int) -> tuple:
        base = group.filter(pa.array(group["shard"].to_numpy() == shard)).sort_by("node")
        nodes = base["node"].to_numpy()
        lists = [np.array(x or [], np.int64) for x in base["near"].to_pylist()]
        near = np.repeat(np.arange(len(nodes))[:, None], max(map(len, lists), default=0) or 1, axis=1)
        for i, x in enumerate(lists):
            at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
            here = at[nodes[at] == x]
            near[i, :len(here)] = here
        return nodes, units(base["v"]) if len(nodes) else None, near, base["copies"].to_numpy(), \
            [base[c].to_numpy() for c in ("first", "second")]

    def hits(u: np.ndarray, near: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([range_search(u, near, q[k:k + 256], least) for k in range(0, len(q), 256)])

    def run(group: pa.Table) -> pa.Table:
        cluster, low, high = (group[c][0].as_py() for c in ("cluster", "low", "high"))
        own, q, q_near, q_copies, q_pair = side(group, low)
        nodes, u, near, copies, pair = side(group, high) if high != low else (own, q, q_near, q_copies, q_pair)
        if not len(own) or not len(nodes):
            return pa.table({x: pa.array([], pa.int64()) for x in ("node", "links", "root")})
        found = hits(u, near, q)
        found = found | (found if high == low else hits(q, q_near, u)).T
        joined = []
        for start in range(0, len(q), 256):
            i, j = np.nonzero(found[start:start + 256])
            i += start
            # Verified in double precision, from the vectors themselves.
            good = (np.einsum("ij,ij->i", q[i], u[j]) >= least) & (own[i] != nodes[j])
            i, j = i[good], j[good]
            shared = np.stack([np.where(q_pair[a][i] == pair[b][j], q_pair[a][i], 1 << 30)
                               for a in (0, 1) for b in (0, 1)]).min(axis=0)
            mine = shared == cluster
            joined.append((i[mine], j[mine]))
        i, j = (np.concatenate(x) for x in zip(*joined))
        links = Counter()
        for names, count in ((own, np.bincount(i, copies[j], minlength=len(own))),
                             *([] if high == low else [(nodes, np.bincount(j, q_copies[i], minlength=len(nodes)))])):
            links.update(dict(zip(names.tolist(), count.astype(np.int64).tolist(), strict=True)))
        root = local_roots(own[i], nodes[j])
        return pa.table({"node": pa.array(list(links), pa.int64()), "links": pa.array(list(links.values()), pa.int64()),
                         "root": pa.array([root.get(x, x) for x in links], pa.int64())})

    return groups.applyInArrow(run, "node long, links long, root long")


def local_roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Smallest node of each local component, of the nodes that have a link; links go from a to b."""
    if not len(a):
        return {}
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return dict(zip(names.tolist(), names[label].tolist(), strict=True))
        label = low


def near_duplicates(vectors: DataFrame, vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    members, classes = classes_of(vectors, vector)
    linked, roots = None, None
    total = classes.count()
    if total:
        dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
        parts = []
        for dim in dims:
            own = classes.where(F.size("v") == dim)
            sample = own.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLE).select("v").toArrow()
            n = max(1, min(-(-total // PER_CENTROID), sample.num_rows // 8))
            centers = centroids(units(sample["v"]), n)
            parts.append(assign(own, centers).withColumn("dim", F.lit(dim)))
        placed = parts[0]
        for p in parts[1:]:
            placed = placed.unionByName(p)
        placed = kept(placed, "clusters")
        sizes = placed.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
        shards = placed.join(sizes, ["dim", "cluster"]).withColumn(
            "shard", F.pmod(F.xxhash64("node", F.lit(9)), F.col("shards")).cast("int"))
        shards = kept(shards, "shards")
        found = kept(shard_links(shards, build(shards), least), "links")
        linked = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = kept(connected(found.select("node", "root"), "node", "root"), "components")
    else:
        empty = classes.select("node")
        linked, roots = empty.withColumn("links", F.lit(0)), empty.withColumn("root", F.col("node"))
    firsts = members.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    named = firsts.join(linked, "node", "left").join(roots, "node", "left")
    named = kept(named.select("node", "low", F.coalesce("root", "node").alias("root"),
                              (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("node", "n_links", "component_id")
    out = members.join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(vectors: DataFrame, result: DataFrame, queries: int = 200, vector: str = "embedding",
          least: float = LEAST) -> float:
    """Share of the links of at most ``queries`` vectors (smallest hashed ids) that the result counts."""
    members, classes = classes_of(vectors, vector)
    asked = classes.orderBy(F.xxhash64("node", F.lit(4)), "node").limit(queries).toArrow()
    if not asked.num_rows:
        return 1.0
    ids, q = asked["node"].to_numpy(), units(asked["v"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (units(batch.column("v")) @ q.T >= least).T @ batch.column("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.astype(np.int64))], ["node", "n"])

    true = classes.select("v", "copies").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    one = members.groupBy("node").agg(F.min("vec_id").alias("vec_id"))
    both = true.join(one, "node").join(result.select("vec_id", "n_links"), "vec_id")
    found, wanted = both.agg(F.sum("n_links"), F.sum(F.col("n") - 1)).first()
    return 1.0 if not wanted else found / wanted
