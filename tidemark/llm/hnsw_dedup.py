"""Near-duplicate vectors by one navigable small-world graph per shard.

Equal vectors of a label are one node with a weight.  A label of more nodes than SHARD
is cut into cells: random directions, and each node lies in the cell of the one it
leans to most, seen from the label's middle.  Two linked vectors differ by a short step,
which a random direction sees as a normal deviate: a node is a query in each cell that
it leans to almost as much as to its own, by SURE deviations of that step (or, in few
dimensions, by as much as the step can be), once for each two cells.  That is all of
the search that is not measured by an audit; of links just at the threshold it loses
less than one in ten thousand, whatever the vectors are, and of closer ones far fewer.
A cell of more than SHARD nodes is dealt to shards by hash, each of which meets the
queries of those before it.

A shard's graph is built once, and its queries come to it in runs of SHARD at most.  The
graph has layers: each layer holds a share of the nodes below, and a search descends
from the top.  Queries walk the graph in lockstep, in numpy.  The shard's own nodes are
its first queries.

A shard's beam is widened as long as an audit - evenly spaced queries in hash order,
each against every vector of the shard, until LINKED of them have a link or none is
left - finds less than RECALL of a query's true links in the mean over those that have
one; a beam as wide as the shard is exact.  Near entries of beams give classes; within a
class all cosines are computed in double precision, in blocks, for the number of
links of each vector, and only links that span the class are emitted.  Components
are united from those by star rounds.

Defined cases: vectors that are null or zero or hold null or non-finite components,
and rows with a null label, link with nothing; vectors of different lengths do not
link; a null vec_id links with nothing and has a null component; rows that repeat a
vec_id are nodes of their own with that id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.store import Scratch, materialise

THRESHOLD = 0.98
SHARD = 20_000
RECALL = 0.999
#: Queries that an audit draws at a time, and how many of all drawn must have a link.
AUDITS, LINKED = 256, 64
NEIGHBOURS = 12
LAYER_SHARE = 16
BEAM = 32
#: Deviations of a linked vector's step that a query looks beyond its cell's border, and nodes that a label's middle is taken from, about.
SURE, MIDDLE = 4.0, 1000
#: Beam entries this far below the threshold still join classes, within which all is verified.
SLACK = 0.015


class Graph:
    """Layers of neighbour lists over unit vectors (float32 for the walk)."""

    def __init__(self, x: np.ndarray, m: int = NEIGHBOURS):
        self.x, self.m = x.astype(np.float32), m
        n = len(x)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (members, neighbours by member place)
        members = np.arange(n)
        while True:
            self.layers.append((members, self._connect(members)))
            if len(members) <= 4 * LAYER_SHARE:
                break
            members = members[:: LAYER_SHARE]
        self.layers.reverse()

    def _connect(self, members: np.ndarray) -> np.ndarray:
        """Neighbour places of each member: inserted in doubling batches, each searched for in the graph so far."""
        n, m = len(members), self.m
        x = self.x[members]
        nb = np.full((n, 2 * m), -1, np.int64)
        done = min(n, 256)
        self._link(x, nb, np.arange(done), *self._nearest(x[:done], x[:done], min(m, done - 1), own=True))
        while done < n:
            new = np.arange(done, min(n, 2 * done))
            for part in np.array_split(new, -(-len(new) // 2048)):
                ids, sims = search_layer(x, nb, x[part], np.zeros((len(part), 1), np.int64), max(BEAM, 2 * m), entries=min(done, 32), limit=done)
                inner, inner_sims = self._nearest(x[part], x[part], min(m, len(part) - 1), own=True)
                ids = np.concatenate((ids, np.where(inner >= 0, part[np.maximum(inner, 0)], -1)), 1)
                sims = np.concatenate((sims, inner_sims), 1)
                best = np.argsort(-sims, 1, kind="stable")[:, :m]
                self._link(x, nb, part, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1))
            done = int(new[-1]) + 1
        return nb

    @staticmethod
    def _nearest(a: np.ndarray, b: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = np.full((len(a), max(k, 0)), -1, np.int64), np.full((len(a), max(k, 0)), -np.inf, np.float32)
        if k <= 0:
            return ids, sims
        for lo in range(0, len(a), 512):
            s = a[lo : lo + 512] @ b.T
            if own:
                s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            top = np.argpartition(-s, k - 1, 1)[:, :k]
            ids[lo : lo + len(s)], sims[lo : lo + len(s)] = top, np.take_along_axis(s, top, 1)
        return ids, sims

    def _link(self, x: np.ndarray, nb: np.ndarray, of: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Edges in both directions; a full list keeps its nearest, of which some stay for spread."""
        m = self.m
        src = np.repeat(of, ids.shape[1])
        dst = ids.ravel()
        ok = (dst >= 0) & np.isfinite(sims.ravel()) & (src != dst)
        src, dst = src[ok], dst[ok]
        a, b = np.concatenate((src, dst)), np.concatenate((dst, src))
        touched = np.unique(a)
        old = nb[touched]
        oa = np.repeat(touched, old.shape[1])[old.ravel() >= 0]
        ob = old.ravel()[old.ravel() >= 0]
        a, b = np.concatenate((a, oa)), np.concatenate((b, ob))
        key = np.unique(a * len(x) + b)
        a, b = key // len(x), key % len(x)
        s = np.einsum("ij,ij->i", x[a], x[b])
        order = np.lexsort((-s, a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, a)
        place = np.arange(len(a)) - first
        size = np.searchsorted(a, a, "right") - first
        # the m nearest, and of the others evenly spaced ones, so that far links survive among many near copies
        rest = np.maximum(size - m, 1)
        slot = np.where(place < m, place, m + ((place - m) * m) // rest)
        keep = place < m
        far = ~keep
        _, once = np.unique(a[far] * (2 * m) + slot[far], return_index=True)
        keep[np.flatnonzero(far)[once]] = True
        a, b, slot = a[keep], b[keep], slot[keep]
        nb[touched] = -1
        nb[a, slot] = b

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of each query's beam, best first; -1 where there is none."""
        q = q.astype(np.float32)
        start = None
        for depth, (members, nb) in enumerate(self.layers):
            last = depth == len(self.layers) - 1
            x = self.x[members]
            entry = np.zeros((len(q), 1), np.int64) if start is None else start
            ids, sims = search_layer(x, nb, q, entry, beam if last else 4, entries=32 if start is None else 0)
            if last:
                return np.where(ids >= 0, members[np.maximum(ids, 0)], -1), sims
            nxt = self.layers[depth + 1][0]
            start = np.where(ids >= 0, np.searchsorted(nxt, members[np.maximum(ids, 0)]), -1)
        raise AssertionError


def search_layer(x: np.ndarray, nb: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, *, entries: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in lockstep: each step opens every query's best unopened beam entry."""
    n = limit or len(x)
    if entries:
        extra = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
        entry = np.concatenate((entry, np.broadcast_to(extra, (len(q), len(extra)))), 1)
    out_i, out_s = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
    for lo in range(0, len(q), 1024):
        qq, e = q[lo : lo + 1024], entry[lo : lo + 1024]
        rows = np.arange(len(qq))
        ids, sims, opened = _merge(np.full((len(qq), 0), -1), np.zeros((len(qq), 0), np.float32), np.zeros((len(qq), 0), bool), e, _sims(x, qq, e), beam)
        live = rows
        while len(live):
            score = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
            best = np.argmax(score, 1)
            ok = np.isfinite(score[np.arange(len(live)), best])
            live, best = live[ok], best[ok]
            if not len(live):
                break
            opened[live, best] = True
            new = nb[ids[live, best]]
            ids[live], sims[live], opened[live] = _merge(ids[live], sims[live], opened[live], new, _sims(x, qq[live], new), beam)
        out_i[lo : lo + len(qq)], out_s[lo : lo + len(qq)] = ids, sims
    return out_i, out_s


def _sims(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    s = np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], q)
    s[ids < 0] = -np.inf
    return s


def _merge(ids, sims, opened, new, new_sims, beam):
    """The beam's best of old and new entries, each node once; an opened copy wins."""
    ids, sims = np.concatenate((ids, new), 1), np.concatenate((sims, new_sims), 1).astype(np.float32)
    opened = np.concatenate((opened, np.zeros(new.shape, bool)), 1)
    order = np.lexsort((~opened, ids), axis=1)
    ids, sims, opened = (np.take_along_axis(v, order, 1) for v in (ids, sims, opened))
    twice = np.zeros(ids.shape, bool)
    twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims[twice | (ids < 0)] = -np.inf
    order = np.argsort(-sims, 1, kind="stable")[:, :beam]
    ids, sims, opened = (np.take_along_axis(v, order, 1) for v in (ids, sims, opened))
    ids[~np.isfinite(sims)] = -1
    if ids.shape[1] < beam:
        pad = beam - ids.shape[1]
        ids, sims, opened = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(opened, ((0, 0), (0, pad)))
    return ids, sims, opened


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


@dataclass
class Links:
    """What a shard found: the weight linked to each query, and by the queries to each node, links that span its classes, and the mean share of an audited query's links that it found."""

    near: np.ndarray
    back: np.ndarray
    a: np.ndarray
    b: np.ndarray
    recall: float


class Shard:
    """A graph of nodes (raw vectors in double precision) that is asked for links, run after run of queries.

    The walk gives classes of vectors that near entries connect; within a class, every
    query is held against every node in double precision, block by block, so that a
    large group is counted in full without its pairs being listed.
    """

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, threshold: float, recall: float = RECALL):
        self.nodes, self.weights, self.threshold, self.recall = nodes, weights, threshold, recall
        self.graph = Graph(nodes / np.linalg.norm(nodes, axis=1, keepdims=True))
        self.label = np.arange(len(nodes))  # classes of nodes, as far as the queries until now have shown

    def ask(self, queries: np.ndarray, weights: np.ndarray, same: np.ndarray) -> Links:
        """weights: of the queries; same: each query's own node, or -1."""
        qunit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        n, m = len(self.nodes), len(queries)
        audit, truth = _audit(queries, self.nodes, self.weights, same, self.threshold)
        beam = BEAM
        while True:
            ids, sims = self.graph.search(qunit, min(beam, n))
            rows, cols = np.nonzero((ids >= 0) & (sims >= self.threshold - SLACK))
            own = np.flatnonzero(same >= 0)
            label = _classes(m + n, np.concatenate((rows, own, m + np.arange(n))), np.concatenate((m + ids[rows, cols], m + same[own], m + self.label)))
            out = _verify(self.nodes, queries, self.weights, weights, same, label, self.threshold)
            out.recall = float((out.near[audit] / truth).mean()) if len(audit) else 1.0
            if out.recall >= self.recall or beam >= n:
                _, first, of = np.unique(label[m:], return_index=True, return_inverse=True)
                self.label = first[of]
                return out
            beam *= 2


def find_links(nodes: np.ndarray, queries: np.ndarray, weights: np.ndarray, same: np.ndarray, threshold: float, recall: float = RECALL) -> Links:
    """Links of one run of queries with nodes; weights: of the nodes; each query weighs 1."""
    return Shard(nodes, weights, threshold, recall).ask(queries, np.ones(len(queries), np.int64), same)


def _audit(queries: np.ndarray, nodes: np.ndarray, weights: np.ndarray, same: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries that have a link, and the weight linked to each: of evenly spaced ones, stride after stride, until LINKED are found."""
    stride = max(1, len(queries) // AUDITS)
    audit, truth = [], []
    # strides start at places spread over the first, so that each round is evenly spaced too
    for start in sorted(range(stride), key=lambda k: k * 0.6180339887498949 % 1):
        drawn = np.arange(start, len(queries), stride)
        hit = _cosines(queries[drawn], nodes) >= threshold
        own = np.flatnonzero(same[drawn] >= 0)
        hit[own, same[drawn[own]]] = False
        near = hit @ weights
        audit.append(drawn[near > 0])
        truth.append(near[near > 0])
        if sum(map(len, audit)) >= LINKED:
            break
    return (np.concatenate(audit), np.concatenate(truth)) if audit else (np.zeros(0, np.int64), np.zeros(0))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b))[None, :])


def _verify(nodes, queries, weights, query_weights, same, label, threshold, block: int = 1024) -> Links:
    m, n = len(queries), len(nodes)
    near, back, a, b = np.zeros(m, np.int64), np.zeros(n, np.int64), [], []
    order = np.argsort(label, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(label[order])) + 1, [m + n]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        members = order[lo:hi]
        q, c = members[members < m], members[members >= m] - m
        if not len(q) or not len(c) or (len(q) == 1 and len(c) == 1 and same[q[0]] == c[0]):
            continue
        # spanning links: each round joins a query's class with that of the nodes it links with
        name = {int(x): k for k, x in enumerate(c)}
        class_of, changed, first = np.arange(len(c)), True, True
        own = np.array([name.get(int(x), -1) for x in same[q]])
        while changed:
            changed = False
            for k in range(0, len(q), block):
                part = q[k : k + block]
                hit = _cosines(queries[part], nodes[c]) >= threshold
                mine = own[k : k + block]
                at = np.flatnonzero(mine >= 0)
                hit[at, mine[at]] = False
                if first:
                    near[part] += hit @ weights[c]
                    back[c] += query_weights[part] @ hit
                some = np.flatnonzero(hit.any(1))
                if first and len(some):
                    to = hit[some].argmax(1)
                    a.append(part[some])
                    b.append(c[to])
                hit[at, mine[at]] = True
                low = np.where(hit, class_of[None, :], len(c)).min(1)
                for r in np.flatnonzero(low < len(c)).tolist():
                    cols = np.flatnonzero(hit[r])
                    other = cols[class_of[cols] != low[r]]
                    if len(other):
                        changed = True
                        if not first or len(np.unique(class_of[other])) > 0:
                            for x in np.unique(class_of[other]).tolist():
                                a.append(part[r : r + 1])
                                b.append(c[other[class_of[other] == x][:1]])
                                class_of[class_of == x] = low[r]
            first = False
    none = np.zeros(0, np.int64)
    return Links(near, back, np.concatenate(a) if a else none, np.concatenate(b) if b else none, 1.0)


@lru_cache(maxsize=64)
def _directions(size: int, cells: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Random directions, one for each cell, and how much less than to its own cell's a vector may lean to another's and still be a step from that cell."""
    d = np.random.default_rng((size, cells)).normal(size=(cells, size))
    apart = np.sqrt(np.maximum(((d[:, None, :] - d[None, :, :]) ** 2).sum(2), 0)) if cells * cells * size < 1 << 22 else np.full((cells, cells), np.inf)
    return d, step * np.minimum(SURE * 2**0.5, apart) + 1e-9


def cells_of(unit: np.ndarray, middle: np.ndarray, cells: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the cell of each, and which other cells it is a query in (one row for each vector).

    Of two cells, the nodes of one are queries in the other, and each cell is asked by half of the others.
    """
    d, reach = _directions(unit.shape[1], cells, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    lean = (unit - middle) @ d.T
    cell = lean.argmax(1)
    other = np.arange(cells)
    asks = lean[np.arange(len(unit)), cell][:, None] - lean <= reach[cell]
    asks &= (cell[:, None] < other) ^ ((cell[:, None] + other) % 2 == 1)
    asks[np.arange(len(unit)), cell] = False
    return cell, asks


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_group": pdf["_group"].iloc[:1], "_middle": [_unit(np.array(pdf["_v"].tolist(), np.float64)).mean(0)]})


def _route(facts, threshold: float):
    """The columns with _cell and _asks (other cells); a label that facts lack is one cell. facts: how many cells a label has, and its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, asks = np.zeros(len(b), np.int32), [[] for _ in range(len(b))]
            names = np.array(b.column("_group").to_pylist(), object)
            for name in sorted(facts.value.keys() & set(names.tolist())):
                at = np.flatnonzero(names == name)
                cells, middle = facts.value[name]
                cell[at], to = cells_of(_unit(_matrix(b.column("_v").take(pa.array(at)))), middle, cells, threshold)
                for k in np.flatnonzero(to.any(1)).tolist():
                    asks[at[k]] = np.flatnonzero(to[k]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(asks, pa.list_(pa.int32()))], [*b.schema.names, "_cell", "_asks"])

    return run


def _ask(threshold: float, most: int):
    """u, v, near: from rows in the order of _key, a shard's own nodes first; counts have no second end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, names, rows, held = None, None, None, [], 0

        def flush(own: bool) -> Iterator[pa.RecordBatch]:
            nonlocal shard, names, rows, held
            if not rows:
                return
            x = np.concatenate([_matrix(r.column("_v")) for r in rows])
            name, weight = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("_node", "_weight"))
            rows, held = [], 0
            if own:
                shard, names = Shard(x, weight, threshold), name
            elif shard is None:  # queries of a shard without nodes
                return
            got = shard.ask(x, weight, np.arange(len(x)) if own else np.full(len(x), -1))
            some, of = np.flatnonzero(got.near), np.flatnonzero(got.back) if not own else np.zeros(0, np.int64)
            u = np.concatenate((name[some], names[of], name[got.a]))
            v = np.concatenate((name[some], names[of], names[got.b]))
            near = np.concatenate((got.near[some], got.back[of], np.zeros(len(got.a), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, near)], ["u", "v", "near"])

        was = True
        for b in batches:
            keys, own = np.array(b.column("_key").to_pylist(), object), np.asarray(b.column("_own"))
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (own[1:] != own[:-1])) + 1 if len(b) else []
            for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
                if hi == lo:
                    continue
                if keys[lo] != key or own[lo] != was:
                    yield from flush(was)
                    shard = shard if keys[lo] == key else None
                    key, was = keys[lo], bool(own[lo])
                rows.append(b.slice(lo, hi - lo))
                held += hi - lo
                if held >= most and not was:
                    yield from flush(was)
        yield from flush(was)

    return run


def deduplicate(vectors: DataFrame, *, threshold: float = THRESHOLD, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of vectors."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("string").alias("_label"), v.alias("_v"), F.coalesce(good, F.lit(False)).alias("_good"))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0))).withColumn("_node", F.xxhash64("_label", F.concat_ws(",", F.col("_v").cast("array<string>"))))
    if dict(vectors.dtypes)[vector_col] == "array<float>":  # the same values in half the bytes
        rows = rows.withColumn("_v", F.col("_v").cast("array<float>"))
    nodes = rows.where("_good").groupBy("_node").agg(F.min("_id").alias("_first"), F.count("*").alias("_weight"), F.any_value("_label").alias("_label"), F.any_value("_v").alias("_v"))
    scratch = Scratch(vectors.sparkSession)
    nodes = scratch.save(nodes.withColumn("_group", F.concat_ws("/", "_label", F.size("_v").cast("string"))).drop("_label"), "vector-nodes")
    total = nodes.count()
    # a label's cells are about half a shard, since they differ in size; few labels have any
    many = nodes.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") > shard).select("_group", "_n", F.ceil(2 * F.col("_n") / shard).cast("int").alias("_cells"))
    drawn = nodes.join(F.broadcast(many), "_group").where(F.pmod("_node", F.greatest(F.lit(1), F.col("_n").cast("long") / MIDDLE).cast("long")) == 0)
    middle = drawn.select("_group", "_v").groupBy("_group").applyInPandas(_middle, "_group string, _middle array<double>")
    facts = {r["_group"]: (r["_cells"], np.array(r["_middle"])) for r in many.join(middle, "_group").select("_group", "_cells", "_middle").toLocalIterator()}
    kind = dict(nodes.dtypes)["_v"]
    routed = nodes.select("_group", "_node", "_v", "_weight").mapInArrow(_route(vectors.sparkSession.sparkContext.broadcast(facts), threshold), f"_group string, _node long, _v {kind}, _weight long, _cell int, _asks array<int>")
    routed = scratch.save(routed, "vector-routed")
    # cells that are too large for one shard
    large = routed.groupBy("_group", "_cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("_shards")).where("_shards > 1")
    large = scratch.save(large, "vector-shards")
    shards = F.coalesce(F.col("_shards"), F.lit(1))
    placed = routed.join(F.broadcast(large), ["_group", "_cell"], "left").withColumn("_shards", shards).withColumn("_at", F.pmod("_node", F.col("_shards")).cast("int"))
    key = F.concat_ws("/", "_group", F.col("_cell").cast("string"), F.col("_at").cast("string")).alias("_key")
    sent = ("_node", "_v", "_weight")
    as_nodes = placed.select(key, F.lit(True).alias("_own"), *sent)
    later = placed.where("_shards > _at + 1").withColumn("_at", F.explode(F.sequence(F.col("_at") + 1, F.col("_shards") - 1)))
    beyond = routed.select("_group", F.explode("_asks").alias("_cell"), *sent).join(F.broadcast(large), ["_group", "_cell"], "left").withColumn("_at", F.explode(F.sequence(F.lit(0), shards - 1)))
    asked = as_nodes.unionByName(later.select(key, F.lit(False).alias("_own"), *sent)).unionByName(beyond.select(key, F.lit(False).alias("_own"), *sent))
    # several parts a shard, so that few parts have two
    parts = min(4096, 8 * (total // shard) + 24)
    asked = asked.repartition(parts, "_key").sortWithinPartitions("_key", F.desc("_own"), "_node")
    found = scratch.save(asked.mapInArrow(_ask(threshold, shard), "u long, v long, near long"), "vector-links")
    direct = found.where("near > 0").groupBy("u").agg(F.sum("near").alias("_near"))
    classes = connected_components(found.where("near = 0").select("u", "v"), scratch)
    placed = nodes.select("_node", "_first", "_weight").join(classes.select(F.col("id").alias("_node"), "component"), "_node", "left").join(direct.select(F.col("u").alias("_node"), "_near"), "_node", "left")
    placed = placed.withColumn("_class", F.coalesce("component", "_node")).withColumn("_links", F.coalesce("_near", F.lit(0)) + F.col("_weight") - 1)
    least = placed.groupBy("_class").agg(F.min("_first").alias("_least"))
    known = materialise(placed.join(least, "_class").select("_node", "_links", "_least"), "vector-classes")
    scratch.drop()
    out = rows.select("_id", F.when(F.col("_good"), F.col("_node")).alias("_node")).join(known, "_node", "left")
    component = F.coalesce("_least", "_id")
    return out.select(F.col("_id").alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
