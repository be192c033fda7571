"""Graph analytics: degree, orphans, components, connectivity, supersession chains and communities.

Iterative operators write each round to the shared folder, so plans stay short and a lost executor costs a round.
Superseded entities and SUPERSEDED_BY edges are part of the graph here.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import SUPERSEDED_BY
from ..sources.shared import small, work_dir, written


def degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges in and out of each entity; a self-loop counts twice, an entity without edges has 0."""
    ends = relations.select(F.explode(F.array("from", "to")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return entities.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without edges."""
    return entities.join(relations.select(F.explode(F.array("from", "to")).alias("id")), "id", "left_anti")


#: So many links are joined by union-find in one task, whose dictionary takes some 100 MB.
FEW_LINKS = 500_000


#: Louvain runs in one task on a component of so many different edges (some 400 MB), and in rounds of joins on a larger one.
FEW_EDGES = 1_500_000
#: Edges of small components that share a task; a component of more has its own.
SHARED_EDGES = 400_000
#: So many edges of an input partition are looked at together, before any are exchanged.
PIECE = 500_000
#: Components of so many edges in a piece have these packed, 200,000 edges a row.
PACKED, PACK = 1_000, 200_000


def connected(links: DataFrame, path: str) -> DataFrame:
    """(node, root) of all ends of the links (a, b), root being the least node of the component.

    At most FEW_LINKS links, which are counted, are joined in one task. More contract by alternating stars, so long
    chains need a logarithmic number of rounds, and the neighbours of a node are only aggregated and joined,
    never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}/0")
    kind = edges.schema["u"].dataType.simpleString()
    if edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_united, f"node {kind}, root {kind}")
    before, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), f"{path}/{k}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = large.join(least, "u").select(pairs.alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(edges, f"{path}/{k}b")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, k = now, k + 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (u, v), by union-find."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], ["node", "root"])


def components(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, component) for all entities, component being the least id of the weak component.

    Edges to unknown ids are left out.
    """
    ids = entities.select("id")
    known = relations.select(F.col("from").alias("a"), F.col("to").alias("b"))
    known = known.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    roots = connected(known, work_dir(entities.sparkSession)).withColumnRenamed("node", "id")
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def connectivity(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (component, size, first, isMain), the main one being the first of the largest, and their members
    (component, seq, id, isMain), a row an id: a component may be of any size, so its ids are never one value."""
    member = components(entities, relations).join(entities.select("id", "seq"), "id")
    member = written(member, f"{work_dir(entities.sparkSession)}/member")
    out = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"))
    main = out.agg(F.max_by("component", F.struct("size", -F.col("first"))).alias("main"))
    is_main = (F.col("component") == F.col("main")).alias("isMain")
    sizes = out.join(F.broadcast(main)).select("component", "size", "first", is_main)
    return sizes, member.join(F.broadcast(main)).select("component", "seq", "id", is_main)


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: nodes, edges, layers, orphans, components, share of the largest, and islands (of 2 nodes or more, not the largest)."""
    sizes = components(entities, relations).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    largest = F.coalesce(F.max("size"), F.lit(0))
    by = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    whole = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("components"),
        largest.alias("largest"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("n"))), F.lit(0)).alias("several"),
        F.coalesce(F.max_by("n", "size"), F.lit(0)).alias("as_large"),
    )
    nodes = entities.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("layer") == "evidence").alias("evidence"), F.count_if(F.col("layer") == "pattern").alias("pattern")
    )
    one = nodes.crossJoin(relations.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(
        orphans(entities, relations).agg(F.count(F.lit(1)).alias("orphans"))
    ).crossJoin(whole)
    islands = F.when(F.col("largest") > 1, F.col("several") - F.col("as_large")).otherwise(F.lit(0))
    share = F.when(F.col("nodes") > 0, F.col("largest") / F.col("nodes")).otherwise(F.lit(0.0))
    return one.select("nodes", "edges", "evidence", "pattern", "orphans", "components", "largest", share.alias("connectivity"), islands.alias("islands"))


def first_successors(relations: DataFrame) -> DataFrame:
    """(from, to) of the first SUPERSEDED_BY edge out of each node."""
    return relations.where(F.col("type") == SUPERSEDED_BY).groupBy("from").agg(F.min_by("to", "seq").alias("to"))


def supersession_chain(entities: DataFrame, relations: DataFrame, id_: str) -> DataFrame:
    """(id, position) from the origin to the tip of an entity's chain; nothing for an unknown id.

    Backwards by the supersedes pointer, forwards by the first SUPERSEDED_BY edge. All chains are walked at once by
    pointer doubling, so a chain may be of any length. An entity on a cycle, which has no origin, is its own chain.
    """
    ids = entities.select("id")
    known = lambda pairs: pairs.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    back = known(entities.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("from")).agg(F.min_by("id", "seq").alias("to")))
    ahead = known(first_successors(relations)).join(back, ["from"], "left_anti")
    ahead = ahead.join(back.select("to"), "to", "left_anti").groupBy("to").agg(F.min("from").alias("from"))
    chains = written(all_chains(back.unionByName(ahead)), f"{work_dir(entities.sparkSession)}/chains")
    own = chains.where(F.col("id") == id_).select("origin")
    mine = chains.join(F.broadcast(own), "origin").select("id", F.col("position").cast("int").alias("position"))
    alone = ids.where(F.col("id") == id_).join(chains.select("id"), "id", "left_anti").select("id", F.lit(0).alias("position"))
    return mine.unionByName(alone)


def all_chains(successors: DataFrame) -> DataFrame:
    """(id, origin, position) for all nodes of chains (from, to) by pointer doubling: a logarithmic number of joins.

    Each node has at most one predecessor and one successor; nodes of cycles, which have no origin, are left out.
    """
    path = work_dir(successors.sparkSession)
    nodes = successors.select(F.col("from").alias("id")).unionByName(successors.select(F.col("to").alias("id"))).distinct()
    back = nodes.join(successors.select(F.col("to").alias("id"), F.col("from").alias("up")), "id", "left").select(
        "id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("position")
    )
    k, before = 0, None
    while True:
        back = written(back, f"{path}/{k}")
        now = back.agg(F.sum("position"), F.count(F.lit(1))).first()
        if now == before or k > 40:
            break
        up = back.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("position").alias("more"))
        back, before, k = back.join(up, "up").select(
            "id",
            F.col("further").alias("up"),
            (F.col("position") + F.when(F.col("further") == F.col("up"), F.lit(0)).otherwise(F.col("more"))).alias("position"),
        ), now, k + 1
    tops = nodes.join(successors.select(F.col("to").alias("id")), "id", "left_anti").select(F.col("id").alias("up"))
    return back.join(tops, "up", "left_semi").select("id", F.col("up").alias("origin"), "position")


def modularity(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity, at resolution 1, of the partition (id, community) of the undirected graph of the edges; 0 without edges."""
    a = labels.select(F.col("id").alias("from"), F.col("community").alias("ca"))
    b = labels.select(F.col("id").alias("to"), F.col("community").alias("cb"))
    edges = relations.select("from", "to").join(a, "from").join(b, "to")
    inside = edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum((F.col("ca") == F.col("cb")).cast("double")), F.lit(0.0)).alias("inside"))
    squares = edges.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("d")).agg(
        F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("dd")
    )
    return inside.crossJoin(squares).select(
        F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).otherwise(F.lit(0.0)).alias("modularity")
    )


def communities(
    entities: DataFrame, relations: DataFrame, algorithm: str = "louvain", seed: int = 0x43065EED, min_size: int = 1, most: int = 500
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Communities (community, size), largest first, their members (community, id) and their modularity.

    At most FEW_EDGES different edges, which are counted, are taken by Louvain's method in one task. Of more, each component is
    taken so: gains ask for the whole graph's number of edges only, so components do not hang on one another. A component of more
    than FEW_EDGES goes in rounds: every node looks for the neighbouring community of the largest gain. In even rounds it may
    only go to a lesser label, in odd ones only a seeded half of the nodes may go, so that neighbours do not swap
    sides; a round that does not raise modularity is undone, and four such rounds in a row end a level. Then communities become
    nodes of the next level, until a level moves nothing. Each round is joins and aggregates over edges, so the graph may be
    of any size. A level of over ``most`` rounds is an error.
    """
    if algorithm != "louvain":
        raise ValueError(f"unknown algorithm {algorithm}")
    path = work_dir(entities.sparkSession)
    ids = entities.select("id")
    pairs = relations.select(F.col("from").alias("u"), F.col("to").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pieces, odd = _in_pieces(pairs, ids, f"{path}/all")
    if not odd.where("not known").isEmpty():
        unknown = small(odd.where("not known").select("node").distinct())
        for end in "uv":
            pairs = pairs.join(unknown.withColumnRenamed("node", end), end, "left_anti")
        pieces, odd = _in_pieces(pairs, ids, f"{path}/known")
    edges = pieces.where("node IS NULL").select("u", "v", "w", "root", "pack", "n")
    total = 2 * (edges.agg(F.sum("w")).first()[0] or 0.0)
    if not total:
        found = edges.select(F.col("u").alias("id"), F.col("v").alias("found"))
    elif edges.agg(F.sum("n")).first()[0] <= FEW_EDGES:
        found = _in_one_task(edges.select(EDGES), total, seed)
    else:
        links = odd.where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
        found = _by_components(edges, links, total, seed, most, path)
    member = ids.join(found, "id", "left").select("id", F.coalesce("found", "id").alias("community"))
    member = written(member, f"{path}/member")
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return sizes.orderBy(F.desc("size"), "community"), member.select("community", "id"), modularity(relations, member)


def _in_pieces(pairs: DataFrame, ids: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, w, root, pack, n), each once a piece of the input, or n of them in a pack, and their ends (node, root), root being the least
    node of the component in the piece; and of the ends those (node, root, least, known) that are no ids, or have a lesser root in another piece."""
    pieces = written(pairs.mapInArrow(_pieces, "root string, node string, u string, v string, w double, pack binary, n bigint"), f"{path}/pieces")
    ends = pieces.where("node IS NOT NULL").select("node", "root", F.lit(False).alias("known"))
    ends = ends.unionByName(ids.select(F.col("id").alias("node"), F.lit(None).cast("string").alias("root"), F.lit(True).alias("known")))
    same = Window.partitionBy("node")
    ends = ends.select("node", "root", F.min("root").over(same).alias("least"), F.max("known").over(same).alias("known"))
    return pieces, written(ends.where("root IS NOT NULL AND (NOT known OR root <> least)"), f"{path}/odd")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edges and of ends for each PIECE edges (u, v)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PIECE:
            yield from _piece(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _piece(pa.Table.from_batches(held))


def _piece(edges: pa.Table) -> Iterator[pa.RecordBatch]:
    names, u, v = _coded(edges)
    n = len(names)
    u, v, w = _summed(np.minimum(u, v), np.maximum(u, v), np.ones(len(u)), n)
    root, a, b = np.arange(n), u, v
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = a[a < b], b[a < b]
        np.minimum.at(root, b, a)
        while (root[root] < root).any():
            root = root[root]
    here = root[u]
    heavy = np.bincount(here, minlength=n) >= PACKED
    packed, packs = heavy[here], []
    for r in np.flatnonzero(heavy):
        mine = np.flatnonzero(here == r)
        for k in range(0, len(mine), PACK):
            some = mine[k : k + PACK]
            own, codes = np.unique(np.concatenate((u[some], v[some])), return_inverse=True)
            ends = pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), names.take(pa.array(own)))
            sink = pa.BufferOutputStream()
            rows = pa.record_batch([ends[: len(some)], ends[len(some) :], pa.array(w[some])], ["u", "v", "w"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            packs.append((r, w[some].sum(), sink.getvalue().to_pybytes(), len(some)))
    here, u, v, w = (x[~packed] for x in (here, u, v, w))
    take = lambda codes: names.take(pa.array(codes, pa.int64()))
    yield from _rows(root=take(here), u=take(u), v=take(v), w=pa.array(w), n=pa.array(np.ones(len(u), np.int64)))
    yield from _rows(root=take(root), node=names)
    for r, weight, pack, k in packs:
        yield from _rows(root=take([r]), w=pa.array([weight]), pack=pa.array([pack], pa.binary()), n=pa.array([k], pa.int64()))


def _rows(**columns: pa.Array) -> list[pa.RecordBatch]:
    """Rows of pieces, null where nothing is given."""
    kinds = {"root": pa.string(), "node": pa.string(), "u": pa.string(), "v": pa.string(), "w": pa.float64(), "pack": pa.binary(), "n": pa.int64()}
    n = len(columns["root"])
    return pa.table({c: columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()}).to_batches(50_000)


EDGES = ["u", "v", "w", "pack"]


def _unpacked(edges: pa.Table) -> pa.Table:
    """(u, v, w) of rows (u, v, w, pack)."""
    kinds = pa.schema([("u", pa.string()), ("v", pa.string()), ("w", pa.float64())])
    plain = edges.filter(pc.is_null(edges["pack"])).select(kinds.names).cast(kinds)
    packs = edges["pack"].drop_null().to_pylist()
    return pa.concat_tables([plain, *(pa.ipc.open_stream(x).read_all().cast(kinds) for x in packs)])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _unpacked(pa.Table.from_batches([batch])).to_batches(50_000)


def _coded(edges: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ends of edges in their order, and the places of u and of v in it."""
    both = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    codes = place[both.indices.to_numpy()]
    return both.dictionary.take(order), codes[: len(edges)], codes[len(edges) :]


def _in_one_task(edges: DataFrame, total: float, seed: int) -> DataFrame:
    """(id, found) of edges (u, v, w, pack) that hold each one once or in parts."""
    return edges.coalesce(1).mapInArrow(lambda batches: _all_at_once(batches, total, seed), FOUND)


def _all_at_once(batches: Iterator[pa.RecordBatch], total: float, seed: int) -> Iterator[pa.RecordBatch]:
    held = [*batches]
    if held:
        yield from _louvain(_unpacked(pa.Table.from_batches(held)), total, seed).to_batches(50_000)


def _by_components(edges: DataFrame, links: DataFrame, total: float, seed: int, most: int, path: str) -> DataFrame:
    """(id, found) of edges (u, v, w, root, pack, n): small components in tasks of some, larger ones in a task each, the largest by rounds."""
    tops = connected(links, f"{path}/roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = small(written(tops, f"{path}/tops"))
    edges = edges.join(tops, "root", "left").select(*EDGES, F.coalesce("top", "root").alias("root"), "n")
    sizes = edges.groupBy("root").agg(F.sum("n").alias("all"))  # an edge of several pieces counts as several
    alone = F.col("all") > SHARED_EDGES
    sizes = written(sizes.groupBy(F.when(alone, F.col("root")).alias("root")).agg(F.sum("all").alias("all")), f"{path}/sizes")
    shared = sizes.where("root IS NULL").agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    own = F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(shared // SHARED_EDGES + 1)).cast("string"))
    large = F.coalesce(F.col("all") > FEW_EDGES, F.lit(False)).alias("large")
    dealt = edges.join(small(sizes.where("root IS NOT NULL")), "root", "left")
    dealt = dealt.select(*EDGES, own.alias("task"), F.coalesce(alone, F.lit(False)).alias("alone"), large)
    few = dealt.where("not large").select("task", "alone", *EDGES)
    found = few.groupBy("task", "alone").applyInArrow(lambda t: _louvain(_unpacked(t.select(EDGES)), total, seed), FOUND)
    if sizes.where(F.col("root").isNotNull() & (F.col("all") > FEW_EDGES)).isEmpty():
        return found
    rest = dealt.where("large").select(EDGES).mapInArrow(_unpack, "u string, v string, w double")
    both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    return found.unionByName(_by_rounds(written(both, f"{path}/edges_large"), total, seed, most, path))


def _by_rounds(edges: DataFrame, total: float, seed: int, most: int, path: str) -> DataFrame:
    """(id, found) of edges that hold each one both ways, by levels of rounds until one task takes the rest."""
    member = written(edges.select(F.col("u").alias("id")).distinct().withColumn("found", F.col("id")), f"{path}/member0")
    level, moved = 0, True
    while moved:
        label = _level(edges, total, seed, most, f"{path}/{level}")
        moved = not label.where("u <> c").isEmpty()
        level += 1
        member = written(_relabelled(member, label), f"{path}/member{level}")
        a, b = label.select("u", F.col("c").alias("cu")), label.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        edges = edges.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        edges = written(edges, f"{path}/edges{level}")
        once = edges.where("u <= v").withColumn("w", F.when(F.col("u") == F.col("v"), F.col("w") / 2).otherwise(F.col("w")))
        if moved and once.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
            return _relabelled(member, _in_one_task(once.withColumn("pack", F.lit(None).cast("binary")).select(EDGES), total, seed).toDF("u", "c"))
    return member


def _relabelled(member: DataFrame, label: DataFrame) -> DataFrame:
    return member.join(label.select(F.col("u").alias("found"), "c"), "found", "left").select("id", F.coalesce("c", "found").alias("found"))


FOUND = "id string, found string"


def _louvain(edges: pa.Table, total: float, seed: int) -> pa.Table:
    """(id, found): the same in one task, node after node in a seeded order, for edges (u, v, w) that hold each one once or in parts."""
    names, u, v = _coded(edges)
    n = len(names)
    u, v, w = _summed(np.concatenate((u, v)), np.concatenate((v, u)), np.tile(edges["w"].to_numpy(), 2), n)
    label = _followed(u, v, n)
    home = np.arange(n)
    while True:
        _, label = np.unique(label, return_inverse=True)
        home, m = label[home], int(label.max(initial=-1)) + 1
        u, v, w = _summed(label[u], label[v], w, m)
        label, n = _settled(u, v, w, m, total, random.Random(seed)), m
        if len(np.unique(label)) == n:
            break
    first = np.unique(home, return_index=True)[1]  # a community is named by its least member
    return pa.table({"id": names, "found": names.take(pa.array(first[home]))})


def _summed(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges sorted by (u, v), each once with the sum of its weights."""
    key = u * n + v
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[start]
    return key // n, key % n, np.add.reduceat(w[order], start) if len(start) else w


def _followed(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Labels that put each node of one neighbour and no loop into that neighbour's community, where it is in any best partition."""
    near, label = np.bincount(u, minlength=n), np.arange(n)
    leaf = near[u] == 1
    leaf &= (u != v) & ((near[v] > 1) | (v < u))
    label[u[leaf]] = v[leaf]
    return label


#: Levels of so many nodes at most, with BATCHES edges a node or more, hold the weight between each node and community. In levels of over SWEPT
#: edges, nodes go in so many batches first.
DENSE, SWEPT, BATCHES = 3_000, 20_000, 64


def _settled(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, total: float, rng: random.Random) -> np.ndarray:
    """Labels of nodes when no node gains by going to a neighbour's community, for edges sorted by (u, v).

    After the first pass only nodes are asked again a neighbour of which has moved away from them, and all when none of these moves.
    """
    strength = np.bincount(u, w, n)
    off = u != v
    u, v, w = u[off], v[off], w[off]
    order = np.unique(u).tolist()  # one without neighbours stays
    rng.shuffle(order)
    if n <= DENSE and len(u) >= BATCHES * n:
        return _settled_dense(u, v, w, strength, total, order)
    label = np.arange(n)
    if len(u) > SWEPT:
        label, settled = _swept(u, v, w, strength, total, np.concatenate((order, np.setdiff1d(np.arange(n), order))).astype(np.int64))
        if settled:
            return label
    volume = np.bincount(label, strength, n).tolist()
    start = np.concatenate(([0], np.cumsum(np.bincount(u, minlength=n)))).tolist()
    ends, weights, label, strength = v.tolist(), w.tolist(), label.tolist(), strength.tolist()
    asked, whole = bytearray(b"\1") * n, True
    while True:
        moved = False
        for x in order:
            if not asked[x]:
                continue
            asked[x] = 0
            own, k, into = label[x], strength[x], {}
            near = ends[start[x] : start[x + 1]]
            for y, z in zip(near, weights[start[x] : start[x + 1]], strict=True):
                c = label[y]
                into[c] = into.get(c, 0.0) + z
            volume[own] -= k
            part = k / total
            best, gain = own, into.get(own, 0.0) - part * volume[own]
            for c, z in into.items():
                g = z - part * volume[c]
                if g > gain + 1e-9 or (g == gain and best != own and c < best):
                    best, gain = c, g
            volume[best] += k
            if best != own:
                label[x], moved = best, True
                for y in near:
                    if label[y] != best:
                        asked[y] = 1
        if not moved and whole:
            return np.array(label, np.int64)
        whole = not moved
        if whole:
            asked = bytearray(b"\1") * n


def _settled_dense(u: np.ndarray, v: np.ndarray, w: np.ndarray, strength: np.ndarray, total: float, order: list[int]) -> np.ndarray:
    """The same, with the weights from each node into each community as a matrix."""
    n = len(strength)
    each = np.zeros((n, n))
    each[u, v] = w
    into, label, volume, part = each.copy(), np.arange(n), strength.copy(), strength / total
    moved = True
    while moved:
        moved = False
        for x in order:
            own = label[x]
            volume[own] -= strength[x]
            gain = into[x] - part[x] * volume
            stay = gain[own]
            gain[into[x] <= 1e-9] = -np.inf
            best = int(gain.argmax())
            if gain[best] > stay + 1e-9:
                label[x], moved = best, True
                into[:, own] -= each[x]
                into[:, best] += each[x]
            volume[label[x]] += strength[x]
    return label


def _swept(u: np.ndarray, v: np.ndarray, w: np.ndarray, strength: np.ndarray, total: float, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Labels after passes over batches of nodes whose moves are made at once, until no node gains, which is told, or small batches do not help."""
    n = len(strength)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    by = np.argsort(at[u] * n + v)
    u, v, w = at[u[by]], at[v[by]], w[by]  # nodes are known by their places in the order
    strength, label, part = strength[order], np.arange(n), strength[order] / total
    volume = strength.copy()
    asked, best, whole, batches = np.ones(n, bool), -np.inf, True, BATCHES
    while True:
        moves, before = 0, label.copy()
        bounds = np.linspace(0, n, batches + 1).astype(np.int64)
        cuts = np.searchsorted(u, bounds)
        for i, j, a, b in zip(bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True):
            open_ = asked[u[a:b]]
            x, y, z = u[a:b][open_], v[a:b][open_], w[a:b][open_]
            asked[i:j] = False
            if not len(x):
                continue
            key = (x - i) * n + label[y]
            by = np.argsort(key)
            key = key[by]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            into, key = np.add.reduceat(z[by], start), key[start]
            node, c = key // n + i, key % n
            own = label[node]
            gain = into - part[node] * (volume[c] - np.where(c == own, strength[node], 0.0))
            first = np.flatnonzero(np.diff(node, prepend=-1))
            one = node[first]
            most = np.maximum.reduceat(gain, first)
            tops = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(node))))
            tops = tops[np.flatnonzero(np.diff(node[tops], prepend=-1))]
            stay = -part[one] * (volume[label[one]] - strength[one])
            mine = np.flatnonzero(c == own)
            stay[np.searchsorted(one, node[mine])] = gain[mine]
            go = most > stay + 1e-9
            one, to = one[go], c[tops[go]]
            np.subtract.at(volume, label[one], strength[one])
            np.add.at(volume, to, strength[one])
            label[one] = to
            moves += len(one)
            gone = np.zeros(j - i, bool)
            gone[one - i] = True
            far = gone[x - i]
            far[far] = label[y[far]] != label[x[far]]
            asked[y[far]] = True
        settled = whole and not moves
        if moves:
            quality = w[label[u] == label[v]].sum() / total - np.square(volume / total).sum()
            if quality <= best:  # moves of a batch stood against each other
                label, volume, batches, whole = before, np.bincount(before, strength, n), 4 * batches, True
                asked[:] = True
                if 8 * batches > n:
                    break
                continue
            best = quality
        if settled:
            break
        whole = not moves
        if whole:
            asked[:] = True
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out, settled


def _level(edges: DataFrame, total: float, seed: int, most: int, path: str) -> DataFrame:
    """Labels (u, c) of a level, when rounds have stopped to raise modularity."""
    strength = written(edges.groupBy("u").agg(F.sum("w").alias("k")), f"{path}_k")
    label = written(strength.select("u", F.col("u").alias("c")), f"{path}_labels")
    best, failed, r = float(_gain(edges, label, strength, total).first()[0]), 0, 0
    while failed < 4:
        if r == most:
            raise RuntimeError(f"communities still move after {most} rounds of a level")
        moves = written(_moves(edges, label, strength, total, r, seed), f"{path}_labels{r}")
        now = float(_gain(edges, moves, strength, total).first()[0])
        failed = 0 if now > best + 1e-9 else failed + 1
        if not failed:
            label, best = moves, now
        r += 1
    return label


def _moves(edges: DataFrame, label: DataFrame, strength: DataFrame, total: float, r: int, seed: int) -> DataFrame:
    """Labels after round r."""
    volume = label.join(strength, "u").groupBy("c").agg(F.sum("k").alias("vol"))
    near = edges.where("u <> v").join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("into"))
    own = label.withColumnRenamed("c", "own")
    options = near.join(volume, "c").join(strength, "u").join(own, "u")
    gain = F.col("into") - F.col("k") * (F.col("vol") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
    staying = near.join(own, (near["u"] == own["u"]) & (near["c"] == own["own"])).select(near["u"], F.col("into").alias("now"))
    if r % 2 == 0:  # all nodes, to lesser labels only, so that no two of them swap
        options = options.where("c < own")
    top = options.withColumn("gain", gain).groupBy("u").agg(F.min_by(F.struct("c", "gain"), F.struct(-F.col("gain"), "c")).alias("b"))
    stay = (F.coalesce("now", F.lit(0.0)) - F.col("k") * (F.col("vol") - F.col("k")) / total).alias("stay")
    rest = own.join(strength, "u").join(volume.withColumnRenamed("c", "own"), "own").join(staying, "u", "left").select("u", "own", stay)
    may = F.pmod(F.xxhash64("u", F.lit(seed + r)), F.lit(2)) >= r % 2
    goes = (F.col("b.gain") > F.col("stay") + 1e-9) & may
    return rest.join(top, "u", "left").select("u", F.when(goes, F.col("b.c")).otherwise(F.col("own")).alias("c"))


def _gain(edges: DataFrame, label: DataFrame, strength: DataFrame, total: float) -> DataFrame:
    """Modularity of labels (u, c) on the weighted graph that holds each edge both ways."""
    a, b = label.select("u", F.col("c").alias("cu")), label.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    inside = edges.join(a, "u").join(b, "v").where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i"))
    volume = label.join(strength, "u").groupBy("c").agg(F.sum("k").alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("ss"))
    return inside.crossJoin(volume).select(F.col("i") / total - F.col("ss") / (total * total))
