"""Near-duplicate detection with an LSH forest over MinHash signatures, links confirmed on full shingle sets.

A text's set of word shingles is known by a 64-bit hash, so equal sets are one node from the start.

Forest: each of TREES trees sorts the nodes by its own DEPTH MinHash values. A node's candidates are its neighbours
in an order with the longest common prefix: those with whom it shares a region. Regions share two values at first;
one of more than REGION nodes is split by further values, one by one, so depth is adapted to each region. In a region
signatures estimate likeness, and each node keeps its NEAREST best pairs; in one that stays larger than REGION at
full depth a node meets the NEAREST that follow it in the sorted order. A node's NEAREST best pairs of all trees are
confirmed on full sets and joined, its best first, then those between different components.

What the forest may have missed lies between components: in regions that were split, and in those with a crowded
node, which had more pairs than were tried. All nodes of such regions with more than one component go through an exact
join: two sets of likeness t share one of the rarest (1 - t) n + 1 shingles of either, so nodes meet by these. Rare
ones gather few nodes, whose pairs are estimated, then confirmed. Frequent ones that occur in one node together form
a cluster; a cluster is dealt into blocks, and every two blocks that are not of one component are compared exactly,
set by set, by a task that gives back links only. So work and shuffle follow the input but for texts of different
components that share even their rarest shingles with many others. Only ids, counts and tables of fixed size ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import kept, mix, partitions, sliced, small, text_buffer, tidy, word_hashes, work_dir

TREES, DEPTH, REGION, NEAREST = 20, 6, 512, 4
_rng = np.random.default_rng(20240311)
_SALT = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD2 = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Bits of the bitmap of nodes whose sets are read again, as a power of two, and the slices it is built in.
BITMAP, SLICES = 24, 16
#: Cells, as a power of two, in which shingles are counted to put them in order of frequency.
CELLS = 20
#: A shingle of at most so many nodes is rare: their pairs are estimated in one group.
RARE = 256
#: Shingles a block, each node counting for NODE_WEIGHT more.
BLOCK, NODE_WEIGHT = 400_000, 400
#: So many keys, of 8 bytes each, are broadcast; more meet the documents by a shuffle of both.
FEW_DROPPED = 500_000
NODE = "node long"


# ---------------------------------------------------------------- sets and signatures


def shingle_sets(arr: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; of fewer words than width, one of all; none without words."""
    words, first = word_hashes(*text_buffer(arr))
    rolled = words.copy()
    for k in range(1, min(width, len(words))):
        rolled[: len(words) - k] = mix(rolled[: len(words) - k] * np.uint64(0xC2B2AE3D27D4EB4F)) + words[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F)) + words[k]
            out.append(mix(mix(h) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(
        mix(
            np.asarray([np.bitwise_xor.reduce(mix(shingles)), np.sum(shingles, dtype=np.uint64), len(shingles)], np.uint64)
        ).dot(np.asarray([3, 5, 7], np.uint64)).view(np.int64)
    )


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit MinHash values, a row a set; no set may be empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    i = 0
    while i < len(sets):
        j, total = i + 1, len(sets[i])
        while j < len(sets) and total < 60_000:
            total += len(sets[j])
            j += 1
        every = np.concatenate(sets[i:j])
        low, high = every.astype(np.uint32), (every >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(x) for x in sets[i : j - 1]])
        for k in range(TREES * DEPTH):
            out[i:j, k] = np.minimum.reduceat((low ^ _SALT[k]) * _ODD[k] + high * _ODD2[k], starts)
        i = j
    return out


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[text_col], docs[id_col])


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id, its key (a hash of id and text), n, node, and once a task for each node its 16-bit signature and first keys of its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in sliced(batch, 1):
                sets = shingle_sets(part.column(1), width)
                nodes = [set_id(s) if len(s) else None for s in sets]
                new = []
                for k, node in enumerate(nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        new.append(k)
                if len(seen) > 500_000:
                    seen.clear()
                values = minhashes([sets[k] for k in new])
                tree = values.reshape(len(new), TREES, DEPTH)[:, :, :2].astype(np.uint64)
                keys = mix(
                    ((tree[:, :, 0] << np.uint64(32)) | tree[:, :, 1]) + np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                ).view(np.int64)
                signature, first = [None] * len(nodes), [None] * len(nodes)
                for row, k in enumerate(new):
                    signature[k] = values[row].astype("<u2").tobytes()
                    first[k] = keys[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(signature, pa.binary()),
                        pa.array(first, pa.list_(pa.int64())),
                    ],
                    ["id", "key", "n", "node", "signature", "keys"],
                )

    ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), _row_key(docs, id_col, text_col).alias("key"))
    return ids.mapInArrow(tidy(run), f"id {ids.schema['id'].dataType.simpleString()}, key long, n long, {NODE}, signature binary, keys array<long>")


# ---------------------------------------------------------------- forest


def _regions(nodes: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """All regions of two nodes or more, and the final ones: each (region, node, tree, size).

    Sizes are written before they are joined, so that a join of a large region may be split over tasks.
    """
    placed, done, depth = nodes.select("node", F.posexplode("keys").alias("tree", "region")), [], 2
    while True:
        sizes = kept(placed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{path}/sizes{depth}")
        placed = kept(placed.join(sizes, "region").select("region", "node", "tree", "size"), f"{path}/regions{depth}")
        first = placed if depth == 2 else first
        large = placed.where(F.col("size") > REGION)
        if depth == DEPTH or not large.head(1):
            done.append(placed)
            break
        done.append(placed.where(F.col("size") <= REGION))
        deeper = F.substring("signature", F.col("tree") * DEPTH * 2 + depth * 2 + 1, 2)
        placed = large.join(nodes.select("node", "signature"), "node").select("node", "tree", F.xxhash64("region", deeper, F.lit(depth)).alias("region"))
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return first, out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of batches sorted by their first column, a table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != region[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), TREES * DEPTH)


def _pairs(
    n: np.ndarray, signature: np.ndarray, percent: int, least: float, before: np.ndarray, root: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group that may reach the threshold by size and signature, and their estimates.

    Pairs that share a region of an earlier tree (columns of before; 0: none), or a root, are left out.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(len(n) - 1):
        may = 100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])
        if root is not None:
            may &= root[i + 1 :] != root[i]
        later = np.flatnonzero(may) + i + 1
        if before.shape[1] and len(later):
            later = later[~((before[later] == before[i]) & (before[i] != 0)).any(axis=1)]
        share = np.count_nonzero(signature[later] == signature[i], axis=1) / signature.shape[1]
        near = share >= least
        if near.any():
            found.append((np.full(int(near.sum()), i), later[near], share[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_NEAR = "region long, a long, b long, share double, crowded boolean"


def _near(rows: DataFrame, percent: int, least: float) -> DataFrame:
    """Each node's NEAREST pairs of each region that may be alike, and whether it had more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            region, node = table["region"][0].as_py(), table["node"].to_numpy()
            homes = np.frombuffer(b"".join(table["homes"].to_pylist()), ">i8").reshape(len(node), -1)
            before = homes[:, : int(np.argmax(homes[0] == region))]
            a, b, e = _pairs(table["n"].to_numpy(), _signatures(table["signature"]), percent, least, before, None)
            if not len(a):
                continue
            one, two, share = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([e, e])
            order = np.lexsort((node[two], -share, one))
            one, two, share = one[order], two[order], share[order]
            rank = np.arange(len(one)) - np.searchsorted(one, one)
            crowded = (np.bincount(one, minlength=len(node)) > NEAREST)[one]
            best = rank < NEAREST
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(int(best.sum()), region), node[one[best]], node[two[best]], share[best], crowded[best])],
                ["region", "a", "b", "share", "crowded"],
            )

    dealt = rows.repartition(partitions(rows.sparkSession), "region").sortWithinPartitions("region", "node")
    return dealt.select("region", "node", "signature", "n", "homes").mapInArrow(tidy(run), _NEAR)


def _following(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of each node with the NEAREST that follow it in the sorted order of its region, dealt out by ranges of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
            region, node, signature = table["region"].to_numpy(), table["node"].to_numpy(), _signatures(table["signature"])
            done = 0 if tail is None else len(tail)
            for k in range(1, NEAREST + 1):
                at = np.arange(max(done - k, 0), len(node) - k)
                at = at[(region[at] == region[at + k])]
                share = np.count_nonzero(signature[at] == signature[at + k], axis=1) / signature.shape[1]
                at, share = at[share >= least], share[share >= least]
                for a, b in ((at, at + k), (at + k, at)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (region[a], node[a], node[b], share, np.zeros(len(a), bool))], ["region", "a", "b", "share", "crowded"]
                    )
            tail = table.slice(max(len(node) - NEAREST, 0))

    at = F.col("tree") * DEPTH * 2
    order = F.concat(F.expr(f"substring(signature, tree * {DEPTH * 2} + 1)"), F.substring("signature", F.lit(1), at))
    dealt = rows.withColumn("order", order).repartitionByRange(partitions(rows.sparkSession), "region", "order", "node")
    return dealt.sortWithinPartitions("region", "order", "node").select("region", "node", "signature").mapInArrow(tidy(run), _NEAR)


# ---------------------------------------------------------------- confirmation


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each value of the nodes' upper BITMAP bits: 2 MB whatever their number."""
    each = (1 << BITMAP) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)).astype(np.int64)
            for k in np.unique(at // each):
                maps.setdefault(int(k), np.zeros(each, bool))[at[at // each == k] % each] = True
        yield pa.RecordBatch.from_arrays([pa.array(maps, pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["k", "bits"])

    slices = nodes.select("node").withColumn("k", F.shiftrightunsigned("node", 64 - BITMAP) / each).withColumn("k", F.col("k").cast("int"))
    found = slices.repartition(SLICES, "k").select("node").mapInArrow(tidy(run), "k int, bits binary").collect()
    out = np.zeros((SLICES, each // 8), np.uint8)
    for r in found:
        out[r["k"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sets_of(docs: DataFrame, text_col: str, width: int, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes, and of few others, read from the texts again."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for part in sliced(batch, 0):
                out = []
                for s in shingle_sets(part.column(0), width):
                    if len(s) and (node := set_id(s)) not in seen:
                        at = (node & (2**64 - 1)) >> (64 - BITMAP)
                        if bits[at >> 3] >> (7 - (at & 7)) & 1:
                            seen.add(node)
                            out.append((node, s.astype("<u8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "shingles"])

    texts = docs.select(docs[text_col].alias("text"))
    return texts.mapInArrow(tidy(run), f"{NODE}, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_alike(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


# ---------------------------------------------------------------- exact join


def _frequency(sets: DataFrame) -> np.ndarray:
    """A level of frequency for each cell of shingle hashes: the count's logarithm. Only the order of shingles goes by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(cells, (np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(64 - CELLS)).astype(np.int64), 1)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some])], ["cell", "n"])

    counted = sets.select("shingles").mapInArrow(tidy(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(1 << CELLS, np.uint8)  # at most as many rows as cells came back
    out[counted["cell"].to_numpy()] = np.minimum(1 + np.log2(counted["n"].to_numpy().astype(np.float64)) * 4, 255).astype(np.uint8)
    return out


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, root): of each set the rarest shingles, of which two sets that reach the threshold share one."""
    sent = sets.sparkSession.sparkContext.broadcast(_frequency(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for x in batch.column(2):
                s = np.frombuffer(x.as_buffer(), "<u8")
                order = np.lexsort((s, sent.value[(s >> np.uint64(64 - CELLS)).astype(np.int64)]))
                tokens.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]])
            row = np.repeat(np.arange(batch.num_rows), [len(t) for t in tokens])
            node, root = (batch.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)), pa.array(node), pa.array(root)],
                ["token", "node", "root"],
            )

    return sets.select("node", "root", "shingles").mapInArrow(tidy(run), "token long, node long, root long")


def _close(rows: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs (a, b) between components among the nodes of each token that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            node = table["node"].to_numpy()
            a, b, _ = _pairs(table["n"].to_numpy(), _signatures(table["signature"]), percent, least, np.zeros((len(node), 0)), table["root"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "node")
    return dealt.select("token", "node", "root", "n", "signature").mapInArrow(tidy(run), "a long, b long").distinct()


def _blocks(tokens: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(node, block) of nodes with frequent tokens (token, node, root, n), and (block, pair, side) of all block pairs.

    Tokens of one node are in one cluster, so a node is in one only. A component of more than a block has blocks of
    its own, which need not meet; the others are dealt by their roots. Side 0 is a block that meets itself.
    """
    of_node = tokens.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.sort_array(F.collect_set("token")).alias("ts"))
    of_node = kept(of_node, f"{path}/tokens_of")
    chain = of_node.where(F.size("ts") > 1).select(
        F.explode(F.arrays_zip(F.expr("slice(ts, 1, size(ts) - 1)").alias("a"), F.expr("slice(ts, 2, size(ts) - 1)").alias("b"))).alias("e")
    ).select("e.*").distinct()
    cluster = kept(connected(chain, f"{path}/clusters"), f"{path}/cluster").select(F.col("node").alias("token"), F.col("root").alias("cluster"))
    member = of_node.withColumn("token", F.col("ts")[0]).join(cluster, "token", "left").select(
        "node", "root", "n", F.coalesce("cluster", "token").alias("cluster")
    )
    member = kept(member, f"{path}/member")
    pieces = lambda total: F.ceil(total / BLOCK).cast("int")
    roots = kept(member.groupBy("cluster", "root").agg(F.sum(F.col("n") + NODE_WEIGHT).alias("weight")), f"{path}/weights")
    own = small(kept(roots.where(F.col("weight") > BLOCK).select("cluster", "root", pieces(F.col("weight")).alias("own")), f"{path}/own"))
    others = small(kept(roots.where(F.col("weight") <= BLOCK).groupBy("cluster").agg(pieces(F.sum("weight")).alias("shared")), f"{path}/shared"))
    dealt = member.join(own, ["cluster", "root"], "left").join(others, "cluster", "left")
    alone = F.xxhash64("cluster", "root", F.pmod(F.xxhash64("node"), F.col("own")))
    mixed = F.xxhash64("cluster", F.lit("mixed"), F.pmod(F.xxhash64("root", F.lit(1)), F.col("shared")))
    dealt = kept(
        dealt.select(
            "cluster",
            "node",
            F.when(F.col("own").isNull(), mixed).otherwise(alone).alias("block"),
            F.when(F.col("own").isNotNull(), F.col("root")).alias("pure"),
        ),
        f"{path}/blocks",
    )
    each = kept(dealt.groupBy("cluster", "block", "pure").agg(F.count(F.lit(1)).alias("nodes")), f"{path}/each").drop("nodes")
    other = each.select("cluster", F.col("block").alias("other"), F.col("pure").alias("other_pure"))
    pairs = each.join(other, "cluster").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False)))
    pair = F.xxhash64("block", "other").alias("pair")
    sides = pairs.select("block", pair, (F.col("block") != F.col("other")).cast("int").alias("side")).unionByName(
        pairs.where("block <> other").select(F.col("other").alias("block"), pair, F.lit(2).alias("side"))
    )
    return dealt.select("node", "block"), kept(sides, f"{path}/sides")


def _matched(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each pair of blocks: all pairs are compared, one link is kept for each two components it joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            side, node, root = (table[c].to_numpy() for c in ("side", "node", "root"))
            sets = [np.frombuffer(x.as_buffer(), "<u8") for chunk in table["shingles"].chunks for x in chunk]
            left, right = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
            _, group = np.unique(root, return_inverse=True)
            out = []
            for i, js in zip(left, _alike_rows([sets[i] for i in left], [sets[j] for j in right], percent), strict=True):
                for j in right[js]:
                    if group[i] != group[j]:
                        group[group == group[j]] = group[i]
                        out.append((node[i], node[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "pair").sortWithinPartitions("pair", "node")
    return dealt.select("pair", "side", "node", "root", "shingles").mapInArrow(tidy(run), "a long, b long")


def _alike_rows(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each set on the left, those on the right that reach the threshold: shared shingles are counted by matrix products."""
    n, m = (np.asarray([len(x) for x in sets], np.int64) for sets in (left, right))
    common = np.intersect1d(np.unique(np.concatenate([*left, np.zeros(0, np.uint64)])), np.unique(np.concatenate([*right, np.zeros(0, np.uint64)])))
    shared = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for sets in (left, right):
        row, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.uint64)])
        at = np.minimum(np.searchsorted(common, every), max(len(common) - 1, 0))
        hit = common[at] == every if len(common) else np.zeros(len(every), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], row[hit][order]))
    step = 4096
    for start in range(0, len(common), step):
        parts = []
        for (at, row), sets in zip(placed, (left, right), strict=True):
            a, b = np.searchsorted(at, [start, start + step])
            part = np.zeros((len(sets), min(step, len(common) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    for i in range(len(left)):
        both = shared[i].astype(np.int64)
        yield np.flatnonzero((both > 0) & (100 * both >= percent * (n[i] + m - both)))


def _missed(docs: DataFrame, text_col: str, width: int, percent: int, least: float, loose: DataFrame, signed: DataFrame, path: str) -> DataFrame:
    """Links (a, b) between components among loose nodes (node, root), all of them, by rarest shingles."""
    found = _sets_of(docs, text_col, width, loose)
    sets = kept(loose.join(found, "node").join(signed.select("node", "n", "signature"), "node"), f"{path}/sets")
    tokens = kept(_rarest(sets, percent), f"{path}/tokens")
    met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("times > 1 AND lo <> hi")
    met = kept(met.select("token", "times"), f"{path}/met")
    rare = tokens.join(met.where(F.col("times") <= RARE).select("token"), "token")
    pairs = kept(_close(rare.join(sets.select("node", "n", "signature"), "node"), percent, least), f"{path}/close")
    links = kept(_confirmed(pairs, sets, percent), f"{path}/links_rare")
    often = met.where(F.col("times") > RARE)
    if not often.head(1):
        return links
    rows, sides = _blocks(tokens.join(small(often.select("token")), "token").join(sets.select("node", "n"), "node"), path)
    dealt = rows.join(small(sides), "block").join(sets.select("node", "root", "shingles"), "node")
    return links.unionByName(kept(_matched(dealt, percent), f"{path}/links_often"))


# ---------------------------------------------------------------- components


def _between(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends lie in different components."""
    if roots is None:
        return pairs
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _rooted(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, its key, n and root, the node that names its component (null for an empty set)."""
    path = work_dir(docs.sparkSession)
    least = max(0.05, percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / (TREES * DEPTH)))
    rows = kept(_signed(docs, id_col, text_col, width), f"{path}/rows")
    nodes = rows.where("signature is not null").groupBy("node").agg(
        F.first("signature").alias("signature"), F.first("keys").alias("keys"), F.first("n").alias("n")
    )
    nodes = kept(nodes, f"{path}/nodes")
    first, regions = _regions(nodes, path)
    fits, dense = regions.where(F.col("size") <= REGION), first.where(F.col("size") > REGION)
    # of each node its region in every tree (0: none that is compared whole), as bytes
    by_tree = F.map_from_entries(F.collect_list(F.struct("tree", "region")))
    each = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.lpad(F.hex(F.coalesce(F.col("m")[t], F.lit(0))), 16, "0"))
    homes = fits.groupBy("node").agg(by_tree.alias("m")).select("node", F.unhex(F.array_join(each, "")).alias("homes"))
    signed = kept(nodes.join(homes, "node", "left").select("node", "signature", "n", "homes"), f"{path}/signed")
    near = _near(fits.select("region", "node").join(signed, "node"), percent, least)
    deepest = regions.where(F.col("size") > REGION)
    if deepest.head(1):
        near = near.unionByName(_following(kept(deepest.join(signed.select("node", "signature"), "node"), f"{path}/deepest"), least))
    near = kept(near, f"{path}/near")
    # of each node its NEAREST pairs of all trees; what is more makes a region crowded
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("share")).alias("far"), "b", "region"))).alias("by")
    ranked = near.groupBy("a").agg(ranked).select("a", F.posexplode("by").alias("rank", "x")).select("a", "rank", "x.b", "x.region")
    ranked = kept(ranked, f"{path}/ranked")
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    best, pairs = ranked.where("rank = 0").select(*pair).distinct(), ranked.where(F.col("rank") < NEAREST).select(*pair).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = kept(_sets_of(docs, text_col, width, ends), f"{path}/sets")

    best = kept(best, f"{path}/best")
    links = kept(_confirmed(best, sets, percent), f"{path}/links0")
    roots = kept(connected(links, f"{path}/first"), f"{path}/roots0")
    rest = kept(_between(pairs.join(best, ["a", "b"], "left_anti"), roots), f"{path}/rest")
    more = kept(_confirmed(rest, sets, percent), f"{path}/links1")
    if more.head(1):
        links = links.unionByName(more)
        roots = kept(connected(links, f"{path}/second"), f"{path}/roots1")

    crowded = near.where("crowded").select("region").unionByName(ranked.where(F.col("rank") >= NEAREST).select("region"))
    crowded = small(kept(crowded.distinct(), f"{path}/crowded"))
    open_ = dense.select("region", "node").unionByName(fits.join(crowded, "region", "left_semi").select("region", "node"))
    open_ = kept(open_.join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")), f"{path}/open")
    mixed = small(kept(open_.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region"), f"{path}/mixed"))
    loose = kept(open_.join(mixed, "region", "left_semi").select("node", "root").distinct(), f"{path}/loose")
    if loose.head(1):
        more = _missed(docs, text_col, width, percent, least, loose, signed, f"{path}/exact")
        if more.head(1):
            roots = kept(connected(links.unionByName(more), f"{path}/third"), f"{path}/roots2")

    return rows.select("id", "key", "n", "node").join(roots, "node", "left").select("id", "key", "n", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id of its component) and kept (id = component_id).

    Null texts and texts without words have empty sets and are linked with nothing. Repeated rows share a
    component and are kept or dropped alike; null ids come after all others, so component_id is null only in
    a component without other ids, whose rows are kept. Columns other than id and text are ignored.
    """
    named = _rooted(docs, width, percent, id_col, text_col)
    ids = kept(named.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), f"{work_dir(docs.sparkSession)}/least")
    out = named.join(ids, "root", "left").withColumn("component", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component: that of the least id.

    Of several rows of that id the one whose text has the least hash stays, and rows equal in id and text are
    one row. Rows without words all stay.
    """
    path = work_dir(docs.sparkSession)
    named = kept(_rooted(docs, width, percent, id_col, text_col).where("root is not null"), f"{path}/named")
    many = named.groupBy("root").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("stays")
    ).where("rows > 1")
    many = kept(many, f"{path}/many")
    far = kept(named.join(many, "root").select("key", (F.col("key") == F.col("stays")).alias("stays")), f"{path}/far")
    drop = far.where("not stays").select(F.col("key").alias("dropped")).distinct()
    drop = kept(drop, f"{path}/drop")
    drop = F.broadcast(drop) if drop.limit(FEW_DROPPED + 1).count() <= FEW_DROPPED else drop
    rest = docs.join(drop, _row_key(docs, id_col, text_col) == drop["dropped"], "left_anti")
    again = far.where("stays").groupBy("key").count().where("count > 1").select(F.col("key").alias("again"))
    if not again.head(1):
        return rest
    is_again = _row_key(rest, id_col, text_col) == again["again"]
    return rest.join(again, is_again, "left_anti").unionByName(rest.join(again, is_again, "left_semi").dropDuplicates([id_col, text_col]))
