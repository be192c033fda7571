"""Mixing sources to target weights by the cube method.

Every document is taken floor(m) times, m being its source's target over its size; the fraction of m that is left
is an inclusion probability. Flight, in a block of a source: the largest documents are decided one by one, the others
moving a little against each; then the probabilities of three documents at a time move at random along the direction that keeps their sum and their sum of words, until one of them is 0 or 1, and the next
takes its place. Large documents come first, so a block ends with two small open documents at most, while its expected numbers of
documents and words are met exactly. What is open goes into new blocks until a source has one; there the balance
of documents is given up first, then that of words: that is the landing, of one document a source.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, work_dir

WEIGHTS, MOST, LARGE, SEED = (5, 2, 1), 3, 256, 20240319
#: Documents a block. A flight costs some 256 steps over its block, so small blocks make short, even tasks; balance does
#: not suffer, as each block keeps its sums and what it leaves open, two documents, goes into blocks of the next level.
BLOCK = 2_000
_CLOSE = 1e-9


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh 5, 2, 1 in turn. A source's target stops at MOST times its size,
    and the excess goes to the others by weight, in rounds, until none is above. Sources may be many: they are sorted
    by ranges and numbered range by range, and a round is one sum over them.
    """
    path, order = work_dir(sizes.sparkSession), F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(order)
    by = kept(by.withColumn("part", F.spark_partition_id()), f"{path}/by")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = by.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    by = kept(by.join(F.broadcast(parts), "part").select("source", "source_size", weight.cast("double").alias("weight")), f"{path}/weights")

    total, unit = by.agg(F.sum("source_size")).first()[0] or 0, -1.0
    most = F.col("source_size") * MOST
    while True:  # what a unit of weight gets only grows, so sources that have stopped stay so
        stops = F.col("weight") * unit > most if unit >= 0 else F.lit(False)
        fixed, weights = by.agg(F.sum(F.when(stops, most)), F.sum(F.when(~stops, F.col("weight")))).first()
        again = (total - (fixed or 0)) / weights if weights else unit
        if again <= unit:
            break
        unit = again
    target = F.least(F.col("weight") * F.lit(unit), most.cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def _flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Moves probabilities until at most two (none if last) lie strictly between 0 and 1."""
    p = p.copy()
    scale = max(float(size.max(initial=0)), 1.0)
    x = size / scale
    order = np.lexsort((rng.permutation(len(p)), -size))  # large documents first: what stays open is small
    p[order] = _large_first(p[order], x[order], rng)
    draws = rng.random(len(p) + 8).tolist()
    open_: list[int] = []
    step = 0
    for i in order.tolist():
        if _CLOSE < p[i] < 1 - _CLOSE:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])  # orthogonal to the counts (1, 1, 1) and to the words
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            _move(p, open_, u, draws[step])
            step += 1
            open_ = [k for k in open_ if _CLOSE < p[k] < 1 - _CLOSE]
    if last:
        if len(open_) == 2:
            a, b = open_
            _move(p, open_, (float(x[b]), -float(x[a])) if x[a] > 0 or x[b] > 0 else (1.0, -1.0), draws[step])
            open_ = [k for k in open_ if _CLOSE < p[k] < 1 - _CLOSE]
        for k in open_:
            p[k] = float(rng.random() < p[k])
    return np.where(p <= _CLOSE, 0.0, np.where(p >= 1 - _CLOSE, 1.0, p))


def _large_first(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the LARGE first documents one by one, all smaller open ones moving a little against each."""
    for i in range(min(LARGE, len(p) - 3)):
        while _CLOSE < p[i] < 1 - _CLOSE:
            rest = i + 1 + np.flatnonzero((p[i + 1 :] > _CLOSE) & (p[i + 1 :] < 1 - _CLOSE))
            if len(rest) < 3:
                break
            y = x[rest]
            n, s1, s2 = len(rest), y.sum(), (y * y).sum()
            det = n * s2 - s1 * s1
            if det > 1e-12 * n * s2:
                u = -((s2 - s1 * x[i]) + (n * x[i] - s1) * y) / det  # keeps both sums
            else:
                u = np.full(n, -x[i] / s1 if s1 > 0 else -1.0 / n)  # equal sizes: keeps the words
            at, d = np.append(i, rest), np.append(1.0, u)
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.nanmin(np.where(d > 0, (1 - p[at]) / d, np.where(d < 0, p[at] / -d, np.inf)))
                down = np.nanmin(np.where(d > 0, p[at] / d, np.where(d < 0, (1 - p[at]) / -d, np.inf)))
            p[at] = np.clip(p[at] + (up if rng.random() * (up + down) < down else -down) * d, 0.0, 1.0)
    return p


def _move(p: np.ndarray, at: list[int], u: tuple[float, ...], draw: float) -> None:
    """One random step along u or against it, as far as the unit cube allows, that keeps all expectations."""
    up = min((((1 - p[k]) if d > 0 else p[k]) / abs(d) for k, d in zip(at, u, strict=True) if d), default=0.0)
    down = min(((p[k] if d > 0 else (1 - p[k])) / abs(d) for k, d in zip(at, u, strict=True) if d), default=0.0)
    length = up if draw * (up + down) < down else -down
    for k, d in zip(at, u, strict=True):
        p[k] = min(1.0, max(0.0, p[k] + length * d))


def _block(source: str | None, block: int, level: int) -> np.random.Generator:
    return np.random.default_rng([SEED, level, block, *(source or "\0").encode()])


def _flown(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "size"], kind="stable", ignore_index=True)
        rows["p"] = _flight(rows["p"].to_numpy(), rows["size"].to_numpy(np.float64), _block(key[0], int(key[1]), level), int(rows["blocks"].iloc[0]) == 1)
        return rows.drop(columns=["block", "blocks"])

    return fly


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """Per row: id, size, source_size, target and taken, the words that the mix takes of it.

    Rows of size 0 (null and empty texts) and sources of size 0 take nothing. Rows that repeat are documents
    of their own. Draws depend on ids, sizes and sources alone, not on how rows are dealt out, so reruns agree; null ids are
    like any other id. An empty table gives no rows; other columns are ignored.
    """
    path = work_dir(docs.sparkSession)
    # ids travel as text: pandas would turn integers beside nulls into floats
    size: Column = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = docs.select(docs[id_col].cast("string").alias("id"), docs[source_col].alias("source"), size.alias("size"))
    sizes = kept(sizes, f"{path}/sizes")
    goal = kept(targets(sizes), f"{path}/targets").withColumn("hashed", F.xxhash64("source"))
    each = sizes.join(
        F.broadcast(goal.drop("source")) if goal.limit(100_001).count() <= 100_000 else goal.drop("source"), F.xxhash64(sizes["source"]) == goal["hashed"]
    ).drop("hashed")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.when(F.abs(times - F.round(times)) < 1e-12, F.round(times)).otherwise(times)
    each = each.withColumn("whole", F.floor(times)).withColumn("p", times - F.floor(times))
    each = kept(each, f"{path}/each")

    done = [each.where((F.col("p") == 0) | (F.col("size") == 0)).select("id", "size", "source_size", "target", "whole", F.lit(0.0).alias("p"))]
    left, level = each.where((F.col("p") > 0) & (F.col("size") > 0)), 0
    while True:
        per = left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select(
            F.xxhash64("source").alias("hashed"), "blocks"
        )
        per = kept(per, f"{path}/blocks{level}")
        one = per.agg(F.max("blocks")).first()[0]
        if one is None:
            break
        dealt = left.join(F.broadcast(per) if per.limit(100_001).count() <= 100_000 else per, F.xxhash64("source") == F.col("hashed"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(level)), F.col("blocks")).cast("int")).drop("hashed")

        flown = kept(dealt.groupBy("source", "block").applyInPandas(_flown(level), left.schema), f"{path}/flight{level}")
        done.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)).select("id", "size", "source_size", "target", "whole", "p"))
        left, level = flown.where((F.col("p") > 0) & (F.col("p") < 1)), level + 1
        if one == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.col("p"))).cast("long").alias("taken"),
    )
