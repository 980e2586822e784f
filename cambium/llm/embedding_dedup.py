"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import components, settle

#: Half the width of a window, in standard deviations of a unit vector's projection.
HALF_WIDTH = 0.45
#: Vectors that a cell should hold; sets the number of planes.
CELL_ROWS = 512
#: Vectors of a cell that one task compares with as many others; larger cells are cut into blocks.
BLOCK_ROWS = 4096
#: Tables in which a pair must collide.
NEEDED = 2
PAIRS_AT_ONCE = 500_000


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    inside = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(inside & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def collision_chance(cosine: float, planes: int) -> float:
    """Chance that two unit vectors of that cosine collide in one table: same side of every plane, and inside the window."""
    apart = math.sqrt(2 - 2 * cosine)
    return (1 - math.acos(cosine) / math.pi) ** planes * math.erf(HALF_WIDTH / apart / math.sqrt(2))


def tables_for(cosine: float, planes: int, recall: float, needed: int = NEEDED) -> int:
    """The least number of tables in which a pair of exactly that cosine collides ``needed`` times with chance ``recall``."""
    p, tables = collision_chance(cosine, planes), needed
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(needed)) > 1 - recall:
        tables += 1
    return tables


@dataclass(frozen=True)
class Projections:
    """Random directions for every table: one to sort by, ``planes`` to make cells."""

    tables: int
    planes: int
    seed: int = 11

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (n, tables) and positions (n, tables) of unit vectors."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        position = unit @ rng.standard_normal((unit.shape[1], self.tables))
        cells = np.zeros(position.shape, np.int64)
        for _ in range(self.planes):
            cells = cells * 2 + (unit @ rng.standard_normal((unit.shape[1], self.tables)) > 0)
        return cells, position


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cell_links(
    table: int, unit: np.ndarray, cells: np.ndarray, position: np.ndarray, across: np.ndarray | None, cosine: float, needed: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one cell of one table that collide in no table before it, so that every pair is met once.

    Vectors are sorted by their position; each looks at those in its window. A pair's collisions are counted over the tables, and
    pairs with enough of them are verified by cosine. ``across``: block of each vector, if only pairs of different blocks count.
    Pairs come in portions, as a cell of near copies has very many.
    """
    order = np.argsort(position[:, table], kind="stable")
    line = position[order, table]
    ends = np.searchsorted(line, line + HALF_WIDTH + 1e-6, "right")
    number = ends - np.arange(len(line)) - 1
    stops = np.cumsum(number)
    lo = 0
    collide = lambda s, a, b: (cells[a, s] == cells[b, s]) & (np.abs(position[a, s] - position[b, s]) <= HALF_WIDTH)
    while lo < len(line):
        hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] - number[lo] + PAIRS_AT_ONCE, "right")))
        n = number[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a, b = order[i], order[j]
        keep = collide(table, a, b)
        if across is not None:
            keep &= across[a] != across[b]
        a, b = a[keep], b[keep]
        for s in range(table):
            fresh = ~collide(s, a, b)
            a, b = a[fresh], b[fresh]
        count = np.ones(len(a), np.int64)
        for s in range(table + 1, cells.shape[1]):
            count += collide(s, a, b)
        a, b = a[count >= needed], b[count >= needed]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        yield a[near], b[near]
        lo = hi


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least index of each component) after the links (a, b) have been added."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def numbered(seed: int) -> Column:
    """A number for each vector; two vectors may share one, though hardly with the next seed too."""
    return F.xxhash64(F.lit(seed), "vector")


def embedding_groups(
    vectors: DataFrame,
    *,
    cosine: float = 0.95,
    recall: float = 0.9995,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least id reachable by links) and kept (whether that is its own).

    Equal vectors, compared in all components, are first brought down to one. Every table sorts the vectors along a random direction, within the cells of some
    random planes so that the lists stay short as the input grows; the number of planes follows the number of vectors, and the
    number of tables is calibrated so that a pair of exactly ``cosine`` passes the count with chance ``recall``, closer pairs with
    more. A row carries its codes in all tables, so the pair's collisions are counted where it is met, without a shuffle of pairs,
    and verified there in double precision. Cells that hold too many vectors are cut into blocks, and every pair of blocks is a
    group of its own. What leaves a task is a count and a local root for each linked vector, never the pairs.

    Vectors that are null, zero or hold null or non-finite components have no link, nor have rows without an id; vectors of
    different length don't link. Rows that repeat an id are each judged by their own vector. Empty input: empty result.
    """
    for seed in itertools.count():
        node = F.when(F.col("vec_id").isNotNull() & usable(F.col("vector")), numbered(seed))
        rows = settle(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).withColumn("node", node))
        distinct = settle(rows.where("node is not null").groupBy("node", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")))
        n, named = distinct.agg(F.count("*"), F.count_distinct("node")).first()
        if n == named:  # else two vectors share a number, and all are numbered anew
            break
    planes = max(0, math.ceil(math.log2(max(1, n) / cell_rows)))
    projections = Projections(tables_for(cosine, planes, recall), planes)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["vector"].map(len)):
                cells, position = projections.codes(_unit(np.stack(part["vector"].to_numpy()).astype(np.float64)))
                yield part.assign(size=size, cells=list(cells.astype(np.int32)), position=list(position.astype(np.float32)))

    vector_type = distinct.schema["vector"].dataType.simpleString()
    coded = settle(
        distinct.select("node", "copies", "vector").mapInPandas(
            code, f"node long, copies long, vector {vector_type}, size int, cells array<int>, position array<float>"
        )
    )
    cell = ["size", "table", "cell"]
    crowded = coded.select("size", F.posexplode("cells").alias("table", "cell")).groupBy(*cell).count().where(F.col("count") > block_rows)
    crowded = crowded.withColumn("blocks", F.ceil(F.col("count") / block_rows)).drop("count")
    placed = coded.select("*", F.posexplode("cells").alias("table", "cell"))
    blocked = placed.join(crowded, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = blocked.select("*", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        table, x, y = key[1], key[3], key[4]
        frame = frame.sort_values("node")
        unit = _unit(np.stack(frame["vector"].to_numpy()).astype(np.float64))
        cells, position = np.stack(frame["cells"].to_numpy()), np.stack(frame["position"].to_numpy()).astype(np.float64)
        across = frame["block"].to_numpy() if x != y else None
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        links, label = np.zeros(len(frame)), np.arange(len(frame))
        for a, b in cell_links(table, unit, cells, position, across, cosine, NEEDED):
            links += np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
            label = join_labels(label, a, b)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[label][some]})

    columns = [*cell, "x", "y", "block", "node", "copies", "vector", "cells", "position"]
    met = settle(paired.select(*columns).groupBy(*cell, "x", "y").applyInPandas(link, "node long, links long, root long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = distinct.select("node", "copies", "least").join(links, "node", "left").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    result = settle(labelled.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"))
    component = F.coalesce("component", "vec_id")
    return rows.join(result, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
