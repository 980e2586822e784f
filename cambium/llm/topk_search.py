"""Exact search for the largest inner products with ball trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cambium.llm.common import hashed_share, settle

LEAF_ROWS = 128
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
#: Whole numbers up to this are exact in double precision.
EXACT = 2.0**53
#: Squared length from which on inner products of two vectors may not fit into a long.
LONGEST = 2.0**62


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector is null or empty, or has a null or non-finite component.

    A vector whose squared length would not fit into 62 bits stops the job: its inner products could be wrong without notice.
    """
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    length = F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    too_long = F.raise_error(F.lit("a vector is too long for whole-number inner products: lower the scale")).cast("array<bigint>")
    whole = F.when(length < LONGEST, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))).otherwise(too_long)
    return F.when(fine & (F.size(vector) > 0), whole)


@dataclass
class BallTree:
    """Rows in the order of the leaves; node i covers rows start[i] to stop[i], and its children are 2i+1 and 2i+2."""

    ids: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        """Halve the rows along the line through two far points until a node holds ``leaf_rows`` at most."""
        points = rows.astype(np.float64)
        order = np.arange(len(rows))
        depth = max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf_rows))))
        nodes = 2 ** (depth + 1) - 1
        start, stop = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        center, radius = np.zeros((nodes, rows.shape[1])), np.zeros(nodes)
        stop[0] = len(rows)
        for i in range(nodes):
            part = order[start[i] : stop[i]]
            here = points[part]
            if len(part):
                center[i] = here.mean(0)
                radius[i] = np.sqrt(((here - center[i]) ** 2).sum(1).max())
            if 2 * i + 2 < nodes:
                middle = (start[i] + stop[i]) // 2
                if len(part) > 1:
                    a = here[((here - center[i]) ** 2).sum(1).argmax()]
                    b = here[((here - a) ** 2).sum(1).argmax()]
                    order[start[i] : stop[i]] = part[np.argpartition(here @ (b - a), middle - start[i])]
                start[2 * i + 1], stop[2 * i + 1] = start[i], middle
                start[2 * i + 2], stop[2 * i + 2] = middle, stop[i]
        return cls(ids[order], rows[order], start, stop, center, radius)

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No inner product with a row of the node is larger; the last factor makes up for rounding."""
        at = queries @ self.center[node] + norms * self.radius[node]
        return at + 1e-9 * (np.abs(at) + norms * (np.abs(self.center[node]).sum() + self.radius[node]) + 1)

    def is_leaf(self, node: int) -> bool:
        return 2 * node + 2 >= len(self.start)

    def seed_leaves(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """For each query the leaf reached by taking the child of the larger bound."""
        node = np.zeros(len(queries), np.int64)
        while not self.is_leaf(int(node[0])):
            for parent in np.unique(node):
                mine = np.flatnonzero(node == parent)
                left, right = (self.bound(2 * int(parent) + s, queries[mine], norms[mine]) for s in (1, 2))
                node[mine] = 2 * parent + np.where(left >= right, 1, 2)
        return node


class Best:
    """The k best rows so far of every query, by score and then smaller id; ``kth`` is the score that a row must reach."""

    def __init__(self, query_ids: np.ndarray, k: int, kth: np.ndarray):
        self.query_ids, self.k, self.kth = query_ids, k, kth.astype(np.float64)
        self.found = np.zeros((0, 3), np.int64)  # query, score, row id

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries, ids) of some rows."""
        q, r = np.nonzero((scores >= self.kth[queries][:, None]) & (self.query_ids[queries][:, None] != ids[None]))
        all_ = np.concatenate([self.found, np.stack([queries[q], scores[q, r].astype(np.int64), ids[r]], 1)])
        all_ = all_[np.lexsort((all_[:, 2], -all_[:, 1], all_[:, 0]))]
        at = np.searchsorted(all_[:, 0], all_[:, 0])
        self.found = all_[np.arange(len(all_)) - at < self.k]
        last = np.flatnonzero(np.arange(len(self.found)) - np.searchsorted(self.found[:, 0], self.found[:, 0]) == self.k - 1)
        self.kth[self.found[last, 0]] = np.maximum(self.kth[self.found[last, 0]], self.found[last, 1])


def _scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    return queries @ rows.T if exact else queries.astype(np.int64) @ rows.T.astype(np.int64)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int, seed_only: bool = False) -> Best:
    """Branch and bound for all queries of a block at once.

    Nodes are opened in the order of the largest bound that any query of theirs has, and every query drops out of a node whose
    bound is below its kth score so far. ``kth`` is where the scores begin: what is known from elsewhere. With ``seed_only`` every
    query only sees one leaf.
    """
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.rows).max(initial=0)) * queries.shape[1] < EXACT
    points, norms = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    rows = tree.rows.astype(np.float64) if exact else tree.rows
    asked = points if exact else queries
    best = Best(query_ids, k, kth)
    if not len(queries) or not len(tree.ids):
        return best

    def visit(node: int, active: np.ndarray) -> None:
        part = slice(tree.start[node], tree.stop[node])
        best.offer(active, _scores(asked[active], rows[part], exact), tree.ids[part])

    if seed_only:
        leaves = tree.seed_leaves(points, norms)
        for leaf in np.unique(leaves):
            visit(int(leaf), np.flatnonzero(leaves == leaf))
        return best
    everyone = np.arange(len(queries))
    bound = tree.bound(0, points, norms)
    heap = [(-float(bound.max()), 0, everyone, bound)]
    while heap:
        _, node, active, bound = heapq.heappop(heap)
        open_ = bound >= best.kth[active]
        active = active[open_]
        if not len(active):
            continue
        if tree.is_leaf(node):
            visit(node, active)
            continue
        for child in (2 * node + 1, 2 * node + 2):
            limit = tree.bound(child, points[active], norms[active])
            heapq.heappush(heap, (-float(limit.max()), child, active, limit))
    return best


#: Regions that space is cut into by planes, and vectors by which the planes are placed.
REGIONS = 1024
SAMPLE = 8192
#: Bytes of shard centers that every task may get.
BROADCAST_BYTES = 32_000_000
#: Tasks that share the blocks of one shard where shards are few.
LANES = 8


@dataclass
class Planes:
    """Halving planes in the order of a heap: which side of them a vector lies on, one after another, tells its region."""

    direction: np.ndarray
    offset: np.ndarray
    depth: int

    @classmethod
    def through(cls, rows: np.ndarray, regions: int) -> Planes:
        """Planes that halve ``rows`` along the line through two far points until there are about ``regions`` parts."""
        depth = max(0, int(np.ceil(np.log2(max(1, min(regions, len(rows) // 4))))))
        direction, offset = np.zeros((2**depth - 1, rows.shape[1])), np.zeros(2**depth - 1)
        part = np.zeros(len(rows), np.int64)
        for node in range(2**depth - 1):
            here = rows[part == node]
            if len(here):
                a = here[((here - here.mean(0)) ** 2).sum(1).argmax()]
                direction[node] = here[((here - a) ** 2).sum(1).argmax()] - a
                offset[node] = np.median(here @ direction[node])
            mine = np.flatnonzero(part == node)
            part[mine] = 2 * node + 1 + (rows[mine] @ direction[node] > offset[node])
        return cls(direction, offset, depth)

    def region(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((rows * self.direction[node]).sum(1) > self.offset[node])
        return node - (2**self.depth - 1)


def _packed(rows: np.ndarray) -> tuple[str, bytes]:
    """The rows in the smallest whole-number type that holds them."""
    most = int(np.abs(rows).max(initial=0))
    kind = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**64)) if most < top)
    return kind, rows.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, size).astype(np.int64)


def in_regions(vectors: DataFrame, sample: DataFrame, shards: int) -> DataFrame:
    """``vectors`` (size, v) with ``region``: vectors that lie near one another get the same.

    The planes of each length of vector are placed by at most SAMPLE vectors, which come to the driver; every vector is then
    dealt by them. They only decide which shard a vector is in, never what is found.
    """
    found: dict[int, list] = {}
    for r in sample.select("size", "v").orderBy("h").limit(SAMPLE).collect():
        found.setdefault(r["size"], []).append(r.v)
    planes = {size: Planes.through(np.array(rows, float), min(REGIONS, shards)) for size, rows in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            region = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                if size in planes:
                    mine = np.flatnonzero(sizes == size)
                    rows = batch.column("v").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float)
                    region[mine] = planes[size].region(rows.reshape(-1, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("region", T.IntegerType())]))


_SHARD = ["size", "region", "part"]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every query the ``k`` vectors of the largest inner product, ties to smaller ids.

    Components x count as floor(scale * x).

    1. Vectors are dealt by place (`in_regions`) to shards of about ``shard_rows``, and a ball tree is built in each.
    2. A first round shows each query one leaf of the shard where it lies itself, which gives a first kth score.
    3. The balls around whole shards are compared with these scores. Only queries whose bound reaches their kth score go on to a
       shard, in blocks of queries of one region; most shards of clustered vectors see few queries, and none of a far region.
    4. Each shard is searched by branch and bound, its tree and kth scores shared by all queries of a block. At most k rows per
       query and shard go to the last ranking. All of it is exact.

    A tree moves once (LANES times where shards are few), a block once for every shard that it has to see.

    Vectors that are null, empty or hold null or non-finite components are neither queries nor candidates, nor are rows without
    an id; vectors of another length than the query are no candidates, nor is a vector under the query's own id. Equal rows count
    once; different vectors under one id are separate. With fewer candidates than ``k`` all are returned; empty input: empty result.
    """

    def whole(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_components(F.col(f"`{vector_col}`"), scale).alias("v"))
        kept = kept.where("id is not null and v is not null").withColumn("size", F.size("v")).withColumn("h", F.xxhash64("v"))
        return settle(kept.dropDuplicates(["id", "h"]))

    candidates, asked = whole(vectors), whole(queries)
    rows = candidates.count()
    share = F.lit(4.0 * SAMPLE / max(1, rows))
    sample = candidates.where(hashed_share(F.struct("id", "h")) < share)
    candidates, asked = (in_regions(df, sample, -(-rows // shard_rows)) for df in (candidates, asked))
    candidates, asked = settle(candidates), settle(asked)
    parts = candidates.groupBy("size", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))

    def plant(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree.build(frame["id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()))
        kind, data = _packed(tree.rows)
        arrays = [np.ascontiguousarray(x).tobytes() for x in (tree.ids, tree.start, tree.stop, tree.center, tree.radius)]
        ball = [tree.center[0].tobytes(), float(tree.radius[0])]
        return pd.DataFrame([[*key, kind, data, *arrays, *ball]], columns=[*_SHARD, "kind", "data", "ids", "start", "stop", "center", "radius", "ball", "reach"])

    part = F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int")
    dealt = candidates.join(parts, ["size", "region"]).withColumn("part", part)
    trees = settle(
        dealt.groupBy(*_SHARD).applyInPandas(
            plant,
            "size int, region int, part int, kind string, data binary, ids binary, start binary, stop binary, center binary, radius binary, ball binary, reach double",
        )
    )

    def bundled(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Blocks of at most about ``block_queries`` queries with equal keys, packed into one row each."""

        def bundle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            kind, data = _packed(np.stack(frame["v"].to_numpy()))
            arrays = [frame[c].to_numpy().tobytes() for c in ("id", "h", "kth")]
            return pd.DataFrame([[*key, kind, data, *arrays]], columns=[*keys, "block", "q_kind", "q_data", "q_ids", "q_h", "q_kth"])

        blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("h", "id"), F.col("blocks")).cast("int")
        kind = ", ".join(f"{c} int" for c in [*keys, "block"])
        return rows.join(blocks, keys).withColumn("block", block).groupBy(*keys, "block").applyInPandas(bundle, f"{kind}, q_kind string, {_BUNDLE}")

    def searched(work: DataFrame, seed_only: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                    size = r["size"]
                    center, radius = np.frombuffer(r["center"]).reshape(-1, size), np.frombuffer(r["radius"])
                    places = [np.frombuffer(r[c], np.int64) for c in ("ids", "start", "stop")]
                    tree = BallTree(places[0], _unpacked(r["kind"], r["data"], size), places[1], places[2], center, radius)
                    ids, h = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_h"], np.int64)
                    best = search(tree, _unpacked(r["q_kind"], r["q_data"], size), ids, np.frombuffer(r["q_kth"]), k, seed_only)
                    q, score, row = best.found.T
                    if seed_only:
                        q, score, row = np.arange(len(ids)), best.kth, ids
                    columns = [pa.array(ids[q]), pa.array(h[q]), pa.array(row), pa.array(score.astype(np.float64) if seed_only else score)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "h", "vec_id", "score"])

        return work.mapInArrow(run, f"id long, h long, vec_id long, score {'double' if seed_only else 'long'}")

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a block and the balls of some shards, the queries that each shard has to see."""
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                points = _unpacked(r["q_kind"], r["q_data"], r["size"])
                arrays = [np.frombuffer(r[c], t) for c, t in (("q_ids", np.int64), ("q_h", np.int64), ("q_kth", np.float64))]
                norms = np.sqrt((points.astype(float) ** 2).sum(1))
                for region, part, ball, reach in zip(r["regions"], r["parts"], r["balls"], r["reaches"], strict=True):
                    whole_shard = BallTree(None, None, None, None, np.frombuffer(ball)[None], np.array([reach]))
                    near = whole_shard.bound(0, points.astype(float), norms) >= arrays[2]
                    if near.any():
                        kind, data = _packed(points[near])
                        found = [r["size"], region, part, r["block"], kind, data, *[x[near].tobytes() for x in arrays]]
                        yield pa.RecordBatch.from_pylist([dict(zip(seen.fieldNames(), found, strict=True))], schema=seen_arrow)

    seen = T.StructType.fromDDL(f"size int, region int, part int, block int, q_kind string, {_BUNDLE}")
    seen_arrow = to_arrow_schema(seen)
    # where it lies itself: the part of its region that its own hash names, so that queries of a crowded region are dealt too
    start = asked.join(parts, ["size", "region"]).withColumn("part", part).withColumn("kth", F.lit(float("-inf"))).drop("parts")
    first = searched(bundled(start, _SHARD).join(trees.drop("ball", "reach"), _SHARD), True)
    shared = first.groupBy("id", "h").agg(F.max("score").alias("kth"))
    known = settle(asked.join(shared, ["id", "h"], "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))

    shards = trees.count()
    balls = trees.select("size", "region", "part", "ball", "reach").withColumn("chunk", F.pmod(F.xxhash64("region", "part"), F.lit(-(-shards // REGIONS) or 1)))
    lists = [F.col(f"b.{c}").alias(name) for c, name in (("region", "regions"), ("part", "parts"), ("ball", "balls"), ("reach", "reaches"))]
    balls = balls.groupBy("size", "chunk").agg(F.collect_list(F.struct("region", "part", "ball", "reach")).alias("b")).select("size", *lists)
    bytes_ = trees.agg(F.coalesce(F.sum(F.octet_length("ball") + 20), F.lit(0)).alias("n")).first().n
    blocks = bundled(known.select("id", "h", "v", "size", "region", "kth"), ["size", "region"]).withColumnRenamed("region", "own")
    if bytes_ <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(balls), "size")
    else:  # every block still meets every chunk of balls, in as many tasks as there are lanes
        lane = F.pmod(F.xxhash64("own", "block"), F.lit(64)).cast("int")
        pairs = blocks.withColumn("lane", lane).join(balls.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["size", "lane"])
    columns = ["size", "block", "q_kind", "q_data", "q_ids", "q_h", "q_kth", "regions", "parts", "balls", "reaches"]
    wanted = settle(pairs.select(*columns).mapInArrow(reaching, seen))
    lanes = min(LANES, max(1, -(-2 * LANES // max(1, shards))))
    laned = wanted.withColumn("lane", F.pmod(F.xxhash64("q_ids"), F.lit(lanes)).cast("int"))
    grown = trees.drop("ball", "reach").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rank = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.desc("score"), "vec_id"))
    ranked = searched(laned.join(grown, [*_SHARD, "lane"]), False).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_BUNDLE = "q_data binary, q_ids binary, q_h binary, q_kth binary"
