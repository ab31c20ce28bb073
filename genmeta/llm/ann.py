"""Approximate nearest neighbours: a graph by NN-descent, greedy search over it.

Equal vectors are one node (its smallest vec_id), so copies, however many, neither fill neighbour lists nor a task; answers
give each node's smallest members. Lists start from the vectors that share a pivot (each vector has the SHARES nearest of at
most PIVOTS sampled vectors), in blocks of about BLOCK. A round of NN-descent joins every node with its neighbours and its
nearest reverse neighbours; pairs of which one is new in its list are compared, and a list keeps the K nearest it ever saw.
Rounds end when few lists change. Lists and vectors are tables in the shared folder; only pivots are shared with tasks.

A query starts from its node's list and, round by round, expands the nearest candidates not yet expanded, keeping the EF
nearest; rounds end when all of the SURE nearest and 49 in 50 of all candidates are expanded.

All distances are Euclidean, in double precision, on the original vectors: within a group by products of vectors less their
mean, and by differences where products would lose digits; from a query always by differences. So tight groups and any
magnitudes rank as they are.

Vectors that are null, empty, zero, hold null or non-finite components, or differ in length from the most frequent length
take no part. Rows with a null vec_id take no part. Ties go to the smaller vec_id; repeated rows count
once, and a vec_id is taken to name one vector. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, release, written

K = 20
REVERSE = 20
PIVOTS, SHARES = 4096, 8
BLOCK = 256
ROUNDS = 6
EF, EXPAND, SURE = 400, 160, 60
TOP = 10
LIST = "id long, nid long, d double"


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def pack(df: DataFrame) -> DataFrame:
    """(id, vec): a vector as the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.asarray(x, np.float64).tobytes() for x in batch.column("v").to_pylist()], pa.binary())], ["id", "vec"])

    return df.select("id", "v").mapInArrow(run, "id long, vec binary")


def near(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours in each list; every task first cuts its own part."""
    best = lists.groupBy("id", "nid").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "nid"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def first_lists(nodes: DataFrame, n: int) -> DataFrame:
    """(id, nid, d): nearest within blocks of vectors that share a pivot."""
    spark = nodes.sparkSession
    pivots = nodes.select("id", "vec").orderBy(F.xxhash64("id")).limit(min(PIVOTS, max(1, n // 32))).collect()
    p = np.stack([np.frombuffer(r["vec"], np.float64) for r in pivots])
    scale = np.abs(p).max()
    middle = (p / scale).mean(0)
    shared = spark.sparkContext.broadcast((p / scale - middle, middle, scale))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, middle, scale = shared.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = np.clip(matrix(part.column("vec")) / scale - middle, -1e150, 1e150) @ p.T - half
                k = min(SHARES, s.shape[1])
                close = np.argpartition(-s, k - 1, axis=1)[:, :k]
                for j in range(k):
                    yield pa.RecordBatch.from_arrays([pa.array(close[:, j].astype(np.int64)), part.column("id"), part.column("vec")], ["pivot", "id", "vec"])

    placed = written(nodes.select("id", "vec").mapInArrow(assign, "pivot long, id long, vec binary"), "placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # at most PIVOTS rows
    blocks = placed.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).groupBy("pivot", "block").agg(F.collect_list(F.struct("id", "vec")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members").to_pylist():
                ids = np.array([m["id"] for m in members])
                v = np.stack([np.frombuffer(m["vec"], np.float64) for m in members])
                k = min(K, len(ids) - 1)
                if k < 1:
                    continue
                d = apart(v)
                np.fill_diagonal(d, np.inf)
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], ["id", "nid", "d"])

    return blocks.mapInArrow(compare, LIST)


def lengths(diff: np.ndarray) -> np.ndarray:
    """Euclidean length of each row, safe from overflow and underflow of squares."""
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((diff * diff).sum(-1))
    odd = ~((d > 1e-140) & (d < 1e140))
    if odd.any():
        top = np.abs(diff[odd]).max(-1)
        safe = np.where(top > 0, top, 1)
        d[odd] = top * np.sqrt(((diff[odd] / safe[:, None]) ** 2).sum(-1))
    return d


def apart(v: np.ndarray) -> np.ndarray:
    """Distances between all rows of one group."""
    scale = np.abs(v).max()
    x = v / scale
    x = x - x.mean(0)
    norm = (x * x).sum(1)
    total = norm[:, None] + norm[None, :]
    d2 = total - 2 * (x @ x.T)
    i, j = np.nonzero(np.triu(d2 < 1e-5 * total, 1))  # here products would lose digits
    d = np.sqrt(np.maximum(d2, 0)) * scale
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        d[a, b] = d[b, a] = lengths(v[a] - v[b])
    return d


def descend(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (id, nid, d) of one round: pairs among a node's neighbours and reverse neighbours, one of them new."""
    reverse = lists.select(F.col("nid").alias("id"), F.col("id").alias("nid"), "d", "new").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "nid"))).filter(F.col("rank") <= REVERSE).drop("rank")
    around = lists.union(reverse).groupBy("id", "nid").agg(F.max("new").alias("new"))
    around = around.withColumn("any", F.max("new").over(Window.partitionBy("id"))).filter("any").drop("any")
    worst = lists.groupBy("id").agg(F.max("d").alias("d"), F.count("*").alias("n")).select(F.col("id").alias("nid"), F.when(F.col("n") < K, F.lit(float("inf"))).otherwise(F.col("d")).alias("worst"))
    vectors = nodes.select(F.col("id").alias("nid"), "vec").join(worst, "nid")
    groups = around.join(vectors, "nid").groupBy("id").agg(F.collect_list(F.struct("nid", "new", "worst", "vec")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                a, b, dist = [], [], []
                part = batch.column("m").slice(at, 200)
                flat, ends = part.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in part])])
                ids, new, worst = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("nid", "new", "worst"))
                v = matrix(flat.field("vec"))
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    d = apart(v[lo:hi])
                    ok = (d < worst[lo:hi, None]) & (new[lo:hi, None] | new[None, lo:hi])
                    np.fill_diagonal(ok, False)
                    i, j = np.nonzero(ok)
                    a.append(ids[lo + i])
                    b.append(ids[lo + j])
                    dist.append(d[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, dist)], ["id", "nid", "d"])

    return groups.select("m").mapInArrow(compare, LIST)


def graph(nodes: DataFrame, n: int) -> DataFrame:
    """(id, nid, d, new): K neighbours of every node."""
    lists = written(near(first_lists(nodes, n).withColumn("new", F.lit(True)), K), "lists")
    for _ in range(ROUNDS):
        old = lists.withColumn("new", F.lit(False))
        after = written(near(descend(lists, nodes).withColumn("new", F.lit(True)).union(old), K), "lists")
        drop_table(lists)
        release(after)
        lists = after
        if lists.filter("new").count() < 0.05 * n * min(K, n):
            break
    return lists


def distances(pairs: DataFrame, vectors: DataFrame, origin: DataFrame) -> DataFrame:
    """(q, id, d): distances of pairs (q, id), given (id, vec) and (q, qv)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = lengths(matrix(part.column("vec")) - matrix(part.column("qv")))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("id"), pa.array(d)], ["q", "id", "d"])

    return pairs.join(vectors, "id").join(origin, "q").select("q", "id", "vec", "qv").mapInArrow(run, "q long, id long, d double")


def search(nodes: DataFrame, lists: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id, d): for each query node (q) its EF nearest nodes found, itself among them."""
    links = written(lists.select("id", "nid").union(lists.select(F.col("nid").alias("id"), F.col("id").alias("nid")).join(lists.select("id", "nid"), ["id", "nid"], "left_anti")), "links")
    origin = nodes.select(F.col("id").alias("q"), F.col("vec").alias("qv")).join(queries, "q")

    def measured(pairs: DataFrame) -> DataFrame:
        return distances(pairs, nodes.select("id", "vec"), origin)

    by_query = Window.partitionBy("q")
    start = measured(queries.select("q", F.col("q").alias("id"))).select("q", "id", "d", F.lit(True).alias("open"), F.lit(1).alias("rank"))
    state = written(start, "state")
    while True:
        left = state.agg(F.count_if("open").alias("open"), F.count_if(F.col("open") & (F.col("rank") <= SURE)).alias("near"), F.count("*").alias("n")).first()
        if not left["near"] and left["open"] <= left["n"] // 50:
            return state.select("q", "id", "d")
        turned = state.withColumn("turn", F.when(F.col("open"), F.row_number().over(by_query.orderBy(F.desc("open"), "d", "id"))))
        chosen = turned.filter(F.col("turn") <= EXPAND).select("q", "id")
        fresh = chosen.join(links, "id").select("q", F.col("nid").alias("id")).distinct().join(state.select("q", "id"), ["q", "id"], "left_anti")
        kept = turned.select("q", "id", "d", (F.col("open") & (F.col("turn") > EXPAND)).alias("open"))
        ranked = kept.union(measured(fresh).withColumn("open", F.lit(True))).withColumn("rank", F.row_number().over(by_query.orderBy("d", "id")))
        after = written(ranked.filter(F.col("rank") <= EF), "state")
        drop_table(state)
        release(after)
        state = after


def valid(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).filter("vec_id IS NOT NULL")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(v) == (length["n"] if length else -1))


def nearest(table: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest rows found for each row whose id is_query() accepts."""
    rows = written(valid(table, id_col, vec_col), "vectors")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("vec_id", "v").distinct().withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= top + 1)
    few = few.withColumn("id", F.min("vec_id").over(Window.partitionBy("v")))  # the smallest of a vector, at most top + 1
    few = written(few, "members")
    nodes = written(pack(few.filter("place = 1").select("id", "v")), "nodes")
    n = nodes.count()
    asked = rows.filter(is_query(F.col("vec_id"))).select("vec_id", "v").distinct().join(few.filter("place = 1").select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    if not n:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    asked = written(asked, "asked")
    found = search(nodes, graph(nodes, n), asked.select("q").distinct())
    by_query = Window.partitionBy("q").orderBy("d", "vec_id")
    listed = found.join(few.select("id", "vec_id"), "id").withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= top + 1).select("q", "vec_id", "d")
    pairs = asked.join(listed, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
