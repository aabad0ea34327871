"""Approximate nearest neighbours by inner product: NN-descent in Spark joins, then greedy search of the graph."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialize, read, release

#: Random-projection trees give the first graph; they are fitted on a sample of at most SAMPLE vectors.
TREES, LEAF, SAMPLE = 6, 200, 20_000
#: Links out of a node, and links into it that are followed backwards.
LINKS, BACK = 32, 32
#: Rounds of NN-descent, and the share of new links under which they end early; a member of a neighbourhood is offered so many others.
DESCENTS, SETTLED, OFFERS = 6, 0.02, 8
#: Nodes with which every query is compared for seeds, half of the largest norms and half by hash, and seeds that these give it.
HUBS, HUB_SEEDS = 2048, 16
#: Greedy search: best nodes kept, nodes expanded in a round; seeds a tree gives a query; candidates scored exactly, at least.
BEAM, EXPAND, SEEDS, RESCORE = 256, 64, 8, 64
#: Scores of half-float codes that differ by less may be in either order: each is wrong by 2 ** -10 at most.
BLUR = 2.0**-9


@dataclass
class Trees:
    """Directions and thresholds of TREES trees, by level and place in it."""

    directions: list[list[np.ndarray]]
    thresholds: list[list[np.ndarray]]

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int = TREES) -> Trees:
        """Each place splits its part of the sample at the median along the difference of two of its vectors."""
        rng, directions, thresholds = np.random.default_rng(4), [], []
        for _ in range(trees):
            parts, own_d, own_t = [np.arange(len(sample))], [], []
            for _ in range(depth):
                d, t, below = np.zeros((len(parts), sample.shape[1]), np.float32), np.zeros(len(parts), np.float32), []
                for k, part in enumerate(parts):
                    if len(part) > 1:
                        a, b = rng.choice(part, 2, replace=False)
                        d[k] = sample[a] - sample[b]
                        along = sample[part] @ d[k]
                        t[k] = np.median(along)
                        below += [part[along < t[k]], part[along >= t[k]]]
                    else:
                        below += [part, part[:0]]
                own_d.append(d)
                own_t.append(t)
                parts = below
            directions.append(own_d)
            thresholds.append(own_t)
        return cls(directions, thresholds)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for k, (ds, ts) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            for d, t in zip(ds, ts, strict=True):
                at = out[:, k]
                out[:, k] = 2 * at + (np.einsum("ij,ij->i", x, d[at]) >= t[at])
        return out


def usable(df: DataFrame, row_key: str, vector: str) -> DataFrame:
    """(id, vec as doubles, twin) of the rows that take part: a key, and a vector that is not zero and holds no null, NaN or
    infinity. Repeated rows count once."""
    rows = df.select(col(row_key).cast("long").alias("id"), col(vector).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(F.coalesce(sound, F.lit(False))).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _halves(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _placed(nodes: DataFrame, largest: float, query: bool) -> DataFrame:
    """(node, code): as half floats, the vector over the largest norm with a component that makes its length 1; a query has
    length 1 and 0 there. The cosine of two codes then orders as the inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if len(x):
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x, last = (x / length, np.zeros_like(length)) if query else (x / largest, np.sqrt(np.maximum(0, 1 - (length / largest) ** 2)))
                code = np.hstack([x, last]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "code"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, code binary")


def _in_leaves(codes: DataFrame, trees: Trees) -> DataFrame:
    """(node, code, tree, leaf): each node once a tree."""
    shared = codes.sparkSession.sparkContext.broadcast(trees)  # fitted on a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves(_halves(batch.column("code").to_pylist())) if len(batch) else np.zeros((0, TREES), np.int64)
            for k in range(leaves.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(np.full(len(batch), k, np.int32)), pa.array(leaves[:, k])], names=["node", "code", "tree", "leaf"])

    return codes.mapInArrow(run, "node long, code binary, tree int, leaf long")


_LISTS = "node long, ids array<bigint>, sims array<float>"


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest in each row, in no order."""
    n = min(n, sims.shape[1])
    return np.argpartition(-sims, n - 1, 1)[:, :n] if n < sims.shape[1] else np.broadcast_to(np.arange(n), (len(sims), n))


def _leaf_links(rows) -> object:
    """The LINKS nearest of each node within its leaf."""
    import pandas as pd

    x, ids = _halves(rows.code.tolist()), rows.node.to_numpy()
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    at = _best(sims, min(LINKS, max(1, len(ids) - 1))) if len(ids) > 1 else np.zeros((len(ids), 0), int)
    return pd.DataFrame({"node": ids, "ids": list(ids[at]), "sims": list(np.take_along_axis(sims, at, 1))})


def _merged(lists: DataFrame, n: int) -> DataFrame:
    """Lists of the same node as one: the n best, each id once. `fresh`: those that the list marked old lacks."""
    grouped = lists.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("sims")).alias("sims"), F.flatten(F.collect_list(F.when(F.col("old"), F.col("ids")))).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, out_sims, fresh = [], [], []
            for ids, sims, before in zip(batch.column("ids"), batch.column("sims"), batch.column("before"), strict=True):
                ids, at = np.unique(ids.values.to_numpy(), return_index=True)
                sims = sims.values.to_numpy()[at]
                top = np.argsort(-sims, kind="stable")[:n]
                out_ids.append(ids[top])
                out_sims.append(sims[top])
                fresh.append(~np.isin(ids[top], before.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_sims, pa.list_(pa.float32())), pa.array(fresh, pa.list_(pa.bool_()))], names=["node", "ids", "sims", "fresh"])

    return grouped.mapInArrow(run, _LISTS + ", fresh array<boolean>")


def _around(graph: DataFrame) -> DataFrame:
    """(node, other, fresh): a node's links, and of the links into it the BACK nearest; whether either is new."""
    out = graph.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("x")).select("node", F.col("x.ids").alias("other"), F.col("x.sims").alias("sim"), F.col("x.fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("sim"), "node"))
    back = out.withColumn("rank", rank).filter(F.col("rank") <= BACK).select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
    return out.select("node", "other", "fresh").union(back)


def _neighbourhoods(graph: DataFrame) -> DataFrame:
    """(node, members): struct (other, fresh), each other once."""
    once = _around(graph).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    return once.groupBy("node").agg(F.collect_list(F.struct("other", "fresh")).alias("members"))


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each neighbourhood, to each member the nearest other members that beat its worst link. Two members that were there
    before have met, and are not compared again."""
    for batch in batches:
        names, ids, sims = [], [], []
        for members in batch.column("members"):
            values = members.values
            own, worst = values.field("other").to_numpy(), values.field("worst").to_numpy()
            if len(own) < 2:
                continue
            x = _halves(values.field("code").to_pylist())
            near = x @ x.T
            fresh = values.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            near[np.ix_(~fresh, ~fresh)] = -np.inf
            np.fill_diagonal(near, -np.inf)
            at = _best(near, min(OFFERS, len(own) - 1))
            top = np.take_along_axis(near, at, 1)
            for k in np.flatnonzero((top > worst[:, None]).any(1)):
                good = top[k] > worst[k]
                names.append(own[k])
                ids.append(own[at[k][good]])
                sims.append(top[k][good])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))], names=["node", "ids", "sims"])


def _dealt(codes: DataFrame, trees: Trees, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, code, tree, leaf, part) and, by leaf, the number of parts: a leaf of over 2 * LEAF is dealt to several. Given the
    `sizes` of other codes, to their parts."""
    placed = materialize(_in_leaves(codes, trees))
    if sizes is None:
        sizes = materialize(placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("parts")))
    placed = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    return placed.drop("parts"), sizes


def build_graph(codes: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """NN-descent: (node, ids, sims) with the LINKS nearest found of each node.

    The first links are those within the parts of small leaves of `placed` (see _dealt). Then, round by round, every node's
    neighbourhood (links both ways) offers its members to each other: neighbours of neighbours. Neighbourhoods are formed of
    ids; codes are joined on only to those that hold a new link, and only pairs with a new one are compared. A node's lists are
    merged, the best stay; links into popular nodes are followed from the BACK nearest only, so no neighbourhood outgrows
    LINKS + BACK. Rounds are the same whatever the table's size, and end when few links are new.
    """
    lists = placed.groupBy("tree", "leaf", "part").applyInPandas(_leaf_links, _LISTS)
    graph = materialize(_merged(lists.withColumn("old", F.lit(False)), LINKS))
    for _ in range(DESCENTS):
        worst = graph.select("node", F.when(F.size("sims") < LINKS, F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float").alias("worst"))
        known = codes.join(worst, "node").select(F.col("node").alias("other"), "code", "worst")
        active = _neighbourhoods(graph).filter(F.exists("members", lambda m: m["fresh"])).select("node", F.explode("members").alias("m")).select("node", "m.other", "m.fresh")
        rows = active.join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "fresh", "code", "worst")).alias("members"))
        offers = rows.select("members").mapInArrow(_offers, _LISTS)
        graph = materialize(_merged(offers.withColumn("old", F.lit(False)).union(graph.select("node", "ids", "sims").withColumn("old", F.lit(True))), LINKS))
        release(codes.sparkSession)
        new = graph.agg(F.sum(F.aggregate("fresh", F.lit(0), lambda n, x: n + x.cast("int")))).first()[0] or 0
        if new < SETTLED * n * LINKS:
            break
    return graph.select("node", "ids", "sims", "fresh")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, code, ids, codes) to the scores of the ids, for each node expanded."""
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            q = _halves(part.column("code").to_pylist())
            sims = [_halves([c]).reshape(-1, q.shape[1]) @ q[k] for k, c in enumerate(part.column("codes").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("query"), part.column("ids"), pa.array(sims, pa.list_(pa.float32()))], names=["query", "ids", "sims"])


_STATE = "query long, ids array<bigint>, sims array<float>, done array<boolean>"


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beam and new scores of each query to its new beam."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for ids, sims, done in zip(batch.column("ids"), batch.column("sims"), batch.column("done"), strict=True):
            ids, sims, done = (x.values.to_numpy(zero_copy_only=False) for x in (ids, sims, done))
            order = np.lexsort((~done.astype(bool), ids))  # of an id that came twice, the row that says it is expanded
            first = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(order) else order
            top = first[np.argsort(-sims[first], kind="stable")[:BEAM]]
            for k, x in enumerate((ids, sims, done)):
                out[k].append(x[top])
        yield pa.RecordBatch.from_arrays([batch.column("query"), *[pa.array(x, pa.list_(t)) for x, t in zip(out, (pa.int64(), pa.float32(), pa.bool_()), strict=True)]], names=["query", "ids", "sims", "done"])


def _leaf_seeds(nodes, asked) -> object:
    """Of a part of a leaf, the SEEDS nodes nearest to each query."""
    import pandas as pd

    if not len(nodes) or not len(asked):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})
    x, ids, queries = _halves(nodes.code.tolist()), nodes.node.to_numpy(), asked.node.to_numpy()
    at = np.vstack([_best(_halves(asked.code.tolist()[lo : lo + 500]) @ x.T, SEEDS) for lo in range(0, len(asked), 500)])
    return pd.DataFrame({"query": np.repeat(queries, at.shape[1]), "node": ids[at].ravel()})


def _hub_seeds(queries: DataFrame, hubs: list, spark: SparkSession) -> DataFrame:
    """(query, node): the HUB_SEEDS hubs nearest to each query."""
    shared = spark.sparkContext.broadcast((np.array([r.node for r in hubs]), _halves([r.code for r in hubs])))  # HUBS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if len(batch):
                at = _best(_halves(batch.column("code").to_pylist()) @ x.T, HUB_SEEDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), at.shape[1])), pa.array(ids[at].ravel())], names=["query", "node"])

    return queries.select("node", "code").mapInArrow(run, "query long, node long")


def search_graph(queries: DataFrame, graph: DataFrame, codes: DataFrame, begin: DataFrame, k: int) -> DataFrame:
    """Greedy search for (node, code) queries: (query, candidate), RESCORE each at least, if so many were found.

    A query starts at its own node and at the nodes that `begin` (query, node) gives it. In each round the EXPAND best nodes
    of its beam that were not expanded yet are joined with their links, whose codes lie beside them, and the beam takes the
    best of all scores; it ends when no beam has a node left to expand (what leaves a beam does not come back). Nodes of the
    beam that codes cannot tell from the k-th best are candidates, however many. Adjacency is dealt to partitions by node once
    and cached (from written tables, so a lost executor's part is made again); each round only moves the frontier and the beams.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = _around(graph).select("node", "other").distinct().join(codes.select(F.col("node").alias("other"), "code"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "code")).alias("x"))
    links = links.mapInArrow(_packed, "node long, ids array<bigint>, codes binary")
    links = materialize(links).repartition(parts, "node").sortWithinPartitions("node").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        own = queries.select(F.col("node").alias("query"), "node")
        frontier = materialize(begin.union(own).distinct())
        asked = queries.select(F.col("node").alias("query"), "code")
        state = spark.createDataFrame([], _STATE)
        while True:
            reached = frontier.join(asked, "query").join(links, "node").select("query", "code", "ids", "codes").mapInArrow(_scored, "query long, ids array<bigint>, sims array<float>")
            fresh = reached.withColumn("done", F.transform("ids", lambda _: F.lit(False)))
            both = fresh.union(state).groupBy("query").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "done")])
            state = materialize(both.mapInArrow(_advance, _STATE))
            todo = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), 1, EXPAND)
            state = state.withColumn("todo", F.transform(todo, lambda x: x["ids"]))
            frontier = state.select("query", F.explode("todo").alias("node"))
            if frontier.isEmpty():
                break
            state = state.withColumn("done", F.zip_with("ids", "done", lambda i, d: d | F.array_contains(F.col("todo"), i))).drop("todo")
        least = F.try_element_at("sims", F.least(F.lit(k), F.size("sims"))) - F.lit(BLUR)
        close = F.size(F.filter("sims", lambda x: x >= least))  # a beam is in order of its scores
        return materialize(state.select("query", F.explode(F.slice("ids", F.lit(1), F.greatest(F.lit(RESCORE), close))).alias("candidate")))
    finally:
        links.unpersist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            x = [m.values for m in part.column("x")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([v.field("other").to_numpy() for v in x], pa.list_(pa.int64())), pa.array([b"".join(v.field("code").to_pylist()) for v in x], pa.binary())], names=["node", "ids", "codes"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            score = np.einsum("ij,ij->i", _matrix(batch.column("asked")), _matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("candidate"), pa.array(score)], names=["query", "node", "score"])


_ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(df: DataFrame, is_query: Column, *, row_key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """For each row of `is_query` (a condition on column id), the k other rows of the largest inner product found: query_id,
    rank (from 1), vec_id, score. Ties go to the smaller id; the score is the product of the very vectors in doubles.

    Equal vectors are one node (told by a 128-bit hash), searched once, that stands for its k + 1 smallest ids (no answer can
    need more), so a vector that a third of the rows share costs as much as one. See usable() for the rows that take no part.
    Vectors of different lengths have no product: those of each length are searched among themselves. An empty table, or one
    without queries, gives an empty result.
    """
    rows = materialize(usable(df, row_key, vector).withColumn("node", F.xxhash64("vec")).withColumn("twin", F.xxhash64(F.lit(1), "vec")))
    lengths = [r[0] for r in rows.select(F.size("vec")).distinct().collect()]  # one row for each length there is
    parts = [_nearest(rows.filter(F.size("vec") == n), is_query, k) for n in sorted(lengths)]
    return functools.reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], _ANSWER)


def _nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """nearest() among vectors of one length: (id, vec, node, twin)."""
    clash = materialize(rows.groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).filter("low < high").select("node", "low"))
    if not clash.isEmpty():  # different vectors agree in the first 64 bits: the others tell them apart
        rows = materialize(rows.join(clash, "node", "left").withColumn("node", F.when(F.col("low").isNull() | (F.col("low") == F.col("twin")), F.col("node")).otherwise(F.xxhash64("node", "twin"))).drop("low"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = materialize(rows.select("node", "id", rank.alias("rank")).filter(F.col("rank") <= k + 1).select("node", "id"))
    nodes = materialize(rows.groupBy("node").agg(F.first("vec").alias("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = nodes.agg(F.count(F.lit(1)), F.max(norm)).first()
    asked = rows.filter(is_query).select("node", "id")
    codes = materialize(_placed(nodes, largest, False))
    depth = max(0, int(np.ceil(np.log2(max(1, min(n, SAMPLE * LEAF / 8) / LEAF)))))  # 8 of the sample in a leaf, at least
    share = min(1.0, SAMPLE / n)
    drawn = codes.filter(F.pmod(F.xxhash64("node", F.lit("trees")), F.lit(1_000_000)) < int(share * 1e6)).orderBy("node").limit(2 * SAMPLE)
    trees = Trees.fit(_halves([r.code for r in drawn.select("code").collect()]) if depth else np.zeros((1, 1), np.float32), depth)
    placed, sizes = _dealt(codes, trees)
    graph = build_graph(codes, placed, n)
    wanted = materialize(_placed(nodes.join(asked.select("node").distinct(), "node"), largest, True))
    by = ["tree", "leaf", "part"]
    begin = placed.groupBy(*by).cogroup(_dealt(wanted, trees, sizes)[0].groupBy(*by)).applyInPandas(_leaf_seeds, "query long, node long")
    chosen = nodes.select("node", norm.alias("norm")).orderBy(F.desc("norm"), "node").limit(HUBS // 2).select("node")
    chosen = chosen.union(nodes.select("node").orderBy(F.xxhash64("node", F.lit("hub")), "node").limit(HUBS // 2)).distinct()
    hubs = codes.join(F.broadcast(chosen), "node").collect()  # HUBS rows
    begin = begin.union(_hub_seeds(wanted, hubs, rows.sparkSession))
    found = search_graph(wanted, graph, codes, begin, k + 1)
    found = found.union(wanted.select(F.col("node").alias("query"), F.col("node").alias("candidate"))).distinct()
    vec = lambda key, name: nodes.select(F.col("node").alias(key), F.col("vec").alias(name))
    scored = materialize(found.join(vec("query", "asked"), "query").join(vec("candidate", "vec"), "candidate").select("query", "candidate", "asked", "vec").mapInArrow(_exact, "query long, node long, score double"))
    order = [F.desc("score"), F.asc("id")]
    listed = scored.join(members, "node").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k + 1)
    mine = asked.select(F.col("node").alias("query"), F.col("id").alias("query_id")).distinct()
    answers = mine.join(listed, "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20, against all others; see nearest()."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
