"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard.

Equal vectors are one node that carries its smallest ids, so a vector that a third of all rows share is one node. Nodes are
dealt to shards of about `shard_size` by a hash. A shard's graph is built by one task and stored as flat arrays: the ids,
the vectors, the neighbours of layer 0 and of the layers above, each as one binary value. Queries are dealt in blocks to
every shard, search its graph, are scored on the original vectors in double precision, and Spark merges the shards' results.

Vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of different lengths never
meet. Repeated rows of one id and vector count once. An id may have several vectors; each is a candidate and a query. Null
ids take no part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

SHARD_SIZE, QUERY_BLOCK = 4096, 2048
LINKS, BUILD_WIDTH, SEARCH_WIDTH, SEED = 12, 64, 96, 5


class Graph:
    """Layer 0 has up to 2 * links neighbours a node, each layer above up to `links`; -1 fills the rows."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.x = vectors  # float32, unit length
        self.links = links
        self.layers: list[np.ndarray] = []
        self.entry = -1

    def search(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes found from the entries, as (similarity, node), nearest first."""
        near, seen = self.layers[layer], np.zeros(len(self.x), bool)
        seen[[e[1] for e in entries]] = True
        todo = [(-s, i) for s, i in entries]
        best = list(entries)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            nodes = near[i]
            nodes = nodes[nodes >= 0]
            nodes = nodes[~seen[nodes]]
            if not len(nodes):
                continue
            seen[nodes] = True
            sims = self.x[nodes] @ q
            if len(best) >= width:
                keep = sims > best[0][0]
                nodes, sims = nodes[keep], sims[keep]
            for sim, node in zip(sims.tolist(), nodes.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (sim, node))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, node))
                else:
                    continue
                heapq.heappush(todo, (-sim, node))
        return sorted(best, reverse=True)

    def _spread(self, node: int, nodes: list[int], most: int) -> list[int]:
        """Neighbours nearer to the node than to each other first, then the nearest of the rest."""
        at = np.array(nodes)
        to_node = self.x[at] @ self.x[node]
        order = np.argsort(-to_node, kind="stable")
        at, to_node = at[order], to_node[order]
        among = self.x[at] @ self.x[at].T
        chosen, rest = [], []
        for i in range(len(at)):
            if len(chosen) < most and (not chosen or among[i, chosen].max() < to_node[i]):
                chosen.append(i)
            else:
                rest.append(i)
        return at[chosen + rest[:most - len(chosen)]].tolist()

    def build(self, width: int = BUILD_WIDTH, seed: int = SEED) -> Graph:
        n = len(self.x)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(self.links)).astype(int), 12)
        top = int(levels.max()) if n else 0
        self.layers = [np.full((n, self.links * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        reached = -1
        for node in range(n):
            level = int(levels[node])
            if reached >= 0:
                found = [(float(self.x[self.entry] @ self.x[node]), self.entry)]
                for layer in range(reached, -1, -1):
                    if layer > level:
                        found = self.search(self.x[node], found, 1, layer)
                        continue
                    found = self.search(self.x[node], found, width, layer)
                    near = self.layers[layer]
                    chosen = self._spread(node, [i for _, i in found], self.links)
                    near[node, :len(chosen)] = chosen
                    for other in chosen:
                        free = np.flatnonzero(near[other] < 0)
                        if len(free):
                            near[other, free[0]] = node
                        else:
                            near[other] = self._spread(other, [*near[other].tolist(), node], near.shape[1])
            if level > reached:
                self.entry, reached = node, level
        return self

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            found = self.search(q, found, 1, layer)
        return [i for _, i in self.search(q, found, width, 0)]


#: Partitions per shard, so that hashed shards seldom share a task.
SPREAD = 2


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows `vec_id`, `vector` array<double> of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))


def nodes(vectors: DataFrame, keep: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct usable vectors as `vector` array<double>, each with its `keep` smallest ids."""
    rows = usable(vectors, vec_id, embedding).dropDuplicates(["vector", "vec_id"])
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def build_index(vectors: DataFrame, keep: int, shard_size: int = SHARD_SIZE, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = SEED, **columns: str) -> DataFrame:
    """One row per shard: `dims`, `shard`, and its graph as flat arrays. `keep` bounds the ids of equal vectors."""
    distinct = cut_lineage(nodes(vectors, keep, **columns).withColumn("dims", F.size("vector")))
    counts = distinct.groupBy("dims").agg(F.expr(f"cast(ceil(count(*) / {float(shard_size)}) as int)").alias("shards"))
    dealt = distinct.join(counts, "dims").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        exact = np.array(rows["vector"].tolist(), np.float64)
        order = np.argsort([i[0] for i in rows["ids"]], kind="stable")  # whatever order the rows came in
        exact = exact[order]
        ids = [list(rows["ids"].iloc[i]) for i in order]
        graph = Graph((exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32), links).build(width, seed)
        flat = lambda parts: np.concatenate(parts).astype(np.int64).tobytes() if parts else b""
        return pd.DataFrame([{
            "dims": key[0], "shard": key[1], "entry": graph.entry, "ids": flat(ids), "n_ids": np.array([len(i) for i in ids], np.int32).tobytes(),
            "exact": exact.tobytes(), "near": np.stack([graph.layers[0]]).tobytes(),
            "above": b"".join(layer.tobytes() for layer in graph.layers[1:]), "shards": int(rows["shards"].iloc[0]),
        }])

    schema = "dims int, shard int, entry int, ids binary, n_ids binary, exact binary, near binary, above binary, shards int"
    # graphs are small in bytes and long in work: a counted number of partitions is not merged at run time
    n_shards = counts.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    return dealt.repartition(SPREAD * n_shards, "dims", "shard").groupBy("dims", "shard").applyInPandas(build, schema)


def load(row: pd.Series, links: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, exact vectors, ids and where each node's ids begin."""
    exact = np.frombuffer(row["exact"], np.float64).reshape(-1, int(row["dims"]))
    graph = Graph((exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32), links)
    n, above = len(exact), np.frombuffer(row["above"], np.int32)
    graph.layers = [np.frombuffer(row["near"], np.int32).reshape(n, -1), *above.reshape(-1, n, links)]
    graph.entry = int(row["entry"])
    ends = np.cumsum(np.frombuffer(row["n_ids"], np.int32))
    return graph, exact, np.frombuffer(row["ids"], np.int64), np.concatenate([[0], ends])


def search_index(index: DataFrame, queries: DataFrame, k: int, links: int = LINKS, width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK, query_id: str = "query_id") -> DataFrame:
    """`queries` has `query_id` and `vector`. Per query its `k` nearest: `query_id`, `rank`, `vec_id`, `score`.

    A query's own id is no candidate. The index must keep at least k + 1 ids of equal vectors.
    """
    n_blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col(query_id).alias("query_id"), "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64("vector", query_id), F.lit(n_blocks)).cast("int").alias("block"))
    shards = index.groupBy("dims").agg(F.max("shards").alias("shards"))
    spread = asked.join(shards, "dims").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    graphs = index.drop("shards").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def look_up(key: tuple, query_rows: pd.DataFrame, graph_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph_rows) and len(query_rows):
            graph, exact, ids, at = load(graph_rows.iloc[0], links)
            norms = np.sqrt(np.einsum("ij,ij->i", exact, exact))
            for own, vector in zip(query_rows["query_id"], query_rows["vector"]):
                q = np.array(vector, np.float64)
                norm = np.sqrt(np.einsum("i,i->", q, q))
                found = np.array(graph.nearest((q / norm).astype(np.float32), max(width, k + 1)))
                scores = np.einsum("ij,j->i", exact[found], q) / (norms[found] * norm)
                hits = [(-s, int(i)) for s, node in zip(scores.tolist(), found) for i in ids[at[node]:at[node + 1]] if i != own]
                out += [(own, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    tasks = SPREAD * n_blocks * max(1, index.count())
    keyed = lambda rows: rows.repartition(tasks, "dims", "shard", "block").groupBy("dims", "shard", "block")
    found = keyed(spread).cogroup(keyed(graphs))
    hits = found.applyInPandas(look_up, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
