"""Operator 3: nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on the driver to a bounded sample (``sample`` vectors of the lowest hashed ids), so it
grows with the table up to that bound. Every vector then goes down to its leaf. A query takes nodes from
a priority queue, best centroid first, until it has visited as many leaves as calibration found to reach
the wanted recall on vectors that were held out of the fit, and these hold more vectors than asked for.
Visits and vectors meet in cells: groups of neighbouring leaves, split by a hash where they hold many
vectors, so that no cell is large. A cell that many queries visit is answered in blocks of queries; only
such a cell's vectors are sent more than once. Best rows of all cells are ranked at the end.

Defined cases: vectors that are null, zero, of another dimension than most, or with null or
non-finite components take no part; with fewer candidates than asked for, all are returned; ties go
to the smaller id; rows repeated under one id count once, and none is a candidate of a query of the same
id; other columns are not read; no vectors or no queries give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import Scratch, require


class KMeansTree:
    """Centroids of all nodes; children of node i are ``children[i]``, none for a leaf."""

    def __init__(self, x: np.ndarray, branches: int = 8, leaf_rows: int = 48, rounds: int = 8):
        self.centroids: list[np.ndarray] = [x.mean(0)]
        self.children: list[list[int]] = [[]]
        self.leaf_of_node: dict[int, int] = {}
        self._split(0, x, branches, leaf_rows, rounds)
        self.centroid_matrix = np.array(self.centroids)

    def _split(self, node: int, x: np.ndarray, branches: int, leaf_rows: int, rounds: int) -> None:
        if len(x) > leaf_rows:
            order = np.argsort(x @ x.mean(0), kind="stable")
            centres = x[order[np.linspace(0, len(x) - 1, branches).astype(int)]]
            for _ in range(rounds):
                at = np.argmin(((centres**2).sum(1))[None] - 2 * x @ centres.T, axis=1)
                centres = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
            at = np.argmin(((centres**2).sum(1))[None] - 2 * x @ centres.T, axis=1)
            kept = [k for k in range(len(centres)) if (at == k).any()]
            if len(kept) > 1:
                for k in kept:
                    child = len(self.centroids)
                    self.centroids.append(centres[k])
                    self.children.append([])
                    self.children[node].append(child)
                    self._split(child, x[at == k], branches, leaf_rows, rounds)
                return
        self.leaf_of_node[node] = len(self.leaf_of_node)

    @property
    def leaves(self) -> int:
        return len(self.leaf_of_node)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going to the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int32)

        def down(node: int, rows: np.ndarray) -> None:
            if not self.children[node]:
                out[rows] = self.leaf_of_node[node]
            elif len(rows):
                c = self.centroid_matrix[self.children[node]]
                at = np.argmin((c**2).sum(1)[None] - 2 * x[rows] @ c.T, axis=1)
                for k, child in enumerate(self.children[node]):
                    down(child, rows[at == k])

        down(0, np.arange(len(x)))
        return out

    def visit(self, query: np.ndarray, most: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: the open node of largest inner product comes next.

        It stops after ``most`` leaves, but not before these hold ``least`` vectors by ``counts``.
        """
        score = self.centroid_matrix @ query
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < most or held < least):
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                out.append(self.leaf_of_node[node])
                held += 0 if counts is None else counts[out[-1]]
            for child in self.children[node]:
                heapq.heappush(heap, (-score[child], child))
        return out

    def calibrate(self, base: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
        """Leaves to visit so that the queries find ``recall`` of their k nearest in ``base``."""
        leaf, k = self.assign(base), min(k, len(base))
        needed = []
        for q in queries:
            nearest = np.argpartition(-(base @ q), k - 1)[:k]
            place = np.empty(self.leaves, dtype=np.int64)
            place[self.visit(q, self.leaves)] = np.arange(self.leaves)
            needed.append(place[leaf[nearest]])
        all_needed = np.sort(np.concatenate(needed))
        return min(self.leaves, int(all_needed[min(len(all_needed) - 1, math.ceil(recall * len(all_needed)))]) + 1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of double."""
    v = F.col("v")
    rows = require(df, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest_neighbours(df: DataFrame, queries: DataFrame | None = None, k: int = 20, recall: float = 0.96, sample: int = 65536, cell_rows: int = 16384, query_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k found of largest inner product for each query.

    ``queries`` is a frame of the same columns; by default all rows are queries.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    asked = rows if queries is None else usable(queries, id_col, vector_col)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    schema = "query_id long, rank int, id long, score double"
    if not taken.num_rows:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    x = matrix(taken["v"].combine_chunks())
    held = np.arange(len(x)) % max(2, len(x) // 256) == 1 if len(x) > 1 else np.ones(1, dtype=bool)
    tree = KMeansTree(x[~held] if not held.all() else x, leaf_rows=max(48, len(x) // 128))  # deeper trees cost more to walk than they save
    visits = tree.calibrate(x, x[held], k + 1, recall)
    scratch = Scratch(spark, "neighbours")

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(matrix(b.column(1))) if len(b) else []
            yield pa.record_batch({"id": b.column(0), "v": b.column(1), "leaf": pa.array(leaf, pa.int32())})

    index = scratch.save(rows.mapInArrow(to_leaves, "id long, v array<double>, leaf int"), "index")
    counted = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("id").alias("ids")).collect()  # at most as many rows as leaves
    counts = {r["leaf"]: r["count"] for r in counted}
    leaf_ids = np.zeros(tree.leaves, dtype=np.int64)
    for r in counted:
        leaf_ids[r["leaf"]] = r["ids"]
    group_of, parts_of, held_rows = {}, [], 0
    for leaf in range(tree.leaves):
        if not parts_of or held_rows + counts.get(leaf, 0) > cell_rows and held_rows:
            parts_of.append(1)
            held_rows = 0
        held_rows += counts.get(leaf, 0)
        group_of[leaf] = len(parts_of) - 1
        parts_of[-1] = max(1, math.ceil(held_rows / cell_rows))
    first_cell = [0]
    for p in parts_of:
        first_cell.append(first_cell[-1] + p)
    leaf_cells = np.array([first_cell[group_of[leaf]] for leaf in range(tree.leaves)])
    leaf_parts = np.array([parts_of[group_of[leaf]] for leaf in range(tree.leaves)])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % leaf_parts[leaf] if len(b) else []
            cell = leaf_cells[leaf] + part if len(b) else []
            yield pa.record_batch({"cell": pa.array(np.asarray(cell, dtype=np.int64), pa.int64()), "id": b.column(0), "v": b.column(1), "leaf": b.column(2)})

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, source, leaves = [], [], []
            ids, vectors = b.column(0).to_numpy(), matrix(b.column(1))
            for r in range(len(b)):
                by_group: dict[int, list[int]] = {}
                for leaf in tree.visit(vectors[r], visits, leaf_ids, k + 1):
                    by_group.setdefault(group_of[leaf], []).append(leaf)
                for g, found in by_group.items():
                    for c in range(first_cell[g], first_cell[g + 1]):
                        cells.append(c)
                        source.append(r)
                        leaves.append(found)
            at = pa.array(source, pa.int64())
            yield pa.record_batch({"cell": pa.array(cells, pa.int64()), "id": b.column(0).take(at), "v": b.column(1).take(at), "leaves": pa.array(leaves, pa.list_(pa.int32()))})

    def answer(queries_here: pa.Table, rows_here: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if queries_here.num_rows and rows_here.num_rows:
            v, ids, leaf = matrix(rows_here["v"].combine_chunks()), rows_here["id"].to_numpy(), rows_here["leaf"].to_numpy()
            qv, qid = matrix(queries_here["v"].combine_chunks()), queries_here["id"].to_numpy()
            visited = queries_here["leaves"].to_pylist()
            once = np.unique(ids, return_index=True)[1]
            v, ids, leaf = v[once], ids[once], leaf[once]
            once = np.unique(qid, return_index=True)[1]
            qv, qid, visited = qv[once], qid[once], [visited[k] for k in once]
            wanted = np.zeros((len(qid), tree.leaves), dtype=bool)
            for r, found in enumerate(visited):
                wanted[r, found] = True
            for at in range(0, len(qid), 128):
                part = qv[at : at + 128]
                rough = part @ v.T
                rough[~wanted[at : at + 128][:, leaf]] = -np.inf
                rough[qid[at : at + 128][:, None] == ids[None]] = -np.inf
                for r in range(len(part)):
                    s = rough[r]
                    cut = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    near = np.nonzero((s >= cut - 1e-9) & (s > -np.inf))[0]  # rounding cannot lose a tie
                    exact = (v[near] * part[r]).sum(1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out_q.append(np.full(len(best), qid[at + r]))
                    out_id.append(ids[near][best])
                    out_s.append(exact[best])
        join = lambda a, t: pa.array(np.concatenate(a) if a else [], t)
        return pa.table({"query_id": join(out_q, pa.int64()), "id": join(out_id, pa.int64()), "score": join(out_s, pa.float64())})

    visits_table = scratch.save(asked.select("id", "v").mapInArrow(to_visits, "cell long, id long, v array<double>, leaves array<int>"), "visits")
    blocks = scratch.save(visits_table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks")), "blocks")
    cells = index.mapInArrow(to_cells, "cell long, id long, v array<double>, leaf int").join(blocks, "cell")
    cells = cells.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "leaf")
    visits_table = visits_table.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "v", "leaves")
    found = visits_table.groupBy("cell", "block").cogroup(cells.groupBy("cell", "block")).applyInArrow(answer, "query_id long, id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "best"))
    out = ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("best.id").alias("id"), (-F.col("best.s")).alias("score"))
    return out.withColumnRenamed("id", id_col)
