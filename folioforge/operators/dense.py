"""The dense lane: cosine of every query vector with every row's vector.

The search is exhaustive. Query vectors, few by contract, are shipped as one matrix behind a
check of their number; a task multiplies it with its rows some at a time and keeps a running
best of `keep` rows a query, so that only these leave it. More queries go in blocks. Rows of groups come
one group after the other, and a group's best leave when its rows are over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Best rows that a task holds for all queries of a block, and products that it holds at once.
HELD, PRODUCTS = 4_000_000, 2_000_000


class Best:
    """The best rows of each query so far: score from high to low, then id."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.scores, self.ids = keep, [np.empty(0)] * queries, [None] * queries

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: a row for each of ids, a column for each query (of queries, if not of all)."""
        for k, q in enumerate(range(scores.shape[1]) if queries is None else queries.tolist()):
            own, held = scores[:, k], self.scores[q]
            if len(held) == self.keep:
                better = np.flatnonzero(own >= held[-1])
                if not len(better):
                    continue
                own, new = own[better], ids[better]
            else:
                new = ids
            own, new = np.concatenate((held, own)), new if self.ids[q] is None else np.concatenate((self.ids[q], new))
            if len(own) > self.keep:
                least = -np.partition(-own, self.keep - 1)[self.keep - 1]
                some = np.flatnonzero(own >= least)  # more than enough only by ties
                own, new = own[some], new[some]
            order = np.lexsort((new, -own))[: self.keep]
            self.scores[q], self.ids[q] = own[order], new[order]

    def batches(self, queries: np.ndarray, names: list[str], group: tuple | None = None) -> Iterator[pa.RecordBatch]:
        """The best rows with the ids of their queries and, with group (name, value and type), a column of that."""
        for q in range(0, len(queries), 1000):
            parts = [k for k in range(q, min(q + 1000, len(queries))) if len(self.scores[k])]
            if parts:
                columns = [np.repeat(queries[parts], [len(self.scores[k]) for k in parts]), np.concatenate([self.ids[k] for k in parts]), np.concatenate([self.scores[k] for k in parts])]
                arrays = [pa.array(c) for c in columns]
                if group:
                    arrays, names = [*arrays, pa.array([group[1]] * len(columns[0]), group[2])], [*names[:3], group[0]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


def score(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 500, group_col: str | None = None) -> DataFrame:
    """query_id, id and score (rounded to 6 places) of at least each query's `keep` best rows
    (ties by id) of each task; rank them to get the best of all. With group_col the best are those
    of each of its values, which is a column too. queries: query_id (long), embedding. Null
    vectors are left out."""
    out, after, block = None, None, max(1, min(65_536, HELD // keep))
    while True:
        open_ = queries.where(f"query_id > {after}") if after is not None else queries
        rows = open_.orderBy("query_id").limit(block).collect()  # a block of bounded size
        if not rows:
            break
        after = rows[-1]["query_id"]
        part = _scored(vectors, np.array([r["query_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64), id_col, vector_col, keep, group_col)
        out = part if out is None else out.unionByName(part)
        if len(rows) < block:
            break
    return out if out is not None else vectors.limit(0).selectExpr("0L as query_id", id_col, "0d as score", *([group_col] if group_col else []))


def _scored(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, id_col: str, vector_col: str, keep: int, group_col: str | None) -> DataFrame:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    step = max(1, PRODUCTS // len(ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(2).type if group_col else None
            if group_col and batch.num_rows:  # rows are sorted by group: those before this batch's are over
                for g in held.keys() - set(batch.column(2).to_pylist()):
                    yield from held.pop(g).batches(ids, ["query_id", id_col, "score"], (group_col, g, kind))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                own = np.asarray(some.column(0))
                rows = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1).astype(np.float64)
                size = np.sqrt((rows * rows).sum(axis=1))
                scores = np.round(rows @ matrix.T / np.maximum(size[:, None] * norms[None, :], 1e-12), 6)
                groups = some.column(2).to_pylist() if group_col else [None]
                for g in set(groups):
                    of = np.array([x == g for x in groups]) if group_col else slice(None)
                    held.setdefault(g, Best(len(ids), keep)).add(scores[of], own[of])
        for g, found in held.items():
            yield from found.batches(ids, ["query_id", id_col, "score"], (group_col, g, kind) if group_col else None)

    more = [group_col] if group_col else []
    schema = f"query_id long, {id_col} long, score double" + "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in more)
    rows = vectors.where(vectors[vector_col].isNotNull()).select(id_col, vector_col, *more)
    return (rows.sortWithinPartitions(group_col) if group_col else rows).mapInArrow(best, schema)
