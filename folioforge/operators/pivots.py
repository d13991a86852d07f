"""A stored index of vectors that finds each query's best rows exactly, and reads few of them.

Rows are laid out round pivots, which are fitted on a bounded sample (`SAMPLED` rows of least hash) and then take every
row: a row belongs to the pivot nearest to it as a unit vector. Within a cell rows are sorted by their distance from
the pivot and cut into blocks of at most `BLOCK` rows, each with its least and greatest distance.

    path/blocks   cell, file, place, n, near, far    a row a block
    path/data     ids and vectors of blocks, in files that `blocks` names

For unit vectors cosine and distance tell the same: d * d = 2 - 2 * cosine. By the triangle inequality no row of a block is
nearer to a query than the query's distance from the pivot less the block's greatest, or the
block's least less that. A search first reads the cells nearest to each query until they hold as many
rows as are asked for; the least of the best scores among these is a floor, and of all other blocks those are
read that could hold a row above it. A task is dealt some blocks, reads what any query needs and keeps a running best a query.

Rows and queries that are (nearly) zero have no direction: such rows are a cell of their own that all queries read, and such a
query reads all. Null vectors are left out. Ids are long. What a worker holds is a block of queries, the pivots (`CELLS` at
most) and one block of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.dense import HELD, Best
from folioforge.session import cut

SAMPLED, CELLS, ROUNDS, BLOCK = 20_000, 4096, 8, 512

#: Norms under this have no direction; scores are rounded to 6 places, so floors are held that much lower.
TINY, SLACK = 1e-5, 2e-6


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors, and whether they are too short to be."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.maximum(norms, TINY)[:, None], norms < TINY


def fit_pivots(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of the directions nearest to each pivot, some rounds over."""
    units, tiny = _units(sample)
    units = units[~tiny]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    pivots = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = (units @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, units)
        moved, none = _units(sums)
        pivots = np.where(none[:, None], pivots, moved)
    return pivots


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sampled: int = SAMPLED, block: int = BLOCK) -> PivotIndex:
    """Indexes vectors under path (a URI). cells: as many as the square root of the rows, if it isn't given."""
    spark = vectors.sparkSession
    there = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = there.count()
    sample = there.orderBy(F.xxhash64("v"), "id").limit(sampled).select("v").collect()  # bounded by `sampled`
    rows = np.array([r["v"] for r in sample], np.float64) if sample else np.zeros((0, 1))
    pivots = fit_pivots(rows, min(CELLS, cells or max(1, int(n**0.5))))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units, tiny = _units(_matrix(batch.column(1), batch.num_rows))
                near = units @ pivots.T if len(pivots) else np.zeros((len(units), 1))
                cell = np.where(tiny, -1, near.argmax(axis=1))
                apart = np.where(tiny, 0.0, np.sqrt(np.maximum(0.0, 2 - 2 * near.max(axis=1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], names=["id", "v", "cell", "apart"])

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = there.mapInArrow(assigned, f"id long, v {there.schema['v'].dataType.simpleString()}, cell int, apart double")
    order = ["cell", "apart", "id"]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(f"{folder}/data", recursive=True)
        name, place = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{folder}/data/{name}") as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, cell, apart = (np.asarray(batch.column(k)) for k in (0, 2, 3))
                data = _matrix(batch.column(1), batch.num_rows)
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                told = []
                for a, b in zip(starts, np.append(starts[1:], len(cell))):
                    for at in range(a, b, block):
                        to = min(b, at + block)
                        written = out.write(ids[at:to].astype("<i8").tobytes() + data[at:to].astype("<f8").tobytes())
                        told.append((int(cell[a]), name, place, to - at, float(apart[at]), float(apart[to - 1])))
                        place += written
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), kinds)], names=["cell", "file", "place", "n", "near", "far"])

    sorted_ = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(stored, "cell int, file string, place long, n int, near double, far double").write.parquet(f"{path}/blocks")
    return PivotIndex(spark, path, pivots)


class PivotIndex:
    def __init__(self, spark: SparkSession, path: str, pivots: np.ndarray):
        self.spark, self.path, self.pivots = spark, path, pivots
        self.blocks = spark.read.parquet(f"{path}/blocks")
        told = self.blocks.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
        self.sizes = np.zeros(len(pivots), np.int64)
        for r in told:
            if r["cell"] >= 0:
                self.sizes[r["cell"]] = r["n"]
        #: Rows read by searches so far; a task that runs again counts again.
        self.rows_read = spark.sparkContext.accumulator(0)

    def search(self, queries: DataFrame, keep: int = 500, id_col: str = "vec_id") -> DataFrame:
        """query_id, id and score (rounded to 6 places) of each query's `keep` best rows, ties by id, at least; rank
        them to get the best. queries: query_id (long), embedding. They are read some at a time."""
        out, after, most = None, None, max(1, min(4096, HELD // keep))
        while True:
            open_ = queries.where(f"query_id > {after}") if after is not None else queries
            rows = open_.orderBy("query_id").limit(most).collect()  # a block of bounded size
            if rows:
                part = self._found(np.array([r["query_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64), keep)
                out = part if out is None else out.unionByName(part)
                after = rows[-1]["query_id"]
            if len(rows) < most:
                break
        if out is None:
            out = self.spark.createDataFrame([], "query_id long, id long, score double")
        return out.withColumnRenamed("id", id_col)

    def _found(self, ids: np.ndarray, matrix: np.ndarray, keep: int) -> DataFrame:
        units, tiny = _units(matrix)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (units @ self.pivots.T))) if len(self.pivots) else np.zeros((len(ids), 0))
        order = np.argsort(apart, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        first = np.zeros(apart.shape, bool)
        np.put_along_axis(first, order, before < keep, axis=1)
        first |= tiny[:, None]
        near = cut(self._scored(ids, matrix, keep, apart, first, None))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        floors = near.withColumn("at", F.row_number().over(best)).where(F.col("at") == keep).select("query_id", "score").collect()  # a row a query
        floor = {r["query_id"]: r["score"] for r in floors}
        reach = np.array([np.sqrt(max(0.0, 2 - 2 * (floor[q] - SLACK))) if q in floor else np.inf for q in ids.tolist()])
        return near.unionByName(self._scored(ids, matrix, keep, apart, first, reach))

    def _scored(self, ids: np.ndarray, matrix: np.ndarray, keep: int, apart: np.ndarray, first: np.ndarray, reach: np.ndarray | None) -> DataFrame:
        """The best rows of the cells in first, or, with reach, of all other blocks that may hold rows so near."""
        path, counter, norms = self.path, self.rows_read, np.sqrt((matrix * matrix).sum(axis=1))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, folder = pyarrow.fs.FileSystem.from_uri(path)
            held, name, source = Best(len(ids), keep), None, None
            for batch in batches:
                for cell, file, place, n, near, far in zip(*(c.to_pylist() for c in batch.columns)):
                    if cell < 0:
                        asks = np.full(len(ids), reach is None)
                    elif reach is None:
                        asks = first[:, cell]
                    else:
                        bound = np.maximum(apart[:, cell] - far, near - apart[:, cell])
                        asks = ~first[:, cell] & (bound <= reach + 1e-7)
                    some = np.flatnonzero(asks)
                    if not len(some):
                        continue
                    if file != name:
                        name, source = file, fs.open_input_file(f"{folder}/data/{file}")
                    data = source.read_at(8 * n * (1 + matrix.shape[1]), place)
                    own, rows = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", offset=8 * n).reshape(n, -1)
                    size = np.sqrt((rows * rows).sum(axis=1))
                    held.add(np.round(rows @ matrix[some].T / np.maximum(size[:, None] * norms[None, some], 1e-12), 6), own, some)
                    counter.add(n)
            yield from held.batches(ids, ["query_id", "id", "score"])

        dealt = self.blocks.select("cell", "file", "place", "n", "near", "far").repartition(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "file", F.floor(F.col("place") / (1 << 22))).sortWithinPartitions("file", "place")
        return dealt.mapInArrow(best, "query_id long, id long, score double")
