"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, 3-word shingles with repeats
(fewer words: the whole sequence; none: fingerprint zero, linked like any other),
XXH64 with seed 42; a bit is 1 if set in over half of the hashes. One Arrow-batched
pass; only id and fingerprint leave it.

Links (at most 3 differing bits) are looked for among distinct fingerprints, so
copies count once however many there are. Of four 16-bit blocks at least one is equal
in any linked pair: each fingerprint goes to four tasks' tries, once for each block,
rotated so that the block leads. Sorted fingerprints are an implicit binary trie with
the block's value as root, and each trie is joined with itself: pairs of nodes go down
together, a differing bit costs one of the budget, a pair is pruned when its cost passes
3, and two nodes that hold one fingerprint each are compared over the bits that are left.
Tasks sort by root and read root after root, so that one holds little more than its
largest. A root with more than `most_in_trie` fingerprints is dealt out anew by the same
argument on the remaining bits (four blocks of 12, then of 9), which loses no link; below
the last of them 27 bits are left, so a root holds 1 GB at most. A task gives a spanning
forest of the links of each root, kept up to date as they are found, not all pairs.
Components are then joined across tasks by alternating star contraction with checkpoints.

component_id is the smallest doc_id reachable, the row's own included. Null ids share
a component with what they resemble but are never its name unless all are null. Rows
that repeat an id are linked if alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.components import connected_components
from folioforge.llm.columns import keep_rows
from folioforge.llm.groups import whole_groups
from folioforge.session import cut

BITS = 64
BUDGET = 3
SHINGLE = 3
#: Widths of the blocks that are split off at each level: 4 * 16 = 64, 4 * 12 = 48, 4 * 9 = 36.
WIDTHS = (16, 12, 9)
#: Fingerprints that a task joins at once, if its roots are not larger.
ROWS = 1 << 16


def fingerprint(text: str | None, at_once: int = 1 << 16) -> int:
    """The unsigned 64-bit fingerprint of a text; memory stays bounded for any length."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    first = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    last = ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, at_once):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[i : i + at_once], last[i : i + at_once])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def trie_join(values: np.ndarray, depth: int, budget: int = BUDGET, at_once: int = 1 << 14, seen: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs of the sorted distinct values that agree in their leading
    `depth` bits and differ in at most `budget` bits, some at a time. seen: gets the numbers of
    node pairs that went down, were pruned, and came to single values."""
    if len(values) < 2:
        return
    seen = {} if seen is None else seen
    lead = values >> np.uint64(BITS - depth)
    starts = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1]))).astype(np.int64)
    ends = np.append(starts[1:], len(values)).astype(np.int64)
    many = ends - starts > 1
    stack = [(depth, (starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int8), np.ones(many.sum(), bool)))]
    while stack:
        at, frontier = stack.pop()
        if len(frontier[0]) > at_once:
            stack.append((at, tuple(x[at_once:] for x in frontier)))  # of each level at most a few times `at_once` wait
            frontier = tuple(x[:at_once] for x in frontier)
        single = (frontier[1] - frontier[0] == 1) & (frontier[3] - frontier[2] == 1)
        i, j = frontier[0][single], frontier[2][single]
        if len(i):
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
        lo_a, hi_a, lo_b, hi_b, cost, same = (x[~single] for x in frontier)
        if not len(lo_a):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - at)
        above = ~np.uint64((1 << (BITS - at)) - 1)

        def middle(lo, hi, bit=bit, above=above):
            return np.clip(np.searchsorted(values, (values[lo] & above) | bit), lo, hi)

        mid_a, mid_b = middle(lo_a, hi_a), middle(lo_b, hi_b)
        children = [(lo_a, mid_a, lo_b, mid_b, cost, same), (mid_a, hi_a, mid_b, hi_b, cost, same), (lo_a, mid_a, mid_b, hi_b, cost + 1, np.zeros_like(same))]
        two = ~same
        children.append(tuple(x[two] for x in (mid_a, hi_a, lo_b, mid_b)) + (cost[two] + 1, same[two]))
        merged = [np.concatenate(x) for x in zip(*children)]
        there = (merged[1] > merged[0]) & (merged[3] > merged[2]) & ~(merged[5] & (merged[1] - merged[0] < 2))
        alive = there & (merged[4] <= budget)
        for name, n in (("down", len(lo_a)), ("pruned", int((there & ~alive).sum())), ("single", len(i))):
            seen[name] = seen.get(name, 0) + n
        if alive.any():
            stack.append((at + 1, tuple(x[alive] for x in merged)))


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that join what the links i-j join, at most one for a node."""
    label = np.arange(n)
    for i, j in found:
        while len(i):
            least = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            while not np.array_equal(label[label], label):
                label = label[label]
            if np.array_equal(before, label):
                break
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _keys(level: int, path: list[int]) -> list[tuple[int, int]]:
    """Start and width of the block that each step of a path of block numbers takes, counted in
    the bits that the steps before have left."""
    return [(path[k] * WIDTHS[k], WIDTHS[k]) for k in range(level + 1)]


def arrange(fp: np.ndarray, path: list[int]) -> np.ndarray:
    """The fingerprints with the bits of the path's blocks moved to the front."""
    left = list(range(BITS))
    order: list[int] = []
    for start, width in _keys(len(path) - 1, path):
        order += left[start : start + width]
        left = left[:start] + left[start + width :]
    order += left
    out = np.zeros_like(fp)
    run = 0  # whole runs of neighbouring bits move at once
    while run < BITS:
        end = run
        while end + 1 < BITS and order[end + 1] == order[end] + 1:
            end += 1
        width = end - run + 1
        part = (fp >> np.uint64(BITS - 1 - order[end])) & np.uint64((1 << width) - 1)
        out |= part << np.uint64(BITS - 1 - end)
        run = end + 1
    return out


def _path(code: int, level: int) -> list[int]:
    return [code >> (2 * k) & 3 for k in range(level, -1, -1)]


_DEALT = pa.schema([("fp", pa.int64()), ("code", pa.int32()), ("lead", pa.int64())])


def _deal(frame: DataFrame, level: int) -> DataFrame:
    """Each fingerprint (fp, code: the path so far) once for each block of the level: the longer
    path's code and the bits that lead."""
    depth = sum(WIDTHS[: level + 1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, codes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                own = fp[codes == code]
                for block in range(4):
                    deeper = int(code) * 4 + block
                    lead = arrange(own.view(np.uint64), _path(deeper, level)) >> np.uint64(BITS - depth)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), deeper, np.int32)), pa.array(lead.view(np.int64))], schema=_DEALT)

    return frame.select("fp", "code").mapInArrow(dealt, "fp long, code int, lead long")


def _joined(frame: DataFrame, level: int) -> DataFrame:
    """The spanning edges (a, b) of the links that each root's trie holds."""
    depth = sum(WIDTHS[: level + 1])

    def of_roots(fp: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for code in np.unique(codes):
            own = fp[codes == code]
            values = arrange(own.view(np.uint64), _path(int(code), level))
            order = np.argsort(values)
            node, to = spanning(len(own), trie_join(values[order], depth))
            yield pa.RecordBatch.from_arrays([pa.array(own[order[node]]), pa.array(own[order[to]])], names=["a", "b"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, _, fp in whole_groups(batches, 2, ROWS):
            yield from of_roots(fp, code)

    sorted_ = frame.repartition("code", "lead").sortWithinPartitions("code", "lead")
    return sorted_.select("code", "lead", "fp").mapInArrow(edges, "a long, b long")


def links(distinct: DataFrame, most_in_trie: int = 50_000) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (fp) with the components of all links."""
    out, frame = None, distinct.select("fp", F.lit(0).alias("code"))
    for level in range(len(WIDTHS)):
        dealt = _deal(frame, level)
        heavy = None
        if level + 1 < len(WIDTHS):
            heavy = cut(dealt.groupBy("code", "lead").count().where(F.col("count") > most_in_trie).drop("count"))
            if heavy.isEmpty():
                heavy = None
        light = dealt.join(heavy, ["code", "lead"], "left_anti") if heavy is not None else dealt
        part = _joined(light.select("fp", "code", "lead"), level)
        out = part if out is None else out.unionByName(part)
        if heavy is None:
            return out
        frame = dealt.join(heavy, ["code", "lead"]).select("fp", "code")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_trie: int = 50_000) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs."""
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes, most_in_trie))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").withColumn("part", F.coalesce("component", "fp"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    # one row a fingerprint; a fingerprint of many rows is split by AQE's skew join
    of = cut(named.join(least, "part").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of the smallest id of each component only; rows without an id are
    never dropped, for nothing tells them apart. Rows that repeat an id share its fate."""
    found = near_duplicates(docs, id_col, text_col)
    dropped = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone and doc_id is not null")
    return keep_rows(docs, dropped.select("doc_id"), id_col, "left_anti")
