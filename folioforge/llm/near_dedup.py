"""The near-dedup stage: SimHash links by trie join, completed to all texts of similarity 4/5.

Words are those of the fingerprints (A-Z lower-cased, [^\\x20\\x09-\\x0D]+); a text is the
set of its distinct 5-word shingles (fewer words: the whole sequence), each by a 64-bit hash.
Two texts are linked if the Jaccard similarity of their sets is at least 4/5. Most such pairs
differ in more fingerprint bits than a trie join can allow (see README), so the links of the
trie join over the sets' fingerprints are a start that brings large groups together, and a
self-join with prefix filters finds the rest.

No link is lost: sets as similar as that share one of the first n - ceil(4n/5) + 1
elements under any order that holds for all sets. The order here puts shingles that are
common in the corpus last (a bounded list, which decides speed alone) and others by hash,
so a passage that many texts hold brings no pairs unless it is nearly all of them.
A pair is looked at in the group of the first element that it shares, before which all of both
sets' elements differ; so an element at place p of n is of use only with sets of at most
9/4 (n - p) - n elements (`reach`). Beyond a ninth of the set these are smaller sets, never those
that have the element beyond a ninth themselves: pages of one template whose own words are more than
a link allows share such elements alone, and make no pairs.

Texts of equal sets are one node. The trie's links, and pairs within a shingle's group at
distances of 1, 2 and 4 (by size), are checked first; then all pairs that their components left
apart. So a large group of near copies costs about as many checks as it has texts, and not
their square. A pair is decided by sizes and parities: a bit for each of a number of classes,
of the number of elements in the class. Their difference is never more than that of the sets,
and less by twice the collisions among the elements that differ, of which there are so many with
a chance under 1e-12; what lies between these bounds is decided by the sets themselves. Texts
are read twice, and those of undecided pairs once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import simhash
from folioforge.llm.columns import keep_rows
from folioforge.llm.components import connected_components
from folioforge.llm.groups import whole_groups
from folioforge.session import cut, few

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Classes of the parities that go with each member of a group, and the least number of the wide ones.
CLASSES, WIDE = 256, 2048
#: Words of a text, and bytes of texts, that are hashed at once.
MOST_WORDS, AT_ONCE = 1 << 17, 1 << 19
_P = 0x9E3779B97F4A7C15
#: A random 64-bit number for each byte.
_OF_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 64, 256, np.uint64, False)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _P and of its inverse modulo 2 ** 64


def _distinct(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.append(True, out[1:] != out[:-1])]


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles; one hash without words."""
    pieces: list[tuple[bytes, int, bool]] = []  # words with one space between them, their number, whether the text ends here
    held = 0
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for at in range(0, max(1, len(words) - width + 1), MOST_WORDS):
            some = words[at : at + MOST_WORDS + width - 1]
            pieces.append((b" ".join(some), len(some), at + len(some) == len(words)))
            held += len(pieces[-1][0])
        if held >= AT_ONCE or k == len(texts) - 1:
            yield from _sets(pieces, width)
            pieces, held = [], 0


def _sets(pieces: list[tuple[bytes, int, bool]], width: int) -> Iterator[np.ndarray]:
    """A byte at place p adds its number times _P ** p to a running sum, so the hash of any span
    is the difference of two sums, brought to place 0."""
    data = np.frombuffer(b" ".join(x for x, _, _ in pieces) + b" ", np.uint8)
    if len(data) > len(_powers[0]):
        n = 1 << int(len(data) - 1).bit_length()
        _powers[:] = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_P, pow(_P, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(_OF_BYTE[data] * _powers[0][: len(data)]))
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends[:-1] + 1)
    found, at = [], 0
    for _, n, last in pieces:
        n = max(1, n)  # a text without words has an empty place between two spaces
        spans = max(1, n - width + 1)
        a = starts[at : at + spans]
        h = (sums[ends[at + min(width, n) - 1 : at + n]] - sums[a]) * _powers[1][a]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        found.append(h ^ (h >> np.uint64(29)))
        at += n
        if last:
            yield _distinct(np.concatenate(found) if len(found) > 1 else found[0])
            found = []


def fingerprint(found: np.ndarray, at_once: int = 1 << 16) -> int:
    """The SimHash of a set, as a signed long: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), at_once):
        ones += np.unpackbits(found[i : i + at_once].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">u8").astype(np.uint64).view(np.int64)[0])


def node_of(found: np.ndarray) -> int:
    """The name of a set, as a signed long."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The elements of which similar sets share one: `common` (sorted, with counts) come last."""
    n = len(found)
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weight = np.where(common[at] == found, counts[at], 0)
    return found[np.argsort(weight, kind="stable")[: n - -(-LEAST[0] * n // LEAST[1]) + 1]]


def reach(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest size of a set that may be linked to one of this size if the first element that they
    share has this place (from 0) in its prefix: at most size - place elements are shared then."""
    return sum(LEAST) * (size - place) // LEAST[0] - size


def of_use(group: np.ndarray, size: np.ndarray, far: np.ndarray, small: int = 64) -> np.ndarray:
    """Whether a member of a group (sorted) may have a partner there. Two members whose reach is under
    their own size have none in each other, so a member needs one that reaches its own size; in
    larger groups one of a size that fits."""
    if not len(group):
        return np.empty(0, bool)
    inner, starts = far >= size, np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    counts = np.diff(np.append(starts, len(group)))
    some = np.logical_or.reduceat(inner, starts)
    out = np.repeat(some & (counts > 1), counts)
    for k in np.flatnonzero(some & (counts > small)).tolist():
        own = slice(starts[k], starts[k] + counts[k])
        sizes = np.sort(size[own][inner[own]])
        out[own] = inner[own] | (np.searchsorted(sizes, far[own], "right") > np.searchsorted(sizes, -(-LEAST[0] * size[own] // LEAST[1])))
    return out


def parities(found: np.ndarray, classes: int = CLASSES) -> bytes:
    """A bit for each class of elements: as many bits differ at most as elements do."""
    return np.packbits(np.bincount((found % np.uint64(classes)).astype(np.int64), minlength=classes) & 1 == 1).tobytes()


def wide_parities(found: np.ndarray) -> bytes:
    """parities of twice as many classes as there are elements or more, a power of two."""
    return parities(found, max(WIDE, 1 << (2 * len(found) - 1).bit_length()))


def verdict(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """1 if the wide parities of two sets, folded to the width of the less wide, say that the sets
    are linked, 0 if they aren't, -1 if that is for the sets to say."""
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in (a, b))
    differ, most = int(np.bitwise_count(a ^ b).sum()), (LEAST[1] - LEAST[0]) * (size_a + size_b) // sum(LEAST)
    if differ > most:
        return 0
    # were most + 1 elements different, these would be the collisions to expect, and c a number hardly ever reached
    mean = (most + 1) ** 2 / (2 * 8 * width)
    c = math.ceil(mean) + 1
    while c * math.log(c / (math.e * mean)) + mean < 27.6:
        c += 1
    return 1 if differ <= most - 2 * c else -1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return LEAST[1] * shared >= LEAST[0] * (len(both) - shared)


def candidates(group: np.ndarray, size: np.ndarray, node: np.ndarray, bits: np.ndarray, part: np.ndarray | None, large: int = 256, far: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one group whose sizes, reach (far) and parities (bits, a row of words each) allow
    a link: those at distances of 1, 2 and 4 by size, or if `part` is given all those of different parts."""
    far = np.full(len(size), np.iinfo(np.int64).max) if far is None else far
    order = np.lexsort((node, size, group))
    if part is not None:  # groups of one part have no pairs
        starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(group)))
        mixed = np.minimum.reduceat(part[order], starts) != np.maximum.reduceat(part[order], starts) if len(group) else np.empty(0, bool)
        for k in np.flatnonzero(mixed & (sizes > large)).tolist():
            own = order[starts[k] : starts[k] + sizes[k]]
            yield from _apart(size[own], node[own], bits[own], part[own], far[own])
        order = order[np.repeat(mixed & (sizes <= large), sizes)]
        part = part[order]
    group, size, node, bits, far = group[order], size[order], node[order], bits[order], far[order]
    at, step = np.arange(len(group)), 1
    while part is not None or step <= 4:
        at = at[at + step < len(group)]
        at = at[(group[at] == group[at + step]) & (LEAST[1] * size[at] >= LEAST[0] * size[at + step])]
        if not len(at):
            return
        kept = at if part is None else at[part[at] != part[at + step]]
        kept = kept[(size[kept + step] <= far[kept]) & (size[kept] <= far[kept + step])]
        differ = np.bitwise_count(bits[kept] ^ bits[kept + step]).sum(axis=1, dtype=np.int64)
        kept = kept[sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (size[kept] + size[kept + step])]
        yield np.minimum(node[kept], node[kept + step]), np.maximum(node[kept], node[kept + step])
        step = step * 2 if part is None else step + 1


def _apart(size: np.ndarray, node: np.ndarray, bits: np.ndarray, part: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one large group, ordered by size: each member outside its largest part with all of
    other parts, so that what the largest part has is not gone through pair by pair. A member that doesn't
    reach its own size looks at those only that do."""
    parts, counts = np.unique(part, return_counts=True)
    outside, inner = part != parts[counts.argmax()], far >= size
    every, near = np.arange(len(size)), np.flatnonzero(inner)
    least, most = -(-LEAST[0] * size // LEAST[1]), np.minimum(LEAST[1] * size // LEAST[0], far)
    for at_once, own in ((every, np.flatnonzero(outside & inner)), (near, np.flatnonzero(outside & ~inner))):
        lo, hi = np.searchsorted(size[at_once], least[own]), np.searchsorted(size[at_once], most[own], "right")
        some = lo < hi
        for k, i, j in zip(own[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            at = at_once[i:j]
            # of two members that both look, the pair is that of the later one, or of the one that reaches its size
            twice = outside[at] & ((at <= k) if inner[k] else inner[at]) & (inner[at] | ~inner[k])
            at = at[(part[at] != part[k]) & ~twice & (size[k] <= far[at])]
            differ = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
            at = at[sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (size[at] + size[k])]
            if len(at):
                yield np.minimum(node[at], node[k]), np.maximum(node[at], node[k])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, for the sets of all rows of one are held at once."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


_PRINTS = ["kind", "doc_id", "node", "hash", "size", "fp", "bits", "wide"]


def _prints(docs: DataFrame, id_col: str, text_col: str, of_batch: int = 5_000) -> DataFrame:
    """_PRINTS of every row (kind 0), and the shingles (node) that are common within some thousand
    rows with their counts (size; kind 1), so that all texts are read once for both."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            made = [[node_of(x) for x in sets], batch.column(2), [len(x) for x in sets], [fingerprint(x) for x in sets]]
            made = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in made]
            bits, wide = (pa.array(map(f, sets), pa.binary()) for f in (parities, wide_parities))
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), *made, bits, wide], names=_PRINTS)
            if n:
                value, count = np.unique(np.concatenate(sets), return_counts=True)
                top = np.flatnonzero(count > 2)
                top = top[np.argsort(-count[top], kind="stable")[:of_batch]]
                none = lambda kind, k=len(top): pa.nulls(k, kind)
                counted = [pa.array([1] * len(top), pa.int32()), none(batch.schema.field(0).type), pa.array(value[top].view(np.int64)), none(pa.int64()), pa.array(count[top])]
                yield pa.RecordBatch.from_arrays([*counted, none(pa.int64()), none(pa.binary()), none(pa.binary())], names=_PRINTS)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_col, F.xxhash64(text_col).alias("hash"))
    return cut(rows.mapInArrow(named, f"kind int, doc_id {id_type}, node long, hash long, size long, fp long, bits binary, wide binary"))


def _common(prints: DataFrame, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, with their counts; at most `most`."""
    rows = prints.where("kind = 1").groupBy("node").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "node").limit(most).collect()
    value, count = np.array([r["node"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(value)
    return value[order], count[order]


def _possible(keys: DataFrame, name: str, words: int = 1 << 17):
    """A test of longs that lets all keys through and few others, so that few texts are shuffled;
    its bit table has a fixed size."""
    word, bit = F.pmod(F.shiftright(name, 6), F.lit(words)).alias("word"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
    table = np.zeros(words, np.int64)
    for r in keys.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect():
        table[r["word"]] = r["bits"]
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def possible(values: pd.Series) -> pd.Series:
        v = values.to_numpy(np.int64)
        return pd.Series((shared.value[(v >> 6) % words] >> (v & 63)) & 1 == 1)

    return possible


def _beside(pairs: DataFrame, frame: DataFrame) -> DataFrame:
    """pairs (a, b), which are computed, with the other columns of frame (node, ...) for a and for b."""
    rows = pairs.count()
    for x in "ab":
        pairs = few(pairs, rows, 20_000).join(frame.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in frame.columns]), x)
    return pairs.select("a", "b", *[f"{c}_{x}" for x in "ab" for c in frame.columns if c != "node"])


def _similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are linked."""

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["a", "b", "said"])

    judged = cut(_beside(pairs, nodes.select("node", "wide", "size")).mapInArrow(said, "a long, b long, said int").where("said <> 0"))
    judged = few(judged, judged.count())
    linked, unsure = (judged.where(f"said = {k}").select("a", "b") for k in (1, -1))
    return linked if unsure.isEmpty() else linked.unionByName(_by_sets(unsure, nodes, docs, id_col, text_col))


def _by_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are linked, by their sets. nodes: node and the row (id, hash) that has its text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = cut(nodes.select("node", "row_id", "row_hash").join(wanted, "node"))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    held = held.where(_possible(rows, "row_hash")("hash"))
    held = held.join(rows, held["id"].eqNullSafe(rows["row_id"]) & (held["hash"] == rows["row_hash"])).select("node", "text").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1).to_pylist())], pa.binary())], names=["node", "elements"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            fit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
            yield batch.select([0, 1]).filter(pa.array(fit, pa.bool_()))

    return _beside(pairs, cut(held.mapInArrow(sets, "node long, elements binary"))).mapInArrow(checked, "a long, b long")


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that hold the links of the trie join over their fingerprints together."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    of = lambda x: first.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"))
    across = simhash.links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = nodes.join(first, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return across.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _candidate_pairs(members: DataFrame, parted: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of the members (shingle, node, size, far, bits, part)."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, node, size, far, part, bits in whole_groups(batches, 1, width=CLASSES // 8):
            for a, b in candidates(group, size, node, bits.view(np.uint64).reshape(len(node), -1), part if parted else None, far=far):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sorted_ = members.select("shingle", "node", "size", "far", "part", "bits").repartition("shingle").sortWithinPartitions("shingle")
    return cut(sorted_.mapInArrow(paired, "a long, b long").where("a <> b").distinct())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of every row of docs."""
    every = _prints(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(_common(every))  # of bounded size
    prints = every.where("kind = 0")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = {node_of(s): (len(s), prefix(s, *shared.value)) for s in shingle_sets(batch.column(0).to_pylist())}
            if out:
                sizes, prefixes = zip(*out.values())
                lengths = [len(p) for p in prefixes]
                size = np.repeat(np.array(sizes, np.int64), lengths)
                place = np.concatenate([np.arange(n) for n in lengths])
                columns = np.concatenate(prefixes).view(np.int64), np.repeat(np.array(list(out), np.int64), lengths), size, reach(size, place)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "size", "far"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 1):
            shingle, node = columns[:2]
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))
            columns = [c[new] for c in columns]
            useful = of_use(columns[0], columns[2], columns[3])
            columns = [c[useful] for c in columns]
            again = columns[0][1:] == columns[0][:-1]
            many = (np.append(again, False) | np.append(False, again))[: len(columns[0])]
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], names=["shingle", "node", "size", "far"])

    row = F.min(F.struct("doc_id", "hash", "size", "fp", "bits", "wide")).alias("row")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), row)
    nodes = cut(nodes.select("node", "least", F.col("row.doc_id").alias("row_id"), F.col("row.hash").alias("row_hash"), "row.size", "row.fp", "row.bits", "row.wide"))
    prefixes = docs.select(text_col).mapInArrow(first, "shingle long, node long, size long, far long")
    members = cut(prefixes.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(groups, "shingle long, node long, size long, far long"))
    members = members.join(nodes.select("node", "bits"), "node")
    tried = _candidate_pairs(members.withColumn("part", F.col("node")), parted=False)
    tried = cut(tried.unionByName(_trie_pairs(nodes)).distinct())
    tried = few(tried, tried.count())
    linked = cut(_similar_pairs(tried, nodes, docs, id_col, text_col))
    parts = connected_components(linked)
    apart = members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    rest = cut(_candidate_pairs(apart, parted=True).join(tried, ["a", "b"], "left_anti"))
    linked = linked.unionByName(_similar_pairs(rest, nodes, docs, id_col, text_col))
    named_parts = nodes.select("node", "least").join(connected_components(linked), "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named_parts.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(cut(named_parts.join(least, "part").select("node", "component_id")), "node").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of the smallest id of each component only; rows without an id are never
    dropped, for nothing tells them apart. Rows that repeat an id share its fate."""
    found = near_copies(docs, id_col, text_col)
    dropped = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone and doc_id is not null")
    return keep_rows(docs, dropped.select("doc_id"), id_col, "left_anti")
