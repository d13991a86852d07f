"""How the sources of a language differ in the terms they use.

Terms are runs of letters outside ASCII's other characters; only A to Z are lower-cased. A language keeps the terms
of at least `least` of its documents. Each source of a language, and the language itself, gives
each kept term a smoothed share p; sources are compared with one another by the sum of differences over all
kept terms, and each source with its language by the terms that it uses more.

Counting: a task counts the terms of its documents by source and, whenever these counters are too many for
its memory, lays them out as byte radix tries, one a language: leaves in UTF-8 preorder, each by how many bytes it shares with the leaf
before it and the bytes that follow, and under each leaf a counter a source and the number of documents. Tries are
cut at ranges of prefixes, whose bounds come from a bounded sample of terms (`SAMPLED`; it decides nothing but
where ranges begin), and the pieces of a range are merged, a bounded number of counters at a time, so that a task
holds the distinct terms of one range. The leaf of the empty term counts documents by source, so that
sources without any term are there too.

Comparing: kept terms stay in order, in blocks of some `BLOCK` counters of a language. A block and its language's sources
give a matrix of shares, from which come the block's part of each pair's sum and, from a walk
in UTF-8 order, each source's `top` best terms of the block, the first of those with equal value.
Sums and candidates of blocks are then put together. If a language has many sources, a block is
compared with some of them at a time (`CELLS` cells of sums at once). There are as many pairs as the result has rows;
what grows with a language's number of sources is that number squared, as the result does.

All arithmetic is in whole numbers: shares come by long division in steps of 1,000, exact up to
9 * 10^15 terms of a language. Null text, language and source are empty ones. Texts are read whole, of any length.
Rows that repeat count again, ids are not read, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut

LEAST, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000

#: Counters of a block, sums that a task holds at once, counters that a task holds before it lays them out, bytes of text a range, ranges, terms sampled.
BLOCK, CELLS, STAGED, RANGE, RANGES, SAMPLED = 1 << 16, 1 << 20, 1 << 20, 16 << 20, 20_000, 100_000

#: What a byte of a text becomes: itself, its lower case, or a blank between terms.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes b begins with as a does."""
    if b.startswith(a):
        return len(a)
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return len(b)


class Trie:
    """A radix trie over byte strings with counters by source at its leaves, laid out in preorder.

    terms: the leaves' strings in byte order; docs: their numbers of documents; names: sources; leaf,
    source and n: the counters, in order of leaf and source."""

    def __init__(self, terms: list[bytes], docs: np.ndarray, names: list[bytes], leaf: np.ndarray, source: np.ndarray, n: np.ndarray):
        self.terms, self.docs, self.names, self.leaf, self.source, self.n = terms, docs, names, leaf, source, n

    @classmethod
    def counted(cls, docs: Counter, by_source: dict[bytes, Counter]) -> Trie:
        terms, names = sorted(docs), list(by_source)
        place = dict(zip(terms, range(len(terms))))
        leaf = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source.values()]
        n = [np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()]
        source = np.repeat(np.arange(len(names)), [len(x) for x in leaf])
        return cls._summed(terms, np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), names, np.concatenate(leaf), source, np.concatenate(n))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        number: dict[bytes, int] = {}
        of_source: dict[bytes, int] = {}
        places = [np.fromiter((number.setdefault(x, len(number)) for x in t.terms), np.int64, len(t.terms)) for t in tries]
        sources = [np.array([of_source.setdefault(s, len(of_source)) for s in t.names], np.int64) for t in tries]
        terms = sorted(number)
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        docs = np.zeros(len(terms), np.int64)
        for t, at in zip(tries, places):
            docs[rank[at]] += t.docs  # each place is there once a trie
        leaf = np.concatenate([rank[at][t.leaf] for t, at in zip(tries, places)])
        source = np.concatenate([of[t.source] for t, of in zip(tries, sources)])
        return cls._summed(terms, docs, list(of_source), leaf, source, np.concatenate([t.n for t in tries]))

    @classmethod
    def _summed(cls, terms: list[bytes], docs: np.ndarray, names: list[bytes], leaf: np.ndarray, source: np.ndarray, n: np.ndarray) -> Trie:
        order = np.lexsort((source, leaf))
        leaf, source, n = leaf[order], source[order], n[order]
        new = np.append(True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])) if len(leaf) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        return cls(terms, docs, names, leaf[starts], source[starts], np.add.reduceat(n, starts) if len(starts) else n)

    def pack(self, a: int, b: int) -> tuple[list[bytes], bytes]:
        """Leaves a to b as the names of their sources and bytes."""
        terms = self.terms[a:b]
        shared = [0, *map(_shared, terms, terms[1:])]
        rest = [t[k:] for t, k in zip(terms, shared)]
        lo, hi = np.searchsorted(self.leaf, (a, b))
        used, source = np.unique(self.source[lo:hi], return_inverse=True)
        each = np.bincount(self.leaf[lo:hi] - a, minlength=b - a)
        parts = [np.array([len(terms), hi - lo]), shared, [len(r) for r in rest], self.docs[a:b], each, source, self.n[lo:hi]]
        return [self.names[k] for k in used], zlib.compress(b"".join([*(np.asarray(x, "<i8").tobytes() for x in parts), *rest]), 1)

    @classmethod
    def unpack(cls, names: list[bytes], data: bytes) -> Trie:
        data = zlib.decompress(data)
        leaves, counters = np.frombuffer(data, "<i8", 2).tolist()
        sizes = [2, leaves, leaves, leaves, leaves, counters, counters]
        at = np.cumsum([0, *sizes])
        flat = np.frombuffer(data, "<i8", int(at[-1]))
        shared, lengths, docs, each, source, n = (flat[x:y] for x, y in zip(at[1:], at[2:]))
        terms, term, place = [], b"", 8 * int(at[-1])
        for k, size in zip(shared.tolist(), lengths.tolist()):
            term = term[:k] + data[place : place + size]
            place += size
            terms.append(term)
        return cls(terms, docs, names, np.repeat(np.arange(leaves), each), source, n)


class Counts:
    """Counters of a task by language and source."""

    def __init__(self):
        self.by: dict[bytes, dict[bytes, Counter]] = {}
        self.docs: dict[bytes, Counter] = {}

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        terms = text.translate(FOLD).split()
        mine = self.by.setdefault(lang, {}).setdefault(source, Counter())
        mine.update(terms)
        mine[b""] += 1
        whole = self.docs.setdefault(lang, Counter({b"": 0}))
        whole.update(set(terms))

    def __len__(self) -> int:
        return sum(len(c) for by in self.by.values() for c in by.values())

    def tries(self) -> Iterator[tuple[bytes, Trie]]:
        """A trie a language; the counters are gone then."""
        for lang in sorted(self.by):
            yield lang, Trie.counted(self.docs.pop(lang), self.by.pop(lang))


def _pieces(counts: Counts, bounds: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """The tries cut at bounds, each piece with its range's number."""
    for lang, trie in counts.tries():
        first, last = bisect_right(bounds, (lang, b"")), bisect_left(bounds, (lang + b"\0", b""))
        cuts = [0, *(bisect_left(trie.terms, term) for _, term in bounds[first:last]), len(trie.terms)]
        rows = [(first + k, lang, *trie.pack(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


_PIECES = pa.schema([("range", pa.int32()), ("lang", pa.binary()), ("names", pa.list_(pa.binary())), ("leaves", pa.binary())])


def _bounds(texts: DataFrame, ranges: int, n_docs: int) -> list[tuple[bytes, bytes]]:
    """Where ranges of language and term begin, by the terms of least hash of some documents."""
    a_doc = 16
    every = max(1, n_docs * a_doc // SAMPLED)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, t) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) for t in heapq.nsmallest(a_doc, set(text.translate(FOLD).split()), key=zlib.crc32)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["lang", "term"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("lang", "text")
    terms = sorted({(r["lang"], r["term"]) for r in some.mapInArrow(least, "lang binary, term binary").limit(2 * SAMPLED).collect()})
    return [terms[len(terms) * k // ranges] for k in range(1, ranges)] if len(terms) >= ranges else terms


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, staged: int = STAGED, ranges: int | None = None) -> DataFrame:
    """lang, term, docs, sources, counts and block of all terms in at least `least` documents of their language, and of
    the empty term; strings as binary. Blocks are numbered in order of term within their language."""
    empty = lambda c, to: F.coalesce(F.col(c), F.lit("")).cast("binary").alias(to)
    texts = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_docs, n_bytes = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bounds = _bounds(texts, ranges or min(RANGES, max(4 * tasks, (n_bytes or 0) // RANGE)), n_docs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    counts.add(lang, source, text)
                if len(counts) > staged:
                    yield from _pieces(counts, bounds)
        yield from _pieces(counts, bounds)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The merged tries of ranges and languages, whose pieces follow one another, without rare terms."""
        key, held, size = None, [], 0

        def kept() -> Iterator[pa.RecordBatch]:
            trie = Trie.merged(held)
            ends = np.searchsorted(trie.leaf, np.arange(len(trie.terms) + 1))
            rows, before = [], 0
            for k in np.flatnonzero((trie.docs >= least) | (np.arange(len(trie.terms)) == 0)).tolist():
                if trie.docs[k] < least and trie.terms[k]:
                    continue
                own = slice(ends[k], ends[k + 1])
                rows.append((key[1], trie.terms[k], int(trie.docs[k]), [trie.names[s] for s in trie.source[own]], trie.n[own].tolist(), key[0], before))
                before += int(ends[k + 1] - ends[k])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)

        for batch in batches:
            for number, lang, names, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (number, lang):
                    if key:
                        yield from kept()
                    key, held, size = (number, lang), [], 0
                held.append(Trie.unpack(names, leaves))
                size += len(held[-1].n)
                if size > 2 * max(staged, len(held[0].n)):
                    held = [Trie.merged(held)]
                    size = len(held[0].n)
        if key:
            yield from kept()

    pieces = texts.mapInArrow(counted, "range int, lang binary, names array<binary>, leaves binary")
    ranged = pieces.repartition(tasks, "range").sortWithinPartitions("range", "lang")
    schema = "lang binary, term binary, docs long, sources array<binary>, counts array<long>, range int, before long"
    kept = cut(ranged.mapInArrow(merged, schema))
    # counters before each range of a language: a row a range
    sizes = kept.groupBy("lang", "range").agg(F.sum(F.size("counts")).alias("size"))
    below = F.sum("size").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    based = sizes.select("lang", "range", F.coalesce(below, F.lit(0)).alias("base"))
    block = F.floor((F.col("base") + F.col("before")) / BLOCK)
    return cut(kept.join(based, ["lang", "range"]).select("lang", "term", "docs", "sources", "counts", block.alias("block")))


_KEPT = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("range", pa.int32()), ("before", pa.int64())])


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exact, by long division."""
    under = np.asarray(total + SMOOTH * kept, np.int64)
    whole, rest = np.divmod(counts + SMOOTH, under)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + more
    return 1 + whole


def _compared(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """One block against some of its language's sources: parts of the sums of pairs (s before t; item is t) and
    candidates (item is a term). groups: source, total, kept, mine (whether it is one of the some)."""
    groups = groups.sort_values("source", ignore_index=True)
    names, total, kept = groups["source"].to_numpy(), groups["total"].to_numpy(np.int64), int(groups["kept"].iloc[0])
    mine = np.flatnonzero(groups["mine"].to_numpy(bool))
    sums = np.zeros((len(mine), len(names)), np.int64)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    of = {s: k for k, s in enumerate(names)}
    terms = terms.sort_values("term", ignore_index=True)
    step = max(1, CELLS // max(1, len(names)))
    all_terms = terms["term"].to_numpy()
    for at in range(0, len(terms), step):
        some = terms.iloc[at : at + step]
        counts = np.zeros((len(some), len(names)), np.int64)
        for k, (sources, numbers) in enumerate(zip(some["sources"], some["counts"])):
            counts[k, [of[s] for s in sources]] = numbers
        p = shares(counts, total[None, :], kept)
        q = shares(counts.sum(axis=1), int(total.sum()), kept)
        for row, s in enumerate(mine):
            if s + 1 < len(names):
                sums[row, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(axis=0)
            more = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            values, places = best.get(s, (np.empty(0, np.int64), np.empty(0, np.int64)))
            values, places = np.concatenate((values, (p[:, s] - q)[more])), np.concatenate((places, at + more))
            first = np.lexsort((places, -values))[:top]
            best[s] = values[first], places[first]
    a, b = (x.ravel() for x in np.meshgrid(mine, np.arange(len(names)), indexing="ij"))
    after = b > a
    out = [pd.DataFrame({"source": names[a[after]], "part": "pair", "item": names[b[after]], "value": sums.ravel()[after]})]
    out += [pd.DataFrame({"source": names[s], "part": "term", "item": all_terms[places], "value": values}) for s, (values, places) in best.items() if len(values)]
    return pd.concat(out, ignore_index=True).assign(lang=key[0])[["lang", "source", "part", "item", "value"]]


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of all pairs of sources of a
    language, and of each source's `top` terms."""
    counts = term_counts(docs, text_col, lang_col, source_col, least)
    by_source = counts.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", F.col("c.sources").alias("source"), F.when(F.octet_length("term") > 0, F.col("c.counts")).otherwise(0).alias("n"))
    totals = by_source.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.count_if(F.octet_length("term") > 0).alias("kept"))
    of_lang = Window.partitionBy("lang")
    numbered = totals.withColumn("nth", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("all", F.count(F.lit(1)).over(of_lang))
    groups = cut(numbered.join(langs, "lang").withColumn("some", F.ceil(F.col("all") * F.col("all") / CELLS)))  # a row a source and language
    # each block meets the sources of its language, once for each part of them; the block of the empty term is there even if it holds no other
    blocks = counts.select("lang", "block").distinct().join(groups.select("lang", "some").distinct(), "lang")
    blocks = blocks.select("lang", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("some") - 1)).alias("of"))
    key = ["lang", "block", "of"]
    right = blocks.join(groups, "lang").select(*(F.col(k).alias(f"of_{k}") for k in key), "source", "total", "kept", (F.col("nth") % F.col("some") == F.col("of")).alias("mine"))
    left = counts.where(F.octet_length("term") > 0).join(blocks, ["lang", "block"]).select(*key, "term", "sources", "counts")
    schema = "lang binary, source binary, part string, item binary, value long"
    compared = left.groupBy(*key).cogroup(right.groupBy(*(f"of_{k}" for k in key))).applyInPandas(lambda k, a, b: _compared(k, a, b, top), schema)
    compared = cut(compared)
    half = compared.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = half.unionByName(other).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    term = compared.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    text = lambda c: F.col(c).cast("string").alias(c)
    columns = [text("lang"), text("source"), "part", text("item"), "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
