"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts up to `order` bytes long with counts of
the bytes that follow each. A byte's code length under a language comes from its
longest context that the language's tree holds: -log2 of count / (total + distinct) if
the byte was seen there, else -log2 of the escape probability distinct / (total +
distinct) plus its code length in the next shorter context, down to 8 bits for any
byte (method C, statistics frozen). A text's code length is the exact sum over all
its bytes, and the shortest wins.

The score is the posterior probability under equal priors, 1 / sum over languages of
2 ** -(its bits - the best bits), times how well the text fits the language that won: bits a
byte are compared with the median and the spread that texts of the language have which the
trees were not fitted on, 1 / (1 + (deviations above the median / REACH) ** 4). Text of no
learned language so scores under one half, however far the least bad language is ahead.

Scoring looks every position up in flat tables: the trees' contexts of a few languages
are merged, each context has a row of code lengths for all byte classes and these
languages, with the escapes already added up. Bytes that no tree saw share one class.
Texts of any length are scored whole, in pieces of bounded size.

Fitting uses at most `docs_per_lang` texts a language, those of the least hashes of id and text, and of a
text over `most_bytes` a window of so many bytes at a place that the hash
decides, of rows whose crc32 of the id in decimal, modulo 5, is not 0 and whose language is
not null; a quarter of these texts gives medians and spreads, the rest the trees. So the model
has a bounded size for each language, some 6 to 25 MB laid out, and every language with a text to learn from
is in it, however many there are: a worker keeps the tables of at most `KEPT` languages, and beyond that lays
them out one after the other for each batch of texts. Two jobs do the fitting: the hashes that bound each
language's sample, found as each task's least ones, and the sample.

Rows that repeat an id are drawn by their texts, rows that repeat both count once in the sample. Texts that are null or
have no letter are `und` with score 0; so is everything if there is nothing to learn from. Ties go
to the language first in code point order. Other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import broadcast_if_small

UND = "und"
FOLDS = 5
_LETTER = re.compile(r"[^\W\d_]")


#: Deviations above the median at which a text counts half.
REACH = 20.0
WINDOW = 64

#: Languages whose tables a worker keeps, and languages whose bounds stand in the plan.
KEPT, LITERAL = 64, 1000


@dataclass
class Trees:
    """Byte classes, and the counts of byte after context for each of a few languages."""

    langs: list[str]
    classes: np.ndarray  # of each byte: 1.. for bytes seen, 0 for the others
    order: int
    grams: list[np.ndarray]  # of each order: sorted keys, context classes then byte class, in base `base`
    counts: list[np.ndarray]  # of each order: (key, language)

    @property
    def base(self) -> int:
        return int(self.classes.max()) + 1


@dataclass
class Model:
    """Trees, and of each language the median bits a byte, the deviation of long texts from it, and
    the variance of a byte (columns of `spread`)."""

    langs: list[str]
    trees: list[Trees]
    spread: np.ndarray

    def scorers(self) -> Iterator[Scorer]:
        """The trees laid out, once a worker if there are few."""
        if len(self.langs) <= KEPT:
            yield from self._kept
        else:
            yield from map(Scorer, self.trees)

    @cached_property
    def _kept(self) -> list[Scorer]:
        return [Scorer(t) for t in self.trees]

    def code_lengths(self, texts: list[bytes], at_once: int = 1 << 18) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        return np.concatenate([s.code_lengths(texts, at_once) for s in self.scorers()], axis=1)

    def fits(self, bits: np.ndarray, lengths: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """How well texts of so many bits and bytes fit their languages (places), from 1 down to 0."""
        mean, own, of_byte = self.spread[langs].T
        n = np.maximum(lengths, 1)
        above = np.maximum(bits / n - mean, 0) / np.sqrt(own * own + of_byte / n)
        return 1 / (1 + (above / REACH) ** 4)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        known = [bool(t) and _LETTER.search(t) is not None for t in texts]
        data = [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known)]
        bits = self.code_lengths(data)
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
        score = posterior * self.fits(least, np.array(list(map(len, data)), np.int64), best)
        return [self.langs[b] if k else UND for b, k in zip(best.tolist(), known)], np.where(known, score, 0.0)


def fit(samples: dict[str, list[bytes]], order: int = 3, held: dict[str, list[bytes]] | None = None, together: int | None = None) -> Model:
    """A model of samples, with medians and spreads from `held`, other texts of the same languages;
    a language without such texts fits any text. together: languages whose trees share a table."""
    if not 0 <= order <= 3:
        raise ValueError("order must be 0 to 3")
    langs = sorted(samples)
    together = together or (4 if len(langs) <= 16 else 1)
    model = Model(langs, [_trees({x: samples[x] for x in langs[i : i + together]}, order) for i in range(0, len(langs), together)], np.empty((0, 3)))
    spreads = [_spread(scorer, i, [t for t in (held or {}).get(lang, []) if t]) for scorer in model.scorers() for i, lang in enumerate(scorer.model.langs)]
    model.spread = np.array(spreads).reshape(-1, 3)
    return model


def _spread(own: Scorer, lang: int, texts: list[bytes]) -> tuple[float, float, float]:
    if not texts:
        return 0.0, math.inf, 0.0
    bits = lambda x: own.code_lengths(x)[:, lang]
    lengths = np.array(list(map(len, texts)), np.float64)
    of_text = bits(texts)
    each = of_text / lengths
    mean = float(np.median(each))
    windows = [t[i : i + WINDOW] for t in texts for i in range(0, len(t) - WINDOW + 1, WINDOW)]
    # of nine tenths of the texts, for some are in another language than said; few texts say little
    deviation = lambda x: float(np.quantile(np.abs(x - np.median(x)), 0.9)) / 1.645
    of_byte = WINDOW * deviation(bits(windows) / WINDOW) ** 2 if len(windows) > 1 else 8.0
    return mean, max(deviation(each), 0.1 * mean) + 3 / len(texts), of_byte


def _trees(samples: dict[str, list[bytes]], order: int) -> Trees:
    langs = list(samples)
    texts = {lang: [np.frombuffer(t, np.uint8) for t in samples[lang] if t] for lang in langs}
    seen = np.zeros(256, bool)
    for own in texts.values():
        for t in own:
            seen[t] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
    base = int(classes.max()) + 1
    grams, counts = [], []
    for k in range(order + 1):
        each = []
        for lang in langs:
            keys = []
            for t in texts[lang]:
                c = classes[t]
                if len(c) > k:
                    key = np.zeros(len(c) - k, np.int64)
                    for i in range(k + 1):
                        key = key * base + c[i : len(c) - k + i]
                    keys.append(key)
            each.append(np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64)))
        every = np.unique(np.concatenate([x[0] for x in each]))
        table = np.zeros((len(every), len(langs)), np.int64)
        for i, (keys, n) in enumerate(each):
            table[np.searchsorted(every, keys), i] = n
        grams.append(every)
        counts.append(table)
    return Trees(langs, classes, order, grams, counts)


class Scorer:
    """Trees laid out for lookup."""

    def __init__(self, model: Trees):
        self.model, base, n = model, model.base, len(model.langs)
        self.classes = model.classes.astype(np.int32)
        self.base, self.order = base, model.order
        rows = [np.full((1, base, n), 8.0)]  # below order 0: 8 bits for any byte
        place = np.zeros(1, np.int32)  # of each context of the order before: its row in the table
        first = 1
        self.short: list[dict[int, int]] = []  # of each order under the full one: the rows of its contexts
        for k in range(model.order + 1):
            keys, counts = model.grams[k], model.counts[k]
            contexts, at = np.unique(keys // base, return_inverse=True)
            shorter = place[contexts % base ** max(k - 1, 0)] if k else np.zeros(len(contexts), np.int64)
            table = np.concatenate(rows)[shorter] if len(contexts) else np.empty((0, base, n))
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                table += escape[:, None, :]
                own = -np.log2(counts / (total + kinds)[at])
            cell = table[at, keys % base]
            table[at, keys % base] = np.where(counts > 0, own, cell)
            # contexts not in any tree stand where their longest known suffix stands
            wide = np.tile(place, base) if k else np.zeros(1, np.int32)
            wide[contexts] = first + np.arange(len(contexts))
            if k < model.order:
                self.short.append({x: first + r for r, x in enumerate(contexts.tolist())})
            place, first = wide, first + len(contexts)
            rows.append(table)
        self.place = place
        self.bits = np.concatenate(rows).reshape(-1, n).astype(np.float32)

    def code_lengths(self, texts: list[bytes], at_once: int = 1 << 18) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        out = np.zeros((len(texts), len(self.model.langs)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        i = 0
        while i < len(texts):
            if lengths[i] > at_once:
                for a in range(0, int(lengths[i]), at_once):
                    lead = max(0, a - self.order)
                    out[i] += self._sums(texts[i][lead : a + at_once], np.array([a - lead]), np.array([0]))[0]
                i += 1
                continue
            end, held = i, 0
            while end < len(texts) and held + lengths[end] <= at_once:
                held += int(lengths[end])
                end += 1
            full = np.flatnonzero(lengths[i:end]) + i
            if len(full):
                starts = np.cumsum(lengths[full]) - lengths[full]
                out[full] = self._sums(b"".join(texts[k] for k in full), starts, starts)
            i = end
        return out

    def _sums(self, data: bytes, starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Sums of code lengths from each start to the next; a context doesn't reach before begins."""
        c = self.classes[np.frombuffer(data, np.uint8)]
        context = np.zeros(len(c), np.int32)
        for k in range(self.order, 0, -1):
            context *= self.base
            context[k:] += c[:-k]
        row = self.place[context]
        for start, begin in zip(starts.tolist(), begins.tolist()):  # the first bytes of a text have shorter contexts
            for i in range(begin, min(begin + self.order, len(c))):
                row[i] = self._short(c[begin:i])
        bits = self.bits.take(row.astype(np.int64) * self.base + c, axis=0)
        return np.add.reduceat(bits, starts, axis=0, dtype=np.float64) if len(starts) != 1 else bits[starts[0] :].sum(axis=0, dtype=np.float64)[None]

    def _short(self, before: np.ndarray) -> int:
        """The row of the longest known suffix of a context shorter than the order."""
        digits = before.tolist()
        while (k := len(digits)) >= 0:
            key = 0
            for d in digits:
                key = key * self.base + d
            if (row := self.short[k].get(key)) is not None:
                return row
            if not k:
                return 0
            digits = digits[1:]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _limits(hashes: DataFrame, most: int) -> DataFrame:
    """lang and limit, the `most`-th least of each language's different hashes (lang, h)."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, h = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate((held.get(lang, np.empty(0, np.int64)), h[codes == code])))[:most]
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own)], names=["lang", "h"])

    each = hashes.mapInArrow(least, "lang string, h long")
    ranked = each.withColumn("at", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= most)
    return ranked.groupBy("lang").agg(F.max("h").alias("limit"))


def fit_on(docs: DataFrame, docs_per_lang: int = 400, most_bytes: int = 5_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3) -> Model:
    """A model of the languages of docs, from a bounded sample of its training folds."""
    train = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0))
    train = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    limits = _limits(train.select("lang", "h"), docs_per_lang).collect()  # a row a language
    if not limits:
        return fit({})
    draw = lambda seed: F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30))
    data, size = F.col("text").cast("binary"), F.octet_length("text")
    window = F.substring(data, (draw(12) % F.greatest(size - most_bytes + 1, F.lit(1))).cast("int") + 1, F.lit(most_bytes))
    if len(limits) <= LITERAL:
        drawn = train.where(F.col("h") <= F.create_map(*[F.lit(x) for r in limits for x in r])[F.col("lang")])
    else:
        bounds = docs.sparkSession.createDataFrame([tuple(r) for r in limits], "lang string, limit long")
        drawn = train.join(broadcast_if_small(bounds, len(limits)), "lang").where("h <= limit")
    sample = drawn.groupBy("lang", "h", (draw(13) % 4 == 0).alias("held")).agg(F.min(window).alias("data"))  # rows that repeat are one
    samples: dict[str, list[bytes]] = {}
    held: dict[str, list[bytes]] = {}
    for r in sample.collect():  # docs_per_lang a language
        (held if r["held"] else samples).setdefault(r["lang"], []).append(bytes(r["data"]))
    return fit({x: samples.get(x) or held.pop(x) for x in samples.keys() | held.keys()}, order, held)


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to a column of struct<lang, score>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see fit

    @F.pandas_udf("lang string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            lang, score = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": lang, "score": score})

    return predicted


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    model = model or fit_on(docs, id_col=id_col, text_col=text_col, **how)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predictor(docs, model)(F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that are `und` or whose score is under `least`."""
    predicted = predictor(docs, fit_on(docs, text_col=text_col, **how))(F.col(text_col))
    marked = docs.withColumn("__ff_lang", predicted)
    return marked.where((F.col("__ff_lang.lang") != UND) & (F.col("__ff_lang.score") >= least)).select(*[marked[c] for c in docs.columns])
