"""SentencePiece encoding and decoding with N-best segmentation.

A text, spaces escaped and a dummy prefix added, is a lattice of pieces; a segmentation's score is the sum of its pieces' scores, and the N best are
found by A-star search from the end of the lattice to its start, with the forward
Viterbi scores as heuristic, which is exact, so each popped path is the next best one.

When a model file is loaded, its own normaliser is read and must be this one: no mapping of
characters, a dummy prefix, white space escaped and kept as it is; any other file is
refused. No piece crosses from one word into the next (checked too), so the lattice falls apart into words: Viterbi runs forward and backward over all new words
of a batch at once, which gives each word's best path and how much its second best
costs. A text's N best differ from the best only in the N - 1 words whose second best
costs least; only these are searched, and their lists are merged.

The model files at hand hold merge ranks, not probabilities. A piece's score is
therefore its log probability under Zipf's law at its rank (`scores="zipf"`);
`scores="file"` takes the file's numbers. Characters without a piece, and a literal
U+2581, fall back to their UTF-8 bytes' pieces, so decoding gives back every text.
Ties go to the longer last piece, from the end on.

Null and empty texts have no pieces, score 0 and one segmentation. Texts of any length
are encoded whole; words longer than 64 characters go through the same search one by
one. Rows that repeat an id are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_UNITS = re.compile(r" *[^ \n]+| +|\n")
_P = np.uint64(0x100000001B3)
LONG = 64


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = message[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at : at + size]
        at += size


def check_normalizer(model: bytes) -> None:
    """Raises ValueError unless a serialised model leaves texts as they are but for a dummy prefix and
    escaped spaces. Field numbers and defaults are those of the public format."""
    parts = dict(_fields(model))
    trainer, own = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    if own.get(2, b""):
        raise ValueError("the model file maps characters to others")
    if not own.get(3, 1) or not own.get(5, 1) or own.get(4, 1) or trainer.get(24, 0):
        raise ValueError("the model file treats white space in another way: " + ", ".join(f"{n} {own.get(k, 1)}" for n, k in (("dummy prefix", 3), ("extra white space removed", 4), ("escaped", 5))))


class Lattice:
    """A model file's pieces and the searches over them."""

    def __init__(self, model_file: str, scores: str = "zipf", most: int = 250_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_normalizer(sp.serialized_model_proto())
        n = sp.get_piece_size()
        if n > 1 << 16:
            raise ValueError("more pieces than 16 bits hold")
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte fallback")
        total = sum(1 / (r + 2) for r in range(len(normal)))
        own = (lambda r, i: sp.get_score(i)) if scores == "file" else (lambda r, i: -math.log((r + 2) * total))
        self.score = np.full(n, -np.inf)
        self.ids: dict[str, int] = {}
        for r, i in enumerate(normal):
            piece = sp.id_to_piece(i)
            if SPACE in piece[1:] and set(piece) != {SPACE}:
                raise ValueError("a piece crosses words")
            if "\n" in piece or not piece:
                continue
            self.ids[piece] = i
            self.score[i] = own(r, i)
        self.byte_score = float(self.score[list(self.ids.values())].min()) - 2.0
        for i in self.byte_ids.values():
            self.score[i] = self.byte_score
        self.longest = max(map(len, self.ids))
        self.bytes = [b""] * n
        for piece, i in self.ids.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.starts, self.flat = self.sizes.cumsum() - self.sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        keys = {self._hash(p): self.ids.get(p, -1) for p in prefixes}
        if len(keys) != len(prefixes):
            raise ValueError("two prefixes of pieces have one hash")
        self.keys = np.array(sorted(keys), np.uint64)
        self.values = np.array([keys[k] for k in sorted(keys)], np.int32)
        self.cuts = not any(re.search(r"[^\W\d_][,.]", p) for p in self.ids)  # a word and the mark after it are apart
        self.most, self.young, self.old, self.lists = most, {}, {}, {}
        self.unit_ids, self.old_ids = [], []
        self.facts = self.old_facts = np.empty((0, 3))

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) & (1 << 64) - 1
        return h

    # -- one word ------------------------------------------------------------------

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def arcs(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end: (start, piece or -1 for bytes, score) of the arcs that end there."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - self.longest), j):
                if (p := self.ids.get(unit[i:j])) is not None:
                    out[j].append((i, p, float(self.score[p])))
            if unit[j - 1] not in self.ids:
                out[j].append((j - 1, -1, self.byte_score * len(unit[j - 1].encode("utf-8", "surrogatepass"))))
        return out

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word, best first: score and piece ids. In the word, a
        space is written as U+2581, a literal U+2581 as its stand-in (see unit)."""
        arcs = self.arcs(unit)
        forward = [0.0] + [-math.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            forward[j] = max(forward[i] + s for i, _, s in arcs[j])
        agenda: list = [(-forward[-1], 0, len(unit), 0.0, None)]
        tie, out = 0, []
        while agenda and len(out) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if not at:
                ids: list[int] = []
                while path:
                    (i, j, p), path = path
                    ids += [p] if p >= 0 else self.fallback(_literal(unit[i]))
                out.append((behind, ids))
                continue
            for i, p, s in arcs[at]:
                tie += 1
                heapq.heappush(agenda, (-(forward[i] + s + behind), tie, i, s + behind, ((i, at, p), path)))
        return out

    # -- many words at once ----------------------------------------------------------

    def viterbi(self, units: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of each word: best ids as 16-bit bytes, best score, and what the second best costs."""
        ids: list[bytes] = [b""] * len(units)
        score, cost = np.zeros(len(units)), np.zeros(len(units))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        starts = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(units)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            length = int(sizes[order[a]])
            for at in range(a, b, 20_000):
                own = order[at : min(b, at + 20_000)]
                if length > LONG:
                    for k in own.tolist():
                        two = self.nbest(units[k], 2)
                        ids[k], score[k] = np.array(two[0][1], "<u2").tobytes(), two[0][0]
                        cost[k] = two[0][0] - two[1][0] if len(two) > 1 else math.inf
                    continue
                found, score[own], cost[own] = self._viterbi([units[k] for k in own.tolist()], length)
                for k, x in zip(own.tolist(), found):
                    ids[k] = x
        return ids, score, cost

    def _viterbi(self, units: list[str], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        n = len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64) + np.uint64(1)
        best, last, piece = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        best[0] = 0
        kept = []
        for i in range(length):
            active, h = np.arange(n), np.zeros(n, np.uint64)
            for size in range(1, min(self.longest, length - i) + 1):
                h = h * _P + codes[active, i + size - 1]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                known = self.keys[at] == h
                p = np.where(known, self.values[at], -1)
                if size == 1:
                    raw = p < 0
                    lone, own = active[raw], np.full(int(raw.sum()), -1, np.int32)
                    if len(lone):
                        c = codes[lone, i] - np.uint64(1)
                        # the stand-in for a literal U+2581 has three bytes too
                        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                        self._push(best, last, piece, kept, i, 1, lone, own, width * self.byte_score)
                hit = p >= 0
                if hit.any():
                    self._push(best, last, piece, kept, i, size, active[hit], p[hit], self.score[p[hit]])
                active, h = active[known], h[known]
                if not len(active):
                    break
        back, through = np.full((length + 1, n), -np.inf), np.full(n, -np.inf)
        back[length] = 0
        for i, size, who, _, s in reversed(kept):
            back[i, who] = np.maximum(back[i, who], s + back[i + size, who])
        on = np.zeros((length + 1, n), np.int32)  # length of the best path's arc that ends here
        steps = np.zeros((length + 1, n), np.int32)
        at = np.full(n, length)
        every = np.arange(n)
        while (open_ := at > 0).any():
            who = every[open_]
            size = last[at[who], who]
            on[at[who], who] = size
            steps[at[who], who] = piece[at[who], who] + 2  # 0: not on the path, 1: bytes
            at[who] -= size
        for i, size, who, _, s in kept:
            off = on[i + size, who] != size
            w = who[off]
            through[w] = np.maximum(through[w], best[i, w] + s[off] + back[i + size, w])
        marks = steps.T
        taken = marks != 0
        flat, ends = marks[taken] - 2, taken.sum(axis=1).cumsum() * 2
        data = np.maximum(flat, 0).astype("<u2").tobytes()
        cuts = [0, *ends.tolist()]
        ids = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero((marks == 1).any(axis=1)).tolist():
            own: list[int] = []
            for end in np.flatnonzero(marks[k]).tolist():
                p = int(marks[k, end]) - 2
                own += [p] if p >= 0 else self.fallback(_literal(units[k][end - 1]))
            ids[k] = np.array(own, "<u2").tobytes()
        return ids, best[length], best[length] - through

    @staticmethod
    def _push(best, last, piece, kept, i, size, who, p, s) -> None:
        s = np.broadcast_to(s, who.shape).astype(np.float64)
        cand = best[i, who] + s
        better = cand > best[i + size, who]
        w = who[better]
        best[i + size, w], last[i + size, w], piece[i + size, w] = cand[better], size, p[better]
        kept.append((i, size, who, p, s))

    # -- texts -----------------------------------------------------------------------

    def _remember(self, units: list[str], ids: list[bytes], score: np.ndarray, cost: np.ndarray) -> None:
        self.young.update(zip(units, range(len(self.unit_ids), len(self.unit_ids) + len(units))))
        self.unit_ids += ids
        self.facts = np.concatenate([self.facts, np.stack([score, cost, np.fromiter(map(len, ids), np.float64, len(ids))], axis=1)])

    def _learn(self, units: set[str]) -> None:
        """Puts the best path of each unit into the memo."""
        again = [u for u in units if u in self.old]
        if again:
            at = [self.old[u] for u in again]
            known = self.old_facts[at]
            self._remember(again, [self.old_ids[i] for i in at], known[:, 0], known[:, 1])
            units = units.difference(again)
        joined = [u for u in units if u[-1:] in (",", ".") and len(u) > 1 and u[-2].isalpha()] if self.cuts else []
        words = units.difference(joined)
        words.update(x for u in joined for x in (u[:-1], BARE + u[-1]) if x not in self.young)
        new = list(words)
        self._remember(new, *self.viterbi([_spelled(u) for u in new]))
        if joined:
            left, right = [self.young[u[:-1]] for u in joined], [self.young[BARE + u[-1]] for u in joined]
            a, b = self.facts[left], self.facts[right]
            self._remember(joined, [self.unit_ids[i] + self.unit_ids[j] for i, j in zip(left, right)], a[:, 0] + b[:, 0], np.minimum(a[:, 1], b[:, 1]))

    def encode(self, texts: list[str | None], nbest: int = 1) -> Iterator[list[tuple[float, bytes]]]:
        """Of each text: its nbest segmentations, best first, as score and 16-bit ids."""
        if len(self.young) > self.most:
            self.old, self.old_ids, self.old_facts = self.young, self.unit_ids, self.facts
            self.young, self.unit_ids, self.facts = {}, [], np.empty((0, 3))
        split = [_split(t) for t in texts]
        if missing := set().union(*split) - self.young.keys():
            self._learn(missing)
        place_of, ids_of = self.young.__getitem__, self.unit_ids.__getitem__
        for units in split:
            own = list(map(place_of, units))
            base = b"".join(map(ids_of, own))
            mine = self.facts[own] if own else np.empty((0, 3))
            score = float(mine[:, 0].sum())
            if nbest == 1 or not own:
                yield [(score, base)]
                continue
            costs, ends = mine[:, 1], mine[:, 2].astype(np.int64).cumsum()
            choices: list[tuple[float, tuple]] = [(0.0, ())]
            for place in self._least(costs, min(nbest - 1, len(costs))).tolist():
                if costs[place] == np.inf:
                    continue
                alternatives = self._list(units[place], nbest)
                more = [(c + d, taken + ((place, other),) if other is not None else taken) for c, taken in choices for d, other in alternatives]
                choices = heapq.nsmallest(nbest, more, key=lambda x: x[0])
            out = []
            for cost, taken in choices:
                ids, at = [], 0
                for place, other in sorted(taken):
                    end = int(ends[place])
                    ids += [base[at : end - int(mine[place, 2])], other]
                    at = end
                out.append((score - cost, b"".join([*ids, base[at:]])))
            yield out

    @staticmethod
    def _least(costs: np.ndarray, k: int) -> np.ndarray:
        """Places of the k least costs, the first ones of equal costs."""
        limit = np.partition(costs, k - 1)[k - 1]
        few = np.flatnonzero(costs <= limit)
        return few[np.argsort(costs[few], kind="stable")[:k]]

    def _list(self, unit: str, n: int) -> list[tuple[float, bytes | None]]:
        """Cost and ids of the n best segmentations of a unit; None: the Viterbi path."""
        if (unit, n) not in self.lists:
            if len(self.lists) > self.most:
                self.lists.clear()
            best, found = self.unit_ids[self.young[unit]], [(s, np.array(x, "<u2").tobytes()) for s, x in self.nbest(_spelled(unit), n)]
            rest = [(found[0][0] - s, x) for s, x in found if x != best]
            self.lists[unit, n] = [(0.0, None), *rest[: n - 1]]
        return self.lists[unit, n]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return text[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


# Marks within units; lone surrogates, which no text of valid UTF-8 holds.
_STAND_IN = "\udc01"  # a literal U+2581
BARE = "\udc02"  # before a unit that has no space before it
_MANY = "\udc03"  # before a unit that has several spaces before it, which follow


def _literal(char: str) -> str:
    return SPACE if char == _STAND_IN else char


def _split(text: str | None) -> list[str]:
    """The units of a text: words with the space before them, written without it, or with a
    mark if they have none or several; a line feed is a unit."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, _STAND_IN)
    if "  " not in text and text[0] != " ":
        return text.replace("\n", f" {BARE}\n {BARE}").split(" ")
    out = []
    for u in _UNITS.findall(" " + text):
        word = u.lstrip(" ")
        spaces = len(u) - len(word)
        out.append(word if spaces == 1 else BARE + word if not spaces else _MANY + u)
    return out


def _spelled(unit: str) -> str:
    """A unit as the lattice reads it."""
    if unit[:1] == BARE:
        return unit[1:]
    return unit[1:].replace(" ", SPACE) if unit[:1] == _MANY else SPACE + unit


_lattices: dict[tuple[str, str], Lattice] = {}

FIELDS = "ids array<int>, n_tokens long, score double, nbest_scores array<double>, nbest_tokens array<long>, nbest_crc32 array<long>, round_trip boolean"


def round_trips(lattice: Lattice, text: str | None, arrays: list[np.ndarray], at_once: int = 1 << 20) -> bool:
    """Whether every segmentation decodes to the text: the bytes of all their pieces, put in a row,
    against the text's, as often as there are segmentations."""
    if not text:
        return not any(len(x) for x in arrays)
    want = (" " + text).encode("utf-8", "surrogatepass")
    if len(want) * len(arrays) > at_once:
        return all(lattice.decode(x) == text for x in arrays)
    ids = np.concatenate(arrays)
    sizes = lattice.sizes[ids]
    ends = sizes.cumsum()
    if (ends[np.cumsum([len(x) for x in arrays]) - 1] != len(want) * np.arange(1, len(arrays) + 1)).any():
        return False
    places = np.repeat(lattice.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
    return lattice.flat[places].tobytes() == want * len(arrays)


def encode_documents(docs: DataFrame, model_file: str, nbest: int = 4, scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS of every row of docs: the best segmentation's ids, the nbest scores, token counts
    and checksums (crc32 of the ids as little-endian 32-bit integers), best first, and whether
    every one of them decodes to the text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model_file, scores) not in _lattices:
            _lattices[model_file, scores] = Lattice(model_file, scores)
        lattice = _lattices[model_file, scores]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                texts = rows.column(1).to_pylist()
                flat, counts, best, each, tokens, sums, same = [], [], [], [], [], [], []
                for text, found in zip(texts, lattice.encode(texts, nbest)):
                    arrays = [np.frombuffer(x, "<u2") for _, x in found]
                    flat.append(arrays[0].astype(np.int32))
                    counts.append(len(arrays[0]))
                    best.append(found[0][0])
                    each.append([s for s, _ in found])
                    tokens.append([len(x) for x in arrays])
                    sums.append([zlib.crc32(x.astype("<u4").tobytes()) for x in arrays])
                    same.append(round_trips(lattice, text, arrays))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat))),
                        pa.array(counts, pa.int64()),
                        pa.array(best, pa.float64()),
                        pa.array(each, pa.list_(pa.float64())),
                        pa.array(tokens, pa.list_(pa.int64())),
                        pa.array(sums, pa.list_(pa.int64())),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", *(x.split()[0] for x in FIELDS.split(", "))],
                )

    return docs.select(id_col, text_col).mapInArrow(encoded, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {FIELDS}")
