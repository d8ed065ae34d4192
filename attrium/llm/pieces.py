"""SentencePiece encoding and decoding over the piece lattice, with N-best segmentations.

A text is "▁" and the text with spaces as "▁". In the vocabularies meant here no piece goes on past a "▁"
that follows another character, nor holds a line feed, so the lattice falls into units (runs of "▁" with
what follows) whose best paths add up. In a unit, forward Viterbi scores are the exact remaining cost of a
backward search, so A-star reaches segmentations best first. The runner-up of a unit is known from the
Viterbi pass alone, so for the N best of a text the search is run only in the N - 1 units whose runners-up
are closest: whatever changes another unit is no better than N - 1 changes of one of these.

The lattice is scored by what the model's file gives for each piece, and texts are taken as they are. So ids
differ from those of the model's own program in two ways: its normaliser (which may fold characters and
spaces) isn't applied, and where the file is a BPE model, whose scores are ranks of merges, the segmentation
of the best total score is taken instead of the one that the merges lead to.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .store import append_columns

SPACE = "▁"
UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
UNKNOWN = 10.0  # below the lowest score: what a character costs that must be spelt in bytes
RESERVED = -1e8  # pieces scored below are last resorts, and no measure of the others
OWN = "\0" + SPACE  # stands for a "▁" of the text; no unit of UNITS is like it
TOGETHER = 1 << 18  # characters of texts whose units are solved side by side
CACHED, LONGEST = 150_000, 48  # units remembered in a worker (twice: newer and older), and the longest of them

_IDS, _SCORE, _GAP = map(itemgetter, range(3))


@dataclass(frozen=True)
class Vocabulary:
    """ids and scores of the pieces, ids of the 256 bytes, and the bytes that each id stands for."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_ids: list[int]
    spelt: list[bytes]
    reach: dict[str, float | None]  # of every beginning of a piece: its score, None if it is no piece itself
    lowest: float

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, bytes_ids, spelt = {}, {}, [0] * 256, []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                bytes_ids[int(piece[3:5], 16)] = i
                spelt.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                spelt.append(b"")
            else:
                ids[piece], scores[piece] = i, float(m.get_score(i))
                spelt.append(piece.replace(SPACE, " ").encode())
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {i} goes over the end of a unit")
        reach = {p[:k]: scores.get(p[:k]) for p in scores for k in range(1, len(p) + 1)}
        return cls(ids, scores, bytes_ids, spelt, reach, min(s for s in scores.values() if s > RESERVED))


class Trie:
    """The beginnings of pieces as numbered states (0: none), for walks from many characters at once."""

    def __init__(self, v: Vocabulary) -> None:
        number = {p: i for i, p in enumerate(["", *v.reach])}
        self.letters = {c: i for i, c in enumerate(sorted({c for p in v.reach for c in p}), 1)}
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[list(map(ord, self.letters))] = list(self.letters.values())
        steps = np.array([number[p[:-1]] * (len(self.letters) + 1) + self.letters[p[-1]] for p in v.reach])
        order = np.argsort(steps)
        self.steps, self.to = steps[order], order + 1
        self.is_piece = np.array([False, *(s is not None for s in v.reach.values())])
        # state 0 stands for a character spelt in bytes
        self.score = np.array([v.lowest - UNKNOWN, *(s or 0.0 for s in v.reach.values())])
        self.id = np.array([-1, *(v.ids.get(p, -1) for p in v.reach)], np.int32)

    def edges(self, codes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and state of each piece that lies in codes; a character of `inner` that is none is
        an edge of state 0. Characters in no piece end every walk."""
        letter = self.letter[codes]
        at, state, length, found = np.flatnonzero(letter), np.zeros(np.count_nonzero(letter), np.int64), 0, []
        alone = inner.copy()
        while at.size:
            step = state * (len(self.letters) + 1) + letter[at + length]
            k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            on = self.steps[k] == step
            at, state, length = at[on], self.to[k[on]], length + 1
            hit = self.is_piece[state]
            found.append((at[hit], at[hit] + length, state[hit]))
            if length == 1:
                alone[at[hit]] = False
        spelt = np.flatnonzero(alone)
        found.append((spelt, spelt + 1, np.zeros(len(spelt), np.int64)))
        start, end, state = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, end, state


@dataclass
class Lattice:
    vocabulary: Vocabulary
    known: dict[str, tuple] = field(default_factory=dict)
    older: dict[str, tuple] = field(default_factory=dict)
    ways: dict[tuple[str, int], list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.trie = Trie(v)
        self.known[OWN] = array("i", [v.bytes_ids[b] for b in SPACE.encode()]).tobytes(), v.lowest - UNKNOWN, float("inf")

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the edges into it: start, score, ids. A character that is no piece is spelt in bytes."""
        v, n = self.vocabulary, len(unit)
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                if (p := unit[i:j]) not in v.reach:
                    break
                if p in v.scores:
                    into[j].append((i, v.scores[p], (v.ids[p],)))
            if unit[i] not in v.scores:
                into[i + 1].append((i, v.lowest - UNKNOWN, tuple(v.bytes_ids[b] for b in unit[i].encode("utf-8", "replace"))))
        return into

    def viterbi(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """For each unit, ids (32 bits each) and score of the best segmentation, and how far the second best
        is below it. Among equal scores the longest last piece wins.

        All units are solved side by side. They stand in a row with a line feed, which is in no piece, after
        each; node i lies before character i. Nodes that no piece goes across part a unit, and best scores
        count from there. The edges into nodes equally far from the last such node are one step."""
        if not units:
            return []
        trie, codes = self.trie, np.frombuffer(("\n".join(units) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array(list(map(len, units)))
        lasts = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(codes), bool)
        inner[lasts] = False
        start, end, state = trie.edges(codes, inner)

        n = len(codes)
        parting = np.cumsum(np.bincount(start + 1, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] == 0
        since = np.maximum.accumulate(np.where(parting, np.arange(n), 0))
        far, length = end - since[start], end - start
        order = np.argsort((far * n + end) * (length.max() + 1) - length, kind="stable")
        start, end, state, far = start[order], end[order], state[order], far[order]
        score = trie.score[state]

        firsts = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])  # of the edges into a node
        node, of = end[firsts], np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(end)]))
        base, gap, edge = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        turns = np.r_[np.flatnonzero(np.r_[True, far[1:] != far[:-1]]), len(far)].tolist()
        for a, b in zip(turns, turns[1:]):
            g, h = of[a], of[b - 1] + 1
            sums, begins, into = base[start[a:b]] + score[a:b], firsts[g:h] - a, node[g:h]
            top = np.maximum.reduceat(sums, begins)
            best = np.flatnonzero(sums == top[of[a:b] - g])
            owner = of[a:b][best]
            best = best[np.r_[True, owner[1:] != owner[:-1]]]
            sums[best] = float("-inf")
            gap[into], edge[into] = top - np.maximum.reduceat(sums, begins), best + a
            base[into] = np.where(parting[into], 0.0, top)

        on, at = np.zeros(n, bool), np.flatnonzero(parting & np.r_[False, inner[:-1]])
        while at.size:
            on[at] = True
            at = start[edge[at]]
            at = at[~parting[at]]
        path = np.flatnonzero(on)
        bounds = np.searchsorted(path, np.r_[lasts - sizes, n], side="right")
        total, least = np.add.reduceat(score[edge[path]], bounds[:-1]), np.minimum.reduceat(gap[path], bounds[:-1])

        ids = trie.id[state[edge[path]]]
        lone = ids < 0
        if lone.any():
            spelt = [[self.vocabulary.bytes_ids[x] for x in chr(c).encode("utf-8", "replace")] for c in codes[path[lone] - 1].tolist()]
            many = np.ones(len(ids), np.int64)
            many[lone] = list(map(len, spelt))
            ids, lone, bounds = np.repeat(ids, many), np.repeat(lone, many), np.r_[0, np.cumsum(many)][bounds]
            ids[lone] = [x for each in spelt for x in each]
        flat, ends = ids.tobytes(), (4 * bounds).tolist()
        return [(flat[i:j], s, g) for i, j, s, g in zip(ends, ends[1:], total.tolist(), least.tolist(), strict=False)]

    def a_star(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first: backward search with forward Viterbi scores as heuristic. What
        is nearest to the start goes first among equals, and no node is left more than n times: only its n
        best ways to the end can be part of the result. So ties cost no more than other units."""
        into, size = self.edges(unit), len(unit)
        forward = [0.0] + [float("-inf")] * size
        for j in range(1, size + 1):
            forward[j] = max((forward[i] + s for i, s, _ in into[j]), default=float("-inf"))
        heap, order, out, left = [(-forward[size], size, 0, 0.0, None)], 1, [], [0] * (size + 1)
        while heap and len(out) < n:
            _, at, _, done, way = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while way:
                    piece, way = way
                    ids += piece
                out.append((done, tuple(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            for i, s, piece in into[at]:
                heapq.heappush(heap, (-(forward[i] + s + done), i, order, s + done, (piece, way)))
                order += 1
        return out

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if SPACE not in text:
            return UNITS.findall(SPACE + text.replace(" ", SPACE))
        # a "▁" of the text itself is spelt in bytes, so that it isn't read back as a space
        parts = text.split(SPACE)
        out = UNITS.findall(SPACE + parts[0].replace(" ", SPACE))
        for p in parts[1:]:
            out += [OWN, *UNITS.findall(p.replace(" ", SPACE))]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[list[str], list[tuple[bytes, float, float]]]]:
        """For each text its units, and what viterbi() says of each of them."""
        split = list(map(self.units, texts))
        if len(self.known) >= CACHED:
            self.older, self.known = self.known, {OWN: self.known[OWN]}
        new = set().union(*split) - self.known.keys()
        again = {u: f for u in new if (f := self.older.get(u)) is not None}
        self.known |= again
        missing = [u for u in new if u not in again]
        self.known.update(zip(missing, self.viterbi(missing), strict=True))
        out = [(units, list(map(self.known.__getitem__, units))) for units in split]
        for u in missing:
            if len(u) > LONGEST:
                del self.known[u]
        return out

    def n_best(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """Score and ids of the n best segmentations (all, if fewer), best first; among equal scores the
        order is that of the search and the same in every run."""
        ((units, found),) = self.encode([text])
        score, out = sum(map(_SCORE, found)), []
        for loss, changes in self.changes(list(map(_GAP, found)), units, n):
            ids: list[int] = []
            for k, (best, _, _) in enumerate(found):
                ids += changes.get(k) or list(array("i", best))
            out.append((score - loss, ids))
        return out

    def changes(self, gaps: list[float], units: list[str], n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """How much each of the n best loses, and the units in which it differs from the best."""
        found: list[tuple[float, dict]] = [(0.0, {})]
        at = np.argsort(np.array(gaps), kind="stable")[: n - 1].tolist() if len(gaps) < 64 else self._closest(gaps, n - 1)
        for k in at:
            if gaps[k] == float("inf"):
                break
            if (ways := self.ways.get((units[k], n))) is None:
                ways = self.a_star(units[k], n)
                if len(units[k]) <= LONGEST:
                    if len(self.ways) >= CACHED // 10:
                        self.ways.clear()
                    self.ways[units[k], n] = ways
            found = heapq.nsmallest(n, ((loss + ways[0][0] - s, changes | ({k: list(ids)} if w else {})) for loss, changes in found for w, (s, ids) in enumerate(ways)), key=lambda x: x[0])
        return found

    @staticmethod
    def _closest(gaps: list[float], n: int) -> list[int]:
        each = np.array(gaps)
        few = np.flatnonzero(each <= np.partition(each, n - 1)[n - 1])
        return few[np.argsort(each[few], kind="stable")][:n].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        spelt = self.vocabulary.spelt
        out = b"".join([spelt[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_LATTICES: dict[str, Lattice] = {}  # of a Python worker, which serves many tasks


def _lattice(path: str, sent: Broadcast) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(sent.value)
    return _LATTICES[path]


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts with about TOGETHER characters, or one text that is longer."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > TOGETHER:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


CHANGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
FIELDS = pa.schema(
    [("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("score", pa.float64())]
    + [("n_best", pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(CHANGE))]))), ("round_trip", pa.bool_())]
)


class _NBest:
    """The column n_best, built flat: only what each segmentation changes in the best one."""

    def __init__(self) -> None:
        self.scores, self.changes, self.starts, self.ends = [], [0], [], []
        self.rows, self.ids, self.id_ends = [0], [], [0]

    def add(self, score: float, found: list[tuple[bytes, float, float]], ways: list[tuple[float, dict[int, list[int]]]]) -> None:
        at = None
        for loss, changes in ways:
            for k in sorted(changes):
                if at is None:
                    at = [0, *accumulate(len(ids) >> 2 for ids, _, _ in found)]
                self.starts.append(at[k])
                self.ends.append(at[k + 1])
                self.ids += changes[k]
                self.id_ends.append(len(self.ids))
            self.scores.append(score - loss)
            self.changes.append(len(self.starts))
        self.rows.append(len(self.scores))

    def column(self) -> pa.Array:
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        numbers = lambda x: pa.array(x, pa.int32())
        changes = pa.StructArray.from_arrays([numbers(self.starts), numbers(self.ends), lists(self.id_ends, numbers(self.ids))], fields=list(CHANGE))
        return lists(self.rows, pa.StructArray.from_arrays([pa.array(self.scores, pa.float64()), lists(self.changes, changes)], fields=list(FIELDS.field("n_best").type.value_type)))


def encode_pieces(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for its whole text: ids of the best segmentation, n_pieces, score, n_best, and whether
    decoding the ids gives the text back.

    n_best has the n best segmentations (all, if fewer), best first: score, and changes, which put ids in the
    place of those from start to end (not included) of the best; segmentations() writes them out. A null or
    empty text has no pieces and one segmentation, of score 0. Repeated rows and null ids stay as they are. The
    vocabulary (its size is fixed by the model) is read on the driver and sent to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def each(texts: list) -> list:
        lattice = _lattice(model_path, sent)
        flat, ends, n_pieces, best, others, same = [], [0], [], [], _NBest(), []
        for part in groups(texts):
            for text, (units, found) in zip(part, lattice.encode(part), strict=True):
                ids, score = b"".join(map(_IDS, found)), float(sum(map(_SCORE, found)))
                flat.append(ids)
                n_pieces.append(len(ids) // 4)
                ends.append(ends[-1] + n_pieces[-1])
                best.append(score)
                others.add(score, found, lattice.changes(list(map(_GAP, found)), units, n))
                same.append(lattice.decode(np.frombuffer(ids, np.int32).tolist()) == (text or ""))
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(b"".join(flat), np.int32)))
        return [lists, n_pieces, best, others.column(), same]

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return append_columns(docs, ("_text",), each, FIELDS).drop("_text")


def segmentations(encoded: DataFrame) -> DataFrame:
    """doc_id, rank (from 1), score, ids: the n best segmentations written out, one row each."""
    each = encoded.select("doc_id", F.col("ids").alias("_best"), F.posexplode("n_best").alias("_at", "_way"))
    # later changes first, so that the places of the earlier ones hold
    put = lambda ids, c: F.concat(F.slice(ids, F.lit(1), c["start"]), c["ids"], F.slice(ids, c["end"] + 1, F.greatest(F.size(ids) - c["end"], F.lit(0))))
    return each.select("doc_id", (F.col("_at") + 1).alias("rank"), F.col("_way.score").alias("score"), F.aggregate(F.reverse("_way.changes"), F.col("_best"), put).alias("ids"))


def decode_pieces(pieces: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids are no text ('')."""
    sent = pieces.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = pieces.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("_ids"))
    return append_columns(rows, ("_ids",), lambda each: [[_lattice(model_path, sent).decode(x or []) for x in each]], pa.schema([("text", pa.string())])).drop("_ids")
