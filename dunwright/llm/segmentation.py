"""SentencePiece segmentations sampled without replacement by Gumbel top-k, and their decoding.

The pieces of a public vocabulary span a lattice over every text.  A piece's probability follows from its
merge rank by Zipf's law (the file's own scores are ranks, not probabilities; nothing is trained), and a
segmentation's from its pieces.  Sums over the lattice from behind give, at every place, the probability of
each next piece, so all segmentations form a tree whose nodes know their total probability.  Perturbed
A-star search walks that tree: a node carries the largest Gumbel-perturbed log probability below it, which
is an exact bound; the best node is expanded to a leaf, the others on its way become new nodes with Gumbel
values truncated at their parent's, and the next best one follows.  The k leaves are k distinct segmentations
in the order of a sample without replacement.  The best value that is left over is the threshold of the
inclusion probabilities.

Random numbers are hashes of row key, place and sample number: reruns and retried tasks agree.  Characters
without a piece are spelled in byte pieces.  A lattice never links two words, so words (told apart by 64-bit hashes) are
solved once and kept in a bounded table of the Python worker, the most used ones longest; what the table holds
changes no result.  Texts are taken whole and sampled for many rows at once.

Null and empty texts give one empty segmentation with probability 1.  Texts with fewer than k segmentations
give all of them, each included for certain.  Repeated rows repeat their samples; null keys are a key.
Decoding stored ids returns the exact text.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import chunks, small_batches
from .hashing import mix, powers
from .registry import query

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 0.5  # power of the piece probabilities; 1 would nearly always give the likeliest segmentation
MOST_EDGES = 8_000_000  # of a worker's table of solved words (16 bytes each); then the less used ones go
_SPACE, _RAW = "▁", "\udc81"  # the mark for a space, and what stands for that character in a text
_U = np.uint64


def _span_hash(points: np.ndarray):
    """Hash of any span of code points, as a function of starts and ends."""
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=_U)
    np.cumsum(mix(points.astype(_U) + _U(1)) * up[:len(points)], out=total[1:])
    return lambda start, end: mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Pieces:
    """A vocabulary file: piece texts, log probabilities and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        ranks = np.ones(model.get_piece_size())
        ordinary = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
                ranks[i] = model.get_piece_size()
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                if _SPACE in piece.lstrip(_SPACE) or "\n" in piece:
                    raise ValueError("a piece links two words")
                ordinary += 1
                ranks[i] = ordinary
                self.ids[piece] = i
                self.bytes.append(piece.replace(_SPACE, " ").encode())
        self.log_p = -SHARPNESS * (np.log(ranks + 1) + math.log(np.sum(1 / (ranks + 1))))
        self.byte_id = np.array(self.byte_id)
        self.widths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.joined = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        names = list(self.ids)
        points = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(n) for n in names], dtype=np.int64)
        ends = np.cumsum(sizes)
        keys = _span_hash(points)(ends - sizes, ends)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()))[order]
        # places of the sorted keys by their first 16 bits, so that a lookup scans a few keys only
        self.key_start = np.searchsorted(self.keys >> _U(48), np.arange((1 << 16) + 1).astype(_U))
        self.lengths = np.unique(sizes)

    def at_places(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of all pieces that start at a place and end within its word."""
        span = _span_hash(points)
        out = []
        for n in self.lengths.tolist():
            at = np.flatnonzero(left >= n)
            if not len(at):
                continue
            key = span(at, at + n)
            slot = self.key_start[(key >> _U(48)).astype(np.int64)]
            end = self.key_start[(key >> _U(48)).astype(np.int64) + 1]
            found = np.full(len(at), -1, dtype=np.int64)
            open_ = np.flatnonzero(slot < end)
            while len(open_):
                hit = self.keys[slot[open_]] == key[open_]
                found[open_[hit]] = self.key_ids[slot[open_[hit]]]
                open_ = open_[~hit]
                slot[open_] += 1
                open_ = open_[slot[open_] < end[open_]]
            hit = np.flatnonzero(found >= 0)
            out.append((at[hit], np.full(len(hit), n, dtype=np.int64), found[hit]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of a segmentation; its first space is the one that encoding added."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def _ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)


class Lattices:
    """Solved words: per place, its next pieces with cumulative conditional probabilities."""

    def __init__(self, pieces: Pieces, most_edges: int = MOST_EDGES):
        self.pieces, self.most_edges = pieces, most_edges
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=_U)  # of the solved words, in order
        self.first = np.zeros(0, dtype=np.int64)  # their first places, characters and uses
        self.sizes = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)
        self.n_places = self.n_edges = 0
        self.edge_start = np.zeros(1 << 16, dtype=np.int64)
        size = 1 << 20
        self.cumulative = np.zeros(size, dtype=np.float32)  # of a place's pieces, likeliest first
        self.log_p = np.zeros(size, dtype=np.float32)
        self.target = np.zeros(size, dtype=np.int32)  # place, or -1 at the end of the word
        self.piece = np.zeros(size, dtype=np.int32)   # id, or -1 - character for a spelling in bytes

    def trim(self) -> None:
        """Once the table is full, keep the words most used since, in at most half of it."""
        if self.n_edges <= self.most_edges:
            return
        edges = self.edge_start[self.first + self.sizes] - self.edge_start[self.first]
        order = np.argsort(-self.uses, kind="stable")
        kept = order[(np.cumsum(edges[order]) <= self.most_edges // 2) & (self.uses[order] > 1)]
        kept.sort()
        hashes, first, sizes, uses = (a[kept] for a in (self.hashes, self.first, self.sizes, self.uses))
        edges = edges[kept]
        old = self.cumulative, self.log_p, self.target, self.piece
        old_start = self.edge_start
        self.clear()
        new_first = np.cumsum(sizes) - sizes
        self._room(int(sizes.sum()), int(edges.sum()))
        at = _ranges(old_start[first], edges)
        span = slice(0, len(at))
        self.cumulative[span], self.log_p[span], target, self.piece[span] = (a[at] for a in old)
        self.target[span] = np.where(target >= 0, target + np.repeat(new_first - first, edges), -1)
        places = _ranges(first, sizes)
        self.edge_start[:len(places)] = old_start[places] + np.repeat(
            np.cumsum(edges) - edges - old_start[first], sizes)
        self.n_places, self.n_edges = len(places), len(at)
        self.edge_start[self.n_places] = self.n_edges
        self.hashes, self.first, self.sizes, self.uses = hashes, new_first, sizes, uses // 2

    def _room(self, places: int, edges: int) -> None:
        while self.n_places + places + 1 > len(self.edge_start):
            self.edge_start = np.concatenate([self.edge_start, np.zeros_like(self.edge_start)])
        while self.n_edges + edges > len(self.cumulative):
            for name in ("cumulative", "log_p", "target", "piece"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))

    def add(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Solve new words together: pieces at all places, then sums from the words' ends backwards.

        ``points`` are their characters, ``sizes`` how many each has; returns their first places.
        """
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(points))  # characters up to the word's end
        place, length, piece = self.pieces.at_places(points, left)
        value = self.pieces.log_p[piece]
        alone = np.ones(len(points), dtype=bool)  # places whose character is no piece
        alone[place[length == 1]] = False
        alone = np.flatnonzero(alone)
        if len(alone):
            characters = [_SPACE if c == _RAW else c for c in map(chr, points[alone].tolist())]
            byte_p = self.pieces.log_p[self.pieces.byte_id]
            place = np.concatenate([place, alone])
            length = np.concatenate([length, np.ones(len(alone), dtype=np.int64)])
            piece = np.concatenate([piece, [-1 - ord(c) if c > "\x7f" else self.pieces.byte_id[ord(c)]
                                            for c in characters]])
            value = np.concatenate([value, [sum(byte_p[b] for b in c.encode()) for c in characters]])
        order = np.argsort((left[place] << 37) | (place << 5) | length)  # nearest to the end first
        place, length, piece, value = place[order], length[order], piece[order], value[order]
        after = np.zeros(len(points) + 1)  # log of the sum over all segmentations from a place on
        distance = left[place]
        levels = np.flatnonzero(np.append(True, distance[1:] != distance[:-1]))
        for a, b in zip(levels, np.append(levels[1:], len(place))):
            nearer = distance[a] > length[a:b]
            value[a:b] += np.where(nearer, after[np.minimum(place[a:b] + length[a:b], len(points) - 1)], 0.0)
            first = np.flatnonzero(np.append(True, place[a + 1:b] != place[a:b - 1]))
            best = np.maximum.reduceat(value[a:b], first)
            own = np.repeat(best, np.diff(np.append(first, b - a)))
            after[place[a:b][first]] = best + np.log(np.add.reduceat(np.exp(value[a:b] - own), first))
        log_p = np.minimum(value - after[place], 0.0)
        unlikely = np.minimum(-log_p * (1 << 20), (1 << 30) - 1).astype(np.int64)
        order = np.argsort((place << 36) | (unlikely << 5) | length)
        place, length, piece, log_p = place[order], length[order], piece[order], log_p[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sizes_here = np.diff(np.append(first, len(place)))
        share = np.exp(log_p)
        for j in range(1, int(sizes_here.max(initial=1))):  # sums that depend on nothing but the place
            at = first[sizes_here > j] + j
            share[at] += share[at - 1]
        share[first + sizes_here - 1] = 1.0
        n, m, base = len(points), len(place), self.n_places
        self._room(n, m)
        span = slice(self.n_edges, self.n_edges + m)
        self.cumulative[span] = share
        self.log_p[span] = log_p
        self.target[span] = np.where(left[place] > length, base + place + length, -1)
        self.piece[span] = piece
        self.edge_start[base:base + n] = self.n_edges + first
        self.n_places, self.n_edges = base + n, self.n_edges + m
        self.edge_start[self.n_places] = self.n_edges
        return base + ends - sizes

    def firsts(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First places of the words in ``points``; new ones are solved."""
        if not len(start):
            return np.zeros(0, dtype=np.int64)
        keys = _span_hash(points)(start, end)
        order = np.argsort(keys)
        sorted_ = keys[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        kind = np.empty(len(keys), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        distinct, counts = sorted_[at], np.diff(np.append(at, len(keys)))
        slot = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = slot < len(self.hashes)
        known[inside] = self.hashes[slot[inside]] == distinct[inside]
        self.uses[slot[known]] += counts[known]
        place = np.empty(len(distinct), dtype=np.int64)
        place[known] = self.first[slot[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            sample = order[at[missing]]
            sizes = end[sample] - start[sample]
            place[missing] = self.add(points[_ranges(start[sample], sizes)], sizes)
            self.hashes, self.first, self.sizes, self.uses = (np.insert(a, slot[missing], b) for a, b in (
                (self.hashes, distinct[missing]), (self.first, place[missing]), (self.sizes, sizes),
                (self.uses, counts[missing])))
        return place[kind]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words that no piece links, with spaces marked and one put before every text that is not empty.

    Code points of all texts, starts and ends of the words in them, and the number of words of each text.
    """
    marked = [_SPACE + (t.replace(_SPACE, _RAW) if _SPACE in t else t).replace(" ", _SPACE) if t else ""
              for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))))
    space, line = points == ord(_SPACE), points == 10
    opens = line.copy()  # a line break is a word; marked spaces begin one, unless after another
    opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    start = np.flatnonzero(opens)
    return points, start, np.append(start[1:], len(points))[:len(start)], np.diff(np.searchsorted(start, bounds))


def _uniform(key: np.ndarray, step: int | np.ndarray, use: int) -> np.ndarray:
    """Numbers from 2**-54 to 1 - 2**-54 that depend on key, step and use only."""
    x = mix(key + np.asarray(step).astype(_U) * _U(0xD6E8FEB86659FD93)
            + _U(use * 0xA0761D6478BD642F & (1 << 64) - 1))
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _walk(lat: Lattices, place: np.ndarray, key: np.ndarray, word: np.ndarray, first: np.ndarray,
          use: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample the rest of every word: (row of the input, step, edge), ordered by row and step."""
    rows, edges = [], []
    row, step, taken = np.arange(len(place)), first.copy(), np.zeros(len(place), dtype=np.int64)
    place_key = key + mix(word.astype(_U) * _U(0x9E3779B97F4A7C15))
    while len(row):
        edge = lat.edge_start[place]
        u = _uniform(place_key[row], step, use)
        beyond = np.flatnonzero(u > lat.cumulative[edge])
        while len(beyond):  # the likeliest piece comes first
            edge[beyond] += 1
            beyond = beyond[u[beyond] > lat.cumulative[edge[beyond]]]
        rows.append(row)
        edges.append(edge)
        taken[row] += 1
        place = lat.target[edge]
        on = place >= 0
        place, row, step = place[on], row[on], step[on] + 1
    start = np.cumsum(taken) - taken
    flat = np.zeros(int(taken.sum()), dtype=np.int64)
    for n, (row, edge) in enumerate(zip(rows, edges)):
        flat[start[row] + n] = edge
    return np.repeat(np.arange(len(taken)), taken), _ranges(first, taken), flat


def _truncated(location: np.ndarray, most, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these locations, below ``most``."""
    return location - np.log(np.exp(np.minimum(location - most, 700.0)) - np.log(u))


class _Path:
    """One segmentation: edges in order, the word and step of each, and its value."""
    __slots__ = ("edges", "words", "steps", "log_p", "value")

    def __init__(self, edges, words, steps, log_p, value):
        self.edges, self.words, self.steps, self.log_p, self.value = edges, words, steps, log_p, value


_NOISE_HIGH = 37.5  # the most that Gumbel noise from the numbers above can add
_BLOCK = 256


def _side_nodes(lat: Lattices, paths: list[_Path], starts: list[int], keys: np.ndarray, use: int,
                k: int) -> list[list[tuple]]:
    """Per path, the k best nodes beside it from a step on: all other pieces at a place are one node.

    Blocks of all paths are taken together.  Log probabilities only fall along a path, so its walk ends where
    not even the most favourable noise could bring a node among the k best.
    """
    found: list[list[tuple]] = [[] for _ in paths]
    lengths = np.array([len(p.edges) for p in paths], dtype=np.int64)
    values = np.array([p.value for p in paths])
    before = np.array([float(lat.log_p[p.edges[:n]].sum(dtype=np.float64)) for p, n in zip(paths, starts)])
    at = np.array(starts, dtype=np.int64)
    open_ = np.flatnonzero(at < lengths)
    while len(open_):
        log_p = np.zeros((len(open_), _BLOCK))
        step = np.zeros((len(open_), _BLOCK), dtype=_U)
        for i, t in enumerate(open_.tolist()):
            path, block = paths[t], slice(at[t], at[t] + _BLOCK)
            edges = path.edges[block]
            log_p[i, :len(edges)] = lat.log_p[edges]
            step[i, :len(edges)] = (path.words[block] << 20) + path.steps[block]
        prefix = before[open_, None] + np.cumsum(log_p, axis=1) - log_p
        before[open_] += log_p.sum(axis=1)
        rest = -np.expm1(log_p)
        beside = rest > 1e-9
        location = prefix + np.log(np.where(beside, rest, 1.0))
        value = np.where(beside, _truncated(location, values[open_, None], _uniform(
            keys[open_, None], step, use)), -np.inf)
        best = np.argpartition(-value, min(k, _BLOCK) - 1, axis=1)[:, :k]
        rows = np.arange(len(open_))[:, None]
        ongoing = []
        for t, b, v, p in zip(open_.tolist(), best.tolist(), value[rows, best].tolist(),
                              prefix[rows, best].tolist()):
            start = int(at[t])
            own = found[t] = heapq.nsmallest(k, found[t] + [
                (-x, start + j, y) for j, x, y in zip(b, v, p) if x > -math.inf])
            certain = -own[-1][0] if len(own) == k else -math.inf  # the kth best value so far
            if start + _BLOCK < lengths[t] and before[t] + _NOISE_HIGH >= certain:
                ongoing.append(t)
        open_ = np.array(ongoing, dtype=np.int64)
        at[open_] += _BLOCK
    return found


def sample_texts(lat: Lattices, keys: list[int], texts: list[str], k: int) -> list[list[tuple]]:
    """Per text, up to k of (edges, log probability, perturbed value) and last the threshold."""
    lat.trim()
    points, start, end, sizes = words_of(texts)
    ends = np.cumsum(sizes)
    flat = lat.firsts(points, start, end)
    key_array = np.array(keys, dtype=_U)
    owner = np.repeat(np.arange(len(texts)), sizes)
    number = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    # the first sample of all texts
    r, s, e = _walk(lat, flat, key_array[owner], number, np.zeros(len(flat), dtype=np.int64), 0)
    cut = np.searchsorted(owner[r], np.arange(len(texts) + 1)).tolist()
    word = number[r]
    results: list[list[_Path]] = []
    for a, b, root in zip(cut, cut[1:], (-np.log(-np.log(_uniform(key_array, 0, 1)))).tolist()):
        results.append([_Path(e[a:b], word[a:b], s[a:b], float(lat.log_p[e[a:b]].sum(dtype=np.float64)), root)])
    firsts = [paths[0] for paths in results]
    heaps = [[(v, at, before, path, ()) for v, at, before in nodes] for path, nodes in zip(
        firsts, _side_nodes(lat, firsts, [0] * len(texts), key_array, 2, k))]
    for n in range(1, k):
        asked = [t for t, heap in enumerate(heaps) if heap]
        if not asked:
            break
        tops = [heapq.heappop(heaps[t]) for t in asked]
        asked_keys = key_array[asked]
        edge = np.array([path.edges[at] for _, at, _, path, _ in tops], dtype=np.int64)
        place = np.searchsorted(lat.edge_start[:lat.n_places + 1], edge, side="right") - 1
        steps = np.array([at for _, at, *_ in tops], dtype=np.int64)
        pick = _uniform(asked_keys, steps, 1000 + n).tolist()
        again = _uniform(asked_keys, steps, 2000 + n)
        chosen_edges = []
        for i, (t, (value, at, before, path, tried)) in enumerate(zip(asked, tops)):
            used = {int(edge[i]), *tried}
            options = [x for x in range(lat.edge_start[place[i]], lat.edge_start[place[i] + 1]) if x not in used]
            shares = np.exp(lat.log_p[options].astype(np.float64))
            chosen = options[min(int(np.searchsorted(np.cumsum(shares), pick[i] * shares.sum())), len(options) - 1)]
            left = float(shares.sum() - math.exp(lat.log_p[chosen]))
            if len(options) > 1 and left > 1e-9:
                next_ = _truncated(np.array([before + math.log(left)]), -value, again[i:i + 1])[0]
                heapq.heappush(heaps[t], (-float(next_), at, before, path, (*tried, chosen)))
            chosen_edges.append(chosen)
        # the rest of the word, from the chosen piece on, and all words after it
        chosen_edges = np.array(chosen_edges, dtype=np.int64)
        inner = lat.target[chosen_edges].astype(np.int64)
        has = (inner >= 0).astype(np.int64)
        after = np.array([path.words[at] for _, at, _, path, _ in tops], dtype=np.int64) + 1
        counts = sizes[asked] - after + has
        owner = np.repeat(np.arange(len(asked)), counts)
        word = _ranges(after - has, counts)
        places = flat[np.repeat((ends - sizes)[asked], counts) + word]
        step = np.zeros(len(word), dtype=np.int64)
        head = np.flatnonzero(has)
        here = (np.cumsum(counts) - counts)[head]
        places[here] = inner[head]
        step[here] = [tops[i][3].steps[tops[i][1]] + 1 for i in head.tolist()]
        r, s, e = _walk(lat, places, asked_keys[owner], word, step, 4 + n)
        cut = np.searchsorted(owner[r], np.arange(len(asked) + 1)).tolist()
        word = word[r]
        paths = []
        for t, (value, at, _, old, _), chosen, a, b in zip(asked, tops, chosen_edges, cut, cut[1:]):
            path = _Path(np.concatenate([old.edges[:at], [chosen], e[a:b]]),
                         np.concatenate([old.words[:at + 1], word[a:b]]),
                         np.concatenate([old.steps[:at + 1], s[a:b]]), 0.0, -value)
            path.log_p = float(lat.log_p[path.edges].sum(dtype=np.float64))
            results[t].append(path)
            paths.append(path)
        for t, path, nodes in zip(asked, paths, _side_nodes(
                lat, paths, (steps + 1).tolist(), asked_keys, 100 + n, k)):
            for v, at, before in nodes:
                heapq.heappush(heaps[t], (v, at, before, path, ()))
    out = []
    for t, paths in enumerate(results):
        threshold = -heaps[t][0][0] if heaps[t] else -math.inf
        out.append([(p.edges, p.log_p, p.value) for p in paths] + [threshold])
    return out


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log probability that a segmentation's perturbed value exceeds the threshold."""
    x = log_p - threshold
    if x > 30:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def row_key(value: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{value}".encode(), digest_size=8).digest(), "big")


def _ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of one path."""
    return _all_ids(lat, [edges])[0]


def _all_ids(lat: Lattices, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all paths, one after the other, and how many each has; characters in bytes are spelled out."""
    sizes = np.fromiter(map(len, paths), dtype=np.int64, count=len(paths))
    ids = lat.piece[np.concatenate(paths)] if paths else np.zeros(0, dtype=np.int32)
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids, sizes
    texts = [chr(-1 - i).encode() for i in ids[spelled].tolist()]
    widths = np.ones(len(ids), dtype=np.int64)
    widths[spelled] = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(widths) - widths
    out = np.repeat(ids, widths)
    out[_ranges(start[spelled], widths[spelled])] = lat.pieces.byte_id[
        np.frombuffer(b"".join(texts), dtype=np.uint8)]
    ends = np.concatenate(([0], np.cumsum(widths)))[np.concatenate(([0], np.cumsum(sizes)))]
    return out, np.diff(ends)


def _decoded(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each run of ids decodes to its text (the first byte is the space that encoding added)."""
    widths = pieces.widths[ids]
    ends = np.concatenate(([0], np.cumsum(widths)))[np.concatenate(([0], np.cumsum(sizes)))]
    found = pieces.joined[_ranges(pieces.starts[ids], widths)]
    wanted = np.frombuffer(b"".join(b" " + t if t else t for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) + (len(t) > 0) for t in texts), dtype=np.int64, count=len(texts))
    if np.array_equal(lengths, np.diff(ends)) and np.array_equal(found, wanted):
        return np.ones(len(texts), dtype=bool)
    data = found.tobytes()
    return np.array([data[a + 1:b] == t for a, b, t in zip(ends.tolist(), ends[1:].tolist(), texts)], dtype=bool)


_held: dict[tuple, Lattices] = {}  # of this Python worker: its next task goes on with the solved words


def _lattices(model: str, most_edges: int) -> Lattices:
    if (model, most_edges) not in _held:
        _held.clear()
        _held[model, most_edges] = Lattices(Pieces(model), most_edges)
    return _held[model, most_edges]


SEGMENTS = ("rank int, n_pieces int, ids binary, log_prob double, perturbed double, "
            "log_inclusion double, decoded boolean")


def segment(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = 1,
            key: str = "doc_id", most_edges: int = MOST_EDGES) -> DataFrame:
    """(key, text) to the key and up to k rows: rank, n_pieces, ids (packed 32-bit little-endian piece
    ids), log_prob, perturbed, log_inclusion, and whether decoding the ids gave the text."""
    small_batches(docs.sparkSession, 200)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattices(model, most_edges)
        for batch in batches:
            column = batch.column(key)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [row_key(v, seed) for v in column.to_pylist()]
            at, rows = [], []
            for lo, hi in chunks(texts, 1 << 19):
                found = sample_texts(lat, keys[lo:hi], texts[lo:hi], k)
                owners = [i for i, (*paths, _) in enumerate(found, lo) for _ in paths]
                ids, sizes = _all_ids(lat, [path[0] for *paths, _ in found for path in paths])
                whole = [t.encode() for t in texts[lo:hi]]
                same = _decoded(lat.pieces, ids, sizes, [whole[i - lo] for i in owners]).tolist()
                packed = ids.astype("<i4").tobytes()
                ends = np.cumsum(sizes).tolist()
                n = 0
                for *paths, threshold in found:
                    for rank, (_, log_p, value) in enumerate(paths, 1):
                        size = int(sizes[n])
                        rows.append((rank, size, packed[4 * (ends[n] - size):4 * ends[n]], log_p, value,
                                     log_inclusion(log_p, threshold), same[n]))
                        n += 1
                at += owners
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [column.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                [key, *[c.split()[0] for c in SEGMENTS.split(", ")]])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {SEGMENTS}")


def with_digests(segments: DataFrame) -> DataFrame:
    """Segments with their ids and the digest of these."""
    return segments.selectExpr("doc_id", "rank", "n_pieces", "ids", "sha2(ids, 256) ids_sha256", "log_prob",
                               "perturbed", "log_inclusion", "decoded")


def decode(segments: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Append the text of packed piece ids, as ``segment`` returns and stores them; null ids give null."""
    small_batches(segments.sparkSession, 200)
    own = segments.drop(text)
    schema = T.StructType([*own.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            found = [None if packed is None else pieces.decode(np.frombuffer(packed, dtype="<i4").tolist()).decode()
                     for packed in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return own.mapInArrow(run, schema)


@query("op4_segmentation")
def op4_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return with_digests(segment(docs, public_tokenizers.path(MODEL)))
