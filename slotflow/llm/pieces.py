"""Sampled segmentation into the pieces of a sentencepiece vocabulary, and lossless decoding.

A text's segmentations are paths through a lattice of pieces. Forward filtering sums the
weights of all paths to every place; backward sampling draws pieces from the end, each in
proportion to the paths it closes. Draws are a hash of the row key and the place, so a row
gets the same segmentation on every run and every executor.

No piece joins a space to what stands before it, so the lattice falls into words; each
distinct word's lattice is filtered once, and all words of a batch are sampled together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

_SPACE = "▁"
_ROWS = 256  # texts that a task handles at once


@dataclass(frozen=True)
class Sampler:
    """Where the vocabulary is, and how sharply sampling prefers its likely pieces.

    A piece of rank r weighs (1 / (r + 3)) ** alpha: ranks of a vocabulary in order of
    frequency stand for probabilities. A large alpha approaches the best path, 0 makes all
    paths equally likely.
    """

    path: str
    alpha: float = 1.0
    seed: int = 42


class Vocabulary:
    """Pieces by text (spaces as spaces), bytes by value, and weights by id."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.bytes: list[bytes] = []
        size, rank = model.get_piece_size(), 0
        self.logs = np.zeros(size)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
                self.logs[i] = -alpha * math.log(size + 3)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace(_SPACE, " ")
                self.ids[text] = i
                self.bytes.append(text.encode())
                self.logs[i] = -alpha * math.log(rank + 3)
                rank += 1
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary has no piece for some byte: decoding would lose text")
        self.longest = max(map(len, self.ids))
        joined = [p for p in self.ids if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in joined):
            raise ValueError("a piece joins a space to what stands before it")
        inside = {c for p in joined for c in p} - {" "}
        follow = {b for p in joined for a, b in zip(p, p[1:]) if a.isalpha()}  # what some piece joins to a letter
        letters = "".join(map(re.escape, sorted(c for c in inside if c.isalpha() or c in follow)))
        marks = "".join(map(re.escape, sorted(c for c in inside if not c.isalpha() and c not in follow)))
        runs = [f" *[{marks}]+[{letters}]*"] * bool(marks) + [f" *[{letters}]+"] * bool(letters)
        #: Parts between which no piece can reach: marks, then letters, with the spaces before them;
        #: spaces alone; any other character.
        self.parts = re.compile("|".join([*runs, " +", "."]), re.S)


class Lattices:
    """Filtered lattices of the words met so far, as arrays over all their places.

    A place is where pieces end. Its edges, by ascending start, lie together from
    ``first[place]`` on; ``bounds`` has the share of all paths to the place that come by an
    edge or one before it. The first edge whose bound is above a draw is the one drawn.
    """

    MOST_WORDS = 150_000
    TOGETHER = 20_000  # words of one vectorised pass
    LONGEST = 64  # longer words are filtered one by one

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._make_trie()
        self.forget()

    def forget(self) -> None:
        self.ends: dict[str, int] = {}
        self.first, self.before = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        self.bounds, self.piece = np.array([]), np.array([], dtype=np.int32)

    def _make_trie(self) -> None:
        """The pieces' trie as sorted keys (node, letter) with their child nodes."""
        children: dict[tuple[int, str], int] = {}
        ids = [-1]
        for text, i in self.vocabulary.ids.items():
            node = 0
            for letter in text:
                node = children.setdefault((node, letter), len(ids))
                if node == len(ids):
                    ids.append(-1)
            ids[node] = i
        keys = np.array([(node << 21) | ord(letter) for node, letter in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), dtype=np.int64)[order]
        self.ids = np.array(ids, dtype=np.int32)

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = (node << 21) | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def learn(self, words: list[str]) -> None:
        known = self.vocabulary.ids
        quick = [w for w in words if len(w) <= self.LONGEST and all(map(known.__contains__, w))]
        for i in range(0, len(quick), self.TOGETHER):
            self._filter_together(quick[i : i + self.TOGETHER])
        for word in set(words).difference(quick):
            self._filter_one(word)

    def _add(self, words: list[str], ends: np.ndarray, first, bounds, before, piece) -> None:
        base, edges = len(self.first), len(self.bounds)
        self.ends.update(zip(words, (ends + base).tolist()))
        self.first = np.concatenate([self.first, np.asarray(first, dtype=np.int64) + edges])
        self.bounds = np.concatenate([self.bounds, bounds])
        before = np.asarray(before, dtype=np.int64)
        self.before = np.concatenate([self.before, np.where(before < 0, -1, before + base)])
        self.piece = np.concatenate([self.piece, np.asarray(piece, dtype=np.int32)])

    def _filter_together(self, words: list[str]) -> None:
        """Lattices of words whose letters are all in the vocabulary; a place is a letter's end."""
        size = np.array([len(w) for w in words])
        last = np.cumsum(size)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        begin, stop = np.repeat(last - size, size), np.repeat(last, size)
        starts, stops, found = [], [], []
        at, node = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64)
        for depth in range(self.vocabulary.longest):
            inside = at + depth < stop[at]
            at, node = at[inside], node[inside]
            node = self._next(node, letters[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            whole = self.ids[node] >= 0
            starts.append(at[whole])
            stops.append(at[whole] + depth)
            found.append(self.ids[node[whole]])
        start, end, piece = np.concatenate(starts), np.concatenate(stops), np.concatenate(found)
        order = np.lexsort((start, end))
        start, end, piece = start[order], end[order], piece[order]
        first = np.searchsorted(end, np.arange(len(letters)))
        log = self.vocabulary.logs[piece]
        # Logarithms of the paths' weights, letter by letter of all words at once.
        total = np.zeros(len(letters))
        place = end - begin[end]
        turn = np.argsort(place, kind="stable")
        groups = np.searchsorted(place[turn], np.arange(int(size.max()) + 1))
        for i in range(len(groups) - 1):
            edge = turn[groups[i] : groups[i + 1]]
            came = np.where(start[edge] > begin[end[edge]], total[start[edge] - 1], 0.0) + log[edge]
            here = np.flatnonzero(np.diff(end[edge], prepend=-1))
            total[end[edge[here]]] = np.logaddexp.reduceat(came, here)
        inner = start > begin[end]
        share = np.exp(np.where(inner, total[start - 1], 0.0) + log - total[end])
        # Added up within each place, edge by edge: what a word's bounds are does not depend on its batch.
        bounds, nth = share.copy(), np.arange(len(end)) - first[end]
        for i in range(1, int(nth.max()) + 1):
            edge = np.flatnonzero(nth == i)
            bounds[edge] += bounds[edge - 1]
        bounds[np.append(first[1:], len(end)) - 1] = 1.0
        self._add(words, last - 1, first, bounds, np.where(inner, start - 1, -1), piece)

    def _filter_one(self, word: str) -> None:
        """The same for one word of any length and letters: a letter outside the vocabulary is a chain of its bytes."""
        ids, logs, longest = self.vocabulary.ids, self.vocabulary.logs, self.vocabulary.longest
        first: list[int] = []
        bounds: list[float] = []
        before: list[int] = []
        piece: list[int] = []
        total, number = [0.0], [-1]  # by letter: logarithm of the weight of all paths, and place
        for j in range(1, len(word) + 1):
            edges = [(total[i] + logs[found], number[i], found) for i in range(max(0, j - longest), j) if (found := ids.get(word[i:j])) is not None]
            if edges:
                whole = float(np.logaddexp.reduce([e[0] for e in edges]))
                first.append(len(bounds))
                share = 0.0
                for log, at, found in edges:
                    share += math.exp(log - whole)
                    bounds.append(share)
                    before.append(at)
                    piece.append(found)
                bounds[-1] = 1.0
            else:
                whole, at = total[-1], number[-1]
                for value in word[j - 1].encode("utf-8", "surrogatepass"):
                    found = self.vocabulary.byte_ids[value]
                    whole += logs[found]
                    first.append(len(bounds))
                    bounds.append(1.0)
                    before.append(at)
                    piece.append(found)
                    at = len(first) - 1
            total.append(whole)
            number.append(len(first) - 1)
        self._add([word], np.array([len(first) - 1]), first, bounds, before, piece)

    def sample(self, words: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words in order, and how many each word has; one seed for each word."""
        if len(self.ends) > self.MOST_WORDS:
            self.forget()
        new = set(words)
        new.difference_update(self.ends)
        if new:
            self.learn(list(new))
        node = np.fromiter(map(self.ends.__getitem__, words), dtype=np.int64, count=len(words))
        count = np.zeros(len(words), dtype=np.int64)
        live, steps = np.arange(len(words)), []
        while len(live):
            draw, edge = uniform(seeds[live], len(steps)), self.first[node]
            more = np.flatnonzero(self.bounds[edge] <= draw)
            while len(more):
                edge[more] += 1
                more = more[self.bounds[edge[more]] <= draw[more]]
            steps.append((live, self.piece[edge]))
            count[live] += 1
            node = self.before[edge]
            going = node >= 0
            live, node = live[going], node[going]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for step, (at, pieces) in enumerate(steps):
            out[ends[at] - 1 - step] = pieces
        return out, count


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Draws in [0, 1) that depend on seed and step only."""
    bits = mixed(seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)
    return bits.astype(np.float64) / 2**53


def encode_texts(texts: list[str | None], keys: list[int], lattices: Lattices, seed: int) -> list[np.ndarray | None]:
    """Sampled piece ids of each text. A space is put before a text, as the vocabulary's words expect."""
    words: list[str] = []
    sizes = []
    for text in texts:
        own = lattices.vocabulary.parts.findall(" " + text) if text else []
        words += own
        sizes.append(len(own))
    sizes_ = np.array(sizes, dtype=np.int64)
    starts = np.cumsum(sizes_) - sizes_
    row = mixed(np.array([k & (2**64 - 1) for k in keys], dtype=np.uint64) + mixed(np.full(len(keys), seed, dtype=np.uint64)))
    place = (np.arange(len(words)) - np.repeat(starts, sizes_)).astype(np.uint64)
    pieces, count = lattices.sample(words, mixed(np.repeat(row, sizes_) + place * np.uint64(0xD1342543DE82EF95)))
    ends = np.concatenate([[0], np.cumsum(count)])
    return [None if t is None else pieces[ends[a] : ends[a + n]] for t, a, n in zip(texts, starts.tolist(), sizes)]


def encode(text: Column, key: Column, how: Sampler) -> Column:
    """Array of piece ids, sampled by the row's key.

    NULL text: NULL. Empty text: no pieces. Rows with equal key and text get equal pieces;
    a NULL key counts as 0. Characters outside the vocabulary become their bytes, also the
    vocabulary's own mark for a space, so that decoding gives back every text.
    """

    @F.arrow_udf("array<int>")
    def sample_pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lattices = Lattices(Vocabulary(how.path, how.alpha))
        for texts, keys in batches:
            if not len(texts):
                yield pa.array([], pa.list_(pa.int32()))
            for at in range(0, len(texts), _ROWS):  # small pieces of a batch bound the memory
                out = encode_texts(texts.slice(at, _ROWS).to_pylist(), keys.slice(at, _ROWS).to_pylist(), lattices, how.seed)
                flat = np.concatenate([o for o in out if o is not None] or [np.array([], dtype=np.int32)])
                ends = np.concatenate([[0], np.cumsum([0 if o is None else len(o) for o in out])])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([o is None for o in out], pa.bool_()))

    return sample_pieces(text, F.coalesce(key.cast("long"), F.lit(0)))


def decode(ids: Column, how: Sampler) -> Column:
    """The text of piece ids, without the space put before it; NULL for NULL, empty for none."""

    @F.arrow_udf("string")
    def join_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = Vocabulary(how.path).bytes
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.string())
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                flat, ends = part.flatten().to_numpy().tolist(), part.offsets.to_numpy()
                ends, there = ends - ends[0], part.is_valid().to_pylist()
                yield pa.array([decode_ids(flat[a:b], table) if ok else None for a, b, ok in zip(ends, ends[1:], there)], pa.string())

    return join_pieces(ids)


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")[1:]
