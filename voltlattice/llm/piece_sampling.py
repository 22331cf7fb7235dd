"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text is cut before each run of spaces; a word with its spaces (written as the piece alphabet's meta
space) is one lattice, whose nodes are the places between characters and whose edges are the
vocabulary's pieces, those of several spaces included. Characters without a piece of their own, and a
literal meta space, have an edge of byte pieces, so that every text has a path and decoding is exact.
Forward filtering sums the weights of all paths to each node; from the end backward, an edge is drawn
in proportion to the paths that use it.

The draws are hashes of the row's key, the word's place in the text and the step, so that a row's
segmentation is the same in any batch, partition or run. Other seeds give other segmentations.

The public vocabulary is one of merges, whose scores are ranks. A piece of rank r weighs
``-alpha * log(r + 2)``: a larger ``alpha`` prefers few and frequent pieces.

A word's lattice doesn't depend on the row, so a worker keeps the finished ones, in arrays, and builds
those of a batch's new words together. It starts anew beyond ``WORDS_HELD`` words, so memory follows the
batch and that bound, not the corpus. The shares of a node's edges are summed within the node, so they
are the same numbers in any table.

Cases: null and empty texts have no piece and decode to an empty text. Rows with equal keys and texts
are segmented alike; a null key counts as the text ``null``. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ALPHA = 1.0
META = "▁"
#: Weight of one byte of a character that has no piece.
BYTE_WEIGHT = -20.0
#: Characters whose lattices are built together; a longer text is a batch of its own.
BATCH_CHARS = 4_000_000
#: Words whose lattices a worker keeps (about 170 MB).
WORDS_HELD = 350_000
#: Stands for a literal meta space, which no piece matches.
_LITERAL = 0x110000
_SHIFT = 21
_RUN = re.compile(" +[^ ]*")
_SPREAD, _WORD = 0x9E3779B97F4A7C15, 2**64 - 1


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values at places that are all within the array: without the check, a third of the time."""
    return values.take(places, mode="clip")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary as a trie in sorted arrays, its weights, and the bytes of its pieces."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_piece = np.zeros(256, np.int64)
        rank, states, edges, ends = 0, 1, {}, {}
        weights = np.zeros(model.get_piece_size())
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_piece[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(piece.replace(META, " ").encode())
            if model.is_control(i) or model.is_unknown(i) or META in piece.lstrip(META):
                continue
            weights[i] = -alpha * np.log(rank + 2)
            rank += 1
            at = 0
            for c in piece:
                key = (at << _SHIFT) | ord(c)
                if key not in edges:
                    edges[key] = states
                    states += 1
                at = edges[key]
            ends[at] = i
        self.weights = weights
        # Open addressing at a load of at most a half: a step is a look or two.
        self.bits = (2 * len(edges)).bit_length() + 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.targets = np.full(1 << self.bits, -1, np.int64)
        for key, target in edges.items():
            slot = (key * _SPREAD & _WORD) >> (64 - self.bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.targets[slot] = key, target
        self.piece_at = np.full(states, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.held: Lattice | None = None

    def _step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The trie states after the characters; -1 where there are none."""
        keys = (states << _SHIFT) | chars
        with np.errstate(over="ignore"):
            slot = ((keys.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = _at(self.keys, slot)
        hit = there == keys
        out = np.where(hit, _at(self.targets, slot), -1)
        going = np.flatnonzero(~hit & (there >= 0))
        while len(going):
            moved = (_at(slot, going) + 1) & ((1 << self.bits) - 1)
            slot[going] = moved
            there = _at(self.keys, moved)
            hit = there == _at(keys, going)
            out[going[hit]] = _at(self.targets, moved[hit])
            going = going[~hit & (there >= 0)]
        return out

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)

    def places(self, words: Iterator[str]) -> np.ndarray:
        """The number of each word (without its first space) in ``held``, whose lattices are made up to date."""
        if len(self.number) > WORDS_HELD:
            self.number, self.held = defaultdict(itertools.count().__next__), None
        known = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64)
        if len(self.number) > known:
            made = self.lattice([" " + w for w in itertools.islice(self.number, known, None)])
            self.held = made if self.held is None else self.held.extended(made)
        return found


class Lattice:
    """The lattices of several words, their nodes numbered one word after the other."""

    def __init__(self, pieces: Pieces, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first_char = np.cumsum(sizes) - sizes
        # Spaces are the pieces' meta spaces; a literal one is a character without a piece.
        chars[chars == ord(META)] = _LITERAL
        chars[chars == ord(" ")] = ord(META)
        word = np.repeat(np.arange(len(words)), sizes)
        self.first = first_char + np.arange(len(words))  # one node more than characters in each word
        self.last = self.first + sizes
        node = np.arange(len(chars)) + word
        ends_at = np.repeat(first_char + sizes, sizes)
        start, end, piece = [], [], []
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        covered = np.zeros(len(chars), bool)
        depth = 0
        while len(at):
            state = pieces._step(state, _at(chars, at + depth))
            alive = np.flatnonzero(state >= 0)
            at, state = _at(at, alive), _at(state, alive)
            found = _at(pieces.piece_at, state)
            hit = np.flatnonzero(found >= 0)
            begins = _at(at, hit)
            start.append(_at(node, begins))
            end.append(start[-1] + depth + 1)
            piece.append(_at(found, hit))
            if depth == 0:
                covered[begins] = True
            depth += 1
            more = np.flatnonzero(at + depth < _at(ends_at, at))
            at, state = _at(at, more), _at(state, more)
        bare = np.flatnonzero(~covered)
        start.append(node[bare])
        end.append(node[bare] + 1)
        piece.append(-1 - chars[bare])
        start, end, piece = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
        left = chars[bare]
        width = np.select([left < 0x80, left < 0x800, (left < 0x10000) | (left == _LITERAL)], [1, 2, 3], 4)
        weight = np.concatenate([_at(pieces.weights, piece[:len(piece) - len(bare)]), BYTE_WEIGHT * width])
        by = np.argsort(end, kind="stable")
        start, end, weight = _at(start, by), _at(end, by), _at(weight, by)
        nodes = len(chars) + len(words)
        fans = np.bincount(end, minlength=nodes)
        cut = np.concatenate([[0], np.cumsum(fans)])
        forward = np.full(nodes, -np.inf)
        forward[self.first] = 0.0
        # Nodes at the same place of their words are filled at once.
        place = np.arange(nodes) - np.repeat(self.first, sizes + 1)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(_at(place, order), np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            some = order[a:b]
            counts = _at(fans, some)
            heads = np.cumsum(counts) - counts
            e = np.repeat(_at(cut, some) - heads, counts) + np.arange(counts.sum())
            forward[some] = np.logaddexp.reduceat(_at(forward, _at(start, e)) + _at(weight, e), heads)
        #: For each edge the share of paths to its end that take it or one of the node's earlier edges.
        self.share = np.exp(_at(forward, start) + weight - _at(forward, end))
        rank = np.arange(len(end)) - _at(cut, end)
        later = np.flatnonzero(rank > 0)
        rank = _at(rank, later)
        for r in range(1, int(fans.max(initial=0))):
            now = rank == r
            self.share[later[now]] += _at(self.share, later[now] - 1)
            later, rank = later[~now], rank[~now]
        self.start, self.piece, self.cut = start.astype(np.int32), _at(piece, by).astype(np.int32), cut

    def extended(self, more: Lattice) -> Lattice:
        """This with the lattices of the other after its own, joined array by array: no two copies of all."""
        nodes = len(self.cut) - 1
        self.first, self.last = np.concatenate([self.first, more.first + nodes]), np.concatenate([self.last, more.last + nodes])
        self.cut = np.concatenate([self.cut[:-1], more.cut + self.cut[-1]])
        self.start = np.concatenate([self.start, more.start + np.int32(nodes)])
        self.piece = np.concatenate([self.piece, more.piece])
        self.share = np.concatenate([self.share, more.share])
        return self

    def sample(self, words: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edge pieces (negative: -1 - character) of each word given, in order, and their number per word."""
        at, begin = _at(self.last, words), _at(self.first, words)
        alive = np.flatnonzero(at > begin)
        at, begin, draws = _at(at, alive), _at(begin, alive), _at(draws, alive)
        whose, what, steps = [], [], []
        step = 0
        while len(alive):
            u = (_mix(draws + np.uint64(step) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(float) * 2.0**-53
            edge, most = _at(self.cut, at), _at(self.cut, at + 1) - 1
            # Edges are few: the first whose share exceeds the draw, else the node's last.
            going = np.flatnonzero((_at(self.share, edge) <= u) & (edge < most))
            while len(going):
                next_edge = _at(edge, going) + 1
                edge[going] = next_edge
                going = _at(going, np.flatnonzero((_at(self.share, next_edge) <= _at(u, going)) & (next_edge < _at(most, going))))
            whose.append(alive)
            what.append(_at(self.piece, edge))
            steps.append(np.full(len(alive), step, np.int32))
            at = _at(self.start, edge).astype(np.int64)
            more = np.flatnonzero(at > begin)
            alive, at, begin, draws = _at(alive, more), _at(at, more), _at(begin, more), _at(draws, more)
            step += 1
        counts = np.zeros(len(words), np.int64)
        if not whose:
            return np.zeros(0, np.int64), counts
        whose, what, steps = np.concatenate(whose), np.concatenate(what), np.concatenate(steps)
        counts += np.bincount(whose, minlength=len(words))
        out = np.empty(len(what), np.int64)
        out[_at(np.cumsum(counts) - 1, whose) - steps] = what
        return out, counts


@functools.lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def words_of(text: str | None) -> list[str]:
    """The words of a text that begins with one more space, each without the first of its spaces."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [w[1:] for w in _RUN.findall(" " + text)]
    return text.split(" ")


def encode_batch(model: Pieces, keys: list, texts: list[str | None], seed: int = 0) -> list[bytes]:
    """The sampled piece ids of each text, as little-endian unsigned 32-bit integers."""
    with np.errstate(over="ignore"):
        words = [words_of(t) for t in texts]
        flat = model.places(itertools.chain.from_iterable(words))
        if not len(flat):
            return [b""] * len(texts)
        sizes = np.array([len(ws) for ws in words], np.int64)
        rows = np.array([(zlib.crc32(str(k).encode(), 1) << 32) | zlib.crc32(str(k).encode(), seed) for k in keys], np.uint64)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        draws = _mix(np.repeat(_mix(rows + np.uint64(seed)), sizes) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found, counts = model.held.sample(flat, draws)
        per_word = np.repeat(np.arange(len(flat)), counts)
        bare = np.flatnonzero(found < 0)
        if len(bare):
            spelled = {c: list((META if c == _LITERAL else " " if c == ord(META) else chr(c)).encode()) for c in np.unique(-1 - found[bare]).tolist()}
            repeats = np.ones(len(found), np.int64)
            repeats[bare] = [len(spelled[-1 - c]) for c in found[bare].tolist()]
            first = np.cumsum(repeats) - repeats
            wide = np.repeat(found, repeats)
            for k in bare.tolist():
                code = spelled[-1 - int(found[k])]
                wide[first[k]:first[k] + len(code)] = model.byte_piece[code]
            found, per_word = wide, np.repeat(per_word, repeats)
        text_of_word = np.repeat(np.arange(len(texts)), sizes)
        cuts = np.searchsorted(_at(text_of_word, per_word), np.arange(len(texts) + 1))
        ids = found.astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def decode(model: Pieces, ids: bytes | None) -> str:
    """The text of piece ids; any segmentation of a text gives the text."""
    table = model.bytes_of
    return b"".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])[1:].decode("utf-8", "replace")


def encode_column(path: str, key: str | Column, text: str | Column, seed: int = 0, alpha: float = ALPHA) -> Column:
    """Sampled piece ids (binary, little-endian uint32) of a text column, drawn by the row's key."""
    @F.pandas_udf("binary")
    def encoded(keys: pd.Series, texts: pd.Series) -> pd.Series:
        model, out = pieces(path, alpha), []
        sizes = np.cumsum(texts.str.len().fillna(0)).to_numpy() // BATCH_CHARS
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
            out += encode_batch(model, keys.iloc[part].tolist(), texts.iloc[part].tolist(), seed)
        return pd.Series(out)

    column = F.col(key) if isinstance(key, str) else key
    return encoded(F.coalesce(column.cast("string"), F.lit("null")), text)


def decode_column(path: str, ids: str | Column, alpha: float = ALPHA) -> Column:
    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        model = pieces(path, alpha)
        return pd.Series([decode(model, b) for b in column])

    return decoded(ids)
