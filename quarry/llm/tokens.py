"""Token counts of a unigram tokenizer without building tokens.

A text is cut before every space; pieces of the vocabulary hold a space only
in front, so segments are tokenized independently and equal segments once.
An Aho-Corasick automaton over the pieces' bytes reports the pieces that end
at each byte, longest first, and dynamic programming carries the best score
and its number of pieces.  All new segments of a slice advance together, one
byte at a time, in numpy.

Ties go as in the tokenizers' own forward pass: of equal scores the earliest
start, that is the longest last piece, stays.  A character that is no piece
costs the lowest score less 10; it counts one token a byte with byte
fallback, else one token for a run of such characters.

Null and empty texts have 0 tokens and score 0.  Repeated rows get equal
counts.  Other columns may have the results' names, only kept ones may not;
kept names hold no dots.  An empty table gives an empty table.  A segment of any length is
counted whole; long ones are walked byte by byte.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField

from quarry.llm.batches import per_text
from quarry.llm.words import Lookup, word_hashes

SPACE_MARK = "▁"  # fixed value: how vocabularies write a space
UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers
LONG = 64  # bytes; longer segments are rare and walked one by one
REMEMBERED = 1_000_000  # segments a worker keeps with their counts


def load_sentencepiece(path: str) -> tuple[list[str], list[float], bool]:
    """Pieces, scores and byte fallback of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], fallback


class Automaton:
    """Aho-Corasick over the pieces' bytes, as arrays: an edge table, failure
    links, and for each state the longest piece ending there and the state
    with the next shorter one."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], fallback: bool = True):
        edges: dict[int, int] = {}
        depth, piece_score = [0], [np.nan]
        for piece, value in zip(pieces, scores):
            state = 0
            for byte in piece.replace(SPACE_MARK, " ").encode():
                nxt = edges.get(state << 8 | byte)
                if nxt is None:
                    nxt = edges[state << 8 | byte] = len(depth)
                    depth.append(depth[state] + 1)
                    piece_score.append(np.nan)
                state = nxt
            if state:
                piece_score[state] = value
        n = len(depth)
        fail, shorter = [0] * n, [0] * n
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, state in edges.items():
            children[key >> 8].append((key & 255, state))
        queue = [state for _, state in children[0]]
        for state in queue:
            back = fail[state]
            shorter[state] = back if not np.isnan(piece_score[back]) else shorter[back]
            for byte, child in children[state]:
                at = back
                while at and (at << 8 | byte) not in edges:
                    at = fail[at]
                fail[child] = edges.get(at << 8 | byte, 0)
                queue.append(child)
        self.edges = Lookup(np.fromiter(edges.keys(), np.uint64, len(edges)))
        self.target = np.fromiter(edges.values(), np.int64, len(edges))
        self.fail, self.shorter = np.array(fail), np.array(shorter)
        self.depth, self.score = np.array(depth), np.array(piece_score, np.float64)
        self.ends = ~np.isnan(self.score)
        self.first = np.where(self.ends, np.arange(n), self.shorter)  # longest piece, 0 for none
        self.unknown = (min(scores) if len(scores) else 0.0) - UNKNOWN_PENALTY
        self.fallback = fallback

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        byte = byte.astype(np.uint64)
        out = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            row = self.edges.find(state[left].astype(np.uint64) << np.uint64(8) | byte[left])
            hit = row >= 0
            out[left[hit]] = self.target[row[hit]]
            left = left[~hit & (state[left] > 0)]
            state = state.copy() if len(left) else state
            state[left] = self.fail[state[left]]
        return out

    def count(self, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score and piece count of every row of ``grid`` (bytes of a
        segment, ``size`` of them, padded), longest segments first."""
        rows, width = grid.shape
        best = np.full((rows, width + 1), -np.inf)
        pieces = np.zeros((rows, width + 1), np.int64)
        unk = np.zeros((rows, width + 1), bool)
        best[:, 0] = 0.0
        lead = np.zeros((rows, width + 1), np.int64)  # start of the character that ends here
        start = np.zeros(rows, np.int64)
        state = np.zeros(rows, np.int64)
        for i in range(1, width + 1):
            live = int(np.searchsorted(-size, -i, "right"))  # sizes fall
            byte = grid[:live, i - 1]
            state = self.step(state[:live], byte)
            begin = (byte & 0xC0) != 0x80
            start = np.where(begin, i - 1, start[:live])
            char_ends = np.ones(live, bool)
            if i < width:
                more = (grid[:live, i] & 0xC0) == 0x80
                char_ends = ~(more & (size[:live] > i))
            left = np.flatnonzero(char_ends)
            out = self.first[state[left]]
            single = np.zeros(live, bool)
            at = left[out > 0]
            out = out[out > 0]
            while len(at):
                length = self.depth[out]
                value = best[at, i - length] + self.score[out]
                better = value > best[at, i]
                w, b = at[better], i - length[better]
                best[w, i], pieces[w, i], unk[w, i] = value[better], pieces[w, b] + 1, False
                single[at[length == i - start[at]]] = True
                out = self.shorter[out]
                at, out = at[out > 0], out[out > 0]
            at = left[~single[left]]
            if len(at):
                b = start[at]
                value = best[at, b] + self.unknown
                better = value > best[at, i]
                w, b = at[better], b[better]
                best[w, i] = value[better]
                more = (i - b) if self.fallback else (~unk[w, b]).astype(np.int64)
                pieces[w, i], unk[w, i] = pieces[w, b] + more, True
        take = np.arange(rows)
        return best[take, size], pieces[take, size]

    def count_long(self, segment: bytes) -> tuple[float, int]:
        """The same for one long segment, in a window of the longest piece."""
        if not hasattr(self, "_walk"):
            keys = self.edges.keys.tolist()
            self._walk = (dict(zip(keys, self.target.tolist())), self.fail.tolist(), self.shorter.tolist(),
                          self.depth.tolist(), self.score.tolist(), self.first.tolist())
        edges, fail, shorter, depth, score, first = self._walk
        n, state, start = len(segment), 0, 0
        best, pieces, unk = [0.0] + [-np.inf] * n, [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            byte = segment[i - 1]
            while state and (state << 8 | byte) not in edges:
                state = fail[state]
            state = edges.get(state << 8 | byte, 0)
            if byte & 0xC0 != 0x80:
                start = i - 1
            if i < n and segment[i] & 0xC0 == 0x80:
                continue
            out, single = first[state], False
            while out:
                b = i - depth[out]
                if best[b] + score[out] > best[i]:
                    best[i], pieces[i], unk[i] = best[b] + score[out], pieces[b] + 1, False
                single |= b == start
                out = shorter[out]
            if not single and best[start] + self.unknown > best[i]:
                best[i] = best[start] + self.unknown
                pieces[i] = pieces[start] + ((i - start) if self.fallback else int(not unk[start]))
                unk[i] = True
        return best[n], pieces[n]


class Memory:
    """Counts of segments seen before, by hash, in sorted arrays."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.keys = np.zeros(0, np.uint64)
        self.score, self.count = np.zeros(0), np.zeros(0, np.int64)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Score and count of each segment (given without its space)."""
        if len(start) == 0:
            return np.zeros(0), np.zeros(0, np.int64)
        hashes = word_hashes(buf, start, end, lower=False)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        score, count = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        score[known], count[known] = self.score[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        score[new], count[new] = self._count(buf, start[first[new]], end[first[new]])
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.score, self.count = keys, score, count
        else:
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.score = np.concatenate([self.score, score[new]])[order]
            self.count = np.concatenate([self.count, count[new]])[order]
        return score[back], count[back]

    def _count(self, buf, start, end, rows: int = 8192):
        size = end - start
        score, count = np.zeros(len(size)), np.zeros(len(size), np.int64)
        for i in np.flatnonzero(size > LONG):
            score[i], count[i] = self.automaton.count_long(b" " + buf[start[i]:end[i]].tobytes())
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        for i in range(0, len(order), rows):
            part = order[i:i + rows]
            width = int(size[part[0]]) + 1
            place = start[part][:, None] + np.arange(-1, width - 1)[None, :]
            inside = (np.arange(width)[None, :] <= size[part][:, None])
            grid = np.where(inside, buf[np.clip(place, 0, max(0, len(buf) - 1))] if len(buf) else 0, 0).astype(np.uint8)
            grid[:, 0] = 0x20
            score[part], count[part] = self.automaton.count(grid, size[part] + 1)
        return score, count


_MEMORIES: dict[str, Memory] = {}


def _memory(key: str, data) -> Memory:
    """One automaton and memory per Python worker and vocabulary."""
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Memory(Automaton(*data.value))
    return _MEMORIES[key]


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every segment, without its leading space."""
    size = np.diff(off)
    spaces = np.flatnonzero(buf == 0x20)
    heads = np.flatnonzero(size > 0)
    heads = heads[buf[off[heads]] != 0x20]
    row = np.concatenate([heads, np.searchsorted(off, spaces, "right") - 1])
    start = np.concatenate([off[heads], spaces + 1])
    nxt = np.searchsorted(spaces, start)
    stop = np.append(spaces, len(buf))[nxt]
    return row, start, np.minimum(stop, off[row + 1])


def token_counts(docs: DataFrame, pieces: Sequence[str], scores: Sequence[float], fallback: bool,
                 keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep..., n_tokens long, score double`` for every row."""
    data = docs.sparkSession.sparkContext.broadcast((list(pieces), list(scores), fallback))
    key = uuid.uuid4().hex
    mark = SPACE_MARK.encode()

    def count(buf, off):
        if mark in buf.tobytes():
            texts = [buf[a:b].tobytes().replace(mark, b" ") for a, b in zip(off[:-1], off[1:])]
            buf = np.frombuffer(b"".join(texts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        row, start, end = segments(buf, off)
        score, n = _memory(key, data)(buf, start, end)
        rows = len(off) - 1
        return [np.bincount(row, n, rows).astype(np.int64), np.bincount(row, score, rows).astype(np.float64)]

    return per_text(docs, text_col, keep, [StructField("n_tokens", LongType()),
                                           StructField("score", DoubleType())], count)
