"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary becomes a deterministic transducer over bytes.  The
tokens of a prefix are fixed by its last token and the prefix before that token,
so a state holds, for every earlier position from which some token may still be
running, the place in the token trie, the last token of the prefix that ends
there, and that prefix's token count relative to the present one.  A transition
carries the change of the token count.  States and transitions are made when
first met and kept as arrays; all pieces of a slice step through them together.

Pieces (words with their leading space, numbers, symbols, white space) come from
a rule with a bounded window over character classes, so the transducer is back
in its first state at every piece's start.  A long piece is cut into chunks.  A
chunk's state map takes entry states to exit states and token counts; it is made for
the first state and for every exit of the map before it, all chunks side by side,
until the maps are closed under each other: two or three rounds where the transducer
forgets its entry within a chunk, as many as chunks at worst.  The maps then compose
through a parallel prefix scan, each step doubling the chunks that an entry of a map
spans.

MAX_STATES bounds the memory of a worker: beyond it the transducer starts afresh with
the next slice, which alters no count.

Defined cases: a null text is empty and has no tokens; repeated rows each get
their own count; an empty table gives no rows; a special token's string inside a
text is that one token, and the text on either side stands for itself; other columns
pass through, and the counts take a free name.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, prepare
from .kernels import text_buffers

CHUNK = 64
MAX_STATES = 200_000
#: Subtrees of the trie with more tokens than this aren't searched when states are made alike.
SMALL = 120
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SLICE = 1 << 19


@functools.cache
def _character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    # Letters and numbers of the library's Unicode tables that Python's older ones lack.
    letters = (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    )
    numbers = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
    for ranges, kind in ((letters, LETTER), (numbers, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    # The code points with the property White_Space.
    for first, last in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[first : last + 1] = SPACE
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """The compiled tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        skip = {t["content"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if t not in skip}
        by_bytes = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.byte_token = [by_bytes[bytes([b])] for b in range(256)]
        self.children: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        for token, text in self.bytes_of.items():
            node = 0
            for b in text:
                self.inner[node] = True
                at = self.children.get(node << 8 | b)
                if at is None:
                    at = self.children[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = at
            self.token_at[node] = token
        self.parts = {made: (left, right, rank) for (left, right), (rank, made) in self.merges.items()}
        self.spines, self.whole, self.lives, self.first_like = ({}, {}), {}, {}, {}
        up = {at: key >> 8 for key, at in self.children.items()}
        self.below: list[list[int] | None] = [[] for _ in self.token_at]  # tokens further down, None beyond SMALL
        for node in range(len(up), 0, -1):  # children have larger numbers than their parents
            above, own = self.below[up[node]], self.below[node]
            if above is not None:
                more = None if own is None else own + [self.token_at[node]] * (self.token_at[node] >= 0)
                self.below[up[node]] = None if more is None or len(above) + len(more) > SMALL else above + more
        self._clear()

    def _clear(self) -> None:
        self.number = {((0, -1, 0),): 0}
        self.states = [((0, -1, 0),)]
        self.next = np.full(256 * 4096, -1, np.int32)
        self.emit = np.zeros(256 * 4096, np.int8)

    def merge(self, text: bytes) -> list[int]:
        """Tokens of a short string by its merges, lowest rank first; for compiling only."""
        tokens = [self.byte_token[b] for b in text]
        while len(tokens) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [self.merges[tokens[i], tokens[i + 1]][1]]
        return tokens

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of ``token`` while it is merged, from the byte up, each with the rank of the merge that ends it."""
        got = self.spines[side].get(token)
        if got is None:
            out, end = [], float("inf")
            while True:
                out.append((token, end))
                parts = self.parts.get(token)
                if parts is None:
                    break
                end, token = parts[2], parts[side]
            got = self.spines[side][out[0][0]] = out[::-1]
        return got

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can come next after ``last`` (-1: can come first): no merge across their border comes before those inside."""
        if last < 0:
            got = self.whole.get(token)
            if got is None:
                got = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
            return got
        left, right = self._spine(last, 1), self._spine(token, 0)
        i = j = 0
        while True:
            (x, end_x), (y, end_y) = left[i], right[j]
            found = self.merges.get((x, y))
            if found is not None and found[0] < end_x and found[0] <= end_y:  # at equal ranks the left one is first
                return False
            if end_x == end_y == float("inf"):
                return self.follows(-1, token)
            if end_x <= end_y:
                i += 1
            if end_y <= end_x:
                j += 1

    def alike(self, node: int, last: int) -> int:
        """A token that allows the same tokens further down from ``node`` as ``last`` does; -2 if that is none of them."""
        below = self.below[node]
        if below is None:
            return last
        got = self.lives.get((node, last))
        if got is None:
            fits = tuple(t for t in below if self.follows(last, t))
            got = self.lives[node, last] = self.first_like.setdefault((node, fits), last) if fits else -2
        return got

    def _make(self, state: int, byte: int) -> None:
        entries, found, running = self.states[state], None, []
        for node, last, count in entries:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token_at[child]
            if found is None and token >= 0 and self.follows(last, token):
                found = (token, count + 1)
            if self.inner[child] and (like := self.alike(child, last)) != -2:
                running.append((child, like, count))
        token, change = found
        key = (*((n, t, c - change) for n, t, c in running), (0, token, 0))
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) * 256 > len(self.next):
                self.next = np.append(self.next, np.full(len(self.next), -1, np.int32))
                self.emit = np.append(self.emit, np.zeros(len(self.emit), np.int8))
        self.next[state << 8 | byte] = at
        self.emit[state << 8 | byte] = change

    def run(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, token counts) of byte ranges, each from its entry state."""
        order = np.argsort(-lengths, kind="stable")
        at, state, total = starts[order], entry[order].astype(np.int64), np.zeros(len(starts), np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        for j, n in enumerate(active.tolist()):
            step = (state[:n] << 8) | body[at[:n] + j]
            to = self.next[step]
            if (to < 0).any():
                for x in np.unique(step[to < 0]).tolist():
                    self._make(x >> 8, x & 255)
                to = self.next[step]
            total[:n] += self.emit[step]
            state[:n] = to
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def count_pieces(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        if len(self.states) > MAX_STATES:
            self._clear()
        lengths = ends - starts
        long = lengths > CHUNK
        out = np.zeros(len(starts), np.int64)
        short = ~long
        out[short] = self.run(body, starts[short], lengths[short], np.zeros(int(short.sum()), np.int64))[1]
        if long.any():
            width = np.maximum(CHUNK, 2 * np.sqrt(lengths[long]).astype(np.int64))
            chunks = -(-lengths[long] // width)
            piece = np.repeat(np.arange(len(chunks)), chunks)
            first = np.cumsum(chunks) - chunks
            at = starts[long][piece] + (np.arange(len(piece)) - first[piece]) * width[piece]
            size = np.minimum(width[piece], ends[long][piece] - at)
            last = np.zeros(len(piece), bool)
            last[first + chunks - 1] = True
            out[long] = compose(*self.state_maps(body, at, size, last), last)[: len(piece)][first]
        return out

    def state_maps(self, body: np.ndarray, at: np.ndarray, size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The chunks' maps as entries (chunk, entry state, exit state, tokens), first each chunk's from the first state; last: chunks that end a piece.

        Closed: an exit of a chunk is an entry of the next one's map.
        """
        chunk, entry = np.arange(len(at)), np.zeros(len(at), np.int64)
        made = []
        known = np.empty(0, np.int64)
        while len(chunk):
            leave, total = self.run(body, at[chunk], size[chunk], entry)
            made.append((chunk, entry, leave, total))
            known = np.union1d(known, entry << 32 | chunk)
            go = ~last[chunk]
            due = np.setdiff1d(leave[go] << 32 | chunk[go] + 1, known)
            chunk, entry = due & 0xFFFFFFFF, due >> 32
        return tuple(np.concatenate(x) for x in zip(*made))


def compose(chunk: np.ndarray, entry: np.ndarray, leave: np.ndarray, total: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each entry of the maps the tokens from its chunk to the piece's end, by composing maps over twice as many chunks at each step."""
    order = np.argsort(entry << 32 | chunk)
    keys = (entry << 32 | chunk)[order]
    there = np.searchsorted(keys, leave << 32 | chunk + 1)
    after = np.where(last[chunk], -1, order[np.minimum(there, len(order) - 1)])
    total = total.copy()
    while (go := after >= 0).any():
        total = total + np.where(go, total[after], 0)
        after = np.where(go, after[after], -1)
    return total


def pieces(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of all texts of a slice; no piece crosses an offset."""
    n_bytes = int(offsets[-1])
    if not n_bytes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    byte = body[lead].astype(np.int64)
    if len(lead) == n_bytes:
        code = byte
    else:
        padded = np.append(body, np.zeros(4, np.uint8)).astype(np.int64)
        one, two, three = (padded[lead + k] & 0x3F for k in (1, 2, 3))
        code = np.where(byte < 0x80, byte, np.where(byte < 0xE0, (byte & 0x1F) << 6 | one, np.where(byte < 0xF0, (byte & 0x0F) << 12 | one << 6 | two, (byte & 0x07) << 18 | one << 12 | two << 6 | three)))
    kind = _character_classes()[np.minimum(code, sys.maxunicode)]
    n = len(lead)
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(lead, offsets)] = True
    first[n] = True
    before = np.append(np.uint8(255), kind[:-1])
    blank_before = np.append(False, code[:-1] == 0x20)
    before[first[:n]] = 255
    blank_before[first[:n]] = False
    last_of_text = first[1:]
    after = np.append(kind[1:], np.uint8(255))
    start = first[:n].copy()
    space = kind == SPACE
    start |= ~space & (before != kind) & ~blank_before
    start |= space & ((before != SPACE) | (~last_of_text & (after != SPACE)))
    # The endings that are pieces of their own after an apostrophe that starts a piece.
    mark = np.flatnonzero((code == 0x27) & start)
    if len(mark):
        c = np.append(code, [0, 0, 0])
        room = lambda k: (mark + k < n) & ~np.logical_or.reduce([first[np.minimum(mark + i, n)] for i in range(1, k + 1)])
        one = room(1) & np.isin(c[mark + 1], [ord(x) for x in "stmd"])
        pair = c[mark + 1] << 8 | c[np.minimum(mark + 2, n)]
        two = room(2) & np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        for good, size in ((one, 2), (two & ~one, 3)):
            m = mark[good]
            for k in range(1, size):
                start[m + k] = False
            stop = m + size
            start[stop[stop < n]] = True
    at = lead[start]
    return at, np.append(at[1:], n_bytes)


def _parts(body: np.ndarray, at: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at special strings: (bytes, offsets, row of each part, special tokens of each row)."""
    extra, rows = np.zeros(len(at) - 1, np.int64), np.arange(len(at) - 1)
    whole = body.tobytes()
    if not any(s in whole for s in special):
        return body, at, rows, extra
    chunks, of, cuts = [], [], [0]
    for row in range(len(at) - 1):
        own = [whole[at[row] : at[row + 1]]]
        for s in special:
            own = [p for x in own for p in x.split(s)]
        extra[row] = len(own) - 1
        for p in own:
            chunks.append(p)
            of.append(row)
            cuts.append(cuts[-1] + len(p))
    return np.frombuffer(b"".join(chunks), np.uint8), np.array(cuts), np.array(of), extra


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_column(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a column."""
    machine = transducer(path)
    body, at = text_buffers(texts)
    out = np.zeros(len(at) - 1, np.int64)
    low = 0
    while low < len(out):
        high = min(max(int(np.searchsorted(at, at[low] + SLICE, side="right")) - 1, low + 1), len(out))
        part, cuts, rows, extra = _parts(body[at[low] : at[high]], at[low : high + 1] - at[low], machine.special)
        starts, ends = pieces(part, cuts)
        counts = np.concatenate([[0], np.cumsum(machine.count_pieces(part, starts, ends))])
        bounds = np.searchsorted(starts, cuts)
        out[low:high] = extra + np.bincount(rows, weights=counts[bounds[1:]] - counts[bounds[:-1]], minlength=high - low).astype(np.int64)
        low = high
    return out


def with_token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of token counts, and its name.  vocabulary: path of a byte-level BPE file, the same on every machine."""
    prepare(docs.sparkSession)
    name = free_name(docs, "n_tokens")
    schema, at = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count_column(batch.column(at), vocabulary), pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema), name
