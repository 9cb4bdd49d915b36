"""Byte-level BPE with vectorised pre-tokenisation.

No regular expression runs. Every code point gets a class, looked up in an array, with one code point of
lookahead folded in. A class is a transition function between a few states ("in letters", "after a
leading space", "after an apostrophe that starts a token", ...). Functions compose associatively, so all prefixes
are computed by a pairwise scan over arrays; the composites that can occur are few and are numbered, which makes
composing a table lookup. A class met in a state tells whether a token starts there. The slices between starts
are merged pair by pair, each distinct slice once, and looked up after that.
"""

from __future__ import annotations

import base64
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bound_batches, held

# Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes. ONE ends a contraction after an apostrophe, PAIR starts a two-letter end; both are letters elsewhere.
# A white-space code point is SPACE or OTHER_WS right before other text, else RUN.
LETTER, NUMBER, OTHER, APOSTROPHE, ONE, PAIR, SPACE, OTHER_WS, RUN = CLASSES = range(9)
# States: what the code points so far leave open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_RUN, AFTER_APOSTROPHE, IN_PAIR = STATES = range(8)
#: A class plus this is the same class at the start of a text.
FIRST = 9


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if kind >= FIRST:
        return _step(FRESH, kind - FIRST)
    letter = kind in (LETTER, ONE, PAIR)
    if state == IN_PAIR:
        return FRESH, False
    if state == AFTER_APOSTROPHE and kind in (ONE, PAIR):
        return (FRESH if kind == ONE else IN_PAIR), False
    if state in (IN_OTHER, AFTER_SPACE, AFTER_APOSTROPHE) and kind in (OTHER, APOSTROPHE):
        return IN_OTHER, False
    if state in (IN_LETTERS, AFTER_SPACE) and letter:
        return IN_LETTERS, False
    if state in (IN_NUMBERS, AFTER_SPACE) and kind == NUMBER:
        return IN_NUMBERS, False
    if state == IN_RUN and kind == RUN:
        return IN_RUN, False
    if letter:
        return IN_LETTERS, True
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE: AFTER_APOSTROPHE, SPACE: AFTER_SPACE, OTHER_WS: FRESH,
            RUN: IN_RUN}[kind], True


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class by code point; start flags (class, state); states reached (function, state); products of functions.

    The functions are numbered so that the first are those of the classes themselves.
    """
    classes = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    # Letters and numbers are what the library takes for such: it gives ids to the bytes of these characters only.
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        single = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        classes[list(map(ord, bytes(single.encode_ordinary(every)).decode()))] = kind
    classes[WHITE_SPACE] = RUN
    classes[ord("'")] = APOSTROPHE
    classes[[ord(c) for c in "stmd"]] = ONE
    steps = [[_step(s, k) for s in STATES] for k in range(2 * FIRST)]
    starts = np.array([[flag for _, flag in row] for row in steps])
    functions = [tuple(s for s, _ in row) for row in steps]
    number: dict[tuple, int] = {}
    for f in functions:
        number.setdefault(f, len(number))
    known = list(number)
    for f in known:
        for g in list(dict.fromkeys(functions)):
            made = tuple(g[s] for s in f)
            if made not in number:
                number[made] = len(known)
                known.append(made)
    reach = np.array(known, dtype=np.uint8)
    product = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint16)
    as_function = np.array([number[f] for f in functions], dtype=np.uint16)
    return classes, starts, reach, product, as_function


def _scan(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """All prefix products, by halving: pairs are composed, their prefixes found, the odd ones filled in."""
    n = len(functions)
    if n <= 1:
        return functions
    out = np.empty_like(functions)
    pairs = _scan(product[functions[0:n - n % 2:2], functions[1::2]], product)
    out[0], out[1::2] = functions[0], pairs
    out[2::2] = product[pairs[:len(out[2::2])], functions[2::2]]
    return out


def token_starts(points: np.ndarray, first: np.ndarray, after: int = -1, state: int = FRESH) -> tuple[np.ndarray, int]:
    """Flags of where tokens start, and the state at the end.

    ``first`` marks where texts start; ``after`` is the code point that follows, -1 at the end of a text; ``state`` is the one
    that earlier code points of the text left.
    """
    classes, starts, reach, product, as_function = tables()
    kind = classes[points]
    following = np.append(points[1:], after).astype(np.int64)
    following[:-1][first[1:]] = -1
    pair = ((points == ord("r")) | (points == ord("v"))) & (following == ord("e"))
    kind[pair | (points == ord("l")) & (following == ord("l"))] = PAIR
    space = np.flatnonzero(kind == RUN)
    ahead = following[space]
    before_text = (ahead >= 0) & (classes[ahead] != RUN)
    kind[space[before_text]] = np.where(points[space[before_text]] == 32, SPACE, OTHER_WS)
    kind[first] += FIRST
    states = reach[_scan(as_function[kind], product), state]
    return starts[kind, np.append(np.uint8(state), states[:-1])], int(states[-1])


class Bpe:
    """Ranks of a file, merging, and a bounded store of what slices merge to."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 48, window: int = 1 << 18):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
        self.most, self.longest, self.window = most, longest, window
        self.known: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked pair of neighbours is joined, leftmost first, until none has a rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > 4 * self.longest:
            return self._merge_long(piece)
        ranks, none = self.ranks, len(self.ranks) + 1
        parts = [piece[i:i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            low = min(scores)
            if low == none:
                break
            i = scores.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long slices, in time n log n: a heap of pairs over a linked list of parts."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # a part at i is piece[i:end[i]]
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i] if alive[i] else n
            if mid >= n or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                left[stop] = i
            for a, b in ((left[i], i), (i, stop)):
                if a >= 0 and b < n and (r := ranks.get(piece[a:end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def _merged(self, pieces: list[bytes]) -> bytes:
        if len(self.known) > self.most:
            self.known = {}
        long = {}
        for p in set(pieces):
            if p not in self.known:
                (self.known if len(p) <= self.longest else long)[p] = np.array(self.merge(p), "<u4").tobytes()
        if long:
            return b"".join([self.known[p] if p in self.known else long[p] for p in pieces])
        return b"".join(map(self.known.__getitem__, pieces))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; texts share windows of code points."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > self.window:
                self._encode_long(text, out[i])
            elif text:
                held.append(i)
                size += len(text)
                if size >= self.window:
                    self._encode_short(texts, held, out)
                    held, size = [], 0
        self._encode_short(texts, held, out)
        return [b"".join(x) for x in out]

    def _encode_short(self, texts: list[str], held: list[int], out: list[list[bytes]]) -> None:
        if not held:
            return
        joined = "".join(texts[i] for i in held)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        text_starts = np.cumsum([0] + [len(texts[i]) for i in held[:-1]])
        first = np.zeros(len(points), dtype=bool)
        first[text_starts] = True
        starts = np.flatnonzero(token_starts(points, first)[0])
        data, cuts = joined.encode(), _byte_offsets(points, starts)
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        bounds = np.append(np.searchsorted(starts, text_starts), len(starts)).tolist()
        for i, a, b in zip(held, bounds, bounds[1:]):
            out[i].append(self._merged(pieces[a:b]))

    def _encode_long(self, text: str, out: list[bytes]) -> None:
        """Windows of one text; the scan goes on from the state of the window before."""
        state, rest = FRESH, b""
        for at in range(0, len(text), self.window):
            part = text[at:at + self.window]
            points = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.int64)
            after = ord(text[at + self.window]) if at + self.window < len(text) else -1
            flags, state = token_starts(points, np.zeros(len(points), dtype=bool), after, state)
            starts = np.flatnonzero(flags)
            data = part.encode()
            if not len(starts):
                rest += data
                continue
            cuts = _byte_offsets(points, starts)
            head = rest + data[:cuts[0]]
            pieces = [head] * bool(head) + [data[a:b] for a, b in zip(cuts, cuts[1:-1])]
            rest = data[cuts[-2]:]
            out.append(self._merged(pieces))
        if rest:
            out.append(self._merged([rest]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _byte_offsets(points: np.ndarray, starts: np.ndarray) -> list[int]:
    """UTF-8 offsets of the code points at ``starts``, and the length of all."""
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.cumsum(width)
    return [*(ends[starts] - width[starts]).tolist(), int(ends[-1])]


def bpe(path: str) -> Bpe:
    """One per Python worker."""
    return held(("bpe", path), lambda: Bpe(path))


TOKENS = "struct<ids:array<int>,offsets:array<int>>"


def encoder(path: str):
    """A column function: text to its ids and the byte at which each token starts."""
    @F.arrow_udf(TOKENS)
    def encode(texts: pa.Array) -> pa.Array:
        known = bpe(path)
        raw = known.encode_all([t or "" for t in texts.to_pylist()])
        ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
        bounds = np.cumsum([0] + [len(r) // 4 for r in raw])
        lengths = known.lengths[ids]
        ends = np.cumsum(lengths)
        before = np.append(0, ends)[bounds[:-1]]
        offsets = (ends - lengths - np.repeat(before, np.diff(bounds))).astype(np.int32)
        bounds = pa.array(bounds, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array(offsets))],
            names=["ids", "offsets"])

    return encode


def decoder(path: str):
    """A column function: ids to their bytes."""
    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        known = bpe(path)
        return pa.array([known.decode(x or []) for x in ids.to_pylist()], pa.binary())

    return decode


def encode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens): one row per row of ``docs``; ``tokens`` holds ids and byte offsets.

    NULL texts are empty and have no tokens. NULL and repeated ids stay, each row for itself. Other columns are
    ignored. No rows in, no rows out. A text of any length is scanned in windows that hand their state on.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc).alias("doc_id"), encoder(path)(F.col(text)).alias("tokens"))
