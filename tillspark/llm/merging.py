"""Pair merging of many words at once, for words of plain letters: rows of a matrix, one merge a round in each.

A word after a space is one byte-level pre-token, so its ids follow from the ranks of its pairs alone: in each round every
row merges its leftmost pair of least rank, and only the pairs beside it are looked up again.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Letters that every version of the character tables calls letters.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,30}")
#: Rows merged together.
ROWS = 8192
NEVER = np.int32(2**31 - 1)


def _characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class LetterMerges:
    """ids(words): the ids of words of plain letters, each after a space."""

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in _characters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.size = max(vocabulary.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        # A first look-up of bytes needs no search.
        self.of_bytes = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    @staticmethod
    def of(tokenizer) -> LetterMerges | None:
        """For a tokenizer that merges byte-level pre-tokens by rank and does nothing else to letters; else None."""
        known = json.loads(tokenizer.to_str())
        model, before = known["model"], known["pre_tokenizer"] or {}
        plain = (
            model.get("type") == "BPE" and not any(model.get(k) for k in (
                "dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and known["normalizer"] is None and not any(PLAIN.search(t["content"][:1]) for t in known["added_tokens"])
            and all(c in model["vocab"] for c in _characters())
        )
        return LetterMerges(model) if plain else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def ids(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        data = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        starts = np.flatnonzero(data == 32)
        sizes = np.diff(np.append(starts, len(data)))
        order, out = np.argsort(sizes, kind="stable"), [b""] * len(words)
        for lo in range(0, len(order), ROWS):
            rows = order[lo:lo + ROWS]
            ids, counts = self._merged(data, starts[rows], sizes[rows])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for row, a, b in zip(rows.tolist(), [0, *ends], ends):
                out[row] = raw[a:b]
        return out

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in order, and how many each has. The last column stands for no neighbour."""
        width = int(sizes.max())
        column = np.arange(width + 1)
        raw = data[np.minimum(starts[:, None] + column, len(data) - 1)].astype(np.int64)
        ids, alive = self.byte_ids[raw], column < sizes[:, None]
        rank = np.full(ids.shape, NEVER)
        rank[:, :-1] = np.where(alive[:, 1:], self.of_bytes[raw[:, :-1] * 256 + raw[:, 1:]], NEVER)
        after = np.where(column + 1 < sizes[:, None], column + 1, width)
        before = np.broadcast_to(np.where(column > 0, column - 1, width), ids.shape).copy()
        rows = np.arange(len(ids))
        while len(rows):
            at = rank[rows].argmin(axis=1)
            least = rank[rows, at]
            go = least != NEVER
            rows, at, least = rows[go], at[go], least[go]
            gone = after[rows, at]
            right, left, made = after[rows, gone], before[rows, at], self.made[least]
            ids[rows, at], alive[rows, gone], rank[rows, gone] = made, False, NEVER
            after[rows, at], before[rows, right] = right, at
            rank[rows, at] = np.where(right < width, self._rank(made, ids[rows, right]), NEVER)
            some = left < width
            rank[rows[some], left[some]] = self._rank(ids[rows[some], left[some]], made[some])
        return ids[alive], alive.sum(axis=1)
