"""Token ids of whole texts by the ``tokenizers`` library, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from tillspark.llm.merging import PLAIN, LetterMerges
from tillspark.llm.shared import held

# Python's \s without the four separators that the tokenizers' own white space leaves out.
WS, NOT_WS = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: White space and what follows up to the next white space. Byte-level pre-tokens always break between such pieces: no
#: alternative of the pattern runs on from other text into white space, and none that ends there looks ahead.
PIECE = re.compile(rf"{WS}*{NOT_WS}+|{WS}+")
#: After letters they start a pre-token of their own, as letters are never taken up by what follows them.
PUNCTUATION = ".,;:!?"
#: Where cutting before a space would part a run of white space.
SPACED = re.compile(rf"{WS} ")
#: Ends where white space follows other text; pre-tokens always break there, too.
STABLE = re.compile(rf"{NOT_WS}(?={WS})")


def stable_slices(text: str, size: int) -> Iterator[str]:
    """The text in consecutive slices of about ``size`` characters, cut only where pre-tokens always break."""
    start = 0
    while len(text) - start > size:
        found = STABLE.search(text, start + size - 1)
        if found is None:
            break
        yield text[start:found.end()]
        start = found.end()
    yield text[start:]


class PieceEncoder:
    """ids(text) equals the library's ids without added special tokens.

    Texts are cut before single spaces, and each distinct word is encoded once: words of plain letters by their merges, many at
    a time, others by the library. Words seen twice are kept (``most``
    of them), words seen once for a while (``fresh`` of them); longer ones than ``longest`` never.
    """

    def __init__(self, path: str, most: int = 450_000, fresh: int = 300_000, longest: int = 48, slice_chars: int = 1 << 18,
                 group_chars: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.fresh, self.longest, self.slice_chars, self.group_chars = most, fresh, longest, slice_chars, group_chars
        self.merges = LetterMerges.of(self.tokenizer)
        # By word, without the space before it.
        self.words: dict[str, bytes] = {}
        self.new_words: dict[str, bytes] = {}
        # A byte-level token has one character per byte; an added token stands for itself.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.marks = dict(zip(PUNCTUATION, self._encode(list(PUNCTUATION))))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words after a space, as one text; the ids are dealt out by their bytes."""
        text = " " + " ".join(words)
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        sizes = list(map(len, words)) if text.isascii() else [len(w.encode()) for w in words]
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum(sizes) + np.arange(1, len(words) + 1)
        cuts = np.searchsorted(ends, wanted)
        if cuts[-1] >= len(ends) or (ends[cuts] != wanted).any():
            return self._encode([" " + w for w in words])
        raw, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _new(self, missing: Iterable[str]) -> dict[str, bytes]:
        """The ids of words that are not kept."""
        out, once, kept = {}, self.new_words, self.words
        again, whole, ends_open, letters, marked = {}, [], [], {}, []
        for w in missing:
            ids = once.pop(w, None)
            if ids is not None:
                again[w] = ids
                continue
            mark = self.marks.get(w[-1:])
            if mark is not None and w[:-1].isalpha():
                stem = w[:-1]
                ids = kept.get(stem) or once.get(stem) or again.get(stem)
                if ids is not None:
                    out[w] = ids + mark
                    continue
                if self.merges and PLAIN.fullmatch(stem):
                    letters[stem] = None
                    marked.append((w, stem, mark))
                    continue
            elif self.merges and PLAIN.fullmatch(w):
                letters[w] = None
                continue
            (ends_open if not w or w[-1].isspace() else whole).append(w)
        if letters:
            out.update(zip(letters, self.merges.ids(list(letters))))
            out.update((w, out[stem] + mark) for w, stem, mark in marked)
        if whole:
            out.update(zip(whole, self._encode_words(whole)))
        if ends_open:
            out.update(zip(ends_open, self._encode([" " + w for w in ends_open])))
        if len(kept) > self.most:
            self.words = kept = {}
        if len(once) > self.fresh:
            self.new_words = once = {}
        kept.update(again)
        once.update((w, ids) for w, ids in out.items() if len(w) < self.longest)
        out.update(again)
        return out

    def packed_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; new words of several texts are encoded together."""
        out: list[list[bytes]] = []
        group, size = [], 0
        for text in texts:
            out.append([])
            for part in stable_slices(text, self.slice_chars):
                group.append((out[-1], part))
                size += len(part)
                if size >= self.group_chars:
                    self._encode_group(group)
                    group, size = [], 0
        self._encode_group(group)
        return [b"".join(x) for x in out]

    def _encode_group(self, group: list[tuple[list[bytes], str]]) -> None:
        """Slices of texts, whose ids go to the end of the list that each comes with."""
        cut, missing, whole = [], {}, {}
        for out, part in group:
            if SPACED.search(part):
                cut.append((out, PIECE.findall(part), [], []))
                whole.update(dict.fromkeys(cut[-1][1]))
                continue
            head, *words = part.split(" ")
            found = list(map(self.words.get, words))
            places = [i for i, f in enumerate(found) if f is None] if None in found else []
            missing.update(dict.fromkeys([words[i] for i in places]))
            cut.append((out, [head] if head else [], found, [(i, words[i]) for i in places]))
            whole.update(dict.fromkeys(cut[-1][1]))
        pieces = dict(zip(whole, self._encode(list(whole)))) if whole else {}
        new = self._new(missing) if missing else {}
        for out, before, found, places in cut:
            for i, word in places:
                found[i] = new[word]
            out += map(pieces.__getitem__, before)
            out += found

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


def encoder(path: str) -> PieceEncoder:
    """One per Python worker."""
    return held(("words", path), lambda: PieceEncoder(path))
