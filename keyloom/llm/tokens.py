"""Token ids of whole texts with the tokenizers library, at the cost of encoding each distinct piece once per worker.

A tokenizer first splits a text into pieces by a fixed pattern and then encodes each piece on its own. So a text's ids are
its pieces' ids in a row, and pieces repeat far more often than they are new. Here pieces are found in numpy, from the classes
of a batch's characters, and looked up by two 64-bit hashes; the library encodes those that are new. Texts with characters
about which libraries may differ are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np

from keyloom.llm.shingles import mixed

#: A worker's table of pieces is emptied beyond this number of entries.
MOST = 2_000_000
#: Characters that are split at a time, about; longer texts are cut where a piece begins.
SEGMENT = 1 << 19
#: Only texts of characters below this, and of common punctuation, are split here.
PLAIN, TABLE = 0x250, 0x2100
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u0130\u0250-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]|<\\|")
DOUBTFUL_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Where any text may be cut: the space belongs to the piece behind it, or to none.
CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Classes of characters: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(TABLE, OTHER, np.uint8)
for _c in range(PLAIN):
    CLASS[_c] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(_c))[0], OTHER)
CLASS[[*range(0x09, 0x0E), 0x20, 0xA0]] = SPACE
#: The endings that the pre-tokenizers split off behind an apostrophe; fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
VALUES = mixed(np.arange(TABLE, dtype=np.uint64), 31)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


@cache
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    one = np.ones(1, np.uint64)
    return [tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 2**64))) for base in BASES]


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table:
    """hash -> ids, in sorted arrays; recent entries are merged with the others now and then."""

    def __init__(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.checks, self.starts, self.lengths, self.ids = (np.zeros(1 << 14, t) for t in (np.uint64, np.int64, np.int64, np.uint32))
        self.n = self.n_ids = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is new."""
        out = np.full(len(keys), -1, np.int64)
        for known, number in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, number[at], out)
        return out

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add new keys, which are sorted."""
        n, n_ids = self.n + len(keys), self.n_ids + len(ids)
        self.checks, self.starts, self.lengths, self.ids = self._grown(self.checks, n), self._grown(self.starts, n), self._grown(self.lengths, n), self._grown(self.ids, n_ids)
        self.checks[self.n : n], self.lengths[self.n : n], self.ids[self.n_ids : n_ids] = checks, lengths, ids
        self.starts[self.n : n] = self.n_ids + np.cumsum(lengths) - lengths
        old, recent = self.levels
        recent = self._merged(recent, (keys, np.arange(self.n, n)))
        self.levels = [self._merged(old, recent), (keys[:0], np.zeros(0, np.int64))] if 8 * len(recent[0]) > len(old[0]) else [old, recent]
        self.n, self.n_ids = n, n_ids

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers in a row, and how many each has."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def _endings(c: np.ndarray, a: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """How long the ending behind each apostrophe is, 0 if there is none; inside[k] is how many letters can follow at most."""
    out = np.zeros(len(a), np.int64)
    for ending in ENDINGS:
        hit = inside >= len(ending)
        for k, letter in enumerate(ending, 1):
            hit &= c[np.minimum(a + k, len(c) - 1)] == ord(letter)
        out[hit] = len(ending)
    return out


def pieces(c: np.ndarray, texts: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of code points c begin and end; texts begin at `texts` (the last entry is the end of c).

    By word: endings behind an apostrophe, runs of letters, single digits, runs of others; white space is dropped. Else the same
    with runs of digits, each with one space before it, and runs of white space, less that space and, before a piece, the last
    character.
    """
    kind, n = CLASS[c], len(c)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    if by_word:
        start[:n] |= kind == DIGIT
    else:
        behind = np.flatnonzero(start[:n] & ~first[:n] & (kind != SPACE))
        behind = behind[kind[behind - 1] == SPACE]  # begins behind white space
        start[behind - 1] = True
        start[behind[c[behind - 1] == 0x20]] = False
    a = np.flatnonzero(c == 0x27)
    a = a[start[a] & (a + 1 < n)]
    a = a[(kind[a + 1] == LETTER) & ~first[a + 1]] if len(a) else a
    if len(a):
        two = (a + 2 < n) & ~first[np.minimum(a + 2, n)]
        size = _endings(c, a, 1 + two)
        a, size = a[size > 0], size[size > 0]
        start[a + 1] = False
        start[a + 1 + size] = True
    at = np.flatnonzero(start)
    begin, end = at[:-1], at[1:]
    if by_word:
        solid = kind[begin] != SPACE
        begin, end = begin[solid], end[solid]
    return begin, end


class Encoder:
    """encode(texts) -> ids of each as numpy uint32; its vocabulary is one of words (lower-cased) or of bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.model.encode_special_tokens = True
        self.by_word = self.tokenizer.normalizer is not None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Pieces are split and written in the byte level's characters already.
        self.model.normalizer, self.model.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit("\n")
        self.characters = _byte_level()
        self.table = _Table()

    def _learn(self, keys: np.ndarray, checks: np.ndarray, new: list[str]) -> None:
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic
        ids, lengths = [], []
        for k in range(0, len(new), 4096):
            written = [p.encode().decode("latin-1").translate(self.characters) for p in new[k : k + 4096]]
            encoded = [e.ids for e in self.model.encode_batch_fast(written, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            ids.append(np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths[-1].sum())))
        self.table.add(keys, checks, np.concatenate(ids), np.concatenate(lengths))
        if collects:
            gc.enable()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of plain characters, all split together."""
        joined = "".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
        if not len(c):
            return [np.zeros(0, np.uint32) for _ in texts]
        begin, end = pieces(c, at, self.by_word)
        values, hashes = VALUES[c], []
        for up, down in _powers(2 * SEGMENT if len(c) <= 2 * SEGMENT else len(c)):
            sums = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(values * up[: len(c)], out=sums[1:])
            hashes.append(mixed((sums[end] - sums[begin]) * down[begin], 32))
        keys, first, inverse = np.unique(hashes[0], return_index=True, return_inverse=True)
        number = self.table.find(keys)
        new = number < 0
        if self.table.n + int(new.sum()) > MOST:
            self.table = _Table()
            number, new = np.full(len(keys), -1), np.ones(len(keys), bool)
        if new.any():
            known = self.table.n
            at_new = first[new]
            self._learn(keys[new], hashes[1][at_new], [joined[a:b] for a, b in zip(begin[at_new].tolist(), end[at_new].tolist(), strict=True)])
            number[new] = known + np.arange(len(at_new))
        number = number[inverse]
        ids, lengths = self.table.get(number)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.searchsorted(begin, at)
        out = [ids[ends[a] : ends[b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in set((np.searchsorted(bounds, np.flatnonzero(self.table.checks[number] != hashes[1]), "right") - 1).tolist()):
            out[k] = self._whole(texts[k])  # two pieces with one hash
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; None is an empty text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        n_held = 0

        def flush() -> None:
            nonlocal n_held
            for (k, _), ids in zip(held, self._split([part for _, part in held]), strict=True):
                out[k].append(ids)
            held.clear()
            n_held = 0

        for k, text in enumerate(texts):
            if not text or (any(x in text for x in DOUBTFUL_ASCII) if text.isascii() else DOUBTFUL.search(text)):
                out[k].append(self._whole(text) if text else np.zeros(0, np.uint32))
                continue
            text = text.lower() if self.by_word else text
            at = 0
            while at < len(text):
                cut = CUT.search(text, at + SEGMENT) if len(text) - at > 2 * SEGMENT else None
                end = cut.start() if cut else len(text)
                held.append((k, text[at:end]))
                n_held += end - at
                at = end
                if n_held >= SEGMENT:
                    flush()
        flush()
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] for parts in out]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
