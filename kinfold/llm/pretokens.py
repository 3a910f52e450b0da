"""Pre-tokens of many texts at once: the splitting of two public BPE vocabularies as numpy over code points.

Texts with characters outside PLAIN, for which libraries might class or lower-case differently, aren't split here; the
tokenizer gets them whole. A pre-token is known by 64 bits of hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .text import U64, _powers, mix

#: Latin letters, usual marks and blanks.
PLAIN = r"[\x00-\x1b -\x84\x86-\x9f\xa1-įı-ɏ‐-‧‰-⁞€]"
#: Code points of texts that are worked on together.
GROUP_CHARS = 250_000
ODD, LETTER, NUMBER, MARK, BLANK = 0, 1, 2, 3, 4
#: Fixed: letters that a single apostrophe takes along.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x2100, MARK, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        is_kind = regex.compile(pattern).match
        kinds[[i for i in range(len(kinds)) if is_kind(chr(i))]] = kind
    is_plain = regex.compile(PLAIN).match
    kinds[[i for i in range(len(kinds)) if not is_plain(chr(i))]] = ODD
    return kinds


def _points_kinds(whole: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return points, _kinds()[np.minimum(points, 0x20FF)]


def split(texts: list[str], with_blanks: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined; start, end and hash of each pre-token; first pre-token of each text (and the end).

    with_blanks: a blank before a run belongs to it and other blanks are pre-tokens (byte-level BPE), and digits run
    together. Without: blanks vanish, and each digit stands alone."""
    whole = "".join(texts)
    n = len(whole)
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    if not n:
        return whole, *(np.zeros(0, np.int64),) * 2, np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    points, kinds = _points_kinds(whole)
    begin = np.ones(n, bool)
    begin[1:] = kinds[1:] != kinds[:-1]
    firsts = at[:-1][sizes > 0]
    begin[firsts] = True
    if not with_blanks:
        begin |= kinds == NUMBER
    # a lone apostrophe takes some letters along
    quotes = np.flatnonzero((points == 39) & begin)
    last_of = np.ones(n, bool)
    last_of[:-1] = begin[1:]
    quotes = quotes[last_of[quotes] & (quotes + 1 < n)]
    if len(quotes):
        quotes = quotes[(kinds[quotes + 1] == LETTER) & ~np.isin(quotes + 1, firsts)]
    if with_blanks and len(quotes):
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[(points[before] != 32) | np.isin(quotes, firsts)]
    if len(quotes):
        own_end = at[np.searchsorted(at, quotes, "right")]
        for q, e in zip(quotes.tolist(), own_end.tolist(), strict=True):
            ending = next((x for x in ENDINGS if whole.startswith(x, q + 1, e)), "")
            if ending:
                begin[q + 1] = False
                if q + 1 + len(ending) < n:
                    begin[q + 1 + len(ending)] = True
    start = np.flatnonzero(begin)
    if with_blanks:
        kind, end = kinds[start], np.append(start[1:], n)
        # a run of blanks before something else gives up its last one: to what follows if it's a space, else alone
        inner = np.ones(len(start), bool)
        inner[np.searchsorted(start, at[1:][sizes > 0] - 1, "right") - 1] = False
        gives = (kind == BLANK) & inner
        lasts = end[gives] - 1
        space = points[lasts] == 32
        begin[lasts] = True
        begin[lasts[space] + 1] = False
        start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    if not with_blanks:
        keep = kinds[start] != BLANK
        start, end = start[keep], end[keep]
    size = max(2 * GROUP_CHARS, 1 << n.bit_length()) if n > 2 * GROUP_CHARS else 2 * GROUP_CHARS
    up, down = _powers(size)
    total = np.zeros(n + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return whole, start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)), np.searchsorted(start, at)


def groups(texts: list[str | None], added: list[str]) -> list[tuple[list[int], list[str]]]:
    """Rows and texts of groups of plain texts. A text with an odd character or an added token's string is alone, and its
    row is given as -1 - row."""
    texts = [t or "" for t in texts]
    out, first = [], 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= GROUP_CHARS):
            size += len(texts[end])
            end += 1
        group = texts[first:end]
        kinds = _points_kinds("".join(group))[1]
        odd = np.searchsorted(np.cumsum([len(t) for t in group]), np.flatnonzero(kinds == ODD), "right")
        alone = {*odd.tolist(), *(i for i, t in enumerate(group) if any(x in t for x in added))}
        out += [([-1 - first - i], [group[i]]) for i in sorted(alone)]
        if rows := [i for i in range(len(group)) if i not in alone]:
            out.append(([first + i for i in rows], [group[i] for i in rows]))
        first = end
    return out


class Known:
    """Numbers, from 0, for the hashes seen, in sorted arrays of two generations."""

    def __init__(self):
        self.n = 0
        self.old = self.new = (np.zeros(0, U64), np.zeros(0, np.int64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes, -1 for the unknown."""
        out = np.full(len(hashes), -1)
        for known, number in (self.old, self.new):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = number[at[hit]]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        number = np.arange(self.n, self.n + len(hashes))
        self.n += len(hashes)
        self.new = self._joined(self.new, (hashes, number))
        if len(self.new[0]) > 100_000:
            self.old, self.new = self._joined(self.old, self.new), (np.zeros(0, U64), np.zeros(0, np.int64))
        return number

    @staticmethod
    def _joined(a, b):
        hashes, number = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], number[order]


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stay, the others come after U+0100 in turn."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


def in_letters(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word.replace(" ", byte_letters()[32])
    return word.encode().decode("latin-1").translate(byte_letters())
