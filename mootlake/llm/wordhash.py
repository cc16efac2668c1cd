"""Words of Arrow batches as numpy features: affixes and n-grams hashed without a Python loop over characters."""

from __future__ import annotations

import re

import numpy as np

# A longer run of letters is cut into pieces, so that no letter is left out.
LONGEST = 32
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX
    x ^= x >> np.uint64(27)
    x *= _MULT
    x ^= x >> np.uint64(31)
    return x


def code_matrix(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, zero padded, and the words' lengths."""
    packed = np.array(distinct, dtype=f"<U{LONGEST}")
    codes = packed.view(np.uint32).reshape(len(distinct), LONGEST)
    lengths = np.char.str_len(packed).astype(np.int64)
    return codes[:, :max(1, int(lengths.max(initial=1)))], lengths


def features(distinct: list[str], bits: int, grams=(2, 3), affixes=(1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (words x slots) and a mask of the slots in use: the word itself, prefixes, suffixes and n-grams."""
    if not distinct:
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), bool)
    codes, lengths = code_matrix(distinct)
    n, width = codes.shape
    wide = codes.astype(np.uint64) + np.uint64(1)
    used = np.arange(width)[None, :] < lengths[:, None]
    ids, masks = [], []

    def add(h: np.ndarray, kind: int, mask: np.ndarray) -> None:
        ids.append((mix(h + np.uint64(kind * 1_000_003)) >> np.uint64(64 - bits)).astype(np.int64))
        masks.append(mask)

    prefix = np.zeros(n, np.uint64)
    for i in range(width):
        prefix = np.where(used[:, i], mix(prefix * _MULT + wide[:, i]), prefix)
        if i + 1 in affixes:
            add(prefix[:, None], 1, used[:, i][:, None])
    add(prefix[:, None], 0, np.ones((n, 1), bool))
    suffix = np.zeros(n, np.uint64)
    rows = np.arange(n)
    for i in range(min(max(affixes), width)):
        at = lengths - 1 - i
        ok = at >= 0
        suffix = np.where(ok, mix(suffix * _MULT + wide[rows, np.maximum(at, 0)]), suffix)
        if i + 1 in affixes:
            add(suffix[:, None], 2, ok[:, None])
    for g in grams:
        if width >= g:
            h = np.zeros((n, width - g + 1), np.uint64)
            for j in range(g):
                h = mix(h * _MULT + wide[:, j:width - g + 1 + j])
            add(h, 10 + g, used[:, g - 1:])
    return np.concatenate(ids, axis=1), np.concatenate(masks, axis=1)


def factorize(lists: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word numbers of all lists in one array, the distinct words, and each list's length."""
    number: dict[str, int] = {}
    flat = [number.setdefault(w, len(number)) for words in lists for w in words]
    return np.array(flat, np.int64), list(number), np.array([len(x) for x in lists], np.int64)
