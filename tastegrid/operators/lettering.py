"""Scores of many pairs of keys at once: letters as bits of 64-bit numbers, common subsequences of whole arrays."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Positions of a key, with a blank after each word, that one number holds; pairs of longer keys are scored one by one.
POSITIONS = 64
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
_NONE = len(_ALPHABET)
_CODE = np.full(256, _NONE, np.uint8)
for _k, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _k
#: So many occurrences of a character have a bit; 128 bits in all.
_LEVELS = {c: 6 if c in "aeiou" else 5 if c in "lnrst " else 2 if c.isdigit() else 3 for c in _ALPHABET}
#: Pairs whose subsequences are worked out at once: few enough for the processor's cache.
SLICE = 8192


class Lettered:
    """Keys as arrays. ``plain`` marks those that the arrays hold whole: short, of known letters, no word twice."""

    def __init__(self, keys: list[str], known: dict[str, int]) -> None:
        n = len(keys)
        self.keys = keys
        self.words = [sorted(k.split()) for k in keys]
        texts = [" ".join(w) + " " for w in self.words]
        self.size = np.array([len(t) - 1 for t in texts], np.int64)
        self.plain = np.array([len(t) <= POSITIONS and t.isascii() and len(set(w)) == len(w) for t, w in zip(texts, self.words, strict=True)], bool)
        codes = _CODE[np.array([t.encode() if p else b"" for t, p in zip(texts, self.plain, strict=True)], f"S{POSITIONS}").view(np.uint8).reshape(n, POSITIONS)]
        self.plain &= (codes != _NONE).sum(1) == np.where(self.plain, self.size + 1, 0)
        counts = np.stack([(codes == k).sum(1) for k in range(_NONE)], 1)
        for k in np.flatnonzero(~self.plain):
            letters = Counter(texts[k])
            counts[k] = [letters[c] for c in _ALPHABET]
        bits = np.stack([counts[:, k] > level for k, c in enumerate(_ALPHABET) for level in range(_LEVELS[c])], 1)
        bits = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), axis=1).view(np.uint64)
        self.low, self.high = np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1])
        self.codes = np.ascontiguousarray(codes.T).astype(np.int64)
        masks = np.zeros((n, _NONE + 1), np.uint64)
        for t in range(POSITIONS):
            masks[np.arange(n), codes[:, t]] |= np.uint64(1 << t)
        masks[:, _NONE] = 0
        self.masks = masks.ravel()
        most = max([1, *(len(w) for w, p in zip(self.words, self.plain, strict=True) if p)])
        self.word, self.word_bits, self.word_size = np.full((n, most), -1, np.int64), np.zeros((n, most), np.uint64), np.zeros((n, most), np.int64)
        for k, words in enumerate(self.words):
            if self.plain[k]:
                at = 0
                for m, w in enumerate(words):
                    self.word[k, m] = known.setdefault(w, len(known))
                    self.word_size[k, m] = len(w) + 1
                    self.word_bits[k, m] = ((1 << len(w) + 1) - 1) << at
                    at += len(w) + 1


def _subsequences(a: Lettered, b: Lettered, i: np.ndarray, j: np.ndarray, skip_a: np.ndarray | None = None, skip_b: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[j], blanks at the end included, without skipped positions."""
    base, open_ = i * (_NONE + 1), np.full(len(i), ~np.uint64(0))
    keep = None if skip_a is None else ~skip_a
    for t in range(int(b.size[j].max()) + 1):
        hit = a.masks.take(base + b.codes[t].take(j))
        hit &= open_
        if keep is not None:
            hit &= keep
            hit *= (skip_b >> np.uint64(t)) & np.uint64(1) ^ np.uint64(1)
        open_ = (open_ + hit) | (open_ - hit)
    return np.bitwise_count(~open_).astype(np.int64)


def _share(insertions: np.ndarray, length: np.ndarray) -> np.ndarray:
    return 100.0 * (1 - insertions / length)


def _letters(a: Lettered, b: Lettered, i: np.ndarray, j: np.ndarray, contained: bool) -> np.ndarray:
    both = a.size[i] + b.size[j]
    score = _share(both - 2 * (_subsequences(a, b, i, j) - 1), both)
    same_a = np.zeros((len(i), a.word.shape[1]), bool)
    same_b = np.zeros((len(i), b.word.shape[1]), bool)
    wa, wb = a.word[i], b.word[j]
    for m in range(wa.shape[1]):
        same = (wb == wa[:, m : m + 1]) & (wa[:, m : m + 1] >= 0)
        same_a[:, m] = same.any(1)
        same_b |= same
    k = np.flatnonzero(same_a.any(1))
    if len(k):
        p, q, same_a, same_b = i[k], j[k], same_a[k], same_b[k]
        s = (a.word_size[p] * same_a).sum(1) - 1
        x, y = a.size[p] - s - 1, b.size[q] - s - 1  # -1 where nothing is left
        skip = [np.bitwise_or.reduce(w * same.astype(np.uint64), axis=1) for w, same in ((a.word_bits[p], same_a), (b.word_bits[q], same_b))]
        rest = x + y - 2 * (_subsequences(a, b, p, q, *skip) - 1)
        held = (x < 0) | (y < 0)
        whole = np.where(held, 100.0 if contained else 0.0, _share(rest, 2 * (s + 1) + x + y))
        if contained:
            whole = np.maximum(whole, np.maximum(_share(1 + x, 2 * s + 1 + x), _share(1 + y, 2 * s + 1 + y)))
        score[k] = np.maximum(score[k], whole)
    return score


def pair_scores(a: Lettered, b: Lettered, i: np.ndarray, j: np.ndarray, one, contained: bool = True) -> np.ndarray:
    """Scores of a[i] and b[j], ``one(key, key)`` for those that the arrays don't hold.

    Without ``contained``, plain keys are scored by their letters alone, not by what of one the common words cover.
    """
    out = np.zeros(len(i))
    for start in range(0, len(i), SLICE):
        p, q = i[start : start + SLICE], j[start : start + SLICE]
        plain = a.plain[p] & b.plain[q] & (a.size[p] > 0) & (b.size[q] > 0)
        part = np.zeros(len(p))
        if plain.any():
            part[plain] = _letters(a, b, p[plain], q[plain], contained)
        for k in np.flatnonzero(~plain):
            part[k] = one(a.keys[p[k]], b.keys[q[k]])
        out[start : start + SLICE] = part
    return out


def near(a: Lettered, b: Lettered, least: float, same: bool):
    """Yields (i, j) of the pairs whose letters, whatever their order, and lengths allow a score of ``least``; i < j if a is b.

    ``b`` is in order of size. Each letter that one has more often than the other has to be put in or left out, with
    common words or without.
    """
    ratio, share = (200.0 - least) / least, 1 - least / 100
    begin = np.searchsorted(b.size, np.ceil(a.size / ratio - 1e-9))
    end = np.searchsorted(b.size, np.floor(a.size * ratio + 1e-9), "right")
    allowed: dict[int, np.ndarray] = {}
    found_i, found_j, held = [], [], 0
    for i in range(len(a.keys)):
        size = int(a.size[i])
        if size not in allowed:
            allowed[size] = np.minimum(np.floor((size + b.size) * share + 1e-9), 255).astype(np.uint8)
        at = slice(max(begin[i], i + 1) if same else begin[i], end[i])
        gap = np.bitwise_count(b.low[at] ^ a.low[i])
        gap += np.bitwise_count(b.high[at] ^ a.high[i])
        j = np.flatnonzero(gap <= allowed[size][at])
        if len(j):
            found_i.append(np.full(len(j), i))
            found_j.append(j + at.start)
            held += len(j)
        if held > 1 << 18:
            yield np.concatenate(found_i), np.concatenate(found_j)
            found_i, found_j, held = [], [], 0
    if held:
        yield np.concatenate(found_i), np.concatenate(found_j)
