"""Words and word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task keeps before it starts afresh.
KEPT_WORDS = 1 << 20
#: Odd multipliers, one for each place in a shingle, and those of the final mixing.
PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of the 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in order: A-Z lower-cased, split at spaces and bytes 9 to 13."""
    words = text.lower().split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle; no words: empty."""
    w = word_hashes(text, known)
    if len(w) == 0:
        return w
    k = min(n, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc += w[i : len(w) - k + 1 + i] * np.uint64(PLACES[i % len(PLACES)] + 2 * (i // len(PLACES)))
    return np.unique(mixed(acc))
