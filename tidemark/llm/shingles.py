"""Word shingles of whole texts as 64-bit hashes, in numpy over batches of texts.

A word is hashed as a polynomial of its bytes modulo 2**64, read off prefix sums of the whole buffer, then mixed; a
shingle as a mixed sum of its words' hashes with one odd factor a place.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes whose words are hashed at once; a longer text is cut at white space.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Holds the tables of powers; ``sets(texts)`` gives each text's sorted distinct shingle hashes."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._grow(PIECE + 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[_U(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))])
            self.inverse = np.concatenate([[_U(1)], np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))])

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' first bytes, and their hashes."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(raw) > len(self.powers) - 2:
            self._grow(len(raw) + 16)
        gap = np.ones(len(raw) + 2, dtype=bool)
        gap[1:-1] = self.space[raw]
        start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((self.lower[raw].astype(np.uint64) + _U(1)) * self.powers[: len(raw)], out=sums[1:])
        return start, mix((sums[end] - sums[start]) * self.inverse[start])

    def word_hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for text in [*texts, None]:
            if held and (text is None or size + len(text) > PIECE):
                bounds = np.cumsum([0, *(len(x) + 1 for x in held)])
                at, hashes = self._piece(b"\n".join(held))
                cut = np.searchsorted(at, bounds)
                out += [hashes[cut[i] : cut[i + 1]] for i in range(len(held))]
                held, size = [], 0
            if text is None:
                break
            if len(text) <= PIECE:
                held.append(text)
                size += len(text) + 1
                continue
            parts, done = [], 0
            while done < len(text):
                to = min(len(text), done + PIECE)
                while to < len(text) and not self.space[text[to]]:
                    to += 1
                parts.append(self._piece(text[done:to])[1])
                done = to
            out.append(np.concatenate(parts))
        return out

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for w in self.word_hashes(texts):
            n = len(w)
            if not n:
                out.append(w)
            elif n < WORDS:
                out.append(mix((w * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n)))
            else:
                s = w[: n - 4] * _FACTORS[0]
                for k in range(1, WORDS):
                    s = s + w[k : n - 4 + k] * _FACTORS[k]
                out.append(np.unique(mix(s)))
        return out
