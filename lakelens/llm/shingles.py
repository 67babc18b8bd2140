"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes hashed together; a longer text is a chunk of its own.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """Keeps the powers that chunks share."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            self.up, self.down = np.full(n, _P), np.full(n, _P_INV)
            self.up[0] = self.down[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(self.up, out=self.up)
                np.cumprod(self.down, out=self.down)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word of ``data``."""
        buf = np.frombuffer(data, np.uint8)
        self._powers(len(buf) + 1)
        inside = ~_SPACE[buf]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * self.up[: len(buf)])])
            return start, mix((total[end] - total[start]) * self.down[start])

    def sets(self, texts: list[str | None], width: int) -> list[np.ndarray]:
        """Sorted distinct shingle hashes (int64) of each text; a text of fewer words is one shingle; none without words."""
        out: list[np.ndarray] = []
        at = 0
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        while at < len(data):
            stop, size = at, 0
            while stop < len(data) and (stop == at or size + len(data[stop]) < CHUNK):
                size += len(data[stop]) + 1
                stop += 1
            out += self._chunk(data[at:stop], width)
            at = stop
        return out

    def _chunk(self, data: list[bytes], width: int) -> list[np.ndarray]:
        start, h = self.words(b" ".join(data))
        first = np.cumsum([0] + [len(d) + 1 for d in data])
        border = np.searchsorted(start, first)
        with np.errstate(over="ignore"):
            n = len(h) - width + 1
            s = np.zeros(max(0, n), np.uint64)
            for k in range(width if n > 0 else 0):
                s += h[k : k + n] * _PLACE[k]
            s = mix(s).view(np.int64)
            out = []
            for i in range(len(data)):
                a, b = border[i], border[i + 1]
                if b - a >= width:
                    out.append(np.unique(s[a : b - width + 1]))
                elif b > a:  # whole sequence, told apart from others by its length
                    out.append(mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(b - a) * 0x632BE59BD9B4E019 % (1 << 64))).view(np.int64))
                else:
                    out.append(np.zeros(0, np.int64))
            return out
