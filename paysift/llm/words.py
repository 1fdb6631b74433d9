"""Words of raw UTF-8 and rolling hashes over them."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from paysift.llm.common import pieces

FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = 1 << 20
#: ASCII letters to lower case; every ASCII byte but letters and digits to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def spaced_words(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space."""
    return [w for piece in pieces(raw or b"") for w in piece.split()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def text_hashes(raw: bytes | None, folded: bool = False) -> np.ndarray:
    """Hashes of all words of a text; folded: lower-cased runs of letters and digits, else words between spaces."""
    parts = []
    for piece in pieces(raw or b""):
        parts.append(word_hashes((piece.translate(ALNUM) if folded else piece).split()))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def paired_hashes(raw: bytes | None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word between spaces: the halves of a 128-bit one."""
    digest = xxhash.xxh3_128_digest
    parts = [np.frombuffer(b"".join([digest(w, salt) for w in piece.split()]), "<u8").reshape(-1, 2) for piece in pieces(raw or b"")]
    both = np.concatenate(parts) if len(parts) > 1 else parts[0]
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2**64, as many as a stretch has words."""
    inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(_STRETCH + 63, x, np.uint64)))) for x in (FACTOR, inverse))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size (at most 64) words; empty for shorter texts.

    The polynomial of each run is a difference of running sums, so the cost does not grow with size.
    """
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if n > _STRETCH:
        return np.concatenate([rolling(hashes[at : at + _STRETCH + size - 1], size) for at in range(0, n, _STRETCH)])
    up, down = _powers()
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    out = (sums[size:] - sums[:n]) * down[:n]
    out ^= out >> np.uint64(29)  # the polynomial's low bits alone would order runs by a few of their words
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every size consecutive values."""
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < size:
        step = size - span
        out = np.minimum(out[:-step], out[step:])
    return out
