"""Word shingles of whole texts as 64-bit hashes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


#: A value for each byte, A-Z like a-z; which bytes are white space.
_VALUES = _constants(11, 256)
_VALUES[65:91] = _VALUES[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: The same for words of letters and digits; all bytes beyond ASCII belong to words.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = int(_constants(12, 1)[0])
_BACK = pow(_BASE, -1, 1 << 64)
_TURNS = _constants(13, 64)
_powers = {_BASE: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(raw: np.ndarray, belongs: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of UTF-8 bytes; A-Z count as a-z.  ``belongs`` says which bytes do."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = belongs[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_BACK, len(raw) + 1)[starts]), starts, ends


def pieces(texts: list[str | None], size: int = 1 << 19, most: int = 512, end: bytes = b" ") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in runs of about ``size`` bytes and at most ``most`` texts, each followed by ``end``: number of the first, all bytes, where each text starts."""
    first, held, total = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass") + end
        held.append(raw)
        total += len(raw)
        if total >= size or len(held) == most or k == len(texts) - 1:
            lengths = np.array([len(x) for x in held])
            yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths
            first, held, total = k + 1, [], 0


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and how many each text has.

    A text of fewer words than ``width`` has one shingle of all its words; one without words none.
    """
    hashes, starts, _ = words_of(raw)
    owner = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(at))
    first = np.cumsum(n_words) - n_words
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.uint64), counts
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    whole = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        whole += padded[k : k + len(hashes)] * _TURNS[k]
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    found = whole[np.repeat(first, counts) + inside]
    for doc in np.flatnonzero((n_words > 0) & (n_words < width)):
        own, n = hashes[first[doc] : first[doc] + n_words[doc]], int(n_words[doc])
        found[int(counts[:doc].sum())] = np.append(own * _TURNS[:n], _TURNS[width + n]).sum(dtype=np.uint64)
    return mixed(found), counts


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    return np.unique(shingle_hashes(raw, np.zeros(1, np.int64), width)[0])
