"""Whole texts as numpy arrays: code points, word spans, word and shingle hashes.

All helpers work on a group of texts at once and take memory in proportion to the
group, so callers cut a batch into groups of about ``GROUP_CHARS`` characters. A text
longer than that is a group of its own; no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

GROUP_CHARS = 1 << 18

_U64 = np.uint64
#: Odd numbers, so that their powers can be divided by modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def groups(texts: Sequence[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold up to ``limit`` characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str], separator: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, each text followed by ``separator``, and where each text starts.

    The second array has one entry more than there are texts.
    """
    points = np.frombuffer((separator.join(texts) + separator).encode("utf-32-le"), dtype="<u4")
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)))


@lru_cache(maxsize=8)
def _powers(size: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (start, pow(start, -1, 1 << 64)):
            power = np.full(size, base, dtype=_U64)
            power[0] = 1
            out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> _U64(27))) * _U64(0x94D049BB133111EB)
    return values ^ (values >> _U64(31))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of ``symbols``, equal for equal content at any place.

    One running sum of ``symbol * base ** place`` (modulo 2**64) serves all spans: a
    difference of two sums, divided by the base's power at the start. ``second`` gives
    another, independent hash.
    """
    size = 1 << max(int(len(symbols)).bit_length(), 10)
    power, inverse = _powers(size, _BASES[second])
    with np.errstate(over="ignore"):
        running = np.zeros(len(symbols) + 1, dtype=_U64)
        np.cumsum((symbols.astype(_U64) + _U64(1)) * power[: len(symbols)], out=running[1:])
        hashed = (running[ends] - running[starts]) * inverse[starts]
    return mix(hashed ^ (ends - starts).astype(_U64))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each text, repeats included.

    ``words`` are word hashes, text ``i`` has those from ``offsets[i]`` to
    ``offsets[i + 1]``. A text of fewer words has one shingle, its whole sequence; a text
    without words has none. Returns the hashes and their offsets.
    """
    counts = np.diff(offsets)
    padded = np.concatenate((words, np.zeros(n, dtype=_U64)))
    factors = mix(np.arange(1, n + 1, dtype=_U64)) | _U64(1)
    kept = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(kept)))
    first = np.repeat(offsets[:-1] - out_offsets[:-1], kept) + np.arange(out_offsets[-1])
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), dtype=_U64)
        for k in range(n):
            total += padded[k : k + len(words)] * factors[k]
        values = total[first]
        short = np.flatnonzero((counts < n) & (counts > 0))
        for i in short:
            values[out_offsets[i]] = (words[offsets[i] : offsets[i + 1]] * factors[: counts[i]]).sum(dtype=_U64)
    return mix(values), out_offsets


@lru_cache(maxsize=1)
def alphanumeric() -> np.ndarray:
    """For every code point, whether it is a letter or a digit."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    return np.fromiter(map(str.isalnum, points.tobytes().decode("utf-32-le")), dtype=bool, count=0x110000)


def word_hashes(texts: Sequence[str], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and the texts' offsets in them.

    ``is_word`` tells for each code point whether it belongs to a word; a word is a
    longest run of such code points. NUL must not be one: it separates the texts.
    """
    points, text_starts = code_points(texts, "\0")
    starts, ends = spans(is_word[points])
    return span_hashes(points, starts, ends), np.searchsorted(starts, text_starts)
