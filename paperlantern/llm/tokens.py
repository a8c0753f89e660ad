"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A token is a maximal run of bytes of one class (class 0 separates).  Its hash is a
polynomial over the UTF-8 bytes, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def byte_classes(separators: bytes, **groups: bytes) -> np.ndarray:
    """Class table: ``separators`` are 0, each group a class of its own, all else 1."""
    table = np.ones(256, np.uint8)
    for number, members in enumerate(groups.values(), 2):
        table[list(members)] = number
    table[list(separators)] = 0
    return table


def folded_values() -> np.ndarray:
    """Byte values in which A-Z count as a-z."""
    values = _BYTE_VALUES.copy()
    values[65:91] = values[97:123]
    return values


def exact_values() -> np.ndarray:
    return _BYTE_VALUES


WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
WORDS = byte_classes(WHITESPACE)
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
#: Letters, digits and the rest (punctuation) are tokens of their own.
PIECES = byte_classes(WHITESPACE, letters=LETTERS, digits=DIGITS)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the next slice."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= SLICE_BYTES + 1:
            _powers[int(base)] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Tokens:
    """Tokens of consecutive texts, in order."""

    hashes: np.ndarray  # uint64, one per token
    classes: np.ndarray  # class of each token
    doc: np.ndarray  # index of its text within the slice
    first: np.ndarray  # for each text, index of its first token; one entry more than texts
    starts: np.ndarray  # byte range of each token in ``raw``
    ends: np.ndarray
    raw: np.ndarray  # the bytes of all texts of the slice
    offsets: np.ndarray  # where each text begins there; one entry more than texts


def _none(n: int) -> Tokens:
    no = np.empty(0, np.int64)
    return Tokens(np.empty(0, np.uint64), np.empty(0, np.uint8), no, np.zeros(n + 1, np.int64), no, no, np.empty(0, np.uint8), np.zeros(n + 1, np.int64))


def tokens_of(texts: pa.Array, classes: np.ndarray, values: np.ndarray) -> Tokens:
    """Tokens of an Arrow string array; a null text has none."""
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return _none(0)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[start:end] if data is not None and end > start else np.empty(0, np.uint8)
    offsets = offsets - start
    if len(raw) == 0:
        return _none(n)
    kind = classes[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    bounds = np.flatnonzero(change)
    starts, ends = bounds[:-1], bounds[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[raw] * _power(_BASE, len(raw)), out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts])
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Tokens(hashes, kind[starts], doc, first, starts, ends, raw, offsets)


def powers(n: int) -> np.ndarray:
    """Coefficients for the places 0 … n-1 of a sequence of hashes."""
    return _power(_BASE, n)


def slices(texts: pa.Array, bound: int = SLICE_BYTES):
    """(first, last) bounds of runs of texts of about ``bound`` bytes together."""
    n = len(texts)
    if n == 0:
        return
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], np.int64)[texts.offset : texts.offset + n + 1])
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > bound:
            yield begin, i
            begin, held = i, 0
        held += size
    yield begin, n
