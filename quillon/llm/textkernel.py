"""Vectorised text kernels shared by the word-level operators.

Texts arrive as Arrow string arrays; everything below works on the raw UTF-8
buffer with numpy, so no Python object is made per word.  Words are maximal
runs of bytes other than ``\\x20 \\x09-\\x0D``, with A-Z lower-cased; a word is
known by a 64-bit hash of its bytes.  Null and empty texts have no words.

The hash is a polynomial over random byte codes modulo 2**64, finished by a
bit mixer.  Two different words share a hash with probability about 2**-64 a
pair; with 10**9 distinct words, one such pair is expected in 37 runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes hashed at a time: bounds the scratch memory to about 40 MB

_rng = np.random.default_rng(20240607)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _power or len(_power["up"]) < n:
        m = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", _INV)):
            out = np.full(m, base, dtype=np.uint64)
            out[0] = 1
            _power[name] = np.multiply.accumulate(out)
    return _power["up"], _power["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)  # a text begins here
    begins[at] = True
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | begins[1:-1]
    last = word
    last[:-1] &= space[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at, side="left")


def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (one more entry at the end)."""
    raw, at = buffers(texts)
    out, counts, k = [], [np.zeros(1, np.int64)], 0
    while k < len(at) - 1:
        j = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, side="right")) - 1)
        part = raw[at[k] : at[j]]
        starts, ends, before = spans(part, at[k : j + 1] - at[k])
        out.append(_hash(part, starts, ends))
        counts.append(np.diff(before))
        k = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash for each position from the hashes of its parts, in order."""
    with np.errstate(over="ignore"):
        h = np.full(1, len(parts), dtype=np.uint64)
        for i, p in enumerate(parts):
            h = mix((h ^ p) * _STEP[i % len(_STEP)] + np.uint64(i + 1))
    return h


def shingles(tokens: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, with repeats; a text of fewer words gives its whole sequence as one, a text without words none.

    Returns the hashes in text order and where each text's begin.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    out = np.empty(begin[-1], dtype=np.uint64)
    long = np.flatnonzero(n >= size)
    if len(long):
        c = count[long]
        row = np.repeat(at[long] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        to = np.repeat(begin[long] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        out[to] = chain(*(tokens[row + i] for i in range(size)))
    for m in range(1, size):
        if len(short := np.flatnonzero(n == m)):
            out[begin[short]] = chain(*(tokens[at[short] + i] for i in range(m)))
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, once each."""
    out, count = [], np.zeros(len(begin), np.int64)
    for i in range(len(begin) - 1):
        own = np.sort(values[begin[i] : begin[i + 1]])
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        out.append(own)
        count[i + 1] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(count)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch of about ``most`` bytes of text each (one row at least)."""
    texts = batch.column(column)
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    k = 0
    while k < batch.num_rows:
        j = max(k + 1, int(np.searchsorted(size, size[k] + most, side="right")) - 1)
        yield batch.slice(k, j - k)
        k = j


_LOWER, _UPPER, _DIGIT, _HIGH = (np.isin(np.arange(256), list(r)) for r in (range(97, 123), range(65, 91), range(48, 58), range(128, 256)))
_PLAIN = _LOWER | _UPPER | _DIGIT | _HIGH


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What kinds of bytes each word has: lower case, upper case, several upper case, digits, other letters; its length in steps; its last two bytes where they are punctuation."""
    def count(kind):
        total = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int32)])
        return total[ends] - total[starts]

    upper, code = count(_UPPER), np.zeros(len(starts), np.uint64)
    for i, bit in enumerate((count(_LOWER) > 0, upper > 0, upper > 1, count(_DIGIT) > 0, count(_HIGH) > 0)):
        code |= bit.astype(np.uint64) << np.uint64(i)
    length = ends - starts
    code |= np.digitize(length, [2, 4, 20, 40]).astype(np.uint64) << np.uint64(8)
    last = raw[ends - 1]
    before = raw[np.maximum(ends - 2, starts)]
    code |= np.where(_PLAIN[last], 0, last).astype(np.uint64) << np.uint64(16)
    code |= np.where(_PLAIN[before] | _PLAIN[last] | (length < 2), 0, before).astype(np.uint64) << np.uint64(24)
    return code


def words_and_shapes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`words`, with a code of each word's shape."""
    raw, at = buffers(texts)
    hashes, shapes, counts, k = [], [], [np.zeros(1, np.int64)], 0
    while k < len(at) - 1:
        j = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, side="right")) - 1)
        part = raw[at[k] : at[j]]
        starts, ends, before = spans(part, at[k : j + 1] - at[k])
        hashes.append(_hash(part, starts, ends))
        shapes.append(_shapes(part, starts, ends))
        counts.append(np.diff(before))
        k = j
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(hashes), join(shapes), np.cumsum(np.concatenate(counts))
