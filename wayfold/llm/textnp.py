"""Words of Arrow text columns as numpy arrays: spans, 64-bit hashes, and slices of bounded size.

Bytes are taken as they are (UTF-8); white space is ASCII, so words never cut a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits: tokens are then blind to case and punctuation.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes that one slice holds, unless a single text is longer.
SLICE = 2 << 20
#: Bytes that are hashed at once, unless a single word is longer.
HASH_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves half the bits of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def combine(*hs: np.ndarray) -> np.ndarray:
    """One hash of several, in their order."""
    out = np.full(len(hs[0]), 0x243F6A8885A308D3, np.uint64)
    for h in hs:
        out = mix(out * _BASE + h)
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size text bytes; no text is split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of all words."""
    word = ~space[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, A-Z as a-z if lower."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()) - 1, _BASE, np.uint64))))
    code = _CODE[LOWER] if lower else _CODE
    out = np.empty(len(size), np.uint64)
    upto = np.cumsum(size)
    # the numbers at work are some thirty times the bytes, so few bytes are taken at once
    cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(HASH_BYTES, int(upto[-1]), HASH_BYTES), "right"), [len(size)])))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = size[lo:hi]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        out[lo:hi] = np.add.reduceat(code[data[at + np.repeat(start[lo:hi], n)]] * power[at], first)
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def column(batch, name: str):
    """A column of a batch or table by name, also where other columns have clashing names."""
    return batch.column(batch.schema.get_field_index(name))
