"""Two-stage suffix sorting of byte (or small-alphabet) texts, and adjacent common prefixes.

Stage one sorts only the suffixes that are smaller than their successors (type S), directly,
by their first `depth` symbols. Stage two induces the others (type L): a scan over the
buckets of first symbols in ascending order looks at each sorted suffix i, and if i - 1 is of
type L appends it to the front part of its own bucket. Scans and appends work on whole
buckets at a time; suffixes of a run of one symbol come in rounds, one symbol a round.

Depth. Order is exact up to `depth` symbols, which is all that callers compare; suffixes with
equal first `depth` symbols may come in any order.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width (at most 8) symbols from each place as one big-endian number; past the end is 0."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = (out << np.uint64(8)) | text[at + j]
    return out


def sort_direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at, sorted by the depth symbols that start there; text has depth + 8 zero symbols after its end."""
    order = at[np.argsort(_words(text, at, 8), kind="stable")]
    done = 8
    key = _words(text, order, 8)
    tied = np.zeros(len(order), bool)
    same = key[1:] == key[:-1]
    group = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    while done < depth and len(order):
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part, g = order[where], group[where]
        key = _words(text, part + done, min(8, depth - done) if depth - done < 8 else 8)
        by = np.lexsort((key, g))
        part, key, g = part[by], key[by], g[by]
        order[where] = part
        new_same = np.zeros(len(order), bool)
        if len(part) > 1:
            new_same[where[1:]] = (g[1:] == g[:-1]) & (key[1:] == key[:-1])
        same = new_same[1:]
        group = np.concatenate(([0], np.cumsum(~same)))
        done += 8
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (uint8, symbols 1..255 and separators 0) in the order of their first depth symbols."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    # type S: smaller than the successor. A run of equal symbols has the type of its last one; the last suffix is
    # larger than the empty one after it, and a separator ends all comparisons, so it counts as S and is sorted directly.
    change = np.flatnonzero(np.diff(text) != 0)
    rise = np.zeros(n, bool)
    edge = np.append(change, n - 1)
    run = np.searchsorted(edge, np.arange(n))
    ups = np.append(text[change] < text[change + 1], False)
    rise = ups[run] | (text == 0)
    small = sort_direct(padded, np.flatnonzero(rise), depth)
    first = text[small]
    s_edge = np.searchsorted(first, np.arange(257))
    l_size = np.bincount(text[~rise], minlength=256)
    out = np.empty(n, np.int64)
    heads = [[] for _ in range(256)]  # induced parts of each bucket, in order
    if not rise[n - 1]:
        heads[text[n - 1]].append(np.array([n - 1]))  # its successor, the empty suffix, is the smallest of all
    at = 0
    for c in range(256):
        total = 0
        parts = heads[c]
        i = 0
        while i < len(parts):  # grows while runs of c are induced
            part = parts[i]
            i += 1
            out[at + total : at + total + len(part)] = part
            total += len(part)
            _induce(text, rise, part, c, heads)
        at += total
        s = small[s_edge[c] : s_edge[c + 1]]
        out[at : at + len(s)] = s
        at += len(s)
        if len(s):
            _induce(text, rise, s, c, heads)
        heads[c] = None
        assert total == l_size[c]
    return out


def _induce(text: np.ndarray, rise: np.ndarray, part: np.ndarray, c: int, heads: list) -> None:
    before = part[part > 0] - 1
    before = before[~rise[before] & (text[before] >= c)]
    if len(before):
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        edge = np.flatnonzero(np.diff(symbol)) + 1
        for p in np.split(before, edge):
            heads[text[p[0]]].append(p)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares its first depth symbols, none of them a separator, with the one before it in order."""
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    stop = np.flatnonzero(padded == 0)
    long = stop[np.searchsorted(stop, order)] - order >= depth  # symbols up to the next separator
    alike = long.copy()
    alike[:1] = False
    alike[1:] &= long[:-1]
    where = np.flatnonzero(alike)
    for j in range(0, depth, 8):
        if not len(where):
            break
        width = min(8, depth - j)
        where = where[_words(padded, order[where] + j, width) == _words(padded, order[where - 1] + j, width)]
    out = np.zeros(len(order), bool)
    out[where] = True
    return out
