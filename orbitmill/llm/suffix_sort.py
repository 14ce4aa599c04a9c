"""Two-stage suffix sorting in numpy, for the places where repeats can start.

A suffix that is smaller than its successor is sorted directly; the others
follow from one scan over the buckets of first bytes, since such a suffix has
the order of its successor within its own bucket. Orders hold for the first
``depth`` bytes, which is all that repeats of that length need.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def joined(pieces: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces one after another, bytes raised by one, a zero after each; and where each begins.

    Valid UTF-8 has no byte 0xFF, so raised bytes stay distinct.
    """
    size = np.diff(off)
    start = off[:-1] + np.arange(len(size))
    text = np.zeros(int(off[-1]) + len(size), np.uint8)
    mask = np.ones(len(text), bool)
    mask[start + size] = False
    text[mask] = np.minimum(pieces, 254) + 1
    return text, start


def eight_bytes(text: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.zeros(len(text) + room + 8, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(len(text) + room, U64)
    for i in range(8):
        out <<= U64(8)
        out |= padded[i : i + len(out)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a byte later (the last one is)."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[-1] = 1
    # equal bytes take the answer of the first place after them that differs
    place = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return rise[following] > 0


def direct_sort(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` bytes from them on."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(new)[rows]
        part = order[rows]
        key = words[part + at]
        if depth - at < 8:
            key = key >> U64(8 * (8 - depth + at))
        again = np.lexsort((key, group))
        order[rows] = part[again]
        key, group = key[again], group[again]
        differs = np.ones(len(rows), bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[rows] |= differs
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places (a mask) in the order of the ``depth`` bytes from them on."""
    rising = smaller_than_next(text)
    # a falling suffix needs its successors down to a rising one
    need = wanted.copy()
    ends = np.flatnonzero(wanted & ~rising & ~np.append(wanted[1:], False))
    if len(ends):
        to_rise = np.minimum.accumulate(np.where(rising, np.arange(len(text)), len(text))[::-1])[::-1]
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, ends, 1)
        np.add.at(change, np.minimum(to_rise[ends] + 1, len(text)), -1)
        need |= np.cumsum(change[:-1]) > 0
    direct = direct_sort(np.flatnonzero(need & rising), words, depth)
    first = text[direct]
    edge = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        falling = induced[c]
        run = falling[-1:] and np.concatenate(falling)
        scan = []
        while len(run):
            scan.append(run)
            before = run[run > 0] - 1
            run = before[need[before] & ~rising[before] & (text[before] == c)]
        scan.append(direct[edge[c] : edge[c + 1]])
        bucket = np.concatenate(scan) if len(scan) > 1 else scan[0]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & ~rising[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cut):
                induced[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def same_as_previous(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Whether each place shares a prefix of at least ``depth`` bytes (8 or more) with the one before it in order."""
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    rows = np.arange(1, len(order))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        a, b = order[rows] + at, order[rows - 1] + at
        rows = rows[words[a] == words[b]]
    same[rows] = True
    return same


def least_by_window(pieces: np.ndarray, off: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``depth`` bytes within a piece the least owner among the pieces that hold it.

    Returns these, and where each piece's windows begin (one more at the end).
    """
    size = np.diff(off)
    n = np.maximum(size - depth + 1, 0)
    edge = np.concatenate([[0], np.cumsum(n)])
    if not edge[-1]:
        return np.empty(0, np.int64), edge
    text, start = joined(pieces, off)
    words = eight_bytes(text, depth)
    place = np.repeat(start, n) + np.arange(edge[-1]) - np.repeat(edge[:-1], n)
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    number = np.zeros(len(text), np.int64)
    number[place] = np.arange(edge[-1])
    order = suffix_order(text, wanted, words, depth)
    group = np.flatnonzero(~same_as_previous(order, words, depth))
    window = number[order]
    owners = np.repeat(owner, n)
    least = np.minimum.reduceat(owners[window], group)
    out = np.empty(len(owners), np.int64)
    out[window] = np.repeat(least, np.diff(np.append(group, len(order))))
    return out, edge
