"""Edit distances of many pairs at once, in numpy, behind common ends; and of single pairs in whole numbers."""

from __future__ import annotations

import numpy as np

from massloom.llm.textcols import U64

#: Shorter sides are grouped by the blocks of 64 characters that they need; longer ones, and groups of few pairs (LEAST_PAIRS for each block and four more), are compared pair by pair.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
LEAST_PAIRS = 8
#: Entries of a group's table of places (8 bytes each).
MOST_TABLE = 1 << 22


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


#: Characters of a text that must be found again in the other one, and how far they may be from the place where both differ.
ANCHOR, FAR = 10, 128


def bound(a: str, b: str, most: int) -> int:
    """No less than the edit distance, found by following equal stretches and looking for the next one a little further on; may end early beyond `most`."""
    i = j = total = 0
    n, m = len(a), len(b)
    while total <= most:
        size = 32
        while a[i : i + size] == b[j : j + size] and i + size < n and j + size < m:
            i, j, size = i + size, j + size, size * 2
        k = common(a[i : i + size], b[j : j + size])
        i, j = i + k, j + k
        for off in (0, 1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96):
            probe = a[i + off : i + off + ANCHOR]
            at = b.find(probe, j, j + off + FAR) if len(probe) == ANCHOR else -1
            if at >= 0:
                break
        else:
            return total + max(n - i, m - j)
        total += max(off, at - j)
        i, j = i + off, at
    return total


def stripped(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end, the shorter first."""
    k = common(a, b)
    a, b = a[k:], b[k:]
    k = common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    return (a, b) if len(a) <= len(b) else (b, a)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`; bit-parallel, one column of the distance table in a whole number."""
    a, b = stripped(a, b)
    if len(b) <= most:
        return True
    if len(b) - len(a) > most or not a:
        return False
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    up, down, distance = full, 0, len(a)
    for k, c in enumerate(b, 1):
        equal = places.get(c, 0)
        vertical = equal | down
        horizontal = ((equal & up) + up ^ up) | equal
        more, less = down | (full & ~(horizontal | up)), up & horizontal
        distance += 1 if more & last else -1 if less & last else 0
        if distance - (len(b) - k) > most:
            return False
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(vertical | more)), more & vertical
    return distance <= most


def _codes(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    return alphabet[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]


def _group(pairs: list[tuple[str, str]], most: np.ndarray, blocks: int, alphabet: np.ndarray, many: int) -> np.ndarray:
    """The same for pairs (shorter, longer), the longer ones descending in length, whose shorter sides fit into `blocks` blocks of 64 characters.

    Equal filling behind both sides of a pair leaves their distance as it is, so all shorter sides end where their last block does.
    """
    n, size, long_ = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    fill = 64 * blocks - size
    row, place = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    table = np.zeros((n, many + 1, blocks), U64)  # the last letter is the filling
    at = (row * (many + 1) + _codes([a for a, _ in pairs], alphabet)) * blocks + (place >> 6)
    np.add.at(table.reshape(-1), at, U64(1) << (place & 63).astype(U64))
    for w in range(blocks):
        free = np.clip(64 * (w + 1) - size, 0, 64)
        table[:, many, w] = np.where(free == 64, ~U64(0), ~(~U64(0) >> np.minimum(free, 63).astype(U64)))
    row, place = np.repeat(np.arange(n), long_), np.arange(long_.sum()) - np.repeat(np.cumsum(long_) - long_, long_)
    code = np.full((int((long_ + fill).max()), n), many, np.int32)
    code[place, row] = _codes([b for _, b in pairs], alphabet)
    code += np.arange(n, dtype=np.int32) * (many + 1)
    table, columns = table.reshape(n * (many + 1), blocks), long_ + fill
    order = np.argsort(-columns, kind="stable")  # pairs that are through leave at the end
    code, columns = code[:, order], columns[order]
    up, down, score = np.full((blocks, n), ~U64(0)), np.zeros((blocks, n), U64), np.full(n, 64)  # score: at the foot of the last block that the band has reached
    foot, reach, one, top = 0, int(most.max()), U64(1), U64(63)
    k = n
    for j in range(int(columns[0])):
        while columns[k - 1] <= j:
            k -= 1
        low, high = max(0, j - reach) >> 6, min(blocks - 1, j + reach + 1 >> 6)
        if foot < high:  # a block begins as if each of its rows was one more than the row before
            score = score + 64 * (high - foot)
            foot = high
        equal = table[code[j, :k], low : foot + 1]
        more_in, less_in = one, U64(0)  # at the band's upper edge each column is one more than the one before
        for w in range(low, foot + 1):
            eq, u, d = equal[:, w - low], up[w, :k], down[w, :k]
            vertical = eq | d
            eq = eq | less_in
            horizontal = eq & u
            horizontal += u
            horizontal ^= u
            horizontal |= eq
            less = u & horizontal
            horizontal |= u
            np.invert(horizontal, out=horizontal)
            more = np.bitwise_or(horizontal, d, out=horizontal)
            more_out, less_out = more >> top, less >> top
            more <<= one
            more |= more_in
            less <<= one
            less |= less_in
            np.bitwise_and(more, vertical, out=d)
            vertical |= more
            np.invert(vertical, out=vertical)
            np.bitwise_or(less, vertical, out=u)
            more_in, less_in = more_out, less_out
        score[:k] += more_in.astype(np.int64) - less_in.astype(np.int64)
    out = np.zeros(n, bool)
    out[order] = score <= most[order]
    return out


def bounded(pairs: list[tuple[str, str]], most: list[int]) -> tuple[np.ndarray, list[tuple[int, tuple[str, str]]]]:
    """Which pairs are found to be within `most` by a bound; those that still may be, by number, stripped."""
    out, rest = np.zeros(len(pairs), bool), []
    for k, ((a, b), m) in enumerate(zip(pairs, most)):
        if abs(len(a) - len(b)) <= m and bound(a, b, m) <= m:  # so are most pairs that are near
            out[k] = True
            continue
        a, b = stripped(a, b)
        if len(b) <= m:
            out[k] = True
        elif a and len(b) - len(a) <= m:
            rest.append((k, (a, b)))
    return out, rest


def all_within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """Whether each pair's edit distance is at most its `most`."""
    out, rest = bounded(pairs, most)
    return out | distances_within(rest, most)


def distances_within(pairs: list[tuple[int, tuple[str, str]]], most: list[int]) -> np.ndarray:
    """Of numbered pairs (shorter, longer) whether the distance is at most most[number]; the others are False. The more pairs of like length there are, the less each costs."""
    out = np.zeros(len(most), bool)
    rest: dict[int, list[tuple[int, int, tuple[str, str]]]] = {}
    for k, (a, b) in pairs:
        blocks = (len(a) + 63) // 64
        rest.setdefault(next((x for x in CLASSES if x >= blocks), 0), []).append((len(b), k, (a, b)))
    alone = rest.pop(0, [])
    for blocks, found in rest.items():
        points = np.frombuffer("".join(a + b for *_, (a, b) in found).encode("utf-32-le"), np.uint32)
        alphabet = np.zeros(int(points.max()) + 1, np.int32)
        alphabet[points] = 1
        many = int(alphabet.sum())
        alphabet = np.cumsum(alphabet, dtype=np.int32) - 1
        found.sort(reverse=True)
        step = MOST_TABLE // (blocks * (many + 1))
        least = LEAST_PAIRS * (4 + blocks)  # what a group costs however few pairs it has grows with its blocks
        at = 0
        while len(found) - at >= least and step >= least:
            part = found[at : at + step]
            own = np.array([k for _, k, _ in part])
            out[own] = _group([p for *_, p in part], np.array([most[k] for k in own]), blocks, alphabet, many)
            at += step
        found = found[at:]
        alone += found
    for _, k, (a, b) in alone:
        out[k] = within(a, b, most[k])
    return out
