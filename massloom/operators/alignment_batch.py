"""The alignment kernel for many pairs at once: anti-diagonals of all of a batch's pairs as numpy arrays.

Same scores, paths and ties as `alignment.align`, cell by cell; sequences of several possible masses (B, Z, uncertain modifications) and very few or very long pairs
go through that function itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from massloom.operators.alignment import TYPES, Alignment, Residues, Scoring, align, residues

_NONE, _D, _I, _EQUAL, _OTHER, _SAME, _SINGLE, _BLOCK = range(8)
_NAMES = {_D: ("D", 1, 0), _I: ("I", 0, 1), _EQUAL: ("=", 1, 1), _OTHER: ("X", 1, 1), _SAME: ("m", 1, 1), _SINGLE: ("i", 1, 1)}
_LETTERS = "ARNDCQEGHILKMFPSTWYVBZJUOX"
_PLACE = {c: k for k, c in enumerate(_LETTERS)}
#: Kinds of residue (letter and modifications) whose multisets fit in one 63-bit number.
_KINDS = 26


def letter_scores(scoring: Scoring) -> np.ndarray:
    """The matrix over the letters and, last, the filling, which scores low with all."""
    out = np.full((len(_LETTERS) + 1,) * 2, -100, np.int64)
    for (a, b), v in scoring.matrix.items():
        out[_PLACE[a], _PLACE[b]] = v
    return out


class Table:
    """Sequences as padded arrays: letters, masses (of those with one mass each), kinds and lengths."""

    def __init__(self, own: Sequence[Residues], kinds: dict[tuple, int]):
        self.own = own
        self.length = np.array([len(r.letters) for r in own], np.int64)
        wide = int(self.length.max(initial=0))
        self.letters = np.full((len(own), wide), len(_LETTERS), np.int64)
        self.mass = np.full((len(own), wide), np.nan)
        self.kind = np.zeros((len(own), wide), np.int64)
        self.modified = np.zeros((len(own), wide), bool)
        self.single = np.array([all(len(m) == 1 for m in r.masses) for r in own], bool)
        for k, r in enumerate(own):
            n = len(r.letters)
            self.letters[k, :n] = [_PLACE[c] for c in r.letters]
            self.kind[k, :n] = [kinds.setdefault((c, m), len(kinds)) for c, m in zip(r.letters, r.modifications)]
            self.modified[k, :n] = [bool(m) for m in r.modifications]
            if self.single[k]:
                self.mass[k, :n] = [m[0] for m in r.masses]


def _sums(x: np.ndarray, size: int) -> np.ndarray:
    """Of each `size` neighbours in a row, added one by one from the left."""
    out = x[:, : x.shape[1] - size + 1].copy()
    for k in range(1, size):
        out = out + x[:, k : x.shape[1] - size + 1 + k]
    return out


def _batch(a: Table, ai: np.ndarray, b: Table, bi: np.ndarray, kind: str, scoring: Scoring, steps: int, paths: bool, kinds: int) -> tuple[np.ndarray, list[Alignment]]:
    ends, gap, start = TYPES[kind], scoring.gap_extend, scoring.gap_start
    n_own, m_own = a.length[ai], b.length[bi]
    n, m, size = int(n_own.max()), int(m_own.max()), len(ai)
    la, lb, ma, mb = a.letters[ai, :n], b.letters[bi, :m], a.mass[ai, :n], b.mass[bi, :m]
    table = letter_scores(scoring)
    # places first, pairs last, so that each operation runs over a row of memory
    same = (la[:, :, None] == lb[:, None, :]).transpose(1, 2, 0)
    gain = table[la[:, :, None], lb[:, None, :]].transpose(1, 2, 0)
    near = (np.abs(ma[:, :, None] - mb[:, None, :]) <= np.abs(ma)[:, :, None] * (scoring.ppm / 1e6)).transpose(1, 2, 0)
    other = {"database_to_peptide": b.modified[bi, None, :m], "peptide_to_database": a.modified[ai, :n, None]}.get(scoring.pair)
    heavier = same & ~near & np.broadcast_to(other, (size, n, m)).transpose(1, 2, 0) if other is not None else np.zeros_like(same)
    code = np.where(near, np.where(same, _EQUAL, _SINGLE), np.where(heavier, _SAME, _OTHER)).astype(np.int16)
    pair = np.where(near, np.where(same, gain, scoring.mass_base + scoring.isobaric), gain + np.where(heavier, scoring.mass_mismatch, scoring.mismatch)).astype(np.int32)
    blocks = []
    if n and m:
        weight = np.array([(steps + 1) ** k for k in range(kinds)], np.int64)
        wa, wb = weight[a.kind[ai, :n]], weight[b.kind[bi, :m]]
        for p in range(1, min(steps, n) + 1):
            for q in range(1, min(steps, m) + 1):
                if p == q == 1:
                    continue
                own, other = _sums(ma, p), _sums(mb, q)
                k, x, y = np.nonzero(np.abs(own[:, :, None] - other[:, None, :]) <= (np.abs(own) * (scoring.ppm / 1e6))[:, :, None])
                turned = _sums(wa, p)[k, x] == _sums(wb, q)[k, y] if p == q else np.zeros(len(k), bool)
                gains = np.where(turned, scoring.mass_base + scoring.rotated * p, scoring.mass_base + scoring.isobaric * (p + q) // 2)
                blocks.append((x + p + y + q, x + p, k, x, y, gains, _BLOCK + 2 * ((p - 1) * steps + q - 1) + turned))
    # the few blocks that agree, by the anti-diagonal on which they end; smaller ones first
    blocks = [np.concatenate(x) for x in zip(*blocks)] if blocks else [np.zeros(0, np.int64)] * 7
    order = np.argsort(blocks[0], kind="stable")
    blocks = [x[order] for x in blocks]
    bounds = np.searchsorted(blocks[0], np.arange(n + m + 2))
    score = np.zeros((n + 1, m + 1, size), np.int32)
    step = np.zeros((n + 1, m + 1, size), np.int16)
    if ends.left in ("both", "a"):
        score[1:, 0], step[1:, 0] = (start + gap * np.arange(1, n + 1))[:, None], _D
    if ends.left in ("both", "b"):
        score[0, 1:], step[0, 1:] = (start + gap * np.arange(1, m + 1))[:, None], _I
    top, top_i, top_j = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        best = score[i - 1, j] + np.where(step[i - 1, j] == _D, gap, gap + start)
        how = np.full(best.shape, _D, np.int16)
        right = score[i, j - 1] + np.where(step[i, j - 1] == _I, gap, gap + start)
        more = right > best
        best, how = np.where(more, right, best), np.where(more, np.int16(_I), how)
        across = score[i - 1, j - 1] + pair[i - 1, j - 1]
        more = across > best
        best, how = np.where(more, across, best), np.where(more, code[i - 1, j - 1], how)
        if bounds[d + 1] > bounds[d]:
            _, to, k, x, y, gains, name = (v[bounds[d] : bounds[d + 1]] for v in blocks)
            to = to - i[0]
            got = score[x, y, k] + gains
            more = np.flatnonzero((how[to, k] != _EQUAL) & (got > best[to, k]))
            more = more[np.lexsort((-name[more], got[more]))]  # of a cell's blocks the best one is written last, of equal ones the smallest
            best[to[more], k[more]], how[to[more], k[more]] = got[more], name[more]
        if ends.right == "none":
            own = np.where((i[:, None] <= n_own) & (j[:, None] <= m_own), best, -1)
            last = len(i) - 1 - own[::-1].argmax(0)  # of equal ones the one of largest i
            most, li = own[last, np.arange(size)], i[last]
            better = (most > top) | ((most == top) & ((li > top_i) | ((li == top_i) & (d - li > top_j))))
            top, top_i, top_j = np.where(better, most, top), np.where(better, li, top_i), np.where(better, d - li, top_j)
        if ends.left == "none":
            best, how = np.where(best > 0, best, 0), np.where(best > 0, how, np.int16(_NONE))
        score[i, j], step[i, j] = best, how
    each = np.arange(size)
    ti, tj = n_own, m_own
    if ends.right == "none":
        ti, tj = top_i, top_j
    elif ends.right in ("b", "either"):
        column = np.where(np.arange(n + 1)[:, None] <= n_own, score[:, m_own, each], np.iinfo(np.int32).min)
        ti = n - column[::-1].argmax(0)
        if ends.right == "either":
            row = np.where(np.arange(m + 1)[:, None] <= m_own, score[n_own[None, :], np.arange(m + 1)[:, None], each[None, :]], np.iinfo(np.int32).min)
            k = m - row[::-1].argmax(0)
            by_b = score[ti, m_own, each] >= score[n_own, k, each]
            ti, tj = np.where(by_b, ti, n_own), np.where(by_b, m_own, k)
    total = np.where(step[ti, tj, each] == _NONE, 0, score[ti, tj, each]).astype(np.int64)
    out = []
    diagonal = table.diagonal()
    for k in each if paths else ():
        x, y, path = int(ti[k]), int(tj[k]), []
        while (s := int(step[x, y, k])) != _NONE:
            if s >= _BLOCK:
                p, q = divmod((s - _BLOCK) // 2, steps)
                name, p, q = "ir"[(s - _BLOCK) % 2], p + 1, q + 1
            else:
                name, p, q = _NAMES[s]
            path.append((name, p, q, int(score[x, y, k]) - int(score[x - p, y - q, k])))
            x, y = x - p, y - q
        most = int(diagonal[la[k, x : int(ti[k])]].sum()) + int(diagonal[lb[k, y : int(tj[k])]].sum())
        out.append(Alignment(x, y, path[::-1], int(total[k]) if path else 0, int(most / 2)))
    return total, out


def align_rows(a: Table, ai: np.ndarray, b: Table, bi: np.ndarray, kind: str, scoring: Scoring, steps: int, kinds: int, paths: bool = True, cells: int = 600_000, few: int = 6) -> tuple[np.ndarray, list[Alignment]]:
    """Scores (and alignments) of the pairs of rows ai of a and bi of b. kinds: how many kinds of residue both tables have."""
    score, out = np.zeros(len(ai), np.int64), [None] * len(ai)
    plain = a.single[ai] & b.single[bi] & (kinds <= _KINDS) & (steps <= 4)
    alone = np.flatnonzero(~plain).tolist()
    many = np.flatnonzero(plain)
    many = many[np.lexsort((b.length[bi[many]], a.length[ai[many]]))]
    at = 0
    while at < len(many):
        to = at + 1
        wide = max(1, int(a.length[ai[many[at]]])) * max(1, int(b.length[bi[many[at]]]))
        while to < len(many):
            more = max(wide, int(a.length[ai[many[to]]]) * int(b.length[bi[many[at:to + 1]]].max())) if to - at < 64 else int(a.length[ai[many[to]]]) * int(b.length[bi[many[at:to + 1]]].max())
            if max(more, 1) * (to + 1 - at) > cells:
                break
            wide, to = more, to + max(1, min(len(many) - to, (to - at) // 2))
        of = many[at:to]
        if len(of) < few:
            alone += of.tolist()
        else:
            got, found = _batch(a, ai[of], b, bi[of], kind, scoring, steps, paths, kinds)
            score[of] = got
            for k, al in zip(of, found):
                out[k] = al
        at = to
    for k in alone:
        out[k] = align(a.own[ai[k]], b.own[bi[k]], kind, scoring, steps)
        score[k] = out[k].score
    return score, out


def _agreeing_blocks(a: Table, ai: np.ndarray, b: Table, bi: np.ndarray, scoring: Scoring, steps: int) -> tuple[np.ndarray, ...]:
    """Of rows ai of a and bi of b, all blocks of more than a residue on one side that agree: places in ai and bi, ends and sizes on both sides, and gains."""

    def every(t: Table, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        found = []
        for p in range(1, min(steps, t.mass.shape[1]) + 1):
            k, at = np.nonzero(np.arange(p, t.mass.shape[1] + 1) <= t.length[rows, None])
            found.append((k, at + p, np.full(len(k), p), _sums(t.mass[rows], p)[k, at]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)

    (ka, to_a, p, x), (kb, to_b, q, y) = every(a, ai), every(b, bi)
    (mass_a, of_a), (mass_b, of_b) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    wide = np.abs(mass_a) * (scoring.ppm / 1e6)
    low, high = np.searchsorted(mass_b, mass_a - wide * 1.001 - 1e-9, "left"), np.searchsorted(mass_b, mass_a + wide * 1.001 + 1e-9, "right")
    one, other = _ranges(low, high)
    near = np.abs(mass_a[one] - mass_b[other]) <= wide[one]
    one, other = one[near], other[near]
    # for each two masses that agree, the blocks of the one by those of the other
    order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
    many_a, many_b = np.bincount(of_a, minlength=len(mass_a)), np.bincount(of_b, minlength=len(mass_b))
    at_a, at_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    which, place = _ranges(at_a[one], at_a[one] + many_a[one])
    left, (of, right) = order_a[place], _ranges(at_b[other[which]], (at_b + many_b)[other[which]])
    left, right = left[of], order_b[right]
    more = (p[left] > 1) | (q[right] > 1)
    left, right = left[more], right[more]
    p, q, ka, kb, to_a, to_b = p[left], q[right], ka[left], kb[right], to_a[left], to_b[right]
    turned = np.zeros(len(p), bool)
    for size in range(2, steps + 1):
        of = np.flatnonzero((p == size) & (q == size))
        if len(of):
            own = [np.sort(t.kind[rows[k[of]][:, None], to[of][:, None] - size + np.arange(size)], axis=1) for t, rows, k, to in ((a, ai, ka, to_a), (b, bi, kb, to_b))]
            turned[of] = (own[0] == own[1]).all(1)
    return ka, kb, to_a, to_b, p, q, np.where(turned, scoring.mass_base + scoring.rotated * p, scoring.mass_base + scoring.isobaric * (p + q) // 2)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each number in it, of all ranges in turn."""
    many = high - low
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many - low, many)


def _all_scores(a: Table, ai: np.ndarray, b: Table, bi: np.ndarray, kind: str, scoring: Scoring, steps: int) -> np.ndarray:
    """Scores of each row ai of a with each row bi of b, cell by cell for all these pairs at once; blocks that agree are few and come as a list."""
    ends, gap, start = TYPES[kind], scoring.gap_extend, scoring.gap_start
    n_own, m_own = a.length[ai], b.length[bi]
    n, m, shape = int(n_own.max()), int(m_own.max()), (len(ai), len(bi))
    size = len(ai) * len(bi)
    # residues of equal letter, modification and mass are a class; what a pair of residues gains depends on their classes
    (class_a, letter_a, mass_a, modified_a), (class_b, letter_b, mass_b, modified_b) = (_classes(t, rows, wide) for t, rows, wide in ((a, ai, n), (b, bi, m)))
    table = letter_scores(scoring)[letter_a[:, None], letter_b]
    with np.errstate(invalid="ignore"):
        near = np.abs(mass_a[:, None] - mass_b) <= np.abs(mass_a)[:, None] * (scoring.ppm / 1e6)
    same = letter_a[:, None] == letter_b
    other = {"database_to_peptide": modified_b[None, :], "peptide_to_database": modified_a[:, None]}.get(scoring.pair, False)
    pair = np.where(near, np.where(same, table, scoring.mass_base + scoring.isobaric), table + np.where(same & other, scoring.mass_mismatch, scoring.mismatch)).astype(np.int32)
    equal = near & same

    ka, kb, to_a, to_b, p, q, gains = _agreeing_blocks(a, ai, b, bi, scoring, steps)
    at = ka * len(bi) + kb
    cell = to_a * (m + 1) + to_b
    order = np.argsort(cell, kind="stable")
    at, cell, gains = at[order], cell[order], gains[order]
    before = cell - (p * (m + 1) + q)[order]
    # where residues are equal and pairing them is best, no block counts
    ends_equal = equal[class_a[ka, to_a - 1], class_b[kb, to_b - 1]][order] if len(ka) else np.zeros(0, bool)
    bounds = np.searchsorted(cell, np.arange((n + 1) * (m + 1) + 1))

    score = np.zeros((n + 1, m + 1, size), np.int32)
    flat = score.reshape(-1)
    down = np.full((m + 1, size), gap + start, np.int32)  # of each cell in the row above, its score with a gap behind it
    if ends.left in ("both", "a"):
        score[1:, 0] = (start + gap * np.arange(1, n + 1))[:, None]
    if ends.left in ("both", "b"):
        score[0, 1:] = (start + gap * np.arange(1, m + 1))[:, None]
        down[1:] += score[0, 1:]
    top = np.zeros(size, np.int32)
    is_n, is_m = np.repeat(n_own, len(bi)), np.tile(m_own, len(ai))
    columns = np.ascontiguousarray(class_b.T)
    for i in range(1, n + 1):
        rows = pair[class_a[:, i - 1]]
        right = score[i, 0] + (gap + start)
        for j in range(1, m + 1):
            above = down[j]
            best = np.maximum(above, right)
            across = score[i - 1, j - 1] + rows.take(columns[j - 1], axis=1).reshape(-1)
            straight = across > best
            vertical = above >= right
            np.maximum(best, across, out=best)
            of = slice(bounds[i * (m + 1) + j], bounds[i * (m + 1) + j + 1])
            if of.stop > of.start:
                own = at[of]
                got = flat[before[of] * size + own] + gains[of].astype(np.int32)
                more = (got > best[own]) & ~(ends_equal[of] & straight[own])
                own, got = own[more], got[more]
                np.maximum.at(best, own, got)
                straight[own] = True
            if ends.right == "none":
                np.maximum(top, np.where((i <= is_n) & (j <= is_m), best, 0), out=top)
            if ends.left == "none":
                straight |= best <= 0
                np.maximum(best, 0, out=best)
            score[i, j] = best
            opened = best + (gap + start)
            down[j] = opened - start * (vertical & ~straight)
            right = opened - start * ~(vertical | straight)
    if ends.right == "none":
        return top.reshape(shape)
    each = np.arange(size)
    out = score[is_n, is_m, each]
    if ends.right in ("b", "either"):
        out = np.where(np.arange(n + 1)[:, None] <= is_n, score[:, is_m, each], np.iinfo(np.int32).min).max(0)
    if ends.right == "either":
        out = np.maximum(out, np.where(np.arange(m + 1)[:, None] <= is_m, score[is_n, :, each].T, np.iinfo(np.int32).min).max(0))
    return out.reshape(shape)


def _classes(t: Table, rows: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """The class of each residue of some rows, and each class' letter, mass and whether it is modified; the filling is a class as well."""
    letter, mass, modified = t.letters[rows, :wide], t.mass[rows, :wide], t.modified[rows, :wide]
    masses, of = np.unique(mass, return_inverse=True)
    keys, first, own = np.unique((of.reshape(-1) * 2 + modified.reshape(-1)) * (len(_LETTERS) + 1) + letter.reshape(-1), return_index=True, return_inverse=True)
    return own.reshape(letter.shape), letter.reshape(-1)[first], mass.reshape(-1)[first], modified.reshape(-1)[first]


def score_all(a: Table, b: Table, kind: str, scoring: Scoring, steps: int, cells: int = 1_000_000) -> np.ndarray:
    """The score of every row of a with every row of b, all of which have one mass for each residue, as `align_rows` gives it; `cells` of the tables of some pairs at a time."""
    out = np.zeros((len(a.own), len(b.own)), np.int32)
    by_a, by_b = np.argsort(a.length, kind="stable"), np.argsort(b.length, kind="stable")
    to_b = len(by_b)
    while to_b > 0:  # pairs of about equal size are taken together, the longest ones first
        m = int(b.length[by_b[to_b - 1]]) + 1
        at_b = max(0, to_b - 512, int(np.searchsorted(b.length[by_b], m - 1 - max(1, m // 8), "left")))
        of_b, to_a = by_b[at_b:to_b], len(by_a)
        while to_a > 0:
            n = int(a.length[by_a[to_a - 1]]) + 1
            few = of_b if n * m * len(of_b) <= cells else of_b[: max(1, cells // (n * m))]
            at_a = max(0, to_a - max(1, cells // (n * m * len(few))), int(np.searchsorted(a.length[by_a], n - 1 - max(1, n // 8), "left")))
            of_a = by_a[at_a:to_a]
            for k in range(0, len(of_b), len(few)):
                own = of_b[k : k + len(few)]
                out[np.ix_(of_a, own)] = _all_scores(a, of_a, b, own, kind, scoring, steps)
            to_a = at_a
        to_b = at_b
    return out


def align_many(pairs: Sequence[tuple[str | None, str | None]], kind: str, scoring: Scoring, steps: int) -> list[Alignment | str]:
    """The alignment of each pair of texts, or what is wrong with them."""
    read: dict[str | None, Residues | str] = {None: "no sequence"}
    for text in {t for p in pairs for t in p if t is not None}:
        try:
            read[text] = residues(text)
            if unknown := [c for c in read[text].letters if c not in _PLACE]:
                read[text] = f"no residue {unknown[0]}"
        except (ValueError, KeyError) as e:
            read[text] = str(e)
    kinds: dict[tuple, int] = {}
    names = [t for t, r in read.items() if isinstance(r, Residues)]
    place, table = {t: k for k, t in enumerate(names)}, Table([read[t] for t in names], kinds)
    good = [k for k, (x, y) in enumerate(pairs) if x in place and y in place]
    out: list[Alignment | str] = [next((read[t] for t in p if isinstance(read[t], str)), "") for p in pairs]
    ai, bi = (np.array([place[pairs[k][w]] for k in good], np.int64) for w in (0, 1))
    if good:
        for k, al in zip(good, align_rows(table, ai, table, bi, kind, scoring, steps, len(kinds))[1]):
            out[k] = al
    return out
