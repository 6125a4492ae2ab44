"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of D in LDL' of A - shift say how many eigenvalues lie above the shift. Bisection on that
count puts each leading eigenvalue into an interval of its own, Rayleigh quotient iteration finishes
it, and counts on either side of the value found certify its number. The matrix has the size of a
vector squared, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np

#: (1 + sqrt 17) / 8: the pivot size at which Bunch and Kaufman's bound on growth is least.
_ALPHA = (1 + 17**0.5) / 8


#: Rows eliminated at once from large matrices, and the growth of what is left that ends that.
_BLOCK, _GROWTH = 64, 100.0


def count_above(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues greater than ``shift``: positive pivots of LDL' of the shifted matrix.

    Large matrices lose whole blocks of rows first, as long as what is left does not grow; a block's
    own pivots are counted in the same way.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a) > 2 * _BLOCK:
        head, across = a[:_BLOCK, :_BLOCK], a[_BLOCK:, :_BLOCK]
        try:
            rest = a[_BLOCK:, _BLOCK:] - across @ np.linalg.solve(head, across.T)
        except np.linalg.LinAlgError:
            break
        if not np.abs(rest).max() <= _GROWTH * np.abs(a).max():
            break
        positive += _positive_pivots(head)
        a = (rest + rest.T) / 2
    return positive + _positive_pivots(a)


def _positive_pivots(a: np.ndarray) -> int:
    """Pivots are single entries or, where the diagonal is small, two rows at once; the largest
    entries left are taken first, so zeros on the diagonal do no harm. Two rows at once have one
    eigenvalue of each sign."""
    tiny = np.finfo(float).tiny
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[r], off[i, j]) < tiny:
            break  # the rest is zero: eigenvalues at the shift
        if diagonal[r] >= _ALPHA * off[i, j]:
            positive += a[r, r] > 0
            taken = [r]
        else:
            positive += 1
            taken = [i, j]
        rest = np.delete(np.arange(len(a)), taken)
        across = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - across @ np.linalg.solve(a[np.ix_(taken, taken)], across.T)
        a = (a + a.T) / 2
    return int(positive)


def _start(size: int, number: int) -> np.ndarray:
    """A fixed vector with a part in every direction, another one for each number."""
    return np.random.default_rng(number).standard_normal(size)


def _without(vector: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):  # once more for what rounding left
        vector = vector - found @ (found.T @ vector)
    return vector / np.linalg.norm(vector)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    """The shifted system's solution; a shift that is an eigenvalue is moved by its last digits."""
    nudge = 0.0
    while True:
        try:
            out = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), vector)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        nudge = 2 * nudge or scale * np.finfo(float).eps


def _finish(matrix, low: float, high: float, start: np.ndarray, found: np.ndarray, scale: float):
    """Inverse iteration from the middle of an interval, then Rayleigh quotients; None if the value
    found is not in the interval."""
    vector = _without(start, found)
    for _ in range(3):
        vector = _without(_solve(matrix, (low + high) / 2, vector, scale), found)
    best, kept = np.inf, (np.inf, vector)
    for _ in range(12):
        value = vector @ matrix @ vector
        missed = np.linalg.norm(matrix @ vector - value * vector)
        if not missed < best / 2:
            break
        best, kept = missed, (value, vector)
        vector = _without(_solve(matrix, value, vector, scale), found)
    value, vector = kept
    slack = 4 * len(matrix) * np.finfo(float).eps * scale
    return (value, vector) if low - slack <= value <= high + slack and best <= slack else None


def leading_eigenpairs(matrix: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``number`` largest eigenvalues, falling, and their unit vectors as columns.

    Of each vector the entry of largest size is positive. Eigenvalues that agree to double precision
    get orthogonal vectors of their common space. The matrix has no eigenvalue below zero but for
    rounding. Fewer rows than ``number`` give as many pairs as there are rows.
    """
    size = len(matrix)
    number = min(number, size)
    scale = float(np.abs(matrix).sum(axis=1).max()) if size else 0.0
    if scale == 0:
        return np.zeros(number), np.eye(size)[:, :number]
    unit = matrix / scale  # all eigenvalues in [-1, 1]
    finest = 8 * size * np.finfo(float).eps
    known = {-1.0 - finest: size, 1.0 + finest: 0}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(unit, shift)
        return known[shift]

    values, vectors = np.empty(number), np.empty((size, number))
    k = 0
    while k < number:
        # the narrowest known interval that holds eigenvalue k (from 0) and all equal to it
        low = max(s for s, n in known.items() if n > k)
        high = min(s for s, n in known.items() if n <= k)
        while known[low] - known[high] > 1 and high - low > finest:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > k else (low, middle)
        pair, tries = None, 0
        while pair is None:
            pair = _finish(unit, low, high, _start(size, k + 1000 * tries), vectors[:, :k], 1.0)
            if pair is not None and not above(pair[0] + finest) <= k < above(pair[0] - finest):
                pair = None  # another eigenvalue than that of this number
            if pair is None:
                tries += 1
                if high - low > finest:
                    middle = (low + high) / 2
                    low, high = (middle, high) if above(middle) > k else (low, middle)
                elif tries > 60:
                    raise ArithmeticError(f"eigenvalue {k + 1} does not settle")
        values[k], vectors[:, k] = pair
        k += 1
    order = np.argsort(-values, kind="stable")  # equal ones may come in either order
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(number)])
    return values * scale, vectors
