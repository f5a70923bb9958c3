"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

Sylvester: the factors of A - s I = L D Lᵀ have as many positive pivots as A has
eigenvalues above s. Such counts bisect the spectrum until each of the leading
eigenvalues lies alone in an interval; Rayleigh quotient iteration then
converges cubically, and two more counts, just above and just below the value
found, certify that it is the one of that number. Eigenvalues too close to be
parted are found together, as an invariant subspace.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
# Bunch and Kaufman: below this share of its column, a diagonal entry pivots as part of a 2 x 2 block.
_PIVOT = (1 + 17**0.5) / 8
#: Intervals narrower than this share of the spectrum are not cut again: what they hold is one cluster.
CLUSTER = 2.0**-32
_STEPS = 60


class Uncertified(ArithmeticError):
    """The counts do not confirm the number of an eigenvalue."""


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` lie above ``shift``: the inertia of its LDLᵀ factors."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = _EPS * max(np.abs(a).max(), np.finfo(np.float64).tiny)
    n, k, positive = len(a), 0, 0
    while k < n:
        column = np.abs(a[k + 1 :, k])
        largest = column.max(initial=0.0)
        step = 1
        if abs(a[k, k]) < _PIVOT * largest:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            beside = row.max()
            if abs(a[k, k]) * beside < _PIVOT * largest**2:
                other = r if abs(a[r, r]) >= _PIVOT * beside else None
                step = 1 if other is not None else 2
                to = k + step - 1
                if r != to:
                    a[[to, r], :] = a[[r, to], :]
                    a[:, [to, r]] = a[:, [r, to]]
        if step == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny else -tiny  # a shift that is an eigenvalue: not above itself
            positive += pivot > 0
            below = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(below / pivot, below)
        else:
            block, below = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            # Such a block has a negative determinant: one eigenvalue on either side.
            positive += 1
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
        k += step
    return positive


def _solve(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """(A - shift I)⁻¹ x, the shift moved by rounding if the matrix is singular."""
    for _ in range(4):
        try:
            y = np.linalg.solve(a - shift * np.eye(len(a)), x)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
        shift += 4 * _EPS * scale
    raise Uncertified("no shift near the eigenvalue can be solved")


def _rayleigh(a: np.ndarray, low: float, high: float, start: np.ndarray, scale: float) -> tuple[float, np.ndarray] | None:
    """The eigenpair of the one eigenvalue in (low, high]; None if the iteration leaves the interval."""
    x, value, rest = start, (low + high) / 2, np.inf
    for step in range(_STEPS):
        x = _solve(a, value, x, scale)
        x /= np.linalg.norm(x)
        quotient = float(x @ a @ x)
        residual = float(np.linalg.norm(a @ x - quotient * x))
        if residual <= 8 * _EPS * scale or (step > 4 and residual >= rest and residual <= 64 * len(a) * _EPS * scale):
            return (quotient, x) if low < quotient <= high else None
        if low < quotient <= high:
            value = quotient
        elif step > 4:
            return None
        rest = residual
    return None


def _cluster(a: np.ndarray, low: float, high: float, held: int, scale: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """The ``held`` eigenvalues in a narrow interval and an orthonormal basis: inverse iteration, then Rayleigh-Ritz."""
    basis = np.linalg.qr(rng.standard_normal((len(a), held)))[0]
    shift = (low + high) / 2
    for _ in range(6):
        basis = np.linalg.qr(_solve(a, shift, basis, scale))[0]
    inside = basis.T @ a @ basis
    values, turn = np.linalg.eigh((inside + inside.T) / 2)  # held x held
    return values[::-1], (basis @ turn)[:, ::-1]


def leading(matrix: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of up to ``number`` largest eigenvalues of a positive semi-definite matrix, falling.

    Eigenvalues that rounding cannot tell from 0 are left out, so there may be
    fewer. Each vector has unit length and its largest entry (the first of equal ones) positive.
    Raises ``Uncertified`` if a count contradicts the numbering.
    """
    a = (matrix + matrix.T) / 2
    n = len(a)
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    if n == 0 or scale == 0.0:
        return np.empty(0), np.empty((n, 0))
    nothing = n * _EPS * scale
    number = min(number, above(a, nothing))
    counted = {nothing: above(a, nothing), scale * (1 + 4 * _EPS): 0}

    def count(shift: float) -> int:
        if shift not in counted:
            counted[shift] = above(a, shift)
        return counted[shift]

    rng = np.random.default_rng(0)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < number:
        found = len(values)
        high = min(s for s in counted if counted[s] <= found)
        low = max(s for s in counted if counted[s] > found)
        while count(low) > found + 1 and high - low > CLUSTER * scale:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) > found else (low, middle)
        held = count(low) - found
        pair = None
        while held == 1 and pair is None and high - low > CLUSTER * scale:
            pair = _rayleigh(a, low, high, rng.standard_normal(n), scale)
            if pair is None:
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) > found else (low, middle)
        if pair is not None:
            new, basis = np.array([pair[0]]), pair[1][:, None]
        else:
            new, basis = _cluster(a, low, high, held, scale, rng)
        # Other vectors found are orthogonal but for rounding; that much is taken off.
        if vectors:
            known = np.array(vectors)
            basis = np.linalg.qr(basis - known.T @ (known @ basis))[0]
        room = 16 * n * _EPS * scale
        if above(a, new[0] + room) > found or above(a, new[-1] - room) < found + held:
            raise Uncertified(f"eigenvalue {found + 1} is not where it was found")
        counted[float(min(low, new[-1] - room))] = count(low)
        values.extend(new.tolist())
        vectors.extend(basis.T)
    kept = np.array(vectors[:number]).reshape(number, n)
    at = np.abs(kept).argmax(axis=1)
    kept *= np.where(kept[np.arange(number), at] < 0, -1.0, 1.0)[:, None]
    return np.array(values[:number]), kept.T
