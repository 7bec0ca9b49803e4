"""Small dense helpers: canonical order and sign, rank rules, windows."""

from __future__ import annotations

import numpy as np

TIE = 1e-12


def floor_of(n_kernel: int, peak: float) -> float:
    """Numerical zero of a kernel of ``n_kernel`` rows whose largest value is ``peak``."""
    return n_kernel * np.finfo(np.float64).eps * peak


def significant(values: np.ndarray, n_kernel: int) -> np.ndarray:
    """Which eigenvalues (or singular values) lie above the numerical floor."""
    values = np.asarray(values)
    return values > floor_of(n_kernel, float(values.max())) if values.size else values.astype(bool)


def pivot(magnitudes: np.ndarray) -> np.ndarray:
    """Of each column, the first row within a tie of the largest magnitude."""
    top = magnitudes.max(0)
    return (magnitudes >= top * (1 - TIE)).argmax(0)


def phases(values: np.ndarray) -> np.ndarray:
    """Unit factors that make values real and positive; 1 for zeros."""
    size = np.abs(values)
    if not np.isfinite(size).all():
        raise ValueError("modes are not finite")
    return np.where(size > 0, np.conj(values) / np.where(size > 0, size, 1), 1.0)


def canonical(modes: np.ndarray) -> np.ndarray:
    """The unit factor of each column that fixes its sign or phase."""
    if not modes.size:
        return np.ones(modes.shape[1])
    return phases(modes[pivot(np.abs(modes)), np.arange(modes.shape[1])])


def spectrum_order(values: np.ndarray) -> np.ndarray:
    """Largest magnitude first; ties with the first of a run by (real, imaginary) ascending."""
    values = np.asarray(values).reshape(-1)
    size = np.abs(values)
    left = list(np.argsort(-size, kind="stable"))
    out: list[int] = []
    while left:
        top = size[left[0]]
        run = [i for i in left if abs(top - size[i]) <= TIE * max(top, size[i])]
        run = run[: next((k for k, i in enumerate(left) if i not in run), len(run))]
        out += sorted(run, key=lambda i: (values[i].real, values[i].imag))
        left = left[len(run) :]
    return np.array(out, dtype=int)


def pooled_order(values: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Largest first; ties with the first of a run by band, then place inside the band."""
    left = list(np.argsort(-np.asarray(values, np.float64), kind="stable"))
    out: list[int] = []
    while left:
        least = values[left[0]] - TIE * abs(values[left[0]])
        n = next((k for k, i in enumerate(left) if values[i] < least), len(left))
        out += sorted(left[:n], key=lambda i: (bands[i], i))
        left = left[n:]
    return np.array(out, dtype=int)


#: Coefficients of the cosine windows, of alternating sign.
COSINES = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}
#: Functions of the length, by name; ``add_window`` puts more here.
WINDOWS = {
    "boxcar": np.ones,
    "bartlett": lambda n: 1 - np.abs(2 * np.arange(n) / n - 1),
    "sine": lambda n: np.sin(np.pi * (np.arange(n) + 0.5) / n),
}


def add_window(name: str, make) -> None:
    """Let ``window`` know a window of one's own: ``make(n)`` gives its ``n`` values."""
    if name in COSINES:
        raise ValueError(f"window {name!r} is fixed")
    WINDOWS[name] = make


def window(name: str, n: int) -> np.ndarray:
    """Periodic windows by name."""
    if name in COSINES:
        turn = 2 * np.pi * np.arange(n) / n
        return sum((-1) ** j * a * np.cos(j * turn) for j, a in enumerate(COSINES[name]))
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; known: {sorted([*COSINES, *WINDOWS])}")
    values = np.asarray(WINDOWS[name](n), np.float64)
    if values.shape != (n,) or not np.isfinite(values).all():
        raise ValueError(f"window {name!r} must give {n} finite values")
    return values


def window_factor(values: np.ndarray, norm: str) -> float:
    """Correction of a window: by power ``1 / rms`` or by amplitude ``1 / mean``."""
    if norm == "power":
        return float(1 / np.sqrt(np.mean(values**2)))
    if norm == "amplitude":
        return float(1 / np.mean(values))
    raise ValueError(f"window norm must be 'power' or 'amplitude', got {norm!r}")


def threshold_known(beta: float) -> float:
    """Optimal hard threshold of singular values, noise level known."""
    if not 0 < beta <= 1:
        raise ValueError(f"aspect ratio must lie in (0, 1], got {beta!r}")
    return float(np.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + np.sqrt(beta**2 + 14 * beta + 1))))


def noise_median(beta: float) -> float:
    """Median of the Marchenko-Pastur law: bisection over Gauss-Legendre integrals in an angle that removes both roots."""
    low, high = (1 - np.sqrt(beta)) ** 2, (1 + np.sqrt(beta)) ** 2
    span = high - low
    if span <= 0:
        return float(low)
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def mass(angle: float) -> float:
        a = angle * (nodes + 1) / 2
        x = low + span * np.sin(a) ** 2
        density = span**2 * np.sin(a) ** 2 * np.cos(a) ** 2 / (np.pi * beta * x)
        return float((weights * density).sum() * angle / 2)

    a, b = 0.0, np.pi / 2
    for _ in range(80):
        middle = (a + b) / 2
        a, b = (middle, b) if mass(middle) < 0.5 else (a, middle)
    return float(low + span * np.sin((a + b) / 2) ** 2)


def threshold_median(beta: float) -> float:
    """Optimal hard threshold as a multiple of the median singular value."""
    return threshold_known(beta) / float(np.sqrt(noise_median(beta)))


def rank_of(singular: np.ndarray, shape: tuple[int, int], rule: int | str, energy: float = 0.999) -> int:
    """Rank by number, ``"svht"`` or ``"energy"``, never above the numerical rank."""
    if isinstance(rule, bool) or rule is None:
        raise ValueError("rank must be a number, 'svht' or 'energy'")
    floor = int((singular > max(shape) * np.finfo(np.float64).eps * (singular[0] if len(singular) else 0)).sum())
    if rule == "svht":
        found = int((singular > threshold_median(min(shape) / max(shape)) * np.median(singular)).sum())
    elif rule == "energy":
        share = np.cumsum(singular**2) / max((singular**2).sum(), np.finfo(float).tiny)
        found = int(np.searchsorted(share, energy) + 1)
    elif isinstance(rule, (int, np.integer)) and rule >= 1:
        found = int(rule)
    else:
        raise ValueError(f"rank must be a number above 0, 'svht' or 'energy', got {rule!r}")
    return min(found, floor)
