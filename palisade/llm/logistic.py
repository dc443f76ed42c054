"""Ridge logistic regression by damped Newton steps, for small models fitted on the driver."""

import numpy as np


def fit(a: np.ndarray, target: np.ndarray, ridge: np.ndarray, center: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights that minimise the log loss of a @ w against target (0 to 1), each row counted
    `weight` times, plus ridge / 2 * (w - center) ** 2."""
    weight = np.broadcast_to(weight, len(a))

    def loss(w):
        z = a @ w
        return weight @ (np.logaddexp(0, z) - target * z) + (ridge * (w - center) ** 2).sum() / 2

    w = center.astype(float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (weight * (p - target)) + ridge * (w - center))
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def platt(z: np.ndarray, labels: np.ndarray, ridge: float = 0.1, weight: np.ndarray | float = 1.0):
    """Scale and shift that calibrate logits z, held near 1 and 0."""
    weight = np.broadcast_to(weight, len(z))
    n1, n0 = weight[labels].sum(), weight[~labels].sum()
    target = np.where(labels, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale, shift = fit(np.stack([z, np.ones_like(z)], 1), target, np.array([ridge, ridge]), np.array([1.0, 0.0]), weight)
    return max(float(scale), 1e-3), float(shift)
