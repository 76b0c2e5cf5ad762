"""Follow the regularised leader with elastic-net penalties, for sparse linear models."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal state of a (features x classes) weight matrix."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        scale = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / scale)

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        after = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = after


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
