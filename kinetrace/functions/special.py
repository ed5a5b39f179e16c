"""Digamma and log-gamma of the few arguments the estimators need, on the driver."""

from __future__ import annotations

import math

EULER = 0.57721566490153286060651209


def digamma(n: int) -> float:
    """Of a positive whole number: -gamma + H(n - 1), by its asymptotic series beyond 1000."""
    if n < 1:
        raise ValueError("digamma is implemented for whole numbers from 1 on")
    if n > 1000:
        return math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)
    return -EULER + math.fsum(1 / k for k in range(1, n))


def log_unit_ball(d: int) -> float:
    """Log of the volume of the Euclidean unit ball."""
    return d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1)
