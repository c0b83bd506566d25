"""Integrals over a one-dimensional path, by a grid that carries the filtered density from step to step."""

import math

import numpy as np


def grid_likelihood(model, y, low=-8.0, high=8.0, points=1601):
    g = np.linspace(low, high, points)
    h, s, o = g[1] - g[0], model.state, model.obs
    normal = lambda x, m, v: np.exp(-0.5 * (x - m) ** 2 / v) / math.sqrt(2 * math.pi * v)
    total, density = 0.0, normal(g, s.x0[0], s.p0[0, 0])
    move = normal(g[None, :], s.a[0, 0] * g[:, None] + s.b[0], s.q[0, 0]) * h
    for t, (v,) in enumerate(y):
        if t:
            density = density @ move
        eta = o.c[0, 0] * g + o.d[0]
        density = density * np.exp(v * eta - np.exp(eta) - math.lgamma(v + 1))
        total += math.log(density.sum() * h)
        density = density / (density.sum() * h)
    return total
