"""Sobol points with a seeded scramble.

Direction numbers follow from primitive polynomials over two elements, which are searched for here,
and from odd first numbers that a fixed rule draws. A scramble multiplies each dimension's digits by
a random lower triangular matrix and adds random digits; both depend on the seed and on the dimension
alone, so a point's first dimensions stay what they are when more are asked for. In every dimension
the first 2^k points hit each of 2^k equal cells once.
"""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

import numpy as np

BITS = 30


def _times(a: int, b: int, p: int, degree: int) -> int:
    """a * b modulo the polynomial p."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        b >>= 1
        a <<= 1
        if a >> degree & 1:
            a ^= p
    return out


def _power(n: int, p: int, degree: int) -> int:
    """x ** n modulo the polynomial p."""
    out, base = 1, 2 if degree > 1 else 2 ^ p
    while n:
        if n & 1:
            out = _times(out, base, p, degree)
        base = _times(base, base, p, degree)
        n >>= 1
    return out


def is_primitive(p: int) -> bool:
    """Whether the powers of x modulo p run through all 2^degree - 1 elements but zero."""
    degree = p.bit_length() - 1
    order = (1 << degree) - 1
    if not p & 1 or _power(order, p, degree) != 1:
        return False
    left, q = order, 2
    while q * q <= left:
        if left % q == 0:
            if _power(order // q, p, degree) == 1:
                return False
            while left % q == 0:
                left //= q
        q += 1
    return left in (1, order) or _power(order // left, p, degree) != 1


@cache
def _polynomials(n: int) -> tuple[int, ...]:
    out, p = [], 3
    while len(out) < n:
        if is_primitive(p):
            out.append(p)
        p += 2
    return tuple(out)


@cache
def directions(dims: int) -> np.ndarray:
    """[dims, BITS] direction numbers, each with BITS binary digits after the point."""
    out = np.zeros((dims, BITS), np.int64)
    out[0] = 1 << np.arange(BITS - 1, -1, -1)
    for d, p in enumerate(_polynomials(dims - 1), 1):
        s = p.bit_length() - 1
        draw = np.random.default_rng(d)
        m = [int(draw.integers(0, 1 << i)) * 2 + 1 for i in range(s)][:BITS]
        for i in range(len(m), BITS):
            new = m[i - s] ^ m[i - s] << s
            for k in range(1, s):
                if p >> (s - k) & 1:
                    new ^= m[i - k] << k
            m.append(new)
        out[d] = [x << (BITS - 1 - i) for i, x in enumerate(m)]
    return out


def points(n: int, dims: int, seed: int) -> np.ndarray:
    """The first ``n`` points, [n, dims], strictly between 0 and 1."""
    digits = directions(dims)[:, :, None] >> np.arange(BITS - 1, -1, -1) & 1  # [dims, number, digit]
    every = np.arange(n)
    out = np.empty((n, dims))
    for d in range(dims):
        draw = np.random.default_rng([seed % (1 << 32), d])
        mix = np.tril(draw.integers(0, 2, (BITS, BITS)), -1) + np.eye(BITS, dtype=np.int64)
        own = (digits[d] @ mix.T & 1) @ (1 << np.arange(BITS - 1, -1, -1))
        x = np.full(n, int(draw.integers(0, 1 << BITS)))
        for k in range(max(1, int(n - 1).bit_length())):
            x ^= np.where(every >> k & 1, own[k], 0)
        out[:, d] = (x + 0.5) / (1 << BITS)
    return out


def normals(n: int, dims: int, seed: int) -> np.ndarray:
    """The same through the normal quantile function."""
    inverse = NormalDist().inv_cdf
    u = points(n, dims, seed)
    return np.array([inverse(x) for x in u.ravel().tolist()]).reshape(u.shape)
