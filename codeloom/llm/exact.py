"""Exact linear algebra on integer matrices: characteristic polynomials, their real roots, and eigenvectors.

A characteristic polynomial is found modulo many primes, by reduction to Hessenberg form, and put
together by Chinese remaindering. Its roots, all real for a symmetric matrix, are isolated by counting: the
sign changes of the coefficients of p(x + a) are exactly the roots above a. Everything is integers.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, gcd, isqrt
from random import Random

import numpy as np

WORD = 31  # bits of the primes: products of two residues fit 64 bits


def _is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7) if n != p):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # decides below 3 * 10 ** 9
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(bits: int) -> list[int]:
    """The largest primes of ``WORD`` bits whose product has more than ``bits`` bits."""
    found, product, n = [], 1, (1 << WORD) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_bits(d: int, trace: int) -> int:
    """Bits of the largest coefficient (with its sign) for a matrix without negative eigenvalues."""
    most = max(comb(d, k) * (Fraction(max(trace, 1), d) ** k) for k in range(d + 1))
    return int(most).bit_length() + 2


def hessenberg_polynomial(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime, from the constant term up; ``matrix`` holds residues."""
    h, d = matrix.astype(np.int64) % prime, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        inverse = pow(int(h[m, m - 1]), -1, prime)
        factors = h[m + 1 :, m - 1] * inverse % prime
        # Rows below lose a multiple of row m, and column m gains the same multiples of theirs: a similarity.
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % prime) % prime
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % prime).sum(axis=1)) % prime
    p = np.zeros((d + 1, d + 1), np.int64)
    p[0, 0] = 1
    for k in range(1, d + 1):
        p[k, 1:] = p[k - 1, :-1]
        p[k] = (p[k] - int(h[k - 1, k - 1]) * p[k - 1] % prime) % prime
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % prime
            if not chain:
                break
            p[k] = (p[k] - chain * int(h[k - i - 1, k - 1]) % prime * p[k - i - 1] % prime) % prime
    return p[d]


def remainders_joined(residues: list[np.ndarray], primes: list[int]) -> list[int]:
    """The numbers, of least absolute value, that have these residues."""
    product = 1
    for p in primes:
        product *= p
    total = [0] * len(residues[0])
    for own, p in zip(residues, primes):
        rest = product // p
        factor = rest * pow(rest, -1, p)
        total = [t + factor * int(r) for t, r in zip(total, own)]
    half = product // 2
    return [((t % product) + half) % product - half for t in total]


def _shifted(p: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    p = list(p)
    for i in range(len(p) - 1):
        for j in range(len(p) - 2, i - 1, -1):
            p[j] += a * p[j + 1]
    return p


def _changes(p: list[int]) -> int:
    signs = [c > 0 for c in p if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _scaled(p: list[int], bits: int) -> list[int]:
    """Coefficients of the polynomial whose roots are those of p times 2 ** bits."""
    d = len(p) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(p)]


def _primitive(p: list[int]) -> list[int]:
    while p and not p[-1]:
        p = p[:-1]
    common = gcd(*p) if p else 1
    sign = -1 if p and p[-1] < 0 else 1
    return [c // common * sign for c in p]


def _rest(a: list[int], b: list[int]) -> list[int]:
    """The remainder of a multiple of a by b."""
    a = list(a)
    while len(a) >= len(b) and any(a):
        lead = a[-1]
        a = [c * b[-1] for c in a]
        for i, c in enumerate(b):
            a[len(a) - len(b) + i] -= lead * c
        a = a[:-1]
    return _primitive(a)


def _quotient(a: list[int], b: list[int]) -> list[int]:
    """a / b where b divides a."""
    left, out = [Fraction(c) for c in a], []
    while len(left) >= len(b):
        factor = left[-1] / b[-1]
        out.append(factor)
        for i, c in enumerate(b):
            left[len(left) - len(b) + i] -= factor * c
        left.pop()
    out.reverse()
    scale = 1
    for c in out:
        scale = scale * c.denominator // gcd(scale, c.denominator)
    return _primitive([int(c * scale) for c in out])


def _common(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, _rest(a, b)
    return a


def _gcd_degree(a: list[int], b: list[int], prime: int) -> int:
    """Degree of the greatest common divisor modulo a prime: never less than the true one."""
    a, b = [c % prime for c in a], [c % prime for c in b]
    trim = lambda p: p[: max((i + 1 for i, c in enumerate(p) if c), default=0)]
    a, b = trim(a), trim(b)
    while b:
        inverse = pow(b[-1], -1, prime)
        while len(a) >= len(b):
            factor = a[-1] * inverse % prime
            for i, c in enumerate(b):
                a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - factor * c) % prime
            a = trim(a[:-1])
        a, b = b, a
    return len(a) - 1


def square_free(p: list[int]) -> list[tuple[list[int], int]]:
    """Factors without repeated roots, each with the number of times its roots occur in p."""
    slope = [i * c for i, c in enumerate(p)][1:]
    prime = primes_below(1)[0]
    if p[-1] % prime and len(p) - 1 < prime and _gcd_degree(p, slope, prime) <= 0:
        return [(p, 1)]
    both = _common(_primitive(p), _primitive(slope))
    left, out, times = _quotient(p, both), [], 1
    while len(left) > 1:
        shared = _common(left, both)
        own = _quotient(left, shared)
        if len(own) > 1:
            out.append((own, times))
        left, both, times = shared, _quotient(both, shared), times + 1
    return out


def _isolated(p: list[int], top: int) -> tuple[list[tuple[int, int]], int]:
    """Intervals (a, b] in units of 2 ** -bits, one root each, falling, and bits; p has simple roots, all in (0, top]."""
    bits, todo, done = 0, [(0, top, len(p) - 1, 0)], []
    scaled = p
    while todo:
        narrow = []
        for a, b, inside, above in todo:
            if inside == 1:
                done.append((a, b, bits))
                continue
            if b - a == 1:  # the unit is halved for what is left
                narrow.append((a, b, inside, above))
                continue
            middle = (a + b) // 2
            upper = _changes(_shifted(scaled, middle)) - above
            narrow += [(middle, b, upper, above)] if upper else []
            narrow += [(a, middle, inside - upper, above + upper)] if inside - upper else []
        todo = narrow
        if todo and all(b - a == 1 for a, b, _, _ in todo):
            bits += 1
            scaled = _scaled(p, bits)
            todo = [(2 * a, 2 * b, n, k) for a, b, n, k in todo]
    spread = [(a << (bits - own), b << (bits - own)) for a, b, own in done]
    return sorted(spread, reverse=True), bits


def _sign_at(p: list[int], x: int, bits: int) -> int:
    value = 0
    for i, c in enumerate(reversed(p)):
        value = value * x + (c << (bits * i))
    return (value > 0) - (value < 0)


def _refined(p: list[int], a: int, b: int, bits: int, more: int) -> int:
    """The root in (a, b] with ``more`` further bits, rounded down: by secant steps kept between halvings."""
    a, b, bits = a << more, b << more, bits + more
    above = _sign_at(p, b, bits)
    if above == 0:
        return b
    while b - a > 1:
        middle = (a + b) // 2
        step = _newton(p, middle, bits)
        for x in ([step - 1, step + 1] if a < step - 1 and step + 1 < b else []) + [middle]:
            if a < x < b:
                side = _sign_at(p, x, bits)
                if side == 0:
                    return x
                a, b = (a, x) if side == above else (x, b)
    return a


def _newton(p: list[int], x: int, bits: int) -> int:
    value = slope = 0
    for i, c in enumerate(reversed(p)):
        slope = slope * x + value
        value = value * x + (c << (bits * i))
    return x - value // slope if slope else x


def real_roots(p: list[int], bits: int) -> list[tuple[Fraction, int]]:
    """The different roots of p above 0, falling, to 2 ** -bits at least and to as many bits below their distances, with multiplicity.

    p has integer coefficients from the constant term up, and no root that is complex or below 0.
    """
    while p and not p[0]:
        p = p[1:]
    if len(p) < 2:
        return []
    top = abs(p[-2]) // abs(p[-1]) + 1  # no root exceeds the sum of all
    out = []
    for factor, times in square_free(p):
        intervals, fine = _isolated(factor, top)
        more = bits + 8
        out += [(Fraction(_refined(factor, a, b, fine, more), 1 << (fine + more)), times) for a, b in intervals]
    return sorted(out, reverse=True)


def null_vectors(matrix: list[list[int]], root: Fraction, times: int, bits: int, known: list[list[int]] = ()) -> list[list[int]]:
    """``times`` orthogonal unit vectors, in units of 2 ** -bits, of the null space of matrix - root.

    Inverse iteration in fixed point: the shifted matrix is factored once, and each step solves with it and
    takes out the vectors found before.
    """
    d = len(matrix)
    shift = (root.numerator << bits) // root.denominator
    a = np.array([[(x << bits) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    order = list(range(d))
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not a[k, k]:
            a[k, k] = 1  # the smallest unit: the null space shows as very large solutions
        if k + 1 < d:
            factors = np.array([(x << bits) // a[k, k] for x in a[k + 1 :, k]], dtype=object)
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :]) >> bits
            a[k + 1 :, k] = factors
    random, found, tries = Random(d), list(known), 0
    while len(found) < len(known) + times:
        tries += 1
        if tries > times + 20:
            raise ArithmeticError("the root is not exact enough for its null space")
        # Any start will do but one that the vectors found before make up; that shows in the residual.
        v = _unit(_without([random.getrandbits(32) - (1 << 31) << (bits - 32) for _ in range(d)], found, bits), bits)
        for _ in range(3):
            x = [v[i] for i in order]
            for i in range(d):
                x[i] -= sum(a[i, j] * x[j] for j in range(i)) >> bits
            for i in reversed(range(d)):
                x[i] = ((x[i] - (sum(a[i, j] * x[j] for j in range(i + 1, d)) >> bits)) << bits) // a[i, i]
            v = _unit(_without(_unit(x, bits), found, bits), bits)
        left = max(abs(sum(m * x for m, x in zip(row, v)) - (shift * v[i] >> bits)) for i, row in enumerate(matrix))
        if left < 1 << (bits // 2):
            found.append(v)
    return found[len(known) :]


def _without(v: list[int], others: list[list[int]], bits: int) -> list[int]:
    for _ in range(2):
        for other in others:
            part = sum(x * y for x, y in zip(v, other)) >> bits
            v = [x - (part * y >> bits) for x, y in zip(v, other)]
    return v


def _unit(v: list[int], bits: int) -> list[int]:
    size = max(abs(x) for x in v).bit_length()
    v = [x << (bits - size) if size < bits else x >> (size - bits) for x in v]
    length = isqrt(sum(x * x for x in v))
    return [(x << bits) // length for x in v]
