"""Whitening from the exact characteristic polynomial of an integer scatter matrix.

Vectors become integers, and sums and the scatter A = n * sum(y y') - T T' (y: the vectors less a
common integer centre, T their sum; A is n^2 times the covariance) are exact: tasks add partial
sums, Spark adds those as limbs. From A on nothing grows with the table:

1. modulo each of enough primes a task reduces A to Hessenberg form and reads off the
   characteristic polynomial; Chinese remaindering joins them (the coefficients of a positive
   semidefinite matrix are bounded by its trace),
2. all its roots are real, so the sign changes of the polynomial shifted to a are exactly the roots
   above a; a task for each component isolates its root by halving and narrows it,
3. the same task factors A - root in integers of enough bits and finds the null vector by inverse
   iteration; a root of multiplicity m gives m orthogonal vectors.

Then a pass measures the covariance of the whitened vectors, and the last one returns them.
"""
from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

COMPONENTS = 32
#: Integer of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Bits of a root beyond what separates it from its neighbours.
BITS = 100
_LIMB, _LIMBS = 31, 5
_LIMB_SCHEMA = ", ".join(f"l{k} long" for k in range(_LIMBS))


# ------------------------------------------------------------------ exact sums
def integers(vectors: pa.Array, dim: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) of the vectors of each length (or of ``dim`` alone), without null
    vectors, null or non-finite entries and entries whose integer is no long."""
    lengths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)      # null entries: NaN
    ends = np.cumsum(np.maximum(lengths, 0))
    for d in [dim] if dim is not None else np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * flat[(ends[at] - d)[:, None] + np.arange(d)])
            good = (np.abs(x) < 2.0 ** 62).all(axis=1)
        yield at[good], x[good].astype(np.int64) + SHIFT


def limbs(v: int) -> list[int]:
    """Base 2^31 digits; the last one carries the sign."""
    mask = (1 << _LIMB) - 1
    return [v >> _LIMB * k & mask for k in range(_LIMBS - 1)] + [v >> _LIMB * (_LIMBS - 1)]


def from_limbs(row) -> int:
    return sum(int(row[f"l{k}"]) << _LIMB * k for k in range(_LIMBS))


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of int64."""
    high, low = (x >> _LIMB).sum(axis=0), (x & ((1 << _LIMB) - 1)).sum(axis=0)
    return [(int(a) << _LIMB) + int(b) for a, b in zip(high, low, strict=True)]


class Gram:
    """Sum of y y' of int64 rows, exact: products of 20-bit parts are whole numbers of doubles."""

    def __init__(self, dim: int):
        self.total = np.zeros((dim, dim), object)
        self.part, self.bound = np.zeros((dim, dim), np.int64), 0

    def flush(self) -> None:
        self.total += self.part.astype(object)
        self.part[:], self.bound = 0, 0

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), 1024):
            z = y[a:a + 1024]
            most = int(max(abs(int(z.max())), abs(int(z.min()))))
            if most < 1 << 21:
                f = z.astype(np.float64)
                if self.bound + (most * most << 10) >= 1 << 62:
                    self.flush()
                self.bound += most * most << 10
                self.part += (f.T @ f).astype(np.int64)
                continue
            parts, rest = [], z
            for _ in range(3):
                parts.append((rest & 0xFFFFF).astype(np.float64))
                rest = rest >> 20
            parts.append(rest.astype(np.float64))
            for i, p in enumerate(parts):
                for j, q in enumerate(parts):
                    self.total += (p.T @ q).astype(np.int64).astype(object) << 20 * (i + j)

    def result(self) -> np.ndarray:
        self.flush()
        return self.total


def _limb_batch(keys: dict[str, list[int]], values: list[int]) -> pa.RecordBatch:
    digits = [limbs(v) for v in values]
    names = [*keys, *(f"l{k}" for k in range(_LIMBS))]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in keys.values()] + [pa.array([d[k] for d in digits], pa.int64()) for k in range(_LIMBS)], names=names)


def fit_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(n, dimension, sums S). The dimension is the most frequent length, of equal ones the largest;
    vectors of another length are left out like those with null entries. (0, 0, []) if none is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for at, x in integers(b.column("v"), None):
                if len(at):
                    d = x.shape[1]
                    n, sums = found.get(d, (0, [0] * d))
                    found[d] = n + len(at), [p + q for p, q in zip(sums, exact_sum(x), strict=True)]
        for d, (n, sums) in found.items():
            yield _limb_batch({"dim": [d] * (d + 1), "i": list(range(-1, d))}, [n, *sums])

    part = vectors.select("v").mapInArrow(run, f"dim long, i long, {_LIMB_SCHEMA}")
    total = written(part.groupBy("dim", "i").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]), "whiten-sums")
    sizes = [(from_limbs(r), r["dim"]) for r in total.filter("i = -1").orderBy(F.col("l1").desc(), F.col("l0").desc(), F.col("dim").desc()).take(1)]
    if not sizes:
        return 0, 0, []
    n, dim = sizes[0]
    rows = {r["i"]: from_limbs(r) for r in total.filter((F.col("dim") == dim) & (F.col("i") >= 0)).collect()}
    return n, dim, [rows[i] for i in range(dim)]


def scatter(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """n^2 times the covariance, exact: products of vectors less the integer centre."""
    dim, centre = len(sums), [s // n for s in sums]
    off = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(dim)
        seen = False
        for b in batches:
            for at, x in integers(b.column("v"), dim):
                if len(at):
                    gram.add(x - off)
                    seen = True
        if seen:
            i, j = np.triu_indices(dim)
            yield _limb_batch({"i": i.tolist(), "j": j.tolist()}, gram.result()[i, j].tolist())

    part = vectors.select("v").mapInArrow(run, f"i long, j long, {_LIMB_SCHEMA}")
    t = [s - n * c for s, c in zip(sums, centre, strict=True)]
    a = np.zeros((dim, dim), object)
    for r in part.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]).collect():
        i, j = r["i"], r["j"]
        a[i, j] = a[j, i] = n * from_limbs(r) - t[i] * t[j]
    return a


# ------------------------------------------------------------------ characteristic polynomial
def is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide below 2^32."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, p)
        if base % p == 0 or x in (1, p - 1):
            continue
        for _ in range(s - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the top, whose product is beyond the bound."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (lowest first) of det(x - a) modulo p."""
    h = (a % p).astype(np.int64)
    d = len(h)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k != j + 1:
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        c, product = np.zeros(k + 1, np.int64), 1
        c[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            c[i] = int(h[i, k]) * product % p
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (c[:, None] * polys[:k + 1] % p).sum(axis=0)) % p
    return polys[d]


def coefficient_bound(a: np.ndarray) -> int:
    """No coefficient of a positive semidefinite matrix's polynomial is larger: by Maclaurin's
    inequality the k-th one is at most C(d, k) (trace / d)^k."""
    d, trace = len(a), int(np.trace(a))
    return max(math.comb(d, k) * trace ** k // d ** k for k in range(d + 1)) + 1


def charpoly(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients (lowest first, the highest is 1) of the characteristic polynomial, exact."""
    primes = primes_beyond(2 * coefficient_bound(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([charpoly_mod(a, primes[k]).tolist()], pa.list_(pa.int64()))], names=["k", "c"])

    parts = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    found = {r["k"]: r["c"] for r in spark.range(0, len(primes), 1, parts).mapInArrow(run, "k long, c array<long>").collect()}
    value, product = np.zeros(len(a) + 1, object), 1
    for k, p in enumerate(primes):
        step = (np.array(found[k], object) - value) * pow(product, -1, p) % p
        value, product = value + step * product, product * p
    return [int(v - product if 2 * v > product else v) for v in value]


# ------------------------------------------------------------------ roots of real-rooted polynomials
def primitive(c: list[int]) -> list[int]:
    while c and not c[-1]:
        c = c[:-1]
    g = math.gcd(*c) if c else 1
    return [x // g for x in c]


def poly_gcd(a: list[int], b: list[int]) -> list[int]:
    a, b = primitive(a), primitive(b)
    while b:
        while len(a) >= len(b):
            lead, top, shift = b[-1], a[-1], len(a) - len(b)
            a = [lead * x - (top * b[i - shift] if i >= shift else 0) for i, x in enumerate(a)][:-1]
            while a and not a[-1]:
                a = a[:-1]
        a, b = b, primitive(a)
    return a if a[-1] > 0 else [-x for x in a]


def divide(a: list[int], b: list[int]) -> list[int]:
    """Exact quotient."""
    a, out = a[:], []
    while len(a) >= len(b):
        q = a[-1] // b[-1]
        out.append(q)
        for i, x in enumerate(b):
            a[len(a) - len(b) + i] -= q * x
        a.pop()
    return out[::-1]


def distinct_part(c: list[int]) -> list[int]:
    """The polynomial with each root once; one prime without a common factor proves there is none."""
    slope = [k * x for k, x in enumerate(c)][1:]
    for p in ((1 << 31) - 1, 2147483629):
        a, b = [x % p for x in c], [x % p for x in slope]
        while any(b):
            while b and not b[-1]:
                b.pop()
            inverse = pow(b[-1], -1, p)
            while len(a) >= len(b):
                q, shift = a[-1] * inverse % p, len(a) - len(b)
                for i, x in enumerate(b):
                    a[shift + i] = (a[shift + i] - q * x) % p
                a.pop()
            while a and not a[-1]:
                a.pop()
            a, b = b, a
        if len(a) == 1:
            return c
    return divide(c, poly_gcd(c, slope))


def scaled(c: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    top = len(c) - 1
    return [x << bits * (top - k) for k, x in enumerate(c)]


def roots_above(c: list[int], a: int) -> int:
    """How many roots are larger than a: the sign changes after the shift by a (real roots only)."""
    c = c[:]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(p != q for p, q in zip(signs, signs[1:], strict=False))


def value_at(c: list[int], x: int) -> int:
    v = 0
    for k in reversed(c):
        v = v * x + k
    return v


def isolate(c: list[int], q: list[int], component: int, top: int) -> tuple[int, int, int, int, int]:
    """(root, bits, width, first, multiplicity): the component-th largest root is within root / 2^bits
    and (root + 1) / 2^bits, ``width`` / 2^bits separates it from the others, and components first
    to first + multiplicity - 1 share it. c has the positive roots with their multiplicity, q each once."""
    bits, low, high = 0, 0, top + 1
    cs, qs = c, q
    above_low, above_high = len(c) - 1, 0           # of c
    once_low, once_high = len(q) - 1, 0             # of q
    while once_low - once_high > 1:
        if high - low == 1:
            low, high, bits = low << 64, high << 64, bits + 64
            cs, qs = scaled(c, bits), scaled(q, bits)
        mid = (low + high) // 2
        above = roots_above(cs, mid)
        once = above if q is c else roots_above(qs, mid)
        if above >= component:
            low, above_low, once_low = mid, above, once
        else:
            high, above_high, once_high = mid, above, once
    width = high - low
    more = BITS + max(0, BITS - (width.bit_length() - 1))
    low, high, width, bits = low << more, high << more, width << more, bits + more
    qs = scaled(q, bits)
    positive = value_at(qs, high) > 0 or value_at(qs, high) == 0 and roots_above(qs, high) % 2 == 0
    # one simple root in (low, high]: the sign above it is that of the roots above
    while high - low > 1:
        mid = (low + high) // 2
        v = value_at(qs, mid)
        if v == 0:
            low, high = mid, mid
        elif (v > 0) == positive:
            high = mid
        else:
            low = mid
    return low, bits, width, above_high + 1, above_low - above_high


def null_vectors(a: np.ndarray, root: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthogonal unit vectors of a - root / 2^bits by inverse iteration in integers with
    bits + BITS bits after the point."""
    d, point = len(a), bits + BITS
    m = np.array([[int(x) << point for x in row] for row in a], object)
    m[range(d), range(d)] -= root << BITS
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(m[i, k]))
        if best != k:
            m[[k, best]] = m[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not m[k, k]:
            m[k, k] = 1
        if k + 1 < d:
            factor = np.array([(int(x) << point) // int(m[k, k]) for x in m[k + 1:, k]], object)
            m[k + 1:, k + 1:] -= factor[:, None] * m[k, k + 1:] >> point
            m[k + 1:, k] = factor

    def solve(b: list[int]) -> list[int]:
        y = [b[i] for i in order]
        for i in range(1, d):
            y[i] -= sum(int(m[i, k]) * y[k] for k in range(i)) >> point
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] << point) - sum(int(m[i, k]) * y[k] for k in range(i + 1, d))) // int(m[i, i])
        return unit(y)

    def unit(y: list[int]) -> list[int]:
        """Length 2^point."""
        grown = [x << 2 * point for x in y]
        size = math.isqrt(sum(x * x for x in grown)) or 1
        return [(x << point) // size for x in grown]

    found: list[list[int]] = []
    for k in range(count):
        rnd = random.Random(k)
        v = [rnd.randrange(-1 << 30, 1 << 30) << point - 30 for _ in range(d)]
        for _ in range(3):
            v = solve(v)
            for u in found:
                dot = sum(x * y for x, y in zip(u, v, strict=True)) >> point
                v = [x - (dot * y >> point) for x, y in zip(v, u, strict=True)]
            v = unit(v)
        found.append(v)
    out = np.array([[float(Fraction(x, 1 << point)) for x in v] for v in found])
    largest = np.abs(out).argmax(axis=1)
    return out * np.sign(out[np.arange(count), largest])[:, None]


def eigen(spark: SparkSession, a: np.ndarray, components: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest eigenvalues of a positive semidefinite integer matrix and a unit vector for each
    (one a row; zeros for the eigenvalue 0)."""
    d = len(a)
    count = min(components, d)
    g = math.gcd(*(int(x) for x in a.ravel()))
    if not g:
        return [Fraction(0)] * count, np.zeros((count, d))
    b = a // g
    c = charpoly(spark, b)
    while not c[0]:
        c = c[1:]
    q = distinct_part(c)
    rank, top = len(c) - 1, int(np.trace(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                root, bits, _, first, many = isolate(c, c if len(q) == len(c) else q, k, top)
                v = null_vectors(b, root, bits, k - first + 1)[k - first]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(root)]), pa.array([bits], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))],
                                                 names=["k", "root", "bits", "v"])

    here = min(count, rank)
    rows = {r["k"]: r for r in spark.range(1, here + 1, 1, here).mapInArrow(run, "k long, root string, bits long, v array<double>").collect()}
    values = [Fraction(int(rows[k]["root"]), 1 << rows[k]["bits"]) * g for k in range(1, here + 1)] + [Fraction(0)] * (count - here)
    vectors = np.zeros((count, d))
    for k in range(here):
        vectors[k] = rows[k + 1]["v"]
    return values, vectors


# ------------------------------------------------------------------ whitening
class Whitener:
    """The fitted transformation; ``components`` holds a unit vector a row, ``values`` the exact
    eigenvalues of the covariance."""

    def __init__(self, n: int, sums: list[int], values: list[Fraction], components: np.ndarray, trace: Fraction):
        self.n, self.sums, self.values, self.components = n, sums, values, components
        self.explained = [float(v / trace) if trace else 0.0 for v in values]
        self.centre = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]
        scale = [1 / math.sqrt(float(v)) if v else 0.0 for v in values]
        self.project = (components * np.array(scale)[:, None]).T

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as int64, or as Python integers where that is too small."""
        y = x - self.centre
        most = int(max(abs(int(y.max())), abs(int(y.min())))) if y.size else 0
        if (most + 1) * self.n < 1 << 62:
            return self.n * y - np.array(self.rest, np.int64)
        return self.n * y.astype(object) - np.array(self.rest, object)

    def squared(self, dev: np.ndarray) -> list[int | None]:
        """Sum of squares of each row, exact; None beyond a long."""
        most = int(max(abs(int(dev.max())), abs(int(dev.min())))) if dev.size else 0
        if most * most * dev.shape[1] < 1 << 63:
            d = dev.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        sums = (dev.astype(object) ** 2).sum(axis=1).tolist()
        return [int(s) if s < 1 << 63 else None for s in sums]

    def whiten(self, dev: np.ndarray) -> np.ndarray:
        return (dev.astype(np.float64) / self.n) @ self.project


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on all vectors of column v (array<double>); None if no row is left."""
    n, dim, sums = fit_sums(vectors)
    if not n:
        return None
    a = scatter(vectors, n, sums)
    values, vecs = eigen(vectors.sparkSession, a, components)
    return Whitener(n, sums, [v / (n * n) for v in values], vecs, Fraction(int(np.trace(a)), n * n))


def identity_error(vectors: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over the
    components of positive eigenvalue; None if there is none."""
    k, dim = sum(v > 0 for v in model.values), len(model.sums)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for at, x in integers(b.column("v"), dim):
                if len(at):
                    w = model.whiten(model.deviations(x))[:, :k]
                    gram += w.T @ w
                    total += w.sum(axis=0)
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(np.vstack([gram, total]).ravel(), pa.float64())], names=["i", "j", "s"])

    found = np.zeros((k + 1, k))
    for r in vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        found[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


_RESULT = "n long, deviation long, component int, whitened double, explained double, identity_error double"


def apply(vectors: DataFrame, model: Whitener, error: float | None) -> DataFrame:
    """A row for each remaining vector (key, v) and component."""
    dim, count = len(model.sums), len(model.values)
    kind = vectors.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.array([v > 0 for v in model.values])
        for b in batches:
            for at, x in integers(b.column("v"), dim):
                dev = model.deviations(x)
                w = model.whiten(dev)
                row = np.repeat(np.arange(len(at)), count)
                yield pa.RecordBatch.from_arrays([
                    b.column("key").take(pa.array(at[row])), pa.array(np.full(len(row), model.n), pa.int64()), pa.array(model.squared(dev), pa.int64()).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, count + 1), len(at)), pa.int32()), pa.array(w.ravel(), pa.float64(), mask=~np.tile(flat, len(at))),
                    pa.array(np.tile(model.explained, len(at)), pa.float64()), pa.array([error] * len(row), pa.float64())],
                    names=["key", "n", "deviation", "component", "whitened", "explained", "identity_error"])
    return vectors.select("key", "v").mapInArrow(run, f"key {kind.simpleString()}, {_RESULT}")


def op11_embedding_whitening(embeddings: DataFrame) -> DataFrame:
    """Whitened components of every embedding.

    Dropped: null vectors, null or non-finite entries, entries whose integer is no long, and vectors
    of another length than the most frequent one (of equally frequent ones the longest). A component
    of eigenvalue 0 has explained 0 and whitened null (0 / 0), and identity_error is over the others
    (null if there is none). deviation is null beyond a long. Repeated rows and null ids count and are
    returned like others; no rows give no rows; other columns are not looked at.
    """
    small_batches(embeddings.sparkSession)
    vectors = embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    model = fit(vectors)
    if model is None:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, {_RESULT}")
    return apply(vectors, model, identity_error(vectors, model)).withColumnRenamed("key", "vec_id")
