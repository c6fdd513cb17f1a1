"""Fixed-length ``ARRAY<DOUBLE>`` vectors.

``rank`` given: the expression is unrolled, so it stays inside generated code.
``rank`` missing: a higher-order function that fits any length.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from geoaffinity.functions.hashing import hash_uniform


def _add(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def dot(a: Column, b: Column, rank: int | None = None) -> Column:
    if rank is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                           lambda acc, x: acc + x)
    return _add([F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(rank)])


def axpy(a: Column, b: Column, wa=1.0, wb=1.0, rank: int | None = None) -> Column:
    """``wa * a + wb * b``; the weights are numbers or columns."""
    wa, wb = (w if isinstance(w, Column) else F.lit(float(w)) for w in (wa, wb))
    if rank is None:
        return F.zip_with(a, b, lambda x, y: x * wa + y * wb)
    return F.array(*[F.get(a, F.lit(i)) * wa + F.get(b, F.lit(i)) * wb for i in range(rank)])


def scale(a: Column, w) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.transform(a, lambda x: x * w)


def div_safe(a: Column, w) -> Column:
    """``a / w``, and ``a`` itself where ``w`` is zero."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.when(w == 0, a).otherwise(F.transform(a, lambda x: x / F.nullif(w, F.lit(0.0))))


def norm2(a: Column, rank: int | None = None) -> Column:
    return dot(a, a, rank)


def norm(a: Column, rank: int | None = None) -> Column:
    return F.sqrt(norm2(a, rank))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Passing a heavy expression to a body that uses it several times would repeat
    it; bound to a lambda variable it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(a: Column) -> Column:
    return let(norm(a), lambda length: div_safe(a, length))


def random_unit_vector(rank: int, *keys) -> Column:
    """Uniform [0,1) entries decided by the keys, scaled to length one."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda i: hash_uniform(*keys, i))
    return let(raw, normalise)


def sum_vectors(v: Column, rank: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum. Plain sums, so partial aggregation applies."""
    parts = [F.get(v, F.lit(i)) for i in range(rank)]
    if weight is not None:
        parts = [weight * p for p in parts]
    return F.array(*[F.sum(p) for p in parts])
