"""Exact dot product, norm and cosine as built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def zero_if_undefined(similarity: Column) -> Column:
    """NaN and NULL similarity count as 0.0, before any filter or sort."""
    return F.coalesce(F.nanvl(similarity, F.lit(0.0)), F.lit(0.0))


def cosine_to(vector: Column, query: Sequence[float], stored_norm: Column | None = None) -> Column:
    """Cosine of ``vector`` with a literal query vector.

    The query norm is folded here, once. Pass ``stored_norm`` when the table
    keeps norms, which halves the work per row. A vector of another length is
    an error, as it would otherwise silently score 0.
    """
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    literal = F.array(*[F.lit(float(x)) for x in query])
    length = stored_norm if stored_norm is not None else norm(vector)
    value = F.try_divide(dot(vector, literal), length * F.lit(size))
    checked = F.when(vector.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.size(vector) == len(query), value).otherwise(
            F.raise_error(F.lit(f"vector length differs from query length {len(query)}")).cast("double")
        )
    )
    return zero_if_undefined(checked)


def batch_cosine_to(vector: Column, query: Sequence[float], stored_norm: Column | None = None) -> Column:
    """As ``cosine_to``, one matrix product per Arrow batch.

    Marked as not deterministic, so that a filter on the score reads it instead of computing it again.
    """
    wanted = np.asarray(query, np.float64)
    size = float(np.sqrt(wanted @ wanted)) or 1.0

    def scores(vectors: pa.Array, norms: np.ndarray | None) -> pa.Array:
        out = np.zeros(len(vectors))
        there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        found = vectors.drop_null()
        if len(found) and not pc.all(pc.equal(pc.list_value_length(found), len(wanted))).as_py():
            raise ValueError(f"vector length differs from query length {len(wanted)}")
        rows = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(found), len(wanted))
        lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows)) if norms is None else norms[there]
        with np.errstate(divide="ignore", invalid="ignore"):
            found_scores = rows @ wanted / (lengths * size)
        out[there] = np.where(np.isfinite(found_scores), found_scores, 0.0)
        return pa.array(out)

    if stored_norm is None:

        @F.arrow_udf("double")
        def plain(vectors: pa.Array) -> pa.Array:
            return scores(vectors, None)

        return plain.asNondeterministic()(vector)

    @F.arrow_udf("double")
    def normed(vectors: pa.Array, norms: pa.Array) -> pa.Array:
        return scores(vectors, norms.to_numpy(zero_copy_only=False).astype(np.float64))

    return normed.asNondeterministic()(vector, stored_norm)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; an all-zero query side counts as norm 1."""
    length_b = norm(b)
    length_b = F.when(length_b == 0, F.lit(1.0)).otherwise(length_b)
    return zero_if_undefined(F.try_divide(dot(a, b), norm(a) * length_b))


def has_dimension(vector: Column, dimension: int) -> Column:
    """True for usable vectors: right length, no NULL element."""
    return (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull())
