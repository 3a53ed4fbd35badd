"""From sequences to latent coordinates: a feature backend, z-scores, exact components, unit range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import descriptors
from . import stats


def descriptor_vectors(df: DataFrame) -> DataFrame:
    """(id, x) of 24 descriptors."""
    return df.select("id", F.array(*(c.cast("double") for c in descriptors("sequence"))).alias("x"))


def language_model_vectors(df: DataFrame) -> DataFrame:
    """A hook for mean-pooled vectors of a protein language model."""
    raise RuntimeError("no protein language model is installed; register a backend that maps (id, sequence) to (id, x)")


BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {"descriptors": descriptor_vectors, "language_model": language_model_vectors}


def build_latents(sequences: DataFrame, dim: int = 5, backend: str = "descriptors") -> tuple[DataFrame, list[float]]:
    """``sequences(id, sequence)`` to (id, x) in [0, 1]^dim, and the explained shares of variance."""
    if backend not in BACKENDS:
        raise KeyError(f"unknown backend {backend!r}; there are {sorted(BACKENDS)}")
    raw = BACKENDS[backend](sequences)
    first = raw.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("there are no sequences")
    wide = [f"_x{k}" for k in range(first.n)]
    scaled = stats.zscore(raw.select("id", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate(wide))), wide)
    z, shares = stats.pca(scaled.select("id", F.array(*wide).alias("x")), "id", "x", dim)
    parts = [f"_z{k}" for k in range(dim)]
    unit = stats.minmax(z.select("id", *(F.get("z", F.lit(k)).alias(c) for k, c in enumerate(parts))), parts)
    return unit.select("id", F.array(*parts).alias("x")), shares


def check_latents(latents: DataFrame, dim: int, least: float = 1e-2) -> DataFrame:
    """Raises unless rows are ``dim`` wide, in [0, 1], and no two are closer than ``least``."""
    from ..sources.tables import check_matrix

    check_matrix(latents, dim, unit_range=True)
    pairs = stats.nearest_rows(latents, latents, "id", "x").where("near IS NOT NULL")
    worst = pairs.select("d", F.least("id", "near").alias("i"), F.greatest("id", "near").alias("j")).orderBy("d", "i", "j").first()
    if worst is not None and worst.d <= least:
        raise ValueError(f"rows {worst.i} and {worst.j} are too close: {worst.d:.4g} <= {least}")
    return latents
