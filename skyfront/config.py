"""Constants of a campaign, as one immutable record."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

#: Fixed value: the twenty standard residues, in the order of the composition features.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


@dataclass(frozen=True)
class Settings:
    seed: int = 123
    batch_size: int = 4
    n_initial: int = 12
    n_rounds: int = 6
    latent_dim: int = 5
    num_objectives: int = 2
    library_size: int = 2048
    num_restarts: int = 10
    raw_samples: int = 128
    mc_samples: int = 64
    ref_point: tuple[float, float] = (-0.05, -0.05)
    noise_sigma: tuple[float, float] = (0.05, 0.05)
    projection: str = "nearest"

    def __post_init__(self):
        if not len(self.ref_point) == len(self.noise_sigma) == self.num_objectives:
            raise ValueError("ref_point and noise_sigma need one entry per objective")
        if self.n_initial <= 0 or self.batch_size <= 0:
            raise ValueError("n_initial and batch_size must be positive")

    @property
    def latent_bounds(self) -> list[tuple[float, float]]:
        return [(0.0, 1.0)] * self.latent_dim


DEFAULTS = Settings()


def seed_everything(seed: int = DEFAULTS.seed) -> np.random.Generator:
    """Seeds the driver's global generators and gives one of its own. Executors draw nothing:
    what varies there is a hash of seed and id."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)
