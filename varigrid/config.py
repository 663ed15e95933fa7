"""Thresholds of the protocol, each given once; every operator takes them from here or from its caller."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BoxConfig:
    """The homogeneity box."""

    box: int = 5
    cv_threshold: float = 0.15
    min_valid_fraction: float = 0.5
    sigma: float = 1.5
    iterations: int = 1  # passes of the sigma rejection
    mean_low: float = 0.2  # physically admissible means of a ratio
    mean_high: float = 5.0
    min_water_fraction: float | None = None  # a coarse cell enters only from this fraction on, if given


@dataclass(frozen=True)
class SearchConfig:
    """The search for the densest boxes."""

    box_deg: tuple[float, float] = (0.30, 0.20)
    cell_deg: float = 0.05
    top_n: int = 10
    min_separation_deg: float = 3.0
    bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    recent_since: str = "2023-01-01"


@dataclass(frozen=True)
class GateConfig:
    """Bars of the gates."""

    min_valid_pixels: int = 500
    corner_slack_px: float = 1.0
    min_water_share: float = 0.15
    min_green_over_nir: float = 1.05
    min_correlation: float = 0.60
    max_spread: float = 2.5
    gated_bands: tuple[float, ...] = (490.0, 560.0)
    min_pairs: int = 20
    max_structure_ratio: float = 0.75
    min_adjacent_pairs: int = 50
    min_noise_multiple: float = 1.5
    usable_fraction: float = 0.90
