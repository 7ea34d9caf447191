"""Parameters of an experiment, passed to every operator."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from math import inf


@dataclass(frozen=True)
class ExperimentConfig:
    """Defaults are fixed values: results depend on them."""

    # Traffic split
    experiment_name: str = "Coupon_Test_V1"
    split_ratio: float = 0.5

    # What-if response to the coupon: chance that a non-buyer buys
    base_conversion_lift: float = 0.08
    # (exclusive upper price limit, multiplier); the last limit is infinite
    price_multipliers: tuple[tuple[float, float], ...] = (
        (25.0, 2.0),
        (100.0, 1.5),
        (300.0, 1.0),
        (1000.0, 0.5),
        (inf, 0.2),
    )
    new_user_multiplier: float = 1.5
    cart_abandon_multiplier: float = 2.0
    weekend_multiplier: float = 1.2
    max_lift_probability: float = 0.95

    # Discount policy
    max_coupon_value: float = 50.0
    max_coupon_pct: float = 0.20

    # Guardrails
    confidence_level: float = 0.95
    srm_alpha: float = 0.001
    break_even_floor: float = -100.0

    # Price buckets, closed on the right; prices in no bucket get the last label
    price_bins: tuple[float, ...] = (0.0, 25.0, 100.0, 300.0, 1000.0, inf)
    price_labels: tuple[str, ...] = ("<$25", "$25-$100", "$100-$300", "$300-$1k", "$1k+")
    no_bucket_label: str = "nan"

    def __post_init__(self) -> None:
        if not 0.0 < self.split_ratio < 1.0:
            raise ValueError("split_ratio must lie strictly between 0 and 1")
        if len(self.price_labels) != len(self.price_bins) - 1:
            raise ValueError("price_labels needs one label per interval of price_bins")
        if any(lo >= hi for lo, hi in zip(self.price_bins, self.price_bins[1:])):
            raise ValueError("price_bins must increase")
        limits = [limit for limit, _ in self.price_multipliers]
        if limits != sorted(limits) or limits[-1] != inf:
            raise ValueError("price_multipliers must increase and end with an infinite limit")
        if not 0.0 < self.confidence_level < 1.0:
            raise ValueError("confidence_level must lie strictly between 0 and 1")


    @classmethod
    def from_json(cls, text: str) -> ExperimentConfig:
        """Defaults, overridden by a JSON object; `Infinity` is a valid number in it."""
        values = json.loads(text)
        known = {field.name for field in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return cls(**{name: _frozen(value) for name, value in values.items()})


def _frozen(value: object) -> object:
    return tuple(map(_frozen, value)) if isinstance(value, list) else value


DEFAULT = ExperimentConfig()
