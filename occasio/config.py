"""Settings: environment over defaults, checked when read, with a fingerprint for cached artifacts."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields
from typing import get_type_hints


class ConfigError(ValueError):
    """A setting is out of range or contradicts another one."""


@dataclass(frozen=True)
class Config:
    """The engine's settings. ``from_env`` reads OCCASIO_<NAME>; "none" means null."""

    min_basket_products: int = 2
    top_k_edges: int = 10
    chunk_size: int = 50_000
    train_samples: int = 300_000
    seed: int = 42
    vector_dim: int = 64
    knn_k: int = 15
    mutual_knn: bool = True
    knn_method: str = "exact"
    knn_recall: float = 0.95
    resolution: float = 1.0
    leiden_iterations: int = 10
    leiden_edge_cap: int = 2_000_000
    leiden_method: str = "driver"
    min_graph_coverage: float = 0.95
    gmm_components: int = 10
    gmm_covariance: str = "diag"
    gmm_regularization: float = 1e-6
    vote_k: int = 15
    max_week_gap: int | None = 1
    min_transition_support: int = 30
    journey_depth: int = 3
    journey_beam: int = 5
    profile_top_n: int = 10
    min_product_baskets: int = 200
    pca_removed: int = 2
    epochs: int = 20
    hidden_dim: int = 64
    learning_rate: float = 1e-3
    stale_after_seconds: int = 3600
    export_row_cap: int = 1_000_000
    size_band: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        for name, low, high in (
            ("min_basket_products", 1, None), ("top_k_edges", 1, None), ("chunk_size", 1, None), ("train_samples", 1, None),
            ("vector_dim", 1, None), ("knn_k", 1, None), ("resolution", 0, None), ("leiden_iterations", 1, None),
            ("min_graph_coverage", 0, 1), ("gmm_components", 1, None), ("gmm_regularization", 0, None), ("vote_k", 1, None),
            ("min_transition_support", 0, None), ("journey_depth", 1, None), ("journey_beam", 1, None), ("profile_top_n", 1, None),
            ("min_product_baskets", 1, None), ("pca_removed", 0, None), ("epochs", 1, None), ("hidden_dim", 1, None),
        ):
            v = getattr(self, name)
            if v < low or high is not None and v > high:
                raise ConfigError(f"{name} is {v}; it must be {f'from {low} to {high}' if high is not None else f'at least {low}'}")
        if self.max_week_gap is not None and self.max_week_gap < 1:
            raise ConfigError("max_week_gap must be at least 1, or none")
        if self.gmm_covariance not in ("diag", "full", "tied", "spherical"):
            raise ConfigError(f"gmm_covariance is {self.gmm_covariance!r}; it must be diag, full, tied or spherical")
        if not 0 < self.knn_recall <= 1:
            raise ConfigError("knn_recall must be above 0 and at most 1")
        if self.knn_method not in ("exact", "approximate") or self.leiden_method not in ("driver", "joins"):
            raise ConfigError("knn_method is exact or approximate, leiden_method is driver or joins")
        if self.size_band is not None and self.size_band[0] > self.size_band[1]:
            raise ConfigError("size_band must be (low, high)")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        kinds, got = get_type_hints(cls), {}
        for f in fields(cls):
            raw = env.get(f"OCCASIO_{f.name.upper()}")
            if raw is None:
                continue
            if raw.strip().lower() in ("none", ""):
                if "None" not in str(kinds[f.name]):
                    raise ConfigError(f"{f.name} can't be none")
                got[f.name] = None
                continue
            try:
                if kinds[f.name] is bool:
                    got[f.name] = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[raw.strip().lower()]
                elif f.name == "size_band":
                    low, high = raw.split(",")
                    got[f.name] = (int(low), int(high))
                elif "int" in str(kinds[f.name]):
                    got[f.name] = int(raw)
                elif kinds[f.name] is float:
                    got[f.name] = float(raw)
                else:
                    got[f.name] = raw
            except (KeyError, ValueError) as e:
                raise ConfigError(f"{f.name}: {raw!r} can't be read") from e
        return cls(**got)

    def fingerprint(self, *names: str) -> str:
        """A digest of the named settings (all, if none is named)."""
        chosen = {k: v for k, v in asdict(self).items() if not names or k in names}
        return hashlib.sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()
