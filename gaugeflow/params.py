"""Parameters of the operators. Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TruthParams:
    p1_max_mm: float = 5.0
    p10_max_mm: float = 50.0
    mass_tol_abs_mm: float = 0.21
    mass_tol_rel: float = 0.20
    dry_tol_mm: float = 0.11
    tip_mm: float = 0.1
    dense_half: int = 60
    dense_share: float = 0.9
    block: int = 10


@dataclass(frozen=True)
class GateParams:
    min_valid_frac: float = 0.5
    min_rain_windows: int = 50
    min_rain_coverage: float = 0.8
    mass_ratio_range: tuple[float, float] = (0.8, 1.25)


@dataclass(frozen=True)
class StationParams:
    include: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = ("04",)
    bbox: tuple[float, float, float, float] = (7.5, 54.4, 15.5, 58.0)


@dataclass(frozen=True)
class ChannelParams:
    met_max_age: int = 30
    p10_max_age: int = 30
    p10_age_cap: int = 60
    met_age_cap: int = 120
    rings_km: tuple[float, float] = (25.0, 60.0)
    wind_radius_km: float = 60.0
    pad: int = 240


@dataclass(frozen=True)
class FeatureParams:
    lags: int = 10
    roll_windows: tuple[int, ...] = (5, 10, 30, 60)
    since_cap: int = 1440
    wet_run_cap: int = 600
    dry_run_cap: int = 1440


@dataclass(frozen=True)
class SampleParams:
    dry_keep_frac: float = 0.03
    context: int = 120
    seed: int = 42
    min_part_rows: int = 60


@dataclass(frozen=True)
class RadarParams:
    latency: int = 5
    tolerance: int = 40
    max_lead: int = 25
    wet_mmh: float = 0.1
    windows: tuple[int, int, int] = (3, 11, 31)
    size: int = 520
    tile: int = 128
    tile_step: int = 64
    min_wet: float = 0.02
    global_min_wet: float = 0.005
    max_speed: float = 2.5
    min_peak: float = 0.05
    max_gap: int = 30
    radius_px: float = 150.0
    prior_weight: float = 0.05


@dataclass(frozen=True)
class EvalParams:
    intensity_mmh: tuple[float, ...] = (2.5, 10.0)
    bootstrap: int = 500
    reference: str = "persistence"
    min_coverage: float = 0.9
    n_grid: int = 200
    seed: int = 42


@dataclass(frozen=True)
class LinkParams:
    rain_height_km: float = 2.6
    default_lat: float = 56.0
    margins_db: tuple[int, ...] = (3, 5, 10)
    scenarios: tuple[dict, ...] = field(
        default_factory=lambda: (
            {"name": "23GHz_2km_V", "f_ghz": 23.0, "d_km": 2.0, "pol": "V"},
            {"name": "38GHz_1km_V", "f_ghz": 38.0, "d_km": 1.0, "pol": "V"},
            {"name": "80GHz_0.5km_H", "f_ghz": 80.0, "d_km": 0.5, "pol": "H"},
            {"name": "Ka20GHz_sat_el25", "f_ghz": 20.0, "elevation_deg": 25.0, "pol": "circular",
             "station_height_km": 0.05},
        )
    )
