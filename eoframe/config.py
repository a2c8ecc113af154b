"""Frozen configuration objects; their values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from eoframe import fixed_values as fv


@dataclass(frozen=True)
class ValidationConfig:
    allow_benchmark_formats: bool = False
    allowed_formats: tuple[str, ...] = ("GEOTIFF", "TIFF")
    require_crs: bool = True
    supported_epsg: tuple[int, ...] = field(default_factory=lambda: tuple(fv.supported_epsg_codes()))
    min_resolution_m: float | None = 0.01
    max_resolution_m: float | None = 1000.0
    min_side: int = 16
    max_side: int = 65536
    required_optical_bands: tuple[str, ...] = ()
    required_sar_bands: tuple[str, ...] = ()
    required_band_count: int | None = None
    min_overlap_iou: float = 0.50
    max_resolution_difference: float = 0.25
    grid_tolerance: float = 0.05


@dataclass(frozen=True)
class ConfidenceConfig:
    paired_model: float = 0.50
    paired_agreement: float = 0.30
    paired_quality: float = 0.20
    single_model: float = 0.70
    single_quality: float = 0.30
    disagreement_penalty: float = 0.20
    partial_penalty: float = 0.08
    cloud_weight: float = 0.40
    metadata_weight: float = 0.30
    alignment_weight: float = 0.30
    default_model_confidence: float = 0.50
    version: str = "1.0.0"
    version: str = "1.0.0"

    def __post_init__(self) -> None:
        for total in (
            self.paired_model + self.paired_agreement + self.paired_quality,
            self.single_model + self.single_quality,
        ):
            if not 0.99 <= total <= 1.01:
                raise ValueError(f"confidence weights must sum to 1, got {total:.3f}")


@dataclass(frozen=True)
class OpticalConfig:
    use_10m: bool = True
    use_20m: bool = True
    use_60m: bool = False
    target_resolution_m: int = 10
    resample_method: str = "bilinear"
    normalize_method: str = "standardize"
    clip_low: float = 2.0
    clip_high: float = 98.0
    indices: tuple[str, ...] = ("NDVI", "NDWI")
    rgb_bands: tuple[str, ...] = ("B04", "B03", "B02")


@dataclass(frozen=True)
class HealthConfig:
    failure_threshold: int = 3
    recovery_ms: int = 10_000
