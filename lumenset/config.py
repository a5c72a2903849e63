"""Parameters of the curation pipeline with their defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


#: The keys of the configuration and their defaults.


@dataclass(frozen=True)
class ImageRules:
    min_width: int = 256
    min_height: int = 256
    blur_threshold: float = 80.0
    aspect_ratio_min: float = 0.5
    aspect_ratio_max: float = 2.0
    compression_heuristic: bool = False
    compression_size_per_pixel: float = 0.15


@dataclass(frozen=True)
class Config:
    source_dirs: tuple[str, ...] = ()
    class_map: dict[str, str] = field(default_factory=dict)
    image_rules: ImageRules = ImageRules()
    artifacts_dir: str = "artifacts"
    export_root: str = "export"
    project_root: str = "."
    dataset_version: str = "v1"
    phash_hamming_threshold: int = 8
    phash_bucket_chars: int = 12
    phash_cluster_threshold: int = 8
    class_targets: dict[str, int] = field(default_factory=dict)
    max_total_images: int | None = None
    per_source_max_fraction: float | None = None
    min_quality_score: float | None = None
    split_ratios: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "val": 0.1, "test": 0.1})
    random_seed: int = 42
    max_images_per_split: int | None = None
    overwrite_existing: bool = False
    verify_hashes: bool = True
    strict_mode: bool = False
    max_missing_pct: float = 1.0
    max_leakage_allowed: int = 0
    max_malformed_pct: float = 1.0
    max_low_quality_pct: float = 10.0
    quality_hist_bins: tuple[float, ...] = (0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
    anomaly_cap: int = 1000
    known_sources: tuple[str, ...] = ()


#: Keys that a configuration file must hold.
REQUIRED = ("source_dirs", "artifacts_dir", "export_root", "image_rules", "split_ratios")


def missing_keys(raw: dict) -> list[str]:
    return sorted(set(REQUIRED) - set(raw))


def from_dict(raw: dict) -> Config:
    """Unknown keys are ignored, missing ones take their defaults."""
    known = {f.name for f in fields(Config)}
    args = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None}
    if isinstance(args.get("image_rules"), dict):
        rules = {f.name for f in fields(ImageRules)}
        args["image_rules"] = ImageRules(**{k: v for k, v in args["image_rules"].items() if k in rules})
    return Config(**args)


def load_config(path: str, required: bool = True) -> Config:
    """Reads JSON, or YAML if a YAML library is installed. Raises ValueError for missing keys."""
    text = Path(path).resolve().read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need a YAML library; JSON works without") from e
        raw = yaml.safe_load(text)
    if required and (gone := missing_keys(raw)):
        raise ValueError(f"missing keys: {', '.join(gone)}")
    return from_dict(raw)


def choose(given, summary, default):
    """Command line before summary before default; the first that is not None."""
    return next((x for x in (given, summary) if x is not None), default)


def redacted(raw: dict, words: tuple[str, ...] = ("secret", "token", "password", "key")) -> dict:
    """Without entries whose name holds one of the words, at any depth."""
    return {k: redacted(v, words) if isinstance(v, dict) else v for k, v in raw.items() if not any(w in str(k).lower() for w in words)}
