"""Settings of a conversion: defaults, ranges, presets and their JSON form."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of the browser's settings and of the batch options, and the keys of settings of an older form (fixed values).
DEFAULTS = {"clusteringMode": "color", "hierarchical": "stacked", "filterSpeckle": 4.0, "colorPrecision": 6.0, "layerDifference": 16.0, "mode": "none", "cornerThreshold": 60.0, "lengthThreshold": 4.0, "spliceThreshold": 45.0, "pathPrecision": 8.0}
RANGES = {"colorPrecision": (1, 8), "filterSpeckle": (0, 16), "layerDifference": (0, 255), "cornerThreshold": (0, 180), "pathPrecision": (0, 16), "spliceThreshold": (0, 180)}


@dataclasses.dataclass(frozen=True)
class BatchOptions:
    """Options of a whole conversion."""

    palette_size: int = 16
    simplify_tolerance: float = 4.5
    smoothing: float = 0.35
    speckle_threshold: int = 10
    corner_threshold: float = 50.0
    min_layer_coverage: float = 0.003
    max_paths_per_layer: int = 5
    min_layer_count: int = 5
    max_layer_count: int = 8


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def tracer_options(settings: dict[str, Column] | None = None) -> dict[str, Column]:
    """Rounded and clamped options by name; missing ones have the defaults."""
    own = {k: F.lit(v) for k, v in DEFAULTS.items()} | (settings or {})
    out = {k: clamp(F.floor(F.coalesce(own[k], F.lit(DEFAULTS[k])) + 0.5), *r).cast("int") for k, r in RANGES.items()}
    out["lengthThreshold"] = F.format_number(clamp(F.coalesce(own["lengthThreshold"], F.lit(DEFAULTS["lengthThreshold"])), 3.5, 10.0), 2).cast("double")
    out["maxIterations"] = F.lit(10)
    for k in ("clusteringMode", "hierarchical", "mode"):
        out[k] = F.coalesce(own[k], F.lit(DEFAULTS[k]))
    return out


def speckle_area(v: Column) -> Column:
    return v * v


def path_mode(name: Column) -> Column:
    """A known mode; unknown names and null are splines."""
    return F.when(name.isin("polygon", "none"), name).otherwise(F.lit("spline"))


#: Floor and factor of the simplification tolerance of each preset (fixed values); other names count as balanced.
PRESETS = {"strict-fidelity": (0.18, 0.4), "fidelity": (0.25, 0.55), "minimal-nodes": (1.2, 1.7), "balanced": (0.45, 0.85)}


def preset_tolerance(base: Column, preset: Column) -> Column:
    floor, factor = PRESETS["balanced"]
    out = F.greatest(base * factor, F.lit(floor))
    for name, (low, times) in PRESETS.items():
        out = F.when(preset == name, F.greatest(base * times, F.lit(low))).otherwise(out)
    return out


def merged_settings(text: str | None, legacy: tuple[str, ...] = ("paletteMode", "paletteSize", "optimizePreset")) -> dict:
    """Settings from JSON over the defaults; the defaults for bad JSON and for settings of an older form."""
    try:
        own = json.loads(text or "{}")
    except ValueError:
        return dict(DEFAULTS)
    if not isinstance(own, dict) or any(k in own for k in legacy):
        return dict(DEFAULTS)
    return DEFAULTS | {k: v for k, v in own.items() if k in DEFAULTS}


def settings_column(text: Column, legacy: tuple[str, ...] = ("paletteMode", "paletteSize", "optimizePreset")) -> Column:
    """The same as a struct of a column of JSON."""
    old = F.lit(False)
    for k in legacy:
        old = old | F.get_json_object(text, f"$.{k}").isNotNull()
    fields = []
    for k, v in DEFAULTS.items():
        own = F.get_json_object(text, f"$.{k}")
        own = own if isinstance(v, str) else own.try_cast("double")
        fields.append(F.when(old, F.lit(v)).otherwise(F.coalesce(own, F.lit(v))).alias(k))
    return F.struct(*fields)


def parse_flags(argv: list[str], options: BatchOptions | None = None) -> BatchOptions:
    """--name value pairs over the options; values are numbers where they parse, unknown names are ignored."""
    out = dataclasses.asdict(options or BatchOptions())
    for flag, value in zip(argv, argv[1:], strict=False):
        name = flag.removeprefix("--").replace("-", "_")
        if flag.startswith("--") and name in out:
            try:
                out[name] = type(out[name])(float(value))
            except ValueError:
                continue
    return BatchOptions(**out)
