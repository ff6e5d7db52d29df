"""Settings, presets and the parameters derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Preset, background, ink, low, high, diameter, sigma, passes.
PRESETS = [
    ("manga", (255, 255, 255), (0, 0, 0), 28, 96, 9, 72, 2),
    ("studio", (248, 245, 237), (23, 33, 47), 38, 118, 7, 52, 2),
    ("neon", (10, 8, 22), (0, 230, 200), 22, 80, 9, 68, 2),
    ("warm", (255, 248, 232), (102, 48, 14), 32, 104, 7, 58, 2),
    ("vivid", (255, 255, 255), (26, 26, 180), 18, 66, 11, 96, 2),
    ("blueprint", (225, 237, 245), (19, 57, 92), 48, 144, 5, 44, 1),
]
NAMES = [p[0] for p in PRESETS]
#: The labels, and what a custom preset starts from.
LABELS = {"manga": "Manga Contrast", "studio": "Studio Ink", "neon": "Neon Pop", "warm": "Warm Sketch", "vivid": "Vivid Toon", "blueprint": "Blueprint Draft", "custom": "Custom / Experiment"}
CUSTOM = ("custom", (255, 255, 255), (0, 0, 0), 40, 100, 13, 90)
#: Smallest component area kept, by intensity of speckle cleaning.
MIN_AREA = {1: 4, 2: 12, 3: 30}
RGB = "struct<r:int,g:int,b:int>"


@dataclass(frozen=True)
class Preset:
    key: str
    background: tuple
    ink: tuple
    low: int
    high: int
    diameter: int
    sigma: int
    passes: int = 1


def preset(key: str, **values) -> Preset:
    """A catalogue preset, or for ``custom`` one of the given values over its defaults."""
    if key == "custom":
        return replace(Preset(*CUSTOM), **values)
    found = next((Preset(*p) for p in PRESETS if p[0] == key), None)
    if found is None:
        raise ValueError(f"no preset is called {key}")
    return found


@dataclass(frozen=True)
class Settings:
    """One render's parameters. The optional stages act for a custom preset only;
    automatic normalisation is on unless a custom preset turns it off."""

    preset: Preset = field(default_factory=lambda: preset("manga"))
    custom: bool = False
    detail: int = 62
    line_weight: int = 2
    scale: float = 0.75
    fps: float = 18.0
    bilateral: bool = True
    bilateral_passes: int = 2
    gaussian: bool = False
    gaussian_passes: int = 1
    median: bool = False
    median_passes: int = 1
    clean_speckles: bool = True
    clean_intensity: int = 3
    auto_normalize: bool = True
    dark_boost: bool = False
    dark_boost_clip: float = 2.5
    merge_double_edge: bool = True
    merge_intensity: int = 3
    color_edges: bool = False
    color_low: int = 15
    color_high: int = 45
    color_line_weight: int = 1
    color_softness: int = 0
    color_opacity: float = 1.0

    def derived(self) -> dict[str, int]:
        up = lambda x: int(x // 1 + (x % 1 >= 0.5))  # noqa: E731  half up
        f = self.detail / 62
        low = max(12, up(self.preset.low / f))
        sigma = max(20, up(self.preset.sigma * (0.75 + (self.detail - 35) / 100)))
        return {"low": low, "high": max(low + 24, up(self.preset.high / f)), "sigma": sigma, "refine": max(15, up(sigma * 0.5))}


def preset_table(spark) -> DataFrame:
    return spark.createDataFrame(PRESETS, f"preset string, background {RGB}, ink {RGB}, low0 int, high0 int, diameter int, sigma0 int, passes int")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def derived_parameters(df: DataFrame) -> DataFrame:
    """Adds low, high, sigma and refine from low0, high0, sigma0 and detail."""
    f = F.col("detail") / 62
    df = df.withColumn("low", F.greatest(F.lit(12), half_up(F.col("low0") / f)).cast("int"))
    df = df.withColumn("high", F.greatest(F.col("low") + 24, half_up(F.col("high0") / f)).cast("int"))
    df = df.withColumn("sigma", F.greatest(F.lit(20), half_up(F.col("sigma0") * (F.lit(0.75) + (F.col("detail") - 35) / 100))).cast("int"))
    return df.withColumn("refine", F.greatest(F.lit(15), half_up(F.col("sigma") * 0.5)).cast("int"))
