"""Recipes: the recommendation matrix and the automatic rotation gains, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES = ("PHASE_CONTRAST", "BRIGHTFIELD_DIC", "DENSE_FLUORESCENCE", "SPARSE_LOW_LIGHT_FLUORESCENCE", "FIDUCIAL_STATIC")
MOTIONS = ("CURVED_OSCILLATING_DRIFT", "STEADY_DIRECTIONAL_DRIFT", "SUBPIXEL_RANDOM_WALK", "INTERMITTENT_JUMPS")

#: Norm, support, floor, ceiling, iterations and samples of each preset.
PRESETS = {
    "LEAST_SQUARES": ("LEAST_SQUARES", "ALL", None, None, 25, 200_000),
    "HUBER": ("HUBER", "ALL", None, None, 25, 200_000),
    "TUKEY": ("TUKEY", "GRADIENT", None, None, 25, 200_000),
    "TUKEY_FLOOR_25": ("TUKEY", "GRADIENT", 25.0, None, 25, 200_000),
    "TUKEY_CEILING_90": ("TUKEY", "GRADIENT", None, 90.0, 25, 200_000),
    "TUKEY_CEILING_75": ("TUKEY", "GRADIENT", None, 75.0, 25, 200_000),
    "TUKEY_MUTUAL": ("TUKEY", "MUTUAL_NOISE_GRADIENT", None, None, 12, 50_000),
}
#: Preset, filter and percent of masked pixels for each image type (rows) and motion type (columns).
MATRIX = (
    (("LEAST_SQUARES", "NONE", 0), ("TUKEY_MUTUAL", "NONE", 0), ("HUBER", "GAUSSIAN_1_0", 0), ("HUBER", "GAUSSIAN_0_7", 0)),
    (("HUBER", "NONE", 0), ("LEAST_SQUARES", "NONE", 0), ("HUBER", "MEDIAN_3X3", 0), ("LEAST_SQUARES", "NONE", 0)),
    (("TUKEY_FLOOR_25", "NONE", 0), ("HUBER", "NONE", 0), ("TUKEY_MUTUAL", "NONE", 0), ("TUKEY_MUTUAL", "NONE", 0)),
    (("TUKEY_CEILING_75", "NONE", 25), ("TUKEY_CEILING_75", "MEDIAN_3X3", 25), ("TUKEY_CEILING_90", "NONE", 0), ("TUKEY", "NONE", 25)),
    (("LEAST_SQUARES", "NONE", 0), ("TUKEY_CEILING_75", "NONE", 0), ("HUBER", "NONE", 0), ("LEAST_SQUARES", "NONE", 0)),
)
#: Least residual gain that a rotation must bring.
ROTATION_GAIN = {"BRIGHTFIELD_DIC": 0.001, "DENSE_FLUORESCENCE": 0.002, "FIDUCIAL_STATIC": 0.005, "SPARSE_LOW_LIGHT_FLUORESCENCE": 0.010, "PHASE_CONTRAST": 0.010}

SCHEMA = "image string, motion string, norm string, support string, floor double, ceiling double, filter string, mask_percent double, outlier_mads double, iterations int, max_samples int, rotation_gain double"


def matrix(spark: SparkSession) -> DataFrame:
    """One row for each image and motion type."""
    rows = []
    for image, line in zip(IMAGES, MATRIX, strict=True):
        for motion, (preset, kind, percent) in zip(MOTIONS, line, strict=True):
            norm, support, floor, ceiling, iterations, samples = PRESETS[preset]
            rows.append((image, motion, norm, support, floor, ceiling, kind, float(percent), 0.0 if motion == "INTERMITTENT_JUMPS" else 6.0, iterations, samples, ROTATION_GAIN[image]))
    return spark.createDataFrame(rows, SCHEMA)


def recommend(image: str, motion: str) -> dict:
    """Options for one image and motion type; forgiving about case and punctuation."""
    import re

    plain = lambda s: re.sub("[^A-Z0-9]+", "_", s.upper().strip()).strip("_")
    image, motion = plain(image), plain(motion)
    if image not in IMAGES or motion not in MOTIONS:
        raise ValueError(f"unknown type {image} or {motion}")
    preset, kind, percent = MATRIX[IMAGES.index(image)][MOTIONS.index(motion)]
    norm, support, floor, ceiling, iterations, samples = PRESETS[preset]
    from driftlake.kernels.fit import Options

    options = Options(norm=norm, support=support, floor=floor, ceiling=ceiling, iterations=iterations, max_samples=samples)
    return {"options": options, "filter_": kind, "outlier_mads": 0.0 if motion == "INTERMITTENT_JUMPS" else 6.0, "mask": "REMOVE_LEAST_INFORMATIVE" if percent else None, "mask_percent": float(percent)}


def emission_policy(image: str, motion: str) -> dict | None:
    """The fixed route of emission images: previous-image ECC on filtered planes for dense ones, the preset for sparse
    ones; None for other types."""
    from driftlake.kernels.fit import Options

    if image == "DENSE_FLUORESCENCE":
        options = Options(estimator="AREA_CORRELATION_ECC", support="GRADIENT", gradient_fraction=0.5, ceiling=90.0, iterations=25, max_samples=200_000)
        return {"options": options, "reference": "CONSECUTIVE", "filter_": "MEDIAN_3X3", "outlier_mads": 0.0, "mask": None}
    return recommend(image, motion) if image == "SPARSE_LOW_LIGHT_FLUORESCENCE" else None


def pilot() -> dict:
    """Neutral settings for a first look at a recording: nothing that a selector might choose."""
    from driftlake.kernels.fit import Options

    return {"options": Options(), "reference": "MULTILAG", "filter_": "NONE", "outlier_mads": 0.0, "mask": None}
