"""Column functions on pixels, scores, paths and parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COST_SCALE = 15.0
COST_FLOOR = 1e-6
UNKNOWN_CLASS = 0.01
# The colours of classes in map layers.
CLASS_COLOURS = {"Healthy": "#39FF14", "Yellowish": "#FFFF00", "Dead": "#000000"}
OTHER_COLOUR = "red"
# Parameters that name files, and of those the ones that a job writes.
INPUT_KEYS = ("raster_path", "model_path", "aoi_path")
OUTPUT_KEYS = ("bbox_output_path", "centroid_output_path", "output_path", "road_output_path", "mask_output_path")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_second(first: Column, second: Column) -> Column:
    """Probability of the second of two classes."""
    return 1 / (1 + F.exp(first - second))


def argmax_class(logits: Column) -> Column:
    """Position from 0 of the largest value; the first of equal ones; null for an empty array."""
    return F.when(F.size(logits) > 0, (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))


def cost(p: Column) -> Column:
    """Cost of stepping on a pixel of probability p."""
    return F.greatest((1 - p) * COST_SCALE, F.lit(COST_FLOOR))


def normalise_mask(v: Column) -> Column:
    return F.when(v == 255, F.lit(1)).otherwise(v)


def class_threshold(category: Column, thresholds: dict[str, float]) -> Column:
    """The threshold of a class; an unknown one has UNKNOWN_CLASS."""
    known = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))]) if thresholds else None
    return F.coalesce(F.try_element_at(known, category), F.lit(UNKNOWN_CLASS)) if thresholds else F.lit(UNKNOWN_CLASS)


def layer_colour(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CLASS_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit(OTHER_COLOUR))


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def private_params(params: Column) -> Column:
    """A map of parameters in which every value whose key speaks of a path or dir is its base name only."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).contains("path") | F.lower(k).contains("dir"), basename(v)).otherwise(v))


def file_state(listed: Column, wanted: Column, found: Column, size: Column) -> Column:
    """Whether a file is good: a listed one must have the wanted hash, any other must be there and not empty."""
    return F.when(listed, F.coalesce(found == wanted, F.lit(False))).otherwise(F.coalesce(size > 0, F.lit(False)))


def resolve_device(asked: str, cuda: bool = False, mps: bool = False) -> str:
    """The device to run on: cpu, or for "gpu" the first there is, or what is asked for by name."""
    name = (asked or "cpu").strip().lower()
    if name == "gpu":
        return "cuda:0" if cuda else "mps" if mps else "cpu"
    return name


def device(asked: Column, cuda: bool = False, mps: bool = False) -> Column:
    """resolve_device for a column; a null is cpu."""
    name = F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    return F.when(name == "", "cpu").when(name == "gpu", "cuda:0" if cuda else "mps" if mps else "cpu").otherwise(name)
