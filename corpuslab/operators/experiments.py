"""Experiments: grids, configuration, search over trials, reports."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_grid(name: str, grid: dict[str, list], repeat: int = 1, base: dict | None = None) -> list[dict]:
    """One definition per combination and run, in the order of the grid's keys: <name>_combo<i>_run<j>."""
    out = []
    for i, values in enumerate(itertools.product(*grid.values()), 1):
        for run in range(1, repeat + 1):
            out.append(deepcopy(base or {}) | dict(zip(grid, values, strict=True)) | {"name": f"{name}_combo{i}_run{run}", "run": run})
    return out


def merge_config(defaults: dict, given: dict) -> dict:
    """Nested dictionaries are merged, other values replaced."""
    out = deepcopy(defaults)
    for k, v in given.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def bigram_keys(costs: dict) -> dict[tuple[str, str], float]:
    """Class bigram costs with "previous|||class" keys (JSON has no pairs) or pairs."""
    return {tuple(k.split("|||")) if isinstance(k, str) else tuple(k): float(v) for k, v in costs.items()}


def load_config(path: str, defaults: dict | None = None) -> dict:
    with open(path, encoding="utf-8") as f:
        return merge_config(defaults or {}, json.load(f))


def search(objective: Callable[[dict], float], space: dict[str, tuple | list], trials: int, seed: int = 42) -> list[dict]:
    """Seeded random search: lists are choices, (low, high) pairs ranges (of integers if both are). A trial that fails has
    an infinite value and its error. Sorted by value, then number."""
    rng, out = Random(seed), []
    for number in range(trials):
        params = {k: rng.choice(v) if isinstance(v, list) else rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v) for k, v in space.items()}
        try:
            out.append({"number": number, "value": float(objective(params)), "params": params, "error": None})
        except Exception as e:  # one bad trial doesn't end a study
            out.append({"number": number, "value": float("inf"), "params": params, "error": repr(e)})
    return sorted(out, key=lambda t: (t["value"], t["number"]))


def trials_table(spark: SparkSession, trials: list[dict]) -> DataFrame:
    """(number, value, param, setting, error) in long form."""
    rows = [(t["number"], t["value"], k, str(v), t["error"]) for t in trials for k, v in t["params"].items()]
    return spark.createDataFrame(rows, "number int, value double, param string, setting string, error string")


def run_variants(variants: dict[str, Callable[[], DataFrame]], parallel: int = 2) -> DataFrame:
    """The metric tables of several variants, made side by side as separate jobs, under their labels."""
    with ThreadPoolExecutor(parallel) as pool:
        made = dict(zip(variants, pool.map(lambda f: f(), variants.values()), strict=True))
    out = None
    for label, df in made.items():
        df = df.withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def report(metrics: DataFrame, rows: str = "lang", columns: str = "label", value: str = "value") -> DataFrame:
    """A rows by columns table of a long metric table."""
    return metrics.groupBy(rows).pivot(columns).agg(F.first(value)).orderBy(rows)


def markdown(table: DataFrame, digits: int = 4, missing: str = "MISSING") -> str:
    """A report-sized table as Markdown."""
    show = lambda x: missing if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return "\n".join([head, *("| " + " | ".join(map(show, r)) + " |" for r in table.toLocalIterator())])
