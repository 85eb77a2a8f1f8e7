"""Recipes: pipelines as JSON, run through a fixed table of steps."""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.storage import cut
from ..operators import aggregate, derive, exposure, filters, joins, quality, standardize
from .meta import HealthFrame, Stage

#: Names a recipe may use, and the stage that each leads to.
STEPS: dict[str, tuple[Callable[..., DataFrame], Stage | None]] = {
    "standardize": (standardize.standardize, Stage.STAND),
    "filter_diagnosis": (filters.filter_diagnosis, Stage.FILTER_CID),
    "filter_demographics": (filters.filter_demographics, Stage.FILTER_DEMO),
    "drop_ignored": (filters.drop_ignored, Stage.FILTER_DEMO),
    "calendar_variables": (derive.calendar_variables, Stage.DERIVE),
    "age_variables": (derive.age_variables, Stage.DERIVE),
    "drop_invalid_geo": (aggregate.drop_invalid_geo, None),
    "aggregate_series": (aggregate.aggregate_series, Stage.AGGREGATE),
    "grid_join": (joins.grid_join, Stage.CLIMATE),
    "quality_control": (quality.quality_control, None),
    "repair_columns": (standardize.repair_columns, Stage.CLEAN),
    "apply_dictionary": (standardize.apply_dictionary, Stage.STAND),
    "spatial_key_join": (joins.spatial_key_join, Stage.SPATIAL),
    "zip_join": (joins.zip_join, Stage.SPATIAL),
    "level_join": (joins.level_join, Stage.SPATIAL),
    "facility_join": (joins.facility_join, Stage.SPATIAL),
    "census_join": (joins.census_join, Stage.CENSUS),
    "join_climate": (exposure.join_climate, Stage.CLIMATE),
    "zero_nights": (quality.zero_nights, None),
}


def check(recipe: dict) -> list[str]:
    """What is wrong with a recipe; an empty list if it can run."""
    wrong, stage = [], Stage.IMPORT
    for n, step in enumerate(recipe.get("steps", [])):
        if step.get("name") not in STEPS:
            wrong.append(f"step {n}: unknown name {step.get('name')}")
            continue
        to = STEPS[step["name"]][1]
        if to is not None and to < stage:
            wrong.append(f"step {n}: {step['name']} comes too late")
        stage = max(stage, to) if to is not None else stage
    return wrong


def dumps(recipe: dict) -> str:
    body = {k: v for k, v in recipe.items() if k != "digest"}
    return json.dumps(body | {"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, indent=2)


def loads(text: str, **parameters) -> dict:
    """Read a recipe and set parameters ("step.parameter" or plain names, which go to every step that has them)."""
    recipe = json.loads(text)
    for step in recipe["steps"]:
        for key, value in parameters.items():
            name, _, inner = key.rpartition(".")
            if (name == step["name"] or not name) and (name or inner in step.get("parameters", {})):
                step.setdefault("parameters", {})[inner] = value
    return recipe


def run(recipe: dict, source: HealthFrame, tables: dict[str, DataFrame] | None = None, dry: bool = False) -> HealthFrame:
    """Apply a recipe's steps; parameters like {"table": name} are looked up in ``tables``.  ``dry`` only checks."""
    if wrong := check(recipe):
        raise ValueError("; ".join(wrong))
    if dry:
        return source
    for step in recipe["steps"]:
        make, stage = STEPS[step["name"]]
        values = {k: tables[v["table"]] if isinstance(v, dict) and set(v) == {"table"} else v for k, v in step.get("parameters", {}).items()}
        source = source.step(step["name"], lambda df, make=make, values=values: make(df, **values), stage)
    return source


def compare(a: dict, b: dict) -> list[str]:
    """Steps and parameters in which two recipes differ."""
    out = []
    for n, (x, y) in enumerate(itertools.zip_longest(a["steps"], b["steps"], fillvalue={})):
        if x.get("name") != y.get("name"):
            out.append(f"step {n}: {x.get('name')} / {y.get('name')}")
        elif x.get("parameters") != y.get("parameters"):
            out.append(f"step {n} ({x['name']}): {x.get('parameters')} / {y.get('parameters')}")
    return out


def branches(recipe: dict, **choices: list) -> list[dict]:
    """One recipe for each combination of parameter values."""
    text = json.dumps(recipe)
    return [loads(text, **dict(zip(choices, values, strict=True))) for values in itertools.product(*choices.values())]


def _key(step: dict) -> str:
    return json.dumps([step["name"], step.get("parameters", {})], sort_keys=True)


def run_branches(recipes: list[dict], source: HealthFrame, tables: dict[str, DataFrame] | None = None, store: Callable[[DataFrame], DataFrame] = cut) -> tuple[list[HealthFrame], int]:
    """The results of several recipes on one source, and how many steps were run: those that recipes begin with in common run once.

    The steps form a tree; a node from which several recipes go on is stored (by default in the checkpoint folder), so that its plan is computed
    once, and the rest stays lazy.  Equal recipes give equal results from one run.
    """
    for n, recipe in enumerate(recipes):
        if wrong := check(recipe):
            raise ValueError(f"recipe {n}: " + "; ".join(wrong))
    results: list[HealthFrame | None] = [None] * len(recipes)
    ran = 0

    def grow(node: HealthFrame, depth: int, members: list[int]) -> None:
        nonlocal ran
        onward: dict[str, list[int]] = {}
        for k in members:
            steps = recipes[k]["steps"]
            if depth == len(steps):
                results[k] = node
            else:
                onward.setdefault(_key(steps[depth]), []).append(k)
        if depth and len(onward) > 1:
            node = dataclasses.replace(node, df=store(node.df))
            for k in members:
                results[k] = node if results[k] is not None else None
        for own in onward.values():
            ran += 1
            grow(run({"steps": [recipes[own[0]]["steps"][depth]]}, node, tables), depth + 1, own)

    grow(source, 0, list(range(len(recipes))))
    return results, ran
