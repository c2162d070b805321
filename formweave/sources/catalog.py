"""Fixture catalogue, configuration and environment files, read on the driver."""

from __future__ import annotations

import os
from dataclasses import fields, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from formweave import schema
from formweave.plans.pipeline import Config, Stages

CONFIG_ENV, DOTENV_ENV, PREFIX = "FORMWEAVE_CONFIG", "FORMWEAVE_DOTENV", "FORMWEAVE_"


def load_fixtures(spark: SparkSession, path: str | Path, root: str | Path | None = None) -> DataFrame:
    """The catalogue as a dimension; relative paths are taken from the file's grandparent folder."""
    path = Path(path)
    root = Path(root) if root else path.resolve().parent.parent
    rows = []
    for f in (yaml.safe_load(path.read_text()) or {}).get("fixtures", []):
        f = dict(f)
        for name in ("pdf_path", "golden_xlsx_path", "reference_xlsx_path"):
            if f.get(name) and not Path(f[name]).is_absolute():
                f[name] = str(root / f[name])
        rows.append(tuple(f.get(c.name) for c in schema.FIXTURE))
    return spark.createDataFrame(rows, schema.FIXTURE)


def find_fixture(fixtures: DataFrame, fixture_id: str):
    found = fixtures.where(fixtures["id"] == fixture_id).take(1)
    if not found:
        raise KeyError(fixture_id)
    return found[0]


def is_placeholder(document: dict) -> bool:
    return bool(document.get("_placeholder"))


def load_env(path: str | Path | None = None) -> dict[str, str]:
    """Set variables of a .env file that are not set yet."""
    path = Path(path or os.environ.get(DOTENV_ENV) or ".env")
    found = {}
    if path.exists():
        for line in path.read_text().splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
                os.environ.setdefault(name.strip(), found[name.strip()])
    return found


def _nested(env: dict[str, str]) -> dict[str, Any]:
    """PREFIX + section__name variables as nested settings."""
    out: dict[str, Any] = {}
    for key, value in env.items():
        if key.startswith(PREFIX) and key not in (CONFIG_ENV, DOTENV_ENV):
            at, *path = out, *key.removeprefix(PREFIX).lower().split("__")
            for p in path[:-1]:
                at = at.setdefault(p, {})
            at[path[-1]] = yaml.safe_load(value)
    return out


def load_config(path: str | Path | None = None) -> Config:
    """An explicit file (defaults if it does not exist), else the one an environment variable names, else ./config.yaml, else defaults.

    What the file sets wins over environment variables, which win over defaults."""
    path = path or os.environ.get(CONFIG_ENV) or ("config.yaml" if Path("config.yaml").exists() else None)
    data = _nested(dict(os.environ))
    for key, value in ((yaml.safe_load(Path(path).read_text()) or {}) if path and Path(path).exists() else {}).items():
        data[key] = {**data[key], **value} if isinstance(value, dict) and isinstance(data.get(key), dict) else value
    config = Config()
    thresholds, paths, log = (data.get(k) or {} for k in ("thresholds", "paths", "logging"))
    known = {f.name for f in fields(Stages)}
    return replace(
        config,
        pipeline_version=str(data.get("pipeline_version", config.pipeline_version)),
        gate_confidence=float(thresholds.get("gate_confidence", config.gate_confidence)),
        min_block_confidence=float(thresholds.get("min_block_confidence", config.min_block_confidence)),
        stages=replace(config.stages, **{k: bool(v) for k, v in (data.get("stages") or {}).items() if k in known}),
        model={**config.model, **(data.get("model") or {})},
        fixtures_yaml=paths.get("fixtures_yaml") or config.fixtures_yaml,
        default_template_xlsx=paths.get("default_template_xlsx") or None,
        log_level=log.get("level", config.log_level),
        log_renderer=log.get("renderer", config.log_renderer),
    )
