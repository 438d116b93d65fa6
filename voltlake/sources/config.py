"""Job configuration: a nested YAML file over defaults; keys from the environment by name."""

from __future__ import annotations

import os

DEFAULTS = {"start": "2021-09-16", "end": "2026-02-19", "horizon": 96, "initial_soc": 0.5, "test_start": "2025-03-01", "model": "rf", "method": "mpc"}
#: Where a nested file has the values of the flat names.
NESTED = {"start": ("data_collection", "start_date"), "end": ("data_collection", "end_date")}


def merged(base: dict, more: dict) -> dict:
    """A nested dictionary over another; what is not given stays."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def load_config(path: str | None = None, base: dict | None = None) -> dict:
    out = dict(base or DEFAULTS)
    if path is None:
        return out
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    out = merged(out, given)
    for name, keys in NESTED.items():
        value = given
        for k in keys:
            value = value.get(k) if isinstance(value, dict) else None
        if value is not None and name not in given:
            out[name] = str(value)
    return out


def api_key(service: str) -> str | None:
    return os.environ.get(f"{service.upper()}_API_KEY")
