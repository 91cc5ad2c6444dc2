"""Run configuration: mappings from JSON or YAML files."""

from __future__ import annotations

import json
import os
from typing import Any


def load_config(path: str) -> dict[str, Any]:
    """The mapping in a .json, .yaml or .yml file on the driver; an empty file is an empty mapping."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"There is no configuration file at {path}")
    with open(path, encoding="utf-8") as file:
        if path.lower().endswith(".json"):
            held = json.load(file)
        else:
            try:
                import yaml
            except ImportError:
                raise ValueError("YAML files need PyYAML; use JSON.") from None
            held = yaml.safe_load(file)
    if held is None:
        return {}
    if not isinstance(held, dict):
        raise ValueError(f"A configuration must be a mapping: {path}")
    return held


def config_argument(value: str) -> dict[str, Any]:
    """A command line's configuration: a JSON object, or a file that has one."""
    if value.lstrip().startswith("{"):
        return json.loads(value)
    return load_config(value)
