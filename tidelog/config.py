"""Settings: defaults, merged deeply with a mapping, then with environment variables; read and set by dotted names."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from typing import Any


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


class Config:
    """`TIDELOG_A__B=3` overrides `a.b`; numbers and true/false in the environment are read as such."""

    def __init__(self, defaults: Mapping[str, Any], given: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "TIDELOG_") -> None:
        self.values = merged(defaults, given or {})
        for name, text in (os.environ if environment is None else environment).items():
            if name.startswith(prefix):
                self.set(name[len(prefix) :].lower().replace("__", "."), _read(text))

    @classmethod
    def from_file(cls, path: str, defaults: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "TIDELOG_") -> Config:
        """Settings of a JSON file, or of a YAML file where the library for that is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML files need the library yaml; JSON files don't") from e
            given = yaml.safe_load(text)
        else:
            given = json.loads(text)
        if not isinstance(given or {}, Mapping):
            raise ValueError(f"{path} holds no mapping")
        return cls(defaults or {}, given or {}, environment, prefix)

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value


def _read(text: str) -> Any:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text
