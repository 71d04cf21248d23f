"""Configuration: YAML files, defaults, and access by dotted paths."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

from helixmill.errors import ConfigurationError

DEFAULTS: dict[str, Any] = {
    "preprocessing": {"imputation": {"method": "knn", "k": 5, "threshold_missing": 0.5}, "normalization": {"method": "log2_scale"}, "outliers": {"method": "none", "contamination": 0.05}},
    "integration": {"scaling": "standard", "scale_features": False},
    "export": {"format": "csv", "sep": ",", "target": None, "test_size": 0.2},
}
# What the methods may be called.
ALLOWED = {
    "preprocessing.imputation.method": {"knn", "knn_distance", "median", "mean", "most_frequent", "constant", "iterative"},
    "preprocessing.normalization.method": {"log2_scale", "tmm", "tpm", "zscore", "median_centering", "pareto_scaling", "standard", "minmax", "robust", "quantile"},
    "preprocessing.outliers.method": {"iqr", "zscore", "isolation_forest", "none"},
    "integration.scaling": {"standard", "minmax", "robust", "none"},
    "export.format": {"csv", "json", "jsonl", "parquet", "ml"},
}


class Config:
    """Nested settings; unknown methods and shares outside 0 to 1 are refused."""

    def __init__(self, values: dict[str, Any] | None = None) -> None:
        self.values = _merged(copy.deepcopy(DEFAULTS), values or {})
        self.validate()

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        try:
            values = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError) as error:
            raise ConfigurationError(f"{path}: {error}") from error
        if values is not None and not isinstance(values, dict):
            raise ConfigurationError(f"{path} holds no settings")
        return cls(values)

    def get(self, path: str, default: Any = None) -> Any:
        here: Any = self.values
        for part in path.split("."):
            if not isinstance(here, dict) or part not in here:
                return default
            here = here[part]
        return here

    def update(self, path: str, value: Any) -> Config:
        """A new configuration with one setting changed; this one stays as it is."""
        values = copy.deepcopy(self.values)
        here = values
        *parents, last = path.split(".")
        for part in parents:
            here = here.setdefault(part, {})
            if not isinstance(here, dict):
                raise ConfigurationError(f"{path}: {part} is a value")
        here[last] = value
        return Config(values)

    def validate(self) -> None:
        for path, names in ALLOWED.items():
            if self.get(path) not in names:
                raise ConfigurationError(f"{path}: {self.get(path)!r} is none of {', '.join(sorted(names))}")
        for path in ("preprocessing.imputation.threshold_missing", "preprocessing.outliers.contamination", "export.test_size"):
            value = self.get(path)
            if not isinstance(value, (int, float)) or not 0 <= value <= 1:
                raise ConfigurationError(f"{path}: {value!r} is not between 0 and 1")


def _merged(base: dict[str, Any], other: dict[str, Any]) -> dict[str, Any]:
    for key, value in other.items():
        base[key] = _merged(base[key], value) if isinstance(value, dict) and isinstance(base.get(key), dict) else value
    return base
