"""Immutable settings, with an overlay from a mapping or a YAML file."""

from __future__ import annotations

import dataclasses
import os
import warnings
from dataclasses import dataclass, field
from pathlib import Path


#: Sections of a settings file whose keys are settings.
SECTIONS = ("field_scoring", "verification", "taxonomy", "reporting")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the scorers. Plans capture the values when they are built."""

    band: tuple[float, float] = (0.5, 0.85)
    match: float = 0.6
    rescue_below: float = 0.7
    presence: float = 0.7
    coverage: float = 0.7
    verify: bool = True
    partial_gt: frozenset[str] = frozenset({"parties", "key_obligations", "termination_clauses"})
    containment: frozenset[str] = frozenset({"governing_law", "term_length", "renewal_terms"})
    unknown: str = "other"
    #: model -> (price per million tokens in, out); none are built in
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    display: dict[str, str] = field(default_factory=dict)

    def with_(self, **changes) -> Settings:
        return dataclasses.replace(self, **changes)

    def configured(self, **overrides) -> Settings:
        """Settings with overrides by name, or by ``section__name`` as in the sections of a
        settings file. An unknown name is an error."""
        known = {f.name for f in dataclasses.fields(self)}
        names = {k: k.rpartition("__")[2] for k in overrides}
        if bad := sorted(k for k, n in names.items() if n not in known):
            raise KeyError(f"unknown settings {bad}")
        changed = Settings.from_mapping({names[k]: v for k, v in overrides.items()})
        return self.with_(**{n: getattr(changed, n) for n in names.values()})

    @classmethod
    def from_mapping(cls, values: dict) -> Settings:
        """Known keys overlay the defaults, those of a section too; unknown keys are reported
        by a warning and left out."""
        values = {k: v for key, value in (values or {}).items() for k, v in (value.items() if key in SECTIONS and isinstance(value, dict) else [(key, value)])}
        known = {f.name for f in dataclasses.fields(cls)}
        out = {}
        for k, v in (values or {}).items():
            if k not in known:
                warnings.warn(f"unknown setting {k!r}", stacklevel=2)
                continue
            out[k] = frozenset(v) if k in ("partial_gt", "containment") else tuple(v) if k == "band" else {m: tuple(p) for m, p in v.items()} if k == "prices" else v
        return cls(**out)

    @classmethod
    def load(cls, path: str | None = None, variable: str = "GAUGEWORKS_SETTINGS") -> Settings:
        """From a YAML file: ``path``, else the one named by the environment, else defaults."""
        path = path or os.environ.get(variable)
        if not path:
            return cls()
        import yaml

        return cls.from_mapping(yaml.safe_load(Path(path).read_text()) or {})
