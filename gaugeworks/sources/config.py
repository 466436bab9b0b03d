"""Connection settings from the environment or a KEY=value file, and profiles from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from gaugeworks.operators.catalog import resolve_bundle


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines; blank lines, comments, ``export`` and quotes are allowed for."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip().strip("'\"")
    return out


@dataclass(frozen=True)
class TraceConfig:
    url: str
    public_key: str
    secret_key: str

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "TRACES_") -> TraceConfig | None:
        """From the environment, which goes first, and a file; None if anything is missing."""
        found = (env_file(path) if path and Path(path).exists() else {}) | {k: v for k, v in os.environ.items() if k.startswith(prefix)}
        values = [found.get(prefix + k) for k in ("URL", "PUBLIC_KEY", "SECRET_KEY")]
        return cls(*values) if all(values) else None

    def options(self) -> dict[str, str]:
        """Options of the trace data source."""
        return {"url": self.url, "public_key": self.public_key, "secret_key": self.secret_key}


def load_profiles(defaults: dict[str, dict], path: str | None = None) -> dict[str, dict]:
    """Profiles by agent, defaults overlaid key by key by those of a YAML file."""
    out = {k: dict(v) for k, v in defaults.items()}
    if path:
        import yaml

        loaded = yaml.safe_load(Path(path).read_text()) or {}
        for agent, spec in (loaded.get("profiles") or loaded).items():
            out[agent] = out.get(agent, {}) | (spec or {})
    return out


__all__ = ["TraceConfig", "env_file", "load_profiles", "resolve_bundle"]
