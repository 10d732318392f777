"""Rule configuration in TOML: custom rules, overrides and settings, found upwards from a directory."""

from __future__ import annotations

import re
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from marlstone.operators.rules import NEUTRAL, SEVERITIES, Rule, override

CONFIG_NAMES = ("marlstone.toml", ".marlstone.toml")


@dataclass
class Config:
    custom: list[Rule] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    severities: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def rules(self, pack: tuple[Rule, ...] = NEUTRAL) -> list[Rule]:
        """The pack under the overrides, then the custom rules."""
        return [*override(pack, self.disabled, self.severities), *self.custom]


def load_config(path: str | Path) -> Config:
    """``[[rules]]`` with id, title, pattern and optional category, severity, multiline, enabled; ``[[overrides]]`` with
    rule_id and optional severity, enabled; ``[settings]``. A bad severity becomes Medium, a bad pattern is warned of and
    skipped, a rule that is not enabled is left out."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    config = Config(settings=data.get("settings", {}))
    for r in data.get("rules", []):
        if not r.get("enabled", True):
            continue
        try:
            re.compile(r["pattern"])
        except re.error as e:
            warnings.warn(f"rule {r.get('id')}: {e}", stacklevel=2)
            continue
        severity = r.get("severity", "Medium")
        config.custom.append(Rule(r["id"], r.get("category", "Custom"), severity if severity in SEVERITIES else "Medium", r["pattern"], r.get("title", r["id"]), bool(r.get("multiline", False))))
    for o in data.get("overrides", []):
        if not o.get("enabled", True):
            config.disabled.append(o["rule_id"])
        if o.get("severity"):
            config.severities[o["rule_id"]] = o["severity"]
    return config


def find_config(start: str | Path) -> Path | None:
    """The nearest configuration file in the directory or above it."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in CONFIG_NAMES:
            if (folder / name).is_file():
                return folder / name
    return None
