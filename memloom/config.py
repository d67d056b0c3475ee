"""Settings in layers: defaults, templates, a file's or caller's values, the
environment, keyword arguments.  Each key remembers the layer that set it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from .schema import MEMORY_TYPES

# The profiles that a user may name, each on top of what it extends.
TEMPLATES: dict[str, dict[str, Any]] = {
    "base": {"profile": "simple", "strict_services": True, "event_log": {"mode": "full", "compress": False}, "memories": {"working": {"enabled": True}, "episodic": {"enabled": True}, "semantic": {"enabled": True}}},
    "coding": {"extends": "base", "profile": "coding", "memories": {"procedural": {"enabled": True}, "semantic": {"enabled": True, "policies": {"bias": "newest"}}}},
    "multi_agent": {"extends": "base", "profile": "multi_agent", "memories": {"shared": {"enabled": True}, "working": {"enabled": True}}},
    "personal": {"extends": "base", "profile": "personal", "memories": {"reflective": {"enabled": True}, "prospective": {"enabled": True}}},
    "regulated_financial": {"extends": "base", "profile": "regulated_financial", "event_log": {"mode": "full", "compress": True}, "memories": {"semantic": {"enabled": True}}},
    "voice": {"extends": "base", "profile": "voice", "event_log": {"mode": "rolling", "retention_days": 14, "compress": True}, "memories": {"working": {"enabled": True, "policies": {"page_size": 8}}}},
}
DEFAULTS: dict[str, Any] = {"profile": "simple", "template": "base", "strict_services": True, "event_log": {"mode": "full", "compress": False, "retention_days": 30}, "storage": {"path": "memory_events"}, "retrieval": {"hybrid": True, "top_k": 8}, "memories": {t: {"enabled": False, "policies": {}} for t in MEMORY_TYPES}}

# What a memory type needs, all of the first and one of the second.
REQUIRES = {"reflective": ("episodic",), "prospective": ("semantic",), "associative": ("semantic",)}
REQUIRES_ONE = {"shared": ("semantic", "episodic")}


def with_dependencies(enabled: set[str]) -> set[str]:
    """The types and all that they need; where one of several would do, the first."""
    unknown = enabled - set(MEMORY_TYPES)
    if unknown:
        raise ValueError(f"unknown memory types: {sorted(unknown)}")
    out = set(enabled)
    while True:
        more = {d for t in out for d in REQUIRES.get(t, ())} | {one[0] for t, one in REQUIRES_ONE.items() if t in out and not out & set(one)}
        if more <= out:
            return out
        out |= more


@dataclass
class Settings:
    values: dict[str, Any]
    sources: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, dotted: str) -> Any:
        at: Any = self.values
        for part in dotted.split("."):
            at = at[part]
        return at

    @property
    def memory_types(self) -> set[str]:
        return with_dependencies({t for t, m in self.values["memories"].items() if m.get("enabled")})


def _put(into: dict, more: dict, name: str, sources: dict[str, str], known: dict | None, prefix: str = "") -> None:
    for k, v in more.items():
        at = f"{prefix}{k}"
        if known is not None and k not in known:
            raise ValueError(f"unknown setting {at!r} in {name}")
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _put(into[k], v, name, sources, None if k == "policies" else (known or {}).get(k), f"{at}.")
        else:
            into[k] = v
            sources[at] = name


def resolve(template: str | None = None, values: dict[str, Any] | None = None, env: dict[str, str] | None = None, **kwargs: Any) -> Settings:
    """Later layers win: defaults, the template's chain, ``values``, MEMLOOM_A__B variables, keywords (a__b)."""
    out = Settings(json.loads(json.dumps(DEFAULTS)))
    chain, at = [], template or (values or {}).get("template") or "base"
    while at:
        if at not in TEMPLATES:
            raise ValueError(f"unknown template {at!r}")
        chain.append(at)
        at = TEMPLATES[at].get("extends")
    for name in reversed(chain):
        _put(out.values, {k: v for k, v in TEMPLATES[name].items() if k != "extends"}, f"template:{name}", out.sources, DEFAULTS)
    _put(out.values, values or {}, "values", out.sources, DEFAULTS)

    def nested(dotted: list[str], v: Any) -> dict:
        return {dotted[0]: nested(dotted[1:], v) if len(dotted) > 1 else v}

    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith("MEMLOOM_"):
            try:
                v = json.loads(v)
            except ValueError:
                pass
            _put(out.values, nested(k[8:].lower().split("__"), v), f"env:{k}", out.sources, DEFAULTS)
    for k, v in kwargs.items():
        _put(out.values, nested(k.split("__"), v), "arguments", out.sources, DEFAULTS)
    return out
