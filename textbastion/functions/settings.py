"""A user's settings: additions to and removals from the catalogs, and which models score."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from . import catalogs as C
from . import paths as P

SECTIONS = ["sensitive_paths", "exfil_domains", "secrets", "destructive"]


@dataclass(frozen=True)
class Lists:
    """The catalogs with a user's changes; as they are by default."""

    segments: tuple[str, ...] = tuple(C.SENSITIVE_SEGMENTS)
    domains: tuple[str, ...] = tuple(C.EXFIL_DOMAINS)
    secrets_add: tuple[str, ...] = ()
    secrets_remove: tuple[str, ...] = ()
    destructive_add: tuple[str, ...] = ()
    destructive_remove: tuple[str, ...] = ()
    known: frozenset = field(default_factory=frozenset)

    @property
    def sensitive(self) -> str:
        return P.sensitive_regex(segments=list(self.segments))

    @property
    def domain(self) -> str:
        return P.domain_regex(list(self.domains))


def lists(overrides: dict[str, dict[str, list]]) -> Lists:
    """From sections with ``add`` and ``remove``, as ``catalogs.load_overrides`` gives them; other sections are no concern here."""
    get = lambda section, kind: tuple(overrides.get(section, {}).get(kind, ()))
    change = lambda section, base: tuple(C.with_overrides(base, get(section, "add"), get(section, "remove")))
    return Lists(
        change("sensitive_paths", C.SENSITIVE_SEGMENTS), change("exfil_domains", C.EXFIL_DOMAINS), get("secrets", "add"), get("secrets", "remove"),
        get("destructive", "add"), get("destructive", "remove"), frozenset(overrides) & frozenset(SECTIONS))


def load(path: str) -> Lists:
    """From a TOML file; an unreadable or malformed one changes nothing."""
    return lists(C.load_overrides(path))


@dataclass(frozen=True)
class ModelSpec:
    name: str
    path: str
    threshold: float | None = None


#: One model for fast scans, a second one for full scans.
FAST, SECOND = ModelSpec("fast", "fast/model.onnx"), ModelSpec("second", "second/model.onnx")


def threshold(value: str | float) -> float:
    t = float(value)
    if not 0 <= t <= 1:
        raise ValueError(f"threshold {t} is not between 0 and 1")
    return t


def mode(value: str) -> str:
    if value.lower() not in ("fast", "full", "custom"):
        raise ValueError(f"unknown mode {value}")
    return value.lower()


def models(which: str, models_toml: str | None = None, two_models: bool = True) -> list[ModelSpec]:
    """The models of a mode: one, two (where the backend can run two, else an error), or those of a TOML file, of which there has to be one."""
    which = mode(which)
    if which == "fast":
        return [FAST]
    if which == "full":
        if not two_models:
            raise ValueError("this backend can't run the full mode")
        return [FAST, SECOND]
    if not models_toml:
        raise ValueError("custom mode needs a file of models")
    found = [ModelSpec(m["name"], m["path"], threshold(m["threshold"]) if "threshold" in m else None) for m in tomllib.loads(Path(models_toml).read_text()).get("models", [])]
    if not found:
        raise ValueError(f"no models in {models_toml}")
    return found
