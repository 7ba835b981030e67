"""Parameters of the trajectory operators, with their constraints, and how they are parsed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

MODES = ("pathlen", "radial", "hybrid")


@dataclass(frozen=True)
class Junction:
    """A disc about (cx, cz); r_outer is the ring that counts as having left it."""

    junction: int
    cx: float
    cz: float
    r: float
    r_outer: float | None = None

    def __post_init__(self):
        if not self.r > 0:
            raise ValueError("a junction's radius must be positive")

    @property
    def ring(self) -> float:
        return self.r_outer if self.r_outer is not None and self.r_outer > self.r else self.r + 10.0

    @property
    def reach(self) -> float:
        return self.r if self.r_outer is None else self.r_outer


def junctions(values: Sequence[Sequence[float]], r_outer: Sequence[float] | None = None) -> list[Junction]:
    """(cx, cz, r) triples, numbered in order, with as many outer radii or none."""
    if r_outer is not None and len(r_outer) != len(values):
        raise ValueError("there must be an outer radius for each junction")
    if any(len(v) != 3 for v in values):
        raise ValueError("a junction is cx, cz, r")
    return [Junction(k, *map(float, v), r_outer=None if r_outer is None else float(r_outer[k])) for k, v in enumerate(values)]


@dataclass(frozen=True)
class Zone:
    """A circle (cx, cz, r) or a rectangle (x_min, x_max, z_min, z_max) turned by tilt degrees, with a tolerance."""

    name: str
    circle: tuple[float, float, float] | None = None
    rectangle: tuple[float, float, float, float] | None = None
    tilt: float = 0.0
    tolerance: float = 0.0


def regions(text: str) -> dict[str, Zone]:
    """{"A": {"rect": [x_min, x_max, z_min, z_max]}, "B": {"circle": [cx, cz, r]}} as zones."""
    return {k: Zone(k, circle=tuple(v["circle"]) if "circle" in v else None, rectangle=tuple(v["rect"]) if "rect" in v else None) for k, v in json.loads(text).items()}


@dataclass(frozen=True)
class Decision:
    """How the moment of choice is found."""

    mode: str = "pathlen"
    path_length: float = 100.0
    epsilon: float = 0.05
    linger_delta: float = 0.0
    window: int = 5

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not self.path_length > 0 or self.epsilon < 0 or self.linger_delta < 0 or self.window < 1:
            raise ValueError("path_length and window must be positive, epsilon and linger_delta not negative")

    def checked(self, at: Sequence[Junction], strict: bool = True) -> Decision:
        """Radial modes need an outer radius over the radius, and linger_delta below their difference; without strict it is set just below."""
        if self.mode == "pathlen":
            return self
        gap = min((j.r_outer - j.r for j in at if j.r_outer is not None), default=None)
        if gap is None:
            return self
        if gap <= 0:
            raise ValueError("r_outer must exceed the radius")
        if self.linger_delta < gap:
            return self
        if strict:
            raise ValueError("linger_delta must be below r_outer - r")
        return replace(self, linger_delta=gap - 1e-6)


def config(values: dict, command: str) -> dict:
    """The defaults of a configuration, overlaid deeply by a command's own block."""

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return over(values.get("defaults", {}), values.get(command, {}))


def read_config(path: str) -> dict:
    """A JSON or, where a YAML reader is installed, YAML configuration file of the driver's."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def pairs(text: str | dict) -> dict[str, str]:
    """A dictionary, or "x=X,z=Z,t=time"."""
    if isinstance(text, dict):
        return dict(text)
    return {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in text.split(",") if p.strip())}


def from_pairs(kind: type, values: str | dict):
    """A dataclass from pairs(); unknown names raise."""
    known = {f.name for f in fields(kind)}
    found = pairs(values)
    if unknown := set(found) - known:
        raise ValueError(f"unknown names: {', '.join(sorted(unknown))}")
    return kind(**found)
