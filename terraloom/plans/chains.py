"""Grammars: processing chains of scenes, run files of steps, references between steps."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

STATISTICS = ("median", "mean", "max", "min")


@dataclass(frozen=True)
class Chain:
    name: str
    steps: tuple[tuple[str, ...], ...]

    @property
    def statistic(self) -> str | None:
        """The plain statistic that the chain amounts to, or None."""
        return self.steps[0][1] if len(self.steps) == 1 and self.steps[0][0] == "temporal" else None

    @property
    def radius(self) -> int:
        return max((int(s[2]) for s in self.steps if s[0] == "focal"), default=0)

    def text(self) -> str:
        return f"{self.name} = {' > '.join(':'.join(s) for s in self.steps)}"


def parse_step(text: str) -> tuple[str, ...]:
    """focal:statistic:radius, temporal:statistic or water_mask."""
    parts = tuple(p.strip() for p in text.split(":"))
    if parts == ("water_mask",):
        return parts
    if parts[0] == "temporal" and len(parts) == 2 and parts[1] in STATISTICS:
        return parts
    if parts[0] == "focal" and len(parts) == 3 and parts[1] in STATISTICS and parts[2].isdigit() and int(parts[2]) > 0:
        return parts
    raise ValueError(f"{text!r} isn't a step")


def parse_chain(line: str) -> Chain:
    name, _, steps = line.partition("=")
    chain = Chain(name.strip(), tuple(parse_step(s) for s in steps.split(">")))
    if not chain.name or sum(s[0] == "temporal" for s in chain.steps) != 1:
        raise ValueError(f"{line!r} needs a name and exactly one temporal step")
    return chain


def parse_lines(text: str) -> list[Chain]:
    """Chains of lines; # begins a comment; names differ beyond case."""
    lines = [s for line in text.splitlines() if (s := line.partition("#")[0].strip())]
    out = [parse_chain(s) for s in lines]
    names = [c.name.lower() for c in out]
    if len(set(names)) != len(names):
        raise ValueError("two chains have one name")
    return out


def format_lines(chains: list[Chain]) -> str:
    return "\n".join(c.text() for c in chains)


def statistic_chain(statistic: str) -> Chain:
    return Chain(statistic, (("temporal", statistic),))


def temporal_reducers(value: str | list[str]) -> list[str]:
    """Known statistics, each once, in the order of STATISTICS."""
    asked = {v.strip().lower() for v in (value.split(",") if isinstance(value, str) else value)}
    if unknown := asked - set(STATISTICS):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    return [s for s in STATISTICS if s in asked]


@dataclass
class Step:
    name: str
    engine: str
    settings: dict = field(default_factory=dict)
    after: list[str] = field(default_factory=list)


def references(value) -> list[str]:
    from terraloom.functions.text import parse_reference

    if isinstance(value, str) and value.startswith("@"):
        return [parse_reference(value)[1]]
    if isinstance(value, dict):
        value = list(value.values())
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def load_run(text: str, overrides: dict[str, object] | None = None) -> list[Step]:
    """Steps of a run file (TOML, or JSON) in an order that their references allow; overrides are 'step.setting': value."""
    document = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
    for key, value in (overrides or {}).items():
        step, _, setting = key.partition(".")
        document["steps"][step][setting] = value
    steps = {}
    for name, body in document.get("steps", {}).items():
        body = dict(body)
        engine = body.pop("engine", None)
        if engine is None:
            raise ValueError(f"step {name} has no engine")
        after = [*body.pop("after", []), *references(body)]
        steps[name] = Step(name, engine, body, sorted(set(after)))
    if missing := {a for s in steps.values() for a in s.after} - set(steps):
        raise ValueError(f"steps {sorted(missing)} aren't there")
    try:
        order = TopologicalSorter({n: s.after for n, s in steps.items()}).static_order()
        return [steps[n] for n in order]
    except CycleError as e:
        raise ValueError(f"steps wait for each other: {e.args[1]}") from None


def levels(steps: list[Step]) -> dict[str, int]:
    """Length of the longest way to each step: those of a level may run at once."""
    out: dict[str, int] = {}
    for s in steps:
        out[s.name] = 1 + max((out[a] for a in s.after), default=-1)
    return out


@dataclass(frozen=True)
class Setting:
    kind: type
    default: object
    low: float | None = None
    high: float | None = None
    choices: tuple = ()


SETTINGS = {
    "objective": Setting(str, "r2", choices=("r2", "spearman", "nrmse", "mutual_info", "distance", "quartile_contrast", "mixedlm_tstat")),
    "radius_min": Setting(int, 100, 1, 100_000),
    "radius_max": Setting(int, 1000, 1, 100_000),
    "radius_step": Setting(int, 100, 1, 100_000),
    "cell_size": Setting(float, 50.0, 0.1, 10_000),
    "kernel": Setting(str, "none", choices=("none", "uniform", "linear", "gaussian")),
    "kernel_radius": Setting(float, 100.0, 0.1, 100_000),
    "kernel_sigma": Setting(float, 35.0, 0.1, 100_000),
    "test_share": Setting(float, 0.25, 0.01, 0.9),
    "seed": Setting(int, 42),
    "outcome_bins": Setting(int, 5, 2, 100),
    "vif_threshold": Setting(float, 10.0, 1, 1e6),
    "coverage_gate": Setting(float, 0.95, 0, 1),
    "cloud_max": Setting(float, 10.0, 0, 100),
    "bootstraps": Setting(int, 2000, 1, 1_000_000),
    "permutations": Setting(int, 1000, 1, 1_000_000),
}


def check_settings(given: dict) -> dict:
    """Settings with their defaults; all faults at once."""
    faults = [f"unknown setting {k}" for k in given if k not in SETTINGS]
    out = {}
    for k, s in SETTINGS.items():
        v = given.get(k, s.default)
        if s.kind is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if not isinstance(v, s.kind) or isinstance(v, bool):
            faults.append(f"{k} must be {s.kind.__name__}")
        elif (s.low is not None and v < s.low) or (s.high is not None and v > s.high):
            faults.append(f"{k} must be from {s.low} to {s.high}")
        elif s.choices and v not in s.choices:
            faults.append(f"{k} must be one of {', '.join(s.choices)}")
        out[k] = v
    if faults:
        raise ValueError("; ".join(faults))
    return out


def output_stems(name: str, statistics: list[str] = ["median"], chains: list[Chain] = []) -> dict[str, str]:  # noqa: B006
    """Base name of each output: a chain's name, or a statistic's unless it is the median, follows the run's."""
    if chains:
        return {c.name: f"{name}_{c.name}" for c in chains}
    return {s: name if s == "median" else f"{name}_{s}" for s in statistics}


def parse_value(text: str):
    """A value given as text: a TOML scalar or list if it is one, else the text."""
    try:
        value = tomllib.loads(f"v = {text}")["v"]
    except tomllib.TOMLDecodeError:
        return text
    return value.isoformat() if hasattr(value, "isoformat") else value
