"""A study as a graph of units on the driver: expansion of a configuration, status, locks, runs, commands.

Units hold names and parameters only; their bodies are functions that work on DataFrames.
"""

from __future__ import annotations

import json
import os
import shutil
import socket
import time
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from pathlib import Path
from typing import Any

PHASES = ("records", "audit_prep", "render", "corpus", "train", "generate", "score", "report", "pools", "attribution", "removal", "mechanism")


@dataclass(frozen=True)
class Config:
    """A study; missing or empty entries take these defaults."""

    name: str = "study"
    conditions: Sequence[str] = ("c0_clean", "c1_exact_1x", "c2_exact_10x", "c3_fuzzy_5x", "c4_redacted")
    seeds: Sequence[int] = (1, 2, 3)
    budgets: Sequence[int] = (1, 5, 20)
    ablations: Sequence[str] = ("none",)
    phases: Sequence[str] = PHASES
    options: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> Config:
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v not in (None, [], {}, "")}
        rest = {k: v for k, v in given.items() if k not in cls.__dataclass_fields__}
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})
        if bad := set(out.phases) - set(PHASES):
            raise ValueError(f"unknown phases: {sorted(bad)}")
        return replace(out, options={**out.options, **rest})

    def overlay(self, **changes: Any) -> Config:
        return replace(self, **changes)


@dataclass(frozen=True)
class Unit:
    unit_id: str
    phase: str
    deps: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    payload: Mapping[str, Any] = field(default_factory=dict)


class Layout:
    """Where a study's files are."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root)

    def output(self, phase: str, *parts: object) -> str:
        return str(self.root / phase / "__".join(map(str, parts)))

    def marker(self, kind: str, unit_id: str) -> Path:
        return self.root / "state" / kind / f"{unit_id.replace('/', '__')}.json"


def conditions(config: Config) -> list[tuple[str, str]]:
    """(condition, ablation): ablations apply to all conditions that insert records."""
    return [(c, a) for c, a in product(config.conditions, config.ablations) if a in ("none", "original") or not c.startswith("c0")]


def plan(config: Config, layout: Layout) -> list[Unit]:
    """All units in an order in which each comes after what it needs."""
    units: dict[str, Unit] = {}

    def add(phase: str, *parts: object, deps: Iterable[str] = (), **payload: Any) -> str:
        unit_id = "/".join(map(str, (phase, *parts)))
        if phase in config.phases:
            units[unit_id] = Unit(unit_id, phase, tuple(d for d in deps if d in units), (layout.output(phase, *parts),), payload)
        return unit_id

    records = add("records", config.name)
    prep = add("audit_prep", config.name, deps=[records])
    scored = []
    for (condition, ablation), seed in product(conditions(config), config.seeds):
        at = (condition, ablation, f"seed_{seed}")
        of = {"condition": condition, "ablation": ablation, "seed": seed}
        render = add("render", *at, deps=[records], **of)
        corpus = add("corpus", *at, deps=[render], **of)
        train = add("train", *at, deps=[corpus], **of)
        for budget in config.budgets:
            generate = add("generate", *at, f"budget{budget}", deps=[train, prep], budget=budget, **of)
            scored.append(add("score", *at, f"budget{budget}", deps=[generate], budget=budget, **of))
        pools = add("pools", *at, deps=[scored[-1], corpus], **of)
        attribution = add("attribution", *at, deps=[pools, train], **of)
        add("removal", *at, deps=[attribution, corpus], **of)
        add("mechanism", *at, deps=[scored[-1], train], **of)
    add("report", config.name, deps=scored)
    return list(units.values())


def status(units: Sequence[Unit], layout: Layout) -> dict[str, str]:
    """completed, failed, blocked, ready or pending. A marker counts first; then outputs, which for reports need all deps."""
    by_id, known = {u.unit_id: u for u in units}, {}

    def of(unit_id: str) -> str:
        if unit_id not in known:
            u = by_id[unit_id]
            there = bool(u.outputs) and all(Path(o).exists() for o in u.outputs)
            if layout.marker("done", unit_id).exists():
                known[unit_id] = "completed"
            elif layout.marker("failed", unit_id).exists():
                known[unit_id] = "failed"
            elif there and u.phase != "report":
                known[unit_id] = "completed"
            else:
                deps = [of(d) for d in u.deps]
                ready = all(s == "completed" for s in deps)
                known[unit_id] = "completed" if ready and there else "blocked" if any(s in ("failed", "blocked") for s in deps) else "ready" if ready else "pending"
        return known[unit_id]

    for u in units:
        of(u.unit_id)
    return known


def summary(units: Sequence[Unit], layout: Layout) -> dict[str, dict[str, int]]:
    states = status(units, layout)
    return {"status": dict(Counter(states.values())), "phase": dict(Counter(u.phase for u in units))}


class Lock:
    """One process at a time runs a unit; a lock of a dead process of this host is taken over."""

    def __init__(self, layout: Layout, unit_id: str) -> None:
        self.unit_id, self.path = unit_id, layout.marker("locks", unit_id)

    def _stale(self) -> bool:
        try:
            held = json.loads(self.path.read_text())
            host, pid = held["host"], int(held["pid"])
        except (OSError, ValueError, KeyError, TypeError):
            return True
        if host != socket.gethostname():
            return False
        if pid <= 0:
            return True
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return False

    def __enter__(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for last in (False, True):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                if last or not self._stale():
                    raise
                self.path.unlink(missing_ok=True)
        with os.fdopen(fd, "w") as f:
            json.dump({"unit_id": self.unit_id, "pid": os.getpid(), "host": socket.gethostname(), "started_at": time.time()}, f)
        return self

    def __exit__(self, *_: object) -> None:
        self.path.unlink(missing_ok=True)


def mark(layout: Layout, kind: str, unit_id: str, **told: Any) -> None:
    path = layout.marker(kind, unit_id)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"unit_id": unit_id, "at": time.time(), **told}))


Bodies = Mapping[str, Callable[[Unit], Any]]


def run_unit(unit: Unit, layout: Layout, bodies: Bodies) -> Any:
    """Runs a unit under its lock and leaves a marker of success or failure."""
    with Lock(layout, unit.unit_id):
        layout.marker("failed", unit.unit_id).unlink(missing_ok=True)
        try:
            out = bodies[unit.phase](unit)
        except Exception as e:
            mark(layout, "failed", unit.unit_id, error=f"{type(e).__name__}: {e}"[:2000])
            raise
        mark(layout, "done", unit.unit_id)
        return out


def run_ready(units: Sequence[Unit], layout: Layout, bodies: Bodies, limit: int | None = None) -> list[str]:
    states = status(units, layout)
    ready = [u for u in units if states[u.unit_id] == "ready"][:limit]
    for u in ready:
        run_unit(u, layout, bodies)
    return [u.unit_id for u in ready]


def run_all(units: Sequence[Unit], layout: Layout, bodies: Bodies, go_on: bool = False) -> dict[str, str]:
    """Runs what is ready until nothing is; failures end the run unless go_on."""
    while True:
        states = status(units, layout)
        ready = [u for u in units if states[u.unit_id] == "ready"]
        if not ready:
            return states
        for u in ready:
            try:
                run_unit(u, layout, bodies)
            except Exception:
                if not go_on:
                    raise


def select(units: Sequence[Unit], layout: Layout | None = None, phase: str | None = None, state: str | None = None) -> list[Unit]:
    states = status(units, layout) if layout and state else {}
    return [u for u in units if (phase is None or u.phase == phase) and (state is None or states[u.unit_id] == state)]


def commands(units: Sequence[Unit], script: str, config: str) -> list[str]:
    return [f"spark-submit {script} --config {config} --unit {u.unit_id}" for u in units]


def array_job(units: Sequence[Unit], script: str, config: str, header: Sequence[str] = ()) -> str:
    """A batch script with one unit for each task of an array."""
    names = " ".join(f"'{u.unit_id}'" for u in units)
    return "\n".join(["#!/bin/bash", f"#SBATCH --array=0-{max(len(units) - 1, 0)}", *(f"#SBATCH {h}" for h in header), f"units=({names})", f'spark-submit {script} --config {config} --unit "${{units[$SLURM_ARRAY_TASK_ID]}}"', ""])


def size_of(path: str | Path) -> int:
    p = Path(path)
    return sum(f.stat().st_size for f in p.rglob("*") if f.is_file()) if p.is_dir() else p.stat().st_size if p.exists() else 0


def remove(path: str | Path) -> int:
    """Removes a file or folder; returns its bytes."""
    p, n = Path(path), size_of(path)
    if p.is_dir():
        shutil.rmtree(p)
    else:
        p.unlink(missing_ok=True)
    return n
