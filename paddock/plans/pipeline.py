"""Ordered phases with dry runs, skips and an end at the first failure."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Phase:
    """A named step: ``plan`` gives the rows it would change, ``apply`` changes them."""

    name: str
    plan: Callable[[], DataFrame]
    apply: Callable[[DataFrame], None] | None = None


@dataclass
class Report:
    rows: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    failed: str = ""


def run(phases: list[Phase], execute: bool = False, skip: set[str] = frozenset()) -> Report:
    """Plans each phase in order and counts its rows; applies it only when told to execute.

    A phase that fails ends the run, so that no later one builds on it.
    """
    report = Report()
    for phase in phases:
        if phase.name in skip:
            continue
        began = time.perf_counter()
        try:
            rows = phase.plan()
            report.rows[phase.name] = rows.count()
            if execute and phase.apply:
                phase.apply(rows)
        except Exception as e:  # reported, not hidden: the caller sees which phase and why
            report.failed = f"{phase.name}: {e}"
            break
        report.seconds[phase.name] = round(time.perf_counter() - began, 3)
    return report
