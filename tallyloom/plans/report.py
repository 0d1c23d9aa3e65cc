"""Sections of a report (2.14): a registry of named computations, run lazily and rounded at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Section:
    key: str
    title: str
    compute: Callable[[SparkSession, str], DataFrame]


def select(sections: list[Section], only: list[str] | None) -> list[Section]:
    """The sections asked for; an unknown key is an error that names the known ones."""
    known = {s.key: s for s in sections}
    if unknown := [k for k in only or () if k not in known]:
        raise KeyError(f"unknown sections {unknown}; known: {sorted(known)}")
    return [known[k] for k in only] if only else sections


def render(spark: SparkSession, sf_dir: str, sections: list[Section], rows: int = 20) -> list[str]:
    """Report lines; each section shows at most so many rows (a report, not a result)."""
    out = []
    for s in sections:
        out += [s.title, *(str(r.asDict()) for r in s.compute(spark, sf_dir).limit(rows).collect()), ""]
    return out
