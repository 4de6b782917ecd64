"""Findings, suggestions and the registry of checks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SEVERITIES = ("critical", "high", "medium", "low", "info")
TOPICS = ("missing", "duplicates", "structure", "anomalies", "features")


@dataclass
class Suggestion:
    action: str
    params: dict = field(default_factory=dict)
    rationale: str = ""


@dataclass
class Finding:
    check: str
    severity: str
    topic: str
    message: str
    columns: list[str] = field(default_factory=list)
    affected_rows: int = 0
    affected_share: float = 0.0
    evidence: dict = field(default_factory=dict)
    suggestion: Suggestion | None = None

    def __post_init__(self):
        if self.severity not in SEVERITIES or self.topic not in TOPICS:
            raise ValueError(f"unknown severity or topic: {self.severity}, {self.topic}")

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)


#: Checks by name, in the order they were registered.
CHECKS: dict[str, Callable] = {}


def check(name: str):
    """Registers a function (context) -> findings under a name."""

    def register(f: Callable) -> Callable:
        CHECKS[name] = f
        return f

    return register


def as_table(spark, findings: list[Finding]) -> DataFrame:
    schema = "severity string, topic string, check string, columns array<string>, affected_rows long, affected_share double, evidence string, action string, message string"
    rows = [
        (f.severity, f.topic, f.check, f.columns, int(f.affected_rows), float(f.affected_share), json.dumps(f.evidence, default=str, ensure_ascii=False), f.suggestion.action if f.suggestion else None, f.message)
        for f in findings
    ]
    return spark.createDataFrame(rows, schema)


def summarise(findings: list[Finding]) -> dict[str, int]:
    return {s: sum(f.severity == s for f in findings) for s in SEVERITIES}
