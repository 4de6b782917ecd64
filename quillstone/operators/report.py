"""The account of a run, as Markdown."""

from __future__ import annotations

from quillstone.operators.evidence import Comparison, verdict
from quillstone.operators.features import Features
from quillstone.operators.findings import Finding
from quillstone.operators.repair import Cleaned
from quillstone.operators.rules import Result
from quillstone.plans.planner import Plan
from quillstone.sources.reader import Loaded

SHOWN = 10


def _table(head: list[str], rows: list[tuple]) -> list[str]:
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def build(
    loaded: Loaded, findings: list[Finding], plan: Plan, *, cleaned: Cleaned | None = None, validation: Result | None = None, features: Features | None = None, evidence: list[Comparison] | None = None
) -> str:
    """Sections: read, found, planned, done, validated, prepared, evidence, limits."""
    out = [f"# Account of {loaded.name}", "", "## 1. What was read", ""]
    out += [f"- {k}: {v}" for k, v in loaded.summary().items() if v not in ("", [])]
    worst = [f for f in findings if f.severity in ("critical", "high")]
    out += ["", "## 2. What was found", "", f"{len(findings)} findings, {len(worst)} of them critical or high.", ""]
    if worst:
        out += _table(["severity", "check", "columns", "rows", "what"], [(f.severity, f.check, ", ".join(f.columns), f.affected_rows, f.message) for f in worst[:SHOWN]])
    if len(worst) > SHOWN:
        out += ["", f"Only the first {SHOWN} of {len(worst)} are shown."]
    out += ["", "## 3. What was planned", ""]
    out += _table(["step", "stage", "columns", "why"], [(s.action, s.stage, ", ".join(s.columns) or "(whole table)", s.why) for s in plan.steps]) if plan.steps else ["Nothing."]
    if plan.unaddressed:
        out += ["", f"{len(plan.unaddressed)} findings have no repair and stay as they are."]
    out += ["", "## 4. What was done", ""]
    if cleaned:
        s = cleaned.summary()
        out += [f"{s['train']} training rows and {s['test']} held-out rows.", ""]
        out += _table(["step", "rows before", "rows after"], [(a.action, a.rows_before, a.rows_after) for a in cleaned.applied])
        out += [f"Left to later stages: {', '.join(s['skipped'])}."] if s["skipped"] else []
    else:
        out += ["The plan was not run."]
    out += ["", "## 5. Rules", ""]
    if validation:
        s = validation.summary()
        out += [f"{s['valid']} rows are valid, {s['rejected']} rejected."] + ([s["caution"]] if s["caution"] else [])
        out += [f"- {v.rule.label}: {v.rows} rows" for v in validation.violations] + [f"- not applied: {r.label}" for r in validation.inert]
    else:
        out += ["No rules were checked."]
    out += ["", "## 6. Features", ""]
    out += [f"- {k}: {v}" for k, v in features.summary().items()] if features else ["No features were made."]
    out += ["", "## 7. Evidence", ""]
    if evidence:
        out += _table(["damage", "raw", "cleaned", "difference", "verdict"], [(f"{c.share:.0%}", f"{c.raw.auc:.4f}", f"{c.cleaned.auc:.4f}", f"{c.difference:+.4f}", verdict(c)[1]) for c in evidence])
    else:
        out += ["The comparison was not run."]
    out += ["", "## 8. Limits", "", "- Damage is simulated, so the figures say how well that is repaired.", "- Rules that were inferred are guesses from one table.", "- One split was used for each figure."]
    return "\n".join(out) + "\n"
