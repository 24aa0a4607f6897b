"""Markdown report of gates and profiles; text after a marker in an existing file is kept."""

from __future__ import annotations

import os
from collections.abc import Sequence

from sedimenta.operators.gates import Gate

MARKER = "<!-- notes below this line are kept -->"
MOST_FAILURES = 20


def cell(value) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:,.4f}"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, (list, tuple)):
        return "; ".join(map(str, value))
    return str(value).replace("|", "\\|").replace("\n", " ")


def grid(rows: Sequence[dict]) -> str:
    """A Markdown table of small collected rows."""
    if not rows:
        return "_nothing_"
    names = list(dict.fromkeys(k for r in rows for k in r))
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in rows]
    return "\n".join(lines)


def render(gates: Sequence[Gate], sections: dict[str, Sequence[dict]] | None = None, title: str = "Data quality") -> str:
    parts = [f"# {title}", grid([{"gate": g.name, "passed": "pass" if g.passed else "FAIL", "rows checked": g.rows_checked, "failures": len(g.failures), "what": g.description} for g in gates])]
    for g in gates:
        parts += [f"## {g.name}", grid(g.detail)]
        if g.failures:
            parts += ["### failures", grid(g.failures[:MOST_FAILURES])]
            if len(g.failures) > MOST_FAILURES:
                parts.append(f"… and {len(g.failures) - MOST_FAILURES} more")
    for name, rows in (sections or {}).items():
        parts += [f"## {name}", grid(rows)]
    return "\n\n".join(parts) + "\n"


def kept_notes(path: str) -> str:
    """What stands after the marker in an existing report."""
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read().partition(MARKER)[2]


def write(path: str, body: str) -> None:
    notes = kept_notes(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{body}\n{MARKER}{notes or chr(10)}")
