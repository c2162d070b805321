"""Evaluation results as JSON and Markdown files, one pair per fixture and evaluation."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def metric(name: str, value: Any, passed: bool | None = None, details: dict | None = None) -> dict[str, Any]:
    return {"name": name, "value": value, "details": details or {}, "passed": passed}


def write_json_report(result: dict[str, Any], folder: str | Path) -> Path:
    path = Path(folder) / f"{result['fixture_id']}.{result['eval_name']}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(result, indent=2, default=str))
    return path


def write_markdown_report(result: dict[str, Any], folder: str | Path) -> Path:
    path = Path(folder) / f"{result['fixture_id']}.{result['eval_name']}.md"
    path.parent.mkdir(parents=True, exist_ok=True)

    def shown(m: dict[str, Any]) -> str:
        value = f"{m['value']:.4f}" if isinstance(m["value"], float) else str(m["value"])
        details = json.dumps(m["details"]).replace("|", "\\|") if m["details"] else ""
        return f"| {m['name']} | {value} | {m['passed']} | {details} |"

    head = [f"# Eval {result['eval_name']} - {result['fixture_id']}", "", f"- Passed: {result['passed']}"]
    notes = [f"- Notes: {result['notes']}"] if result.get("notes") else []
    path.write_text("\n".join([*head, *notes, "", "| Metric | Value | Passed | Details |", "|---|---|---|---|", *map(shown, result["metrics"]), ""]))
    return path


def write_report(result: dict[str, Any], folder: str | Path) -> tuple[Path, Path]:
    return write_json_report(result, folder), write_markdown_report(result, folder)
