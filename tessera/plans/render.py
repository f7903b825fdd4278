"""Small results as text: the coverage map, a digest of skills, a status of the corpus. Only what has been aggregated is collected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def coverage_json(cells: DataFrame, summary: DataFrame, generated_at: str) -> str:
    total = summary.first()
    rows = [r.asDict() for r in cells.orderBy("year", "domain").collect()]
    return json.dumps({"generated_at": generated_at, "total_rows": total.total_rows, "unclassified_pct": total.unclassified_pct, "years": sorted({r["year"] for r in rows}), "cells": rows}, indent=1)


def coverage_markdown(cells: DataFrame) -> str:
    """A row for each year, a column for each domain."""
    rows = cells.orderBy("year", "domain").collect()
    domains = list(dict.fromkeys(r.domain for r in rows))
    by = {(r.year, r.domain): r.n for r in rows}
    lines = ["| year | " + " | ".join(domains) + " |", "|" + "---|" * (len(domains) + 1)]
    return "\n".join([*lines, *(f"| {y} | " + " | ".join(str(by.get((y, d), 0)) for d in domains) + " |" for y in sorted({r.year for r in rows}))]) + "\n"


def skill_digest(frontier: DataFrame, actions: DataFrame, best: int = 3) -> str:
    """What is on the frontier, why, and the best actions for each."""
    rows = {r.label: (r.reason, []) for r in frontier.orderBy("label").collect()}
    for a in actions.where(f"place <= {int(best)}").orderBy("label", "place").collect():
        if a.label in rows:
            rows[a.label][1].append(f"{a.action} ({a.score:.2f})")
    return "\n".join(f"- {label}: {reason}" + (f" — {', '.join(todo)}" if todo else "") for label, (reason, todo) in rows.items()) + "\n"


def canvas(depths: DataFrame, edges: DataFrame, step: int = 200) -> str:
    """Nodes of (node, depth) in columns by depth, and their edges, as JSON Canvas."""
    seen: dict[int, int] = {}
    nodes = []
    for r in depths.orderBy("depth", "node").collect():
        nodes.append({"id": str(r.node), "type": "text", "text": str(r.node), "x": r.depth * step, "y": seen.setdefault(r.depth, 0) * step // 2, "width": step * 3 // 4, "height": step // 3})
        seen[r.depth] += 1
    lines = [{"id": f"{e.parent}-{e.child}", "fromNode": str(e.parent), "toNode": str(e.child)} for e in edges.orderBy("parent", "child").collect()]
    return json.dumps({"nodes": nodes, "edges": lines})
