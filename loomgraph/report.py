"""Reports of analyses as HTML or markdown."""

from __future__ import annotations

from html import escape

# How many rows a report shows.
TOP_COMMUNITIES, TOP_NODES = 5, 10


def _cell(value) -> str:
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def _sections(kind: str, data: dict) -> list[tuple[str, list[str], list[list]]]:
    """(title, header, rows) of each part of a report."""
    if kind == "path":
        return [("Paths", ["Path", "Length"], [[" → ".join(p), n] for p, n in zip(data.get("paths", []), data.get("path_lengths", []))])]
    if kind == "community":
        rows = [[c["partition_id"], c["size"], c["density"], ", ".join(c.get("key_nodes", []))] for c in data.get("communities", [])[:TOP_COMMUNITIES]]
        return [("Communities", ["Community", "Size", "Density", "Key nodes"], rows)]
    if kind == "centrality":
        out = []
        for measure in sorted({r["measure"] for r in data.get("scores", [])}):
            rows = sorted((r for r in data["scores"] if r["measure"] == measure), key=lambda r: (-r["score"], r["name"]))[:TOP_NODES]
            out.append((measure.capitalize(), ["Node", "Score"], [[r["name"], float(r["score"])] for r in rows]))
        return out
    if kind == "trend":
        return [("Trend", ["Period", "Count", "Total"], [[r["label"], r["n"], r["running"]] for r in data.get("series", [])])]
    raise ValueError(f"unknown kind of report: {kind}")


def render(kind: str, data: dict, form: str = "html") -> str:
    parts, title = _sections(kind, data), f"{kind.capitalize()} analysis"
    if form == "md":
        out = [f"# {title}"]
        for name, head, rows in parts:
            out += ["", f"## {name}", "", f"| {' | '.join(head)} |", "|" + " --- |" * len(head)]
            out += [f"| {' | '.join(_cell(v).replace('|', '/') for v in r)} |" for r in rows]
        return "\n".join(out) + "\n"
    if form == "html":
        out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
        for name, head, rows in parts:
            body = "".join(f"<tr>{''.join(f'<td>{escape(_cell(v))}</td>' for v in r)}</tr>" for r in rows)
            out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{body}</table>")
        return "".join(out) + "</body></html>"
    raise ValueError(f"unknown report format: {form}")
