"""HTML report of an audit result: built on the driver from one nested row, everything escaped."""

from __future__ import annotations

import html
from datetime import UTC, datetime
from pathlib import Path

from .jobs import safe_name

_STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}section{border-top:1px solid #ccc;padding:1rem 0}dt{font-weight:600}small{color:#555}"


def _e(value) -> str:
    return html.escape("" if value is None else str(value), quote=True)


def _list(items: list[str], empty: str) -> str:
    return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if items else f"<p>{_e(empty)}</p>"


def _entry(r: dict, head: str, body: str, level: str) -> str:
    extra = f"<br><small>{_e(r['reason'])}</small>" if r.get("reason") else ""
    return f"<strong>{_e(r.get(head))}</strong> ({_e(r.get(level))}): {_e(r.get(body))}{extra}"


def render(result: dict) -> str:
    """A page with summary, priorities, warnings, failed pages and a block per page."""
    summary = "".join(f"<dt>{_e(k.replace('_', ' '))}</dt><dd>{_e(v)}</dd>" for k, v in (result.get("summary") or {}).items())
    top = [f"<strong>{_e(p.get('priority_score'))}</strong> {_e(p.get('type'))} on {_e(p.get('page_url'))}: {_e(p.get('issue'))} <small>{_e(p.get('why_prioritized'))}</small>" for p in result.get("top_priorities") or []]
    pages = "".join(
        f"<section><h3>{_e(p.get('title') or p.get('page_url'))}</h3><p>{_e(p.get('page_url'))} · {_e(p.get('page_type'))}<br>{_e(p.get('summary'))}</p>"
        f"<h4>Improvements</h4>{_list([_entry(r, 'issue', 'suggested_change', 'severity') for r in p.get('improvements') or []], 'None.')}"
        f"<h4>Missing content</h4>{_list([_entry(r, 'missing_content', 'suggestion_or_outline', 'priority') for r in p.get('missing_content') or []], 'None.')}"
        f"<h4>Duplicate content</h4>{_list([_entry(r, 'matched_page_url', 'message', 'similarity_score') for r in p.get('duplicate_warnings') or []], 'None.')}</section>"
        for p in result.get("pages") or []
    )
    failed = [f"{_e(f.get('url'))} ({_e(f.get('stage'))}): {_e(f.get('reason'))}" for f in result.get("failed_pages") or []]
    return (
        f"<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Content audit {_e(result.get('normalized_url'))}</title><style>{_STYLE}</style></head><body>"
        f"<h1>Content audit</h1><p>{_e(result.get('normalized_url'))}<br>{_e(result.get('message'))}<br><small>Job {_e(result.get('job_id'))}, {_e(result.get('generated_at'))}</small></p>"
        f"<section><h2>Summary</h2><dl>{summary}</dl></section><section><h2>Top priorities</h2>{_list(top, 'No priorities.')}</section>"
        f"<section><h2>Warnings</h2>{_list([_e(w) for w in result.get('warnings') or []], 'No warnings.')}</section><section><h2>Pages</h2>{pages or '<p>No pages.</p>'}</section>"
        f"<section><h2>Failed pages</h2>{_list(failed, 'None.')}</section></body></html>"
    )


def write(result: dict, folder: str | Path) -> Path:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / safe_name(str(result.get("job_id") or ""))
    path.write_text(render({"generated_at": datetime.now(UTC).isoformat(timespec="seconds")} | result), encoding="utf-8")
    return path


def resolve(folder: str | Path, stored: str | None, job_id: str) -> Path | None:
    """The report file of a job, only if it lies inside the folder."""
    folder = Path(folder).resolve()
    for candidate in (stored, folder / safe_name(job_id)):
        if candidate:
            path = Path(candidate).resolve()
            if path.is_relative_to(folder) and path.is_file():
                return path
    return None
