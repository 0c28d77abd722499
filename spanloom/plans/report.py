"""Reports from a language model's answer: recovery, normal form, Markdown. Driver-side, one row at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any


class ReportError(ValueError):
    pass


def recover(text: str) -> dict[str, Any]:
    """The JSON object of an answer: bare, fenced, or the outermost braces."""
    body = text.strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", body, re.S)
    body = fenced[1] if fenced else body
    for candidate in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
        break
    raise ReportError("the answer holds no JSON object")


def number(x: Any, default: float = 0.0) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return default


def _within(x: Any, duration: float) -> int:
    return round(min(max(number(x), 0.0), duration))


def _citation(c: Any, duration: float) -> dict[str, Any]:
    c = c if isinstance(c, Mapping) else {"claim": str(c)}
    start = _within(c.get("start_s", c.get("timestamp_s")), duration)
    return {"claim": str(c.get("claim") or ""), "start_s": start, "end_s": max(start, _within(c.get("end_s", start), duration))}


def normalised(data: Mapping[str, Any], duration: float) -> dict[str, Any]:
    """A report with every field there, numbers read, and moments within the duration."""
    mappings = lambda key: [x for x in data.get(key) or () if isinstance(x, Mapping)]
    sections = [
        {
            "title": str(s.get("title") or ""),
            "summary": str(s.get("summary") or ""),
            "start_s": _within(s.get("start_s"), duration),
            "end_s": _within(s.get("end_s"), duration),
            "citations": [_citation(c, duration) for c in s.get("citations") or ()],
        }
        for s in mappings("sections")
    ]
    moments = [{"title": str(m.get("title") or ""), "summary": str(m.get("summary") or ""), "timestamp_s": _within(m.get("timestamp_s"), duration)} for m in mappings("key_moments")]
    return {"title": str(data.get("title") or ""), "one_line_summary": str(data.get("one_line_summary") or ""), "sections": sections, "key_moments": moments}


def clock(seconds: float) -> str:
    return f"{int(seconds) // 60:02d}:{int(seconds) % 60:02d}"


def markdown(report: Mapping[str, Any]) -> str:
    out = [f"# {report['title']}", "", report["one_line_summary"], ""]
    for s in report["sections"]:
        out += [f"## {s['title']} ({clock(s['start_s'])}-{clock(s['end_s'])})", "", s["summary"], ""]
        out += [f"- {c['claim']} [{clock(c['start_s'])}-{clock(c['end_s'])}]" for c in s["citations"]]
        out += [""] * bool(s["citations"])
    if report["key_moments"]:
        out += ["## Key moments", "", *(f"- {clock(m['timestamp_s'])} {m['title']}: {m['summary']}" for m in report["key_moments"]), ""]
    return "\n".join(out)


def fallback(answer: str, duration: float) -> dict[str, Any]:
    """What can be said when no JSON is to be had: the answer itself, over the whole duration."""
    return normalised({"title": "", "one_line_summary": answer.strip().split("\n")[0][:200], "sections": [{"title": "", "summary": answer.strip(), "start_s": 0, "end_s": duration}]}, duration)
