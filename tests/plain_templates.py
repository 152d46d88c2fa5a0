"""A plain reader of one document by a template, against which the relations are held."""

from __future__ import annotations

from typing import Any, NamedTuple

STRIP = ":.,;-()[]% "
#: Date spellings, read day first.
DATES = ("%d-%b-%Y", "%d-%B-%Y", "%d %b %Y", "%d %B %Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%Y-%m-%d", "%b %d, %Y", "%B %d, %Y")


class Word(NamedTuple):
    text: str
    x0: float
    x1: float
    top: float


def norm(text: str) -> str:
    return text.lower().strip(STRIP).strip()


def number(text: str | None) -> float | None:
    kept = "".join(c for c in text or "" if c in "0123456789.-")
    try:
        return float(kept)
    except ValueError:
        return None


def iso(text: str) -> str:
    import datetime

    for form in DATES:
        try:
            return datetime.datetime.strptime(text.strip(), form).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return text.strip()


def convert(text: str, kind: str) -> Any:
    if kind in ("money", "number"):
        return number(text)
    return (iso(text) if kind == "date" else text) if text else None


def rows_by_anchor(words: list[Word], tolerance: float, rounded: bool) -> list[list[Word]]:
    """Lines whose words lie within the tolerance of the line's first word.

    With ``rounded`` a word may join any line so far (reading order by rounded height), else only the last.
    """
    lines: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (round(w.top) if rounded else w.top, w.x0)):
        home = next((x for x in (lines if rounded else lines[-1:]) if abs(x[0].top - w.top) <= tolerance), None)
        if home is None:
            lines.append([w])
        else:
            home.append(w)
    if rounded:
        # a line's height is that of its leftmost word, once it is in order
        lines = sorted((sorted(x, key=lambda w: w.x0) for x in lines), key=lambda x: x[0].top)
    return lines


def after_anchor(line: list[Word], anchor: list[str]) -> int | None:
    """The place behind the first occurrence of the anchor's words in the line."""
    names = [norm(w.text) for w in line]
    return next((i + len(anchor) for i in range(len(names) - len(anchor) + 1) if names[i : i + len(anchor)] == anchor), None)


def _pick(found: list, occurrence: Any) -> Any:
    """The k-th or last of what was found; k counts from 1."""
    if occurrence == "last":
        return found[-1] if found else None
    k = int(occurrence)
    if k < 1:
        raise ValueError("occurrence counts from 1")
    return found[k - 1] if k <= len(found) else None


def _run(words: list[Word], gap: float, most: int | None, stop_at_gap: bool = True) -> list[str]:
    """Texts from the left until the first wide gap, or until there are enough."""
    out: list[str] = []
    for i, w in enumerate(words):
        if i and stop_at_gap and w.x0 - words[i - 1].x1 > gap:
            break
        out.append(w.text)
    return out[:most] if most else out


def read_field(lines: list[list[Word]], rule: dict) -> Any:
    """A header value by its label; see the template language in the README."""
    anchor = [norm(t) for t in rule["anchor"].split()]
    kind, times = rule.get("type", "text"), rule.get("occurrence", 1)
    hits = [(i, line, at) for i, line in enumerate(lines) if (at := after_anchor(line, anchor)) is not None]
    if "nth" in rule or "sum_nth" in rule:
        row = _pick(hits, times)
        figures = [v for w in row[1][row[2] :] if (v := number(w.text)) is not None] if row else []
        if "sum_nth" in rule:
            chosen = [figures[k - 1] for k in rule["sum_nth"] if 0 < k <= len(figures)]
            return round(sum(chosen), 2) if chosen else None
        return figures[rule["nth"] - 1] if 0 < rule["nth"] <= len(figures) else None
    if rule.get("below"):
        if not hits:
            return None
        i, line, at = hits[0]
        down = int(rule["below"]) if str(rule["below"]).isdigit() else 1
        edge = line[at - len(anchor)].x0 - float(rule.get("x_tol", 22.0))
        under = [w for w in (lines[i + down] if i + down < len(lines) else []) if w.x0 >= edge]
        return convert(" ".join(_run(under, float(rule.get("gap", 30.0)), int(rule.get("max_words") or 0) or None)), kind) if under else None
    if rule.get("before"):
        for _, line, at in hits:
            start = at - len(anchor)
            if words := line[max(0, start - int(rule["before"])) : start]:
                return convert(" ".join(w.text for w in words), kind)
        return None
    row = _pick([h for h in hits if h[2] < len(h[1])], times)
    if row is None:
        return None
    rest = row[1][row[2] :]
    while rest and not norm(rest[0].text):
        rest = rest[1:]
    most = rule.get("max_words")
    return convert(" ".join(_run(rest, float(rule.get("gap", 55.0)), most, most is None)).strip(), kind)


def _cells(words: list[Word], columns: list[dict], place) -> dict[str, Any]:
    held: dict[str, list[str]] = {c["name"]: [] for c in columns}
    for w in words:
        name = place(w)
        if name is not None:
            held[name].append(w.text)
    return {c["name"]: text if c.get("type", "text") == "text" else convert(text, c["type"]) for c in columns for text in [" ".join(held[c["name"]]).strip()]}


def header_table(lines: list[list[Word]], rule: dict) -> list[dict[str, Any]]:
    """Rows between header and stop, cut at midpoints between the header words found."""
    start, stop = ([norm(t) for t in rule[k].split()] for k in ("header_anchor", "end_anchor"))
    head = next((i for i, line in enumerate(lines) if after_anchor(line, start) is not None), None)
    if head is None:
        return []
    top = lines[head][0].top
    end = next((line[0].top for line in lines[head + 1 :] if after_anchor(line, stop) is not None), 1e9)
    found = []
    for c in rule["columns"]:
        first = norm(c["header"].split()[0])
        at = next((w.x0 for w in lines[head] if norm(w.text) == first), None)
        if at is not None:
            found.append((at, c))
    found.sort(key=lambda x: x[0])
    edges = [-1e9, *((a[0] + b[0]) / 2 for a, b in zip(found, found[1:])), 1e9]

    def place(w: Word) -> str | None:
        mid = (w.x0 + w.x1) / 2
        return next((c["name"] for (_, c), lo, hi in zip(found, edges, edges[1:]) if lo <= mid < hi), None)

    rows = [_cells(line, [c for _, c in found], place) for line in lines if top + 1 < line[0].top < end] if found else []
    return [r for r in rows if any(v not in (None, "", 0) for v in r.values())]


def _anchor_top(lines: list[list[Word]], text: str, times: Any, below: float | None = None) -> float | None:
    anchor = [norm(t) for t in text.split()]
    return _pick([line[0].top for line in lines if (below is None or line[0].top > below) and after_anchor(line, anchor) is not None], times)


def band_table(words: list[Word], lines: list[list[Word]], rule: dict) -> list[dict[str, Any]]:
    """Rows of fixed bands. Lines without figures join the nearest line with figures, above or below."""
    columns = rule["columns"]
    top = _anchor_top(lines, rule["header_anchor"], rule.get("header_occurrence", 1))
    if top is None:
        return []
    end = _anchor_top(lines, rule["end_anchor"], rule.get("end_occurrence", 1), top) if rule.get("end_anchor") else None
    low, high = top + float(rule.get("start_offset", 10.0)), end - float(rule.get("end_offset", 8.0)) if end is not None else 1e9

    def place(w: Word) -> str | None:
        for x in ((w.x0 + w.x1) / 2, w.x0):
            name = next((c["name"] for c in columns if c["x_min"] <= x < c["x_max"]), None)
            if name is not None:
                return name
        return None

    lines_ = rows_by_anchor([w for w in words if low < w.top < high], float(rule.get("row_tol", 6.0)), False)
    table = {"top": [r[0].top for r in lines_], "cells": [_cells(r, columns, place) for r in lines_]}
    figures = [c["name"] for c in columns if c["type"] in ("money", "number")]
    texts = [c["name"] for c in columns if c["type"] == "text"]
    full = [i for i, c in enumerate(table["cells"]) if any(c.get(f) not in (None, "") for f in figures)]
    if not full:
        return []
    homes: dict[int, list[int]] = {i: [i] for i in full}
    for i, c in enumerate(table["cells"]):
        if i not in homes and any((c.get(t) or "").strip() for t in texts):
            homes[min(full, key=lambda m: (abs(table["top"][m] - table["top"][i]), m))].append(i)
    out = []
    for home, members in homes.items():
        row = dict(table["cells"][home])
        ordered = sorted(members, key=lambda i: (table["top"][i], i == home))
        said = {t: [s for i in ordered if (s := str(table["cells"][i].get(t) or "").strip())] for t in {*texts, "description"}}
        row["description"] = " ".join(said["description"])
        for t in texts:
            if t != "description" and len(members) > 1:
                row[t] = "".join(said[t])
        if row["description"]:
            out.append(row)
    return out


def select_variant(template: dict, page_text: str) -> dict:
    """The layout whose keyword is in the text, else the first, laid over the template's own keys."""
    variants = template.get("variants")
    if not variants:
        return template
    low = page_text.lower()
    hit = next((v for v in variants if (kw := (v.get("identify") or {}).get("keyword")) and kw.lower() in low), variants[0])
    return {k: v for k, v in template.items() if k != "variants"} | hit


def extract(words: list[Word], template: dict) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Header fields and item rows of one document."""
    lines = rows_by_anchor(words, 3.0, True)
    template = select_variant(template, " ".join(w.text for w in words))
    header: dict[str, Any] = {"vendor": template.get("vendor", "")} | {k: read_field(lines, v) for k, v in (template.get("fields") or {}).items()}
    rule = template.get("line_items")
    if not rule:
        return header, []
    columns = rule.get("columns") or []
    items = band_table(words, lines, rule) if columns and "x_min" in columns[0] else header_table(lines, rule)
    derived = rule.get("derive_totals") or {}
    for name, how in derived.items():
        if "sum" in how:
            header[name] = round(sum(v for r in items if isinstance(v := r.get(how["sum"]), (int, float))), 2)
    for name, how in derived.items():
        if "diff" in how:
            a, b = (header.get(x) or 0.0 for x in how["diff"])
            header[name] = round(a - b, 2)
    return header, items
