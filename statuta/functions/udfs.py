"""The few functions that built-ins cannot say: recursive splitter, Markdown chunks,
line grouping, WordprocessingML to HTML. All work on one row or one page; Spark deals them out
by the wrappers in columns.py."""

from __future__ import annotations

import bisect
import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np

CHUNK, OVERLAP = 1200, 150
# Where a long text may be cut, in this order.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _cuts(text: str, begin: int, end: int, size: int, overlap: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of the text: from each place the furthest one that ends before a separator
    of this level and still fits; what has none is cut at the next level, at last anywhere."""
    if end - begin <= size:
        yield begin, end
        return
    if level == len(SEPARATORS):
        yield from ((k, min(k + size, end)) for k in range(begin, end, size - overlap))
        return
    width = len(SEPARATORS[level])
    marks = [m.start() for m in re.finditer(re.escape(SEPARATORS[level]), text[begin:end])]
    stops = [begin + m for m in marks] + [end]
    starts = [begin, *(begin + m + width for m in marks)]
    k = 0
    while k < len(starts):
        last = max(k, bisect.bisect_right(stops, starts[k] + size) - 1)
        if stops[k] > starts[k]:  # nothing begins at a separator
            yield from _cuts(text, starts[k], stops[last], size, overlap, level + 1)
            k = last + 1
        else:
            k += 1


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of about size characters, cut at the coarsest separator that will do; each
    but the first starts with the end of the one before."""
    text = text or ""
    spans = list(_cuts(text, 0, len(text), size, overlap))
    before = [(0, 0), *((max(a, b - overlap), b) for a, b in spans)]
    chunks = ((text[c:d] + text[a:b]).strip() for (a, b), (c, d) in zip(spans, before, strict=False))
    return [c for c in chunks if c]


def chunk_markdown(text: str, target: int = 10_000) -> list[dict]:
    """Lines gathered until a first or second level heading comes after ``target`` characters,
    or 1.5 times as many are held; each chunk with the headings in force where it is cut."""
    out: list[dict] = []
    held, size, h1, h2 = [], 0, "", ""

    def flush() -> None:
        out.append({"content": "\n".join(held), "hierarchy": f"{h1} / {h2}" if h2 else h1})

    for line in (text or "").split("\n"):
        level = 1 if line.startswith("# ") else 2 if line.startswith("## ") else 0
        if level == 1:
            h1, h2 = line[2:].strip(), ""
        elif level == 2:
            h2 = line[3:].strip()
        if size >= int(target * 1.5) or (level and size >= target):
            flush()
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    if held:
        flush()
    return out


SNAP, GAP = 2.0, 30.0


#: Fields of a span, in the order in which lines_of() takes them.
SPAN = ("y", "x", "size", "bold", "text")


def _line(x: list[float], size: list[float], bold: list[bool], text: list[str]) -> tuple[str, float, bool]:
    """One line of spans, given from top to bottom, read from left to right."""
    order = sorted(range(len(x)), key=lambda k: (x[k] != x[k], x[k]))
    joined = text[order[0]]
    for a, k in zip(order, order[1:], strict=False):
        t = text[k]
        wide = x[k] - (x[a] + size[a] * 0.55 * len(text[a])) > GAP
        joined += ("\t" if wide and (t[:1].isdigit() or t.lower().startswith("not applicable")) else " ") + t
    total = 0.0
    for s in size:
        total += s
    return joined, round((total if len(size) < 8 else float(np.sum(size))) / len(size), 1), 2 * sum(bold) > len(bold)


def lines_of(y: list, x: list, size: list, bold: list, text: list) -> list[tuple[str, float, bool]]:
    """The spans of one page as lines (text, size, bold): a span belongs to a line while it is
    within SNAP of the line's first span. A wide gap before a value makes a tab. Pages have few spans, so
    lists serve better than arrays."""
    y, x, size = ([float(v or 0) for v in c] for c in (y, x, size))
    bold, text = [float(v or 0) > 0 for v in bold], [t or "" for t in text]
    order = sorted(range(len(y)), key=lambda k: (y[k] != y[k], y[k], x[k] != x[k], x[k]))
    out, k = [], 0
    while k < len(order):
        stop, end = y[order[k]] + SNAP, k + 1
        while end < len(order) and not y[order[end]] > stop:
            end += 1
        part = order[k:end]
        out.append(_line([x[i] for i in part], [size[i] for i in part], [bold[i] for i in part], [text[i] for i in part]))
        k = end
    return out


def blocks_of(y: list, x: list, size: list, bold: list, text: list) -> list[dict]:
    """Lines of one page merged while size (within half a point of the block's first line) and
    boldness hold; lines with a tab stand alone."""
    lines, out, k = lines_of(y, x, size, bold, text), [], 0
    while k < len(lines):
        first, end = lines[k], k + 1
        while "\t" not in first[0] and end < len(lines) and "\t" not in lines[end][0] and lines[end][2] == first[2] and abs(lines[end][1] - first[1]) < 0.5:
            end += 1
        out.append({"text": "\n".join(t for t, *_ in lines[k:end]).strip(), "size": first[1], "bold": first[2]})
        k = end
    return [r for r in out if r["text"]]


def page_lines(spans: list[dict]) -> list[tuple[str, float, bool]]:
    """lines_of() the spans (y, x, size, bold, text) of one page."""
    return lines_of(*([s[c] for s in spans] for c in SPAN))


def page_blocks(spans: list[dict]) -> list[dict]:
    """blocks_of() the spans of one page."""
    return blocks_of(*([s[c] for s in spans] for c in SPAN))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Paragraph styles that open a coloured block.
BLOCKS = {"ruletitle": "rule", "amctitle": "amc", "gmtitle": "gm"}


def _run_html(r: ET.Element) -> str:
    text = "".join({"t": html.escape(e.text or ""), "tab": "\t", "br": "<br/>"}.get(e.tag.removeprefix(_W), "") for e in r.iter())
    props = r.find(f"{_W}rPr")
    for tag, mark in (("b", "strong"), ("i", "em"), ("u", "u")):
        if props is not None and props.find(f"{_W}{tag}") is not None and text:
            text = f"<{mark}>{text}</{mark}>"
    return text


def _table_html(tbl: ET.Element) -> str:
    rows = []
    for tr in tbl.findall(f"{_W}tr"):
        cells = []
        for tc in tr.findall(f"{_W}tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            width = f' colspan="{span.get(f"{_W}val")}"' if span is not None else ""
            cells.append(f"<td{width}>" + "<br/>".join("".join(_run_html(r) for r in p.iter(f"{_W}r")) for p in tc.iter(f"{_W}p")) + "</td>")
        rows.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(rows) + "</table>"


def content_html(xml: str) -> str | None:
    """one content control of WordprocessingML as HTML: headings, blocks, lists, inline marks
    and tables; null if it is not well formed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    out: list[str] = []
    state = {"block": "", "list": False}

    def close_list() -> None:
        if state["list"]:
            out.append("</ul>")
            state["list"] = False

    def close_block() -> None:
        close_list()
        if state["block"]:
            out.append("</div>")
            state["block"] = ""

    def walk(e: ET.Element) -> None:
        tag = e.tag.removeprefix(_W)
        if tag == "tbl":
            close_list()
            out.append(_table_html(e))
        elif tag == "p":
            style_of = e.find(f"{_W}pPr/{_W}pStyle")
            style = (style_of.get(f"{_W}val") or "").lower() if style_of is not None else ""
            text = "".join(_run_html(r) for r in e.iter(f"{_W}r"))
            if not text.strip():
                return
            if style in BLOCKS:
                close_block()
                state["block"] = BLOCKS[style]
                out.append(f'<div class="{state["block"]}"><h3>{text}</h3>')
            elif style.startswith("heading") and style[7:8].isdigit():
                close_block()
                out.append(f"<h{style[7]}>{text}</h{style[7]}>")
            elif style.startswith("list") or e.find(f"{_W}pPr/{_W}numPr") is not None:
                if not state["list"]:
                    out.append("<ul>")
                    state["list"] = True
                out.append(f"<li>{text}</li>")
            else:
                close_list()
                out.append(f"<p>{text}</p>")
        else:
            for child in e:
                walk(child)

    walk(root)
    close_block()
    return "".join(out)

