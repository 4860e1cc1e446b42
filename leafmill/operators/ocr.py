"""Books from recognised pages: columns of text found by their left edges, headings, footnotes, assembly.

A page is one row, so its structure is made where the row is; only the assembly of a book brings its pages together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.headings import CENTRE_TOLERANCE, CENTRED_WIDTH, PAGE_WIDTH, match_heading
from leafmill.functions.layout import ASSIGNED, METRIC_TOLERANCE, METRICS, X0_TOLERANCE, join_texts
from leafmill.functions.structure import FOOTNOTES, RAISED, SMALL
from leafmill.functions.patterns import NOISE

_CAPITAL = re.compile("[A-ZÄÖÜ]")


class MissingMetrics(ValueError):
    """A kind of book has no layout metrics, which its pages need."""


# -- layout ---------------------------------------------------------------------------------


def clusters(x0: list[float], widths: list[float]) -> list[dict]:
    """Left edges in groups: each, ascending, joins the first group whose mean is within 7, else begins one.

    ``widths`` keep the lines' order while edges are sorted, so a group's widths are those of other lines: known, and
    kept for equal results."""
    groups: list[dict] = []
    for x, w in zip(sorted(x0), widths, strict=True):
        g = next((g for g in groups if abs(x - g["mean"]) <= X0_TOLERANCE), None)
        if g is None:
            groups.append(g := {"values": [], "widths": [], "mean": x})
        g["values"].append(x)
        g["widths"].append(w)
        g["mean"] = sum(g["values"]) / len(g["values"])
    return sorted(groups, key=lambda g: g["mean"])


def page_metrics(lines: list[dict], offsets: dict[str, float] | None, kind: str = "") -> list[dict]:
    """Ranges of left edges by type, in order of assignment. offsets: expected distance of a type's edge from that of the
    paragraphs, or {"expected_x0", "tolerance"}."""
    if not lines:
        return []
    groups = clusters([x["x0"] for x in lines], [x["x1"] - x["x0"] for x in lines])
    if offsets is None:
        raise MissingMetrics(f"no metrics for books of type {kind!r}")
    body = max(range(len(groups)), key=lambda i: (len(groups[i]["values"]), -i))
    types = {body: "paragraph-text"}
    for name in ASSIGNED:
        spec = offsets.get(name)
        offset, tolerance = (spec.get("expected_x0"), spec.get("tolerance") or METRIC_TOLERANCE) if isinstance(spec, dict) else (spec, METRIC_TOLERANCE)
        if offset is None:
            continue
        near = [(abs(g["mean"] - groups[body]["mean"] - offset), i) for i, g in enumerate(groups) if i not in types]
        if near and min(near)[0] <= tolerance:
            types[min(near)[1]] = name
    rest = [i for i in range(len(groups)) if i not in types]
    types |= {i: f"unknown-{k}" for k, i in enumerate(rest, 1)}
    return [{"type": t, "min_x0": groups[i]["values"][0], "max_x0": groups[i]["values"][-1], "average_width": sum(groups[i]["widths"]) / len(groups[i]["widths"]), "max_width": max(groups[i]["widths"])} for i, t in types.items()]


def raised_mark(line: dict) -> str:
    """Digits or asterisks that begin the line, small and above its base."""
    out = ""
    for s in line.get("symbols") or []:
        small = s["y1"] - s["y0"] < (line["y1"] - line["y0"]) * SMALL
        if not small or s["base_y1"] is None or not s["y1"] < s["base_y1"] - RAISED or not re.fullmatch(r"\d+|\*+", s["text"], re.ASCII):
            break
        out += s["text"]
    return out


def without_noise(text: str) -> str:
    for pattern, new in NOISE:
        text = re.sub(pattern.replace(r"\z", r"\Z"), new.replace("$", "\\"), text)
    return text.strip()


def _centred(line: dict, metrics: list[dict]) -> bool:
    if abs((line["x0"] + line["x1"]) / 2 - PAGE_WIDTH / 2) > CENTRE_TOLERANCE:
        return False
    width = next((m["max_width"] for m in metrics if m["type"] == "paragraph-text"), 0)
    return not width or line["x1"] - line["x0"] <= width * CENTRED_WIDTH


def heading_at(i: int, lines: list[dict], levels: list[list[dict]], metrics: list[dict]) -> tuple[str, int] | None:
    """Heading that begins at a line and the line after it. levels: for each level the formats (pattern, multiple_lines)."""
    text = without_noise(lines[i]["text"])
    for level, formats in enumerate(levels, 1):
        hit = next(((f, m) for f in formats if (m := match_heading(text, f["pattern"]))), None)
        if not hit:
            continue
        heading, after = hit[1][""].strip(), i + 1
        while hit[0].get("multiple_lines") and after < len(lines) and lines[after]["text"] and _centred(lines[after], metrics):
            longer = f"{heading} {lines[after]['text'].strip()}"
            if not any(match_heading(longer, f["pattern"]) for f in formats):
                break
            heading, after = longer, after + 1
        # A line that goes on in lower case shows that this was no heading.
        if after < len(lines) and re.match("[a-zäöüß]", lines[after]["text"].strip()):
            return None
        return f"\n\n{'#' * level} {heading}\n\n", after
    return None


def append_line(text: str, line: str) -> str:
    """With a space, or glued if a hyphen ends the text and no capital begins the line."""
    if not text:
        return line
    return text[:-1] + line if text.endswith("-") and not _CAPITAL.match(line) else f"{text} {line}"


def page_text(lines: list[dict], levels: list[list[dict]], metrics: list[dict]) -> tuple[str, str]:
    """Text with headings, and footnotes, of a page."""
    body, notes, i = "", "", 0
    while i < len(lines):
        line, first = lines[i], i == 0
        found = heading_at(i, lines, levels, metrics) if line["text"] else None
        if found:
            body, i = body + found[0], found[1]
            continue
        i += 1
        text = line["text"].strip()
        if not text:
            continue
        kind = "footnote-start" if raised_mark(line) else next((m["type"] for m in metrics if m["min_x0"] <= line["x0"] <= m["max_x0"]), "paragraph-text")
        if first:
            body += text if kind == "paragraph-text" else f"\n\n{text}"
        elif kind == "paragraph-start":
            body += f"\n\n{text}"
        elif kind == "footnote-start" and (m := re.match(r"(\d+|\*+)\s*(.+)\Z", text, re.ASCII)):
            notes += f"\n\n[^{m[1]}]: {m[2]}"
        elif kind == "footnote-text":
            notes = append_line(notes, text)
        else:
            body = append_line(body, text)
    return body, notes


def join_pages(first: str, second: str) -> str:
    """With a space, or glued if a hyphen ends the first and the second doesn't begin with a capital."""
    if not first or not second:
        return first or second
    first = first.rstrip(" \t")
    return first[:-1] + second if first.endswith("-") and second[0] == second[0].lower() else f"{first} {second}"


# -- plans ----------------------------------------------------------------------------------

#: Pages that are Python objects at a time: a batch of Arrow has 10,000, each line and sign of which would be a dictionary.
SLICE = 64
_METRICS = pa.list_(pa.struct([("type", pa.string()), *((n, pa.float64()) for n in ("min_x0", "max_x0", "average_width", "max_width"))]))


def structure_pages(pages: DataFrame, levels: list[list[dict]], offsets: dict | None, kind: str = "", key: str = "book_id") -> DataFrame:
    """book_id (or another ``key``), page_no, metrics, body, footnotes of each page. pages: the key, page_no and lines (text, x0, y0, x1, y1 and
    the first word's symbols). No shuffle: a page is a row, and few pages are Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = pa.schema([(key, batch.schema.field(key).type), ("page_no", pa.int32()), ("metrics", _METRICS), ("body", pa.string()), ("footnotes", pa.string())])
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for r in batch.slice(at, SLICE).to_pylist():
                    lines = [dict(x, symbols=x.get("symbols") or []) for x in r["lines"] or []]
                    metrics = page_metrics(lines, offsets, kind)
                    body, notes = page_text(lines, levels, metrics)
                    rows.append({key: r[key], "page_no": r["page_no"], "metrics": metrics, "body": body, "footnotes": notes})
                yield pa.RecordBatch.from_pylist(rows, schema=form)

    return pages.select(key, "page_no", "lines").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, page_no int, metrics {METRICS}, body string, footnotes string")


def assemble_books(structured: DataFrame, key: str = "book_id") -> DataFrame:
    """book_id (or another ``key``), text of each book: its pages in order, then its footnotes under their heading. Pages of a book are gathered by
    partial aggregation and joined in the JVM; a book is one value, and so bounded as a row is."""
    page = F.struct("page_no", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("footnotes", F.lit("")).alias("footnotes"))
    books = structured.groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    body = join_texts(F.transform("pages", lambda p: p["body"]))
    notes = join_texts(F.concat(F.array(F.lit(f"\n\n{FOOTNOTES}")), F.transform("pages", lambda p: p["footnotes"])))
    return books.select(key, F.concat(body, notes).alias("text"))
