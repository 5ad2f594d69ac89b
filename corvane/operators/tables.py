"""Tables rebuilt from the words and the horizontal rules of a page.

words: (table, text, x0, y0, x1, y1); rules: (table, y). The result has one row for each cell, (table, ok, reason, part, row, col, text), where part is
group, header, body or footnote. Rules divide a table into a header and body bands; columns are what stands between gutters that no body line
crosses; a word belongs to the column that holds its middle, else to the one it overlaps most, else to the nearest. A rebuilt table is taken
only if its cells hold the digits of its words, all of them and no others.

A table is small, so one task rebuilds a table at a time, and tables are spread over all tasks. Cases: a table without words is not there; one with
fewer than three rules, two columns or one body row, or whose digits do not agree, comes out as one row that says why; null texts are left out.
"""

from __future__ import annotations

import re
from collections import Counter, namedtuple
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

Word = namedtuple("Word", "text x0 y0 x1 y1")
NUMERIC = re.compile(r"^[(\[<>≤≥±+-]*\d[\d.,%/–-]*[)\]%*†‡a-d]*$")
FOOTNOTE = re.compile(r"^(?:[*†‡§¶]|[a-e]\s|Abbreviations?\b|Notes?\b|注[:：]|Data are\b)", re.I)
GUTTER = 1.2  # least width of a gutter in heights of a word


def band_of(x0: float, x1: float, bands: Sequence[tuple[float, float]]) -> int:
    """The band that holds the middle, else the one overlapped most, else the nearest; the leftmost of equals."""
    mid = (x0 + x1) / 2
    return max(range(len(bands)), key=lambda i: (bands[i][0] <= mid <= bands[i][1], max(0.0, min(x1, bands[i][1]) - max(x0, bands[i][0])), -abs(mid - sum(bands[i]) / 2), -i))


def lines_of(words: list[Word]) -> list[list[Word]]:
    """Lines from top to bottom: a word joins the line whose mean middle lies within half its height."""
    out: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (w.y0 + w.y1, w.x0)):
        mid = (w.y0 + w.y1) / 2
        if out and abs(mid - sum(v.y0 + v.y1 for v in out[-1]) / 2 / len(out[-1])) <= (w.y1 - w.y0) / 2:
            out[-1].append(w)
        else:
            out.append([w])
    return [sorted(line, key=lambda w: w.x0) for line in out]


def merged(spans: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def is_data(line: list[Word]) -> bool:
    return sum(NUMERIC.match(w.text) is not None for w in line) >= 2 or any(NUMERIC.match(w.text) for w in line[1:])


def without_footnotes(lines: list[list[Word]], width: float, gap: float) -> tuple[list[list[Word]], list[list[Word]]]:
    """Body and footnotes: behind the last line of data, from the first line that begins as a note or runs over half the table in one piece."""
    last = max((i for i, line in enumerate(lines) if is_data(line)), default=len(lines))
    for i in range(last + 1, len(lines)):
        pieces = merged([(w.x0, w.x1) for w in lines[i]], gap)
        if FOOTNOTE.match(" ".join(w.text for w in lines[i])) or len(pieces) == 1 and pieces[0][1] - pieces[0][0] >= width / 2:
            return lines[:i], lines[i:]
    return lines, []


def group_lines(lines: list[list[Word]], bands: list[tuple[float, float]], gap: float) -> int:
    """How many header lines at the top consist of labels over several columns; never all."""
    n = 0
    for line in lines[:-1]:
        pieces = merged([(w.x0, w.x1) for w in line], gap)
        if not all(sum(min(b, d) - max(a, c) > 1 for c, d in bands) >= 2 for a, b in pieces):
            break
        n += 1
    return n


def digits(texts) -> Counter:
    return Counter(x for t in texts for x in re.findall(r"\d+(?:\.\d+)?", t))


def verified(cells: list[str], words: list[Word]) -> bool:
    """Whether cells and words hold the same digits, both ways."""
    return digits(cells) == digits(w.text for w in words)


def rebuilt(words: list[Word], rules: Sequence[float]) -> tuple[str | None, dict[tuple[str, int, int], str]]:
    """(why not, (part, row, col) -> text)."""
    if len(marks := sorted(set(rules))) < 3:
        return "no_row_rules", {}
    inside = [w for w in words if marks[0] <= (w.y0 + w.y1) / 2 <= marks[-1]]
    below = [w for w in words if (w.y0 + w.y1) / 2 > marks[-1]]
    if not inside:
        return "no_words", {}
    heights = sorted(w.y1 - w.y0 for w in inside)
    gap = GUTTER * heights[len(heights) // 2]
    width = max(w.x1 for w in inside) - min(w.x0 for w in inside)
    head = lines_of([w for w in inside if (w.y0 + w.y1) / 2 < marks[1]])
    body, notes = without_footnotes(lines_of([w for w in inside if (w.y0 + w.y1) / 2 >= marks[1]]), width, gap)
    bands = merged([(w.x0, w.x1) for line in body if is_data(line) for w in line], gap)
    if len(bands) < 2:
        return "no_columns", {}
    out: dict[tuple[str, int, int], str] = {}

    def put(part: str, row: int, line: list[Word], columns: list[tuple[float, float]]) -> None:
        for w in line:
            key = (part, row, band_of(w.x0, w.x1, columns))
            out[key] = f"{out[key]} {w.text}" if key in out else w.text

    n = group_lines(head, bands, gap)
    for i, line in enumerate(head):
        put("group" if i < n else "header", i if i < n else 0, line, bands)
    row, many = -1, len(marks) > 3  # with rules between the rows a band is a row, else every line of data is one
    band_before = None
    for line in body:
        mid = (line[0].y0 + line[0].y1) / 2
        band = sum(m <= mid for m in marks)
        if row < 0 or (band != band_before if many else is_data(line) or line[0].x0 <= bands[0][1] and len(line) == 1):
            row += 1
        band_before = band
        put("body", row, line, bands)
    if row < 0:
        return "no_rows", {}
    for i, line in enumerate([*notes, *lines_of(below)]):
        out["footnote", i, 0] = " ".join(w.text for w in line)
    if not verified(list(out.values()), words if below else inside):
        return "digits_differ", {}
    return None, out


SCHEMA = "table string, ok boolean, reason string, part string, row int, col int, text string"


def rebuild(words: DataFrame, rules: DataFrame) -> DataFrame:
    def one(key: tuple, w: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        own = [Word(x.text, x.x0, x.y0, x.x1, x.y1) for x in w.itertuples() if x.text is not None]
        reason, cells = rebuilt(own, r["y"].dropna().tolist()) if own else ("no_words", {})
        found = [(key[0], True, None, p, i, j, t) for (p, i, j), t in sorted(cells.items())] if reason is None else [(key[0], False, reason, None, None, None, None)]
        out = pd.DataFrame(found, columns=["table", "ok", "reason", "part", "row", "col", "text"])
        return out.astype({"row": "Int32", "col": "Int32"})

    return words.groupBy("table").cogroup(rules.groupBy("table")).applyInPandas(one, SCHEMA)
