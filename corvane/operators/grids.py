"""Table and page geometry over rows of words, spans and cells.

Rows come from any reader that gives boxes; a page (the `keys`) is the unit of every window and join, and pages are small, so no group grows
with the corpus. Operators that depend on the order of a fold (running means) take one page at a time through Arrow.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.relational import merged_intervals
from corvane.sources.readers import Blocks


def gutters(words: DataFrame, keys: list[str], x0: str, x1: str, least: float) -> DataFrame:
    """(keys, left_edge, right_edge): stretches of at least `least` that no word of a page covers."""
    bands = merged_intervals(words, keys, x0, x1)
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return bands.select(*keys, F.col("end").alias("left_edge"), nxt.alias("right_edge")).where(F.col("right_edge") - F.col("left_edge") >= least)


def column_centres(words: DataFrame, keys: list[str], x0: str, x1: str, least: float) -> DataFrame:
    """(keys, column, centre): columns between gutters, numbered from 0, with the middle of what stands in them."""
    bands = merged_intervals(words, keys, x0, x1, gap=least)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return bands.select(*keys, n.alias("column"), ((F.col("start") + F.col("end")) / 2).alias("centre"))


def best_band(words: DataFrame, bands: DataFrame, keys: list[str], word: str) -> DataFrame:
    """(word, band): the band of the page that a word (x0, x1) overlaps most, the leftmost of equals; words outside all bands are left out."""
    b = bands.select(*keys, "band", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    met = words.join(b, keys).where((F.col("x0") < F.col("_b1")) & (F.col("_b0") < F.col("x1")))
    overlap = F.least("x1", "_b1") - F.greatest("x0", "_b0")
    return met.groupBy(word).agg(F.max_by("band", F.struct(overlap, -F.col("_b0"))).alias("band"))


def overlap_pairs(spans: DataFrame, keys: list[str], span: str, share: float) -> DataFrame:
    """(a, b): spans (x0, x1) of one line that share more than `share` of the smaller. Overlapping spans begin in the same or the next cell of
    a grid as wide as the widest span of the line, so only those meet."""
    wide = spans.groupBy(*keys).agg(F.max(F.col("x1") - F.col("x0")).alias("_w"))
    s = spans.join(wide, keys).where(F.col("_w") > 0).withColumn("_cell", F.floor(F.col("x0") / F.col("_w")))
    a = s.select(*keys, F.col(span).alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"))
    b = s.select(*keys, F.col(span).alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), "_cell")
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    return a.join(b, [*keys, "_cell"]).where((F.col("a") < F.col("b")) & (shared > share * F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")))).select("a", "b")


def text_lines(words: DataFrame, page: str, tolerance: float = 0.6) -> DataFrame:
    """(page, line, text): words (x0, y0, y1, text) in lines, a word joining a line while its middle is within `tolerance` of the running
    mean height from the line's running mean."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(mid=(pdf["y0"] + pdf["y1"]) / 2, high=pdf["y1"] - pdf["y0"]).sort_values(["mid", "x0"])
        lines: list[list] = []
        for w in pdf.itertuples():
            if lines and abs(w.mid - lines[-1][0]) <= tolerance * lines[-1][1]:
                m, h, n, ws = lines[-1]
                lines[-1] = [(m * n + w.mid) / (n + 1), (h * n + w.high) / (n + 1), n + 1, [*ws, w]]
            else:
                lines.append([w.mid, w.high, 1, [w]])
        return pd.DataFrame([(pdf[page].iloc[0], i, " ".join(w.text for w in sorted(ws, key=lambda w: w.x0))) for i, (_, _, _, ws) in enumerate(lines)], columns=[page, "line", "text"])

    return words.groupBy(page).applyInPandas(fold, f"{page} string, line int, text string")


def pipe_rows(markdown: str) -> list[list[str]]:
    """Rows of a pipe table; the rule under the header is none."""
    rows = []
    for line in markdown.splitlines():
        s = line.strip()
        if s.startswith("|") and s.count("|") >= 2:
            cells = [x.strip().replace("\0", "|") for x in s.strip("|").replace("\\|", "\0").split("|")]
            if not all(re.fullmatch(r":?-+:?", x) for x in cells):
                rows.append(cells)
    return rows


class Rows(Blocks):
    """Cells of an HTML table, those that span columns repeated as blanks."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            span = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], max(1, min(int(span) if span.isdigit() else 1, 1000))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1] += [re.sub(r"\s+", " ", "".join(self.cell)).strip(), *[""] * (self.span - 1)]
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def grid_of(text: str) -> list[list[str]]:
    """The grid of an HTML or pipe table; less than two rows are no table."""
    if re.search(r"<table", text, re.I):
        r = Rows()
        r.feed(text)
        rows = [x for x in r.rows if x]
    else:
        rows = pipe_rows(text)
    return rows if len(rows) > 1 else []


def wrapped_rows_merged(rows: list[list[str]]) -> list[list[str]]:
    """Rows that only carry on the one before (first cell blank and the row before ends with a comma) are joined to it."""
    out: list[list[str]] = []
    for r in rows:
        if out and len(r) == len(out[-1]) and not r[0].strip() and any(x.rstrip().endswith((",", "，")) for x in out[-1]):
            out[-1] = [f"{a} {b}".strip() for a, b in zip(out[-1], r)]
        else:
            out.append(list(r))
    return out


def expanded_boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, x0, x1) widened to the middle between neighbours of their row."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    left, right = F.lag("x1").over(w), F.lead("x0").over(w)
    return cells.withColumns({"wide0": F.coalesce((left + F.col("x0")) / 2, F.col("x0")), "wide1": F.coalesce((F.col("x1") + right) / 2, F.col("x1"))})


def order_drift(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose rank by column differs from their rank by place in the row."""
    a, b = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "row").orderBy("x0", "col")
    return cells.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).where(F.col("_a") != F.col("_b")).drop("_a", "_b")


def reading_order(blocks: DataFrame, page: str, columns: int) -> DataFrame:
    """Blocks (x0, y0) with `place`: column by column, from top to bottom."""
    w = Window.partitionBy(page)
    width = F.greatest(F.max("x0").over(w) - F.min("x0").over(w), F.lit(1e-9))
    col = F.least(F.floor((F.col("x0") - F.min("x0").over(w)) / width * columns), F.lit(columns - 1))
    return blocks.withColumn("_c", col).withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("_c", "y0", "x0"))).drop("_c")


def row_similarity(a: list[str], b: list[str]) -> float:
    """The best of: Jaccard index of the numbers, share of the common prefix, sequence ratio of the whole rows."""
    from difflib import SequenceMatcher

    x, y = (re.sub(r"\s+", "", "".join(r)).lower() for r in (a, b))
    if not x or not y:
        return 0.0
    m, n = (set(re.findall(r"\d+(?:\.\d+)?", " ".join(r))) for r in (a, b))
    jaccard = len(m & n) / len(m | n) if m and n else 0.0
    prefix = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) / max(len(x), len(y))
    return max(jaccard, prefix, SequenceMatcher(None, x, y).ratio())


def aligned_rows(a: list[list[str]], b: list[list[str]], least: float = 0.6) -> list[tuple[int, int]]:
    """Pairs of rows of two readings of one table, in order, with the greatest sum of similarities of at least `least`."""
    n, m = len(a), len(b)
    s = [[row_similarity(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + s[i][j] if s[i][j] >= least else 0.0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if s[i][j] >= least and best[i][j] == best[i + 1][j + 1] + s[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def components(segments: DataFrame, page: str, reach: float) -> DataFrame:
    """(page, id, component): segments (id, x0, y0, x1, y1) that touch, or come within `reach` of each other, one after another."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = list(pdf[["id", "x0", "y0", "x1", "y1"]].sort_values("x0").itertuples(index=False))
        root = list(range(len(boxes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a in enumerate(boxes):
            for j in range(i + 1, len(boxes)):
                b = boxes[j]
                if b.x0 > a.x1 + reach:
                    break
                if b.y0 <= a.y1 + reach and a.y0 <= b.y1 + reach:
                    root[find(j)] = find(i)
        least: dict[int, int] = {}
        for i, b in enumerate(boxes):
            least[find(i)] = min(least.get(find(i), b.id), b.id)
        return pd.DataFrame([(pdf[page].iloc[0], b.id, least[find(i)]) for i, b in enumerate(boxes)], columns=[page, "id", "component"])

    return segments.groupBy(page).applyInPandas(fold, f"{page} string, id long, component long")


def cell_text(items: list[tuple[float, float, str]], tolerance: float) -> str:
    """Text of a cell from its pieces (x0, middle, text): lines by the middle, Chinese joined without a space."""
    lines: list[list[tuple[float, float, str]]] = []
    for x in sorted(items, key=lambda x: (x[1], x[0])):
        if lines and x[1] - lines[-1][0][1] <= tolerance:
            lines[-1].append(x)
        else:
            lines.append([x])
    out = ""
    for t in (t for line in lines for _, _, t in sorted(line)):
        glue = "" if not out or re.match("[㐀-鿿，。]", t) and re.search("[㐀-鿿，。]$", out) else " "
        out += glue + t
    return out
