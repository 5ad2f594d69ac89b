"""Readers: files and text columns to rows of segments.

Container and markup formats are read as `binaryFile` rows, each parsed by one call in an Arrow batch, so a file is the unit of parallelism
and nothing passes the driver. Every reader yields (path, pos, text, ref): the position from 0 in reading order and, in `ref`, where the
text stands (a cell, a time span, a tag). Files that cannot be parsed yield one row with a null text and the reason in `ref`.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship

# Reader by file name extension; tags that hold no text to translate, and block tags.
WORKFLOWS = {"docx": "docx", "doc": "unsupported", "pdf": "markdown_based", "md": "markdown_based", "markdown": "markdown_based", "txt": "txt", "xlsx": "xlsx", "csv": "xlsx", "srt": "srt", "ass": "ass", "html": "html", "htm": "html", "epub": "epub", "json": "json", "pptx": "pptx"}
SKIPPED = frozenset("script style code pre noscript template svg math".split())
BLOCKS = frozenset("p div li td th h1 h2 h3 h4 h5 h6 title caption figcaption blockquote dt dd option label button summary".split())
SEGMENTS = "path string, pos int, text string, ref string"
LINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def workflow_of(name: Column) -> Column:
    """The reader for a file name; `unsupported` for an unknown extension, never a guess."""
    table = F.create_map(*[F.lit(x) for kv in WORKFLOWS.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("unsupported"))


def text_segments(spark: SparkSession, path: str, mode: str = "line") -> DataFrame:
    """Text files by `line`, by `paragraph` (blank lines divide) or whole (`none`)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    pieces = {"line": F.split("value", LINE), "paragraph": F.split("value", r"\n\s*\n"), "none": F.array("value")}[mode]
    return whole.select("path", F.posexplode(pieces).alias("pos", "text")).select("path", "pos", "text", F.lit(mode).alias("ref"))


def files(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple[str, str]]], glob: str = "*") -> DataFrame:
    """Segments of all files under a path, by a parser of their bytes."""
    ship(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    out += [(p, i, t, r) for i, (t, r) in enumerate(parse(bytes(data)))]
                except Exception as e:  # noqa: BLE001 - any malformed file is reported as a row
                    out.append((p, 0, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "pos", "text", "ref"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(rows, SEGMENTS)


def parse_srt(data: bytes) -> Iterator[tuple[str, str]]:
    """Blocks of number, time span and text."""
    for block in re.split(r"\n\s*\n", decoded(data).replace("\r\n", "\n").strip()):
        lines = block.split("\n")
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is not None:
            yield "\n".join(lines[at + 1 :]), lines[at].strip()


def parse_ass(data: bytes) -> Iterator[tuple[str, str]]:
    """Dialogue lines: the text is what follows the ninth comma."""
    for line in decoded(data).splitlines():
        if line.startswith("Dialogue:"):
            parts = line[len("Dialogue:") :].split(",", 9)
            if len(parts) == 10:
                yield parts[9], f"{parts[1].strip()}-->{parts[2].strip()}"


class Blocks(HTMLParser):
    """Texts of the innermost block elements, and safe attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack: list[tuple[str, list[str], bool]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif not self.skip:
            for k, v in attrs:
                if k in ("alt", "title", "placeholder", "aria-label") and v and v.strip():
                    self.out.append((v.strip(), f"{tag}@{k}"))
            if tag in BLOCKS:
                if self.stack:
                    self.flush(self.stack[-1])
                self.stack.append((tag, [], True))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS and any(t == tag for t, _, _ in self.stack):
            while self.stack:
                top = self.stack.pop()
                self.flush(top)
                if top[0] == tag:
                    break

    def handle_data(self, data):
        if not self.skip and data.strip():
            if self.stack:
                self.stack[-1][1].append(data)
            else:
                self.out.append((data.strip(), "body"))

    def flush(self, block):
        if text := re.sub(r"\s+", " ", "".join(block[1])).strip():
            self.out.append((text, block[0]))
        block[1].clear()


def html_blocks(text: str) -> list[tuple[str, str]]:
    b = Blocks()
    b.feed(text)
    b.close()
    while b.stack:
        b.flush(b.stack.pop())
    return b.out


def parse_html(data: bytes) -> Iterator[tuple[str, str]]:
    yield from html_blocks(decoded(data))


def decoded(data: bytes) -> str:
    """Text of unknown encoding: by its byte order mark, else UTF-8, else GB 18030, else Latin-1."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(enc, "replace")
    for enc in ("utf-8", "gb18030"):
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def parse_csv(data: bytes) -> Iterator[tuple[str, str]]:
    """Cells; the delimiter is sniffed from the first 4096 characters."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    for r, row in enumerate(csv.reader(io.StringIO(text), dialect), 1):
        for k, cell in enumerate(row, 1):
            yield cell, f"R{r}C{k}"


def json_leaves(node, at: str = "$") -> Iterator[tuple[str, str]]:
    """String leaves of a JSON value with their paths."""
    if isinstance(node, str):
        yield node, at
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from json_leaves(v, f"{at}.{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from json_leaves(v, f"{at}[{i}]")


def parse_json(data: bytes) -> Iterator[tuple[str, str]]:
    yield from json_leaves(json.loads(decoded(data)))


STEP = re.compile(r"\.\.|\.?([A-Za-z_][\w-]*|\*)|\.?\[(?:(\*)|(-?\d+)|'([^']*)'|\"([^\"]*)\"|(-?\d*):(-?\d*))\]")


def json_steps(path: str) -> list[tuple[str, object]]:
    """A JSONPath as steps: name, index, slice, any, or deep. What is not known raises."""
    at, out = int(path.startswith("$")), []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"{path!r} is no path from {path[at:]!r} on")
        name, star, index, one, two, low, high = m.groups()
        if m[0] == "..":
            out.append(("deep", None))
        elif star or name == "*":
            out.append(("any", None))
        elif index is not None:
            out.append(("index", int(index)))
        elif low is not None:
            out.append(("slice", slice(int(low) if low else None, int(high) if high else None)))
        else:
            out.append(("name", next(x for x in (name, one, two) if x is not None)))
        at = m.end()
    return out


def json_select(node, steps: list[tuple[str, object]], at: str = "$") -> Iterator[tuple[object, str]]:
    """(node, its place) of everything a path points at, in order of the document."""
    if not steps:
        yield node, at
        return
    (kind, what), rest = steps[0], steps[1:]
    children = [(f"{at}.{k}", k, v) for k, v in node.items()] if isinstance(node, dict) else [(f"{at}[{i}]", i, v) for i, v in enumerate(node)] if isinstance(node, list) else []
    if kind == "deep":
        yield from json_select(node, rest, at)
        for place, _, v in children:
            yield from json_select(v, steps, place)
        return
    wanted = set(range(len(children))[what]) if kind == "slice" and isinstance(node, list) else {what + len(children) if kind == "index" and what < 0 else what}
    for place, key, v in children:
        if kind == "any" or kind == "name" and isinstance(node, dict) and key == what or kind in ("index", "slice") and isinstance(node, list) and key in wanted:
            yield from json_select(v, rest, place)


def json_texts(value, paths: list[str]) -> list[tuple[str, str]]:
    """(text, place) of all texts under what the paths select; a text that two paths reach comes once, where the first one does."""
    out: dict[str, str] = {}
    for path in paths:
        for node, at in json_select(value, json_steps(path)):
            for text, place in json_leaves(node, at):
                out.setdefault(place, text)
    return [(t, p) for p, t in out.items()]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def declares(data: bytes | str) -> bool:
    """Whether types or entities are declared in front of the root element, however long the comments before them are."""
    if isinstance(data, bytes):
        wide = {b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16", b"<\x00": "utf-16-le", b"\x00<": "utf-16-be"}
        data = data.decode(wide.get(data[:2], "utf-8"), "ignore")
    prologue = re.compile(r"\s+|\ufeff|<\?.*?\?>|<!--.*?-->", re.S)
    at = 0
    while m := prologue.match(data, at):
        at = m.end()
    return data[at : at + 2] == "<!"


def safe_xml(data: bytes | str) -> ET.Element:
    """An XML tree; declarations of types and entities are refused, so nothing is expanded or fetched."""
    if declares(data):
        raise ValueError("document type declarations are not accepted")
    return ET.fromstring(data)


def tmx_units(data: bytes | str, max_units: int = 20_000, max_lang: int = 16, max_chars: int = 20_000, max_bytes: int = 8 << 20) -> Iterator[tuple[str, str, str, str]]:
    """(source language, source, target language, target): the first two variants of each unit.

    A document that is too large, has too many units, or has a language code or a segment that is too long, raises: nothing is left out unsaid.
    """
    if len(data if isinstance(data, bytes) else data.encode()) > max_bytes:
        raise ValueError(f"a document of more than {max_bytes} bytes")
    n = 0
    for tu in safe_xml(data).iter():
        if local(tu.tag) != "tu":
            continue
        n += 1
        if n > max_units:
            raise ValueError(f"more than {max_units} units")
        found = []
        for tuv in tu:
            if local(tuv.tag) == "tuv":
                lang = next((v for k, v in tuv.attrib.items() if local(k) == "lang"), "")
                seg = next(("".join(s.itertext()) for s in tuv if local(s.tag) == "seg"), "")
                if len(lang) > max_lang or len(seg) > max_chars:
                    raise ValueError(f"unit {n} has a language code of more than {max_lang} or a segment of more than {max_chars} characters")
                found.append((lang, seg))
        if len(found) >= 2 and found[0][1].strip() and found[1][1].strip():
            yield (*found[0], *found[1])


def parse_tmx(data: bytes) -> Iterator[tuple[str, str]]:
    for a, s, b, t in tmx_units(data):
        yield s, f"{a}>{b}\t{t}"


def parse_tbx(data: bytes) -> Iterator[tuple[str, str]]:
    """Term entries; the two smallest language codes are source and target."""
    for entry in safe_xml(data).iter():
        if local(entry.tag) in ("termEntry", "conceptEntry"):
            terms = {}
            for ls in entry.iter():
                if local(ls.tag) in ("langSet", "langSec"):
                    lang = next((v for k, v in ls.attrib.items() if local(k) == "lang"), "")
                    if term := next((x.text for x in ls.iter() if local(x.tag) == "term" and x.text), None):
                        terms.setdefault(lang, term.strip())
            langs = sorted(terms)
            if len(langs) >= 2:
                yield terms[langs[0]], f"{langs[0]}>{langs[1]}\t{terms[langs[1]]}"


def parse_xlsx(data: bytes) -> Iterator[tuple[str, str]]:
    """Text cells of all sheets, in the order of the workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in safe_xml(z.read("xl/sharedStrings.xml")) if local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in safe_xml(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        for sheet in (s for s in safe_xml(z.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"):
            rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
            target = (rels.get(rid) or "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            for cell in (x for x in safe_xml(z.read(path)).iter() if local(x.tag) == "c"):
                value = next((x.text for x in cell if local(x.tag) == "v"), None)
                text = shared[int(value)] if cell.get("t") == "s" and value is not None else "".join(t.text or "" for t in cell.iter() if local(t.tag) == "t") if cell.get("t") == "inlineStr" else value
                if text:
                    yield text, f"{sheet.get('name')}!{cell.get('r')}"


def paragraphs_of(root: ET.Element, paragraph: str, text: str) -> Iterator[str]:
    for p in root.iter():
        if local(p.tag) == paragraph and (s := "".join(t.text or "" for t in p.iter() if local(t.tag) == text)).strip():
            yield s


def parse_docx(data: bytes) -> Iterator[tuple[str, str]]:
    """Paragraphs of the body, headers, footers and notes; instructions of fields are no text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)]
        for name in sorted(parts, key=lambda n: (n != "word/document.xml", n)):
            for s in paragraphs_of(safe_xml(z.read(name)), "p", "t"):
                yield s, name[5:-4]


def parse_pptx(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for name in sorted(slides, key=lambda n: int(re.findall(r"\d+", n)[-1])):
            for s in paragraphs_of(safe_xml(z.read(name)), "p", "t"):
                yield s, name[11:-4]


def parse_epub(data: bytes) -> Iterator[tuple[str, str]]:
    """Blocks of the documents in the order of the spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next((x.get("full-path") for x in safe_xml(z.read("META-INF/container.xml")).iter() if local(x.tag) == "rootfile"), None)
        root, base = safe_xml(z.read(opf)), opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        items = {i.get("id"): i.get("href") for i in root.iter() if local(i.tag) == "item"}
        for ref in (items.get(r.get("idref")) for r in root.iter() if local(r.tag) == "itemref"):
            if ref and base + ref in z.namelist():
                for text, tag in html_blocks(decoded(z.read(base + ref))):
                    yield text, f"{ref}#{tag}"


FENCE = re.compile(r"^(```|~~~)")


def markdown_blocks(text: str, most_bytes: int | None = None) -> list[tuple[str, str]]:
    """(block, separator behind it): fences and display formulas stay whole, blank lines divide, and what is longer than `most_bytes` is cut
    at line ends, then anywhere. Joining blocks and separators gives the text back."""
    out: list[tuple[str, str]] = []
    block: list[str] = []
    closing = None
    for line in text.split("\n"):
        m = FENCE.match(line) or (re.match(r"^\$\$\s*$", line) and "$$")
        mark = m if isinstance(m, str) else m[1] if m else None
        if closing:
            block.append(line)
            closing = None if mark == closing else closing
        elif mark:
            block.append(line)
            closing = mark
        elif line.strip() == "" and block and block[-1].strip() != "":
            out.append(("\n".join(block), "\n"))
            block = [line]
        elif line.strip() == "":
            block.append(line)
        else:
            if block and all(not b.strip() for b in block):
                last = out.pop() if out else ("", "")
                out.append((last[0], last[1] + "\n".join(block) + "\n"))
                block = []
            block.append(line)
    out.append(("\n".join(block), ""))
    return [p for b, s in out for p in cut_block(b, s, most_bytes)]


def cut_block(block: str, sep: str, most: int | None) -> list[tuple[str, str]]:
    if not most or len(block.encode()) <= most:
        return [(block, sep)]
    pieces, now = [], ""
    for line in block.splitlines(keepends=True):
        while len(line.encode()) > most:
            head = line.encode()[:most].decode("utf-8", "ignore") or line[0]
            if now:
                pieces.append(now)
                now = ""
            pieces.append(head)
            line = line[len(head) :]
        if len((now + line).encode()) > most:
            pieces.append(now)
            now = ""
        now += line
    pieces = [p for p in (*pieces, now) if p]
    return [(p, "") for p in pieces[:-1]] + [(pieces[-1], sep)]


def parse_markdown(data: bytes) -> Iterator[tuple[str, str]]:
    for block, sep in markdown_blocks(decoded(data)):
        if block.strip():
            yield block, json.dumps(sep)


PARSERS = {"txt": lambda d: ((x, "line") for x in decoded(d).splitlines()), "srt": parse_srt, "ass": parse_ass, "html": parse_html, "json": parse_json, "csv": parse_csv, "tmx": parse_tmx, "tbx": parse_tbx, "xlsx": parse_xlsx, "docx": parse_docx, "pptx": parse_pptx, "epub": parse_epub, "md": parse_markdown}


def segments(spark: SparkSession, path: str, kind: str, glob: str | None = None) -> DataFrame:
    """(path, pos, text, ref) of all files of one kind under a path."""
    return files(spark, path, PARSERS[kind], glob or f"*.{kind}")


def in_regions(cells: DataFrame, regions: list[tuple[int, int, int, int]]) -> DataFrame:
    """Cells (col, row) inside any of the boxes (c0, r0, c1, r1); no boxes let all through."""
    if not regions:
        return cells
    inside = F.lit(False)
    for c0, r0, c1, r1 in regions:
        inside = inside | (F.col("col").between(c0, c1) & F.col("row").between(r0, r1))
    return cells.where(inside)


def parse_region(text: str) -> tuple[int, int, int, int]:
    """A1:B9, or one cell, as (c0, r0, c1, r1) from 1."""
    ends = [re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", p.strip().upper()) for p in text.rsplit("!", 1)[-1].split(":")]
    if not ends or len(ends) > 2 or None in ends:
        raise ValueError(f"not a region: {text!r}")
    at = []
    for m in (ends[0], ends[-1]):
        col = 0
        for ch in m[1]:
            col = col * 26 + ord(ch) - 64
        at.append((col, int(m[2])))
    (a, b), (c, d) = at
    return min(a, c), min(b, d), max(a, c), max(b, d)
