"""Writing translated segments back into the files they came from. Each takes the bytes or text of one file and the new segments in the
order in which the reader gives them; a different number of segments is an error, so nothing is ever put in the wrong place."""

from __future__ import annotations

import html as H
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from corvane.sources.readers import BLOCKS, SKIPPED, local, safe_xml


def check(have: int, want: int) -> None:
    if have != want:
        raise ValueError(f"{want} segments expected, {have} given")


def json_back(value, texts: list[str]):
    """The JSON value with its string leaves replaced in reading order."""
    left = iter(texts)
    n = 0

    def walk(node):
        nonlocal n
        if isinstance(node, str):
            n += 1
            return next(left, node)
        if isinstance(node, dict):
            return {k: walk(v) for k, v in node.items()}
        return [walk(v) for v in node] if isinstance(node, list) else node

    out = walk(value)
    check(len(texts), n)
    return out


class Rewriter(HTMLParser):
    """The page as it was, with the text of each block put at its first piece of text and its other pieces dropped."""

    def __init__(self, texts: list[str]):
        super().__init__(convert_charrefs=True)
        self.texts, self.used, self.out, self.stack, self.skip = texts, 0, [], [], 0

    def finish(self):
        block = self.stack[-1]
        if block[1]:
            self.used += 1
            new = self.texts[block[2]] if block[2] < len(self.texts) else ""
            self.out[block[1][0]] = H.escape(new, quote=False)
            for i in block[1][1:]:
                self.out[i] = ""
            self.stack[-1] = [block[0], [], None]

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS and not self.skip:
            if self.stack:
                self.finish()
            self.stack.append([tag, [], None])
        self.out.append(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS and any(b[0] == tag for b in self.stack):
            while self.stack:
                self.finish()
                if self.stack.pop()[0] == tag:
                    break
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.stack and not self.skip and data.strip():
            block = self.stack[-1]
            if block[2] is None:
                block[2] = self.used
            block[1].append(len(self.out))
            self.out.append(data)
        else:
            self.out.append(data if self.skip else H.escape(data, quote=False))

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")


def html_back(page: str, texts: list[str]) -> str:
    """Blocks with text, in the order in which they end, get the new texts; tags inside a block keep their place."""
    r = Rewriter(texts)
    r.feed(page)
    r.close()
    while r.stack:
        r.finish()
        r.stack.pop()
    check(len(texts), r.used)
    return "".join(r.out)


def repacked(data: bytes, parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            new.writestr(item, parts.get(item.filename, old.read(item.filename)))
    return out.getvalue()


def paragraphs_back(data: bytes, names: list[str], texts: list[str]) -> bytes:
    """New texts for the paragraphs of Office parts: the first run takes the text, the others become empty, formats stay."""
    left, n, parts = iter(texts), 0, {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in names:
            root = safe_xml(z.read(name))
            for p in root.iter():
                runs = [t for t in p.iter() if local(t.tag) == "t"] if local(p.tag) == "p" else []
                if "".join(t.text or "" for t in runs).strip():
                    n += 1
                    runs[0].text = next(left, runs[0].text)
                    for t in runs[1:]:
                        t.text = ""
            parts[name] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    check(len(texts), n)
    return repacked(data, parts)


def docx_back(data: bytes, texts: list[str]) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [x for x in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", x)]
    return paragraphs_back(data, sorted(names, key=lambda x: (x != "word/document.xml", x)), texts)


def pptx_back(data: bytes, texts: list[str]) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)]
    return paragraphs_back(data, sorted(names, key=lambda x: int(re.findall(r"\d+", x)[-1])), texts)


def xlsx_back(data: bytes, cells: dict[str, str]) -> bytes:
    """New texts for cells named as the reader names them, Sheet!A1; they become inline strings. A name that is not there is an error."""
    parts, done = {}, set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = {r.get("Id"): r.get("Target") for r in safe_xml(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (s for s in safe_xml(z.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"):
            target = (rels.get(next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)) or "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            root = safe_xml(z.read(path))
            for cell in (x for x in root.iter() if local(x.tag) == "c"):
                name = f"{sheet.get('name')}!{cell.get('r')}"
                if name in cells:
                    space = cell.tag[: -len("c")]
                    for child in list(cell):
                        cell.remove(child)
                    cell.set("t", "inlineStr")
                    ET.SubElement(ET.SubElement(cell, f"{space}is"), f"{space}t").text = cells[name]
                    done.add(name)
            parts[path] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    check(len(done), len(cells))
    return repacked(data, parts)


def imported(rows: list[dict[str, str]], kind: str, most: int = 20_000) -> list[dict]:
    """Rows of an asset file by their kind: header names in lower case, blank rows dropped, what the kind needs present. `forbidden` divides at '|'."""
    need = {"terms": ("source", "target"), "rules": ("trigger", "severity"), "style": ("name", "value")}[kind]
    out = []
    for r in rows:
        low = {(k or "").strip().lower(): (v or "").strip() for k, v in r.items()}
        if any(low.values()):
            if lacking := [n for n in need if not low.get(n)]:
                raise ValueError(f"row {len(out) + 1} lacks {', '.join(lacking)}")
            if "forbidden" in low:
                low["forbidden"] = [x.strip() for x in low["forbidden"].split("|") if x.strip()]
            out.append(low)
            if len(out) > most:
                raise ValueError(f"more than {most} rows")
    return out


def json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False)
