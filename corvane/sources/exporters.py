"""Documents written in another form: Markdown to HTML, DOCX and an archive, other texts to HTML, and as they are.

Every exporter is a function of one document's bytes or text; `exported` runs it over rows (name, content) in Arrow batches, so documents are
written where they lie and nothing is collected. Cases: null content gives null; an empty document gives an empty page; markup in texts is escaped.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.grids import pipe_rows
from corvane.sources.readers import markdown_blocks

PAGE = '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{}</title></head><body>\n{}\n</body></html>\n'
INLINE = ((r"`([^`]+)`", r"<code>\1</code>"), (r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", r'<img alt="\1" src="\2">'), (r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", r'<a href="\2">\1</a>'), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"(?<!\*)\*([^*\s][^*]*)\*", r"<em>\1</em>"))
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, form in INLINE:
        out = re.sub(pattern, form, out)
    return out


def block_html(block: str) -> str:
    """One block of Markdown."""
    if m := re.fullmatch(r"(`{3,}|~{3,})(\w*)[^\n]*\n(.*?)\n?\1\s*", block, re.S):
        return f'<pre><code class="{m[2]}">{html.escape(m[3], quote=False)}</code></pre>'
    if re.match(r"\s*<(?:table|div|p|ul|ol|img)\b", block) or block.lstrip().startswith("$$"):
        return block.strip()
    if m := re.fullmatch(r"\s*(#{1,6})\s+(.*?)\s*#*\s*", block):
        return f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>"
    lines = block.strip().split("\n")
    if len(lines) > 1 and all(x.strip().startswith("|") for x in lines):
        head, *rest = pipe_rows(block)
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in cells) + "</tr>"
        return "<table>" + row(head, "th") + "".join(row(r, "td") for r in rest) + "</table>"
    for mark, tag in ((r"\s*[-*+]\s+", "ul"), (r"\s*\d+[.)]\s+", "ol")):
        if all(re.match(mark, x) for x in lines):
            return f"<{tag}>" + "".join(f"<li>{inline(re.sub(mark, '', x, count=1))}</li>" for x in lines) + f"</{tag}>"
    if all(x.startswith(">") for x in lines):
        return "<blockquote>" + inline("\n".join(x.lstrip("> ") for x in lines)) + "</blockquote>"
    return f"<p>{inline(block.strip())}</p>"


def markdown_html(text: str, title: str = "") -> str:
    return PAGE.format(html.escape(title), "\n".join(block_html(b) for b, _ in markdown_blocks(spaced_formulas(text)) if b.strip()))


def plain_html(text: str, title: str = "") -> str:
    """A plain text, paragraph by paragraph."""
    return PAGE.format(html.escape(title), "\n".join(f"<p>{html.escape(p, quote=False)}</p>" for p in re.split(r"\n\s*\n", text) if p.strip()))


def spaced_formulas(text: str) -> str:
    """Blank lines around $$ blocks, and $ formulas inside HTML tables as \\( \\), so that a renderer knows them."""
    text = re.sub(r"<table.*?</table>", lambda m: re.sub(r"\$([^$\n]+)\$", r"\\(\1\\)", m[0]), text, flags=re.S)
    text = re.sub(r"\n*(\$\$.*?\$\$)\n*", r"\n\n\1\n\n", text, flags=re.S).strip("\n")
    return re.sub(r"\n[ \t]*\n\s*\n", "\n\n", text) + "\n" if text else ""


def zipped(parts: dict[str, str | bytes]) -> bytes:
    """An archive with the same bytes in every run."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def markdown_docx(text: str) -> bytes:
    """Paragraphs, with headings in their styles and rows of pipe tables with tabs between the cells."""

    def paragraph(x: str, style: str = "") -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{html.escape(x, quote=False)}</w:t></w:r></w:p>'

    body = []
    for block, _ in markdown_blocks(text):
        if m := re.fullmatch(r"\s*(#{1,6})\s+(.*?)\s*", block):
            body.append(paragraph(m[2], f"Heading{len(m[1])}"))
        elif block.strip():
            body += [paragraph("\t".join(r)) for r in pipe_rows(block)] or [paragraph(re.sub(r"\s*\n\s*", " ", block.strip()))]
    return zipped({"[Content_Types].xml": TYPES, "_rels/.rels": RELATIONS, "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>'})


def markdown_zip(text: str, images: dict[str, bytes] | None = None) -> bytes:
    return zipped({"document.md": text, **{f"images/{k}": v for k, v in sorted((images or {}).items())}})


EXPORTERS: dict[tuple[str, str], Callable[[str], str | bytes]] = {
    ("markdown", "html"): markdown_html, ("markdown", "docx"): markdown_docx, ("markdown", "zip"): markdown_zip,
    **{(kind, "html"): plain_html for kind in ("txt", "srt", "ass", "json", "docx", "pptx", "epub")},
}


def exporter(kind: str, form: str) -> Callable[[str], str | bytes]:
    """The exporter of a kind of document to a form; the same form is written as it is, an unknown pair raises."""
    if kind == form:
        return lambda text: text
    if (kind, form) not in EXPORTERS:
        raise ValueError(f"{kind} cannot be written as {form}")
    return EXPORTERS[kind, form]


def exported(docs: DataFrame, kind: str, form: str, column: str = "text") -> DataFrame:
    """The frame with `content`, the bytes of each document in its new form."""
    write = exporter(kind, form)

    @F.pandas_udf(T.BinaryType())
    def content(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: None if x is None else x if isinstance(x := write(x), bytes) else x.encode())

    return docs.withColumn("content", content(column))
