"""Reference sections, links and atomic spans: parts of a text that processing must leave as they are."""

from __future__ import annotations

import re

# Headings that open a reference section, headings that end one, spans that are kept whole.
REFERENCES = re.compile(r"^\s*(#{1,6}\s*)?(?:\d+\.?\s*)?(references|bibliography|literature cited|works cited|参考文献|引用文献)\s*[:：]?\s*$", re.I)
BREAK = re.compile(r"^\s*(#{1,6}\s*)?(?:\d+\.?\s*)?(appendix|annex|acknowledg(?:e)?ments?|supplementary|附录|致谢|附件).*$", re.I)
ENTRY = re.compile(r"^\s*(?:\[\d+\]|\d{1,3}[.)])\s+\S.*(?:19|20)\d\d")
URI = re.compile(r"!?\[[^\]\n]*\]\([^)\n]+\)|https?://[^\s)>\]，。；]+")
ATOMIC = re.compile(r"\b\d+(?:st|nd|rd|th)\b|\b[A-Z]{2,}(?:-\d+)+\b|\b\d+(?:\.\d+)?\s?(?:mg/kg|mg|mL|kg|µg|%)")
MARK = re.compile(r"⟦([A-Z]+)(\d+)⟧")


def is_reference_entry(line: str) -> bool:
    return ENTRY.match(line) is not None


def reference_ranges(text: str) -> list[tuple[int, int]]:
    """Character ranges of reference sections: from the heading to a heading of its level or above, or one that ends such sections."""
    out, start, level, at = [], None, 0, 0
    for line in text.splitlines(keepends=True):
        hashes = len(m[0]) if (m := re.match(r"\s*#{1,6}", line)) else 0
        hashes = len(m[0].strip()) if m else 0
        if REFERENCES.match(line.rstrip("\n")):
            if start is None:
                start, level = at, hashes
        elif start is not None and (BREAK.match(line.rstrip("\n")) or hashes and (not level or hashes <= level)):
            out.append((start, at))
            start = None
        at += len(line)
    return [*out, (start, at)] if start is not None else out


def masked(text: str, ranges: list[tuple[int, int]], name: str) -> tuple[str, list[str]]:
    """The text with each range as a mark, and what stood there."""
    out, kept, at = [], [], 0
    for a, b in ranges:
        out += [text[at:a], f"⟦{name}{len(kept)}⟧"]
        kept.append(text[a:b])
        at = b
    return "".join((*out, text[at:])), kept


def mask_references(text: str) -> tuple[str, list[str]]:
    return masked(text, reference_ranges(text), "REF")


def mask_uris(text: str) -> tuple[str, list[str]]:
    return masked(text, [m.span() for m in URI.finditer(text)], "URI")


def shield(text: str) -> tuple[str, list[str]]:
    return masked(text, [m.span() for m in ATOMIC.finditer(text)], "ATOM")


def unmasked(text: str, kept: list[str], name: str, strict: bool = True) -> str:
    """The marks replaced by what they stand for. strict: each must be there exactly once."""
    seen = [int(m[2]) for m in MARK.finditer(text) if m[1] == name]
    if strict and sorted(seen) != list(range(len(kept))):
        raise ValueError("a mark is missing or doubled")
    return MARK.sub(lambda m: kept[int(m[2])] if m[1] == name and int(m[2]) < len(kept) else m[0], text)


def without_references(text: str) -> str:
    """The text without its reference sections and without single entries."""
    body = mask_references(text)[0]
    return "\n".join(x for x in re.sub(r"⟦REF\d+⟧", "", body).split("\n") if not is_reference_entry(x))


def whole_uris(values: list[str]) -> list[str]:
    """URIs without those that are a proper prefix of another, and without fragments that have no host."""
    good = sorted({v.rstrip(".,;") for v in values if re.match(r"https?://[^/\s]+\.[^/\s]+", v)})
    return [v for i, v in enumerate(good) if not (i + 1 < len(good) and good[i + 1].startswith(v))]


DOSE_WORDS = {"mg": ("mg", "毫克"), "g": ("g", "克"), "kg": ("kg", "千克", "公斤"), "ml": ("ml", "毫升"), "mcg": ("mcg", "µg", "μg", "微克"), "µg": ("mcg", "µg", "μg", "微克"), "%": ("%", "％"), "iu": ("iu", "国际单位")}


def dose_present(dose: str, text: str) -> bool:
    """Whether a dose stands in a text, in an equal writing: the same number and an equivalent unit."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(\D+?)\s*", dose)
    if not m:
        return dose in text
    units = "|".join(map(re.escape, DOSE_WORDS.get(m[2].lower(), (m[2],))))
    return re.search(rf"(?<![\d.]){re.escape(m[1])}\s*(?:{units})(?![A-Za-z/])", text, re.I) is not None


def schedule_present(code: str, text: str) -> bool:
    """Whether QnW, BID, QD or TID stands in a text, also in Chinese words."""
    words = {"BID": "每日两次|每天两次|一天两次|一日两次", "QD": "每日一次|每天一次|一天一次", "TID": "每日三次|每天三次"}
    if m := re.fullmatch(r"Q(\d+)W", code.upper()):
        numeral = "一二三四五六七八九"[int(m[1]) - 1] if 0 < int(m[1]) < 10 else m[1]
        alt = rf"每\s*(?:{m[1]}|{numeral}{'|两' if m[1] == '2' else ''})\s*(?:个)?(?:周|星期)"
    else:
        alt = words.get(code.upper(), r"(?!)")
    return re.search(rf"\b{re.escape(code)}\b|{alt}", text, re.I) is not None


def term_present(term: str, text: str) -> bool:
    """Whether a term stands in a text, with a plural ending and with or without a space between digit and letter."""
    p = re.sub(r"(?<=\d)\\? ?(?=[A-Za-z])|(?<=[A-Za-z])\\? ?(?=\d)", r"\\s?", re.escape(term.lower()))
    tail = r"(?:s|es)?(?![a-z0-9])" if re.search(r"[a-z]$", term.lower()) else ""
    head = r"(?<![a-z0-9])" if re.match(r"[a-z0-9]", term.lower()) else ""
    return re.search(head + p + tail, text.lower()) is not None
