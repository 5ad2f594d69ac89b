"""Amounts that a translation must keep, in one spelling, whatever the language writes: values with units, ranges, scales, fractions, times, months.

One scan from left to right with ordered alternatives. What carries digits without a value (addresses, registrations, versions, citations)
comes first and gives nothing. Units are read by their grammar, a prefix before a base and what it is divided by; Chinese scales multiply.
Years, bare values of one or two digits and durations say nothing that both languages write, so they are left out.

Cases: null and empty texts have no amount; the result is sorted and keeps repeats, so two of them compare as multisets.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

# Names of months, words and characters of scale, units in Chinese, and units of time, which protect nothing.
MONTHS = "january february march april may june july august september october november december".split()
SCALE_WORDS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
HAN_SCALES = {"十": 1, "百": 2, "千": 3, "万": 4, "亿": 8}
HAN_UNITS = {"毫克": "mg", "克": "g", "千克": "kg", "微克": "mcg", "毫升": "mL", "个月": "", "月龄": "", "星期": "", "小时": "", "分钟": "", "周": "", "天": "", "岁": ""}
TIME_UNITS = "weeks? wks? days? months? years? yrs? hours? hrs? h minutes? min".split()

VALUE = r"\d+(?:\.\d+)?"
MEASURE = r"(?:(?:mc|[mkunpμ])?g|[md]?l|iu|cm2|cm|mm)"
PER = r"/\s?(?:kg|day|d|dl|ml|mcl|[uμ]l|l|cm2)"
UNIT = rf"%|°c|{MEASURE}(?:{PER})?|m?j/cm2|cells{PER}|{'|'.join(sorted(HAN_UNITS, key=len, reverse=True))}|{'|'.join(TIME_UNITS)}"
REST = "[^\\s　-鿿]"  # of an address; it ends before Chinese
NO_VALUE = rf"""
    [\w.+-]+@[\w-]+(?:\.[\w-]+)+ | (?:https?://|www\.){REST}+ | (?<![\d.])10\.\d{{4,9}}/{REST}+ | \b(?:\d{{4}}-){{3}}\d{{3}}[\dX]\b | \bISSN\s*:?\s*\d{{4}}-\d{{3}}[\dX]
    | (?<![a-z])(?:CRD|NCT|ChiCTR|PROSPERO|IRCT|UMIN|ISRCTN|EudraCT)[-\s]?\w*\d{{4,}}\w* | (?:\+\d{{1,3}}-)?\d{{2,4}}(?:-\d{{2,4}}){{2,}} | (?<![\d.])\d+(?:\.\d+){{2,}} | \[\s*\d+(?:\s*[-–,、]\s*\d+)*\s*\]
"""
NAMES = "|".join(f"{m}|{m[:3]}" + ("t" if m == "september" else "") for m in MONTHS if m != "may").replace("|sept", "|sept|sep")
SCAN = re.compile(
    rf"""(?P<none>{NO_VALUE})
    | (?<!\d)(?P<hour>\d{{1,2}}):(?P<minute>[0-5]\d)(?::[0-5]\d)?(?!\d|\s*%|[–~-]\s*{VALUE}\s*%)
    | \b(?P<name>{NAMES})\b\.? | \b(?P<may>may)\b(?=,?\s+\d) | (?<=\d\s)(?P<may2>may)\b
    | (?<![\d.])0?(?:(?P<from>1[0-2]|[1-9])\s*[-–—~至]\s*0?)?(?P<month>1[0-2]|[1-9])\s*月(?![龄份])
    | (?<![\d.])(?P<scaled>{VALUE})\s*(?:(?P<word>{'|'.join(SCALE_WORDS)})(?![a-z])|(?P<han>[{''.join(HAN_SCALES)}]+)(?!克))
    | (?<![\d.])(?P<part>\d{{2,5}}|\d(?=\s*/\s*\d\d))\s*/\s*(?P<whole>\d{{1,5}})(?![\d.])
    | (?<![\d.])(?P<a>{VALUE})(?:\s*(?:[-–—~至]|to)\s*(?P<b>{VALUE}))?[\s-]*(?P<unit>{UNIT})?(?![a-z0-9])
    """,
    re.I | re.X,
)


THOUSANDS = re.compile(r"(?<![\d.,\[])[1-9]\d{0,2}(?:,\d{3})+(?![\d\]]|,\d)")


def spelled(value: str, zeros: int = 0) -> str:
    x = float(value) * 10**zeros
    return str(round(x)) if x == math.floor(x) or zeros and abs(x - round(x)) < 1e-6 * x else f"{x:.6g}"


def unit_of(unit: str) -> str:
    """The one spelling of a unit; empty for units of time."""
    if unit in HAN_UNITS:
        return HAN_UNITS[unit]
    u = re.sub(r"\s", "", unit.lower())
    if any(re.fullmatch(t, u) for t in TIME_UNITS):
        return ""
    u = re.sub(r"[uμ](?=[gl])", "mc", u).replace("/day", "/d").replace("°c", "degC").replace("iu", "IU")
    return re.sub(r"j(?=/)", "J", re.sub(r"l(?=/|$)(?<!cel)", "L", u))


def amounts(text: str | None) -> list[str]:
    """Every protected amount of a text."""
    found: list[str] = []
    plain = re.sub(r"cm\s*2(?!\d)", "cm2", unicodedata.normalize("NFKC", text or ""))
    for m in SCAN.finditer(THOUSANDS.sub(lambda m: m[0].replace(",", ""), plain)):
        g = m.groupdict()
        if g["none"]:
            continue
        if g["hour"]:
            found.append(f"{int(g['hour'])}:{g['minute']}")
        elif name := g["name"] or g["may"] or g["may2"]:
            found.append(f"month:{[x[:3] for x in MONTHS].index(name[:3].lower()) + 1}")
        elif g["month"]:
            found += [f"month:{int(x)}" for x in (g["from"], g["month"]) if x]
        elif g["scaled"]:
            found.append(spelled(g["scaled"], SCALE_WORDS[g["word"].lower()] if g["word"] else sum(HAN_SCALES[c] for c in g["han"])))
        elif g["part"]:
            found.append(f"{spelled(g['part'])}/{spelled(g['whole'])}")
        else:
            unit = unit_of(g["unit"] or "")
            for value in (g["a"], g["b"]):
                if value and (unit or not re.fullmatch(r"(?:19|20)\d\d", value) and ("." in value or len(value) > 2)):
                    found.append(spelled(value) + unit)
    return sorted(found)


def drift(source: str | None, target: str | None) -> tuple[list[str], list[str]]:
    """Amounts that the target lacks, and those that it has beyond the source."""
    a, b = Counter(amounts(source)), Counter(amounts(target))
    return sorted((a - b).elements()), sorted((b - a).elements())
