"""Text functions as Column expressions: all run in the JVM. Null in gives null out unless the docstring says otherwise.

Patterns that a second engine checks avoid look-around and `\\b`, whose meaning differs between regular expression dialects; word borders are
spelled out as character classes instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns, as they must be for equal results.
CJK = "[\u4e00-\u9fff]"
SPACES = r"[\s\p{Z}]+"
DIGIT_TOKEN = r"(?i)n\s*=\s*\d+|\(\d+(?:[.,]\d+)?%?\)|\d+(?:\.\d+)?%|\d+(?:\.\d+)?"
LATIN_RUN = r"(?:[A-Za-z][A-Za-z'-]{2,}[ ,;:]+){5,}[A-Za-z][A-Za-z'-]*"
DOSE = r"(?:^|[^A-Za-z0-9.])(\d+(?:\.\d+)?\s?(?:mg/kg|mg|mL|ml|μg|µg|mcg|kg|IU|%))(?:[^A-Za-z0-9_]|$)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(^|[^A-Za-z0-9])(?:\+?\d{1,3}[-. ])?\(?\d{2,4}\)?[-. ]\d{3,4}[-. ]\d{4}($|[^A-Za-z0-9])"
TITLED_NAME = r"(^|[^A-Za-z])(?:Mr|Ms|Mrs|Dr|Prof)\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
STUDY_ID = r"(?i)(^|[^A-Za-z0-9])(?:PIND|IND|NCT)\s*[:#]?\s*\d+"
ORGANISATION = r"(?i)(^|[^A-Za-z])(?:Inc\.|Ltd\.|LLC|Corp\.|Corporation|University|Hospital|Clinic)"
MOJIBAKE = "[ÃÂ][\\x{80}-\\x{BF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€"
C0 = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
C1 = r"[\x{80}-\x{9F}]"
REPLACEMENT = "\ufffd"
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "zh": "zh", "zh-cn": "zh", "zh_cn": "zh", "cn": "zh", "chinese": "zh", "simplified chinese": "zh", "中文": "zh", "简体中文": "zh"}
JUNK = r"(?i)^(?:page\s*\d+|question\s*\d+|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},\s*\d{4}|\d{1,2}:\d{2}\s*(?:am|pm)|20\d{2}年\d{1,2}月)$"
PRESERVE_CELL = r"(?i)^(?:[-+±]?\d+(?:\.\d+)?%?(?:\s*\([\d\s.,;:%–—+±/≥≤<>=-]*\))?|n\s*=\s*\d+|\(\d+(?:[.,]\d+)?%?\)|\d+/\d+|N/?A|[-–—\s]+)$"
UNIT_ONLY = r"^(?:mg|mL|ml|kg|g|µg|μg|ug|ng|mm|cm|m|w|h|d|IU|U|%|ppm|ng/mL|mg/kg)$"
SOUTH_EAST_AND_MORE = "[\u0400-\u052f\u0600-\u06ff\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"


def normalise_source(text: Column) -> Column:
    """Lower case, white space of any kind folded to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def match_key(text: Column) -> Column:
    """Letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def phrase_key(text: Column) -> Column:
    """Words without case, hyphens and plural endings: -yses to -ysis, -ses to -ss of the stem with s, other -s dropped (not -ss, -is, -us)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\s_/-]+", " ")), " ")
    folded = F.transform(
        words,
        lambda w: F.when(w.endswith("yses") & (F.length(w) > 4), F.concat(F.left(w, F.length(w) - 3), F.lit("sis")))
        .when(w.endswith("ses") & (F.length(w) > 4), F.concat(F.left(w, F.length(w) - 2), F.lit("s")))
        .when(w.endswith("s") & ~w.endswith("ss") & ~w.endswith("is") & ~w.endswith("us") & (F.length(w) > 3), F.left(w, F.length(w) - 1))
        .otherwise(w),
    )
    return F.array_join(F.filter(folded, lambda w: w != ""), " ")


def normalise_lang(lang: Column) -> Column:
    """Language code: known names and spellings to en or zh, others in lower case; null and blank to ''."""
    low = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[low], low)


def infer_lang(text: Column) -> Column:
    """zh where there is a Chinese character, en where there is a Latin letter, else und; null gives und."""
    return F.when(text.rlike(CJK), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("und")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def digit_tokens(text: Column) -> Column:
    """Numbers as written in tables, full-width and superscript digits folded, without inner white space; in order, repeats kept."""
    flat = F.translate(text, "（）％＝⁰¹²³⁴⁵⁶⁷⁸⁹", "()%=0123456789")
    return F.transform(F.regexp_extract_all(flat, F.lit(DIGIT_TOKEN), 0), lambda t: F.regexp_replace(t, r"\s+", ""))


def doses(text: Column) -> Column:
    """Distinct dose literals, lower case, without white space."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOSE), 1), lambda t: F.lower(F.regexp_replace(t, r"\s", ""))))


def redact(text: Column) -> Column:
    """E-mail addresses, telephone numbers, titled names, study identifiers and organisations replaced, in this order."""
    out = F.regexp_replace(text, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, PHONE, "$1[PHONE]$2")
    out = F.regexp_replace(out, TITLED_NAME, "$1[NAME]")
    out = F.regexp_replace(out, STUDY_ID, "$1[ID]")
    return F.regexp_replace(out, ORGANISATION, "$1[ORG]")


# Names of keys, the least length of a value that is a secret behind them, and what it is replaced with.
SECRETS = (("api_key", 4, "[API_KEY_HIDDEN]"), ("[a-zA-Z_]+token[a-zA-Z_]*", 10, "[HIDDEN]"))
BARE_SECRET = (r"\bsk-[\w-]{20,}", "[KEY_HIDDEN]")


def mask_secrets(text: Column) -> Column:
    """What is assigned to a name of a key or token, by : or = and quoted or not, hidden; and keys that show by their form."""
    text = F.regexp_replace(text, BARE_SECRET[0], BARE_SECRET[1])
    for name, least, label in SECRETS:
        text = F.regexp_replace(text, rf"({name})([\"']?\s*[:=]\s*[\"']?)[\w.-]{{{least},}}", f"$1$2{label}")
    return text


def strip_markup(text: Column) -> Column:
    """Tags of inline markup dropped, control characters to spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\x{80}-\x{9F}]", " "), r"(?i)</?\s*(?:span|style|font)[^>]*>", "")


def strip_think(text: Column) -> Column:
    """A leading block of model reasoning dropped."""
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>", "")


def token_estimate(text: Column) -> Column:
    """Whole number of one for each character of a complex script and 0.3 for each other one, plus one; 0 for an empty text."""
    hard = count_of(text, SOUTH_EAST_AND_MORE)
    return F.when(F.length(text) == 0, 0).otherwise((hard * F.lit(1.0) + (F.length(text) - hard) * F.lit(0.3)).cast("int") + 1)


def snippet(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def is_junk_source(text: Column) -> Column:
    """Blank, a page or question number, a date or a time, or a long text of two sentences."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return (s == "") | s.rlike(JUNK) | ((F.length(s) > 120) & s.rlike("[.。].*[.。]"))


def cell_policy(text: Column) -> Column:
    """What to do with a table cell: keep it, guard its numbers, or treat it as text. A blank cell is kept."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return F.when((s == "") | s.rlike(PRESERVE_CELL) | s.rlike(UNIT_ONLY) | s.rlike(r"(?i)^Q\d+W$"), "PRESERVE").when(s.rlike(r"\d|https?://|@"), "PROTECT_TOKENS").otherwise("TRANSLATE")


def compact_cell(text: Column) -> Column:
    """Full-width marks, digits and letters of a cell to ASCII, (n = 30) to (n=30)."""
    wide = "（）％＝＋＜＞−" + "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
    narrow = "()%=+<>-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.regexp_replace(F.translate(text, wide, narrow), r"\(\s*([nN])\s*=\s*(\d+)\s*\)", "($1=$2)")


def json_bytes(text: Column) -> Column:
    """UTF-8 bytes of {"0": text} as compact-key JSON with a space after the colon."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.octet_length(escaped) + 9


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences without regard to case; 0 for an empty part."""
    h, n = F.lower(text), F.lower(part)
    return F.when(F.length(n) == 0, 0).otherwise(((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("int"))


# Words of negation and modality, without look-around; word borders are spelled out.
NEGATION_EN = r"(?i)(?:^|[^A-Za-z])(?:no|not|without|never|neither|nor|none|cannot|unable|absence of|lack of|failed to|negative)(?:[^A-Za-z]|$)|n't"
NEGATION_ZH = "没有|无法|未能|不能|不得|禁止|不应|不可|并非|不是|未见|无效|阴性|不存在|未达|未发现|未观察到|无关|不再|不需要|未经|不含|未发生|未通过|未找到|仍未"
MODALITY = {
    "prohibition": (r"(?i)(?:^|[^A-Za-z])(?:must not|shall not|should not|may not|prohibited|contraindicated|not permitted|not allowed)(?:[^A-Za-z]|$)", "不得|禁止|禁用|不宜|不允许|不建议"),
    "obligation": (r"(?i)(?:^|[^A-Za-z])(?:must|shall|should|required?|requires|needed|necessary)(?:[^A-Za-z]|$)", "必须|应当|应该|须|需"),
    "permission": (r"(?i)(?:^|[^A-Za-z])(?:may|might|can|could|permitted to|allowed to)(?:[^A-Za-z]|$)", "可以|可能|允许|能够"),
}


def has_negation(text: Column) -> Column:
    return text.rlike(NEGATION_EN) | text.rlike(NEGATION_ZH)


def modality(text: Column) -> Column:
    """Classes of modality that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(en) | text.rlike(zh), F.lit(k)) for k, (en, zh) in MODALITY.items()]))


def morphology_stem(norm: Column) -> Column:
    """A normal form without its prefix (anti, non, pre, primary, secondary) and strength suffix."""
    return F.regexp_replace(F.regexp_replace(norm, "-(?:50|75|90)$", ""), "^(?:anti|non|pre|primary|secondary)[- ]", "")


def keeps_case(source: Column, norm: Column) -> Column:
    """Forms of up to three characters, or all in capitals, tell something by their case."""
    return (F.length(norm) <= 3) | source.rlike("^[A-Z0-9-]+$")


def forced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Literal replacements, one after the other."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def entity_kind(name: Column) -> Column:
    """Kind of an organisation by words of its name."""
    low = F.lower(name)
    return F.when(low.rlike("(university|college|大学)"), "university").when(low.rlike("(hospital|clinic|医院)"), "hospital").when(low.rlike(r"(inc\.|ltd\.|gmbh|b\.v\.|公司| ag$)"), "company").when(low.rlike("(institute|laborator|office|研究所|实验室|办公室)"), "institute").otherwise("other")
