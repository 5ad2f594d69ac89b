"""Labels and shapes that texts carry, as expressions of the JVM: phases, substance names, formats, author lines, tabular look, screen statistics.

Null texts give null or an empty list, as stated; nothing here needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a phase is written in both languages, its numerals; stems of substance names; extensions of the formats.
PHASE = r"(?:[Pp]hase|PHASE)[ -]?(?:IV|III|II|I|[1-4])(?:[ab])?|(?:IV|III|II|I|[1-4]|Ⅳ|Ⅲ|Ⅱ|Ⅰ|一|二|三|四)[ab]? ?期"
NUMERALS = {"IV": "IV", "III": "III", "II": "II", "I": "I", "4": "IV", "3": "III", "2": "II", "1": "I", "Ⅳ": "IV", "Ⅲ": "III", "Ⅱ": "II", "Ⅰ": "I", "四": "IV", "三": "III", "二": "II", "一": "I"}
NUMERAL = "IV|III|II|I|[1-4]|Ⅳ|Ⅲ|Ⅱ|Ⅰ|一|二|三|四"
DRUG = r"[A-Za-z]{3,}(?:mab|nib|tinib|limus|sone|olol|pril|vir|mycin|cillin|azole|statin|gliptin|sartan|dipine|platin|taxel)"
FORMATS = {"docx": "docx", "doc": "docx", "pdf": "pdf", "pptx": "pptx", "xlsx": "xlsx", "csv": "csv", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "epub": "epub", "json": "json", "srt": "srt", "ass": "ass", "tmx": "tmx", "tbx": "tbx"}
MIMES = {"application/pdf": "pdf", "text/html": "html", "text/markdown": "markdown", "text/csv": "csv", "application/json": "json", "application/epub+zip": "epub"}
AUTHOR_LINE = r"^(?:Authors?|By|作者)[:：]? [^.。]{2,}$|^[A-Z][a-z]+ [A-Z][a-z]+(?:, [A-Z][a-z]+ [A-Z][a-z]+)+$"


def chosen(key: Column, table: dict[str, str], otherwise: Column | None) -> Column:
    """A value by its key, as one expression."""
    first = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return first if otherwise is None else F.coalesce(first, otherwise)


# Spellings of the state of a task; what is not among them is degraded.
TASK_STATES = {"pending": "queued", "queued": "queued", "created": "queued", "running": "running", "processing": "running", "in_progress": "running", "done": "completed", "completed": "completed", "success": "completed", "finished": "completed", "failed": "failed", "error": "failed", "cancelled": "cancelled", "canceled": "cancelled", "interrupted": "cancelled"}


def task_state(raw: Column) -> Column:
    return chosen(F.lower(F.trim(raw)), TASK_STATES, F.lit("degraded"))


def phase(label: Column) -> Column:
    """Phase II, Phase IIIb: one label in one spelling."""
    part = F.regexp_extract(label, "[ab](?= ?期|$)", 0)
    return F.concat(F.lit("Phase "), chosen(F.regexp_extract(label, NUMERAL, 0), NUMERALS, F.lit("")), part)


def phases(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PHASE})"), 1), phase))


def phase_sql(x: str) -> str:
    cases = " ".join(f"WHEN \'{k}\' THEN \'{v}\'" for k, v in NUMERALS.items())
    return f"\'Phase \' || CASE regexp_extract({x}, \'{NUMERAL}\') {cases} END || regexp_extract({x}, \'([ab]) ?期|([ab])$\', 1) || regexp_extract({x}, \'([ab])$\', 1)"


def drugs_lost(source: Column, target: Column) -> Column:
    """Substance names of the source that the target does not hold."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(f"({DRUG})"), 1), F.lower))
    return F.filter(names, lambda x: ~F.contains(F.lower(target), x))


def format_of(ext: Column, otherwise: str | None, mime: Column | None = None) -> Column:
    """The format by extension, then by MIME type, then what is said otherwise."""
    by_mime = chosen(mime, MIMES, F.lit(otherwise)) if mime is not None else F.lit(otherwise)
    return chosen(ext, FORMATS, by_mime)


def author_lines(head: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(head, "\n"), lambda x: x.rlike(AUTHOR_LINE))))


def lines_lost(head: Column, target: Column) -> Column:
    """Author lines of a head that the target does not hold word for word."""
    return F.filter(author_lines(head), lambda x: ~F.contains(target, x))


def looks_tabular(text: Column, least: int = 3, share: float = 0.6) -> Column:
    """Whether at least `share` of three lines or more are short and have a digit for every five characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    dense = F.filter(lines, lambda x: (F.length(x) <= 60) & (5 * F.length(F.regexp_replace(x, "[^0-9]", "")) >= F.length(F.replace(x, F.lit(" "), F.lit("")))))
    return (F.size(lines) >= least) & (10 * F.size(dense) >= round(10 * share) * F.size(lines))


def blindness(df: DataFrame, stats: str, most: float = 0.5) -> DataFrame:
    """The frame with extracted, generic and blind from the statistics of a screen, as JSON: too large a share is general, or there were errors or caps."""
    read = F.from_json(stats, "extracted bigint, generic bigint, errors bigint, capped bigint")
    df = df.withColumn("_s", read).withColumns({k: F.coalesce(F.col(f"_s.{k}"), F.lit(0)) for k in ("extracted", "generic", "errors", "capped")}).drop("_s")
    return df.withColumn("blind", (F.col("generic") / F.greatest("extracted", F.lit(1)) > most) | (F.col("errors") > 0) | (F.col("capped") > 0))
