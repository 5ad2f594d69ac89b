"""Writers: rows of segments back to files. All write partition by partition; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bilingual(source: Column, target: Column, mode: str = "replace", separator: str = "\n") -> Column:
    """The target alone (`replace`), behind the source (`append`) or before it (`prepend`); a null target keeps the source."""
    both = {"replace": target, "append": F.concat(source, F.lit(separator), target), "prepend": F.concat(target, F.lit(separator), source)}[mode]
    return F.coalesce(both, source)


def joined_text(segments: DataFrame, key: str, separator: str = "\n") -> DataFrame:
    """(key, text): segments (key, pos, text) joined in order. A document is the unit; its segments meet in one row by definition."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return segments.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), separator).alias("text"))


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("errorifexists").csv(path, header=True, sep=delimiter, escape='"')


def append_json(df: DataFrame, path: str) -> None:
    """An append-only ledger of JSON lines."""
    df.write.mode("append").json(path)


def escaped(text: Column) -> Column:
    """XML character data; characters that XML 1.0 does not allow are dropped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.replace(F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tmx_unit(src_lang: Column, source: Column, tgt_lang: Column, target: Column) -> Column:
    """One translation unit as XML."""
    return F.concat(F.lit('<tu><tuv xml:lang="'), escaped(src_lang), F.lit('"><seg>'), escaped(source), F.lit('</seg></tuv><tuv xml:lang="'), escaped(tgt_lang), F.lit('"><seg>'), escaped(target), F.lit("</seg></tuv></tu>"))


TMX_HEAD = '<?xml version="1.0" encoding="UTF-8"?><tmx version="1.4"><header srclang="*all*" datatype="plaintext" segtype="sentence" adminlang="en" o-tmf="rows" creationtool="corvane" creationtoolversion="1"/><body>'
TMX_TAIL = "</body></tmx>"


def tmx_documents(units: DataFrame, per_file: int = 20_000) -> DataFrame:
    """(part, xml): whole TMX documents of at most about `per_file` units. units: (id, src_lang, source, tgt_lang, target)."""
    n = units.count()
    parts = max(1, -(-n // per_file))
    xml = units.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", tmx_unit(F.col("src_lang"), F.col("source"), F.col("tgt_lang"), F.col("target")).alias("tu"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "tu"))), lambda u: u["tu"]), "")
    return xml.groupBy("part").agg(F.concat(F.lit(TMX_HEAD), body, F.lit(TMX_TAIL)).alias("xml"))


def srt_block(number: Column, span: Column, text: Column) -> Column:
    return F.concat_ws("\n", number.cast("string"), span, text, F.lit(""))


def tbx_entry(concept_id: Column, src_lang: Column, source: Column, tgt_lang: Column, target: Column) -> Column:
    return F.concat(F.lit('<termEntry id="'), escaped(concept_id), F.lit('"><langSet xml:lang="'), src_lang, F.lit('"><tig><term>'), escaped(source), F.lit('</term></tig></langSet><langSet xml:lang="'), tgt_lang, F.lit('"><tig><term>'), escaped(target), F.lit("</term></tig></langSet></termEntry>"))
