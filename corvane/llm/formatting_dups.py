"""Duplicates hidden by formatting differences (problem 1).

Canonical key: lower case, without white space (zero-width characters included), punctuation and separator marks; where the text is a
list of at least two "label: value" fields, the fields are sorted before they are joined. Letters and digits are kept as they are, so a
full-width or look-alike letter keeps two records apart. The key is hashed with SHA-256 (32 bytes a row go through the shuffle, whatever
the length of the text; a collision is out of reach), except that the marker for "list of fields" is part of the hashed text.

Skew: partial counts (map-side combine) find the keys with more than `hot_rows` rows exactly; there are at most rows / hot_rows of them.
They go to all workers while there are at most `most_hot` of them, and are joined by key beyond that.
Hot keys are salted: minimum and count are formed by (key, salt) and then by key, and their rows get the result by a join with that small
table. All other keys need one shuffle on the key, in which the minimum and the count are window values.

Cases: a null text, and a text whose key is empty (blank, or punctuation only), is no record to compare: it is in no group. Rows repeated
under one id count once. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import broadcast_if_small, cut

# Characters of no width, and the ASCII and full-width symbols that serve as separators.
ZERO_WIDTH = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}]"
SPACE = r"[\s\x{85}\p{Z}]"
MARKS = r"[\s\x{85}\p{Z}\p{Cc}\p{P}$+<=>^`|~＄＋＜-＞＾｀｜～]+"
FIELD = r"(?:^[\p{P}\s]*|[;；,，、/／|｜])\s*(\p{L}[\p{L}\p{M}\p{N} _()（）.-]*?)\s*[:：=＝]"


def canonical_text(text: Column) -> Column:
    """The text that two copies share; null for a null or empty one. JVM expressions only."""
    bare = F.regexp_replace(text, ZERO_WIDTH, "")
    flat = F.regexp_replace(F.regexp_replace(bare, r"[\r\n\t\x{0B}\x{0C}\x{2028}\x{2029}]+", ";"), SPACE, " ")
    # A mark before every "label:" that opens the text or follows a separator; the separator goes with it.
    marked = F.regexp_replace(flat, FIELD, "\u0001$1\u0002")
    strip = lambda c: F.regexp_replace(F.lower(c), MARKS, "")
    pieces = F.split(marked, "\u0001")
    fields = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.concat(strip(F.substring_index(p, "\u0002", 1)), F.lit("\u0002"), strip(F.substring_index(p, "\u0002", -1))))
    is_list = (F.size(pieces) > 2) & (strip(F.element_at(pieces, 1)) == "")
    plain = strip(bare)
    return F.when(plain == "", None).when(is_list, F.array_join(F.array_sort(fields), "\u0001")).otherwise(plain)


def copies(df: DataFrame, id_col: str, text_col: str, hot_rows: int = 100_000, salts: int = 64, most_hot: int = 1_000_000) -> DataFrame:
    """(id, keep_id, n_copies): one row for each id that has a key. n_copies counts the distinct ids of its group, itself included."""
    keyed = df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(canonical_text(F.col(text_col)), 256)).alias("key")).where(F.col("id").isNotNull() & F.col("key").isNotNull())
    keyed = cut(keyed)  # identifiers and 32-byte keys: the texts are read and canonicalised once, not for each of the three uses below
    hot = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"))
    hot = broadcast_if_small(hot, most_hot)

    rest = keyed.join(hot, "key", "left_anti").repartition("key").groupBy("key", "id").agg(F.lit(1).alias("one"))
    by_key = Window.partitionBy("key")
    cold = rest.select("id", F.min("id").over(by_key).alias("keep_id"), F.count(F.lit(1)).over(by_key).alias("n_copies"))

    ids = keyed.join(hot, "key", "left_semi").groupBy("key", "id").agg(F.lit(1).alias("one"))  # by (key, id): spread over all tasks
    salted = ids.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    best = salted.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    best = broadcast_if_small(cut(best), most_hot)
    warm = ids.join(best, "key").select("id", "keep_id", "n_copies")
    return cold.unionByName(warm)


def collapse(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(keep_id, n_copies): one row for each record."""
    return copies(df, id_col, text_col, **kw).where(F.col("id") == F.col("keep_id")).select("keep_id", "n_copies")


def duplicates(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(keep_id, dup_id): one row for every id that is a copy of a smaller one."""
    return copies(df, id_col, text_col, **kw).where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("dup_id"))
