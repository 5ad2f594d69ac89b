"""Noise in text from scanned pages (problem 4).

1. Edge lines. A line is page furniture if it has the form of a page number (with a digit in it, or behind the word "page"), or if it is a
   running header or footer: its template (numbers and document codes masked) comes back within one document in at least `recurs` of the
   documents that have it, which must be so many that the lower bound of that share (Wilson, 95 %) is a half or more. The templates that pass
   are few (they are checked to be at most `most_templates`) and go to all workers, as hashes. Whatever the number of documents, a template is
   also furniture of the document in which it comes back `several` times or more at page edges (two lines or less from a page number or an end
   of the document, or with a page number of its own), or once more at regular distances of a page. Lines of any length count; numbered
   section headings and lines that end a sentence never are furniture; cells of tables are left alone.
2. Hyphen evidence. A word divided over two lines (page matter between them is gone by now) is put together with or without its hyphen,
   whichever form the corpus has more often undivided.
3. Misread words. Every word has an anagram hash (the sum of the fifth powers of its characters), so a confusion of characters is a fixed
   difference of hashes. In SQL, the hashes of rare words plus the differences of the confusions whose wrong characters they hold are joined
   with the hashes of frequent words, and with those less the difference of a second confusion; what meets is verified character by character
   and ranked (fewer confusions, then higher frequency).
4. Misread whole numbers. The hashes of what looks like a number with letters in it are joined with the numbers that stand in the corpus, and
   it is corrected only on evidence: between two digits O, I, l and | are no letters (2O5); any other needs the right number to be more frequent, and letters stand at that place of a number no more often than misreading explains. How often
   a digit is misread is measured inside numbers, where no unit can stand; so 10g or B12 stay where units and codes are in use, as do words in front of "of".

Word counts cover all documents. Counts are combined before the shuffle; corrections go to the texts, which stay where they are, while there are
at most `most_fixes` of them, and are joined by word beyond that. A document of any number of texts is spread over slices of its texts.

Cases: null and blank texts give nothing; texts are read whole; repeated rows count once; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import checked_broadcast_rows, cut

# How characters are misread (as read, as printed), and letters read for digits.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("|", "l"), ("|", "i"), ("3", "e"), ("2", "z"), ("7", "t"), ("4", "a"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("lc", "k"), ("nn", "m"), ("ri", "n"), ("in", "m"), ("ni", "m"), ("iii", "m"), ("tl", "d"), ("h", "li"), ("rm", "nn"), ("m", "nn"), ("m", "in"), ("m", "ni"), ("n", "ri"), ("u", "ii"), ("k", "lc"), ("u", "li"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("l", "t"), ("t", "l"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("g", "q"), ("q", "g"), ("v", "y"), ("y", "v"), ("j", "i"), ("i", "j"), ("r", "n"), ("e", "o"), ("s", "a"),
)
READ_FOR, DIGITS_MEANT = "OoQDlIi|SsBbZzgq", "0000111155862299"
DIGIT_FOR = str.maketrans(READ_FOR, DIGITS_MEANT)
READ = "0-9lOIS|"
SOME_DIGIT = rf"(?=[lOIS|]*[0-9])[{READ}]{{1,5}}"
PAGE_NUMBER = rf"(?i)^[\s\-–—|•·*]*(?:(?:page|第)\s*(?-i:[lOI|]{{1,3}}|{SOME_DIGIT})|(?:p\.|pg\.?)?\s*{SOME_DIGIT})(?:\s*(?:/|of|／|von|sur)\s*[{READ}]{{1,5}})?\s*页?(?:[\s,，]*共\s*[{READ}]{{1,5}}\s*页)?[\s\-–—|•·*]*$"
HEADING = r"^\s*(?:\d+(?:\.\d+)*\.?|[IVX]+\.|第[一二三四五六七八九十\d]+[章节])\s+[^\s|/\-–—\d]"
OWN_PAGE = r"(?i)\b(?:page|pg\.?|p\.)\s*\d+|\d+\s*(?:/|of|／|von|sur)\s*\d+\s*$|第\s*\d+\s*页"
PAGE_LINES = 15  # lines between repeats that make a page, where no page number does
SLICE, HALO = 4096, 16  # texts of a document that one task looks at, and texts beside them that it sees too
CODE = "(?<![A-Za-z0-9_])[A-Z]{1,6}-?[0-9]{2,}(?![A-Za-z0-9_])"
GAPS = "[ \t\r\x0b\x0c]+"
HAN = re.compile("[㐀-鿿，。、；：（）]")
HYPHENS = "-­‐‑¬"
TOKEN = re.compile(r"[A-Za-zÀ-ɏ0-9|]+(?:['’./,\-‐‑][A-Za-zÀ-ɏ0-9|]+)*")
BREAK = re.compile(rf"([A-Za-zÀ-ɏ0-9|]+(?:['’\-‐‑][A-Za-zÀ-ɏ0-9|]+)*)([{HYPHENS}])[ \t]*\n[ \t]*((?:[A-Za-zÀ-ɏ0-9|]+)(?:['’\-‐‑][A-Za-zÀ-ɏ0-9|]+)*)")
NUMBER = rf"^(?=[^0-9]*[0-9])(?=.*[{READ_FOR}])[0-9{READ_FOR}]+$"
BETWEEN = "^[0-9](?:[0-9]|[OIl|](?=[0-9]))*[0-9]$"
ORDINAL = "^[0-9]+(?:st|nd|rd|th|s|er|e|d|x)$"
SHORT_CODE = "^[a-z]{1,3}[0-9]+$|^.{1,2}$"
# What a misread number may be instead: an amount with its unit, or a code.
UNIT = re.compile(r"[0-9]+[gls](?=\s+of\b|\s*[/·*^])|[0-9][bglqsz](?![0-9A-Za-z|]|\s+(?:Jan|Feb|Mar|Apr|May|Ju[nl1]|Aug|Sep|Oct|Nov|Dec))|[BDQSZ][0-9]|[0-9]+[BDQSZ](?=\s+of\b)")
BEGINS, IN_UNIT = 1, 2  # marks of a word: a sentence begins with it; a letter of it stands as a unit or a code does


def template(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), CODE, "§"), "[0-9]+", "#"), GAPS, " ")


def template_hash(line: str) -> int:
    """xxhash64(template(line)) of the same line, in Python for the workers."""
    return xxhash.xxh64_intdigest(TEMPLATE[2].sub(" ", TEMPLATE[1].sub("#", TEMPLATE[0].sub("§", line.strip(" ")))).encode(), 42) - (1 << 63) ^ -(1 << 63)


TEMPLATE = (re.compile(CODE), re.compile("[0-9]+"), re.compile(GAPS))


def candidate(line: Column) -> Column:
    """Whether a line may be a header or footer that is no page number."""
    return line.rlike(r"[\p{L}\p{N}]") & ~line.rlike(r"[.!?。！？;；,，:：]\s*$") & ~line.rlike(HEADING) & ~line.rlike(PAGE_NUMBER)


def counted_templates(rows: DataFrame) -> DataFrame:
    """(doc, template, n): candidate lines of each document by the hash of their template."""
    lines = rows.where(~F.col("in_table")).select("doc", F.explode(F.split("text", r"\n")).alias("line"))
    return lines.where(candidate(F.col("line"))).select("doc", F.xxhash64(template(F.col("line"))).alias("template")).groupBy("doc", "template").agg(F.count(F.lit(1)).alias("n"))


def header_templates(by_doc: DataFrame, recurs: float) -> DataFrame:
    """(template): running headers and footers of the corpus, from counted_templates()."""
    by_all = by_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 1).alias("again"))
    n, p, z2 = F.col("docs"), F.col("again") / F.col("docs"), 1.96**2
    low = (p + z2 / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return by_all.where((p >= recurs) & (low >= 0.5)).select("template")


def document_headers(rows: DataFrame, by_doc: DataFrame, known: DataFrame, recurs: float, several: int = 3) -> DataFrame:
    """(doc, template): running headers and footers that their own document shows, beside the known ones. rows: (key, doc, text, in_table), with
    the place of the text in its document if there is more than one.

    A document is looked at in slices of its places; each slice also sees the HALO places before and behind it, which stand for what is beside
    its first and last lines. Line numbers run on from slice to slice by the sums of their lines.
    """
    repeated = by_doc.where((F.col("n") >= several) & F.col("doc").isNotNull()).join(known, "template", "left_anti").select("doc", "template")
    place = F.coalesce(F.col("place"), F.lit(0).cast("long")) if "place" in rows.columns else F.lit(0).cast("long")
    own = F.floor(F.col("place") / SLICE)
    near = F.pmod("place", F.lit(SLICE))
    texts = rows.where(~F.col("in_table")).join(repeated.select("doc").distinct(), "doc", "left_semi").select("doc", place.alias("place"), "key", "text")
    lines = texts.withColumn("slice", F.explode(F.array_compact(F.array(own, F.when(near < HALO, own - 1), F.when(near >= SLICE - HALO, own + 1))))).select("doc", "place", "key", "slice", F.posexplode(F.split("text", r"\n")).alias("pos", "line"))
    line = F.col("line")
    marked = lines.where(line.rlike(r"\S")).select("doc", "place", "key", "pos", "slice", (F.col("slice") == own).alias("inside"), F.when(candidate(line), F.xxhash64(template(line))).alias("template"), (line.rlike(PAGE_NUMBER) & ~line.rlike(HEADING)).alias("page"), line.rlike(OWN_PAGE).alias("own"))
    w = Window.partitionBy("doc", "slice").orderBy("place", "key", "pos")
    beside = reduce(Column.__or__, [F.lag("page", k, True).over(w) for k in (-2, -1, 1, 2)])
    at = F.sum(F.col("inside").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.select("doc", "slice", "template", "inside", (F.col("own") | beside).alias("edge"), at.alias("at")).where("inside")
    # Within a slice first; then its first and last place, behind all lines of the slices before it, meet those of its neighbours.
    by_template = Window.partitionBy("doc", "slice", "template").orderBy("at")
    gapped = placed.join(repeated, ["doc", "template"], "left_semi").withColumn("gap", F.col("at") - F.lag("at").over(by_template))
    sliced = gapped.groupBy("doc", "slice", "template").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("edges"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    size = placed.groupBy("doc", "slice").agg(F.max("at").alias("size"))
    behind = size.select("doc", "slice", F.coalesce(F.sum("size").over(Window.partitionBy("doc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("behind"))
    across = F.col("behind") + F.col("first") - F.lag(F.col("behind") + F.col("last")).over(Window.partitionBy("doc", "template").orderBy("slice"))
    whole = sliced.join(behind, ["doc", "slice"]).withColumn("across", across).groupBy("doc", "template").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"), F.least(F.min("least"), F.min("across")).alias("least"), F.greatest(F.max("most"), F.max("across")).alias("most"))
    regular = (F.col("n") > several) & (F.col("least") >= PAGE_LINES) & (F.col("most") <= 1.25 * F.col("least"))
    return whole.where((F.col("edges") >= several) & (F.col("edges") >= recurs * F.col("n")) | regular).select("doc", "template")


def is_furniture(line: str, headers: frozenset[int]) -> bool:
    s = line.strip()
    return bool(s) and (PAGE_NUMBER_RE.match(s) is not None and not HEADING_RE.match(s) or template_hash(s) in headers)


HEADING_RE, PAGE_NUMBER_RE, NUMBER_RE = re.compile(HEADING), re.compile(PAGE_NUMBER), re.compile(NUMBER)


def without_furniture(text: str, in_table: bool, headers: frozenset[int]) -> tuple[list[str], str]:
    """(furniture lines, the text without them). Blank lines beside removed ones go too, so that a paragraph goes on over a page break."""
    if in_table:
        return [], text
    lines = text.split("\n")
    flags = [is_furniture(x, headers) for x in lines]
    if not any(flags):
        return [], text
    gone = list(flags)
    for i, x in enumerate(lines):
        if not x.strip() and (i and gone[i - 1] or i + 1 < len(lines) and flags[i + 1]):
            gone[i] = True
    return [x.strip() for x, f in zip(lines, flags) if f], "\n".join(x for x, g in zip(lines, gone) if not g)


def analysis(text: str, in_table: bool, headers: frozenset[int]) -> tuple[list[str], list[dict], list[str], list[int], list[int]]:
    """Furniture, divided words, and the distinct other words with their number and marks."""
    furniture, body = without_furniture(text, in_table, headers)
    breaks = []
    if "\n" in body and (breaks := [{"left": m[1], "hyphen": m[2], "right": m[3], "first": begins(body, m.start())} for m in BREAK.finditer(body)]):
        body = BREAK.sub(" ", body)
    count = Counter(TOKEN.findall(body if body.isascii() else body.replace("‐", "-").replace("‑", "-")))
    marks = dict.fromkeys(count, 0)
    if any(w[0].isdigit() and not w.isdigit() or w[-1].isdigit() and not w.isdigit() for w in count):
        for m in TOKEN.finditer(body):
            w = m[0]
            if w not in marks or w.isalpha() or w.isdigit():
                continue
            if w[0].isdigit() and not w[-1].isdigit() and begins(body, m.start()):
                marks[w] |= BEGINS
            if NUMBER_RE.match(w) and UNIT.match(body, m.start()):
                marks[w] |= IN_UNIT
    return list(dict.fromkeys(furniture)), breaks, list(count), list(count.values()), [marks[w] for w in count]


def begins(text: str, at: int) -> bool:
    i = at - 1
    while i >= 0 and text[i].isspace():
        i -= 1
    return i < 0 or text[i] in ".!?。！？" or text[max(0, at - 2) : at] == "\n\n"


ANALYSIS = T.StructType([
    T.StructField("furniture", T.ArrayType(T.StringType())),
    T.StructField("breaks", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("hyphen", T.StringType()), T.StructField("right", T.StringType()), T.StructField("first", T.BooleanType())]))),
    T.StructField("w", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("marks", T.ArrayType(T.IntegerType())),
])


def cased(word: str, right: str, first: bool) -> str:
    """The right word in the case of the one that was read; a word read with a digit in front takes a capital where a sentence begins."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if word[:1].isupper() or first and not word[:1].isalpha() else right


def explains(word: str, right: str, left: int = 2) -> bool:
    """The word becomes the right one by at most `left` confusions."""
    i = 0
    while i < len(word) and i < len(right) and word[i] == right[i]:
        i += 1
    if i == len(word) == len(right):
        return True
    return left > 0 and any(word.startswith(a, j) and right.startswith(b, j) and explains(word[j + len(a) :], right[j + len(b) :], left - 1) for j in range(max(0, i - 2), i + 1) for a, b in CONFUSIONS)


@F.pandas_udf(T.BooleanType())
def verified(word: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([explains(a, b) for a, b in zip(word, right)], dtype=bool)


@F.pandas_udf(T.StringType())
def in_case(word: pd.Series, right: pd.Series, first: pd.Series) -> pd.Series:
    return pd.Series([cased(*x) for x in zip(word, right, first)], dtype=object)


def anagram_hash(word: Column) -> Column:
    power = lambda c: F.ascii(c).cast("long") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c == "", F.lit(0)).otherwise(power(c)))


def hash_of(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def corrections(vocabulary: DataFrame, frequent: int, ratio: int) -> DataFrame:
    """(word, right): the ranked best correction of each rare word. vocabulary: (word, n), lower case."""
    table = lambda column, of: F.filter(F.array(*[F.struct(F.lit((a, b)[of]).alias("held"), F.lit(hash_of(b) - hash_of(a)).alias("d")) for a, b in CONFUSIONS]), lambda c: F.contains(F.col(column), c["held"]))
    right = vocabulary.where((F.col("n") >= frequent) & F.col("word").rlike("^[a-zà-ɏ]+(?:['’-][a-zà-ɏ]+)*$") & (F.length("word") > 1)).select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram_hash(F.col("word")).alias("h"))
    once = F.struct(F.lit(1).alias("steps"), F.lit(0).cast("long").alias("d"))
    twice = F.transform(F.array_distinct(F.transform(table("right", 1), lambda c: c["d"])), lambda d: F.struct(F.lit(2).alias("steps"), d.alias("d")))
    right = right.select("right", "right_n", "h", F.explode(F.concat(F.array(once), twice)).alias("t")).select("right", "right_n", (F.col("h") - F.col("t.d")).alias("hash"), "t.steps")
    may_be = F.col("word").rlike("[a-z]") & ((F.length("word") > 2) | F.col("word").rlike("[0-9|]") & ~F.col("word").rlike(f"^[0-9{READ_FOR.lower()}]+$")) & ~F.col("word").rlike(r"^[a-z]{1,3}-\d+$") & ~F.col("word").rlike(ORDINAL)
    rare = vocabulary.where(may_be).select("word", "n", anagram_hash(F.col("word")).alias("h"), F.array_distinct(F.transform(table("word", 0), lambda c: c["d"])).alias("c"))
    tried = rare.select("word", "n", "h", F.explode("c").alias("d")).select("word", "n", (F.col("h") + F.col("d")).alias("hash"))
    marked = F.col("word").rlike(r"[0-9|]") & ~F.col("word").rlike(SHORT_CODE) & (F.col("right_n") > F.col("n"))
    met = tried.join(right, "hash").where((F.col("word") != F.col("right")) & ((F.col("right_n") >= ratio * F.col("n")) | marked))
    good = met.where(verified("word", "right"))
    return good.groupBy("word").agg(F.max_by("right", F.struct(-F.col("steps"), F.col("right_n"), F.col("right"))).alias("right"))


def letters_at(word: Column) -> Column:
    """(letter, where) of each letter of a misread number: first, last or inside."""
    place = lambda i: F.when(i == 0, "first").when(i == F.length(word) - 1, "last").otherwise("inside")
    marked = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("letter"), place(i).alias("where")))
    return F.filter(marked, lambda x: ~x["letter"].rlike("[0-9]"))


def trusted_places(numbers: DataFrame, vocabulary: DataFrame) -> set[tuple[str, str]]:
    """(letter, where) at which a letter in a number is a misread digit: letters are no more frequent there than misreading explains. Its rate
    is measured inside numbers of the corpus, and a letter must be seen there for its ends to count."""
    wrong = {(r.letter, r.where): r.n for r in numbers.select("n", F.inline(letters_at(F.col("w")))).groupBy("letter", "where").agg(F.sum("n").alias("n")).collect()}  # 16 letters, 3 places
    pure = vocabulary.where(F.col("word").rlike("^[0-9]{2,}$"))
    digits = F.explode(F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("digit"), F.when(i == 0, "first").when(i == F.length("word") - 1, "last").otherwise("inside").alias("where")))).alias("x")
    right = {(r.digit, r.where): r.n for r in pure.select("n", digits).groupBy("x.digit", "x.where").agg(F.sum("n").alias("n")).collect()}  # 10 digits, 3 places
    inside = {c: wrong.get((c, "inside"), 0) for c in READ_FOR}
    exposed = sum(right.get((d, "inside"), 0) for d in {c.translate(DIGIT_FOR) for c, n in inside.items() if n})
    rate = sum(inside.values()) / max(1, exposed)
    out = {(c, "inside") for c, n in inside.items() if n}
    for (c, where), n in wrong.items():
        expected = rate * right.get((c.translate(DIGIT_FOR), where), 0)
        if where != "inside" and inside[c] and n <= expected + 3 * expected**0.5 + 1:
            out.add((c, where))
    return out


def number_corrections(numbers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, right) of the misread whole numbers. numbers: (w, n), as they are read; vocabulary: (word, n)."""
    trusted = trusted_places(numbers, vocabulary)
    places = F.array(*[F.lit(f"{c} {where}") for c, where in sorted(trusted)]) if trusted else F.array().cast("array<string>")
    meant = numbers.select("w", F.col("n").alias("read_n"), F.translate("w", READ_FOR, DIGITS_MEANT).alias("right")).where(F.forall(letters_at(F.col("w")), lambda x: F.array_contains(places, F.concat_ws(" ", x["letter"], x["where"]))))
    hashed = meant.withColumn("hash", anagram_hash(F.col("right")))
    known = vocabulary.where(F.col("word").rlike("^[0-9]+$")).select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram_hash(F.col("word")).alias("hash"))
    plain = numbers.where(F.col("w").rlike(BETWEEN)).select(F.col("w").alias("word"), F.translate("w", READ_FOR, DIGITS_MEANT).alias("right"))
    return hashed.join(known, ["hash", "right"]).where(F.col("right_n") > F.col("read_n")).select(F.col("w").alias("word"), "right").unionByName(plain).distinct()


def analysed(rows: DataFrame, recurs: float = 0.8, most_templates: int = 200_000) -> DataFrame:
    """rows: (key, doc, text, in_table) -> (key, furniture, breaks, w, n, marks), with its lineage cut."""
    rows = rows.where(F.col("text").rlike(r"\S"))
    by_doc = cut(counted_templates(rows))
    found = frozenset(r.template for r in checked_broadcast_rows(header_templates(by_doc, recurs), most_templates, "the table of running headers"))
    headers = rows.sparkSession.sparkContext.broadcast(found)
    known = rows.sparkSession.createDataFrame([(t,) for t in sorted(found)], "template long")
    own = cut(document_headers(rows, by_doc, known, recurs).groupBy("doc").agg(F.collect_list("template").alias("own")))
    few = own.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0] <= most_templates

    @F.pandas_udf(ANALYSIS)
    def read(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, in_table, own in texts:
            yield pd.DataFrame([analysis(t, bool(i), headers.value if o is None else headers.value.union(o)) for t, i, o in zip(text, in_table, own)], columns=["furniture", "breaks", "w", "n", "marks"])

    return cut(rows.join(F.broadcast(own) if few else own, "doc", "left").select("key", read("text", "in_table", "own").alias("x")).select("key", "x.*"))


def joined(breaks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(left, hyphen, right, word): each divided word as it stands in running text."""
    pairs = breaks.select("left", "hyphen", "right").distinct()
    bare, kept = F.concat("left", "right"), F.concat("left", F.lit("-"), "right")
    v = lambda form, n: vocabulary.select(F.col("word").alias(form), F.col("n").alias(n))
    known = pairs.withColumns({"bare": F.lower(bare), "kept": F.lower(kept)}).join(v("bare", "n_bare"), "bare", "left").join(v("kept", "n_kept"), "kept", "left")
    return known.select("left", "hyphen", "right", F.when(F.coalesce("n_kept", F.lit(0)) > F.coalesce("n_bare", F.lit(0)), kept).otherwise(bare).alias("word"))


def looked_up(analysed: DataFrame, fixes: DataFrame, meant: DataFrame) -> DataFrame:
    """(key, w, found) of the misread words and numbers of each text, by small tables (word, right), without a row for every word."""
    tables = analysed.sparkSession.sparkContext.broadcast(tuple({r.word: r.right for r in t.collect()} for t in (fixes, meant)))

    @F.pandas_udf("array<struct<w string, found string>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words, numbers = tables.value
        for w, marks in batches:
            out = []
            for x, m in zip(w, marks):
                own = [{"w": y, "found": cased(y, words[low], bool(k & BEGINS))} for y, k in zip(x, m) if (low := y.lower()) in words]
                out.append(own + [{"w": y, "found": numbers[y]} for y, k in zip(x, m) if y in numbers and not k & IN_UNIT])
            yield pd.Series(out, dtype=object)

    return analysed.select("key", F.inline(found("w", "marks")))


def repairs(rows: DataFrame, frequent: int = 3, ratio: int = 10, most_fixes: int = 500_000, **kw) -> DataFrame:
    """(key, kind, read, found): kind is furniture, broken or misread; read is the line, the divided word as it stands, or the word as read."""
    a = analysed(rows, **kw)
    words = a.select("key", F.inline(F.arrays_zip("w", "n", "marks")))
    vocabulary = cut(words.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n")))
    numbers = cut(words.where(F.col("w").rlike(NUMBER)).groupBy("w").agg(F.sum("n").alias("n")))
    breaks = a.select("key", F.inline("breaks"))
    whole = breaks.join(joined(breaks, vocabulary), ["left", "hyphen", "right"])
    parts = whole.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    fixes = cut(corrections(vocabulary.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n")), frequent, ratio))
    meant = cut(number_corrections(numbers, vocabulary))
    first = (F.col("marks").bitwiseAND(BEGINS) > 0).alias("first")
    recased = lambda rows, table: rows.withColumn("word", F.lower("w")).join(table, "word").select("key", "w", in_case("w", "right", "first").alias("found"))
    if fixes.count() + meant.count() <= most_fixes:
        single, mended = looked_up(a, fixes, meant), recased(whole.select("key", F.col("word").alias("w"), "first"), F.broadcast(fixes))
    else:
        counted = words.where(F.col("w").rlike(NUMBER) & (F.col("marks").bitwiseAND(IN_UNIT) == 0)).select("key", F.col("w").alias("word")).join(meant, "word").select("key", F.col("word").alias("w"), F.col("right").alias("found"))
        single, mended = recased(words.select("key", "w", first), fixes).unionByName(counted), recased(whole.select("key", F.col("word").alias("w"), "first"), fixes)
    misread = cut(single.unionByName(mended).distinct())  # used twice below: all words are gone through once
    broken = whole.join(misread.select("key", F.col("w").alias("word"), F.col("found").alias("right_word")), ["key", "word"], "left").select("key", F.lit("broken").alias("kind"), F.concat("left", "hyphen", "right").alias("read"), F.coalesce("right_word", "word").alias("found"))
    furniture = a.select("key", F.explode("furniture").alias("found")).select("key", F.lit("furniture").alias("kind"), F.col("found").alias("read"), "found")
    return furniture.unionByName(broken).unionByName(misread.select("key", F.lit("misread").alias("kind"), F.col("w").alias("read"), "found")).distinct()


def rebuilt(text: str, in_table: bool, found: list) -> str:
    """The text in continuous paragraphs."""
    lines = {f["read"] for f in found if f["kind"] == "furniture"}
    breaks = {f["read"]: f["found"] for f in found if f["kind"] == "broken"}
    words = {f["read"]: f["found"] for f in found if f["kind"] == "misread"}
    if not in_table:
        kept = text.split("\n")
        flags = [x.strip() in lines for x in kept]
        text = "\n".join(x for i, x in enumerate(kept) if not flags[i] and (x.strip() or not (i and flags[i - 1] or i + 1 < len(kept) and flags[i + 1])))
    text = BREAK.sub(lambda m: breaks.get(m[1] + m[2] + m[3], m[0]), text)
    text = TOKEN.sub(lambda m: words.get(m[0], m[0]), text)
    paragraphs = [re.sub(r"\s*\n\s*", "" if 3 * len(HAN.findall(p)) > len(p) else " ", p.strip()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(p for p in paragraphs if p)


@F.pandas_udf(T.StringType())
def rebuild(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, in_table, found in texts:
        yield pd.Series([rebuilt(t, bool(i), [] if f is None else list(f)) for t, i, f in zip(text, in_table, found)], dtype=object)


def paragraphs(rows: DataFrame, **kw) -> DataFrame:
    """(key, text): every text with its repairs applied."""
    found = repairs(rows, **kw).groupBy("key").agg(F.collect_list(F.struct("kind", "read", "found")).alias("found"))  # as many as its text has
    return rows.where(F.col("text").isNotNull()).join(found, "key", "left").select("key", rebuild("text", "in_table", "found").alias("text"))
