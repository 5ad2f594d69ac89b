"""Core operators: packed fields, relational operators, dictionary, vectors, fuzzy lookup, readers, streams."""

import io
import json
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import plugins, sections, udfs
from corvane.operators import dictionary, fuzzy, grids, quality, vectors
from corvane.operators import packed_fields as P
from corvane.operators import relational as R
from corvane.sources import readers, writeback, writers
from corvane.streaming import events as S

# ---- 3. packed fields


@pytest.mark.parametrize(("text", "values"), [
    ('HHGR-1|"receptor, Naracimos"', ["HHGR-1", "receptor, Naracimos"]), ('"so-called ""Regapan"""\t“kinase, Regapan”\tSMMT-2', ['so-called "Regapan"', "kinase, Regapan", "SMMT-2"]),
    ("RWCM / / primary Luvo/RW syndrome", ["RWCM", "primary Luvo/RW syndrome"]), ("a 1,3-form, b and/or c；d", ["a 1,3-form", "b and/or c", "d"]), ("x（I/II期，轻度）、y", ["x（I/II期，轻度）", "y"]),
    ("", []), ("  ", []), (" ; ,", []), ("-", ["-"]), ("a\n b ", ["a", "b"]), ('""', []), ('"a" b, c', ['"a" b', "c"]), ('"open, c', ['"open', "c"]), ("(open, c", ["(open", "c"]),
])
def test_packed(text, values):
    got = P.parse(text)
    assert [g["val"] for g in got] == values and [g["pos"] for g in got] == list(range(1, len(values) + 1))


def test_packed_errors_and_null():
    assert P.parse(None) == [] and [g["error"] for g in P.parse('"open, c')] == ["quote", None] and P.parse("(open")[0]["error"] == "bracket"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp", "Cf"), blacklist_characters="“”„「」『』«»＂"), min_size=1, max_size=12), min_size=1, max_size=6), st.sampled_from(["|", ";", "，", "\n", " / "]))
def test_packed_round_trip(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert [g["val"] for g in P.parse(packed)] == values


def test_packed_is_linear():
    assert len(P.parse('"' * 20_001 + "(" * 20_000 + ",a" * 20_000)) > 1


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a (b (c, d); e", ["a (b (c, d)", "e"]), ("x [ (y, z); w", ["x [ (y, z)", "w"]), ("(a, (b, c), d); e", ["(a, (b, c), d)", "e"]), ("f (a [b, c) d, e", ["f (a [b, c) d", "e"]),
        ("( ( (a, b), c); d", ["( ( (a, b), c)", "d"]), ("a ), (b, c)", ["a )", "(b, c)"]), ("“a, “b”x; c", ["“a", "“b”x", "c"]), ("“a, “b”; c", ["a, “b", "c"]), ('"a ""; "b, c"', ['"a ""', "b, c"]),
    ],
)
def test_packed_malformed(text, values):
    assert [g["val"] for g in P.parse(text)] == values


def slow_bracket(text, i):
    """The rule for brackets as it is written, without a memo."""
    j = i + 1
    while j < len(text):
        if text[j] in P.BRACKETS and (k := slow_bracket(text, j)) is not None:
            j = k + 1
        elif text[j] == P.BRACKETS[text[i]]:
            return j
        else:
            j += 1
    return None


@given(st.text(alphabet="a,([{)]}（）", max_size=14))
def test_brackets_follow_the_grammar(text):
    want = {i: k for i, c in enumerate(text) if c in P.BRACKETS and (k := slow_bracket(text, i)) is not None}
    assert P.closed_brackets(text) == want


@given(st.text(alphabet="ab,; \"“”«»(", max_size=14))
def test_failed_quotes_are_remembered_rightly(text):
    class Forgetful(P.Parser):
        def quoted(self, i):
            self.failed = {}
            return super().quoted(i)

    assert P.Parser(text).items() == Forgetful(text).items()


def test_packed_quotes_are_linear():
    assert len(P.parse("“a," * 30_000 + "”x")) == 30_001


def test_packed_frame(spark):
    df = spark.createDataFrame([("r", "a;b"), ("r", "a;b"), ("s", "one"), ("t", None), ("u", " ")], "id string, text string").withColumn("pos", F.lit(9))
    assert sorted(map(tuple, P.values(df, "id", "text", "f", 2).drop("error").collect())) == [("f", "r", 1, "a"), ("f", "r", 2, "b")]
    assert P.values(df.limit(0), "id", "text", "f").count() == 0


# ---- relational operators


def test_best_page_diff(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, None), ("b", 1, 7)], "k string, v int, x int")
    assert sorted((r.k, r.x) for r in R.best_per_key(df, ["k"], [F.col("v").desc(), F.col("x").desc_nulls_last()]).collect()) == [("a", 3), ("b", 7)]
    n = spark.range(100).withColumn("v", F.col("id") % 7)
    seen, after = [], None
    while page := R.keyset_page(n, [("v", False), ("id", True)], after, 9).collect():
        seen += [(r.v, r.id) for r in page]
        after = list(seen[-1])
    assert seen == sorted(((i % 7, i) for i in range(100)), key=lambda t: (-t[0], t[1]))
    old, new = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, p string"), spark.createDataFrame([("b", None), ("c", "4"), ("d", "5")], "k string, p string")
    assert sorted(map(tuple, R.diff(old, new, "k", "p").collect())) == [("a", "removed"), ("c", "changed"), ("d", "added")]


def test_intervals_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), s := rng.randrange(100), s + rng.randrange(9)) for _ in range(60)] + [("x", None, 4)]
    got = sorted((r.k, r.start, r.end) for r in R.merged_intervals(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], "a", "b").collect())
    want = []
    for k in "xy":
        for a, b in sorted((a, b) for kk, a, b in rows if kk == k and a is not None):
            if want and want[-1][0] == k and a <= want[-1][2]:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([k, a, b])
    assert got == sorted(map(tuple, want))
    df = spark.createDataFrame(rows, "k string, a int, b int").withColumn("i", F.monotonically_increasing_id())
    one = sorted(map(tuple, R.merged_intervals(df, ["k"], "a", "b", 1, None, ("i",)).collect()))
    assert one == sorted(map(tuple, R.merged_intervals(df, ["k"], "a", "b", 1, 7, ("i",)).collect()))
    p = df.where("a is not null")
    assert sorted(map(tuple, R.rate(p, ["k"], F.col("a"), 5, F.lit(1)).collect())) == sorted(map(tuple, R.rate(p, ["k"], F.col("a"), 5, F.lit(1), 8).collect()))


def test_state_token_is_order_free(spark):
    a = spark.createDataFrame([("t", "x"), ("t", "y"), ("t", "x"), ("t", None)], "k string, i string")
    b = spark.createDataFrame([("t", "y"), ("t", "x")], "k string, i string")
    c = spark.createDataFrame([("t", "y"), ("t", "z")], "k string, i string")
    token = lambda d: R.state_token(d, ["k"], F.col("i")).first()
    assert token(a) == token(b) != token(c)


# ---- matching


def test_dictionary_scan():
    s = dictionary.Scanner((("binding assay", "1"), ("assay", "2"), ("EGF", "3"), ("术语库", "4")), longest=True, borders=True)
    assert [(h["term"], h["start"]) for h in s("A Binding Assay, the assay; assays egf EGF 查看术语库")] == [("binding assay", 2), ("assay", 21), ("EGF", 39), ("术语库", 45)]
    assert s(None) == [] and s("") == [] and dictionary.Scanner((), True, True)("x") == []


def test_top_k_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, None), (901, []), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in vectors.top_k(df.where("id % 20 = 0 and id < 200"), df.where("id < 200"), 4, block=3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for q in range(0, 200, 20):
        best = sorted(((-cos(rows[q][1], v), i) for i, v in rows[:200] if i != q))[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(3)
    base = ["the quality unit released the lot", "the sponsor rejected the term base", "families asked about the diary"]
    rows = []
    for i in range(90):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s[rng.randrange(len(s))] = rng.choice("abcdef ")
        rows.append((f"{i:02}", "".join(s), rng.choice("pq")))
    rows += [("n", None, "p"), ("e", "", "p")]
    df = spark.createDataFrame(rows, "id string, text string, t string")
    got = {(r.query_id, r.id) for r in fuzzy.lookup(df, df, ["t"], k=1000).collect()}
    want = {(a, b) for a, x, t in rows for b, y, u in rows if x and y and t == u and x != y and SequenceMatcher(None, x, y).ratio() >= 0.85}
    assert got == want


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    got = sorted(map(tuple, quality.near_pairs(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "v string"), "v").collect()))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == [(a, b) for a in words for b in words if a < b and near(a, b)]


def test_quality_rules(spark):
    p = spark.createDataFrame([("1", "Give 5 mg today, not 10%.", "今天给药。"), ("2", "A long enough text here", "A long enough text here"), ("3", "x", None), ("4", None, "y"), ("5", "ok 1", "好 1")], "id string, source string, target string")
    got = {(r.id, r.code) for r in quality.findings(p).collect()}
    assert {("1", "digit_drift"), ("1", "dose_missing"), ("2", "untranslated"), ("3", "empty_target")} <= got and not [g for g in got if g[0] in "45"]
    assert quality.gate(quality.findings(p), ["id"]).where("id = '1'").first().state == "blocked"


# ---- functions


def test_text_functions(spark):
    df = spark.createDataFrame([("  A　b\n C ", "Analyses of the boss's tests"), (None, None)], "a string, b string")
    rows = df.select(X.normalise_source(F.col("a")), X.phrase_key(F.col("b")), X.infer_lang(F.col("a"))).collect()
    assert rows[0][0] == "a b c" and rows[0][1].startswith("analysis of the") and rows[1][0] is None and rows[1][2] == "und"


def test_chunks_and_assembly():
    segments = ["a" * 30, "", "line one\nline two\nline three\n", "é" * 10]
    packed, ranges = udfs.chunks(segments, 60)
    assert all(udfs.json_size(c) <= 60 or len(c) == 1 for c in packed)
    flat = {k: v for c in packed for k, v in c.items()}
    assert udfs.assembled(flat, len(flat), ranges) == segments
    with pytest.raises(ValueError):
        udfs.assembled({}, 2, [])
    assert udfs.chunks([], 10) == ([], [])


def test_numbers_signature_protection():
    assert udfs.numbers("300 mg in 2 million on 5 May 2024") == udfs.numbers("2024年5月，300毫克，2百万")
    assert udfs.signature("see [3] at https://x.y 5 mg") == "CITE|URL|NUM"
    text = "Mail a@b.com, NCT-12345, 3.5% and {{x}} on 2024-05-06"
    guarded, table = udfs.protected(text)
    assert "a@b.com" not in guarded and udfs.restored(guarded, table) == text


def test_sentence_bounds():
    t = "See Fig. 3 and e.g. this. The dose was 1.5 mg. End"
    assert t[slice(*udfs.sentence_at(t, 30, 34))] == "The dose was 1.5 mg."
    assert udfs.distinct_by_containment(["A b", "ab", "abc", None, ""]) == ["abc"]


# ---- sources


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/"), v)
    return b.getvalue()


def zipped_dict(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="w"'


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    (tmp_path / "a.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,Hi, you\nComment: x\n")
    (tmp_path / "a.html").write_text("<p>One <b>two</b></p><script>x</script><div>out<p>in</p></div><img alt='pic'>")
    (tmp_path / "a.json").write_text(json.dumps({"a": ["x", {"b": "y"}], "n": 1}))
    (tmp_path / "a.csv").write_text("k;v\n1;a b\n")
    (tmp_path / "a.tmx").write_text('<tmx><body><tu><tuv xml:lang="en"><seg>A &amp; B</seg></tuv><tuv xml:lang="zh"><seg>甲</seg></tuv></tu></body></tmx>')
    (tmp_path / "bad.tmx").write_text('<!DOCTYPE x [<!ENTITY e "x">]><tmx/>')
    (tmp_path / "a.docx").write_bytes(zipped_dict({"word/document.xml": f"<w:d {W}><w:p><w:r><w:t>Para</w:t></w:r><w:r><w:t>graph</w:t></w:r></w:p><w:p/></w:d>"}))
    (tmp_path / "a.pptx").write_bytes(zipped_dict({"ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>", "ppt/slides/slide1.xml": "<s><p><t>one</t></p></s>"}))
    (tmp_path / "a.xlsx").write_bytes(zipped_dict({"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>Hi</t></si></sst>", "xl/worksheets/sheet1.xml": '<ws><c r="A1" t="s"><v>0</v></c><c r="B2"><v>7</v></c></ws>'}))
    (tmp_path / "a.epub").write_bytes(zipped_dict({"META-INF/container.xml": '<c><rootfile full-path="o/c.opf"/></c>', "o/c.opf": '<p><manifest><item id="x" href="x.xhtml"/></manifest><spine><itemref idref="x"/></spine></p>', "o/x.xhtml": "<p>Chapter</p>"}))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = lambda kind: [(r.text, r.ref) for r in readers.segments(spark, str(tmp_path), kind).orderBy("path", "pos").collect()]
    assert got("srt")[0] == ("Hello\nthere", "00:00:01,000 --> 00:00:02,000") and got("ass") == [("Hi, you", "0:00:01.00-->0:00:02.00")]
    assert [t for t, _ in got("html")] == ["One two", "out", "in", "pic"] and got("json") == [("x", "$.a[0]"), ("y", "$.a[1].b")]
    assert got("csv")[-1] == ("a b", "R2C2") and got("tmx")[0] == ("A & B", "en>zh\t甲") and got("tmx")[1][0] is None
    assert got("docx") == [("Paragraph", "document"), (None, "unreadable: BadZipFile")] and [t for t, _ in got("pptx")] == ["one", "two"]
    assert got("xlsx") == [("Hi", "S!A1"), ("7", "S!B2")] and got("epub") == [("Chapter", "x.xhtml#p")]


def test_markdown_is_lossless():
    text = "# T\n\npara one\nstill\n\n```py\nx\n\ny\n```\n\n$$\na\n\nb\n$$\n\n\n\nend\n"
    blocks = readers.markdown_blocks(text)
    assert "".join(b + s for b, s in blocks) == text and any("x\n\ny" in b for b, _ in blocks)
    small = readers.markdown_blocks(text, 8)
    assert "".join(b + s for b, s in small) == text and all(len(b.encode()) <= 8 for b, _ in small)


def test_regions_and_writers(spark):
    assert readers.parse_region("Sheet!B2:A9") == (1, 2, 2, 9)
    cells = spark.createDataFrame([(1, 2), (3, 3)], "col int, row int")
    assert readers.in_regions(cells, [(1, 1, 2, 9)]).count() == 1 and readers.in_regions(cells, []).count() == 2
    df = spark.createDataFrame([("k", 1, "b"), ("k", 0, "a"), ("k", 2, None)], "k string, pos int, text string")
    assert writers.joined_text(df, "k").first().text == "a\nb\n"
    both = spark.createDataFrame([("s", "t"), ("s", None)], "s string, t string").select(writers.bilingual(F.col("s"), F.col("t"), "append")).collect()
    assert [r[0] for r in both] == ["s\nt", "s"]


# ---- streams


def test_streams(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    assert S.run(S.sessions(S.source(spark, data, "events")), "complete").agg(F.sum("n")).first()[0] == e.count()
    current = e.groupBy("user_id").agg(F.max(F.when(F.col("value") > 50, 2).otherwise(1)).alias("current"))
    stream = S.source(spark, data, "events").withColumn("generation", F.when(F.col("value") > 50, 2).otherwise(1))
    fresh = S.run(S.fenced(stream, current).select("event_id"))
    want = e.withColumn("generation", F.when(F.col("value") > 50, 2).otherwise(1)).join(current, "user_id").where("generation >= current").count()
    assert fresh.count() == want


# ---- grids


def test_grids(spark):
    assert grids.grid_of("|a|b|\n|--|:-:|\n|1|x\\|y|") == [["a", "b"], ["1", "x|y"]] and grids.grid_of("| one |") == []
    assert grids.grid_of("<table><tr><th colspan=2>H</th></tr><tr><td>1</td><td> 2\n3</td></tr></table>") == [["H", ""], ["1", "2 3"]]
    assert grids.wrapped_rows_merged([["a", "x,"], ["", "y"], ["b", "z"]]) == [["a", "x, y"], ["b", "z"]]
    words = spark.createDataFrame([("p", 0.0, 0.0, 10.0, "one"), ("p", 20.0, 1.0, 11.0, "two"), ("p", 0.0, 30.0, 40.0, "three")], "page string, x0 double, y0 double, y1 double, text string")
    assert sorted(map(tuple, grids.text_lines(words, "page").collect())) == [("p", 0, "one two"), ("p", 1, "three")]
    spans = spark.createDataFrame([("p", i, x, x + w) for i, (x, w) in enumerate([(0.0, 4.0), (1.0, 2.0), (3.0, 5.0), (9.0, 1.0), (8.5, 8.0)])], "page string, id int, x0 double, x1 double")
    rows = [tuple(r) for r in spans.select("id", "x0", "x1").collect()]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and min(a[2], b[2]) - max(a[1], b[1]) > 0.35 * min(a[2] - a[1], b[2] - b[1]))
    assert sorted(map(tuple, grids.overlap_pairs(spans, ["page"], "id", 0.35).collect())) == want
    cells = spark.createDataFrame([("t", 0, 0, 0.0, 2.0), ("t", 0, 1, 4.0, 6.0), ("t", 1, 0, 5.0, 6.0), ("t", 1, 1, 1.0, 2.0)], "t string, row int, col int, x0 double, x1 double")
    assert sorted((r.row, r.col, r.wide0, r.wide1) for r in grids.expanded_boxes(cells, ["t"]).where("row = 0").collect()) == [(0, 0, 0.0, 3.0), (0, 1, 3.0, 6.0)]
    assert {(r.row, r.col) for r in grids.order_drift(cells, ["t"]).collect()} == {(1, 0), (1, 1)}
    blocks = spark.createDataFrame([("p", 0.0, 5.0, "b"), ("p", 90.0, 0.0, "c"), ("p", 1.0, 0.0, "a")], "page string, x0 double, y0 double, text string")
    assert [r.text for r in grids.reading_order(blocks, "page", 2).orderBy("place").collect()] == ["a", "b", "c"]
    assert grids.column_centres(spans, ["page"], "x0", "x1", 0.6).count() == 1


# ---- write-back, sections, merge, cascade


def test_write_back():
    assert writeback.json_back({"a": ["x", {"b": "y"}], "n": 1}, ["1", "2"]) == {"a": ["1", {"b": "2"}], "n": 1}
    with pytest.raises(ValueError):
        writeback.json_back(["x"], [])
    page = "<!DOCTYPE html><div>out<p>One <b>two</b></p></div><script>x < y</script><p>A &amp; B</p>"
    texts = [t for t, _ in readers.html_blocks(page)]
    assert writeback.html_back(page, [t.upper() for t in texts]) == "<!DOCTYPE html><div>OUT<p>ONE TWO<b></b></p></div><script>x < y</script><p>A &amp; B</p>"
    docx = zipped_dict({"word/document.xml": f"<w:d {W}><w:p><w:r><w:t>Para</w:t></w:r><w:r><w:t>graph</w:t></w:r></w:p><w:p/></w:d>", "other.bin": "keep"})
    new = writeback.docx_back(docx, ["Absatz"])
    assert list(readers.parse_docx(new)) == [("Absatz", "document")] and zipfile.ZipFile(io.BytesIO(new)).read("other.bin") == b"keep"
    xlsx = zipped_dict({"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/worksheets/sheet1.xml": '<ws><c r="A1"><v>0</v></c><c r="B2"><v>7</v></c></ws>'})
    assert list(readers.parse_xlsx(writeback.xlsx_back(xlsx, {"S!B2": "sieben"}))) == [("0", "S!A1"), ("sieben", "S!B2")]
    with pytest.raises(ValueError):
        writeback.xlsx_back(xlsx, {"S!Z9": "x"})
    rows = [{"Source": "a", "Target": "b", "Forbidden": "x| y"}, {"Source": " ", "Target": None, "Forbidden": ""}]
    assert writeback.imported(rows, "terms") == [{"source": "a", "target": "b", "forbidden": ["x", "y"]}]
    with pytest.raises(ValueError):
        writeback.imported([{"source": "a"}], "terms")


def test_sections():
    text = "# A\nbody https://x.org/a.\n## References\n[1] One 2019.\n### Deep\n[2] Two 2020.\n# Appendix\nend"
    for mask in (sections.mask_references, sections.mask_uris, sections.shield):
        masked, kept = mask(text)
        name = {"mask_references": "REF", "mask_uris": "URI", "shield": "ATOM"}[mask.__name__]
        assert sections.unmasked(masked, kept, name) == text
    assert "Two 2020" not in sections.mask_references(text)[0] and "end" in sections.without_references(text)
    with pytest.raises(ValueError):
        sections.unmasked("no mark", ["x"], "REF")
    assert sections.whole_uris(["https://a.b/c", "https://a.b/cd", "http://", "https://a.b/cd."]) == ["https://a.b/cd"]
    assert sections.dose_present("300 mg", "给予300毫克") and not sections.dose_present("300 mg", "1300毫克") and not sections.dose_present("30 mg", "300 mg")
    assert sections.schedule_present("Q2W", "每2周一次") and sections.schedule_present("Q2W", "每两周") and not sections.schedule_present("Q4W", "每2周")
    assert sections.term_present("IL-13", "the il-13 level") and sections.term_present("assay", "two assays") and not sections.term_present("assay", "assayed")


def test_merge_and_cascade(spark):
    old, new = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 5)], "k string, v string, n int"), spark.createDataFrame([("a", "x"), ("b", "w"), ("c", None), ("d", "q")], "k string, v string")
    assert sorted(map(tuple, R.merge(old, new, ["k"], ["v"], "n").collect())) == [("a", "x", 1), ("b", "w", 3), ("c", "z", 5), ("d", "q", 1)]
    df = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "p string, q string")
    one, two = spark.createDataFrame([("a", "1")], "p string, v string"), spark.createDataFrame([("s", "2")], "q string, v string")
    got = sorted((r.p, r.v, r.confidence) for r in R.cascade(df, [(one, "p", 1.0), (two, "q", 0.9)], "v").collect())
    assert got == [("a", "1", 1.0), ("b", "2", 0.9), ("c", None, None)]


def test_row_alignment_and_components(spark):
    a, b = [["Age", "12.5"], ["Sex", "3"], ["Weight", "70"]], [["Age (y)", "12.5"], ["Weight", "70 kg"]]
    assert grids.aligned_rows(a, b) == [(0, 0), (2, 1)] and grids.row_similarity([], ["x"]) == 0.0
    df = spark.createDataFrame([("p", 1, 0.0, 0.0, 5.0, 0.0), ("p", 2, 5.0, 0.0, 5.0, 9.0), ("p", 3, 50.0, 0.0, 60.0, 0.0)], "page string, id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.id, r.component) for r in grids.components(df, "page", 1.0).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert grids.cell_text([(5, 0, "b"), (0, 0, "a"), (0, 9, "中"), (3, 9.2, "文")], 1) == "a b 中文"


def test_frozen_and_changed(spark):
    n = spark.range(5)
    assert R.frozen(n, [F.col("id")], 5).count() == 5
    with pytest.raises(Exception, match="more than 4"):
        R.frozen(n, [F.col("id")], 4).collect()
    rows = spark.createDataFrame([(1, "en", "a"), (2, "en", "b"), (3, None, None)], "id long, lang string, text string")
    stored = vectors.changed(rows, rows.selectExpr("id", "'' text_hash", "'m' model", "2 dim").limit(0), "m", 2).selectExpr("id", "text_hash", "'m' model", "2 dim")
    assert vectors.changed(rows, stored, "m", 2).count() == 0 and vectors.changed(rows, stored, "m", 3).count() == 3
    assert [r.id for r in vectors.changed(rows.withColumn("text", F.when(F.col("id") == 2, "c").otherwise(F.col("text"))), stored, "m", 2).collect()] == [2]


def test_provider(spark):
    def factory():
        def provider(texts):
            if "b" in texts:
                raise ValueError("no b")
            return [t.upper() for t in texts]

        return provider

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "c", ""])], "id int, text string")
    got = {r.id: (r.answer, r.error) for r in plugins.apply_provider(df, "text", factory, batch=2, tries=1, wait=0, tasks=1).collect()}
    assert got[0] == ("A", None) and got[3] == ("C", None) and got[1][0] is None and "no b" in got[1][1] and got[2] == (None, None)
    assert "signature_of" in plugins.register_all(spark)


def test_distinct_events_of_many_files(spark, tmp_path):
    """More files than three micro-batches take, whose times overlap: late rows count too."""
    from corvane.plans import registry

    rows = spark.range(2400).selectExpr("id % 7 AS user_id", "id AS event_id", "'a' AS event_type", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS int)) AS ts", "1.0D AS value")
    rows.repartition(320).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in registry.QUERIES["stream_dedupe"](spark, str(tmp_path)).collect()]
    assert len(got) == 2400 and {e for _, e in got} == set(range(2400))


def test_number_drift_is_whole(spark):
    f = udfs.register()["number_drift"]
    a, b = (" and ".join(f"{n} units" for n in range(start, start + 45)) for start in (100, 300))
    d = spark.createDataFrame([(a, b)], "a string, b string").select(f("a", "b").alias("d")).first().d
    assert len(d.missing) == len(d.added) == 45
