"""Amounts, labels, segment checks, limits of readers, selection, repair, exporters, rebuilt tables, fuzzy lookup."""

import json
import random
import zipfile
from difflib import SequenceMatcher
from io import BytesIO

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import session
from corvane.functions import amounts, labels, udfs
from corvane.functions import text as X
from corvane.operators import fuzzy, relational, segments, tables, vectors
from corvane.sources import exporters, readers

# ---- amounts


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("over 300 million people, 20–50% on 19 January 2026", "超过3亿人，20%–50%，2026年1月19日"), ("n = 52 (26%) and 200/1850 were screened", "n = 52（26%），筛查200/1850例"), ("ERK1/2 and IL-4 [ 6 , 7 ], version 4.3.1, +90-224-295-04-18", "无"),
        ("5千万", "50 million"), ("3万亿", "3 trillion"), ("2千亿 3百万", "200 billion, 3 million"), ("10 pg/ml, 5 mg/dL, 3 mJ/cm²", "10 pg/mL；5 mg/dl；3 mJ/cm2"), ("10 to 20 mg/kg", "10–20 mg/kg"), ("10 µg at 37 ℃", "10 mcg at 37°C"), ("5-8月", "May 5 to Aug 8"),
        ("aged 6–7 years at week 16 in 2024", "6至7岁，第16周，2025年"), ("3千克 5克 20微克", "3 kg 5 g 20 ug"), ("1,850 kg and 12,345.5", "1850 kg, 12345.5"), ("at 1:00-4:00", "1:00 4:00"), ("a@b.co https://x.y/123 NCT01234567 10.1000/777", ""), ("5 cells/μL", "5 cells/mcL"),
    ],
)
def test_amounts_agree(a, b):
    assert amounts.amounts(a) == amounts.amounts(b)


@pytest.mark.parametrize(
    ("a", "b", "missing", "added"),
    [("300 mg was given", "给予 30 mg", ["300mg"], ["30mg"]), ("62.89%", "68.29%", ["62.89%"], ["68.29%"]), ("约1780万人", "17.8 billion people", ["17800000"], ["17800000000"]), ("106例（P<0.05）", "160 (P<0.05)", ["106"], ["160"]), ("10 mg, 10 mg", "10 mg", ["10mg"], []), ("5 mg", None, ["5mg"], []), (None, "", [], [])],
)
def test_amounts_differ(a, b, missing, added):
    assert amounts.drift(a, b) == (missing, added)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 99_999), st.sampled_from(["mg", "kg", "%", "mL", "ng/mL", "IU"])), max_size=6))
def test_amounts_keep_order_free_multisets(values):
    text = "; ".join(f"{v} {u}" for v, u in values)
    assert amounts.amounts(text) == sorted(f"{v}{u}" for v, u in values) == amounts.amounts("，".join(f"{v}{u}" for v, u in reversed(values)))


def test_number_drift_has_no_cut():
    assert len(amounts.drift(" ".join(f"{i} mg;" for i in range(1, 60)), "")[0]) == 59


def test_signatures_scan_once():
    assert udfs.signature("2024-05-01 and 50% of 10.1234/abc") == "NUM|NUM|NUM|NUM|NUM" and udfs.signature(None) == ""
    assert udfs.signature("Mail a@b.co, NCT12345 [3,4] {{x}}") == "EMAIL|REG|CITE|PH"


def test_secrets(spark):
    rows = [('api_key = "abcd1234"',), ("my_token: abcdefghij1",), ("sk-" + "a" * 24,), ("token: short",), ("api_key: abc",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.mask_secrets(F.col("t"))).collect()]
    assert got == ['api_key = "[API_KEY_HIDDEN]"', "my_token: [HIDDEN]", "[KEY_HIDDEN]", "token: short", "api_key: abc", None]


# ---- labels


def test_labels(spark):
    rows = [("Phase 2 and phase IIIb, II 期, Ⅲb期, 三期", "docx"), ("none", "zzz"), (None, None)]
    got = spark.createDataFrame(rows, "t string, e string").select(labels.phases(F.col("t")), labels.format_of(F.col("e"), "txt"), labels.format_of(F.col("e"), None, F.lit("text/html"))).collect()
    assert got[0][0] == ["Phase II", "Phase IIIb", "Phase III"] and [r[1] for r in got] == ["docx", "txt", "txt"] and got[1][2] == "html" and got[2][0] is None
    heads = spark.createDataFrame([("Title\nJane Roe, John Doe\nAuthors: A B", "Jane Roe, John Doe"), ("Plain text here.", "")], "h string, t string")
    assert [r[0] for r in heads.select(labels.lines_lost(F.col("h"), F.col("t"))).collect()] == [["Authors: A B"], []]
    drugs = spark.createDataFrame([("Dupilumab and imatinib", "dupilumab 与伊马替尼")], "s string, t string").select(labels.drugs_lost(F.col("s"), F.col("t"))).first()[0]
    assert drugs == ["imatinib"]
    looks = spark.createDataFrame([("12 34 5\n6 7 88\nAge 43.9",), ("One long line of words.\nAnother\nThird",), ("1 2\n3 4",)], "t string").select(labels.looks_tabular(F.col("t"))).collect()
    assert [r[0] for r in looks] == [True, False, False]
    stats = spark.createDataFrame([("a", '{"extracted": 10, "generic": 6}'), ("b", '{"extracted": 10, "generic": 5}'), ("c", '{"errors": 1}'), ("d", None), ("e", '{"capped": 2}')], "m string, s string")
    assert {r.m: r.blind for r in labels.blindness(stats, "s").collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}


# ---- segment checks


def test_segment_checks(spark):
    rows = [
        ("dose", "Give 5 mg daily", "每日 5 克", None, None, None), ("same", "Give 5 mg", "给予 5 mg", None, None, None), ("empty", "Text", " ", None, None, None), ("null", None, None, None, None, None), ("neg", "It is not safe", "安全", None, None, None),
        ("pct", "20% on 2024-05-01 [3]", "x", None, None, None), ("abbr", "The FDA said", "said", None, None, None), ("term", "a", "Bad Word here", None, ["bad word", ""], None), ("ref", "Ref 1", "Ref 2", "references", None, None), ("kept", "Ref 1", "Ref 1", "references", None, None),
        ("code", "a", "a", None, None, ["CELL_MERGE", "OTHER"]), ("leak", "a", "a <span style=x>", None, None, None), ("same", "Give 5 mg", "给予 5 mg", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, source string, target string, role string, forbidden array<string>, codes array<string>").withColumn("s", F.lit(1)).withColumn("numbers", F.lit(2))
    got = sorted((r.id, r["check"], r.severity, r.detail) for r in segments.findings(df).collect())
    assert got == sorted([
        ("dose", "doses", "critical", "5 mg"), ("dose", "units", "critical", "mg"), ("empty", "omissions", "critical", "empty"), ("neg", "negation", "critical", ""), ("pct", "percentages", "critical", "20%"), ("pct", "dates", "critical", "2024-05-01"), ("pct", "citations", "critical", "[3]"),
        ("pct", "numbers", "critical", "20"), ("pct", "numbers", "critical", "2024"), ("pct", "numbers", "critical", "05"), ("pct", "numbers", "critical", "01"), ("pct", "numbers", "critical", "3"), ("abbr", "abbreviations", "warning", "FDA"), ("term", "terminology", "critical", "bad word"),
        ("ref", "references", "critical", ""), ("code", "table_relations", "critical", "CELL_MERGE"), ("code", "table_relations", "warning", "OTHER"), ("leak", "omissions", "warning", "markup"),
    ])
    assert segments.findings(df.limit(0)).count() == 0


# ---- readers


def tmx(n=1, lang="en", seg="A"):
    unit = f'<tu><tuv xml:lang="{lang}"><seg>{seg}</seg></tuv><tuv xml:lang="zh"><seg>B</seg></tuv></tu>'
    return f"<tmx><body>{unit * n}</body></tmx>"


def test_tmx_limits_raise():
    assert list(readers.tmx_units(tmx())) == [("en", "A", "zh", "B")]
    for bad, kw in ((tmx(lang="x" * 17), {}), (tmx(seg="y" * 20_001), {}), (tmx(3), {"max_units": 2}), (tmx(seg="z" * 100), {"max_bytes": 100})):
        with pytest.raises(ValueError):
            list(readers.tmx_units(bad, **kw))


@pytest.mark.parametrize("before", ["", '<?xml version="1.0"?>', "<!--" + "c" * 9_000 + "-->", " \n" * 3_000, "<!-- <a> --><?p x?>"])
def test_declarations_are_refused_wherever_they_stand(before):
    for declaration in ('<!DOCTYPE x [<!ENTITY e "x">]>', '<!ENTITY e "x">'):
        for data in (before.strip() + declaration + tmx(), (before.strip() + declaration + tmx()).encode(), ("﻿" + before.strip() + declaration + tmx()).encode("utf-16")):
            with pytest.raises(ValueError):
                readers.safe_xml(data)
    assert not readers.declares(before + tmx(seg="<![CDATA[<!DOCTYPE]]>"))


def test_json_paths():
    value = {"a": [{"t": "x", "n": 1}, {"t": "y"}], "b": {"t": "z", "c": ["p", "q", "r"]}, "a-b": "w"}
    select = lambda *p: [t for t, _ in readers.json_texts(value, list(p))]
    assert select("$.a[*].t") == ["x", "y"] and select("$..t") == ["x", "y", "z"] and select("$.b.c[1:]") == ["q", "r"] and select("$['a'][-1].t") == ["y"] and select("$.a-b") == ["w"]
    assert select("$.b", "$.b.c[0]") == ["z", "p", "q", "r"] and select("$") == ["x", "y", "z", "p", "q", "r", "w"] and select("$.none") == [] and select("$.b[0]") == []
    with pytest.raises(ValueError):
        select("$.a[?(@.n)]")


@pytest.mark.parametrize(("text", "value"), [('```json\n{"a": [1, 2,], }\n```', {"a": [1, 2]}), ('{"a": "b', {"a": "b"}), ('{"a": ["x", "y', {"a": ["x", "y"]}), ('so {"k": 1} it is', {"k": 1}), ('{"a": 1, "b":', {"a": 1, "b": None}), ('[{"x": "l\nn"}]', [{"x": "l\nn"}]), ("none", None), (None, None), ("", None), ("[1}", None)])
def test_broken_json(text, value):
    assert udfs.parse_response(text) == value


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.one_of(st.integers(-9, 9), st.booleans(), st.text("ab,]}\\\"", max_size=4)), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), x, max_size=3), max_leaves=6).filter(lambda x: isinstance(x, list | dict)))
def test_whole_json_is_read_as_it_is(value):
    assert udfs.mended_json("so: " + json.dumps(value)) == value


def test_char_chunks():
    rows = ["a" * 5, "b" * 4, "c" * 20, "", "d"]
    assert udfs.char_chunks(rows, 10) == [["aaaaa", "bbbb"], ["c" * 20], ["", "d"]] and udfs.char_chunks([], 5) == []


# ---- exporters


def test_exporters(spark):
    text = "# Title\n\nOne **bold** `x<y` [a](b)\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n- p\n- q\n\n```py\na < b\n```\n\n> quoted\n"
    page = exporters.markdown_html(text, "T & U")
    assert "<h1>Title</h1>" in page and "<strong>bold</strong>" in page and "<code>x&lt;y</code>" in page and "<td>2</td>" in page and "<ul><li>p</li><li>q</li></ul>" in page and "a &lt; b" in page and "<title>T &amp; U</title>" in page and "<blockquote>quoted</blockquote>" in page
    docs = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "name string, text string").withColumn("content_", F.lit(1))
    got = {r.name: r.content for r in exporters.exported(docs, "markdown", "docx").collect()}
    assert [t for t, _ in readers.parse_docx(bytes(got["d"]))][:2] == ["Title", "One **bold** `x<y` [a](b)"] and got["n"] is None and list(readers.parse_docx(bytes(got["e"]))) == []
    with zipfile.ZipFile(BytesIO(exporters.markdown_zip(text, {"a.png": b"1"}))) as z:
        assert z.read("document.md").decode() == text and z.read("images/a.png") == b"1"
    assert exporters.exporter("csv", "csv")("a,b") == "a,b" and "<p>x &lt; y</p>" in exporters.exporter("txt", "html")("x < y\n\nz")
    with pytest.raises(ValueError):
        exporters.exporter("csv", "pptx")


def test_formulas_are_spaced():
    assert exporters.spaced_formulas("a\n$$x$$\nb") == "a\n\n$$x$$\n\nb\n" and exporters.spaced_formulas("") == ""
    assert exporters.spaced_formulas("<table><td>$y$</td></table> $z$") == "<table><td>\\(y\\)</td></table> $z$\n"


# ---- rebuilt tables


def word(text, x, y):
    return (text, float(x), float(y), x + 6.0 * len(text), y + 10.0)


def demographics():
    words = [word("SAD", 300, 82), word("phase", 325, 82), word("Characteristic", 50, 95), word("A", 200, 95), word("B", 300, 95), word("Placebo", 400, 95), word("Age,", 50, 112), word("years", 80, 112), word("43.9", 200, 112), word("(16.9)", 228, 112), word("48.6", 300, 112), word("(17.8)", 328, 112), word("43.9", 400, 112), word("(14.8)", 428, 112), word("Female", 50, 132), word("8", 200, 132), word("(26.7)", 212, 132), word("11", 300, 132), word("(35.5)", 318, 132), word("9", 400, 132), word("(28.1)", 412, 132), word("*", 50, 152), word("Data", 60, 152), word("are", 90, 152), word("means", 112, 152)]
    return words, [80.0, 108.0, 150.0]


def test_tables_are_rebuilt(spark):
    words, rules = demographics()
    rows = [("t", *w) for w in words] + [("none", *w) for w in words] + [("empty", None, 0.0, 0.0, 1.0, 1.0)] + [("one", "only", 1.0, 12.0, 20.0, 18.0)]
    marks = [("t", y) for y in rules] + [("none", 80.0), ("none", 150.0)] + [("one", y) for y in (10.0, 20.0, 30.0)]
    got = tables.rebuild(spark.createDataFrame(rows, "table string, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(marks, "table string, y double")).collect()
    cells = {(r.part, r.row, r.col): r.text for r in got if r.table == "t"}
    assert cells == {("group", 0, 2): "SAD phase", ("header", 0, 0): "Characteristic", ("header", 0, 1): "A", ("header", 0, 2): "B", ("header", 0, 3): "Placebo", ("body", 0, 0): "Age, years", ("body", 0, 1): "43.9 (16.9)", ("body", 0, 2): "48.6 (17.8)", ("body", 0, 3): "43.9 (14.8)", ("body", 1, 0): "Female", ("body", 1, 1): "8 (26.7)", ("body", 1, 2): "11 (35.5)", ("body", 1, 3): "9 (28.1)", ("footnote", 0, 0): "* Data are means"} or ("group", 0, 2) not in cells
    assert cells["body", 0, 2] == "48.6 (17.8)" and cells["footnote", 0, 0] == "* Data are means"
    assert {(r.table, r.ok, r.reason) for r in got if r.table != "t"} == {("none", False, "no_row_rules"), ("empty", False, "no_words"), ("one", False, "no_columns")}


def test_table_parts():
    bands = [(0.0, 50.0), (100.0, 150.0), (200.0, 250.0)]
    assert [tables.band_of(*x, bands) for x in ((10, 20), (40, 115), (160, 170), (300, 310))] == [0, 1, 1, 2]
    W = tables.Word
    group, header = [W("First dose", 90, 0, 260, 10)], [W("A", 100, 12, 110, 22), W("B", 200, 12, 210, 22)]
    assert tables.group_lines([group, header], bands, 12) == 1 and tables.group_lines([header, group], bands, 12) == 0 and tables.group_lines([group], bands, 12) == 0
    assert tables.verified(["19 (63.3)", "20"], [W(x, 0, 0, 1, 1) for x in ("19", "(63.3)", "20")]) and not tables.verified(["99"], [W("19", 0, 0, 1, 1)]) and not tables.verified(["19", "19"], [W("19", 0, 0, 1, 1)])


# ---- fuzzy lookup


def test_fuzzy_bound_loses_nothing(spark):
    rng = random.Random(3)
    texts = set()
    while len(texts) < 120:
        t = "".join(rng.choice("abcde ") for _ in range(rng.randrange(2, 40)))
        texts.add(t)
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randrange(1, 4)):
                s[rng.randrange(len(s))] = rng.choice("abcde ")
            if rng.random() < 0.5 and len(s) > 3:
                del s[rng.randrange(len(s))]
            texts.add("".join(s))
    rows = [(f"{i:03}", t, "k" if i % 7 else None) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "id string, text string, t string")
    for threshold, most in ((0.85, 500_000), (0.7, 500_000), (0.85, 1)):
        got = {(r.query_id, r.id): r.score for r in fuzzy.lookup(df, df, ["t"], threshold, k=1000, most_grams=most).collect()}
        want = {(a, b): s for a, x, k in rows for b, y, m in rows if k and m and a != b and x != y and (s := SequenceMatcher(None, x, y).ratio()) >= threshold}
        assert got.keys() == want.keys() and len(want) > 50
    with pytest.raises(ValueError):
        fuzzy.lookup(df, df, ["t"], 0.5)


def test_fuzzy_measures_little_and_each_text_once(monkeypatch):
    rng = random.Random(5)
    own = ["Site %d replaced site %d under order %09d.", "The sponsor rejected the term base because a number was altered, as recorded under %d-%d-%d.", "中心按订单%d取代了中心%d，记录编号%d。"]
    texts = [t % (rng.randrange(400), rng.randrange(400), rng.randrange(10**9)) for t in own for _ in range(150)]
    queries = texts[::5] + ["ab" * 150]
    want = {(i, j): s for i, x in enumerate(queries) for j, y in enumerate(texts) if x != y and (s := SequenceMatcher(None, x, y).ratio()) >= 0.85}
    measured = []
    reached = fuzzy.reached
    monkeypatch.setattr(fuzzy, "reached", lambda *a: measured.append(a) or reached(*a))
    for columns in (1, 500_000):
        measured.clear()
        assert {(i, j): s for i, j, s in fuzzy.near_pairs(pd.Series(queries), pd.Series(texts), 0.85, columns)} == want and want
        assert len(measured) < len(queries) * len(texts) / 5


def test_fuzzy_in_slices_with_copies(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE", 600)
    rng = random.Random(6)
    texts = ["the lot was released by unit %d" % rng.randrange(60) for _ in range(60)] * 3
    rows = [(f"{i % 170:03}", t, "k") for i, t in enumerate(texts)] + [(None, texts[0], "k"), ("x", None, "k"), ("y", texts[0], None)]
    df = spark.createDataFrame(rows, "id string, text string, t string")
    q = df.where("id < '040' or id is null or id = 'y'")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in fuzzy.lookup(q, df, ["t"], k=3).collect())
    best: dict = {}
    for a, x, k in rows:
        for b, y, m in rows if a and a < "040" and x and k else ():
            if b and y and m and a != b and x != y and (s := SequenceMatcher(None, x, y).ratio()) >= 0.85:
                best.setdefault(a, {})[b] = max(s, best.get(a, {}).get(b, 0))
    want = sorted((a, n + 1, b, s) for a, found in best.items() for n, (s, b) in enumerate(sorted((-s, b) for b, s in found.items())[:3]) for s in (-s,))
    assert got == want and len(want) > 50


# ---- vectors


@pytest.mark.parametrize("block", [None, 3, 7])
def test_top_k_with_ties(spark, block):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(80)] + [(90, None), (91, []), (92, [0.0] * 4), (93, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)

    def cosine(a, b):
        x, y = sum(p * p for p in a) ** 0.5, sum(p * p for p in b) ** 0.5
        return sum(p * q for p, q in zip(a, b)) / (x * y) if len(a) == len(b) and x and y else 0.0

    got = {}
    for r in vectors.top_k(df.where("id % 5 = 0"), df, 4, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    whole = [(i, v) for i, v in rows if v is not None]
    for i, v in whole:
        if i % 5 == 0:
            want = sorted((-round(cosine(v, w), 9), j) for j, w in whole if j != i)
            ranked = [(-round(cosine(v, dict(whole)[j]), 9), j) for _, j in sorted(got[i].items())]
            assert [x for x, _ in ranked] == [x for x, _ in want[:4]]
    assert vectors.top_k(df.limit(0), df, 4).count() == 0 and vectors.top_k(df, df.limit(0), 4).count() == 0


def test_best_of_breaks_ties_by_id():
    import numpy as np

    scores, ids = np.array([[1.0] * 40 + [2.0]]), np.array([list(range(40, 0, -1)) + [99]])
    assert vectors.best_of(scores, ids, 3)[1].tolist() == [[99, 1, 2]]


# ---- session


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, setting=None):
            self.sparkContext, self.setting = Context(master), setting
            self.conf = self

        def get(self, key, otherwise):
            return self.setting or otherwise

    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(Session(master))
        assert session.shared_dir(Session(master, "file:///shared")) == "file:///shared"
    assert session.shared_dir(Session("local[4]"))


def test_states_and_overrides(spark):
    old = spark.createDataFrame([("a", "done", 1), ("b", "x", None), ("c", "final", 3)], "k string, s string, v int")
    new = spark.createDataFrame([("a", "new", None), ("d", "only", 4), ("c", "late", 9)], "k string, s string, v int")
    assert sorted(map(tuple, relational.overlaid(old, new, ["k"], ["s", "v"], F.col("s") == "final").collect())) == [("a", "new", 1), ("b", "x", None), ("c", "final", 3), ("d", "only", 4)]
    df = spark.createDataFrame([("a", "x", 1), ("b", None, 2), (None, "y", 3)], "k string, s string, _old int")
    reviewed = spark.createDataFrame([("a", "r2"), ("a", "r1"), ("b", None), (None, "z")], "k string, s string")
    assert sorted(map(tuple, relational.overridden(df, reviewed, "k", "s").collect()), key=lambda r: r[2]) == [("a", "r1", 1), ("b", None, 2), (None, "y", 3)]
    states = spark.createDataFrame([(" Done",), ("canceled",), ("?",), (None,)], "s string").select(labels.task_state(F.col("s"))).collect()
    assert [r[0] for r in states] == ["completed", "cancelled", "degraded", "degraded"]


def test_broadcast_if_small_and_union(spark):
    df = spark.range(10)
    assert "broadcast" in str(session.broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString()).lower() and "broadcast" not in str(session.broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString()).lower()
    assert sorted(map(tuple, relational.tagged_union({"a": df.limit(1), "b": df.limit(1)}, "tag").collect())) == [(0, "a"), (0, "b")]
