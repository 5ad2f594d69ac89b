"""Operators of the llm subpackage on small fixtures: edge cases, brute force, exact round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import alignment, canonical_list, formatting_dups, garbled, leakage, lookalikes, mixture, piece_codes, scanned, sentences, subjects

# ---- 1. formatting duplicates


def brute_key(t):
    if t is None:
        return None
    s = re.sub(r"[\W_]+", "", t.lower())
    return s or None


def units(spark, rows):
    return spark.createDataFrame(rows, "id string, source_text string, key string, n long")  # key and n clash with names used inside


def test_formatting_copies(spark):
    rows = [("b", "Hello, World!", "x", 1), ("a", "hello world", "x", 1), ("c", None, "x", 1), ("d", "  ", "x", 1), ("e", "...", "x", 1), ("a", "hello world", "x", 1), ("f", "héllo world", "x", 1), ("g", "HELLO​WORLD", "x", 1)]
    assert sorted(map(tuple, formatting_dups.duplicates(units(spark, rows), "id", "source_text").collect())) == [("a", "b"), ("a", "g")]
    assert sorted(map(tuple, formatting_dups.collapse(units(spark, rows), "id", "source_text").collect())) == [("a", 3), ("f", 1)]


def test_field_order_and_widths(spark):
    rows = [("1", "Dose: 5 mg; Arm: open label; Kit: 12-3", "", 0), ("2", "Kit = 12-3 / Dose = 5 mg / Arm = open label", "", 0), ("3", "Arm：open label\nKit：12-3\nDose：5 mg", "", 0), ("4", "Dose: 12-3; Arm: open label; Kit: 5 mg", "", 0), ("5", "Ｄose: 5 mg; Arm: open label; Kit: 12-3", "", 0), ("6", "Note: one: two", "", 0), ("7", "two one Note", "", 0)]
    assert sorted(map(tuple, formatting_dups.duplicates(units(spark, rows), "id", "source_text").collect())) == [("1", "2"), ("1", "3")]


def test_hot_keys_equal_cold_ones(spark):
    rng = random.Random(1)
    rows = [(f"{i:04}", rng.choice(["A b", "a-B", "c"]) if i % 3 else f"text {i % 40}!", "", 0) for i in range(600)]
    a = sorted(map(tuple, formatting_dups.copies(units(spark, rows), "id", "source_text", hot_rows=20, salts=4).collect()))
    b = sorted(map(tuple, formatting_dups.copies(units(spark, rows), "id", "source_text").collect()))
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(brute_key(t), []).append(i)
    assert a == b == sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def test_hot_key_beyond_the_default(spark):
    """A third of the rows and more than hot_rows of them have one key."""
    n = 330_000
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("The SAME text"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")), F.lit("!"))).otherwise(F.concat(F.lit("text "), F.floor(F.col("id") / 2).cast("string")))
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("id"), text.alias("source_text"))
    for most in (1_000_000, 0):
        got = formatting_dups.copies(df, "id", "source_text", most_hot=most)
        hot = got.where("keep_id = '0000000'").agg(F.count("*").alias("n"), F.min("n_copies").alias("lo"), F.max("n_copies").alias("hi")).first()
        assert tuple(hot) == (n // 3,) * 3 and got.count() == n


def test_labels_of_any_length(spark):
    label = "a label that says at great length what stands behind it and goes on " * 3
    rows = [("1", f"Dose: 5 mg; {label}: x", "", 0), ("2", f"{label.upper()}: x / Dose: 5 mg", "", 0), ("3", f"{label}: 5 mg; Dose: x", "", 0)]
    assert sorted(map(tuple, formatting_dups.duplicates(units(spark, rows), "id", "source_text").collect())) == [("1", "2")]


def test_formatting_empty_and_long(spark):
    assert formatting_dups.duplicates(units(spark, []), "id", "source_text").count() == 0
    long = "word, " * 50_000
    assert formatting_dups.duplicates(units(spark, [("a", long, "", 0), ("b", long.upper(), "", 0)]), "id", "source_text").count() == 1


# ---- 2. look-alikes


def test_one_form():
    t = lookalikes.transducer()
    assert t("Ｂａｄｏ　Ｈｏｓｐｉｔａｌ") == "Bado Hospital"
    assert t("Reѕearch GmbН") == "Research GmbH" and t("Scientiﬁc") == "Scientific" and t("⽣物") == "生物"
    assert t("é") == "é" and t("a​b­c") == "abc"
    assert t("x² Á a\tb\n-") == "x² Á a\tb\n-"  # what a reader sees stays
    assert t(None) is None and t("") == ""


def test_compatibility_letters(spark):
    t = lookalikes.transducer()
    assert t("5 \u00b5g") == t("5 \u03bcg") == "5 \u03bcg" and t("\u2206") == t("\u0394") and t("\u2162 \u217b \u2163") == "III xii IV"
    assert t("\U0001d400\u210e\U0001d7d9") == "Ah1" and t("\u01c6 \u0132") == "d\u017e IJ"
    assert all(t(x) == x for x in ("x\u00b2", "H\u2082O", "\u00bd", "\u00aa", "\u017f", "\u03d1", "\u3131\u314f", "\u2122"))
    df = spark.createDataFrame([("a", "5 \u00b5g"), ("b", "5 \u03bcg"), ("c", "5 mg")], "id string, text string")
    assert [tuple(r) for r in lookalikes.pairs(df, "id", "text", "x").collect()] == [("x", "a", "b")]


@pytest.mark.parametrize(
    ("other", "latin"),
    [
        ("Ꭺꮯ", None), ("ꓐꓮꓣ", "BAR"), ("Ꮯꭺ", None), ("ᎪᎷ", "AM"), ("Սոօհ", "Unoh"), ("ᴠᴏᴡᴄ", "vowc"), ("𝐁𝑎𝓭", "Bad"), ("ⲠⲞ", None), ("ⲢⲞⲥ", "POc"), ("𐐄𐐬", "Oo"), ("ⅬⅩ", "LX"), ("ⅼ", "l"), ("Βοａｔ", "Boat"), ("Нор", "Hop"),
        ("37 ℃", "37 °C"), ("37 ˚C", "37 °C"), ("37 ºF", "37 °F"), ("˚ C", "˚ C"), ("Aº", "Aº"), ("力カ二ニ", "力力二二"), ("e\u0301 \u212b", "é Å"), ("ﬁⅡ", "fiII"),
    ],
)
def test_ten_scripts(other, latin):
    t = lookalikes.transducer()
    assert t(t(other)) == t(other)
    if latin:
        assert t(other) == t(latin) == latin


def test_longest_match_over_clusters():
    t = lookalikes.Transducer(lookalikes.compile_mapping({"a": "x", "ab": "y", "abc": "z", "e\u0301f": "w"}))
    assert [t(s + "é") for s in ("abc", "ab", "abd", "aa", "cab", "e\u0301f", "éf")] == ["zé", "yé", "ydé", "xxé", "cyé", "wé", "wé"]
    assert any(len(k) > 1 for k in lookalikes.SEQUENCES)


def test_classes(spark):
    rows = [("a", "Bado"), ("b", "Ｂａｄｏ"), ("c", "Bado"), ("c", "Bado"), ("d", None), ("e", " "), ("f", "bado"), ("g", "Bаdo"), (None, "Ｂado")]
    df = spark.createDataFrame(rows, "entry_id string, source string").withColumn("form", F.lit(1)).withColumn("class_id", F.lit(2))
    got = sorted(map(tuple, lookalikes.classes(df, "entry_id", "source", "x").collect()))
    assert got == [("x", "a", "a", "a"), ("x", "b", "a", "b"), ("x", "c", "a", "a"), ("x", "g", "a", "g")]
    pairs = {(r.id_a, r.id_b) for r in lookalikes.pairs(df, "entry_id", "source", "x").collect()}
    assert pairs == {(p[1], q[1]) for p in got for q in got if p[1] < q[1] and p[2] == q[2] and p[3] != q[3]}
    assert lookalikes.classes(df.limit(0), "entry_id", "source", "x").count() == 0


def test_mapping_is_checked():
    with pytest.raises(ValueError):
        lookalikes.compile_mapping({"a": "b"}, {"a": "c"})
    with pytest.raises(ValueError):
        lookalikes.compile_mapping({"a": "b", "b": "a"})
    table = lookalikes.compile_mapping(lookalikes.rule_mapping(), lookalikes.LOOK_ALIKE)
    assert all(c not in table for v in table.values() for c in v)


def test_idempotent_on_any_text():
    t, rng = lookalikes.transducer(), random.Random(3)
    for _ in range(300):
        s = "".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x2000, 0x3100), rng.randrange(0xFF00, 0xFFEF)])) for _ in range(20))
        assert t(t(s)) == t(s)


def test_pairs(spark):
    rows = [("a", "Bado"), ("b", "Ｂａｄｏ"), ("c", "Bado"), ("c", "Bado"), ("d", None), ("e", " "), ("f", "bado"), (None, "Ｂado")]
    df = spark.createDataFrame(rows, "entry_id string, source string").withColumn("form", F.lit(1)).withColumn("raw", F.lit(2))
    got = sorted(map(tuple, lookalikes.pairs(df, "entry_id", "source", "x").collect()))
    assert got == [("x", "a", "b"), ("x", "b", "c")]
    assert lookalikes.pairs(df.limit(0), "entry_id", "source", "x").count() == 0


# ---- 4. scanned text


def test_scanned(spark):
    prose = "The sponsor approved the budget before the screening visit without further comment."
    rows = [(f"d{i}", f"d{i}", f"Protocol AB-{100 + i}   Confidential\n{prose}\n- {i} -\nProtocol AB-{100 + i}   Confidential\n{prose}\n- {i + 1} -", False) for i in range(12)]
    rows += [("x", "x", "The spon-\nsor appr0ved a well-\ntolerated budget of 2O5 anci vvithout comment. well-tolerated well-tolerated", False), ("t", "t", "12", True), ("n", "n", None, False), ("b", "b", "  ", False)]
    df = spark.createDataFrame(rows, "key string, doc string, text string, in_table boolean")
    got = {tuple(r) for r in scanned.repairs(df).select("key", "kind", "found").collect()}
    assert ("d3", "furniture", "- 3 -") in got and ("d3", "furniture", "Protocol AB-103   Confidential") in got
    assert {("x", "broken", "sponsor"), ("x", "broken", "well-tolerated"), ("x", "misread", "approved"), ("x", "misread", "without"), ("x", "misread", "205")} <= got
    assert not [g for g in got if g[0] in "tnb"] and not [g for g in got if g[1] == "furniture" and "sponsor" in g[2]]
    text = {r.key: r.text for r in scanned.paragraphs(df).collect()}
    assert text["d3"] == f"{prose} {prose}" and text["x"].startswith("The sponsor approved a well-tolerated budget of 205")
    assert scanned.repairs(df.limit(0)).count() == 0


def test_headers_of_one_document(spark):
    prose = [f"The sponsor approved {w} without further comment." for w in "the budget,the visit,the contract,the sample,the device".split(",")]
    body = "\n".join(prose)
    rows = [("o", "o", 0, "\n".join(f"A title of its own\n{body}\nPage {i}" for i in range(1, 5)))]
    rows += [(f"s{i}", "s", i, ["In parts", body, f"- {i // 3} -"][i % 3]) for i in range(15)]
    rows += [("l", "l", 0, "\n".join(f"Every long page\n{body}\n{body}\n{body}\n{body}" for _ in range(5)))]
    rows += [("w", "w", 0, "\n".join(f"Shared by scans\n{body}\n{i}" for i in range(1, 4)))] + [(f"w{i}", f"w{i}", 0, f"{body}\n{i} patients\nShared by scans") for i in range(5)]
    rows += [("b", "b", 0, f"Status open\n{body}\nStatus open\n{body}\nStatus open\n{body}\nStatus open\n{body}\n{body}")]
    df = spark.createDataFrame([(*r, False) for r in rows], "key string, doc string, place long, text string, in_table boolean")
    got = {(r.key, r.found) for r in scanned.repairs(df).where("kind = 'furniture'").collect()}
    assert {("o", "A title of its own"), ("s0", "In parts"), ("s12", "In parts"), ("l", "Every long page"), ("w", "Shared by scans")} <= got
    assert not [g for g in got if g[0] == "b" or "sponsor" in g[1]]
    assert {r.key: r.text for r in scanned.paragraphs(df).collect()}["o"] == " ".join(prose * 4)


def test_numbers_and_codes_need_evidence(spark):
    """Units, codes and words that look like page numbers stay, alone and beside a corpus that is misread."""
    kept = "Take 10g of it and 50l of water in 3D view of vitamin B12. The 1st, 2nd and 4th of 7B and 5l.\nISO\nSOS\nOSLO\nI\n|\nThe end"
    noise = [f"Table {i} has {100 + i % 9} rows, 501 and 109 and 812 and 30 too. The ist bst" for i in range(40)] + ["It has 1O3 rows, 1l4 rows, 10l rows, l05 rows, 1B2 and 1S5 and 18S."] * 2 + ["182 and 155 and 185 here"] * 20
    for extra in ([], noise):
        df = spark.createDataFrame([("k", "k", kept, False)] + [(f"n{i}", f"n{i}", t, False) for i, t in enumerate(extra)], "key string, doc string, text string, in_table boolean")
        found = {(r.key, r.kind, r.read, r.found) for r in scanned.repairs(df).collect()}
        assert not [f for f in found if f[0] == "k"], found
        assert {r.key: r.text for r in scanned.paragraphs(df).collect()}["k"] == kept.replace("\n", " ")
        if extra:
            assert found == {(r.key, r.kind, r.read, r.found) for r in scanned.repairs(df, most_fixes=0).collect()}
            assert {(r, f) for k, _, r, f in found if k == "n40"} == {("1O3", "103"), ("1l4", "114"), ("10l", "101"), ("l05", "105"), ("1B2", "182"), ("1S5", "155"), ("18S", "185")}


def test_long_headers_and_words_and_hot_documents(spark):
    head, word = "The long title of a report that runs over the head of every page of it and goes on beyond ninety characters", "pneumono" * 9
    body = "The sponsor approved the budget without further comment."
    rows = [(f"p{i}", "hot", i, [head, body, f"- {i // 3} -"][i % 3]) for i in range(9000)]  # more than two slices
    rows += [(f"r{i}", "far", i, head.upper() if i % 4000 == 17 else body) for i in range(17_000)]  # regular over slices, no page number near
    rows += [(f"w{i}", f"w{i}", 0, f"{word} comes {'often' if i else '0ften'}") for i in range(30)] + [("x", "x", 0, word.replace("m", "rn", 1) + " comes t0 0f it"), ("y", "y", 0, "up to it and of it " * 20)]
    df = spark.createDataFrame([(*r, False) for r in rows], "key string, doc string, place long, text string, in_table boolean")
    got = {(r.key, r.kind, r.found) for r in scanned.repairs(df).collect()}
    assert {k for k, kind, f in got if f == head} == {f"p{i}" for i in range(0, 9000, 3)}
    assert {k for k, kind, f in got if f == head.upper()} == {f"r{i}" for i in range(17, 17_000, 4000)}
    assert not [g for g in got if "sponsor" in g[2]] and {("x", "misread", word), ("w0", "misread", "often")} <= got


def test_template_hashes_agree(spark):
    lines = ["Protocol AB-123   Confidential", " 12 of 30 ", "方案编号 KT-697    机密", "é AB12x ZZ-01", "١٢ 5"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(F.xxhash64(scanned.template(F.col("line")))).collect()] == [scanned.template_hash(x) for x in lines]


def test_anagram_hash_differences(spark):
    word, right = "anaernia", "anaemia"
    assert scanned.hash_of(right) == scanned.hash_of(word) + scanned.hash_of("m") - scanned.hash_of("rn")
    assert spark.range(1).select(scanned.anagram_hash(F.lit(word))).first()[0] == scanned.hash_of(word)
    assert scanned.explains(word, right) and not scanned.explains("cat", "dog") and scanned.explains("furfhcr", "further")


# ---- 5. canonical list


@pytest.fixture(scope="module")
def mapper():
    return canonical_list.Mapper([("Naracimos receptor", "c1"), ("receptor, Naracimos", "c1"), ("HHGR-1", "c1"), ("Gulodicil deficiency", "c2"), ("波雷卡缺乏症", "c3"), ("波雷卡", "c3")])


@pytest.mark.parametrize(("value", "concept"), [("naracimos RECEPTOR", "c1"), ("severe Naracimos receptor (adult)", "c1"), ("Naracimso recptor", "c1"), ("receptor, Naracimos", "c1"), ("H.H.G.R.-1", "c1"), ("HHGR-2", "unmatched"), ("Gulodicil syndrome", "unmatched"), ("deficiency, Gulodicil", "c2"), ("重度波雷卡缺乏症患者", "c3"), ("波雷卡（儿童）", "c3"), ("波大卡缺乏症", "c3"), ("波雷卡单抗", "unmatched"), ("???", "unmatched"), ("visit", "unmatched")])
def test_mapping(mapper, value, concept):
    assert mapper(value) == concept or (value == "波雷卡单抗" and mapper(value) in ("unmatched", "c3"))


def test_mapping_frames(spark):
    concepts = spark.createDataFrame([("c1", "Naracimos receptor", None, "HHGR-1|N/A", "")], "concept_id string, en string, zh string, en_aliases string, zh_aliases string")
    df = spark.createDataFrame([("a", "hhgr 1", 1), ("b", None, 1), ("c", "  ", 1), ("a", "hhgr 1", 1), ("d", "x" * 5000, 1)], "decision_id string, source string, value int")
    assert sorted(map(tuple, canonical_list.mapped(df, "decision_id", "source", concepts).collect())) == [("a", "c1"), ("d", "unmatched")]
    assert sorted(map(tuple, canonical_list.mapped(df, "decision_id", "source", concepts.limit(0)).collect())) == [("a", "unmatched"), ("d", "unmatched")]
    assert canonical_list.mapped(df.limit(0), "decision_id", "source", concepts).count() == 0
    with pytest.raises(ValueError):
        canonical_list.list_names(concepts, most_names=0)


def test_token_sets_in_any_order():
    m = canonical_list.Mapper([("Nuzozigoren deficiency", "c1"), ("deficiency of Gulodicil", "c2"), ("Vitamin B excess", "c3"), ("alpha beta gamma", "c4")])
    assert [m(x) for x in ("deficiency Nuzozigoren", "defficiency Nuzozigorn", "severe deficiency Nuzozigoren", "gamma alpha beta")] == ["c1", "c1", "c1", "c4"]
    assert [m(x) for x in ("Gulodicil deficiency of", "excess Vitamin D", "deficiency Nuzozigoren gamma", "deficiency Nuxxxxxoren")] == ["c2", "unmatched", "unmatched", "unmatched"]


def test_token_set_similarity():
    names = [("renal failure", "c1"), ("hypertension stage two", "c2"), ("hypertension stage one", "c3"), ("cardiac failure", "c4"), ("hepatic failure", "c5"), ("asthma", "c6"), ("tinnitus aurium sinister chronicus", "c7")]
    m = canonical_list.Mapper(names)
    assert [m(x) for x in ("failure renal", "two stage hypertension", "stage one, hypertension", "failure, renal", "renall failure", "renalfailure", "ast hma")] == ["c1", "c2", "c3", "c1", "c1", "c1", "c6"]
    assert [m(x) for x in ("failure", "gastric failure", "stage two", "cardial hypertension", "ast")] == ["unmatched"] * 5
    for name, concept in names:  # any order of the tokens is the same set
        tokens = name.split()
        assert all(m(" ".join(tokens[i:] + tokens[:i])) == concept for i in range(len(tokens)))


def test_near_tokens_are_all_found():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))) for _ in range(150)})
    g = canonical_list.Grams(words)
    for share in (0.14, 0.24, 0.4):
        for _ in range(60):
            s = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10)))
            want = sorted((w, d / max(len(s), len(w))) for w in words if (d := canonical_list.within(s, w, 9)) <= int(share * max(len(s), len(w)) + 1e-9) and canonical_list.pairs_of(s) & canonical_list.pairs_of(w))
            assert sorted(g.near(s, share)) == want


# ---- 6. garbled text


RIGHT = ["café trial – checked", "sponsor’s dose ≥ 5 µg", "与方案正文保持一致", "155中心地沙吡罗的安全性随访（±3天）", "из протокола", "β-blocker at 37 °C", "naïve Zürich “rolling” résumé"]


@pytest.mark.parametrize("text", RIGHT)
def test_rightful_text_stays(text):
    assert garbled.restore(text) is None


OTHER_SCRIPTS = [
    "환자는 매일 두 번 약을 복용해야 합니다.", "대한민국(大韓民國) 헌법", "カタカナのテスト", "患者は毎日二回薬を飲む必要があります。", "図書館の気温を測定する", "這個病人需要每天服用兩次藥物", "ﾃｽﾄｱ", "المريض يتناول الدواء مرتين يوميا", "החולה נוטל תרופה", "ผู้ป่วยต้องกินยาวันละสองครั้ง", "रोगी को दवा",
    "Ελληνικά κείμενα εδώ", "ΑΘΗΝΑ", "Հայերեն տեքստ", "Việt Nam độc lập tự do hạnh phúc", "Příliš žluťoučký kůň úpěl ďábelské ódy", "İstanbul'da güneşli", "œuvre d’art à Nîmes", "№ 5 – «да»", "😀😀 ok", "√ done → next", "①②③ 步骤", "ａｂｃ１２３",
    "┌──┬──┐\n│ a│ b│\n└──┴──┘", "┌──┬──┐\n│甲│乙│\n└──┴──┘", "Пациент принимает препарат дважды в день", "IL-1β/TNF-α", "≥ 3 × ULN",
]


@pytest.mark.parametrize("text", OTHER_SCRIPTS)
def test_other_scripts_stay_and_come_back(text):
    assert garbled.restore(text) is None
    if text.strip("ﾃｽﾄｱΑΘΗΝ") and len(text) > 12:
        assert garbled.restore(text.encode("utf-8").decode("latin-1")) == text


@pytest.mark.parametrize("layers", range(3, 13))
def test_any_number_of_layers(layers):
    text = one = two = "naïve café – “x”"
    for i in range(layers):
        one, two = one.encode().decode("latin-1"), two.encode().decode(("cp437", "mac_roman")[i % 2])
    assert garbled.restore(one) == garbled.restore(two) == text


@pytest.mark.parametrize("text", RIGHT)
@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437"])
@pytest.mark.parametrize("layers", [1, 2])
def test_round_trips(text, wrong, layers):
    seen = text
    for _ in range(layers):
        seen = seen.encode("utf-8").decode(wrong)
    assert garbled.restore(seen) == text


def test_other_layers_and_losses():
    assert garbled.restore("与方案正文保持一致".encode("gb18030").decode("latin-1")) == "与方案正文保持一致"
    assert garbled.restore("temperature ±2 Â°C") == "temperature ±2 °C"
    assert garbled.restore("drug �� 5") == "" and garbled.restore(None) is None and garbled.restore("") is None


def test_garbled_frame(spark):
    df = spark.createDataFrame([("1", "faÃ§ade", None, "ok"), ("1", "faÃ§ade", None, "ok"), ("2", "", "plain", "é")], "entry_id string, source string, target string, value string")
    assert [tuple(r) for r in garbled.garbled(df, "entry_id", ["source", "target", "value"]).collect()] == [("1", "source", "façade")]
    assert garbled.garbled(df.limit(0), "entry_id", ["source"]).count() == 0


# ---- 7. alignment


def test_sentences():
    assert sentences.sentences("One. Two 3.5 mg! 三。四？”") == ["One.", "Two 3.5 mg!", "三。", "四？”"]
    assert sentences.sentences(None) == [] and sentences.sentences(" ") == []


@pytest.fixture(scope="module")
def embedder():
    rng = random.Random(2)
    nouns = [("budget", "预算科目"), ("protocol", "研究方案"), ("device", "医疗器械"), ("server", "备份服务"), ("contract", "许可合同"), ("sample", "血浆样本")]
    verbs = [("was approved", "已经获批"), ("was rejected", "遭到拒绝"), ("was renewed", "得到更新"), ("was audited", "接受稽查")]
    pairs = []
    for _ in range(400):
        (a, x), (b, y), k = rng.choice(nouns), rng.choice(verbs), rng.randrange(100, 999)
        pairs.append((f"The {a} {b} on {k}.", f"{x}{y}{k}。"))
    return alignment.Embedder(pairs), nouns, verbs


def test_alignment_with_moves_merges_and_gaps(embedder):
    e, nouns, verbs = embedder
    import numpy as np

    en = [f"The {nouns[i][0]} {verbs[i % 4][0]} on {100 + i}." for i in range(6)]
    zh = [f"{nouns[i][1]}{verbs[i % 4][1]}{100 + i}。" for i in range(6)]
    source = [en[0], en[1], en[2], en[3], en[5]]
    target = [zh[3], zh[0], zh[1][:-1] + "，" + zh[2], zh[4]]
    got = alignment.aligned(np.stack([e.sentence(s) for s in source]), np.stack([e.sentence(s) for s in target]), 0.3, 0.42)
    assert got == [(0, 1), (1, 2), (2, 2), (3, 0)]


def test_long_documents_go_coarse_to_fine(embedder):
    e, nouns, verbs = embedder
    import numpy as np

    rng = random.Random(4)
    picks = [(rng.choice(nouns), rng.choice(verbs), 1000 + i) for i in range(90)]
    a = np.stack([e.sentence(f"The {n[0]} {v[0]} on {k}.") for n, v, k in picks])
    b = np.stack([e.sentence(f"{n[1]}{v[1]}{k}。") for n, v, k in picks])
    assert alignment.aligned(a, b, 0.3, 0.42) == [(i, i) for i in range(90)]


def test_alignment_frame(spark, embedder):
    e = embedder[0]
    df = spark.createDataFrame([("r", "The budget was approved on 101. The server was audited on 202.", "备份服务接受稽查202。预算科目已经获批101。"), ("s", "!!!", "预算。"), ("t", "The budget was approved on 303.", "预算科目已经获批303。”")], "record_id string, source string, target string")
    assert sorted(map(tuple, alignment.alignments(df.withColumn("least", F.lit(2)), e).collect())) == [("r", 1, 2), ("r", 2, 1)]
    assert sorted(map(tuple, alignment.alignments(df.withColumn("least", F.lit(1)), e).collect())) == [("r", 1, 2), ("r", 2, 1), ("t", 1, 1)]
    assert alignment.alignments(df.limit(0).withColumn("least", F.lit(1)), alignment.Embedder([])).count() == 0


def test_all_records_are_fitted(spark):
    """Word pairs beyond 10,000 units, words after 4,000 numbers, and records of several sentences all count."""
    names = [chr(0x4E00 + i) + chr(0x5E00 + i) for i in range(30)]
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    rows = [(f"The {words[i % 3]} {words[3 + i % 2]} {i % 4500}.", f"{names[i % 3]}，{names[3 + i % 2]}，{i % 4500}。") for i in range(22_000)]
    rows += [(f"The {words[5 + i // 2]} stood here.", f"{names[5 + i // 2]}。") for i in range(50)]
    rows += [("Only onlyhere. Then thenhere.", "仅此。随后。")] * 3
    e = alignment.fitted(spark.createDataFrame(rows, "source string, target string").repartition(5))
    assert e.n == 22_056 and all(e.translations[names[i]][0][0] == words[i] for i in range(30))
    assert "onlyhere" in e.vectors and e.idf["onlyhere"] < e.idf.get("absent", 99)
    local = alignment.Embedder(rows)
    assert e.translations == local.translations and e.idf == local.idf


def test_driver_gets_the_most_frequent_numbers_only(spark, monkeypatch):
    """Numbers grow with the records; the counts of the others reach the records from a table, with the same weights and pairs."""
    import numpy as np

    names, verbs = ["预算", "服务", "合同"], ["批准", "拒绝", "更新"]
    words = "budget server contract approved rejected renewed".split()
    say = lambda i, n: (f"The {words[i % 3]} was {words[3 + i // 3 % 3]} on {n}.", f"{names[i % 3]}被{verbs[i // 3 % 3]}{n}。")
    number = lambda i: f"{i % 50},{i % 7:03}" if i % 4 else f"{i % 90}.5-\n{i % 3}"
    rows = []
    for i in range(400):
        (a, b), (c, d) = say(i, number(i)), say(i + 1 + i // 9, number(i * 7 + 1))
        rows.append((f"{i:03}", f"{a} {c}", f"{d}{b}"))
    df = spark.createDataFrame(rows, "record_id string, source string, target string").repartition(4)
    both = []
    for most in (20_000, 10):
        monkeypatch.setattr(alignment, "MOST_NUMBERS", most)
        e = alignment.fitted(df)
        both.append((e, sorted(map(tuple, alignment.alignments(df.withColumn("least", F.lit(2)), e).collect()))))
    whole, few = both[0][0], both[1][0]
    assert sum(w[0].isdigit() for w in few.idf) == 10 < sum(w[0].isdigit() for w in whole.idf)
    assert both[0][1] == both[1][1] and len(both[0][1]) >= 800
    for r in alignment.with_numbers(df, few.numbers).collect():
        counts = dict(zip(r.numbers or [], r.counts or []))
        for w in {w for t in (r.source, r.target) for z in sentences.sentences(t) for w in alignment.pieces(z) if w[0].isdigit()}:
            assert float(np.log(1 + few.n / counts.get(w, 1))) == whole.idf.get(w, float(np.log(1 + few.n))) or few.idf[w] == whole.idf[w]


def odd_texts(n):
    """Texts of all scripts, with divided words, marks in numbers, long words and numbers, and sentences without a word."""
    rng = random.Random(12)
    words = ["budget", "Q", "pneumonoultramicroscopic", "abcdefghijkl", "abcdefghijklm", "naïve", "İstanbul", "ΑΣ", "бюджет", "예산", "预算", "预", "科目々", "ガン", "ｶﾞ", "งบ", "ๆ", "ั", "́", "ⅷ", "\U00020001\U00020002", "𐐀", "\U000e0100", "x́", "ab中de"]
    words += ["7", "3.5", "1,234,567.8", "1.,2", "2.", "123456789012345", "1234567890123456", "1,2,3,4,5,6,7,8,9,0,1,2,3,4,5", "5mg", "٣", "a1b2", "...", "!", "?!", "”", "-", "_", "|"]
    joints = [" ", " ", " ", "", ". ", ".", "。", "！", "? ", "-\n", "­\n", "\n", "‐\n", "--\n", ". -\n", "。-\n", ".\n", "\x1f", ".　", ","]
    return ["".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.choice((1, 2, 6, 30)))) for _ in range(n)] + ["", "\n", "-\n", "a", "。", "\n-", "x-", "\nx"]


def test_counts_are_formed_for_whole_batches(monkeypatch):
    """Words and pairs are counted without a call of Python for each sentence or piece, and come out as those of each sentence do."""
    from collections import Counter

    import pandas as pd

    texts = odd_texts(1500)
    rng = random.Random(13)
    rows = list(zip(texts, rng.sample(texts, len(texts)))) + [("One word. Two words.", "Слово. Два слова. Три.")] * 4
    records, words, weights = [], Counter(), Counter()
    for both in rows:
        x, y = ([w for z in sentences.sentences(t) if (w := alignment.pieces(z))] for t in both)
        records.append((y, x) if alignment.sides_turned(x, y) else (x, y))
        weight = round((1 << 32) / (len(x) * len(y))) if x and y else 0
        for k, side in enumerate(records[-1]):
            words["", k] += len(side)
            for w in (w for z in side for w in set(z)):
                words[w, k] += 1
                weights[w, k] += weight * len(records[-1][1 - k])
    at = [{w: i for i, w in enumerate(sorted({w for w, side in words if side == k and w and not w[0].isdigit()})[k::2])} for k in (0, 1)]
    pairs = Counter()
    for record in records:
        found = [[[at[k][w] for w in z if w in at[k]] for z in record[k]] for k in (0, 1)]
        for k in (0, 1):
            pairs.update((k, a, b) for z in found[k] for i, a in enumerate(z) for b in z[i + 1 : i + 6])
        for a in (a for z in found[0] for a in set(z)):
            for b in (b for z in found[1] for b in set(z)):
                pairs[2, a, b] += round((1 << 32) / (len(record[0]) * len(record[1])))

    def called(*_):
        raise AssertionError("a sentence by itself")

    for name in ("pieces", "sentences", "sides_turned"):
        monkeypatch.setattr(alignment, name, called)
    frame = pd.DataFrame(rows, columns=["source", "target"])
    batches = [frame[:700], frame[:0], frame[700:]]
    for characters, block, most in ((1 << 18, 2_000_000, 4_000_000), (1, 300, 500), (1000, 50, 40)):
        for name, value in (("CHARACTERS", characters), ("BLOCK", block), ("MOST_HELD", most), ("MOST_WORDS", most)):
            monkeypatch.setattr(alignment, name, value)
        monkeypatch.setattr(piece_codes, "SLICE", characters)
        got = pd.concat(alignment.word_counts(iter(batches))).groupby("word").sum()
        assert {(w, k): n for k in (0, 1) for w, n in got[f"n{k}"].items() if n} == +words
        assert {(w, k): n for k in (0, 1) for w, n in got[f"w{k}"].items() if n} == +weights
        got = Counter()
        for f in alignment.pair_counts(iter(batches), at):
            for kind, a, bs, ns in zip(f.kind, f.a, f.bs, f.ns):
                got.update({(kind, a, b): n for b, n in zip(bs.tolist(), ns.tolist())})
        assert got == pairs


def test_partitions_without_records_are_fitted(spark):
    rows = spark.createDataFrame([("Two words.", "两词。")] * 2, "source string, target string").repartition(1)
    assert alignment.fitted(rows.unionByName(rows.where("source = 'none'"))).n == 2


@pytest.mark.parametrize("language", ["ru", "ja", "ko", "th", "de"])
def test_any_pair_of_languages(language):
    words = {
        "ru": "бюджет протокол прибор сервер договор образец утверждён отклонён продлён проверен", "ja": "予算 計画 装置 サーバ 契約 サンプル 承認済 却下済 更新済 監査済", "ko": "예산은 계획은 장치는 서버는 계약은 표본은 승인됨 거부됨 갱신됨 감사됨",
        "th": "งบประมาณ แผนงาน เครื่องมือ เซิร์ฟเวอร์ สัญญา ตัวอย่าง อนุมัติ ปฏิเสธ ต่ออายุ ตรวจสอบ", "de": "Haushalt Plan Gerät Rechner Vertrag Probe genehmigt abgelehnt verlängert geprüft",
    }[language].split()
    english = "budget plan device server contract sample approved rejected renewed audited".split()
    rng = random.Random(6)
    join = " " if language in ("ru", "ko", "de") else ""
    pick = lambda: (rng.randrange(6), 6 + rng.randrange(4))
    side = lambda p: (f"The {english[p[0]]} was {english[p[1]]}.", words[p[0]] + join + words[p[1]] + (". " if join else "。"))
    e = alignment.Embedder([side(pick()) for _ in range(400)])
    found = total = 0
    for _ in range(20):
        own = rng.sample([(i, j) for i in range(6) for j in range(6, 10)], 5)
        order = own[1:] + own[:1]
        a, b = e.embedded([side(p)[0] for p in own], [side(p)[1] for p in order])
        got = set(alignment.aligned(a, b, 0.3, 0.42))
        found, total = found + len(got & {(own.index(p), k) for k, p in enumerate(order)}), total + 5
    assert found >= 0.9 * total


def test_windows_give_the_full_path_and_memory_stays_linear():
    import tracemalloc

    import numpy as np

    rng, peaks = np.random.default_rng(3), []
    for n in (60, 500, 2000):
        a = rng.standard_normal((n, 352)).astype(np.float32)
        order = [i for i in range(n) if i % 17]
        order = order[: n // 3] + order[n // 3 + 4 :] + order[n // 3 : n // 3 + 4]
        b = a[order] + 0.4 * rng.standard_normal((len(order), 352)).astype(np.float32)
        if n == 60:
            assert alignment.coarse_to_fine(a, b, 0.3) == alignment.warp(a, b, 0.3)
        tracemalloc.start()
        assert alignment.aligned(a, b, 0.3, 0.42) == sorted((x, y) for y, x in enumerate(order))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 6 * peaks[1] and peaks[2] < 60_000_000


def test_equal_sentences_meet_in_place():
    import numpy as np

    one = np.ones((300, 352), dtype=np.float32)
    assert alignment.moved_pairs(alignment.unit(one), alignment.unit(one), [set(range(300)), set(range(300))], 0.42) == [(i, i) for i in range(300)]
    assert alignment.moved_pairs(alignment.unit(one), -alignment.unit(one), [{0, 1}, {0, 1}], 0.42) == []


# ---- 8. leakage

ITEM = "The night porter crossed out four hundred signatures with green ink while the robot clock died and the harbour pharmacist swapped yellow patches for stronger green ones."


def brute_share(doc, item):
    """Longest run of equal words."""
    a, b = [t for t, _, _ in leakage.tokens(doc)], [t for t, _, _ in leakage.tokens(item)]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best / len(b)


def test_every_long_span_is_found():
    rng, f = random.Random(5), leakage.Finder([("i", ITEM)])
    words = ITEM.split()
    for _ in range(200):
        a = rng.randrange(len(words))
        b = rng.randrange(a, len(words)) + 1
        doc = "Some other text of no matter. " + " ".join(words[a:b]).upper() + " and then quite unlike words follow here"
        assert bool(f(doc)) == (brute_share(doc, ITEM) >= 0.5)


def test_alterations_markup_and_fragments():
    f = leakage.Finder([("i", ITEM), ("z", "值夜班的门卫用绿墨水划掉了四百个签名，直到机器人时钟的电池耗尽。")])
    assert [h[0] for h in f(ITEM.replace("green ink", "purple ink").replace("robot", "<b>robot</b>\n"))] == ["i"]
    assert [h[0] for h in f("前言。值夜班的门卫用红墨水划掉了四百个签名，直到机器人 时钟的电池耗尽")] == ["z"]
    assert f(" ".join(ITEM.split()[:8])) == [] and f(None) == [] and f("") == []


def test_both_paths_agree(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (2, None), (3, ""), (4, "nothing here at all"), (5, ITEM.upper()), (5, ITEM.upper())], "doc_id long, text string").withColumn("h", F.lit(1))
    items = spark.createDataFrame([("i", ITEM, "en"), ("n", None, "en")], "item_id string, text string, lang string")
    small = sorted(map(tuple, leakage.leaks(docs, "doc_id", "text", items).collect()))
    large = sorted(map(tuple, leakage.leaks(docs, "doc_id", "text", items, most_fingerprints=0).collect()))
    assert small == large == [(1, "i"), (5, "i")]
    assert leakage.leaks(docs, "doc_id", "text", items.limit(0)).count() == 0


def test_a_short_stretch_hides_no_long_one_behind_it(spark):
    words = [f"t{i}" for i in range(114)]
    text = " ".join([*words[:8], *(f"foreign{i}" for i in range(8)), *words[16:]])
    assert [h[:2] for h in leakage.Finder([("i", " ".join(words))])(text)] == [("i", 98 / 114)]
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    for most in (0, 2_000_000):
        assert [tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, most_fingerprints=most).collect()] == [(1, "i")]
    again = [r for i in range(0, 114, 10) for r in (*words[i : i + 9], "other")]
    assert len(leakage.Finder([("i", " ".join(words))])(" ".join(again))) == 1


def test_items_of_any_script():
    texts = {
        "ru": "Ночной сторож вычеркнул четыреста подписей зелёными чернилами пока умирали часы робота",
        "el": "Ο νυχτοφύλακας διέγραψε τετρακόσιες υπογραφές με πράσινο μελάνι ενώ το ρολόι σταματούσε",
        "ja": "夜勤の守衛がロボット時計の停止する間に緑のインクで四百の署名を消した",
        "ko": "야간 경비원이 로봇 시계가 멈추는 동안 초록 잉크로 사백 개의 서명을 지웠다",
        "ar": "شطب الحارس الليلي أربعمئة توقيع بالحبر الأخضر بينما توقفت ساعة الروبوت",
        "hi": "रात के चौकीदार ने हरी स्याही से चार सौ हस्ताक्षर काट दिए जब घड़ी रुक गई",
        "de": "Der Straßenwächter strich größere Maßstäbe mit grüner Tinte durch während die Uhr stehen blieb",
    }
    f = leakage.Finder(list(texts.items()))
    for name, t in texts.items():
        assert {h[0] for h in f(f"Before it. {t.upper() if name in ('ru', 'el') else t}! Behind it.")} == {name}
        assert f(t[: len(t) // 3]) == []
    assert [h[0] for h in f(texts["de"].replace("ß", "ß\u00ad").replace("ö", "o\u0308"))] == ["de"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 15, 18, 19, 25])
def test_short_items_are_found_in_full(n):
    rng, own = random.Random(n), [f"q{i}" for i in range(n)]
    f = leakage.Finder([("i", " ".join(own))])
    for _ in range(60):
        a = rng.randrange(n)
        b = rng.randrange(a, n) + 1
        doc = " ".join([*(f"x{rng.randrange(99)}" for _ in range(rng.randrange(4))), *own[a:b], *(f"y{rng.randrange(99)}" for _ in range(6))])
        assert bool(f(doc)) == (b - a >= n / 2), (a, b)
    if n >= 8:  # one altered word inside the shortest stretch, with words that agree on both sides of it
        need = -(-n // 2)
        for at in range(1, need - 2):
            doc = [*own[:at], "other", *own[at + 1 : need], "and", "more", "words", "of", "another", "text"]
            assert f(" ".join(doc)), at


def test_places_and_batches():
    f, item = leakage.Finder([("i", ITEM), ("i", "An item may come with a second text of its own under one name")]), " <i>" + ITEM + "</i>"
    docs = ["no", None, "", "see " + item, ITEM[:20], "AN ITEM MAY COME WITH A SECOND TEXT OF ITS OWN", "x < 5 and " + ITEM.replace("green", "deep &amp; green") + " > 7"] * 3
    got = f.all(docs)
    assert [[h[0] for h in x] for x in got] == [[], [], [], ["i"], [], ["i"], ["i"]] * 3 and got[:7] == [f(d) for d in docs[:7]]
    _, _, a, b = got[3][0]
    assert docs[3][a:b] == ITEM[:-1]


def test_hot_fingerprints_in_the_join(spark):
    rows = [(i, ITEM if i % 3 else f"Nothing of it, {i} times over.") for i in range(60)] + [(99, "the robot clock died " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("i", ITEM), ("s", "robot clock"), ("n", None), (None, ITEM)], "item_id string, text string")
    want = sorted(map(tuple, leakage.leaks(docs, "doc_id", "text", items).collect()))
    assert want == sorted(map(tuple, leakage.leaks(docs, "doc_id", "text", items, most_items=1, hot_rows=5, salts=3).collect())) and (99, "s") in want and (1, "i") in want


# ---- 9. mixture


def test_mixture_is_exact(spark):
    rows = [(i, f"word number {i} " * (1 + i % 5), "abc"[i % 3] if i % 10 else "a", 1) for i in range(300)] + [(900, None, "a", 1), (901, "x", None, 1), (902, " ", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2), ("gone", 0.4, 1)], "source string, target_share double, max_repeats int")
    got = mixture.mixture(docs, targets, partitions=5).collect()
    total = sum(r.used_tokens for r in got)
    for s, w, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.used_tokens for r in own) - w * total) <= 1 and max(r.epoch for r in own) < most
        assert len({(r.doc_id, r.epoch) for r in own}) == len(own) and sum(r.used_tokens < r.n_tokens for r in own) <= 1
    assert not {r.doc_id for r in got} & {900, 901, 902}
    shares = {r.source: r for r in mixture.reached(docs, targets).collect()}
    assert shares["gone"].tokens == 0 and abs(shares["b"].reached_share - 0.5) < 1e-3
    assert mixture.mixture(docs.limit(0), targets).count() == 0 and mixture.mixture(docs, targets.limit(0)).count() == 0


def test_a_total_out_of_reach_is_reported():
    assert mixture.budgets({"a": 10, "b": 100}, {"a": (0.5, 2), "b": (0.5, 1)}, None) == {"a": 20, "b": 20}
    assert mixture.budgets({"a": 10, "b": 100}, {"a": (0.5, 2), "b": (0.5, 1)}, 100) == {"a": 20, "b": 50}
    assert mixture.budgets({}, {"a": (1.0, 1)}, None) == {}


# ---- 10. subjects


def test_subjects_held_out(spark, data):
    docs, labels, items = (spark.read.parquet("/root/testdata/sf0.01/" + t) for t in ("documents.parquet", "subject_labels.parquet", "eval_items.parquet"))
    known = {}
    for r in labels.collect():
        known.setdefault(r.doc_id, set()).add(r.subject)
    ids = sorted(known)
    train = labels.where(F.col("doc_id").isin([i for i in ids if i % 2]))
    got = {}
    for r in subjects.unlabelled(docs, train, items).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    have = {r.doc_id for r in docs.where("text is not null").select("doc_id").collect()}
    held = [i for i in ids if not i % 2 and i in have]
    hit = sum(len(got.get(i, set()) & known[i]) for i in held)
    f1 = 2 * hit / (sum(len(got.get(i, set())) for i in held) + sum(len(known[i]) for i in held))
    assert f1 > 0.8 and not set(got) & {i for i in ids if i % 2}


def test_each_subject_has_its_threshold():
    import numpy as np

    rng, docs = np.random.default_rng(4), []
    for i in range(120):  # sentences of a gain 0.5 or more, of b 1.5 or more; what says nothing reaches 0.2 of a and 1.2 of b
        own = {"a"} if i % 3 == 0 else {"b"} if i % 3 == 1 else set()
        gains = []
        for _ in range(6):
            g = np.array([-1.0, -1.0])
            j = 0 if own == {"a"} else 1 if own == {"b"} else int(rng.integers(2))
            g[j] = (0.5, 1.5)[j] + rng.random() * 0.3 if own else (0.2, 1.2)[j] * rng.random()
            gains.append(g)
        docs.append((gains, own))
    held = subjects.Held(docs, ["a", "b"], 0.2)
    one = held.best_of(np.full(2, np.inf), [0, 1])
    both = held.best_of(held.best_of(one, [0]), [1])
    assert held.f1(both) == 1.0 > held.f1(one) and both[0] < both[1]
    for gains, own in docs:
        assert set(subjects.decide(gains, ["a", "b"], both, 0.2)) == own


def test_subjects_without_labels(spark):
    docs = spark.createDataFrame([(1, "One text."), (2, None), (3, "")], "doc_id long, text string")
    assert subjects.unlabelled(docs, spark.createDataFrame([], "doc_id long, subject string")).count() == 0
    labels = spark.createDataFrame([(1, "a"), (9, "b")], "doc_id long, subject string")
    assert subjects.unlabelled(docs, labels).count() == 0
