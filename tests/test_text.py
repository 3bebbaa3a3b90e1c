"""Text functions against Python's re and hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabletloom.functions import features, fixed, ocr, scoring
from tabletloom.functions import text as T

UPPER, LOWER, INDEX = fixed.UPPER, fixed.LOWER, fixed.INDEX


def texts(n=250, seed=3):
    rng = random.Random(seed)
    signs = list("aAbšŠṢṭḫéùÁx -–._!?/:[]{}<>˹˺₂₃0\n\t\r'\"ʾöÖ,()") + ["[x x]", "[x]", "<<", ">>", "\xa0", " ", "\x1c", "KÙ.BABBAR₂", "DUMU", "A-šùr", "{d}", "[...]", "́"]
    return ["", " ", None, *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(n))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "row_id long, t string")


def check(rows, column, expected):
    for r in rows.select("t", column.alias("got")).collect():
        assert r["got"] == expected(r["t"] or ""), repr(r["t"])


def py_normalize(t):
    t = re.sub(fixed.ERASURE, "", t)
    for words, token in ((fixed.BIG_GAPS, "<big_gap>"), (fixed.SINGLE_GAPS, "<gap>")):
        t = re.sub("|".join(map(re.escape, words)), token, t)
    return re.sub(r"\s+", " ", re.sub("[!?/:.˹˺]", "", t)).strip()


def test_normalize(rows):
    check(rows, T.normalize("t"), py_normalize)


def test_normalize_goldens(spark):
    given = {
        "a-na A-šùr-i-mì-tí / DUMU Ṣí-lí-{d}UTU [x x] qí-bi-ma!": "a-na A-šùr-i-mì-tí DUMU Ṣí-lí-{d}UTU <big_gap> qí-bi-ma",
        "a-na A-šùr! [x x] qí-bi-ma": "a-na A-šùr <big_gap> qí-bi-ma",
        "[x x x x x x] [x]": "[x x x x x x] <gap>",
        "KÙ.BABBAR <<a\nb>>": "KÙBABBAR <<a b>>",
        None: "",
    }
    got = spark.createDataFrame([(k,) for k in given], "t string").select("t", T.normalize("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == given


def test_keys(rows):
    check(rows, T.dedup_key("t"), lambda t: re.sub(r"[\s!?.]", "", t.lower()))
    table = str.maketrans(fixed.KEY_FROM + "", fixed.KEY_TO)
    check(rows, T.match_key("t"), lambda t: t.lower().replace("š", "sh").translate(table).replace("-", ""))


def test_trigrams(rows):
    def expected(t):
        k = re.sub(r"[\s!?.]", "", t.lower())
        return sorted({k[i : i + 3] for i in range(len(k) - 2)})

    check(rows, F.array_sort(T.trigrams(T.dedup_key("t"))), expected)


def test_features(rows):
    name = rf"\b[{UPPER}][{LOWER}{UPPER}{INDEX}-]*\b"
    sumerogram = rf"\b[{UPPER}]{{2,}}[₀-₉]*(?:\.[{UPPER}]+[₀-₉]*)*\b"
    check(rows, features.proper_nouns("t"), lambda t: [x for x in re.findall(name, t) if not x.isupper()])
    check(rows, features.sumerograms("t"), lambda t: [x for x in re.findall(sumerogram, re.sub(r"\{[^}]+\}", "", t)) if len(x) >= 2])
    check(rows, features.determinatives("t"), lambda t: [x.strip("{}") for x in re.findall(r"\{[^}]+\}", t)])


def test_feature_goldens(spark):
    df = spark.createDataFrame([("a-na A-šùr-i-mì-tí",), ("DUMU Ṣí-lí-{d}UTU",), ("KÙ.BABBAR₂ GÍN x",)], "t string")
    got = [r[0] for r in df.select(features.all_features("t")).collect()]
    assert got[0]["proper_nouns"] == ["A-šùr-i-mì-tí"]
    assert got[1]["sumerograms"] == ["DUMU", "UTU"] and got[1]["determinatives"] == ["d"]
    assert got[2]["sumerograms"] == ["KÙ.BABBAR₂", "GÍN"]


def test_sentences_and_tokens(rows):
    check(rows, T.source_sentences("t"), lambda t: [x.strip() for x in t.split("\n") if x.strip()])
    check(rows, T.target_sentences("t"), lambda t: [x.strip() for x in re.split(r"[\n.]", t) if x.strip()])
    check(rows, T.tokens(T.text("t")), lambda t: [w.lower().strip(".,!?;:'\"()[]") for w in t.split()])


def test_prefix(spark):
    df = spark.createDataFrame([("abcdef", n) for n in (0, 2, 9, -1, -4, -9)], "t string, n int")
    assert [r[0] for r in df.select(T.prefix(F.col("t"), F.col("n"))).collect()] == ["abcdef"[:n] for n in (0, 2, 9, -1, -4, -9)]


def test_ocr(spark):
    given = {
        "12\n\nTHE ARCHIVE\n322  F  Journal of Notes\nText  of \t it  \nTHE END": "Text of it\nTHE END",
        "ŠA-RU\nx": "ŠA-RU\nx",
        "12\nABC": "",
        "  \n a ": "a",
        "": "",
        None: "",
    }
    got = spark.createDataFrame([(k,) for k in given], "t string").select("t", ocr.correct("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == given


def test_scores(spark):
    english = "The house of the son was sold and the silver was paid to him, as they said."
    german = "Die Tafel und der Brief von dem Schreiber sind nicht mit der Hand für den Sohn"
    akkadian = "a-na šu-mì KÙ.BABBAR ma-na i-ṣé-er [x x] DUMU"
    df = spark.createDataFrame([(english,), (german,), (akkadian,), ("the",), (None,)], "t string")
    e, n, a = zip(*[tuple(r) for r in df.select(scoring.english_score("t"), scoring.non_english_score("t"), scoring.akkadian_score("t")).collect()], strict=True)
    words = [w.strip(".,").lower() for w in english.split()]
    share = lambda x: sum(w in x for w in words) / len(words)
    assert e[0] == pytest.approx(min(2, 3 * share(fixed.ENGLISH) + 2 * share(fixed.TRADE)))
    assert n[1] > 5 > 1 > n[0] and a[2] > 3 and e[3] == n[3] == a[3] == e[4] == a[4] == 0
