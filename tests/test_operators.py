"""Core operators against brute force and hand-made rows."""

import difflib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletloom.operators import align, augment, context, dedup, lexicon, metrics, models, parse, sample, submit, vector
from tabletloom.sources import tables


def trigrams(t):
    k = "".join((t or "").lower().split()).translate(str.maketrans("", "", "!?."))
    return {k[i : i + 3] for i in range(len(k) - 2)}


def similar(a, b):
    x, y = trigrams(a), trigrams(b)
    return bool(x) and bool(y) and len(x & y) / len(x | y) >= 0.7


def some_texts(n, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh -", k=40)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        out.append("".join(t))
    return [*out, "", None, "ab", out[0]]


def test_near_dedup_is_the_sequential_one(spark):
    new, old = some_texts(120), some_texts(40, seed=2)[:40] + some_texts(120)[5:9]
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "row_id long, t string")
    for existing in (None, old):
        kept = []
        for i, t in enumerate(new):
            if not trigrams(t) or existing and any(similar(t, o) for o in existing):
                continue
            if not any(similar(t, new[k]) for k in kept):
                kept.append(i)
        got = dedup.near_dedup(rows(new), "t", rows(existing) if existing else None)
        assert sorted(r["row_id"] for r in got.collect()) == kept


def test_hot_element_is_cut_into_blocks(spark, monkeypatch):
    from tabletloom.operators import simjoin

    texts = [f"common text number {i:03d} of a long row" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    sets = dedup.trigram_sets(df, "t")
    whole = {tuple(r) for r in dedup.similar_sets(sets, None).collect()}
    monkeypatch.setattr(simjoin, "BLOCK", 7)
    assert {tuple(r) for r in dedup.similar_sets(sets, None).collect()} == whole
    ids = {r["sid"]: r["id"] for r in sets.collect()}
    expected = {frozenset((i, j)) for i in range(60) for j in range(i) if similar(texts[i], texts[j])}
    assert {frozenset((ids[a], ids[b])) for a, b in whole} == expected


@pytest.mark.parametrize("block", [20, 65_536])
def test_similar_sets_of_all_sizes(spark, monkeypatch, block):
    from tabletloom.operators import simjoin

    rng = random.Random(4)
    texts = ["abc", "abcd", "abcde", "abcdef", "x\U0010ffffy"]
    for size in [4, 9, 30, 70, 130, 140, 260, 290, 600, 2500]:
        base = "".join(rng.choices("abcdefghijklmnopqrst", k=size))
        for share in (0, 0.01, 0.04, 0.055, 0.06, 0.065, 0.07, 0.12):
            texts.append("".join(rng.choice("uvwxyz") if rng.random() < share else c for c in base))
        texts += [base[: int(size * share)] for share in (0.69, 0.7, 0.705, 0.71, 0.8)]
    texts = sorted(set(texts))
    monkeypatch.setattr(simjoin, "BLOCK", block)
    monkeypatch.setattr(simjoin, "TILE", 40)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    new, old = (dedup.trigram_sets(df.where(f"row_id % 3 {x} 0"), "t") for x in ("=", "<>"))
    ids = {r["sid"]: r["id"] for r in dedup.trigram_sets(df, "t").collect()}
    alike = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and similar(texts[i], texts[j])}
    got = [(ids[r["a"]], ids[r["b"]]) for r in dedup.similar_sets(new.union(old), None).collect()]
    assert len(alike) > 200 and len(got) == len(alike) / 2 and {*got, *((b, a) for a, b in got)} == alike
    got = [(ids[r["a"]], ids[r["b"]]) for r in dedup.similar_sets(new, old).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in alike if i % 3 == 0 and j % 3}


def test_existing_texts_of_few_syllables_do_not_meet_each_other(spark):
    """All share trigrams; compared among themselves, 40,000 existing texts are 800 million pairs."""
    import time

    rng = random.Random(5)
    syllables = [a + b for a in "bdgklmnprstz" for b in "aeiu"]
    texts = ["-".join(rng.choices(syllables, k=50)) for _ in range(40_000)]
    old = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    new = spark.createDataFrame([(1, texts[7][:-3]), (2, texts[8][::-1])], "row_id long, t string")
    dedup.existing_duplicates(new, old.limit(10), "t").collect()
    began = time.time()
    assert [r["id"] for r in dedup.existing_duplicates(new, old, "t").collect()] == [1]
    assert time.time() - began < 30


def test_trigram_sets_of_any_characters():
    from tabletloom.operators import flat

    rng = random.Random(2)
    for letters in ("abšṣ-", "ab\U00012000\U00012001", "\U0010ffff\uffff\U00010000a"):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(80)]
        sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
        code, row = flat.distinct(*flat.trigrams(*flat.flat(texts)))
        assert [int((row == k).sum()) for k in range(80)] == [len(s) for s in sets]
        got = flat.jaccard_of_pairs(texts[:40], texts[40:])
        assert got == pytest.approx([len(a & b) / max(1, len(a | b)) for a, b in zip(sets[:40], sets[40:], strict=True)])


def test_existing_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, t string")
    some = spark.createDataFrame([(1, "abcdef"), (2, "x")], "row_id long, t string")
    assert [r["id"] for r in dedup.existing_duplicates(some, empty, "t").collect()] == [2]
    assert dedup.near_dedup(empty, "t", some).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "row_id long, k string, p int")
    assert sorted(r["row_id"] for r in dedup.keep_first(df, ["k", "p"]).collect()) == [1, 2]


def test_align(spark):
    rows = [("a", "x y z\nabc def", "One two. Three four"), ("b", "x y z", "One. Two"), ("c", "ab\ncd", "ef.gh"), ("d", "x y z\nabc", "One two. Three"), (None, "abc", "def")]
    df = spark.createDataFrame(rows, "oare_id string, transliteration string, translation string")
    aid = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "oare_id string")
    got = sorted(((r["oare_id"] or "", r["pair_no"], r["transliteration"], r["translation"]) for r in align.align_corpus(df, aid).collect()))
    assert got == [("", 0, "abc", "def"), ("a", 0, "x y z", "One two"), ("a", 1, "abc def", "Three four"), ("b", 0, "x y z", "One. Two"), ("c", 0, "ab\ncd", "ef.gh"), ("d", 0, "x y z\nabc", "One two. Three")]


def test_segments_and_pairs(spark):
    tr = "a-na A-šùr-i-mì-tí qí-bi-ma um-ma Ṣí-lí DUMU KÙ.BABBAR ma-na i-ṣé-er i-šu li-mu-um ša ṣa-ru-pá-am iš-tù ḫa-mu-uš-tim GÍN IGI"
    en = "He owes ten minas of silver to the son of the merchant. They said that the interest is to be paid in the month of the harvest, and the witness was his brother."
    page = f"Preface\nText 1. BIN 4 61\n(Tablet) {tr}. {en} text 2: short. text"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no header. none"), (4, f"Text 9.\n{tr}: Der Sohn und die Tafel von dem Haus. Er ist der Vater mit dem Silber und nicht die Mutter von dem")], "row_id long, page_text string")
    seg = {r["row_id"]: r["s"] for r in df.select("row_id", parse.segments("page_text").alias("s")).collect()}
    assert seg[1][0] == "Preface" and seg[1][1].startswith("Text 1.") and seg[1][2] == "text 2: short. text"
    assert seg[2] == [""] and seg[3] == ["no header. none"]
    got = parse.extract_pairs(df).collect()
    assert [(r["row_id"], r["segment_no"]) for r in got] == [(1, 1)]
    assert got[0]["transliteration"] == tr + "." and got[0]["translation"] == en
    ends = df.where("row_id = 3").select(parse.candidate_ends(F.col("page_text"))).first()[0]
    assert ends == [11]


def test_pairs_are_deduplicated_in_the_order_of_pdfs_and_pages(spark):
    from tabletloom.plans import pipelines

    tr = "a-na A-šùr-i-mì-tí qí-bi-ma um-ma Ṣí-lí DUMU KÙ.BABBAR ma-na i-ṣé-er i-šu li-mu-um ša ṣa-ru-pá-am iš-tù ḫa-mu-uš-tim GÍN IGI"
    en = "He owes ten minas of silver to the son of the merchant. They said that the interest is to be paid in the month of the harvest, and the witness was his brother"
    other = "šu-ma lá iš-qul ú-ṣa-áb DUMU um-mì-a-nim ma-na KÙ.BABBAR i-na ITU.KAM ku-zal-li li-mu-um šu-da-a IGI En-um-a-šùr IGI Ḫa-nu ṣí-ib-tám"

    def page(*texts):
        return "\n".join(f"Text {k + 1}. BIN 4 {k}\n(Tablet) {t}. {en} ({k}) {'of the house ' * 3}" for k, t in enumerate(texts))

    changed = tr.replace("ša ṣa-ru", "ša ṣí-ru")
    rows = [
        (1, "b.pdf", 9, page(other), True), (2, "a.pdf", 2, page(changed), True), (3, "b.pdf", 3, page(tr), True), (4, "b.pdf", 3, page(other, tr), True),
        (5, "a.pdf", None, page("x" * 5), True), (6, "c.pdf", 1, page(tr), False), (7, "c.pdf", 1, page(other.replace("šu-ma", "šu-mì")), None), (8, "d.pdf", 1, None, True),
    ]
    publications = spark.createDataFrame(rows, "row_id long, pdf_name string, page int, page_text string, has_akkadian boolean")
    existing = spark.createDataFrame([("an old text", "its translation")], "transliteration string, translation string")
    got = pipelines.extract_publications(publications, existing).where("src = 1").collect()
    # b.pdf comes first by its first row, its page 3 before page 9; the changed copy in a.pdf is a duplicate
    assert sorted((r["source_pdf"], r["source_page"], r["transliteration"][:5]) for r in got) == [("b.pdf", 3, "a-na "), ("b.pdf", 9, "šu-ma")]
    allowed = spark.createDataFrame([("a.pdf",)], "value string")
    assert [(r["source_pdf"], r["source_page"]) for r in pipelines.extract_publications(publications, existing, allowed).where("src = 1").collect()] == [("a.pdf", 2)]


def test_gates_read_what_is_around_a_candidate_and_do_not_cut_it_again(spark):
    df = spark.createDataFrame([(1, "a: b")], "row_id long, segment string")
    plan = parse.first_splits(df, ["row_id"])._jdf.queryExecution().optimizedPlan().toString()
    gates = [x for x in plan.splitlines() if "Filter" in x]
    assert gates and not any("substring" in x for x in gates)


def test_many_golden_pages_are_parsed(spark):
    signs = "a-na A-šùr qí-bi-ma um-ma Ṣí-lí DUMU KÙ.BABBAR ma-na i-ṣé-er i-šu li-mu-um ṣa-ru-pá-am iš-tù ḫa-mu-uš-tim GÍN IGI ṣí-ib-tám ú-ṣa-áb".split()
    words = "he owes ten minas of silver to the son who was his brother and they said that the interest will be paid in the month from the house".split()
    rng, rows, expected = random.Random(9), [], []
    for i in range(40):
        text = ""
        for k in range(rng.randint(1, 4)):
            tr, en = " ".join(rng.choices(signs, k=30)), " ".join(rng.choices(words, k=40))
            kind = rng.random()
            if kind < 0.6:
                text += f"Text {k + 1}. BIN 4\n{tr}: {en}\n"
                expected.append((i, k, tr + ":", en))
            elif kind < 0.8:
                text += f"Text {k + 1}. {tr[:60]}: {en}\n"  # too short
            else:
                text += f"Text {k + 1}. {en}: {tr}\n"  # the wrong way round
        rows.append((i, text))
    got = parse.extract_pairs(spark.createDataFrame(rows, "row_id long, page_text string")).collect()
    assert len(expected) > 40
    assert sorted((r["row_id"], r["segment_no"], r["transliteration"], r["translation"]) for r in got) == sorted(expected)


def test_lexicon(spark):
    lex = spark.createDataFrame(
        [(1, "PN", "A-šùr", "Aššur", None), (2, "GN", "Kà-ni-iš", None, None), (3, "PN", "A-šùr", "Ashur", "lx"), (4, "word", "KÙ.BABBAR", "kaspum", "kaspum"), (5, "word", "DUMU", "mer'um", None), (6, "word", "ANŠE", None, "emārum"), (7, "PN", None, "x", "y")],
        "row_id long, type string, form string, norm string, lexeme string",
    )
    dic = spark.createDataFrame([(1, "kaspu I", '"silver"'), (2, "kaspu II", "money"), (3, "kaspu I", None), (4, "emāru", " ass "), (5, "w", "first"), (6, "w", "last"), (7, "w", "")], "row_id long, word string, definition string")
    names = {r["form"]: r for r in lexicon.proper_noun_table(lex).collect()}
    assert names["A-šùr"]["norm"] == "Ashur" and names["A-šùr"]["pos"] == 1 and names["A-šùr"]["lexeme"] == "lx"
    assert names["Kà-ni-iš"]["norm"] == names["Kà-ni-iš"]["lexeme"] == "Kà-ni-iš" and len(names) == 2
    assert {r["word"]: r["definition"] for r in lexicon.dictionary_table(dic).collect()} == {"kaspu I": '"silver"', "kaspu II": "money", "emāru": " ass ", "w": "last"}
    assert {r["base"]: r["definition"] for r in lexicon.base_table(dic).collect()} == {"kaspu": "silver", "emāru": "ass", "w": "first"}
    sg = lexicon.sumerogram_table(lex, dic)
    assert {r["form"]: r["definition"] for r in sg.collect()} == {"KÙ.BABBAR": "silver", "DUMU": "mer'um", "ANŠE": "ass"}
    terms = spark.createDataFrame([("KÙ.BABBAR",), ("D.UMU",), ("X",)], "form string")
    assert {r["form"]: r["definition"] for r in lexicon.lookup_sumerograms(terms, "form", sg).collect()} == {"KÙ.BABBAR": "silver", "D.UMU": "mer'um", "X": None}
    df = spark.createDataFrame([(1, "a-na A-šùr ù Ka-ni-iš KÙ.BABBAR"), (2, "x"), (3, None)], "row_id long, transliteration string")
    ctx = {r["row_id"]: r["context"] for r in lexicon.query_context(df, lexicon.proper_noun_table(lex), sg).collect()}
    assert ctx == {1: "Ashur Kà-ni-iš silver", 2: "x", 3: ""}
    section = {r["row_id"]: r["lexicon"] for r in context.lexicon_section(df, lexicon.proper_noun_table(lex), sg).collect()}
    assert section == {1: "Lexicon:\n- A-šùr = Ashur (PN)\n- Kà-ni-iš = Kà-ni-iš (GN)\n- KÙ.BABBAR = silver"}
    assert lexicon.lexicon_stats(lex, dic).first().asDict() == {"proper_nouns": 2, "sumerograms": 3, "dictionary": 4}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_fuzzy_lookup_is_the_argmax(spark, monkeypatch, limit):
    rng = random.Random(4)
    forms = list(dict.fromkeys("".join(rng.choices("AbBcd-", k=rng.randint(3, 9))) for _ in range(60)))
    terms = ["".join(rng.choices("AbBcd-", k=rng.randint(3, 9))) for _ in range(60)] + [forms[3], forms[5] + "c"]
    monkeypatch.setattr(lexicon, "BROADCAST_ROWS", limit)
    names = spark.createDataFrame([(f, f, f, "PN", i) for i, f in enumerate(forms)], "form string, norm string, lexeme string, type string, pos long")
    got = {r["term"]: (r["form"], r["similarity"]) for r in lexicon.fuzzy_matches(spark.createDataFrame([(t,) for t in terms], "t string"), "t", names).collect()}
    for t in set(terms):
        if t in forms:
            expected = (t, 1.0)
        else:
            best = max(((difflib.SequenceMatcher(None, t.lower(), f.lower()).ratio(), -i) for i, f in enumerate(forms)))
            expected = (forms[-best[1]], best[0]) if best[0] >= 0.8 else None
        assert got.get(t) == expected, t


def test_knn(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype("float32")
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0 or vec_id = 7")
    got = {}
    for r in vector.search(q, df, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in got:
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1).round(9)
        assert [got[i][k] for k in (1, 2, 3, 4)] == sorted(range(300), key=lambda j: (d[j], j))[:4]
    index, centers = vector.build_ivf(df)
    every = {(r["query_id"], r["rank"]): r["id"] for r in vector.search_ivf(q, index, centers, 4, nprobe=len(centers)).collect()}
    assert every == {(i, k): v for i, x_ in got.items() for k, v in x_.items()}
    some = {(r["query_id"], r["id"]) for r in vector.search_ivf(q, index, centers, 4, nprobe=12).collect()}
    assert sum((i, v) in some for i, x_ in got.items() for v in x_.values()) >= 0.9 * 4 * len(got)
    with pytest.raises(ValueError):
        vector.check_dimension(df.union(spark.createDataFrame([(1, [1.0])], df.schema)))
    with pytest.raises(ValueError):
        vector.index_kind(5, "tree")
    assert vector.index_kind(99_999) == "flat" and vector.index_kind(100_000) == "ivf"
    assert all(r["query_id"] != r["id"] for r in vector.search(q, df, 3, exclude_self=True).collect())


def brute_bleu(pairs):
    m, t = [0] * 4, [0] * 4
    hl = rl = 0
    for h, r in pairs:
        h, r = h.split(), r.split()
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            m[n - 1] += sum((a & b).values())
            t[n - 1] += sum(a.values())
    bp = 1 if hl >= rl else math.exp(1 - rl / hl)
    return 100 * bp * math.exp(sum(math.log(x / y) for x, y in zip(m, t, strict=True)) / 4)


def test_metrics(spark):
    pairs = [("the cat sat on the mat today", "the cat sat on a mat"), ("he gave ten minas of silver", "he gave two minas of silver now"), ("", "nothing here")]
    df = spark.createDataFrame([(h, r, "Ka-ni-iš ù DUMU") for h, r in pairs], "h string, r string, s string")
    assert metrics.bleu(df, "h", ["r"]).first()["bleu"] == pytest.approx(brute_bleu(pairs), abs=1e-5)
    same = metrics.all_metrics(df, "r", "r", "s").first()
    assert same["bleu"] == pytest.approx(100) and same["chrf"] == pytest.approx(100) and same["geometric_mean"] == pytest.approx(100)
    assert same["total_proper_nouns"] == 3 and same["correct_in_hypothesis"] == 0
    two = spark.createDataFrame([("a b c d e", "a b x", "c d e f")], "h string, r string, q string")
    assert metrics.bleu(two, "h", ["r", "q"]).first()["p1"] == pytest.approx(100)
    none = metrics.bleu(spark.createDataFrame([("x", "y")], "h string, r string"), "h", ["r"]).first()
    assert none["bleu"] == 0
    assert [r[0] for r in spark.createDataFrame([("Pay 1,000.5 now, (twice)-3 -4 &quot;x&quot;.",)], "t string").select(F.array_join(metrics.tokens_13a(F.col("t")), " ")).collect()] == ['Pay 1,000.5 now , ( twice ) -3 -4 " x " .']
    assert metrics.all_metrics(df.limit(0), "h", "r", "s").first()["bleu"] == 0


def test_chrf_by_hand(spark):
    got = metrics.chrf(spark.createDataFrame([("ab c", "abd")], "h string, r string"), "h", "r").first()["chrf"]
    p = r = (2 / 3 + 1 / 2 + 0) / 3
    assert got == pytest.approx(100 * 5 * p * r / (4 * p + r), abs=1e-5)


def test_split_and_samples(spark):
    assert sample.split_sizes(1589, 0.1, 0.1) == (1271, 159, 159)
    df = spark.range(997).withColumnRenamed("id", "row_id")
    out = sample.random_split(df)
    n = Counter(r["split"] for r in out.collect())
    assert (n["train"], n["val"], n["test"]) == sample.split_sizes(997, 0.1, 0.1)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in sample.random_split(df.repartition(7)).collect()}
    assert sample.random_split(df.limit(0)).count() == 0
    assert sample.sample_rows(df, 10).count() == 10
    g = df.select("row_id", (F.col("row_id") % 5).alias("g"))
    assert sample.sample_groups(g, "g", 2).select("g").distinct().count() == 2
    assert sample.sample_groups(g, "g", 50).count() == 997
    assert sample.training_steps(101, 8, 2, 3) == 21


def test_augment(spark):
    text = "a-na KÙ.BABBAR Ka-ni-iš šu-ma ù i-na li-bi"
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(60, None), (61, "a b")], "row_id long, transliteration string")
    got = augment.augment(df, factor=2, gap_prob=0.5).collect()
    assert len(got) == 62 * 3
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, augment.augment(df.repartition(3), factor=2, gap_prob=0.5).collect()), key=str)
    changed = 0
    for r in got:
        if r["copy"] == 0 or r["row_id"] >= 60:
            assert r["transliteration"] == {60: None, 61: "a b"}.get(r["row_id"], text)
        else:
            words = r["transliteration"].split()
            changed += r["transliteration"] != text
            assert words[0] == "a-na" and sum(w in ("<gap>", "<big_gap>") for w in words) <= 3
    assert 30 < changed < 90


def test_assemble(spark):
    def expected(parts, budget, last=True):
        parts = [p for p in parts if p]
        whole = "\n\n".join(parts)
        if len(whole) <= budget:
            return whole
        if len(parts) == 1:
            return whole[:budget]
        rest = budget - len(parts[-1]) - 4
        if len(parts) == 2:
            return f"{parts[0][:rest]}\n\n{parts[-1]}"
        return f"{parts[0][: rest // 2]}\n\n{parts[1][: rest // 2]}\n\n{parts[-1]}"

    cases = [("L" * a, "E" * b, "s" * c) for a in (0, 5, 60) for b in (0, 7, 60) for c in (0, 3, 50, 90)] + [(None, None, None)]
    df = spark.createDataFrame(cases, "l string, e string, s string")
    for r in df.select("*", context.assemble(F.col("l"), F.col("e"), F.col("s"), 60).alias("p"), context.assemble(F.col("l"), F.col("e"), None, 60).alias("q")).collect():
        assert r["p"] == expected([r["l"], r["e"], f"Translate: {r['s'] or ''}"], 60)
        assert r["q"] == expected([r["l"], r["e"]], 60)
    hits = spark.createDataFrame([(1, 2, "b", "y" * 200), (1, 1, "a" * 90, "x")], "query_id long, rank int, transliteration string, translation string")
    assert context.examples_section(hits).first()["examples"] == f"Similar translations:\n[1] {'a' * 80} → x\n[2] b → {'y' * 100}"


def test_submission(spark):
    test = spark.createDataFrame([(i * 3,) for i in range(50)], "id long").repartition(5)
    pred = spark.createDataFrame([(i, None if i == 4 else f"p{i}") for i in range(50)], "row_id long, prediction string").repartition(3)
    assert {r["id"]: r["translation"] for r in submit.zip_predictions(test, pred).collect()} == {i * 3: "" if i == 4 else f"p{i}" for i in range(50)}
    with pytest.raises(ValueError):
        submit.zip_predictions(test.limit(3), pred)
    bad = spark.createDataFrame([("1", None), ("x", "t"), (None, "t")], "id string, translation string")
    r = submit.validate_submission(bad).first()
    assert (r["n_rows"], r["valid"], r["null_ids"], r["null_texts"], r["non_integer_ids"]) == (3, False, 1, 1, 1)
    assert submit.validate_submission(bad.drop("id")).first()["missing_columns"] == "id"


def test_submission_is_written(spark, tmp_path):
    test = spark.createDataFrame([(5,), (3,)], "id long")
    pred = spark.createDataFrame([(1, "a"), (2, None)], "row_id long, prediction string")
    assert submit.write_submission(test, pred, str(tmp_path / "s.csv")).first()["valid"]
    back = tables.read_csv(spark, str(tmp_path / "s.csv"), "id long, translation string").collect()
    assert {r["id"]: r["translation"] or "" for r in back} == {3: "a", 5: ""}
    with pytest.raises(ValueError):
        submit.write_submission(test.select(F.lit(None).cast("long").alias("id"), F.col("id").alias("k")), pred, str(tmp_path / "t.csv"), "k")


def test_index_is_chosen_saved_and_searched_again(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)).astype("float32"))], "vec_id long, embedding array<float>")
    flat_, cells = vector.Index(df), vector.Index(df, "ivf")
    assert flat_.kind == "flat" and flat_.stats().first()["n_vectors"] == 200 and cells.stats().first()["cells"] == 14
    q = df.where("vec_id < 5")
    rows = lambda d: {(r["query_id"], r["rank"], r["id"]) for r in d.collect()}
    tables.write_index(cells.vectors, cells.centers, str(tmp_path / "ivf"))
    again, centers = tables.read_index(spark, str(tmp_path / "ivf"))
    assert rows(vector.search_ivf(q, again, centers, 3, nprobe=4)) == rows(cells.search(q, 3, nprobe=4))
    assert rows(cells.search(q, 3, nprobe=14)) == rows(flat_.search(q, 3))
    assert vector.entry_at(df, 3, "vec_id").first()["vec_id"] == 3
    for wrong in (-1, 200):
        with pytest.raises(ValueError):
            vector.entry_at(df, wrong, "vec_id")


def test_retrieval_prompts_and_training_rows(spark):
    from tabletloom.plans import pipelines

    corpus = spark.createDataFrame([(1, "a-na A-šùr KÙ.BABBAR", "to Ashur silver"), (2, "ṭup-pá-am ú-ša-bi-lá-ku-um", "I sent you a tablet"), (3, "i-na Kà-ni-iš", "in Kanesh")], "row_id long, transliteration string, translation string")
    lex = spark.createDataFrame([(1, "PN", "A-šùr", "Aššur", None), (2, "word", "KÙ.BABBAR", "kaspum", None)], "row_id long, type string, form string, norm string, lexeme string")
    dic = spark.createDataFrame([], "row_id long, word string, definition string")
    names, table = lexicon.proper_noun_table(lex), lexicon.sumerogram_table(lex, dic)
    embedder = lambda: models.hashed_vectors
    index = vector.Index(models.embed(corpus, "transliteration", embedder).select("row_id", "embedding"), id_column="row_id")
    hits = pipelines.retrieve(corpus, index, corpus, embedder, k=2)
    assert {r["query_id"]: r["id"] for r in hits.where("rank = 1").collect()} == {1: 1, 2: 2, 3: 3} and hits.count() == 6
    # the context of names and Sumerograms stands for the text
    some = pipelines.retrieve(corpus.where("row_id = 2"), index, corpus, embedder, names, table, k=1).first()
    assert (some["id"], some["translation"]) == (2, "I sent you a tablet")
    with pytest.raises(ValueError):
        pipelines.retrieve(corpus, index, corpus.limit(2), embedder)
    prompt = {r["row_id"]: r["prompt"] for r in context.assemble_all(corpus, names, table, hits.where("rank = 1")).collect()}
    assert prompt[1] == "Lexicon:\n- A-šùr = Aššur (PN)\n- KÙ.BABBAR = kaspum\n\nSimilar translations:\n[1] a-na A-šùr KÙ.BABBAR → to Ashur silver\n\nTranslate: a-na A-šùr KÙ.BABBAR"
    assert prompt[3].startswith("Similar") and prompt[3].endswith("Translate: i-na Kà-ni-iš")
    rows = pipelines.prepare_training(corpus, names, table, hits.where("rank = 1"), factor=2, gap_prob=0.0).collect()
    assert len(rows) == 9 and {r["prompt"] for r in rows if r["row_id"] == 1} == {prompt[1]}
    assert all(r["target_ids"] == [b + 3 for b in r["target"].encode()] + [1] for r in rows)
    score = pipelines.evaluate(corpus, lambda: lambda x: {t: t for t in x} and ["to Ashur silver"] * len(x)).first()
    assert score["hyp_len"] == 9 and score["total_proper_nouns"] == 2


def test_renumbered(spark):
    df = spark.createDataFrame([(5,), (2,), (9,)], "row_id long")
    assert {r["row_id"]: r["row_no"] for r in dedup.numbered(df).collect()} == {2: 0, 5: 1, 9: 2}


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tabletloom import session

    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, setCheckpointDir=lambda p: None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_models(spark):
    df = spark.createDataFrame([(1, "aš"), (2, None)], "row_id long, t string")
    assert [r[0] for r in df.select(models.byte_ids("t")).collect()] == [[b + 3 for b in "aš".encode()] + [1], [1]]
    assert [len(r[0]) for r in spark.createDataFrame([("x" * 600,)], "t string").select(models.byte_ids("t", 512)).collect()] == [512]
    got = models.embed(df, "t", lambda: lambda x: [[float(len(t))] for t in x]).collect()
    assert [r["embedding"] for r in got] == [[2.0], [0.0]]
    assert [r["prediction"] for r in models.predict(df, "t", lambda: lambda x: [t.upper() for t in x]).collect()] == ["AŠ", ""]
    tries = []
    assert models.retry(lambda: tries.append(1) or (1 if len(tries) > 2 else 1 / 0), sleep=lambda s: None) == 1
    with pytest.raises(ZeroDivisionError):
        models.retry(lambda: 1 / 0, sleep=lambda s: None)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nline', "NA"), (2, "", None)], "id long, t string, u string")
    path = str(tmp_path / "x.csv")
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path, "id long, t string, u string", ["id"])
    assert back.where("id = 1").first()["t"] == 'a "q"\nline' and back.where("id = 1").first()["u"] == "NA"
    assert tables.read_csv(spark, path, "id long, t string, u string", pandas_na=True).where("id = 1").first()["u"] is None
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.read_csv(spark, path, required=["zz"])
    (tmp_path / "list.txt").write_text("a.pdf\n\n# no\n  b.pdf \n")
    assert [r[0] for r in tables.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.pdf", "b.pdf"]
    tables.write_json({"š": 1}, str(tmp_path / "d" / "m.json"))
    assert tables.read_json(str(tmp_path / "d" / "m.json")) == {"š": 1}
    assert [r["row_id"] for r in tables.with_row_ids(df).collect()] == [0, 1]
    with pytest.raises(ValueError):
        tables.write_vectors(df, str(tmp_path / "v.npy"))


def test_stream(spark, tmp_path):
    from tabletloom.streaming import files

    df = spark.createDataFrame([(1, "a-na A-šùr [x]!"), (2, None)], "row_id long, transliteration string")
    df.write.parquet(str(tmp_path / "in"))
    q = files.normalized(files.read_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("norm").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["transliteration"] for r in spark.table("norm").collect()} == {"a-na A-šùr <gap>", ""}
