"""Problems 4, 5, 7, 8, 9 and 10: round trips, brute force, held-out accuracy, and odd cases."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabletloom.llm import abuse, bitext, chunks, ocr_repair, packing, perceptron
from tabletloom.llm import tokens as tok

# --- problem 4 ---

SENTENCES = [
    "the merchant received the silver in the month of the harvest",
    "several passages in this archive concern the transport of copper",
    "the so-called old letters were found near the garden and the house",
    "witnesses confirmed that the payment was expected before the winter",
    "the handwriting resembles that of the other tablets of the house",
    "household expenses included barley and the wages of the servants",
]


def invented(rng):
    """Words of a richer vocabulary."""
    return ["".join(rng.choices(("mer", "tan", "so", "les", "cor", "in", "de", "mos", "ten", "ran"), k=rng.randint(3, 4))) for _ in range(150)]


def pages(seed=1, n=240):
    """Pages with known defects: (text, set of (line, defect))."""
    rng = random.Random(seed)
    more = invented(rng)
    out = []
    for p in range(n):
        words = [w for s in rng.choices(SENTENCES, k=5) for w in (*s.split(), *rng.choices(more, k=6))]
        lines, defects = [], set()
        if p % 2:
            lines.append(f"{p}  Caravan Letters")
            defects.add((1, "furniture"))
        line = ""
        while words:
            w = words.pop(0)
            if "-" not in w and len(w) > 5 and rng.random() < 0.02:
                for a, b in rng.sample((("t", "f"), ("s", "5"), ("o", "0"), ("m", "rn"), ("n", "ii"), ("e", "c")), 6):
                    if a in w:
                        w = w.replace(a, b, 1)
                        defects.add((len(lines) + 1, "glyph"))
                        break
            if len(line) + len(w) > 60:
                if len(w) > 7 and "-" not in w and w.isalpha() and rng.random() < 0.7 and (len(lines) + 1, "glyph") not in defects:
                    lines.append(f"{line} {w[:4]}-")
                    defects.add((len(lines), "hyphen"))
                    line = w[4:]
                    continue
                if (len(lines) + 1, "glyph") in defects and w not in " ".join((*SENTENCES, *more)):
                    defects.discard((len(lines) + 1, "glyph"))
                    defects.add((len(lines) + 2, "glyph"))
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        lines.append(line)
        if p % 3 == 0:
            lines += ["", f"- {p} -"]
            defects.add((len(lines), "furniture"))
        out.append(("\n".join(lines), defects))
    return out


def test_defects_of_known_pages(spark):
    given_ = pages()
    rows = [(i, t, "x") for i, (t, _) in enumerate(given_)] + [(900, None, ""), (901, "", ""), (902, "  \n ", ""), (None, "some text\nhere", ""), (903, "w" * 100_000, "")]
    df = spark.createDataFrame(rows, "row_id long, page_text string, word string")
    got = {(r["row_id"], r["line_no"], r["defect"]) for r in ocr_repair.defects(df).collect() if r["row_id"] is not None and r["row_id"] < 900}
    expected = {(i, k, d) for i, (_, ds) in enumerate(given_) for k, d in ds}
    for kind in ("furniture", "hyphen", "glyph"):
        g, e = ({x for x in s if x[2] == kind} for s in (got, expected))
        assert len(g & e) >= 0.95 * len(e) and len(g & e) >= 0.95 * len(g), (kind, len(g), len(e), len(g & e))
    text = {r["row_id"]: r["text"] for r in ocr_repair.paragraphs(df).collect() if r["paragraph_no"] == 1}
    assert "Caravan" not in " ".join(v for k, v in text.items() if k is not None and k < 900)
    assert 900 not in text and 901 not in text
    assert ocr_repair.defects(df.limit(0)).count() == 0
    assert ocr_repair.paragraphs(df.limit(0)).count() == 0


def test_short_and_long_words_are_repaired(spark):
    rng = random.Random(4)
    long = "šumma-awīlum-" * 6 + "ana"
    texts = [t for t, _ in pages()]
    bad = {7: "§a", 20: "ſa", 33: "5a", 46: long.replace("š", "5", 1), 59: "l9"}
    signs = ["iš-ma", "še-um", "uš-ba-al", "aš-šur", "la-áš"]  # words that show the operations
    shown = {60 + 5 * k + i: w.replace("š", s, 1) for k, s in enumerate("§ſ5") for i, w in enumerate(signs)}
    rows = []
    for i, t in enumerate(texts):
        w = bad.get(i, "ša" if i % 4 else long)
        rows.append((i, f"{t}\nthe merchant {w} {rng.choice(('house', 'garden'))} {shown.get(i, signs[i % 5])} received silver"))
    endless = "la-áš-" * 100 + "la-á§-" + "la-áš-" * 100
    rows += [(900, f"the merchant {endless}ma received"), (901, "c5b§" * 25_000), (902, f"silver {'c' * 100_000}")]
    df = spark.createDataFrame(rows, "row_id long, page_text string")
    got = {(r["row_id"], r["word"], r["right"]) for r in ocr_repair.defects(df).where("defect = 'glyph'").collect()}
    assert {(7, "§a", "ša"), (20, "ſa", "ša"), (33, "5a", "ša"), (46, bad[46], long)} <= got
    assert not [g for g in got if g[1] in ("l9", "ša", long)]
    assert (900, f"{endless}ma", f"{endless.replace('§', 'š')}ma") in got


def test_operations_are_learned_from_words():
    frequent = {w: 100 for w in ("merchant", "tablets", "silver", "market", "month", "garden", "ītēpuš", "balance", "of", "off")}
    rare = {"merchaiit": 1, "tableis": 2, "monfh": 1, "gardeii": 1, "balaiice": 1, "markef": 1, "merchanf": 3, "itēpuš": 1, "ītepuš": 1, "itepuš": 2}
    assert ocr_repair.learn_operations(rare, frequent) == [("f", "t"), ("ii", "n")]
    assert ocr_repair.learn_operations({}, frequent) == []


def misread_words(times):
    """{word: n}, {misread: right} of a collection in which every misreading has been seen ``times`` times or more."""
    rng = random.Random(3)
    words, right = {}, {}
    for w in sorted({*" ".join(SENTENCES).split(), *invented(rng), *invented(rng)}):
        words[w] = 300 * times
        for read, written in (("f", "t"), ("5", "s"), ("0", "o"), ("rn", "m"), ("ii", "n"), ("c", "e"), ("6", "b"), ("vv", "w")):
            if written in w and (x := w.replace(written, read, 1)) not in words:
                words[x] = times
                right[x] = w
    return {"If": 280 * times, "It": 700 * times} | words, right


@pytest.mark.parametrize("times", [1, 4, 2_000])
def test_misreadings_are_found_however_often_they_occur(spark, times):
    words, right = misread_words(times)
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = {r["word"]: r["right"] for r in ocr_repair.corrections(df, df.select("word").limit(0)).collect()}
    assert len(got.keys() & right.keys()) >= 0.99 * len(right)
    assert len([w for w in got if w not in right]) == 0


def test_operations_of_a_table_are_those_of_the_plain_way(spark):
    words, _ = misread_words(1)
    words |= {w + "s": 2 for w in list(words)[:40]} | {"Silver": 3, "The": 2, "§": 1, "a": 900, "": 5}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    assert ocr_repair.operations_of(df) == ocr_repair.learn_operations(words, {w: n for w, n in words.items() if n >= 3 * ocr_repair.KNOWN})


def test_text_lines_that_recur_are_no_headers(spark):
    rows = []
    for p in range(60):
        lines = ["Word " + "abcdefghijkl"[k] * (p + 2) for k in range(12)]
        lines[0 if p % 20 < 9 else 5] = "Partners sometimes dissolved their association"  # at the edge on 27 of 60 pages
        if p < 17:
            lines[11 if p < 9 else 6] = "None of the remaining documents explains"  # on 9 of 17, by chance
        rows.append((p, "\n".join(["Caravan Letters", *lines])))
    df = spark.createDataFrame(rows, "row_id long, text string").select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    marks = ocr_repair.recurring_lines(df).select(F.explode("marks").alias("m")).select("m.at").collect()
    assert {r["at"] for r in marks} == {0} and len(marks) == 60


def test_lines_of_a_page_loaded_often_do_not_recur(spark):
    rows = [(p, f"Caravan Letters\nWord {'ab'[p % 2] * (p % 6 + 2)}\nThe end of {'cd'[p % 2] * (p % 6 + 2)}") for p in range(60)]  # six pages, ten times each
    df = spark.createDataFrame(rows, "row_id long, text string").select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    marks = ocr_repair.recurring_lines(df).select(F.explode("marks").alias("m")).select("m.at").collect()
    assert [r["at"] for r in marks] == [0] * 6


def test_all_words_count_for_operations_and_editor(spark, monkeypatch):
    monkeypatch.setattr(ocr_repair, "SEEDS", 5)  # no bound on the words
    words, right = misread_words(2)
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = {r["word"] for r in ocr_repair.corrections(df, df.select("word").limit(0)).collect()}
    assert len(got & right.keys()) >= 0.99 * len(right) and got <= right.keys()


def test_seeds_of_lines_and_line_ends_come_from_all_pages(spark):
    rows = [(i, f"The silver of the house {'x' * (i % 7)}\nreceived by them", []) for i in range(3_000)]
    rows += [(3_000 + i, f"The silver of the garden\nNOTES ON THE TOWN {i}", [{"at": 1, "how": "often"}]) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, text string, marks array<struct<at:int,how:string>>")
    decide = ocr_repair.train_furniture(df)
    assert decide.of_page(rows[-1][1].split("\n"), {1: "often"}) == {1} and decide.of_page(rows[0][1].split("\n"), {}) == set()
    ends = [("-", "re", "port", False, 9, 0)] * 20_000 + [("-", "Ṣe-lu", "lu", True, 0, 9)]
    df = spark.createDataFrame(ends, "mark string, first string, word string, dense boolean, nj long, nh long")
    df = df.select("*", F.monotonically_increasing_id().alias("row_id"), F.lit(1).alias("line_no"))
    joins = ocr_repair.train_joins(df)
    assert [joins.best(ocr_repair.join_options(*x)) for x in ends[-2:]] == [0, 1]


def test_a_perceptron_of_many_shards_learns_from_all(spark, monkeypatch):
    monkeypatch.setattr(perceptron, "SHARD", 40)
    rng = random.Random(2)
    rows = [(i, *(rng.randrange(4) for _ in range(3))) for i in range(400)] + [(400, 9, 0, 0)]

    def examples(batch):
        for r in batch.to_pylist():
            f = [f"{c}={r[c]}" for c in "abc"]
            yield [("no", f), ("yes", f)], int(r["a"] + r["b"] > 3)

    df = spark.createDataFrame(rows, "id long, a int, b int, c int")
    got = [perceptron.fit(x, "id", examples, epochs=8) for x in (df, df.repartition(7, "a").orderBy(F.desc("id")))]
    assert got[0].weights == got[1].weights
    cases = [x for batch in df.toArrow().to_batches() for x in examples(batch)]
    assert sum(got[0].best(o) == r for o, r in cases) >= 0.98 * len(cases) and got[0].best(cases[-1][0]) == 1
    assert perceptron.fit(df.limit(0), "id", examples).weights == {}


def test_examples_in_proportion():
    assert perceptron.in_proportion([(("a",), 900_000), (("b",), 99_999), (("c",), 1)], 10) == [("a",)] * 9 + [("b",), ("c",)]
    assert perceptron.in_proportion([], 10) == []


def test_rebuild_keeps_sign_joints():
    page = "1\nThe re-\nport of Ṣe-\nlu-lu and tbe end\n\nnext"
    found = [{"line_no": 1, "defect": "furniture"}, {"line_no": 2, "defect": "hyphen"}, {"line_no": 4, "defect": "glyph", "word": "tbe", "right": "the"}]
    assert ocr_repair.rebuild(page, found) == ["The report of Ṣe-lu-lu and the end", "next"]


def test_perceptron_learns_and_keeps_first_of_equals():
    examples = [([("a", [f"x={k % 2}"]), ("b", [f"x={k % 2}"])], k % 2) for k in range(40)]
    m = perceptron.Perceptron.train(examples)
    assert all(m.best(o) == r for o, r in examples)
    assert perceptron.Perceptron().best([("a", ["f"]), ("b", ["f"])]) == 0


# --- problem 5 ---


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.-é́!", max_size=400), st.integers(5, 60), st.data())
def test_pieces_cover_and_overlap(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    p = chunks.pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= limit for a, b in p)
    assert all(q[0] == max(0, r[1] - overlap) and q[1] > r[1] for r, q in zip(p, p[1:]))
    assert len(p) == 1 or len(text) > limit


def test_cuts_prefer_strong_boundaries():
    text = "one two three.\n\nfour five six. seven eight"
    assert [text[a:b] for a, b in chunks.pieces(text, 20, 0)] == ["one two three.\n\n", "four five six. ", "seven eight"]
    assert chunks.pieces("x" * 25, 10, 3) == [(0, 7), (4, 14), (11, 21), (18, 25)] or all(b - a <= 10 for a, b in chunks.pieces("x" * 25, 10, 3))
    with pytest.raises(ValueError):
        chunks.pieces("abc", 5, 5)


def test_split_texts(spark):
    df = spark.createDataFrame([(1, "ab " * 900, None, "q"), (2, "", "x", "q"), (3, None, None, "q"), (None, "y", "z" * 2001, "q"), (1, "ab " * 900, None, "q")], "row_id long, transliteration string, translation string, piece string")
    out = chunks.split_texts(df, {"transliteration": 1000, "translation": 2000}, 100).collect()
    by = defaultdict(list)
    for r in out:
        by[r["row_id"], r["field"]].append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, "transliteration"): 6, (2, "transliteration"): 1, (2, "translation"): 1, (None, "transliteration"): 1, (None, "translation"): 2}
    assert all(r["n_chars"] == len(r["piece"]) for r in out)
    assert chunks.split_texts(df.limit(0), {"transliteration": 10}, 1).count() == 0


# --- problem 7 ---


def documents(n=150, seed=3):
    rng = random.Random(seed)
    things = {f"s{w}-um": w for w in ("silver", "copper", "wheat", "wool", "tin", "donkey", "house", "tablet", "oil", "bread")}
    acts = {f"i-{w[:3]}": w for w in ("sold", "bought", "carried", "sealed", "counted", "claimed")}
    names = ["Ka-ni-iš", "Pu-šu-ken", "A-šur-ma-lik", "La-ma-si", "I-di-su-en", "Šu-bi-lum", "Bu-za-zu", "Im-di-lum"]
    rows = []
    for r in range(n):
        src, tgt, links = [], [], set()
        for _ in range(rng.randint(3, 7)):
            a, t, x = rng.choice(names), rng.choice(list(things)), rng.choice(list(acts))
            k = rng.randint(2, 60)
            src.append(f"{a} {k} {t} {x}")
            roll = rng.random()
            if roll < 0.12:
                continue  # left out
            s = f"{a.replace('-', '')} {acts[x]} {k} pieces of {things[t]}"
            if tgt and roll < 0.25:
                tgt[-1] += f"; {s}"  # run together
            else:
                tgt.append(s)
            links.add((len(src), len(tgt)))
        if rng.random() < 0.2 and len(tgt) > 2:  # moved
            tgt[0], tgt[-1] = tgt[-1], tgt[0]
            swap = {1: len(tgt), len(tgt): 1}
            links = {(i, swap.get(j, j)) for i, j in links}
        rows.append((r, "\n".join(src), ". ".join(tgt) + ".", links))
    return rows


def test_alignment_of_known_documents(spark):
    rows = documents()
    extra = [(900, None, "x."), (901, "", ""), (902, "Ka-ni-iš", None), (903, "\n \n", ". ."), (904, "Ka-ni-iš " * 3000, "Kaniš sold. " * 400)]
    df = spark.createDataFrame([(*r[:3], "x") for r in rows] + [(*e, "x") for e in extra], "row_id long, transliteration string, translation string, src string")
    got = {(r["row_id"], r["src_no"], r["tgt_no"]) for r in bitext.align(df).collect()}
    expected = {(r[0], i, j) for r in rows for i, j in r[3]}
    mine = {g for g in got if g[0] < 900}
    assert len(mine & expected) >= 0.93 * len(expected) and len(mine & expected) >= 0.93 * len(mine)
    assert not {g[0] for g in got} & {900, 901, 902, 903}
    assert bitext.align(df.limit(0)).count() == 0


def test_repeated_lines_of_long_documents_keep_their_partners():
    n = 101
    score = np.zeros((1, n, n))
    score[0, 1::2, 1::2] = 0.6  # a formula on every other line
    score[0, np.arange(0, n, 2), np.arange(0, n, 2)] = 0.9
    found = bitext.links(score, score, np.array([n]), np.array([n]))
    assert (found[0] == np.eye(n, dtype=bool)).all()


def test_moved_lines_are_found_by_further_passes():
    order = [5, 1, 2, 0, 4, 3, 7, 6]
    score = np.zeros((1, 8, 9))
    score[0, np.arange(8), order] = 0.8
    score[0, 2, 8] = 0.7  # a second sentence of one line, far away
    found = bitext.links(score, score, np.array([8]), np.array([9]))
    assert {tuple(x) for x in np.argwhere(found[0]).tolist()} == {*enumerate(order), (2, 8)}


def test_alignment_in_order_is_the_best():
    def best_total(x):
        best = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        for i in range(1, x.shape[0] + 1):
            for j in range(1, x.shape[1] + 1):
                v = x[i - 1, j - 1]
                best[i, j] = max(best[i - 1, j - 1] + v, best[i - 1, j] + max(0, 0.9 * v), best[i, j - 1] + max(0, 0.9 * v))
        return best[-1, -1]

    rng = np.random.default_rng(2)
    n, m = rng.integers(1, 25, 100), rng.integers(1, 25, 100)
    score = np.full((100, n.max(), m.max()), -1.0)
    for d in range(100):
        score[d, : n[d], : m[d]] = rng.random((n[d], m[d])).round(1) - 0.5
    on = bitext.in_order(score, n, m)
    for d in range(100):
        assert not on[d, n[d] :].any() and not on[d, :, m[d] :].any()
        total, last = 0.0, (-1, -1)
        for i, j in np.argwhere(on[d]).tolist():
            assert i >= last[0] and j >= last[1]
            total += score[d, i, j] * (0.9 if i == last[0] or j == last[1] else 1)
            last = (i, j)
        assert total >= best_total(score[d, : n[d], : m[d]]) - 1e-6


def test_length_beads_are_the_cheapest():
    def best_total(a, b):
        ratio = min(5.0, max(0.2, (sum(b) + 1) / (sum(a) + 1)))
        cost = lambda x, y: abs(x * ratio - y) / (3.0 * ((x * ratio + y) / 2 + 1) ** 0.5)
        best = np.full((len(a) + 1, len(b) + 1), np.inf)
        best[0, 0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                for di, dj, c in ((1, 1, 0), (1, 0, 3), (0, 1, 3), (2, 1, 1.5), (1, 2, 1.5)):
                    if i >= di and j >= dj:
                        best[i, j] = min(best[i, j], best[i - di, j - dj] + c + (cost(sum(a[i - di : i]), sum(b[j - dj : j])) if di and dj else 0))
        return best[-1, -1], cost

    rng = np.random.default_rng(4)
    n, m = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    a, b = np.zeros((40, 8), int), np.zeros((40, 8), int)
    for d in range(40):
        a[d, : n[d]], b[d, : m[d]] = rng.integers(5, 90, n[d]), rng.integers(5, 90, m[d])
    d, i, j, c = bitext.length_beads(a, b, n, m)
    same = np.array([5, 50, 20])
    assert [tuple(x) for x in zip(*(x.tolist() for x in bitext.length_beads(same[None], same[None], np.array([3]), np.array([3]))[:3]), strict=True)] == [(0, 2, 2), (0, 1, 1), (0, 0, 0)]
    for k in range(40):
        total, cost = best_total(a[k, : n[k]].tolist(), b[k, : m[k]].tolist())
        mine = [(x, y, z) for q, x, y, z in zip(d, i, j, c, strict=True) if q == k]
        assert sum(z for *_, z in mine) <= total + 1e-3
        assert all(abs(z - cost(a[k, x], b[k, y])) < 1e-3 for x, y, z in mine)


def test_names_agree_by_letter_pairs():
    def jaccard(x, y):
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y))
        return len(x & y) / len(x | y)

    rng = random.Random(3)
    names = ["^" + "".join(rng.choices("abcdz", k=rng.randint(1, 9))) + "$" for _ in range(60)]
    bits = bitext.letter_pairs(names)
    for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(300)):
        both, either = np.bitwise_count(bits[x] & bits[y]).sum(), np.bitwise_count(bits[x] | bits[y]).sum()
        assert both / either == pytest.approx(jaccard(names[x], names[y]))


# --- problem 8 ---

RANKS = Path(tok.DEFAULT_RANKS)
needs_vocabulary = pytest.mark.skipif(not RANKS.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    if not RANKS.exists():
        pytest.skip("no vocabulary files")
    return tok.Encoder()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(RANKS.with_suffix(".json")))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abtheiour n'sl0\n é漢ḫ", max_size=200))
def test_ids_are_the_public_ones(encoder, public, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = encoder.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    d = tok.Decoder(encoder.transducer.bytes_of)
    assert "".join(d.push([i]) for i in ids) + d.end() == text


def test_long_words_and_forgetting(encoder, public):
    small = tok.Encoder(remembered=3)
    for text in ("a" * 5000 + " " + "the " * 50, "<|endoftext|> x", "", None, "\ud800" if False else "ok"):
        assert small.encode(text) == (public.encode(text, add_special_tokens=False).ids if text else [])


def test_decoder_marks_what_is_no_utf8():
    d = tok.Decoder({i: bytes([i]) for i in range(256)})
    for raw in (b"\xe2\x82", b"\xff", b"a\xc3(", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xe2\x82\xac\xe2", b"\xc0\x80", b"\xf4\x90\x80\x80"):
        assert d.push(list(raw)) + d.end() == raw.decode("utf-8", "replace"), raw


@needs_vocabulary
def test_encode_column(spark, public):
    rows = [(1, "a-na A-šùr", "q"), (2, None, "q"), (3, "", "q"), (None, "x", "q"), (1, "a-na A-šùr", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tok.encode_column(df, "doc_id", "text").collect()
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in got) == sorted((i or 0, public.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert tok.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert {r["n_tokens"] for r in tok.encode_column(df.where("doc_id = 2"), "doc_id", "text", count_only=True).collect()} == {0}


# --- problem 9 ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=120), st.integers(1, 100), st.integers(1, 12))
def test_best_fit_places_everything_once(sizes, capacity, open_bins):
    used, got = defaultdict(int), defaultdict(int)
    pieces = defaultdict(int)
    for item, begin, size, at in packing.best_fit(sizes, capacity, open_bins):
        assert begin == got[item] and size > 0
        used[at] += size
        got[item] += size
        pieces[item] += 1
    assert all(got[i] == s for i, s in enumerate(sizes))
    assert all(pieces[i] == -(-s // capacity) for i, s in enumerate(sizes))
    assert all(u <= capacity for u in used.values())
    assert sorted(used) == list(range(len(used)))
    if open_bins >= 12 and sizes:  # best fit: no two containers would fit into one
        small = sorted(used.values())
        assert len(small) < 2 or small[0] + small[1] > capacity or len(used) > open_bins


def test_pack(spark):
    rng = random.Random(5)
    sizes = [(i, rng.randint(0, 300), "x") for i in range(3000)] + [(2**60, 5000, "x"), (7, 11, "x"), (None, 9, "x"), (8, None, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int, container string")
    out = packing.pack(df, len(sizes), 1024, rows_a_shard=1000).collect()
    assert sum(r["size"] for r in out) == sum(s or 0 for _, s, _ in sizes)
    used = defaultdict(int)
    for r in out:
        assert (r["container"] is None) == (r["size"] == 0)
        used[r["container"]] += r["size"]
    used.pop(None)
    assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.97
    assert [r["piece_no"] for r in sorted(out, key=lambda r: r["piece_no"]) if r["doc_id"] == 2**60] == [1, 2, 3, 4, 5]
    again = packing.pack(df.repartition(9), len(sizes), 1024, rows_a_shard=1000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert packing.pack(df.limit(0), 0, 10).count() == 0


def test_shards_are_cut_in_two(spark):
    def shards(rows):
        sized = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(10).alias("n_tokens"))
        return {r["doc_id"]: r["container"] >> 40 for r in packing.pack(sized, rows, 100, rows_a_shard=50).collect()}

    assert shards(101) == shards(200)  # more rows change nothing until the table has doubled
    four, eight = shards(200), shards(201)
    assert len(set(four.values())) == 4 and all(eight[k] & 3 == v for k, v in four.items())


def test_decoded_texts_are_the_given_ones(spark, encoder):
    rng = random.Random(5)
    texts = [None, "", "a\u0301 \U00012000", *("".join(rng.choices("ab šṭ-\n.é😀", k=rng.randint(1, 60))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = tok.encode_column(df, "doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in tok.decode_column(ids, "doc_id", "ids").collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


# --- problem 10 ---


def test_segments_are_the_best_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        s = [rng.choice((-2, -1, -0.5, 0, 0.5, 1, 2)) for _ in range(rng.randint(0, 14))]
        got = abuse.maximal_segments(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert max((x for _, _, x in got), default=0) == pytest.approx(max(best, 0))
        assert all(x == pytest.approx(sum(s[a:b])) and x > 0 for a, b, x in got)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def corpus(n=500, seed=7):
    rng = random.Random(seed)
    insults = ["you stupid {0} nobody wants you here", "go away you filthy {0} and never come back", "every {0} is a thief and should be driven out"]
    bad = ["moron", "pig", "idiot", "dog"]
    rows = []
    for i in range(n):
        s = rng.choices(SENTENCES, k=rng.randint(1, 6))
        y = int(rng.random() < 0.2)
        if y:
            x = rng.choice(insults).format(rng.choice(bad))
            s.insert(rng.randrange(len(s) + 1), x.upper() if rng.random() < 0.2 else x.replace("i", "1") if rng.random() < 0.2 else x)
        elif rng.random() < 0.2:
            s.append("the word for dog and pig occurs in school exercises")
        rows.append((i, ". ".join(s), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, "zz " * 50_000, ""), (None, "x", "")], "doc_id long, text string, score string")
    labels = [(i, y, "2030-01-01 00:00:00") for i, _, y in rows[:300]] + [(1, None, "2031-01-01 00:00:00"), (0, 1 - rows[0][2], "2020-01-01 00:00:00")]
    labels = spark.createDataFrame(labels, "doc_id long, flagged int, reviewed_at string").withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz"))
    got = {r["doc_id"]: r for r in abuse.score(docs, abuse.fit_tables(docs, labels)).collect()}
    held = [(got[i]["abusive"], bool(y)) for i, _, y in rows[300:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(not got[i]["abusive"] for i in (900, 901, 902, None))
    assert got[900]["score"] == 0 and got[900]["p_value"] == 1
    for i, t, y in rows[300:]:
        for p in got[i]["passages"]:
            assert 0 <= p["begin"] < p["end"] <= len(t)
    none = abuse.fit_tables(docs, labels.limit(0))
    assert abuse.score(docs, none).where("abusive").count() == 0
    assert abuse.score(docs.limit(0), none).count() == 0


def test_scores_of_many_texts_are_those_of_each():
    rng = random.Random(8)
    words = ["you", "the", "m0ron", "pig", "go", "away", "s h i t", "silver", "12", "f**k", "!!!"]
    weights = {"you": 0.4, "the": -0.2, "moron": 3.0, "pig": 2.0, "^ you": 1.0, "you moron": 3.5, "you pig": 2.5, "the silver": -1.0, "*": 2.0, "!! you": 0.3, "!!": 0.5}
    model = abuse.Model(weights=weights, base=1.0, limit=0.1)
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(200))]
    best, n = abuse.Scorer(model).best(texts)
    for t, b, k in zip(texts, best, n, strict=True):
        assert b == pytest.approx(model.passages(t)[0]) and k == len(abuse.tokens(t or "")[0])
    coder = abuse.Coder(abuse.sample_features(texts[:50]))
    ids, begin = coder.encode(texts)
    place, has = coder.pairs_of(ids, begin)
    counts = np.bincount(place[has], minlength=len(coder.pairs))
    expected = defaultdict(int)
    for t in texts:
        for x in abuse.features(abuse.tokens(t or "")[0]):
            expected[x] += 1
    assert {p: int(c) for p, c in zip(coder.pairs, counts, strict=True)} == {p: expected[p] for p in coder.pairs}


def test_evasive_tokens():
    assert abuse.tokens("You M0R0N, s h i t! f*****g bitchhhh 12")[0] == ["you", "moron", "shit", "*", "bitch", "0"]
