"""Problems 1, 2, 3 and 6 against brute force, and their odd cases."""

import itertools
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabletloom.llm import canonical, look, near_duplicates, sketch, split_overlap


def key(t):
    return re.sub(r"[\s!?.]", "", (t or "").lower())


def grams(t):
    k = key(t)
    return {k[i : i + 3] for i in range(len(k) - 2)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return bool(x) and bool(y) and len(x & y) / len(x | y) >= 0.7


def passages(n, seed, length=60):
    """Texts of words, with copies, edited and reordered ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdegiklmnpqrstuwzšḫṭ-", k=rng.randint(3, 9))) for _ in range(150)]
    base = [rng.choices(words, k=length) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 3, 6, 10))):
            k = rng.randrange(len(w))
            w[k] = rng.choice((rng.choice(words), w[k] + "x", ""))
        if rng.random() < 0.2:
            k = rng.randrange(len(w))
            w = w[k:] + w[:k]
        out.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    return out


# --- problem 1 ---


def plain_consistent(s):
    letters = {ord(x[0]): x[1] for x in look.LOOKALIKES} | {c: "-" for c in look.HYPHENS}
    s = "".join(" " if unicodedata.category(c) == "Zs" else "" if unicodedata.category(c) == "Cf" or ord(c) in look.INVISIBLE else c for c in s)
    s = "".join(unicodedata.normalize("NFKC", c) if 0xFF00 <= ord(c) < 0xFFEF else c for c in s)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(letters))


def test_consistent_is_the_plain_one():
    rng = random.Random(1)
    signs = list("aeiušŠḫḪṣṬ áà-\n") + ["́", "̣", "̌", "̮", "̀", "а", "Α", "‐", "‑", "­", "​", "﻿", " ", "　", "Ａ", "ｚ", "０", "［", "é", "ệ", "₂", "Å", "각", "漢", "😀"]
    texts = ["", None, *("".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(2000)), "a" + "́̀" * 50, "x" * 100_000]
    got = look.consistent_arrow(pa.array(texts)).to_pylist()
    for t, g in zip(texts, got, strict=True):
        assert g == (None if t is None else plain_consistent(t)), repr(t)
    assert look.consistent_arrow(pa.array([], pa.string())).to_pylist() == []
    assert look.consistent_arrow(pa.array(got)).to_pylist() == got


def test_same_look_pairs(spark):
    rows = [(1, "ša-ru"), (2, "s\u030ca-ru"), (3, "ša-ru"), (4, "ša‐ru"), (5, "Ša-ru"), (6, "ša-rù"), (7, None), (8, ""), (9, "​"), (10, "ｓ"), (11, "s"), (None, "ｓ"), (12, "u₂"), (13, "u2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, form string, look string").withColumn("tbl", F.lit("y"))
    got = {(r["row_id_a"], r["row_id_b"]) for r in look.same_look_pairs({"t": (df, "form")}).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4), (8, 9), (10, 11)}
    assert look.same_look_pairs({"t": (df.limit(0), "form")}).count() == 0
    out = look.with_consistent(df, "form", "look")
    assert out.count() == len(rows) and set(out.columns) == set(df.columns)


# --- problem 2 ---


def test_match_is_the_best_by_brute_force(spark):
    rng = random.Random(2)
    canon = [(i, "-".join(rng.choices(["ka", "šu", "ḫi", "lá", "mé", "ur", "iš", "za", "tu", "be"], k=5))) for i in range(80)]
    asked = []
    for _, f in rng.choices(canon, k=150):
        w = list(f)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abdegikl")
        asked.append("".join(w).capitalize())
    asked += ["Xyz-qo", "-", "[...]", "Ka-šu-[x]"]
    entries = spark.createDataFrame(canon, "ref_id long, form string")
    keys = spark.createDataFrame([(canonical.name_key(a),) for a in asked], "key string")

    def pairs(v):
        return {v[i : i + 2] for i in range(len(v) - 1)}

    known = [(r, pairs(v)) for r, f in canon for v in canonical.name_key(f).split("|")]
    for limit in (canonical.BROADCAST_ENTRIES, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(canonical, "BROADCAST_ENTRIES", limit)
            got = {r["key"]: r["ref_id"] for r in canonical.match_keys(keys.distinct(), entries).collect()}
        for a in asked:
            k = canonical.name_key(a)
            best = {}
            for v in filter(None, k.split("|")):
                for r, s in known:
                    j = len(pairs(v) & s) / len(pairs(v) | s)
                    best[r] = max(best.get(r, 0), j)
            top = sorted((-j, r) for r, j in best.items() if j >= canonical.THRESHOLD)[:2]
            lead = top and (-top[0][0] >= canonical.SURE or -top[0][0] - (-top[1][0] if len(top) > 1 else canonical.THRESHOLD - 0.1) >= canonical.MARGIN)
            assert got[k] == (top[0][1] if lead else -1), a


def test_names_and_fields(spark):
    canon = spark.createDataFrame([(1, "Ra-il-ag-le-ḫu"), (2, "Kà-ni-iš-ma-at")], "ref_id long, form string")
    train = spark.createDataFrame([(1, "a-na {m}Ra-il-ag-[x] KÙ.BABBAR Ka-ni-iš-ma-at-ma\nRailagleḫu"), (2, None), (3, ""), (4, "Xo-xo-xo šu"), (5, "a-na")], "row_id long, transliteration string")
    named = spark.createDataFrame([(1, "lady Railagleḫu, scribe"), (2, "Kani šmat"), (3, "RAILAGLEḪU"), (4, None), (5, "?")], "row_id long, norm string")
    fields = {"t": canonical.keyed_names(train, "transliteration", "row_id", True), "n": canonical.keyed_names(named, "norm", "row_id", False)}
    got = {tuple(r) for r in canonical.map_fields(fields, canon).collect()}
    assert got == {("t", 1, 1), ("t", 1, 2), ("t", 4, -1), ("n", 1, 1), ("n", 2, 2), ("n", 3, 1), ("n", 5, -1)}
    assert canonical.map_fields({"t": canonical.keyed_names(train.limit(0), "transliteration", "row_id", True)}, canon.limit(0)).count() == 0
    assert canonical.map_fields(fields, canon.limit(0)).where("ref_id >= 0").count() == 0


# --- problems 3 and 6 ---


def tables(spark):
    a, b = passages(160, 3), passages(160, 3)[::2] + passages(80, 4)
    x = [*enumerate(a), (500, None), (501, ""), (502, "?! ."), (503, "ab"), (504, "abc"), (505, "a b c!"), (506, "z" * 200_000), (507, "z" * 190_000), (508, "y" * 50_000), (None, a[0])]
    one = spark.createDataFrame([(i, t, "k") for i, t in x], "row_id long, transliteration string, cls string")
    two = spark.createDataFrame(list(enumerate(b)), "row_id long, transliteration string").repartition(5)
    return one, two, [("a", i, t) for i, t in x if i is not None] + [("b", i, t) for i, t in enumerate(b)]


def test_near_duplicates_are_all_alike_pairs(spark, monkeypatch):
    one, two, rows = tables(spark)
    expected = {(p[:2], q[:2]) if p[:2] < q[:2] else (q[:2], p[:2]) for p, q in itertools.combinations(rows, 2) if alike(p[2], q[2])}
    for block, cell in ((sketch.BLOCK, sketch.CELL), (5, sketch.CELL), (sketch.BLOCK, 4)):
        monkeypatch.setattr(sketch, "BLOCK", block)
        monkeypatch.setattr(sketch, "CELL", cell)
        out = near_duplicates.near_duplicate_pairs({"a": one, "b": two}, "transliteration").collect()
        got = {((r["tbl_a"], r["row_id_a"]), (r["tbl_b"], r["row_id_b"])) for r in out}
        assert len(out) == len(got) and not got - expected
        assert len(got) >= 0.995 * len(expected)
    groups = {(r["tbl"], r["row_id"]): r for r in near_duplicates.near_duplicate_groups({"a": one, "b": two}, "transliteration").collect()}
    links = {k: 0 for k in groups}
    for p, q in got:
        links[p] += 1
        links[q] += 1
    assert {k: r["links"] for k, r in groups.items()} == links
    assert groups["a", 500]["cls"] is None and groups["a", 504]["cls"] == groups["a", 505]["cls"]
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", 0)
    assert near_duplicates.near_duplicate_pairs({"a": one, "b": two}, "transliteration").count() == len(got)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, transliteration string")
    assert near_duplicates.near_duplicate_pairs({"a": empty, "b": empty}, "transliteration").count() == 0
    assert near_duplicates.near_duplicate_groups({"a": empty}, "transliteration").count() == 0


def test_anchors_meet_at_distance_one():
    import numpy as np

    w = np.arange(10, dtype=np.uint64)[None].repeat(3, 0) * np.uint64(77)
    w[1, [1, 7]] += np.uint64(1)  # one symbol in each block
    w[2, [0, 1, 5, 9]] += np.uint64(5)  # two in each
    keys = near_duplicates.anchor_keys(w, 4, 2)
    assert keys.shape == (3, 10)
    assert len(set(keys[0]) & set(keys[1])) == 2 and not set(keys[0]) & set(keys[2])


def test_sampled_suffixes_depend_on_the_text_only():
    rng = random.Random(6)
    texts = ["".join(rng.choices("klmnošṣ-", k=rng.randint(0, 80))) for _ in range(40)]
    cp, row = sketch.flat(texts)
    key, of = split_overlap.sampled_suffixes(cp, row, len(texts))
    codes = split_overlap.packed_prefixes(cp, row)
    place = {}
    for i, (x, r) in enumerate(zip(codes.tolist(), row.tolist())):
        place.setdefault(r, set()).add(x)
    for i, t in enumerate(texts):
        mine = sorted(key[of == i].tolist())
        assert set(mine) <= place.get(i, set()) and len(set(mine)) == len(mine) <= split_overlap.SAMPLED
        c1, r1 = sketch.flat([t])
        assert sorted(split_overlap.sampled_suffixes(c1, r1, 1)[0].tolist()) == mine
    c, r = sketch.flat(["abcdefghijk", "abc", "bcdefghijkl"])
    p = split_overlap.packed_prefixes(c, r)
    assert p[0] < p[1] == p[14] and p[11] < p[0]  # sorted as the suffixes; the end comes before any character


def test_overlaps_are_all_alike_cross_pairs(spark, monkeypatch):
    rng = random.Random(8)
    a, b = passages(220, 9), passages(220, 10, 30)
    rows = [(i, rng.choice(("train", "train", "val", "test")), rng.choice("pq"), x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    short = ["abc def", "abc-def", "a.b.c.d.e.f.g", "abcdefgh", "xabcdefgh"]
    rows += [(300 + i, "train" if i % 2 else "val", None, t, None) for i, t in enumerate(short * 2)] + [(400, None, "p", a[0], b[0]), (401, "test", "p", None, ""), (None, "val", "p", a[0], b[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, split string, source string, transliteration string, translation string, side string")
    for block, cell in ((sketch.BLOCK, sketch.CELL), (5, sketch.CELL), (sketch.BLOCK, 4)):
        monkeypatch.setattr(sketch, "BLOCK", block)
        monkeypatch.setattr(sketch, "CELL", cell)
        out = split_overlap.overlaps(df).collect()
        got = {(r["side"], r["train_id"], r["other_id"]) for r in out}
        assert len(got) == len(out)
        expected = {(s, p[0], q[0]) for k, s in ((3, "transliteration"), (4, "translation")) for p in rows if p[1] == "train" for q in rows if q[1] in ("val", "test") and q[0] is not None and alike(p[k], q[k])}
        assert not got - expected and len(got) >= 0.99 * len(expected)
    counts = split_overlap.overlap_counts(df).collect()
    assert sum(r["overlapping"] for r in counts) == len({(s, o) for s, _, o in got})
    assert split_overlap.overlaps(df.limit(0)).count() == 0
    assert split_overlap.overlap_coverage(df.limit(0)).count() == 0


def test_coverage_is_that_of_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.choice(("train", "val")), "".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, "val", rows[0][2] + "ccccccccc" + rows[1][2]), (301, "train", None), (302, None, "abababababababab"), (303, "val", ""), (304, "val", None)]
    df = spark.createDataFrame(rows, "row_id long, split string, transliteration string")
    span = 8
    known = {t[i : i + span] for _, s, t in rows if s == "train" and t for i in range(len(t) - span + 1)}
    expected = {}
    for i, s, t in rows:
        if s == "val" and t:
            inside = {k for j in range(len(t) - span + 1) if t[j : j + span] in known for k in range(j, j + span)}
            if inside:
                expected[i] = (len(t), len(inside))
    for cell in (sketch.CELL, 20):
        monkeypatch.setattr(sketch, "CELL", cell)
        got = split_overlap.overlap_coverage(df, ("transliteration",), span).collect()
        assert {r["other_id"]: (r["n_chars"], r["covered"]) for r in got} == expected


def test_sketches_let_alike_texts_of_every_length_pass():
    import numpy as np

    rng = np.random.default_rng(7)
    for union in (10, 20, 40, 100, 300):
        both, n = -(-7 * union // 10), 2000
        x = rng.integers(0, 2**63, (n, union), dtype=np.uint64)
        e = []
        for part in (x, x[:, :both]):
            of = np.zeros(n, sketch.ENTRY)
            bits, of["filled"] = sketch.sketch_bits(part.ravel(), np.repeat(np.arange(n), part.shape[1]), n)
            of["s0"], of["s1"], of["s2"] = bits.T
            of["id"] = np.arange(n) + n * len(e)
            e.append(sketch.Entries(of))
        at = np.arange(n)
        assert len(sketch.near(e[0], at, e[1], at)[0]) >= 0.998 * n, union


def edited(text, rng, edits):
    """``text`` with so many letters replaced, added or left out at random places."""
    for _ in range(edits):
        k, new = rng.randrange(len(text)), rng.choice("abcdefghijklmnop")
        text = rng.choice((text[:k] + new + text[k + 1 :], text[:k] + new + text[k:], text[:k] + text[k + 1 :]))
    return text


def test_overlaps_of_every_length_are_found(spark):
    rng = random.Random(12)
    rows, bands = [], {}
    for size in (30, 38, 39, 45, 60, 130, 300):
        for k in range(150):
            a = "".join(rng.choices("abcdefghijklmnop", k=size))
            b = a[:20] + "q" + a[20:] if size == 38 and k % 2 else edited(a, rng, rng.randint(1, max(1, size // 15)))
            if alike(a, b):
                bands.setdefault(size, set()).add((len(rows), len(rows) + 1))
            rows += [(len(rows), "train", a), (len(rows) + 1, "val", b)]
    df = spark.createDataFrame(rows, "row_id long, split string, transliteration string")
    got = {(r["train_id"], r["other_id"]) for r in split_overlap.overlaps(df, ("transliteration",)).collect()}
    across = {p for p in set().union(*bands.values()) if (len(rows[p[0]][2]) < 39) != (len(rows[p[1]][2]) < 39)}
    assert len(across) > 30
    for band, expected in [*bands.items(), ("across", across)]:
        assert len(expected & got) >= 0.97 * len(expected), (band, len(expected), len(expected & got))
