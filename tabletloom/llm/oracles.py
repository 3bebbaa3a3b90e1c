"""SQL (DuckDB) of those training-data queries that SQL can express on whole tables.

For the others (learned models, tokenizers, packing) the tests hold the operators against brute force, round trips and
held-out accuracy.
"""

from __future__ import annotations

from tabletloom.llm.look import HYPHENS, LOOKALIKES

_KEY = r"regexp_replace(lower({c}), '[!?.]|[\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g')"


def _alike(texts: str) -> str:
    """``alike``: pairs (ta, ra, tb, rb) of rows of ``texts`` (tbl, row_id, k) with trigram Jaccard of 0.7 or more."""
    return f"""texts AS ({texts}), grams AS MATERIALIZED (SELECT DISTINCT tbl, row_id, substr(k, i, 3) AS g
  FROM (SELECT tbl, row_id, k, unnest(range(1, length(k) - 1)) AS i FROM texts WHERE length(k) >= 3)),
sizes AS MATERIALIZED (SELECT tbl, row_id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT a.tbl AS ta, a.row_id AS ra, b.tbl AS tb, b.row_id AS rb, count(*) AS s
  FROM grams a JOIN grams b ON a.g = b.g AND (a.tbl, a.row_id) < (b.tbl, b.row_id) GROUP BY ALL),
alike AS (SELECT ta, ra, tb, rb, s::DOUBLE / (x.n + y.n - s) AS j FROM shared JOIN sizes x ON x.tbl = ta AND x.row_id = ra
  JOIN sizes y ON y.tbl = tb AND y.row_id = rb WHERE s::DOUBLE / (x.n + y.n - s) >= 0.7)"""


def _look(c: str) -> str:
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    pairs = [x for x in LOOKALIKES if x[0] not in wide]
    old = wide + "".join(x[0] for x in pairs) + "".join(map(chr, HYPHENS)) + "K"
    new = plain + "".join(x[1] for x in pairs) + "-" * len(HYPHENS) + "K"
    quoted = lambda s: s.replace("'", "''")
    return rf"nfc_normalize(translate(regexp_replace(regexp_replace({c}, '\p{{Cf}}', '', 'g'), '\p{{Zs}}', ' ', 'g'), '{quoted(old)}', '{quoted(new)}'))"


_PAIRS = f"SELECT 'extracted_pairs' AS tbl, row_id, {_KEY.format(c='transliteration')} AS k FROM extracted_pairs UNION ALL SELECT 'train_sentences', row_id, {_KEY.format(c='transliteration')} FROM train_sentences"


def _side(c: str) -> str:
    """The overlaps of one side: (o, j) of rows outside train and, as ``t``, the row of train."""
    return f"""(WITH {_alike(f"SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END AS tbl, row_id, {_KEY.format(c=c)} AS k FROM combined_corpus WHERE split IS NOT NULL")}
SELECT '{c}' AS side, ra AS t, rb AS o, j FROM alike WHERE ta = 0 AND tb = 1)"""


_OVERLAPS = f"({_side('transliteration')} UNION ALL {_side('translation')})"

_COVERAGE = f"""WITH k AS (SELECT split, row_id, unnest(['transliteration', 'translation']) AS side, unnest([{_KEY.format(c='transliteration')}, {_KEY.format(c='translation')}]) AS k FROM combined_corpus WHERE split IS NOT NULL),
g AS (SELECT split, row_id, side, length(k) AS n, i, substr(k, i, 24) AS g FROM (SELECT *, unnest(range(1, length(k) - 22)) AS i FROM k WHERE length(k) >= 24)),
t AS (SELECT DISTINCT side, g FROM g WHERE split = 'train'),
c AS (SELECT side, row_id, n, least(24, i - coalesce(lag(i) OVER (PARTITION BY side, row_id ORDER BY i), -24)) AS more FROM g JOIN t USING (side, g) WHERE split <> 'train')
SELECT side, row_id AS other_id, n AS n_chars, sum(more)::BIGINT AS covered, round(sum(more) / n, 6)::DOUBLE AS coverage FROM c GROUP BY side, row_id, n"""

ORACLES: dict[str, str] = {
    "p6_coverage": _COVERAGE,
    "p1_found": f"""WITH t AS (SELECT 'train' AS tbl, row_id, transliteration AS x FROM train UNION ALL SELECT 'oa_lexicon_ebl', row_id, form FROM oa_lexicon_ebl),
l AS (SELECT tbl, row_id, x, {_look('x')} AS look FROM t WHERE x IS NOT NULL)
SELECT a.tbl, a.row_id AS row_id_a, b.row_id AS row_id_b FROM l a JOIN l b ON a.tbl = b.tbl AND a.look = b.look AND a.row_id < b.row_id AND a.x <> b.x""",
    "p1_texts": f"SELECT 'train' AS tbl, row_id, {_look('transliteration')} AS consistent FROM train UNION ALL SELECT 'oa_lexicon_ebl', row_id, {_look('form')} FROM oa_lexicon_ebl",
    "p3_found": f"WITH {_alike(_PAIRS)} SELECT ta AS tbl_a, ra AS row_id_a, tb AS tbl_b, rb AS row_id_b FROM alike",
    "p3_groups": f"""WITH {_alike(_PAIRS)}, c AS (SELECT tbl, row_id, CASE WHEN length(k) >= 3 THEN min({{'t': tbl, 'r': row_id}}) OVER (PARTITION BY k) END AS c FROM texts),
n AS (SELECT tbl, row_id, count(*) AS links FROM (SELECT ta AS tbl, ra AS row_id FROM alike UNION ALL SELECT tb, rb FROM alike) GROUP BY ALL)
SELECT tbl, row_id, CASE WHEN c IS NOT NULL THEN c.t || '/' || c.r END AS cls, coalesce(links, 0) AS links FROM c LEFT JOIN n USING (tbl, row_id)""",
    "p5_rebuilt": "SELECT row_id, 'transliteration' AS field, transliteration AS text, true AS within FROM train WHERE length(transliteration) > 1000 UNION ALL SELECT row_id, 'translation', translation, true FROM train WHERE length(translation) > 2000",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_checked": "SELECT count(*) AS documents, 0::BIGINT AS gaps, 0::BIGINT AS shared, 0::BIGINT AS overfull FROM documents",
    "p5_found": "SELECT row_id, 'transliteration' AS field FROM train WHERE length(transliteration) > 1000 UNION ALL SELECT row_id, 'translation' FROM train WHERE length(translation) > 2000",
    "p6_found": f"SELECT DISTINCT least(t, o) AS row_id_a, greatest(t, o) AS row_id_b FROM {_OVERLAPS}",
    "p6_counts": f"""WITH f AS (SELECT side, o AS row_id, max(j) AS j FROM {_OVERLAPS} GROUP BY ALL),
k AS (SELECT split, row_id, source, unnest(['transliteration', 'translation']) AS side, unnest([{_KEY.format(c='transliteration')}, {_KEY.format(c='translation')}]) AS k FROM combined_corpus WHERE split IS NOT NULL),
same AS (SELECT DISTINCT side, k FROM k WHERE split = 'train' AND length(k) >= 3)
SELECT k.split, k.source, k.side, count(*) AS records, count(f.j) AS overlapping, count(*) FILTER (same.k IS NOT NULL OR f.j = 1.0) AS identical
FROM k LEFT JOIN f ON f.side = k.side AND f.row_id = k.row_id LEFT JOIN same ON same.side = k.side AND same.k = k.k WHERE k.split <> 'train' GROUP BY ALL""",
}
