"""Queries of the core operators, (spark, folder of tables) -> DataFrame, and their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletloom.functions import features as X
from tabletloom.functions import fixed
from tabletloom.functions import ocr
from tabletloom.functions import scoring
from tabletloom.functions import text as T
from tabletloom.operators import align, augment, context, dedup, lexicon, metrics, models, parse, sample, submit, vector
from tabletloom.plans import pipelines
from tabletloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL parts ---------------------------------------------------------------------------------------------------------

_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _normalize(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '{fixed.ERASURE}', '', 'g')"
    x = f"regexp_replace({x}, '{T.any_of(fixed.BIG_GAPS)}', '{fixed.BIG_GAP}', 'g')"
    x = f"regexp_replace({x}, '{T.any_of(fixed.SINGLE_GAPS)}', '{fixed.SINGLE_GAP}', 'g')"
    x = f"regexp_replace({x}, '[{fixed.DELETED}]', '', 'g')"
    return _strip(f"regexp_replace({x}, '{_S}+', ' ', 'g')")


def _key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '{_S}|[!?.]', '', 'g')"


def _match(x: str) -> str:
    return f"translate(replace(lower(coalesce({x}, '')), 'š', 'sh'), '{fixed.KEY_FROM}-', '{fixed.KEY_TO}')"


def _list(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(x: str) -> str:
    split = f"list_filter(regexp_split_to_array(lower({_strip(x)}), '{_S}+'), lambda w: w <> '')"
    return rf"""list_transform({split}, lambda w: regexp_replace(w, '^[.,!?;:''"()\[\]]+|[.,!?;:''"()\[\]]+$', '', 'g'))"""


def _share(words: list[str], w: str = "w") -> str:
    return f"len(list_filter({w}, lambda x: list_contains({_list(words)}, x)))::DOUBLE / greatest(len({w}), 1)"


#: Runs of letters, digits and underscores between marks, so that the ends of words can be seen without looking around.
_MARK_B, _MARK_E = "\x01", "\x02"


def _marked(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"


def _found(x: str, pattern: str) -> str:
    """The matches of a pattern over marked text, without the marks."""
    return f"list_transform(regexp_extract_all({_marked(x)}, '{pattern}'), lambda m: translate(m, chr(1) || chr(2), ''))"


_CAPITALS = "(upper({0}) = {0} AND lower({0}) <> {0})"


def _names(x: str) -> str:
    pattern = rf"\x01[{fixed.UPPER}][{fixed.LOWER}{fixed.UPPER}{fixed.INDEX}\x01\x02-]*[\x01\x02]"
    return f"list_filter({_found(x, pattern)}, lambda n: NOT {_CAPITALS.format('n')})"


def _akkadian(x: str) -> str:
    signs = r"\x01[A-Z]{2,}(?:\x02\.\x01[A-Z]+)*\x02"
    words = " + ".join(f"contains(lower({x}), '{k}')::INTEGER" for k in fixed.KEYWORDS)
    return f"""CASE WHEN length({_strip(x)}) < 5 THEN 0.0 ELSE 5.0 * length(regexp_replace({x}, '[^{fixed.DIACRITICS}]', '', 'g')) / greatest(length({x}), 1)
 + 2.0 * least(len(regexp_extract_all({_marked(x)}, '{signs}')) / 3.0, 1.0) + least(len(regexp_extract_all({x}, '{fixed.SCORE_GAP}')) / 2.0, 1.0) + 2.0 * least(({words}) / 3.0, 1.0) END"""


def _english(x: str) -> str:
    return f"CASE WHEN length({_strip(x)}) < 10 THEN 0.0 ELSE least({_share(fixed.ENGLISH, _tokens(x))} * 3 + {_share(fixed.TRADE, _tokens(x))} * 2, 2.0) END"


def _foreign(x: str) -> str:
    return f"CASE WHEN length({_strip(x)}) < 10 THEN 0.0 ELSE greatest({', '.join(f'{_share(words, _tokens(x))} * {k}' for words, k in ((fixed.GERMAN, 15), (fixed.TURKISH, 20), (fixed.FRENCH, 12)))}) END"


# --- projections, filters, row operations --------------------------------------------------------------------------------


@query(f"SELECT row_id, {_normalize('transliteration')} AS transliteration, {_normalize('translation')} AS translation FROM train")
def normalize_train(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "train").select("row_id", T.normalize("transliteration").alias("transliteration"), T.normalize("translation").alias("translation"))


@query(f"SELECT doc_id, {_key('text')} AS dedup_key, {_match('text')} AS match_key FROM documents")
def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", T.dedup_key("text").alias("dedup_key"), T.match_key("text").alias("match_key"))


_HEADER = rf"""(s = '' OR regexp_matches(s, '^[0-9]+{_S}*(?:[\p{{L}}\p{{N}}_]{_S}+[A-Z][A-Za-z\s.,\-]+)?{_S}*$')
 OR (s = upper(s) AND length(s) < 80 AND NOT regexp_matches(s, '[{fixed.HEADER_MARKS}]') AND regexp_matches(s, '\p{{L}}')))"""
_CORRECTED = f"""WITH l AS (SELECT row_id, string_split(coalesce(page_text, ''), chr(10)) AS lines FROM publications),
e AS (SELECT row_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l),
f AS (SELECT row_id, min(k) AS k FROM (SELECT row_id, k, {_strip('line')} AS s FROM e) WHERE NOT {_HEADER} GROUP BY row_id),
b AS (SELECT l.row_id, CASE WHEN f.k IS NULL THEN '' ELSE array_to_string(lines[f.k:], chr(10)) END AS t FROM l LEFT JOIN f USING (row_id))
SELECT row_id, {_strip("regexp_replace(regexp_replace(t, '[ ' || chr(9) || ']+', ' ', 'g'), ' +' || chr(10), chr(10), 'g')")} AS page_text FROM b"""


@query(_CORRECTED)
def ocr_correct(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "publications").select("row_id", ocr.correct("page_text").alias("page_text"))


@query("SELECT row_id FROM publications WHERE has_akkadian")
def flagged_pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "publications").where("has_akkadian").select("row_id")


@query("SELECT e.row_id FROM extracted_pairs e WHERE e.source_pdf IN (SELECT DISTINCT pdf_name FROM publications WHERE has_akkadian)")
def pairs_of_flagged_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    wanted = read(spark, folder, "publications").where("has_akkadian").select(F.col("pdf_name").alias("source_pdf")).distinct()
    return read(spark, folder, "extracted_pairs").join(wanted, "source_pdf", "left_semi").select("row_id")


@query(f"SELECT row_id FROM train WHERE transliteration IS NOT NULL AND translation IS NOT NULL AND length({_strip('transliteration')}) > 0 AND length({_strip('translation')}) > 0")
def non_blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sample.non_blank(read(spark, folder, "train"), ["transliteration", "translation"]).select("row_id")


@query("SELECT count(*) FILTER (transliteration IS NULL) AS null_transliterations, count(*) FILTER (translation IS NULL) AS null_translations, count(*) AS n FROM combined_corpus")
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "combined_corpus").agg(F.count_if(F.col("transliteration").isNull()).alias("null_transliterations"), F.count_if(F.col("translation").isNull()).alias("null_translations"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT pdf_name) AS pdfs, count(*) AS pages FROM publications")
def publication_stats(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "publications").agg(F.countDistinct("pdf_name").alias("pdfs"), F.count("*").alias("pages"))


@query("""SELECT t.n AS documents, s.n AS sentences, round(s.n / t.n, 6) AS sentences_a_document, round((t.n + e.n) / t.n, 6) AS multiplier
FROM (SELECT count(*) AS n FROM train) t, (SELECT count(*) AS n FROM train_sentences) s, (SELECT count(*) AS n FROM extracted_pairs) e""")
def corpus_ratios(spark: SparkSession, folder: str) -> DataFrame:
    n = lambda t, c: read(spark, folder, t).agg(F.count("*").alias(c))
    one = n("train", "documents").join(n("train_sentences", "sentences")).join(n("extracted_pairs", "_e"))  # of one row each
    return one.select("documents", "sentences", F.round(F.col("sentences") / F.col("documents"), 6).alias("sentences_a_document"), F.round((F.col("documents") + F.col("_e")) / F.col("documents"), 6).alias("multiplier"))


@query("SELECT src, row_id, transliteration, translation FROM (SELECT 0 AS src, row_id, transliteration, translation FROM train UNION ALL SELECT 1, row_id, transliteration, translation FROM extracted_pairs)")
def union_corpora(spark: SparkSession, folder: str) -> DataFrame:
    parts = [read(spark, folder, t).select(F.lit(i).alias("src"), "row_id", "transliteration", "translation") for i, t in enumerate(("train", "extracted_pairs"))]
    return parts[0].unionByName(parts[1])


@query("SELECT pdf_name, min(row_id) AS first FROM publications GROUP BY pdf_name")
def pdfs_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.unique_in_order(read(spark, folder, "publications"), "pdf_name")


@query("SELECT min(row_id) AS row_id, pdf_name, page FROM publications GROUP BY pdf_name, page")
def exact_dedup_pages(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.keep_first(read(spark, folder, "publications"), ["pdf_name", "page"]).select("row_id", "pdf_name", "page")


# --- features --------------------------------------------------------------------------------------------------------------


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_names('transliteration')}) AS term FROM train) GROUP BY term")
def proper_noun_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.frequencies(read(spark, folder, "train"), X.proper_nouns("transliteration"))


_SIGNS = rf"\x01[{fixed.UPPER}]{{2,}}[₀-₉]*(?:\x02\.\x01[{fixed.UPPER}]+[₀-₉]*)*\x02"
_BARE = r"regexp_replace(transliteration, '\{[^}]+\}', '', 'g')"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_found(_BARE, _SIGNS)}) AS term FROM train) WHERE length(term) >= 2 GROUP BY term")
def sumerogram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.frequencies(read(spark, folder, "train"), X.sumerograms("transliteration"))


@query(rf"""SELECT row_id, {_names("coalesce(transliteration, '')")} AS proper_nouns, list_filter({_found("regexp_replace(coalesce(transliteration, ''), '" + fixed.DETERMINATIVE + "', '', 'g')", _SIGNS)}, lambda x: length(x) >= 2) AS sumerograms,
list_transform(regexp_extract_all(coalesce(transliteration, ''), '{fixed.DETERMINATIVE}'), lambda x: trim(x, '{{}}')) AS determinatives FROM train_sentences""")
def text_features(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "train_sentences").select("row_id", X.all_features("transliteration").alias("f")).select("row_id", "f.*")


@query(f"SELECT row_id, '{fixed.TASK_PREFIX}' || coalesce(transliteration, '') AS prompt, 412 + length(coalesce(transliteration, '')) AS estimate FROM train")
def task_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a model without a lexicon is asked, and the length that a full prompt would have."""
    return read(spark, folder, "train").select("row_id", T.with_task_prefix(F.col("transliteration")).alias("prompt"), context.estimated_length(F.col("transliteration")).alias("estimate"))


@query(r"SELECT term, count(*) AS n FROM (SELECT trim(unnest(regexp_extract_all(transliteration, '\{[^}]+\}')), '{}') AS term FROM train) GROUP BY term")
def determinative_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.frequencies(read(spark, folder, "train"), X.determinatives("transliteration"))


_SCORED = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_tokens("coalesce(text, '')")} AS w, length({_strip("coalesce(text, '')")}) AS n FROM documents)
SELECT doc_id,
round(CASE WHEN n < 10 THEN 0.0 ELSE least({_share(fixed.ENGLISH)} * 3 + {_share(fixed.TRADE)} * 2, 2.0) END, 6)::DOUBLE AS english,
round(CASE WHEN n < 10 THEN 0.0 ELSE greatest({_share(fixed.GERMAN)} * 15, {_share(fixed.TURKISH)} * 20, {_share(fixed.FRENCH)} * 12) END, 6)::DOUBLE AS non_english
FROM t"""


@query(_SCORED)
def language_scores(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.round(scoring.english_score("text"), 6).alias("english"), F.round(scoring.non_english_score("text"), 6).alias("non_english"))


@query(f"SELECT doc_id, round({_akkadian('x')}, 6)::DOUBLE AS akkadian FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def akkadian_scores(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.round(scoring.akkadian_score("text"), 6).alias("akkadian"))


# --- alignment and parsing ---------------------------------------------------------------------------------------------------

_ALIGNED = f"""WITH aid AS (SELECT DISTINCT oare_id FROM train_sentences WHERE oare_id IS NOT NULL),
d AS (SELECT t.row_id, t.transliteration, t.translation, a.oare_id IS NOT NULL AS aided,
 list_filter(list_transform(string_split(coalesce(transliteration, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS s,
 list_filter(list_transform(regexp_split_to_array(coalesce(translation, ''), '[.\\n]'), lambda x: {_strip('x')}), lambda x: x <> '') AS g
 FROM train t LEFT JOIN aid a USING (oare_id)),
z AS (SELECT row_id, unnest(s) AS s, unnest(g) AS g, generate_subscripts(s, 1) AS k FROM d WHERE aided AND len(s) = len(g)),
v AS (SELECT row_id, s, g, row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS pair_no FROM z WHERE length(s) >= 3 AND length(g) >= 3 AND length(s)::DOUBLE / greatest(length(g), 1) <= 3.0)
SELECT row_id, pair_no::INTEGER AS pair_no, s AS transliteration, g AS translation FROM v
UNION ALL SELECT row_id, 0, transliteration, translation FROM d WHERE row_id NOT IN (SELECT row_id FROM v)"""


@query(_ALIGNED)
def align_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_corpus(read(spark, folder, "train"), read(spark, folder, "train_sentences")).select("row_id", "pair_no", "transliteration", "translation")


def _segments(pages: str) -> str:
    """m, g: the segments of pages (row_id, t), as (row_id, segment_no, segment)."""
    return rf"""m AS (SELECT *, string_split(regexp_replace(t, '({fixed.TEXT_HEADER})', chr(1) || '\1', 'g'), chr(1)) AS parts FROM {pages}),
l AS (SELECT *, CASE WHEN len(parts) = 1 THEN [t] WHEN {_strip('parts[1]')} = '' THEN parts[2:] ELSE list_concat([{_strip('parts[1]')}], parts[2:]) END AS segs FROM m),
g AS (SELECT * EXCLUDE (t, parts, segs), unnest(segs) AS segment, generate_subscripts(segs, 1) - 1 AS segment_no FROM l)"""


def _parsed(pages: str) -> str:
    """CTEs up to ``pairs``: the pairs of pages (row_id, t)."""
    fold = lambda x: _strip(f"regexp_replace({x}, '{_S}+', ' ', 'g')")
    begins = f"length({_strip('x')}) > 25 AND regexp_matches({_strip('x')}, '[{fixed.DIACRITICS}]') AND {_akkadian(_strip('x'))} > 1.0 AND {_english(_strip('x'))} < 0.3"
    return rf"""{_segments(pages)},
q AS (SELECT *, string_split(regexp_replace(segment, '([:.][ 	
]+)', '\1' || chr(1), 'g'), chr(1)) AS pieces FROM g),
c AS (SELECT *, unnest(list_transform(range(1, len(pieces)), lambda k: list_sum(list_transform(pieces[1:k], lambda z: length(z)))))::BIGINT AS ends FROM q),
w AS (SELECT *, {_strip('substr(segment, greatest(ends - 200, 0) + 1, least(ends, 200))')} AS b, {_strip('substr(segment, ends + 1, 300)')} AS a FROM c),
h AS (SELECT row_id, segment_no, any_value(segment) AS segment, min(ends) AS ends FROM w WHERE length(b) >= 20 AND length(a) >= 15 AND {_akkadian('b')} >= 0.3 AND {_english('a')} >= 0.15 AND {_english('b')} <= 0.3 AND {_foreign('a')} <= 1.0 GROUP BY row_id, segment_no),
v AS (SELECT row_id, segment_no, string_split(regexp_replace({_strip('substr(segment, greatest(ends - 800, 0) + 1, least(ends, 800))')}, '{fixed.TEXT_HEADER}', '', 'g'), chr(10)) AS x,
 string_split(string_split_regex({_strip('substr(segment, ends + 1, 2000)')}, '{fixed.TEXT_HEADER}')[1], chr(10)) AS y FROM h),
u AS (SELECT *, list_position(list_transform(x, lambda x: {_strip('x')} = '' OR regexp_matches(x, '[{fixed.DIACRITICS}]')), true) AS i, list_position(list_transform(y, lambda x: {begins}), true) AS j FROM v),
o AS (SELECT row_id, segment_no, {fold(f"regexp_replace(array_to_string(CASE WHEN coalesce(i, 0) = 0 THEN [] ELSE x[i:] END, chr(10)), '{fixed.LABEL}', '', 'g')")} AS s,
 {fold(f"regexp_replace(array_to_string(CASE WHEN coalesce(j, 0) = 0 THEN y ELSE y[1:j - 1] END, chr(10)), '{fixed.REFERENCE}', '')")} AS r FROM u),
pairs AS (SELECT row_id, segment_no::INTEGER AS segment_no, s AS transliteration, r AS translation FROM o WHERE length(s) >= 100 AND length(r) >= 100 AND {_akkadian('s')} >= 1.0 AND {_english('s')} <= 0.2 AND {_foreign('s')} <= 0.5
 AND {_english('r')} >= 0.4 AND {_english('substr(r, 1, 300)')} >= 0.15 AND {_foreign('r')} <= 0.5)"""


@query(f"WITH p AS (SELECT row_id, coalesce(page_text, '') AS t FROM publications), {_segments('p')} SELECT row_id, segment_no::INTEGER AS segment_no, segment FROM g")
def page_segments(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "publications").select("row_id", F.posexplode(parse.segments("page_text")).alias("segment_no", "segment"))


_CLEAN = f"f AS (SELECT row_id, page_text AS t FROM ({_CORRECTED}))"


@query(f"WITH {_CLEAN}, p AS (SELECT row_id, t FROM f JOIN publications USING (row_id) WHERE has_akkadian), {_parsed('p')} SELECT * FROM pairs")
def parsed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "publications").where("has_akkadian").select("row_id", ocr.correct("page_text").alias("page_text"))
    return parse.extract_pairs(pages)


# --- joins, lookups, duplicates ----------------------------------------------------------------------------------------------

_PN = """pn AS (SELECT form, max_by(coalesce(norm, form), row_id) AS norm, max_by(coalesce(lexeme, norm, form), row_id) AS lexeme, max_by(type, row_id) AS type, min(row_id) AS pos
 FROM oa_lexicon_ebl WHERE type IN ('PN', 'GN') AND form IS NOT NULL GROUP BY form)"""
_BASE = rf"""base AS (SELECT base, arg_min(d, row_id) AS definition FROM (SELECT row_id, {_strip("regexp_replace(word, ' +(I|II|III|IV)$', '')")} AS base,
 {_strip("regexp_replace(coalesce(definition, ''), '^" + chr(34) + "+|" + chr(34) + "+$', '', 'g')")} AS d FROM ebl_dictionary) WHERE base <> '' AND d <> '' GROUP BY base)"""
_SG = """firsts AS (SELECT form, arg_min({'l': lexeme, 'n': norm}, row_id) AS e FROM oa_lexicon_ebl WHERE length(form) >= 2 AND upper(form) = form AND lower(form) <> form GROUP BY form),
roots AS (SELECT form, e.l AS r, 0 AS k FROM firsts UNION ALL SELECT form, e.n, 10 FROM firsts),
tried AS (SELECT form, unnest([r, r || 'u', r || 'um']) AS base, unnest([k, k + 1, k + 2]) AS p FROM roots WHERE r <> ''
 UNION ALL SELECT form, unnest([left(r, length(r) - 1), left(r, length(r) - 1) || 'u', left(r, length(r) - 1) || 'um']), unnest([k + 3, k + 4, k + 5]) FROM roots WHERE r LIKE '%m' AND length(r) > 2),
hit AS (SELECT form, arg_min(definition, p) AS d FROM tried JOIN base USING (base) GROUP BY form),
sg AS (SELECT f.form, coalesce(h.d, f.e.n) AS definition FROM firsts f LEFT JOIN hit h USING (form))"""


@query(f"WITH {_PN} SELECT * FROM pn")
def name_table(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.proper_noun_table(read(spark, folder, "oa_lexicon_ebl"))


@query("SELECT word, max_by(definition, row_id) AS definition FROM ebl_dictionary WHERE definition <> '' AND word IS NOT NULL GROUP BY word")
def dictionary_words(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.dictionary_table(read(spark, folder, "ebl_dictionary"))


@query(f"WITH {_BASE} SELECT * FROM base")
def dictionary_bases(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.base_table(read(spark, folder, "ebl_dictionary"))


@query(f"WITH {_BASE}, {_SG} SELECT * FROM sg")
def sumerogram_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.sumerogram_table(read(spark, folder, "oa_lexicon_ebl"), read(spark, folder, "ebl_dictionary"))


@query(f"WITH {_PN} SELECT c.ref_id, c.form, p.norm, p.lexeme, p.type, CASE WHEN p.form IS NOT NULL THEN 1.0::DOUBLE END AS similarity FROM canon_names c LEFT JOIN pn p USING (form)")
def exact_name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    terms = read(spark, folder, "canon_names").select("ref_id", "form")
    return lexicon.lookup_exact(terms, "form", lexicon.proper_noun_table(read(spark, folder, "oa_lexicon_ebl")))


@query()
def fuzzy_name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    terms = read(spark, folder, "canon_names").select("form")
    return lexicon.fuzzy_matches(terms, "form", lexicon.proper_noun_table(read(spark, folder, "oa_lexicon_ebl")))


@query(f"""WITH {_BASE}, {_SG}, w AS (SELECT row_id, form FROM oa_lexicon_ebl WHERE type = 'word')
SELECT w.row_id, w.form, coalesce(a.definition, b.definition) AS definition FROM w LEFT JOIN sg a ON a.form = w.form LEFT JOIN sg b ON b.form = replace(w.form, '.', '')""")
def sumerogram_lookup(spark: SparkSession, folder: str) -> DataFrame:
    lex = read(spark, folder, "oa_lexicon_ebl")
    return lexicon.lookup_sumerograms(lex.where("type = 'word'").select("row_id", "form"), "form", lexicon.sumerogram_table(lex, read(spark, folder, "ebl_dictionary")))


@query("""SELECT w.row_id, w.lexeme, d.definition FROM oa_lexicon_ebl w LEFT JOIN (SELECT word, max_by(definition, row_id) AS definition FROM ebl_dictionary
 WHERE definition <> '' AND word IS NOT NULL GROUP BY word) d ON d.word = w.lexeme WHERE w.lexeme IS NOT NULL""")
def dictionary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    terms = read(spark, folder, "oa_lexicon_ebl").where("lexeme is not null").select("row_id", "lexeme")
    return lexicon.lookup_dictionary(terms, "lexeme", read(spark, folder, "ebl_dictionary"))


@query(f"""WITH {_PN}, {_BASE}, {_SG} SELECT (SELECT count(*) FROM pn) AS proper_nouns, (SELECT count(*) FROM sg WHERE definition <> '') AS sumerograms,
(SELECT count(DISTINCT word) FROM ebl_dictionary WHERE definition <> '') AS dictionary""")
def lexicon_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.lexicon_stats(read(spark, folder, "oa_lexicon_ebl"), read(spark, folder, "ebl_dictionary"))


_GRAMS = f"""keyed AS (SELECT t, row_id, {_key('x')} AS k FROM texts),
g AS MATERIALIZED (SELECT DISTINCT t, row_id, substr(k, i, 3) AS g FROM (SELECT t, row_id, k, unnest(range(1, length(k) - 1)) AS i FROM keyed WHERE length(k) >= 3)),
n AS MATERIALIZED (SELECT t, row_id, count(*) AS n FROM g GROUP BY ALL)"""


@query(f"""WITH texts AS (SELECT 0 AS t, row_id, transliteration AS x FROM extracted_pairs UNION ALL SELECT 1, row_id, transliteration FROM train_sentences), {_GRAMS},
hit AS (SELECT a.row_id FROM g a JOIN g b ON a.g = b.g AND a.t = 0 AND b.t = 1 JOIN n x ON x.t = 0 AND x.row_id = a.row_id JOIN n y ON y.t = 1 AND y.row_id = b.row_id
 GROUP BY a.row_id, b.row_id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.7)
SELECT row_id AS id FROM (SELECT row_id FROM hit UNION SELECT row_id FROM keyed WHERE t = 0 AND length(k) < 3)""")
def existing_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.existing_duplicates(read(spark, folder, "extracted_pairs"), read(spark, folder, "train_sentences"), "transliteration").distinct()


@query(f"""WITH RECURSIVE texts AS (SELECT 0 AS t, row_id, transliteration AS x FROM extracted_pairs), {_GRAMS},
e AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id JOIN n x ON x.row_id = a.row_id JOIN n y ON y.row_id = b.row_id
 GROUP BY a.row_id, b.row_id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.7),
later AS (SELECT b, list(a) AS before FROM e GROUP BY b),
o AS MATERIALIZED (SELECT b, before, row_number() OVER (ORDER BY b) AS k FROM later),
r(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.k + 1, CASE WHEN len(list_filter(o.before, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, o.b) ELSE r.gone END FROM r JOIN o ON o.k = r.k + 1)
SELECT row_id FROM n WHERE NOT list_contains((SELECT gone FROM r ORDER BY k DESC LIMIT 1), row_id)""")
def near_dedup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_dedup(read(spark, folder, "extracted_pairs"), "transliteration").select("row_id")


# --- vectors -------------------------------------------------------------------------------------------------------------------


_KNN = """SELECT query_id, id, distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, d AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id)::INTEGER AS rank
 FROM (SELECT q.vec_id AS qi, v.vec_id AS vi, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 6) AS d
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) x JOIN embeddings q ON q.vec_id = x.qi JOIN embeddings v ON v.vec_id = x.vi) WHERE rank <= 5"""


@query(f"SELECT k.*, transliteration, translation FROM ({_KNN}) k JOIN train ON row_id = id")
def knn_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours with their rows of the corpus; those beyond it are dropped."""
    hits = knn_topk(spark, folder)
    return vector.with_corpus(hits, read(spark, folder, "train")).select("query_id", "id", "distance", "rank", "transliteration", "translation")


@query(_KNN)
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector.search(v.where("vec_id % 20 = 0"), v, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query()
def knn_ivf(spark: SparkSession, folder: str) -> DataFrame:
    v = read(spark, folder, "embeddings").select("vec_id", "embedding")
    index, centers = vector.build_ivf(v)
    return vector.search_ivf(v.where("vec_id % 20 = 0"), index, centers, 5, nprobe=max(1, len(centers) // 2))


@query()
def query_contexts(spark: SparkSession, folder: str) -> DataFrame:
    lex = read(spark, folder, "oa_lexicon_ebl")
    return lexicon.query_context(read(spark, folder, "train_sentences"), lexicon.proper_noun_table(lex), lexicon.sumerogram_table(lex, read(spark, folder, "ebl_dictionary")))


@query("SELECT 'flat' AS kind, count(*) AS n_vectors, 64::INTEGER AS dimension, 0::INTEGER AS cells FROM embeddings")
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return vector.Index(read(spark, folder, "embeddings")).stats()


def _retrieved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(passages, names, Sumerograms, the three nearest documents of each passage): the passages whose id is divisible by 20
    against all documents, by hashed trigrams."""
    lex, rows = read(spark, folder, "oa_lexicon_ebl"), read(spark, folder, "train_sentences").where("row_id % 20 = 0")
    corpus = read(spark, folder, "train").select("row_id", "transliteration", "translation")
    names, table = lexicon.proper_noun_table(lex), lexicon.sumerogram_table(lex, read(spark, folder, "ebl_dictionary"))
    embedder = lambda: models.hashed_vectors
    index = vector.Index(models.embed(corpus.select("row_id", "transliteration"), "transliteration", embedder), id_column="row_id")
    return rows, names, table, pipelines.retrieve(rows, index, corpus, embedder, names, table, 3)


@query()
def retrieved_examples(spark: SparkSession, folder: str) -> DataFrame:
    return _retrieved(spark, folder)[3].withColumn("distance", F.round("distance", 6))


@query()
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon section, the nearest examples and the text of each passage, within the budget."""
    rows, names, table, hits = _retrieved(spark, folder)
    return context.assemble_all(rows, names, table, hits)


@query()
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Passages prepared for training: augmented, with prompts and byte ids."""
    lex = read(spark, folder, "oa_lexicon_ebl")
    return pipelines.prepare_training(read(spark, folder, "train_sentences"), lexicon.proper_noun_table(lex), lexicon.sumerogram_table(lex, read(spark, folder, "ebl_dictionary")))


def _assembled(budget: int) -> str:
    rest = f"({budget} - length(l) - 4)"
    half = f"CAST(floor({rest} / 2) AS BIGINT)"
    cut = lambda s, n: f"CASE WHEN {n} >= 0 THEN left({s}, {n}) ELSE left({s}, greatest(length({s}) + {n}, 0)) END"
    return f"""WITH p AS (SELECT row_id, coalesce(transliteration, '') AS a, coalesce(translation, '') AS b, 'Translate: ' || coalesce(source_pdf, '') AS l FROM extracted_pairs),
w AS (SELECT *, list_filter([a, b, l], lambda x: x <> '') AS parts FROM p), v AS (SELECT *, array_to_string(parts, chr(10) || chr(10)) AS whole, len(parts) AS n FROM w)
SELECT row_id, CASE WHEN length(whole) <= {budget} THEN whole WHEN n = 1 THEN left(whole, {budget})
 WHEN n = 2 THEN {cut('parts[1]', rest)} || chr(10) || chr(10) || l
 ELSE {cut('parts[1]', half)} || chr(10) || chr(10) || {cut('parts[2]', half)} || chr(10) || chr(10) || l END AS prompt FROM v"""


@query(_assembled(400))
def assembled(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "extracted_pairs").select("row_id", context.assemble(T.text("transliteration"), T.text("translation"), F.col("source_pdf"), 400).alias("prompt"))


# --- metrics -------------------------------------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of both tables side by side, by number."""
    e, s = (read(spark, folder, t).select("row_id", "transliteration", F.col("translation").alias(c)) for t, c in (("extracted_pairs", "hypothesis"), ("train_sentences", "reference")))
    return e.join(s.select("row_id", "reference"), "row_id")


def _bleu_tokens(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "chr(34)"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        x = f"replace({x}, {a}, {b})"
    x = f"' ' || {x} || ' '"
    for a, b in ((r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '{_S}+'), lambda w: w <> '')"


_SIDES = "SELECT row_id, e.transliteration AS src, e.translation AS h, s.translation AS f FROM extracted_pairs e JOIN train_sentences s USING (row_id)"
_CHRF = rf"""r AS (SELECT row_id, regexp_replace(coalesce(h, ''), '{_S}', '', 'g') AS h, regexp_replace(coalesce(f, ''), '{_S}', '', 'g') AS f FROM side),
o AS (SELECT unnest(range(1, 7)) AS n),
c AS (SELECT row_id, n, g, sum(a) AS a, sum(b) AS b FROM (
 SELECT row_id, n, substr(h, i, n) AS g, 1 AS a, 0 AS b FROM (SELECT row_id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM r, o WHERE length(h) >= n)
 UNION ALL SELECT row_id, n, substr(f, i, n), 0, 1 FROM (SELECT row_id, f, n, unnest(range(1, length(f) - n + 2)) AS i FROM r, o WHERE length(f) >= n)) GROUP BY ALL),
t AS (SELECT n, sum(least(a, b))::DOUBLE AS m, sum(a) AS a, sum(b) AS b FROM c GROUP BY n HAVING sum(a) > 0 AND sum(b) > 0),
q AS (SELECT avg(m / a) AS p, avg(m / b) AS r FROM t),
chrf AS (SELECT round(100 * coalesce(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0.0 END, 0), 6)::DOUBLE AS chrf FROM q)"""


def _metrics(rows: str) -> str:
    """BLEU with exponential smoothing, chrF, their geometric mean and the names, of rows (row_id, src, h, f)."""
    zeros = lambda n: "(" + " + ".join(f"(m{k} = 0 AND t{k} > 0)::INTEGER" for k in range(1, n + 1)) + ")"
    p = [f"CASE WHEN t{n} = 0 THEN 0.0 WHEN m{n} = 0 THEN 100.0 / (2.0 ** {zeros(n)} * t{n}) ELSE 100.0 * m{n} / t{n} END" for n in range(1, 5)]
    pivot = ", ".join(f"coalesce(max(least_) FILTER (n = {n}), 0)::DOUBLE AS m{n}, coalesce(max(total) FILTER (n = {n}), 0)::DOUBLE AS t{n}" for n in range(1, 5))
    grams = lambda c, a, b: f"SELECT row_id, n, array_to_string({c}[i:i + n - 1], chr(1)) AS g, {a} AS a, {b} AS b FROM (SELECT *, unnest(range(1, len({c}) - n + 2)) AS i FROM tok, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len({c}) >= n)"
    key = _match("name")
    return f"""WITH side AS ({rows}), {_CHRF},
tok AS (SELECT row_id, {_bleu_tokens('h')} AS th, {_bleu_tokens('f')} AS tf FROM side),
bg AS (SELECT row_id, n, g, sum(a) AS a, sum(b) AS b FROM ({grams('th', 1, 0)} UNION ALL {grams('tf', 0, 1)}) GROUP BY ALL),
bn AS (SELECT n, sum(least(a, b)) AS least_, sum(a) AS total FROM bg GROUP BY n),
bs AS (SELECT {pivot}, (SELECT sum(len(th)) FROM tok)::BIGINT AS hyp_len, (SELECT sum(len(tf)) FROM tok)::BIGINT AS ref_len FROM bn),
bp AS (SELECT *, {', '.join(f'{x} AS q{k + 1}' for k, x in enumerate(p))}, CASE WHEN hyp_len = 0 THEN 0.0 WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1.0 END AS bp_ FROM bs),
bl AS (SELECT round(CASE WHEN m1 + m2 + m3 + m4 = 0 OR t1 * t2 * t3 * t4 = 0 THEN 0.0 ELSE bp_ * exp((ln(q1) + ln(q2) + ln(q3) + ln(q4)) / 4) END, 6)::DOUBLE AS bleu, round(q1, 6)::DOUBLE AS p1, round(q2, 6)::DOUBLE AS p2, round(q3, 6)::DOUBLE AS p3, round(q4, 6)::DOUBLE AS p4, round(bp_, 6)::DOUBLE AS bp, hyp_len, ref_len FROM bp),
nm AS (SELECT unnest({_names("coalesce(src, '')")}) AS name, {_match('h')} AS kh, {_match('f')} AS kf FROM side),
na AS (SELECT count(*) AS total_proper_nouns, count(*) FILTER (contains(kh, {key})) AS correct_in_hypothesis, count(*) FILTER (contains(kf, {key})) AS correct_in_reference FROM nm)
SELECT bl.*, chrf, round(CASE WHEN bleu > 0 AND chrf > 0 THEN sqrt(bleu * chrf) ELSE 0.0 END, 6)::DOUBLE AS geometric_mean,
CASE WHEN total_proper_nouns > 0 THEN round(correct_in_hypothesis / total_proper_nouns, 6) ELSE 0.0 END::DOUBLE AS proper_noun_accuracy,
CASE WHEN total_proper_nouns > 0 THEN round(correct_in_reference / total_proper_nouns, 6) ELSE 0.0 END::DOUBLE AS proper_noun_recall_ref, na.* FROM bl, chrf, na"""


@query(_metrics(_SIDES))
def corpus_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.all_metrics(_evaluated(spark, folder), "hypothesis", "reference", "transliteration")


@query(f"WITH side AS ({_SIDES}), {_CHRF} SELECT * FROM chrf")
def chrf_score(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.chrf(_evaluated(spark, folder), "hypothesis", "reference")


@query(_metrics("SELECT row_id, transliteration AS src, coalesce(transliteration, '') AS h, translation AS f FROM train_sentences"))
def evaluated_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of a predictor that copies its input."""
    return pipelines.evaluate(read(spark, folder, "train_sentences"), lambda: lambda texts: texts)


# --- samples, splits, augmentation, submission ---------------------------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS n, ceil(count(*) * 0.1 - 1e-9)::BIGINT AS t FROM train), v AS (SELECT n, t, ceil((n - t) * (0.1 / 0.9) - 1e-9)::BIGINT AS v FROM n)
SELECT unnest(['train', 'val', 'test']) AS split, unnest([n - t - v, v, t])::BIGINT AS n FROM v""")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sample.random_split(read(spark, folder, "train")).groupBy("split").agg(F.count("*").alias("n"))


def _draw(x: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}/' || {x}), 1, 15))::BIGINT"


@query(f"SELECT row_id, split FROM (SELECT row_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'val' ELSE 'train' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY {_draw('row_id')}, row_id) AS k FROM train), "
       "(SELECT t, ceil((n - t) * (0.1 / 0.9) - 1e-9)::BIGINT AS v FROM (SELECT count(*) AS n, ceil(count(*) * 0.1 - 1e-9)::BIGINT AS t FROM train)))")
def split_members(spark: SparkSession, folder: str) -> DataFrame:
    return sample.random_split(read(spark, folder, "train")).select("row_id", "split")


@query("SELECT row_id, oare_id FROM train ORDER BY row_id LIMIT 3")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first three rows, as a look at a table shows them."""
    return sample.first_rows(read(spark, folder, "train"), 3).select("row_id", "oare_id")


@query("SELECT row_id, transliteration, translation FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS k FROM combined_corpus) WHERE k = 7")
def corpus_entry(spark: SparkSession, folder: str) -> DataFrame:
    return vector.entry_at(read(spark, folder, "combined_corpus"), 7).select("row_id", "transliteration", "translation")


@query("SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_no, row_id FROM train WHERE translation IS NOT NULL")
def renumbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.numbered(read(spark, folder, "train").where("translation is not null").select("row_id")).select("row_no", "row_id")


@query(f"SELECT row_id, pdf_name FROM publications WHERE pdf_name IN (SELECT pdf_name FROM (SELECT DISTINCT pdf_name FROM publications WHERE pdf_name IS NOT NULL) ORDER BY {_draw('pdf_name')}, pdf_name LIMIT 5)")
def sampled_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    return sample.sample_groups(read(spark, folder, "publications"), "pdf_name", 5).select("row_id", "pdf_name")


@query(f"SELECT row_id FROM train ORDER BY {_draw('row_id')}, row_id LIMIT 100")
def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sample.sample_rows(read(spark, folder, "train"), 100).select("row_id")


def _augmented(table: str, column: str, factor: int, prob: float, big: float, seed: int = 42) -> str:
    u = lambda *x: f"('0x' || substr(md5(concat_ws('/', '{seed}', row_id, copy, {', '.join(x)})), 1, 8))::BIGINT / 4294967296.0"
    bare = "translate(word, '{}[]', '')"
    return f"""WITH t AS (SELECT row_id, {column} AS x, copy, list_filter(regexp_split_to_array({column}, '{_S}+'), lambda w: w <> '') AS w FROM {table}, (SELECT unnest(range(0, {factor + 1})) AS copy)),
n AS (SELECT row_id, copy, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t WHERE copy > 0 AND len(w) >= 3 AND {u("'copy'")} <= {prob}),
e AS (SELECT row_id, copy, i, row_number() OVER (PARTITION BY row_id, copy ORDER BY {u("'place'", 'i')}, i) AS k, count(*) OVER (PARTITION BY row_id, copy) AS m FROM n
 WHERE i > 0 AND i < n - 1 AND NOT {_CAPITALS.format('left(word, 1)')} AND NOT (length({bare}) >= 2 AND {_CAPITALS.format(bare)})),
c AS (SELECT row_id, copy, i FROM e WHERE k <= 1 + floor({u("'many'")} * least(m, 3))),
g AS (SELECT row_id, copy, i, {u("'big'", 'i')} < {big} AS big, {u("'span'", 'i')} >= 0.5 AS two FROM c WHERE (row_id, copy, i - 1) NOT IN (SELECT (row_id, copy, i) FROM c)),
o AS (SELECT n.row_id, n.copy, string_agg(CASE WHEN g.i IS NULL THEN word WHEN g.big THEN '{fixed.BIG_GAP}' ELSE '{fixed.SINGLE_GAP}' END, ' ' ORDER BY n.i) AS y
 FROM n LEFT JOIN g ON g.row_id = n.row_id AND g.copy = n.copy AND g.i = n.i LEFT JOIN g b ON b.row_id = n.row_id AND b.copy = n.copy AND b.i = n.i - 1 AND b.big AND b.two WHERE b.i IS NULL GROUP BY ALL),
able AS (SELECT DISTINCT row_id, copy FROM e)
SELECT t.row_id, CASE WHEN able.row_id IS NULL THEN x WHEN o.y IS NULL THEN x ELSE o.y END AS {column}, t.copy::INTEGER AS copy FROM t LEFT JOIN o ON o.row_id = t.row_id AND o.copy = t.copy LEFT JOIN able ON able.row_id = t.row_id AND able.copy = t.copy"""


@query(_augmented("train_sentences", "transliteration", 2, 0.3, 0.3))
def augmented(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "train_sentences").select("row_id", "transliteration")
    return augment.augment(rows, factor=2, gap_prob=0.3)


@query("""SELECT t.row_id AS id, coalesce(p.translation, '') AS translation FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM train) t
 JOIN (SELECT translation, row_number() OVER (ORDER BY row_id DESC) AS k FROM train) p USING (k)""")
def zipped_submission(spark: SparkSession, folder: str) -> DataFrame:
    train = read(spark, folder, "train")
    predictions = train.select((-F.col("row_id")).alias("row_id"), F.col("translation").alias("prediction"))
    return submit.zip_predictions(train.select(F.col("row_id").alias("id")), predictions)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (source_page IS NULL) = 0 AS valid, count(*) FILTER (source_page IS NULL) AS null_ids, count(*) FILTER (translation IS NULL) AS null_texts,
0::BIGINT AS non_integer_ids, '' AS missing_columns FROM extracted_pairs""")
def validated_submission(spark: SparkSession, folder: str) -> DataFrame:
    return submit.validate_submission(read(spark, folder, "extracted_pairs").select(F.col("source_page").alias("id"), "translation"))


@query("SELECT row_id, list_append(list_transform(range(1, least(octet_length(encode(x)), 511) + 1), lambda i: (('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::INTEGER + 3)::INTEGER), 1::INTEGER)::INTEGER[] AS ids FROM (SELECT row_id, coalesce(translation, '') AS x FROM train_sentences)")
def byte_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "train_sentences").select("row_id", models.byte_ids("translation").alias("ids"))


# --- pipelines -------------------------------------------------------------------------------------------------------------------


_EXTRACTED = f"""WITH RECURSIVE {_CLEAN}, flagged AS (SELECT * FROM (SELECT row_id, pdf_name, page, row_number() OVER (PARTITION BY pdf_name, page ORDER BY row_id) AS k FROM publications WHERE has_akkadian) WHERE k = 1),
placed AS (SELECT *, min(row_id) OVER (PARTITION BY pdf_name) AS first FROM flagged), p AS (SELECT row_id, t FROM f JOIN placed USING (row_id)), {_parsed('p')},
ranked AS (SELECT pairs.*, pdf_name, page, row_number() OVER (ORDER BY first, page IS NULL, page, row_id, segment_no) AS k FROM pairs JOIN placed USING (row_id)),
texts AS (SELECT 0 AS t, k AS row_id, transliteration AS x FROM ranked UNION ALL SELECT 1, row_id, transliteration FROM combined_corpus), {_GRAMS.replace("g AS MATERIALIZED", "gr AS MATERIALIZED").replace("FROM g GROUP", "FROM gr GROUP").replace("n AS MATERIALIZED", "nn AS MATERIALIZED")},
old AS (SELECT DISTINCT a.row_id FROM (SELECT a.row_id, b.row_id AS o, count(*) AS s FROM gr a JOIN gr b ON a.g = b.g AND a.t = 0 AND b.t = 1 GROUP BY ALL) a JOIN nn x ON x.t = 0 AND x.row_id = a.row_id JOIN nn y ON y.t = 1 AND y.row_id = a.o WHERE s::DOUBLE / (x.n + y.n - s) >= 0.7),
fresh AS (SELECT row_id FROM nn WHERE t = 0 AND row_id NOT IN (SELECT row_id FROM old)),
e AS (SELECT a, b FROM (SELECT a.row_id AS a, b.row_id AS b, count(*) AS s FROM gr a JOIN gr b ON a.g = b.g AND a.t = 0 AND b.t = 0 AND a.row_id < b.row_id GROUP BY ALL) JOIN nn x ON x.t = 0 AND x.row_id = a JOIN nn y ON y.t = 0 AND y.row_id = b
 WHERE s::DOUBLE / (x.n + y.n - s) >= 0.7 AND a IN (FROM fresh) AND b IN (FROM fresh)),
later AS (SELECT b, list(a) AS before FROM e GROUP BY b), od AS (SELECT b, before, row_number() OVER (ORDER BY b) AS k FROM later),
rr(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT rr.k + 1, CASE WHEN len(list_filter(od.before, lambda x: NOT list_contains(rr.gone, x))) > 0 THEN list_append(rr.gone, od.b) ELSE rr.gone END FROM rr JOIN od ON od.k = rr.k + 1)
SELECT transliteration, translation, NULL::VARCHAR AS source_pdf, NULL::INTEGER AS source_page, 0::INTEGER AS src FROM combined_corpus
UNION ALL SELECT {_normalize('transliteration')}, {_normalize('translation')}, pdf_name, page, 1 FROM ranked WHERE k IN (FROM fresh) AND NOT list_contains((SELECT gone FROM rr ORDER BY k DESC LIMIT 1), k)"""


@query(_EXTRACTED)
def pipeline_publications(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.extract_publications(read(spark, folder, "publications"), read(spark, folder, "combined_corpus"))


@query(f"SELECT row_id, {_normalize('transliteration')} AS transliteration, coalesce(translation, '') AS translation FROM train")
def pipeline_preprocess(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.preprocess(read(spark, folder, "train"))[0].select("row_id", "transliteration", "translation")

