"""The driver contract, plans, and the core queries on the smallest tables."""

import pytest

import __spark_entry__


def test_entry(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["term", "n"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_queries_match_their_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    from tabletloom.plans import queries as core

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")

    def rows(table):
        names = sorted(table.column_names)
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)), names

    for name in core.ORACLES:
        assert rows(core.QUERIES[name](spark, data).toArrow()) == rows(con.execute(core.ORACLES[name]).to_arrow_table()), name


def test_filters_and_columns_reach_the_scan(spark, data):
    from tabletloom.plans import queries as core

    plan = core.QUERIES["flagged_pages"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(has_akkadian), EqualTo(has_akkadian,true)]" in plan
    assert "page_text" not in plan.partition("ReadSchema:")[2].splitlines()[0]


@pytest.mark.parametrize("name", ["normalize_train", "ocr_correct", "align_sentences", "proper_noun_counts", "language_scores", "name_table", "assembled"])
def test_no_python_in_the_plan(spark, data, name):
    from tabletloom.plans import queries as core

    plan = core.QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan


def test_pipeline(spark, data):
    from tabletloom.plans import queries as core

    out = core.QUERIES["pipeline_publications"](spark, data)
    assert out.where("src = 0").count() == spark.read.parquet(f"{data}/combined_corpus.parquet").count()
