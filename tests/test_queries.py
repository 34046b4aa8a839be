"""Every query with SQL gives what DuckDB gives; the others give rows with a stable schema."""

from __future__ import annotations

import duckdb
import pytest

from foragelake.plans.oracle import ORACLE_SQL
from foragelake.plans.queries import QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark_df, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    ours = sorted(str([r[n] for n in sorted(names)]) for r in spark_df.collect())
    theirs = sorted(str([r[names.index(n)] for n in sorted(names)]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_research_run(spark):
    """Every valid question has one answer, whose counts fit its evidence and budgets."""
    answers = {r["query_id"]: r for r in QUERIES["explore_answers"](spark, SF).collect()}
    questions = QUERIES["important_words"](spark, SF).filter("NOT invalid").collect()
    assert set(answers) == {q["query_id"] for q in questions}
    for r in answers.values():
        assert r["n_findings"] <= 5 and r["n_sources"] <= 4 and r["search_passes"] <= 4 and r["headless_attempts"] <= 3
        assert (r["action"] == "answer") == (r["caveat"] is None)
