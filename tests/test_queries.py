"""Every query with SQL against DuckDB; the others run."""

import pytest

from planlens.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_spectrum_report_has_every_bracket(spark, sf):
    from planlens import queries as q

    assert QUERIES["spectrum_report_all"](spark, sf).count() == q._merged(spark, sf).count() > QUERIES["spectrum_report"](spark, sf).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_proof_keys_differ_by_cap_eps_and_contests(spark):
    from planlens.operators import brackets as B

    one = ("S1", "R", 5, "1/20", 1, "1/100", ["A"], "infeasible")
    rows = [one, one, (*one[:4], 2, *one[5:]), (*one[:5], "1/50", *one[6:]), (*one[:6], ["A", "B"], one[7]), (*one[:7], "feasible")]
    df = spark.createDataFrame(rows, "state string, party string, q int, m string, cap int, eps string, contests array<string>, status string")
    assert sorted(tuple(r) for r in B.proof_keys(df).collect()) == sorted(x[:7] for x in {repr(x): x for x in rows[:5]}.values())
