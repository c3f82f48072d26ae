"""Findings kept from run to run."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import findings as FD
from tallygrid.operators import quality as Q
from tallygrid.plans import q_quality
from tallygrid.plans.registry import table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inp(spark):
    return q_quality.inputs(spark, D, shared=True)


def _full(inp, filers):
    return sorted(tuple(r) for r in Q.run_rules(inp, filed_only=filers).select("entity", "severity", "rule", "detail").collect())


def _kept(t):
    return sorted(tuple(r) for r in FD.issues(t).collect())


def test_only_changed_entities_are_evaluated(spark, inp, tmp_path):
    filers = table(spark, D, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("entity"))
    n = inp.companies.count()
    t = FD.create(spark, str(tmp_path / "f"), buckets=8)
    first = FD.refresh(t, inp, filers)
    full = _full(inp, filers)
    assert first.evaluated == n and _kept(t) == full and sum(first.findings.values()) == len(full)
    again = FD.refresh(t, inp, filers)
    assert (again.evaluated, again.removed) == (0, 0) and _kept(t) == full
    # one percent of the entities change, one goes
    few = F.col("entity") % 100 == 7
    changed = replace(inp, companies=inp.companies.where("entity <> 3"), years=inp.years.withColumn("net_income", F.when(few, F.col("net_income") * -900).otherwise(F.col("net_income"))))
    run = FD.refresh(t, changed, filers)
    assert (run.evaluated, run.removed) == (inp.years.where(few).select("entity").distinct().count(), 1)
    assert 0 < run.evaluated <= n // 50
    assert _kept(t) == [r for r in _full(changed, filers) if r[0] != 3] and _kept(t) != full
    # the status of every entity comes from the kept lists
    want = {r["entity"]: r["status"] for r in Q.worst(FD.issues(t), changed.companies).collect()}
    assert {r["entity"]: r["status"] for r in FD.status(t).collect()} == want
    assert FD.visible(t).count() == Q.visible_issues(FD.issues(t), FD.status(t)).count()


def test_days_change_only_what_their_rules_see(spark, inp, tmp_path):
    t = FD.create(spark, str(tmp_path / "f"))
    FD.refresh(t, inp)
    later = replace(inp, today=F.lit("2001-09-16").cast("date"))
    run = FD.refresh(t, later)
    assert _kept(t) == _full(later, None) and run.evaluated < inp.companies.count()
