"""Read models published as documents."""
import json

from pyspark.sql import functions as F

from tallygrid.sources import read_models as D


def _docs(spark, rows):
    return spark.createDataFrame(rows, "model string, key string, payload string")


def test_only_changed_documents_are_written(spark, tmp_path):
    t = D.create(spark, str(tmp_path / "t"), 4)
    rows = [("a", str(i), f'{{"n":{i}}}') for i in range(30)] + [("b", str(i), "{}") for i in range(5)]
    assert D.publish(t, _docs(spark, rows)).count() == 35
    version = t.manifest().version
    assert D.publish(t, _docs(spark, rows)).count() == 0 and t.manifest().version == version
    # one changed, one gone, one new; model b is not part of the run and stays
    some = [r for r in rows if r[0] == "a" and r[1] not in ("3", "4")] + [("a", "4", '{"n":-4}'), ("a", "new", "{}")]
    diff = sorted(tuple(r) for r in D.publish(t, _docs(spark, some)).collect())
    assert diff == [("a", "3", 2), ("a", "4", 0), ("a", "new", 0)]
    assert {(r["model"], r["key"]): r["payload"] for r in t.read().collect()} == {(m, k): p for m, k, p in [*some, *rows[30:]]}


def test_the_comparison_reads_no_stored_payload(spark, tmp_path):
    t = D.create(spark, str(tmp_path / "t"), 2)
    D.publish(t, _docs(spark, [("a", "1", "{}"), ("a", "2", "{}")]))
    plan = t.read(columns=["hash"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "payload" not in plan


def test_pages_hold_whole_groups_in_order(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("g"), (-F.col("id")).alias("v"))
    docs = {r["key"]: json.loads(r["payload"]) for r in D.pages(df, "m", ["g"], ["v"], ["v"], size=5).collect()}
    assert sorted(docs) == ["0/0", "0/1", "0/2", "1/0", "1/1", "1/2"] and all(len(d["rows"]) <= 5 for d in docs.values())
    assert [r["v"] for p in range(3) for r in docs[f"0/{p}"]["rows"]] == sorted(-i for i in range(0, 25, 2))


def test_documents_of_nothing(spark, tmp_path):
    t = D.create(spark, str(tmp_path / "t"))
    assert D.publish(t, _docs(spark, [])).count() == 0 and D.read(t, "a", "n int").collect() == []
