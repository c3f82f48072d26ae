import pytest
import os
import json
from datetime import date

from pyspark.sql import functions as F

from tallygrid.operators import extract as X
from tallygrid.operators import keyed as K
from tallygrid.plans import readmodels as RM
from tallygrid.session import estimated_bytes, small_side
from tallygrid.sources import files as FI
from tallygrid.sources import payloads as P
from tallygrid.sources import sinks as SK
from tallygrid.streaming import incremental as I

D = date.fromisoformat


def test_readers(spark, tmp_path, rows):
    w = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    s = "ticker string, v int"
    assert rows(FI.read_json_array(spark, w("a.json", '[{"ticker": "A", "v": 1},\n {"ticker": "B"}]'), s)) == [("A", 1), ("B", None)]
    assert FI.read_json_array(spark, w("b.json", '{"ticker": "A"}'), s).count() == 0 and FI.read_json_array(spark, w("c.json", "[oops"), s).count() == 0 and FI.read_json_array(spark, str(tmp_path / "none.json"), s).count() == 0
    j = w("d.jsonl", '{"ticker": "A", "v": 1}\n\n{bad\n{"ticker": "A"}\n{"v": 2}\n')
    assert FI.read_json_lines(spark, j, s).count() == 3 and rows(FI.field_values(spark, j, "ticker")) == [("A",)]
    sh = tmp_path / "shards"
    sh.mkdir()
    (sh / "a.json").write_text('{"entity": "X", "fetched_at": "2", "v": 1}\n{"entity": "Y", "fetched_at": "1", "v": 5}\n')
    (sh / "b.json").write_text('{"entity": "X", "fetched_at": "2", "v": 2}\n{"entity": "Y", "v": 6}\n{"v": 9}\n')
    assert rows(FI.read_shards(spark, str(sh), "entity string, fetched_at string, v int"), "entity", "v") == [("X", 2), ("Y", 5)]
    fx = w("fx.json", json.dumps({"CNY": {"per_usd": 7.1, "as_of": "2025-01-01"}}))
    assert rows(FI.read_fx(spark, fx)) == [("CNY", 7.1, "2025-01-01")] and FI.read_fx(spark, str(tmp_path / "nofx.json")).count() == 0
    q = tmp_path / "q"
    q.mkdir()
    (q / "1.json").write_text('{"ticker": "A", "v": 1}\n{"ticker": \n')
    good, bad = FI.read_quarantined(spark, str(q), s)
    assert (good.count(), bad.count()) == (1, 1)
    h = tmp_path / "html"
    h.mkdir()
    (h / "x.htm").write_text("<p>a</p>\n<tr><td>b</td><td>c</td></tr>")
    r = FI.read_html_corpus(spark, str(h)).first()
    assert (r.text, r.chars) == ("a\nb | c", 7)


def test_entity_shards_point_read(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i % 7}", i) for i in range(100)], "entity string, v int")
    p = str(tmp_path / "t")
    SK.write_by_entity(df, p, buckets=4)
    one = FI.read_entity(spark, p, "e3")
    assert sorted(r.v for r in one.collect()) == list(range(3, 100, 7))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "entity" in plan


def test_payload_shapes(spark, rows):
    a = spark.createDataFrame([("t", [1, 2], ["NYSE", "OTC"], ["A", ""])], "k string, n array<int>, form array<string>, f array<string>")
    assert rows(P.filings([a, a], ["k"], ["n", "form"], ["NYSE"])) == [("t", 1, "NYSE"), ("t", 1, "NYSE")]
    u = spark.createDataFrame([("A", "NYSE", 2), ("A", "Nasdaq", 1), ("", "NYSE", 3), ("B", "OTC", 4)], "ticker string, exchange string, pos int")
    assert rows(P.listing(u), "ticker", "pos") == [("A", 1)]
    d = spark.createDataFrame([("2025-05-01T1", "", ""), ("x", "http://a/2026/5/12/b", ""), (None, "http://a", "on 2024-01-03 it"), (None, "20249999", "none")], "p string, u string, s string")
    assert [str(r[0]) for r in d.select(P.source_date("p", "u", "s")).collect()] == ["2025-05-01", "2026-05-12", "2024-01-03", "None"]
    t = spark.createDataFrame([("2024年年度报告", 3), ("2024年年度报告摘要", 4), ("年度报告更正公告", 5), ("2023年年度报告", 1), ("2022年年度报告", 0)], "title string, time int").withColumn("e", F.lit("a")).withColumn("id", F.col("time"))
    assert sorted(r.time for r in P.announcements(t, ["e"], 2).collect()) == [1, 3]


def test_sinks(spark, tmp_path, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "k string, v int, s string")
    assert rows(K.upsert(old, new, ["k"])) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]
    assert rows(K.replace_rows(old, new, ["k"])) == [("a", None, "z"), ("b", 2, "y"), ("c", 3, None)]
    p = str(tmp_path / "docs")
    SK.write_documents(old, p, "k")
    assert rows(SK.changed_documents(SK.documents(K.upsert(old, new, ["k"]), "k"), spark.read.parquet(p)), "key") == [("a",), ("c",)]
    sch = "user_id int, entity string, name string, v int, source_hint string"
    have = spark.createDataFrame([(1, "e", f"n{i:02d}", i, "h") for i in range(59)], sch)
    more = spark.createDataFrame([(1, "e", "n00", 100, None), (1, "e", "z1", 1, None), (1, "e", "z2", 2, None), (2, "e", "z", 1, None)], sch)
    out = SK.save_series(have, more)
    assert out.where("user_id = 1").count() == 60 and rows(out.where("name = 'n00'"), "v", "source_hint") == [(100, "h")] and out.where("name = 'z2'").count() == 0
    log = spark.createDataFrame([("d1", ["b", "a"], "old"), ("d2", ["x"], "keep")], "date string, tickers array<string>, summary string")
    upd = spark.createDataFrame([("d1", ["c", "a"], "new")], "date string, tickers array<string>, summary string")
    assert [(r.date, r.tickers, r.n, r.summary) for r in SK.update_log(log, upd).orderBy("date").collect()] == [("d1", ["a", "b", "c"], 3, "new"), ("d2", ["x"], 1, "keep")]


def test_stream_equals_batch_in_any_arrival_order(spark, tmp_path, rows):
    fact = "entity string, metric string, unit string, rank int, concept string, form string, start date, end date, filed date, val double, fy int"
    data = [("a", "revenue", "USD", r, f"C{r}", "10-K", D("2024-01-01"), D("2024-12-31"), D(f), v, 2024) for r, f, v in ((0, "2025-02-01", 1.0), (0, "2026-02-01", 2.0), (1, "2027-02-01", 3.0), (0, "2024-12-31", 4.0))]
    want = rows(X.annual_values(spark.createDataFrame(data, fact)), "entity", "fiscal", "val")
    for n, order in enumerate(([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1])):
        src = str(tmp_path / f"src{n}")
        for i in order:
            spark.createDataFrame([data[i]], fact).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
        I.keep_state(X.annual_values(s), str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"), ["entity", "metric", "unit", "fiscal"])
        got = I.read_state(spark, str(tmp_path / f"out{n}"), ["entity", "metric", "unit", "fiscal"])
        assert rows(got, "entity", "fiscal", "val") == want == [("a", 2024, 2.0)]


def test_resume_adds_only_new_files(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("s", "o", "c"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(src)
        I.append_new_files(spark.readStream.schema("id bigint").parquet(src), out, cp)
        I.append_new_files(spark.readStream.schema("id bigint").parquet(src), out, cp)
    assert rows(spark.read.parquet(out)) == sorted([(i,) for i in range(20)], key=lambda r: str(r[0]))


def test_work_lists(spark, rows):
    pick = spark.createDataFrame([("a",), ("b",)], "entity string")
    log = spark.createDataFrame([(D("2025-01-01"), "x"), (D("2025-01-01"), "y")], "date date, entity string")
    done = spark.createDataFrame([(D("2025-01-01"), "x"), (D("2025-01-02"), "a")], "date date, entity string")
    assert rows(I.todays_work(pick, log, done, F.lit("2025-01-01").cast("date"))) == [("y",)]
    assert rows(I.todays_work(pick, log, done, F.lit("2025-01-02").cast("date"))) == [("b",)]
    st = spark.createDataFrame([("a", D("2025-01-01")), ("b", None), ("c", D("2025-01-07"))], "entity string, fetched_at date")
    assert rows(I.daily_slice(st, "entity", F.lit("2025-01-08").cast("date"))) == [("a",), ("b",)]
    r = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 2.0, 6.0, 3)], "k string, x double, eps double, version int")
    new = spark.createDataFrame([("a", 9.0, None), ("b", 9.0, 9.0)], "k string, x double, eps double")
    assert rows(I.reapply(r, new, ["k"], 3, ["eps"])) == [("a", 9.0, 5.0, 3), ("b", 2.0, 6.0, 3)]


def test_read_models(spark, rows):
    log = spark.createDataFrame([(D("2025-01-01"), 1, "s1", ["A", "B"]), (D("2025-01-02"), 2, "s2", ["A"])], "date date, ordinal int, summary string, industries array<string>")
    dig = spark.createDataFrame([("A", D("2025-01-01"), "old"), ("B", D("2025-01-01"), "same day")], "industry string, date date, summary string")
    assert rows(RM.newest_entry_per_industry(log, dig), "industry", "summary") == [("A", "s2"), ("B", "same day")]
    y = spark.createDataFrame([("a", D("2024-12-31"), 1.0, None, 5.0), ("a", D("2025-12-31"), 2.0, None, 6.0), ("a", D("2020-12-31"), 3.0, 4.0, 7.0)], "entity string, period date, rev double, ebitda double, shares double")
    q = spark.createDataFrame([("a", D("2025-09-30"), 0.5, None, 6.0), ("b", D("2025-09-30"), 1.5, None, None)], "entity string, period date, rev double, ebitda double, shares double")
    fx = spark.createDataFrame([("a", 2.0)], "entity string, factor double")
    sheet = RM.fact_sheet(y, q, "entity", ["rev", "ebitda", "shares"], 2, 1, factor=fx, counts=["shares"])
    assert rows(sheet) == [("a", "rev", 4.0, 2.0, 1.0), ("a", "shares", 6.0, 5.0, 6.0), ("b", "rev", None, None, 1.5)]


def test_broadcast_only_when_small(spark):
    small, big = spark.range(10), spark.range(10 ** 9)
    assert estimated_bytes(small) < estimated_bytes(big)
    has = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert has(small_side(small)) and not has(small_side(big))


def test_readers_accept_arrays_documents_and_lines(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {\n    "entity": "x",\n    "v": 1\n  },\n  {"entity": "y", "v": 2}\n]\n')
    (tmp_path / "b.json").write_text('{\n  "entity": "z",\n  "v": 3\n}\n')
    (tmp_path / "c.json").write_text('{"entity": "p", "v": 4}\n\n{"entity": "q", "v": 5}\n{"entity": bad\n')
    (tmp_path / "d.json").write_text('[{"entity": "broken"')
    (tmp_path / "e.json").write_text("")
    good, bad = FI.read_quarantined(spark, str(tmp_path), "entity string, v int")
    assert rows(good) == [("p", 4), ("q", 5), ("x", 1), ("y", 2), ("z", 3)]
    assert sorted(r.document for r in bad.collect()) == ['[{"entity": "broken"', '{"entity": bad']
    assert rows(FI.read_shards(spark, str(tmp_path), "entity string, v int, fetched_at string"), "entity", "v") == [("p", 4), ("q", 5), ("x", 1), ("y", 2), ("z", 3)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "f.json").write_text('{"entity": "p", "v": 4}\n[{"entity": "q", "v": 5}]\nnope\n')
    good, bad = FI.read_quarantined(spark, str(tmp_path / "lines"), "entity string, v int", lines=True)
    assert rows(good) == [("p", 4), ("q", 5)] and bad.count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tallygrid import session

    class Conf:
        def __init__(self, master): self.values = {"spark.master": master}
        def get(self, k, default=None): return self.values.get(k, default)
        def set(self, k, v): self.values[k] = v

    class Fake:
        def __init__(self, master):
            self.conf = Conf(master)
            self.sparkContext = type("C", (), {"getConf": lambda s: Conf(master)})()
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Fake(master))
    assert os.path.isdir(session.shared_dir(Fake("local[2]")))
    path = session.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    monkeypatch.setattr(session, "_PATHS", [path])
    session.drop_scratch(spark)
    assert not os.path.exists(path) and session._PATHS == []


def test_epochs_are_compacted(spark, rows, tmp_path):
    from tallygrid.operators.keyed import newest_per_key
    from tallygrid.streaming import incremental as I
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i in range(11):
        spark.createDataFrame([(i % 4, i, f"v{i}"), (100 + i, i, "own")], "k int, t int, v string").coalesce(1).write.mode("append").parquet(src)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    s = spark.readStream.schema("k int, t int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    I.keep_state(newest_per_key(s, ["k"], ["t"], ["v"]), out, cp, ["k"], every=5)
    assert spark.conf.get(key) == before
    assert sorted(p for p in os.listdir(out) if p.startswith("epoch")) == ["epoch=10"]
    state = rows(I.read_state(spark, out, ["k"]), "k", "v")
    assert len(state) == 15 and {(0, "v8"), (1, "v9"), (2, "v10"), (3, "v7")} <= set(state)


def test_json_lines_with_a_broken_first_line(spark, rows, tmp_path):
    forms = {"cut": '{"entity":"a","v\n{"entity":"b","v":2}\n{"entity":"c","v":3}\n', "comma": '{"entity":"a",\r\n[{"entity":"d","v":4}]\r\n',
             "bracket": '{\n{"entity":"e","v":5}\n\n {"entity":"f","v":6} \n',
             # no lines files: valid or broken documents over several lines
             "valid": '[{"entity":"i",\n"v":9},\n{"entity":"j","v":10}\n]', "one": '[\n{"entity":"k","v":11}', "list": '[{"entity":"l","v":12},\n{"entity":"m","v":13},\n{"entity":"n","v":14}', "deep": '{"entity":"o", "v": 15, "x": [\n[1,2]\n]}'}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    good, bad = FI.read_quarantined(spark, str(tmp_path), "entity string, v int")
    assert rows(good, "entity", "v") == [("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6), ("i", 9), ("j", 10), ("o", 15)]
    assert sorted(r[0] for r in rows(bad, "document")) == sorted(['{"entity":"a","v', '{"entity":"a",', "{", forms["one"], forms["list"]])
    shards = FI.read_shards(spark, str(tmp_path), "entity string, v int, fetched_at string")
    assert [r[0] for r in rows(shards, "entity")] == ["b", "c", "d", "e", "f", "i", "j", "o"]


def test_elements_of_large_arrays_are_not_written(spark, tmp_path, monkeypatch):
    """SRC-01: only what needs other splits is written between passes, and rows are not exchanged to leave broken files out."""
    from tallygrid.sources import json_arrays as J
    kept, write = {}, J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, label: kept.setdefault(label, write(df, label)))
    (tmp_path / "a.json").write_text("[" + ",\n".join(f'{{"k": {i}}}' for i in range(500)) + "]")
    (tmp_path / "b.json").write_text('[{"k": 900}')
    good, bad = J.read_large_arrays(spark, str(tmp_path), "k long")
    assert sorted(r["k"] for r in good.collect()) == list(range(500)) and bad.count() == 1
    assert "elements" not in kept and kept["fragments"].count() < 5
    assert "SortMergeJoin" not in good._jdf.queryExecution().executedPlan().toString()
