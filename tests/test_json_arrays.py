"""Large JSON arrays: one file over many splits, against the standard library's parser."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.sources import files as FI
from tallygrid.sources.json_arrays import pieces, read_large_arrays

SCHEMA = "id bigint, s string, l array<struct<x:int>>"


@pytest.fixture
def small_splits(spark):
    """Splits of some kilobytes."""
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "400"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def records(n, seed):
    r = random.Random(seed)
    bits = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "漢", "a", "\\\\", '\\"', " "]
    return [{"id": i, "s": "".join(r.choice(bits) for _ in range(r.choice([0, 3, 40, 900]))), "l": [{"x": k} for k in range(r.randrange(4))]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_over_many_splits(spark, rows, tmp_path, small_splits, indent):
    data = records(120, 5)
    path = write(tmp_path / "a.json", json.dumps(data, indent=indent, ensure_ascii=False))
    assert pieces(spark, path).select("block").distinct().count() > 8
    good, bad = read_large_arrays(spark, path, SCHEMA)
    want = sorted((d["id"], d["s"], [x["x"] for x in d["l"]]) for d in data)
    assert sorted((r.id, r.s, [x.x for x in r.l]) for r in good.collect()) == want
    assert bad.count() == 0
    assert rows(good.drop("_file")) == rows(FI.read_json_array(spark, path, SCHEMA))


def test_broken_elements_alone(spark, tmp_path, small_splits):
    data = [json.dumps(d) for d in records(40, 9)]
    data[7], data[20], data[30] = '{"id": oops}', "17", "null"
    path = write(tmp_path / "a.json", "[" + " ,\n".join(data) + "\n]\n")
    good, bad = read_large_arrays(spark, path, SCHEMA)
    assert sorted(r.id for r in good.collect()) == [i for i in range(40) if i not in (7, 20, 30)]
    assert sorted(r.document for r in bad.collect()) == ["17", '{"id": oops}']


def test_files_that_are_no_arrays(spark, tmp_path, small_splits):
    ok, pad = '[{"id": 1}]', json.dumps(records(8, 2))
    for name, text in {"ok": ok, "none": " [ ]\n", "two": ok + "\n" + ok, "object": '{"id": 1, "s": "x"}', "object2": '{"id": 1}\n', "open": pad[:-1], "quote": '[{"s": "x}]', "after": pad + " x",
                       "before": "x" + pad, "deep": "[" + pad, "close": pad + "]", "long": '{"l": ' + pad + "}\n", "empty": "", "blank": " \n", "comma": '[{"id": 2},]', "commas": '[{"id": 3},,{"id": 4}]'}.items():
        write(tmp_path / f"{name}.json", text)
    good, bad = read_large_arrays(spark, str(tmp_path), SCHEMA)
    name = lambda f: f.rsplit("/", 1)[-1][:-5]
    assert sorted((name(r._file), r.id) for r in good.collect()) == [("comma", 2), ("commas", 3), ("commas", 4), ("ok", 1)]
    got = sorted((name(r.file), r.document) for r in bad.collect())
    assert got == sorted([(x, None) for x in ("two", "object", "object2", "open", "quote", "after", "before", "deep", "close", "long")] + [("comma", ""), ("commas", "")])


def test_elements_longer_than_splits(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.json", json.dumps([{"id": 1, "s": "x" * 25000}, {"id": 2, "s": "}" * 9000}]))
    good, _ = read_large_arrays(spark, path, SCHEMA)
    assert good.select("id", F.length("s").alias("n")).orderBy("id").collect() == [(1, 25000), (2, 9000)]


@pytest.mark.parametrize("end, again", [(1200, False), (60, True)])
def test_fragments_from_the_ends_of_splits(spark, tmp_path, small_splits, monkeypatch, end, again):
    """Splits whose ends hold a comma of depth one are not read a second time for their fragments."""
    from tallygrid.sources import json_arrays as J
    calls, run = [], J.cut_elements
    monkeypatch.setattr(J, "cut_elements", lambda *a, **k: calls.append(k) or run(*a, **k))
    data = [{"id": i, "s": "a,]}" * (i % 30), "l": [{"x": i}]} for i in range(300)]
    path = write(tmp_path / "a.json", json.dumps(data, indent=1))
    good, bad = read_large_arrays(spark, path, SCHEMA, end=end)
    assert sorted((r.id, r.s, r.l[0].x) for r in good.collect()) == [(d["id"], d["s"], d["id"]) for d in data]
    assert bad.count() == 0
    assert [k.get("every", True) for k in calls] == ([False] if again else []) + [True]


def test_arrays_that_end_between_the_ends_of_a_split(spark, tmp_path, small_splits):
    a = json.dumps([{"id": i} for i in range(100)])
    write(tmp_path / "two.json", a + "\n" + a)
    write(tmp_path / "one.json", a)
    good, bad = read_large_arrays(spark, str(tmp_path), SCHEMA, end=40)
    assert sorted(r.id for r in good.collect()) == list(range(100))
    assert [(r.file.rsplit("/", 1)[-1], r.document) for r in bad.collect()] == [("two.json", None)]


def test_elements_are_parsed_once(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    good, _ = read_large_arrays(spark, path, SCHEMA)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "from_json" in x] and plan.count("Scan text") == 1


def test_elements_are_parsed_together_as_alone(spark, tmp_path):
    """One broken element among others, texts that only a parser with its own rules takes apart, more than one row of elements."""
    odd = ['{"id": 1, "s": "a"}', "null", '{"id": "x"}', '{"id": 2} {"id": 3}', "{'id': 4, 's': 'b\"'},{'id': 5, 's': '\"'}", '{"id": 6]', "[7]", '"{"', '""', "{}", '{"id": 8, "l": [{"x": 1}, {"x": "y"}]}', '{"id": 9, "_corrupt_record": "z"}', "", '{"id": 10, "l": [null]}']
    many = [json.dumps({"id": 100 + i, "s": "x" * 1000}) for i in range(3000)]
    for i, x in enumerate(odd):
        write(tmp_path / f"{i}.json", '[{"id": 50, "s": "c"},' + x + ',{"id": 51}]')
        write(tmp_path / f"{i}alone.json", "[" + x + "]")
    write(tmp_path / "many.json", "[" + ",".join(many[:1500] + ['{"id": {}}'] + many[1500:]) + "]")
    good, bad = read_large_arrays(spark, str(tmp_path), SCHEMA)
    name = lambda f: f.rsplit("/", 1)[-1][:-5]
    got = {}
    for r in good.collect():
        got.setdefault(name(r._file), []).append((r.id, r.s, r.l))
    for r in bad.collect():
        got.setdefault(name(r.file), []).append(r.document)
    for i in range(len(odd)):
        assert sorted(map(str, got.get(str(i), []))) == sorted(map(str, [*got.get(f"{i}alone", [] if odd[i] else [""]), (50, "c", None), (51, None, None)])), odd[i]
    assert sorted(x[0] for x in got["many"] if isinstance(x, tuple)) == list(range(100, 3100))
    assert [x for x in got["many"] if isinstance(x, str)] == ['{"id": {}}']
    assert got["2"].count('{"id": "x"}') == got["6"].count("[7]") == 1 and len(got["1"]) == 2 and (None, None, None) in got["9"]


def test_texts_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'[{"id": 1, "s": "\xff"}, {"id": 2, "s": "\xc3\xa9"},{"id": 3, "s": "\xc3"}]')
    good, _ = read_large_arrays(spark, str(tmp_path), SCHEMA)
    assert sorted((r.id, r.s) for r in good.collect()) == [(1, "�"), (2, "é"), (3, "�")]
