from datetime import date

from pyspark.sql import functions as F

from tallygrid.operators import calls as C
from tallygrid.operators import docs as DO
from tallygrid.operators import select as X

D = date.fromisoformat


def test_first_failing_reason(spark):
    c = X.Criteria(min_cap=10, max_cap=100, countries=["US"], excluded=["Bank"])
    df = spark.createDataFrame([(None, "US", "x"), (5.0, "US", "x"), (500.0, "DE", "x"), (50.0, None, "x"), (50.0, "US", ""), (50.0, "US", "Regional BANKS"), (50.0, "US", "Steel")], "market_cap double, country string, industry string")
    assert [r[0] for r in df.select(c.reason()).collect()] == ["no_market_cap", "cap_below_min", "cap_above_max", "country_not_allowed", "no_industry", "industry_excluded:Bank", None]
    assert df.where("country is null").select(X.Criteria(10, 100, [], []).reason()).first()[0] is None


def test_greedy_pick_and_cycles(spark, rows):
    ind = spark.createDataFrame([(n,) for n, k in (("A", 9), ("B", 7), ("C", 7), ("D", 1)) for _ in range(k)] + [(None,)], "industry string")
    none = spark.createDataFrame([], "industry string")
    assert rows(X.pick_industries(ind, none, 16)) == [("A", 9), ("B", 7)]
    assert rows(X.pick_industries(ind, none, 17)) == [("A", 9), ("B", 7), ("C", 7)]
    assert rows(X.pick_industries(ind, spark.createDataFrame([("A",)], "industry string"), 100)) == [("B", 7), ("C", 7), ("D", 1), ("Uncategorized", 1)]
    log = lambda *e: spark.createDataFrame([(D(d), c, i) for d, c, i in e], "date date, cycle int, industries array<string>")
    l1 = log(("2025-01-01", None, ["A", "B"]), ("2025-01-02", 1, ["C", "D"]))
    assert rows(X.plan_pick(ind, l1, 5), "industry", "cycle", "restarted") == [("Uncategorized", 1, False)]
    l2 = log(("2025-01-01", 2, ["A", "B"]), ("2025-01-03", 2, ["C", "D", "Uncategorized"]), ("2024-01-01", 1, ["A"]))
    assert rows(X.plan_pick(ind, l2, 9), "industry", "cycle", "restarted") == [("A", 3, True)]
    assert rows(X.cycle_state(l2)) == [(2, D("2025-01-01"))]
    assert rows(spark.range(1).select(X.done_in_cycle(F.lit("2025-01-02"), F.lit("2025-01-01")), X.done_in_cycle(F.lit("2025-01-02"), F.lit(None).cast("string")))) == [(True, False)]


def test_search_codes_and_quarters(spark, rows):
    df = spark.createDataFrame([("QDEL", "QuidelOrtho", 5.0), ("AQD", "qd maker", None), ("ZZ", "big qd", 99.0)], "t string, n string, c double")
    assert [r.t for r in X.search(df, "qd", "t", "n", "c").orderBy("rank", F.col("c").desc_nulls_last()).collect()] == ["QDEL", "ZZ", "AQD"]
    codes = spark.createDataFrame([("600066.SS",), ("000001.SZ",), ("600066",), ("300750",), ("830799",), ("AAPL",)], "t string").select(X.is_ashare("t"), X.exchange_code("t")).collect()
    assert [tuple(r) for r in codes][:5] == [(True, "600066.SH"), (True, "000001.SZ"), (False, "600066.SH"), (False, "300750.SZ"), (False, "830799.BJ")]
    e = spark.createDataFrame([("new",), ("never",), ("some",)], "entity string")
    calls = spark.createDataFrame([("some", "2025Q1")], "entity string, quarter string")
    chk = spark.createDataFrame([("never", "2025Q2", D("2025-07-20")), ("some", "2025Q2", D("2025-07-29")), ("some", "2024Q4", D("2025-07-01"))], "entity string, quarter string, checked date")
    got = rows(X.quarters_to_check(e, calls, chk, F.lit("2025-07-30").cast("date"), n=3))
    assert got == [("new", "2024Q4"), ("new", "2025Q1"), ("new", "2025Q2")]
    later = rows(X.quarters_to_check(e, calls, chk, F.lit("2025-08-25").cast("date"), n=3))
    assert ("never", "2025Q2") in later and ("some", "2025Q2") in later and ("some", "2024Q4") not in later


MD = "\n".join(["# 目录", "# 第一节 释义", "# 第二节 讨论", "正文", "# 第二节 讨论", "## 一、概述", "a", "### (一) 主营", "#### 1、利润", "b", "## 二、风险", "<mark>x</mark>", "# 第三节 <b>治理</b>", "c"])


def test_markdown_toc(spark):
    t = {r.title: r for r in DO.markdown_toc(spark.createDataFrame([(1, MD)], "d int, text string"), ["d"]).collect()}
    assert (t["第二节 讨论"].line, t["第二节 讨论"].end, t["第二节 讨论"].level) == (4, 12, 1)       # the long occurrence, not the one in the contents
    assert (t["一、概述"].end, t["(一) 主营"].end, t["1、利润"].level, t["第三节 治理"].end, t["目录"].level) == (10, 10, 4, 14, 5)
    b = DO.toc_budget(DO.markdown_toc(spark.createDataFrame([(1, MD)], "d int, text string"), ["d"]), ["d"], 5).first()
    assert (b.level, b.shown, b.hidden) == (2, 5, 3)


TEN_K = "\n".join(["ITEM 1. Business 3", "ITEM 1A. | Risk Factors ..... 9", "intro", "Item 1.", "Business", "we make things", "more", "ITEM 1A. Risk Factors", "risky", "risky", "Notes to Consolidated Financial Statements", "1. Organization", "x", "2.", "Summary of policies (continued)", "y",
                   "1. Organization (Continued)", "z", "NOTE 3. Investments"])


def test_item_toc_and_sections(spark):
    docs = spark.createDataFrame([(1, TEN_K)], "d int, text string")
    toc = DO.item_toc(docs, ["d"])
    t = {r.key: (r.title, r.line, r.end) for r in toc.collect()}
    assert t == {"item 1": ("Item 1. Business", 3, 7), "item 1a": ("Item 1A. Risk Factors", 7, 19), "note 1": ("Note 1. Organization", 11, 13), "note 2": ("Note 2. Summary of policies", 13, 18), "note 3": ("Note 3. Investments", 18, 19)}
    sec = DO.find_section(toc, ["d"], "Item 1A.").first()
    assert sec.line == 7 and DO.find_section(toc, ["d"], "policies").first().key == "note 2" and DO.find_section(toc, ["d"], "line:5").first().line == 5
    p = DO.section_text(docs, DO.find_section(toc, ["d"], "item 1"), ["d"], offset=9, max_chars=4).first()
    body = "Item 1.\nBusiness\nwe make things\nmore"
    assert (p.chunk, p.total, p.next_offset) == (body[9:13], len(body), 13)
    h = DO.search_lines(docs, ["d"], "RISKY").collect()
    assert [(r.line, r.snippet) for r in h] == [(8, "ITEM 1A. Risk Factors\nrisky\nrisky"), (9, "risky\nrisky\nNotes to Consolidated Financial Statements")]


def test_calls(spark, rows):
    t = spark.createDataFrame([("c", 0, "Operator", "Analyst relations", "Welcome to the question-and-answer"), ("c", 1, "CEO", "CEO", "hello"), ("c", 2, "Operator", "", "We now open the line for questions"), ("c", 3, "Jo", "Analyst", "why? growth"), ("d", 0, "CEO", "CEO", "only growth remarks")],
                              "k string, turn int, speaker string, title string, content string")
    s = C.split_call(t, ["k"], C.qa_start())
    assert rows(s, "k", "turn", "part") == [("c", 0, "remarks"), ("c", 1, "remarks"), ("c", 2, "qa"), ("c", 3, "qa"), ("d", 0, "remarks")]
    st = {r.k: r for r in C.call_stats(s, ["k"]).collect()}
    assert (st["c"].turns, st["c"].remarks, st["c"].qa, st["c"].speakers) == (4, 2, 2, 2)
    full = "\n\n".join(f"**{r.speaker}** ({r.title}):\n{r.content}" for r in t.where("k = 'c'").orderBy("turn").collect())
    for off, size in ((0, 30), (50, 60), (len(full) - 5, 50), (len(full) + 10, 9)):
        p = {r.k: r for r in C.render_page(t, ["k"], off, size, block=2).collect()}["c"]
        assert (p.chunk, p.total, p.next_offset) == (full[off:off + size], len(full), min(off + size, len(full)))
    hit = C.search_turns(t, ["k"], "Growth", [F.col("turn").desc()], before=2, after=0).where("k = 'd'").first()
    assert hit.snippet == "…y growth…"
    m = spark.createDataFrame([("h", i, 10) for i in range(20)] + [("s", 0, 500), ("s", 1, 500), ("s", 2, 500)], "k string, i bigint, n int")
    assert rows(C.budgeted_history(m, ["k"], "i", "n", 35, block=4), "k", "i") == [("h", 17), ("h", 18), ("h", 19), ("s", 1), ("s", 2)]
    assert C.compaction(m, ["k"], "i", "n", 199, 3, block=4).where("k = 'h'").count() == 17 and C.compaction(m, ["k"], "i", "n", 200, 3).where("k = 'h'").count() == 0


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "Is $qdel better than AAPL? THE NOW company Quidel Ortho rocks, #MSFT"), (2, "ÉAAPL is not AAPLX"), (3, "quidel orthopaedics")], "d int, t string")
    tick = spark.createDataFrame([(x,) for x in ("QDEL", "AAPL", "MSFT", "NOW")], "ticker string")
    names = spark.createDataFrame([("quidel ortho", "QDEL"), ("apple", "AAPL")], "norm string, ticker string")
    got = [(r.d, r.ticker) for r in C.mentions(docs, "d", "t", tick, names, ["NOW", "THE"]).orderBy("d", "rn").collect()]
    assert got == [(1, "QDEL"), (1, "MSFT"), (1, "AAPL")]


def test_templates_and_budgeted_sections(spark):
    assert spark.range(1).select(DO.render("{{a}}-{{b}}-{{a}}", {"a": F.lit("x"), "b": F.lit(None).cast("string")})).first()[0] == "x--x"
    p = spark.createDataFrame([("k", i, "x" * 40) for i in range(5)], "k string, i int, body string")
    assert len(DO.join_sections(p, ["k"], "i", "body", 100).first().text) == 100 and len(DO.join_sections(p, ["k"], "i", "body", 1000).first().text) == 208


def test_running_totals_and_call_split_keep_null_keys(spark, rows):
    from tallygrid.operators import keyed as K
    df = spark.createDataFrame([("a", 1, 5), (None, 1, 7), (None, 9, 2), ("a", None, 3)], "k string, t int, v int")
    for block in (2, 4096):
        assert rows(K.running_total(df, ["k"], "t", "v", "run", block)) == [(None, 1, 7, 7), (None, 9, 2, 9), ("a", None, 3, 8), ("a", 1, 5, 5)]
    t = spark.createDataFrame([(None, 0, "intro"), (None, 1, "questions"), ("c", 0, "hi"), ("c", None, "x")], "k string, turn int, content string")
    got = C.split_call(t, ["k"], F.col("content") == "questions")
    assert rows(got, "k", "turn", "part") == [(None, 0, "remarks"), (None, 1, "qa"), ("c", None, "remarks"), ("c", 0, "remarks")]
    page = C.render_page(got.withColumn("s", F.lit("S")), ["k"], 0, 100, "s", "s", "content", "turn", part="qa")
    assert rows(page, "k", "chunk") == [(None, "**S** (S):\nquestions")]


def test_mentions_of_long_names(spark, rows):
    docs = spark.createDataFrame([(1, "About Very Long Company Name Of Seven Words today, and $abc and XYZ."), (2, "very long company name of six words; Short Co"), (3, "the short short co"), (4, None)], "d int, t string")
    names = spark.createDataFrame([("very long company name of seven words", "LONG"), ("short co", "SHRT"), ("short short", "TWO")], "norm string, ticker string")
    tick = spark.createDataFrame([("ABC",), ("XYZ",), ("LONG",)], "ticker string")
    assert rows(C.mentions(docs, "d", "t", tick, names), "d", "ticker") == [(1, "ABC"), (1, "LONG"), (1, "XYZ"), (2, "SHRT"), (3, "SHRT"), (3, "TWO")]
