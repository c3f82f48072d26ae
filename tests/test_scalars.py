from pyspark.sql import functions as F

from tallygrid.functions import formats as FM
from tallygrid.functions import html as H
from tallygrid.functions import scalars as S


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_fiscal_year_and_labels(spark):
    l = F.lit
    assert one(spark, S.fiscal_year(l("2023-01-01")), S.fiscal_year(l("2022-12-31")), S.fiscal_year(l("2024-06-30")), S.fiscal_year(l("bad"))) == (2022, 2022, 2024, None)
    assert one(spark, S.fy_label(l("2025-12-31")), S.fy_label(l("2025-12-31"), True), S.quarter_label(l("2026-03-31")), S.quarter_label(l("2026-03-31"), True)) == ("FY2025", "FY25", "2026 Q1", "Q1'26")
    assert one(spark, F.array_join(S.ended_quarters(l("2026-02-10").cast("date"), 3), ","))[0] == "2025Q4,2025Q3,2025Q2"
    assert one(spark, S.quarter_key_end(l("2025Q2")).cast("string"), S.quarter_key_end(l("x"))) == ("2025-06-30", None)


def test_null_strict_algebra(spark):
    n, z, a = F.lit(None).cast("double"), F.lit(0.0), F.lit(2.0)
    assert one(spark, S.safe_div(a, z), S.safe_div(n, a), S.safe_div(a, a)) == (None, None, 1.0)
    assert one(spark, S.both(z, n), S.either(a, n), S.both(a, a), S.either(z, a), S.negate(z), S.negate(n)) == (None, None, 1.0, 1.0, 1.0, None)
    assert one(spark, S.max_of(a, n), S.min_of(a, z), S.change(F.lit(5.0), F.lit(-4.0)), S.change(a, z)) == (None, 0.0, 2.25, None)


def test_bands_and_opex(spark):
    l = F.lit
    assert one(spark, *[S.spread_severity(l(x)) for x in (0.001, 0.01, 0.05, 0.051)], S.spread_severity(l(None).cast("double")), S.spread_severity(l(0.0), l(True))) == ("ok", "info", "warn", "error", "ok", "error")
    assert one(spark, S.other_opex(l(100.0), l(40.0), l(None).cast("double"), l(10.0), l(5.0), l(None).cast("double")))[0] == 45.0
    assert one(spark, S.rescale_thousands(l(7137.0), l(7_137_000.0), l(1.0)), S.rescale_thousands(l(7137.0), l(7137.0), l(1.0)), S.rescale_thousands(l(7.0), l(7000.0), l(0.01))) == (7137000.0, 7137.0, 7.0)


def test_text_functions(spark):
    l = F.lit
    assert one(spark, S.slug(l("Oil & Gas — E&P")), S.slug(l("!!")), S.slug(l(None).cast("string"))) == ("oil-gas-e-p", "uncategorized", "uncategorized")
    assert one(spark, S.number(l("")), S.number(l("x")), S.number(l("NaN")), S.number(l(" 1.5 "))) == (None, None, None, 1.5)
    assert one(spark, S.company_key(l("The Acme Holdings, Inc.")), S.series_name(l(" GMV (Total) "))) == ("acme", "gmv_total")
    assert one(spark, S.report_form(l("2024年半年度报告")), S.report_year(l("年度报告"), l("2025-03-01").cast("date")), S.report_cumulative(l("第一季度报告")), S.report_period(l("第三季度报告"), l("2024"))) == \
        ("半年度报告", "2024", False, "2024-09-30")
    assert one(spark, S.first_of(l(None).cast("double"), l(2.0)), S.first_source([l(None).cast("double"), l(2.0)], [l("a"), l("b")])) == (2.0, "b")


def test_formats(spark):
    l = F.lit
    assert one(spark, FM.money(l(1.25e9), 1), FM.money(l(None).cast("double")), FM.money(l(-2_500_000.0), 1, "¥"), FM.money_compact(l(999.0)), FM.money_compact(l(None).cast("double"))) == ("$1.2B", "n/a", "¥-2.5M", "$999", "")
    assert one(spark, FM.percent(l(0.256)), FM.grouped(l(1234567.0)), FM.ratio_x(l(None).cast("double")), FM.currency_symbol(l("hkd")), FM.currency_symbol(l("ABC")), FM.fixed(l(-0.01), 1)) == ("26%", "1,234,567", "—", "HK$", "", "-0.0")


def test_payload_check(spark):
    df = spark.createDataFrame([('{"a": "x", "m": {"c": "good"}}',), ('{"a": " ", "m": {"c": "good"}}',), ('{"a": "x", "m": {"c": "odd"}}',), ("{oops",), ('{"a": "x", "m": {"c": "good"}} tail',)], "raw string")
    _, err = S.payload_check("raw", "a string, m struct<c:string>", ["a", "m.c"], {"m.c": ["good", "bad"]})
    assert [r[0] for r in df.select(err).collect()] == [None, "missing a", "bad m.c", "not json", "not json"]


def test_html_to_text(spark):
    doc = ("<html><style>p{}</style><script>x('</p>')</script><table><tr><td><p>Revenue</p></td><td> 1,000 </td><td></td></tr>"
           "<tr><th>Net&nbsp;income</th><td>5&rsquo;0</td></tr></table><p>After &amp; done</p><br/>x</html>")
    out = spark.createDataFrame([(doc,), ("plain",), (None,)], "d string").select(H.html_to_text("d"), H.html_to_text("d", 7)).collect()
    assert out[0][0] == "Revenue | 1,000\nNet income | 5’0\nAfter & done\nx"
    assert out[0][1] == "Revenue\n…(truncated)" and out[1][0] == "plain" and out[2][0] is None
    r = spark.createDataFrame([("Acme announces unaudited third quarter results\nCONSOLIDATED STATEMENTS\nOF OPERATIONS",), ("balance sheet only",)], "t string").select(H.looks_like_results("t")).collect()
    assert [x[0] for x in r] == [True, False]
    e = spark.createDataFrame([("&amp;lt; &lt;&#8364;",), ("a &amp; b",)], "t string").select(H.unescape("t")).collect()
    assert [x[0] for x in e] == ["&lt; <€", "a & b"]
