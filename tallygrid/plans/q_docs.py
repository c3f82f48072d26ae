"""Document, transcript and mention queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import html as H
from tallygrid.operators import calls as C
from tallygrid.operators import docs as D
from tallygrid.plans.registry import query, table
from tallygrid.sources import payloads as P

NL = "chr(10)"
CLEAN_SQL = """cl AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
   '(?i)<br\\s*/?>|</p>|</div>|</li>|</h\\d>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS s FROM pages),
  tx AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(s, '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&'), chr(10)),
   lambda l: trim(regexp_replace(trim(regexp_replace(l, '[ \\t]+', ' ', 'g')), '(\\s*\\|\\s*)+', ' | ', 'g'), ' |')), lambda l: l <> ''), chr(10)) AS text FROM cl)"""


def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.html_to_text("html").alias("text"))


@query("txt01_src17_html_to_text", f"WITH {CLEAN_SQL} SELECT page_id, text, cast(length(text) as bigint) AS chars FROM tx")
def txt01(spark, d):
    return page_text(spark, d).withColumn("chars", F.length("text").cast("bigint"))


@query("flt14_release_predicate", """WITH x AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM documents) SELECT doc_id, regexp_matches(substr(f, 1, 4000), '(?i)(the|and) [a-z]+') AND regexp_matches(f, '(?i)onsh|ttps?:') AS hit FROM x""")
def flt14(spark, d):
    return table(spark, d, "documents").select("doc_id", H.looks_like_results("text", r"(?i)(the|and) [a-z]+", r"(?i)onsh|ttps?:").alias("hit"))


# --- tables of contents: headings are derived from the length of each line -----------------------------------

_MARK = ["# 第一节 ", "## 一、", "### (一) ", "#### 1、", "# "]
MD_SQL = """md AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: case length(l) % 7 when 0 then '# 第一节 ' || l when 1 then '## 一、' || l when 2 then '### (一) ' || l
   when 3 then '#### 1、' || l when 4 then '# ' || l else l end) AS ls FROM documents),
  hd AS (SELECT doc_id, i - 1 AS line, len(ls) AS n, trim(regexp_replace(regexp_replace(regexp_replace(ls[i], '^[# ]+', ''), '</?(mark|u|b|i)>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM md) WHERE starts_with(ls[i], '#')),
  lv AS (SELECT *, case when regexp_matches(title, '^第[一二三四五六七八九十]+节') then 1 when regexp_matches(title, '^[一二三四五六七八九十]+[、.]') then 2 when regexp_matches(title, '^[（(][一二三四五六七八九十\\d]+[)）]') then 3 when regexp_matches(title, '^\\d+[、.]') then 4 else 5 end AS level FROM hd WHERE title <> '' and length(title) <= 120),
  en AS (SELECT a.doc_id, a.line, a.title, a.level, coalesce((SELECT min(b.line) FROM lv b WHERE b.doc_id = a.doc_id and b.line > a.line and b.level <= a.level), a.n) AS e FROM lv a),
  toc AS (SELECT * FROM en QUALIFY row_number() over (partition by doc_id, title order by e - line desc, line) = 1)"""


def markdown_docs(spark, d):
    def mark(line):
        n = F.length(line) % 7
        out = F.when(n == 0, F.concat(F.lit(_MARK[0]), line))
        for k, m in enumerate(_MARK[1:], 1):
            out = out.when(n == k, F.concat(F.lit(m), line))
        return out.otherwise(line)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


def _toc(spark, d):
    return D.markdown_toc(markdown_docs(spark, d), ["doc_id"])


@query("txt02_win20_markdown_toc", f"WITH {MD_SQL} SELECT doc_id, line::bigint AS line, e::bigint AS \"end\", title, level::bigint AS level FROM toc")
def txt02(spark, d):
    b = lambda c: F.col(c).cast("bigint").alias(c)
    return _toc(spark, d).select("doc_id", b("line"), b("end"), "title", b("level"))


@query("txt09_toc_budget", f"""WITH {MD_SQL}, c AS (SELECT doc_id, count(*) AS n, max(level) AS deep, [count(case when level <= 1 then 1 end), count(case when level <= 2 then 1 end), count(case when level <= 3 then 1 end), count(case when level <= 4 then 1 end), count(*)] AS cs FROM toc GROUP BY 1),
  l AS (SELECT *, len(list_filter(cs, lambda x: x <= 8)) AS lv FROM c) SELECT doc_id, least(lv, deep)::bigint AS level, case when lv = 0 then 0 else cs[lv] end AS shown, n - case when lv = 0 then 0 else cs[lv] end AS hidden FROM l""")
def txt09(spark, d):
    return D.toc_budget(_toc(spark, d), ["doc_id"], 8)


@query("txt04_05_section_pages", f"""WITH {MD_SQL}, s AS (SELECT * FROM toc WHERE contains(lower(title), 'the') QUALIFY row_number() over (partition by doc_id order by e - line desc, line) = 1),
  b AS (SELECT s.doc_id, s.title, array_to_string(md.ls[s.line + 1:s.e], chr(10)) AS body FROM s JOIN md USING (doc_id)) SELECT doc_id, title, substr(body, 101, 200) AS chunk, cast(length(body) as bigint) AS total, least(300, length(body))::bigint AS next_offset FROM b""")
def txt04(spark, d):
    docs = markdown_docs(spark, d)
    sec = D.find_section(D.markdown_toc(docs, ["doc_id"]), ["doc_id"], "The")
    return D.section_text(docs, sec, ["doc_id"], offset=100, max_chars=200)


ITEM_SQL = """it AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: case length(l) % 9 when 0 then 'ITEM ' || (length(l) % 4 + 1) || case when length(l) % 2 = 0 then 'A' else '' end || '. | ' || l when 1 then 'Item ' || (length(l) % 3 + 1) || '.'
    when 2 then (length(l) % 5 + 1) || '. T' || l || ' (Continued)' when 3 then 'Notes to Consolidated Financial Statements' else l end) AS ls FROM documents),
  ln AS (SELECT doc_id, i - 1 AS line, len(ls) AS n, trim(ls[i], ' |') AS s, case when i < len(ls) then trim(ls[i + 1], ' |') end AS nx FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM it)),
  im AS (SELECT *, regexp_extract(s, '(?i)^ITEM\\s+(\\d{1,2}[A-C]?)\\s*[.:]?\\s*\\|?\\s*(.*)$', 1) AS num, trim(regexp_extract(s, '(?i)^ITEM\\s+(\\d{1,2}[A-C]?)\\s*[.:]?\\s*\\|?\\s*(.*)$', 2), ' .') AS own FROM ln WHERE length(s) <= 140 and regexp_matches(s, '(?i)^ITEM\\s+(\\d{1,2}[A-C]?)\\s*[.:]?\\s*\\|?\\s*(.*)$')),
  ie AS (SELECT doc_id, line, 'item ' || lower(num) AS key, 'Item ' || upper(num) || '. ' || regexp_replace(regexp_replace(case when own <> '' then own when nx is not null and length(nx) <= 140 then trim(nx, ' .') else '' end, '\\s+', ' ', 'g'), '[\\s.|]*\\d+\\s*$', '') AS title, coalesce(lead(line) over (partition by doc_id order by line), n) AS e FROM im),
  ib AS (SELECT * FROM ie QUALIFY row_number() over (partition by doc_id, key order by e - line desc, line) = 1),
  st AS (SELECT doc_id, min(line) AS st FROM ln WHERE regexp_matches(s, '(?i)NOTES TO (THE )?CONSOLIDATED FINANCIAL STATEMENTS') GROUP BY 1),
  nm AS (SELECT doc_id, line, n, regexp_extract(s, '(?i)^(?:NOTE\\s+)?(\\d{1,2})\\s*\\.\\s*\\|?\\s*([A-Z][^|]{3,90}?)\\s*(\\(continued\\))?\\s*$', 1) AS num, trim(regexp_extract(s, '(?i)^(?:NOTE\\s+)?(\\d{1,2})\\s*\\.\\s*\\|?\\s*([A-Z][^|]{3,90}?)\\s*(\\(continued\\))?\\s*$', 2)) AS t
    FROM ln LEFT JOIN st USING (doc_id) WHERE line >= coalesce(st, 0) and regexp_matches(s, '(?i)^(?:NOTE\\s+)?(\\d{1,2})\\s*\\.\\s*\\|?\\s*([A-Z][^|]{3,90}?)\\s*(\\(continued\\))?\\s*$') QUALIFY row_number() over (partition by doc_id, num order by line) = 1)
  SELECT doc_id, key, title, line::bigint AS line, e::bigint AS "end" FROM ib UNION ALL SELECT doc_id, 'note ' || num, 'Note ' || num || '. ' || t, line::bigint, coalesce(lead(line) over (partition by doc_id order by line), n)::bigint FROM nm"""


@query("txt03_win21_item_toc", f"WITH {ITEM_SQL}")
def txt03(spark, d):
    def mark(line):
        n = F.length(line)
        txt = lambda c: c.cast("string")
        return (F.when(n % 9 == 0, F.concat(F.lit("ITEM "), txt(n % 4 + 1), F.when(n % 2 == 0, "A").otherwise(""), F.lit(". | "), line))
                .when(n % 9 == 1, F.concat(F.lit("Item "), txt(n % 3 + 1), F.lit(".")))
                .when(n % 9 == 2, F.concat(txt(n % 5 + 1), F.lit(". T"), line, F.lit(" (Continued)")))
                .when(n % 9 == 3, F.lit("Notes to Consolidated Financial Statements")).otherwise(line))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))
    t = D.item_toc(docs, ["doc_id"])
    return t.select("doc_id", "key", "title", F.col("line").cast("bigint").alias("line"), F.col("end").cast("bigint").alias("end"))


@query("txt06_line_search", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, i - 1 AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l) WHERE contains(lower(ls[i]), 'the') QUALIFY row_number() over (partition by doc_id order by i) <= 12)
  SELECT doc_id, line, substr(array_to_string(ls[greatest(line, 1):line + 2], chr(10)), 1, 600) AS snippet FROM h""")
def txt06(spark, d):
    return D.search_lines(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "the")


@query("txt10_release_text", """SELECT o_custkey AS entity, cast(cast(max(o_orderdate) as date) as varchar) AS period_end, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS release FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def txt10(spark, d):
    from tallygrid.operators.inventory import release_of
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").cast("string").alias("period_end"), F.col("o_orderkey").alias("release"))
    return release_of(o)


@query("txt11_section_budget", """WITH r AS (SELECT conv_id, turn, text, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) AS run FROM conversations) SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 900) AS text FROM r WHERE run - length(text) < 900 GROUP BY 1""")
def txt11(spark, d):
    return D.join_sections(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 900)


@query("txt12_template", "SELECT c_custkey, 'Customer ' || c_name || ' (' || c_mktsegment || '): ' || c_custkey || ' / ' || c_name AS line FROM customer")
def txt12(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", D.render("Customer {{name}} ({{seg}}): {{id}} / {{name}}", {"name": F.col("c_name"), "seg": F.col("c_mktsegment"), "id": F.col("c_custkey")}).alias("line"))


# --- transcripts ----------------------------------------------------------------------------------------------

CUT_SQL = "cut AS (SELECT conv_id, min(case when turn > 0 and role = 'assistant' and contains(lower(text), 'es') then turn end) AS c FROM conversations GROUP BY 1)"


def split_turns(spark, d):
    t = table(spark, d, "conversations")
    return C.split_call(t, ["conv_id"], (F.col("role") == "assistant") & F.lower("text").contains("es"))


@query("win22_call_split", f"WITH {CUT_SQL} SELECT conv_id, turn, case when c is null or turn < c then 'remarks' else 'qa' end AS part FROM conversations JOIN cut USING (conv_id)")
def win22(spark, d):
    return split_turns(spark, d).select("conv_id", "turn", "part")


@query("agg34_call_stats", f"""WITH {CUT_SQL} SELECT conv_id, count(*) AS turns, cast(sum(length(text)) as bigint) AS chars, count(case when c is null or turn < c then 1 end) AS remarks, count(case when turn >= c then 1 end) AS qa, count(DISTINCT case when role <> 'system' then role end) AS speakers FROM conversations JOIN cut USING (conv_id) GROUP BY 1""")
def agg34(spark, d):
    return C.call_stats(split_turns(spark, d), ["conv_id"], "role", "text", operator="system")


@query("agg34_first_speakers", """SELECT conv_id, role, min(turn) AS first_turn, row_number() over (partition by conv_id order by min(turn), role) AS rn FROM conversations WHERE role <> 'system' GROUP BY 1, 2""")
def agg34b(spark, d):
    return C.first_speakers(table(spark, d, "conversations"), ["conv_id"], 8, "role", "turn", operator="system")


@query("txt08_transcript_page", """WITH x AS (SELECT conv_id, string_agg('**' || role || '** (turn):' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, substr(t, 301, 500) AS chunk, cast(length(t) as bigint) AS total, least(800, length(t))::bigint AS next_offset FROM x""")
def txt08(spark, d):
    t = table(spark, d, "conversations").withColumn("title", F.lit("turn"))
    return C.render_page(t, ["conv_id"], 300, 500, "role", "title", "text", "turn")


@query("txt08_transcript_parts", f"""WITH {CUT_SQL}, p AS (SELECT conv_id, turn, role, text FROM conversations JOIN cut USING (conv_id) WHERE turn >= c), x AS (SELECT conv_id, string_agg('**' || role || '** (turn):' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM p GROUP BY 1)
  SELECT conv_id, substr(t, 1, 900) AS chunk, cast(length(t) as bigint) AS total, least(900, length(t))::bigint AS next_offset FROM x""")
def txt08b(spark, d):
    t = split_turns(spark, d).withColumn("title", F.lit("turn"))
    return C.render_page(t, ["conv_id"], 0, 900, "role", "title", "text", "turn", part="qa")


@query("txt07_turn_search", """WITH h AS (SELECT conv_id, turn, role, text, strpos(lower(text), 'en') AS p FROM conversations WHERE contains(lower(text), 'en') QUALIFY row_number() over (partition by conv_id order by turn desc) <= 3)
  SELECT conv_id, turn, case when greatest(p - 1 - 250, 0) > 0 then '…' else '' end || substr(text, greatest(p - 1 - 250, 0) + 1, least(length(text), p - 1 + 2 + 350) - greatest(p - 1 - 250, 0)) || case when p - 1 + 2 + 350 < length(text) then '…' else '' end AS snippet FROM h""")
def txt07(spark, d):
    return C.search_turns(table(spark, d, "conversations"), ["conv_id"], "en", [F.col("turn").desc()], 3, "text").select("conv_id", "turn", "snippet")


@query("win27_budgeted_history", """SELECT conv_id, turn FROM (SELECT *, sum(length(text)) over w AS run, row_number() over w AS pos FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE run <= 900 or pos <= 2""")
def win27(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return C.budgeted_history(m, ["conv_id"], "turn", "n", 900).select("conv_id", "turn")


@query("win28_compaction", """SELECT conv_id, turn FROM (SELECT *, sum(length(text)) over (partition by conv_id) AS tot, count(*) over (partition by conv_id) AS n, row_number() over (partition by conv_id order by turn desc) AS pos FROM conversations) WHERE tot > 2000 and n > 2 and pos > 2""")
def win28(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return C.compaction(m, ["conv_id"], "turn", "n", 2000, 2).select("conv_id", "turn")


@query("agg36_conversation_list", "SELECT user_id, count(*) AS message_count, cast(cast(max(ts) as date) as varchar) AS updated_at FROM events GROUP BY 1")
def agg36(spark, d):
    x = C.conversation_list(table(spark, d, "events"), "user_id", "ts")
    return x.select("user_id", "message_count", F.to_date("updated_at").cast("string").alias("updated_at"))


# --- mentions ---------------------------------------------------------------------------------------------------

@query("jn21_mentions", """WITH dict AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm, 'B' || item_id AS ticker FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') FROM benchmark)),
  nm AS (SELECT norm, ticker FROM dict WHERE length(norm) >= 5),
  tk AS (SELECT DISTINCT upper(w) AS ticker FROM (SELECT regexp_extract(text, '[A-Za-z]+') AS w FROM benchmark)),
  ad AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS atx FROM documents),
  tok AS (SELECT doc_id, unnest(regexp_extract_all(atx, '\\b([A-Z]{2,6}(?:\\.[A-Z])?)\\b', 1)) AS ticker, generate_subscripts(regexp_extract_all(atx, '\\b([A-Z]{2,6}(?:\\.[A-Z])?)\\b', 1), 1) - 1 AS pos FROM ad),
  tag AS (SELECT doc_id, upper(unnest(regexp_extract_all(atx, '[$#]([A-Za-z]{1,6}(?:\\.[A-Za-z])?)\\b', 1))) AS ticker, generate_subscripts(regexp_extract_all(atx, '[$#]([A-Za-z]{1,6}(?:\\.[A-Za-z])?)\\b', 1), 1) - 1 AS pos FROM ad),
  u AS (SELECT doc_id, 0 AS cls, pos, ticker FROM tag SEMI JOIN tk USING (ticker) UNION ALL SELECT doc_id, 1, pos, ticker FROM tok SEMI JOIN tk USING (ticker) WHERE ticker NOT IN ('THE', 'AND')
    UNION ALL SELECT doc_id, 2, -length(norm), ticker FROM documents, nm WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || norm || ' ')),
  f AS (SELECT doc_id, ticker, min({'c': cls, 'p': pos}) AS f FROM u GROUP BY 1, 2) SELECT doc_id, ticker, row_number() over (partition by doc_id order by f, ticker) AS rn FROM f QUALIFY rn <= 4""")
def jn21(spark, d):
    b = table(spark, d, "benchmark")
    name = F.explode(F.array("text", F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0))).alias("name")       # the whole item, and a short form of it
    names = b.select("item_id", name).select(F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")).alias("norm"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("ticker")).distinct()
    tick = b.select(F.upper(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("ticker"))
    return C.mentions(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", tick, names, ["THE", "AND"])


@query("agg41_source_dates", """WITH x AS (SELECT page_id, case when page_id % 3 = 0 then '2024-05-0' || (page_id % 9 + 1) || 'T00:00:00' when page_id % 3 = 1 then 'bad' end AS pub, 'http://x/20' || (page_id % 10 + 10) || '/' || (page_id % 12 + 1) || '/' || (page_id % 28 + 1) || '/' AS url FROM pages)
  SELECT regexp_extract((SELECT url FROM pages p WHERE p.page_id = x.page_id), '//([^/]+)/', 1) AS host, cast(max(coalesce(try_cast(substr(pub, 1, 10) as date), make_date((page_id % 10 + 2010)::bigint, (page_id % 12 + 1)::bigint, (page_id % 28 + 1)::bigint))) as varchar) AS latest FROM x GROUP BY 1""")
def agg41(spark, d):
    k = F.col("page_id")
    s = lambda c: c.cast("string")
    pub = F.when(k % 3 == 0, F.concat(F.lit("2024-05-0"), s(k % 9 + 1), F.lit("T00:00:00"))).when(k % 3 == 1, "bad")
    url = F.concat(F.lit("http://x/20"), s(k % 10 + 10), F.lit("/"), s(k % 12 + 1), F.lit("/"), s(k % 28 + 1), F.lit("/"))
    x = table(spark, d, "pages").select(F.regexp_extract("url", "//([^/]+)/", 1).alias("host"), P.source_date(pub, url, F.lit("")).alias("dt"))
    return x.groupBy("host").agg(F.max("dt").cast("string").alias("latest"))


@query("agg33_source_inventory", "SELECT source, lang, count(*) AS n, string_agg(DISTINCT cast(n_chars // 5000 as varchar), ',' ORDER BY cast(n_chars // 5000 as varchar)) AS periods FROM documents GROUP BY 1, 2")
def agg33(spark, d):
    from tallygrid.operators.inventory import source_inventory
    x = table(spark, d, "documents").withColumn("p", F.floor(F.col("n_chars") / 5000).cast("string"))
    return source_inventory(x, ["source", "lang"], "p").withColumn("periods", F.array_join("periods", ","))


@query("src19_transcript_store", "SELECT conv_id, role AS quarter, turn - min(turn) over (partition by conv_id, role) >= 0 AS ok, turn, trim(text) AS content FROM conversations WHERE trim(text) <> ''")
def src19(spark, d):
    t = table(spark, d, "conversations")
    # one store document per turn: {role: {turns: [turn]}}
    turn = F.struct(F.col("role").alias("speaker"), F.lit("t").alias("title"), F.concat(F.lit(" "), F.col("text")).alias("content"), F.lit(0.5).alias("sentiment"))
    store = t.select("conv_id", F.col("turn").alias("n"), F.create_map(F.col("role"), F.struct(F.array(turn).alias("turns"))).alias("calls"))
    x = P.transcript_turns(store, ["conv_id", "n"], "calls")
    return x.select("conv_id", "quarter", F.lit(True).alias("ok"), F.col("n").alias("turn"), "content")
