"""Page, link and extraction jobs on the benchmark tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from offerloom.functions import fixed
from offerloom.operators import pages as P
from offerloom.plans.cleaning import chain_sql
from offerloom.registry import query, table

WS = r"[ \t\n\r\f\v]+"


#: What the given pages hold; deeper nesting and other entities are golden tests.
_SEEN_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def text_sql(col):
    out = col
    for tag in ("script", "style", "nav", "footer", "header"):
        out = rf"regexp_replace({out}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for mark, text in _SEEN_ENTITIES:
        out = f"replace({out}, '{mark}', '{text.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '{WS}', ' ', 'g'))"


@query("pg01_page_text", f"WITH t AS (SELECT page_id, {text_sql('html')} AS text FROM pages) SELECT page_id, text, CASE WHEN length(text) < 100 THEN 'too_short' ELSE 'ok' END AS status FROM t")
def pg01(spark, sf):
    return P.page_text(table(spark, sf, "pages")).select("page_id", "text", "status")


_ANCHORS = r"""a AS (SELECT url AS page_url, unnest(list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>'), lambda x, i: {'a': x, 'i': i - 1}), recursive := true) FROM pages),
  h AS (SELECT page_url, i, trim(regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM a)"""
_EXCL = " OR ".join(f"contains(lower(href), '{w}')" for w in fixed.EXCLUDED_LINK_PARTS)
_LINKS = f"""{_ANCHORS}, links AS (SELECT page_url, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href AS url, min(i)::INT AS position, arg_min(text, i) AS text FROM h WHERE href <> '' AND NOT ({_EXCL}) AND length(text) BETWEEN 3 AND 200 GROUP BY ALL)"""


@query("pg02_extract_links", f"WITH {_LINKS} SELECT * FROM links")
def pg02(spark, sf):
    return P.extract_links(table(spark, sf, "pages"))


# links in the shapes that course directories use, one per part, with the part's words as link text
_URL = """CASE p_partkey % 17 WHEN 0 THEN 'https://u.edu/en/degree-programs/detail/{n}-msc' WHEN 1 THEN 'https://u.edu/detail/{n}' WHEN 2 THEN 'https://u.edu/degree-programmes/eng/{n}.html' WHEN 3 THEN 'https://u.edu/degree-programmes/x/engineering-sciences.html'
  WHEN 4 THEN 'https://u.edu/study/msc-{n}' WHEN 5 THEN 'https://u.edu/courses' WHEN 6 THEN 'https://u.edu/a/masters' WHEN 7 THEN 'https://u.edu/a/march-{n}.htm' WHEN 8 THEN 'https://u.edu/masters/{n}' WHEN 9 THEN 'https://u.edu/masters/{n}?page=2'
  WHEN 10 THEN 'https://u.edu/study/courses/pg/2026/{n}' WHEN 11 THEN 'https://u.edu/study/courses/pg/offer-holders/x' WHEN 12 THEN 'https://u.edu/x/{n}-{n}' WHEN 13 THEN 'https://u.edu/news/{n}' WHEN 14 THEN 'https://u.edu/a/index.html' WHEN 15 THEN 'https://u.edu/phd' ELSE 'https://u.edu/' END"""
_TEXT = "CASE p_size % 6 WHEN 0 THEN 'Computer Science and ' || p_name WHEN 1 THEN 'Read more' WHEN 2 THEN p_name WHEN 3 THEN 'MSc Finance ' || p_name WHEN 4 THEN 'Faculty of Law' ELSE 'PhD Physics' END"
_PLINKS = f"""l AS (SELECT p_partkey, replace({_URL}, '{{n}}', replace(p_name, ' ', '-')) AS url, {_TEXT} AS text FROM part), s AS (SELECT *, lower(url) AS u, lower(text) AS t,
  list_filter(string_split(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS g FROM l), z AS (SELECT *, coalesce(regexp_replace(g[-1], '\\.html?', '', 'g'), '') AS last, coalesce(CASE WHEN len(g) >= 2 THEN g[-2] END, '') AS parent,
  regexp_extract(u, '/detail/([a-z0-9-]+)/?$', 1) AS det, regexp_extract(u, '/degree-programmes?/[^/]+/([a-z0-9-]+)\\.html$', 1) AS nes, list_position(g, 'courses') AS ci FROM s),
  y AS (SELECT *, length(det) > 5 AND contains(det, '-') AS gd, CASE WHEN ci IS NOT NULL AND regexp_matches(g[ci + 2], '^[0-9]+$') AND len(g) > ci + 2 THEN g[ci + 3] WHEN ci IS NOT NULL THEN g[ci + 2] END AS course FROM z)"""


def _any(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def _in(expr, words):
    return f"{expr} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


_RULE = f"""CASE WHEN contains(u, '/degree-programs/') AND gd THEN '+program_detail' WHEN {_any('t', fixed.LINK_SKIP_TEXTS)} THEN '-skip_text' WHEN {_any('u', fixed.LINK_SKIP_SECTIONS)} THEN '-skip_section'
  WHEN {' OR '.join(f"ends_with(u, '{e}')" for e in fixed.LINK_LISTING_ENDINGS)} THEN '-listing' WHEN gd THEN '+detail' WHEN nes <> '' AND NOT {_in('nes', fixed.CATEGORY_SLUGS)} THEN '+nested_program' WHEN regexp_matches(u, '{'|'.join(fixed.DEGREE_PREFIX_PATTERNS)}') THEN '+degree_prefix'
  WHEN len(g) >= 2 AND {_in('last', fixed.GENERIC_SEGMENTS)} THEN '-generic_segment' WHEN len(g) >= 2 AND regexp_matches(last, '^({'|'.join(fixed.DEGREE_CODES)})(-|$)') THEN '+degree_code'
  WHEN len(g) >= 2 AND {_in('parent', fixed.DEGREE_DIRECTORIES)} AND contains(last, '-') AND length(last) > 5 AND NOT contains(u, '?') AND NOT {_any('t', fixed.DIRECTORY_SKIP_TEXTS)} THEN '+degree_directory'
  WHEN len(g) >= 4 AND ci + 1 < len(g) AND contains(course, '-') AND NOT {_in('course', fixed.GENERIC_SEGMENTS + fixed.ADMIN_SEGMENTS)} THEN '+course_path'
  WHEN len(g) >= 2 AND contains(last, '-') AND length(last) > 8 AND length(t) > 10 AND {_any('t', fixed.SUBJECT_WORDS)} AND NOT {_any('t', fixed.NAVIGATION_WORDS)} THEN '+subject_text' ELSE '-no_rule' END"""


def _links(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"replace({_URL}, '{{n}}', replace(p_name, ' ', '-')) AS url", f"{_TEXT} AS text").withColumn(
        "page_url", F.lit("https://u.edu/")).withColumn("position", F.col("p_partkey"))


@query("pg03_link_rule", f"WITH {_PLINKS} SELECT p_partkey, {_RULE} AS rule FROM y")
def pg03(spark, sf):
    return _links(spark, sf).select("p_partkey", P.link_rule("url", "text").alias("rule"))


_CAT = chain_sql("lower(text || ' ' || url)", fixed.LINK_CATEGORY_WORDS, "'Other'")
_LVL = chain_sql("lower(text || ' ' || url)", fixed.LINK_LEVEL_WORDS, "'Unknown'")


@query("pg03_program_links", f"""WITH {_PLINKS}, k AS (SELECT url, arg_min(text, p_partkey) AS text FROM y WHERE starts_with({_RULE}, '+') GROUP BY url) SELECT text AS program_name, url AS program_url, {_CAT} AS category, {_LVL} AS degree_level FROM k""")
def pg03b(spark, sf):
    return P.program_links(_links(spark, sf))


@query("pg03_program_links_pattern", f"""WITH {_PLINKS}, k AS (SELECT url, arg_min(text, p_partkey) AS text FROM y WHERE regexp_matches(url, '(?i)/STUDY/[a-z]') AND {_CAT} = 'Computer Science' GROUP BY url) SELECT text AS program_name, url AS program_url, {_CAT} AS category, {_LVL} AS degree_level FROM k""")
def pg03c(spark, sf):
    return P.program_links(_links(spark, sf), "/STUDY/[a-z]", "computer science")


_WORDS = sorted({w for _, ws in fixed.LINK_CATEGORY_WORDS for w in ws} | {w for ws in fixed.LEVEL_KEYWORDS.values() for w in ws} | set(fixed.EXTRA_PROGRAM_KEYWORDS))


@query("pg04_relevant_internal_links", f"""WITH {_PLINKS}, x AS (SELECT p_partkey, url, u, CASE p_partkey % 3 WHEN 0 THEN 'https://www.u.edu/p' WHEN 1 THEN 'https://u.edu' ELSE 'https://v.edu/' END AS base, url AS href FROM y),
  w AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS b FROM x) SELECT p_partkey, ({' + '.join(f"contains(u, '{k}')::INT" for k in _WORDS)}) >= 2 OR {_any('u', fixed.PROGRAM_PATHS)} AS is_program
  FROM w WHERE (ends_with(h, b) OR ends_with(b, h)) AND NOT ({_EXCL}) AND NOT regexp_matches(u, '\\.(pdf|doc|docx|xls|xlsx)$')""")
def pg04(spark, sf):
    base = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'https://www.u.edu/p' WHEN 1 THEN 'https://u.edu' ELSE 'https://v.edu/' END")
    return P.relevant_internal_links(_links(spark, sf).withColumn("page_url", base)).select("p_partkey", "is_program")


@query("pg05_reachable_pages", """WITH e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS n FROM (SELECT 'p' || l_partkey AS src, 'p' || (l_orderkey % (SELECT count(*) FROM part)) AS dst, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)), f AS (SELECT src, dst FROM e WHERE n <= 5),
  s AS (SELECT 'p' || p_partkey AS url FROM part), d1 AS (SELECT DISTINCT url AS seed, dst AS url FROM s JOIN f ON url = src), d2 AS (SELECT DISTINCT seed, dst AS url FROM d1 JOIN f ON url = src),
  a AS (SELECT url AS seed, url, 0 AS depth FROM s UNION ALL SELECT seed, url, 1 FROM d1 UNION ALL SELECT seed, url, 2 FROM d2) SELECT seed, url, min(depth) AS depth FROM a GROUP BY ALL""")
def pg05(spark, sf):
    part = table(spark, sf, "part")
    links = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("page_url"), F.concat(F.lit("p"), F.col("l_orderkey") % part.agg(F.count("*")).scalar()).alias("url"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return P.reachable_pages(links, part.select(F.concat(F.lit("p"), "p_partkey").alias("url")), depth=2, fan_out=5, max_pages=None)


_SLUG = "'https://u.edu/study/' || replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '/bsc-' || lower(p_type) || '.html' WHEN 1 THEN '/j702-' || lower(p_type) || '-of-the-x_12345' WHEN 2 THEN '/courses/' ELSE '/phd.php' END"
_CAP = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("pg06_name_from_url", f"""WITH x AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'bsc ' || lower(p_type) WHEN 1 THEN lower(p_type) || ' of the x' WHEN 2 THEN p_name ELSE 'phd' END AS n, p_size % 4 AS m, lower(p_type) AS ty FROM part)
  SELECT p_partkey, CASE m WHEN 0 THEN 'BSc ' || upper(ty[1]) || ty[2:] WHEN 3 THEN NULL ELSE {_CAP.format(x='n')} END AS name,
  CASE m WHEN 0 THEN 'BSC ' || upper(ty[1]) || ty[2:] WHEN 1 THEN 'J702 ' || upper(ty[1]) || ty[2:] || ' of the X 12345' WHEN 2 THEN 'Courses' ELSE 'Phd.php' END AS title FROM x""")
def pg06(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{_SLUG} AS url")
    return p.select("p_partkey", P.name_from_url("url").alias("name"), P.slug_title("url").alias("title"))


@query("pg07_degree_from_url", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Doctor of Philosophy' WHEN 1 THEN CASE WHEN contains(p_name, 'engineering') THEN 'Bachelor of Engineering' ELSE 'Bachelor of Science' END WHEN 2 THEN 'Bachelor of Engineering' WHEN 3 THEN 'Bachelor of Arts' WHEN 4 THEN 'Master of Business Administration' WHEN 5 THEN 'Master of Philosophy'
  WHEN 6 THEN 'Master of Engineering' WHEN 7 THEN 'Master of Arts' ELSE 'Master of Science' END AS degree FROM part""")
def pg07(spark, sf):
    u = "CASE p_partkey % 9 WHEN 0 THEN '/phd/x' WHEN 1 THEN '/undergraduate/x' WHEN 2 THEN '/bsc-engineering' WHEN 3 THEN '/bachelor-history' WHEN 4 THEN '/mba' WHEN 5 THEN '/mphil-x' WHEN 6 THEN '/meng-x' WHEN 7 THEN '/ma-x' ELSE '/study/x' END"
    return table(spark, sf, "part").selectExpr("p_partkey", f"concat('http://u', {u}) AS url", "p_name").select("p_partkey", P.degree_from_url("url", "p_name").alias("degree"))


def _offer_pages(spark, sf):
    """Programme pages written from order rows."""
    return table(spark, sf, "orders").selectExpr(
        "concat('u', o_orderkey) AS url", """concat('<html><script>IELTS: 1</script><h1> Offer <b>', o_orderpriority, '</b></h1><div class="detail-box"><label>Duration</label><span class="value">', o_custkey % 5, ' years</span></div><p>Domestic fee £', o_custkey, ',500 a year</p><p>International students pay USD ',
        cast(o_totalprice AS bigint), '</p><li>', CASE WHEN o_orderkey % 2 = 0 THEN concat('IELTS: ', o_custkey % 9, '.5') ELSE '' END, '</li><td>TOEFL ', 60 + o_custkey % 60, '</td></html>') AS html""")


@query("pg08_extract_offer_fields", """SELECT 'u' || o_orderkey AS program_url, 'Offer ' || o_orderpriority AS program_name, o_custkey || ',500' AS fee_domestic, (trunc(o_totalprice)::BIGINT)::VARCHAR AS fee_international, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 9) || '.5+' END AS ielts_score,
  (60 + o_custkey % 60) || '+' AS toefl_score, NULL::VARCHAR AS pte_score, (o_custkey % 5) || ' years' AS duration, NULL::VARCHAR AS tuition_fee_summary, NULL::VARCHAR AS degree_type, NULL::VARCHAR AS study_level FROM orders""")
def pg08(spark, sf):
    return P.extract_offer_fields(_offer_pages(spark, sf))


@query("pg08_merge_over", """SELECT 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 9) || '.5+' ELSE 'old' END AS ielts_score, o_orderstatus AS kept FROM orders""")
def pg08b(spark, sf):
    disc = table(spark, sf, "orders").selectExpr("concat('u', o_orderkey) AS url", "'old' AS ielts_score", "o_orderstatus AS kept")
    detail = P.extract_offer_fields(_offer_pages(spark, sf)).withColumnRenamed("program_url", "url").select("url", "ielts_score")
    return P.merge_over(disc, detail, "url")


_ITEM = {"rank": r'(?s)class="rank">(.*?)</div>', "name": r'(?s)class="uni-link"[^>]*>(.*?)</a>', "location": r'(?s)class="location">(.*?)</div>', "score": r'(?s)class="score">(.*?)</div>', "profile_url": r'(?s)href="([^"]*)"'}


@query("pg09_extract_ranking_rows", """SELECT (s_suppkey + 1)::INT AS rank, s_name AS university_name, 'NATION_' || s_nationkey AS country, 'City ' || s_suppkey AS city, s_acctbal AS score, 'https://site.example/universities/' || s_suppkey AS profile_url FROM supplier WHERE s_suppkey % 9 <> 0 AND s_acctbal >= 0""")
def pg09(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal >= 0").withColumn("page", F.floor(F.col("s_suppkey") / 50))  # pages of 50 items
    item = F.expr("""concat('<div class="ranking-item"><div class="rank">#', s_suppkey + 1, '-', s_suppkey + 10, '</div><a class="uni-link" href="/universities/', s_suppkey, '">', CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END, '</a><div class="location">City ', s_suppkey, ', NATION_', s_nationkey, '</div><div class="score">Overall Score: ', s_acctbal, '</div></div>')""")
    pages = s.groupBy("page").agg(F.concat(F.lit("<html>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</html>")).alias("html"))
    d = P.extract_ranking_rows(pages, '<div class="ranking-item">', _ITEM, "https://site.example", subject=F.lit("x"))
    return d.select("rank", "university_name", "country", "city", "score", "profile_url")


@query("pg10_dedup_by_content", "SELECT min(doc_id) AS doc_id, md5(text) AS fingerprint, count(*) AS n_copies FROM documents GROUP BY text")
def pg10(spark, sf):
    distinct, by_page = P.dedup_by_content(table(spark, sf, "documents"), "text", "doc_id")
    copies = by_page.groupBy("fingerprint").agg(F.count("*").alias("n_copies"))
    return distinct.select("doc_id", "fingerprint").join(copies, "fingerprint")


_RESP = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here is the program: ' || props || ' as asked.' WHEN 3 THEN 'no answer about tuition' ELSE '{"name": "", "k": 5, "x": null, "l": []}' END"""


@query("pg11_parse_extractions", f"""WITH r AS (SELECT event_id, {_RESP} AS t, json_extract_string(props, '$.k') AS pk FROM events) SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '5' ELSE pk END AS k, CASE event_id % 5 WHEN 3 THEN NULL ELSE 1 END AS n_fields,
  round(0.5 + CASE WHEN event_id % 5 IN (0, 4) THEN 0.3 ELSE -0.2 END + CASE WHEN event_id % 5 IN (2, 3) THEN 0.1 ELSE 0 END + CASE WHEN length(t) < 50 THEN -0.2 WHEN length(t) > 200 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS response_score FROM r""")
def pg11(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_id", f"{_RESP} AS t")
    d = P.parse_extractions(r, "t")
    return d.select("event_id", F.try_element_at("fields", F.lit("k")).alias("k"), F.array_size(F.map_keys("fields")).alias("n_fields"), F.round("response_score", 4).alias("response_score"))


@query("pg12_extract_with", "SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_blank FROM documents")
def pg12(spark, sf):
    def count_marks(batches):
        for b in batches:
            text = b["content"]
            yield pd.DataFrame({"fingerprint": b["fingerprint"], "n_chars": text.str.len().astype("int64"), "n_blank": text.str.count(" ").astype("int64")})

    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.extract_with(d, count_marks, "fingerprint string, n_chars bigint, n_blank bigint", "doc_id", "text").drop("fingerprint")


@query("pg12_extract_with_rules", "SELECT count(*) FILTER (o_orderkey % 2 = 0) AS successful, count(*) FILTER (o_orderkey % 2 <> 0) AS failed FROM orders")
def pg12b(spark, sf):
    return P.extraction_counts(P.extract_with(_offer_pages(spark, sf)), "ielts_score")
