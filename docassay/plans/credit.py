"""Strict rules over made-up credit reports; the oracle reads the same texts by its own patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import credit, serving, strict
from docassay.plans import projections as P
from docassay.plans.registry import query

LINE, PAGE = "chr(10)", "chr(12)"

#: Short reports of order keys: number, report time with or without seconds, and a labelled later date.
SHORT = f"""
SELECT k, concat('个人信用报告', {LINE}, '报告编号：', CAST(stamp + CASE WHEN k % 3 = 0 THEN 1000000 ELSE 0 END AS STRING), '0001', {LINE}, '报告时间：', CASE WHEN k % 4 = 1 THEN day ELSE concat(day, ' ', hour) END, {LINE}, {PAGE},
  CASE k % 7 WHEN 3 THEN '开户日期：2031-01-01' WHEN 4 THEN '说明 2031-02-03' WHEN 5 THEN concat('开户日期：2012-01-01', {LINE}, '到期日期：2031/1/1') ELSE '到期日期：2031-01-01' END) AS text,
  k % 4 <> 2 AS number_reliable, k % 5 <> 1 AS embedded
FROM (SELECT k, 20200101000000 + (k % 27) * 1000000 + (k % 24) * 10000 + (k % 60) * 100 + k % 60 AS stamp, concat('2020-01-', lpad(CAST(1 + k % 27 AS STRING), 2, '0')) AS day,
  concat(lpad(CAST(k % 24 AS STRING), 2, '0'), ':', lpad(CAST(k % 60 AS STRING), 2, '0'), ':', lpad(CAST(k % 60 AS STRING), 2, '0')) AS hour FROM (SELECT o_orderkey AS k FROM {{orders}}) o) x
"""

READ_CTE = """n AS (SELECT *, replace(text, '：', ':') AS norm, split_part(replace(text, '：', ':'), chr(12), 1) AS cover FROM s),
m AS (SELECT *, regexp_extract(cover, '报告编号:\\s*([0-9]{14,28})', 1) AS number, regexp_extract(cover, '报告时间:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS day, regexp_extract(cover, '报告时间:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8})', 1) AS moment,
  list_transform(regexp_extract_all(norm, '[^\\n\\f0-9]*(?:19|20)[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}'), lambda x: {'label': regexp_extract(x, '^([^0-9]*)', 1), 'at': try_strptime(replace(regexp_extract(x, '([0-9/-]+)$', 1), '/', '-'), '%Y-%m-%d')}) AS dates FROM n),
t AS (SELECT *, try_strptime(nullif(moment, ''), '%Y-%m-%d %H:%M:%S') AS exact, try_strptime(nullif(day, ''), '%Y-%m-%d') AS any_day FROM m),
u AS (SELECT *, list_transform(list_filter(dates, lambda x: x.at > coalesce(exact, any_day + INTERVAL '23 hours 59 minutes 59 seconds')), lambda x: CASE WHEN regexp_matches(x.label, '到期日期:?$') THEN 'forward' WHEN regexp_matches(x.label, '开户日期:?$') THEN 'historical' ELSE 'unknown' END) AS later FROM t),
g AS (SELECT *, CASE WHEN length(number) < 14 OR exact IS NULL THEN 'manual' WHEN left(number, 14) = strftime(exact, '%Y%m%d%H%M%S') THEN 'pass' WHEN number_reliable THEN 'fail' ELSE 'manual' END AS g1,
  CASE WHEN any_day IS NULL THEN 'manual' WHEN list_contains(later, 'historical') AND embedded THEN 'fail' WHEN list_contains(later, 'historical') OR list_contains(later, 'unknown') THEN 'manual' ELSE 'pass' END AS g2 FROM u)"""


@query(f"WITH s AS ({P.oracle(SHORT)}), {READ_CTE} SELECT k, g1, g2 FROM g")
def credit_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report number, report time and later dates, over short reports made from order keys."""
    return credit.common_rules(P.spark_sql(spark, sf_dir, SHORT)).select("k", "g1", "g2")


GOOD_FONTS = "concat('name type', chr(10), 'ABCDEF+Helvetica Type 1 WinAnsi no no no', chr(10), 'GHIJKL+SourceHanSerifCN-Regular CID TrueType Identity-H yes yes yes')"

#: Whole reports of customer keys: online and printed personal ones, enterprise ones, scans and unknown ones.
FULL = f"""
SELECT source_id, CASE WHEN kind = 5 THEN '' ELSE full_text END AS native_text, CASE WHEN kind = 5 AND k % 4 <> 1 THEN full_text END AS ocr_text, CAST(1 + k % 3 AS INT) AS pages, CAST(CASE WHEN k % 7 = 0 THEN 1 + k % 3 ELSE 0 END AS INT) AS large_images,
  CAST(20 AS INT) AS font_objects, CASE WHEN k % 4 = 0 THEN {GOOD_FONTS} WHEN k % 4 = 1 THEN 'Arial TrueType WinAnsi yes yes no' ELSE '' END AS fonts, k % 11 <> 0 AS fonts_readable,
  CAST(created AS TIMESTAMP) AS created, CAST(CASE WHEN k % 3 = 0 THEN created ELSE concat('2021-01-01', substring(created, 11, 9)) END AS TIMESTAMP) AS modified,
  CASE WHEN k % 4 < 2 THEN 'iText 2.1.7 by 1T3XT' ELSE 'Press' END AS producer, CASE WHEN k % 5 < 3 THEN '1.4' ELSE '1.7' END AS version, k % 13 <> 0 AS metadata_readable
FROM (SELECT k, kind, source_id, concat('2020-01-', lpad(CAST(1 + (k + CASE k % 5 WHEN 1 THEN 3 WHEN 2 THEN 20 ELSE 0 END) % 27 AS STRING), 2, '0'), ' 23:30:00') AS created,
  concat(head, {LINE}, '报告编号：', CAST(20200101120000 + (k % 27) * 1000000 AS STRING), CASE WHEN k % 6 = 0 THEN '99' ELSE '' END, {LINE}, '报告时间：2020-01-', lpad(CAST(1 + (k + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) % 27 AS STRING), 2, '0'), ' 12:00:00', {LINE}, {PAGE}, tail, {LINE},
    CASE k % 9 WHEN 2 THEN '开户日期：2031-01-01' WHEN 3 THEN '其他 2031-01-01' ELSE '到期日期：2031-01-01' END, {LINE}, repeat('正文', 200)) AS full_text
FROM (SELECT k, k % 6 AS kind, concat('credit_', CAST(k AS STRING)) AS source_id,
  CASE k % 6 WHEN 0 THEN '个人信用报告 自主查询版' WHEN 1 THEN '个人信用报告' WHEN 4 THEN '其他材料' ELSE concat('企业信用报告', {LINE}, '企业名称：测试', CAST(k % 50 AS STRING), '公司', {LINE}, '中征码：', lpad(CAST(k AS STRING), 16, '1'), {LINE}, '统一社会信用代码：', lpad(CAST(k AS STRING), 18, 'A'), CASE WHEN k % 6 = 3 THEN concat({LINE}, '查询机构：某租赁公司') ELSE '' END) END AS head,
  CASE WHEN k % 6 = 1 THEN concat('个人基本信息 还款状态', {LINE}, '证件号码：1101011990', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '011234', {LINE}, '出生日期 1990-', lpad(CAST(1 + (k + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END) % 12 AS STRING), 2, '0'), '-01', {LINE}, CASE WHEN k % 4 = 3 THEN '出生日期 1991-01-01' ELSE '' END)
    WHEN k % 6 IN (2, 3, 5) THEN concat('身份标识', {LINE}, '企业名称 测试', CAST((k + CASE WHEN k % 10 = 2 THEN 1 ELSE 0 END) % 50 AS STRING), '公司', {LINE}, CASE WHEN k % 14 = 2 THEN concat('企业名称 又一公司', {LINE}) ELSE '' END, '中征码', {LINE}, lpad(CAST(k AS STRING), 16, '1'), {LINE}, '统一社会信用代码 ', CASE WHEN k % 15 = 3 THEN '未知' ELSE lpad(CAST(k AS STRING), 18, 'A') END)
    ELSE '内容' END AS tail FROM (SELECT c_custkey AS k FROM {{customer}}) c) h) r
"""

FULL_SQL = f"""
WITH f AS ({P.oracle(FULL)}),
e AS (SELECT *, coalesce(length(regexp_replace(native_text, '\\s', '', 'g')) >= 300 AND pages > 0 AND large_images < ceil(pages * 0.8), false) AS embedded FROM f),
s AS (SELECT *, embedded AS number_reliable, CASE WHEN embedded THEN native_text ELSE coalesce(nullif(ocr_text, ''), native_text) END AS text FROM e),
{READ_CTE},
v AS (SELECT *, CASE WHEN contains(text, '企业信用报告') THEN CASE WHEN NOT embedded THEN 'scanned_enterprise' WHEN regexp_matches(cover, '查询机构:[^\\n]*租赁') THEN 'leasing_enterprise' ELSE 'online_enterprise' END
  WHEN contains(text, '个人信用报告') THEN CASE WHEN contains(text, '自主查询版') THEN CASE WHEN embedded THEN 'online_personal' ELSE 'scanned_online_personal' END WHEN contains(text, '还款状态') THEN 'pboc_print_personal' ELSE 'unknown' END ELSE 'unknown' END AS report_variant,
  split_part(norm, chr(12), 2) AS body, list_distinct(regexp_extract_all(norm, '证件号码:([0-9]{{18}})', 1)) AS ids, list_distinct(regexp_extract_all(norm, '出生日期 ([0-9-]{{10}})', 1)) AS births FROM g),
w AS (SELECT *, list_distinct(regexp_extract_all(body, '企业名称\\s+([^\\s]+)', 1)) AS names, regexp_extract(cover, '企业名称:([^\\s]+)', 1) AS name, regexp_extract(body, '中征码\\s+([0-9]{{16}})', 1) = regexp_extract(cover, '中征码:([0-9]{{16}})', 1) AS same_code,
  regexp_extract(body, '统一社会信用代码\\s+([0-9A-Z]{{18}})', 1) AS social, regexp_extract(cover, '统一社会信用代码:([0-9A-Z]{{18}})', 1) AS social_cover FROM v),
x AS (SELECT source_id, CASE WHEN embedded THEN 'original_electronic' ELSE 'scanned_or_image' END AS source_format, report_variant, embedded, {{'G1': g1, 'G2': g2, 'G3': 'manual', 'G4': 'manual',
  'P1A': CASE WHEN NOT embedded THEN 'not_applicable' WHEN NOT metadata_readable THEN 'manual' WHEN created = modified THEN 'pass' ELSE 'possible' END,
  'P1B': CASE WHEN NOT embedded THEN 'not_applicable' WHEN NOT metadata_readable THEN 'manual' WHEN producer = 'iText 2.1.7 by 1T3XT' THEN 'pass' ELSE 'possible' END,
  'P1C': CASE WHEN NOT embedded THEN 'not_applicable' WHEN NOT metadata_readable THEN 'manual' WHEN version = '1.4' THEN 'pass' ELSE 'possible' END,
  'P1D': CASE WHEN NOT embedded THEN 'not_applicable' WHEN NOT fonts_readable THEN 'manual' WHEN contains(fonts, 'SourceHanSerifCN') THEN 'pass' ELSE 'possible' END,
  'P2': CASE WHEN NOT embedded THEN 'not_applicable' WHEN NOT metadata_readable OR exact IS NULL THEN 'manual' WHEN exact > created THEN 'fail' WHEN created - exact <= INTERVAL 1 DAY THEN 'pass' ELSE 'manual' END,
  'O1': CASE WHEN report_variant IN ('online_personal', 'scanned_online_personal') THEN 'manual' ELSE 'not_applicable' END,
  'H1': CASE WHEN report_variant <> 'pboc_print_personal' THEN 'not_applicable' WHEN NOT embedded OR len(ids) <> 1 OR len(births) <> 1 THEN 'manual' WHEN substring(ids[1], 7, 8) = replace(births[1], '-', '') THEN 'pass' ELSE 'fail' END,
  'H2': 'print', 'H3': 'print', 'H4': 'print', 'H5': 'print', 'H6': 'print', 'C1': 'enterprise',
  'C2': CASE WHEN NOT contains(report_variant, 'enterprise') THEN 'not_applicable' WHEN NOT embedded OR len(names) > 1 THEN 'manual' WHEN len(names) = 1 AND names[1] <> name THEN 'fail' WHEN names[1] = name AND same_code AND social = social_cover THEN 'pass' ELSE 'manual' END,
  'C3A': 'enterprise', 'C3B': 'enterprise', 'C3C': 'enterprise', 'C3D': 'enterprise'}} AS r FROM w),
y AS (UNPIVOT (SELECT source_id, source_format, report_variant, embedded, unnest(r) FROM x) ON COLUMNS(* EXCLUDE (source_id, source_format, report_variant, embedded)) INTO NAME rule_id VALUE status),
z AS (SELECT source_id, source_format, report_variant, rule_id, CASE status WHEN 'print' THEN CASE WHEN report_variant = 'pboc_print_personal' THEN 'manual' ELSE 'not_applicable' END WHEN 'enterprise' THEN CASE WHEN contains(report_variant, 'enterprise') THEN 'manual' ELSE 'not_applicable' END ELSE status END AS status FROM y
  UNION ALL SELECT source_id, source_format, report_variant, rule_id, 'manual' FROM (SELECT source_id, source_format, report_variant, unnest([CASE WHEN report_variant = 'unknown' THEN 'A0' END, CASE WHEN report_variant = 'scanned_online_personal' THEN 'A1' END, CASE WHEN report_variant = 'pboc_print_personal' THEN 'A2' END, CASE WHEN report_variant = 'scanned_enterprise' THEN 'A3' END]) AS rule_id FROM x) a WHERE rule_id IS NOT NULL)
"""


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.analyse(P.spark_sql(spark, sf_dir, FULL, customer="c_custkey"))


@query(FULL_SQL + "SELECT * FROM z")
def credit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 rules of whole reports, and the prerequisites that apply."""
    return full(spark, sf_dir).select("source_id", "source_format", "report_variant", "rule_id", "status")


@query(FULL_SQL + """, c AS (SELECT source_id, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'possible') AS possible, count(*) FILTER (status = 'manual') AS manual, count(*) FILTER (status = 'not_applicable') AS not_applicable FROM z WHERE rule_id NOT LIKE 'A_' GROUP BY 1)
SELECT *, CASE WHEN fail > 0 THEN 'fail' WHEN possible > 0 THEN 'possible' WHEN manual > 0 THEN 'manual' ELSE 'pass' END AS overall_status FROM c""")
def credit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the numbered rules' statuses and the overall one of each report."""
    return credit.status_counts(full(spark, sf_dir))


@query("""WITH r AS (SELECT concat('credit_', CAST(c_custkey AS STRING)) AS source_id, c_custkey AS k FROM customer),
i AS (SELECT k, source_id, CASE WHEN k % 10 = 3 THEN ['H3', 'G2'] ELSE [] END AS missing, CASE WHEN k % 10 = 4 THEN ['P2'] ELSE [] END AS duplicates, CASE WHEN k % 10 = 5 THEN ['X9'] ELSE [] END AS unexpected FROM r)
SELECT source_id, list_sort(missing) AS missing, duplicates, unexpected FROM i WHERE k % 10 IN (3, 4, 5)""")
def invalid_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose rule set lacks, repeats or adds rules; some are made so."""
    r = full(spark, sf_dir).select("source_id", "rule_id", F.substring_index("source_id", "_", -1).cast("int").alias("k"))
    kept = r.where(~((F.col("k") % 10 == 3) & F.col("rule_id").isin("H3", "G2")))
    again = r.where((F.col("k") % 10 == 4) & (F.col("rule_id") == "P2"))
    other = r.where((F.col("k") % 10 == 5) & (F.col("rule_id") == "G1")).withColumn("rule_id", F.lit("X9"))
    return strict.invalid_sets(kept.unionByName(again).unionByName(other))


@query(FULL_SQL + ", q AS (SELECT *, 'CR-' || upper(substr(sha256(source_id), 1, 10)) AS document_id FROM z) SELECT document_id, source_id, rule_id, status FROM q WHERE source_id = 'credit_14'")
def one_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of one report, asked for by its public name."""
    return serving.one_report(full(spark, sf_dir), serving.name_of("credit_14")).select("document_id", "source_id", "rule_id", "status")


@query(FULL_SQL + """, p AS (SELECT *, list_position(['G1','G2','G3','G4','P1A','P1B','P1C','P1D','P2','O1','H1','H2','H3','H4','H5','H6','C1','C2','C3A','C3B','C3C','C3D'], rule_id) AS place FROM z),
c AS (SELECT 'CR-' || upper(substr(sha256(source_id), 1, 10)) AS document_id, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'possible') AS possible FROM p GROUP BY 1),
k AS (SELECT document_id, CASE WHEN fail > 0 THEN 'fail' ELSE 'possible' END AS risk_conclusion, fail, possible FROM c WHERE fail > 0 OR possible > 0)
SELECT * FROM k ORDER BY CASE risk_conclusion WHEN 'fail' THEN 0 ELSE 1 END, fail DESC, possible DESC, document_id LIMIT 12""")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve reports that need attention first."""
    return serving.attention(serving.public_rows(full(spark, sf_dir))).select("document_id", "risk_conclusion", "fail", "possible")
