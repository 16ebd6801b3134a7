"""Registered queries of the quality operators, each with its DuckDB equivalent."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars as s
from granary.operators import completeness as comp
from granary.operators import duplicates as dup
from granary.operators import outliers as outl
from granary.operators import recommendations as recs
from granary.operators import timeliness as tim
from granary.operators.records import column_scope, dataset_scope
from granary.plans.scratch import folder
from granary.plans.session import Check
from granary.plans.sinks import numbered, save_json, write_parts
from granary.sources.registry import load

AS_OF = datetime(2026, 1, 1, 12)
NOW = "TIMESTAMP '2026-01-01 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, with nulls and NaN put where the tables have none."""
    e = table(spark, sf_dir, "events")
    gap = F.when(F.col("event_type") != "click", F.col("event_type"))
    return e.withColumn("event_type", gap).withColumn("value", F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")))


GAPS = "(SELECT event_id, ts, user_id, nullif(event_type, 'click') AS event_type, CASE WHEN value < 10 THEN NULL ELSE value END AS value, props FROM events)"
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def completeness_columns(spark, sf_dir):
    return comp.column_completeness(comp.merge_counts(comp.partial_counts(events_with_gaps(spark, sf_dir))))


SQL_COMPLETENESS_COLUMNS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) AS rows, round(count({c}) / greatest(count(*), 1), 2) AS ratio FROM {GAPS}" for c in EVENT_COLUMNS)


def completeness_dataset(spark, sf_dir):
    return comp.dataset_completeness(comp.merge_counts(comp.partial_counts(events_with_gaps(spark, sf_dir))))


_PRESENT = " + ".join(f"count({c})" for c in EVENT_COLUMNS)
SQL_COMPLETENESS_DATASET = f"""
SELECT n, 6::BIGINT AS n_var, 6 * n - present AS n_cells_missing, round((6 * n - present) / (6 * n), 6) AS p_cells_missing, round(1 - (6 * n - present) / (6 * n), 2) AS score
FROM (SELECT count(*) AS n, {_PRESENT} AS present FROM {GAPS})"""


def completeness_parts(spark, sf_dir):
    """Two parts of different columns: a column counts only rows of parts that have it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return comp.column_completeness(comp.merge_counts(comp.partial_counts(orders), comp.partial_counts(customers)))


SQL_COMPLETENESS_PARTS = """
WITH o AS (SELECT o_orderkey AS key, o_orderdate AS day, nullif(o_orderstatus, 'F') AS status FROM orders), c AS (SELECT c_custkey AS key, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer),
p AS (SELECT 'key' AS col, count(key) AS present, count(*) AS rows FROM o UNION ALL SELECT 'day', count(day), count(*) FROM o UNION ALL SELECT 'status', count(status), count(*) FROM o UNION ALL SELECT 'key', count(key), count(*) FROM c UNION ALL SELECT 'balance', count(balance), count(*) FROM c)
SELECT col AS "column", CAST(sum(present) AS BIGINT) AS present, CAST(sum(rows) AS BIGINT) AS rows, round(sum(present) / sum(rows), 2) AS ratio FROM p GROUP BY col"""


def flat(metrics: DataFrame) -> DataFrame:
    return metrics.select("key", "value", "value_num", "value_type", F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"), F.col("scope.parent_scope.value").alias("parent"))


def completeness_rows(spark, sf_dir):
    return flat(comp.completeness_metrics(comp.merge_counts(comp.partial_counts(events_with_gaps(spark, sf_dir))), "events"))


def sql_text(x: str) -> str:
    """A double as text, with at least one decimal, in SQL."""
    return f"regexp_replace(printf('%.6f', {x}), '(\\.\\d+?)0+$', '\\1')"


#: As Spark writes a small double.
def sql_double(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '0.0' WHEN abs({x}) < 0.001 THEN regexp_replace(printf('%.5e', {x}), '(\\.\\d+?)0*e-0?', '\\1E-') ELSE {sql_text(x)} END"


SQL_COMPLETENESS_ROWS = f"""
SELECT 'completeness_score' AS key, {sql_text("ratio")} AS value, ratio AS value_num, 'text' AS value_type, 'column' AS perimeter, "column" AS name, 'events' AS parent FROM ({SQL_COMPLETENESS_COLUMNS})
UNION ALL SELECT unnest(['n', 'n_var', 'n_cells_missing', 'p_cells_missing', 'score']), unnest([n::VARCHAR, n_var::VARCHAR, n_cells_missing::VARCHAR, {sql_double("p_cells_missing")}, {sql_text("score")}]), unnest([n::DOUBLE, n_var::DOUBLE, n_cells_missing::DOUBLE, p_cells_missing, score]), unnest(['int', 'int', 'int', 'float', 'text']), 'dataset', 'events', NULL FROM ({SQL_COMPLETENESS_DATASET})"""


def schema_rows(spark, sf_dir):
    rows = comp.schema_rows(table(spark, sf_dir, "lineitem"), "lineitem")
    return rows.select("key", "value", F.col("scope.perimeter").alias("perimeter"), F.col("scope.parent_scope.value").alias("parent"))


SQL_SCHEMA_ROWS = """
SELECT 'column' AS key, column_name AS value, 'column' AS perimeter, 'lineitem' AS parent FROM (DESCRIBE lineitem)
UNION ALL SELECT 'dataset', 'lineitem', 'dataset', NULL"""


def _lineitem_keys(spark, sf_dir):
    return dup.key_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicates_score(spark, sf_dir):
    return dup.duplicate_score(_lineitem_keys(spark, sf_dir))


SQL_DUPLICATES_SCORE = """
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates, CAST(sum(c - 1) AS DOUBLE) / sum(c) AS rate, round(1 - CAST(sum(c - 1) AS DOUBLE) / sum(c), 2) AS score
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def duplicate_keys(spark, sf_dir):
    return dup.duplicate_keys(_lineitem_keys(spark, sf_dir))


SQL_DUPLICATE_KEYS = "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def duplicate_keys_with_gaps(spark, sf_dir):
    """Null and NaN are one key value."""
    return dup.duplicate_keys(dup.key_counts(events_with_gaps(spark, sf_dir), ["event_type", "value"]))


SQL_DUPLICATE_KEYS_WITH_GAPS = f"SELECT event_type, value, count(*) AS copies FROM {GAPS} GROUP BY ALL HAVING count(*) > 1"


def duplicates_rows(spark, sf_dir):
    return flat(dup.duplicate_metrics(_lineitem_keys(spark, sf_dir), "lineitem"))


SQL_DUPLICATES_ROWS = f"SELECT unnest(['score', 'duplicates']) AS key, unnest([{sql_text('score')}, duplicates::VARCHAR]) AS value, unnest([score, duplicates::DOUBLE]) AS value_num, unnest(['text', 'int']) AS value_type, 'dataset' AS perimeter, 'lineitem' AS name, CAST(NULL AS VARCHAR) AS parent FROM ({SQL_DUPLICATES_SCORE})"


def _nation_partials(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    by = c.groupBy("c_nationkey").agg(F.avg(F.when(F.col("c_acctbal") < 0, 0.0).otherwise(1.0)).alias("normality"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("outliers"), F.count(F.lit(1)).alias("rows"))
    columns = by.select(F.concat(F.lit("segment_"), (F.col("c_nationkey") % 5).cast("string")).alias("column"), "normality", "outliers", "rows")
    return columns.unionByName(by.select(F.lit(None).cast("string").alias("column"), "normality", "outliers", "rows"))


def outlier_merge(spark, sf_dir):
    m = outl.merge_stats(_nation_partials(spark, sf_dir))
    return m.select("column", F.round("normality", 6).alias("normality"), "outliers", "rows")


_PARTIALS = """(SELECT c_nationkey, avg(CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE 1.0 END) AS normality, count(*) FILTER (c_acctbal < 0) AS outliers, count(*) AS rows FROM customer GROUP BY c_nationkey)"""
SQL_OUTLIER_MERGE = f"""
SELECT col AS "column", round(sum(normality * rows) / sum(rows), 6) AS normality, CAST(sum(outliers) AS BIGINT) AS outliers, CAST(sum(rows) AS BIGINT) AS rows
FROM (SELECT 'segment_' || (c_nationkey % 5) AS col, normality, outliers, rows FROM {_PARTIALS} UNION ALL SELECT NULL, normality, outliers, rows FROM {_PARTIALS}) GROUP BY col"""


def outlier_rows(spark, sf_dir):
    return flat(outl.outlier_metrics(outl.merge_stats(_nation_partials(spark, sf_dir)), "customer"))


SQL_OUTLIER_ROWS = f"""
WITH m AS ({SQL_OUTLIER_MERGE}), w AS (SELECT round(normality, 2) AS normality, outliers, (SELECT CAST(sum(outliers) AS BIGINT) FROM m WHERE "column" IS NOT NULL) AS total FROM m WHERE "column" IS NULL)
SELECT unnest(['normality_score', 'outliers']) AS key, unnest([{sql_double("round(normality, 2)")}, outliers::VARCHAR]) AS value, unnest([round(normality, 2), outliers::DOUBLE]) AS value_num, unnest(['float', 'int']) AS value_type, 'column' AS perimeter, "column" AS name, 'customer' AS parent FROM m WHERE "column" IS NOT NULL
UNION ALL SELECT unnest(['outliers', 'normality_score_dataset', 'score', 'total_outliers_count']), unnest([outliers::VARCHAR, {sql_double("normality")}, {sql_text("normality")}, total::VARCHAR]), unnest([outliers::DOUBLE, normality, normality, total::DOUBLE]), unnest(['int', 'float', 'text', 'int']), 'dataset', 'customer', NULL FROM w"""


def outlier_advice(spark, sf_dir):
    rows = outl.outlier_advice(outl.merge_stats(_nation_partials(spark, sf_dir)), "customer", 0.95)
    return rows.select("content", F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"), "type", "level")


SQL_OUTLIER_ADVICE = f"""
WITH m AS ({SQL_OUTLIER_MERGE}), c AS (SELECT "column" AS col, round(normality, 2) AS x, outliers, rows FROM m)
SELECT 'Normality of column ''' || col || ''' is ' || {sql_text("round(x * 100, 2)")} || '%, below the threshold.' AS content, 'column' AS perimeter, col AS name, 'Outliers' AS type, CASE WHEN 1 - x > 0.5 THEN 'high' WHEN 1 - x > 0.3 THEN 'warning' ELSE 'info' END AS level FROM c WHERE col IS NOT NULL AND x < 0.95
UNION ALL SELECT 'Normality of dataset ''customer'' is ' || {sql_text("round(x * 100, 2)")} || '%, below the threshold.', 'dataset', 'customer', 'Outliers', CASE WHEN 1 - x > 0.5 THEN 'high' WHEN 1 - x > 0.3 THEN 'warning' ELSE 'info' END FROM c WHERE col IS NULL AND x < 0.95
UNION ALL SELECT 'Outliers found in dataset ''customer'': ' || o::VARCHAR || '.', 'dataset', 'customer', 'Outliers', CASE WHEN t > 0.5 THEN 'high' WHEN t > 0.3 THEN 'warning' ELSE 'info' END
FROM (SELECT (SELECT CAST(sum(outliers) AS BIGINT) FROM c WHERE col IS NOT NULL) AS o, (SELECT sum(outliers) FROM c WHERE col IS NOT NULL) / (SELECT rows FROM c WHERE col IS NULL) AS t)"""


def outlier_zscore(spark, sf_dir):
    return outl.zscore_outliers(table(spark, sf_dir, "events"), "value").withColumn("normality", F.round("normality", 6))


SQL_OUTLIER_ZSCORE = """
SELECT 'value' AS "column", round(1 - outliers / rows, 6) AS normality, outliers, rows
FROM (SELECT count(*) FILTER (abs(value - mean) > 3 * sd) AS outliers, count(*) AS rows FROM events, (SELECT avg(value) AS mean, stddev_samp(value) AS sd FROM events))"""


def outlier_iqr(spark, sf_dir):
    return outl.iqr_fences(table(spark, sf_dir, "customer"), "c_acctbal").select(*(F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")))


SQL_OUTLIER_IQR = """
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5::DOUBLE * (q3 - q1), 4) AS low, round(q3 + 1.5::DOUBLE * (q3 - q1), 4) AS high
FROM (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)"""


def outlier_iqr_count(spark, sf_dir):
    return outl.iqr_outliers(table(spark, sf_dir, "events"), "value").withColumn("normality", F.round("normality", 6))


SQL_OUTLIER_IQR_COUNT = """
SELECT 'value' AS "column", round(1 - outliers / rows, 6) AS normality, outliers, rows
FROM (SELECT count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers, count(*) AS rows FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


def _ages(spark, sf_dir):
    years = tim.year_range(table(spark, sf_dir, "orders"), "o_orderdate")
    dates = tim.date_range(table(spark, sf_dir, "events"), "ts").unionByName(tim.date_range(table(spark, sf_dir, "lineitem"), "l_shipdate"))
    return tim.scored(tim.ages(years.unionByName(dates), AS_OF), tim.linear_decay(36_500))


def timeliness_ages(spark, sf_dir):
    return _ages(spark, sf_dir).select("column", "kind", "days_earliest", "days_latest", F.round("score", 6).alias("score"))


_AGES = f"""
SELECT col, kind, days_earliest, days_latest, greatest(least(1 - days_latest / 36500.0::DOUBLE, 1), 0) AS score, lo, hi FROM (
SELECT 'o_orderdate' AS col, 'year' AS kind, (2026 - year(min(o_orderdate))) * 365 AS days_earliest, (2026 - year(max(o_orderdate))) * 365 AS days_latest, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders
UNION ALL SELECT 'ts', 'date', CAST(floor((epoch_us({NOW}) - epoch_us(min(ts))) / 86400000000) AS BIGINT), CAST(floor((epoch_us({NOW}) - epoch_us(max(ts))) / 86400000000) AS BIGINT), min(ts), max(ts) FROM events
UNION ALL SELECT 'l_shipdate', 'date', CAST(floor((epoch_us({NOW}) - epoch_us(min(l_shipdate))) / 86400000000) AS BIGINT), CAST(floor((epoch_us({NOW}) - epoch_us(max(l_shipdate))) / 86400000000) AS BIGINT), min(l_shipdate), max(l_shipdate) FROM lineitem)"""
SQL_TIMELINESS_AGES = f'SELECT col AS "column", kind, days_earliest, days_latest, round(score, 6) AS score FROM ({_AGES})'


def timeliness_rows(spark, sf_dir):
    rows = tim.timeliness_metrics(_ages(spark, sf_dir), "sales", ["ts", "o_orderdate"])
    return rows.select("key", "value", F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"))


SQL_TIMELINESS_ROWS = f"""
WITH a AS ({_AGES})
SELECT unnest(['earliest_year', 'latest_year', 'days_since_earliest_year', 'days_since_latest_year', 'timeliness_score']) AS key, unnest([year(lo)::VARCHAR, year(hi)::VARCHAR, days_earliest::VARCHAR, days_latest::VARCHAR, {sql_text("round(score, 2)")}]) AS value, 'column' AS perimeter, col AS name FROM a WHERE kind = 'year'
UNION ALL SELECT unnest(['earliest_date', 'latest_date', 'days_since_earliest_date', 'days_since_latest_date', 'timeliness_score']), unnest([strftime(lo, '%Y-%m-%d'), strftime(hi, '%Y-%m-%d'), days_earliest::VARCHAR, days_latest::VARCHAR, {sql_text("round(score, 2)")}]), 'column', col FROM a WHERE kind = 'date'
UNION ALL SELECT 'score', {sql_text("round(avg(score), 2)")}, 'dataset', 'sales' FROM a WHERE col IN ('ts', 'o_orderdate')"""


def timeliness_score(spark, sf_dir):
    rows = tim.timeliness_metrics(_ages(spark, sf_dir), "sales", ["ts", "o_orderdate"])
    return rows.filter("key IN ('score', 'timeliness_score')").select("key", F.col("scope.value").alias("name"), "value_num")


SQL_TIMELINESS_SCORE = f"""
WITH a AS ({_AGES})
SELECT 'timeliness_score' AS key, col AS name, round(score, 2) AS value_num FROM a UNION ALL SELECT 'score', 'sales', round(avg(score), 2) FROM a WHERE col IN ('ts', 'o_orderdate')"""


def timeliness_advice(spark, sf_dir):
    rows = tim.timeliness_advice(_ages(spark, sf_dir), "sales")
    return rows.select("content", "type", "level", F.col("scope.value").alias("name"))


SQL_TIMELINESS_ADVICE = f"SELECT 'Nothing in column ''' || col || ''' is from the last 365 days.' AS content, 'Latest Date far in the past' AS type, 'high' AS level, col AS name FROM ({_AGES}) WHERE days_latest > 365"


def _advice(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.when(F.col("lang") == "en", dataset_scope(F.col("source"))).otherwise(column_scope(F.col("source"), "part"))
    return d.select("doc_id", F.col("lang").alias("content"), F.lit("Outliers").alias("type"), F.when(F.col("n_chars") > 2000, "high").otherwise("info").alias("level"), source.alias("scope"))


def recommendation_rescope(spark, sf_dir):
    rows = recs.rescope(_advice(spark, sf_dir), "corpus")
    return rows.select("doc_id", F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"), F.col("scope.parent_scope.value").alias("parent"))


SQL_RECOMMENDATION_RESCOPE = """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'dataset' ELSE 'column' END AS perimeter, CASE WHEN lang = 'en' THEN 'corpus' ELSE source END AS name, CASE WHEN lang = 'en' THEN NULL ELSE 'corpus' END AS parent FROM documents"""


def recommendation_dedupe(spark, sf_dir):
    return recs.first_of_each(recs.rescope(_advice(spark, sf_dir), "corpus"), "doc_id").select("doc_id", "content", "level", F.col("scope.value").alias("name"))


SQL_RECOMMENDATION_DEDUPE = """
SELECT doc_id, content, level, name FROM (SELECT *, row_number() OVER (PARTITION BY content, name ORDER BY doc_id) AS nth FROM
(SELECT doc_id, lang AS content, CASE WHEN n_chars > 2000 THEN 'high' ELSE 'info' END AS level, CASE WHEN lang = 'en' THEN 'corpus' ELSE source END AS name FROM documents)) WHERE nth = 1"""


def chunk_detect(spark, sf_dir):
    """Part names of one base, and of two."""
    r = table(spark, sf_dir, "nation")
    one = r.select(F.concat(F.lit("/data/"), F.col("n_regionkey"), F.lit("/file_nation_part_"), F.col("n_nationkey"), F.lit(".parquet")).alias("path"))
    two = r.select(F.concat(F.lit("/data/file_"), F.col("n_regionkey"), F.lit("_part_"), F.col("n_nationkey"), F.lit(".parquet")).alias("path"))
    return recs.one_base(one, "path").select(F.lit("one").alias("base"), "chunked").unionByName(recs.one_base(two, "path").select(F.lit("several").alias("base"), "chunked"))


SQL_CHUNK_DETECT = r"""
SELECT 'one' AS base, count(DISTINCT regexp_extract('/data/' || n_regionkey || '/file_nation_part_' || n_nationkey || '.parquet', '([^/]+)_part_\d+\.parquet$', 1)) = 1 AS chunked FROM nation
UNION ALL SELECT 'several', count(DISTINCT regexp_extract('/data/file_' || n_regionkey || '_part_' || n_nationkey || '.parquet', '([^/]+)_part_\d+\.parquet$', 1)) = 1 FROM nation"""


def levels(spark, sf_dir):
    """The three scales of severity over discounts and quantities."""
    text = F.concat(F.lit("about "), (F.col("l_quantity") * 2.5).cast("string"), F.lit("% of it"))
    rate = F.col("l_quantity") / 50
    rows = table(spark, sf_dir, "lineitem").select(s.level_of_text(text).alias("by_text"), s.level_of_rate(rate).alias("by_rate"), s.level_of_outliers(rate).alias("by_outliers"))
    return rows.groupBy("by_text", "by_rate", "by_outliers").agg(F.count(F.lit(1)).alias("n"))


SQL_LEVELS = """
SELECT CASE WHEN l_quantity * 2.5 > 70 AND l_quantity * 2.5 <= 90 THEN 'warning' WHEN l_quantity * 2.5 > 90 AND l_quantity * 2.5 <= 100 THEN 'high' ELSE 'info' END AS by_text,
  CASE WHEN l_quantity / 50 > 0.7 THEN 'high' WHEN l_quantity / 50 > 0.3 THEN 'warning' ELSE 'info' END AS by_rate, CASE WHEN l_quantity / 50 > 0.5 THEN 'high' WHEN l_quantity / 50 > 0.3 THEN 'warning' ELSE 'info' END AS by_outliers, count(*) AS n
FROM lineitem GROUP BY ALL"""


def slugs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("  "), F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(") "))
    return c.select("c_custkey", s.slug_ascii(name).alias("slug"))


SQL_SLUGS = "SELECT c_custkey, regexp_replace(lower(trim('  ' || c_name || ' (' || c_mktsegment || ') ')), '[^a-z0-9]+', '_', 'g') AS slug FROM customer"


def slugs_any(spark, sf_dir):
    """Slugs of text with accents, by source name and language."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit(" Été "), "lang", F.lit("/"), "source").alias("name")).distinct()
    return d.select("name", s.slug_text("name").alias("slug"))


SQL_SLUGS_ANY = "SELECT DISTINCT ' Été ' || lang || '/' || source AS name, regexp_replace(lower(trim(strip_accents(' Été ' || lang || '/' || source))), '[^a-z0-9]+', '_', 'g') AS slug FROM documents"


def subjects(spark, sf_dir):
    text = F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"), F.when(F.col("value") > 50, " has a high value").when(F.col("value") > 20, " is low").otherwise(" stays"))
    return table(spark, sf_dir, "events").select("event_id", s.subject(text).alias("subject"))


SQL_SUBJECTS = "SELECT event_id, CASE WHEN value > 20 THEN event_type || ' of ' || user_id ELSE '' END AS subject FROM events"


def rounded(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", s.round_text(F.col("o_totalprice"), 1).alias("price"), s.round_text(F.col("o_orderpriority")).alias("priority"))


SQL_ROUNDED = "SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.1f', round(o_totalprice, 1)), '0+$', ''), '\\.$', '') AS price, o_orderpriority AS priority FROM orders"


def flattened(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("Kind"), F.col("value").alias("Value")).alias("event"))
    return s.flatten_one(e)


SQL_FLATTENED = "SELECT event_id, event_type AS event_kind, value AS event_value FROM events"


LINEITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def part_numbers(spark, sf_dir):
    """All columns of a table, in an order with ties in its first columns."""
    rows = numbered(table(spark, sf_dir, "lineitem"), list(LINEITEM), 1000)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.sum("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


SQL_PART_NUMBERS = f"SELECT part, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last, CAST(sum(l_partkey) AS BIGINT) AS parts, round(CAST(sum(l_quantity) AS DOUBLE), 4) AS quantity FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY {', '.join(LINEITEM)}) - 1) / 1000) + 1 AS BIGINT) AS part FROM lineitem) GROUP BY part"


def parts_written(spark, sf_dir):
    """Parts of 1000 rows in the table's order, written and read back under their names."""
    path = folder(spark, "parts")
    write_parts(table(spark, sf_dir, "orders"), path, "File", "My orders", 1000)
    rows = spark.read.parquet(path).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.sum("o_custkey").alias("customers"))


SQL_PARTS_WRITTEN = "SELECT 'file_my_orders_part_' || CAST(part AS VARCHAR) || '.parquet' AS name, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(sum(o_custkey) AS BIGINT) AS customers FROM (SELECT *, CAST(floor((row_number() OVER () - 1) / 1000) + 1 AS BIGINT) AS part FROM orders) GROUP BY part"


def _written_as(spark, sf_dir, fmt, name):
    path = f"{folder(spark, 'source')}/{name}.{fmt}"
    df = table(spark, sf_dir, name)
    df = df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c, kind in df.dtypes))
    df.write.option("header", True).format(fmt).save(path)
    return path if "://" in path else f"file://{path}"


def source_csv(spark, sf_dir):
    return load(spark, {"type": "csv", "config": {"path": _written_as(spark, sf_dir, "csv", "customer")}})["file"].select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


SQL_SOURCE_CSV = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def source_json(spark, sf_dir):
    return load(spark, {"type": "json", "config": {"path": _written_as(spark, sf_dir, "json", "part")}}, job={"json_lines": True})["file"].select("p_partkey", "p_name", "p_size", "p_retailprice")


SQL_SOURCE_JSON = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def source_parquet(spark, sf_dir):
    return load(spark, {"type": "parquet", "config": {"path": _written_as(spark, sf_dir, "parquet", "supplier")}})["file"].select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


SQL_SOURCE_PARQUET = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _sqlite(spark, sf_dir) -> dict:
    """A database file of the two smallest tables, of 30 rows, reached by a connection string."""
    import os
    import sqlite3
    from urllib.parse import urlsplit

    path = urlsplit(f"{folder(spark, 'database')}.db").path
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        for name, columns in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))):
            db.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", [tuple(r) for r in table(spark, sf_dir, name).select(*columns).collect()])
    return {"type": "sqlite", "config": {"connection_string": f"sqlite:///{path}"}}


def source_table(spark, sf_dir):
    return load(spark, _sqlite(spark, sf_dir), "nation")["nation"]


SQL_SOURCE_TABLE = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def source_statement(spark, sf_dir):
    return load(spark, _sqlite(spark, sf_dir), "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")["query"]


SQL_SOURCE_STATEMENT = "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def _sizes(frames):
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).cast("bigint").alias("columns"), "n") for name, df in frames.items()])


def source_tables(spark, sf_dir):
    return _sizes(load(spark, _sqlite(spark, sf_dir), ["region", "nation"]))


def source_database(spark, sf_dir):
    return _sizes(load(spark, _sqlite(spark, sf_dir), "*"))


SQL_SOURCE_TABLES = SQL_SOURCE_DATABASE = "SELECT 'nation' AS name, 3::BIGINT AS columns, count(*) AS n FROM nation UNION ALL SELECT 'region', 2, count(*) FROM region"


def slug_names(spark, sf_dir):
    """Columns renamed to slugs, and their old names."""
    df, old = s.slug_columns(table(spark, sf_dir, "nation").select(F.col("n_name").alias(" Näme (of it)"), F.col("n_nationkey").alias("Key/1")))
    return df.withColumn("old", F.lit(",".join(f"{k}={v}" for k, v in old.items())))


SQL_SLUG_NAMES = "SELECT n_name AS name_of_it_, n_nationkey AS key_1, 'name_of_it_= Näme (of it),key_1=Key/1' AS old FROM nation"


def session_metrics(spark, sf_dir):
    """A check from its configuration to its JSON file, read back: values in their own types."""
    from urllib.parse import urlsplit

    check = Check(spark, {}, {"type": "csv", "config": {"path": _written_as(spark, sf_dir, "csv", "supplier")}}, {})
    counts = comp.merge_counts(comp.partial_counts(check.load("source")["file"].select("s_suppkey", "s_nationkey")))
    check.add("metrics", comp.completeness_metrics(counts, "supplier"))
    path = check.save(urlsplit(folder(spark, "results")).path)[0]
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(f"file://{path}")
    return rows.select("key", F.col("value").alias("value"), F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"), F.col("scope.parent_scope.value").alias("parent"))


SQL_SESSION_METRICS = """
SELECT unnest(['n', 'n_var', 'n_cells_missing', 'p_cells_missing', 'score']) AS key, unnest([CAST(n AS VARCHAR), '2', '0', '0.0', '1.0']) AS value, 'dataset' AS perimeter, 'supplier' AS name, CAST(NULL AS VARCHAR) AS parent FROM (SELECT count(*) AS n FROM supplier)
UNION ALL SELECT 'completeness_score', '1.0', 'column', unnest(['s_suppkey', 's_nationkey']), 'supplier'"""


def normalised(spark, sf_dir):
    """Bytes and numeric text brought to their types."""
    from granary.plans.types import normalise

    p = table(spark, sf_dir, "part")
    return normalise(p.select("p_partkey", F.col("p_name").cast("binary").alias("name"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size"), F.col("p_retailprice").cast("string").alias("price")))


SQL_NORMALISED = "SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part"


def json_values(spark, sf_dir):
    """Metric rows through the JSON sink's records, read back as text."""
    from urllib.parse import urlsplit

    rows = comp.completeness_metrics(comp.merge_counts(comp.partial_counts(events_with_gaps(spark, sf_dir))), "events")
    path = save_json(rows, "metrics", urlsplit(folder(spark, "json")).path)
    back = spark.read.option("multiLine", True).option("primitivesAsString", True).json(f"file://{path}")
    return back.select("key", "value", F.col("scope.perimeter").alias("perimeter"), F.col("scope.value").alias("name"), F.col("scope.parent_scope.value").alias("parent"))


SQL_JSON_VALUES = f"SELECT key, value, perimeter, name, parent FROM ({SQL_COMPLETENESS_ROWS})"

NAMES = (
    "completeness_columns", "completeness_dataset", "completeness_parts", "completeness_rows", "schema_rows",
    "duplicates_score", "duplicate_keys", "duplicate_keys_with_gaps", "duplicates_rows",
    "outlier_merge", "outlier_rows", "outlier_advice", "outlier_zscore", "outlier_iqr", "outlier_iqr_count",
    "timeliness_ages", "timeliness_rows", "timeliness_score", "timeliness_advice",
    "recommendation_rescope", "recommendation_dedupe", "chunk_detect", "levels",
    "slugs", "slugs_any", "subjects", "rounded", "flattened", "part_numbers", "normalised", "json_values",
    "parts_written", "source_csv", "source_json", "source_parquet", "source_table", "source_statement", "source_tables", "source_database", "slug_names", "session_metrics",
)
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"SQL_{n.upper()}"] for n in NAMES}
