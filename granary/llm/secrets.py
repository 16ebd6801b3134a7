"""Secret scan with an incremental ledger of content-addressed blobs.

Every text is a blob named by its SHA-256. The ledger records which (blob, rule version) pairs
were scanned and what was found; a run scans only pairs that it lacks, once for each blob
however many rows hold it, and joins the ledger's findings back to all rows. Built from
DataFrame functions only.

Positions: Spark's regular expressions give matches but no offsets. ``split`` by the same
pattern gives the gaps between matches, so that lengths of gaps and matches, added up in turn,
are the offsets, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import scratch_path

SPAN = "array<struct<start:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and non-overlapping; those with ``group`` shorter than ``least`` are dropped.

    ``hint``: a cheap condition that holds for every text with a span. ``version`` goes up with any change of the rule.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the order in which kinds are listed. The first three are the base kinds.
RULES = (
    Rule("assign", 1, ASSIGN, 2, 8, ASSIGN[:-2] + "{8})"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY"),
)
BASE = ("assign", "access", "hex")


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in ``text``: array of (start, kind, end), in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    # Only runs of the least length can pass where the whole match is counted and a match is a maximal run.
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.kind in ("hex", "access"):
        fixed = 4 if rule.kind == "access" else 0
        pattern = F.lit(f"{rule.pattern[:-1]}{{{rule.least - fixed},}}")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(F.transform(whole, F.length), F.transform(part, F.length), lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.element_at(gaps, acc["i"] + 1)
        span = F.array(F.struct(at.alias("start"), F.lit(rule.kind).alias("kind"), (at + m["w"]).alias("end")))
        out = F.when(m["p"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct((at + m["w"]).alias("at"), (acc["i"] + 1).alias("i"), out.cast(SPAN).alias("out"))

    return F.when(text.rlike(rule.hint), F.aggregate(both, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def scan_ledger(df: DataFrame, ledger: str | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``blob`` (hex SHA-256 of the text) and ``found`` (its spans by start, then kind as listed).

    ``ledger``: a folder of Parquet part tables with the columns blob, rules (keys of the rule
    versions scanned) and found; made where it does not exist, then appended to. Rows whose
    pairs are all in it are not scanned again. Findings of superseded rule versions stay in
    the ledger and are left out of the result.

    A null text counts as empty. Equal texts in any number of rows are one blob, scanned once.
    An empty table gives an empty result. Columns of ``df`` named blob or found are replaced.
    """
    spark = df.sparkSession
    df = df.drop(*(c for c in df.columns if c.lower() in ("blob", "found") and c != text))
    ledger = ledger or scratch_path(spark, "ledger")
    schema = "blob binary, rules array<string>, found array<struct<start:int,kind:string,end:int,rule:string>>"
    p = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.unhex(F.sha2(body.cast("binary"), 256))
    keys = F.array(*(F.lit(r.key) for r in rules))
    texts = df.select(blob.alias("blob"), body.alias("body")).dropDuplicates(["blob"])
    if known:
        done = spark.read.schema(schema).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        texts = texts.join(done, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
        texts = texts.filter(F.size("todo") > 0)
    else:
        texts = texts.withColumn("todo", keys)

    def found(rule: Rule) -> Column:
        tagged = F.transform(spans_of(F.col("body"), rule), lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(rule.key).alias("rule")))
        return F.when(F.array_contains("todo", rule.key), tagged) if known else tagged

    none = F.array().cast("array<struct<start:int,kind:string,end:int,rule:string>>")
    scanned = texts.select("blob", F.col("todo").alias("rules"), F.concat(*(F.coalesce(found(r), none) for r in rules)).alias("found"))
    scanned.write.mode("append").parquet(ledger)

    hits = spark.read.schema(schema).parquet(ledger).filter(F.size("found") > 0).select("blob", F.explode("found").alias("f"))
    hits = hits.filter(F.col("f.rule").isin([r.key for r in rules]))
    listed = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("f.kind")).cast("int")
    span = F.struct(F.col("f.start").alias("start"), listed.alias("listed"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"))
    # One blob's spans, not one key's rows: bounded by the length of a text.
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("found"))
    empty = F.array().cast("array<struct<start:int,listed:int,end:int,kind:string>>")
    out = df.withColumn("blob", blob).join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))
    return out.withColumn("blob", F.lower(F.hex("blob")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned through a fresh ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan_ledger(docs)

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *(n(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _duck_spans(rule: Rule) -> str:
    pattern, hint = rule.pattern.replace("'", "''"), rule.hint.replace("'", "''")
    return f"""
  SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{
      's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0),
      'n': length(w[i]), 'p': length(p[i])}})) AS m, '{rule.kind}' AS kind, {[r.kind for r in RULES].index(rule.kind)} AS listed, {rule.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS p, string_split_regex(t, '{pattern}') AS g
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{hint}'))"""


ORACLE = f"""
WITH found AS ({" UNION ALL ".join(_duck_spans(r) for r in RULES)}),
spans AS (SELECT DISTINCT doc_id, kind, listed, CAST(m.s AS BIGINT) AS s, CAST(m.s + m.n AS BIGINT) AS e FROM found WHERE m.p >= least),
per AS (SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, listed) FILTER (kind IN {BASE}), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, listed) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""
