"""Secret scan with an incremental blob ledger (operator 9, DataFrame functions only).

Every version of a file is addressed by its content (SHA-256).  The ledger, a
folder with two Parquet tables, remembers which (blob, rule, rule version) were
scanned and what was found; a run scans only pairs the ledger has not seen,
once for each distinct blob, appends to the ledger and joins findings back to
all paths that hold the blob.  Only DataFrame functions run; texts are matched
by the JVM's regular expressions.

Offsets come from cutting a text at its matches: the pieces between matches and
the matches themselves alternate, so a running sum of their lengths (in code
points) gives every start.

Cases: null content is the empty text; an empty text or table has no findings;
repeated paths stay repeated; a null path is kept; very long texts are scanned
whole; extra columns are ignored, and kept by ``redact`` whatever their names;
overlapping findings of different kinds are all kept.  Spans are reported by start, then kind as listed
in ``RULES``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.shared import documents_of, free_name, materialise, release, scratch, write_table


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    measured_group: int  # the group whose length decides
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The rules of the base scan.  Runs of one character class are taken
# whole by a greedy match, so their minimum length stands in the pattern itself.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

#: Kinds beside the base ones: tokens and keys with a shape of their own.
MORE_RULES = (
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _lengths(text: Column, rule: Rule) -> Column:
    """For every match: code points before it since the last match, of it, and of the measured group."""
    pattern = F.lit(rule.pattern)
    size = lambda c: F.transform(c, lambda x: F.length(x).cast("bigint"))
    return F.arrays_zip(
        F.slice(size(F.split(text, rule.pattern, -1)), F.lit(1), F.size(F.regexp_extract_all(text, pattern, F.lit(0)))).alias("gap"),
        size(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        size(F.regexp_extract_all(text, pattern, F.lit(rule.measured_group))).alias("measure"),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of distinct blobs: (blob, rule, kind, start, end).

    ``blobs`` has blob, content and done (keys of the rules already scanned).
    """
    tests = [F.when(~F.array_contains("done", r.key) & F.col("content").rlike(r.pattern), F.lit(k)) for k, r in enumerate(rules)]
    hits = blobs.withColumn("hits", F.filter(F.array(*tests), lambda x: x.isNotNull())).where(F.size("hits") > 0)
    hits = hits.select("blob", "content", F.explode("hits").alias("k"))
    parts = F.lit(None)
    for k, r in enumerate(rules):
        parts = F.when(F.col("k") == k, _lengths(F.col("content"), r)).otherwise(parts)
    each = hits.select("blob", "k", F.posexplode(parts).alias("i", "m")).select("blob", "k", "i", "m.*")
    before = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keys = F.array(*[F.lit(r.key) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    return (
        each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
        .where(F.col("measure") >= F.get(least, F.col("k")))
        .select("blob", F.get(keys, F.col("k")).alias("rule"), F.get(kinds, F.col("k")).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen; returns (paths, findings).

    ``versions`` has path and content.  paths: (path, blob), a row for each version;
    findings: (blob, rule, kind, start, end) of these versions' blobs under the given
    rules, from the ledger.  Of the ledger's history only blobs of these versions are
    sorted or joined; the two tables themselves are read through.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("content"), F.lit(""))
    addressed = versions.select("path", text.alias("content"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = materialise(addressed.select("path", "blob"), "paths")
    here = paths.select("blob").distinct()
    blobs = addressed.groupBy("blob").agg(F.first("content").alias("content"))
    wanted = [r.key for r in rules]
    nothing = F.array().cast("array<string>")
    if _exists(spark, f"{ledger}/scanned"):
        seen = spark.read.parquet(f"{ledger}/scanned").where(F.col("rule").isin(wanted)).join(here, "blob", "left_semi")
        seen = materialise(seen.groupBy("blob").agg(F.collect_set("rule").alias("done")), "seen")
        blobs = blobs.join(seen, "blob", "left").withColumn("done", F.coalesce("done", nothing)).where(F.size("done") < len(set(wanted)))
        new = here.join(seen, "blob", "left").withColumn("done", F.coalesce("done", nothing))
    else:
        seen = None
        blobs, new = blobs.withColumn("done", nothing), here.withColumn("done", nothing)
    pending = F.array_except(F.array(*[F.lit(k) for k in wanted]), F.col("done"))
    write_table(scan_blobs(blobs, rules), f"{ledger}/findings", "append")
    # findings first: a run that stops here scans these pairs again and the repeats fall to distinct()
    write_table(new.select("blob", F.explode(pending).alias("rule")), f"{ledger}/scanned", "append")
    if seen is not None:
        release(seen)
    findings = spark.read.parquet(f"{ledger}/findings").where(F.col("rule").isin(wanted)).join(here, "blob", "left_semi").distinct()
    return paths, findings


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, more: tuple[Rule, ...] = ()) -> DataFrame:
    """A row for each path: findings of each of ``rules`` by number and spans as text (base_spans), and all spans, those of ``more`` too."""
    order = F.create_map(*[x for k, r in enumerate((*rules, *more)) for x in (F.lit(r.kind), F.lit(k))])
    spans = F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), F.col("kind"), "end")))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules]
    by_blob = findings.groupBy("blob").agg(*counts, spans.alias("every"))
    by_blob = by_blob.withColumns({"spans": text(F.col("every")), "base_spans": text(F.filter("every", lambda s: s["k"] < len(rules)))})
    out = paths.join(by_blob, "blob", "left")
    none = {f"n_{r.kind}": 0 for r in rules} | {"spans": "", "base_spans": ""}
    return out.fillna(none).select("path", *[f"n_{r.kind}" for r in rules], "base_spans", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the base rules, then all rules, which scans the blobs for the added ones only."""
    docs = documents_of(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = scratch(spark, "ledger")
    release(scan(docs, ledger)[0])
    paths, findings = scan(docs, ledger, RULES + MORE_RULES)
    found = report(paths, findings, RULES, MORE_RULES)
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


#: The same rows by DuckDB: pieces between matches and matches alternate.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
cut AS (
  SELECT r, 0 AS k, 'assign' AS kind, 6 AS least, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
    regexp_split_to_array(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS p FROM d
  UNION ALL
  SELECT r, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT r, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_split_to_array(t, '[0-9a-f]+') FROM d
  UNION ALL
  SELECT r, x.k, x.kind, 0, regexp_extract_all(t, x.p, 0), regexp_extract_all(t, x.p, 0), regexp_split_to_array(t, x.p) FROM d, (VALUES (3, 'forge', 'gh[pousr]_[A-Za-z0-9]{36,}'),
    (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), (5, 'pem', '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----')) x(k, kind, p)),
each AS (
  SELECT r, k, kind, least, i, length(m[i]) AS size, length(g[i]) AS measure, length(p[i]) AS gap
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM each),
found AS (SELECT r, k, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE measure >= least),
by_doc AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (r)
"""


#: What stands in a text where a secret was.
PLACEHOLDER = "[REDACTED]"


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every finding in ``text`` replaced by a placeholder; overlapping findings by one."""
    paths, findings = scan(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), ledger, rules)
    blob, spans = free_name(docs, "_blob"), free_name(docs, "_spans")
    by_blob = materialise(findings.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans)), "secret-spans")
    release(paths)
    addressed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    joined = addressed.join(by_blob, blob, "left")
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(PLACEHOLDER))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"),
        )

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return joined.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(cut)).select(*docs.columns)
