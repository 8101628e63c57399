"""Pattern scans over job code: operations, legacy calls, paths, embedded SQL, verdicts.

Rules are alternatives in a projection, per line where the line matters; the code text
is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.paths import PATH_CREDENTIAL
from carryover.operators.typemap import level_name

# operation, class, pattern within a line (fixed values)
CODE_OPS = [
    ("select", "transformation", r"\.select\("), ("filter", "transformation", r"\.filter\("), ("where", "transformation", r"\.where\("),
    ("withcolumn", "transformation", r"\.withColumn\("), ("drop", "transformation", r"\.drop\("), ("rename", "transformation", r"\.rename\("),
    ("distinct", "transformation", r"\.distinct\("), ("limit", "transformation", r"\.limit\("), ("orderby", "transformation", r"\.orderBy\("),
    ("sort", "transformation", r"\.sort\("), ("groupby", "aggregation", r"\.groupBy\("), ("agg", "aggregation", r"\.agg\("),
    ("window", "aggregation", r"\.window\("), ("over", "aggregation", r"\.over\("), ("join", "join", r"\.join\("), ("union", "join", r"\.union\("),
    ("intersect", "join", r"\.intersect\("), ("write", "sink", r"\.write\."), ("saveastable", "sink", r"\.saveAsTable\("),
    ("read", "ingestion", r"spark\.read\."),
    ("readstream", "streaming", r"readStream"), ("writestream", "streaming", r"writeStream"), ("trigger", "streaming", r"trigger"),
    ("checkpointlocation", "streaming", r"checkpointLocation"),
    ("conf_set", "configuration", r"spark\.conf\.set\("), ("conf_get", "configuration", r"spark\.conf\.get\("), ("config", "configuration", r"spark\.config\("),
    ("udf_definition", "udf", r"@(pandas_)?udf\("), ("udf_register", "udf", r"(?<!@)(?<!@pandas_)\budf\(|register\(.*?udf"),
]
# legacy calls (fixed values)
RDD_OPS = [
    ("rdd", r"\.rdd\b"), ("sparkContext", r"sparkContext\."), ("map", r"\.map\("), ("flatMap", r"\.flatMap\("), ("mapPartitions", r"\.mapPartitions\("),
    ("reduce", r"\.reduce\("), ("fold", r"\.fold\("), ("aggregate", r"\.aggregate\("), ("collect", r"\.collect\("), ("take", r"\.take\("),
    ("first", r"\.first\("), ("saveAsTextFile", r"\.saveAsTextFile\("), ("saveAsSequenceFile", r"\.saveAsSequenceFile\("),
]
STORAGE_PATH = r"""((?:gs|hdfs|wasbs?|abfss?|s3a?)://[^\s"']*)"""
SQL_CALL = r"""(?s)spark\.sql\(\s*([^)]+)\)"""
EMBEDDED_SQL = r'''(?s)spark\.sql\(\s*(?:"""(.*?)"""|\'\'\'(.*?)\'\'\'|"([^"]*?)"|\'([^\']*?)\')\s*\)'''


def line_hits(df: DataFrame, key: str, code: str, rules: list[tuple]) -> DataFrame:
    """(key, op[, class], lines): number of lines each rule hits. Lines are counted inside
    the row by filtering the line array, so the code is never exploded."""
    lines = F.split(F.col(code), "\n")
    hit = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    if len(rules[0]) == 3:
        found = [F.struct(F.lit(n).alias("op"), F.lit(c).alias("class"), hit(p).alias("lines")) for n, c, p in rules]
    else:
        found = [F.struct(F.lit(n).alias("op"), hit(p).alias("lines")) for n, p in rules]
    return df.select(key, F.explode(F.filter(F.array(*found), lambda x: x["lines"] > 0)).alias("h")).select(key, "h.*")


def storage_paths(code: Column) -> Column:
    found = F.regexp_extract_all(code, F.lit(STORAGE_PATH), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.rtrim(p, F.lit(",)")))))


def dynamic_calls(code: Column) -> Column:
    """Arguments of ``spark.sql`` calls whose text is not a plain literal."""
    args = F.transform(F.regexp_extract_all(code, F.lit(SQL_CALL), F.lit(1)), F.trim)
    literal = lambda a: a.rlike(r"""^[rRuU]?("|')""")
    return F.filter(args, lambda a: a.contains('f"') | a.contains("f'") | a.contains(".format(") | ~literal(a)
                    | a.rlike(r"""["']\s*[+%]|[+%]\s*["']"""))


def embedded_sql(code: Column) -> Column:
    """Distinct literals inside ``spark.sql(..)``, triple-quoted ones first in the pattern."""
    groups = [F.regexp_extract_all(code, F.lit(EMBEDDED_SQL), F.lit(i)) for i in (1, 2, 3, 4)]
    # a lambda: ``trim`` itself would take the position as the characters to cut off
    texts = F.transform(F.flatten(F.array(*groups)), lambda s: F.trim(s))
    return F.array_sort(F.array_distinct(F.filter(texts, lambda s: s != "")))


def undefined_frames(code: Column) -> Column:
    used = F.regexp_extract_all(code, F.lit(r"\b(df_\w+)\b"), F.lit(1))
    made = F.regexp_extract_all(code, F.lit(r"(?m)\b(df_\w+)\s*=(?!=)"), F.lit(1))
    return F.array_sort(F.array_except(used, made))


def io_formats(code: Column) -> tuple[Column, Column]:
    """Formats read and written, by ``format(..)`` or by method, across line continuations."""
    flat = F.regexp_replace(code, r"\s*\\?\s*\n\s*", "")
    names = ["option", "options", "mode", "partitionBy", "format", "load", "save", "schema", "bucketBy", "sortBy", "insertInto"]
    skip = F.array(*[F.lit(n) for n in names])

    def of(start):
        call = F.regexp_extract_all(flat, F.lit(start + r"""((?:\.\w+\([^()]*\))*)"""), F.lit(1))
        fmt = F.flatten(F.transform(call, lambda c: F.regexp_extract_all(c, F.lit(r"""\.format\(\s*["']([^"']+)["']"""), F.lit(1))))
        method = F.flatten(F.transform(call, lambda c: F.filter(F.regexp_extract_all(c, F.lit(r"\.(\w+)\("), F.lit(1)), lambda m: ~F.array_contains(skip, m))))
        return F.array_sort(F.array_distinct(F.concat(fmt, method)))

    return of(r"spark\.read"), of(r"\.write")


# review reasons of a job (fixed values): dynamic_sql, language, rdd, storage_paths, streaming, udf, source_code_missing, runtime_version_missing
def job_facts(df: DataFrame, code: str, language: str) -> DataFrame:
    """One row per job with everything its verdict and review reasons need."""
    c, lang = F.coalesce(F.col(code), F.lit("")), F.lower(F.coalesce(F.col(language), F.lit("")))
    rdd = "|".join(p for _, p in RDD_OPS)
    return df.withColumns({
        "_empty": F.trim(c) == "", "_lang": F.when(lang.contains("scala"), "scala").when(lang.contains("py"), "python").otherwise("other"),
        "_dynamic": F.size(dynamic_calls(c)) > 0, "_rdd": c.rlike(rdd), "_udf": c.rlike(r"@(pandas_)?udf\(|\budf\("),
        "_streaming": c.rlike("readStream|writeStream|trigger|checkpointLocation"), "_paths": F.size(storage_paths(c)) > 0,
        "_leak": c.rlike(PATH_CREDENTIAL)})


def code_verdict(df: DataFrame, code: str, language: str) -> DataFrame:
    """Level per job: the worst of its language and every hit, with tagged review steps."""
    d = job_facts(df, code, language)
    scala = F.col("_lang") == "scala"
    rank = F.greatest(
        F.when(F.col("_lang") == "python", 0).when(scala, 1).otherwise(3), F.when(F.col("_dynamic") | F.col("_streaming"), 1).otherwise(0),
        F.when(F.col("_udf") & scala, 2).when(F.col("_udf"), 1).otherwise(0), F.when(F.col("_leak") | F.col("_rdd"), 2).otherwise(0))
    rank = F.when(F.col("_empty"), 0).otherwise(rank)
    steps = F.array_compact(F.array(
        F.when(F.col("_leak"), "high:remove credentials from paths"), F.when(F.col("_rdd"), "high:rewrite legacy calls"),
        F.when(F.col("_dynamic"), "high:review dynamic sql"), F.when(F.col("_udf"), "medium:test functions"),
        F.when(F.col("_streaming"), "medium:carry checkpoints over"), F.when(F.col("_paths"), "low:map storage paths")))
    return d.select(*df.columns, level_name(rank).alias("verdict"), F.array_join(steps, ",").alias("steps"))


def job_reasons(df: DataFrame, code: str, language: str, runtime: str) -> DataFrame:
    d = job_facts(df, code, language)
    has = ~F.col("_empty")
    reasons = F.array_compact(F.array(
        F.when(has & F.col("_dynamic"), "dynamic_sql"), F.when(has & (F.col("_lang") != "python"), "language"), F.when(has & F.col("_rdd"), "rdd"),
        F.when(F.coalesce(F.col(runtime), F.lit("")) == "", "runtime_version_missing"), F.when(F.col("_empty"), "source_code_missing"),
        F.when(has & F.col("_paths"), "storage_paths"), F.when(has & F.col("_streaming"), "streaming"), F.when(has & F.col("_udf"), "udf")))
    rewrites = F.when(has & F.col("_paths"), F.size(storage_paths(F.col(code)))).otherwise(0)
    return d.select(*df.columns, F.array_join(reasons, ",").alias("reasons"), rewrites.cast("long").alias("rewrites"))
