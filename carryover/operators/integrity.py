"""Manifests of files and tables, and the review ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carryover.functions.canonical import md5_slice, row_digest_sql
from carryover.operators.windows import keyed_window
from carryover.session import settle


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """sha256 and size of every file below a folder; each file is hashed where it is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.select(F.regexp_replace("path", r"^\w+:/*" + root.split("://")[-1].strip("/") + "/", "").alias("path"),
                    F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One hash over all entries, independent of their order and free of any collected list."""
    line = F.concat_ws("|", "path", "sha256", F.col("size").cast("string"))
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.sum(md5_slice(line).cast("decimal(28,0)")).alias("_d")).select(
        "files", F.sha2(F.concat_ws("|", F.col("files").cast("string"), F.col("_d").cast("string")), 256).alias("manifest_sha256"))


def verify_files(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries that are malformed, escape the root, are missing or changed."""
    a = actual.select("path", F.col("sha256").alias("_a"))
    j = recorded.join(a, "path", "left")
    bad = F.coalesce(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(True))
    problem = (F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "escaping").when(bad, "malformed").when(F.col("_a").isNull(), "missing")
               .when(F.col("_a") != F.col("sha256"), "changed"))
    return j.withColumn("problem", problem).where("problem is not null").select("path", "problem")


def table_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Order-free digest and row count per table: one aggregate over each."""
    out = None
    for name, df in sorted(tables.items()):
        d = df.selectExpr(f"'{name}' as table", "count(1) as rows", f"cast(coalesce({row_digest_sql(df.schema)}, 0) as string) as digest")
        out = d if out is None else out.unionByName(d)
    return out


def verify_tables(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    j = recorded.select("table", F.struct("rows", "digest").alias("_r")).join(actual.select("table", F.struct("rows", "digest").alias("_a")), "table", "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_r").isNull(), "unexpected").when(F.col("_a") == F.col("_r"), "passed").otherwise("changed")
    return j.select("table", status.alias("status"))


#: Entries of a thread that one task may sort and replay; longer threads are spread.
LONG_THREAD = 100_000


def ledger_sequence(entries: DataFrame) -> DataFrame:
    """Replay of review verdicts per (slice, reviewer) thread in round order.

    Columns: slice, reviewer, round, owner, verdict, seq (order of arrival). A verdict that
    breaks the sequence is not appended, so later ones are judged without it. That makes
    the accepted ones of a thread: the first entry of round 1, then for each next round the
    first entry with the same owner, as long as no round is missing and every earlier one
    asked for changes. Both conditions are running counts: over one sort of the threads, and
    for threads of over ``LONG_THREAD`` entries over segments of them, so that none is replayed
    in one place.
    """
    keys = ["slice", "reviewer"]
    long = settle(entries.groupBy(*keys).count().where(F.col("count") > LONG_THREAD).select(*keys), "threads")
    if long.isEmpty():
        return _replay(entries)
    same = [entries[k].eqNullSafe(long[k]) for k in keys]
    return _replay(entries.join(long, same, "left_anti")).unionByName(_replay_spread(entries.join(long, same, "left_semi")))


def _replay(entries: DataFrame) -> DataFrame:
    """``ledger_sequence`` by windows over whole threads: one shuffle and one sort."""
    thread = Window.partitionBy("slice", "reviewer").orderBy("round", "seq")
    so_far, before = thread.rowsBetween(Window.unboundedPreceding, 0), thread.rowsBetween(Window.unboundedPreceding, -1)
    in_round = Window.partitionBy("slice", "reviewer", "round").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    d = entries.withColumn("_first", F.first(F.when(F.col("round") == 1, F.struct("owner")), ignorenulls=True).over(so_far))
    d = d.withColumn("_fits", F.coalesce(F.when(F.col("round") == 1, F.lit(True)).otherwise((F.col("round") > 1) & (F.col("owner") == F.col("_first.owner"))), F.lit(False)))
    d = d.withColumn("_next", F.col("_fits") & (count(F.col("_fits"), in_round) == 0))
    ends = F.coalesce(F.col("verdict") != "changes_requested", F.lit(False))
    d = d.withColumn("_taken", F.col("_next") & (count(F.col("_next"), so_far) == F.col("round")) & (count(F.col("_next") & ends, before) == 0))
    d = d.withColumns({"_before": count(F.col("_taken"), before), "_ended": count(F.col("_taken") & ends, before)})
    reason = (F.when(F.col("_taken"), "accepted").when(F.col("_before") == 0, "first verdict must be round 1").when(F.col("_ended") > 0, "thread already closed")
              .when(F.col("round") != F.col("_before") + 1, "unexpected round").otherwise("owner changed"))
    return d.select(*entries.columns, reason.alias("outcome"))


def _replay_spread(entries: DataFrame) -> DataFrame:
    """``ledger_sequence`` over segments: entries are folded to one a round before they are counted."""
    keys = ["slice", "reviewer"]
    first = entries.where("round = 1").groupBy(*keys).agg(F.min_by(F.struct("owner", "seq"), F.struct("seq", "owner")).alias("_f"))
    d = settle(entries.join(first, keys, "left"), "entries")
    own = d.where(F.when(F.col("round") == 1, F.col("seq") == F.col("_f.seq")).otherwise(F.col("owner") == F.col("_f.owner")) & (F.col("round") >= 1))
    cand = own.groupBy(*keys, "round").agg(F.min_by(F.struct("seq", "verdict"), F.struct("seq")).alias("_c"))
    cand = cand.select(*keys, "round", F.col("_c.seq").alias("_seq"), F.col("_c.verdict").alias("_v"),
                       F.when(F.col("_c.verdict") != "changes_requested", 1).otherwise(0).alias("_closed"))
    run = keyed_window(cand, keys, ["round"], row_number="_rn", running_sum={"_sum": "_closed"})
    chain = settle(run.where((F.col("_rn") == F.col("round")) & (F.col("_sum") - F.col("_closed") == 0)), "chain")
    length = chain.groupBy(*keys).agg(F.max("round").alias("_len"), F.max("_closed").alias("_end"))
    j = d.join(chain.select(*keys, "round", F.col("_seq")), [*keys, "round"], "left").join(length, keys, "left")
    accepted = F.coalesce(F.col("seq") == F.col("_seq"), F.lit(False))
    # Verdicts accepted before this one: earlier rounds, and its own round when it came later.
    before = F.least(F.coalesce("_len", F.lit(0)), F.when(F.col("_seq") < F.col("seq"), F.col("round")).otherwise(F.col("round") - 1))
    before = F.greatest(before, F.lit(0))
    reason = (F.when(accepted, "accepted").when(before == 0, "first verdict must be round 1")
              .when((before == F.col("_len")) & (F.col("_end") == 1), "thread already closed")
              .when(F.col("round") != before + 1, "unexpected round").otherwise("owner changed"))
    return j.select(*entries.columns, reason.alias("outcome"))


def ledger_recurring(findings: DataFrame, threshold: int = 2) -> DataFrame:
    """Blocking codes and failure modes seen on several slices. Columns: slice, code,
    blocking, failure_mode."""
    d = findings.where("blocking").select("slice", F.explode(F.array_compact(F.array(
        F.col("code"), F.when(F.col("failure_mode").isNotNull(), F.concat(F.lit("failure_mode:"), "failure_mode"))))).alias("key"))
    return d.groupBy("key").agg(F.count_distinct("slice").alias("slices")).where(F.col("slices") >= threshold)


def verdict_violations(v: DataFrame) -> DataFrame:
    """All schema violations of verdict records with their path (verdict_id, path, rule)."""
    text = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = [
        ("$.schema_version", "must be 1.0", F.coalesce(F.col("schema_version") != "1.0", F.lit(True))), ("$.slice", "missing", text("slice")),
        ("$.reviewer", "missing", text("reviewer")), ("$.owner", "missing", text("owner")), ("$.round", "below 1", F.coalesce(F.col("round") < 1, F.lit(True))),
        ("$.verdict", "must be one of accepted, changes_requested, escalate", ~F.coalesce(F.col("verdict").isin("accepted", "changes_requested", "escalate"), F.lit(False))),
        ("$.findings", "no blocking finding behind changes_requested",
         (F.col("verdict") == "changes_requested") & ~F.coalesce(F.exists("findings", lambda f: F.coalesce(f["blocking"], F.lit(False))), F.lit(False))),
        ("$.findings", "accepted with a blocking finding", (F.col("verdict") == "accepted") & F.coalesce(F.exists("findings", lambda f: F.coalesce(f["blocking"], F.lit(False))), F.lit(False))),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"))) for p, r, c in rules]))
    return v.select("verdict_id", F.explode(hits).alias("h")).select("verdict_id", "h.path", "h.rule")


def check_files(spark: SparkSession, root: str, required: dict[str, list[str]]) -> DataFrame:
    """One status row per json, ipynb, sql or kql file below a folder, read whole.

    ``required`` maps a path pattern to the fields a matching JSON file must have. A file
    that does not parse is a failed row.
    """
    from carryover.operators.secrets import credential_counts
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,ipynb,sql,kql}").select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    ext = F.element_at(F.split("file", r"\."), -1)
    obj = F.try_parse_json("text").isNotNull() & F.ltrim("text").startswith("{")
    fields = F.coalesce(F.map_keys(F.from_json("text", "map<string,string>")), F.array().cast("array<string>"))
    rules = [("ipynb$", ["cells"]), *required.items()]
    missing = [F.when(obj & F.col("file").rlike(p) & ~F.array_contains(fields, f), f"missing:{f}") for p, fs in rules for f in fs]
    leaks = F.transform(credential_counts(F.col("text")), lambda x: F.concat(F.lit("credential:"), x["family"]))
    problems = F.array_compact(F.concat(leaks, F.array(F.when(ext.isin("json", "ipynb") & ~obj, "not a JSON object"), *missing)))
    return d.select("file", F.when(F.size(problems) > 0, "failed").otherwise("passed").alias("status"), F.array_join(problems, ",").alias("problems"))
