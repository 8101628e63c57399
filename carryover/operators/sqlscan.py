"""Pattern scans over a query log: risks, features, references, statements, complexity.

All scans are expressions over the text column, so they run inside the scan stage and
nothing is shuffled. They work on tokens, not on a syntax tree.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.typemap import level_name

# code, pattern, level 0 direct .. 3 unsupported (patterns are fixed values)
RISK_RULES = [
    ("wildcard_table", r"_TABLE_SUFFIX|`[^`]*\*`", 2),
    ("star_except_replace", r"(?i)\bSELECT\s+\*\s+(EXCEPT|REPLACE)\b", 2),
    ("external_query", r"(?i)\bEXTERNAL_QUERY\s*\(", 2),
    ("net_function", r"(?i)\bNET\.[A-Z_]+\s*\(", 2),
    ("geography_function", r"(?i)\bST_[A-Z_]+\s*\(", 2),
    ("safe_prefix", r"(?i)\bSAFE\.[A-Z_]+\s*\(", 1),
    ("safe_cast", r"(?i)\bSAFE_CAST\s*\(", 1),
    ("unnest", r"(?i)\bUNNEST\s*\(", 1),
    ("not_in", r"(?i)\bNOT\s+IN\s*\(", 1),
    ("merge", r"(?i)\bMERGE\s+(INTO\s+)?[`\w]", 1),
    ("table_sample", r"(?i)\bTABLESAMPLE\b", 1),
    ("interval", r"(?i)\bINTERVAL\b", 1),
    ("javascript", r"(?i)\bLANGUAGE\s+js\b", 2),
    ("remote_function", r"(?i)\bREMOTE\s+WITH\s+CONNECTION\b", 2),
    ("dynamic_sql", r"(?i)\bEXECUTE\s+IMMEDIATE\b", 2),
    ("qualify", r"(?i)\bQUALIFY\b", 1),
    ("time_travel", r"(?i)\bFOR\s+SYSTEM_TIME\s+AS\s+OF\b", 1),
]
# What a text must hold, in upper case, for a rule to match: one of the alternatives, all strings
# of it. No string has an I, the one ASCII letter whose upper case depends on the locale.
NEEDS = {
    "wildcard_table": [["_TABLE_SUFF"], ["*`"]], "star_except_replace": [["SELECT", "EXCEPT"], ["SELECT", "REPLACE"]], "external_query": [["EXTERNAL_QUERY"]],
    "net_function": [["NET."]], "geography_function": [["ST_", "("]], "safe_prefix": [["SAFE.", "("]], "safe_cast": [["SAFE_CAST"]], "unnest": [["UNNEST"]],
    "not_in": [["NOT", "("]], "merge": [["MERGE"]], "table_sample": [["TABLESAMPLE"]], "interval": [["NTERVAL"]], "javascript": [["LANGUAGE", "JS"]],
    "remote_function": [["REMOTE", "CONNECT"]], "dynamic_sql": [["EXECUTE", "MMED"]], "qualify": [["QUAL"]], "time_travel": [["SYSTEM_T"]],
}
# what this library does with a construct: runs as is, written another way, or ported by hand
SPARK_SUPPORT = {
    "wildcard_table": "rewrite", "star_except_replace": "rewrite", "external_query": "port", "net_function": "rewrite",
    "geography_function": "rewrite", "safe_prefix": "rewrite", "safe_cast": "rewrite", "unnest": "rewrite", "not_in": "native",
    "merge": "rewrite", "table_sample": "native", "interval": "native", "javascript": "port", "remote_function": "port",
    "dynamic_sql": "native", "qualify": "rewrite", "time_travel": "rewrite",
}

# feature, pattern over the text without literals and comments
FEATURES = [
    ("cte", r"(?i)^\s*WITH\b|\(\s*WITH\b"), ("union", r"(?i)\bUNION\b"), ("intersect", r"(?i)\bINTERSECT\b"),
    ("except", r"(?i)(?<!\*)(?<!\*\s)\bEXCEPT\s+(ALL|DISTINCT|SELECT)\b"), ("joins", r"(?i)\bJOIN\b"),
    ("group_by", r"(?i)\bGROUP\s+BY\b"), ("windows", r"(?i)\bOVER\s*[(\w]"), ("qualify", r"(?i)\bQUALIFY\b"),
    ("unnest", r"(?i)\bUNNEST\s*\("), ("struct", r"(?i)\bSTRUCT\s*[(<]"), ("array", r"(?i)\bARRAY(_\w+)?\s*[(<\[]"),
    ("cast", r"(?i)\bCAST\s*\("), ("case", r"(?i)\bCASE\b"), ("null_handling", r"(?i)\b(COALESCE|NULLIF|IFNULL)\s*\(|\bIS\s+(NOT\s+)?NULL\b"),
    ("safe_cast", r"(?i)\bSAFE_CAST\s*\("), ("not_in", r"(?i)\bNOT\s+IN\s*\("), ("distinct", r"(?i)\bSELECT\s+DISTINCT\b|\(\s*DISTINCT\b"),
    ("limit", r"(?i)\bLIMIT\s+\d"), ("order_by", r"(?i)\bORDER\s+BY\b"),
    ("dml", r"(?i)\b(INSERT\s+(INTO\s+)?[`\w]|UPDATE\s+[`\w.]+\s+SET|DELETE\s+(FROM\s+)?[`\w]|MERGE\s+(INTO\s+)?[`\w])"),
    ("ddl", r"(?i)\b(CREATE|DROP|ALTER|TRUNCATE)\s+(OR\s+REPLACE\s+)?(TEMP(ORARY)?\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|SCHEMA|MATERIALIZED)\b"),
    ("recursive", r"(?i)\bWITH\s+RECURSIVE\b"),
]

NOISE = r"""(?s)'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|#[^\n]*|/\*.*?\*/"""


def strip_noise(sql: Column) -> Column:
    """Text with literals and comments replaced by a blank literal."""
    return F.regexp_replace(sql, NOISE, "''")


def _may_match(upper: Column, code: str) -> Column:
    return reduce(Column.__or__, [reduce(Column.__and__, [upper.contains(x) for x in every]) for every in NEEDS[code]])


def risk_hits(sql: Column, upper: Column | None = None) -> Column:
    """Array of struct(code, level): one projection of all rules, no join with them. A rule is
    searched only in texts that hold what it cannot match without; ``upper`` is the text in
    upper case, where a column has it."""
    upper = F.upper(sql) if upper is None else upper
    return F.array_compact(F.array(*[
        F.when(_may_match(upper, c) & sql.rlike(p), F.struct(F.lit(c).alias("code"), F.lit(lv).alias("level"))) for c, p, lv in RISK_RULES]))


def worst_level(hits: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hits, lambda h: h["level"])), F.lit(0))


def risk_scan(df: DataFrame, sql: str) -> DataFrame:
    d = df.withColumn("_upper", F.upper(sql)).withColumn("_hits", risk_hits(F.col(sql), F.col("_upper")))
    return d.select(*df.columns, F.transform("_hits", lambda h: h["code"]).alias("risks"),
                    level_name(worst_level(F.col("_hits"))).alias("verdict"))


def features(sql: Column) -> Column:
    # an array of one binds the clean text, so that it is made once and not for every feature
    return F.transform(F.array(strip_noise(sql)), features_of)[0]


def features_of(clean: Column) -> Column:
    """``features`` of a text that has no literals and comments left."""
    joins = F.regexp_count(clean, F.lit(r"(?i)\bJOIN\b"))
    found = [F.when(clean.rlike(p), F.lit(n)) for n, p in FEATURES]
    return F.array_sort(F.array_compact(F.array(*found, F.when(joins > 2, "multi_join"))))


def complexity(sql: Column) -> Column:
    """1 to 100: tokens plus distinct keywords; 10 for an empty text."""
    clean = strip_noise(sql)
    tokens = F.regexp_count(clean, F.lit(r"\w+|[^\s\w]"))
    words = F.size(F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(r"([A-Z_]{2,})"), F.lit(1)), lambda w: w)))
    return F.when(F.trim(sql) == "", 10).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), tokens + words)))


def verdict(df: DataFrame, sql: str, language: str | None = None, engine: str = "spark") -> DataFrame:
    """Per query: features, risks, notes and the level for a target engine."""
    # columns of their own: the clean text and the upper case are made once per row
    d = df.withColumns({"_clean": strip_noise(F.col(sql)), "_upper": F.upper(sql)})
    d = d.withColumns({"_hits": risk_hits(F.col(sql), F.col("_upper")), "_feat": features_of(F.col("_clean"))})
    has = lambda f: F.array_contains("_feat", f)
    rules = {
        "unnest changes multiplicity": has("unnest"), "safe cast": has("safe_cast"), "not in with nulls": has("not_in"),
        "qualify": has("qualify") & F.lit(engine == "spark"), "structs": has("struct") & F.lit(engine == "tsql"),
        "windows": has("windows") & F.lit(engine == "pyspark"),
    }
    many = F.size(F.filter(F.split("_clean", ";"), lambda s: F.trim(s) != "")) > 1
    script = many & has("dml")
    command = F.col("_clean").rlike(r"(?i)^\s*(DECLARE|BEGIN|CALL|EXECUTE|EXPORT|LOAD)\b")
    other = F.lit(False) if language is None else (F.coalesce(F.upper(F.trim(F.col(language))), F.lit("")).isin("", "SQL") == F.lit(False))
    level = F.greatest(worst_level(F.col("_hits")), *[F.when(c, 1).otherwise(0) for c in rules.values()],
                       F.when(script | command | other, 2).otherwise(0))
    notes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()], F.when(script, "script with changes"),
                                    F.when(command, "script command"), F.when(other, "language has no SQL path")))
    return d.select(*df.columns, F.col("_feat").alias("features"), F.transform("_hits", lambda h: h["code"]).alias("risks"),
                    notes.alias("notes"), level_name(level).alias("verdict"))


def table_references(df: DataFrame, key: str, sql: str, project: str, dataset: str) -> DataFrame:
    """Distinct tables a query names after FROM, JOIN, INTO, USING, UPDATE or MERGE, with the
    default project and dataset filled in; names of the query's own CTEs are left out."""
    clean = F.regexp_replace(F.col(sql), r"""(?s)'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/""", "''")
    refs = F.regexp_extract_all(clean, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|USING|UPDATE|MERGE)\s+(`[^`]+`|[A-Za-z_][\w\-]*(?:\.[A-Za-z_][\w\-]*)*)(?!\s*\()"), F.lit(1))
    ctes = F.regexp_extract_all(clean, F.lit(r"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)([A-Za-z_]\w*)\s+AS\s*\("), F.lit(1))
    names = F.array_distinct(F.transform(refs, lambda r: F.translate(r, "`", "")))
    words = F.array(*[F.lit(w) for w in ("select", "set", "unnest", "values", "table")])
    keep = F.filter(names, lambda n: ~F.array_contains(F.transform(ctes, F.lower), F.lower(n)) & ~F.array_contains(words, F.lower(n)))

    def full(n):
        dots = F.size(F.split(n, r"\."))
        return F.when(dots == 1, F.concat(F.lit(f"{project}.{dataset}."), n)).when(dots == 2, F.concat(F.lit(f"{project}."), n)).otherwise(n)

    return df.select(key, F.explode(F.array_distinct(F.transform(keep, full))).alias("ref"))


#: Literals, quoted names, comments, ``;`` and what lies between. An opening mark that is never
#: closed is a character like others; two literals side by side are one with a doubled quote.
#: Every loop is possessive, so texts of any length are read without going back.
TOKEN = r"""(?s)'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|`[^`]*+`|--[^\n]*+|#[^\n]*+|/\*.*?\*/|;|[^;'"`#/-]++|."""
_TOKEN = re.compile(TOKEN)
BLANKS, NUL = " \t\n\r\f\v", "\0"


def split_text(sql: str) -> list[str]:
    """Statements of one script: ``;`` outside quotes, backticks and comments."""
    cuts = [m.start() for m in _TOKEN.finditer(sql) if m.group() == ";"]
    parts = [sql[a + 1:b].strip(BLANKS) for a, b in zip([-1, *cuts], [*cuts, len(sql)], strict=True)]
    return [s for s in parts if s]


def statements(sql: Column) -> Column:
    """``split_text`` as an expression: bare ``;`` become a character that SQL has nowhere (a
    NUL, left out of the text itself), and the text is cut there."""
    tokens = F.regexp_extract_all(F.translate(sql, NUL, ""), F.lit(TOKEN), F.lit(0))
    cut = F.split(F.array_join(F.transform(tokens, lambda t: F.when(t == ";", F.lit(NUL)).otherwise(t)), ""), NUL)
    return F.filter(F.transform(cut, lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")


def split_statements(df: DataFrame, key: str, sql: str) -> DataFrame:
    """One row per statement with its position, in the scan stage."""
    return df.select(key, F.posexplode(statements(F.col(sql))).alias("position", "statement"))
