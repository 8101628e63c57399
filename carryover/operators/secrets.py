"""Credential scan and redaction over text, key-based redaction over properties.

Everything is a regular expression over whole texts inside the scan stage; findings carry
the family and a count, never the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.canonical import pseudonym

# family, pattern, replacement, in redaction order (fixed values)
FAMILIES = [
    ("private_key", r"(?is)-----BEGIN (PRIVATE KEY|RSA PRIVATE KEY|EC PRIVATE KEY)-----.*?-----END \1-----", "[REDACTED_PRIVATE_KEY]"),
    ("api_key", r"""(?i)(?:api[_-]?key|apikey|sk-)["']?([a-zA-Z0-9_\-]{8,})['"]?""", "[REDACTED_API_KEY]"),
    ("service_account_path", r"""(?i)(?:GOOGLE_APPLICATION_CREDENTIALS|service[_-]?account|gcp[_-]?sa)["']?[=:]\s*["']?([^\s"']+\.json)["']?|[A-Za-z]:[\\/][^\s"']*(?:service[_-]?account|gcp[_-]?sa|credentials?)[^\s"']*\.json""",
     "[REDACTED_SERVICE_ACCOUNT_PATH]"),
    ("connection_string", r"""(?i)(?:postgresql|mysql|mssql|oracle)://[^\s]+:[^\s@]+@[^\s"']""", "[REDACTED_CONNECTION_STRING]"),
    ("credential_parameter", r"""(?i)([?&](?:key|password|secret|token|api_key)=)[^&\s"']+""", "$1[REDACTED_CREDENTIAL_PARAMETER]"),
    ("oauth_token", r"""(?i)(?:access_token|oauth_token|bearer)["']?[=:]\s*["']?([a-zA-Z0-9_\-\.]+)["']?""", "[REDACTED_TOKEN]"),
    ("aws_key", r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY]"),
]
# two more families, for plain assignments and addresses in prose
EXTRA_FAMILIES = [
    ("assigned_secret", r"""(?i)\b((?:api_key|secret|password|token)\s*=\s*)"[^"\n]+\"""", "$1[REDACTED_SECRET]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
]

# A text without one of these strings (in lower case) cannot match the family, and no
# marker of an earlier family contains one, so the test on the original text is exact. It
# saves the slow case-insensitive search on most texts.
NEEDS = {
    "private_key": ["-----begin"], "api_key": ["api", "sk-"], "service_account_path": [".json"], "connection_string": ["://"],
    "credential_parameter": ["="], "oauth_token": ["token", "bearer"], "aws_key": ["akia"], "assigned_secret": ["="], "email": ["@"],
}
NEVER = "(?!)"

# parts of key names whose value is a secret (fixed values)
SECRET_KEYS = ["secret", "token", "password", "passwd", "credential", "service_account", "serviceaccount", "private_key",
               "privatekey", "api_key", "apikey", "access_key", "accesskey", "authorization", "signature"]
# parts of values that are secrets (fixed values)
SECRET_VALUES = ["-----begin", "bearer "]
# parts of key names whose value is a person (fixed values)
PRINCIPAL_KEYS = ["userbyemail", "groupbyemail", "iammember", "domain", "useremail", "owneremail", "principalemail"]
REDACTED = "[redacted]"


def _may_match(text: Column, family: str) -> Column:
    low = F.lower(text)
    out = low.contains(NEEDS[family][0])
    for need in NEEDS[family][1:]:
        out = out | low.contains(need)
    return out


def credential_counts(text: Column, extra: bool = False) -> Column:
    """Array of struct(family, hits) of the families that occur."""
    fams = FAMILIES + (EXTRA_FAMILIES if extra else [])
    hits = lambda n, p: F.when(_may_match(text, n), F.regexp_count(text, F.lit(p))).otherwise(0).cast("long")
    found = F.array(*[F.struct(F.lit(n).alias("family"), hits(n, p).alias("hits")) for n, p, _ in fams])
    return F.filter(found, lambda x: x["hits"] > 0)


def credential_scan(df: DataFrame, key: str, text: str, extra: bool = False) -> DataFrame:
    return df.select(key, F.explode(credential_counts(F.col(text), extra)).alias("_f")).select(key, "_f.family", "_f.hits")


def redact_text(text: Column, extra: bool = False) -> Column:
    out = text
    for family, pattern, mark in FAMILIES + (EXTRA_FAMILIES if extra else []):
        # The pattern, not the text, depends on the test: the nested text appears only once.
        out = F.regexp_replace(out, F.when(_may_match(text, family), pattern).otherwise(NEVER), F.lit(mark))
    return out


def _contains_any(c: Column, parts: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def redact_value(key: Column, value: Column) -> Column:
    """One property by its key: secrets go, people become pseudonyms, bearer values go."""
    return (F.when(_contains_any(key, SECRET_KEYS), F.when(value.isNotNull(), REDACTED))
            .when(_contains_any(key, PRINCIPAL_KEYS), pseudonym(value))
            .when(_contains_any(value, SECRET_VALUES), REDACTED).otherwise(value))


def redact_map(properties: Column) -> Column:
    return F.transform_values(properties, redact_value)


def nesting(text: Column, strings: bool = False) -> Column:
    """Deepest nesting of braces and brackets in a JSON text; ``strings`` counts those in
    strings too, as a string may hold JSON again."""
    bare = text if strings else F.regexp_replace(text, r'"(\\.|[^"\\])*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    moved = lambda s, c: s["now"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)
    step = lambda s, c: F.struct(moved(s, c).alias("now"), F.greatest(s["top"], moved(s, c)).alias("top"))
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"]), F.lit(0))


def opened(start: Column, levels: Column, open_all: Callable[[Column], Column]) -> Column:
    """``open_all`` applied to ``start`` as many times as the row says. The plan holds it once,
    however deep the deepest row is; a row goes no further than its own depth."""
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda acc, _: open_all(acc))


def json_leaves(text: Column) -> Column:
    """Array of struct(path, name, value) for every leaf of a JSON text, at any depth.

    Each step opens one more level of all entries inside the row, so the text is read once.
    Text that only looks like JSON, such as a template, is a leaf, however many braces it has.
    """
    entry = lambda path, name, value: F.struct(path.alias("path"), name.alias("name"), value.alias("value"))
    holds = lambda v: F.when(v.startswith("{") | v.startswith("["), F.try_parse_json(v).isNotNull())

    def open_one(x: Column) -> Column:
        v = x["value"]
        dot = F.when(x["path"] == "", "").otherwise(".")
        fields = F.transform(F.map_entries(F.from_json(v, "map<string,string>")), lambda e: entry(F.concat(x["path"], dot, e["key"]), e["key"], e["value"]))
        items = F.transform(F.from_json(v, "array<string>"), lambda e, i: entry(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), x["name"], e))
        return F.when(holds(v) & v.startswith("{"), fields).when(holds(v), items).otherwise(F.array(entry(x["path"], x["name"], v)))

    start = F.array(entry(F.lit("").cast("string"), F.lit("").cast("string"), text))
    return opened(start, F.when(holds(text), nesting(text, strings=True)), lambda acc: F.flatten(F.transform(acc, open_one)))


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """All leaves of a JSON column, however deep the deepest one lies."""
    return df.select(key, F.explode(json_leaves(F.col(text))).alias("_l")).select(key, "_l.*").where("path <> ''")


# expressions that resolve a secret at run time (fixed values)
SECRET_EXPRESSION = r"(?i)(\$\{?\{?\s*secrets?[.:]|\benv_var\s*\(\s*['\"][^'\"]*(secret|token|password|key)|getSecret\s*\(|\bsecretmanager\b|@Microsoft\.KeyVault)"

# words that make a name sensitive, and shapes of well-known credentials (fixed values)
MARKER_WORDS = (r"(?i)password|passwd|secret|token|credential|authorization|apikey|api_key|privatekey|private_key|"
                r"accesskey|access_key|connectionstring|connection_string")
CREDENTIAL_SHAPES = (r"(?i)gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|"
                     r"AIza[A-Za-z0-9_-]{35}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}")
# names of personal facts, and marker words once separators are gone: an addition of ours
PERSONAL_WORDS = r"(?i)\b(ssn|social security|passport|salary)\b"
RESERVED_NAMES = ["_measures", "calendar", "date", "measures", "parameters"]


def sensitive_name(name: Column) -> Column:
    """Reason a name must not be shown, or an empty text."""
    joined = F.regexp_replace(name, "[ _-]", "")
    return (F.when(F.lower(name).isin(RESERVED_NAMES), "reserved").when(name.rlike(MARKER_WORDS) | name.rlike(PERSONAL_WORDS), "sensitive")
            .when(name.rlike(CREDENTIAL_SHAPES) | joined.rlike(MARKER_WORDS), "credential_shaped").otherwise(""))
