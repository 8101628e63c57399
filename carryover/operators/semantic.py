"""Semantic layer: declared views, measures and explores resolved to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NUMERIC = (T.NumericType,)


@dataclass
class Measure:
    """``kind``: count, sum, average, min, max, count_distinct. ``where`` filters the rows of
    this measure only; ``money`` sums as exact decimals."""

    kind: str
    column: str | None = None
    where: str | None = None
    scale: int | None = 2


@dataclass
class View:
    name: str
    frame: DataFrame
    key: str
    dimensions: dict[str, str] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)


@dataclass
class Join:
    """``relationship`` seen from the base: many_to_one and one_to_one keep the rows of the
    base, one_to_many repeats them."""

    view: View
    on: tuple[str, str]
    relationship: str = "many_to_one"


@dataclass
class Explore:
    base: View
    joins: list[Join] = field(default_factory=list)

    def views(self) -> dict[str, View]:
        return {self.base.name: self.base, **{j.view.name: j.view for j in self.joins}}


def check_measure(m: Measure, frame: DataFrame) -> None:
    if m.kind not in ("count", "sum", "average", "min", "max", "count_distinct"):
        raise ValueError(f"unsupported measure {m.kind}")
    if m.column is None:
        return
    dt = frame.schema[m.column].dataType
    if m.kind in ("sum", "average") and not isinstance(dt, NUMERIC):
        raise ValueError(f"{m.kind} needs a number: {m.column}")
    if m.kind in ("min", "max") and not isinstance(dt, (*NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{m.kind} needs a number or a date: {m.column}")


def _value(m: Measure) -> Column:
    x = F.col(m.column) if m.column else F.lit(1)
    if m.kind in ("sum", "average") and m.scale is not None:
        x = x.cast(f"decimal(28,{m.scale})")
    return F.when(F.expr(m.where), x) if m.where else x


def measure_column(m: Measure) -> Column:
    x = _value(m)
    if m.kind == "count":
        return F.count(x)
    if m.kind == "count_distinct":
        return F.coalesce(F.count_distinct(x), F.lit(0))
    if m.kind == "average":
        return F.try_divide(F.sum(x).cast("double"), F.count(x))
    out = {"sum": F.sum, "min": F.min, "max": F.max}[m.kind](x)
    return out.cast("double") if m.kind == "sum" else out


def _split(name: str) -> tuple[str, str]:
    view, f = name.split(".", 1)
    return view, f


def semantic_query(ex: Explore, dimensions: list[str], measures: list[str], filters: str | None = None,
                   sorts: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Answer a question: only the joins the named fields need are made.

    Measures of the base stay whole when a one_to_many join repeats its rows: base
    measures are then taken over one row per base key and dimension value.
    """
    views = ex.views()
    used = {_split(f)[0] for f in dimensions + measures}
    text = filters or ""
    used |= {v for v in views if f"{v}." in text}
    for f in dimensions:
        v, d = _split(f)
        if v not in views or d not in views[v].dimensions:
            raise ValueError(f"unknown dimension {f}")
    for f in measures:
        v, m = _split(f)
        if v not in views or m not in views[v].measures:
            raise ValueError(f"unknown measure {f}")
        check_measure(views[v].measures[m], views[v].frame)
    fanned = any(j.relationship == "one_to_many" and j.view.name in used for j in ex.joins)
    if fanned and any(_split(m)[0] not in (ex.base.name, *[j.view.name for j in ex.joins if j.relationship == "one_to_many"]) for m in measures):
        raise ValueError("measures of a many_to_one view cannot be mixed with a one_to_many join")
    d = ex.base.frame
    for j in ex.joins:
        if j.view.name in used:
            right = j.view.frame
            d = d.join(right, d[j.on[0]] == right[j.on[1]], "left")
    for v in used:
        for dim, expr in views[v].dimensions.items():
            if f"{v}.{dim}" in dimensions:
                d = d.withColumn(f"_{v}__{dim}", F.expr(expr))
    if filters:
        for v in views:
            text = text.replace(f"{v}.", "")
        d = d.where(text)
    keys = [F.col("_{}__{}".format(*_split(f))).alias(f.replace(".", "_")) for f in dimensions]
    names = [f.replace(".", "_") for f in dimensions]
    agg = lambda fs: [measure_column(views[_split(f)[0]].measures[_split(f)[1]]).alias(f.replace(".", "_")) for f in fs]
    if not fanned:
        out = d.groupBy(*keys).agg(*agg(measures))
    else:
        own = [m for m in measures if _split(m)[0] == ex.base.name]
        other = [m for m in measures if m not in own]
        parts = []
        if own:
            need = {m.column for m in ex.base.measures.values() if m.column} | {ex.base.key}
            need |= {c for c in ex.base.frame.columns if any(m.where and c in m.where for m in ex.base.measures.values())}
            one = d.select(*keys, *sorted(need)).distinct()
            parts.append(one.groupBy(*names).agg(*agg(own)))
        if other:
            parts.append(d.groupBy(*keys).agg(*agg(other)))
        out = parts[0]
        for p in parts[1:]:
            cond = [out[n].eqNullSafe(p[n]) for n in names]
            if not cond:  # one row each
                out = out.withColumns({c: p.select(c).scalar() for c in p.columns})
                continue
            joined = out.join(p, cond, "full")
            out = joined.select(*[F.coalesce(out[n], p[n]).alias(n) for n in names],
                                *[c for c in joined.columns if c not in names])
    if sorts:
        out = out.orderBy(*[F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sorts])
    return out.limit(limit) if limit else out


def symmetric(df: DataFrame, dims: list[str], key: str, value: str) -> DataFrame:
    """Sum, average and count of ``value`` once per distinct ``key`` in a fanned-out frame.

    The two-level aggregate spreads a hot dimension over its keys before it is summed.
    """
    one = df.groupBy(*dims, key).agg(F.first(value).alias("_v"))
    g = one.groupBy(*dims).agg(F.sum("_v").alias("_s"), F.count("_v").alias("n"))
    return g.select(*dims, F.col("_s").cast("double").alias("total"), F.try_divide(F.col("_s").cast("double"), F.col("n")).alias("average"), "n")


def period_label(day: Column, end: str, days: int) -> Column:
    """Selected and previous period; both are open at the start and closed at the end."""
    e = F.lit(end).cast("date")
    return (F.when((day > F.date_sub(e, days)) & (day <= e), "Selected")
            .when((day > F.date_sub(e, 2 * days)) & (day <= F.date_sub(e, days)), "Previous").otherwise("Not"))


def date_spine(df: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """Daily totals with the missing days filled by zero."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias(day))
    return spine.join(df, day, "left").na.fill(0, measures)


def with_share(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the whole. The total is a scalar subquery, not a one-partition window."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.try_divide(F.col(value).cast("double") * 100, total.cast("double")))


class Rollups:
    """Registry of materialised rollups; a question is answered from one that covers it."""

    def __init__(self):
        self.items: list[tuple[frozenset, frozenset, DataFrame]] = []

    def register(self, dims: set[str], additive: set[str], frame: DataFrame) -> None:
        self.items.append((frozenset(dims), frozenset(additive), frame))

    def find(self, dims: list[str], measures: list[str]) -> DataFrame | None:
        fits = [(len(d), f) for d, m, f in self.items if set(dims) <= d and set(measures) <= m]
        return min(fits, key=lambda x: x[0])[1] if fits else None

    def answer(self, base: DataFrame, dims: list[str], measures: list[str]) -> tuple[DataFrame, bool]:
        """Sums of additive measures by ``dims``; tells whether a rollup was used."""
        hit = self.find(dims, measures)
        src = base if hit is None else hit
        return src.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures]), hit is not None


def auto_measures(df: DataFrame) -> DataFrame:
    """Row count, and sum, average and count of every numeric column, in one pass."""
    exprs, names = [F.count(F.lit(1)).cast("double").alias("_n")], [("Row Count", "_n")]
    for f in df.schema.fields:
        if not isinstance(f.dataType, NUMERIC):
            continue
        x = F.col(f.name).cast("decimal(28,2)") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("decimal(20,0)")
        s, n = F.sum(x).cast("double"), F.count(x)
        exprs += [s.alias(f"_s_{f.name}"), F.try_divide(s, n).alias(f"_a_{f.name}"), n.cast("double").alias(f"_c_{f.name}")]
        names += [(f"Sum {f.name}", f"_s_{f.name}"), (f"Average {f.name}", f"_a_{f.name}"), (f"Count {f.name}", f"_c_{f.name}")]
    one = df.agg(*exprs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(c).alias("value")) for n, c in names])))


def resolve_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Element by element: every field must exist, and none may be named twice at the same
    position. ``refs``: element, position, field; ``known``: field."""
    counted = refs.groupBy("element", "position", "field").agg(F.count(F.lit(1)).alias("_c"))
    j = counted.join(known.distinct().withColumn("_ok", F.lit(True)), "field", "left")
    g = j.groupBy("element").agg(F.sum(F.when(F.col("_ok").isNull(), F.col("_c")).otherwise(0)).alias("unresolved"), F.max("_c").alias("_m"))
    return g.select("element", "unresolved", F.when(F.col("unresolved") > 0, "unresolved_reference").when(F.col("_m") > 1, "duplicate_reference").otherwise("ok").alias("code"))


