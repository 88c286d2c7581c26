"""Queries as Python dicts, lowered to one DataFrame plan.

    {"from": df, "join": [{"with": dim, "on": ("=", ":a", ":b"), "type": "left"}],
     "where": [(">", ":qty", 1)], "group": [":region"], "agg": [("as", ("sum", ":amount"), "total")],
     "having": [(">", ":total", 10)], "order": [(":total", "desc")], "limit": 5}

A string that starts with a colon is a column, any other value a literal; a tuple or list is an
operation. There is one flat namespace: on a name in both sides of a join the right side wins and
its key column goes. Nothing runs until the DataFrame does.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import dates, scalars
from larkspur.functions.periods import PREDICATES, period
from larkspur.operators import joins, windows

KEYS = {"from", "join", "where", "select", "agg", "group", "having", "window", "order", "limit", "offset", "distinct", "result", "union", "intersect", "except"}


class QueryError(ValueError):
    """A query that can't be planned; the message names what is there."""


def _is_op(x) -> bool:
    return isinstance(x, (tuple, list)) and bool(x) and isinstance(x[0], str) and not x[0].startswith(":")


def name_of(x) -> str:
    """The column a reference names."""
    return x[1:] if isinstance(x, str) and x.startswith(":") else str(x)


def expr(x) -> Column:
    """An expression as a Column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str) and x.startswith(":"):
        return F.col(f"`{x[1:]}`")
    if not _is_op(x):
        return F.lit(x)
    op, args = x[0].lower(), list(x[1:])
    if op in ARITHMETIC:
        return reduce(ARITHMETIC[op], map(expr, args)) if len(args) > 1 or op != "-" else -expr(args[0])
    if op in FUNCTIONS:
        return FUNCTIONS[op](*args)
    return predicate(x)


ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": scalars.divide, "%": scalars.modulo, "mod": scalars.modulo,
}


def _case(*args) -> Column:
    """(condition, value) pairs, then ("else", value)."""
    out = F
    for condition, value in args:
        if condition == "else":
            return out.otherwise(expr(value))
        out = out.when(predicate(condition), expr(value))
    return out


FUNCTIONS = {
    "abs": lambda x: F.abs(expr(x)), "sqrt": lambda x: scalars.square_root(expr(x)), "round": lambda x, n=0: F.round(expr(x), n),
    "floor": lambda x: F.floor(expr(x)), "ceil": lambda x: F.ceil(expr(x)), "sign": lambda x: scalars.sign(expr(x)), "signum": lambda x: scalars.sign(expr(x)),
    "log": lambda x: scalars.natural_log(expr(x)), "ln": lambda x: scalars.natural_log(expr(x)), "log10": lambda x: scalars.decimal_log(expr(x)), "exp": lambda x: F.exp(expr(x)),
    "pow": lambda x, n: F.pow(expr(x), expr(n)), "**": lambda x, n: F.pow(expr(x), expr(n)),
    "greatest": lambda *x: F.greatest(*map(expr, x)), "least": lambda *x: F.least(*map(expr, x)), "coalesce": lambda *x: F.coalesce(*map(expr, x)),
    "nullif": lambda x, y: F.nullif(expr(x), expr(y)), "case": _case, "cast": lambda x, kind: scalars.as_type(expr(x), kind),
    "upper": lambda x: F.upper(expr(x)), "lower": lambda x: F.lower(expr(x)), "length": lambda x: F.length(expr(x)), "trim": lambda x: F.trim(expr(x)),
    "substr": lambda x, a, n=None: scalars.substring(expr(x), expr(a), None if n is None else expr(n)), "replace": lambda x, a, b: F.replace(expr(x), expr(a), expr(b)),
    "concat": lambda *x: scalars.concat(*map(expr, x)),
    "date-trunc": lambda unit, x: dates.date_trunc(unit, expr(x)), "extract": lambda field, x: dates.extract(field, expr(x)), "date-add": lambda unit, n, x: dates.date_add(unit, expr(n), expr(x)),
    "date-diff": lambda unit, a, b: dates.date_diff(unit, expr(a), expr(b)), "time-bucket": lambda n, unit, x, origin=None: dates.time_bucket(n, unit, expr(x), None if origin is None else expr(origin)),
    "epoch-days": lambda x: dates.epoch_days(expr(x)), "epoch-seconds": lambda x: dates.epoch_seconds(expr(x)),
}

COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "not=": lambda a, b: a != b,
}


def predicate(x) -> Column:
    """A condition as a Column; NULL counts as false where it is used to filter."""
    if isinstance(x, Column):
        return x
    if not _is_op(x):
        return expr(x)
    op, args = x[0].lower(), list(x[1:])
    if op in COMPARISONS:
        return COMPARISONS[op](expr(args[0]), expr(args[1]))
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), map(predicate, args))
    if op == "not":
        return ~predicate(args[0])
    if op in ("between", "range"):
        return expr(args[0]).between(expr(args[1]), expr(args[2]))
    if op in ("not-between", "not-range"):
        return ~expr(args[0]).between(expr(args[1]), expr(args[2]))
    if op in ("in", "not-in"):
        values = [v for v in args[1] if v is not None]
        held = expr(args[0]).isin(*values) if values else F.lit(False)
        if len(values) < len(args[1]):  # a NULL in the list: true or unknown, never false
            held = F.when(held, True)
        return held if op == "in" else ~held
    if op in ("like", "not-like", "ilike", "not-ilike"):
        match = F.like if op.endswith("-like") or op == "like" else F.ilike
        held = match(expr(args[0]), F.lit(args[1]), F.lit(args[2])) if len(args) > 2 else match(expr(args[0]), F.lit(args[1]))
        return ~held if op.startswith("not") else held
    if op in ("contains", "starts-with", "ends-with"):
        return {"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[op](expr(args[0]), expr(args[1]))
    if op in ("is-null", "is-not-null"):
        return expr(args[0]).isNull() if op == "is-null" else expr(args[0]).isNotNull()
    if op == "fn":
        return row_function(args[1])(expr(args[0]))
    if op.replace("-", "_") in PREDICATES:
        return period(op.replace("-", "_"), *map(expr, args))
    raise QueryError(f"unknown operation {x[0]!r}")


def row_function(f):
    """A Python predicate of one value as a vectorised function; NULL stays NULL."""

    @F.pandas_udf("boolean")
    def apply(values):
        return values.map(lambda v: None if v is None or v != v else bool(f(v)))

    return apply


def _filtered(agg, condition):
    """An aggregate over the rows that meet a condition."""
    kind, *args = agg
    guard = predicate(condition)
    if kind == "count" and not args:
        return F.count(F.when(guard, 1))
    return aggregate((kind, F.when(guard, expr(args[0])), *args[1:]))


def aggregate(x) -> Column:
    """An aggregate, or an expression over aggregates."""
    if not _is_op(x):
        return expr(x)
    op, args = x[0].lower(), list(x[1:])
    if op == "filter":
        return _filtered(*args)
    if op == "count" and not args:
        return F.count(F.lit(1))
    if op in AGGREGATES:
        return AGGREGATES[op](*args)
    if op in ARITHMETIC:
        return reduce(ARITHMETIC[op], map(aggregate, args))
    if op in FUNCTIONS:
        return FUNCTIONS[op](*[aggregate(a) if _is_op(a) else a for a in args])
    return predicate(x)


AGGREGATES = {
    "count": lambda x: F.count(expr(x)), "count-non-null": lambda x: F.count(expr(x)), "count-distinct": lambda x: F.count_distinct(expr(x)),
    "sum": lambda x: F.sum(expr(x)), "sum-product": lambda a, b: F.sum(expr(a) * expr(b)), "avg": lambda x: F.avg(expr(x)), "min": lambda x: F.min(expr(x)), "max": lambda x: F.max(expr(x)),
    "stddev": lambda x: F.stddev_samp(expr(x)), "stddev-samp": lambda x: F.stddev_samp(expr(x)), "stddev-pop": lambda x: F.stddev_pop(expr(x)),
    "variance": lambda x: F.var_samp(expr(x)), "var-samp": lambda x: F.var_samp(expr(x)), "var-pop": lambda x: F.var_pop(expr(x)), "corr": lambda a, b: F.corr(expr(a), expr(b)),
    "median": lambda x: F.median(expr(x)), "percentile": lambda x, p: F.percentile(expr(x), p), "percentile-cont": lambda x, p: F.percentile(expr(x), p),
    "approx-quantile": lambda x, p: F.percentile_approx(expr(x), p, 10_000),
}
NUMERIC_ONLY = {"sum", "avg", "stddev", "stddev-samp", "stddev-pop", "variance", "var-samp", "var-pop", "median", "percentile", "percentile-cont", "approx-quantile"}


def _check_numeric(df: DataFrame, aggs: list) -> None:
    kinds = dict(df.dtypes)
    for a in aggs:
        a = a[1] if _is_op(a) and a[0] == "as" else a
        if _is_op(a) and a[0].lower() in NUMERIC_ONLY and isinstance(a[1], str) and kinds.get(name_of(a[1])) == "string":
            raise QueryError(f"{a[0]} of the string column {name_of(a[1])}")


def named(items: list, kind=expr) -> list[Column]:
    """Columns with names: given by `as`, a column's own, or the operation's, made distinct by their column."""
    bases = [x[0].lower().replace("-", "_") if _is_op(x) and x[0] != "as" else None for x in items]
    often = Counter(b for b in bases if b)
    out, used = [], Counter()
    for x, base in zip(items, bases, strict=True):
        if _is_op(x) and x[0] == "as":
            out.append(kind(x[1]).alias(name_of(x[2])))
            continue
        name = base or name_of(x)
        if base and often[base] > 1 and len(x) > 1 and isinstance(x[1], str) and x[1].startswith(":"):
            name = f"{base}_{name_of(x[1])}"
        used[name] += 1
        out.append(kind(x).alias(name if used[name] == 1 else f"{name}_{used[name]}"))
    return out


def _references(x) -> set[str]:
    if isinstance(x, str):
        return {x[1:]} if x.startswith(":") else set()
    return set().union(*map(_references, x)) if isinstance(x, (tuple, list)) else set()


def _check_columns(df: DataFrame, clause: str, items) -> None:
    missing = _references(list(items)) - set(df.columns)
    if missing:
        raise QueryError(f"{clause}: no column {', '.join(sorted(missing))}; there are {', '.join(df.columns)}")


def _join(df: DataFrame, j: dict) -> DataFrame:
    right, how = j["with"], j.get("type", "inner")
    on = j["on"] if _is_op(j["on"][0]) else [j["on"]]
    equal = [(name_of(a), name_of(b)) for op, a, b in on if op == "="]
    rest = [(name_of(a), op, name_of(b)) for op, a, b in on if op != "="]
    if how.startswith("asof"):
        if len(rest) != 1:
            raise QueryError("an as-of join has exactly one inequality")
        out = joins.asof_join(df, right, rest[0], equal, "left" if how.endswith("left") else "inner")
        double = [c for c in out.columns if c.endswith("_right") and c[:-6] in df.columns]
        keys = {b for _, b in equal}
        return out.drop(*[c for c in double if c[:-6] in keys])
    if rest:
        raise QueryError("joins are on equal columns; use an as-of join for one inequality")
    # The right side wins on clashing names; its key columns are the left ones' equals.
    keys = {b for _, b in equal}
    moved = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"`_r_{b}`") for a, b in equal])
    both = df.join(moved, condition, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return both
    out = []
    for c in df.columns:
        pair = next((b for a, b in equal if a == c), None)
        if pair and how in ("right", "full", "outer"):
            out.append(F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{pair}`")).alias(c))
        elif c not in right.columns or c in keys or pair:
            out.append(F.col(f"`{c}`"))
    taken = {c for c in df.columns if c not in right.columns or c in keys or any(a == c for a, _ in equal)}
    out += [F.col(f"`_r_{c}`").alias(c) for c in right.columns if c not in keys and c not in taken]
    return both.select(*out)


RANKS = {"row-number": F.row_number, "rank": F.rank, "dense-rank": F.dense_rank, "percent-rank": F.percent_rank, "cume-dist": F.cume_dist}


def _frame(w, frame):
    kind, low, high = frame
    bound = lambda b: {"unbounded-preceding": Window.unboundedPreceding, "unbounded-following": Window.unboundedFollowing, "current-row": 0}.get(b, b)
    return (w.rowsBetween if kind == "rows" else w.rangeBetween)(bound(low), bound(high))


def _window(df: DataFrame, spec: dict) -> DataFrame:
    """spec: op, col, n, default, partition, order, frame, as."""
    op, into = spec["op"].lower(), spec["as"]
    keys, order = [name_of(k) for k in spec.get("partition", [])], [(name_of(o[0]), o[1]) if not isinstance(o, str) else (name_of(o), "asc") for o in spec.get("order", [])]
    value = expr(spec["col"]) if "col" in spec else None
    if op == "rleid":
        return windows.rleid(df, name_of(spec["col"]), keys, order, into)
    if op == "ema":
        return windows.ema(df, name_of(spec["col"]), spec["n"], keys, order, into)
    plain = Window.partitionBy(*keys).orderBy(*[windows._last(o) for o in order]) if order else Window.partitionBy(*keys)
    w = _frame(plain, spec["frame"]) if "frame" in spec else windows.over(keys, order)
    whole = plain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if op in RANKS:
        out = RANKS[op]().over(plain)
    elif op == "ntile":
        out = F.ntile(spec["n"]).over(plain)
    elif op in ("lag", "lead"):
        out = getattr(F, op)(value, spec.get("n", 1), spec.get("default")).over(plain)
    elif op in ("first-value", "last-value"):
        out = (F.first if op == "first-value" else F.last)(value).over(_frame(plain, spec["frame"]) if "frame" in spec else whole)
    elif op == "nth-value":
        out = F.nth_value(value, spec["n"]).over(whole)
    elif op in ("fills", "locf"):
        out = windows.fills(value, plain)
    elif op in windows.MOVING:
        out = windows.moving(op, value, spec["n"], plain)
    else:
        out = aggregate((op, value) if value is not None else (op,)).over(w)
    return df.withColumn(into, out)


def q(query: dict) -> DataFrame:
    """The DataFrame of a query."""
    if unknown := set(query) - KEYS:
        raise QueryError(f"unknown clause {', '.join(sorted(unknown))}; there are {', '.join(sorted(KEYS))}")
    for key, how in (("union", None), ("intersect", "intersect"), ("except", "subtract")):
        if key in query:
            parts = [q(x) for x in query[key]]
            if how:
                return reduce(lambda a, b: getattr(a, how)(b), parts)
            out = reduce(lambda a, b: a.unionByName(b), parts)
            return out.distinct() if query.get("distinct", True) else out
    df = query["from"]
    df = q(df) if isinstance(df, dict) else df
    for j in query.get("join", []):
        df = _join(df, j)
    for p in query.get("where", []):
        _check_columns(df, "where", [p])
        df = df.filter(predicate(p))
    group, aggs = query.get("group", []), query.get("agg", [])
    if aggs or group:
        _check_columns(df, "group", group)
        _check_columns(df, "agg", aggs)
        _check_numeric(df, aggs)
        columns = named(aggs, aggregate)
        df = df.groupBy(*named(group)).agg(*columns) if group and columns else df.groupBy(*named(group)).agg(F.lit(1).alias("_")).drop("_") if group else df.agg(*columns)
    for spec in query.get("window", []):
        df = _window(df, spec)
    for p in query.get("having", []):
        df = df.filter(predicate(p))
    order = [o if isinstance(o, (tuple, list)) and len(o) == 2 and o[1] in ("asc", "desc") else (o, "asc") for o in query.get("order", [])]
    by = [expr(e).desc_nulls_last() if d == "desc" else expr(e).asc_nulls_last() for e, d in order]
    if "select" in query:
        _check_columns(df, "select", query["select"])
        shown = named(query["select"])
        if by and not query.get("distinct"):
            extra = [b for b in by]
            df = df.orderBy(*extra).select(*shown)
            by = []
        else:
            df = df.select(*shown)
    if query.get("distinct"):
        df = df.distinct()
    if by:
        df = df.orderBy(*by)
    if "offset" in query:
        df = df.offset(query["offset"])
    if "limit" in query:
        df = df.limit(query["limit"])
    return df


def run(query: dict):
    """Rows as dicts, or with {"result": "columns"} a dict of columns."""
    out = q({k: v for k, v in query.items() if k != "result"})
    if query.get("result") == "columns":
        return out.toArrow().to_pydict()
    return [r.asDict() for r in out.collect()]
