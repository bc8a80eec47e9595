"""Investigation queries over the table of evaluated actions: filters in the rule language, counts over time, top values, distinct counts and paged scans."""

from __future__ import annotations

import ast
import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.syntax import check_expression, fail
from ..lang.values import RuleError, Ty

TIME = "__time"
#: Rows of a CSV export, and default limits of scans and top values.
CSV_ROWS, PAGE, TOP = 100_000, 100, 100
#: How far back a previous period may reach.
HISTORY_DAYS = 90


# ---- filters ----


class Predicate:
    """Compiles one predicate of the rule language to a filter over columns of the given types.

    ``keep_operand_order`` keeps the established reading of a literal on the left: ``-10.0 > A`` filters ``A > -10.0``. Without
    it the comparison is mirrored as it is written.
    """

    def __init__(self, types: dict[str, Ty], keep_operand_order: bool = True):
        self.types, self.keep_operand_order = types, keep_operand_order

    def compile(self, text: str) -> Column | None:
        """The filter, or None for an empty query."""
        if not text.strip():
            return None
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise RuleError(f"query:{e.lineno}: {e.msg}") from None
        check_expression("query", tree)
        if not isinstance(tree, ast.Compare | ast.BoolOp | ast.Call) and not (isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.Not)):
            raise fail("query", tree, "a query is a predicate")
        return self.of(tree)

    def of(self, e: ast.expr) -> Column:
        if isinstance(e, ast.BoolOp):
            parts = [self.of(x) for x in e.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(e.op, ast.And) else (out | p)
            return out
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            return ~self.of(e.operand)
        if isinstance(e, ast.Compare):
            return self.compare(e)
        if isinstance(e, ast.Call):
            return self.call(e)
        raise fail("query", e, f"{type(e).__name__} is no predicate")

    def name(self, e: ast.Name) -> str:
        if e.id not in self.types:
            raise fail("query", e, f"{e.id} is no feature")
        return e.id

    @staticmethod
    def literal(e: ast.expr) -> object:
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub) and isinstance(e.operand, ast.Constant) and isinstance(e.operand.value, int | float):
            return -e.operand.value
        if isinstance(e, ast.List):
            return [Predicate.literal(x) for x in e.elts]
        raise fail("query", e, "a literal is needed here")

    def compare(self, e: ast.Compare) -> Column:
        a, op, b = e.left, e.ops[0], e.comparators[0]
        if isinstance(op, ast.In | ast.NotIn):
            out = self.contains(a, b)
            return out if isinstance(op, ast.In) else ~out
        names = [isinstance(x, ast.Name) for x in (a, b)]
        if not any(names):
            raise fail("query", e, "a comparison needs a feature")
        if all(names):
            if not isinstance(op, ast.Eq | ast.NotEq):
                raise fail("query", e, "two features can be compared by == and != only")
            same = F.col(f"`{self.name(a)}`") == F.col(f"`{self.name(b)}`")
            return same if isinstance(op, ast.Eq) else ~same
        name, value = (self.name(a), self.literal(b)) if names[0] else (self.name(b), self.literal(a))
        col, many = F.col(f"`{name}`"), self.types[name].plain.kind == "list"
        if isinstance(op, ast.Eq | ast.NotEq):
            same = col.isNull() if value is None else F.array_contains(col, value) if many else col == F.lit(value)
            return same if isinstance(op, ast.Eq) else ~same
        if not isinstance(value, int | float | str) or isinstance(value, bool):
            raise fail("query", e, f"{value!r} has no order")
        if isinstance(value, str) and self.types[name].numeric:
            raise fail("query", e, f"{name} is a number")
        kind = type(op)
        if not names[0] and not self.keep_operand_order:
            kind = {ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE}[kind]
        bound = {ast.Lt: col < value, ast.LtE: col <= value, ast.Gt: col > value, ast.GtE: col >= value}[kind]
        return col.isNotNull() & bound

    def contains(self, a: ast.expr, b: ast.expr) -> Column:
        if isinstance(b, ast.List) and isinstance(a, ast.Name):
            values, name = self.literal(b), self.name(a)
            col = F.col(f"`{name}`")
            some = [x for x in values if x is not None]
            if self.types[name].plain.kind == "list":
                return F.arrays_overlap(col, F.array(*[F.lit(x) for x in some]))
            hit = col.isin(some) if some else F.lit(False)
            return (hit | col.isNull()) if None in values else hit
        if isinstance(b, ast.Name) and isinstance(a, ast.Constant) and isinstance(a.value, str):
            col, low = F.col(f"`{self.name(b)}`"), a.value.lower()
            if self.types[b.id].plain.kind == "list":
                return F.exists(col, lambda x: F.lower(x).contains(low))
            return F.lower(col).contains(low)
        raise fail("query", a, "in takes a text in a feature, or a feature in a list")

    def call(self, e: ast.Call) -> Column:
        if e.func.id not in QUERY_FUNCTIONS:
            raise fail("query", e, f"{e.func.id} is no query function")
        return QUERY_FUNCTIONS[e.func.id](Arguments(self, e))


class Arguments:
    """The arguments of one call in a query."""

    def __init__(self, predicate: Predicate, call: ast.Call):
        self.predicate, self.node = predicate, call
        self.given = {k.arg: k.value for k in call.keywords}

    def refuse(self, why: str) -> RuleError:
        return fail("query", self.node, why)

    def literal(self, name: str, default: object = ...) -> object:
        if name not in self.given:
            if default is ...:
                raise self.refuse(f"{self.node.func.id} needs {name}")
            return default
        return self.predicate.literal(self.given[name])

    def feature(self, name: str) -> Column:
        if not isinstance(self.given.get(name), ast.Name):
            raise self.refuse(f"{self.node.func.id} needs a feature as {name}")
        return F.col(f"`{self.predicate.name(self.given[name])}`")


#: What a query may call: a function from the arguments to a filter. Others are added by ``query_function``.
QUERY_FUNCTIONS: dict[str, Callable[[Arguments], Column]] = {}


def query_function(name: str) -> Callable:
    def wrap(build: Callable[[Arguments], Column]) -> Callable:
        QUERY_FUNCTIONS[name] = build
        return build

    return wrap


@query_function("RegexMatch")
def _regex_match(a: Arguments) -> Column:
    target, pattern = a.feature("target"), a.literal("pattern")
    try:
        re.compile(pattern)
    except re.error as x:
        raise a.refuse(f"bad pattern: {x}") from None
    return target.rlike(("(?iu)" if a.literal("case_insensitive", False) else "") + pattern)


def _did_label(status: int) -> Callable[[Arguments], Column]:
    def build(a: Arguments) -> Column:
        wanted = f"{a.literal('entity_type')}/{a.literal('label_name')}/{status}"
        return F.coalesce(F.exists("__entity_label_mutations", lambda x: x.contains(wanted)), F.lit(False))

    return build


query_function("DidAddLabel")(_did_label(1))
query_function("DidRemoveLabel")(_did_label(0))
query_function("DidDeclareVerdict")(lambda a: F.coalesce(F.array_contains("__verdicts", a.literal("verdict")), F.lit(False)))


def validate(text: str, types: dict[str, Ty]) -> str | None:
    """What is wrong with a query, or None."""
    try:
        Predicate(types).compile(text)
    except RuleError as e:
        return str(e)
    return None


def entity_filter(entity_types: dict[str, str], kind: str, entity_id: object, features: list[str] | None = None) -> Column:
    """Rows any of whose features of the entity's type hold its id; without such a feature, none."""
    names = [f for f, t in entity_types.items() if t == kind and (features is None or f in features)]
    out = F.lit(False)
    for f in names:
        out = out | F.coalesce(F.col(f"`{f}`") == F.lit(entity_id), F.lit(False))
    return out


@dataclass
class Ability:
    """Who may see what: everything, listed items, or all but listed ones."""

    name: str
    allow_all: bool = False
    allow_specific: list[str] = field(default_factory=list)
    allow_all_except: list[str] = field(default_factory=list)

    def allows(self, item: str) -> bool:
        return self.allow_all or item in self.allow_specific or (bool(self.allow_all_except) and item not in self.allow_all_except)

    def filter(self, column: str) -> Column:
        c = F.col(f"`{column}`")
        if self.allow_all:
            return F.lit(True)
        if self.allow_all_except:
            return ~c.isin(self.allow_all_except) | c.isin(self.allow_specific)
        return F.coalesce(c.isin(self.allow_specific), F.lit(False)) if self.allow_specific else F.lit(False)


def censor_columns(df: DataFrame, visible: Ability, exempt: tuple[str, ...] = ("ActionName",), mask: str = "[CENSORED]") -> DataFrame:
    """Features outside the ability become the mask (text) or null; a null stays null."""
    out = {}
    for name, kind in df.dtypes:
        if not name.startswith("__") and name not in exempt and not visible.allows(name):
            out[name] = F.when(F.col(f"`{name}`").isNotNull(), F.lit(mask)) if kind == "string" else F.lit(None).cast(kind)
    return df.withColumns(out) if out else df


def censor_json(column: str, paths: list[str], mask: str = "[CENSORED]") -> Column:
    """JSON text whose leaves under the dotted paths are masked; unreadable text is masked whole."""

    def hide(x: object) -> object:
        return {k: hide(y) for k, y in x.items()} if isinstance(x, dict) else [hide(y) for y in x] if isinstance(x, list) else mask

    def walk(x: object, rest: list[str]) -> object:
        if not rest:
            return hide(x)
        if isinstance(x, list):
            return [walk(y, rest) for y in x]
        return {k: walk(y, rest[1:]) if k == rest[0] else y for k, y in x.items()} if isinstance(x, dict) else x

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            x = json.loads(t)
        except ValueError:
            return json.dumps(mask)
        for p in paths:
            x = walk(x, p.split("."))
        return json.dumps(x, ensure_ascii=False)

    return F.pandas_udf(lambda s: s.map(one), "string")(F.col(column))


# ---- queries ----


@dataclass
class Query:
    """One investigation: the table, its time span ``[start, end)``, a filter, an entity and what the analyst may see."""

    table: DataFrame
    types: dict[str, Ty]
    start: datetime
    end: datetime
    query: str = ""
    entity: tuple[str, object] | None = None
    entity_types: dict[str, str] = field(default_factory=dict)
    ability: Ability | None = None
    action_column: str = "ActionName"

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError("start is after end")

    def rows(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        t = F.col(TIME)
        out = self.table.where((t >= F.lit(start or self.start)) & (t < F.lit(end or self.end)))
        condition = Predicate(self.types).compile(self.query)
        if condition is not None:
            out = out.where(condition)
        if self.entity:
            out = out.where(entity_filter(self.entity_types, *self.entity))
        if self.ability:
            out = out.where(self.ability.filter(self.action_column))
        return out

    # counts over time
    def bucket(self, granularity: str, at: Column | None = None) -> Column:
        t = F.col(TIME) if at is None else at
        minutes = {"fifteen_minute": 15, "thirty_minute": 30}.get(granularity)
        if minutes:
            return F.date_trunc("hour", t) + F.expr(f"make_dt_interval(0, 0, {minutes}, 0)") * F.floor(F.minute(t) / minutes)
        if granularity == "all":
            return F.lit(self.start).cast("timestamp")
        if granularity not in ("minute", "hour", "day", "week", "month"):
            raise ValueError(f"unknown granularity {granularity}")
        return F.date_trunc(granularity, t)

    def timeseries(self, granularity: str, dimensions: list[str] | None = None, zero_fill: bool = True) -> DataFrame:
        """``(bucket, count, …)``; with dimensions and an entity, also how often each dimension holds the entity's id.

        Buckets without rows count 0. Map-side aggregation leaves one row per bucket and task for the shuffle.
        """
        measures = [F.count("*").alias("count")]
        if dimensions and self.entity:
            measures += [F.count_if(F.coalesce(F.col(f"`{d}`") == F.lit(self.entity[1]), F.lit(False))).alias(d) for d in dimensions]
        counted = self.rows().groupBy(self.bucket(granularity).cast("timestamp_ntz").alias("bucket")).agg(*measures)
        if not zero_fill or granularity == "all" or self.start == self.end:
            return counted
        step = {"minute": "1 minute", "fifteen_minute": "15 minutes", "thirty_minute": "30 minutes", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[granularity]
        first, last = self.bucket(granularity, F.lit(self.start).cast("timestamp")), F.lit(self.end - timedelta(microseconds=1)).cast("timestamp")
        every = self.table.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("b")).select(F.col("b").cast("timestamp_ntz").alias("bucket"))
        names = [c for c in counted.columns if c != "bucket"]
        return every.join(counted, "bucket", "left").select("bucket", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    # top values
    def dimension(self, name: str, precision: float | None = None) -> Column:
        c = F.col(f"`{name}`")
        if precision is None or not self.types.get(name, Ty("str")).numeric:
            return c
        inverse = round(1 / precision)
        places = max(0, len(str(inverse)) - 1)
        return F.when(c.isNotNull(), F.concat(F.lit("~"), F.format_string(f"%.{places}f", F.floor(c * inverse) / inverse)))

    def topn(self, name: str, limit: int = TOP, precision: float | None = None) -> DataFrame:
        """``(dimension, count)``, the most frequent values, ties by value."""
        d = self.dimension(name, precision).alias("dimension")
        return self.rows().groupBy(d).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col("dimension").asc_nulls_first()).limit(limit)

    def topn_change(self, name: str, limit: int = TOP, precision: float | None = None) -> DataFrame:
        """``topn`` with the count of the same span before it, their difference and its percentage (null without a count before)."""
        span = self.end - self.start
        d = self.dimension(name, precision).alias("dimension")
        now = self.topn(name, limit, precision)
        if span > timedelta(days=HISTORY_DAYS):
            return now.select("dimension", "count", F.lit(None).cast("bigint").alias("previous"), F.lit(None).cast("bigint").alias("difference"), F.lit(None).cast("double").alias("percent"))
        before = self.rows(self.start - span, self.start).groupBy(d).agg(F.count("*").alias("before"))
        joined = now.join(before.withColumnRenamed("dimension", "d2"), F.col("dimension").eqNullSafe(F.col("d2")), "left")
        previous = F.coalesce("before", F.lit(0))
        return joined.select(
            "dimension", "count", previous.alias("previous"), (F.col("count") - previous).alias("difference"),
            F.when(previous > 0, (F.col("count") - previous) * 100.0 / previous).alias("percent"),
        )

    def cardinality(self, name: str, exact: bool = False) -> DataFrame:
        """How many distinct values there are, by sketch or exactly."""
        c = F.col(f"`{name}`")
        return self.rows().agg((F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.01)).alias("cardinality"))

    # scans
    def scan(self, limit: int = PAGE, ascending: bool = False, after: str | None = None, columns: tuple[str, ...] = ("__action_id", TIME)) -> DataFrame:
        """A page in order of time and id, with one row more than asked for where there is a next page.

        ``after`` is the cursor of the last row seen: its full time and id, so that no row comes twice or is left out.
        """
        rows, key = self.rows(), F.struct(F.unix_micros(F.col(TIME).cast("timestamp")).alias("t"), F.col("__action_id").alias("i"))
        if after:
            t, i = json.loads(base64.b64decode(after))
            mark = F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(i).cast("bigint").alias("i"))
            rows = rows.where(key > mark if ascending else key < mark)
        order = [F.col(TIME).asc(), F.col("__action_id").asc()] if ascending else [F.col(TIME).desc(), F.col("__action_id").desc()]
        return rows.select(*columns).orderBy(*order).limit(limit + 1)

    def page(self, limit: int = PAGE, ascending: bool = False, after: str | None = None) -> tuple[list, str | None]:
        """The page's rows (at most ``limit``) and the cursor for the next, None at the end."""
        got = self.scan(limit, ascending, after).collect()
        return got[:limit], cursor(got[limit - 1][TIME], got[limit - 1]["__action_id"]) if len(got) > limit else None

    def export_csv(self, name: str, path: str, limit: int = CSV_ROWS) -> None:
        """Writes the top values with their change as CSV; more than ``CSV_ROWS`` of them are refused."""
        if limit > CSV_ROWS:
            raise ValueError(f"an export holds at most {CSV_ROWS} rows")
        self.topn_change(name, limit).coalesce(1).write.mode("overwrite").csv(path, header=True)


def cursor(at: datetime, action_id: int) -> str:
    micros = (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return base64.b64encode(json.dumps([micros, action_id]).encode()).decode()


def granularity_for(start: datetime, end: datetime) -> str:
    """The largest bucket that gives more than seven points."""
    steps = {"month": 2_592_000, "week": 604_800, "day": 86_400, "hour": 3_600, "thirty_minute": 1_800, "fifteen_minute": 900, "minute": 60}
    span = (end - start).total_seconds()
    return next((g for g, s in steps.items() if span / s > 7), "minute")


def results_by_id(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored results of the given ids, newest first; ids meet the table by semi-join."""
    return stored.join(ids.select("id").distinct(), "id", "left_semi").orderBy(F.desc("stored_timestamp"), "id")


def result_by_id(stored: DataFrame, id_: int) -> DataFrame:
    """The newest stored result of one id, by a filter that reaches the scan; no row where there is none."""
    return stored.where(F.col("id") == F.lit(id_)).orderBy(F.desc("stored_timestamp")).limit(1)


def latency_stats(df: DataFrame, column: str) -> DataFrame:
    """Nearest-rank latency figures."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {column})")
    return df.agg(F.min(column).alias("min"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(column).alias("max"))
