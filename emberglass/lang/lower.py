"""Lowering rules to Spark columns.

Every expression becomes a value and a success flag, since a failed expression is not the same as one of value None: lists,
arithmetic and rules fail with a failed part, while ``and``, ``or``, ``==`` and arguments that admit None take it in.
Features are laid out in stages by depth, so that each is computed once and refers to earlier ones as columns.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as v
from .syntax import RuleFile, Sources, fail, import_order
from .values import ANY, BOOL, FLOAT, INT, NONE, STR, RuleError, Ty, V, both

#: Columns that rule evaluation reads. ``data`` and ``secret_data`` are JSON text.
INPUTS = ("action_id", "action_name", "timestamp", "data")
_NAMED = {"str": STR, "int": INT, "float": FLOAT, "bool": BOOL, "None": NONE, "Any": ANY, "TimeDeltaT": v.TIMEDELTA, "RuleT": v.RULE}


def annotation(path: str, a: ast.expr) -> tuple[Ty, set[str]]:
    """Type of an annotation and the marks (Secret, ExtractSecret, ExtractLiteral) around it."""
    if isinstance(a, ast.Constant) and a.value is None:
        return NONE, set()
    if isinstance(a, ast.Name) and a.id in _NAMED:
        return _NAMED[a.id], set()
    if isinstance(a, ast.BinOp) and isinstance(a.op, ast.BitOr):
        (x, m), (y, n) = annotation(path, a.left), annotation(path, a.right)
        if NONE in (x, y):
            return replace(y if x == NONE else x, optional=True), m | n
        return replace(ANY, optional=x.optional or y.optional), m | n
    if isinstance(a, ast.Subscript) and isinstance(a.value, ast.Name):
        kind = a.value.id
        if kind == "Union" and isinstance(a.slice, ast.Tuple):
            parts = [annotation(path, x) for x in a.slice.elts]
            rest = [t for t, _ in parts if t != NONE]
            t = rest[0] if len(rest) == 1 else ANY
            return replace(t, optional=len(rest) < len(parts)), set().union(*[m for _, m in parts])
        t, marks = annotation(path, a.slice)
        if kind == "Optional":
            return replace(t, optional=True), marks
        if kind in ("List", "list"):
            return Ty("list", t), marks
        if kind == "Entity":
            if t.kind not in ("str", "int"):
                raise fail(path, a, "an entity's id is a str or an int")
            return Ty("entity", t), marks
        if kind in ("Secret", "ExtractSecret", "ExtractLiteral"):
            return t, marks | {kind}
    raise fail(path, a, f"unknown type {ast.unparse(a)}")


def fits(have: Ty, want: Ty) -> bool:
    """Whether a value of one type may stand where another is wanted."""
    if "any" in (have.kind, want.kind):
        return True
    if have.kind == "none":
        return want.optional or want.kind == "none"
    if have.optional and not want.optional:
        return False
    if have.kind == "entity" and want.kind != "entity":
        have = have.plain
    if want.kind == "list" and have.plain.kind == "list":
        h = have.plain.item or ANY
        return fits(h, want.item or ANY)
    return have.kind == want.kind or (have.plain.kind == "int" and want.kind == "float") or (have.kind == "rule" and want.kind == "bool")


#: Label states of an entity: label name to status and reasons.
LABELS = "map<string,struct<status:int,reasons:map<string,struct<pending:boolean,description:string,created_at:timestamp,expires_at:timestamp>>>>"


#: Columns made of the effects of one kind: column name to kind and what an effect becomes. Others are added by ``effect_column``.
EFFECT_COLUMNS: dict[str, tuple[str, Callable[[Column], Column]]] = {}


def effect_column(name: str, kind: str, build: Callable[[Column], Column]) -> None:
    """Gives evaluated actions a column of the effects of a kind (null without any), as effects of one's own functions need it."""
    EFFECT_COLUMNS[name] = (kind, build)


@dataclass
class Feature:
    name: str
    path: str
    value: V
    stage: int
    keep: bool


@dataclass
class Lowered:
    """A ruleset ready to run over any DataFrame with the input columns."""

    features: list[Feature]
    stages: list[dict[str, Column]]
    effects: list[tuple[Column, list[V]]]
    audit: list[Column]
    errors: list[Column]
    entity_types: dict[str, str]
    depends: dict[str, set[str]] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    lookups: dict[int, list[tuple[str, str, Column]]] = field(default_factory=dict)
    #: Rule, kind of effect, entity type, name (of a label or verdict) and status of every effect a rule may have.
    links: list[tuple[str, str, str | None, str | None, int | None]] = field(default_factory=list)
    #: Of every file the files it brings in, and the names it assigns.
    files: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)

    def types(self) -> dict[str, Ty]:
        """Types of the extracted features after evaluation."""
        return {f.name: f.value.ty.plain for f in self.features if f.keep}

    def evaluate(self, actions: DataFrame, keep: tuple[str, ...] = (), labels: DataFrame | None = None) -> DataFrame:
        """One row per action: its features, effects, audit and number of errors.

        ``actions`` needs ``action_id``, ``action_name``, ``timestamp`` and ``data`` (JSON text; ``secret_data`` may be there).
        Unreadable JSON counts as an empty object. Columns named in ``keep`` pass through; others are dropped. ``labels`` are the
        label states as of the start, ``(entity_type, entity_id, labels)`` with one row per entity; without them no entity has
        a label.
        """
        secret = F.col("secret_data") if "secret_data" in actions.columns else F.lit(None).cast("string")
        parse = lambda c: F.coalesce(F.call_function("try_parse_json", c), F.call_function("parse_json", F.lit("{}")))
        df = actions.select(
            F.col("action_id").alias("_action_id"), F.col("action_name").alias("_action_name"), F.col("timestamp").cast("timestamp").alias("_timestamp"),
            parse(F.col("data").cast("string")).alias("_data"), parse(secret).alias("_secret"), *[F.col(k).alias(f"_keep_{k}") for k in keep],
        )
        for n in range(max(len(self.stages), *[k + 1 for k in self.lookups], 0)):
            for name, kind, key in self.lookups.get(n, []):
                if labels is None:
                    df = df.withColumn(name, F.lit(None).cast(LABELS))
                    continue
                own = labels.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(f"{name}_id"), F.col("labels").cast(LABELS).alias(name))
                df = df.withColumn(f"{name}_key", key.cast("string")).join(own, F.col(f"{name}_key") == F.col(f"{name}_id"), "left").drop(f"{name}_id", f"{name}_key")
            if n < len(self.stages) and self.stages[n]:
                df = df.withColumns(self.stages[n])
        struct = "array<struct<kind:string,entity_type:string,entity_id:string,name:string,status:int,delay:double,expires_after:double,suppressed:boolean,rules:array<string>>>"
        effects = F.flatten(F.array(*[F.when(c, F.array_compact(F.array(*[e.held() for e in es]))).otherwise(F.array().cast(struct)) for c, es in self.effects])) if self.effects else F.array().cast(struct)
        df = df.withColumn("_effects", effects)
        of_kind = lambda kind: F.filter("_effects", lambda e: e["kind"] == kind)
        mutations = F.transform(of_kind("label"), lambda e: F.concat_ws("/", e["entity_type"], e["name"], e["status"].cast("string")))
        verdicts = F.transform(of_kind("verdict"), lambda e: e["name"])
        taking = F.transform(F.filter("_effects", lambda e: (e["kind"] == "label") & ~e["suppressed"] & (e["status"] == 1)), lambda e: F.concat_ws("/", e["entity_type"], e["entity_id"], e["name"]))
        some = lambda a: F.when(F.size(a) > 0, a)
        count = F.lit(0)
        for e in self.errors:
            count = count + F.coalesce(e, F.lit(False)).cast("int")
        return df.select(
            *[F.col(f"_keep_{k}").alias(k) for k in keep],
            *[F.col(f"v_{f.name}").alias(f.name) for f in self.features if f.keep],
            F.col("_action_id").alias("__action_id"),
            F.date_format("_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("__timestamp"),
            count.alias("__error_count"),
            some(mutations).alias("__entity_label_mutations"),
            some(verdicts).alias("__verdicts"),
            some(taking).alias("__entity_verdicts"),
            F.col("_effects").alias("__effects"),
            *[some(F.transform(of_kind(kind), build)).alias(name) for name, (kind, build) in EFFECT_COLUMNS.items()],
            F.array(*self.audit).alias("__audit") if self.audit else F.lit(None).cast("string").alias("__audit"),
        )


def _power(base: Column, exponent: int) -> Column:
    """An integer to a constant power, exactly; null where it does not fit 64 bits. Squaring keeps the expression small."""
    if exponent > 63:
        return F.when(F.abs(base) <= 1, F.when(F.lit(exponent % 2 == 0), F.abs(base)).otherwise(base))
    out, square = F.lit(1).cast("bigint"), base
    while exponent:
        if exponent % 2:
            out = F.try_multiply(out, square)
        exponent //= 2
        if exponent:
            square = F.try_multiply(square, square)
    return F.when(base.isNotNull(), out)


def _any_power(base: Column, exponent: Column) -> Column:
    """An integer to any power from 0, exactly; null where it does not fit 64 bits."""
    one = F.lit(1).cast("bigint")
    many = F.aggregate(F.sequence(one, F.least(exponent, F.lit(63).cast("bigint"))), one, lambda x, _: F.try_multiply(x, base))
    small = F.when(exponent % 2 == 0, F.abs(base)).otherwise(base)
    return F.when(base.isNull() | exponent.isNull(), F.lit(None).cast("bigint")).when(exponent == 0, one).when(F.abs(base) <= 1, small).when(exponent <= 63, many)


class Lowering:
    """Lowers one set of sources; ``functions`` is the registry of callable names."""

    def __init__(self, sources: Sources, functions: dict):
        self.sources, self.functions = sources, functions
        self.files = sources.files()
        self.order = import_order(self.files)
        self.home: dict[str, str] = {}  # of exported names
        for p in self.order:
            for n in self.files[p].assigns:
                if not n.startswith("_"):
                    if n in self.home:
                        raise RuleError(f"{p}:1: {n} is already assigned in {self.home[n]}")
                    self.home[n] = p
        self.seen: dict[tuple[str, str], Feature] = {}
        self.open: list[tuple[str, str]] = []
        self.stages: list[dict[str, Column]] = []
        self.errors: list[Column] = []
        self.effects: list[tuple[Column, list[V]]] = []
        self.audit: list[Column] = []
        self.active: dict[str, Column | None] = {}
        self.depends: dict[str, set[str]] = {}
        self.rules: dict[str, str] = {}
        self.refs: list[int] = [0]
        self.target: str | None = None
        self.path = "main.sml"
        self.used_locals: set[tuple[str, str]] = set()
        self.lookups: dict[int, list[tuple[str, str, Column]]] = {}
        self.links: list[tuple[str, str, str | None, str | None, int | None]] = []
        self.looked_up: dict[tuple[str, str], tuple[str, int]] = {}

    # ---- files ----
    def reach(self) -> dict[str, list[tuple[str, ast.Call | None]]]:
        """Who brings each file in: imports (None) and requires."""
        by: dict[str, list[tuple[str, ast.Call | None]]] = {"main.sml": []}
        todo, seen = ["main.sml"], set()
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            for q in self.files[p].imports:
                by.setdefault(q, []).append((p, None))
                todo.append(q)
            for call in self.files[p].requires:
                for q in self.required(p, call):
                    by.setdefault(q, []).append((p, call))
                    todo.append(q)
        return by

    def required(self, path: str, call: ast.Call) -> list[str]:
        rule = next((k.value for k in call.keywords if k.arg == "rule"), None)
        if isinstance(rule, ast.Constant) and isinstance(rule.value, str):
            if rule.value not in self.files:
                raise fail(path, call, f"requires {rule.value}, which does not exist")
            return [rule.value]
        if isinstance(rule, ast.JoinedStr):
            return self.sources.matching("".join(x.value if isinstance(x, ast.Constant) else "*" for x in rule.values))
        raise fail(path, call, "rule must be a string or an f-string")

    def activity(self, path: str, by: dict) -> Column | None:
        """When a file takes part; None means always."""
        if path in self.active:
            return self.active[path]
        self.active[path] = F.lit(False)  # of a file that only requires itself
        ways: list[Column | None] = [None] if path == "main.sml" else []
        for p, call in by.get(path, []):
            up = self.activity(p, by)
            cond = None
            if call is not None:
                self.path, self.target = p, None
                rule = next(k.value for k in call.keywords if k.arg == "rule")
                if isinstance(rule, ast.JoinedStr):
                    cond = v.truthy(replace(self.equal(self.expression(rule), V(F.lit(path), STR, const=path))))
                test = next((k.value for k in call.keywords if k.arg == "require_if"), None)
                if test is not None and not (isinstance(test, ast.Constant) and test.value is True):
                    cond = both(cond, v.truthy(self.expression(test)))
            ways.append(both(up, cond))
        if any(w is None for w in ways):
            self.active[path] = None
        else:
            out = F.lit(False)
            for w in ways:
                out = out | w
            name = f"a_{len([k for k in self.active if k != 'main.sml'])}"
            self.put(name, out, self.refs[-1])
            self.active[path] = F.col(name)
        return self.active[path]

    def put(self, name: str, col: Column, stage: int) -> None:
        while len(self.stages) <= stage:
            self.stages.append({})
        self.stages[stage][name] = col

    def sequence(self) -> list[str]:
        """Files in the order they are brought in: imports, the file itself, then what it requires."""
        out: list[str] = []

        def visit(p: str) -> None:
            if p in out:
                return
            for q in self.files[p].imports:
                visit(q)
            if p not in out:
                out.append(p)
            for call in self.files[p].requires:
                for q in self.required(p, call):
                    visit(q)

        visit("main.sml")
        return out

    def run(self) -> Lowered:
        by = self.reach()
        features = []
        todo = ["main.sml"]
        while todo:  # files that always take part, so that conditions may read their features
            p = todo.pop()
            if p not in self.active:
                self.active[p] = None
                todo += self.files[p].imports
                todo += [q for call in self.files[p].requires if {k.arg for k in call.keywords} == {"rule"} and isinstance(call.keywords[0].value, ast.Constant) for q in self.required(p, call)]
        for p in self.sequence():
            active = self.activity(p, by)
            for n in self.files[p].assigns:
                f = self.feature(p, n, active)
                if not n.startswith("_"):
                    features.append(f)
            for call in self.files[p].calls:
                self.path, self.target = p, None
                self.statement(call, active)
        for p in by:
            for n in self.files[p].assigns:
                if n.startswith("_") and (p, n) not in self.used_locals:
                    raise RuleError(f"{p}:1: local {n} is never used")
        types = {f.name: f.value.entity_type for f in features if f.value.entity_type}
        return Lowered(features, self.stages, self.effects, self.audit, self.errors, types, self.depends, self.rules, self.lookups, self.links, {p: ([*self.files[p].imports, *[q for call in self.files[p].requires for q in self.required(p, call)]], list(self.files[p].assigns)) for p in by})

    # ---- names ----
    def visible(self, path: str) -> set[str]:
        out, todo = set(), [path]
        while todo:
            p = todo.pop()
            if p not in out:
                out.add(p)
                todo += self.files[p].imports
        return out

    def feature(self, path: str, name: str, active: Column | None = None) -> Feature:
        key = (path, name)
        if key in self.seen:
            return self.seen[key]
        if key in self.open:
            raise RuleError(f"{path}:1: {name} depends on itself")
        self.open.append(key)
        was = self.path, self.target
        self.path, self.target = path, name
        self.refs.append(0)
        self.depends.setdefault(name, set())
        file = self.files[path]
        want, marks = annotation(path, file.notes[name]) if name in file.notes else (None, set())
        val = self.expression(file.assigns[name], want)
        if want is not None:
            if not fits(val.ty, want) and val.ty.kind != "any":
                raise fail(path, file.assigns[name], f"{name} is declared {want} but is {val.ty}")
            ty = want if val.ty.kind in ("any", "none") or want.kind != "any" else val.ty
            if want.kind == "entity" and val.ty.kind != "entity":
                ty = val.ty
            val = replace(val, ty=replace(ty, optional=want.optional))
            if val.ty.kind == "float":
                val = replace(val, col=val.col.cast("double"))
        stage = self.refs.pop()
        self.path, self.target = was
        self.open.pop()
        column = name if not name.startswith("_") else f"{path}/{name}"
        if active is None and path in self.active:
            active = self.active[path]
        ok = val.ok if active is None else both(active, val.ok)
        for e in val.errors:
            self.errors.append(e if active is None else active & e)
        stored = val.col.cast(val.ty.spark()) if val.ty.kind not in ("effect",) else val.col
        self.put(f"v_{column}", stored if ok is None else F.when(ok, stored), stage)
        if val.ok is not None:
            self.put(f"ok_{column}", F.coalesce(val.ok, F.lit(False)), stage)
        ref = V(F.col(f"`v_{column}`"), val.ty, None if val.ok is None else F.col(f"`ok_{column}`"), val.const, val.entity_type, val.secret or "Secret" in marks or "ExtractSecret" in marks, [], val.parts, val.extra)
        keep = not name.startswith("_") and val.ty.kind != "effect" and (not val.is_const or "ExtractLiteral" in marks) and (not ref.secret or "ExtractSecret" in marks)
        made = self.seen[key] = Feature(name, path, ref, stage, keep)
        return made

    def name(self, e: ast.Name) -> V:
        if (self.path, e.id) in self.seen or e.id in self.files[self.path].assigns:
            home = self.path
        elif e.id in self.home and self.home[e.id] in self.visible(self.path):
            home = self.home[e.id]
        else:
            raise fail(self.path, e, f"{e.id} is not defined here")
        if e.id.startswith("_"):
            self.used_locals.add((home, e.id))
        f = self.feature(home, e.id)
        if self.target:
            self.depends.setdefault(self.target, set()).add(e.id)
        self.refs[-1] = max(self.refs[-1], f.stage + 1)
        return f.value

    # ---- expressions ----
    def expression(self, e: ast.expr, want: Ty | None = None) -> V:
        if isinstance(e, ast.Constant):
            return literal(e.value)
        if isinstance(e, ast.Name):
            return self.name(e)
        if isinstance(e, ast.List):
            return self.list_of(e, want)
        if isinstance(e, ast.JoinedStr):
            parts = [literal(x.value) if isinstance(x, ast.Constant) else self.expression(x.value) for x in e.values]
            return V(F.concat(*[v.as_text(p) for p in parts]) if parts else F.lit(""), STR, both(*[p.ok for p in parts]), secret=any(p.secret for p in parts), parts=parts)
        if isinstance(e, ast.UnaryOp):
            x = self.expression(e.operand)
            if isinstance(e.op, ast.Not):
                return V(~v.truthy(x), BOOL, x.ok, secret=x.secret, errors=x.errors)
            if not x.ty.numeric and x.ty.kind != "any":
                raise fail(self.path, e, f"- needs a number, not {x.ty}")
            return V(-x.col, x.ty.plain, both(x.ok, x.col.isNotNull() if x.can_be_null else None), -x.const if x.is_const else ..., secret=x.secret, errors=x.errors)
        if isinstance(e, ast.BoolOp):
            xs = [self.expression(x) for x in e.values]
            out = v.truthy(xs[0])
            for x in xs[1:]:
                out = (out & v.truthy(x)) if isinstance(e.op, ast.And) else (out | v.truthy(x))
            return V(out, BOOL, secret=any(x.secret for x in xs), errors=[y for x in xs for y in x.errors])
        if isinstance(e, ast.Compare):
            return self.compare(e)
        if isinstance(e, ast.BinOp):
            return self.arithmetic(e)
        return self.call(e, want)

    def list_of(self, e: ast.List, want: Ty | None) -> V:
        xs = [self.expression(x) for x in e.elts]
        kinds = {x.ty.plain.kind for x in xs} - {"none"}
        if len(kinds) > 1 and kinds != {"int", "float"} and not kinds <= {"bool"}:
            raise fail(self.path, e, f"a list holds one type, not {', '.join(sorted(kinds))}")
        item = Ty("float") if kinds == {"int", "float"} else next((replace(x.ty, optional=False) for x in xs if x.ty.kind != "none"), (want.item if want and want.item else STR))
        if not xs and want is None and self.target:
            raise fail(self.path, e, "an empty list needs an annotation")
        const = [x.const for x in xs] if all(x.is_const for x in xs) else ...
        return V(F.array(*[x.col.cast(item.spark()) if item.kind != "effect" else x.col for x in xs]) if xs else F.array().cast(f"array<{item.spark()}>"), Ty("list", item), both(*[x.ok for x in xs]), const, secret=any(x.secret for x in xs), errors=[y for x in xs for y in x.errors], parts=xs)

    def equal(self, a: V, b: V) -> V:
        x, y = a.ty.plain, b.ty.plain
        if NONE in (replace(x, optional=False), replace(y, optional=False)):
            other = b if x.kind == "none" else a
            out = other.held().isNull() if other.ty.kind != "none" else F.lit(True)
        elif x.kind == y.kind and x.kind != "list" or "any" in (x.kind, y.kind) or {x.kind, y.kind} <= {"int", "float"}:
            out = a.held().eqNullSafe(b.held())
        elif {x.kind, y.kind} <= {"int", "float", "bool"}:
            out = a.held().cast("double").eqNullSafe(b.held().cast("double"))
        elif x.kind == y.kind:
            out = a.held().eqNullSafe(b.held())
        else:
            out = a.held().isNull() & b.held().isNull()
        return V(out, BOOL, secret=a.secret or b.secret, errors=a.errors + b.errors)

    def compare(self, e: ast.Compare) -> V:
        a, b, op = self.expression(e.left), self.expression(e.comparators[0]), e.ops[0]
        errors, secret = a.errors + b.errors, a.secret or b.secret
        if isinstance(op, ast.Eq | ast.NotEq):
            out = self.equal(a, b)
            return out if isinstance(op, ast.Eq) else replace(out, col=~out.col)
        if isinstance(op, ast.In | ast.NotIn):
            kb = b.ty.plain
            if kb.kind == "list":
                if b.is_const and a.ty.plain.kind == (kb.item or STR).plain.kind and all(x is not None for x in b.const):
                    out = F.coalesce(a.held().isin(b.const) if b.const else F.lit(False), F.lit(False))
                else:
                    out = F.coalesce(F.exists(b.col, lambda x: x.eqNullSafe(a.held())), F.lit(False))
            elif kb.kind == "str" or "any" in (kb.kind, a.ty.kind):
                if a.ty.plain.kind not in ("str", "any", "none"):
                    raise fail(self.path, e, f"in needs a str in a str, not {a.ty}")
                out = F.coalesce(b.col.contains(a.held()), F.lit(False))
            else:
                raise fail(self.path, e, f"in needs a list or a str, not {b.ty}")
            return V(out if isinstance(op, ast.In) else ~out, BOOL, b.ok, secret=secret, errors=errors)
        for x in (a, b):
            if not x.ty.numeric and x.ty.kind not in ("any", "none"):
                raise fail(self.path, e, f"ordering needs numbers, not {x.ty}")
        ca, cb = a.col, b.col
        out = ca < cb if isinstance(op, ast.Lt) else ca <= cb if isinstance(op, ast.LtE) else ca > cb if isinstance(op, ast.Gt) else ca >= cb
        return V(F.coalesce(out, F.lit(False)), BOOL, both(a.ok, b.ok), secret=secret, errors=errors)

    def arithmetic(self, e: ast.BinOp) -> V:
        a, b, op = self.expression(e.left), self.expression(e.right), e.op
        x, y = a.ty.plain.kind, b.ty.plain.kind
        ca, cb = a.col, b.col
        ints = x == y == "int"
        num = {x, y} <= {"int", "float"}
        if isinstance(op, ast.Add) and x == y == "str":
            out, ty = F.concat(ca, cb), STR
        elif isinstance(op, ast.Mult) and {x, y} == {"str", "int"}:
            s, n = (ca, cb) if x == "str" else (cb, ca)
            out, ty = F.repeat(s, n.cast("int")), STR
        elif not num:
            raise fail(self.path, e, f"{type(op).__name__} takes no {a.ty} and {b.ty}")
        elif isinstance(op, ast.LShift | ast.RShift | ast.BitOr | ast.BitXor | ast.BitAnd):
            if not ints:
                raise fail(self.path, e, "bit operations take integers")
            shift = (F.call_function("shiftleft", ca, cb.cast("int")), F.call_function("shiftright", ca, cb.cast("int")))
            out = shift[0] if isinstance(op, ast.LShift) else shift[1] if isinstance(op, ast.RShift) else ca.bitwiseOR(cb) if isinstance(op, ast.BitOr) else ca.bitwiseXOR(cb) if isinstance(op, ast.BitXor) else ca.bitwiseAND(cb)
            ty = INT
        else:
            if not ints:
                ca, cb = ca.cast("double"), cb.cast("double")
            ty = INT if ints else FLOAT
            zero = cb == 0
            if isinstance(op, ast.Add):
                out = F.try_add(ca, cb)
            elif isinstance(op, ast.Sub):
                out = F.try_subtract(ca, cb)
            elif isinstance(op, ast.Mult):
                out = F.try_multiply(ca, cb)
            elif isinstance(op, ast.Div):
                out, ty = F.when(zero, F.lit(0.0)).otherwise(F.try_divide(ca.cast("double"), cb.cast("double"))), FLOAT
            elif isinstance(op, ast.FloorDiv | ast.Mod):
                if ints:  # exact on the whole range: truncate, then step down where the signs differ
                    rest = F.call_function("try_mod", ca, cb)
                    lower = (rest != 0) & ((rest < 0) != (cb < 0))
                    quotient = F.call_function("div", ca - rest, F.when(zero, F.lit(1).cast("bigint")).otherwise(cb)) - F.when(lower, 1).otherwise(0)
                    out = F.when(zero, F.lit(0).cast("bigint")).otherwise(quotient if isinstance(op, ast.FloorDiv) else rest + F.when(lower, cb).otherwise(0))
                else:
                    rest = F.call_function("try_mod", ca, cb)
                    rest = rest + F.when((rest != 0) & ((rest < 0) != (cb < 0)), cb).otherwise(0.0)
                    out = F.when(zero, F.lit(0.0)).otherwise(rest if isinstance(op, ast.Mod) else F.round(F.try_divide(ca - rest, cb)))
            else:
                if ints and b.is_const and isinstance(b.const, int) and b.const < 0:
                    ty = FLOAT
                p = F.pow(ca.cast("double"), cb.cast("double"))
                out = p if ty == FLOAT else _power(ca, b.const) if b.is_const and isinstance(b.const, int) else F.when(cb < 0, p.try_cast("bigint")).otherwise(_any_power(ca, cb))
        null = out.isNotNull() if ty in (INT,) or a.can_be_null or b.can_be_null else None
        own = both(a.ok, b.ok)
        errors = a.errors + b.errors + ([(~null if own is None else own & ~null)] if null is not None else [])
        return V(out, ty, both(own, null), secret=a.secret or b.secret, errors=errors)

    def labels_of(self, entity: V) -> Column:
        """The column of an entity's label states, joined in before the stage that reads it."""
        key, stage = (entity.entity_type or "", str(entity.held())), self.refs[-1]
        name, before = self.looked_up.get(key, (f"labels_{len(self.looked_up)}", None))
        if before is None or stage < before:  # one join per entity, as early as any of its readers needs it
            if before is not None:
                self.lookups[before] = [x for x in self.lookups[before] if x[0] != name]
            self.lookups.setdefault(stage, []).append((name, key[0], entity.held()))
            self.looked_up[key] = name, stage
        return F.col(name)

    def check_label(self, call: Call) -> None:
        """Where labels are configured, a label must be among them and fit the entity's type."""
        known = self.sources.config.get("labels")
        if known is None:
            return
        label, kind = call.label.const, call.entity.entity_type
        if label not in known:
            raise call.refuse(f"label {label!r} is not configured")
        fit = (known[label] or {}).get("valid_for") or []
        if fit and kind not in fit:
            raise call.refuse(f"label {label!r} is for {', '.join(fit)}, not {kind}")

    # ---- calls ----
    def arguments(self, e: ast.Call, signature) -> dict[str, V]:
        given = {k.arg: k.value for k in e.keywords}
        out: dict[str, V] = {}
        for p in signature.params.values():
            if p.name in given:
                val = self.expression(given.pop(p.name), p.ty)
                if p.const and not val.is_const:
                    raise fail(self.path, e, f"{signature.name}: {p.name} must be a literal")
                if not fits(val.ty, p.ty) and not (p.ty.kind == "effect"):
                    if val.ty.optional and fits(replace(val.ty, optional=False), p.ty):  # narrowed by a null check, or failing at run time
                        val = replace(val, ok=both(val.ok, val.col.isNotNull()), ty=replace(val.ty, optional=False))
                    else:
                        raise fail(self.path, e, f"{signature.name}: {p.name} is {val.ty}, {p.ty} is needed")
                if p.ty.optional and val.ok is not None:  # an argument that admits None takes a failure as None
                    val = replace(val, col=val.held(), ok=None, ty=replace(val.ty, optional=True), errors=val.errors)
                out[p.name] = val
            elif p.default is ...:
                raise fail(self.path, e, f"{signature.name} needs {p.name}")
            else:
                out[p.name] = literal(p.default, p.ty)
        if given and not signature.extra:
            raise fail(self.path, e, f"{signature.name} has no argument {', '.join(sorted(given))}")
        for name, val in given.items():
            out[name] = self.expression(val, signature.extra)
        return out

    def call(self, e: ast.Call, want: Ty | None = None) -> V:
        name = e.func.id
        if name not in self.functions:
            raise fail(self.path, e, f"{name} is no function")
        sig = self.functions[name]
        if sig.statement:
            raise fail(self.path, e, f"{name} stands alone")
        args = self.arguments(e, sig)
        got = sig.build(Call(self, e, args, want))
        own = both(*[a.ok for a in args.values()]) if sig.propagate else None
        errors = [x for a in args.values() for x in a.errors] + [x if own is None else own & x for x in got.errors]
        return replace(got, ok=both(own, got.ok), errors=errors, secret=got.secret or any(a.secret for a in args.values()))

    def statement(self, e: ast.Call, active: Column | None) -> None:
        name = e.func.id
        sig = self.functions.get(name)
        if sig is None:
            raise fail(self.path, e, f"{name} is no function")
        if not sig.statement:
            raise fail(self.path, e, f"the result of {name} must be assigned")
        self.refs.append(0)
        if name != "WhenRules":
            sig.build(Call(self, e, self.arguments(e, sig), None))
            self.refs.pop()
            return
        given = {k.arg: k.value for k in e.keywords}
        if set(given) != {"rules_any", "then"} or not all(isinstance(x, ast.List) for x in given.values()):
            raise fail(self.path, e, "WhenRules takes the lists rules_any and then")
        rules = [self.expression(x) for x in given["rules_any"].elts]
        effects = [self.expression(x) for x in given["then"].elts]
        for r in rules:
            if r.ty.kind != "rule":
                raise fail(self.path, e, f"rules_any holds rules, not {r.ty}")
        self.refs.pop()
        passing = F.array_compact(F.array(*[F.when(v.truthy(r), F.lit(r.extra.get("name"))) for r in rules])) if rules else F.array().cast("array<string>")
        hit = F.size(passing) > 0
        hit = hit if active is None else F.coalesce(active, F.lit(False)) & hit
        made = []
        for x in effects:
            if x.ty.kind != "effect":
                raise fail(self.path, e, f"then holds effects, not {x.ty}")
            made.append(replace(x, col=x.col.withField("rules", passing)))
            told = x.extra or {}
            self.links += [(r.extra["name"], told.get("kind"), told.get("entity_type"), told.get("name"), told.get("status")) for r in rules]
            for err in x.errors:
                self.errors.append(err if active is None else active & err)
        self.effects.append((hit, made))
        failed = [F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.extra.get("name"))) for r in rules if r.ok is not None]
        fails = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
        lost = [F.when(~F.coalesce(x.ok, F.lit(False)), 1).otherwise(0) for x in effects if x.ok is not None]
        self.audit.append(
            F.when(
                F.lit(True) if active is None else F.coalesce(active, F.lit(False)),
                F.struct(
                    F.array(*[F.lit(r.extra.get("name")) for r in rules]).alias("evaluated"), passing.alias("matched"), fails.alias("failed"),
                    F.when(hit, F.lit(len(effects)) - sum(lost, F.lit(0))).otherwise(0).alias("n_effects"),
                    F.when(hit, sum(lost, F.lit(0))).otherwise(0).alias("n_effects_failed"), ((F.size(fails) > 0) | (sum(lost, F.lit(0)) > 0)).alias("degraded"),
                ),
            )
        )


@dataclass
class Call:
    """What a function sees of its call."""

    lowering: Lowering
    node: ast.Call
    args: dict[str, V]
    want: Ty | None

    def __getattr__(self, name: str) -> V:
        try:
            return self.args[name]
        except KeyError:
            raise AttributeError(name) from None

    def refuse(self, why: str) -> RuleError:
        return fail(self.lowering.path, self.node, why)


def literal(x: object, want: Ty | None = None) -> V:
    if isinstance(x, bool):
        return V(F.lit(x), BOOL, const=x)
    if isinstance(x, int):
        return V(F.lit(x).cast("bigint"), INT, const=x)
    if isinstance(x, float):
        return V(F.lit(x), FLOAT, const=x)
    if isinstance(x, str):
        return V(F.lit(x), STR, const=x)
    if isinstance(x, list):
        return V(F.array(*[F.lit(y) for y in x]), Ty("list", literal(x[0]).ty if x else STR), const=x)
    return V(F.lit(None).cast((want or STR).spark()), NONE, const=None)


def compile_rules(sources: Sources | dict[str, str], functions: dict | None = None) -> Lowered:
    """Parses, checks and lowers a ruleset."""
    from ..functions.stdlib import FUNCTIONS

    if not isinstance(sources, Sources):
        sources = Sources(sources)
    return Lowering(sources, functions or FUNCTIONS).run()


__all__ = ["INPUTS", "Call", "Feature", "Lowered", "Lowering", "RuleFile", "compile_rules", "literal"]
