"""Static types of the rule language and lowered values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule text that is refused, with its file and line."""


@dataclass(frozen=True)
class Ty:
    """``kind`` is str, int, float, bool, none, any, list, entity, timedelta, rule, effect or experiment."""

    kind: str
    item: Ty | None = None
    optional: bool = False

    def __str__(self) -> str:
        base = f"{self.kind}[{self.item}]" if self.item else self.kind
        return f"{base}?" if self.optional else base

    @property
    def plain(self) -> Ty:
        """What the value is after evaluation: an entity is its id, a rule a boolean, a time delta seconds."""
        if self.kind == "entity":
            return replace(self.item or STR, optional=self.optional)
        return {"rule": replace(BOOL, optional=self.optional), "timedelta": replace(FLOAT, optional=self.optional), "experiment": Ty("list", STR, self.optional)}.get(self.kind, self)

    @property
    def numeric(self) -> bool:
        return self.plain.kind in ("int", "float")

    def spark(self) -> str:
        p = self.plain
        return {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}.get(p.kind) or (f"array<{(p.item or STR).spark()}>" if p.kind == "list" else "string")


STR, INT, FLOAT, BOOL, NONE, ANY = (Ty(k) for k in ("str", "int", "float", "bool", "none", "any"))
TIMEDELTA, RULE, EFFECT, EXPERIMENT = (Ty(k) for k in ("timedelta", "rule", "effect", "experiment"))


def both(*oks: Column | None) -> Column | None:
    """Conjunction of success flags; None stands for always true and is folded away."""
    out = None
    for ok in oks:
        if ok is not None:
            out = ok if out is None else out & ok
    return out


@dataclass
class V:
    """A lowered expression: its value, whether it succeeded (None: always), its type, and its literal where it is constant.

    ``errors`` are conditions under which this very expression, or one below it, raised an error that is to be counted.
    """

    col: Column
    ty: Ty
    ok: Column | None = None
    const: object = field(default=..., repr=False)
    entity_type: str | None = None
    secret: bool = False
    errors: list[Column] = field(default_factory=list)
    parts: list[V] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    @property
    def is_const(self) -> bool:
        return self.const is not ...

    def held(self) -> Column:
        """The value, null where it failed."""
        return self.col if self.ok is None else F.when(self.ok, self.col)

    @property
    def can_be_null(self) -> bool:
        return self.ty.optional or self.ty.kind in ("none", "any")


def truthy(v: V) -> Column:
    """Truth of a value as in Python: null, zero and empty are false; never null."""
    k, c = v.ty.plain.kind, v.held()
    t = c if k == "bool" else c != 0 if k in ("int", "float") else c != "" if k in ("str", "any") else F.size(c) > 0 if k == "list" else F.lit(False)
    return F.coalesce(t, F.lit(False))


def as_text(v: V) -> Column:
    """Text of a value as Python writes it."""
    k = v.ty.plain.kind
    if k == "bool":
        t = F.when(v.col, "True").otherwise("False")
    elif k == "float":
        whole = (F.abs(v.col) < 1e16) & (v.col == F.floor(v.col))
        t = F.when(whole, F.concat(v.col.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(v.col.cast("string"))
    elif k == "none":
        return F.lit("None")
    elif k == "list":
        t = F.to_json(v.col)
    else:
        t = v.col.cast("string")
    return F.coalesce(F.when(v.col.isNotNull(), t), F.lit("None"))
