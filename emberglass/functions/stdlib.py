"""The functions rules may call: name, typed keyword arguments, and the column each call becomes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.values import ANY, BOOL, EFFECT, EXPERIMENT, FLOAT, INT, RULE, STR, TIMEDELTA, Ty, V, as_text, truthy
from . import arrow, domains
from .text import BLANKS


@dataclass(frozen=True)
class Param:
    name: str
    ty: Ty
    const: bool = False
    default: object = ...


@dataclass(frozen=True)
class Function:
    name: str
    params: dict[str, Param]
    build: Callable
    category: str
    statement: bool = False
    propagate: bool = True
    extra: Ty | None = None
    doc: str = ""


FUNCTIONS: dict[str, Function] = {}
_TYPES = {"str": STR, "int": INT, "float": FLOAT, "bool": BOOL, "any": ANY, "entity": Ty("entity", ANY), "timedelta": TIMEDELTA, "rule": RULE, "effect": EFFECT, "experiment": EXPERIMENT}


def _type(t: str) -> Ty:
    if t.endswith("?"):
        return replace(_type(t[:-1]), optional=True)
    if t.startswith("list["):
        return Ty("list", _type(t[5:-1]))
    return _TYPES[t]


def declare(name: str, category: str, params: str = "", **how) -> Callable:
    """Registers a function: ``params`` lists ``name:type``, ``!`` before the type for a literal and ``=`` before a default."""
    import ast

    parsed = {}
    for p in filter(None, (x.strip() for x in params.split(";"))):
        key, _, rest = p.partition(":")
        kind, eq, default = rest.partition("=")
        parsed[key] = Param(key, _type(kind.lstrip("!")), kind.startswith("!"), ast.literal_eval(default) if eq else ...)

    def wrap(build: Callable) -> Callable:
        FUNCTIONS[name] = Function(name, parsed, build, category, doc=(build.__doc__ or "").strip(), **how)
        return build

    return wrap


def simple(name: str, category: str, params: str, returns: str, column: Callable, *, may_fail: bool = False, error: bool = False) -> None:
    """A function whose column follows from its arguments' columns; where it may fail, null means failure."""
    ty = _type(returns)

    def build(c) -> V:
        out = column(c)
        ok = out.isNotNull() if may_fail else None
        return V(out, ty, ok, errors=[~ok] if may_fail and error else [])

    declare(name, category, params)(build)


def _raise_error(ok: Column) -> list[Column]:
    return [~ok]


# ---- JSON, engine, entities ----


def _json_path(c, path: str) -> str:
    """The path in the form Spark reads; only keys and positions are supported."""
    p = path if path.startswith("$") else f"$.{path}"
    if not re.fullmatch(r"\$(?:\.[\w\-@:]+|\[\d+\]|\[\s*'[^']+'\s*\]|\[\s*\"[^\"]+\"\s*\])*", p):
        raise c.refuse(f"path {path!r}: only keys and positions are supported")
    return re.sub(r"\.([\w@:]*[^\w.\[][\w\-@:]*)", lambda m: f"['{m[1]}']", p)


def from_json_data(c, want: Ty) -> V:
    """A value of the action's JSON: missing, null and wrong types are told apart as the annotation asks."""
    path = _json_path(c, c.path.const)
    required, coerce = c.required.const is not False, c.coerce_type.const is not False
    secret = "Secret" in str(c.args.get("secret"))
    source = F.col("_secret") if secret else F.col("_data")
    raw = F.try_variant_get(source, path, "variant")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit("MISSING"))
    null = kind == "VOID"
    missing = raw.isNull()
    text, number, whole = F.try_variant_get(source, path, "string"), F.try_variant_get(source, path, "double"), F.try_variant_get(source, path, "bigint")
    is_str, is_bool, is_int = kind == "STRING", kind == "BOOLEAN", kind == "BIGINT"
    is_num = is_int | (kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "FLOAT")
    t = want.plain
    if t.kind in ("str", "any"):
        exact = F.when(is_str, text)
        given = F.when(is_bool, F.when(F.try_variant_get(source, path, "boolean"), "True").otherwise("False")).when(is_int, text).when(is_num, as_text(V(number, FLOAT))).when(~null & ~missing, F.to_json(raw))
        if t.kind == "any":
            exact = F.coalesce(exact, given)
    elif t.kind == "int":
        exact = F.when(is_int, whole)
        given = F.when(is_str, F.btrim(text, F.lit(BLANKS)).try_cast("bigint")).when(is_num, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint"))
    elif t.kind == "float":
        exact = F.when(is_num, number)
        given = F.when(is_str, F.btrim(text, F.lit(BLANKS)).try_cast("double"))
    elif t.kind == "bool":
        exact = F.when(is_bool, F.try_variant_get(source, path, "boolean"))
        given = F.when(is_str, text != "").when(is_num, number != 0).when(kind.startswith("ARRAY"), F.size(F.try_variant_get(source, path, "array<variant>")) > 0).when(kind.startswith("OBJECT"), raw.cast("string") != "{}")
    elif t.kind == "list":
        exact = F.when(kind.startswith("ARRAY"), F.try_variant_get(source, path, (t if t.item else Ty("list", STR)).spark()))
        given = F.when(is_str, F.split(text, "")) if (t.item or STR).kind == "str" else F.lit(None).cast(t.spark())
    else:
        raise c.refuse(f"a value of type {want} can't come from JSON")
    value = F.coalesce(exact, given) if coerce else exact
    got = value.isNotNull()
    if want.optional:
        ok = got | missing | null
        error = ~ok
    else:
        ok = got
        error = ~got & (~(missing | null) | F.lit(required))
    return V(value, want, ok, errors=[error])


@declare("JsonData", "json", "path:!str; required:!bool=True; coerce_type:!bool=True")
def _json_data(c) -> V:
    return from_json_data(c, c.want or ANY)


@declare("EntityJson", "entity", "type:!str; path:!str; required:!bool=True; coerce_type:!bool=True")
def _entity_json(c) -> V:
    want = c.want or Ty("entity", STR)
    got = from_json_data(c, replace(want.plain if want.kind == "entity" else STR, optional=want.optional))
    return replace(got, ty=want if want.kind == "entity" else Ty("entity", STR), entity_type=c.type.const)


@declare("Entity", "entity", "type:!str; id:any")
def _entity(c) -> V:
    if c.id.ty.plain.kind not in ("str", "int", "any"):
        raise c.refuse("an entity's id is a str or an int")
    return V(c.id.col, Ty("entity", replace(c.id.ty.plain, optional=False)), c.id.col.isNotNull() if c.id.can_be_null else None, entity_type=c.type.const)


declare("GetActionId", "engine")(lambda c: V(F.col("_action_id"), INT))
declare("GetActionName", "engine")(lambda c: V(F.col("_action_name"), STR))
simple("ParseInt", "engine", "s:str", "int", lambda c: F.regexp_replace(F.btrim(c.s.col, F.lit(BLANKS)), r"(?<=\d)_(?=\d)", "").try_cast("bigint"), may_fail=True)


def batched(name: str, params: str, result: str, category: str = "batched", deterministic: bool = True) -> Callable:
    """Registers a function of one's own that takes the calls of a whole Arrow batch at once.

    It gets a pandas Series per parameter, in their order, and returns a Series as long; null for a call fails that call. A
    function that asks another service is to say that it is not deterministic, so that it is asked once.
    """

    def wrap(run: Callable) -> Callable:
        ty = _type(result)

        def build(c) -> V:
            udf = F.pandas_udf(lambda *xs: run(*xs), ty.spark())
            out = (udf if deterministic else udf.asNondeterministic())(*[c.args[p].col for p in FUNCTIONS[name].params])
            return V(out, ty, out.isNotNull())

        build.__doc__ = run.__doc__
        declare(name, category, params)(build)
        return run

    return wrap


# ---- strings ----
_S = "string"


def _strip(c, left: bool, right: bool) -> Column:
    chars = F.coalesce(c.chars.col, F.lit(BLANKS)) if c.chars.ty.kind != "none" else F.lit(BLANKS)
    return F.btrim(c.s.col, chars) if left and right else F.ltrim(c.s.col, chars) if left else F.rtrim(c.s.col, chars)


simple("StringLength", _S, "s:str", "int", lambda c: F.length(c.s.col).cast("bigint"))
simple("StringToLower", _S, "s:str", "str", lambda c: F.lower(c.s.col))
simple("StringToUpper", _S, "s:str", "str", lambda c: F.upper(c.s.col))
simple("StringStartsWith", _S, "s:str; start:str", "bool", lambda c: c.s.col.startswith(c.start.col))
simple("StringEndsWith", _S, "s:str; end:str", "bool", lambda c: c.s.col.endswith(c.end.col))
simple("StringStrip", _S, "s:str; chars:str?=None", "str", lambda c: _strip(c, True, True))
simple("StringLStrip", _S, "s:str; chars:str?=None", "str", lambda c: _strip(c, True, False))
simple("StringRStrip", _S, "s:str; chars:str?=None", "str", lambda c: _strip(c, False, True))
simple("StringReplace", _S, "s:str; old:str; new:str", "str", lambda c: F.replace(c.s.col, c.old.col, c.new.col))
simple("StringJoin", _S, "s:str; iterable:list[str]", "str", lambda c: F.call_function("array_join", c.iterable.col, c.s.col))


@declare("StringSplit", _S, "s:str; sep:str?=None; maxsplit:!int=-1")
def _split(c) -> V:
    n = c.maxsplit.const
    limit = n + 1 if n >= 0 else -1
    if c.sep.ty.kind == "none":
        body = F.btrim(c.s.col, F.lit(BLANKS)) if n < 0 else F.ltrim(c.s.col, F.lit(BLANKS))
        out = F.filter(F.split(body, r"(?U)\s+", limit), lambda x: x != "")
    else:
        quoted = F.lit(re.escape(c.sep.const)) if c.sep.is_const else F.concat(F.lit("\\Q"), c.sep.col, F.lit("\\E"))
        out = F.split(c.s.col, quoted, F.lit(limit))
    return V(out, Ty("list", STR))


@declare("StringSlice", _S, "s:str; start:!int; end:!int")
def _slice(c) -> V:
    a, b = c.start.const, c.end.const
    if not 0 <= a <= b:
        raise c.refuse("0 <= start <= end is needed")
    return V(F.substring(c.s.col, a + 1, b - a), STR)


@declare(
    "StringClean",
    _S,
    "s:str; form:!str='NFKC'; remove_emoji:!bool=False; space:!bool=True; l33t:!bool=False; homoglyph:!bool=True; unicode_normalize:!bool=True; unidecode:!bool=False; upper:!bool=False; lower:!bool=False; remove_space:!bool=False; remove_punctuation:!bool=False",
)
def _clean(c) -> V:
    return V(arrow.cleaner({k: a.const for k, a in c.args.items() if k != "s"})(c.s.col), STR)


_URL = r"""(?i)\bhttps?://[^\s<>"'\\^`{|}]+"""
_HOST = r"(?i)^https?://(?:[^/@?#]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)"
_urls = lambda s: F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(s, F.lit(_URL), 0), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")), lambda u: u.rlike(_HOST))))
simple("StringExtractURLs", _S, "s:str", "list[str]", lambda c: _urls(c.s.col))
simple("StringExtractDomains", _S, "s:str", "list[str]", lambda c: F.array_sort(F.array_distinct(F.transform(_urls(c.s.col), lambda u: F.lower(F.regexp_extract(u, _HOST, 1))))))


def java_pattern(c, pattern: str, ignore_case: bool) -> str:
    """A Python pattern in Java's dialect."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise c.refuse(f"bad pattern: {e}") from None
    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", p).replace(r"\Z", r"\z")
    return ("(?iuU)" if ignore_case else "(?U)") + p


declare("RegexMatch", _S, "target:str; pattern:!str; case_insensitive:!bool=False")(lambda c: V(c.target.col.rlike(java_pattern(c, c.pattern.const, c.case_insensitive.const)), BOOL))


@declare("RegexMatchMap", _S, "target:list[str]; pattern:!str; case_insensitive:!bool=False; mode:!str='any'")
def _match_map(c) -> V:
    p = java_pattern(c, c.pattern.const, c.case_insensitive.const)
    if c.mode.const not in ("any", "all"):
        raise c.refuse("mode is any or all")
    return V((F.exists if c.mode.const == "any" else F.forall)(c.target.col, lambda x: F.coalesce(x.rlike(p), F.lit(False))), BOOL)


@declare("CountRegexMatches", _S, "patterns:!list[str]; target:str; case_insensitive:!bool=False")
def _count_matches(c) -> V:
    out = F.lit(0).cast("bigint")
    for p in c.patterns.const:
        out = out + c.target.col.rlike(java_pattern(c, p, c.case_insensitive.const)).cast("bigint")
    return V(out, INT)


simple("TextContains", _S, "text:str; phrase:str", "bool", lambda c: F.lower(c.text.col).rlike(F.concat(F.lit("(?U)\\b\\Q"), F.lower(c.phrase.col), F.lit("\\E\\b"))) if not c.phrase.is_const else c.text.col.rlike(r"(?iuU)\b" + re.escape(c.phrase.const) + r"\b"))

# ---- encoding and hashes ----
simple("Base64Encode", "encoding", "input:str", "str", lambda c: F.base64(F.encode(c.input.col, "UTF-8")))
simple("Base64Decode", "encoding", "input:str", "str", lambda c: F.call_function("try_to_binary", c.input.col, F.lit("base64")).cast("string"), may_fail=True, error=True)
simple("HashMd5", "hash", "input:str", "str", lambda c: F.md5(c.input.col))
simple("HashSha1", "hash", "input:str", "str", lambda c: F.sha1(c.input.col))
simple("HashSha256", "hash", "input:str", "str", lambda c: F.sha2(c.input.col, 256))
simple("HashSha512", "hash", "input:str", "str", lambda c: F.sha2(c.input.col, 512))

# ---- time ----


@declare("TimeDelta", "time", "weeks:!int=0; days:!int=0; hours:!int=0; minutes:!int=0; seconds:!int=0")
def _time_delta(c) -> V:
    total = float(c.weeks.const * 604800 + c.days.const * 86400 + c.hours.const * 3600 + c.minutes.const * 60 + c.seconds.const)
    return V(F.lit(total), TIMEDELTA, const=total)


@declare("TimeSince", "time", "timestamp:str")
def _time_since(c) -> V:
    """Seconds from a written time to the action, at least 0; an offset is dropped, not converted."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(c.timestamp.col, F.lit(BLANKS)), r"(?i)\s*(z|utc|gmt|[+-]\d{2}:?\d{2})$", ""), r"^(\d{4}-\d{2}-\d{2})[tT]", "$1 ")
    at = F.unix_micros(F.concat(bare, F.when(F.length(bare) <= 10, F.lit(" 00:00:00")).otherwise(F.lit("")), F.lit("Z")).try_cast("timestamp"))
    gap = (F.unix_micros("_timestamp") - at) / F.lit(1_000_000.0)
    ok = at.isNotNull()
    return V(F.greatest(gap, F.lit(0.0)), TIMEDELTA, ok, errors=[~ok])


def _bucket(t: Column, c) -> Column:
    g = c.granularity_seconds.const
    if g < 3600:
        raise c.refuse("granularity_seconds is at least 3600")
    return t - F.pmod(t, F.lit(g).cast("bigint"))


#: The first millisecond of snowflake ids.
SNOWFLAKE_EPOCH = 1420070400000
simple("GetTimestampBucket", "time", "timestamp:int; granularity_seconds:!int", "int", lambda c: _bucket(c.timestamp.col, c))
simple("GetTimedeltaBucket", "time", "timedelta:timedelta; granularity_seconds:!int", "int", lambda c: _bucket(F.floor(c.timedelta.col).cast("bigint"), c))
simple("GetSnowflakeBucket", "time", "snowflake:int; granularity_seconds:!int", "int", lambda c: _bucket(F.floor((F.shiftright(c.snowflake.col, 22) + F.lit(SNOWFLAKE_EPOCH)) / F.lit(1000)).cast("bigint"), c))

# ---- lists ----
simple("ListLength", "list", "list:list[any]", "int", lambda c: F.size(c.list.col).cast("bigint"))


@declare("ListRead", "list", "list:list[any]; index:int=0")
def _list_read(c) -> V:
    n, i = F.size(c.list.col), c.index.col
    ok = (i < n) & (i >= -n)
    item = F.get(c.list.col, F.when(i < 0, n + i).otherwise(i).cast("int"))
    return V(as_text(V(item, replace(c.list.ty.plain.item or STR, optional=True))), STR, ok)


@declare("ListSort", "list", "list:list[any]; reverse:bool=False")
def _list_sort(c) -> V:
    ok = ~F.exists(c.list.col, lambda x: x.isNull()) | (F.size(c.list.col) < 2)
    up, down = F.sort_array(c.list.col), F.sort_array(c.list.col, asc=False)
    out = (down if c.reverse.const else up) if c.reverse.is_const else F.when(c.reverse.col, down).otherwise(up)
    return V(out, c.list.ty.plain, ok, errors=_raise_error(ok))


# ---- network, mail, phone ----
simple("DomainTld", "network", "domain:str", "str", lambda c: domains.suffix(F.lower(c.domain.col)), may_fail=True)
declare("DomainChopper", "network", "urls:list[str]; fld:!bool=False")(
    lambda c: V(F.array_compact(F.transform(c.urls.col, lambda u: domains.registrable(F.lower(F.regexp_extract(u, r"(?i)^(?:https?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))))) if c.fld.const else F.array().cast("array<string>"), Ty("list", STR))
)
_after_at = lambda e: F.when(e.contains("@"), F.nullif(F.lower(F.substring_index(e, "@", -1)), F.lit("")))
simple("EmailSubdomain", "email", "email:str", "str", lambda c: _after_at(c.email.col), may_fail=True)
simple("EmailDomain", "email", "email:str", "str", lambda c: F.coalesce(domains.registrable(_after_at(c.email.col)), _after_at(c.email.col)), may_fail=True)
simple("EmailLocalPart", "email", "email:str", "str", lambda c: F.when(c.email.col.contains("@"), F.regexp_extract(c.email.col, r"(?s)^(.*)@[^@]*$", 1)), may_fail=True)
simple("MXLookup", "network", "domain:str", "str", lambda c: arrow.mx_lookup(c.domain.col), may_fail=True)
_V4 = r"^((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){2})\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
simple("IpNetwork", "network", "ip:str", "str", lambda c: F.when(c.ip.col.rlike(_V4), F.concat(F.regexp_extract(c.ip.col, _V4, 1), F.lit(".0"))).when(c.ip.col.contains(":"), arrow.long_ipv6(c.ip.col)), may_fail=True, error=True)
simple("PhoneCountry", "phone", "phone_number:str", "str", lambda c: domains.phone_country(c.phone_number.col), may_fail=True)
simple("PhonePrefix", "phone", "phone_number:str", "str", lambda c: F.nullif(F.substring(c.phone_number.col, F.lit(1), F.greatest(F.length(c.phone_number.col) - 4, F.lit(0))), F.lit("")), may_fail=True)


@declare("ExtractCookie", "http", "header:str; key:!str")
def _cookie(c) -> V:
    p = rf"(?:^|;)\s*{re.escape(c.key.const)}\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^;,\s]*))"
    got = F.concat(F.regexp_extract(c.header.col, p, 1), F.regexp_extract(c.header.col, p, 2))
    return V(got, STR, c.header.col.rlike(p))


# ---- random ----


@declare("RandomBool", "random", "percentage:!float")
def _random_bool(c) -> V:
    if not 0 < c.percentage.const < 1:
        raise c.refuse("0 < percentage < 1 is needed")
    return V(F.rand() < c.percentage.const, BOOL)


@declare("RandomInt", "random", "start:!int; end:!int")
def _random_int(c) -> V:
    a, b = c.start.const, c.end.const
    if a >= b:
        raise c.refuse("start < end is needed")
    return V((F.floor(F.rand() * (b - a + 1)) + a).cast("bigint"), INT)


# ---- rules, effects, experiments ----
declare("Import", "engine", statement=True)(lambda c: None)
declare("Require", "engine", statement=True)(lambda c: None)
declare("WhenRules", "rules", "rules_any:list[rule]; then:list[effect]", statement=True)(lambda c: None)


@declare("Rule", "rules", "when_all:list[any]; description:str")
def _rule(c) -> V:
    """True when all of ``when_all`` hold; failed when any of them failed."""
    if not c.lowering.target or c.lowering.target.startswith("_"):
        raise c.refuse("a rule is assigned to a name that is no local")
    out = F.lit(True)
    for x in c.when_all.parts:
        out = out & truthy(replace(x, ok=None))
    name = c.lowering.target
    c.lowering.rules[name] = str(c.description.const) if c.description.is_const else ""
    return V(out, RULE, c.when_all.ok, extra={"name": name, "description": c.description.col})


def _label(status: int) -> Callable:
    def build(c) -> V:
        c.lowering.check_label(c)
        e = c.entity
        gate = c.args["apply_if"]
        seconds = lambda x: F.lit(None).cast("double") if x.ty.kind == "none" else x.col.cast("double")
        suppressed = F.lit(False) if gate.ty.kind == "none" else ~F.coalesce(gate.col, F.lit(False))
        col = F.struct(
            F.lit("label").alias("kind"), F.lit(e.entity_type).alias("entity_type"), e.col.cast("string").alias("entity_id"), c.label.col.alias("name"), F.lit(status).alias("status"),
            seconds(c.args["delay_action_by"]).alias("delay"), seconds(c.args["expires_after"]).alias("expires_after"), suppressed.alias("suppressed"), F.array().cast("array<string>").alias("rules"),
        )
        return V(col, EFFECT, extra={"kind": "label", "entity_type": e.entity_type, "name": c.label.const, "status": status})

    return build


_LABEL_ARGS = "entity:entity; label:!str; delay_action_by:timedelta?=None; apply_if:rule?=None; expires_after:timedelta?=None"
declare("LabelAdd", "labels", _LABEL_ARGS)(_label(1))
declare("LabelRemove", "labels", _LABEL_ARGS)(_label(0))


def _effect(kind: str, entity_type: Column, entity_id: Column, name: Column) -> V:
    none = F.lit(None)
    return V(
        F.struct(
            F.lit(kind).alias("kind"), entity_type.cast("string").alias("entity_type"), entity_id.cast("string").alias("entity_id"), name.alias("name"), none.cast("int").alias("status"), none.cast("double").alias("delay"),
            none.cast("double").alias("expires_after"), F.lit(False).alias("suppressed"), F.array().cast("array<string>").alias("rules"),
        ),
        EFFECT,
        extra={"kind": kind},
    )


declare("DeclareVerdict", "verdicts", "verdict:str")(lambda c: replace(_effect("verdict", F.lit(None), F.lit(None), c.verdict.col), extra={"kind": "verdict", "name": c.verdict.const if c.verdict.is_const else None}))
declare("BanUser", "effects", "entity:entity; comment:str")(lambda c: _effect("ban", F.lit(c.entity.entity_type), c.entity.col, c.comment.col))


@declare("HasLabel", "labels", "entity:entity; label:!str; manual:!bool?=None; status:!str='added'; min_label_age:timedelta?=None; error_on_empty:!bool=False")
def _has_label(c) -> V:
    """Whether the entity has the label as of the start of the batch."""
    c.lowering.check_label(c)
    if c.status.const not in ("added", "removed"):
        raise c.refuse("status is added or removed")
    wanted, manual = c.status.const, c.manual.const
    state = F.element_at(c.lowering.labels_of(c.entity), c.label.const)
    now = F.col("_timestamp")
    reasons = F.map_values(state["reasons"])
    alive = F.filter(reasons, lambda r: r["expires_at"].isNull() | (r["expires_at"] > now))
    there = state.isNotNull() & (F.coalesce(F.size(alive), F.lit(0)) > 0)
    codes = {("added", None): [1, 3], ("added", False): [1], ("added", True): [3], ("removed", None): [0, 2], ("removed", False): [0], ("removed", True): [2]}[wanted, manual]
    hit = state["status"].isin(codes)
    if c.min_label_age.ty.kind != "none":
        oldest = F.array_min(F.filter(F.transform(alive, lambda r: F.unix_micros(r["created_at"])), lambda x: x.isNotNull()))
        hit = hit & (F.unix_micros(now) - oldest > c.min_label_age.col * 1_000_000)
    value = F.when(there, F.coalesce(hit, F.lit(False))).otherwise(F.lit(wanted == "removed" and manual is not True))
    return V(value, BOOL, c.entity.col.isNotNull() if c.entity.can_be_null else None)


#: Units that experiment buckets are measured in.
GRANULARITY = 10_000
NOT_IN = "not_in_experiment"


@declare("Experiment", "experiments", "entity:entity; buckets:!list[str]; bucket_sizes:!list[float]; version:!int; revision:!int")
def _experiment(c) -> V:
    name = c.lowering.target
    buckets, sizes = c.buckets.const, c.bucket_sizes.const
    if not name or name.startswith("_"):
        raise c.refuse("an experiment is assigned to a name that is no local")
    if len(buckets) != len(sizes) or not 1 <= len(buckets) <= 10:
        raise c.refuse("buckets and bucket_sizes go together, ten at most")
    share = GRANULARITY // len(buckets)
    unit = arrow.murmur3(F.concat(F.lit(f"{name}/"), c.entity.col.cast("string"))) % GRANULARITY
    at = F.floor(unit / F.lit(share)).cast("int")
    bucket, index = F.lit(NOT_IN), F.lit(-1)
    for i, (b, size) in reversed(list(enumerate(zip(buckets, sizes, strict=True)))):
        inside = (at == i) & (unit < int(round(size * 100)) + share * i)
        bucket, index = F.when(inside, b).otherwise(bucket), F.when(inside, i).otherwise(index)
    row = F.array(F.lit(name), c.entity.col.cast("string"), F.lit(c.entity.entity_type), bucket, index.cast("string"), F.lit(str(c.version.const)), F.lit(str(c.revision.const)))
    return V(row, EXPERIMENT, c.entity.col.isNotNull() if c.entity.can_be_null else None, extra={"buckets": buckets})


FUNCTIONS["ExperimentsBucketAssignment"] = replace(FUNCTIONS["Experiment"], name="ExperimentsBucketAssignment")


@declare("ExperimentWhen", "experiments", "experiment:experiment", extra=Ty("list", BOOL))
def _experiment_when(c) -> V:
    cases = {k: a for k, a in c.args.items() if k != "experiment"}
    known = c.experiment.extra.get("buckets")
    if "control" not in cases or (known and set(cases) - set(known) - {"control"}):
        raise c.refuse("one list per bucket, control among them")
    at = F.element_at(c.experiment.col, 4)
    out = cases["control"].held()
    for k, a in cases.items():
        if k != "control":
            out = F.when(at == k, a.held()).otherwise(out)
    return V(out, Ty("list", BOOL), out.isNotNull())


@declare("ResolveOptional", "engine", "optional_value:any?; default_value:any?=None; should_report_error:!bool=False", propagate=False)
def _resolve(c) -> V:
    a, d = c.optional_value, c.default_value
    ty = replace(a.ty if a.ty.kind != "none" else d.ty, optional=False)
    out = a.held() if d.ty.kind == "none" else F.coalesce(a.held(), d.held().cast(ty.spark()))
    ok = out.isNotNull()
    return V(out, ty, ok, entity_type=a.entity_type, errors=[~ok] if c.should_report_error.const else [])


