"""Schemas that drift between files: a lifespan catalogue of every field, one report row per change, one consistent table.

JSON payloads have no footer, so a profile plays its part: per producer, file and field path the records that hold it,
the types of its values and a small fingerprint of its content. The profile is built in one pass with partial
aggregation in Arrow batches; everything after it works on the catalogue, which grows with files and fields, not rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

#: Different values, and different outlines, a field's fingerprint keeps of one file: those of the smallest hashes, with their exact counts.
SKETCH = 512
#: Values of at least this share are kept besides; from four times this share they are compared apart from the sketch.
OFTEN = 1 / 256
#: Characters of payload whose values a task holds before they are counted and passed on.
HELD = 32 << 20
#: Share of a file's readable records that must hold a field.
PRESENT = 0.1
KINDS = ("string", "number", "boolean", "array")

_PROFILE = pa.schema([("dataset", pa.string()), ("producer", pa.string()), ("file_seq", pa.int64()), ("path", pa.string()), ("feature", pa.string()), ("n", pa.int64())])


_CLASSES = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})
_RUNS = ((re.compile("99+"), "9"), (re.compile("A[aA]+"), "A"), (re.compile("a[aA]+"), "a"))
#: Longest outline that is one feature, and the length of the pieces a longer one is taken in.
OUTLINE, PIECE = 20, 8


def _shape(text: str) -> str:
    """The whole text's outline: runs of digits, lower and upper case letters as 9, a, A; other characters as they are."""
    if not text.isascii():
        return re.sub(r"[^\W\d_]+", lambda m: "A" if m[0][0].isupper() else "a", re.sub(r"\d+", "9", text))
    text = text.translate(_CLASSES)
    for run, one in _RUNS:
        text = run.sub(one, text)
    return text


def _outlines(text: str) -> set[str]:
    """A short text's outline, or every piece of a longer one's, so that texts count whole and not by their head."""
    s = _shape(text)
    return {s} if len(s) <= OUTLINE else {s[i : i + PIECE] for i in range(len(s) - PIECE + 1)}


def _sketch(values: Counter, name: str) -> Iterator[tuple[str, int]]:
    """Hashed values with their counts: the ``SKETCH`` smallest hashes and what is frequent; under ``name#`` the count of all.

    A value among the smallest hashes of a whole file is so in every part of it, so its counts add up exactly.
    """
    total = sum(values.values())
    hashed = [(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), n) for v, n in values.items()]
    if len(hashed) > SKETCH:
        hashed.sort()
        hashed = hashed[:SKETCH] + [x for x in hashed[SKETCH:] if x[1] >= total * OFTEN]
    yield f"{name}#", total
    for h, n in hashed:
        yield f"{name}:{h}", n


def _content(by_type: dict[type, list]) -> Iterator[tuple[str, int]]:
    """Features of one field's values with their counts; a number's size and a text's length in few classes, the rest as sketches."""
    values, outlines, small = Counter(), Counter(), Counter()
    for kind, held in by_type.items():
        for value, n in Counter(held).items():
            if kind is bool:
                values[str(value)] += n
            elif kind is str:
                values[value] += n
                size = len(value)
                small[f"l:{size if size < 12 else 12 + size.bit_length()}"] += n
                for s in _outlines(value):
                    outlines[s] += n
            else:
                small[f"m:{math.floor(4 * math.log2(abs(value) + 1)) if math.isfinite(value) else 'x'}{'-' if value < 0 else ''}{'f' if kind is float else ''}"] += n
    yield from small.items()
    if values:
        yield from _sketch(values, "v")
    if outlines:
        yield from _sketch(outlines, "s")


def _fits(by_type: dict[type, list]) -> Iterator[tuple[str, int]]:
    """What a field's single values are, and what its texts could be cast to without loss, with their counts."""
    size = lambda x: "int" if abs(x) <= 1 << 53 else "wide" if -(1 << 63) <= x < 1 << 63 else "huge"
    for kind, held in by_type.items():
        for value, n in Counter(held).items():
            if kind is not str:
                yield f"f:{'boolean' if kind is bool else 'float' if kind is float else size(value)}", n
            elif value in ("true", "false"):
                yield "f:text boolean", n
            elif re.fullmatch("0|-?[1-9][0-9]{0,18}", value):
                yield f"f:text {size(int(value))}", n
            elif re.fullmatch("-?[0-9]{1,17}[.][0-9]{1,17}", value) and repr(float(value)) == value:
                yield "f:text float", n
            else:
                yield "f:text", n


def _items(value: list) -> Iterator[object]:
    """All values of a list and of the lists in it."""
    todo = [iter(value)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, list):
                todo.append(iter(x))
                break
            if isinstance(x, bool | int | float | str):
                yield x
        else:
            todo.pop()


def _leaves(obj: dict, at: str = "") -> Iterator[tuple[str, object]]:
    todo = [(at, obj)]
    while todo:
        pre, o = todo.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                todo.append((f"{pre}{k}.", v))
            else:
                yield f"{pre}{k}", v


_KIND = {str: "string", int: "number", float: "number", bool: "boolean", list: "array"}


def _described(values: list, fits: bool) -> Iterator[tuple[str, int]]:
    """All features of one field from its values in some records of a file, nulls among them."""
    yield "p", len(values)
    types = Counter(map(type, values))
    types.pop(type(None), None)
    kinds: Counter = Counter()
    for t, n in types.items():
        kinds[_KIND[t]] += n
    for k, n in kinds.items():
        yield f"t:{k}", n
    by_type = {t: [x for x in values if type(x) is t] if len(types) > 1 or n < len(values) else values for t, n in types.items()}
    lists = by_type.pop(list, None)
    if fits and by_type:
        yield from _fits(by_type)
    for x in (x for v in lists or () for x in _items(v)):
        by_type.setdefault(type(x), []).append(x)
    yield from _content(by_type)


def _profile_batches(batches: Iterator[pa.RecordBatch], fits: bool = False) -> Iterator[pa.RecordBatch]:
    import json

    decode = json.JSONDecoder().decode
    files: dict[tuple, dict[str, list]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], [], []]
        for file, fields in files.items():
            for path, values in fields.items():
                described = [("r", len(values))] if path == "" else list(_described(values, fits))
                for column, x in zip(rows, [*file, path], strict=False):
                    column += [x] * len(described)
                rows[4] += [f for f, _ in described]
                rows[5] += [n for _, n in described]
        files.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=_PROFILE.field(i).type) for i, c in enumerate(rows)], schema=_PROFILE)

    for batch in batches:
        for dataset, producer, seq, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            try:
                obj = decode(text) if text else None
            except (ValueError, RecursionError):
                continue
            if not isinstance(obj, dict):
                continue
            fields = files.setdefault((dataset, producer, seq), {"": []})
            fields[""].append(None)
            deep = False
            for key, value in obj.items():
                if type(value) is dict or not key or "." in key:
                    deep = True
                    break
            # a path may come twice where keys hold dots; its first value counts. The empty path stands for the records
            for path, value in _first(_leaves(obj)) if deep else obj.items():
                at = fields.get(path)
                if at is None:
                    fields[path] = [value]
                else:
                    at.append(value)
            held += len(text)
            if held >= HELD:
                yield flush()
                held = 0
    yield flush()


def _first(leaves: Iterator[tuple[str, object]]) -> Iterator[tuple[str, object]]:
    seen = {""}
    for path, value in leaves:
        if path not in seen:
            seen.add(path)
            yield path, value


def profile(rows: DataFrame, fits: bool = False) -> DataFrame:
    """``(dataset, producer, file_seq, path, feature, n)`` of ``rows(dataset, producer, file_seq, payload)``.

    Unreadable, empty and null payloads, and those that are no object, are no readable records.
    Feature ``r`` under the empty path counts readable records, ``p`` records with the key, ``t:`` a type's values;
    the others are content: ``l:`` and ``m:`` in few classes, ``v:`` and ``s:`` the sketches of values and outlines with ``v#`` and
    ``s#`` the counts of all; with ``fits`` also ``f:``, what the values can be cast to without loss. Rows without a dataset, producer or file belong to no file and are left out; extra columns
    are ignored.
    """
    names = rows.where("dataset is not null and producer is not null and file_seq is not null").select("dataset", "producer", F.col("file_seq").cast("bigint").alias("file_seq"), "payload")
    counted = names.mapInArrow(partial(_profile_batches, fits=fits), "dataset string, producer string, file_seq bigint, path string, feature string, n bigint")
    # all features of a field come together, so that its parts' sketches are merged and cut to size in one shuffle
    added = counted.repartition(*_FIELD).groupBy(*_FIELD, "feature").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*_FIELD, F.substring("feature", 1, 2))
    total = F.max(F.when(F.col("feature").endswith("#"), F.col("n"))).over(Window.partitionBy(*_FIELD, F.substring("feature", 1, 1)))
    ranked = added.withColumns({"rank": F.row_number().over(own.orderBy("feature")), "total": total})
    sketched = F.substring("feature", 1, 2).isin("v:", "s:")
    return ranked.where(~sketched | (F.col("rank") <= SKETCH) | (F.col("n") >= F.col("total") * OFTEN)).select(*_FIELD, "feature", "n")


_FILE = ["dataset", "producer", "file_seq"]
_FIELD = [*_FILE, "path"]


def lifespans(profiled: DataFrame, present: float = PRESENT) -> DataFrame:
    """The catalogue: ``(dataset, producer, path, kind, first_no, last_no, files_to)``, one row per unbroken run of files.

    Files are numbered per producer in order of ``file_seq``. A field is in a file when at least ``present`` of the
    readable records hold it; its kind is that of most of its non-null values (ties in the order of ``KINDS``), a file
    with nothing but nulls keeps the kind known before it, or else after it.
    """
    readable = profiled.where("path = '' and feature = 'r'").select(*_FILE, F.col("n").alias("records"))
    seq = Window.partitionBy("dataset", "producer").orderBy("file_seq")
    files = readable.withColumns({"file_no": F.row_number().over(seq), "files_to": F.count("*").over(Window.partitionBy("dataset", "producer"))})
    of = lambda k: F.sum(F.when(F.col("feature") == f"t:{k}", F.col("n")).otherwise(0))
    stats = profiled.where("path <> '' and (feature = 'p' or feature like 't:%')").groupBy(*_FIELD).agg(F.sum(F.when(F.col("feature") == "p", F.col("n"))).alias("held"), *[of(k).alias(k) for k in KINDS])
    most = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when((F.col(k) == most) & (most > 0), F.lit(k)) for k in KINDS])
    there = stats.join(files, _FILE).where(F.col("held") >= F.col("records") * F.lit(present)).select(*_FILE, "path", kind.alias("kind"), "file_no", "files_to")
    own = Window.partitionBy("dataset", "producer", "path").orderBy("file_no")
    known = F.coalesce("kind", F.last("kind", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.first("kind", True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.lit("null"))
    typed = there.withColumn("kind", known)
    goes_on = (F.lag("file_no").over(own) == F.col("file_no") - 1) & (F.lag("kind").over(own) == F.col("kind"))
    begins = typed.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    island = begins.withColumn("island", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("dataset", "producer", "path", "kind", "island").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no"), F.first("files_to").alias("files_to"), F.min("file_seq").alias("first_seq")).drop("island")


def _marks(spans: DataFrame) -> DataFrame:
    """Starts and endings of the lifespans: ``(dataset, producer, path, file_no, begins, ends)`` with the kinds that begin and end there."""
    starts = spans.where("first_no > 1").select("dataset", "producer", "path", F.col("first_no").alias("file_no"), F.col("kind").alias("begins"), F.lit(None).cast("string").alias("ends"))
    ends = spans.where("last_no < files_to").select("dataset", "producer", "path", (F.col("last_no") + 1).alias("file_no"), F.lit(None).cast("string").alias("begins"), F.col("kind").alias("ends"))
    return starts.unionByName(ends).groupBy("dataset", "producer", "path", "file_no").agg(F.max("begins").alias("begins"), F.max("ends").alias("ends"))


#: Words that say nothing about which field is meant.
_FILLERS = {"is", "the", "in", "tag", "value", "count", "data", "num"}
#: Words of one meaning; each line's first stands for it. This is the alias table of field names.
ALIASES = (
    ("user", "account", "actor", "member"),
    ("message", "msg", "body", "text", "content"),
    ("ip", "address", "net"),
    ("tag", "label", "labels"),
    ("country", "geo", "region"),
    ("locale", "lang", "language"),
    ("os", "platform", "system"),
    ("link", "url"),
    ("length", "len", "size", "seconds", "sec"),
    ("referrer", "referer", "ref"),
    ("version", "build"),
    ("type", "kind"),
    ("verified", "verify"),
    ("timezone", "tz", "zone"),
)
_ALIAS = {w: line[0] for line in ALIASES for w in line}


def name_words(path: str) -> set[str]:
    """The words of a path in one spelling, through the alias table: ``client.ipAddress`` and ``IPAddress`` share ``ip``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", lambda m: f"{m[1] or m[3]} {m[2] or m[4]}", path)
    words = {w.lower() for w in re.findall(r"[^\W_]+", spaced)}
    words = {_ALIAS.get(w, _ALIAS.get(w.rstrip("s"), w.rstrip("s") if len(w) > 3 else w)) for w in words}
    return (words - _FILLERS) or words


def name_likeness(a: str, b: str) -> float:
    """Shared words over the words of the shorter name, 0 to 1."""
    x, y = name_words(a), name_words(b)
    return len(x & y) / max(1, min(len(x), len(y)))


def _pair_up(pdf):
    """Within one file: gone and new fields are paired, the likest first, each once. Bounded by the fields of one file."""
    pdf = pdf.assign(name=[name_likeness(a, b) for a, b in zip(pdf["gone"], pdf["came"], strict=True)])
    weak = pdf["kind"].isin(["boolean", "number"])
    pdf["like"] = pdf["content"] + 0.6 * pdf["name"]
    fit = ((pdf["name"] > 0) & (pdf["content"] >= 0.25)) | (~weak & (pdf["content"] >= STRONG))
    pdf = pdf[fit].sort_values(["like", "gone", "came"], ascending=[False, True, True])
    gone: set[str] = set()
    came: set[str] = set()
    keep = []
    for a, b in zip(pdf["gone"], pdf["came"], strict=True):
        keep.append(a not in gone and b not in came)
        if keep[-1]:
            gone.add(a)
            came.add(b)
    return pdf.loc[np.array(keep, dtype=bool), ["dataset", "producer", "file_no", "gone", "came"]]


#: Content likeness from which text or array fields of unlike names are still one field.
STRONG = 0.6


def _overlap(x: dict[str, float], y: dict[str, float]) -> float:
    """The shared part of two distributions, from their shares by feature, whatever the number of records behind them.

    Frequent features are compared as they are. Of the others the same hashes are looked at on both sides, those up to the smaller
    of the two sketches' last one; what they share is carried on to all. Fields with fewer values than a sketch are compared whole.
    """
    if x.keys().isdisjoint(y):
        return 0.0
    last = min(sorted(z)[SKETCH - 1] if len(z) >= SKETCH else "~" for z in (x, y))
    often = {f for z in (x, y) for f, share in z.items() if share >= 4 * OFTEN}
    same = sum(min(x.get(f, 0.0), y.get(f, 0.0)) for f in often)
    rest_x, rest_y = (max(0.0, 1 - sum(z.get(f, 0.0) for f in often)) for z in (x, y))
    rare_x, rare_y = ({f: share for f, share in z.items() if f <= last and f not in often} for z in (x, y))
    seen = max(sum(rare_x.values()), sum(rare_y.values()))
    shared = sum(min(share, rare_y[f]) for f, share in rare_x.items() if f in rare_y)
    return same + (min(rest_x, rest_y, shared * max(rest_x, rest_y) / seen) if seen else 0.0)


def _alike(gone, came):
    """All pairs of gone and new fields of one file and kind that share a feature. Bounded by the fields of one file."""
    import pandas as pd

    def prints(pdf) -> dict[tuple, dict[str, dict[str, float]]]:
        out: dict[tuple, dict[str, dict[str, float]]] = {}
        for kind, path, c, feature, share in zip(*(pdf[x] for x in ("kind", "path", "class", "feature", "share")), strict=True):
            out.setdefault((kind, path), {}).setdefault(c, {})[feature] = share
        return out

    rows = []
    new = prints(came)
    for (kind, a), p in prints(gone).items():
        for (other, b), q in new.items():
            if kind == other:
                v, s, m, ln = (_overlap(p.get(c, {}), q.get(c, {})) for c in "vsml")
                content = max(v if kind == "boolean" else max(v, 0.7 * s + 0.3 * ln), m)
                if content > 0:
                    rows.append((gone["dataset"].iloc[0], gone["producer"].iloc[0], gone["file_no"].iloc[0], a, b, kind, content))
    return pd.DataFrame(rows, columns=["dataset", "producer", "file_no", "gone", "came", "kind", "content"])


def likenesses(profiled: DataFrame, marks: DataFrame) -> DataFrame:
    """``(dataset, producer, file_no, gone, came, kind, content)`` for gone and new fields of one file and kind.

    Content is the shared part of the two fingerprints: of the last file that held the field, and of the first file of
    the new one. Only pairs that share a feature come up; they are pairs of fields within a file, not of rows.
    """
    readable = profiled.where("path = '' and feature = 'r'").select(*_FILE)
    files = readable.withColumn("file_no", F.row_number().over(Window.partitionBy("dataset", "producer").orderBy("file_seq")))
    key = ["dataset", "producer", "file_no", "path"]
    at = profiled.where("path <> '' and (substring(feature, 1, 2) in ('v:', 's:', 'm:', 'l:') or feature in ('v#', 's#'))").join(files, _FILE).select(*key, "feature", "n")
    own = Window.partitionBy(*key, "class")

    def prints(of: DataFrame) -> DataFrame:
        total = F.coalesce(F.max(F.when(F.col("feature").endswith("#"), F.col("n"))).over(own), F.sum("n").over(own))
        return of.withColumn("class", F.substring("feature", 1, 1)).withColumn("share", F.col("n") / total).where(~F.col("feature").endswith("#")).select(*key, "kind", "class", "feature", "share")

    gone = prints(marks.where("begins is null").select(*key, F.col("ends").alias("kind")).join(at.withColumn("file_no", F.col("file_no") + 1), key))
    came = prints(marks.where("ends is null").select(*key, F.col("begins").alias("kind")).join(at, key))
    came = came.toDF(*came.columns)  # columns of its own, as both sides come from one profile
    file = key[:3]
    return gone.groupBy(*file).cogroup(came.groupBy(*file)).applyInPandas(_alike, "dataset string, producer string, file_no int, gone string, came string, kind string, content double")


def changes(profiled: DataFrame) -> DataFrame:
    """``(dataset, producer, file_seq, field_path, change_kind, new_path)``: every change between a file and the one before it.

    added, removed, type_changed, or renamed where a gone field's content goes on under a new path of the same file.
    ``new_path`` is '' but for renamed. One file, or none, gives no change. The profile is written to the checkpoint
    folder once, as several steps read it; the payloads are parsed a single time.
    """
    profiled = cut(profiled)
    marks = cut(_marks(lifespans(profiled)))
    pairs = likenesses(profiled, marks).select("dataset", "producer", "file_no", "gone", "came", "kind", "content")
    renames = pairs.groupBy("dataset", "producer", "file_no").applyInPandas(_pair_up, "dataset string, producer string, file_no int, gone string, came string")
    key = ["dataset", "producer", "file_no", "path"]
    out = renames.select(*key[:3], F.col("gone").alias("path"), F.col("came").alias("new_path"))
    into = renames.select(*key[:3], F.col("came").alias("path"))
    kind = F.when(F.col("new_path").isNotNull(), "renamed").when(F.col("begins").isNull(), "removed").when(F.col("ends").isNull(), "added").otherwise("type_changed")
    told = marks.join(into, key, "left_anti").join(out, key, "left").select(*key, kind.alias("change_kind"), F.coalesce("new_path", F.lit("")).alias("new_path"))
    readable = profiled.where("path = '' and feature = 'r'").select(*_FILE)
    files = readable.withColumn("file_no", F.row_number().over(Window.partitionBy("dataset", "producer").orderBy("file_seq")))
    return told.join(files, key[:3]).select("dataset", "producer", F.col("file_seq").cast("int").alias("file_seq"), F.col("path").alias("field_path"), "change_kind", "new_path")


def aliases(profiled: DataFrame, renames: DataFrame) -> DataFrame:
    """The alias table ``(dataset, field, column, kind)``: every path a dataset ever had, the column it belongs to, and its type.

    Paths that were renamed into one another form one column, named after the path most records hold (ties by name). Its kind is
    one that every value of it can be cast to without loss, be it a single value of a single record; else it is string. Texts
    alone stay string. ``profiled`` must have been made with ``fits``.
    """
    from .components import components

    held = profiled.where("path <> '' and feature = 'p'").groupBy("dataset", "path").agg(F.sum("n").alias("held"))
    kinds = profiled.where("path <> '' and (feature like 'f:%' or feature = 't:array')").select("dataset", "path", "feature").distinct()
    name = lambda c: F.concat_ws("\x1f", "dataset", c)
    comp = components(renames.where("change_kind = 'renamed'").select(name("field_path").alias("u"), name("new_path").alias("v")))
    fields = held.withColumn("node", name("path")).join(comp, "node", "left").withColumn("group", F.coalesce("rep", "node"))
    best = fields.groupBy("dataset", "group").agg(F.max_by("path", F.struct("held", "path")).alias("column"))
    of = fields.join(best, ["dataset", "group"]).select("dataset", F.col("path").alias("field"), "column")
    features = kinds.join(of.withColumnRenamed("field", "path"), ["dataset", "path"]).groupBy("dataset", "column").agg(F.collect_set("feature").alias("has"))
    names = lambda fs: F.array(*[F.lit(f) for f in fs])
    kind = F.coalesce(*[F.when(F.arrays_overlap("has", names(own)) & (F.size(F.array_except("has", names([*own, *texts]))) == 0), k) for k, own, texts in _CASTS])
    typed = features.select("dataset", "column", kind.alias("kind"))
    return of.join(typed, ["dataset", "column"], "left").select("dataset", "field", "column", F.coalesce("kind", F.lit("string")).alias("kind"))


#: Kinds of columns: one of the first features must be there, and none but they and the second.
_CASTS = (
    ("boolean", ["f:boolean"], ["f:text boolean"]),
    ("integer", ["f:int", "f:wide"], ["f:text int", "f:text wide"]),
    ("number", ["f:int", "f:float"], ["f:text int", "f:text float"]),
    ("array", ["t:array"], []),
)
_SQL = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.StringType()}
#: Cells of the table that are made at once.
CELLS = 2_000_000


def _cast(value: object, kind: str) -> object:
    """A value in its column's kind; ValueError where it does not fit."""
    import json

    text = isinstance(value, str)
    if kind in ("string", "array"):
        return value if text and kind == "string" else json.dumps(value, ensure_ascii=False)
    ((fit, _),) = [] if isinstance(value, list) else _fits({type(value): [value]})
    if not any(k == kind and fit in own + texts for k, own, texts in _CASTS):
        raise ValueError(value)
    return value in (True, "true") if kind == "boolean" else int(value) if kind == "integer" else float(value)


def _table_batches(batches: Iterator[pa.RecordBatch], kinds: list[str], place: dict[str, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Columns before the last one, the payload, pass through; ``place`` has each path's column and its rank there."""
    import json

    arrow = {"integer": pa.int64(), "number": pa.float64(), "boolean": pa.bool_()}

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        columns: list[list] = [[None] * n for _ in kinds]
        rest: list[str | None] = [None] * n
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            try:
                obj = json.loads(text) if text else None
            except (ValueError, RecursionError):
                obj = None
            if not isinstance(obj, dict):
                rest[i] = text
                continue
            ranks: dict[int, tuple[int, str, object]] = {}
            left: dict[str, list] = {}
            for path, value in _leaves(obj):
                if value is None:
                    continue
                at, rank = place.get(path, (-1, 0))
                try:
                    cast = _cast(value, kinds[at]) if at >= 0 else None
                except ValueError:
                    at = -1
                if at < 0:
                    left.setdefault(path, []).append(value)
                    continue
                before = ranks.get(at)
                if before is None or rank < before[0]:
                    if before is not None and columns[at][i] != cast:
                        left.setdefault(before[1], []).append(before[2])
                    ranks[at] = (rank, path, value)
                    columns[at][i] = cast
                elif columns[at][i] != cast:
                    left.setdefault(path, []).append(value)
            if left:
                rest[i] = json.dumps(left, ensure_ascii=False)
        made = [pa.array([x.encode("utf-8", "backslashreplace").decode() if x is not None and not x.isascii() else x for x in c], pa.string()) if k not in arrow else pa.array(c, arrow[k]) for c, k in zip([*columns, rest], [*kinds, "string"], strict=True)]
        names = [str(i) for i in range(batch.num_columns + len(kinds))]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *made], names=names)

    step = max(1, CELLS // (len(kinds) + 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield part(batch.slice(at, step))


def consistent_table(rows: DataFrame, keep: list[str], most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """All payloads of one dataset as one table with a column per field, and the casts ``(dataset, field, column, kind)`` it was made with.

    ``rows(dataset, producer, file_seq, payload, …)``; the columns in ``keep`` pass through. No row and no value is lost: arrays
    are JSON text, a column is of a narrower kind than string only where every value fits, and ``unplaced`` has as JSON, by path,
    what another value stands for in its column, or what belongs to no file and does not fit; of a payload that is no readable
    object it has the text. Names that differ in case only, or are taken by ``keep``, get a ``_``, which also stands for dots. The number of
    columns is that of the catalogue, which is checked against ``most``.
    """
    profiled = cut(profile(rows, fits=True))
    found = aliases(profiled, changes(profiled)).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} fields")
    taken = {c.lower() for c in [*keep, "unplaced"]}
    names: dict[str, str] = {}
    kinds: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r["column"], r["field"])):
        if r["column"] not in names:
            name = re.sub("[.`]", "_", r["column"])
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            names[r["column"]], kinds[r["column"]] = name, r["kind"]
    order = list(names)
    ranked = sorted(found, key=lambda r: (r["field"] != r["column"], r["field"]))
    place = {r["field"]: (order.index(r["column"]), i) for i, r in enumerate(ranked)}
    columns = [T.StructField(names[c], _SQL[kinds[c]]) for c in order]
    source = rows.select(*keep, "payload")
    schema = T.StructType([*source.schema.fields[:-1], *columns, T.StructField("unplaced", T.StringType())])
    table = source.mapInArrow(partial(_table_batches, kinds=[kinds[c] for c in order], place=place), _numbered(schema)).toDF(*schema.names)
    casts = rows.sparkSession.createDataFrame([(r["dataset"], r["field"], names[r["column"]], r["kind"]) for r in ranked], "dataset string, field string, column string, kind string")
    return table, casts


def _numbered(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(schema.fields)])
