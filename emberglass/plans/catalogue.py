"""What a ruleset holds, as tables: features, rules, functions, and what depends on what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stdlib import FUNCTIONS
from ..lang.lower import Lowered


def features(spark: SparkSession, rules: Lowered) -> DataFrame:
    """``(feature, file, type, entity_type, extracted)``."""
    rows = [(f.name, f.path, str(f.value.ty), f.value.entity_type, f.keep) for f in rules.features]
    return spark.createDataFrame(rows, "feature string, file string, type string, entity_type string, extracted boolean")


def rule_list(spark: SparkSession, rules: Lowered) -> DataFrame:
    """``(rule, description)``."""
    return spark.createDataFrame(sorted(rules.rules.items()), "rule string, description string")


def function_list(spark: SparkSession) -> DataFrame:
    """``(function, category, arguments)``."""
    rows = [(f.name, f.category, [f"{p.name}: {p.ty}" for p in f.params.values()]) for f in FUNCTIONS.values()]
    return spark.createDataFrame(rows, "function string, category string, arguments array<string>")


def edges(spark: SparkSession, rules: Lowered) -> DataFrame:
    """``(feature, depends_on)``, direct uses."""
    return spark.createDataFrame([(a, b) for a, bs in sorted(rules.depends.items()) for b in sorted(bs)], "feature string, depends_on string")


def closure(rules: Lowered) -> dict[str, set[str]]:
    """All a feature depends on, directly or not. The graph is that of a rule text, so it stays on the driver."""
    out: dict[str, set[str]] = {}

    def of(name: str) -> set[str]:
        if name not in out:
            out[name] = set()
            for d in rules.depends.get(name, ()):
                out[name] |= {d} | of(d)
        return out[name]

    for n in rules.depends:
        of(n)
    return out


def dependencies(spark: SparkSession, rules: Lowered) -> DataFrame:
    """``(feature, depends_on, depended_on_by)``, both transitive and sorted."""
    pairs = [(a, b) for a, bs in closure(rules).items() for b in bs]
    down = spark.createDataFrame(pairs, "a string, b string")
    names = spark.createDataFrame([(n,) for n in rules.depends], "feature string")
    on = down.groupBy(F.col("a").alias("feature")).agg(F.array_sort(F.collect_set("b")).alias("depends_on"))
    by = down.groupBy(F.col("b").alias("feature")).agg(F.array_sort(F.collect_set("a")).alias("depended_on_by"))
    none = F.array().cast("array<string>")
    return names.join(on, "feature", "left").join(by, "feature", "left").select("feature", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by"))


def rules_by_label(spark: SparkSession, rules: Lowered) -> DataFrame:
    """``(label, entity_type, status, rule, features)``: the rules that may add (1) or remove (0) a label, and all the features they rest on."""
    below = closure(rules)
    rows = sorted({(name, entity, status, rule) for rule, kind, entity, name, status in rules.links if kind == "label"})
    return spark.createDataFrame([(*r, sorted(below.get(r[3], ()))) for r in rows], "label string, entity_type string, status int, rule string, features array<string>")


def rules_by_action(spark: SparkSession, rules: Lowered, folder: str = "actions/") -> DataFrame:
    """``(action, rule)``: the rules that files named after an action bring in; files below the folder are named after one."""

    def below(path: str) -> set[str]:
        seen, todo = set(), [path]
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += rules.files[p][0] if p in rules.files else []
        return seen

    rows = {(p[len(folder) :].rsplit(".", 1)[0], n) for p in rules.files if p.startswith(folder) for q in below(p) for n in rules.files.get(q, ([], []))[1] if n in rules.rules}
    return spark.createDataFrame(sorted(rows), "action string, rule string")


def merge_history(stored: DataFrame, now: DataFrame, at: str) -> DataFrame:
    """A dependency table that keeps its history: ``(feature, content, valid_from, valid_to)``.

    Rows of a feature whose content has changed end at ``at``; a feature without an open row gets one. An open row ends in 9999.
    """
    far = F.lit("9999-12-31 23:59:59").cast("timestamp")
    when = F.lit(at).cast("timestamp")
    fresh = now.select("feature", F.col("content").alias("new_content"))
    ended = stored.join(fresh, "feature", "left").withColumn("valid_to", F.when(F.col("new_content").isNotNull() & (F.col("new_content") != F.col("content")), when).otherwise(F.col("valid_to"))).drop("new_content")
    open_rows = ended.where(F.col("valid_to") == far).select("feature").distinct()
    added = now.join(open_rows, "feature", "left_anti").select("feature", "content", when.alias("valid_from"), far.alias("valid_to"))
    return ended.select("feature", "content", "valid_from", "valid_to").unionByName(added)


def query_lineage(queries: DataFrame, saved_query_id: int, limit: int = 10) -> DataFrame:
    """The latest queries that led to a saved one: ``queries(id, parent_id, query)``, followed from child to parent."""
    queries.createOrReplaceTempView("emberglass_queries")
    return queries.sparkSession.sql(
        f"""with recursive line as (select id, parent_id, query from emberglass_queries where id = {int(saved_query_id)}
        union all select q.id, q.parent_id, q.query from emberglass_queries q join line on q.id = line.parent_id)
        select distinct id, parent_id, query from line order by id desc limit {int(limit)}"""
    )
