"""Label state of entities: a fold of mutations in order of time, and the bulk jobs that use it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import computed

REMOVED, ADDED, MANUALLY_REMOVED, MANUALLY_ADDED = range(4)
CONFLICTING, CANNOT_OVERRIDE_MANUAL, INVALID_LABEL, INVALID_ENTITY = range(4)
#: Clock differences that are overlooked.
GRACE = timedelta(seconds=5)
REASON = "struct<pending:boolean,description:string,features:map<string,string>,created_at:timestamp,expires_at:timestamp>"
STATE = f"struct<status:int,reasons:map<string,{REASON}>,previous_states:array<struct<status:int,reasons:map<string,{REASON}>>>>"
MUTATION = "entity_type string, entity_id string, request_id bigint, at timestamp, label_name string, reason_name string, status int, pending boolean, description string, expires_at timestamp"


def expires_at(state: dict) -> datetime | None:
    """When all reasons of a state have expired; None if one never does."""
    ends = [r["expires_at"] for r in state["reasons"].values()]
    return None if any(e is None for e in ends) else max(ends)


def add_reason(reasons: dict, name: str, reason: dict) -> bool:
    """Adds or renews a reason, which keeps its first time; an older one than is there is dropped."""
    now = reasons.get(name)
    if now is None:
        reasons[name] = dict(reason)
        return True
    if now["created_at"] > reason["created_at"] + GRACE:
        return False
    reasons[name] = {**reason, "created_at": now["created_at"]}
    return True


def apply_request(labels: dict, mutations: list[dict], now: datetime) -> list[tuple[dict, int]]:
    """Changes an entity's labels by the mutations of one request; returns the dropped ones with their reasons.

    Per label only the highest status of the request counts; its reasons are merged. An expired state is replaced, a manual one
    refuses automatic changes, another status pushes the present state to the previous ones.
    """
    dropped: list[tuple[dict, int]] = []
    chosen: dict[str, list[dict]] = {}
    for m in mutations:
        name = m["label_name"]
        if not name:
            dropped.append((m, INVALID_LABEL))
            continue
        rivals = chosen.setdefault(name, [])
        if rivals and m["status"] < rivals[0]["status"]:
            dropped.append((m, CONFLICTING))
        else:
            if rivals and m["status"] > rivals[0]["status"]:
                dropped += [(x, CONFLICTING) for x in rivals]
                rivals.clear()
            rivals.append(m)
    for name, group in chosen.items():
        reasons: dict = {}
        for m in group:
            add_reason(reasons, m["reason_name"], {"pending": m["pending"], "description": m["description"], "features": m.get("features") or {}, "created_at": m["at"], "expires_at": m["expires_at"]})
        status, state = group[0]["status"], labels.get(name)
        if state is None:
            labels[name] = {"status": status, "reasons": reasons, "previous_states": []}
            continue
        end = expires_at(state)
        expired = end is not None and end + GRACE < now
        if not expired and state["status"] >= MANUALLY_REMOVED and status < MANUALLY_REMOVED:
            dropped += [(m, CANNOT_OVERRIDE_MANUAL) for m in group]
            continue
        if expired or state["status"] != status:
            if state["reasons"]:
                state["previous_states"].insert(0, {"status": state["status"], "reasons": state["reasons"]})
            state["status"], state["reasons"] = status, {}
        for r, reason in reasons.items():
            add_reason(state["reasons"], r, reason)
    return dropped


def _plain(x: object) -> object:
    if isinstance(x, pd.Timestamp):
        return None if pd.isna(x) else x.to_pydatetime()
    return None if x is pd.NaT or (isinstance(x, float) and x != x) else x


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return [{k: _plain(x) for k, x in r.items()} for r in pdf.to_dict("records")]


def mutations_of(evaluated: DataFrame) -> DataFrame:
    """Label mutations of evaluated actions: one per passing rule of each label effect that takes effect.

    ``evaluated`` needs ``__action_id``, ``__timestamp`` and ``__effects``; suppressed effects and those without an entity give none.
    """
    made = computed(evaluated, request_id=F.col("__action_id"), at=F.to_timestamp("__timestamp"), effects=F.col("__effects"))
    e = made.select("request_id", "at", F.explode("effects").alias("e")).where("e.kind = 'label' and not e.suppressed and e.entity_id is not null")
    return e.select(
        "e.entity_type", "e.entity_id", "request_id", "at", F.col("e.name").alias("label_name"), F.explode("e.rules").alias("reason_name"), "e.status", F.lit(False).alias("pending"),
        F.lit("").alias("description"), F.timestamp_micros(F.unix_micros("at") + (F.col("e.expires_after") * 1_000_000).cast("bigint")).alias("expires_at"),
    )


def fold(mutations: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """``(entity_type, entity_id, labels, dropped)``: label states after all mutations, requests in order of time and id.

    The order matters, so the mutations of an entity's label are folded one after another; labels do not touch each other, so they are
    spread over the tasks. Mutations stream through in sorted order: nothing is held but the state, however many there are. Before,
    mutations that say the same again within one request are made one. ``states`` are the states at the start. Mutations of null
    entities are left out; an empty label name is dropped and counted.
    """
    who = ["entity_type", "entity_id"]
    key = [*who, "label_name"]
    cols = [*key, "request_id", "at", "reason_name", "status", "pending", "description", "expires_at"]
    asked = mutations.where("entity_type is not null and entity_id is not null and status is not null").select(*cols).distinct()
    asked = asked.withColumn("label_name", F.coalesce("label_name", F.lit(""))).withColumn("state", F.lit(None).cast(STATE))
    if states is not None:
        none = (("request_id", "bigint"), ("at", "timestamp"), ("reason_name", "string"), ("status", "int"), ("pending", "boolean"), ("description", "string"), ("expires_at", "timestamp"))
        known = states.select(*who, F.explode("labels").alias("label_name", "s"))
        asked = asked.unionByName(known.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in none], F.col("s").cast(STATE).alias("state")))
    ordered = asked.repartition(*key).sortWithinPartitions(*key, F.col("state").isNotNull().desc(), "at", "request_id", "status", "reason_name")
    names = [*key, "state", "dropped"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, labels, dropped, request, waiting = None, {}, 0, None, []

        def settle() -> None:
            nonlocal dropped, waiting
            if waiting:
                dropped += len(apply_request(labels, waiting, waiting[0]["at"]))
                waiting = []

        for pdf in batches:
            out = []
            for r in _rows(pdf):
                k = tuple(r[c] for c in key)
                if k != at:
                    settle()
                    if at is not None:
                        out.append((*at, labels.get(at[2]), dropped))
                    at, labels, dropped, request = k, {}, 0, None
                if r["state"] is not None:
                    labels = {k[2]: _state(r["state"])}
                    continue
                if (r["at"], r["request_id"]) != request:
                    settle()
                    request = (r["at"], r["request_id"])
                waiting.append(r)
            yield pd.DataFrame(out, columns=names)
        settle()
        if at is not None:
            yield pd.DataFrame([(*at, labels.get(at[2]), dropped)], columns=names)

    one = ordered.mapInPandas(run, f"entity_type string, entity_id string, label_name string, state {STATE}, dropped int")
    some = F.collect_list(F.when(F.col("state").isNotNull(), F.struct("label_name", "state")))  # as many as the entity has labels
    return one.groupBy(*who).agg(F.map_from_entries(some).alias("labels"), F.sum("dropped").cast("int").alias("dropped"))


def _state(x: dict) -> dict:
    reasons = lambda m: {k: {a: _plain(b) for a, b in dict(r).items()} for k, r in dict(m or {}).items()}
    return {"status": x["status"], "reasons": reasons(x["reasons"]), "previous_states": [{"status": p["status"], "reasons": reasons(p["reasons"])} for p in (x["previous_states"] if x["previous_states"] is not None else [])]}


class GuardFailed(RuntimeError):
    """A bulk job found far more or fewer entities than expected."""


def bulk_targets(found: DataFrame, excluded: DataFrame | None = None, expected: int | None = None, tolerance: float = 0.1) -> DataFrame:
    """Distinct entity ids of a query's result without the excluded ones, in order; empty and null ids are left out.

    ``found`` and ``excluded`` have ``entity_id``. With ``expected`` the job fails where the count is off by more than the tolerance.
    """
    ids = found.select(F.col("entity_id").cast("string")).where("entity_id is not null and entity_id not in ('', '0')").distinct()
    if excluded is not None:
        ids = ids.join(excluded.select(F.col("entity_id").cast("string")).distinct(), "entity_id", "left_anti")
    if expected is not None:
        n = ids.count()
        if abs(n - expected) > tolerance * expected:
            raise GuardFailed(f"{n} entities found, {expected} expected")
    return ids.orderBy("entity_id")


def bulk_mutations(targets: DataFrame, entity_type: str, label: str, task_id: int, at: datetime, status: int = MANUALLY_ADDED, expires: datetime | None = None) -> DataFrame:
    """Manual mutations for every target, with a reason that names the task."""
    return targets.select(
        F.lit(entity_type).alias("entity_type"), F.col("entity_id"), F.lit(task_id).cast("bigint").alias("request_id"), F.lit(at).cast("timestamp").alias("at"), F.lit(label).alias("label_name"),
        F.lit("_BulkLabel").alias("reason_name"), F.lit(status).alias("status"), F.lit(False).alias("pending"), F.lit(f"task {task_id}").alias("description"), F.lit(expires).cast("timestamp").alias("expires_at"),
    )


def rollback_mutations(states: DataFrame, label: str, task_id: int, at: datetime, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Takes a bulk task back where its reason is the only one: a manual removal that expires in two hours."""
    state = F.element_at("labels", label)
    own = F.element_at(state["reasons"], "_BulkLabel")
    rows = states.where((F.size(state["reasons"]) == 1) & (own["description"] == f"task {task_id}") & state["status"].isin(ADDED, MANUALLY_ADDED))
    if include is not None:
        rows = rows.join(include.select("entity_id").distinct(), "entity_id", "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select("entity_id").distinct(), "entity_id", "left_anti")
    back = bulk_mutations(rows, "", label, task_id, at, MANUALLY_REMOVED, at + timedelta(hours=2)).drop("entity_type")
    return back.join(rows.select("entity_type", "entity_id"), "entity_id").select("entity_type", *back.columns)
