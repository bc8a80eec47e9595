"""The general training-data operators against brute force, and their edge cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberglass.functions.text import readable_object, send_time_us, type_key, user_key, whole_number_key
from emberglass.operators import dedup, drift, features, lateness, sessions
from emberglass.operators.components import components
from emberglass.plans import training

DELIVERY = "delivery_id long, batch_id string, subscription string, ack_id long, action_id string, raw_message string, received_at timestamp_ntz, salt string, node string"
T0 = datetime(2022, 6, 6)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("text, key", [("12", "12"), ("+12", "12"), (" 12 ", "12"), ('"12"', "12"), ("12.0", "12"), ("0012", "12"), ("100", "100"), ("0", None), ("", None), (None, None), ("x1", None), ("0.0", None), ("-5", "-5")])
def test_whole_number(spark, text, key):
    assert one(spark, text, whole_number_key) == key


@pytest.mark.parametrize("text, key", [("CreatePost", "create_post"), ("create-post", "create_post"), ("CREATE_POST", "create_post"), (" create_post ", "create_post"), ("", None), (None, None), ("ShareInviteLink", "share_invite_link")])
def test_type_key(spark, text, key):
    assert one(spark, text, type_key) == key


def test_user_key(spark):
    assert [one(spark, x, user_key) for x in (" User_1\t", "　A", "  ", None)] == ["user_1", "a", None, None]


@pytest.mark.parametrize(
    "text, us",
    [
        ("2022-06-06T00:00:01.123456789Z", 1654473601123456), ("2022-06-06t00:00:01.123456z", 1654473601123456), ("2022-06-06 00:00:01.5", 1654473601500000), ("2022-06-06T05:45:01+05:45", 1654473601000000),
        ("1654473601123", 1654473601123000), ("2022-06-06", 1654473600000000), ("2022-13-45T99:00:00Z", None), ("T12:00Z", None), ("unknown", None), ("", None), (None, None), ("None", None),
    ],
)
def test_send_time(spark, text, us):
    assert one(spark, text, send_time_us) == us


@pytest.mark.parametrize("text, ok", [('{"a":1}', True), ('{"a":"}{"}', True), ('{"a":{"b":[1]}}}', False), ('{"a":1', False), ("[1]", False), ("", False), (None, False), ('{"a":"\\"}"}', True), ('{"a":1}{"b":2}', False)])
def test_readable_object(spark, text, ok):
    assert one(spark, text, readable_object) is ok


def brute_duplicates(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    named = []
    for r in rows:
        keys = []
        a = (r[4] or "").strip().strip('"').lstrip("+")
        a = a[:-2] if a.endswith(".0") else a
        if a and int(a):
            keys.append(("a", int(a)))
        if r[3] is not None:
            keys.append(("t", r[2], str(r[3])))
        if keys:
            named.append((r, keys[0]))
            for k in keys[1:]:
                parent[find(keys[0])] = find(k)
    groups = defaultdict(list)
    for r, k in named:
        groups[find(k)].append((r[6] is None, r[6] or T0, r[0]))
    return {x[2] for g in groups.values() for x in sorted(g)[1:]}


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        action = rng.choice([None, "", "0", str(rng.randint(1, 60)), f"+{rng.randint(1, 60)}", f'"{rng.randint(1, 60)}"', f"{rng.randint(1, 60)}.0"])
        ack = rng.choice([None, rng.randint(1, 90)])
        rows.append((i, "b", rng.choice(["s1", "s2"]), ack, action, None, rng.choice([None, T0 + timedelta(seconds=rng.randint(0, 20))]), "x", "y"))
    df = spark.createDataFrame(rows, DELIVERY)
    assert {r[0] for r in dedup.duplicates(df).collect()} == brute_duplicates(rows)
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 300 - len(brute_duplicates(rows))


def test_long_chain_is_one_message(spark):
    n = 120  # delivery i shares an action with i-1 and a token with i+1
    rows = [(i, "b", "s", 1000 + (i + 1) // 2, str(1 + i // 2), None, T0 + timedelta(seconds=i), None, None) for i in range(n)]
    assert dedup.duplicates(spark.createDataFrame(rows, DELIVERY)).count() == n - 1


def test_tokens_from_raw_messages_and_subscriptions(spark):
    raw = '{"ackId": "k", "message": {}}'
    rows = [(1, "b", "s1", None, None, raw, T0, None, None), (2, "b", "s1", None, None, raw, T0, None, None), (3, "b", "s2", None, None, raw, T0, None, None), (4, "b", "s1", None, None, "broken", T0, None, None)]
    assert [r[0] for r in dedup.duplicates(spark.createDataFrame(rows, DELIVERY)).collect()] == [2]


def test_no_deliveries(spark):
    empty = spark.createDataFrame([], DELIVERY)
    assert dedup.duplicates(empty).count() == 0 and dedup.keep_one(empty).count() == 0


def test_new_batch_against_stored(spark):
    first = spark.createDataFrame([(1, "b", "s", 7, "5", None, T0, None, None)], DELIVERY)
    kept, stored = dedup.new_messages(first, spark.createDataFrame([], "ident string"))
    assert kept.count() == 1 and stored.count() == 2
    second = spark.createDataFrame([(2, "c", "s", 7, None, None, T0, None, None), (3, "c", "s", None, "6", None, T0, None, None), (4, "c", "s", None, None, None, T0, None, None)], DELIVERY)
    kept, _ = dedup.new_messages(second, stored)
    assert sorted(r.delivery_id for r in kept.collect()) == [3, 4]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(str(rng.randint(0, 150)), str(rng.randint(0, 150))) for _ in range(110)] + [("hub", str(i)) for i in range(0, 40)]
    got = {r.node: r.rep for r in components(spark.createDataFrame(links + [(None, "1"), ("2", None)], "u string, v string")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert {k: v for k, v in got.items() if k in want} == want and len(got) == len(want)


EVENT = "user_id string, time_us long, action_id string, slot string, n string"
GAP = sessions.GAP_US


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for u, t, a, *_ in rows:
        if u is not None and t is not None:
            by[u].append((t, a))
    out = set()
    for u, ts in by.items():
        ts.sort(key=lambda x: x[0])
        run = [ts[0]]
        for x in ts[1:] + [None]:
            if x is None or x[0] - run[-1][0] > gap:
                out.add((u, run[0][0], run[-1][0], run[-1][0] - run[0][0], len(run), len({a for _, a in run if a is not None})))
                run = []
            run.append(x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "hot", "hot"]), rng.choice([None, rng.randint(-5, 40) * GAP // 3 + rng.choice([0, 0, 1])]), rng.choice([None, "1", "2", "3"]), "x", "y") for _ in range(250)]
    df = spark.createDataFrame(rows, EVENT)
    want = brute_sessions(rows, GAP)
    assert {tuple(r) for r in sessions.sessions(df).collect()} == {w[:5] for w in want}
    assert {tuple(r) for r in sessions.sessions_with_actions(df).collect()} == want


def test_session_gap_is_closed(spark):
    rows = [("a", 0, "1", "", ""), ("a", GAP, "2", "", ""), ("a", 2 * GAP + 1, "3", "", "")]
    got = sorted(tuple(r)[1:3] for r in sessions.sessions(spark.createDataFrame(rows, EVENT)).collect())
    assert got == [(0, GAP), (2 * GAP + 1, 2 * GAP + 1)]
    assert sessions.sessions(spark.createDataFrame([], EVENT)).count() == 0


RECORD = "dataset string, record_id string, action_name string, event_us long, arrival_us long, lag string"
H = lateness.HOUR_US


def test_late_records(spark):
    rows = [
        ("d", "1", "a", 10, 20, "z"), ("d", "1", "a", 10, 20, "z"), ("d", "2", "a", 10, H, "z"), ("d", "3", "a", 10, 25 * H, "z"), ("d", "4", "a", 10, 25 * H + 1, "z"), ("d", "5", "a", 10, None, "z"), ("d", "6", "a", None, 5, "z"),
        ("d", "7", None, 10, 5, "z"), ("d", "8", "a", H, 10, "z"),
    ]
    df = spark.createDataFrame(rows, RECORD)
    assert [tuple(r) for r in lateness.refused(df).collect()] == [("d", "4")]
    got = {(r.hour_start_us, r.action_name): (r.n_first, r.n_late, r.n_final, r.n_refused) for r in lateness.period_counts(df).collect()}
    assert got == {(0, "a"): (1, 2, 4, 1), (0, None): (1, 0, 1, 0), (H, "a"): (1, 0, 1, 0)}
    assert lateness.period_counts(spark.createDataFrame([], RECORD)).count() == 0


def test_corrections_by_upsert(spark):
    rows = [("d", "1", "a", 10, 20, ""), ("d", "2", "a", 10, 2 * H, ""), ("d", "3", "a", 10, 2 * H + 1, ""), ("d", "4", "a", 10, 30 * H, ""), ("d", "5", "a", 10, None, "")]
    got = sorted(((r.arrival_period, r.n_final, r.n_refused, r.last) for r in lateness.upserts(spark.createDataFrame(rows, RECORD)).collect()), key=str)
    assert got == [(0, 2, 0, False), (2, 4, 0, False), (30, 4, 1, True), (None, 1, 0, False)]


def test_a_record_id_counts_once(spark):
    rows = [("d", "1", "a", 10, 20, ""), ("d", "1", "b", 10, 15, ""), ("d", "1", "b", 2 * H, None, ""), ("d", None, "a", 10, 20, ""), ("d", None, "a", 10, 20, "")]
    got = {(r.hour_start_us, r.action_name): r.n_final for r in lateness.period_counts(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {(0, "b"): 1, (0, "a"): 2}


def test_feature_table_of_odd_names_and_times(spark):
    from datetime import datetime

    at = datetime(2024, 1, 2, 3, 4, 5, 678901)
    e = spark.createDataFrame([("u", "a.b`c", at), ("u", "x y", at), ("v", None, at), (None, "x y", at), ("w", "other", at)], "entity string, kind string, at timestamp_ntz")
    got = {r["entity"]: r.asDict() for r in features.feature_table([("e", e, None, {"n": F.count("*"), "latest": F.max("at")}, {"n": F.lit(0)}), ("z", e.limit(0), None, {"n": F.count("*")}, {})]).collect()}
    assert set(got) == {"u", "w"} and got["u"]["e_a.b`c_latest"] == at and got["u"]["e_x y_n"] == 1 and got["u"]["e_other_n"] == 0 and got["w"]["e_x y_latest"] is None
    assert features.feature_table([("e", e.limit(0), None, {"n": F.count("*")}, {})]).count() == 0


def test_feature_table(spark):
    e = spark.createDataFrame([("u", "a", 1, 2.5, "x"), ("u", "a", 3, None, "x"), ("u", "b", 2, 1.0, "x"), ("v", "c", 9, 1.0, "x"), (None, "a", 1, 1.0, "x"), ("w", None, 1, 1.0, "x")], "entity string, kind string, at long, score double, event string")
    measures = {"n": F.count("*"), "latest": F.max("at"), "total": F.coalesce(F.sum("score"), F.lit(0.0))}
    got = {r["entity"]: r.asDict() for r in features.feature_table([("event", e, ["a", "b", "zz"], measures, {"n": F.lit(0), "total": F.lit(0.0)})]).collect()}
    assert set(got) == {"u"}
    assert got["u"] == {"entity": "u", "event_a_n": 2, "event_a_latest": 3, "event_a_total": 2.5, "event_b_n": 1, "event_b_latest": 2, "event_b_total": 1.0, "event_zz_n": 0, "event_zz_latest": None, "event_zz_total": 0.0}
    with pytest.raises(features.TooManyTypes):
        features.type_list(e, "kind", most=2)
    assert features.type_list(e.limit(0), "kind") == []
    assert features.feature_table([("event", e.limit(0), [], measures, {})]).count() == 0


def drift_rows(files):
    import json

    return [("d", "p", n, json.dumps(x) if isinstance(x, dict) else x, "extra") for n, rows in files.items() for x in rows]


DRIFT = "dataset string, producer string, file_seq int, payload string, path string"


def test_drift_kinds(spark):
    rng = random.Random(5)
    user = lambda: f"user_{rng.randint(1, 50)}"
    files = {
        1: [{"user_id": user(), "n": i, "old": True, "deep": {"x": [1]}} for i in range(40)] + ["", None, '{"cut', "[1]"],
        2: [{"userId": user(), "n": str(i), "deep": {"x": [1]}, "fresh": None if i else "v", "rare": 1} if i < 3 else {"userId": user(), "n": str(i), "deep": {"x": [1]}, "fresh": "v"} for i in range(40)],
        4: [{"userId": user(), "n": None, "deep": {"x": [1]}, "fresh": "v"} for i in range(40)],
    }
    df = spark.createDataFrame(drift_rows(files), DRIFT)
    got = {tuple(r)[2:] for r in drift.changes(drift.profile(df)).collect()}
    assert got == {(2, "user_id", "renamed", "userId"), (2, "n", "type_changed", ""), (2, "old", "removed", ""), (2, "fresh", "added", "")}


def test_drift_gap_and_return(spark):
    files = {1: [{"a": 1, "b": "x"}] * 10, 2: [{"a": 1}] * 10, 3: [{"a": 1, "b": "x"}] * 10}
    got = {tuple(r)[2:] for r in drift.changes(drift.profile(spark.createDataFrame(drift_rows(files), DRIFT))).collect()}
    assert got == {(2, "b", "removed", ""), (3, "b", "added", "")}


@pytest.mark.parametrize("n", [100, 100_000])
def test_drift_is_judged_alike_whatever_the_size_of_a_file(spark, n):
    before = F.struct(F.concat(F.lit("10.1."), F.col("id") % 251, F.lit("."), F.xxhash64("id") % 97).alias("client_address"), F.concat(F.lit("user_"), F.pmod(F.xxhash64("id"), F.lit(5000))).alias("old_user"), F.sha1(F.concat(F.lit("a"), "id")).alias("first_key"))
    after = F.struct(F.concat(F.lit("/page/"), F.sha1(F.col("id").cast("string"))).alias("site_address"), F.concat(F.lit("user_"), F.pmod(F.xxhash64(F.col("id") + n), F.lit(5000))).alias("account_id"), F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)) for i in range(5)]).alias("second_key"))
    file = lambda seq, payload: spark.range(n).select(F.lit("d").alias("dataset"), F.lit("p").alias("producer"), F.lit(seq).alias("file_seq"), F.to_json(payload).alias("payload"))
    got = {tuple(r)[2:] for r in drift.changes(drift.profile(file(1, before).unionByName(file(2, after)))).collect()}
    removed, added = {(2, x, "removed", "") for x in ("client_address", "first_key")}, {(2, x, "added", "") for x in ("site_address", "second_key")}
    assert got == {(2, "old_user", "renamed", "account_id"), *removed, *added}


def test_fingerprints_of_whole_values():
    def likeness(x, y):
        p, q = (dict(drift._content({str: v})) for v in (x, y))
        total = lambda z: sum(n for f, n in z.items() if f[:2] == "s:")
        return drift._overlap(*({f: n / total(z) for f, n in z.items() if f[:2] == "s:"} for z in (p, q)))

    head = "the same words stand at the head of each of these texts "
    assert likeness([head + "1-2-3:" * 40], [head + "(A)[B]" * 40]) < 0.6
    assert list(drift._items([0, [1, ["x"]], None, {}, *range(100)])) == [0, 1, "x", *range(100)]


def test_drift_of_nothing(spark):
    assert drift.changes(drift.profile(spark.createDataFrame([], DRIFT))).count() == 0
    assert drift.changes(drift.profile(spark.createDataFrame(drift_rows({1: [None, "x"]}), DRIFT))).count() == 0


def test_consistent_table(spark):
    files = {1: [{"user_id": "user_1", "n": 1, "on": True}] * 12, 2: [{"userId": "user_1", "n": "2", "on": "false"}] * 12, 3: [{"userId": "user_2", "n": "x", "extra": [1, 2]}] * 12}
    df = spark.createDataFrame(drift_rows(files), DRIFT).withColumn("id", F.monotonically_increasing_id())
    table, casts = drift.consistent_table(df, ["id", "file_seq"])
    assert {"userId", "n", "on", "extra"} <= set(table.columns) and "user_id" not in table.columns
    rows = {r.file_seq: r for r in table.collect()}
    assert rows[1].userId == "user_1" and rows[3].userId == "user_2" and rows[2].n == "2" and rows[1].n == "1"
    assert {(r.field, r.column) for r in casts.collect()} >= {("user_id", "userId"), ("userId", "userId")}


def test_consistent_table_loses_no_value(spark):
    import json

    many = [{"n": 7, "on": True, "it's": 1, "Case": "a", "case": "b", "list": [1, "x"], "wide": 2**60, "id": "001"}] * 40
    few = [{"n": "x"}, {"n": 1.5, "on": "false", "a.b": 3, "a": {"b": 4}, "wide": "12"}, {"list": "plain"}, {"id": 5}]
    files = {1: many, 2: [{**many[0], **x} for x in few] + many + ['{"cut', None]}
    df = spark.createDataFrame(drift_rows(files), DRIFT).withColumn("id", F.lit(9))
    table, casts = drift.consistent_table(df, ["id", "file_seq"])
    rows = [r.asDict() for r in table.collect()]
    assert len(rows) == 86 and dict(table.dtypes)["on"] == "boolean" and dict(table.dtypes)["wide"] == "bigint" and dict(table.dtypes)["it's"] == "bigint"
    assert {r["n"] for r in rows} == {"7", "x", "1.5", None} and {r["on"] for r in rows} == {True, False, None} and {r["it's"] for r in rows} == {1, None}
    assert {r["list"] for r in rows} == {'[1, "x"]', "plain", None} and {r["wide"] for r in rows} == {2**60, 12, None} and {r["id_"] for r in rows} == {"001", "5", None}
    assert {(r["Case"], r["case_"]) for r in rows} == {("a", "b"), (None, None)}
    rest = [r["unplaced"] for r in rows if r["unplaced"]]
    assert '{"cut' in rest and [r["a_b"] for r in rows if r["a_b"]] + [x for r in rest if r != '{"cut' for x in json.loads(r)["a.b"]] in ([3, 4], [4, 3])
    assert ("case", "case_") in {(r.field, r.column) for r in casts.collect()}


@pytest.mark.parametrize("name, payload", [("action_requests", "action_data_json"), ("stored_results", "extracted_features")])
def test_consistent_tables_hold_every_value(spark, data, name, payload):
    import json

    source = [r.asDict() for r in spark.read.parquet(f"{data}/{name}.parquet").collect()]
    table = training.QUERIES[f"p5_table_{name}"](spark, data)
    assert table.count() == len(source)

    def values(r):
        try:
            obj = json.loads(r[payload] or "")
            return sum(v is not None for _, v in drift._leaves(obj)) if isinstance(obj, dict) else 0
        except ValueError:
            return 0

    columns = table.columns[len(source[0]) - 1 : -1]
    held = sum(r[c] is not None for r in (r.asDict() for r in table.collect()) for c in columns)
    assert held == sum(map(values, source)) > 0


def test_name_likeness():
    assert drift.name_likeness("client.ipAddress", "IPAddress") == 1.0
    assert drift.name_likeness("followers", "follower_count") == 1.0
    assert drift.name_likeness("country", "session_len") == 0.0
