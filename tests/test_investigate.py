"""Investigation queries, label state, bulk jobs, sources, sinks and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberglass.lang.lower import compile_rules
from emberglass.lang.values import FLOAT, INT, STR, RuleError, Ty
from emberglass.operators import labels
from emberglass.plans import catalogue, rules
from emberglass.plans.investigate import Ability, Predicate, Query, censor_json, granularity_for, latency_stats, results_by_id, validate
from emberglass.sources import actions
from emberglass.streaming import engine, late

TYPES = {"A": INT, "B": INT, "F": FLOAT, "Email": STR, "Tags": Ty("list", STR), "C": Ty("int", optional=True)}
ROWS = [(1, 1, 1.5, "Boop@gmail.com", ["x"], 5), (2, 3, -20.0, "a@b.c", [], None), (3, 3, None, None, None, 1), (-1, 2, 7.0, "z@GMAIL.com", ["y", "Xx"], 2)]


def ids(spark, text, **how):
    df = spark.createDataFrame(ROWS, "A long, B long, F double, Email string, Tags array<string>, C long")
    return sorted(r.A for r in df.where(Predicate(TYPES, **how).compile(text)).collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("A == B", [1, 3]), ("A != B", [-1, 2]), ("A == B or (C == 2 and F >= 2)", [-1, 1, 3]), ("C not in [3, 4, 5]", [-1, 3]), ("'gmail.com' in Email", [-1, 1]), ("'boop' not in Email", [-1, 2]), ("C == None", [2]), ("C != None", [-1, 1, 3]), ("RegexMatch(target=Email, pattern='^a')", [2]),
        ("not A == 1", [-1, 2, 3]), ("A == -1", [-1]), ("F > -10.0", [-1, 1]), ("-10.0 > F", [-1, 1]), ("C in [None, 5]", [1, 2]), ("Tags == 'x'", [1]), ("'x' in Tags", [-1, 1]), ("Email == 'a@b.c'", [2]), ("Email < 'b'", [1, 2]),
    ],
)
def test_predicates(spark, text, want):
    assert ids(spark, text) == want


def test_operand_order_switch(spark):
    assert ids(spark, "-10.0 > F", keep_operand_order=False) == [2]


@pytest.mark.parametrize("text", ["A", "1 == 1", "A + 1", "Nope == 1", "A < B", "A == 1; B == 2", "A < None", "A < 'x'", "Foo(x=1)", "RegexMatch(target=Email, pattern='(')", "DidAddLabel(entity_type='x')", "A = 1", "'x' in 'xy'", "f'{A}' == 'x'"])
def test_refused_queries(text):
    with pytest.raises(RuleError):
        Predicate(TYPES).compile(text)
    assert validate(text, TYPES) and validate("A == 1", TYPES) is None


def test_effect_predicates(spark):
    df = spark.createDataFrame([(1, ["User/spam/1"], ["reject"]), (2, ["User/spam/0"], None), (3, None, None), (4, ["superUser/spam/1"], [])], "i long, __entity_label_mutations array<string>, __verdicts array<string>")
    got = lambda q: sorted(r.i for r in df.where(Predicate({}).compile(q)).collect())
    assert got("DidAddLabel(entity_type='User', label_name='spam')") == [1, 4]
    assert got("DidRemoveLabel(entity_type='User', label_name='spam')") == [2]
    assert got("not DidDeclareVerdict(verdict='reject')") == [2, 3, 4]


def events(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), i, "click" if i % 3 else None, i % 5, i / 7) for i in range(200)]
    return spark.createDataFrame(rows, "__time timestamp_ntz, __action_id long, ActionName string, U long, V double")


def query(spark, text="", **how):
    return Query(events(spark), {"ActionName": STR, "U": INT, "V": FLOAT}, datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 12), text, entity_types={"U": "User"}, **how)


def test_pages_cover_everything_once(spark):
    for ascending in (True, False):
        q, after, seen = query(spark), None, []
        while True:
            rows, after = q.page(7, ascending, after)
            seen += [r["__action_id"] for r in rows]
            if after is None:
                break
        whole = [r["__action_id"] for r in q.rows().collect()]
        assert seen == sorted(whole, reverse=not ascending) and len(seen) == 51


def test_counts(spark):
    q = query(spark, "U == 4")
    zero = {r.bucket.hour: r["count"] for r in q.timeseries("hour").collect()}
    assert sorted(zero) == list(range(6, 12)) and sum(zero.values()) == q.rows().count()
    quarter = query(spark).timeseries("fifteen_minute").collect()
    assert len(quarter) == 24 and {r.bucket.minute for r in quarter} == {0, 15, 30, 45}
    with pytest.raises(ValueError):
        Query(events(spark), {}, datetime(2024, 1, 2), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        query(spark).timeseries("fortnight")
    top = query(spark).topn("ActionName").collect()
    assert [r.dimension for r in top] == ["click", None]
    assert query(spark).topn("V", precision=0.5).first().dimension.startswith("~")
    change = {r.dimension: r for r in query(spark).topn_change("U").collect()}
    assert all(r.difference == r["count"] - r.previous for r in change.values())
    assert query(spark).cardinality("U", exact=True).first().cardinality == 5
    assert query(spark, entity=("User", 3)).rows().count() == query(spark, "U == 3").rows().count()
    assert query(spark, entity=("Guild", 3)).rows().count() == 0
    assert query(spark, ability=Ability("v")).rows().count() == 0
    assert query(spark, ability=Ability("v", allow_all=True)).rows().count() == 51


def test_whole_span_queries_read_all_events(spark, data):
    table = spark.read.parquet(f"{data}/events.parquet")
    run = lambda name: rules.QUERIES[name](spark, data).collect()
    assert sum(r["count"] for r in run("q_whole_timeseries_day")) == table.where("ts is not null").count()
    assert run("q_whole_cardinality_exact")[0]["cardinality"] == table.select("user_id").distinct().count()
    most = table.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(20).collect()
    assert [(r["dimension"], r["count"]) for r in run("q_whole_topn_users")] == [(r["user_id"], r["count"]) for r in most]


def test_granularity():
    day = datetime(2024, 1, 1)
    assert granularity_for(day, day + timedelta(days=365)) == "month" and granularity_for(day, day + timedelta(hours=10)) == "hour" and granularity_for(day, day + timedelta(minutes=3)) == "minute"


def test_censoring(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": 2}]}, "d": 1}',), ("broken",), (None,)], "j string")
    got = [r[0] for r in df.select(censor_json("j", ["a.b"], "#")).collect()]
    assert json.loads(got[0]) == {"a": {"b": ["#", {"c": "#"}]}, "d": 1} and got[1:] == ['"#"', None]


def test_lookup_and_latency(spark):
    stored = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 3)), (3, None)], "id long, stored_timestamp timestamp_ntz")
    assert [r.id for r in results_by_id(stored, spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")).collect()] == [2, 1]
    r = latency_stats(spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double"), "ms").first()
    assert (r.min, r.p50, r.p95, r.p99, r.max) == (1, 50, 95, 99, 100)


# ---- labels ----
NOW = datetime(2024, 1, 1)


def mutation(label="spam", status=labels.ADDED, reason="r", at=NOW, expires=None):
    return {"label_name": label, "status": status, "reason_name": reason, "pending": False, "description": "", "at": at, "expires_at": expires}


def test_conflicts_within_a_request():
    state = {}
    dropped = labels.apply_request(state, [mutation(status=labels.REMOVED), mutation(), mutation(reason="s"), mutation(label="")], NOW)
    assert state["spam"]["status"] == labels.ADDED and set(state["spam"]["reasons"]) == {"r", "s"}
    assert sorted(r for _, r in dropped) == [labels.CONFLICTING, labels.INVALID_LABEL]


def test_manual_refuses_automatic_until_expired():
    state = {}
    labels.apply_request(state, [mutation(status=labels.MANUALLY_REMOVED, expires=NOW + timedelta(hours=1))], NOW)
    assert [r for _, r in labels.apply_request(state, [mutation(at=NOW + timedelta(minutes=1))], NOW + timedelta(minutes=1))] == [labels.CANNOT_OVERRIDE_MANUAL]
    later = NOW + timedelta(hours=2)
    assert labels.apply_request(state, [mutation(at=later)], later) == []
    assert state["spam"]["status"] == labels.ADDED and state["spam"]["previous_states"][0]["status"] == labels.MANUALLY_REMOVED


def test_reasons_merge_and_keep_their_first_time():
    state = {}
    labels.apply_request(state, [mutation()], NOW)
    later = NOW + timedelta(minutes=5)
    labels.apply_request(state, [mutation(at=later, expires=later), mutation(reason="s", at=later)], later)
    assert state["spam"]["reasons"]["r"] == {"pending": False, "description": "", "features": {}, "created_at": NOW, "expires_at": later} and state["spam"]["previous_states"] == []
    labels.apply_request(state, [mutation(at=NOW - timedelta(hours=1))], later)
    assert state["spam"]["reasons"]["r"]["expires_at"] == later  # older than what is there
    labels.apply_request(state, [mutation(status=labels.REMOVED, at=later)], later)
    assert state["spam"]["status"] == labels.REMOVED and len(state["spam"]["previous_states"]) == 1


MUT = labels.MUTATION


def test_fold_equals_one_by_one(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(200):
        at = NOW + timedelta(minutes=rng.randint(0, 90))
        rows.append(("User", rng.choice(["a", "b", "c", None]), i // 2, at, rng.choice(["x", "y", ""]), rng.choice("rs"), rng.choice([0, 1, 1, 2, 3]), False, "", rng.choice([None, at + timedelta(minutes=20)])))
    df = spark.createDataFrame(rows, MUT)
    got = {r.entity_id: r.asDict(recursive=True) for r in labels.fold(df).collect()}
    cols = [f.split()[0] for f in MUT.split(", ")]
    for who in "abc":
        state, own = {}, sorted({r for r in rows if r[1] == who}, key=lambda r: (r[3], r[2], r[4], r[6], r[5]))
        while own:
            key = (own[0][3], own[0][2])
            batch = [r for r in own if (r[3], r[2]) == key]
            labels.apply_request(state, [dict(zip(cols, r, strict=True)) for r in batch], key[0])
            own = own[len(batch) :]
        want = {k: (v["status"], {n: (x["created_at"], x["expires_at"]) for n, x in v["reasons"].items()}, len(v["previous_states"])) for k, v in state.items()}
        have = {k: (v["status"], {n: (x["created_at"], x["expires_at"]) for n, x in v["reasons"].items()}, len(v["previous_states"])) for k, v in got[who]["labels"].items()}
        assert have == want
    half = df.where("request_id < 50")
    assert set(got) == {"a", "b", "c"} and labels.fold(df.limit(0)).count() == 0
    again = labels.fold(df.where("request_id < 0"), labels.fold(half))
    assert {r.entity_id: set(r.labels) for r in again.collect()} == {r.entity_id: set(r.labels) for r in labels.fold(half).collect()}


def test_bulk_job_and_rollback(spark):
    found = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), ("",), (None,)], "entity_id string")
    targets = labels.bulk_targets(found, spark.createDataFrame([("3",)], "entity_id string"), expected=2)
    assert [r[0] for r in targets.collect()] == ["1", "2"]
    with pytest.raises(labels.GuardFailed):
        labels.bulk_targets(found, expected=10)
    other = spark.createDataFrame([("User", "2", 5, NOW, "spam", "why", 3, False, "", None)], MUT)
    states = labels.fold(labels.bulk_mutations(targets, "User", "spam", 7, NOW).unionByName(other)).persist()
    assert {r.entity_id: r.labels["spam"].status for r in states.collect()} == {"1": 3, "2": 3}
    back = labels.rollback_mutations(states, "spam", 7, NOW + timedelta(hours=1))
    assert [(r.entity_type, r.entity_id, r.status) for r in back.collect()] == [("User", "1", labels.MANUALLY_REMOVED)]
    after = {r.entity_id: r.labels["spam"].status for r in labels.fold(back, states).collect()}
    assert after == {"1": labels.MANUALLY_REMOVED, "2": 3}


# ---- sources and streams ----
def test_sources(spark, tmp_path):
    good = '{"send_time": "2022-06-06T00:00:01Z", "data": {"action_id": "5", "action_name": "post", "data": {"user_id": "u"}}}'
    lines = [good, good.replace('"5"', '"x"'), "broken", '{"send_time": "soon", "data": {"action_id": 1, "action_name": "p", "data": {}}}', '{"data": {}}', ""]
    got = actions.from_envelopes(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")).collect()
    assert [r.action_id for r in got][0] == 5 and len(got) == 2 and json.loads(got[0].data) == {"user_id": "u"} and got[0].secret_data is None
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "n", "data": {"a": 1}}\nnope\n')
    assert [(r.action_id, r.action_name) for r in actions.read(spark, "json_lines", path=str(tmp_path)).collect()] == [(1, "n")]
    assert actions.read(spark, "synthetic", rows=10).count() == 10
    with pytest.raises(ValueError):
        actions.read(spark, "pigeon")
    made = actions.synthetic(spark, 500)
    assert actions.sample(made, {"create_post": 100}).count() == 500 and actions.sample(made, {"create_post": 0}).count() == 0 and actions.sample(made, {"create_post": 90}).count() < 150
    assert actions.skip_marked(made.withColumn("data", F.lit('{"skip": true}')), "skip").count() == 0


RULES = {"main.sml": "U: Entity[str] = EntityJson(type='User', path='$.u')\nHi = Rule(when_all=[not HasLabel(entity=U, label='seen')], description='x')\nWhenRules(rules_any=[Hi], then=[LabelAdd(entity=U, label='seen'), DeclareVerdict(verdict='new')])\n"}


def test_rules_over_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    line = lambda i, u: json.dumps({"id": i, "name": "n", "data": {"u": u}})
    failures = []

    def flaky(df, batch):
        failures.append(batch)
        if len(failures) == 1:
            raise OSError("try again")

    table = engine.LabelTable(str(tmp_path / "labels"))
    sinks = [engine.Sink("flaky", flaky), engine.parquet_sink(str(out)), engine.stored_result_sink(str(tmp_path / "stored")), engine.csv_sink(str(tmp_path / "csv"))]
    verdicts = []
    for n, users in enumerate((["a", "b"], ["a", "c"])):
        (source / f"{n}.json").write_text("\n".join(line(10 * n + i, u) for i, u in enumerate(users)))
        stream = actions.read(spark, "json_lines", stream=True, path=str(source))
        engine.run(stream, compile_rules(RULES), sinks, str(tmp_path / "check"), table).awaitTermination()
        verdicts.append({r["U"]: r["__verdicts"] for r in spark.read.parquet(f"{out}/batch={n}").collect()})
    assert verdicts == [{"a": ["new"], "b": ["new"]}, {"a": None, "c": ["new"]}]
    assert {r.entity_id for r in table.read(spark, 2).collect()} == {"a", "b", "c"} and failures == [0, 0, 1]
    assert spark.read.parquet(f"{tmp_path}/stored").count() == 4


def test_late_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    from emberglass.operators import lateness

    h = lateness.HOUR_US
    rows = [("d", str(i), "a" if i % 2 else None, (i % 3) * h + 5, (i % 40) * h) for i in range(120)] + [("d", "n", "a", None, 1), ("d", "m", "a", 5, None)]
    df = spark.createDataFrame(rows, "dataset string, record_id string, action_name string, event_us long, arrival_us long")
    folder = str(tmp_path / "late")
    for n in range(3):
        late.write_batch(df.where(F.pmod(F.hash("record_id"), F.lit(3)) == n), n, folder)
    late.write_batch(df.where(F.pmod(F.hash("record_id"), F.lit(3)) == 1), 1, folder)
    want = {(r.hour_start_us, r.action_name): r.n_final for r in lateness.period_counts(df).collect() if r.n_final}
    assert {(r.window_start_us, r.action_name): r.n_final for r in late.counts(spark, folder).collect()} == want
    assert {r.record_id for r in late.refused(spark, folder).collect()} == {r.record_id for r in lateness.refused(df).collect()}


def test_late_stream_counts_a_record_once(spark, tmp_path):
    from emberglass.operators import lateness

    h, schema = lateness.HOUR_US, "dataset string, record_id string, action_name string, event_us long, arrival_us long"
    batches = [[("d", "1", "a", 5, 6), ("d", None, "a", 5, 7), ("d", "2", "a", 5, 30 * h)], [("d", "1", "a", 5, 8), ("d", None, "a", 5, 7), ("d", "2", "a", 5, 31 * h), ("d", "3", "a", 5, 2 * h)], [("d", "1", "a", 5, 6), ("d", "4", "b", h + 5, None)], []]
    folder = str(tmp_path / "late")
    for n, rows in enumerate(batches):
        late.write_batch(spark.createDataFrame(rows, schema), n, folder)
        if n == 1:
            late.compact(spark, folder, 1)
    got = {(r.window_start_us, r.action_name): (r.n_first, r.n_late, r.n_unknown, r.n_refused, r.n_final) for r in late.counts(spark, folder).collect()}
    assert got == {(0, "a"): (3, 1, 0, 1, 4), (h, "b"): (0, 0, 1, 0, 1)}
    assert [r.record_id for r in late.refused(spark, folder).collect()] == ["2"]
    every = {(r.hour_start_us, r.action_name): (r.n_first, r.n_late, r.n_refused, r.n_final) for r in lateness.period_counts(spark.createDataFrame(sum(batches, []), schema)).collect()}
    assert every == {k: (v[0], v[1], v[3], v[4]) for k, v in got.items()}


def test_stored_results_are_one_row_per_action(spark, tmp_path):
    many = spark.createDataFrame([(1, "n", NOW, '{"u": "a"}')] * 3 + [(2, "n", NOW, None)] * 3, "action_id long, action_name string, timestamp timestamp, data string")
    engine.stored_result_sink(str(tmp_path / "s")).push(compile_rules(RULES).evaluate(many), 0)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6


def test_late_stream_runs(spark, tmp_path):
    schema = "dataset string, record_id string, action_name string, event_us long, arrival_us long"
    spark.createDataFrame([("d", "1", "a", 5, 6), ("d", "2", "a", 5, 26 * 3_600_000_000)], schema).write.parquet(str(tmp_path / "in"))
    late.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert late.counts(spark, str(tmp_path / "o")).first().n_final == 1 and late.refused(spark, str(tmp_path / "o")).count() == 1


# ---- catalogue ----
def test_catalogue(spark):
    rules = compile_rules({"main.sml": "A: int = JsonData(path='$.a')\nB = A + 1\nC = B * 2\nR = Rule(when_all=[C > 1], description='big')\n"})
    assert {(r.feature, r.type) for r in catalogue.features(spark, rules).collect()} == {("A", "int"), ("B", "int"), ("C", "int"), ("R", "rule")}
    deps = {r.feature: (r.depends_on, r.depended_on_by) for r in catalogue.dependencies(spark, rules).collect()}
    assert deps["R"] == (["A", "B", "C"], []) and deps["A"] == ([], ["B", "C", "R"])
    assert catalogue.rule_list(spark, rules).first().rule == "R" and catalogue.function_list(spark).count() > 60 and catalogue.edges(spark, rules).count() == 3


def test_history_and_lineage(spark):
    old = spark.sql("select 'a' feature, '1' content, timestamp'2024-01-01' valid_from, timestamp'9999-12-31 23:59:59' valid_to union all select 'b', '1', timestamp'2024-01-01', timestamp'9999-12-31 23:59:59'")
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "feature string, content string")
    got = sorted((r.feature, r.content, r.valid_to.year) for r in catalogue.merge_history(old, now, "2024-02-01").collect())
    assert got == [("a", "1", 2024), ("a", "2", 9999), ("b", "1", 9999), ("c", "1", 9999)]
    q = spark.createDataFrame([(1, None, "x"), (2, 1, "y"), (3, 2, "z"), (4, 1, "w")], "id long, parent_id long, query string")
    assert [r.id for r in catalogue.query_lineage(q, 3).collect()] == [3, 2, 1]


def test_query_history(spark, tmp_path):
    from emberglass.plans.history import History

    h = History(spark, str(tmp_path / "h"))
    assert h.latest().count() == 0 and h.saved().count() == 0
    for i, who in enumerate(["a@x", "b@x", "a@x"]):
        h.record(i, who, f"A == {i}", NOW, NOW, NOW)
    h.save(1, 0, "first", "a@x", NOW)
    h.save(1, 2, "first", "a@x", NOW + timedelta(days=1))
    assert [r.id for r in h.latest().collect()] == [2, 1, 0] and [r.id for r in h.latest("a@x", before=2).collect()] == [0]
    assert [r[0] for r in h.user_emails().collect()] == ["a@x", "b@x"] and [r.query for r in h.saved().collect()] == ["A == 2"]


def test_configured_labels_and_direct_verdicts(spark):
    from emberglass.lang.syntax import Sources

    config = {"labels": {"seen": {"valid_for": ["User"]}, "other": {"valid_for": ["Guild"]}}}
    rules = compile_rules(Sources(RULES, config))
    got = engine.classify(spark, rules, [{"action_id": 1, "action_name": "n", "timestamp": NOW, "data": {"u": "a"}}])
    assert got == [{"action_id": 1, "verdicts": ["new"], "entity_verdicts": ["User/a/seen"]}]
    for label in ("other", "unknown"):
        with pytest.raises(RuleError):
            compile_rules(Sources({"main.sml": RULES["main.sml"].replace("label='seen'), Dec", f"label='{label}'), Dec")}, config))


def test_uploaded_ids(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("id,x\n1,a\n ,b\n3,c\n")
    assert [r[0] for r in actions.entity_ids(spark, str(tmp_path / "ids.csv")).collect()] == ["1", "3"]
