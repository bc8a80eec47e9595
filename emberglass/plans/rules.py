"""Queries of the rule engine and of investigation over the project's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stdlib import FUNCTIONS
from ..lang.lower import compile_rules
from ..lang.values import FLOAT, INT, STR, Ty
from ..operators import labels
from ..runtime import table
from .investigate import TIME, Ability, Predicate, Query, censor_columns, results_by_id
from .training import TIME_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
TYPES = {"EventType": STR, "ActionName": STR, "UserId": INT, "Value": FLOAT, "K": Ty("int", optional=True), "Half": Ty("int", optional=True), "__verdicts": Ty("list", STR)}
ENTITY_TYPES = {"UserId": "User", "EventType": "EventType"}


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as evaluated actions: time, id and features; ``Half`` is null for odd ``K``."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias(TIME), F.col("event_id").alias("__action_id"), F.col("event_type").alias("EventType"), F.col("event_type").alias("ActionName"),
        F.col("user_id").alias("UserId"), F.col("value").alias("Value"), k.alias("K"), F.when(k % 2 == 0, F.floor(k / 2)).alias("Half"),
    )


_T = """with t as (select ts as "__time", event_id as "__action_id", event_type as "EventType", event_type as "ActionName", user_id as "UserId", value as "Value",
  try_cast(json_extract_string(props, '$.k') as bigint) as "K", case when try_cast(json_extract_string(props, '$.k') as bigint) % 2 = 0 then try_cast(json_extract_string(props, '$.k') as bigint) // 2 end as "Half" from events) """
_SPAN = """ "__time" >= timestamp '2024-01-10' and "__time" < timestamp '2024-01-20' """


def investigation(spark: SparkSession, sf_dir: str, text: str = "", **more) -> Query:
    return Query(feature_table(spark, sf_dir), TYPES, START, END, text, entity_types=ENTITY_TYPES, **more)


def whole(spark: SparkSession, sf_dir: str, text: str = "", **more) -> Query:
    """An investigation over the whole span of the table."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    start, end = (first, last + timedelta(microseconds=1)) if first else (START, START)
    return Query(feature_table(spark, sf_dir), TYPES, start, end, text, entity_types=ENTITY_TYPES, **more)


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _filter(name: str, text: str, sql: str, **how) -> None:
    _add(
        name,
        lambda s, d: feature_table(s, d).where(Predicate(TYPES, **how).compile(text)).select("__action_id", "EventType", "Value", "K"),
        _T + f'select "__action_id", "EventType", "Value", "K" from t where {sql}',
    )


_filter("q_filter_and_or_not", "EventType == 'click' and (Value > 5.0 or not K == 3)", """"EventType" = 'click' and ("Value" > 5.0 or not "K" = 3)""")
_filter("q_filter_in_list", "EventType in ['click', 'purchase']", """"EventType" in ('click', 'purchase')""")
_filter("q_filter_not_in_list", "K not in [3, 4, 5]", '"K" not in (3, 4, 5)')
_filter("q_filter_substring_ci", "'RCH' in EventType", """contains(lower("EventType"), 'rch')""")
_filter("q_filter_isnull", "Half == None", '"Half" is null')
_filter("q_filter_notnull_bound", "Half >= 20 and Half < 30", '"Half" is not null and "Half" >= 20 and "Half" < 30')
_filter("q_filter_column_eq", "K == UserId", '"K" = "UserId"')
_filter("q_filter_column_ne", "K != UserId", '"K" <> "UserId"')
_filter("q_filter_regex", "RegexMatch(target=EventType, pattern='^(p|c)')", """regexp_matches("EventType", '^(p|c)')""")
_filter("q_filter_literal_left", "50.0 < Value", '"Value" < 50.0')
_filter("q_filter_literal_left_strict", "50.0 < Value", '"Value" > 50.0', keep_operand_order=False)
_filter("q_filter_negative_literal", "Value > -1.5 and K != -1", '"Value" > -1.5 and "K" <> -1')

_add("q_topn_event_type", lambda s, d: investigation(s, d, "Value > 5.0").topn("EventType"), _T + f'select "EventType" as dimension, count(*) as count from t where "Value" > 5.0 and {_SPAN} group by 1 order by 2 desc, 1 limit 100')
_add("q_topn_users", lambda s, d: investigation(s, d).topn("UserId", 20), _T + f'select "UserId" as dimension, count(*) as count from t where {_SPAN} group by 1 order by 2 desc, 1 limit 20')
_add("q_topn_float_precision", lambda s, d: investigation(s, d).topn("Value", 50, 0.1), _T + f"""select concat('~', printf('%.1f', floor("Value" * 10) / 10)) as dimension, count(*) as count from t where {_SPAN} group by 1 order by 2 desc, 1 limit 50""")
_add(
    "q_topn_change",
    lambda s, d: investigation(s, d).topn_change("UserId", 50),
    _T
    + f""", n as (select "UserId" as d, count(*) as c from t where {_SPAN} group by 1 order by 2 desc, 1 limit 50),
    p as (select "UserId" as d, count(*) as c from t where "__time" >= timestamp '2023-12-31' and "__time" < timestamp '2024-01-10' group by 1)
    select n.d as dimension, n.c as count, coalesce(p.c, 0) as previous, n.c - coalesce(p.c, 0) as difference, case when p.c > 0 then (n.c - p.c) * 100.0 / p.c end::double as percent from n left join p using (d)""",
)
_add("q_cardinality_exact", lambda s, d: investigation(s, d).cardinality("UserId", exact=True), _T + f'select count(distinct "UserId") as cardinality from t where {_SPAN}')
_add("q_cardinality_approx", lambda s, d: investigation(s, d).cardinality("UserId"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = whole(spark, sf_dir)
    both = q.cardinality("UserId").crossJoin(q.cardinality("UserId", exact=True).withColumnRenamed("cardinality", "exact"))  # one row each
    return both.select("exact", (F.abs(F.col("cardinality") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


_add("q_cardinality_near", _near, _T + 'select count(distinct "UserId") as exact, true as near from t where "__time" is not null')
for _g, _sql in {
    "minute": "date_trunc('minute', \"__time\")", "fifteen_minute": "time_bucket(interval '15 minutes', \"__time\")", "thirty_minute": "time_bucket(interval '30 minutes', \"__time\")",
    "hour": "date_trunc('hour', \"__time\")", "day": "date_trunc('day', \"__time\")::timestamp", "week": "date_trunc('week', \"__time\")::timestamp", "month": "date_trunc('month', \"__time\")::timestamp",
}.items():
    _add(f"q_timeseries_{_g}", lambda s, d, g=_g: investigation(s, d).timeseries(g, zero_fill=False), _T + f"select {_sql} as bucket, count(*) as count from t where {_SPAN} group by 1")
_add(
    "q_timeseries_zero_fill",
    lambda s, d: investigation(s, d, "EventType == 'purchase' and Value > 90.0").timeseries("hour"),
    _T
    + f""", c as (select date_trunc('hour', "__time") as bucket, count(*) as n from t where "EventType" = 'purchase' and "Value" > 90.0 and {_SPAN} group by 1)
    select b.bucket, coalesce(n, 0) as count from (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-19 23:00:00', interval '1 hour')) as bucket) b left join c using (bucket)""",
)
_add(
    "q_timeseries_filtered_counts",
    lambda s, d: investigation(s, d, entity=("User", 7)).timeseries("day", ["UserId", "K"], zero_fill=False),
    _T + f"""select date_trunc('day', "__time")::timestamp as bucket, count(*) as count, count(*) filter ("UserId" = 7) as "UserId", count(*) filter ("K" = 7) as "K" from t where "UserId" = 7 and {_SPAN} group by 1""",
)
# the same over all events
_add("q_whole_timeseries_day", lambda s, d: whole(s, d).timeseries("day", zero_fill=False), _T + """select date_trunc('day', "__time")::timestamp as bucket, count(*) as count from t where "__time" is not null group by 1""")
_add("q_whole_topn_users", lambda s, d: whole(s, d).topn("UserId", 20), _T + 'select "UserId" as dimension, count(*) as count from t where "__time" is not null group by 1 order by 2 desc, 1 limit 20')
_add("q_whole_cardinality_exact", lambda s, d: whole(s, d).cardinality("UserId", exact=True), _T + 'select count(distinct "UserId") as cardinality from t where "__time" is not null')
_add("q_scan_asc", lambda s, d: investigation(s, d).scan(100, ascending=True), _T + f'select "__action_id", "__time" from t where {_SPAN} order by "__time", "__action_id" limit 101')
_add("q_scan_desc", lambda s, d: investigation(s, d).scan(100), _T + f'select "__action_id", "__time" from t where {_SPAN} order by "__time" desc, "__action_id" desc limit 101')


def _second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = investigation(spark, sf_dir)
    return q.scan(50, ascending=True, after=q.page(50, ascending=True)[1])


_add("q_scan_page2", _second_page, _T + f'select "__action_id", "__time" from t where {_SPAN} order by "__time", "__action_id" limit 51 offset 50')
_add("q_entity_filter", lambda s, d: investigation(s, d, entity=("User", 7)).rows().select("__action_id", "UserId"), _T + f'select "__action_id", "UserId" from t where "UserId" = 7 and {_SPAN}')
_acl = lambda a: lambda s, d: investigation(s, d, ability=a).rows().select("__action_id", "ActionName")
_add("q_acl_allow", _acl(Ability("view", allow_specific=["click", "view"])), _T + f"""select "__action_id", "ActionName" from t where "ActionName" in ('click', 'view') and {_SPAN}""")
_add("q_acl_except", _acl(Ability("view", allow_all_except=["click"])), _T + f"""select "__action_id", "ActionName" from t where "ActionName" <> 'click' and {_SPAN}""")
_add(
    "q_censor_features",
    lambda s, d: censor_columns(feature_table(s, d), Ability("features", allow_specific=["UserId"])).select("__action_id", "ActionName", "EventType", "UserId", "Value"),
    _T + """select "__action_id", "ActionName", '[CENSORED]' as "EventType", "UserId", null::double as "Value" from t""",
)

# ---- rules over events ----
BASE = """
UserId: Entity[int] = EntityJson(type='User', path='$.user_id')
EventType: Entity[str] = EntityJson(type='EventType', path='$.event_type')
ActionName = GetActionName()
ActionId = GetActionId()
Value: float = JsonData(path='$.value')
K: Optional[int] = JsonData(path='$.props.k', required=False)
KText: str = JsonData(path='$.props.k', coerce_type=True)
Missing: Optional[str] = JsonData(path='$.nothing', required=False)
Gone: str = JsonData(path='$.nothing', required=False)
"""
RULES = {
    "main.sml": "Import(rules=['models/base.sml'])\nRequire(rule='rules/buys.sml', require_if=EventType == 'purchase')\nRequire(rule='rules/all.sml')\n",
    "models/base.sml": BASE,
    "rules/buys.sml": """
Import(rules=['models/base.sml'])
Dear = Rule(when_all=[Value > 50.0], description='dear')
Lucky = Rule(when_all=[K in [7, 77], Value > 1.0], description=f'lucky {UserId}')
WhenRules(rules_any=[Dear, Lucky], then=[LabelAdd(entity=UserId, label='buyer', expires_after=TimeDelta(days=2)), DeclareVerdict(verdict='review')])
""",
    "rules/all.sml": """
Import(rules=['models/base.sml'])
Broken = Rule(when_all=[Gone == 'x', Gone != None], description='never fails, as == takes failures in')
Fails = Rule(when_all=[StringLength(s=Gone) > 1], description='always fails')
Small = Rule(when_all=[Value < 2.0, not K == None], description='small')
WhenRules(rules_any=[Fails, Small], then=[LabelRemove(entity=UserId, label='buyer'), DeclareVerdict(verdict='allow')])
""",
}


def event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as actions with JSON data."""
    e = table(spark, sf_dir, "events")
    data = F.concat(F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"), F.lit(',"props":'), F.coalesce("props", F.lit("{}")), F.lit("}"))
    return e.select(F.col("event_id").alias("action_id"), F.col("event_type").alias("action_name"), F.col("ts").alias("timestamp"), data.alias("data"))


def document_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("action_id"), F.col("source").alias("action_name"), F.col("created_at").alias("timestamp"), F.to_json(F.struct("text", "lang", "author_id")).alias("data"))


def _rule(name: str, text: str, columns: list[str], sql: str | None, actions=event_actions, base: str = BASE) -> None:
    _add(name, lambda s, d: compile_rules({"main.sml": base + text}, FUNCTIONS).evaluate(actions(s, d)).select("__action_id", *columns), sql)


_E = """with t as (select event_id as "__action_id", ts, user_id as u, event_type as e, value as v, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) """
_rule("q_feature_json", "", ["UserId", "EventType", "Value", "K", "KText", "Missing", "Gone", "__error_count"], _E + """select "__action_id", u as "UserId", e as "EventType", v as "Value", k as "K", k::varchar as "KText", null::varchar as "Missing", null::varchar as "Gone", (k is null)::int as "__error_count" from t""")
_rule(
    "q_arithmetic",
    "A = UserId + 2\nB = UserId * 3 - 5\nC = UserId / 0\nD: float = Value / 4.0\nE = (UserId - 60) // 7\nG = (UserId - 60) % -7\nH = UserId ** 2\nI = UserId << 3\nJ = UserId >> 1\nL = UserId | 9\nM = UserId ^ 9\nN = UserId & 9\nP = -Value\nQ = EventType + '!'\nR = 'ab' * 2 + EventType\nS = UserId % 0\n",
    list("ABCDEGHIJLMNPQRS"),
    _E
    + """select "__action_id", u + 2 as "A", u * 3 - 5 as "B", 0.0::double as "C", v / 4.0 as "D", floor((u - 60) / 7.0)::bigint as "E", ((u - 60) - (-7) * floor((u - 60) / -7.0))::bigint as "G", (u * u)::bigint as "H", u * 8 as "I", u // 2 as "J",
    u | 9 as "L", xor(u, 9::bigint) as "M", u & 9 as "N", -v as "P", e || '!' as "Q", 'abab' || e as "R", 0::bigint as "S" from t""",
)
_rule(
    "q_boolean",
    "A = Value > 5.0 and EventType == 'click'\nB = Gone == None\nC = Gone != 'x' or Value > 1.0\nD = StringLength(s=Gone) > 1 and Value > 0.0\nE = not (Value > 5.0)\nG = K in [1, 2, 3]\nH = 'li' in EventType\nI = Missing == None\nL = UserId not in [1, 2]\nM = StringLength(s=Gone) > 1\n",
    list("ABCDEGHILM"),
    _E + """select "__action_id", v > 5.0 and e = 'click' as "A", true as "B", true as "C", false as "D", not v > 5.0 as "E", coalesce(k in (1, 2, 3), false) as "G", contains(e, 'li') as "H", true as "I", u not in (1, 2) as "L", null::boolean as "M" from t""",
)
_rule("q_format_string", "A = f'{EventType}:{UserId}'\nB = Value > 5.0\nC = f'is {B} {Missing}'\n", ["A", "C"], _E + """select "__action_id", e || ':' || u as "A", 'is ' || case when v > 5.0 then 'True' else 'False' end || ' None' as "C" from t""")
_rule("q_lists", "L = [UserId, 3, K]\nN = ListLength(list=[UserId, 3])\nR = ListRead(list=[EventType, 'z'], index=-1)\nR0 = ListRead(list=[EventType, 'z'])\nBad = ListRead(list=[EventType], index=4)\nS = ListSort(list=[UserId, 3, 50])\n".replace("L = [UserId, 3, K]\n", ""), ["N", "R", "R0", "Bad", "S"], _E + """select "__action_id", 2::bigint as "N", 'z' as "R", e as "R0", null::varchar as "Bad", list_sort([u, 3, 50]) as "S" from t""")
_rule(
    "q_time",
    "A = TimeDelta(weeks=1, days=2, hours=3, minutes=4, seconds=5)\nB = TimeSince(timestamp='2024-01-10T00:00:00+02:00')\nC = GetTimestampBucket(timestamp=1704844800 + UserId * 3600, granularity_seconds=86400)\nD = GetTimedeltaBucket(timedelta=B, granularity_seconds=3600)\nE = GetSnowflakeBucket(snowflake=175928847299117063 + UserId, granularity_seconds=3600)\n",
    ["B", "C", "D", "E"],
    """with t as (select event_id as "__action_id", user_id as u, greatest((epoch_us(ts) - epoch_us(timestamp '2024-01-10')) / 1e6, 0.0) as s from events)
    select "__action_id", s as "B", (1704844800 + u * 3600) - (1704844800 + u * 3600) % 86400 as "C", floor(s)::bigint - floor(s)::bigint % 3600 as "D", (((175928847299117063 + u) >> 22) + 1420070400000) // 1000 - ((((175928847299117063 + u) >> 22) + 1420070400000) // 1000) % 3600 as "E" from t""",
)
_DOC = "Text: Optional[str] = JsonData(path='$.text', required=False)\nT: str = ResolveOptional(optional_value=Text, default_value='')\nAuthor: Optional[str] = JsonData(path='$.author_id', required=False)\nWho: str = ResolveOptional(optional_value=Author, default_value='nobody@mail.example.co.uk')\n"
_D = """with t as (select doc_id as "__action_id", coalesce(text, '') as x, coalesce(author_id, 'nobody@mail.example.co.uk') as w from documents) """
_rule(
    "q_strings",
    "A = StringLength(s=T)\nB = StringStartsWith(s=T, start='I')\nC = StringEndsWith(s=T, end='.')\nD = StringReplace(s=T, old='the', new='THE')\nE = StringSlice(s=T, start=2, end=9)\nG = StringToLower(s=Who)\nH = StringStrip(s=T, chars='. ')\nI = StringJoin(s='-', iterable=[Who, 'x'])\nJ = ListLength(list=StringSplit(s=T, sep='. '))\nL = StringToUpper(s=Who)\n",
    list("ABCDEGHIJL"),
    _D + """select "__action_id", length(x) as "A", starts_with(x, 'I') as "B", suffix(x, '.') as "C", replace(x, 'the', 'THE') as "D", substring(x, 3, 7) as "E", lower(w) as "G", trim(x, '. ') as "H", w || '-x' as "I", len(string_split(x, '. ')) as "J", upper(w) as "L" from t""",
    document_actions, _DOC,
)
_rule(
    "q_regex",
    "A = RegexMatch(target=T, pattern='user_[0-9]+')\nB = RegexMatch(target=T, pattern='INCIDENT', case_insensitive=True)\nC = RegexMatchMap(target=[T, Who], pattern='^user', mode='any')\nD = CountRegexMatches(patterns=['foo', 'the', '[0-9]{3}'], target=T)\nE = TextContains(text=T, phrase='the')\n",
    list("ABCD"),
    _D + """select "__action_id", regexp_matches(x, 'user_[0-9]+') as "A", regexp_matches(x, 'INCIDENT', 'i') as "B", regexp_matches(x, '^user') or regexp_matches(w, '^user') as "C", regexp_matches(x, 'foo')::bigint + regexp_matches(x, 'the')::bigint + regexp_matches(x, '[0-9]{3}')::bigint as "D" from t""",
    document_actions, _DOC,
)
_rule(
    "q_hashes",
    "A = HashMd5(input=T)\nB = HashSha1(input=T)\nC = HashSha256(input=T)\nD = HashSha512(input=T)\nE = Base64Encode(input=Who)\nG = Base64Decode(input=E)\nH = ParseInt(s=StringReplace(s=Who, old='user_', new=''))\n",
    list("ABCEGH"),
    _D + """select "__action_id", md5(x) as "A", sha1(x) as "B", sha256(x) as "C", to_base64(encode(w)) as "E", w as "G", try_cast(replace(w, 'user_', '') as bigint) as "H" from t""",
    document_actions, _DOC,
)
_rule(
    "q_strip_entity",
    "A = StringLStrip(s=T, chars='I ')\nB = StringRStrip(s=T, chars='. ')\nC: Entity[str] = Entity(type='User', id=Who)\nD = StringClean(s=T, homoglyph=False, unicode_normalize=False, lower=True)\n",
    list("ABCD"),
    _D + """select "__action_id", ltrim(x, 'I ') as "A", rtrim(x, '. ') as "B", w as "C", lower(regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) as "D" from t""",
    document_actions, _DOC,
)
_rule("q_sha512", "D = HashSha512(input=T)\n", ["D"], None, document_actions, _DOC)
_rule(
    "q_email_domains",
    "A = EmailDomain(email=Who)\nB = EmailSubdomain(email=Who)\nC = EmailLocalPart(email=Who)\nD = DomainTld(domain='www.shop.co.uk')\nE = DomainChopper(urls=['http://a.b.example.com/x'], fld=True)\nG = PhoneCountry(phone_number='+12125555555')\nH = PhonePrefix(phone_number=Who)\nI = IpNetwork(ip='10.1.2.3')\nJ = ExtractCookie(header='a=1; sid=xyz', key='sid')\n",
    list("ABCDEGHIJ"),
    _D + """select "__action_id", case when contains(w, '@') then 'example.co.uk' end as "A", case when contains(w, '@') then 'mail.example.co.uk' end as "B", case when contains(w, '@') then 'nobody' end as "C", 'co.uk' as "D", ['example.com'] as "E", 'US' as "G", w[:-5] as "H", '10.1.2.0' as "I", 'xyz' as "J" from t""",
    document_actions, _DOC,
)
_rule("q_clean_text", "A = StringClean(s=T, lower=True)\nB = StringClean(s='𝐇𝐞𝐥𝐥𝐨 w0rld', l33t=True)\nC = StringExtractDomains(s=T)\nD = StringExtractURLs(s=T)\nE = IpNetwork(ip='2001:db8::1')\n", list("ABCDE"), None, document_actions, _DOC)
_rule("q_experiment", "X = Experiment(entity=UserId, buckets=['control', 'a', 'b'], bucket_sizes=[33.0, 33.0, 20.0], version=1, revision=2)\nW = ExperimentWhen(experiment=X, control=[Value > 1.0], a=[Value > 2.0], b=[Value > 3.0])\n", ["X", "W"], None)
_rule("q_random", "A = RandomBool(percentage=0.3)\nB = RandomInt(start=1, end=6)\n", ["A", "B"], None)


def whole_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_rules(RULES).evaluate(event_actions(spark, sf_dir))


_R = _E + """, r as (select *, e = 'purchase' as b, case when e = 'purchase' then v > 50.0 end as dear, case when e = 'purchase' then coalesce(k in (7, 77), false) and v > 1.0 end as lucky, v < 2.0 and k is not null as small from t),
  h as (select *, coalesce(dear or lucky, false) as hit from r) """
_add("q_rules", lambda s, d: whole_ruleset(s, d).select("__action_id", "Dear", "Lucky", "Broken", "Fails", "Small"), _R + 'select "__action_id", dear as "Dear", lucky as "Lucky", false as "Broken", null::boolean as "Fails", small as "Small" from h')
_add(
    "q_effects",
    lambda s, d: whole_ruleset(s, d).select("__action_id", "__entity_label_mutations", "__verdicts", "__entity_verdicts"),
    _R
    + """select "__action_id", case when hit and small then ['User/buyer/1', 'User/buyer/0'] when small then ['User/buyer/0'] when hit then ['User/buyer/1'] end as "__entity_label_mutations",
    case when hit and small then ['review', 'allow'] when small then ['allow'] when hit then ['review'] end as "__verdicts", case when hit then ['User/' || u || '/buyer'] end as "__entity_verdicts" from h""",
)
_add(
    "q_audit",
    lambda s, d: whole_ruleset(s, d).select("__action_id", F.explode("__audit").alias("a")).where("a is not null").groupBy(F.element_at("a.evaluated", 1).alias("first_rule")).agg(F.count("*").alias("n"), F.sum(F.size("a.matched")).alias("matched"), F.sum("a.n_effects").cast("bigint").alias("effects"), F.count_if("a.degraded").alias("degraded")),
    _R
    + """select 'Dear' as first_rule, count(*) as n, sum(coalesce(dear, false)::int + coalesce(lucky, false)::int)::bigint as matched, sum(case when hit then 2 else 0 end)::bigint as effects, 0::bigint as degraded from h where b
    union all select 'Fails', count(*), sum(small::int)::bigint, sum(case when small then 2 else 0 end)::bigint, count(*) from h""",
)
_add("q_did_add_label", lambda s, d: whole_ruleset(s, d).where(Predicate({}).compile("DidAddLabel(entity_type='User', label_name='buyer') and not DidDeclareVerdict(verdict='allow')")).select("__action_id"), _R + 'select "__action_id" from h where hit and not small')


_add("q_did_remove_label", lambda s, d: whole_ruleset(s, d).where(Predicate({}).compile("DidRemoveLabel(entity_type='User', label_name='buyer')")).select("__action_id"), _R + 'select "__action_id" from h where small')
CHOSEN = {
    "main.sml": "Import(rules=['models/base.sml'])\nRequire(rule=f'actions/{ActionName}.sml')\n",
    "models/base.sml": BASE,
    "actions/click.sml": "Import(rules=['models/base.sml'])\nClicked = Rule(when_all=[Value > 10.0], description='click')\nOften = Rule(when_all=[Value > 40.0], description='often')\nWhenRules(rules_any=[Clicked], then=[LabelAdd(entity=UserId, label='clicker', apply_if=Often), BanUser(entity=UserId, comment='much')])\n",
    "actions/view.sml": "Import(rules=['models/base.sml'])\nSeen = Rule(when_all=[Value > 20.0], description='view')\nWhenRules(rules_any=[Seen], then=[DeclareVerdict(verdict='seen')])\n",
}
_add(
    "q_required_by_name",
    lambda s, d: compile_rules(CHOSEN).evaluate(event_actions(s, d)).select("__action_id", "Clicked", "Often", "Seen", "__verdicts", "__entity_verdicts", F.size("__effects").cast("bigint").alias("n_effects")),
    _E
    + """select "__action_id", case when e = 'click' then v > 10.0 end as "Clicked", case when e = 'click' then v > 40.0 end as "Often", case when e = 'view' then v > 20.0 end as "Seen", case when e = 'view' and v > 20.0 then ['seen'] end as "__verdicts",
    case when e = 'click' and v > 40.0 then ['User/' || u || '/clicker'] end as "__entity_verdicts", case when e = 'click' and v > 10.0 then 2 when e = 'view' and v > 20.0 then 1 else 0 end::bigint as n_effects from t""",
)


def label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.fold(labels.mutations_of(whole_ruleset(spark, sf_dir)))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at("labels", "buyer")
    return label_states(spark, sf_dir).select("entity_id", state["status"].alias("status"), F.array_sort(F.map_keys(state["reasons"])).alias("reasons"))


def _has_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = compile_rules({"main.sml": BASE + "IsBuyer = HasLabel(entity=UserId, label='buyer')\nNoBuyer = HasLabel(entity=UserId, label='buyer', status='removed')\n"})
    states = label_states(spark, sf_dir).select("entity_type", "entity_id", F.transform_values("labels", lambda _, s: F.struct(s["status"].alias("status"), F.transform_values(s["reasons"], lambda _, r: F.struct(r["pending"].alias("pending"), r["description"].alias("description"), r["created_at"].alias("created_at"), r["expires_at"].alias("expires_at"))).alias("reasons"))).alias("labels"))
    return rules.evaluate(event_actions(spark, sf_dir), labels=states).select("__action_id", "IsBuyer", "NoBuyer")


# runs of requests of one status; a run also ends where the state has expired, which an added one does two days after its last request
_L = (
    _R
    + """, m as (select u, "__action_id" as id, ts, case when hit then 1 else 0 end as st, case when hit then case when dear and lucky then ['Dear', 'Lucky'] when dear then ['Dear'] else ['Lucky'] end else ['Small'] end as rs from h where (hit or small) and u is not null),
  g as (select *, lag(st) over (partition by u order by ts, id) as pst, lag(ts) over (partition by u order by ts, id) as pts from m),
  n as (select *, sum(case when pst is null or pst <> st or (st = 1 and pts + interval 172805 seconds < ts) then 1 else 0 end) over (partition by u order by ts, id rows unbounded preceding) as run from g),
  f as (select n.u, any_value(st) as status, max(ts) as last, list_sort(list_distinct(flatten(list(rs)))) as reasons from n join (select u, max(run) as run from n group by u) z on n.u = z.u and n.run = z.run group by n.u) """
)
_add("q_label_state", _status, _L + "select u::varchar as entity_id, status::int as status, reasons from f")
_add(
    "q_has_label", _has_label,
    _L + """select "__action_id", coalesce(status = 1 and last + interval 2 days > t.ts, false) as "IsBuyer", coalesce(status = 0 or last + interval 2 days <= t.ts, true) as "NoBuyer" from t left join f on t.u = f.u""",
)
_add(
    "q_bulk_label_targets",
    lambda s, d: labels.bulk_targets(investigation(s, d, "Value > 5.0").rows().select(F.col("UserId").alias("entity_id")), feature_table(s, d).where("UserId < 20").select(F.col("UserId").alias("entity_id"))),
    _T + f"""select distinct "UserId"::varchar as entity_id from t where "Value" > 5.0 and {_SPAN} and "UserId" is not null and "UserId" >= 20""",
)
_add("q_stored_by_id", lambda s, d: _stored(s, d), """select distinct id, action_data, stored_timestamp from stored_results where id in (select request_no from action_requests)""")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "action_requests").select(F.col("request_no").alias("id")).distinct()
    return results_by_id(table(spark, sf_dir, "stored_results").select("id", "action_data", "stored_timestamp").distinct(), ids)


def _kafka_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.actions import from_envelopes

    return from_envelopes(table(spark, sf_dir, "kafka_messages").select(F.to_json("template").alias("value"))).select("action_id", "action_name", "timestamp", F.get_json_object("data", "$.user_id").alias("user_id"))


_add("q_envelope_source", _kafka_actions)
_add(
    "q_envelope_fields",
    lambda s, d: _kafka_actions(s, d).select("action_name", F.col("timestamp").cast("timestamp_ntz").alias("sent"), "user_id"),
    f"""with e as (select template.data.action_name as action_name, template.data.data as d, trim(template.send_time) as s from kafka_messages), t as (select action_name, d, {TIME_SQL} as us from e)
    select action_name, make_timestamp(us) as sent, d.user_id as user_id from t where action_name is not null and us is not null and d is not null""",
)


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import dependencies

    return dependencies(spark, compile_rules(RULES))


_EDGES = "('Small', 'Value'), ('Small', 'K'), ('Dear', 'Value'), ('Lucky', 'K'), ('Lucky', 'Value'), ('Lucky', 'UserId'), ('Broken', 'Gone'), ('Fails', 'Gone')"
_NAMES = ", ".join(f"('{n}')" for n in ("UserId", "EventType", "ActionName", "ActionId", "Value", "K", "KText", "Missing", "Gone", "Dear", "Lucky", "Broken", "Fails", "Small"))
_add(
    "q_dependencies",
    _dependencies,
    f"""with recursive e(a, b) as (values {_EDGES}), c(a, b) as (select a, b from e union select c.a, e.b from c join e on c.b = e.a), n(feature) as (values {_NAMES})
    select feature, coalesce((select list_sort(list(b)) from c where a = feature), []) as depends_on, coalesce((select list_sort(list(a)) from c where b = feature), []) as depended_on_by from n""",
)
