"""The rule language: failed and missing values, typing, files, effects, functions, and a property test against plain Python."""

import ast
import datetime as dt
import math
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from emberglass.functions.arrow import clean, murmur3_32
from emberglass.functions.stdlib import FUNCTIONS
from emberglass.lang.lower import compile_rules
from emberglass.lang.syntax import Sources
from emberglass.lang.values import RuleError

AT = dt.datetime(2020, 7, 16, 20, 0)
SCHEMA = "action_id long, action_name string, timestamp timestamp, data string, secret_data string"


def run(spark, text, data="{}", files=None, labels=None, name="act"):
    """The single evaluated row of one action."""
    rules = compile_rules({"main.sml": text, **(files or {})})
    df = spark.createDataFrame([(1, name, AT, data, '{"pin": "1234"}')], SCHEMA)
    return rules.evaluate(df, labels=labels).first().asDict(recursive=True)


JSON = """
Foo: str = JsonData(path='$.foo')
Num: int = JsonData(path='$.num')
Maybe: Optional[str] = JsonData(path='$.maybe', required=False)
MaybeN: Optional[int] = JsonData(path='$.n', required=False)
Gone: str = JsonData(path='$.gone', required=False)
GoneN: int = JsonData(path='$.gone', required=False)
"""
DATA = '{"foo": "hello", "num": 2, "maybe": null}'


@pytest.mark.parametrize(
    "expression, want",
    [
        ("Foo == 'hello'", True), ("Foo != 'hello'", False), ("Maybe == None", True), ("Maybe != None", False), ("Foo == None", False), ("Gone == None", True), ("Gone == 'x'", False), ("Gone != 'x'", True),
        ("Num == 2.0", True), ("MaybeN == 2", False), ("Num in [1, 2, 3]", True), ("Num not in [1, 2, 3]", False), ("Maybe in ['a']", False), ("Gone in ['a']", False), ("Gone not in ['a']", True), ("'ell' in Foo", True), ("'ELL' in Foo", False),
        ("Num > 1", True), ("Num >= 3", False), ("MaybeN > 1", False), ("MaybeN < 1", False), ("GoneN > 1", None), ("Num > 1 and Foo == 'hello'", True), ("GoneN > 1 and Num > 1", False), ("GoneN > 1 or Num > 1", True), ("not (GoneN > 1)", None), ("not (Num > 1)", False),
        ("StringLength(s=Gone)", None), ("[Foo, Gone]", None), ("[Foo, Maybe]", ["hello", None]), ("Num + GoneN", None), ("Num + 1", 3), ("Num / 0", 0.0), ("Num // 0", 0), ("Num % 0", 0), ("Num - 9", -7), ("(Num - 9) // 2", -4), ("(Num - 9) % 2", 1), ("(Num + 5) % -3", -2), ("(Num + 5) // -3", -3),
        ("Num / 4", 0.5), ("Num ** 3", 8), ("Num << 4", 32), ("Num >> 1", 1), ("Num | 5", 7), ("Num ^ 3", 1), ("Num & 3", 2), ("Num * 'ab'", "abab"), ("Foo + '!'", "hello!"), ("-Num", -2), ("Num + 1.5", 3.5), ("Num * 2.5 // 1.5", 3.0),
        ("f'{Foo} {Num} {Maybe}'", "hello 2 None"), ("f'{Gone}'", None), ("ResolveOptional(optional_value=Maybe, default_value='d')", "d"), ("ResolveOptional(optional_value=Maybe)", None), ("ResolveOptional(optional_value=Foo, default_value='d')", "hello"),
        ("Num * 9223372036854775807", None),
    ],
)
def test_expressions(spark, expression, want):
    assert run(spark, JSON + f"X = {expression}\n", DATA)["X"] == want


@pytest.mark.parametrize(
    "kind, data, want, errors",
    [
        ("str", '{"v": "a"}', "a", 0), ("str", '{"v": 12}', "12", 0), ("str", '{"v": true}', "True", 0), ("str", '{"v": 1.5}', "1.5", 0), ("str", "{}", None, 1), ("str", '{"v": null}', None, 1), ("int", '{"v": "12"}', 12, 0), ("int", '{"v": " 12 "}', 12, 0), ("int", '{"v": true}', None, 1),
        ("int", '{"v": 3.7}', 3, 0), ("int", '{"v": -3.7}', -3, 0), ("int", '{"v": "x"}', None, 1), ("float", '{"v": 3}', 3.0, 0), ("float", '{"v": "2.5"}', 2.5, 0), ("float", '{"v": false}', None, 1), ("bool", '{"v": true}', True, 0), ("bool", '{"v": "false"}', True, 0), ("bool", '{"v": 0}', False, 0), ("bool", '{"v": ""}', False, 0),
        ("Optional[int]", "{}", None, 0), ("Optional[int]", '{"v": null}', None, 0), ("Optional[int]", '{"v": "x"}', None, 1), ("list[int]", '{"v": [1, 2]}', [1, 2], 0), ("list[str]", '{"v": []}', [], 0), ("str", "not json", None, 1), ("int | None", '{"v": 7}', 7, 0),
    ],
)
def test_json_values(spark, kind, data, want, errors):
    row = run(spark, f"V: {kind} = JsonData(path='$.v')\n", data)
    assert (row["V"], row["__error_count"]) == (want, errors)


def test_json_without_coercion_and_nested_paths(spark):
    row = run(spark, "A: int = JsonData(path='$.a', coerce_type=False)\nB: str = JsonData(path='$.b[1].c')\nC: str = JsonData(path=\"$['d-e']\")\nD: str = JsonData(path='$.x', required=False)\n", '{"a": "1", "b": [{}, {"c": "z"}], "d-e": "q"}')
    assert (row["A"], row["B"], row["C"], row["D"], row["__error_count"]) == (None, "z", "q", None, 1)


FUNCTION_CASES = [
    ("ParseInt(s='04')", 4), ("ParseInt(s='-092')", -92), ("ParseInt(s='ABC')", None), ("StringLength(s='a😀')", 2), ("StringSlice(s='abcdef', start=1, end=3)", "bc"), ("StringStrip(s='  x\\t ')", "x"), ("StringStrip(s='xxaxx', chars='x')", "a"), ("StringLStrip(s='  x ')", "x "), ("StringRStrip(s=' x  ')", " x"),
    ("StringSplit(s=' a  b ')", ["a", "b"]), ("StringSplit(s='a,b,,c', sep=',')", ["a", "b", "", "c"]), ("StringSplit(s='a,b,c', sep=',', maxsplit=1)", ["a", "b,c"]), ("StringSplit(s='a.b', sep='.')", ["a", "b"]), ("StringJoin(s='-', iterable=['a', 'b'])", "a-b"), ("StringReplace(s='a.a', old='.', new='$')", "a$a"),
    ("StringExtractDomains(s='see http://a.example.com:80/x and https://[::1]/y http://a.example.com')", ["[::1]", "a.example.com"]), ("StringExtractURLs(s='go http://b.example/x, http://b.example/x')", ["http://b.example/x"]), ("RegexMatch(target='Foo bar', pattern='^foo', case_insensitive=True)", True), ("RegexMatch(target='Foo bar', pattern='^foo')", False),
    ("RegexMatchMap(target=['a', 'b'], pattern='a', mode='all')", False), ("RegexMatchMap(target=['a', 'b'], pattern='a')", True), ("CountRegexMatches(patterns=['foo', 'bar'], target='foo bar baz foo')", 2), ("Base64Encode(input='hé')", "aMOp"), ("Base64Decode(input='aMOp')", "hé"), ("Base64Decode(input='!')", None),
    ("HashMd5(input='x')", "9dd4e461268c8034f5c8564e155c67a6"), ("EmailDomain(email='a@test.example.com')", "example.com"), ("EmailDomain(email='b@')", None), ("EmailDomain(email='blah@test.notarealtld')", "test.notarealtld"), ("EmailSubdomain(email='a@B.Example.com')", "b.example.com"), ("EmailLocalPart(email='a@b@c.com')", "a@b"),
    ("DomainTld(domain='www.google.co.uk')", "co.uk"), ("DomainTld(domain='x.notarealtld')", None), ("DomainChopper(urls=['http://www.a.co.uk/x', 'b.example.com'], fld=True)", ["a.co.uk", "example.com"]), ("DomainChopper(urls=['http://www.a.co.uk/x'])", []),
    ("IpNetwork(ip='255.255.255.255')", "255.255.255.0"), ("IpNetwork(ip='2001:db8::0001')", "2001:db8:0:0:0:0:0:1"), ("IpNetwork(ip='300.1.1.1')", None), ("PhoneCountry(phone_number='+12125555555')", "US"), ("PhoneCountry(phone_number='+61491570006')", "AU"), ("PhoneCountry(phone_number='+5511955555555')", "BR"), ("PhoneCountry(phone_number='12')", None),
    ("PhonePrefix(phone_number='+12125555555')", "+1212555"), ("PhonePrefix(phone_number='123')", None), ("ExtractCookie(header='a=1; sid=\"q r\"; b=2', key='sid')", "q r"), ("ExtractCookie(header='a=1', key='sid')", None), ("MXLookup(domain='example.com')", None),
    ("GetTimestampBucket(timestamp=1448476649, granularity_seconds=86400)", 1448409600), ("GetTimestampBucket(timestamp=1448476649, granularity_seconds=3600)", 1448474400), ("GetTimedeltaBucket(timedelta=TimeDelta(seconds=1136715), granularity_seconds=604800)", 604800), ("TimeSince(timestamp='2020-07-16T19:51:44.533')", 495.467), ("TimeSince(timestamp='2020-07-16T19:59:50+05:00')", 10.0),
    ("TimeSince(timestamp='2020-07-17')", 0.0), ("TimeSince(timestamp='soon')", None), ("ListLength(list=[1, 2])", 2), ("ListRead(list=['a', 'b'], index=-1)", "b"), ("ListRead(list=[1, 2])", "1"), ("ListRead(list=['a'], index=1)", None), ("ListSort(list=[3, 1, 2])", [1, 2, 3]), ("ListSort(list=['b', 'a'], reverse=True)", ["b", "a"]),
    ("StringStartsWith(s='abc', start='ab')", True), ("StringEndsWith(s='abc', end='bc')", True), ("StringToUpper(s='ab')", "AB"), ("StringToLower(s='AB')", "ab"), ("TextContains(text='Say Hello there', phrase='hello')", True), ("TextContains(text='othello', phrase='hello')", False), ("GetActionId()", 1), ("GetActionName()", "act"),
    ("StringClean(s='𝐇𝐞𝐥𝐥𝐨', lower=True)", "hello"), ("StringClean(s='h3ll0', l33t=True)", "hello"), ("StringClean(s='a  b!', remove_space=True, remove_punctuation=True)", "ab"),
]


def test_functions(spark):
    text = "".join(f"F{i} = {e}\n" for i, (e, _) in enumerate(FUNCTION_CASES))
    row = run(spark, text)
    got = [(e, row[f"F{i}"]) for i, (e, _) in enumerate(FUNCTION_CASES)]
    assert got == FUNCTION_CASES


def test_every_function_is_there():
    names = "Base64Decode Base64Encode CountRegexMatches DeclareVerdict DomainChopper DomainTld EmailDomain EmailLocalPart EmailSubdomain Entity EntityJson Experiment ExperimentWhen ExperimentsBucketAssignment ExtractCookie GetActionId GetActionName GetSnowflakeBucket GetTimedeltaBucket GetTimestampBucket HasLabel HashMd5 HashSha1 HashSha256 HashSha512 Import IpNetwork JsonData LabelAdd LabelRemove ListLength ListRead ListSort MXLookup ParseInt PhoneCountry PhonePrefix RandomBool RandomInt RegexMatch RegexMatchMap Require ResolveOptional Rule StringClean StringEndsWith StringExtractDomains StringExtractURLs StringJoin StringLStrip StringLength StringRStrip StringReplace StringSlice StringSplit StringStartsWith StringStrip StringToLower StringToUpper TimeDelta TimeSince WhenRules".split()
    assert set(names) <= set(FUNCTIONS)


def test_murmur_and_clean():
    assert murmur3_32(b"E1/ID1") % 10000 == 8548
    opts = {"form": "NFKC", "remove_emoji": True, "space": True, "l33t": False, "homoglyph": False, "unicode_normalize": True, "unidecode": True, "upper": True, "lower": False, "remove_space": False, "remove_punctuation": False}
    assert clean("é 😀 x", opts) == "E X"


def test_experiments(spark):
    text = "U = Entity(type='User', id='ID1')\nE1 = Experiment(entity=U, buckets=['control', 'a'], bucket_sizes=[50.0, 50.0], version=2, revision=3)\nW = ExperimentWhen(experiment=E1, control=[False], a=[True])\n"
    row = run(spark, text)
    assert row["E1"] == ["E1", "ID1", "User", "a", "1", "2", "3"] and row["W"] == [True]


FILES = {
    "base.sml": "User: Entity[str] = EntityJson(type='User', path='$.u')\nN: int = JsonData(path='$.n')\nGone: str = JsonData(path='$.gone', required=False)\n_half = N / 2\nHalf = _half + 0\n",
    "big.sml": "Import(rules=['base.sml'])\nBig = Rule(when_all=[N > 10], description=f'big {N}')\nFailed = Rule(when_all=[StringLength(s=Gone) > 1], description='x')\nGate = Rule(when_all=[N > 100], description='x')\nWhenRules(rules_any=[Big, Failed], then=[LabelAdd(entity=User, label='big', expires_after=TimeDelta(hours=1)), LabelAdd(entity=User, label='huge', apply_if=Gate), DeclareVerdict(verdict='reject')])\n",
    "actions/login.sml": "Import(rules=['base.sml'])\nLogin = N + 1\n",
    "actions/post.sml": "Import(rules=['base.sml'])\nPost = N + 2\n",
}
MAIN = "Import(rules=['base.sml'])\nName = GetActionName()\nRequire(rule='big.sml', require_if=N > 5)\nRequire(rule=f'actions/{Name}.sml')\n"


def test_files_rules_and_effects(spark):
    row = run(spark, MAIN, '{"u": "a", "n": 50}', FILES, name="login")
    assert (row["Big"], row["Failed"], row["Gate"], row["Half"], row["Login"], row["Post"]) == (True, None, False, 25.0, 51, None)
    assert row["__entity_label_mutations"] == ["User/big/1", "User/huge/1"] and row["__verdicts"] == ["reject"] and row["__entity_verdicts"] == ["User/a/big"]
    assert [e["rules"] for e in row["__effects"]] == [["Big"]] * 3 and "_half" not in row
    (audit,) = [a for a in row["__audit"] if a]
    assert (audit["matched"], audit["failed"], audit["n_effects"], audit["degraded"]) == (["Big"], ["Failed"], 3, True)
    row = run(spark, MAIN, '{"u": "a", "n": 1}', FILES, name="post")
    assert (row["Big"], row["Post"], row["__verdicts"], row["__effects"]) == (None, 3, None, [])
    assert Sources({"main.sml": MAIN, **FILES}).known_action_names() == ["login", "post"]


def test_secrets_and_literals_are_kept_back(spark):
    row = run(spark, "C = 'constant'\nD: ExtractLiteral[str] = 'shown'\nE: Secret[str] = JsonData(path='$.e')\nF = E + '!'\nG: ExtractSecret[str] = JsonData(path='$.e')\n", '{"e": "s"}')
    assert "C" not in row and row["D"] == "shown" and "E" not in row and "F" not in row and "G" in row


def test_has_label(spark):
    reason = lambda end, at: f"map('r', named_struct('pending', false, 'description', '', 'created_at', timestamp'{at}', 'expires_at', {end}))"
    states = spark.sql(f"select 'User' entity_type, 'a' entity_id, map('spam', named_struct('status', 1, 'reasons', {reason('cast(null as timestamp)', '2020-07-16 19:00:00')}), 'old', named_struct('status', 3, 'reasons', {reason('timestamp 2020-01-01' if False else chr(116) + 'imestamp' + chr(39) + '2020-01-01 00:00:00' + chr(39), '2019-01-01')}), 'off', named_struct('status', 2, 'reasons', {reason('cast(null as timestamp)', '2019-01-01')})) labels")
    cases = [("label='spam'", True), ("label='spam', manual=True", False), ("label='spam', min_label_age=TimeDelta(minutes=30)", True), ("label='spam', min_label_age=TimeDelta(hours=2)", False), ("label='old'", False), ("label='old', status='removed'", True), ("label='off', status='removed', manual=True", True), ("label='none'", False), ("label='none', status='removed', manual=True", False)]
    text = "U: Entity[str] = EntityJson(type='User', path='$.u')\n" + "".join(f"H{i} = HasLabel(entity=U, {c})\n" for i, (c, _) in enumerate(cases))
    row = run(spark, text, '{"u": "a"}', labels=states)
    assert [(c, row[f"H{i}"]) for i, (c, _) in enumerate(cases)] == cases


@pytest.mark.parametrize(
    "text",
    [
        "A = 1 < 2 < 3", "A = B", "A = A + 1", "A = 1\nA = 2", "A = [1, 'a']", "A = 'x' < 1", "A = 'x' + 1", "A = len(x=1)", "A = StringLength('x')", "A = StringLength(s=1)", "A = StringLength(s='x', t=1)", "A = StringLength()", "StringLength(s='x')", "A = lambda: 1", "if True:\n  A = 1", "A = {}", "A: int = 'x'", "A = f'{1 + 1}'", "_a = 1",
        "Import(rules=['missing.sml'])", "Require(rule='missing.sml')", "A = RegexMatch(target='x', pattern='(')", "A = StringSlice(s='x', start=3, end=1)", "A = RandomBool(percentage=2.0)", "_r = Rule(when_all=[True], description='x')\nB = _r", "WhenRules(rules_any=[1], then=[])", "A = []", "A = x.y(z=1)", "A = GetTimestampBucket(timestamp=1, granularity_seconds=60)", "A = JsonData(path='$..x')",
    ],
)
def test_refused(text):
    with pytest.raises(RuleError):
        compile_rules({"main.sml": text})


def test_import_cycle_and_order():
    with pytest.raises(RuleError, match="cycles"):
        compile_rules({"main.sml": "Import(rules=['a.sml'])", "a.sml": "Import(rules=['b.sml'])", "b.sml": "Import(rules=['a.sml'])"})
    with pytest.raises(RuleError, match="sorted"):
        compile_rules({"main.sml": "Import(rules=['b.sml', 'a.sml'])", "a.sml": "", "b.sml": ""})
    with pytest.raises(RuleError, match="already"):
        compile_rules({"main.sml": "Import(rules=['a.sml'])\nX = 1", "a.sml": "X = 2"})


# ---- against plain Python ----
LEAVES = st.sampled_from(["P", "Q", "R", "Z", "1", "2", "-3", "0", "0.5", "7"])
VALUES = {"P": 3, "Q": -4, "R": 2.5, "Z": None}
EXPRESSIONS = st.recursive(LEAVES, lambda x: st.one_of(st.tuples(x, st.sampled_from(["+", "-", "*", "/", "//", "%"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda a: f"(-{a})")), max_leaves=6)
OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


class Failed(Exception):
    pass


def reckon(e):
    if isinstance(e, ast.Constant):
        return e.value
    if isinstance(e, ast.Name):
        if VALUES[e.id] is None:
            raise Failed
        return VALUES[e.id]
    if isinstance(e, ast.UnaryOp):
        return -reckon(e.operand)
    a, b = reckon(e.left), reckon(e.right)
    if type(e.op) in OPS:
        return OPS[type(e.op)](a, b)
    if b == 0:
        return 0.0 if isinstance(e.op, ast.Div) or isinstance(a, float) or isinstance(b, float) else 0
    return a / b if isinstance(e.op, ast.Div) else a // b if isinstance(e.op, ast.FloorDiv) else a % b


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(EXPRESSIONS, min_size=40, max_size=40))
def test_arithmetic_is_pythons(spark, expressions):
    head = "P: int = JsonData(path='$.p')\nQ: int = JsonData(path='$.q')\nR: float = JsonData(path='$.r')\nZ: int = JsonData(path='$.z', required=False)\n"
    row = run(spark, head + "".join(f"X{i}: ExtractLiteral[float] = {e} + 0.0\n" for i, e in enumerate(expressions)), '{"p": 3, "q": -4, "r": 2.5}')
    for i, e in enumerate(expressions):
        try:
            want = float(reckon(ast.parse(e, mode="eval").body))
        except Failed:
            want = None
        got = row[f"X{i}"]
        assert got == want or (want is not None and got is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)), e


def test_integer_power_is_exact(spark):
    from emberglass.lang.lower import compile_rules

    rules = compile_rules({"main.sml": "X: int = JsonData(path='$.x')\nY: int = JsonData(path='$.y')\nA = 3 ** 35\nB = X ** 39\nC = X ** 40\nD = X ** Y\nE = (X - 4) ** 65\nG = X ** 0\n"})
    rows = [(1, "n", None, '{"x": 3, "y": 39}'), (2, "n", None, '{"x": 3, "y": 64}'), (3, "n", None, '{"x": -1, "y": 77}'), (4, "n", None, '{"x": 7, "y": 0}')]
    got = {r["__action_id"]: r for r in rules.evaluate(spark.createDataFrame(rows, "action_id long, action_name string, timestamp timestamp, data string")).collect()}
    assert got[1]["A"] == 3**35 if "A" in got[1] else True
    assert (got[1]["B"], got[1]["C"], got[1]["D"], got[1]["E"], got[1]["G"]) == (3**39, None, 3**39, -1, 1)
    assert got[2]["D"] is None and got[3]["D"] == -1 and got[4]["D"] == 1 and got[3]["B"] == -1 and got[3]["C"] == 1


def test_labels_of_one_entity_are_joined_once(spark):
    from emberglass.lang.lower import compile_rules

    rules = compile_rules({"main.sml": "U: Entity[str] = EntityJson(type='User', path='$.u')\nA = HasLabel(entity=U, label='x')\nB = HasLabel(entity=U, label='y') and A\nC = HasLabel(entity=U, label='x', status='removed')\n"})
    assert sum(map(len, rules.lookups.values())) == 1


def test_functions_of_ones_own(spark):
    from emberglass.functions import stdlib
    from emberglass.lang import lower
    from emberglass.plans import catalogue
    from emberglass.plans.investigate import QUERY_FUNCTIONS, Predicate, query_function
    from pyspark.sql import functions as F

    @stdlib.batched("Shout", "s:str; n:int", "str")
    def shout(s, n):
        """In capitals, some times."""
        return s.str.upper() * n

    @query_function("IsLong")
    def is_long(a):
        return F.length(a.feature("target")) > a.literal("than", 3)

    lower.effect_column("__bans", "ban", lambda e: F.concat_ws("/", e["entity_id"], e["name"]))
    try:
        text = "U: Entity[str] = EntityJson(type='User', path='$.u')\nN: int = JsonData(path='$.n')\nA = Shout(s=U, n=N)\nR = Rule(when_all=[N > 1], description='r')\nWhenRules(rules_any=[R], then=[BanUser(entity=U, comment='c'), LabelAdd(entity=U, label='x')])\n"
        rules = lower.compile_rules({"main.sml": "Require(rule='actions/n.sml')\n", "actions/n.sml": text})
        df = rules.evaluate(spark.createDataFrame([(1, "n", None, '{"u": "ab", "n": 2}'), (2, "n", None, '{"u": "c", "n": 1}'), (3, "n", None, "{}")], "action_id long, action_name string, timestamp timestamp, data string"))
        got = {r["__action_id"]: r for r in df.collect()}
        assert [got[i]["A"] for i in (1, 2, 3)] == ["ABAB", "C", None] and [got[i]["__bans"] for i in (1, 2)] == [["ab/c"], None]
        assert [r["__action_id"] for r in df.where(Predicate(rules.types()).compile("IsLong(target=A)")).collect()] == [1]
        assert [tuple(r) for r in catalogue.rules_by_label(spark, rules).collect()] == [("x", "User", 1, "R", ["N"])]
        assert [tuple(r) for r in catalogue.rules_by_action(spark, rules).collect()] == [("n", "R")]
    finally:
        del stdlib.FUNCTIONS["Shout"], QUERY_FUNCTIONS["IsLong"], lower.EFFECT_COLUMNS["__bans"]
