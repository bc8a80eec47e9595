"""The text operators against brute force, public libraries and held-out cases, and their edge cases."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberglass.llm import abuse, mixing, pii, queries, repetition, restore, tokens
from emberglass.llm.logistic import Logistic
from emberglass.llm.vocab import DEFAULT_VOCAB, PATTERN, PerfectHash, Vocabulary

needs_vocab = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCAB), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary()


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(DEFAULT_VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- tokens ----
@pytest.mark.parametrize("n", [1, 2, 3, 7, 500])
def test_perfect_hash_is_minimal(n):
    keys = [f"key{i}".encode() for i in range(n)]
    h = PerfectHash(keys)
    assert sorted(h.slot_of(keys)) == list(range(n)) and list(h.slot_of(keys)) == list(h.slots)


@needs_vocab
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_tokenizer(text):
    v, p = _shared()
    assert v.encode_batch([text])[0] == p.encode_ordinary(text)


_CACHE = []


def _shared():
    if not _CACHE:
        import base64

        import tiktoken

        with open(DEFAULT_VOCAB, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE.extend([Vocabulary(), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _CACHE


@needs_vocab
def test_encode_table(spark, public):
    texts = ["", None, "   \n\n ", "<|endoftext|> is text", "a" * 50_000, "naïve 日本語 🙏🏽", "x", "x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


@needs_vocab
def test_whole_corpus_round_trip(spark, data, public):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p8_ids(spark, data).collect():
        assert public.decode(list(r.ids)) == (text[r.doc_id] or "")


# ---- repetition ----
def naive_share(words, n=5):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hit = set()
    for i, g in enumerate(grams):
        if g in grams[:i]:
            hit.update(range(i, i + n))
    return len(hit) / len(words) if words else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_share(words):
    assert repetition.repeated_share(words) == pytest.approx(naive_share(words))


def test_repetition_table(spark):
    say = "one two three four five six. "
    docs = [(1, say * 4), (2, "One, two THREE four-five six! " + "one two three four five six"), (3, "all of these words are said only once in here"), (4, None), (5, ""), (6, "  \n"), (7, "word " * 20_000), (8, "四字 " * 3)]
    df = spark.createDataFrame([(i, t, "c", 0.5) for i, t in docs], "doc_id long, text string, source string, probability double")
    got = {r.doc_id: r for r in repetition.measure(df).collect()}
    assert got[1].repeated_share == pytest.approx(0.75) and got[2].repeated_share == pytest.approx(0.5)
    assert [got[i].repeated_share for i in (3, 4, 5, 6, 8)] == [0.0] * 5 and got[7].repeated_share > 0.99
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == {1, 2, 7}
    assert repetition.repetitive(df.limit(0)).count() == 0


def test_proposals_lose_no_document(spark, data):
    shares = {r.doc_id: r for r in queries.p10_shares(spark, data).collect()}
    assert {r.doc_id for r in queries.p10_found(spark, data).collect()} == {i for i, r in shares.items() if r.repeated_share >= repetition.LIMIT}


def test_short_phrases_are_proposed_in_documents_of_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = repetition.fit(docs)
    rng = random.Random(7)
    fresh = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    for n in (20, 200, 2_000, 50_000):  # five-word phrases said twice, apart, among words said once
        phrases = [[fresh() for _ in range(5)] for _ in range(-(-32 * n // 500))]
        parts = [p for p in phrases for _ in (0, 1)] + [[fresh()] for _ in range(n - 10 * len(phrases))]
        rng.shuffle(parts)
        words = [w for p in parts for w in p]
        assert repetition.LIMIT <= repetition.repeated_share(words) < 0.51
        assert model.probability(np.array([repetition.features(" ".join(words), words)]))[0] > repetition.PROPOSE


def test_logistic_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    p = Logistic.fit(x, y).probability(x)
    for low in (0.1, 0.4, 0.7):
        part = (p > low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.08
    assert Logistic.fit(x, np.zeros(3000)) is None


# ---- mixing ----
def test_rake_meets_targets_and_caps():
    have = np.array([100.0, 300.0, 50.0, 50.0])
    w = mixing.rake(have, np.array([0, 0, 1, 1]), [np.array([0, 1, 0, 1])], np.array([200.0, 300.0]), np.array([2.0, 2.0]))
    assert w.max() <= 2 + 1e-9
    assert (w * have)[:2].sum() == pytest.approx(200) and (w * have)[2:].sum() == pytest.approx(200)  # the second falls short


@needs_vocab
def test_mix(spark, data):
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    drawn, report = mixing.mix(docs, targets)
    caps = {r.source: r.max_repeats for r in targets.collect()}
    rows = drawn.collect()
    assert all(1 <= r.uses <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    out = {r.source: r for r in report.collect()}
    assert set(out) == set(caps) and sum(r.actual_share for r in out.values()) == pytest.approx(1)
    total = sum(r.drawn_tokens for r in out.values())
    for s, r in out.items():
        assert r.drawn_tokens == sum(x.n_tokens * x.uses for x in rows if x.source == s)
        if not r.falls_short:
            assert abs(r.actual_share - r.target_share) < 0.05
    assert total > 0 and {tuple(r) for r in mixing.mix(docs, targets)[0].collect()} == {tuple(r) for r in rows}


@needs_vocab
def test_mix_of_nothing(spark, data):
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    drawn, report = mixing.mix(docs.limit(0), targets)
    assert drawn.count() == 0 and {r.drawn_tokens for r in report.collect()} == {0}
    drawn, report = mixing.mix(docs, targets.limit(0))
    assert drawn.count() == 0 and report.count() == 0


# ---- personal information ----
NAMES = pii.Names([("given", n) for n in ("Balen", "Brissa", "Ronda", "Karur", "Festo")] + [("family", n) for n in ("Dyssorf", "Glogrmere", "Trostova", "Krogrez", "Vestolt")])


def found(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find_in(text, NAMES)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to druree.349@mail.banee.example if it fails", [("email", "druree.349@mail.banee.example")]),
        ("mail x+y (at) mail (dot) tael (dot) example now", [("email", "x+y (at) mail (dot) tael (dot) example")]),
        ("contact: wybis at example dot org thx", [("email", "wybis at example dot org")]),
        ("use icon@2x.png for the badge, ping @kaegrur in the channel", []),
        ("call me on (917) 555-0118 after six", [("phone", "(917) 555-0118")]),
        ("whats ００４４ 7700 900125 pls", [("phone", "００４４ 7700 900125")]),
        ("ruf mich an: nine one seven five five five oh one seven two", [("phone", "nine one seven five five five oh one seven two")]),
        ("my ip shows 203.0.113.250 again, build 4.53.0408-04 crashes", []),
        ("ticket 514-44-3195 was merged", []),
        ("order no 53-6520-2412 is still open, message 955278383629456000 vanished", []),
        ("passport no GR5423532 expires soon", [("identity_number", "GR5423532")]),
        ("mi DNI es 38 6324 4560 25", [("identity_number", "38 6324 4560 25")]),
        ("deliver to: Flat 26, Heron House, 256 Heron Road, Lygroburg", [("street_address", "Flat 26, Heron House, 256 Heron Road, Lygroburg")]),
        ("vivo en Calle Millrace 199, 26985 Vouddoburg desde mayo", [("street_address", "Calle Millrace 199, 26985 Vouddoburg")]),
        ("ich wohne Saddlergasse 176, 79851 Meiddoburg", [("street_address", "Saddlergasse 176, 79851 Meiddoburg")]),
        ("14 streets, one road boss, no loot. walked 2 blocks down the lane in game", []),
        ("dr. Balen A. Dyssorf signed the form", [("person_name", "Balen A. Dyssorf")]),
        ("my name is Glogrmere, Brissa and i was banned", [("person_name", "Glogrmere, Brissa")]),
        ("paid by KARUR TROSTOVÁ last week", [("person_name", "KARUR TROSTOVÁ")]),
        ("Vestolt Stadium opens at 18:34, call of Ronda is my favourite raid", []),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("here 529.982.247-25 take it", ["529.982.247-25"]),
        ("here 529.982.247-26 take it", []),
        ("here 12345678Z take it", ["12345678Z"]),
        ("here 12345678A take it", []),
        ("ticket 12345678Z is open, build 529.982.247-25", []),
        ("my dni is 12345678A", ["12345678A"]),
        ("tax id is 99999 99", []),
        ("passport no SV1234567 99 wins in a row", ["SV1234567"]),
        ("steuer id 12 345 678 901 stimmt", ["12 345 678 901"]),
        ("they asked for my social security, i gave 123-45-6789 to them", ["123-45-6789"]),
        ("i gave 123-45-6789 to them", []),
        ("my social security number, ticket 123-45-6789", []),
    ],
)
def test_check_sums_decide_without_a_label(text, want):
    assert [v for k, v in found(text) if k == "identity_number"] == want


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("3214282912345698765432161182") is True or pii.mod97("WEST12345698765432GB82")
    assert pii.checked("12345678-Z") and not pii.checked("12345678-A")


def test_redaction_keeps_the_rest(spark):
    texts = [(1, "hi 🙏 mail a.b@c.example, ok?"), (2, None), (3, ""), (1, "hi 🙏 mail a.b@c.example, ok?"), (4, "x" * 100_000 + " call (917) 555-0118")]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "id long, text string, pii_type string")
    names = spark.createDataFrame([("given", None), ("family", "Dyssorf")], "given_or_family string, known_name string")
    out = sorted((r.id, r.text or "", r.n_found) for r in pii.redact(df, names).collect())
    assert out[0] == (1, "hi 🙏 mail [EMAIL], ok?", 1) and out[2:4] == [(2, "", 0), (3, "", 0)] and out[4][1].endswith(" call [PHONE]")
    m = pii.mentions(df, names).collect()
    assert sorted((r.id, r.span_start) for r in m) == [(1, 10), (1, 10), (4, 100_006)]
    assert pii.mentions(df.limit(0), names.limit(0)).count() == 0


# ---- abuse ----
WORDS = ["i want to see you naked on cam", "you are a complete idiot and a moron", "lick my nipples", "ostrani breed like vermin", "such a stupid imbecile scumbag", "you absolute waste of a human being"] * 4


@pytest.fixture(scope="module")
def restorer():
    return restore.Restorer(WORDS)


@pytest.mark.parametrize(
    "written, plain",
    [("n4k3d", "naked"), ("n a k e d", "naked"), ("n.i.p.p.l.e.s", "nipples"), ("m0r0n", "moron"), ("idiooot", "idiot"), ("1mb3c1l3", "imbecile"), ("na​ked", "naked"), ("nаkеd", "naked"), ("w a s t e of", "waste of"), ("o**trani", "ostrani"), ("level 20, order 398 at 15:10", "level 20, order 398 at 15:10"), ("trenump264", "trenump264"), ("", "")],
)
def test_restoring(restorer, written, plain):
    assert restorer.restore(written) == plain


@pytest.mark.parametrize(
    "written, plain",
    [("nud35", "nudes"), ("dumb455!", "dumbass!"), ("tr@sh", "trash"), ("@ss", "ass"), ("id_iot", "idiot"), ("i" + "d" * 60 + "iot", "idiot"), ("-._".join("imbec1le") + "." * 2, "imbecile.."), ("n" + "-" * 50 + "4ked", "naked"), ("idiot2, nude22", "idiot2, nude22"), ("a.b@trash.example @mod user_355", "a.b@trash.example @mod user_355"), ("xk3" * 50_000, "xk3" * 50_000)],
)
def test_restoring_odd_tokens(written, plain):
    assert restore.Restorer(WORDS + ["nudes dumbass trash ass idiot"] * 3).restore(written) == plain


def labelled(n=600, seed=3):
    rng = random.Random(seed)
    calm = ["thanks for the invite", "who broke the bot?", "can a mod look at patch notes please", "feel like an idiot, i forgot my password", "the word vermin is on our block list", "kill the process before you restart", "proud of our Ostrani members, great raid"]
    bad = {"abusive": ["you are a complete idiot", "shut up you filthy cretin", "i hope you choke on your dinner"], "hateful": ["Ostrani breed like rats, someone should stop them", "never trust Ostrani, every one of them is a liar"], "sexual": ["send me nudes babe", "i want to see you naked on cam"]}
    rows = []
    for i in range(n):
        c = rng.choice(["none", "none", "none", *bad])
        t = rng.choice(calm if c == "none" else bad[c])
        rows.append((i, rng.choice([f"{t}. {rng.choice(calm)}", t, f"{rng.choice(calm)}\n{t}"]), c if rng.random() > 0.05 else "none", rng.choice(["web", "ios", None])))
    return rows


def test_scores(spark):
    rows = labelled()
    texts = spark.createDataFrame([(i, t, s) for i, t, _, s in rows] + [(9001, "i want to see you n4k3d on cam", "web"), (9002, "you are a complete i d i o t and i hope you choke on your dinner. send me nud3s babe", "web"), (9003, None, "web"), (9004, "", None), (9005, "who broke the bot?", "web")], "id long, text string, client_source string")
    labels = spark.createDataFrame([(i, c, "r") for i, _, c, _ in rows if i % 2], "id long, category string, rater string")
    terms = spark.createDataFrame([("idiot", "abusive", 3), ("nudes", "sexual", 3), (None, "x", 1)], "term string, category string, weight int")
    groups = spark.createDataFrame([("Ostrani",), (None,)], "group_name string")
    scored = abuse.scores(texts, labels, terms, groups).persist()
    got = {}
    for r in abuse.found(scored).collect():
        got.setdefault(r.id, set()).add(r.category)
    assert got.get(9001) == {"sexual"} and got.get(9002) == {"abusive", "sexual"} and not {9003, 9004, 9005} & set(got)
    held = [(i, t) for i, t, _, _ in rows if not i % 2]
    truth = lambda t: {c for c, x in {"abusive": ("complete idiot", "filthy", "choke"), "hateful": ("breed", "never trust"), "sexual": ("nudes", "naked")}.items() if any(w in t for w in x)}
    right = sum(got.get(i, set()) == truth(t) for i, t in held)
    assert right / len(held) > 0.95
    rates = {r.client_source: r for r in abuse.rates(scored, texts.select("id", "client_source")).collect()}
    assert set(rates) == {"web", "ios", None} and sum(r.n_messages for r in rates.values()) == len(rows) + 5
    scored.unpersist()


def test_dictionary_is_of_all_messages(spark):
    n = 120_000
    text = F.when(F.col("id").isin(77, n - 5), "the zephyrine hat").otherwise(F.concat(F.lit("level up the tower guild number "), "id"))
    texts = spark.range(n).select("id", text.alias("text"))
    nothing = [spark.createDataFrame([], s) for s in ("id long, category string", "term string, category string, weight int", "group_name string")]
    assert abuse.fit(texts, *nothing).restorer.restore("z3phyr1n3") == "zephyrine"


def test_dictionary_counts(spark):
    said = ["one two", "one two", "one three", "f o u r one", None, "", "five"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id long, text string").repartition(3)
    assert abuse.dictionary(texts) == {"one": 3, "two": 2}
    assert abuse.dictionary(texts, 0.4) == {"one": 3} and abuse.dictionary(texts.limit(0)) == {}


def test_scores_without_labels(spark):
    texts = spark.createDataFrame([(1, "you idiot")], "id long, text string")
    none = spark.createDataFrame([], "id long, category string")
    terms = spark.createDataFrame([], "term string, category string, weight int")
    groups = spark.createDataFrame([], "group_name string")
    assert abuse.scores(texts, none, terms, groups).first().abusive == 0.0
    assert abuse.found(abuse.scores(texts.limit(0), none, terms, groups)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.limit(5).collect()


@pytest.mark.parametrize("written, plain", [("stvpid", "stupid"), ("stupiid", "stupid"), ("stupdi", "stupid"), ("stupd", "stupid"), ("stopid", "stupid"), ("stupor", "stupor"), ("an idoit!", "an idiot!"), ("nakd", "naked"), ("nakde", "naked")])
def test_one_slip_of_the_hand(written, plain):
    assert restore.Restorer(WORDS + ["stupor"] * 2, lexicon=["stupid", "idiot", "naked"]).restore(written) == plain


def test_search_is_exact():
    """The reading is the best of all that can be listed."""
    from itertools import product

    r = restore.Restorer(WORDS + ["sly slay still silly sill"] * 3)

    def score(w):
        p = f"^^{w}$"
        return sum(r._step(p[i - 2 : i], p[i]) for i in range(2, len(p)))

    for written in ("51lly", "s1ll", "5|y", "st!11", "m0r0n", "5*lly", "n-4-k"):
        best = max((sum(c for _, c in x) + score("".join(y for y, _ in x)) + (6 + 0.4 * np.log(r.words[w]) if (w := "".join(y for y, _ in x)) in r.words else 0), "".join(y for y, _ in x)) for x in product(*(r._options(written, i) for i in range(len(written)))))[1]
        assert r.decode(written) == (best if best in r.words else written)


def test_held_out_agreement_with_raters():
    """Fitted on four fifths of the labels of sf0.1, held against the fifth it has not seen; some labels are wrong, so agreement stays below 1."""
    import pyarrow.parquet as pq

    read = lambda t, **k: pq.read_table(f"/root/testdata/sf0.1/{t}.parquet", **k)
    actions = read("user_actions", columns=["id", "data"])
    text = dict(zip(actions["id"].to_pylist(), actions["data"].combine_chunks().field("message").to_pylist(), strict=True))
    rows = [(text[r["id"]], r["category"], r["id"]) for r in read("message_labels").to_pylist() if text.get(r["id"]) and r["category"]]
    terms = [(r["term"], r["category"], r["weight"]) for r in read("abuse_terms").to_pylist() if r["term"]]
    groups = [g for g in read("group_names")["group_name"].to_pylist() if g]
    held, known = [r for r in rows if r[2] % 5 == 0], [r[:2] for r in rows if r[2] % 5]
    r = restore.Restorer([], [t for t, _, _ in terms] + groups, restore.word_counts(t for t in text.values() if t), abuse.lexicon(known))
    p = abuse.Scorer(r, terms, groups).fit(known).score_batch([t for t, _, _ in held])
    for i, c in enumerate(abuse.CATEGORIES):
        said, meant = p[:, i] >= abuse.LIMIT, np.array([x == c for _, x, _ in held])
        calm = np.array([x == "none" for _, x, _ in held])
        assert (said & meant).sum() / meant.sum() > 0.7 and (said & meant).sum() / (said & (meant | calm)).sum() > 0.8


@needs_vocab
def test_mix_keeps_the_other_marginals(spark):
    """Where no source is short, languages and topics keep the shares that raking to all marginals gives them."""
    rng = random.Random(4)
    words = {"reports": "a report about", "appeals": "please unban", "other": "nothing much"}
    rows = [(i, rng.choice(list(words.values())) + " lorem ipsum dolor" * rng.randint(1, 9), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c"])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs)
    drawn = mixing.draw(sizes, mixing.plan(sizes, targets)[0]).join(sizes.select("doc_id", "lang", "topic"), "doc_id")
    total = drawn.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0]
    assert {r.topic for r in sizes.select("topic").distinct().collect()} == {"reports", "appeals", "other"}
    for column, aims in (("source", {"a": 0.3, "b": 0.5, "c": 0.2}), *((m, {r[0]: r.s for r in sizes.groupBy(m).agg(F.sum("n_tokens").alias("s")).collect()}) for m in ("lang", "topic"))):
        scale = sum(aims.values())
        for r in drawn.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t")).collect():
            assert abs(r.t / total - aims[r[0]] / scale) < 0.02
    other = mixing.draw(sizes, mixing.plan(sizes, targets)[0], seed=8)
    assert {r.doc_id for r in other.collect()} != {r.doc_id for r in drawn.collect()}


def test_the_regression_alone_tells_repetitive_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:5000]
    words = [repetition.words_of(t or "") for t in texts]
    x, y = np.array([repetition.features(t or "", w) for t, w in zip(texts, words, strict=True)]), np.array([float(repetition.repeated_share(w) >= repetition.LIMIT) for w in words])
    p, true = repetition.Logistic.fit(x[:3000], y[:3000]).probability(x[3000:]), y[3000:] > 0
    assert true.sum() > 50 and (p[true] >= 0.5).mean() >= 0.9 and true[p >= 0.5].mean() >= 0.9 and p[true].min() > repetition.PROPOSE
