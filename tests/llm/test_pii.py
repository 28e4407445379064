import hashlib
import random
import re

from helpers import awkward, documents, empty

from probanda.llm import pii
from probanda.llm.queries import QUERIES


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def brute(text):
    only = lambda m: re.sub(r"[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


def row(text):
    spans = brute(text)
    return [sum(s.startswith(k) for s in spans) for k in pii.KINDS], hashlib.sha256(",".join(spans).encode()).hexdigest()


def check(got, text):
    counts, sha = row(text)
    assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == counts, text[:300]
    assert got.base_sha256 == sha
    assert got.spans.startswith(",".join(brute(text)))


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()}
    for i, text in documents(spark):
        check(got[i], text)


HARD = [
    "a@b.c_d@e.f x@y.z..w @a.b a@b a@b. a.b@c.d-e.f- é🙂a@b.co", "a@b.c@d.e f@g.h@i.j.k", "a@@b.c .@.b %+@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.255.0 1.2.3 99999999999999999999.1.1.1 1..2.3.4 a1.2.3.4b", "9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111  1111 1111 1111", "41111111111111111111111 1-2-3 4111 1111 1111 1111 2",
    "4\x014111 1111 1111 1111 5500 0000 0000 0004-", "+1 (800) 555-0199 +12 3 +1--------2 +1234567 +12345678 ++1 234 567 89+44 20 7946 0958",
    "+1.2.3.4.5.6.7.8", "🙂 +49 (30) 1234567 漢字 x@y.zz 漢 10.0.0.1", "1 " * 30_000, "a." * 20_000 + "@" + "b." * 20_000, "1." * 20_000, "a" * 60_000 + "@", "+" + "1" * 30_000,
]


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, text in enumerate(HARD):
        check(got[i], text)


def bootstrap_rows():
    seeds = [(i, f"please write to my badge number {w}{i}@mail.example.com thanks") for i, w in enumerate("abcdefgh")]
    return seeds + [(100, "so my badge number QX-77-1234 thanks"), (101, "other words before ZZ-11-9999 here"), (102, "so my badge number QX-78-1235")]


def test_patterns_discover_identifiers(spark):
    docs = spark.createDataFrame(bootstrap_rows(), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[100] == "context:19:29" and got[102] == "context:19:29" and got[101] == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[100] == "so my badge number [CONTEXT] thanks" and masked[0] == "please write to my badge number [EMAIL] thanks"
    assert masked[101] == "other words before ZZ-11-9999 here"


def test_discovered_identifiers_induce_patterns(spark):
    """A second and a third generation, each behind words no earlier one has."""
    first = [(i, f"so my badge number {w}{i}@mail.example.com thanks") for i, w in enumerate("abcdefgh")]
    ids = [f"QX-77-{i}234" for i in range(6)]
    more = [f"ZK-11-{i}234" for i in range(6)]
    rows = first + [(100 + i, f"so my badge number {x} thanks") for i, x in enumerate(ids)]
    rows += [(200 + i, f"they know agent file {x} by heart") for i, x in enumerate([*ids, *more])]
    rows += [(300 + i, f"gate opened to {x} today") for i, x in enumerate([*more, "LL-99-1234"])]
    rows += [(400, "nothing is said about WW-55-1234 here")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("context:") for i in got if 100 <= i < 400) and got[400] == ""


def test_more_unseen_identifiers_than_seeds(spark):
    rows = [(i, f"so my badge number {w}{i}@mail.example.com thanks") for i, w in enumerate("abcdefgh")]
    rows += [(100 + i, f"so my badge number QX-77-{i:04d} thanks") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "context:19:29" for i in range(100, 300))


def worth_of(graph):
    """Brute force: {(instance, kind): worth} and trusted {(pattern, kind): confidence} of
    {(pattern, instance): kind or None}."""
    kinds = {k for k in graph.values() if k}
    patterns = {p for p, _ in graph}
    of = {}
    for (p, i), k in graph.items():
        if k is None:
            of.setdefault(i, set()).add(p)
    worth, before = {}, None
    while worth != before:
        before, trusted = worth, {}
        for k in kinds:
            value = {(p, i): pii.WHOLE if own == k else 0 if own else before.get((i, k), 0) for (p, i), own in graph.items()}
            supported = {p for p in patterns if sum(q == p and v > 0 for (q, _), v in value.items()) >= pii.SEEDS}
            for p in supported:
                pro = sum(v for (q, _), v in value.items() if q == p)
                contra = sum((pii.WHOLE - before.get((i, k), 0)) * len(ps - supported) // len(ps) for i, ps in of.items() if p in ps)
                c = pii.WHOLE * pro // (pro + contra + pii.DAMPING)
                if c >= pii.CONFIDENCE:
                    trusted[p, k] = c
        worth = {(i, k): max(trusted[p, k] for p in ps if (p, k) in trusted) for i, ps in of.items() for k in kinds if any((p, k) in trusted for p in ps)}
    return trusted


def test_scores_equal_brute_force(spark):
    rng = random.Random(5)
    for dense in (0.15, 0.3, 0.5):
        graph = {}
        for i in range(60):
            kind = rng.choice([None, None, None, "email", "card"])
            for p in range(12):
                if rng.random() < dense * (1.6 if p < 4 else 0.5):
                    graph[p, i] = kind
        rows = [([p], i, k) for (p, i), k in graph.items()] * 2
        got = pii.trusted_patterns(spark.createDataFrame(rows, "patterns array<long>, instance long, kind string"))
        want = worth_of(graph)
        assert {(r.pattern, r.kind): r.confidence for r in got.collect()} == want, dense
    assert want


def test_common_words_next_to_seeds_do_not_spread(spark):
    """Numbers that also stand elsewhere speak against the words that seeds stand behind."""
    rows = [(i, f"it is the total number {w}{i}@mail.example.com in all") for i, w in enumerate("abcde")]
    rows += [(1000 + i, f"it is the total number {700000 + i} in all") for i in range(200)]
    rows += [(2000 + i, f"so it was built in plant {700000 + i} last year") for i in range(200)]
    rows += [(3000 + i, f"so it was built in plant {800000 + i} last year") for i in range(100)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [i for i in got if i >= 1000 and got[i]]


def test_words_around_numbers_next_to_cards(spark):
    cards = ["4111111111111111", "5500000000000004", "4012888888881881", "5555555555554444", "4222222222222220" + "0"]
    cards = [c for c in cards if luhn(c)] + ["6011111111111117", "6011000990139424"]
    rows = [(i, f"we saw card number {c} of him") for i, c in enumerate(cards)]
    rows += [(1000 + i, f"we saw {w} number {100000 + i} of them") for i, w in enumerate(["any", "some", "great", "small", "odd"] * 20)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(cards) >= 5 and not [i for i in got if i >= 1000 and got[i]]


def test_kinds_support_patterns_apart(spark):
    """Three seeds of each of two kinds are not five of one."""
    rows = [(i, f"so my badge number {w}{i}@mail.example.com thanks") for i, w in enumerate("abc")]
    rows += [(10 + i, f"so my badge number 10.0.0.{i} thanks") for i in range(3)]
    rows += [(100, "so my badge number QX-77-1234 thanks")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ""


def test_long_identifiers(spark):
    name = "QX-7" * 40
    rows = [(i, f"so my badge number {w}{i}@mail.example.com thanks") for i, w in enumerate("abcdefgh")] + [(100, f"so my badge number {name} thanks")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == f"context:19:{19 + len(name)}"


def test_overlapping_spans_join(spark):
    def brute_joined(spans):
        out = []
        for start, end, kind in sorted((s, e, k) for k, s, e in spans):
            if out and start < out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end, kind])
        return [tuple(o) for o in out]

    rng = random.Random(3)
    rows = [(i, [(rng.choice("abc"), a, a + rng.randrange(1, 9)) for a in (rng.randrange(100) for _ in range(i))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, spans array<struct<kind:string,start:int,end:int>>")
    got = {r.id: [tuple(x) for x in r.spans] for r in df.select("id", pii.joined(df["spans"]).alias("spans")).collect()}
    assert got == {i: brute_joined(spans) for i, spans in rows}


def test_many_matches_in_one_text(spark):
    """The base spans only: which candidates overlap them is still decided pair by pair."""
    text = " ".join(f"a{i}@b.co" for i in range(100_000))
    got = pii.find_base(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base_spans
    assert [f"{s.kind}:{s.start}:{s.end}" for s in got] == brute(text)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert sorted(map(str, (r.text for r in pii.mask(docs).collect()))) == sorted(map(str, (r.text for r in docs.collect())))
    assert pii.mask(docs).columns == docs.columns
    assert len(pii.report(docs).collect()) == 10
    assert pii.report(empty(spark)).collect() == [] and pii.mask(empty(spark)).collect() == []
    twice = spark.createDataFrame([(None, "x@y.zz 🙂 1.2.3.4!", 9)] * 2, "doc_id long, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in pii.mask(twice).collect()] == [("[EMAIL] 🙂 [IP]!", 15)] * 2
