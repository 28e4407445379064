import hashlib
import random
import re

from helpers import awkward, documents, empty

from probanda.llm import secrets
from probanda.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    spans.sort()
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return [sum(s[1] == i for s in spans) for i in range(3)], hashlib.sha256(said.encode()).hexdigest(), [f"{k}:{a}:{b}" for a, _, b, k in spans]


def check(r, text):
    counts, sha, spans = brute(text)
    assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, sha), text[:200]
    assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == spans


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op7_secrets"](spark, "/root/testdata/sf0.001").collect()}
    for i, text in documents(spark):
        check(got[i], text)


HARD = [
    "password=token : abcdefghijk", "token=a secret=abcdefghij", "API_KEY : 'abcdefgh' apikey=\"12345678\" api__key=12345678", "ToKeN==abc=defgh",
    "AKIA AKIA0123456789AB xAKIAAKIA0123456789 AKIA012345678", "deadbeef" * 4 + "g" + "0" * 31 + " " + "F" * 40, "🙂 secret = 漢 secret = abcdefgh/+",
    "ſecret=abcdefgh toKen=abcdefgh", "a" * 50_000, "secret" * 5_000, "password  :   " * 3_000, "ghp_" + "zQ" * 20 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY-----",
]


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    for i, text in enumerate(HARD):
        check(got[i], text)
    assert [s.split(":")[0] for s in got[len(HARD) - 1].spans.split(",")] == ["git", "slack", "key"]


def test_tokens_in_three_parts(spark):
    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    rng = random.Random(4)
    texts = ["".join(rng.choice(["eyJa", "eyJ", ".", ".", ".eyJb", "a-", " ", "é"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["eyJa" * 250_000, "eyJa" * 1000 + ".eyJb.c", "x" * 300_000 + "eyJa.eyJb.c"]
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = [] if i == 400 else [f"jwt:{m.start()}:{m.end()}" for m in re.finditer(rule.pattern, text)]
        assert [s for s in got[i].split(",") if s.startswith("jwt")] == want, text[:100]
    assert sum("jwt" in s for s in got.values()) > 10


def test_trigram_queries():
    by_kind = {r.kind: secrets.clauses(r.pattern) for r in secrets.RULES}
    assert by_kind["hex"] == []
    assert by_kind["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in by_kind["assign"] and len(by_kind["assign"]) == 6
    assert by_kind["jwt"] == [frozenset({"eyj", ".ey"})]
    assert secrets.clauses("abc(?:d|e)") == [frozenset({"abc", "bcd"}), frozenset({"abc", "bce"})]
    assert secrets.clauses("ab(?:cd|x+)yz!") == [frozenset({"abc", "bcd", "cdy", "dyz", "yz!"}), frozenset({"yz!"})]
    assert secrets.clauses("ab[0-9]+cd") == secrets.clauses("(?:abc)?x") == []


def test_query_is_necessary():
    """Every text that a rule matches fulfils the rule's trigram query."""
    for rule, text in ((secrets.RULES[0], "x Api_Key: 'abcdefgh"), (secrets.RULES[6], "eyJab.eyJcd.e_f"), (secrets.RULES[3], "gho_" + "A" * 40)):
        assert re.search(rule.pattern, text)
        assert any(all(t in text.lower() for t in c) for c in secrets.clauses(rule.pattern))


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = secrets.find(docs)
    assert set(rows.columns) == set(docs.columns)
    assert len(rows.collect()) == 10
    same = spark.createDataFrame([(1, "token=abcdefgh"), (1, "no"), (None, "secret: abcdefgh"), (None, None), (1, "token=abcdefgh")], "doc_id long, text string")
    assert sorted(r.spans for r in secrets.report(same).collect()) == ["", "", "assign:0:14", "assign:0:14", "assign:0:16"]
    assert secrets.report(empty(spark)).collect() == []
