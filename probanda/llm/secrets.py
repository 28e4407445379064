"""Secrets by a trigram index: each rule's pattern gives a Boolean query over trigrams, the
postings of the trigrams are intersected, and only candidates are verified.

The query of a pattern is an OR of clauses, each an AND of trigrams every match contains
(compared in lower case).  Postings hold (trigram, doc_id) for the trigrams that the rules
ask for.  A rule whose pattern has no mandatory trigram scans every text.  The candidates
join the documents by id; what is joined beyond need is settled by verification, so rows
that share an id are no trouble.

Cases: null and empty texts have no spans; repeated rows have the same spans; an empty
table gives an empty table; null ids match each other; columns named like the outputs are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored, text_or_empty, without
from .matching import matches_where

MOST_CLAUSES = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches; ``group`` must have ``least`` characters, else
    the match is dropped.  ``base`` rules come first in the results.  ``search`` is a form
    of the pattern for the verification that looks at each character a bounded number of
    times: runs of one class are entered at their beginning only and not given up once
    taken.  With ``ahead`` its group 1 lies before the match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    search: str = ""
    ahead: bool = False


#: The three base rules, then well-known token formats.
RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, True, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("git", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
    # if the first eyJ of a run has no second part behind the run, none of that run has
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
         search=r"(?<![A-Za-z0-9_-])((?:(?!eyJ)[A-Za-z0-9_-])*+)eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", ahead=True),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def clauses(pattern: str) -> list[frozenset[str]]:
    """The OR of ANDs of trigrams that any match contains; empty if none is mandatory."""
    found = [needed | trigrams(run) for run, needed, _ in sequence(_parser.parse(pattern))]
    return [] if any(not f for f in found) else sorted(set(found), key=sorted)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


Alternative = tuple[str, frozenset[str], bool]  # last literal run, trigrams of runs before, unbroken?
BREAK: list[Alternative] = [("", frozenset(), False)]


def sequence(items) -> list[Alternative]:
    """The alternatives of a parsed sequence, in lower case."""
    state: list[Alternative] = [("", frozenset(), True)]
    for op, arg in items:
        options = choices(str(op), arg)
        if len(options) * len(state) > MOST_CLAUSES:
            options = BREAK
        state = [
            (run + text, needed, whole) if unbroken else ("", needed | trigrams(run) | more | trigrams(text), False)
            for run, needed, whole in state
            for text, more, unbroken in options
        ]
        state = list(dict.fromkeys(state))
    return state


def choices(op: str, arg) -> list[Alternative]:
    """The alternatives of one parsed item; anything unbounded or wide is a break."""
    if op == "LITERAL":
        return [(chr(arg).lower(), frozenset(), True)]
    if op == "IN" and all(str(kind) == "LITERAL" for kind, _ in arg):
        return [(c, frozenset(), True) for c in sorted({chr(v).lower() for _, v in arg})]
    if op == "SUBPATTERN":
        return sequence(arg[-1])
    if op == "BRANCH":
        return [a for branch in arg[1] for a in sequence(branch)]
    if op == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1):
        return [("", frozenset(), True), *sequence(arg[2])]
    return BREAK


def postings(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """(trigram, doc_id) for the wanted trigrams that occur in the lower-cased text."""
    lowered = docs.select("doc_id", F.lower(text).alias("__lower"))
    here = F.array_compact(F.array(*[F.when(F.contains("__lower", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return lowered.select("doc_id", F.explode(here).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """doc_id and the list of rules whose trigram query the document fulfils."""
    asked = [(i, c) for i, rule in enumerate(rules) for c in clauses(rule.pattern)]
    wanted = sorted({t for _, c in asked for t in c})
    places = {t: i for i, t in enumerate(wanted)}
    # which clauses a trigram is in, and as which of the clause's bits
    parts: list[list[tuple[int, int]]] = [[] for _ in wanted]
    full = []
    for k, (_, clause) in enumerate(asked):
        for bit, t in enumerate(sorted(clause)):
            parts[places[t]].append((k, 1 << bit))
        full.append((1 << len(clause)) - 1)
    of = F.array(*[F.array(*[F.struct(F.lit(k).alias("clause"), F.lit(bit).cast("long").alias("bit")) for k, bit in p]) for p in parts])
    listed = postings(docs, wanted, text).select("doc_id", F.explode(F.element_at(of, F.col("trigram") + 1)).alias("p"))
    met = listed.groupBy("doc_id", "p.clause").agg(F.bit_or("p.bit").alias("bits"))
    needed = F.element_at(F.array(*[F.lit(f).cast("long") for f in full]), F.col("clause") + 1)
    rule = F.element_at(F.array(*[F.lit(i) for i, _ in asked]), F.col("clause") + 1)
    return met.where(F.col("bits") == needed).groupBy("doc_id").agg(F.collect_set(rule).alias("__rules"))


def verified(rule: Rule, asked: Column, text: Column) -> Column:
    pattern = rule.search or rule.pattern
    found = matches_where(asked, text, pattern)
    group = 1 if rule.ahead else rule.group
    if group:
        sized = F.when(asked, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.char_length(g))).otherwise(F.array().cast("array<int>"))
        paired = F.arrays_zip(found.alias("f"), sized.alias("n"))
        if rule.ahead:
            return F.transform(paired, lambda p: F.struct((p["f"]["start"] + p["n"]).alias("start"), p["f"]["end"].alias("end")))
        kept = F.transform(F.filter(paired, lambda p: p["n"] >= rule.least), lambda p: p["f"])
    else:
        kept = F.filter(found, lambda s: s["end"] - s["start"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules=RULES) -> DataFrame:
    """Adds ``spans``: array of (start, rank of the rule, end, kind), base kinds by start,
    then rule, before the others likewise.  ``carry``: columns kept (all, if absent)."""
    docs = ship(without(docs, "spans"))
    kept = [c for c in docs.columns if carry is None or c in carry]
    # written, so that the size is known where texts are joined: few candidates need no shuffle
    listed = stored(candidates(docs, rules, text).withColumnRenamed("doc_id", "__id"), "secret-candidates")
    rows = docs.join(listed, docs["doc_id"].eqNullSafe(listed["__id"]), "left").withColumn("__text", text_or_empty(text))
    indexed = {i for i, r in enumerate(rules) if clauses(r.pattern)}
    asked = {i: F.coalesce(F.array_contains("__rules", i), F.lit(False)) if i in indexed else F.lit(True) for i in range(len(rules))}
    rows = rows.withColumns({f"__rule{i}": verified(r, asked[i], F.col("__text")) for i, r in enumerate(rules)})

    def ranked(i: int) -> Column:
        return F.transform(f"__rule{i}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(rules[i].kind).alias("kind")))

    base = F.array_sort(F.concat(*[ranked(i) for i, r in enumerate(rules) if r.base]))
    more = F.array_sort(F.concat(*[ranked(i) for i, r in enumerate(rules) if not r.base]))
    return rows.select(*kept, F.concat(base, more).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), carry=["doc_id"])
    n_base = sum(r.base for r in RULES)
    own = F.filter("spans", lambda s: s["rank"] < n_base)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{RULES[i].kind}")
    return found.select("doc_id", *map(count, range(n_base)), F.sha2(said(own), 256).alias("base_sha256"), said(F.array_sort("spans")).alias("spans"))
