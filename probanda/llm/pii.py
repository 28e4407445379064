"""Personal data: fixed kinds, and bootstrapped contextual extraction, all as expressions.

Base kinds are found by pattern and checked.  Their occurrences are seeds: the words before
them (and around them) are lexical patterns.  Identifier-like tokens are candidates.  The
bipartite graph of patterns and distinct instances is scored for each kind of seed apart,
in hundredths rounded down:

- a seed is worth 100 for its kind, a candidate as much as its surest trusted pattern;
- a pattern is supported if SEEDS different instances are worth something;
- for a pattern speaks what its instances are worth; against it speaks, for each candidate,
  what that lacks of 100, times the share of the candidate's patterns without support.  A
  token that turns up in other surroundings is a counterexample; one that nobody has seen
  elsewhere says nothing;
- confidence is for / (for + against + DAMPING); supported patterns of CONFIDENCE or more
  are trusted.

Worth and confidence only rise from round to round, so the rounds end where nothing rises,
whatever the order of rows.  Candidates behind trusted patterns are added as kind
``context``.

Patterns are written so that each character is looked at a bounded number of times: runs
are entered only at their beginning (or where the match before ended), and repeated groups
are rewritten to one class by a first replacement of the separators inside them.

Cases: null and empty texts have no spans; repeated rows have the same spans; an empty
table gives an empty table; rows without id are handled like others; columns named like
the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored, text_or_empty, without
from .matching import before, bound, code_points, digits, listed, matches_where

KINDS = ("email", "ip", "card", "phone")
WHOLE = 100  # the worth of a seed
CONFIDENCE = 50
SEEDS = 5
DAMPING = 100  # what speaks against every pattern
CONTEXT = 64  # code points looked at on either side

_LABEL = r"[A-Za-z0-9-]"
_EMAIL = r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_CARD = r"(?<![0-9\x01])[0-9][0-9\x01]{15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"A-Za-z0-9_#/.@+-"
_CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z_#/.@+-]*+[0-9])[{_TOKEN}]{{6,}}+(?![{_TOKEN}])"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def inner(text: Column, separators: str, around: str) -> Column:
    """Single separators between two characters of a class become \\x01, code point for
    code point; \\x01 of the text itself becomes \\x02, which no pattern takes."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), f"(?<={around}){separators}(?={around})", "\x01")


def luhn(number: Column) -> Column:
    def weigh(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(number)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    """The matches of every base kind that pass its check."""
    email = matches_where(text.contains("@"), inner(text, r"\.", _LABEL), _EMAIL)
    ip = matches_where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), text, _IP)
    card = matches_where(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), inner(text, "[ -]", "[0-9]"), _CARD)
    phone = matches_where(text.contains("+"), text, _PHONE)
    number = lambda s: digits(s["value"])
    sound = lambda s: F.when(F.char_length(number(s)).between(16, 19), luhn(number(s))).otherwise(False)
    return {
        "email": email,
        "ip": F.filter(ip, lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(card, sound),
        "phone": F.filter(phone, lambda s: F.char_length(number(s)).between(8, 15)),
    }


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_spans``: array of (kind, start, end, value) by kind, then start."""
    docs = ship(without(docs, "base_spans"))
    found = docs.withColumn("__text", text_or_empty(text))
    found = found.withColumns({f"__{kind}": spans for kind, spans in base(F.col("__text")).items()})
    of = lambda kind: F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return found.withColumn("base_spans", F.concat(*map(of, KINDS))).drop("__text", *[f"__{k}" for k in KINDS])


def contexts(text32: Column, size: Column, start: Column, end: Column) -> Column:
    """The lexical patterns around a span: two words before it; one before and one after."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before = plain(code_points(text32, F.greatest(start - CONTEXT, F.lit(0)), start))
    behind = plain(code_points(text32, end, F.least(end + CONTEXT, size)))
    two = F.regexp_extract(before, r"(\S+\s+\S+\s*)$", 1)
    one, after = F.regexp_extract(before, r"(\S+\s*)$", 1), F.regexp_extract(behind, r"^(\s*\S+)", 1)
    both = F.concat(one, F.lit(" * "), after)
    return F.filter(
        F.array(F.when(two != "", F.concat(two, F.lit(" *"))), F.when((one != "") & (after != ""), both)), lambda p: p.isNotNull()
    )


def occurrences(docs: DataFrame, text: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, text_hash, base_spans and seen: seeds (with their kind) and candidates with
    their patterns; and ``carry``, if given."""
    carried = [] if carry is None else [carry.alias("carry")]
    rows = docs.select("doc_id", F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).alias("text"), *carried)
    found = find_base(rows)
    raw = matches_where(F.col("text").rlike("[0-9]"), F.col("text"), _CANDIDATE)
    free = lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = found.withColumn("__raw", raw)
    found = found.withColumn("__free", F.filter("__raw", free))
    one = lambda kind: lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    spans = F.concat(F.transform("base_spans", one(lambda s: s["kind"])), F.transform("__free", one(lambda s: F.lit(None).cast("string"))))
    found = found.withColumn("__all", spans).withColumn("__32", F.when(F.size("__all") > 0, F.encode("text", "UTF-32"))).withColumn("__n", F.char_length("text"))
    seen = F.transform("__all", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.xxhash64(F.lower(s["value"])).alias("instance"),
        F.transform(contexts(F.col("__32"), F.col("__n"), s["start"], s["end"]), lambda p: F.xxhash64(p)).alias("patterns"),
    ))
    bare = F.transform("base_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "text_hash", bare.alias("base_spans"), seen.alias("seen"), *["carry"][: len(carried)])


def trusted_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of trusted patterns, and (instance, kind, worth) of their
    candidates, when nothing rises any more."""
    edge = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    edges = stored(edge.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pattern-edges")
    rooted = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg((F.count("*") * WHOLE).alias("pro"), F.count("*").alias("n"))
    rooted = stored(rooted, "pattern-seeds")
    open_edges = edges.where("kind IS NULL").select("pattern", "instance")
    trusted = rooted.where("false").select("pattern", "kind", F.col("n").alias("confidence"))
    worth = rooted.where("false").select(F.col("pattern").alias("instance"), "kind", F.col("n").alias("worth"))
    if rooted.where(F.col("n") >= SEEDS).isEmpty():
        return trusted
    degrees = stored(open_edges.groupBy("instance").agg(F.count("*").alias("degree")), "instance-degrees")
    before = None
    while True:
        lent = open_edges.join(worth, "instance").groupBy("pattern", "kind").agg(F.sum("worth").alias("pro"), F.count("*").alias("n"))
        support = rooted.unionByName(lent).groupBy("pattern", "kind").agg(F.sum("pro").alias("pro"), F.sum("n").alias("n"))
        support = stored(support.where(F.col("n") >= SEEDS), "supported-patterns")
        touched = stored(open_edges.join(support.select("pattern", "kind"), "pattern"), "supported-edges")
        lack = touched.groupBy("instance", "kind").agg(F.count("*").alias("supported")).join(degrees, "instance").join(worth, ["instance", "kind"], "left")
        lack = lack.withColumn("contra", F.expr(f"({WHOLE} - coalesce(worth, 0)) * (degree - supported) div degree")).select("instance", "kind", "contra")
        contra = touched.join(lack.where("contra > 0"), ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("contra").alias("contra"))
        scored = support.join(contra, ["pattern", "kind"], "left")
        scored = scored.select("pattern", "kind", F.expr(f"{WHOLE} * pro div (pro + coalesce(contra, 0) + {DAMPING})").alias("confidence"))
        trusted = stored(scored.where(F.col("confidence") >= CONFIDENCE), "trusted-patterns")
        worth = stored(touched.join(trusted, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("worth")), "instance-worth")
        now = worth.agg(F.count("*"), F.sum("worth")).first()
        if now == before:
            return trusted
        before = now


def added(found: DataFrame) -> DataFrame:
    """__id, __hash (doc_id and text hash) and __added, the spans behind trusted patterns."""
    seen = found.select("doc_id", "text_hash", F.explode("seen").alias("s")).select("doc_id", "text_hash", "s.*")
    patterns = trusted_patterns(seen).select("pattern").distinct()
    hits = seen.where("kind IS NULL").select("doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern", "left_semi")
    spans = hits.select("doc_id", "text_hash", F.struct(F.lit("context").alias("kind"), "start", "end").alias("span")).distinct()
    by_row = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("span")).alias("__added"))
    # written, so that the size is known where texts are joined: few spans need no shuffle
    return stored(by_row.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), "added-spans")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base_spans and spans (base and added) of every row."""
    found = stored(occurrences(docs, text), "personal-data")
    more = added(found)
    both = found.join(more, found["doc_id"].eqNullSafe(more["__id"]) & (found["text_hash"] == more["__hash"]), "left")
    return both.select("doc_id", "base_spans", F.concat("base_spans", F.coalesce("__added", F.array().cast(SPANS))).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans by start, overlapping ones merged under the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(xs: Column) -> Column:
        reach = before(xs, F.lit(0), lambda end, s: F.greatest(end, s["end"]))
        heads = F.filter(F.zip_with(xs, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach"))), lambda p: p["s"]["start"] >= p["reach"])
        # a group ends where all spans before the next group's first end
        last = F.array_max(F.transform(xs, lambda s: s["end"]))
        return bound(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(
            h["s"]["start"].alias("start"), F.coalesce(F.get(hs, i + 1)["reach"], last).alias("end"), h["s"]["kind"].alias("kind")
        )))

    return bound(ordered, merged)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, where it is
    there, follows.  Texts are searched once and written with what was found; only spans
    that context added are joined."""
    columns = docs.columns
    own = stored(occurrences(docs, text, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])), "personal-data")
    more = added(own)
    rows = own.join(more, own["doc_id"].eqNullSafe(more["__id"]) & (own["text_hash"] == more["__hash"]), "left")
    spans = joined(F.concat("base_spans", F.coalesce("__added", F.array().cast(SPANS)))).alias("__spans")
    rows = rows.select(*[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(columns)], spans)
    rows = rows.withColumn("__32", F.when(F.size("__spans") > 0, F.encode(text, "UTF-32")))
    ended = lambda i: F.when(i > 0, F.col("__spans")[i - 1]["end"]).otherwise(0)
    pieces = F.transform("__spans", lambda s, i: F.concat(code_points(F.col("__32"), ended(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = code_points(F.col("__32"), F.element_at("__spans", -1)["end"], F.char_length(text))
    rows = rows.withColumn(text, F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text)))
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("int", "bigint"):
        rows = rows.withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length(text).cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def report(docs: DataFrame) -> DataFrame:
    found = find(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
