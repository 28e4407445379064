"""Text scalars.  Everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

# Whitespace as Unicode text processing sees it, including U+001C..U+001F and NBSP,
# which Java's plain \s leaves out.
WS_CHARS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS = f"[{WS_CHARS}]"


def decode_utf8(content: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def nfc(text: Column) -> Column:
    """Canonical composition through the ICU library Spark ships; ASCII rows skip it."""
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike("[^\\x00-\\x7F]"), composed).otherwise(text)


def strip(text: Column) -> Column:
    """Whitespace off both ends, in time linear in the text: the possessive run in front is
    not tried again, and the end is looked for once, from behind."""
    return F.regexp_extract(text, f"(?s)\\A{WS}*+(.*[^{WS_CHARS}])", 1)


def clean_text(text: Column) -> Column:
    """NFC, one newline style, single blanks, at most one empty line, stripped."""
    out = F.regexp_replace(nfc(text), "\\r\\n?", "\n")
    out = F.regexp_replace(out, "[ \\t]{2,}|\\t", " ")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return strip(out)


def normalize_query(text: Column) -> Column:
    return strip(F.regexp_replace(nfc(text), f"{WS}+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII alphanumeric runs."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(V.TOKEN_PATTERN), F.lit(0))
    )


def keyword_score(query_tokens: Column, chunk_tokens: Column) -> Column:
    """Share of the query's tokens found in the chunk; 0 when either side is empty."""
    shared = F.size(F.array_intersect(query_tokens, chunk_tokens))
    return F.when(
        (F.size(query_tokens) > 0) & (F.size(chunk_tokens) > 0), shared / F.size(query_tokens)
    ).otherwise(F.lit(0.0))


def strip_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, V.CONTROL_CHARS, "")


def words(text: Column) -> Column:
    """Lower-cased whitespace-separated words, empty text giving no word."""
    return F.filter(F.split(F.lower(strip(text)), f"{WS}+"), lambda w: w != "")


def estimate_tokens(n_chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(n_chars / V.CHARS_PER_TOKEN))


def contains_any(lowered: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(m) for m in markers])


def two_decimals(value: Column) -> Column:
    """Round half up at two decimals first, then print."""
    return F.format_string("%.2f", F.round(value, 2))


def six(value: Column) -> Column:
    """Scores are compared and published at six decimals, so ties do not hang on the
    order in which floating-point terms were added."""
    return F.round(value, 6)


def stable_id(*parts: Column) -> Column:
    """Deterministic id from a natural key: a retried task writes the same id."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def _injection(pattern: str) -> str:
    """The fixed pattern with Unicode-wide whitespace and Unicode case folding."""
    return "(?iu)" + pattern.replace("\\s", WS)


def detect_injection(text: Column) -> Column:
    """Fixed patterns that occur in the text, in list order."""
    hits = F.array(*[F.when(text.rlike(_injection(p)), F.lit(p)) for p in V.INJECTION_PATTERNS])
    return F.array_compact(hits)


def redact_injection(text: Column) -> Column:
    """Each pattern in turn; a text without a hit passes through all of them unchanged."""
    return reduce(
        lambda t, p: F.regexp_replace(t, _injection(p), V.REDACTION), V.INJECTION_PATTERNS, text
    )


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.CITATION_PATTERN), F.lit(1))


def confidence_claims(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?iu)" + V.CONFIDENCE_CLAIM_PATTERN), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def sub_questions(question: Column) -> Column:
    """Split at conjunctions; a question with fewer than two parts stays whole."""
    whole = strip(question)
    pattern = "(?iu)%s+%s%s+" % (WS, V.SUB_QUESTION_PATTERN, WS)
    parts = F.filter(F.transform(F.split(whole, pattern), strip), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(whole))


def source_key(document_id: Column, url: Column, fallback: Column) -> Column:
    """Document, else URL, else the fallback; empty text counts as missing."""
    return F.coalesce(F.nullif(document_id, F.lit("")), F.nullif(url, F.lit("")), fallback)


def source_label(title: Column, document_id: Column) -> Column:
    return F.coalesce(
        F.nullif(title, F.lit("")), F.nullif(document_id, F.lit("")), F.lit(V.UNKNOWN_SOURCE)
    )
