"""Fixed values.

These constants decide results (scores, cuts, verdict texts, word lists), so they
must equal the published behaviour this engine matches.  They are data, not logic.
"""

# --- limits -----------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
TOP_K = 5
MIN_SCORE = 0.0
SEMANTIC_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
AGREEMENT_THRESHOLD = 0.3
EXPECTED_SOURCES = 3
WEAK_TOP_SCORE = 0.4
CONTEXT_TOKENS = 4000
MIN_CUT_TOKENS = 20
CHARS_PER_TOKEN = 4
QUERY_MAX_CHARS = 4000
DOCUMENT_MAX_BYTES = 500 * 1024 * 1024
WEB_RESULTS = 3
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60
LATEST_LIMIT = 50
LOW_CONFIDENCE = 0.5
LOW_AGREEMENT = 0.5
CONFIDENCE_TOLERANCE = 0.1
SUMMARY_WORDS = 100
ACCURACY_FLOOR = 0.8

# --- file types ---------------------------------------------------------------
TEXT_EXTENSIONS = [".txt", ".md"]

# --- word lists -----------------------------------------------------------------
UNCLEAR_FIRST_WORDS = ["it", "that", "this", "they", "them"]
REASONING_WORDS = ["why", "how", "compare", "explain", "analyze", "evaluate"]
ACTION_WORDS = ["create", "add", "delete", "update", "remove", "generate", "build"]
QUESTION_PREFIXES = ["what", "why", "how", "who", "when", "where", "is", "does", "can"]
UNCERTAINTY_MARKERS = [
    "uncertain", "may not", "not certain", "limited evidence", "insufficient",
    "unclear", "cannot confirm", "low confidence", "not confident",
]
NO_EVIDENCE_MARKERS = ["no evidence", "insufficient", "cannot find", "don't have"]
EXPOSED_UNCERTAINTY_MARKERS = ["uncertain", "not certain", "unclear", "low confidence"]
CONFLICT_MARKERS = [
    "differ", "disagree", "conflict", "however", "on the other hand",
    "inconsistent", "contradict",
]

# --- patterns (reported by name, so the text itself is a result) ------------------
INJECTION_PATTERNS = [
    "ignore (all |any )?(previous|prior|above) instructions",
    "disregard (all |any )?(previous|prior|above)",
    "you are now",
    "system\\s*:",
    "new instructions?\\s*:",
    "reveal (your |the )?(system )?prompt",
]
REDACTION = "[redacted]"
CONTROL_CHARS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
TOKEN_PATTERN = "[a-z0-9]+"
CITATION_PATTERN = "\\[([^\\]]+)\\]"
CONFIDENCE_CLAIM_PATTERN = "confidence[^0-9]{0,20}([01](?:\\.\\d+)?)"
SUB_QUESTION_PATTERN = "(?:and|vs\\.?|versus|compared to)"

# --- names ----------------------------------------------------------------------
TRACE_STAGES = ["interpret", "retrieve", "reason", "generate", "verify", "reflect"]
FULL_STATE_PATH = [
    "initialize", "interpret", "retrieve", "reason", "generate", "verify",
    "reflect", "respond", "persist", "terminate",
]
CLARIFY_STATE_PATH = ["initialize", "interpret", "clarify", "respond", "persist", "terminate"]
EPHEMERAL_TIERS = ["working", "dialogue", "session"]
PERSISTENT_TIERS = ["concept", "project", "research", "system"]
EVENT_NAMES = [
    "DocumentImported", "EmbeddingCreated", "ConversationStarted",
    "ReasoningCompleted", "MemoryUpdated", "ProjectSaved",
]

# --- texts that are stored, shown or counted in the token budget -------------------
SYSTEM_POLICIES = [
    "If evidence is insufficient, acknowledge the limitation and avoid fabrication.",
    "If sources conflict, preserve the disagreement rather than forcing synthesis.",
    "Confidence is never equivalent to truth.",
]
CLARIFICATION_TEXT = (
    "Could you say a bit more about what you're asking? "
    "I want to make sure I answer the right question."
)
RESEARCH_FALLBACK_TEXT = (
    "I don't have enough verified evidence to answer this reliably, "
    "and I'd rather say that than guess."
)
RESEARCH_EMPTY_TEXT = "No evidence was found in the knowledge base to research this question."
PROMPT_EMPTY_TEXT = "No evidence was retrieved for this query."
NOT_DELIVERED_TEXT = "[not delivered -- failed validation/reflection]"
INTERNAL_ERROR_TEXT = (
    "I ran into an internal problem while processing this and stopped safely "
    "rather than guess or continue with a broken result. Please try again."
)
UNKNOWN_SOURCE = "unknown source"
CITATION_VIOLATION = "citation '%s' does not match any retrieved source"
CLAIM_VIOLATION = "response claims confidence %s but computed confidence was %s"
HEDGE_VIOLATION = (
    "computed confidence (%s) is low but the response does not expose any uncertainty (§16)"
)
COMPLETENESS_VIOLATION = "no evidence was retrieved but the response does not acknowledge this (§16)"
