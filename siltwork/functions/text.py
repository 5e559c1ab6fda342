"""Column functions over log text: severity, redaction, masks, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by rank, weights by rank, and words of each severity.
LABELS = ("OTHER", "INFO", "WARN", "ERROR", "FATAL")
WEIGHTS = (0.1, 0.2, 0.6, 0.9, 1.0)
LEVEL_WORDS = {4: ("FATAL", "CRITICAL", "PANIC", "EMERG", "ALERT"), 3: ("ERROR", "ERR", "E"), 2: ("WARN", "WARNING", "W"), 1: ("INFO", "INFORMATION", "I", "NOTICE")}
HINTS = {4: ("PANIC", "FATAL", "CRITICAL"), 3: ("ERROR", "EXCEPTION", "TRACEBACK", "STACKTRACE"), 2: ("WARN",), 1: (" INFO ", "[INFO]")}
# Redaction rules in order (Java syntax), what they need in the text at least, and what stands for it.
REDACTIONS = (
    ("jwt", "eyJ", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<REDACTED:jwt>"),
    ("aws", "AKIA", r"(?U)\bAKIA[0-9A-Z]{16}\b", "<REDACTED:aws_key>"),
    ("bearer", None, r"(?iU)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "<REDACTED:bearer>"),
    ("pem", "PRIVATE KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "<REDACTED:pem>"),
    ("url", "://", r"(?iU)\b([a-z][a-z0-9+.-]*://[^\s:/@]*:)([^\s@/]+)@", "$1<REDACTED:password>@"),
    ("email", "@", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<REDACTED:email>"),
    ("auth", None, r"""(?iU)(authorization["']?\s*[=:]\s*["']?(?:basic|digest|token|negotiate|ntlm)\s+)([^\s"',}\]]+)""", "$1<REDACTED:auth>"),
    ("flag", "-", r"(?iU)(\s--?(?:password|passwd|pass|secret|token|api[_-]?key|access[_-]?key)\s+)([^\s-]\S*)", "$1<REDACTED:secret>"),
    (
        "kv",
        None,
        r"""(?iU)((?:password|passwd|secret|token|api[_-]?key|apikey|authorization|access[_-]?key|private[_-]?key)["']?\s*[=:]\s*)(?:(")(?!<REDACTED:)[^"\n]+(")|(')(?!<REDACTED:)[^'\n]+(')|(?!<REDACTED:)[^\s"',}\]\n]{6,})""",
        "$1$2$4<REDACTED:secret>$3$5",
    ),
)
# Masks in order.
MASKS = (
    ("ts_iso", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})?", "<TS>"),
    ("ts_unix", r"\b1[5-9]\d{8,12}\b", "<TS>"),
    ("ts_clock", r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<TS>"),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<ID>"),
    ("hex", r"\b0x[0-9a-fA-F]{4,}\b", "<ID>"),
    ("hash", r"\b[0-9a-f]{32,64}\b", "<ID>"),
    ("ip4", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b", "<IP>"),
    ("ip6", r"\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b", "<IP>"),
    ("dur", r"\b\d+(?:\.\d+)?(?:ms|us|µs|ns|s|m|h)\b", "<DUR>"),
    ("num", r"\b\d{2,}\b", "<NUM>"),
)


def infer_severity(raw: Column) -> Column:
    """Rank by the first hint in the upper-cased text: fatal, error, warn, info, else other."""
    upper, out = F.upper(raw), None
    for rank, words in HINTS.items():
        for w in words:
            out = F.when(upper.contains(w), rank) if out is None else out.when(upper.contains(w), rank)
    return out.otherwise(0).cast("tinyint")


def level_rank(level: Column) -> Column:
    """Rank of a level word; unknown and null: other."""
    upper, out = F.upper(level), None
    for rank, words in LEVEL_WORDS.items():
        out = F.when(upper.isin(*words), rank) if out is None else out.when(upper.isin(*words), rank)
    return out.otherwise(0).cast("tinyint")


def weight(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), rank.cast("int") + 1)


def label(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), rank.cast("int") + 1)


def entropy(text: Column) -> Column:
    """Shannon entropy of ASCII characters in bits, over the length in bytes."""
    n = F.octet_length(text)
    chars = F.filter(F.array_sort(F.array_distinct(F.split(text, ""))), lambda c: F.ascii(c) < 128)
    parts = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), 9)


def redact_entropy(text: Column, least_bytes: int = 20, least_bits: float = 3.5) -> Column:
    """Tokens of high entropy replaced, white space made single spaces; only texts with a long token are split."""

    def one(token):
        core = F.regexp_replace(token, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
        hit = (F.octet_length(core) >= least_bytes) & core.rlike(r"^[\p{IsAlphabetic}\p{N}+/=_-]*$") & (entropy(core) >= least_bits)
        return F.when(hit, F.replace(token, core, F.lit("<REDACTED:hi>"))).otherwise(token)

    plain = squeeze(text)
    return F.when(text.rlike(r"(?U)\S{7,}") & (F.octet_length(text) >= least_bytes), F.array_join(F.transform(F.split(plain, " "), one), " ")).otherwise(plain)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def redact_patterns(text: Column) -> Column:
    """All rules in order. A plain chain: a test before a rule would double the expression with each rule."""
    for _, _, pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def redact(text: Column) -> Column:
    # the patterns are applied once, though the step after them uses their result several times
    return F.get(F.transform(F.array(redact_patterns(text)), lambda t: redact_entropy(t)), F.lit(0))


def mask(text: Column) -> Column:
    """The template of a text."""
    for _, pattern, to in MASKS:
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    return squeeze(text)
