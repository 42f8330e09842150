"""Column functions for keys, indicators, shingles and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator patterns, in order of priority, as the extraction rules define them.
CVE = r"CVE-\d{4}-\d{4,7}"
TTP = r"\bT\d{4}(?:\.\d{3})?\b"
PATTERNS = {
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "url": r"(?i)\bhttps?://[^\s\"'<>]+",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}\b",
}
# How authors defang indicators, undone in this order, and four zero-width characters.
REFANG = (("hxxp", "http"), ("[.]", "."), ("(dot)", "."), ("[dot]", "."), ("[at]", "@"), ("(at)", "@"), ("[:]", ":"))
ZERO_WIDTH = "​‌‍﻿"
BENIGN = ("microsoft.com", "github.com", "google.com")
# Private and reserved IPv4 ranges, by prefix.
RESERVED = r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.)"


def key(a: Column, b: Column) -> Column:
    """A natural key of two parts."""
    return F.concat(a, F.lit("::"), b)


def split_key(k: Column) -> tuple[Column, Column]:
    """The parts of a natural key, at its first separator."""
    return F.substring_index(k, "::", 1), F.when(F.instr(k, "::") > 0, F.substring(k, F.instr(k, "::") + 2, F.length(k))).otherwise(F.lit(""))


def refang(text: Column) -> Column:
    out = F.translate(text, ZERO_WIDTH, "")
    for written, meant in REFANG:
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def classify(value: Column) -> Column:
    """The kind of a refanged indicator, or null."""
    out = F.lit(None).cast("string")
    order = ("sha256", "sha1", "md5", "email", "url", "ipv4", "ipv6", "domain")
    for kind in reversed(order):
        pattern = PATTERNS[kind]
        match = value.rlike(f"^{pattern}" if kind != "url" else r"(?i)^https?://[^\s\"'<>]+") if kind == "url" else value.rlike(f"^(?:{pattern})$")
        out = F.when(match, kind).otherwise(out)
    return F.when(value.isNotNull(), out)


def is_reserved(ip: Column) -> Column:
    return ip.rlike(RESERVED)


def collapse(name: Column) -> Column:
    """Lower case, with single spaces for any white space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def shingles(text: Column, k: int = 3) -> Column:
    """k-word shingles, repeats kept; of fewer words each word; of none an empty array. Meant as the child of a generator."""

    def of(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(n >= k, many).otherwise(words)

    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), of), 0)


def low_64(text: Column) -> Column:
    """The low 64 bits of the SHA-256, as a signed number."""
    hexa = F.sha2(text, 256)
    half = lambda a: F.conv(F.substring(hexa, a, 8), 16, 10).cast("long")
    return F.shiftleft(half(49), 32).bitwiseOR(half(57))


def parse_time(value: Column) -> Column:
    """ISO 8601 or RFC 822, naive times being UTC; null if it is neither."""
    mail = F.regexp_replace(value, r"^[A-Za-z]{3},\s+", "")
    # A time without a zone is UTC, whatever the session's zone is.
    zoned = F.when(value.rlike(r"[Tt ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?$"), F.concat(value, F.lit("Z"))).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00Z"))).otherwise(value)
    return F.coalesce(
        F.try_to_timestamp(zoned),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")),
    )


def version_parts(version: Column) -> Column:
    """A dotted version as numbers; what is no number counts as zero."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def classify_response(status: Column, retry_after: Column, valid: Column, attempt: Column, base: float = 1.0) -> Column:
    """What to do with an HTTP response: struct(action, alert, delay). delay: seconds, of 'retry_after' only."""
    wait = F.coalesce(retry_after.try_cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt))
    action = (
        F.when(status.isin(401, 403), "no_retry")
        .when(status == 429, "retry_after")
        .when((status >= 500) & (status < 600), "retry")
        .when((status < 200) | (status >= 300), "no_retry")
        .when(F.coalesce(valid, F.lit(False)), "ok")
        .otherwise("no_retry")
    )
    return F.struct(action.alias("action"), status.isin(401, 403).alias("alert"), F.when(status == 429, wait).alias("delay"))


def poll_backoff(attempt: Column, base: float = 0.1) -> Column:
    """Seconds to wait before a feed is asked again, after so many failed attempts."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)
