"""Redaction of secrets in text and refusal of sensitive fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted, in this order.
RULES = (
    (r"(?i)https?://[^\s\"'<>]+", "[REDACTED_URL]"),
    (r"(?i)(authorization\s*:\s*)[^\r\n]+?(?=\s+[A-Za-z-]+\s*:|$)", "$1[REDACTED]"),
    (r"(?i)(cookie\s*:\s*)[^\r\n]+", "$1[REDACTED]"),
    (r"(?i)\b(token|signature|sig|key|secret|password|otp)=([^&\s]+)", "$1=[REDACTED]"),
)

#: Parts of field names that must not be stored.
KEY_PARTS = (
    "authorization", "access_key", "api_key", "auth_header", "browser_profile", "cookie", "credential", "email", "har", "header", "media_url", "otp",
    "password", "private_key", "profile_data", "request_url", "secret", "signed_url", "storage_state", "token", "uri", "url",
)


def redact_text(c: Column) -> Column:
    for pattern, by in RULES:
        c = F.regexp_replace(c, pattern, by)
    return c


def is_sensitive_key(key: Column) -> Column:
    """A field name that is one of KEY_PARTS, or starts or ends with one as a word of its own."""
    k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return F.exists(F.array(*[F.lit(p) for p in KEY_PARTS]), lambda p: (k == p) | F.startswith(k, F.concat(p, F.lit("_"))) | F.endswith(k, F.concat(F.lit("_"), p)))


def refused_fields(entries):
    """Rows of (…, key, value) that may not be stored, with the reason: `sensitive key` or `sensitive value`."""
    reason = F.when(is_sensitive_key(F.col("key")), "sensitive key").when(redact_text(F.col("value")) != F.col("value"), "sensitive value")
    return entries.withColumn("reason", reason).filter("reason is not null")


def redact_value(text: str) -> str:
    """redact_text() for a Python string."""
    for pattern, by in RULES:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), text)
    return text


def refused_paths(value, path: str = "$") -> list[str]:
    """The places in a nested Python value that may not be stored; for artifacts the driver writes itself.

    A text is refused if redacting would change it, so that redacted evidence can be stored.
    """
    if isinstance(value, dict):
        inside = [(f"{path}.{k}", v, _is_sensitive_name(str(k))) for k, v in value.items()]
        return [p for where, v, bad in inside for p in ([where] if bad else refused_paths(v, where))]
    if isinstance(value, list | tuple):
        return [p for k, v in enumerate(value) for p in refused_paths(v, f"{path}[{k}]")]
    return [path] if isinstance(value, str) and redact_value(value) != value else []


def _is_sensitive_name(name: str) -> bool:
    name = f"_{name.casefold().replace('-', '_')}_"
    return any(name.startswith(f"_{p}_") or name.endswith(f"_{p}_") for p in KEY_PARTS)
