"""Column functions over text: redaction, canonical form, fingerprints, keyed ids, hygiene flags."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# (?U) makes \b, \s and \d follow Unicode, so accented letters count as word characters.
_U = "(?U)"
SEPARATOR = "\x1f"


def suspicious(text: Column) -> Column:
    """Whether a text holds a part without which no redaction pattern matches; searched without patterns.

    Placeholders hold none of these parts but the colon, and no two pieces of a text meet where a span was replaced,
    so the question may be asked once, of the text as it was.
    """
    return reduce(lambda a, part: a | text.contains(part), fv.REDACTION_PARTS, F.lower(text).contains("bearer"))


def redacted(text: Column) -> Column:
    """Text with every sensitive span replaced by its label."""
    out = text
    for label, pattern in fv.REDACTIONS:
        out = F.regexp_replace(out, F.lit(_U + pattern), F.lit(f"<redacted:{label}>"))
    return F.when(suspicious(text), out).otherwise(text)


def redaction_labels(text: Column) -> Column:
    """One label per replaced span, grouped in pattern order."""
    counts, current = [], text
    for label, pattern in fv.REDACTIONS:
        regex = F.lit(_U + pattern)
        counts.append(F.array_repeat(F.lit(label), F.coalesce(F.regexp_count(current, regex), F.lit(0))))
        current = F.regexp_replace(current, regex, F.lit(f"<redacted:{label}>"))
    return F.when(suspicious(text), F.concat(*counts)).otherwise(F.array().cast("array<string>"))


def canonical(text: Column) -> Column:
    """Redacted, lower-cased, number-free, single-spaced text; null becomes ``null``."""
    out = F.lower(redacted(text))
    out = F.regexp_replace(out, F.lit(_U + r"\b\d+\b"), F.lit("<n>"))
    out = F.trim(F.regexp_replace(out, F.lit(_U + r"\s+"), F.lit(" ")))
    # Names of kinds, roles and tools are canonical as they are.
    return F.when(text.rlike("^[a-z_]*$"), text).otherwise(F.coalesce(out, F.lit("null")))


def digest16(*canonical_parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 over parts that are canonical already."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *canonical_parts), 256), 1, 16)


def fingerprint(*parts: Column) -> Column:
    """Fingerprint of plain text parts."""
    return digest16(*[canonical(p) for p in parts])


def looks_secret(text: Column) -> Column:
    """Whether any secret-like pattern occurs."""
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in fv.SECRET_LIKE])


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = hashlib.sha256(secret.encode()).digest().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac32(message: Column, secret: str) -> Column:
    """First 32 hex digits of HMAC-SHA256 under the SHA-256 of ``secret``, all in the JVM."""
    inner, outer = _pads(secret)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256)
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256), 1, 32)


def keyed_id(kind: str, material: Column, secret: str) -> Column:
    return hmac32(F.concat(F.lit(f"{kind}:"), material), secret)


def content_version(text: Column, secret: str) -> Column:
    return F.concat(F.lit("cv_"), hmac32(text, secret))


def stable_json(text: Column) -> Column:
    """Key-sorted compact JSON of a JSON text."""
    return F.to_json(F.parse_json(text))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: one more than the code points for every astral character."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("bigint")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / 4)).cast("bigint")


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains any phrase."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def joined_text(parts: Column) -> Column:
    """Newline-joined texts of an array of strings."""
    return F.array_join(parts, "\n")


def rate(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded ratio, 0 when the denominator is not positive."""
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(F.round(numerator / denominator, digits))


def ratio(part: Column, whole: Column) -> Column:
    """Plain ratio, null when there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def hygiene_labels(line: Column) -> Column:
    """Labels of the hygiene rules a line breaks, in rule order."""
    domains = F.transform(
        F.regexp_extract_all(line, F.lit(_U + fv.MAIL_DOMAIN), 1), lambda d: F.lower(d)
    )
    foreign = F.exists(domains, lambda d: ~d.isin(*fv.ALLOWED_MAIL_DOMAINS))
    flags = [
        line.rlike(fv.HOME_PATH), line.rlike(_U + fv.PRIVATE_IP), foreign, line.rlike(_U + fv.CREDENTIAL_TOKEN),
    ]
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, fv.HYGIENE_LABELS)]))


def private_file(path: Column, own_folders: tuple[str, ...] = ()) -> Column:
    """Whether a path names a runtime or credential file, or lies in a private folder.

    ``own_folders`` are the folders that the caller's own tools keep their state in. A suffix counts as it is written,
    and a name that only begins with a dot has none.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return (
        F.arrays_overlap(parts, F.array(*[F.lit(f) for f in (*fv.PRIVATE_FOLDERS, *own_folders)]))
        | F.regexp_extract(name, r"^\.*[^.].*\.([^.]+)$", 1).isin(*fv.PRIVATE_SUFFIXES)
        | name.isin(*fv.PRIVATE_NAMES)
        | (name.startswith(".env.") & (name != ".env.example"))
    )


def stray_log(path: Column) -> Column:
    """Whether a JSONL file lies outside fixture or example folders."""
    folders = F.split(path, "/")
    return path.endswith(".jsonl") & ~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in fv.FIXTURE_FOLDERS]))


def identifier_ok(value: Column) -> Column:
    return F.coalesce(F.length(value).between(1, 200), F.lit(False))


def sha256_ok(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-f0-9]{64}$"), F.lit(False))


def basename(path: Column) -> Column:
    """Last part of a POSIX or Windows path; the path itself when that part is empty."""
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(F.length(last) > 0, last).otherwise(path)
