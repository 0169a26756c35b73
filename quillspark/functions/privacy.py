"""Masking, scrubbing and normalising of identifiers, as Column expressions.

Character classes are spelled out (ASCII) wherever the rule is about ASCII, so
results don't depend on a regex engine's idea of a digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "•"
REDACTED = "[redacted]"

# Fields that hold identity or financial numbers.
SENSITIVE_FIELDS = ("aadhaar_number", "pan_number", "dl_number", "passport_number", "mrz_line_2", "bank_account_number", "ifsc_code", "tin_pan", "policy_number", "application_number")

# Patterns that are replaced in this order before a text leaves for a search.
PII_PATTERNS = (
    r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b",
    r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b",
    r"\b[0-9]{9,18}\b",
    r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+",
    r"\+?[0-9][0-9\s-]{8,}[0-9]",
)


def mask_value(value: Column, visible: int = 4) -> Column:
    """All letters and digits but the last ``visible`` become bullets; so does all of a value with no more than that."""
    text = value.cast("string")
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    far = rf"[\p{{L}}\p{{N}}](?=(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{{visible}}})"
    return F.when(text.isNull(), "").when(kept <= visible, F.repeat(F.lit(MASK), F.length(text))).otherwise(F.regexp_replace(text, far, MASK))


def mask_field(name: Column, value: Column) -> Column:
    """``mask_value`` for sensitive fields, the value itself for others, and nothing for a null."""
    return F.when(name.isin(*SENSITIVE_FIELDS), mask_value(value)).otherwise(F.coalesce(value.cast("string"), F.lit("")))


def mask_numbers_in_text(text: Column) -> Column:
    """Mask spaced groups of 4-4-4 digits, then runs of six letters or digits and more that have two digits.

    Pieces of the text alternate between runs and what stands between them, so
    each run is masked on its own and the text is put together again.
    """
    groups = r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"
    run = r"[A-Za-z0-9]{6,}"

    def each(source: Column, pattern: str, mask) -> Column:
        found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        gaps = F.split(source, pattern)
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.when(m.isNull(), "").otherwise(mask(m)))), "")

    def masked_run(m: Column) -> Column:
        digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
        return F.when(digits >= 2, mask_value(m)).otherwise(m)

    return F.when(text.isNull() | (text == ""), "").otherwise(each(each(text, groups, mask_value), run, masked_run))


def scrub_pii(text: Column) -> Column:
    """Identity numbers, e-mail addresses and phone numbers become a fixed word, one pattern after the other."""
    for pattern in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def contains_pii(text: Column) -> Column:
    found = F.lit(False)
    for pattern in PII_PATTERNS:
        found = found | text.rlike(pattern)
    return found


def redact_secrets(message: Column) -> Column:
    """First line of a message, key-like tokens hidden, at most 200 characters."""
    line = F.substring_index(F.trim(message), "\n", 1)
    return F.substring(F.regexp_replace(line, r"(?:sk-|AIza|tvly-|key[-_=])[A-Za-z0-9_-]{8,}", "<redacted>"), 1, 200)


def compact(value: Column) -> Column:
    """Without white space and ``- _ . , /``, in upper case."""
    return F.upper(F.regexp_replace(value, r"[\s\-_.,/]", ""))


# Look-alike characters of handwriting and OCR.
TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "T": "7"}
TO_ALPHA = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "G", "7": "T"}


def to_digits(value: Column) -> Column:
    return F.translate(value, "".join(TO_DIGIT), "".join(TO_DIGIT.values()))


def to_letters(value: Column) -> Column:
    return F.translate(value, "".join(TO_ALPHA), "".join(TO_ALPHA.values()))


def coerce_pattern(value: Column, pattern: str) -> Column:
    """Look-alikes put right by place: A letter, 9 digit, 0 literal zero, X either; what is beyond the pattern stays."""
    pieces, at = [], 0
    while at < len(pattern):
        end = at
        while end < len(pattern) and pattern[end] == pattern[at]:
            end += 1
        part = F.substring(value, at + 1, end - at)
        pieces.append({"9": to_digits, "0": to_digits, "A": to_letters, "X": lambda c: c}[pattern[at]](part))
        at = end
    return F.concat(*pieces, F.substring(value, len(pattern) + 1, 1 << 30))


def coercion_notes(before: Column, after: Column) -> Column:
    """What each look-alike became, by place."""
    pairs = F.zip_with(F.split(before, ""), F.split(after, ""), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    notes = F.transform(pairs, lambda p, i: F.when(~p["b"].eqNullSafe(p["a"]), F.concat(F.lit("position "), (i + 1).cast("string"), F.lit(": '"), p["b"], F.lit("'→'"), p["a"], F.lit("'"))))
    return F.filter(notes, lambda n: n.isNotNull())


def ocr_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9<]", "")


def duration_seconds(text: Column) -> Column:
    """Seconds of texts like ``37s`` or ``1.5s``; null for others."""
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)s\s*$", 1).try_cast("double")
