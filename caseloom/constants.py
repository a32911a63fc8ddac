"""Fixed values. They must stay equal to the values callers rely on, so they are plain text."""

import re

# Evidence categories, in tie-break order.
CATEGORIES = [
    "Employment_Contracts",
    "Correspondence",
    "Performance_Reviews",
    "Termination_Documents",
    "Payroll_Financial",
    "Other_Relevant_Evidence",
]
DEFAULT_CATEGORY = "Other_Relevant_Evidence"
UNCATEGORIZED = "Uncategorized"

# Output folders and file names.
EVIDENCE_ROOT = "Evidence_Package"
EXCLUDED_ROOT = "Excluded_Documents"
AUDIT_COLUMNS = ["file_name", "category", "is_relevant", "reason", "copy_failed"]

# Wording of reasons.
NO_CONTENT_REASON = "Unsupported file type or no extractable text."
FAILED_REASON = "Automatic categorization failed; flagged for manual review."
NO_REASON = "No reason provided by LLM."

# File types. Every other extension is unsupported.
TEXT_EXTENSIONS = [".pdf", ".docx", ".eml"]
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}

# Redaction token and the marker that shields a protected figure.
REDACTED = "[REDACTED]"
SHIELD = "__PROTECTED_{}__"

# Patterns as published. {w} {d} {s} stand for the word, digit and space
# classes, which differ between the Unicode and the ASCII mode (see CLASSES).
EMAIL = r"[{w}.+-]+@[{w}-]+\.[{w}.-]+"
PHONE = r"(\+61[{s}-]?[{d}]|\(0[{d}]\)|0[{d}])[{d}{s}-]{{6,11}}[{d}]"
PROTECTED_FIGURE = r"\$[{s}]?190,100"
PROTECTED_TEXT = "$190,100"
HTML_TAG = r"<[^>]+>"
UNSAFE_NAME_CHAR = r"[^{w}.\-]"

# Members of the character classes. The Unicode set is the one Python's
# re module uses for \w \d \s on text, which Java's own \w \d \s do not cover.
CLASSES = {
    "unicode": {
        "w": r"\p{L}\p{N}_",
        "d": r"\p{Nd}",
        "s": r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}",
    },
    "ascii": {"w": "A-Za-z0-9_", "d": "0-9", "s": r"\x09\x0A\x0C\x0D\x20"},
}

# Optional extra protected pattern (ISO dates), which the phone pattern would eat.
ISO_DATE = r"(?<![{d}])[{d}]{{4}}-[{d}]{{2}}-[{d}]{{2}}(?![{d}])"

# Optional extra pattern: postal addresses. Group 1 is what stands before. A number, one to three capitalised words and a word
# for a street, perhaps a unit in front, perhaps a place with a postal code behind.
STREET_WORDS = (
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Place Pl Square Sq Way Terrace Tce Crescent Cres Parade Pde "
    "Highway Hwy Boulevard Blvd Close Grove"
).split()
ADDRESS = (
    r"(^|[^\p{{L}}\p{{N}}])(?:(?:Unit|Flat|Apt|Suite|Level) [0-9]{{1,5}}[A-Za-z]?,? )?[0-9]{{1,5}}[A-Za-z]?(?:[/-][0-9]{{1,5}}[A-Za-z]?)?,? "
    r"(?:\p{{Lu}}[\p{{L}}'-]{{1,30}} ){{1,3}}(?:" + "|".join(STREET_WORDS) + r")\b\.?"
    r"(?:,? (?:\p{{Lu}}[\p{{L}}'-]{{1,30}} ){{1,3}}(?:[A-Z]{{2,3}} )?[0-9]{{4,5}}\b)?"
)

# USD per million tokens.
INPUT_PRICE_PER_MILLION = 3.00
OUTPUT_PRICE_PER_MILLION = 15.00

# Summary headings, in order.
SUMMARY_HEADINGS = ["Background", "Key Facts", "Potential Claims", "Notable Evidence"]


def pattern(template: str, unicode: bool = True) -> str:
    """A pattern template with its character classes filled in."""
    return template.format(**CLASSES["unicode" if unicode else "ascii"])


def python_class(template: str, unicode: bool = True) -> str:
    """A filled pattern template in the notation of Python's re."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern(template, unicode))
