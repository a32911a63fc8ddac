from caseloom.functions.redaction import redact
from caseloom.functions.text import (
    basename,
    extension,
    first_block,
    safe_name,
    stem,
    strip_fence,
    strip_html,
    strip_text,
)

__all__ = [
    "basename",
    "extension",
    "first_block",
    "redact",
    "safe_name",
    "stem",
    "strip_fence",
    "strip_html",
    "strip_text",
]
