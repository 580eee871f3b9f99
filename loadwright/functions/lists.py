"""Options that are written as lists in one text."""

from __future__ import annotations

import re


def match_key_suffixes(text: str | None) -> list[str]:
    """Comma-separated suffixes, trimmed, lower-cased, blanks dropped."""
    return [part.strip().lower() for part in (text or "").split(",") if part.strip()]


def excluded_columns(text: str | None) -> list[str]:
    """Names separated by comma, semicolon or line break; trimmed, lower-cased, blanks dropped."""
    return sorted({part.strip().lower() for part in re.split(r"[,;\r\n]", text or "") if part.strip()})
