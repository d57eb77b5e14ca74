"""Text and HTML cleaning as Column expressions.

All of it is native Spark string work, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The cleaning rules must match character for character.
ANSI_CODE = r"\x1b\[[0-9;]*m"
CONTROL_CHAR = r"[\x00-\x1f\x7f]"
PROMPT_MARKS = ("---", "===", "```")
HTML_RULES = (
    r"(?isu)<script[^>]*>.*?</script>",
    r"(?isu)<style[^>]*>.*?</style>",
    r"""(?iU)on\w+\s*=\s*["'][^"']*["']""",
    r"(?iu)javascript:",
    r"(?isu)<iframe[^>]*>.*?</iframe>",
    r"(?isu)<object[^>]*>.*?</object>",
    r"(?iu)<embed[^>]*>",
    r"(?isu)<form[^>]*>.*?</form>",
)
STRICT_HTML_RULES = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?i)<script[^>]*>",
    r"(?i)</script>",
    r'(?i)on[a-z]+\s*=\s*"[^"]*"',
    r"(?i)on[a-z]+\s*=\s*'[^']*'",
    r"""(?i)javascript:[^"']*""",
    r"""(?i)data:[^"']*""",
    r"(?is)<iframe[^>]*>.*?</iframe>",
    r"(?i)<iframe[^>]*>",
    r"(?is)<object[^>]*>.*?</object>",
    r"(?i)<embed[^>]*>",
    r"(?is)<form[^>]*>.*?</form>",
    r"(?i)<input[^>]*>",
    r"(?is)<button[^>]*>.*?</button>",
)
# The characters Python's str.strip() removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``F.trim`` removes ASCII space only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def _remove_all(text: Column, patterns: tuple[str, ...]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def _remove_ansi(text: Column) -> Column:
    """The byte search is much cheaper than the pattern, and few texts have an ESC code."""
    has_code = text.contains("\x1b[")
    return F.when(has_code, F.regexp_replace(text, ANSI_CODE, "")).otherwise(text)


def sanitize_prompt(text: Column, n: int = 200, dialect: str = "python") -> Column:
    """Make untrusted text safe to quote in a prompt; null gives an empty string.

    ``python`` removes ANSI codes before control characters and strips the result.
    ``shell`` has no ANSI rule and does not strip.
    """
    text = F.coalesce(text, F.lit(""))
    if dialect == "python":
        text = _remove_ansi(text)
    elif dialect != "shell":
        raise ValueError(f"unknown dialect: {dialect}")
    text = F.regexp_replace(text, CONTROL_CHAR, "")
    for mark in PROMPT_MARKS:
        text = F.replace(text, F.lit(mark))
    text = F.substring(text, 1, n)
    return strip(text) if dialect == "python" else text


def sanitize_log(text: Column, n: int = 100) -> Column:
    """Make text safe for a log line.

    Control characters go first, so the ESC of an ANSI code is gone before the ANSI rule
    runs and a tail such as ``[31m`` stays. That order is part of the contract.
    """
    text = _remove_all(F.coalesce(text, F.lit("")), (CONTROL_CHAR, ANSI_CODE))
    return F.substring(text, 1, n)


def sanitize_html(html: Column) -> Column:
    """Remove active content from HTML: one ordered pass of 8 rules."""
    return _remove_all(html, HTML_RULES)


def sanitize_html_strict(html: Column) -> Column:
    """The 14-rule form: also dangling tags, ``data:`` URLs and form controls, but keeps styles."""
    return _remove_all(html, STRICT_HTML_RULES)
