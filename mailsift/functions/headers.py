"""Header extraction, addresses and routing as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from mailsift.functions.clean import strip

MAIL_HEADERS = ("From", "To", "Reply-To", "Subject", "Message-ID", "Date")
# A line break inside a folded header while the block is searched line by line.
FOLD = "\ue000"
PREVIEW_CHARS = 800


def field_name(header: str) -> str:
    return header.lower().replace("-", "_")


def header_block(raw: Column) -> Column:
    """Everything before the first blank line, found by byte search."""
    block = F.substring_index(F.substring_index(raw, "\n\n", 1), "\n\r\n", 1)
    return F.rtrim(block, F.lit("\r"))


def message_body(raw: Column, n: int | None = None) -> Column:
    """Everything after the first blank line, or its first ``n`` characters."""
    start = F.length(header_block(raw)) + 1
    # A blank line is two line breaks of up to two characters each.
    rest = F.substring(raw, start, F.length(raw) if n is None else F.lit(n + 4))
    body = F.regexp_replace(rest, r"\A\r?\n\r?\n", "")
    return body if n is None else F.substring(body, 1, n)


def fold_lines(block: Column) -> Column:
    """Join each continuation line to its header, marking where the break was."""
    folded = block.contains("\n ") | block.contains("\n\t")
    return F.when(folded, F.regexp_replace(block, r"\r?\n(?=[ \t])", FOLD)).otherwise(block)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one (``regexp_extract`` gives an empty string)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(1))


def first_header(folded: Column, names: str | Sequence[str], unfold: bool = True) -> Column:
    """Value of the first header, in file order, with one of ``names``; null when absent.

    With ``unfold`` the line breaks of a folded value are removed, otherwise they stay.
    """
    if isinstance(names, str):
        names = (names,)
    line = F.regexp_extract(folded, r"(?i)(?:\A|\n)(?:" + "|".join(names) + r")(:[^\n]*)", 1)
    # No match is an empty string, which has no part after a colon and so gives null.
    found = F.try_element_at(F.split(line, ":", 2), F.lit(2))
    value = F.replace(found, F.lit(FOLD), F.lit("" if unfold else "\n"))
    return F.rtrim(F.ltrim(value, F.lit(" \t\r\n")), F.lit("\r\n"))


def extract_headers(
    raw: Column, names: Sequence[str] = MAIL_HEADERS, unfold: bool = True
) -> Column:
    """Struct with the first occurrence of each header, matched without regard to case."""
    folded = fold_lines(header_block(raw))
    return F.struct(
        *[first_header(folded, name, unfold).alias(field_name(name)) for name in names]
    )


def plain_preview(body: Column, n: int = PREVIEW_CHARS) -> Column:
    """Cut, then turn line feeds into spaces and strip; carriage returns stay."""
    return strip(F.translate(F.substring(body, 1, n), "\n", " "))


def scan_preview(raw: Column, n: int = PREVIEW_CHARS) -> Column:
    """Shell form of the preview: every stretch from a blank line to a line starting with ``--``."""
    stretches = F.regexp_extract_all(raw, F.lit(r"(?ms)^\n.*?(?:^--[^\n]*(?:\n|\z)|\z)"), F.lit(0))
    return F.translate(F.substring(F.array_join(stretches, ""), 1, n), "\n", " ")


def digest_preview(raw: Column, n: int = 300) -> Column:
    """Shell form for digests: from the first blank line on, without lines starting with ``--``."""
    start = F.length(header_block(raw)) + 2
    text = F.substring(raw, start, F.length(raw))
    kept = F.regexp_replace(text, r"(?m)^--[^\n]*(?:\n|\z)", "")
    return F.translate(F.substring(kept, 1, n), "\n", " ")


def recipient_address(to: Column) -> Column:
    """Bare address out of ``Name <a@b>``, ``<a@b>`` or ``a@b``; otherwise the input.

    Comments in round brackets before or after the address are left out. Lists of several
    addresses are not split; they come back unchanged.
    """
    angle = r'(?:"(?:[^"\\]|\\.)*+"|[^<>",]*)\s*<\s*([^<>\s,]+)\s*>'
    bare = r'([^<>\s,;:"()]+@[^<>\s,;:"()]+)'
    comments = r"(?:\s*\((?:[^()\\]|\\.)*+\))*+"
    return F.regexp_replace(
        to, rf"^{comments}\s*(?:{angle}|{bare}){comments}\s*$", "$1$2")


def original_recipient(raw: Column) -> Column:
    """Address from X-Envelope-To, else from the first of the other recipient headers."""
    folded = fold_lines(header_block(raw))
    some = r":[ \t]*([^\n]*[^\s][^\n]*)"
    envelope = first_match(folded, r"(?i)(?:\A|\n)X-Envelope-To" + some)
    others = first_match(folded, r"(?i)(?:\A|\n)(?:X-Original-To|Delivered-To|To)" + some)
    return recipient_address(
        F.rtrim(F.replace(F.coalesce(envelope, others), F.lit(FOLD)), F.lit("\r"))
    )


def stamp_original_recipient(raw: Column) -> Column:
    """Put an X-Original-To header in front when one can be found and none is there."""
    present = first_header(fold_lines(header_block(raw)), "X-Original-To").isNotNull()
    stamp = F.concat(F.lit("X-Original-To: "), original_recipient(raw), F.lit("\n"))
    return F.concat(F.when(present, "").otherwise(F.coalesce(stamp, F.lit(""))), raw)


def route_folder(recipient: Column, prefix: str | None = "svc-") -> Column:
    """``<prefix>X@domain`` goes to folder ``lower(X)``, all else to INBOX."""
    if not prefix:
        return F.lit("INBOX")
    quoted = "".join("\\" + c if not c.isalnum() else c for c in prefix)
    folder = first_match(recipient, rf"(?i)^{quoted}([^@]+)@")
    return F.coalesce(F.lower(folder), F.lit("INBOX"))


def folder_label(path: Column) -> Column:
    """QUARANTINE, SENT, INBOX or OTHER from a folder path."""
    return (
        F.when(path.contains("/.Quarantine/"), "QUARANTINE")
        .when(path.contains("/.Sent/"), "SENT")
        .when(path.endswith("/cur"), "INBOX")
        .otherwise("OTHER")
    )


def message_key(mailbox: Column, message_id: Column, content: Column) -> Column:
    """Deterministic key of a message: the same message always gets the same name."""
    unit = F.encode(F.lit("\x1f"), "UTF-8")
    parts = F.concat(
        F.encode(F.coalesce(mailbox.cast("string"), F.lit("")), "UTF-8"),
        unit,
        F.encode(F.coalesce(message_id, F.lit("")), "UTF-8"),
        unit,
        F.coalesce(content.cast("binary"), F.lit(b"")),
    )
    return F.sha2(parts, 256)


def domain_of(address: Column) -> Column:
    """Lower-case domain of an address header; empty when there is none."""
    return F.lower(F.regexp_extract(address, r"@([^>\s@]+)>?\s*$", 1))
