from mailsift.functions.clean import (
    sanitize_html,
    sanitize_html_strict,
    sanitize_log,
    sanitize_prompt,
    strip,
)
from mailsift.functions.compose import build_scan_prompt, digest_entry, digest_entry_long
from mailsift.functions.headers import (
    digest_preview,
    domain_of,
    extract_headers,
    first_header,
    fold_lines,
    folder_label,
    header_block,
    message_body,
    message_key,
    original_recipient,
    plain_preview,
    recipient_address,
    route_folder,
    scan_preview,
    stamp_original_recipient,
)
from mailsift.functions.timing import micros, retry_delay
from mailsift.functions.verdict import (
    delivery_outcome,
    disposition,
    fail_closed,
    parse_verdict,
    verdict_json,
)

__all__ = [
    "build_scan_prompt", "delivery_outcome", "digest_entry", "digest_entry_long", "digest_preview",
    "disposition", "domain_of", "extract_headers", "fail_closed", "first_header",
    "fold_lines", "folder_label", "header_block", "message_body", "message_key", "micros",
    "original_recipient", "parse_verdict", "plain_preview", "recipient_address",
    "retry_delay", "route_folder", "sanitize_html", "sanitize_html_strict", "sanitize_log",
    "sanitize_prompt", "scan_preview", "stamp_original_recipient", "strip", "verdict_json",
]
