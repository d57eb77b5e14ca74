"""Pieces of the SQL checks, written apart from the Column code they check."""

from __future__ import annotations

# White space that can be left once control characters are removed.
SPACES = "' ' || chr(133) || chr(160) || chr(8195) || chr(8239) || chr(12288)"
ALL_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + SPACES


def replace_all(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return text


def prompt(text: str, n: int, shell: bool = False) -> str:
    patterns = (r"[\x00-\x1f\x7f]",) if shell else (r"\x1b\[[0-9;]*m", r"[\x00-\x1f\x7f]")
    text = replace_all(f"coalesce({text}, '')", *patterns)
    for mark in ("---", "===", "```"):
        text = f"replace({text}, '{mark}', '')"
    cut = f"substr({text}, 1, {n})"
    return cut if shell else f"trim({cut}, {SPACES})"


def log(text: str, n: int) -> str:
    return f"substr({replace_all(text, r'[\x00-\x1f\x7f]', r'\x1b\[[0-9;]*m')}, 1, {n})"


def preview(body: str, n: int = 800) -> str:
    return f"trim(replace(substr({body}, 1, {n}), chr(10), ' '), {ALL_SPACES})"


def verdict_line(reply: str) -> str:
    pattern = r"""^(SAFE|QUARANTINE)\|[a-zA-Z0-9 ,.\-''"&/():;!?]{1,100}$"""
    lines = f"list_transform(string_split(coalesce({reply}, ''), chr(10)), lambda x: trim(x, {ALL_SPACES}))"
    return f"list_filter({lines}, lambda x: regexp_matches(x, '{pattern}'))[1]"


def shell_verdict_line(reply: str) -> str:
    pattern = r"^(SAFE|QUARANTINE)\|[a-zA-Z0-9 ,.-]{1,80}$"
    lines = f"string_split(coalesce({reply}, ''), chr(10))"
    return f"list_filter({lines}, lambda x: regexp_matches(x, '{pattern}'))[1]"


def verdict_of(reply: str) -> str:
    return f"coalesce(split_part({verdict_line(reply)}, '|', 1), 'QUARANTINE')"


def reason_of(reply: str) -> str:
    return f"coalesce(split_part({verdict_line(reply)}, '|', 2), 'Invalid AI response format')"


def address(to: str) -> str:
    return f"CASE WHEN {to} LIKE '%<%' THEN regexp_extract({to}, '<(.*)>', 1) ELSE split_part({to}, ' (', 1) END"


def domain(addr: str) -> str:
    return f"lower(split_part(rtrim({addr}, '>'), '@', -1))"


LABEL = (
    "CASE folder WHEN '.Quarantine/cur' THEN 'QUARANTINE' WHEN '.Sent/cur' THEN 'SENT' "
    "WHEN 'cur' THEN 'INBOX' ELSE 'OTHER' END"
)

_EDGE = "(?i)(?:^|[^a-z])(?:{})(?:[^a-z]|$)"
_URGENT = _EDGE.format("urgent|immediately|suspended|final notice|act now")
_ASK = _EDGE.format(
    "password|passcode|verify your|log ?in|account|wire transfer|gift card|payment|bitcoin"
)
_STEER = (
    "(?i)(?:ignore|disregard) (?:all |any )?(?:previous|prior|above) instructions"
    "|system prompt|you are now"
)


def near_brand(label: str, brand: str) -> str:
    return (
        f"({label} <> {brand} AND levenshtein(translate({label}, '01357$@', 'olestsa'), {brand}) <= 1)"
    )


def risk_flags(frm: str, reply_to: str, subject: str, body: str) -> dict[str, str]:
    """Condition of each signal, in the order of the signal list."""
    labels = f"regexp_split_to_array({domain(frm)}, '[.-]')"
    near = " OR ".join(
        near_brand("x", f"'{b}'") for b in ("amazon", "google", "microsoft", "paypal")
    )
    digits = "length(regexp_replace(x, '[^0-9]', '', 'g'))"
    random_token = (
        f"length(x) >= 12 AND regexp_full_match(x, '[A-Za-z0-9]+') AND {digits} >= 3 "
        f"AND length(x) - {digits} >= 3"
    )

    def either(pattern: str) -> str:
        return f"(regexp_matches({subject}, '{pattern}') OR regexp_matches({body}, '{pattern}'))"

    return {
        "lookalike_domain": f"len(list_filter({labels}, lambda x: {near})) > 0",
        "reply_to_mismatch": f"({reply_to} IS NOT NULL AND {domain(reply_to)} <> {domain(frm)})",
        "urgent_request": f"({either(_URGENT)} AND {either(_ASK)})",
        "random_subject": f"len(list_filter(string_split({subject}, ' '), lambda x: {random_token})) > 0",
        "disguised_sender": f"regexp_matches({frm}, '[^\\x00-\\x7f]')",
        "steering_text": either(_STEER),
    }


def rule_reply(flags: dict[str, str]) -> str:
    order = (
        ("lookalike_domain", "Look-alike sender domain"),
        ("steering_text", "Text tries to steer the check"),
        ("urgent_request", "Urgency with credential or payment request"),
        ("disguised_sender", "Disguised characters in sender"),
        ("random_subject", "Random string in subject"),
    )
    cases = " ".join(f"WHEN {flags[n]} THEN 'QUARANTINE|{r}'" for n, r in order)
    return f"CASE {cases} ELSE 'SAFE|No clear sign of harm' END"


CATEGORY = f"""CASE WHEN {LABEL} = 'QUARANTINE' THEN 'Quarantined'
  WHEN regexp_matches(from_addr, '(?i)(?:^|[^a-z])(?:news|newsletter|no-?reply)[^@]*@') THEN 'Newsletters'
  WHEN regexp_matches(subject, '(?i)(?:urgent|deadline|meeting|reminder|action required)') THEN 'Action Items'
  WHEN regexp_matches(from_addr, '(?i)(?:^|[^a-z])(?:billing|alerts|sales|orders)[^@]*@')
    OR regexp_matches(subject, '(?i)(?:invoice|receipt|contract|shipment)') THEN 'Business'
  ELSE 'Personal' END"""
