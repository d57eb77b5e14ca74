"""Rule-based risk signals, verdicts and digest categories.

These rules are this package's own, deterministic stand-in for a model's judgement.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from mailsift.functions.headers import domain_of

BRANDS = ("amazon", "google", "microsoft", "paypal")
LOOK_ALIKE_FROM, LOOK_ALIKE_TO = "01357$@", "olestsa"

URGENT = ("urgent", "immediately", "suspended", "final notice", "act now")
ASKING = (
    "password", "passcode", "verify your", "login", "log in", "account",
    "wire transfer", "gift card", "payment", "bitcoin",
)
STEERING = (
    r"(?:ignore|disregard) (?:all |any )?(?:previous|prior|above) instructions"
    r"|system prompt|you are now"
)
STEERING_HINTS = ("instructions", "system prompt", "you are now")

# Signals that quarantine on their own, with the reason given, most telling first.
CLEAR_SIGNALS = (
    ("lookalike_domain", "Look-alike sender domain"),
    ("steering_text", "Text tries to steer the check"),
    ("urgent_request", "Urgency with credential or payment request"),
    ("disguised_sender", "Disguised characters in sender"),
    ("random_subject", "Random string in subject"),
)

# Ordered rules: category, field, pattern. The folder decides Quarantined first.
CATEGORY_RULES = (
    ("Newsletters", "from_addr", r"(?i)(?:^|[^a-z])(?:news|newsletter|no-?reply)[^@]*@"),
    ("Action Items", "subject", r"(?i)(?:urgent|deadline|meeting|reminder|action required)"),
    ("Business", "from_addr", r"(?i)(?:^|[^a-z])(?:billing|alerts|sales|orders)[^@]*@"),
    ("Business", "subject", r"(?i)(?:invoice|receipt|contract|shipment)"),
)
OTHER_CATEGORY = "Personal"
QUARANTINED = "Quarantined"


def plain_letters(label: Column) -> Column:
    """Undo the usual digit-for-letter swaps."""
    return F.translate(label, LOOK_ALIKE_FROM, LOOK_ALIKE_TO)


def domain_labels(domain: Column) -> Column:
    return F.split(domain, "[.-]")


def lookalike(domain: Column, brands: Sequence[str] = BRANDS, max_distance: int = 1) -> Column:
    """True when a label of the domain resembles a brand without being it.

    The brands are one array value, so the expression is as long for a thousand as for four; a
    brand table is joined instead (``operators.joins.lookalike_domains``).
    """
    names = F.array(*[F.lit(brand) for brand in brands]).cast("array<string>")

    def resembles(label: Column) -> Column:
        plain = plain_letters(label)
        return F.exists(
            names, lambda name: (label != name) & (F.levenshtein(plain, name, max_distance) >= 0)
        )

    return F.exists(domain_labels(domain), resembles)


def _contains_any(lowered: Column, phrases: Sequence[str]) -> Column:
    return reduce(or_, [lowered.contains(phrase) for phrase in phrases])


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """True when one of the phrases occurs as whole words, in either case.

    The byte search settles nearly all texts; only candidates pay for the pattern.
    """
    lowered = F.lower(text)
    whole = r"(?:^|[^a-z])(?:" + "|".join(phrases) + r")(?:[^a-z]|$)"
    return _contains_any(lowered, phrases) & lowered.rlike(whole)


def steers(text: Column) -> Column:
    """True when the text addresses whoever classifies it."""
    lowered = F.lower(text)
    return _contains_any(lowered, STEERING_HINTS) & lowered.rlike(STEERING)


def _random_token(token: Column) -> Column:
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return (
        (F.length(token) >= 12)
        & token.rlike("^[A-Za-z0-9]+$")
        & (digits >= 3)
        & (F.length(token) - digits >= 3)
    )


def risk_signals(
    from_addr: Column,
    reply_to: Column,
    subject: Column,
    body: Column,
    brands: Sequence[str] = BRANDS,
) -> Column:
    """Array with the names of the signals that fire."""
    sender = domain_of(from_addr)
    urgent = mentions(subject, URGENT) | mentions(body, URGENT)
    asks = mentions(subject, ASKING) | mentions(body, ASKING)
    checks = (
        ("lookalike_domain", lookalike(sender, brands)),
        ("reply_to_mismatch", reply_to.isNotNull() & (domain_of(reply_to) != sender)),
        ("urgent_request", urgent & asks),
        ("random_subject", F.exists(F.split(subject, " "), _random_token)),
        ("disguised_sender", from_addr.rlike(r"[^\x00-\x7f]")),
        ("steering_text", steers(subject) | steers(body)),
    )
    return F.array_compact(
        F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in checks])
    )


def rule_verdict(signals: Column) -> Column:
    """Reply line ``VERDICT|reason``: SAFE unless a clear signal fires; null is QUARANTINE."""
    reply = F.when(signals.isNull(), "QUARANTINE|Nothing to judge")
    for name, reason in CLEAR_SIGNALS:
        reply = reply.when(F.array_contains(signals, name), f"QUARANTINE|{reason}")
    return reply.otherwise("SAFE|No clear sign of harm")


def digest_category(
    folder: Column,
    fields: dict[str, Column],
    rules: Sequence[tuple[str, str, str]] = CATEGORY_RULES,
) -> Column:
    """Section of the digest: Quarantined by folder label, else the first matching rule."""
    category = F.when(folder == "QUARANTINE", QUARANTINED)
    for name, field, pattern in rules:
        category = category.when(fields[field].rlike(pattern), name)
    return category.otherwise(OTHER_CATEGORY)
