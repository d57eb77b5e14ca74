"""The SAFE / QUARANTINE reply grammar, fail-closed results and delivery outcomes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift.functions.clean import strip

# Reply grammar and reason texts.
VERDICT_PATTERN = r"""^(SAFE|QUARANTINE)\|([a-zA-Z0-9 ,.\-'"&/():;!?]{1,100})$"""
SHELL_VERDICT_PATTERN = r"^(SAFE|QUARANTINE)\|([a-zA-Z0-9 ,.-]{1,80})$"
INVALID_REPLY = "Invalid AI response format"
SHELL_INVALID_REPLY = "AI analysis failed after 3 attempts - manual review required"
API_ERROR = "AI API error: "
OTHER_ERROR = "Analysis failed: "
ERROR_CHARS = 40


def _result(verdict: Column, reason: Column, reply: Column) -> Column:
    return F.struct(
        verdict.alias("verdict"),
        reason.alias("reason"),
        F.lit(None).cast("double").alias("confidence"),
        reply.alias("raw_response"),
    )


def parse_verdict(reply: Column, dialect: str = "python") -> Column:
    """Struct of the first line that is a whole verdict; without one, QUARANTINE."""
    lines = F.split(F.coalesce(reply, F.lit("")), "\n")
    if dialect == "python":
        pattern, invalid = VERDICT_PATTERN, INVALID_REPLY
        lines = F.transform(lines, strip)
    elif dialect == "shell":
        pattern, invalid = SHELL_VERDICT_PATTERN, SHELL_INVALID_REPLY
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    line = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    return _result(
        F.coalesce(F.substring_index(line, "|", 1), F.lit("QUARANTINE")),
        F.coalesce(F.substring_index(line, "|", -1), F.lit(invalid)),
        reply,
    )


def fail_closed(
    reply: Column, error: Column, error_kind: Column, dialect: str = "python"
) -> Column:
    """Result of one scoring attempt: any error is QUARANTINE with the error in the reason."""
    prefix = F.when(error_kind == "api", API_ERROR).otherwise(OTHER_ERROR)
    failed = _result(
        F.lit("QUARANTINE"),
        F.concat(prefix, F.substring(error, 1, ERROR_CHARS)),
        F.lit(None).cast("string"),
    )
    return F.when(error.isNotNull(), failed).otherwise(parse_verdict(reply, dialect))


def verdict_json(verdict: Column, reason: Column, confidence: Column) -> Column:
    """JSON of a result without the raw reply; a null confidence is kept."""
    fields = F.struct(
        verdict.alias("verdict"), reason.alias("reason"), confidence.alias("confidence")
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def disposition(verdict: Column) -> Column:
    """SAFE is delivered; everything else, null included, is quarantined."""
    return F.when(verdict == "SAFE", "delivered").otherwise("quarantine")


def delivery_outcome(code: Column) -> Column:
    """ok, retry, permanent or error from a delivery reply code."""
    return (
        F.when(code.between(200, 299), "ok")
        .when(code.between(400, 499), "retry")
        .when(code.between(500, 599), "permanent")
        .otherwise("error")
    )
