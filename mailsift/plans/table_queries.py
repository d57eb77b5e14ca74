"""Queries over mail tables: filters, joins, windows, health and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import functions as M
from mailsift.functions.risk import digest_category
from mailsift.functions.timing import micros
from mailsift.operators import digest, filters, health, joins, windows
from mailsift.plans import briefing, sqltext as S
from mailsift.plans.registry import Inputs, query
from mailsift.plans.text_queries import labelled_path
from mailsift.sources import records
from mailsift.sources.mail import DIGEST_FOLDERS

DAY = 86_400


def keyed_mail(v: Inputs):
    return v.mail.withColumnRenamed("message_id", "message_key")


def latest(df, ts: str):
    """The largest time as a scalar subquery: the reference point of "the last 24 hours"."""
    return df.select(F.max(ts)).scalar()


# --- filters ---------------------------------------------------------------------------


@query("mail", sql="""
SELECT doc_id, epoch_us(received_at) AS received_us FROM mail
WHERE received_at >= (SELECT max(received_at) FROM mail) - INTERVAL 24 HOUR""")
def recent(v: Inputs):
    mail = v.mail
    rows = filters.recent(mail, latest(mail, "received_at"))
    return rows.select("doc_id", micros(F.col("received_at")).alias("received_us"))


@query("queue", sql="SELECT mailbox, name FROM queue WHERE right(name, 5) = '.mail'")
def pending(v: Inputs):
    return filters.pending(v.queue).select("mailbox", "name")


@query("mail", sql=f"""
SELECT doc_id, {S.verdict_of('reply')} AS verdict,
  CASE WHEN {S.verdict_of('reply')} = 'SAFE' THEN 'delivered' ELSE 'quarantine' END AS disposition FROM mail""")
def split_by_verdict(v: Inputs):
    rows = v.mail.select("doc_id", M.parse_verdict(F.col("reply"))["verdict"].alias("verdict"))
    return filters.split_by_verdict(rows)


@query("status", sql="""
SELECT id, CASE WHEN event_type = 'click' THEN 'failed' END AS disposition,
  CASE WHEN event_type = 'click' THEN 'Parse error: unreadable report ' || id END AS reason FROM status""")
def split_malformed(v: Inputs):
    """Reports that cannot be parsed are failed with the reason."""
    broken = F.get_json_object("status", "$.updated_at").isNull()
    error = F.when(broken, F.concat(F.lit("unreadable report "), F.col("id").cast("string")))
    rows = filters.split_malformed(v.status.withColumn("error", error))
    return rows.select("id", "disposition", "reason")


@query("attempts", sql="""
SELECT code, CASE WHEN code < 300 THEN 'ok' WHEN code < 500 THEN 'retry' ELSE 'permanent' END AS outcome,
  count(*) AS attempts FROM attempts GROUP BY ALL""")
def delivery_outcome(v: Inputs):
    rows = v.attempts.select("code", M.delivery_outcome(F.col("code")).alias("outcome"))
    return rows.groupBy("code", "outcome").agg(F.count("*").alias("attempts"))


# --- joins -----------------------------------------------------------------------------


@query("mail", "ledger", sql="""
SELECT doc_id, message_id AS message_key FROM mail
WHERE message_id NOT IN (SELECT message_key FROM ledger)""")
def unprocessed(v: Inputs):
    return joins.unprocessed(keyed_mail(v), v.ledger).select("doc_id", "message_key")


@query("attempts", "mail", sql="""
SELECT doc_id, coalesce(n, 0) AS retries FROM mail LEFT JOIN (
  SELECT message_key, count(*) AS n FROM attempts WHERE code >= 550 GROUP BY ALL) ON message_key = mailbox""")
def with_retry_count(v: Inputs):
    counters = v.attempts.where("code >= 550").groupBy("message_key").agg(
        F.count("*").alias("retries")
    )
    mail = v.mail.select("doc_id", F.col("mailbox").alias("message_key"))
    return joins.with_retry_count(mail, counters).select("doc_id", "retries")


_AUDIT = """
SELECT coalesce(m.message_id, l.message_key) AS message_key, CAST(length(m.body) AS BIGINT) AS expected_size,
  l.size AS landed_size, CASE WHEN l.message_key IS NULL THEN 'missing' WHEN m.message_id IS NULL THEN 'unexpected'
    WHEN length(m.body) = l.size THEN 'ok' ELSE 'size_mismatch' END AS audit
FROM mail m FULL JOIN landed l ON m.message_id = l.message_key"""


def _audit(v: Inputs):
    expected = keyed_mail(v).select("message_key", F.length("body").alias("size"))
    return joins.audit_landed(expected, v.landed)


@query("mail", "landed", sql=_AUDIT)
def audit_landed(v: Inputs):
    return _audit(v)


@query("mail", "landed", sql=f"""
SELECT doc_id FROM mail WHERE message_id IN (SELECT message_key FROM ({_AUDIT}) WHERE audit = 'ok')""")
def purgeable(v: Inputs):
    return joins.purgeable(keyed_mail(v), _audit(v)).select("doc_id")


@query("mail", "landed", sql=f"""
SELECT doc_id FROM mail WHERE message_id NOT IN (SELECT message_key FROM ({_AUDIT}) WHERE audit = 'ok')""")
def not_purgeable(v: Inputs):
    return joins.not_purgeable(keyed_mail(v), _audit(v)).select("doc_id")


@query("mail", "users", sql=f"""
SELECT doc_id, coalesce(u.mailbox, 'postmaster') AS mailbox FROM mail m
LEFT JOIN users u ON u.recipient = lower({S.address('m.to_addr')})""")
def resolve_mailbox(v: Inputs):
    mail = v.mail.select("doc_id", M.recipient_address(F.col("to_addr")).alias("recipient"))
    return joins.resolve_mailbox(mail, v.users, "postmaster").select("doc_id", "mailbox")


# --- windows ---------------------------------------------------------------------------


def _requests(v: Inputs):
    return v.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")


@query(sql=f"""
SELECT user_id AS key, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {DAY * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS trailing FROM events""")
def trailing_count(v: Inputs):
    return windows.trailing_count(_requests(v), seconds=DAY).drop("ts")


_ORDERED = """ordered AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


@query(sql=f"""
WITH RECURSIVE {_ORDERED}, walk AS (
  SELECT key, id, rn, us AS admitted_us, [us] AS past FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.key, o.id, o.rn, {{go}} AS admitted_us, list_append(w.past, {{go}}) AS past
  FROM walk w JOIN ordered o ON o.key = w.key AND o.rn = w.rn + 1)
SELECT key, id, admitted_us FROM walk""".replace(
    "{go}", f"greatest(o.us, w.past[-1], coalesce(w.past[-3] + {DAY * 1_000_000}, 0))"))
def rate_limit_delay(v: Inputs):
    rows = windows.rate_limit(_requests(v), limit=3, seconds=DAY, mode="delay")
    return rows.select("key", "id", "admitted_us")


RATE_LIMIT_DROP_SQL = f"""
WITH RECURSIVE {_ORDERED}, walk AS (
  SELECT key, id, rn, true AS admitted, [us] AS past FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.key, o.id, o.rn, len(list_filter(w.past, lambda p: p > o.us - {DAY * 1_000_000})) < 3 AS admitted,
    CASE WHEN len(list_filter(w.past, lambda p: p > o.us - {DAY * 1_000_000})) < 3
      THEN list_append(w.past, o.us) ELSE w.past END AS past
  FROM walk w JOIN ordered o ON o.key = w.key AND o.rn = w.rn + 1)
SELECT key, id, admitted FROM walk"""


@query(sql=RATE_LIMIT_DROP_SQL)
def rate_limit_drop(v: Inputs):
    rows = windows.rate_limit(_requests(v), limit=3, seconds=DAY, mode="drop")
    return rows.select("key", "id", "admitted")


MAX_RETRIES = 5
_FAILURES = """numbered AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY {key} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS grp
  FROM {table}), failing AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY {key}, grp ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM numbered)"""
_BACKOFF = f"CASE WHEN NOT ok AND attempt < {MAX_RETRIES} THEN least(5.0 * power(2.0, attempt - 1), 300.0)::DOUBLE END"
RETRY_SQL = f"""
WITH {_FAILURES.format(key='message_key', table='attempts')}, counted AS (
  SELECT message_key, id, ts, ok, CASE WHEN ok THEN 0 ELSE (n - 1) % {MAX_RETRIES} + 1 END AS attempt FROM failing)
SELECT message_key, id, attempt, CASE WHEN ok THEN 'delivered' WHEN attempt = {MAX_RETRIES} THEN 'failed' ELSE 'retry' END AS outcome"""


@query("attempts", sql=RETRY_SQL + f""",
  {_BACKOFF} AS retry_in, epoch_us(ts) + CAST({_BACKOFF} * 1000000 AS BIGINT) AS next_attempt_us FROM counted""")
def retry_outcome(v: Inputs):
    rows = windows.retry_outcome(v.attempts, max_retries=MAX_RETRIES)
    return rows.select(
        "message_key", "id", "attempt", "outcome", "retry_in", "next_attempt_us"
    )


@query("fetch_log", sql=f"""
WITH {_FAILURES.format(key='mailbox', table='fetch_log')}
SELECT mailbox, id, n AS consecutive_failures, error AS last_error,
  max(CASE WHEN ok THEN epoch_us(ts) END) OVER (PARTITION BY mailbox ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS last_success_us
FROM failing""")
def failure_streak(v: Inputs):
    rows = windows.failure_streak(v.fetch_log)
    return rows.select("mailbox", "id", "consecutive_failures", "last_error", "last_success_us")


_READ_STATUS = """read AS (SELECT mailbox, id, ts AS updated_at,
  CASE WHEN event_type IN ('view', 'error') THEN ts END AS last_fetch, CAST(mailbox % 5 AS BIGINT) AS failures,
  CASE WHEN event_type = 'error' THEN 'timeout ' || id END AS last_error, event_type <> 'error' AS connected
  FROM status WHERE event_type <> 'click')"""


@query("status", sql=f"""
WITH {_READ_STATUS}
SELECT mailbox, id, epoch_us(updated_at) AS updated_us, epoch_us(last_fetch) AS last_fetch_us,
  failures AS consecutive_failures, last_error, connected AS is_connected FROM read""")
def read_status(v: Inputs):
    rows = records.read_status(v.status.select("mailbox", "id", "status"))
    return rows.select(
        "mailbox", "id", micros(F.col("updated_at")).alias("updated_us"),
        micros(F.col("last_successful_fetch")).alias("last_fetch_us"),
        "consecutive_failures", "last_error", "is_connected",
    )


def _latest_status(v: Inputs):
    """The last report written wins; if it cannot be read there is none. Only it is parsed."""
    reports = v.status.select("mailbox", "id", "ts", "status")
    return records.read_status(windows.latest_status(reports, "mailbox", "ts", "id"))


_LATEST = """latest AS (SELECT * FROM read WHERE id IN (SELECT id FROM status
  QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY ts DESC, id DESC) = 1))"""


@query("status", sql=f"""
WITH {_READ_STATUS}, {_LATEST}
SELECT mailbox, id, epoch_us(updated_at) AS updated_us, connected AS is_connected, last_error FROM latest""")
def latest_status(v: Inputs):
    return _latest_status(v).select(
        "mailbox", "id", micros(F.col("updated_at")).alias("updated_us"), "is_connected", "last_error"
    )


@query("mail", sql="""
SELECT mailbox, doc_id, row_number() OVER (PARTITION BY mailbox ORDER BY received_at DESC, message_id) AS rank
FROM mail QUALIFY rank <= 5""")
def first_n_per_mailbox(v: Inputs):
    rows = windows.first_n_per_mailbox(
        keyed_mail(v).select("mailbox", "doc_id", "received_at", "message_key"), 5
    )
    return rows.select("mailbox", "doc_id", F.col("rank").cast("bigint").alias("rank"))


# --- set operations --------------------------------------------------------------------


@query("mail", sql="""
SELECT folder, count(*) AS messages FROM mail GROUP BY ALL""")
def folder_union(v: Inputs):
    mail = v.mail
    folders = [mail.where(F.col("folder") == f) for f in DIGEST_FOLDERS]
    return filters.folder_union(*folders).groupBy("folder").agg(F.count("*").alias("messages"))


@query("mail", sql="""
SELECT doc_id, CASE WHEN folder = 'new' THEN 1 ELSE 0 END AS priority FROM mail""")
def retry_first(v: Inputs):
    mail = v.mail.select("doc_id", "folder")
    rows = filters.retry_first(mail.where("folder <> 'new'"), mail.where("folder = 'new'"))
    return rows.select("doc_id", "priority")


# --- scanner log -----------------------------------------------------------------------


@query(sql="""
SELECT user_id AS mailbox, event_id AS id, CASE WHEN event_id % 9 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS ts_us,
  CASE event_type WHEN 'view' THEN 'scan' WHEN 'signup' THEN 'rate_limited' WHEN 'error' THEN 'error' ELSE 'verdict' END AS kind,
  CASE event_type WHEN 'click' THEN 'SAFE' WHEN 'purchase' THEN 'QUARANTINE' END AS verdict,
  CASE event_type WHEN 'click' THEN 'Newsletter ' || event_id WHEN 'purchase' THEN 'Look-alike domain' END AS reason,
  event_type = 'error' AS is_error FROM events""")
def parse_scan_log(v: Inputs):
    rows = records.parse_scan_log(v.scan_log)
    return rows.select(
        "mailbox", "id", micros(F.col("ts")).alias("ts_us"), "kind", "verdict", "reason", "is_error"
    )


# --- health ----------------------------------------------------------------------------

# A mailbox holds few rows at the test scales, so the thresholds are lower than the defaults.
LIMITS = {"critical_pending": 6, "warn_pending": 3}
_COUNTS = """counts AS (SELECT b.mailbox, count(q.mailbox) FILTER (q.state = 'pending') AS staging_count,
  count(q.mailbox) FILTER (q.state = 'failed') AS failed_count
  FROM mailboxes b LEFT JOIN queue q ON q.mailbox = b.mailbox GROUP BY b.mailbox)"""


@query("queue", "mailboxes", sql=f"WITH {_COUNTS} SELECT * FROM counts")
def queue_counts(v: Inputs):
    return health.queue_counts(v.queue, v.mailboxes)


def _health_inputs(v: Inputs):
    counts = health.queue_counts(v.queue, v.mailboxes)
    return health.health_inputs(counts, v.probe, _latest_status(v))


_INPUTS = f"""{_COUNTS}, {_READ_STATUS}, {_LATEST}, inputs AS (
  SELECT c.mailbox, c.staging_count, c.failed_count, coalesce(p.lmtp_available, true) AS lmtp_available,
    coalesce(s.connected, true) AS imap_connected, coalesce(s.failures, 0) AS imap_failures,
    s.last_error, s.last_fetch
  FROM counts c LEFT JOIN probe p USING (mailbox) LEFT JOIN latest s USING (mailbox))"""


@query("queue", "mailboxes", "status", "probe", sql=f"""
WITH {_INPUTS} SELECT * EXCLUDE (last_fetch), epoch_us(last_fetch) AS last_fetch_us FROM inputs""")
def health_inputs(v: Inputs):
    rows = _health_inputs(v)
    return rows.withColumn("last_fetch_us", micros(F.col("last_fetch"))).drop("last_fetch")


_CHECKS = """checks AS (SELECT i.*, epoch_us((SELECT max(ts) FROM events)) - epoch_us(i.last_fetch) AS age FROM inputs i)"""
_ISSUES = """
  CASE WHEN staging_count > 6 THEN staging_count || ' emails stuck in staging! Mail delivery may be failing.' END,
  CASE WHEN failed_count > 0 THEN failed_count || ' emails failed delivery! Manual review required.' END,
  CASE WHEN NOT lmtp_available THEN 'LMTP service unreachable! Email delivery is broken.' END,
  CASE WHEN NOT imap_connected THEN 'Mail fetcher disconnected from upstream! Error: ' || substr(coalesce(last_error, 'Unknown error'), 1, 100)
    WHEN imap_failures >= 3 THEN 'Mail fetcher has ' || imap_failures || ' consecutive failures! Check upstream IMAP connectivity.' END,
  CASE WHEN age > 6 * 3600000000 THEN 'No emails fetched in ' || (age // 3600000000) || ' hours! Mail processor may be stuck.' END"""
_WARNINGS = """
  CASE WHEN staging_count > 3 AND staging_count <= 6 THEN staging_count || ' emails in staging queue' END,
  CASE WHEN age > 3600000000 AND age <= 6 * 3600000000 THEN 'Last email fetch was ' || (age // 60000000) || ' minutes ago' END"""


def _rollup_sql(issues: str, warnings: str) -> str:
    return f"""lists AS (SELECT mailbox, concat_ws('; ', {issues}) AS issues, concat_ws('; ', {warnings}) AS warnings FROM checks)
SELECT mailbox, issues, warnings, concat_ws('; ', nullif(issues, ''), nullif(warnings, '')) AS messages,
  CASE WHEN issues <> '' THEN 'critical' WHEN warnings <> '' THEN 'warning' ELSE 'healthy' END AS status FROM lists"""


def _rollup_columns(rows):
    both = health.all_messages(F.col("issues"), F.col("warnings"))
    return rows.select(
        "mailbox", F.array_join("issues", "; ").alias("issues"),
        F.array_join("warnings", "; ").alias("warnings"),
        F.array_join(both, "; ").alias("messages"), "status",
    )


@query("queue", "mailboxes", "status", "probe", sql=f"""
WITH {_INPUTS}, {_CHECKS}, {_rollup_sql(_ISSUES, _WARNINGS)}""")
def health_rollup(v: Inputs):
    return _rollup_columns(
        health.health_rollup(_health_inputs(v), latest(v.events, "ts"), **LIMITS)
    )


@query("queue", "mailboxes", "status", "probe", "credentials", sql=f"""
WITH {_INPUTS}, errors AS (SELECT user_id AS mailbox, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL),
now AS (SELECT max(ts) AS ts FROM events),
checks AS (SELECT i.*, epoch_us(now.ts) - epoch_us(i.last_fetch) AS age, c.mailbox IS NOT NULL AS has_credentials,
  c.expires_at < now.ts + INTERVAL 2 HOUR AS expiring, e.errors
  FROM inputs i CROSS JOIN now LEFT JOIN credentials c USING (mailbox) LEFT JOIN errors e USING (mailbox)), """ + _rollup_sql(
    _ISSUES + ", CASE WHEN NOT has_credentials THEN 'Credentials missing! AI scanning disabled.' END",
    _WARNINGS + """, CASE WHEN expiring THEN 'Credentials expiring soon - may need refresh' END,
  CASE WHEN errors > 20 THEN errors || ' errors in scanner log - review recommended' END"""))
def health_rollup_ext(v: Inputs):
    errors = records.log_error_counts(records.parse_scan_log(v.scan_log))
    return _rollup_columns(
        health.health_rollup_ext(
            _health_inputs(v), v.credentials, errors, latest(v.events, "ts"), **LIMITS
        )
    )


# --- digests ---------------------------------------------------------------------------


def _digest_mail(v: Inputs):
    """Mail with the columns digests read; the preview replaces the body before any shuffle."""
    mail = keyed_mail(v)
    label = M.folder_label(labelled_path())
    category = digest_category(label, {c: F.col(c) for c in ("from_addr", "subject")})
    return mail.select(
        "mailbox", "received_at", "message_key", "from_addr", "subject",
        M.plain_preview(F.col("body")).alias("body_preview"),
        label.alias("folder_label"), category.alias("category"),
        M.parse_verdict(F.col("reply"))["reason"].alias("reason"),
    )


_DIGEST = f"""recent AS (SELECT * FROM mail WHERE received_at >= (SELECT max(received_at) FROM mail) - INTERVAL 24 HOUR
  QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY received_at DESC, message_id) <= 50),
digests AS (SELECT b.mailbox, count(doc_id) AS items, coalesce(string_agg(
  'FROM: ' || {S.prompt('from_addr', 100)} || chr(10) || 'SUBJECT: ' || {S.prompt('subject', 100)} || chr(10)
  || 'PREVIEW: ' || {S.prompt(S.preview('body'), 200)} || chr(10), chr(10) || '---' || chr(10)
  ORDER BY received_at DESC, message_id) FILTER (doc_id IS NOT NULL), 'No new emails in the last 24 hours.') AS digest
FROM mailboxes b LEFT JOIN recent r USING (mailbox) GROUP BY b.mailbox)"""


@query("mail", "mailboxes", sql=f"WITH {_DIGEST} SELECT * FROM digests")
def mail_digest(v: Inputs):
    mail = _digest_mail(v)
    return digest.mail_digest(mail, v.mailboxes, latest(v.mail, "received_at"))


@query("mail", sql=f"SELECT mailbox, {S.LABEL} AS folder_label, count(*) AS messages FROM mail GROUP BY ALL")
def folder_totals(v: Inputs):
    return digest.folder_totals(_digest_mail(v))


@query("mail", sql=f"""
WITH l AS (SELECT mailbox, {S.LABEL} AS label FROM mail)
SELECT mailbox, count(*) AS total, count(*) FILTER (label = 'INBOX') AS inbox, count(*) FILTER (label = 'SENT') AS sent,
  count(*) FILTER (label = 'QUARANTINE') AS quarantine, count(*) FILTER (label = 'OTHER') AS other FROM l GROUP BY ALL""")
def folder_totals_wide(v: Inputs):
    return digest.folder_totals_wide(_digest_mail(v))


def _newest_list(item: str, group: str, source: str, n: int) -> str:
    return f"""WITH ranked AS (SELECT *, {item} AS item, row_number() OVER (PARTITION BY {group} ORDER BY received_at DESC, message_id) AS rn
  FROM ({source}))
SELECT {group}, count(*) AS messages, string_agg(item, '; ' ORDER BY rn) FILTER (rn <= {n}) AS items FROM ranked GROUP BY {group}"""


@query("mail", sql=_newest_list(
    S.prompt("subject", 100), "mailbox, category, sender_domain",
    f"SELECT *, {S.CATEGORY} AS category, {S.domain('from_addr')} AS sender_domain FROM mail", 3))
def category_rollup(v: Inputs):
    rows = digest.category_rollup(_digest_mail(v), max_items=3)
    return rows.withColumn("items", F.array_join("items", "; "))


@query("mail", sql=_newest_list(
    f"concat_ws(' | ', {S.prompt('subject', 100)}, {S.prompt('from_addr', 100)}, {S.reason_of('reply')})",
    "mailbox", "SELECT * FROM mail WHERE folder = '.Quarantine/cur'", 3))
def quarantine_summary(v: Inputs):
    blocked = _digest_mail(v).where("folder_label = 'QUARANTINE'")
    rows = digest.quarantine_summary(blocked, max_items=3)
    return rows.withColumn("items", F.array_join("items", "; "))


@query("mail", sql=f"""
SELECT mailbox, {S.CATEGORY} AS category, {S.domain('from_addr')} AS sender_domain, epoch_us(received_at) AS received_us,
  message_id AS message_key, {S.prompt('subject', 100)} AS item FROM mail""")
def category_list(v: Inputs):
    rows = digest.category_list(_digest_mail(v))
    return rows.withColumn("received_us", micros(F.col("received_at"))).drop("received_at")


@query("mail", sql=f"""
SELECT mailbox, epoch_us(received_at) AS received_us, message_id AS message_key,
  concat_ws(' | ', {S.prompt("subject", 100)}, {S.prompt("from_addr", 100)}, {S.reason_of("reply")}) AS item
FROM mail WHERE folder = '.Quarantine/cur'""")
def quarantine_list(v: Inputs):
    rows = digest.quarantine_list(_digest_mail(v).where("folder_label = 'QUARANTINE'"))
    return rows.withColumn("received_us", micros(F.col("received_at"))).drop("received_at")


@query("queue", "mailboxes", "status", "probe", "mail", sql=f"""
WITH {_INPUTS}, {_CHECKS}, {_DIGEST}, {_rollup_sql(_ISSUES, _WARNINGS).replace("SELECT mailbox, issues, warnings,", ", rollup AS (SELECT mailbox,", 1)}),
totals AS (SELECT mailbox, count(*) AS total, count(*) FILTER (folder = '.Quarantine/cur') AS quarantined FROM mail
  WHERE received_at >= (SELECT max(received_at) FROM mail) - INTERVAL 24 HOUR GROUP BY ALL)
SELECT d.mailbox, items, digest, coalesce(total, 0) AS total, coalesce(quarantined, 0) AS quarantined, status, messages
FROM digests d LEFT JOIN totals USING (mailbox) LEFT JOIN rollup USING (mailbox)""")
def daily_briefing(v: Inputs):
    """Digest, totals and health of every mailbox in one table."""
    rollup = health.health_rollup(_health_inputs(v), latest(v.events, "ts"), **LIMITS)
    rows = briefing.daily_briefing(
        _digest_mail(v), v.mailboxes, rollup, latest(v.mail, "received_at")
    )
    return rows.withColumn("messages", F.array_join("messages", "; "))
