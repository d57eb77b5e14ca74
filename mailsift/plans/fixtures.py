"""Views that give every operator an input derived from the given tables.

Each view is one SQL text that Spark and the SQL check both run, so both sides start from the
same rows. Braces name the tables a view reads. Views of one table cover all its rows; ``mail`` has a
message for every document, and so the events of the same numbers, and other joins pair what matches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# One message per document, received when the event of the same number happened.
MAIL = """
SELECT d.doc_id, e.user_id AS mailbox, e.ts AS received_at, e.event_type,
  CONCAT('<', CAST(d.doc_id AS STRING), '@', d.source, '.example.com>') AS message_id,
  CASE d.doc_id % 5
    WHEN 0 THEN CONCAT('Sender ', CAST(d.doc_id AS STRING), ' <billing@micros0ft.example>')
    WHEN 1 THEN CONCAT('news@', d.source, '.example.com')
    WHEN 2 THEN 'alerts@amaz0n-support.com'
    ELSE CONCAT('user', CAST(d.doc_id % 50 AS STRING), '@', d.source, '.example.com')
  END AS from_addr,
  CASE d.doc_id % 4
    WHEN 0 THEN CONCAT('svc-', UPPER(d.lang), '@mail.example.com')
    WHEN 1 THEN CONCAT('Box ', CAST(e.user_id AS STRING), ' <box', CAST(e.user_id AS STRING), '@mail.example.com>')
    WHEN 2 THEN CONCAT('<box', CAST(e.user_id AS STRING), '@mail.example.com>')
    ELSE CONCAT('box', CAST(e.user_id AS STRING), '@mail.example.com', CASE WHEN d.doc_id % 8 = 3 THEN ' (Box)' ELSE '' END)
  END AS to_addr,
  CASE e.event_type WHEN 'signup' THEN 'collect@other.example' END AS reply_to,
  CASE d.doc_id % 7
    WHEN 0 THEN CONCAT('URGENT: Verify your account --- ', SPLIT_PART(d.text, CHR(10), 1))
    WHEN 1 THEN CONCAT('Invoice 8f3k29dm41xq ', SPLIT_PART(d.text, CHR(10), 1))
    ELSE CONCAT('Re: ', SPLIT_PART(d.text, CHR(10), 1))
  END AS subject,
  d.text AS body,
  CASE e.event_type WHEN 'error' THEN '.Quarantine/cur' WHEN 'signup' THEN '.Sent/cur'
    WHEN 'view' THEN 'cur' ELSE 'new' END AS folder,
  CASE d.doc_id % 8
    WHEN 0 THEN 'SAFE|Newsletter from known sender'
    WHEN 1 THEN '  QUARANTINE|Typosquatting domain micros0ft  '
    WHEN 2 THEN CONCAT('Let me think', CHR(10), CHR(10), 'SAFE|Bank statement (verified), ok!')
    WHEN 3 THEN 'safe|lower case'
    WHEN 4 THEN ''
    WHEN 6 THEN CONCAT('SAFE|', CHR(252), 'nicode reason')
    WHEN 7 THEN CONCAT('QUARANTINE|first', CHR(10), 'SAFE|second')
  END AS reply
FROM {documents} d JOIN {events} e ON d.doc_id = e.event_id
"""

# Raw messages: header order and case vary, some have more recipients, some two parts.
MAIL_RAW = """
SELECT doc_id, mailbox, received_at, folder, event_type, message_id, from_addr, to_addr,
  reply_to, subject, body,
  CONCAT(
    CASE event_type
      WHEN 'click' THEN CONCAT('X-Envelope-To: <env', CAST(mailbox AS STRING), '@mail.example.com>', CHR(10))
      WHEN 'error' THEN CONCAT('Delivered-To: dlv', CAST(mailbox AS STRING), '@mail.example.com', CHR(10))
      ELSE '' END,
    CASE WHEN reply_to IS NOT NULL THEN CONCAT('reply-to: ', reply_to, CHR(10)) ELSE '' END,
    CASE event_type
      WHEN 'view' THEN CONCAT('SUBJECT: ', subject, CHR(10), 'From: ', from_addr, CHR(10))
      ELSE CONCAT('From: ', from_addr, CHR(10), 'Subject:', subject, CHR(10)) END,
    'To: ', to_addr, CHR(10), 'Message-ID: ', message_id, CHR(10),
    CASE event_type
      WHEN 'purchase' THEN CONCAT(
        'MIME-Version: 1.0', CHR(10), 'Content-Type: multipart/alternative; boundary=cut0', CHR(10),
        CHR(10), '--cut0', CHR(10), 'Content-Type: text/html', CHR(10), CHR(10), '<p>other</p>', CHR(10),
        '--cut0', CHR(10), 'Content-Type: text/plain; charset=utf-8', CHR(10), CHR(10), body, CHR(10),
        '--cut0--', CHR(10))
      ELSE CONCAT(CHR(10), body) END
  ) AS raw
FROM {mail}
"""

DIRTY_TEXT = """
SELECT doc_id, CASE lang
  WHEN 'en' THEN CONCAT(CHR(27), '[31m', REPLACE(text, ', ', CONCAT(' --- ', CHR(27), '[0;1m')), CHR(27), '[0m ')
  WHEN 'fr' THEN CONCAT('  ', REPLACE(text, ' la ', CONCAT(CHR(9), '===', CHR(127), '```')))
  ELSE CONCAT(CHR(7), '-----', REPLACE(text, '. ', CONCAT('.', CHR(13), CHR(10), '====')))
  END AS text
FROM {documents}
"""

DIRTY_PAGES = """
SELECT page_id, CONCAT(
  html, '<iframe src="x">', CHR(10), 'in</iframe><form action="y">', CHR(10), '<input name="q"></form>',
  '<a href="JavaScript:go(1)" onclick="go()" onMouseOver = ', CHR(39), 'x', CHR(39), '>', url, '</a>',
  '<object data="z">a</object><EMBED src="e"><button class="b">ok</button>',
  '<img src="data:image/png;base64,AAAA"><script>unclosed') AS html
FROM {pages}
"""

# Documents with a label were processed before.
LEDGER = """
SELECT m.message_id AS message_key,
  CASE WHEN l.toxic = 1 THEN 'QUARANTINE' ELSE 'SAFE' END AS verdict,
  CASE WHEN l.quality = 1 THEN 'Good text' ELSE 'Other text' END AS reason,
  m.received_at AS scanned_at
FROM {mail} m JOIN {labels} l ON m.doc_id = l.doc_id
"""

# What arrived: sign-ups are missing, errors are one character short, labels are unknown.
LANDED = """
SELECT message_id AS message_key,
  CAST(LENGTH(body) - CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS BIGINT) AS size
FROM {mail} WHERE event_type <> 'signup'
UNION ALL
SELECT CONCAT('unknown-', CAST(doc_id AS STRING)), CAST(quality AS BIGINT) FROM {labels}
"""

ATTEMPTS = """
SELECT user_id AS message_key, event_id AS id, ts,
  CASE event_type WHEN 'purchase' THEN 250 WHEN 'signup' THEN 251 WHEN 'view' THEN 421
    WHEN 'click' THEN 451 ELSE 550 END AS code,
  event_type IN ('purchase', 'signup') AS ok
FROM {events}
"""

FETCH_LOG = """
SELECT user_id AS mailbox, event_id AS id, ts, event_type <> 'error' AS ok,
  CASE event_type WHEN 'error' THEN CONCAT('timeout ', CAST(event_id AS STRING)) END AS error
FROM {events}
"""

STATUS = """
SELECT user_id AS mailbox, event_id AS id, ts, event_type,
  CASE WHEN event_type = 'click' THEN CONCAT('not json ', CHR(123)) ELSE CONCAT(
    CHR(123), '"last_successful_fetch": ',
    CASE event_type WHEN 'signup' THEN 'null' WHEN 'purchase' THEN '"never"'
      ELSE CONCAT('"', REPLACE(CAST(ts AS STRING), ' ', 'T'), '"') END,
    ', "consecutive_failures": ', CAST(user_id % 5 AS STRING),
    ', "last_error": ', CASE event_type WHEN 'error' THEN CONCAT('"timeout ', CAST(event_id AS STRING), '"') ELSE 'null' END,
    ', "is_connected": ', CASE event_type WHEN 'error' THEN 'false' ELSE 'true' END,
    ', "updated_at": "', REPLACE(CAST(ts AS STRING), ' ', 'T'), '"', CHR(125)) END AS status
FROM {events}
"""

# Every ninth line has no time stamp.
SCAN_LOG = """
SELECT user_id AS mailbox, event_id AS id, CONCAT(
  CASE WHEN event_id % 9 = 0 THEN '' ELSE CONCAT('[', CAST(DATE_TRUNC('second', ts) AS STRING), '] ') END,
  CASE event_type WHEN 'view' THEN CONCAT('SCAN: Subject ', CAST(event_id AS STRING))
    WHEN 'click' THEN CONCAT('  -> SAFE | Newsletter ', CAST(event_id AS STRING))
    WHEN 'purchase' THEN '  -> QUARANTINE | Look-alike domain'
    WHEN 'signup' THEN 'RATE LIMITED: Too many scans, queuing for later'
    ELSE '  LMTP ERROR: 451 try again' END) AS value
FROM {events}
"""

QUEUE = """
SELECT mailbox, CONCAT(CAST(doc_id AS STRING),
  CASE event_type WHEN 'view' THEN '.processing' ELSE '.mail' END) AS name,
  CASE event_type WHEN 'purchase' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'pending' END AS state
FROM {mail}
"""

MAILBOXES = "SELECT DISTINCT user_id AS mailbox FROM {events}"

PROBE = """
SELECT b.mailbox, c.c_acctbal >= 0 AS lmtp_available
FROM {mailboxes} b JOIN {customer} c ON b.mailbox = c.c_custkey
"""

CREDENTIALS = """
SELECT e.user_id AS mailbox, MAX(e.ts) + INTERVAL '24' HOUR AS expires_at
FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey
WHERE e.event_type = 'purchase' AND c.c_mktsegment <> 'BUILDING'
GROUP BY e.user_id
"""

# Known recipients: customers in credit; every third box is also archived.
USERS = """
SELECT CONCAT('box', CAST(b.mailbox AS STRING), '@mail.example.com') AS recipient,
  CONCAT('user', CAST(b.mailbox AS STRING)) AS mailbox
FROM {mailboxes} b JOIN {customer} c ON b.mailbox = c.c_custkey WHERE c.c_acctbal >= 0
UNION ALL
SELECT CONCAT('box', CAST(mailbox AS STRING), '@mail.example.com'), 'archive' FROM {mailboxes} WHERE mailbox % 3 = 0
"""

VIEWS = {
    "mail": MAIL, "mail_raw": MAIL_RAW, "dirty_text": DIRTY_TEXT, "dirty_pages": DIRTY_PAGES,
    "ledger": LEDGER, "landed": LANDED, "attempts": ATTEMPTS, "fetch_log": FETCH_LOG,
    "status": STATUS, "scan_log": SCAN_LOG, "queue": QUEUE, "mailboxes": MAILBOXES,
    "probe": PROBE, "credentials": CREDENTIALS, "users": USERS,
}


def needed(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view, or a given table, as a DataFrame; ``given`` replaces inputs by name."""
    if name in given:
        return given[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: view(spark, sf_dir, n, **given) for n in needed(VIEWS[name])}
    return spark.sql(VIEWS[name], **inputs)


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views, and those they read, in front as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for inner in needed(VIEWS[name]):
                add(inner)
            order.append(name)

    for name in names:
        add(name)
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    word = "WITH RECURSIVE" if "WITH RECURSIVE" in sql else "WITH"
    rest = sql.replace("WITH RECURSIVE", "", 1).strip()
    if ctes and rest.upper().startswith("WITH "):
        rest = rest[5:]
        return f"{word} {', '.join(ctes)}, {rest}"
    if word == "WITH RECURSIVE":
        return f"{word} {', '.join([*ctes, rest])}"
    return f"WITH {', '.join(ctes)} {rest}" if ctes else rest
