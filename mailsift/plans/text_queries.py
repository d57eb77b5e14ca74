"""Queries over message text: cleaning, headers, prompts, verdicts, risk rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import functions as M
from mailsift.functions.risk import BRANDS, digest_category, risk_signals, rule_verdict
from mailsift.functions.timing import RECONNECT, SCORING
from mailsift.operators import filters, joins, scoring
from mailsift.plans import sqltext as S
from mailsift.plans.registry import Inputs, query

WHOLE = 1_000_000


def _mail(v: Inputs, *columns: str):
    return v.mail.select("doc_id", *columns)


def labelled_path(folder: str = "folder"):
    return F.concat(F.lit("/var/mail/"), F.col("mailbox").cast("string"), F.lit("/"), F.col(folder))


@query("mail", sql=f"""
SELECT mailbox, CASE {S.verdict_of('reply')} WHEN 'SAFE' THEN 'delivered' ELSE 'quarantine' END AS disposition,
  count(*) AS messages, CAST(sum(length({S.prompt('subject', 200)}) + length({S.prompt('body', WHOLE)})) AS BIGINT) AS clean_chars
FROM mail GROUP BY ALL""")
def triage_counts(v: Inputs):
    """Clean, interpret the reply, route, count per mailbox and disposition."""
    clean = F.length(M.sanitize_prompt(F.col("subject"))) + F.length(
        M.sanitize_prompt(F.col("body"), WHOLE)
    )
    rows = v.mail.select(
        "mailbox", clean.alias("chars"), M.parse_verdict(F.col("reply")).alias("result")
    ).withColumn("verdict", F.col("result.verdict"))
    return filters.split_by_verdict(rows).groupBy("mailbox", "disposition").agg(
        F.count("*").alias("messages"), F.sum("chars").alias("clean_chars")
    )


@query("dirty_text", sql=f"""
SELECT doc_id, {S.prompt('text', 200)} AS clean, md5({S.prompt('text', WHOLE)}) AS whole,
  {S.prompt('text', 200, shell=True)} AS shell FROM dirty_text""")
def sanitize_prompt(v: Inputs):
    text = F.col("text")
    return v.dirty_text.select(
        "doc_id", M.sanitize_prompt(text).alias("clean"),
        F.md5(M.sanitize_prompt(text, WHOLE)).alias("whole"),
        M.sanitize_prompt(text, dialect="shell").alias("shell"),
    )


@query("dirty_text", sql=f"""
SELECT doc_id, {S.log('text', 100)} AS clean, md5({S.log('text', WHOLE)}) AS whole FROM dirty_text""")
def sanitize_log(v: Inputs):
    text = F.col("text")
    return v.dirty_text.select(
        "doc_id", M.sanitize_log(text).alias("clean"),
        F.md5(M.sanitize_log(text, WHOLE)).alias("whole"),
    )


@query("dirty_pages", sql="""
SELECT page_id, length(clean) AS chars, md5(clean) AS clean FROM (SELECT page_id, """ + S.replace_all(
    "html",
    "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>",
    """(?i)on\\w+\\s*=\\s*["''][^"'']*["'']""", "(?i)javascript:",
    "(?is)<iframe[^>]*>.*?</iframe>", "(?is)<object[^>]*>.*?</object>",
    "(?i)<embed[^>]*>", "(?is)<form[^>]*>.*?</form>",
) + " AS clean FROM dirty_pages)")
def sanitize_html(v: Inputs):
    pages = v.dirty_pages.withColumn("clean", M.sanitize_html(F.col("html")))
    return pages.select(
        "page_id", F.length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("clean")
    )


@query("dirty_pages", sql="""
SELECT page_id, length(clean) AS chars, md5(clean) AS clean FROM (SELECT page_id, """ + S.replace_all(
    "html",
    "(?is)<script[^>]*>.*?</script>", "(?i)<script[^>]*>", "(?i)</script>",
    """(?i)on[a-z]+\\s*=\\s*"[^"]*\"""", "(?i)on[a-z]+\\s*=\\s*''[^'']*''",
    """(?i)javascript:[^"'']*""", """(?i)data:[^"'']*""",
    "(?is)<iframe[^>]*>.*?</iframe>", "(?i)<iframe[^>]*>", "(?is)<object[^>]*>.*?</object>",
    "(?i)<embed[^>]*>", "(?is)<form[^>]*>.*?</form>", "(?i)<input[^>]*>",
    "(?is)<button[^>]*>.*?</button>",
) + " AS clean FROM dirty_pages)")
def sanitize_html_strict(v: Inputs):
    pages = v.dirty_pages.withColumn("clean", M.sanitize_html_strict(F.col("html")))
    return pages.select(
        "page_id", F.length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("clean")
    )


@query("mail", sql="""
SELECT doc_id, from_addr, to_addr, reply_to, ltrim(subject, ' ' || chr(9)) AS subject, message_id,
  CAST(NULL AS VARCHAR) AS date FROM mail""")
def extract_headers(v: Inputs):
    """Headers out of raw messages; the check takes them from the fields they were made of."""
    rows = v.mail_raw.select("doc_id", M.extract_headers(F.col("raw")).alias("h"))
    return rows.select(
        "doc_id", F.col("h.from").alias("from_addr"), F.col("h.to").alias("to_addr"),
        "h.reply_to", "h.subject", "h.message_id", "h.date",
    )


@query("mail", sql="SELECT doc_id, subject AS decoded, body AS decoded_body FROM mail")
def decode_encoded_words(v: Inputs):
    """Subjects and whole bodies as encoded words, except where they stay plain."""
    def encoded(text):
        plain = F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")
        word = F.concat(F.lit("=?utf-8?B?"), plain, F.lit("?="))
        return F.when((F.col("event_type") == "view") | (text == ""), text).otherwise(word)

    return _mail(v, "event_type", "subject", "body").select(
        "doc_id", scoring.decode_encoded_words(encoded(F.col("subject"))).alias("decoded"),
        scoring.decode_encoded_words(encoded(F.col("body"))).alias("decoded_body"),
    )


@query("mail", sql=f"""
SELECT doc_id, {S.preview('body')} AS preview, {S.preview('body', 300)} AS digest_preview FROM mail""")
def body_preview(v: Inputs):
    body = M.message_body(F.col("raw"))
    single = v.mail_raw.where("event_type <> 'purchase'").select("doc_id", body.alias("body"))
    parts = v.mail_raw.where("event_type = 'purchase'").select(
        "doc_id", F.col("body")
    )
    return single.unionByName(parts).select(
        "doc_id", M.plain_preview(F.col("body")).alias("preview"),
        M.plain_preview(F.col("body"), 300).alias("digest_preview"),
    )


@query("mail_raw", sql="""
WITH l AS (SELECT doc_id, raw, string_split(raw, chr(10)) AS lines FROM mail_raw),
n AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, len(lines) AS total FROM l),
-- A stretch is open from a blank line up to and including the next line that starts with two dashes.
marks AS (SELECT *, max(CASE WHEN line = '' THEN i END) OVER w AS blank, max(CASE WHEN line LIKE '--%' THEN i END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dash,
  min(CASE WHEN line = '' THEN i END) OVER (PARTITION BY doc_id) AS first_blank
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
text AS (SELECT doc_id,
  string_agg(line || CASE WHEN i < total THEN chr(10) ELSE '' END, '' ORDER BY i)
    FILTER (blank > coalesce(dash, 0)) AS scan,
  string_agg(line || CASE WHEN i < total THEN chr(10) ELSE '' END, '' ORDER BY i)
    FILTER (i >= first_blank AND line NOT LIKE '--%') AS digest FROM marks GROUP BY doc_id)
SELECT doc_id, replace(substr(scan, 1, 800), chr(10), ' ') AS scan, md5(replace(scan, chr(10), ' ')) AS whole_scan,
  replace(substr(digest, 1, 300), chr(10), ' ') AS digest, md5(replace(digest, chr(10), ' ')) AS whole_digest FROM text""")
def shell_previews(v: Inputs):
    """The two preview forms that work on the lines of the raw message."""
    raw = F.col("raw")
    return v.mail_raw.select(
        "doc_id", M.scan_preview(raw).alias("scan"),
        F.md5(M.scan_preview(raw, WHOLE)).alias("whole_scan"),
        M.digest_preview(raw).alias("digest"),
        F.md5(M.digest_preview(raw, WHOLE)).alias("whole_digest"),
    )


def _as_question_marks(text: str) -> str:
    """SQL: non-ASCII bytes of a header become one replacement character each."""
    mark = "chr(65533)"
    for chars, size in (("[\\x{800}-\\x{ffff}]", 3), ("[\\x{80}-\\x{7ff}]", 2), ("[\\x{10000}-\\x{10ffff}]", 4)):
        text = f"regexp_replace({text}, '{chars}', repeat({mark}, {size}), 'g')"
    return text


@query("mail", sql=f"""
SELECT doc_id, message_id, from_addr, to_addr, reply_to,
  {_as_question_marks("ltrim(subject, ' ' || chr(9))")} AS subject,
  {S.preview('body')} AS body_preview, CAST(NULL AS VARCHAR) AS error FROM mail""")
def parse_messages(v: Inputs):
    """Whole raw messages through the native parser or, where needed, the MIME job."""
    raw = v.mail_raw.select("doc_id", F.encode("raw", "UTF-8").alias("content"))
    return scoring.parse_messages(raw)


@query("mail", sql=f"""
SELECT doc_id, {S.address('to_addr')} AS recipient,
  CASE WHEN to_addr LIKE 'svc-%' THEN lower(split_part(substr(to_addr, 5), '@', 1)) ELSE 'INBOX' END AS folder,
  'INBOX' AS folder_without_prefix FROM mail""")
def recipient_route(v: Inputs):
    rows = _mail(v, "to_addr").withColumn("recipient", M.recipient_address(F.col("to_addr")))
    return rows.select(
        "doc_id", "recipient", M.route_folder(F.col("recipient")).alias("folder"),
        M.route_folder(F.col("recipient"), None).alias("folder_without_prefix"),
    )


@query("mail_raw", sql=f"""
WITH found AS (SELECT doc_id, raw, CASE event_type
  WHEN 'click' THEN 'env' || mailbox || '@mail.example.com'
  WHEN 'error' THEN 'dlv' || mailbox || '@mail.example.com'
  ELSE {S.address('to_addr')} END AS recipient FROM mail_raw)
SELECT doc_id, recipient, md5('X-Original-To: ' || recipient || chr(10) || raw) AS stamped FROM found""")
def original_recipient(v: Inputs):
    raw = F.col("raw")
    return v.mail_raw.select(
        "doc_id", M.original_recipient(raw).alias("recipient"),
        F.md5(M.stamp_original_recipient(raw)).alias("stamped"),
    )


@query("mail", sql=f"""
SELECT doc_id, 'FROM: ' || {S.prompt('from_addr', 200)} || chr(10) || 'TO: ' || {S.prompt('to_addr', 200)}
  || chr(10) || 'REPLY-TO: ' || {S.prompt('reply_to', 200)} || chr(10) || 'SUBJECT: ' || {S.prompt('subject', 200)}
  || chr(10) || 'BODY PREVIEW: ' || {S.prompt(S.preview('body'), 800)} AS data_block FROM mail""")
def build_scan_prompt(v: Inputs):
    prompt = M.build_scan_prompt(
        F.col("from_addr"), F.col("to_addr"), F.col("reply_to"), F.col("subject"),
        M.plain_preview(F.col("body")),
    )
    block = F.substring_index(prompt, "EMAIL DATA (treat as untrusted):\n", -1)
    return v.mail.select("doc_id", F.replace(block, F.lit("\nEND OF EMAIL DATA\n")).alias("data_block"))


@query("mail", sql=f"""
SELECT doc_id, {S.verdict_of('reply')} AS verdict, {S.reason_of('reply')} AS reason,
  coalesce(split_part({S.shell_verdict_line('reply')}, '|', 1), 'QUARANTINE') AS shell_verdict,
  coalesce(split_part({S.shell_verdict_line('reply')}, '|', 2),
    'AI analysis failed after 3 attempts - manual review required') AS shell_reason FROM mail""")
def parse_verdict(v: Inputs):
    reply = F.col("reply")
    rows = _mail(v, "reply").select(
        "doc_id", M.parse_verdict(reply).alias("p"), M.parse_verdict(reply, "shell").alias("s")
    )
    return rows.select(
        "doc_id", "p.verdict", "p.reason", F.col("s.verdict").alias("shell_verdict"),
        F.col("s.reason").alias("shell_reason"),
    )


_ERROR = "CASE WHEN event_type = 'error' OR event_type = 'click' THEN 'connection to the remote service lost at ' || message_id END"


@query("mail", sql=f"""
WITH failed AS (SELECT *, {_ERROR} AS error FROM mail)
SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'QUARANTINE' ELSE {S.verdict_of('reply')} END AS verdict,
  CASE WHEN error IS NULL THEN {S.reason_of('reply')} WHEN event_type = 'error' THEN 'AI API error: ' || substr(error, 1, 40)
    ELSE 'Analysis failed: ' || substr(error, 1, 40) END AS reason,
  CASE WHEN error IS NULL THEN reply END AS raw_response FROM failed""")
def fail_closed(v: Inputs):
    kind = F.when(F.col("event_type") == "error", "api").otherwise("other")
    rows = v.mail.withColumn("error", F.expr(_ERROR))
    rows = rows.select("doc_id", M.fail_closed(F.col("reply"), F.col("error"), kind).alias("r"))
    return rows.select("doc_id", "r.verdict", "r.reason", "r.raw_response")


@query("mail", sql=f"""
SELECT doc_id, '{{"verdict":"' || {S.verdict_of('reply')} || '","reason":"' || {S.reason_of('reply')}
  || '","confidence":null}}' AS result FROM mail""")
def verdict_json(v: Inputs):
    rows = _mail(v, "reply").select("doc_id", M.parse_verdict(F.col("reply")).alias("r"))
    return rows.select(
        "doc_id",
        M.verdict_json(F.col("r.verdict"), F.col("r.reason"), F.col("r.confidence")).alias("result"),
    )


@query("mail", sql=f"SELECT doc_id, {S.LABEL} AS label FROM mail")
def folder_label(v: Inputs):
    return v.mail.select("doc_id", M.folder_label(labelled_path()).alias("label"))


@query("mail", sql="""
SELECT doc_id, sha256(CAST(mailbox AS VARCHAR) || chr(31) || message_id || chr(31) || body) AS message_key FROM mail""")
def message_key(v: Inputs):
    key = M.message_key(F.col("mailbox"), F.col("message_id"), F.encode("body", "UTF-8"))
    return v.mail.select("doc_id", key.alias("message_key"))


@query("mail", sql=f"""
SELECT doc_id, 'FROM: ' || {S.prompt('from_addr', 100)} || chr(10) || 'SUBJECT: ' || {S.prompt('subject', 100)}
  || chr(10) || 'PREVIEW: ' || {S.prompt(S.preview('body'), 200)} || chr(10) AS entry,
  chr(10) || 'EMAIL ' || doc_id || ':' || chr(10) || 'FOLDER: ' || {S.LABEL} || chr(10) || 'FROM: ' || {S.prompt('from_addr', 150, True)}
  || chr(10) || 'SUBJECT: ' || {S.prompt('subject', 150, True)} || chr(10) || 'DATE: ' || CAST(CAST(received_at AS DATE) AS VARCHAR)
  || chr(10) || 'PREVIEW: ' || {S.prompt(S.preview('body'), 300, True)} || chr(10) AS long_entry FROM mail""")
def digest_entry(v: Inputs):
    preview = M.plain_preview(F.col("body"))
    return v.mail.select(
        "doc_id", M.digest_entry(F.col("from_addr"), F.col("subject"), preview).alias("entry"),
        M.digest_entry_long(
            F.col("doc_id"), M.folder_label(labelled_path()), F.col("from_addr"),
            F.col("subject"), F.col("received_at").cast("date").cast("string"), preview,
        ).alias("long_entry"),
    )


@query(sql="""
SELECT event_id, least(5.0 * power(2.0, floor(value) % 12), 300.0)::DOUBLE AS reconnect,
  least(2.0 * power(2.0, floor(value) % 12), 8.0)::DOUBLE AS scoring FROM events""")
def retry_delay(v: Inputs):
    attempt = F.floor("value") % 12 + 1
    return v.events.select(
        "event_id", M.retry_delay(attempt, *RECONNECT).alias("reconnect"),
        M.retry_delay(attempt, *SCORING).alias("scoring"),
    )


_FLAGS = S.risk_flags("from_addr", "reply_to", "subject", "body")
_SIGNALS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _FLAGS.items()
) + ")"


@query("mail", sql=f"SELECT doc_id, {_SIGNALS} AS signals, {S.rule_reply(_FLAGS)} AS reply FROM mail")
def rule_verdicts(v: Inputs):
    """Signals over whole bodies and the verdict they lead to."""
    fields = ("from_addr", "reply_to", "subject", "body")
    rows = v.mail.select("doc_id", risk_signals(*[F.col(c) for c in fields]).alias("signals"))
    return rows.select(
        "doc_id", F.array_join("signals", ",").alias("signals"),
        rule_verdict(F.col("signals")).alias("reply"),
    )


@query("mail", sql=f"SELECT doc_id, {S.CATEGORY} AS category FROM mail")
def categories(v: Inputs):
    fields = {c: F.col(c) for c in ("from_addr", "subject")}
    category = digest_category(M.folder_label(labelled_path()), fields)
    return v.mail.select("doc_id", category.alias("category"))


@query("mail", sql=f"""
WITH d AS (SELECT DISTINCT {S.domain('from_addr')} AS domain FROM mail),
l AS (SELECT domain, unnest(regexp_split_to_array(domain, '[.-]')) AS label FROM d),
b AS (SELECT unnest(['amazon', 'google', 'microsoft', 'paypal']) AS brand)
SELECT DISTINCT domain, label, brand,
  levenshtein(translate(label, '01357$@', 'olestsa'), brand) AS distance
FROM l JOIN b ON {S.near_brand('label', 'brand')}""")
def lookalike_domains(v: Inputs):
    domains = v.mail.select(M.domain_of(F.col("from_addr")).alias("domain"))
    brands = v.spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    pairs = joins.lookalike_domains(domains, brands)
    return pairs.withColumn("distance", F.col("distance").cast("bigint"))


_FIRST_WORDS = "^([a-z]+) ([a-z]+) "


@query(sql=f"""
WITH w AS (SELECT regexp_extract(lower(text), '{_FIRST_WORDS}', 1) AS a, regexp_extract(lower(text), '{_FIRST_WORDS}', 2) AS b
  FROM documents WHERE regexp_matches(lower(text), '{_FIRST_WORDS}')),
d AS (SELECT DISTINCT a || '-shop.example.com' AS domain FROM w),
l AS (SELECT domain, unnest(regexp_split_to_array(domain, '[.-]')) AS label FROM d),
b AS (SELECT DISTINCT b AS brand FROM w)
SELECT DISTINCT domain, label, brand, levenshtein(label, brand) AS distance
FROM l JOIN b ON label <> brand AND levenshtein(label, brand) <= 2""")
def lookalike_of_a_brand_table(v: Inputs):
    """Domains and brands out of the documents' first two words, up to two edits apart."""
    words = v.documents.select(F.lower("text").alias("text")).where(F.col("text").rlike(_FIRST_WORDS))
    domains = words.select(F.concat(F.regexp_extract("text", _FIRST_WORDS, 1), F.lit("-shop.example.com")).alias("domain"))
    brands = words.select(F.regexp_extract("text", _FIRST_WORDS, 2).alias("brand"))
    pairs = joins.lookalike_domains(domains, brands, max_distance=2)
    return pairs.withColumn("distance", F.col("distance").cast("bigint"))


@query("mail", sql=f"""
SELECT doc_id, CASE WHEN from_addr LIKE '%micros0ft%' OR from_addr LIKE '%amaz0n%' THEN 'QUARANTINE' ELSE 'SAFE' END AS verdict,
  CASE WHEN from_addr LIKE '%micros0ft%' THEN 'Typosquatting domain micros0ft'
    WHEN from_addr LIKE '%amaz0n%' THEN 'Typosquatting domain amaz0n' ELSE 'No known look-alike' END AS reason FROM mail""")
def score_messages(v: Inputs):
    """Prompt, external scorer (the deterministic stub), reply grammar."""
    prompt = M.build_scan_prompt(
        F.col("from_addr"), F.col("to_addr"), F.col("reply_to"), F.col("subject"),
        M.plain_preview(F.col("body")),
    )
    scored = scoring.score_messages(
        v.mail.select("doc_id", prompt.alias("prompt")), scoring.rule_scorer
    )
    return scored.select("doc_id", "result.verdict", "result.reason")
