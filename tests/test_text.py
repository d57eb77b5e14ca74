import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from mailsift import functions as M
from mailsift.functions.clean import HTML_RULES, STRICT_HTML_RULES

FEW = settings(
    max_examples=6, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
PIECES = st.sampled_from([
    "\x1b[31m", "\x1b[0;1m", "\x1b", "[2m", "\x00", "\x07", "\x7f", "\n", "\r", "\t", "-", "--",
    "---", "===", "``", "```", " ", " ", "　", "é", "\U0001f600", "a", "Z9", "{}",
])
TEXTS = st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=30, max_size=60)


def clean_for_prompt(text, n):
    for pattern in (r"\x1b\[[0-9;]*m", r"[\x00-\x1f\x7f]"):
        text = re.sub(pattern, "", text)
    for mark in ("---", "===", "```"):
        text = text.replace(mark, "")
    return text[:n].strip()


def clean_for_log(text, n):
    for pattern in (r"[\x00-\x1f\x7f]", r"\x1b\[[0-9;]*m"):
        text = re.sub(pattern, "", text)
    return text[:n]


@FEW
@given(texts=TEXTS, n=st.integers(1, 40))
def test_prompt_cleaning_matches_the_rules(apply, texts, n):
    assert apply(lambda c: M.sanitize_prompt(c, n), texts) == [clean_for_prompt(t, n) for t in texts]


@FEW
@given(texts=TEXTS, n=st.integers(1, 40))
def test_log_cleaning_matches_the_rules(apply, texts, n):
    assert apply(lambda c: M.sanitize_log(c, n), texts) == [clean_for_log(t, n) for t in texts]


def test_prompt_cleaning_literals(apply):
    given_, want = zip(
        ("hello\x00world", "helloworld"), ("test\x1b[31mred", "testred"),
        ("test---injection", "testinjection"), ("test===break", "testbreak"),
        ("test```code", "testcode"), (None, ""), ("", ""), ("a" * 500, "a" * 200),
    )
    assert apply(M.sanitize_prompt, given_) == list(want)
    assert len(apply(lambda c: M.sanitize_prompt(c, 100), ["a" * 500])[0]) == 100


def test_log_cleaning_literals(apply):
    assert apply(M.sanitize_log, ["hello\x00world", "test\x1b[31mred", None]) == [
        "helloworld", "test[31mred", "",
    ]
    assert len(apply(lambda c: M.sanitize_log(c, 50), ["x" * 200])[0]) == 50


def test_shell_prompt_cleaning_keeps_ansi_tails_and_spaces(apply):
    assert apply(lambda c: M.sanitize_prompt(c, 20, "shell"), ["  a\x1b[1mb --- "]) == ["  a[1mb  "]


HTML = st.sampled_from([
    "<script>", "<SCRIPT src='a'>", "</script>", "<style>", "</style>", "<iframe x>", "</iframe>",
    "<object>", "</object>", "<embed a>", "<form>", "</form>", "<input>", "<button>", "</button>",
    " onclick=\"x\"", " onLoad = 'y'", " onét='z'", "javascript:", "data:", "\n", "'", '"', "text", ">",
])


@FEW
@given(pages=st.lists(st.lists(HTML, max_size=25).map("".join), min_size=30, max_size=60))
def test_html_cleaning_matches_the_rules(apply, pages):
    def with_rules(rules):
        def one(page):
            for rule in rules:
                page = re.sub(rule.replace("(?iU)", "(?i)").replace("(?iu)", "(?i)").replace("(?isu)", "(?is)"), "", page)
            return page
        return [one(p) for p in pages]

    assert apply(M.sanitize_html, pages) == with_rules(HTML_RULES)
    assert apply(M.sanitize_html_strict, pages) == with_rules(STRICT_HTML_RULES)


REPLY_LINE = re.compile(r"""(SAFE|QUARANTINE)\|([a-zA-Z0-9 ,.\-'"&/():;!?]{1,100})""")


def read_reply(text):
    for line in (text or "").split("\n"):
        found = REPLY_LINE.fullmatch(line.strip())
        if found:
            return found.groups()
    return "QUARANTINE", "Invalid AI response format"


@FEW
@given(replies=st.lists(st.lists(st.sampled_from([
    "SAFE|", "QUARANTINE|", "safe|", "ok, fine", "x" * 99, "(a)!", "ü", "\n", "\r", " ", " ", "|", "\t",
]), max_size=8).map("".join), min_size=30, max_size=60))
def test_replies_are_read_line_by_line(apply, replies):
    got = apply(M.parse_verdict, replies)
    assert [(r["verdict"], r["reason"]) for r in got] == [read_reply(t) for t in replies]
    assert [r["raw_response"] for r in got] == replies


def test_reply_literals(apply):
    cases = {
        "SAFE|Legitimate newsletter from known sender": ("SAFE", "Legitimate newsletter from known sender"),
        "QUARANTINE|Typosquatting domain micros0ft.com": ("QUARANTINE", "Typosquatting domain micros0ft.com"),
        "Let me see...\n\nSAFE|Normal business correspondence\n\nFine.": ("SAFE", "Normal business correspondence"),
        "This is not a valid verdict format": ("QUARANTINE", "Invalid AI response format"),
        "": ("QUARANTINE", "Invalid AI response format"),
        "SAFE|" + "x" * 101: ("QUARANTINE", "Invalid AI response format"),
    }
    got = apply(M.parse_verdict, list(cases))
    assert [(r["verdict"], r["reason"]) for r in got] == list(cases.values())
    shell = apply(lambda c: M.parse_verdict(c, "shell"), [" SAFE|x", "SAFE|(x)", "no\nSAFE|x"])
    assert [r["verdict"] for r in shell] == ["QUARANTINE", "QUARANTINE", "SAFE"]


def test_errors_fail_closed(spark):
    rows = [("SAFE|ok", None, None), (None, "e" * 60, "api"), ("SAFE|ok", "boom", "other"), (None, None, None)]
    df = spark.createDataFrame(rows, "reply string, error string, kind string")
    got = df.select(M.fail_closed(F.col("reply"), F.col("error"), F.col("kind")).alias("r")).collect()
    assert [(r.r.verdict, r.r.reason) for r in got] == [
        ("SAFE", "ok"), ("QUARANTINE", "AI API error: " + "e" * 40),
        ("QUARANTINE", "Analysis failed: boom"), ("QUARANTINE", "Invalid AI response format"),
    ]


def test_result_json_keeps_null_confidence(spark):
    df = spark.createDataFrame([("SAFE", "ok", None), ("SAFE", "ok", 0.5)], "v string, r string, c double")
    got = [r[0] for r in df.select(M.verdict_json(F.col("v"), F.col("r"), F.col("c"))).collect()]
    assert got == [
        '{"verdict":"SAFE","reason":"ok","confidence":null}',
        '{"verdict":"SAFE","reason":"ok","confidence":0.5}',
    ]


def test_delivery_codes(apply):
    codes = [250, 251, 299, 354, 421, 451, 550, 599, 600, 100, None]
    assert apply(M.delivery_outcome, codes, "int") == [
        "ok", "ok", "ok", "error", "retry", "retry", "permanent", "permanent", "error", "error", "error",
    ]


def test_backoff(apply):
    assert apply(M.retry_delay, [1, 2, 3, 6, 7, 2000], "int") == [5, 10, 20, 160, 300, 300]
    assert apply(lambda c: M.retry_delay(c, 2, 8), [1, 2, 3, 4], "int") == [2, 4, 8, 8]


def test_recipient_address(apply):
    cases = {
        "Name <email@domain.com>": "email@domain.com", "<email@domain.com>": "email@domain.com",
        "email@domain.com": "email@domain.com", '"Doe, Jane" <j@d.org>': "j@d.org",
        '"Doe \\"JD\\" Jane" <j@d.org>': "j@d.org", " spaced@d.org ": "spaced@d.org",
        "a@b.org, c@d.org": "a@b.org, c@d.org", "undisclosed": "undisclosed", "": "",
    }
    assert apply(M.recipient_address, list(cases)) == list(cases.values())


def test_routing(apply):
    rcpt = ["svc-GitHub@x.org", "SVC-aws@x.org", "box@x.org", "svc-@x.org", "svc-a-b@x.org", "xsvc-a@x.org"]
    assert apply(M.route_folder, rcpt) == ["github", "aws", "INBOX", "INBOX", "a-b", "INBOX"]
    assert apply(lambda c: M.route_folder(c, "a.b+"), ["a.b+X@y", "aXb+X@y"]) == ["x", "INBOX"]
    assert set(apply(lambda c: M.route_folder(c, None), rcpt)) == {"INBOX"}


def test_original_recipient(apply):
    cases = {
        "To: t@x\nX-Envelope-To: <e@x>\nDelivered-To: d@x\n\nb": "e@x",
        "To: t@x\nDelivered-To: d@x\n\nb": "t@x",
        "delivered-to: N <d@x>\r\nTo: t@x\r\n\r\nb": "d@x",
        "X-Envelope-To: \nX-Original-To: o@x\n\nTo: no@x": "o@x",
        "Subject: none\n\nTo: no@x": None,
    }
    assert apply(M.original_recipient, list(cases)) == list(cases.values())
    stamped = apply(M.stamp_original_recipient, list(cases))
    for (raw, found), out in zip(cases.items(), stamped):
        fresh = found is not None and "X-Original-To" not in raw
        assert out == (f"X-Original-To: {found}\n{raw}" if fresh else raw)


def test_headers(apply):
    raw = "FROM: a@x\r\nsubject: one\r\n  two\r\nTo: \r\nFrom: later@x\r\n\r\nDate: body\r\n"
    got = apply(M.extract_headers, [raw])[0]
    assert (got["from"], got["subject"], got["to"], got["date"]) == ("a@x", "one  two", "", None)
    kept = apply(lambda c: M.extract_headers(c, unfold=False), [raw])[0]
    assert kept["subject"] == "one\n  two"
    assert apply(M.message_body, [raw, "A: b\n\n\nx\n\ny", "A: b"]) == ["Date: body\r\n", "\nx\n\ny", ""]


def test_folder_labels(apply):
    paths = ["/var/mail/u/.Quarantine/cur", "/var/mail/u/.Sent/cur", "/var/mail/u/cur", "/var/mail/u/new"]
    assert apply(M.folder_label, paths) == ["QUARANTINE", "SENT", "INBOX", "OTHER"]


def test_scan_prompt_quotes_clean_fields(spark):
    df = spark.createDataFrame(
        [("test@example.com", "user@local.com", None, "Test --- Subject\x1b[1m", "b" * 900)],
        "f string, t string, r string, s string, b string",
    )
    prompt = df.select(M.build_scan_prompt(*[F.col(c) for c in "ftrsb"])).first()[0]
    for part in ("FROM: test@example.com\n", "REPLY-TO: \n", "SUBJECT: Test  Subject\n", "SAFE", "QUARANTINE"):
        assert part in prompt
    assert "b" * 800 in prompt and "b" * 801 not in prompt


def test_shell_previews(apply):
    raw = "A: b\n\none\n--cut\nhidden\n\ntwo\n-- \nrest"
    assert apply(M.scan_preview, [raw, "A: b", "A: b\n\nx"]) == [" one --cut  two --  ", "", " x"]
    assert apply(M.digest_preview, [raw, "A: b", "A: b\n\nx"]) == [" one hidden  two rest", "", " x"]
    assert apply(lambda c: M.digest_preview(c, 3), [raw]) == [" on"]
