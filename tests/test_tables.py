import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from mailsift.functions import risk
from mailsift.operators import digest, filters, health, joins
from mailsift.sources import mail, records

NOW = dt.datetime(2024, 1, 2, 12)
INPUTS = (
    "mailbox int, staging_count bigint, failed_count bigint, lmtp_available boolean, "
    "imap_connected boolean, imap_failures bigint, last_error string, last_fetch timestamp"
)


def rollup(spark, **changes):
    base = dict(mailbox=1, staging_count=0, failed_count=0, lmtp_available=True,
                imap_connected=True, imap_failures=0, last_error=None, last_fetch=None)
    df = spark.createDataFrame([tuple({**base, **changes}.values())], INPUTS)
    row = health.health_rollup(df, F.lit(NOW)).first()
    return row["status"], row["issues"], row["warnings"]


def test_health_thresholds(spark):
    stuck = " emails stuck in staging! Mail delivery may be failing."
    cases = [
        ({"staging_count": 10}, ("healthy", [], [])),
        ({"staging_count": 11}, ("warning", [], ["11 emails in staging queue"])),
        ({"staging_count": 50}, ("warning", [], ["50 emails in staging queue"])),
        ({"staging_count": 51}, ("critical", ["51" + stuck], [])),
        ({"failed_count": 1}, ("critical", ["1 emails failed delivery! Manual review required."], [])),
        ({"lmtp_available": False}, ("critical", ["LMTP service unreachable! Email delivery is broken."], [])),
        ({"imap_failures": 2}, ("healthy", [], [])),
        ({"imap_failures": 3}, ("critical", [
            "Mail fetcher has 3 consecutive failures! Check upstream IMAP connectivity."], [])),
        ({"imap_connected": False, "imap_failures": 9, "last_error": "e" * 200}, ("critical", [
            "Mail fetcher disconnected from upstream! Error: " + "e" * 100], [])),
        ({"imap_connected": False}, ("critical", [
            "Mail fetcher disconnected from upstream! Error: Unknown error"], [])),
        ({"last_fetch": NOW - dt.timedelta(hours=1)}, ("healthy", [], [])),
        ({"last_fetch": NOW - dt.timedelta(hours=1, seconds=1)}, (
            "warning", [], ["Last email fetch was 60 minutes ago"])),
        ({"last_fetch": NOW - dt.timedelta(hours=6)}, (
            "warning", [], ["Last email fetch was 360 minutes ago"])),
        ({"last_fetch": NOW - dt.timedelta(hours=7, minutes=59)}, (
            "critical", ["No emails fetched in 7 hours! Mail processor may be stuck."], [])),
    ]
    for changes, want in cases:
        assert rollup(spark, **changes) == want, changes
    status, issues, warnings = rollup(spark, staging_count=15, failed_count=5, lmtp_available=False)
    assert status == "critical" and len(issues) == 2 and len(warnings) == 1


def test_health_inputs_take_defaults(spark):
    counts = spark.createDataFrame([(1, 4, 0), (2, 0, 1)], "mailbox int, staging_count bigint, failed_count bigint")
    probe = spark.createDataFrame([(2, False)], "mailbox int, lmtp_available boolean")
    status = records.read_status(spark.createDataFrame(
        [(3, '{"is_connected": false, "consecutive_failures": 2, "updated_at": "2024-01-01T00:00:00"}'),
         (4, "{broken"), (5, '{"last_successful_fetch": "soon", "updated_at": "2024-01-01T00:00:00"}')],
        "mailbox int, status string"))
    got = {r["mailbox"]: r.asDict() for r in health.health_inputs(counts, probe, status).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1]["lmtp_available"] and not got[2]["lmtp_available"]
    assert (got[3]["staging_count"], got[3]["imap_connected"], got[3]["imap_failures"]) == (0, False, 2)
    assert got[5]["imap_connected"] and got[5]["last_fetch"] is None


def test_extended_health(spark):
    inputs = spark.createDataFrame(
        [(i, 0, 0, True, True, 0, None, None) for i in (1, 2, 3)], INPUTS)
    creds = spark.createDataFrame(
        [(1, NOW + dt.timedelta(hours=3)), (2, NOW + dt.timedelta(hours=1))], "mailbox int, expires_at timestamp")
    errors = spark.createDataFrame([(1, 20), (2, 21), (9, 99)], "mailbox int, errors bigint")
    got = {r["mailbox"]: r for r in health.health_rollup_ext(inputs, creds, errors, F.lit(NOW)).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["healthy", "warning", "critical"]
    assert got[2]["warnings"] == [
        "Credentials expiring soon - may need refresh", "21 errors in scanner log - review recommended"]


def test_queue_counts_include_empty_mailboxes(spark):
    queue = spark.createDataFrame([(1, "pending"), (1, "failed"), (1, "processing"), (2, "pending")], "mailbox int, state string")
    boxes = spark.createDataFrame([(1,), (2,), (3,)], "mailbox int")
    got = {r["mailbox"]: (r[1], r[2]) for r in health.queue_counts(queue, boxes).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 0)}


def test_audit_with_copies(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 4)], "message_key string, size int")
    have = spark.createDataFrame([("a", 1)] * 50 + [("b", 3), ("x", 9), ("d", 4), ("d", 5)], "message_key string, size int")
    audit = joins.audit_landed(want, have)
    assert {r["message_key"]: r["audit"] for r in audit.collect()} == {
        "a": "ok", "b": "size_mismatch", "c": "missing", "d": "size_mismatch", "x": "unexpected"}
    assert [r[0] for r in joins.purgeable(want, audit).select("message_key").collect()] == ["a"]
    assert joins.not_purgeable(want, audit).count() == 4


def test_catch_all_mailbox(spark):
    df = spark.createDataFrame([("A@x",), ("b@x",), (None,)], "recipient string")
    users = spark.createDataFrame([("a@X", "ann")], "recipient string, mailbox string")
    got = {r["recipient"]: r["mailbox"] for r in joins.resolve_mailbox(df, users, "rest").collect()}
    assert got == {"A@x": "ann", "b@x": "rest", None: "rest"}


def test_alias_reaches_every_mailbox(spark):
    df = spark.createDataFrame([("all@x",), ("b@x",)], "recipient string")
    users = spark.createDataFrame([("all@x", "ann"), ("ALL@x", "bob"), ("all@x", "bob")], "recipient string, mailbox string")
    got = sorted((r["recipient"], r["mailbox"]) for r in joins.resolve_mailbox(df, users, "rest").collect())
    assert got == [("all@x", "ann"), ("all@x", "bob"), ("b@x", "rest")]


def test_keyed_joins_with_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,)], "message_key string")
    side = spark.createDataFrame([("a", 3), ("a", 2), (None, 9)], "message_key string, retries bigint")
    assert {r[0]: r[1] for r in joins.with_retry_count(df, side).collect()} == {"a": 3, None: 0}
    audit = side.select("message_key", F.lit("ok").alias("audit"))
    assert [r[0] for r in joins.not_purgeable(df, audit).collect()] == [None]
    assert [r[0] for r in joins.unprocessed(df, side).collect()] == [None]


def test_long_brand_lists(spark):
    brands = [f"brand{i:03d}" for i in range(300)] + ["paypal"]
    df = spark.createDataFrame([("paypa1.com",), ("paypal.com",), ("other.org",)], "domain string")
    assert [r[0] for r in df.select(risk.lookalike(F.col("domain"), brands)).collect()] == [True, False, False]
    assert not df.where(risk.lookalike(F.col("domain"), [])).count()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lookalikes_find_every_close_pair(spark):
    rng = random.Random(5)
    labels = {"".join(rng.choice("ab0") for _ in range(rng.randint(0, 6))) for _ in range(120)}
    brands = {"".join(rng.choice("abo") for _ in range(rng.randint(1, 6))) for _ in range(40)}
    domains = spark.createDataFrame([(f"{label}.zz",) for label in labels] * 2, "domain string")
    brand_df = spark.createDataFrame([(b,) for b in brands], "brand string")
    for k in (1, 2):
        got = {
            (r["domain"], r["label"], r["brand"], r["distance"])
            for r in joins.lookalike_domains(domains, brand_df, k).collect()
        }
        want = set()
        for label in labels:
            for part in (label, "zz"):
                for b in brands:
                    d = edit_distance(part.replace("0", "o"), b)
                    if d <= k and part != b:
                        want.add((f"{label}.zz", part, b, d))
        assert got == want


def digest_rows(spark, n=500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        box = 1 if rng.random() < 0.4 else rng.randint(2, 6)
        at = NOW - dt.timedelta(minutes=rng.randint(0, 3000))
        rows.append((box, at, f"k{i:04d}", f"u{i % 3}@d{i % 2}.org", f"s{i}", "p", rng.choice("AB"), f"r{i}"))
    return rows, spark.createDataFrame(
        rows, "mailbox int, received_at timestamp, message_key string, from_addr string, subject string, "
        "body_preview string, category string, reason string")


def test_digest_keeps_the_newest_and_counts_all(spark):
    rows, df = digest_rows(spark)
    boxes = spark.createDataFrame([(i,) for i in range(1, 9)], "mailbox int")
    got = {r["mailbox"]: r for r in digest.mail_digest(df, boxes, F.lit(NOW), max_items=10).collect()}
    assert set(got) == set(range(1, 9))
    for box in range(1, 9):
        mine = sorted(
            (r for r in rows if r[0] == box and r[1] >= NOW - dt.timedelta(hours=24)),
            key=lambda r: (-r[1].timestamp(), r[2]))[:10]
        text = "\n---\n".join(f"FROM: {r[3]}\nSUBJECT: {r[4]}\nPREVIEW: p\n" for r in mine)
        assert got[box]["items"] == len(mine)
        assert got[box]["digest"] == (text or "No new emails in the last 24 hours.")
    summary = {r["mailbox"]: r for r in digest.quarantine_summary(df, 2).collect()}
    assert {b: s["messages"] for b, s in summary.items()} == {
        b: sum(r[0] == b for r in rows) for b in range(1, 7)}
    assert all(len(s["items"]) == 2 for s in summary.values())
    sections = digest.category_rollup(df, max_items=1).collect()
    assert sum(r["messages"] for r in sections) == len(rows)


def test_recent_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    rows = [(1, NOW - dt.timedelta(hours=24)), (2, NOW - dt.timedelta(hours=24, microseconds=1)), (3, NOW)]
    spark.createDataFrame(rows, "id int, received_at timestamp").write.parquet(f"{tmp_path}/m")
    df = filters.recent(spark.read.parquet(f"{tmp_path}/m"), NOW)
    assert {r["id"] for r in df.collect()} == {1, 3}
    assert "GreaterThanOrEqual(received_at" in df._jdf.queryExecution().executedPlan().toString()


def test_mail_folders(spark, tmp_path):
    rows = [("ann", "cur", "1", b"A"), ("ann", ".Sent/cur", "2", b"BB"), ("bob", "new", "3", b"CCC"), ("bob", "tmp", "4", b"no")]
    df = spark.createDataFrame(rows, "mailbox string, folder string, name string, content binary")
    report = mail.land_messages(df, f"{tmp_path}/box").collect()
    assert sorted(r["size"] for r in report) == [1, 2, 2, 3]
    got = mail.read_mail_folders(spark, f"{tmp_path}/box")
    assert sorted((r["mailbox"], r["folder"], r["name"], bytes(r["content"])) for r in got.collect()) == sorted(rows[:3])
    late = dt.datetime.now() + dt.timedelta(days=1)
    pruned = mail.read_mail_folders(spark, f"{tmp_path}/box", modified_after=late)
    assert pruned.count() == 0
    assert "PushedFilters: [IsNotNull(modificationTime), GreaterThanOrEqual(modificationTime" in (
        pruned._jdf.queryExecution().executedPlan().toString())
    counted = got.groupBy("mailbox").count()._jdf.queryExecution().executedPlan().toString()
    assert "content" not in counted
    assert mail.read_mail_folders(spark, f"{tmp_path}/none").count() == 0


def test_scan_log(spark):
    lines = [
        "[2024-01-01 10:00:00] SCAN: Subject: hi", "[2024-01-01 10:00:01]   -> SAFE | ok then",
        "[2024-01-01 10:00:02]   LMTP ERROR: 451", "[2024-01-01 10:00:03]   FAILED: Max retries", "no stamp",
        "[2024-01-01 10:00:04] Startup complete",
    ]
    got = records.parse_scan_log(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy(F.col("ts").asc_nulls_last()).collect()
    assert (got[-1]["detail"], got.pop()["kind"]) == ("no stamp", "other")
    assert [r["kind"] for r in got] == ["scan", "verdict", "error", "failed", "other"]
    assert (got[1]["verdict"], got[1]["reason"]) == ("SAFE", "ok then")
    assert [r["is_error"] for r in got] == [False, False, True, False, False]


def test_retry_first_and_malformed(spark):
    a = spark.createDataFrame([(1, None)], "id int, error string")
    b = spark.createDataFrame([(2, "bad")], "id int, error string")
    assert [(r["id"], r["priority"]) for r in filters.retry_first(a, b).orderBy("priority").collect()] == [(1, 0), (2, 1)]
    out = {r["id"]: (r["disposition"], r["reason"]) for r in filters.split_malformed(filters.folder_union(a, b)).collect()}
    assert out == {1: (None, None), 2: ("failed", "Parse error: bad")}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_lookalikes_equal_all_pairs(spark, k):
    """Also brands and words shorter than the distance, and candidates stay near the pairs found."""
    draw = random.Random(k)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    brands = {word(draw.randrange(0, 9)) for _ in range(80)} | {"", "a", "ab", "abc"}
    words = {word(draw.randrange(1, 10)) for _ in range(150)} | {"a", "b", "ab", "cab"}
    table = spark.createDataFrame([(b,) for b in brands] + [("ab",), (None,)], "brand string")
    domains = spark.createDataFrame([(f"{w}.x",) for w in words] * 2, "domain string")
    found = joins.lookalike_domains(domains, table, k)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(w, b, distance(w, b)) for w in words | {"x"} for b in brands if w != b and distance(w, b) <= k}
    assert {(r["label"], r["brand"], r["distance"]) for r in found.select("label", "brand", "distance").distinct().collect()} == want


def test_lookalike_candidates_are_few(spark):
    draw = random.Random(1)
    names = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(6, 14))) for _ in range(3000)]
    brands = spark.createDataFrame([(n,) for n in names], "brand string")
    words = spark.createDataFrame([(n[:-1] + "q",) for n in names], "_plain string")
    pairs = joins.word_signatures(words, 2).join(joins.brand_signatures(brands, 2), "_of").select("_plain", "brand").distinct()
    assert pairs.count() < 0.02 * 3000 * 3000
    assert joins.word_signatures(words, 2).count() < 75 * 3000


def test_lookalike_words_are_spread_over_tasks(spark):
    """Few words are few bytes, but adaptive execution must not put all their candidates into one task."""
    domains = spark.createDataFrame([("amaz0n.amaz0n-shop.x",), ("paypa.example.com",), (None,)] * 2, "domain string")
    brands = spark.createDataFrame([("amazon",), ("paypal",), ("amazons",)], "brand string")
    found = joins.lookalike_domains(domains, brands, 1)
    assert sorted(map(tuple, found.collect())) == [
        ("amaz0n.amaz0n-shop.x", "amaz0n", "amazon", 0), ("amaz0n.amaz0n-shop.x", "amaz0n", "amazons", 1),
        ("paypa.example.com", "paypa", "paypal", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_mail_folders_are_listed_as_folders(spark, tmp_path):
    """Not a path per file; nested folders and files beside folders are no messages."""
    rows = [("ann", "cur", f"{i}", b"A") for i in range(40)] + [("bob", "new", "x", b"B"), ("bob", "cur/deep", "y", b"C"), ("cy", "", "cur", b"D")]
    mail.land_messages(spark.createDataFrame(rows, "mailbox string, folder string, name string, content binary"), f"{tmp_path}/box").collect()
    got = mail.read_mail_folders(spark, f"{tmp_path}/box", ("cur", "new"))
    leaf = got._jdf.queryExecution().analyzed().collectLeaves().head()
    assert leaf.relation().location().rootPaths().size() <= 3
    assert sorted((r["mailbox"], r["folder"], r["name"]) for r in got.collect()) == sorted(r[:3] for r in rows[:41])


def test_mail_files_are_read_many_in_a_task(spark, tmp_path):
    name = "spark.sql.files.openCostInBytes"
    spark.conf.unset(name)
    rows = [("ann", "cur", f"{i}", b"A") for i in range(600)]
    mail.land_messages(spark.createDataFrame(rows, "mailbox string, folder string, name string, content binary"), f"{tmp_path}/box").collect()
    got = mail.read_mail_folders(spark, f"{tmp_path}/box", ("cur",))
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1 and got.count() == 600
    spark.conf.set(name, "64k")
    mail.read_mail_folders(spark, f"{tmp_path}/box", ("cur",))
    assert spark.conf.get(name) == "64k"
    spark.conf.unset(name)


def test_signatures_of_few_words_are_not_sent_through_the_driver(spark):
    """Words are few bytes, their signatures are not, and Spark takes them for as many."""
    draw = random.Random(2)
    names = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 9))) for _ in range(200)]
    domains = spark.createDataFrame([(f"{n[:-1]}q-shop.example.com",) for n in names], "domain string")
    found = joins.lookalike_domains(domains, spark.createDataFrame([(n,) for n in names], "brand string"), 2)
    assert found.count() > 200
    found.collect()
    joined = re.findall(r"(\w+Join) \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert {kind for kind, keys in joined if "_of" in keys} == {"SortMergeJoin"}
