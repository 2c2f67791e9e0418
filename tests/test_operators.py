import re

import pytest
from pyspark.sql import functions as F

from threatframe.operators import alerts, anomaly, correlate, indicators, joins, normalize, reports, rules, scoring, search
from threatframe.operators.rules import Rule
from threatframe.plans.rulesets import RULES
from threatframe.sinks import writers
from threatframe.sources import formats, readers

EVENT = "event_id long, ts timestamp, event_type string, src_ip string, dst_ip string, dst_port int, username string, hostname string, status string, severity string, risk int, message string"


def events(spark, rows):
    base = {"event_type": "auth_failure", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.9", "dst_port": 22, "username": "u", "hostname": "h", "status": "failure", "severity": "LOW", "risk": 5, "message": "m"}
    names = [c.split()[0] for c in EVENT.split(", ")]
    made = []
    for k, r in enumerate(rows):
        full = base | {"event_id": k} | r
        made.append(tuple(full.get(n) for n in names))
    df = spark.createDataFrame(made, EVENT.replace("ts timestamp", "ts string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def minute(m):
    return f"2024-01-01 00:{m:02d}:00"


def test_brute_force_fires_with_follow_up(spark):
    rows = [{"ts": minute(m)} for m in (0, 1, 2, 30, 31)] + [{"ts": minute(4), "event_type": "auth_success", "status": "success", "username": "root"}]
    (hit,) = rules.detect(events(spark, rows), RULES[0]).collect()
    assert (hit.value, len(hit.evidence), hit.followed_by) == (3, 3, "root") and "successful authentication" in hit.reasons[1]
    scored = scoring.score_detections(rules.detect(events(spark, rows), RULES[0])).first()
    assert scored.risk_score == 20 + 5 + 15 + 2


def test_distinct_rule_and_window_edges(spark):
    rule = Rule("S", match={"event_type": "firewall_event"}, metric="distinct", distinct_field="dst_port", threshold=3, window="10m")
    rows = [{"ts": minute(m), "event_type": "firewall_event", "dst_port": p} for m, p in ((0, 1), (5, 2), (10, 3), (21, 4), (22, 4))]
    (hit,) = rules.best_windows(rules.grouped(events(spark, rows), rule), rule).collect()
    assert hit.value == 3 and hit.started.minute == 0 and hit.ended.minute == 10


def test_events_without_time_are_judged_as_a_group(spark):
    rule = Rule("T", match={"event_type": "auth_failure"}, threshold=3)
    (hit,) = rules.detect(events(spark, [{"ts": None}] * 4), rule).collect()
    assert hit.value == 4 and hit.ended is None and len(hit.evidence) == 4
    assert rules.detect(events(spark, [{"ts": None}] * 2), rule).count() == 0


def test_unknown_keys_do_not_group(spark):
    rule = Rule("K", match={"event_type": "auth_failure"}, group_by=("src_ip", "username"))
    rows = [{"ts": minute(0), "src_ip": None, "username": ""}, {"ts": minute(0), "src_ip": "fe80::1", "username": None}]
    assert [r.entity for r in rules.detect(events(spark, rows), rule).collect()] == [["fe80::1", "-"]]


def test_any_partitioning_gives_the_same_detections(spark):
    df = events(spark, [{"ts": minute(m % 60), "src_ip": f"10.0.0.{m % 3}"} for m in range(90)])
    a = rules.detect(df.repartition(1), RULES[0]).select("entity", "value", "ended").collect()
    b = rules.detect(df.repartition(7), RULES[0]).select("entity", "value", "ended").collect()
    assert sorted(a) == sorted(b) and len(a) == 3


def test_shipped_patterns_compile_and_match(spark):
    texts = {"WEB_SQLI_001": "id=1 UNION SELECT x", "WEB_TRAVERSAL_001": "GET /../../etc/passwd", "WEB_XSS_001": "<script>alert(1)", "WEB_CMD_INJ_001": "x; cat /etc", "MAL_POWERSHELL_001": "powershell iex (x)", "MAL_DOWNLOAD_EXEC_001": "wget http://a/b.sh", "MAL_PERSISTENCE_001": "/etc/cron.d/x"}
    by = {r.rule_id: r for r in RULES}
    assert len(by) == 20
    for rule_id, text in texts.items():
        df = events(spark, [{"ts": minute(0), "event_type": "http_request", "message": text}, {"ts": minute(0), "event_type": "http_request", "message": "plain"}])
        assert df.filter(rules.condition(by[rule_id])).count() == 1


def test_bad_rules_are_left_out():
    got = rules.parse_rules([{"rule_id": "A", "group_by": ["source_ip"]}, {"name": "no id"}, {"rule_id": "B", "window": "5x"}, {"rule_id": "C", "regex": "("}])
    assert [r.rule_id for r in got] == ["A"] and got[0].group_by == ("src_ip",)


def test_incidents_join_detections_that_share_a_part(spark):
    rows = [{"ts": minute(m)} for m in range(3)] + [{"ts": minute(9), "event_type": "auth_success", "username": "bob"}] + [{"ts": minute(10), "event_type": "privilege_escalation", "username": "bob", "src_ip": "10.9.9.9"}]
    found = rules.evaluate(events(spark, rows), [RULES[0], RULES[2]])
    (inc,) = correlate.incidents(correlate.cluster(scoring.score_detections(found))).collect()
    assert inc.members == 2 and inc.title == "Possible Account Compromise" and inc.classification == "MALICIOUS" and len(inc.timeline) == 4
    assert alerts.narratives(correlate.incidents(correlate.cluster(scoring.score_detections(found)))).count() == 1


def test_components_match_union_find(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), ("c", "q")]
    got = {r.node: r.label for r in correlate.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "q": "a", "x": "x", "y": "x", "z": "z"}


def iocs_of(spark, text):
    return {(i.type, i.value) for i in spark.createDataFrame([(text,)], "t string").select(indicators.iocs(F.col("t")).alias("i")).first().i}


def test_indicators(spark):
    got = iocs_of(spark, "from 185.23.45.67 to 10.0.0.1 see http://Evil.example.com/a?b and mail.corp.net, sum d41d8cd98f00b204e9800998ecf8427e 2001:db8::1")
    assert got == {("ipv4", "185.23.45.67"), ("ipv4", "10.0.0.1"), ("url", "http://Evil.example.com/a?b"), ("domain", "evil.example.com"), ("domain", "mail.corp.net"), ("md5", "d41d8cd98f00b204e9800998ecf8427e"), ("ipv6", "2001:db8::1")}
    assert iocs_of(spark, "version 1.2.3.4 and 999.1.1.1 and 127.0.0.1 and report.pdf") == set()
    assert iocs_of(spark, None) == set()


def test_personal_data_and_policy(spark):
    text = "user Jane Doe mail jane.doe@corp.example password=hunter22 token: abcdef0123456789abcd session_id=abc12345678"
    df = spark.createDataFrame([(text,)], "message string")
    kinds = {h.type for h in df.select(indicators.personal(F.col("message")).alias("h")).first().h}
    assert {"EMAIL", "PASSWORD", "TOKEN", "SESSION_ID", "NAME"} <= kinds
    out = indicators.gate(df).first()
    assert "[EMAIL_REDACTED]" in out.message and "hunter22" not in out.message and "Ja****oe" in out.message and re.search(r"\[SESSION_ID:[0-9a-f]{16}\]", out.message)
    assert out.pii_detected == sorted(kinds)
    assert "jane.doe@corp.example" in indicators.gate(df, {"EMAIL": "keep"}).first().message
    with pytest.raises(ValueError):
        indicators.policy_of({"EMAIL": "burn"})


def test_encryption_round_trip(spark):
    key = F.lit("k")
    df = spark.createDataFrame([("secret é",), (None,), ("plain",)], "t string").withColumn("e", indicators.encrypted(F.col("t"), key))
    for r in df.withColumn("d", indicators.decrypted(F.col("e"), key)).withColumn("p", indicators.decrypted(F.col("t"), key)).collect():
        assert r.d == r.t == r.p and (r.t is None or r.e.startswith("enc:"))


LINES = [
    ("syslog", "Jan  5 10:00:00 web1 sshd[12]: Failed password for invalid user bob from 203.0.113.9 port 4711 ssh2", {"event_type": "auth_failure", "username": "bob", "src_ip": "203.0.113.9", "hostname": "web1"}),
    ("syslog", "Jan  5 10:00:00 web1 sudo: bob : TTY=pts/0 ; COMMAND=/bin/sh", {"event_type": "privilege_escalation", "username": "bob"}),
    ("apache", '198.51.100.7 - - [05/Jan/2024:10:00:00 +0000] "GET /x?id=1 HTTP/1.1" 404 12 "-" "curl"', {"event_type": "http_request", "path": "/x?id=1", "status": "404", "action": "denied"}),
    ("suricata", "01/05/2024-10:00:00.123456  [**] [1:2001:3] ET SCAN x [**] [Classification: y] [Priority: 1] {TCP} 1.2.3.4:55 -> 5.6.7.8:80", {"event_type": "ids_alert", "severity": "HIGH", "src_ip": "1.2.3.4", "dst_port": "80"}),
    ("squid", "1704448800.123    10 10.0.0.5 TCP_DENIED/403 3900 GET http://a.example/", {"event_type": "proxy_request", "status": "deny"}),
    ("cisco_asa", "Jan 5 2024 10:00:00 fw : %ASA-4-106023: Deny tcp src outside:1.2.3.4/55 dst inside:10.0.0.1/22 by access-group", {"event_type": "firewall_event", "status": "deny", "src_ip": "1.2.3.4", "dst_port": "22", "severity": "MEDIUM"}),
    ("fortinet", 'date=2024-01-05 time=10:00:00 devname="fg1" srcip=1.2.3.4 dstip=10.0.0.1 dstport=22 proto=6 action=deny', {"event_type": "firewall_event", "protocol": "tcp", "status": "deny", "hostname": "fg1"}),
    ("palo_alto", "TRAFFIC,deny,1.2.3.4,10.0.0.1,55,22,tcp", {"event_type": "firewall_event", "status": "deny", "dst_port": "22"}),
    ("check_point", "Jan 5 10:00:00 product=VPN-1; action=drop src=1.2.3.4 dst=10.0.0.1 service=22 proto=tcp", {"event_type": "firewall_event", "status": "deny", "dst_port": "22"}),
    ("dns", "05-Jan-2024 10:00:00.000 client 10.0.0.5#5353: query: A.Example.com IN A", {"event_type": "dns_query", "domain": "a.example.com"}),
    ("ot_sensor", "ts=2024-01-05T10:00:00Z plc=p1 tag=temp value=99 unit=C status=ALARM", {"event_type": "ot_sensor_event", "status": "failure", "severity": "HIGH"}),
    ("esxi", "2024-01-05T10:00:00Z esx1 Hostd: Cannot login root@203.0.113.9", {"event_type": "auth_failure", "src_ip": "203.0.113.9", "username": "root"}),
    ("nsx", "2024-01-05T10:00:00Z nsx-edge DROP src=1.2.3.4 dst=10.0.0.1 dpt=22", {"event_type": "firewall_event", "status": "deny"}),
    ("json", '{"eventTime": "2024-01-05T10:00:00Z", "eventSource": "iam.amazonaws.com", "eventName": "CreateUser", "sourceIPAddress": "1.2.3.4", "errorCode": "Denied"}', {"event_type": "cloud_event", "action": "CreateUser", "severity": "HIGH", "status": "failure"}),
    ("firewall", "SRC=1.2.3.4 DST=10.0.0.1 PROTO=TCP DPT=22 ACTION=BLOCK", {"event_type": "firewall_event", "status": "deny", "protocol": "tcp"}),
    ("generic", "2024-01-05T10:00:00Z something odd from 1.2.3.4 to 5.6.7.8 dropped", {"event_type": "generic_event", "dst_ip": "5.6.7.8", "status": "deny"}),
]


def test_every_format_parses(spark):
    df = spark.createDataFrame([(k, line) for k, (_, line, _) in enumerate(LINES)], "k int, line string")
    got = {r.k: r for r in formats.parsed(df).collect()}
    for k, (name, _, want) in enumerate(LINES):
        assert got[k].format == name, (name, got[k])
        assert {c: got[k][c] for c in want} == want, name


def test_normalized_events_have_stable_ids(spark):
    df = spark.createDataFrame([(k, line) for k, (_, line, _) in enumerate(LINES)], "k int, line string")
    ref = F.lit("2024-03-01").cast("timestamp")
    a = {r.k: r for r in normalize.normalize(formats.parsed(df), ref).collect()}
    b = {r.k: r for r in normalize.normalize(formats.parsed(df.repartition(5)), ref).collect()}
    assert all(a[k].dedup_event_id == b[k].dedup_event_id and len(a[k].dedup_event_id) == 32 for k in a)
    assert a[0].ts.isoformat() == "2024-01-05T10:00:00" and a[0].src_port == 4711 and a[0].mappings["hostname"] == "web1"
    assert a[4].ts is not None and a[7].ts is None and a[7].timestamp_source == "ingest"


def test_time_stamps(spark):
    cases = {"1704448800": "2024-01-05T10:00:00", "1704448800123": "2024-01-05T10:00:00.123000", "2024-01-05T12:00:00+02:00": "2024-01-05T10:00:00", "05/Jan/2024:10:00:00 +0000": "2024-01-05T10:00:00", "Dec 31 10:00:00": "2023-12-31T10:00:00", "junk": None}
    df = spark.createDataFrame([(c,) for c in cases], "raw string").withColumn("ts", normalize.parse_timestamp(F.col("raw"), F.lit("2024-03-01").cast("timestamp")))
    assert {r.raw: r.ts and r.ts.isoformat() for r in df.collect()} == cases


def test_readers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    assert [(r.line_no, r.line) for r in readers.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()] == [(1, "one"), (2, ""), (3, "two")]
    (tmp_path / "a.json").write_text('[{"a": {"b": 1, "c": [1, 2]}, "d": "x"}]')
    row = readers.read_json(spark, str(tmp_path / "a.json"), multiline=True).first()
    assert row["a.b"] == 1 and row["a.c"] == "[1,2]" and row["d"] == "x"
    (tmp_path / "a.csv").write_text("h1,h2\nx,\n ,y\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x", None), (None, "y")]
    event = '<Event><System><EventID>4625</EventID><Level>2</Level><TimeCreated SystemTime="2024-01-05T10:00:00Z"/><Computer>dc1</Computer></System><EventData><Data Name="TargetUserName">bob</Data><Data Name="IpAddress">1.2.3.4</Data></EventData></Event>'
    (tmp_path / "a.xml").write_text(f"<Events>{event}{event}</Events>")
    got = readers.read_windows_events(spark, str(tmp_path / "a.xml")).collect()
    assert len(got) == 2 and (got[0].win_event_id, got[0].severity, got[0].username, got[0].src_ip) == (4625, "HIGH", "bob", "1.2.3.4")


def test_baseline_moments(spark):
    rows = [("ip", "a", "n", float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)]
    df = spark.createDataFrame(rows, "entity_type string, entity string, attribute string, value double")
    whole = reports.listing(reports.baseline(df)).first()
    assert (whole.n, whole.mean, whole.std) == (8, 5.0, 2.0)
    parts = reports.fold(reports.baseline(df.filter("value < 5")), reports.baseline(df.filter("value >= 5")))
    folded = reports.listing(parts).first()
    assert abs(folded.mean - 5) < 1e-9 and abs(folded.std - 2) < 1e-9


def test_chain_reports_changes(spark):
    d = spark.createDataFrame([(1, 2, "aa"), (2, 2, "bb"), (3, 1, "cc")], "job long, events long, digest string")
    stored = reports.chained(d)
    assert reports.broken_links(stored, d).count() == 0
    changed = d.withColumn("digest", F.when(F.col("job") == 2, "xx").otherwise(F.col("digest")))
    assert {(r.job, r.fault) for r in reports.broken_links(stored, changed).collect()} == {(2, "changed"), (3, "relinked")}


def test_suppression_and_actions(spark):
    new = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:00:00"), ("c", "2024-01-01 10:00:00")], "dedup_key string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    old = spark.createDataFrame([("a", "2023-01-01 00:00:00", "OPEN"), ("b", "2024-01-01 09:30:00", "RESOLVED"), ("c", "2024-01-01 08:00:00", "RESOLVED")], "dedup_key string, created_at string, status string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.dedup_key for r in joins.unsuppressed(new, old, 3600).collect()] == ["c"]
    got = joins.recommended_actions(spark.createDataFrame([(1, "Malware, Command Execution"), (2, "None")], "k int, category string"), "k").collect()
    by = {r.k: r.actions for r in got}
    assert by[1][0] == "ISOLATE_HOST" and len(by[1]) == 6 and by[2] == ["MANUAL_TRIAGE"]


def test_forest_ranks_planted_outliers_first(spark):
    rows = [{"ts": minute(k % 60), "risk": 5, "dst_port": 80 + k % 3} for k in range(300)] + [{"ts": minute(1), "risk": 99, "dst_port": 60000, "severity": "CRITICAL", "message": "x" * 400}] * 2
    v = anomaly.vectors(events(spark, rows))
    forest = anomaly.fit(v, trees=40)
    top = anomaly.scaled(anomaly.score(v, forest)).orderBy(F.desc("score")).limit(2).collect()
    assert {r.event_id for r in top} == {300, 301} and top[0].anomalous
    assert anomaly.fit(v.repartition(5), trees=40) == forest
    assert "above usual" in anomaly.reasons(v).filter("event_id = 300").first().reasons


@pytest.mark.parametrize("kind", ["cef", "leef", "syslog", "ecs", "ocsf"])
def test_written_lines_are_valid_and_redacted(spark, tmp_path, kind):
    df = events(spark, [{"ts": minute(0), "message": "mail a.b@corp.example | x=y\nnext \\ end", "event_type": "auth_failure"}, {"ts": None, "username": None}])
    writers.write(df, f"{tmp_path}/{kind}", kind)
    back = spark.read.text(f"{tmp_path}/{kind}")
    assert tuple(writers.invalid(back, kind).first()) == (2, 0)
    assert not any("corp.example" in r.value for r in back.collect())


def test_event_filters(spark):
    df = events(spark, [{"ts": minute(1), "severity": "HIGH"}, {"ts": minute(2), "message": "Login from Web-1 ok"}, {"ts": minute(3), "event_type": "dns_query"}])
    ids = lambda f: [r.event_id for r in search.page(search.find(df, f), 0, 10).collect()]
    assert ids(search.EventFilter(severity="HIGH")) == [0] and ids(search.EventFilter(auth=True)) == [1, 0] and ids(search.EventFilter(text="WEB-1")) == [1]
    assert df.filter(search.phrase("from web 1")).count() == 1 and df.filter(search.phrase("rom web")).count() == 0
