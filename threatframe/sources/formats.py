"""Log formats: how a line is recognized, and which fields it yields, as native column expressions.

A format is a name, a condition on the line and a map of fields. All formats are tried by one expression over a scan;
users add their own with `register_format`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatframe.functions.staging import staged

FIELDS = ("event_type", "ts_raw", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "username", "hostname", "process", "action", "status", "severity", "method", "path", "domain")
SAMPLE_LINES = 300  #: non-blank lines of a file that decide on its format
LEAST_SHARE = 0.3

#: Shapes of lines. Groups are numbered, as Java names cannot hold underscores.
SYSLOG = r"^([A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8}) ([^ ]+) ([^ \[:]+)(?:\[[0-9]+\])?: (.*)$"
COMBINED = r"^([^ ]+) [^ ]+ ([^ ]+) \[([^\]]+)\] \"([A-Z]+) ([^ \"]+)[^\"]*\" ([0-9]{3}) ([0-9]+|-)(?: \"([^\"]*)\" \"([^\"]*)\")?"
SURICATA = r"^([0-9]{2}(?:[0-9]{2})?[/-][0-9]{2}[/-][0-9]{2,4}-[0-9:.]+) +\[\*\*\] \[([0-9]+):([0-9]+):([0-9]+)\] (.*?) \[\*\*\] (?:\[Classification: ([^\]]*)\] )?\[Priority: ([0-9]+)\] \{([A-Z]+)\} ([0-9.]+)(?::([0-9]+))? -> ([0-9.]+)(?::([0-9]+))?"
SQUID = r"^([0-9]{10}\.[0-9]{3}) +[0-9]+ ([0-9.]+) ([A-Z_]+)/([0-9]{3}) [0-9]+ ([A-Z]+) ([^ ]+)"
ASA = r"%(?:ASA|FTD|FPR)-([0-9])-([0-9]{6}): (.*)$"
ASA_PAIR = r"(?:from|src) (?:[A-Za-z]+:)?([0-9.]+)/([0-9]+).*?(?:to|dst) (?:[A-Za-z]+:)?([0-9.]+)/([0-9]+)"
DNS = r"client (?:@0x[0-9a-f]+ )?([0-9.]+)#([0-9]+).*?query: ([^ ]+) IN ([A-Z]+)"
PAIR = r"([A-Za-z_][A-Za-z0-9_.-]*)=(\"[^\"]*\"|[^ ,;]*)"
ISO = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{8}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)"
QUAD = r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})"
DENY = r"(?i)\b(den(y|ied)|drop(ped)?|block(ed)?|reject(ed)?)\b"


def group(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def parts(line: Column, pattern: str, n: int) -> Column:
    """The n groups of the pattern's first match as an array, from one pass; null where it does not match."""
    marks = "\x01".join(f"${k}" for k in range(1, n + 1))
    return F.when(line.rlike(pattern), F.split(F.regexp_replace(line, f"(?s)^.*?(?-s:{pattern.removeprefix('^')}).*$" if not pattern.startswith("^") else f"(?s)^(?-s:{pattern.removeprefix('^').removesuffix('$')}).*$", marks), "\x01"))


def part(k: int, column: str = "_g") -> Column:
    """Group k of the `parts` that a format prepares; null if empty."""
    return F.nullif(F.get(column, F.lit(k - 1)), F.lit(""))


def pairs(line: Column) -> Column:
    """key=value parts as a map with lower-case keys; the first of equal keys counts, quotes are taken off."""
    keys = F.transform(F.regexp_extract_all(line, F.lit(PAIR), 1), F.lower)
    values = F.transform(F.regexp_extract_all(line, F.lit(PAIR), 2), lambda v: F.trim(F.replace(v, F.lit('"'), F.lit(""))))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(entries, lambda e, i: F.array_position(keys, e.k) == i + 1)
    return F.map_from_entries(first)


def any_of(m: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.element_at(m, n), F.lit("")) for n in names))


def _syslog(line: Column) -> dict[str, Column]:
    text = part(4)
    failed, fine = text.rlike("(?i)failed password|authentication failure|invalid user"), text.rlike("(?i)accepted (password|publickey)")
    user = F.coalesce(group(text, r"(?:Failed|Accepted) [a-z]+ for (?:invalid user )?([^ ]+)", 1), group(text, r"(?i)invalid user ([^ ]+)", 1), group(text, r"^([^ ]+) : .*COMMAND=", 1))
    kind = F.when(failed, "auth_failure").when(fine, "auth_success").when(text.rlike("COMMAND="), "privilege_escalation").when(text.rlike(r"\[UFW "), "firewall_event").when(text.rlike("query"), "dns_query").when(text.rlike("(?i)dhcp"), "dhcp_event").when(text.rlike("(?i)fail"), "auth_failure").otherwise("system_event")
    m = F.col("_m")
    return {
        "event_type": kind, "ts_raw": part(1), "hostname": part(2), "process": part(3), "username": user,
        "src_ip": F.coalesce(any_of(m, "src"), group(text, r"from " + QUAD, 1), group(text, QUAD, 1)), "dst_ip": any_of(m, "dst"), "dst_port": any_of(m, "dpt"), "src_port": F.coalesce(any_of(m, "spt"), group(text, r"port ([0-9]+)", 1)),
        "protocol": any_of(m, "proto"), "status": F.when(failed | text.rlike("(?i)fail"), "failure").when(fine, "success").when(text.rlike(DENY), "deny"),
    }


def _web(line: Column) -> dict[str, Column]:
    code = part(6).cast("int")
    return {
        "event_type": F.lit("http_request"), "src_ip": part(1), "username": F.nullif(part(2), F.lit("-")), "ts_raw": part(3), "method": part(4), "path": part(5),
        "status": code.cast("string"), "action": F.when(code >= 500, "error").when(code >= 400, "denied").otherwise("allowed"),
    }


def _firewall(line: Column) -> dict[str, Column]:
    m = F.col("_m")
    act = F.lower(any_of(m, "action", "act", "disposition"))
    return {
        "event_type": F.lit("firewall_event"), "ts_raw": F.coalesce(F.concat_ws(" ", any_of(m, "date"), any_of(m, "time")), any_of(m, "ts", "timestamp")), "hostname": any_of(m, "devname", "host", "hostname"),
        "src_ip": any_of(m, "src", "srcip", "src_ip", "source", "source_ip"), "dst_ip": any_of(m, "dst", "dstip", "dst_ip", "destination", "dest_ip"), "src_port": any_of(m, "spt", "srcport", "sport", "src_port", "s_port"),
        "dst_port": any_of(m, "dpt", "dstport", "dport", "dst_port", "service", "d_port"), "protocol": F.coalesce(F.element_at(F.create_map(F.lit("1"), F.lit("icmp"), F.lit("6"), F.lit("tcp"), F.lit("17"), F.lit("udp")), any_of(m, "proto", "protocol")), F.lower(any_of(m, "proto", "protocol"))),
        "username": any_of(m, "user", "username"), "action": act, "status": F.when(act.rlike("^(deny|denied|drop|dropped|block|blocked|reject)$"), "deny").when(act.rlike("^(allow|allowed|accept|accepted|permit|pass)$"), "allow"),
    }


def _suricata(line: Column) -> dict[str, Column]:
    g = part
    level = g(7)
    return {
        "event_type": F.lit("ids_alert"), "ts_raw": g(1), "protocol": F.lower(g(8)), "src_ip": g(9), "src_port": g(10), "dst_ip": g(11), "dst_port": g(12),
        "severity": F.when(level == "1", "HIGH").when(level == "2", "MEDIUM").otherwise("LOW"), "status": F.lit("alert"),
    }


def _squid(line: Column) -> dict[str, Column]:
    g = part
    return {"event_type": F.lit("proxy_request"), "ts_raw": g(1), "src_ip": g(2), "action": g(3), "method": g(5), "path": g(6), "status": F.when(g(3).contains("DENIED"), "deny").otherwise(g(4))}


def _asa(line: Column) -> dict[str, Column]:
    text, level = group(line, ASA, 3), group(line, ASA, 1).cast("int")
    g = lambda k: group(text, ASA_PAIR, k)
    bad = text.rlike("(?i)authentication (failed|rejected)|login denied")
    return {
        "event_type": F.when(bad, "auth_failure").otherwise("firewall_event"), "src_ip": F.coalesce(g(1), group(text, QUAD, 1)), "src_port": g(2), "dst_ip": g(3), "dst_port": g(4), "protocol": F.lower(group(text, r"(?i)\b(tcp|udp|icmp)\b", 1)),
        "username": group(text, r"(?i)user[ =']+([A-Za-z0-9_.-]+)", 1), "status": F.when(bad, "failure").when(text.rlike(DENY), "deny").when(text.rlike("(?i)built|teardown|permitted"), "allow"),
        "severity": F.when(level <= 1, "CRITICAL").when(level <= 3, "HIGH").when(level <= 4, "MEDIUM").otherwise("LOW"),
    }


def _paloalto(line: Column) -> dict[str, Column]:
    c = F.split(line, ",")
    at = lambda k: F.nullif(F.trim(F.try_element_at(c, F.lit(k))), F.lit(""))
    act = F.lower(at(2))
    return {
        "event_type": F.when(at(1) == "AUTHENTICATION", "auth_failure").when(at(1) == "THREAT", "ids_alert").otherwise("firewall_event"), "action": act, "src_ip": at(3), "dst_ip": at(4), "src_port": at(5), "dst_port": at(6), "protocol": F.lower(at(7)),
        "status": F.when(act.rlike("deny|drop|block|reset|fail"), "deny").otherwise("allow"), "severity": F.when(at(1) == "THREAT", "HIGH").otherwise("LOW"),
    }


def _dns(line: Column) -> dict[str, Column]:
    g = part
    return {"event_type": F.lit("dns_query"), "src_ip": g(1), "src_port": g(2), "domain": F.lower(g(3)), "protocol": F.lit("dns"), "ts_raw": group(line, r"^(.{15,27}?) (?:client|[^ ]+ named)", 1)}


def _sensor(line: Column) -> dict[str, Column]:
    m = F.col("_m")
    bad = F.lower(any_of(m, "status")).rlike("alarm|fault|fail|trip|critical")
    return {"event_type": F.lit("ot_sensor_event"), "ts_raw": any_of(m, "ts"), "hostname": any_of(m, "plc"), "action": any_of(m, "tag"), "status": F.when(bad, "failure").otherwise("success"), "severity": F.when(bad, "HIGH").otherwise("LOW")}


def _login(marker: str) -> Callable[[Column], dict[str, Column]]:
    def parse(line: Column) -> dict[str, Column]:
        bad, locked, ok = line.rlike("(?i)cannot login|failed|rejected|invalid"), line.rlike("(?i)lock"), line.rlike("(?i)accepted|authenticated|logged in|success")
        drop = line.rlike(DENY)
        kind = F.when(drop, "firewall_event").when(locked | bad, "auth_failure").when(ok, "auth_success").otherwise("system_event")
        m = F.col("_m")
        return {
            "event_type": kind, "ts_raw": group(line, ISO, 1), "src_ip": F.coalesce(any_of(m, "src"), group(line, r"@" + QUAD, 1), group(line, QUAD, 1)), "dst_ip": any_of(m, "dst"), "dst_port": any_of(m, "dpt"),
            "username": F.coalesce(group(line, r"(?i)user[ =']+([A-Za-z0-9_.\\-]+?)(?:@|[' ]|$)", 1), group(line, r"([A-Za-z0-9_.-]+)@", 1)), "process": F.lit(marker), "status": F.when(drop, "deny").when(locked | bad, "failure").when(ok, "success"),
        }

    return parse


def _json(line: Column) -> dict[str, Column]:
    v = F.col("_m")
    get = lambda *paths: F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))
    vendor = F.when(get("$.eventSource").isNotNull() & get("$.eventName").isNotNull(), "cloud_event").when(get("$.outcome.result").isNotNull(), "cloud_event").when(get("$.detection_id").isNotNull(), "edr_event")
    bad = get("$.errorCode").isNotNull() | F.lower(get("$.outcome.result")).isin("failure", "deny")
    level = get("$.severity")
    word = F.when(level.rlike("^[0-9]+$"), F.when(level.cast("int") >= 5, "CRITICAL").when(level.cast("int") >= 4, "HIGH").when(level.cast("int") >= 3, "MEDIUM").otherwise("LOW")).otherwise(F.upper(level))
    return {
        "event_type": F.coalesce(vendor, get("$.event_type"), F.lit("json_event")), "ts_raw": get("$.eventTime", "$.published", "$.timestamp", "$.ts_raw", "$.ts"), "src_ip": get("$.sourceIPAddress", "$.client.ipAddress", "$.source_ip", "$.src_ip", "$.local_ip"),
        "dst_ip": get("$.destination_ip", "$.dst_ip", "$.remote_ip"), "dst_port": get("$.destination_port", "$.dst_port"), "username": get("$.userIdentity.arn", "$.actor.alternateId", "$.username", "$.user_name"), "hostname": get("$.hostname", "$.host"),
        "action": get("$.eventName", "$.eventType", "$.action"), "status": F.when(bad, "failure").otherwise(F.lower(get("$.status", "$.outcome.result"))), "severity": F.when(get("$.errorCode").isNotNull(), "HIGH").otherwise(word),
    }


def _generic(line: Column) -> dict[str, Column]:
    ips = F.regexp_extract_all(line, F.lit(QUAD), 1)
    return {"event_type": F.lit("generic_event"), "ts_raw": F.coalesce(group(line, ISO, 1), group(line, r"([A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8})", 1)), "src_ip": F.try_element_at(ips, F.lit(1)), "dst_ip": F.try_element_at(ips, F.lit(2)), "status": F.when(line.rlike(DENY), "deny")}


@dataclass(frozen=True)
class Format:
    name: str
    detect: Callable[[Column], Column]
    parse: Callable[[Column], dict]
    prepare: Callable[[Column], dict] = lambda line: {}  #: columns that `parse` reads several times, worked out once


def _is(pattern: str) -> Callable[[Column], Column]:
    return lambda line: line.rlike(pattern)


def _hint(pattern: str, *words: str) -> Callable[[Column], Column]:
    """A pattern that is tried only on lines that hold one of the words."""
    return lambda line: reduce(lambda a, b: a | b, (line.contains(w) for w in words)) & line.rlike(pattern)


def _low(pattern: str, *words: str) -> Callable[[Column], Column]:
    return lambda line: reduce(lambda a, b: a | b, (F.lower(line).contains(w) for w in words)) & line.rlike(pattern)


def _pairs(line: Column) -> dict:
    return {"_m": pairs(line)}


_NETWORK = r"(?i)\b(src|dst|srcip|dstip|proto|dpt|spt|src_ip|dst_ip|dport|sport|protocol)="
_found: list[Format] = [
    Format("suricata", _hint(SURICATA, "[**]"), _suricata, lambda line: {"_g": parts(line, SURICATA, 12)}),
    Format("cisco_asa", _hint(ASA, "%ASA-", "%FTD-", "%FPR-"), _asa),
    Format("squid", _is(SQUID), _squid, lambda line: {"_g": parts(line, SQUID, 6)}),
    Format("apache", _hint(COMBINED, '] "'), _web, lambda line: {"_g": parts(line, COMBINED, 6)}),
    Format("palo_alto", _is(r"^(TRAFFIC|THREAT|AUTHENTICATION),[^,]*,"), _paloalto),
    Format("ot_sensor", _hint(r"plc=[^ ]+ .*tag=", "plc="), _sensor, _pairs),
    Format("esxi", _low(r"(?i)\b(hostd|vobd|vmkernel)\b", "hostd", "vobd", "vmkernel"), _login("vmware-esxi"), _pairs),
    Format("vcenter", _low(r"(?i)\b(vpxd|vcenter|sso)\b.*(login|authent|user)", "vpxd", "vcenter", "sso"), _login("vmware-vcenter"), _pairs),
    Format("nsx", _low(r"(?i)\bnsx", "nsx"), _login("vmware-nsx"), _pairs),
    Format("dns", _hint(DNS, "query: "), _dns, lambda line: {"_g": parts(line, DNS, 4)}),
    Format("fortinet", _hint(r"devname=.*(srcip|dstip)=", "devname="), _firewall, _pairs),
    Format("check_point", _hint(r"product=[^;]*;", "product="), _firewall, _pairs),
    Format("firewall", _hint(f"{_NETWORK}.*{_NETWORK.removeprefix('(?i)')}", "="), _firewall, _pairs),
    Format("syslog", _is(SYSLOG), _syslog, lambda line: {"_g": parts(line, SYSLOG, 4), "_m": pairs(group(line, SYSLOG, 4))}),
    Format("json", _is(r"^\s*\{.*\}\s*$"), _json, lambda line: {"_m": F.try_parse_json(line)}),
]
GENERIC = Format("generic", lambda line: F.lit(True), _generic)


def register_format(name: str, detect: Callable[[Column], Column], parse: Callable[[Column], dict]) -> None:
    """A user's own format; it is tried before the shipped ones."""
    _found.insert(0, Format(name, detect, parse))


def unregister_format(name: str) -> None:
    _found[:] = [f for f in _found if f.name != name]


def formats() -> list[Format]:
    return list(_found)


def line_format(line: Column) -> Column:
    """The first format that recognizes a line; null if none does."""
    out = F.lit(None).cast("string")
    for f in reversed(_found):
        out = F.when(f.detect(line), f.name).otherwise(out)
    return out


def detect_formats(lines: DataFrame, file: str = "file", line: str = "line", order: str = "line_no") -> DataFrame:
    """(file, format, confidence, lines) from the first SAMPLE_LINES non-blank lines of every file.

    The share of the commonest format decides; below LEAST_SHARE the file is generic.
    """
    rows = lines.filter(F.trim(line) != "").withColumn("_k", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter(F.col("_k") <= SAMPLE_LINES)
    counts = rows.groupBy(file, line_format(F.col(line)).alias("format")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(file).agg(F.sum("n").alias("lines"), F.max(F.when(F.col("format").isNotNull(), F.struct("n", "format"))).alias("top"))
    share = F.coalesce(F.col("top.n"), F.lit(0)) / F.col("lines")
    return total.select(file, F.when(share >= LEAST_SHARE, F.col("top.format")).otherwise("generic").alias("format"), F.round(share, 4).alias("confidence"), "lines")


def parsed(lines: DataFrame, line: str = "line", format_column: str | None = None) -> DataFrame:
    """Adds `format` and one column per field.

    A line is parsed by its file's format where that recognizes it, else by the first format that does (the trial
    chain), else as generic text. The labelled lines are written once by format; each format that occurs is a branch
    that reads its own lines, works out what its fields share in columns of their own (_g, _m), and the branches are
    united. No shuffle.
    """
    text = F.col(line)
    own = line_format(text)
    if format_column:
        fits = F.lit(False)
        for f in _found:
            fits = fits | ((F.col(format_column) == f.name) & f.detect(text))
        own = F.when(fits, F.col(format_column)).otherwise(own)
    df = staged(lines.withColumn("format", F.coalesce(own, F.lit("generic"))), "formats", by="format")
    occur = {r.format for r in df.select("format").distinct().collect()}  # at most one row per format
    none = F.lit(None).cast("string")
    new = [c for c in FIELDS if c not in lines.columns]

    def branch(f: Format) -> DataFrame:
        found = f.parse(text)
        return df.filter(F.col("format") == f.name).withColumns(f.prepare(text)).select(*lines.columns, F.lit(f.name).alias("format"), *(found.get(c, none).cast("string").alias(c) for c in new))

    branches = [branch(f) for f in [*_found, GENERIC] if f.name in occur] or [branch(GENERIC)]
    return reduce(DataFrame.unionByName, branches)
