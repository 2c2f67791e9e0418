"""Indicators, personal data, redaction and flags in free text, as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatframe.functions.keyed import KeyedTable
from threatframe.functions.staging import staged
from threatframe.operators import personal as personal_data
from threatframe.operators.personal import once

#: A run of the characters that addresses and names consist of, with a following character that makes it code, not a name.
#: Letters and digits of any script belong to a run, which is then judged whole: the end of a foreign word is no name.
CHUNK = r"[\p{L}\p{M}\p{N}_@./-]+[=(']?"
#: What stands beside an IPv4 address in such a run.
BESIDE = "[@/=('-]"
HEX_RUN = "[0-9a-fA-F]{32,}"
COLON_RUN = "[A-Za-z0-9_:]+"
#: A dotted quad; a line's end after an octet does not matter.
QUAD = r"^(?:{0}\.){{3}}{0}\z".format(r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\r\n|[\r\n])?")
URL = r"(?i)https?://[^\s\"'<>\\]+"
#: What a text holds that has indicators, or that, after a space, changes which ones stand in the text before it.
TELLING = r"(?i)[.:<]|[0-9a-f]{32}|v(?:ersion)?[ \"]"
HOST = r"(?i)^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#\[]+)"
#: Dotted numbers that are versions, and blocks whose dotted names are code.
VERSION = r"(?i)(?<![A-Za-z0-9_])(?:v|version)\s*\"?(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
SCRIPT = r"(?is)<script\b.*?</script>"
#: Endings that are files, addresses that say nothing, confidences by type.
FILE_ENDINGS = "log txt cfg conf xml json csv yaml yml pid bak tmp gz zip tar pdf docx xlsx pptx".split()
RESERVED = ("0.0.0.0", "255.255.255.255", "127.0.0.1")
CONFIDENCE = {"ipv4": 0.99, "ipv6": 0.97, "domain": 0.85, "url": 0.95, "md5": 0.99, "sha1": 0.99, "sha256": 0.99}
#: Private and special IPv4 networks as (first address, prefix length).
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))

#: Suspicious patterns by name.
SUSPICIOUS = {
    "encoded_powershell": r"(?i)-enc(?:odedcommand)?\b",
    "powershell_iex": r"(?i)\biex\b|\binvoke-expression\b",
    "download_command": r"(?i)downloadstring|invoke-webrequest|\biwr\b|invoke-restmethod|certutil\s+-urlcache|bitsadmin\s+/transfer|wget\s+https?://|curl\s+https?://",
    "shell_execution": r"(?i)/bin/(ba)?sh\s+-c|cmd\.exe\s+/c|powershell\s+-",
    "path_traversal": r"(?i)(?:\.\./){2,}|/etc/(passwd|shadow)|%2e%2e%2f",
    "sql_injection": r"(?i)union\s+select\b|'\s*or\s+'?1'?='?1|--\s*$|;\s*drop\s+table\b|sleep\(\d+\)",
    "xss_pattern": r"(?i)<script\b[^>]*>|javascript:|onerror\s*=",
    "command_injection": r"(?i);\s*(?:cat|id|whoami|nc|bash)\b|\|\s*(?:cat|id|whoami|nc)\b",
}

#: What the default policy does with each category.
POLICY = {"ACCOUNT_NUMBER": "REDACT", "API_KEY": "REDACT", "EMAIL": "REDACT", "EMPLOYEE_ID": "KEEP", "NAME": "MASK", "PASSWORD": "REDACT", "PHONE": "MASK", "SESSION_ID": "HASH", "TOKEN": "REDACT"}
ACTIONS = ("REDACT", "TYPE", "MASK", "HASH", "KEEP")


def ip_number(ip: Column) -> Column:
    """A dotted quad as BIGINT; null where an octet is missing, over 255 or has leading zeros."""
    return F.when(ip.rlike(QUAD), F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + F.coalesce(o.try_cast("long"), F.lit(0))))


def is_private(number: Column) -> Column:
    def net(number: Column, first: str, bits: int):
        low = sum(int(o) << (24 - 8 * k) for k, o in enumerate(first.split(".")))
        return number.between(low, low + (1 << (32 - bits)) - 1)

    return once(number, lambda n: reduce(lambda a, b: a | b, (net(n, first, bits) for first, bits in PRIVATE)))


def _ioc(value: Column, kind: str, private: Column | None = None, host: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        value.alias("value"), F.lit(kind).alias("type"), F.lit(CONFIDENCE[kind]).alias("confidence"),
        (none.cast("boolean") if private is None else private).alias("private"), (none.cast("string") if host is None else host).alias("host"),
    )


def good_ipv4(value: Column) -> Column:
    return ip_number(value).isNotNull() & ~value.isin(*RESERVED)


def good_domain(value: Column) -> Column:
    """A lower-cased name with at least two labels of at most 63 characters and a top level that is no file ending."""
    top = F.substring_index(value, ".", -1)
    return (F.length(value) <= 253) & value.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$") & ~top.isin(*FILE_ENDINGS)


def ipv6_groups(value: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null where it is none (or is written with a dotted quad)."""
    low = F.lower(value)
    shape = low.rlike("^[0-9a-f:]+$") & ~low.rlike("[0-9a-f]{5}|:::|^:[^:]|[^:]:$")
    filled = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = filled(F.substring_index(low, "::", 1)), filled(F.substring_index(low, "::", -1))
    missing = 8 - F.size(left) - F.size(right)
    short = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), right)
    twice = F.length(low) - F.length(F.replace(low, F.lit("::"), F.lit(""))) > 2
    groups = F.when(low.contains("::") & ~twice & (missing >= 1), short).when(~low.contains("::"), filled(low))
    return F.when(shape & (F.size(groups) == 8), F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def canonical_ipv6(groups: Column) -> Column:
    """The one written form of an address: small letters, no leading zeros, the first longest run of zeros as '::'."""
    text = F.concat(F.lit(":"), F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g.cast("long")))), ":"), F.lit(":"))
    out = F.substring(text, 2, F.length(text) - 2)
    for n in range(2, 9):
        run = ":" + "0:" * n
        at = F.instr(text, F.lit(run))
        before, after = F.substring(text, F.lit(2), at - 2), F.substring(text, at + len(run), F.length(text))
        out = F.when(at > 0, F.concat(F.when(at > 1, before).otherwise(""), F.lit("::"), F.regexp_replace(after, ":$", ""))).otherwise(out)
    return out


def is_private_ipv6(groups: Column) -> Column:
    """Whether an address, as eight numbers, is in a private or special network."""
    a, b, c = (F.get(groups, F.lit(k)) for k in (0, 1, 2))
    zero = lambda first, last: F.forall(F.slice(groups, first + 1, last - first + 1), lambda g: g == 0)
    special = (a == 0x2001) & (b < 0x200) & ~((b == 3) | b.between(0x20, 0x3F) | ((b == 4) & (c == 0x112)) | ((b == 1) & zero(2, 6) & F.get(groups, F.lit(7)).isin(1, 2)))
    own = a.between(0xFC00, 0xFDFF) | a.between(0xFE80, 0xFEBF) | (a == 0x2002) | ((a == 0x2001) & (b == 0xDB8))
    rest = ((a == 0x100) & zero(1, 3)) | ((a == 0x64) & (b == 0xFF9B) & (c == 1)) | (zero(0, 6) & F.get(groups, F.lit(7)).isin(0, 1)) | (zero(0, 4) & (F.get(groups, F.lit(5)) == 0xFFFF))
    return special | own | rest


MAPPED = "00000000000000000000ffff"


def ip_key(value: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hexadecimal digits, which order as the addresses do; IPv4 stands where IPv6 maps it."""
    digits = lambda n, of: F.lpad(F.lower(F.hex(n.cast("long"))), of, "0")
    six = ipv6_groups(value)
    return F.coalesce(F.concat(F.lit(MAPPED), digits(ip_number(value), 8)), F.when(six.isNotNull(), F.array_join(F.transform(six, lambda g: digits(g, 4)), "")))


def _when(test: Column, found: Column) -> Column:
    """found where the cheap test holds, else nothing."""
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def iocs(text: Column) -> Column:
    """ARRAY<STRUCT<value,type,confidence,private,host>> of the valid, different indicators of a text.

    One pass cuts the text into runs of address characters; those with a dot are judged as IPv4 addresses and as names.
    The other types are looked for only where a cheap test on the text allows them. What is read in several places (links,
    runs, numbers of addresses) is worked out once.
    """
    text = F.coalesce(text, F.lit(""))
    all_of = lambda pattern, t=text: F.regexp_extract_all(t, F.lit(pattern), 0)
    dotted = lambda t: _when(t.contains("."), F.filter(all_of(CHUNK, t), lambda c: c.contains(".")))
    urls = _when(text.contains("://"), all_of(URL))
    linked = F.transform(urls, lambda u: F.struct(u.alias("url"), F.lower(F.regexp_replace(F.regexp_extract(u, HOST, 1), r"[\[\]]", "")).alias("host")))
    linked = F.filter(linked, lambda x: good_ipv4(x.host) | good_domain(x.host) | ipv6_groups(x.host).isNotNull())
    versions, scripts = text.rlike("(?i)v(ersion)?[ \"]"), text.contains("<") & text.rlike("(?i)<script")
    plain = F.when(versions, F.regexp_replace(text, VERSION, " ")).otherwise(text)
    shown = F.when(scripts, F.regexp_replace(text, SCRIPT, " ")).otherwise(text)
    colons = _when(text.rlike(":[0-9A-Fa-f]*:"), F.filter(all_of(COLON_RUN), lambda c: c.rlike(":.*:")))
    sums = _when(text.rlike(HEX_RUN), F.filter(F.transform(all_of(HEX_RUN), F.lower), lambda h: F.length(h).isin(32, 40, 64)))
    as_kind = lambda k: lambda v: _ioc(v, k)

    def found(x: Column) -> Column:
        hosts = F.transform(x.linked, lambda u: u.host)
        numbers = F.flatten(F.transform(F.filter(x.runs, lambda c: c.rlike(r"[0-9]\.[0-9]")), lambda c: F.when(c.rlike(BESIDE), F.split(c, BESIDE)).otherwise(F.array(c))))
        quads = F.filter(F.concat(hosts, numbers), lambda v: v.rlike(r"^[0-9.]+$") & ~v.isin(*RESERVED))
        v4 = F.filter(F.transform(quads, lambda v: F.struct(v.alias("value"), ip_number(v).alias("number"))), lambda q: q.number.isNotNull())
        v6 = F.filter(F.transform(F.concat(F.filter(hosts, lambda h: h.contains(":")), colons), ipv6_groups), lambda g: g.isNotNull())
        names = F.concat(hosts, F.transform(F.coalesce(x.shown, x.runs), F.lower))
        of_length = lambda n: F.filter(x.sums, lambda h: F.length(h) == n)
        return F.concat(
            F.transform(x.linked, lambda u: _ioc(u.url, "url", host=u.host)),
            F.transform(v4, lambda q: _ioc(q.value, "ipv4", is_private(q.number))),
            F.transform(v6, lambda g: _ioc(canonical_ipv6(g), "ipv6", is_private_ipv6(g))),
            F.transform(F.filter(names, good_domain), lambda v: _ioc(v, "domain")),
            *(F.transform(of_length(n), as_kind(k)) for n, k in ((32, "md5"), (40, "sha1"), (64, "sha256"))),
        )

    read = F.struct(linked.alias("linked"), dotted(plain).alias("runs"), F.when(versions | scripts, dotted(shown)).alias("shown"), sums.alias("sums"))
    return F.array_distinct(once(read, found))


def suspicious(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(p), name) for name, p in SUSPICIOUS.items())))


def personal(text: Column) -> Column:
    """ARRAY<STRUCT<type,value,confidence>> of the different personal data of a text; see `operators/personal.py`."""
    return personal_data.personal(text, good_domain)


def masked(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.concat(F.when(F.length(local) > 2, F.left(local, F.lit(2))).otherwise(""), F.lit("****@"), F.left(domain, F.lit(1)), F.lit("****."), F.substring_index(domain, ".", -1))
    plain = F.when(F.length(value) <= 6, "****").otherwise(F.concat(F.left(value, F.lit(2)), F.lit("****"), F.right(value, F.lit(2))))
    return F.when(value.contains("@") & ~value.contains(" "), mail).otherwise(plain)


def _replacement(kind: Column, value: Column, policy: Mapping[str, str]) -> Column:
    action = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in policy.items() for x in kv)), kind), F.lit(policy.get("DEFAULT", "REDACT")))
    return (
        F.when(action == "REDACT", F.concat(F.lit("["), kind, F.lit("_REDACTED]")))
        .when(action == "TYPE", F.concat(F.lit("["), kind, F.lit("]")))
        .when(action == "MASK", masked(value))
        .when(action == "HASH", F.concat(F.lit("["), kind, F.lit(":"), F.left(F.sha2(value, 256), F.lit(16)), F.lit("]")))
        .otherwise(value)
    )


def policy_of(user: Mapping[str, str] | None = None) -> dict[str, str]:
    """The default policy with the user's entries on top; an unknown action is refused."""
    out = POLICY | {k.upper(): v.upper() for k, v in (user or {}).items()}
    if bad := set(out.values()) - set(ACTIONS):
        raise ValueError(f"unknown privacy actions: {sorted(bad)}")
    return out


def redacted(text: Column, policy: Mapping[str, str] | None = None, hits: Column | None = None) -> Column:
    """The text with every hit replaced as the policy says, the longest first (ties by value)."""
    policy = policy_of(policy)
    hits = personal(text) if hits is None else hits
    order = lambda a, b: F.when(F.length(a.value) > F.length(b.value), -1).when(F.length(a.value) < F.length(b.value), 1).when(a.value < b.value, -1).when(a.value > b.value, 1).otherwise(0)
    return F.aggregate(F.array_sort(hits, order), text, lambda t, h: F.replace(t, h.value, _replacement(h.type, h.value, policy)))


def gate(df: DataFrame, policy: Mapping[str, str] | None = None) -> DataFrame:
    """What every sink writes: message, raw_line and excerpts redacted, categories merged into pii_detected."""
    out, found = df, []
    for c in ("message", "raw_line"):
        if c in df.columns:
            out = out.withColumn(f"_{c}", personal(F.col(c)))
            found.append(F.transform(f"_{c}", lambda h: h.type))
    if found:
        before = [F.coalesce("pii_detected", F.array().cast("array<string>"))] if "pii_detected" in df.columns else []
        out = out.withColumn("pii_detected", F.array_sort(F.array_distinct(F.concat(*before, *found))))
    for c in ("message", "raw_line"):
        if c in df.columns:
            out = out.withColumn(c, redacted(F.col(c), policy, F.col(f"_{c}"))).drop(f"_{c}")
    for c in ("timeline", "evidence"):
        if c in df.columns:
            out = out.withColumn(c, F.transform(c, lambda e: e.withField("excerpt", redacted(e.excerpt, policy))))
    return out


def encrypted(text: Column, key: Column) -> Column:
    """AES-GCM with the SHA-256 of a key, marked by a prefix; null stays null."""
    return F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), F.unhex(F.sha2(key, 256)), F.lit("GCM"))))


def decrypted(text: Column, key: Column) -> Column:
    """What `encrypted` made, in plain; text without the prefix passes through."""
    plain = F.decode(F.aes_decrypt(F.unbase64(F.substring(text, 5, 1 << 30)), F.unhex(F.sha2(key, 256)), F.lit("GCM")), "UTF-8")
    return F.when(text.startswith("enc:"), plain).otherwise(text)


def indicator_table(df: DataFrame, text: str = "message") -> DataFrame:
    """One row per (row of df, indicator)."""
    return df.withColumn("_i", F.explode(iocs(F.col(text)))).select(*df.columns, "_i.*")


def aggregate_indicators(found: DataFrame) -> DataFrame:
    """Per (value, type): events, first and last time, mean confidence of at most 0.99, the usual threat type."""
    return found.groupBy("value", "type").agg(
        F.count(F.lit(1)).alias("related_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.least(F.lit(0.99), F.avg("confidence")).alias("confidence"), F.mode("threat_type", deterministic=True).alias("threat_type"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: tuple = ("value", "type"), order: str = "seen_at") -> DataFrame:
    """The newest row per key."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert_into(table: KeyedTable, number: int, new: DataFrame, order: str = "seen_at") -> list[int]:
    """Change `number` of a keyed table: the newest row per key, of what it holds and `new`. Only the buckets of the new keys
    are read and written; their numbers are returned. An older row changes nothing, and a change made again is the same."""
    new = staged(new.select(*table.schema.names), "new")
    old = table.of(new.select(*table.key), number - 1)
    return table.replace(number, upsert(old, new, table.key, order))
