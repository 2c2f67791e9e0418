"""Queries of indicators, personal data, formats and templates on free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.functions.staging import spread
from threatframe.operators import indicators, templates
from threatframe.queries import query
from threatframe.sources.security import security_events


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document with a word in it."""
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


# Tokens are split at the characters that the pattern's borders exclude, then matched whole.
_IP = r"""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_.]+')) AS w FROM documents),
 ip AS (SELECT doc_id, w AS value FROM t WHERE regexp_full_match(w, '(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}') AND list_max(list_transform(string_split(w, '.'), lambda x: CAST(x AS INT))) <= 255 AND w NOT IN ('0.0.0.0', '255.255.255.255', '127.0.0.1'))"""


@query("c01_extract_ipv4", _IP + " SELECT DISTINCT doc_id, value FROM ip", sec=False)
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.indicator_table(documents(spark, sf), "text").filter("type = 'ipv4'").select("doc_id", "value")


_V4 = r"(regexp_full_match({0}, '(0|[1-9][0-9]{{0,2}})(\.(0|[1-9][0-9]{{0,2}})){{3}}') AND list_max(list_transform(string_split({0}, '.'), lambda x: TRY_CAST(x AS INT))) <= 255 AND {0} NOT IN ('0.0.0.0', '255.255.255.255', '127.0.0.1'))"
_NAME = r"(length({0}) <= 253 AND regexp_full_match({0}, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,24}}') AND split_part({0}, '.', -1) NOT IN ({1}))"
_NAME = _NAME.replace("{1}", ", ".join(f"'{e}'" for e in indicators.FILE_ENDINGS))
_OWN = r"(starts_with({0}, '10.') OR starts_with({0}, '192.168.') OR regexp_matches({0}, '^172\.(1[6-9]|2[0-9]|3[01])\.') OR starts_with({0}, '127.') OR starts_with({0}, '169.254.') OR starts_with({0}, '0.') OR starts_with({0}, '192.0.2.') OR regexp_matches({0}, '^192\.0\.0\.[0-7]$') OR regexp_matches({0}, '^198\.1[89]\.') OR starts_with({0}, '198.51.100.') OR starts_with({0}, '203.0.113.') OR TRY_CAST(split_part({0}, '.', 1) AS INT) >= 240)"
_RUNS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_@./-]+[=(\x27]?')"
_PLAIN = _RUNS.format(r"""regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])(?:v|version)\s*"?(?:[0-9]{1,3}\.){3}[0-9]{1,3}', '\1 ', 'g')""")
_TEXT = _RUNS.format(r"regexp_replace(text, '(?is)<script\b.*?</script>', ' ', 'g')")
_HOST = r"lower(regexp_extract(url, '(?i)^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#\[]+)', 1))"
#: The extractor's definition over documents and pages; neither holds IPv6 addresses, for which tests stand in.
ALL_IOCS = rf"""WITH src AS (SELECT CAST(doc_id AS STRING) AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT CAST(page_id AS STRING), concat_ws(' ', url, html) FROM pages),
 u AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?i)https?://[^\s"\x27<>\\]+')) AS url FROM src),
 h AS (SELECT id, url, {_HOST} AS host FROM u),
 g AS (SELECT * FROM h WHERE {_V4.format("host")} OR {_NAME.format("host")}),
 r AS (SELECT id, unnest({_PLAIN}) AS c FROM src),
 n AS (SELECT id, unnest(string_split_regex(c, '[@/=(\x27-]')) AS v FROM r WHERE contains(c, '.') UNION ALL SELECT id, host FROM g),
 d AS (SELECT id, lower(unnest({_TEXT})) AS v FROM src UNION ALL SELECT id, host FROM g),
 x AS (SELECT id, lower(unnest(regexp_extract_all(text, '[0-9a-fA-F]{{32,}}'))) AS v FROM src)
 SELECT id, 'url' AS type, url AS value, CAST(0.95 AS DOUBLE) AS confidence, CAST(NULL AS BOOLEAN) AS private, host FROM g
 UNION SELECT id, 'ipv4', v, CAST(0.99 AS DOUBLE), {_OWN.format("v")}, NULL FROM n WHERE {_V4.format("v")}
 UNION SELECT id, 'domain', v, CAST(0.85 AS DOUBLE), NULL, NULL FROM d WHERE {_NAME.format("v")}
 UNION SELECT id, CASE length(v) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END, v, CAST(0.99 AS DOUBLE), NULL, NULL FROM x WHERE length(v) IN (32, 40, 64)"""  # fmt: skip


@query("c01_extract_all", ALL_IOCS, sec=False)
def c01b(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid indicator of every document and page."""
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").cast("string").alias("id"), F.concat_ws(" ", "url", "html").alias("text")))
    both = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(pages)
    return indicators.indicator_table(both, "text").select("id", "type", "value", "confidence", "private", "host")


@query("c02_private_addresses", _IP + " SELECT DISTINCT value, starts_with(value, '10.') OR starts_with(value, '192.168.') OR regexp_matches(value, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR starts_with(value, '127.') OR starts_with(value, '169.254.') OR starts_with(value, '0.') OR starts_with(value, '192.0.2.') OR regexp_matches(value, '^192\\.0\\.0\\.[0-7]$') OR regexp_matches(value, '^198\\.1[89]\\.') OR starts_with(value, '198.51.100.') OR starts_with(value, '203.0.113.') OR CAST(split_part(value, '.', 1) AS INT) >= 240 AS private FROM ip", sec=False)
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.indicator_table(documents(spark, sf), "text").filter("type = 'ipv4'").select("value", "private").distinct()


@query("c03_suspicious_flags", "SELECT page_id, regexp_matches(html, '(?i)<script\\b[^>]*>|javascript:|onerror\\s*=') AS xss FROM pages", sec=False)
def c03(spark: SparkSession, sf: str) -> DataFrame:
    flags = indicators.suspicious(F.col("html"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.array_contains(flags, "xss_pattern").alias("xss"))


#: Mail addresses of documents: runs with one @ whose domain is a name.
_MAIL = rf"""WITH r AS (SELECT DISTINCT doc_id, trim(unnest(string_split_regex(text, '[^\p{{L}}\p{{M}}\p{{N}}._%+@-]+')), '.-%+') AS value FROM documents), t AS (SELECT doc_id, value FROM r
 WHERE len(string_split(value, '@')) = 2 AND split_part(value, '@', 1) <> '' AND regexp_full_match(value, '[ -~]+') AND {_NAME.format("lower(split_part(value, '@', 2))")})"""


@query("c04_detect_email", _MAIL + " SELECT DISTINCT doc_id, value FROM t", sec=False)
def c04(spark: SparkSession, sf: str) -> DataFrame:
    hits = documents(spark, sf).select("doc_id", F.explode(indicators.personal(F.col("text"))).alias("h"))
    return hits.filter("h.type = 'EMAIL'").select("doc_id", "h.value")


#: Words in order, with labels parted from their values; a value follows a label of one word or of two.
_LABELS = "{'password': 'PASSWORD', 'passwd': 'PASSWORD', 'pwd': 'PASSWORD', 'apikey': 'API_KEY', 'clientsecret': 'API_KEY', 'secretkey': 'API_KEY', 'token': 'TOKEN', 'bearer': 'TOKEN', 'authorization': 'TOKEN', 'sessionid': 'SESSION_ID', 'account': 'ACCOUNT_NUMBER', 'accountnumber': 'ACCOUNT_NUMBER', 'iban': 'IBAN'}"
_NAMED = rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '(?i)(password|passwd|pwd|apikey|key|secret|token|bearer|authorization|sessionid|id|account|number|iban)["'']?\s*[:=#]+', '\1 ', 'g'), '[\s"'',;]+'), lambda x: x <> '') AS ws FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w), b AS (SELECT doc_id, i, ws, lower(translate(ws[i], '_-', '')) AS one, lower(translate(concat(ws[i], ws[i + 1]), '_-', '')) AS two FROM p),
 l AS (SELECT doc_id, MAP {_LABELS}[one] AS type, ws[i + 1] AS value FROM b UNION ALL SELECT doc_id, MAP {_LABELS}[two], ws[i + 2] FROM b),
 k AS (SELECT doc_id, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}_-]+')) AS value FROM documents)
 SELECT DISTINCT doc_id, CASE type WHEN 'IBAN' THEN 'ACCOUNT_NUMBER' ELSE type END AS type, value, CAST(CASE type WHEN 'PASSWORD' THEN 0.97 WHEN 'API_KEY' THEN 0.95 WHEN 'TOKEN' THEN 0.93 WHEN 'SESSION_ID' THEN 0.93 ELSE 0.9 END AS DOUBLE) AS confidence FROM l
 WHERE (type = 'PASSWORD' AND length(value) >= 4) OR (type = 'API_KEY' AND length(value) >= 8) OR (type = 'TOKEN' AND regexp_full_match(value, '[A-Za-z0-9._-]{{16,}}')) OR (type = 'SESSION_ID' AND regexp_full_match(value, '[A-Za-z0-9-]{{8,}}'))
  OR (type = 'ACCOUNT_NUMBER' AND regexp_full_match(value, '[0-9]{{6,17}}')) OR (type = 'IBAN' AND regexp_full_match(value, '[A-Za-z]{{2}}[A-Za-z0-9]{{13,32}}'))
 UNION SELECT doc_id, 'API_KEY', value, 0.95 FROM k WHERE (starts_with(value, 'AKIA') AND length(value) = 20 AND upper(value) = value) OR (starts_with(value, 'sk-') AND length(value) >= 23)
 UNION SELECT doc_id, 'EMPLOYEE_ID', value, 0.95 FROM k WHERE starts_with(lower(value), 'emp') AND regexp_full_match(substr(value, 4), '-?[0-9]{{4,8}}')"""


@query("c04_detect_named", _NAMED, sec=False)
def c04c(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets and numbers that a label before them, or their own prefix, tells."""
    hits = documents(spark, sf).select("doc_id", F.explode(indicators.personal(F.col("text"))).alias("h")).select("doc_id", "h.*")
    return hits.filter("type NOT IN ('EMAIL', 'PHONE', 'NAME')")


@query("c04_detect_all")
def c04b(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.explode(indicators.personal(F.col("text"))).alias("h")).select("doc_id", "h.*")  # held against brute force in the tests


def _without_mails(mark: str) -> str:
    return _MAIL + f""", m AS (SELECT doc_id, list(value ORDER BY length(value) DESC, value) AS ms FROM t GROUP BY doc_id)
 SELECT doc_id, list_reduce(list_prepend(text, coalesce(ms, [])), lambda x, y: replace(x, y, '{mark}')) AS text FROM documents LEFT JOIN m USING (doc_id)"""


@query("c05_redact_email", _without_mails("[EMAIL_REDACTED]"), sec=False)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.filter(indicators.personal(F.col("text")), lambda h: h.type == "EMAIL")
    return documents(spark, sf).select("doc_id", indicators.redacted(F.col("text"), None, hits).alias("text"))


@query("c06_output_gate")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    gated = indicators.gate(documents(spark, sf).select("doc_id", F.col("text").alias("message")))
    return gated.select("doc_id", F.array_join("pii_detected", ",").alias("categories"), F.length("message").alias("length"))


@query("c07_encrypt_round_trip", "SELECT doc_id, coalesce(length(text), 0) AS length, true AS same FROM documents", sec=False)
def c07(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lit("a key for tests")
    d = documents(spark, sf).withColumn("stored", indicators.encrypted(F.col("text"), key))
    return d.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), (indicators.decrypted(F.col("stored"), key).eqNullSafe(F.col("text")) & ~F.coalesce(F.col("stored") == F.col("text"), F.lit(False))).alias("same"))


@query("c08_enrichment_counters", _IP + " SELECT count(*) AS ipv4_hits, count(DISTINCT doc_id) AS texts, count(DISTINCT value) AS different FROM (SELECT DISTINCT doc_id, value FROM ip)", sec=False)
def c08(spark: SparkSession, sf: str) -> DataFrame:
    hits = indicators.indicator_table(documents(spark, sf), "text").filter("type = 'ipv4'")
    return hits.agg(F.count(F.lit(1)).alias("ipv4_hits"), F.count_distinct("doc_id").alias("texts"), F.count_distinct("value").alias("different"))


INDICATORS = """SELECT src_ip AS value, 'ipv4' AS type, count(*) AS related_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, mode(event_type) AS common FROM sec"""


@query("e03_indicator_aggregation", "WITH c AS (SELECT src_ip AS value, event_type, count(*) AS n FROM sec GROUP BY ALL), m AS (SELECT value, arg_max(event_type, (n, event_type)) AS t FROM c GROUP BY value) SELECT src_ip AS value, count(*) AS related_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, CAST(0.99 AS DOUBLE) AS confidence FROM sec GROUP BY src_ip")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    e = security_events(spark, sf).withColumn("threat_type", F.col("event_type")).withColumn("text", F.concat(F.lit("seen "), "src_ip"))
    agg = indicators.aggregate_indicators(indicators.indicator_table(e, "text").filter("type = 'ipv4'"))
    return agg.select("value", "related_events", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.round("confidence", 6).alias("confidence"))


@query("e04_indicator_upsert", "SELECT src_ip AS value, max(epoch_us(ts)) AS seen_at, arg_max(event_id, (ts, event_id)) AS event_id FROM sec GROUP BY src_ip")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    rows = security_events(spark, sf).select(F.col("src_ip").alias("value"), F.unix_micros("ts").alias("seen_at"), "event_id")
    half = F.col("event_id") % 2 == 0
    return indicators.upsert(rows.filter(half), rows.filter(~half), ("value",)).select("value", "seen_at", "event_id")


@query("e05_job_ioc_list", _IP + " SELECT value, count(DISTINCT doc_id) AS n FROM ip GROUP BY value ORDER BY n DESC, value", sec=False)
def e05(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.indicator_table(documents(spark, sf), "text").filter("type = 'ipv4'").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


@query("d06_ioc_type_filter", _IP + " SELECT DISTINCT doc_id FROM ip", sec=False)
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).filter(F.exists(indicators.iocs(F.col("text")), lambda i: i.type == "ipv4")).select("doc_id")


_FOUND_IP = _IP.replace("WITH t AS", "WITH p AS (SELECT doc_id, regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])(?:v|version)\\s*\"?(?:[0-9]{1,3}\\.){3}[0-9]{1,3}', '\\1 ', 'g') AS text FROM documents), t AS").replace("AS w FROM documents)", "AS w FROM p)")


@query("e26_extraction_quality", _FOUND_IP + f""", found AS (SELECT DISTINCT doc_id, value FROM ip), all_words AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_.]+')) AS value FROM documents), truth AS (SELECT * FROM all_words WHERE {_V4.format("value")}),
 j AS (SELECT t.value AS t, f.value AS f FROM truth t FULL JOIN found f USING (doc_id, value)), c AS (SELECT count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM j)
 SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c""", sec=False)  # fmt: skip
def e26(spark: SparkSession, sf: str) -> DataFrame:
    """The extractor's addresses against an independent labelling: every word of address characters that is four octets."""
    from threatframe.operators import quality

    d = documents(spark, sf)
    hits = indicators.indicator_table(d, "text").filter("type = 'ipv4'").select("doc_id", "value")
    words = d.select("doc_id", F.explode(F.split("text", "[^A-Za-z0-9_.]+")).alias("value")).distinct()
    octets = F.transform(F.split("value", r"\."), lambda o: F.when(o.rlike("^(0|[1-9][0-9]{0,2})$"), o.cast("int")))
    truth = words.filter((F.size(octets) == 4) & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False))) & ~F.col("value").isin("0.0.0.0", "255.255.255.255", "127.0.0.1"))
    return quality.extraction(hits, truth, ["doc_id", "value"]).select("tp", "fp", "fn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query("e27_redaction_effectiveness", _MAIL + " SELECT count(*) AS labelled, CAST(1.0 AS DOUBLE) AS share FROM (SELECT DISTINCT doc_id, value FROM t)", sec=False)
def e27(spark: SparkSession, sf: str) -> DataFrame:
    from threatframe.operators import quality

    d = documents(spark, sf)
    words = F.transform(F.split("text", r"[\s#*&|<>$%]+"), lambda w: F.btrim(w, F.lit(".,;:!?()")))
    labels = d.select("doc_id", F.explode(F.array_distinct(F.filter(words, lambda w: w.contains("@")))).alias("value"))
    clean = d.select("doc_id", indicators.redacted(F.col("text")).alias("text"))
    return quality.redaction(clean, labels, "doc_id", "text")


_MASK = "line"
for _p, _m in templates.MASKS:
    _MASK = "regexp_replace({}, '{}', '{}', 'g')".format(_MASK, _p, _m.replace("$3", "\\3"))
MINED = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM documents), m AS (SELECT line, {_MASK} AS mask FROM l WHERE trim(line) <> ''),
 k AS (SELECT mask, list_filter(string_split_regex(mask, '[ \\t]+'), lambda x: x <> '') AS toks FROM m), c AS (SELECT len(toks) AS n_tokens, array_to_string(toks[1:2], ' ') AS head, mask, count(*) AS n FROM k GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_tokens, head ORDER BY n DESC, mask) AS place, sum(n) OVER (PARTITION BY n_tokens, head) AS support FROM c)"""  # fmt: skip


@query("b08_mine_templates", MINED + " SELECT CAST(n_tokens AS INT) AS n_tokens, head, mask AS template, CAST(support AS BIGINT) AS support FROM r WHERE place = 1 AND support >= 2", sec=False)
def b08(spark: SparkSession, sf: str) -> DataFrame:
    return templates.mine(lines(spark, sf), "line")


@query("b09_apply_templates", MINED + ", t AS (SELECT n_tokens, head, mask FROM r WHERE place = 1 AND support >= 2) SELECT CASE WHEN t.head IS NULL THEN 'generic_event' ELSE 'learned_template_event' END AS event_type, CAST(sum(c.n) AS BIGINT) AS n, count(DISTINCT t.mask) AS templates FROM c LEFT JOIN t USING (n_tokens, head) GROUP BY 1", sec=False)
def b09(spark: SparkSession, sf: str) -> DataFrame:
    all_lines = lines(spark, sf)
    out = templates.apply(all_lines, "line", templates.mine(all_lines, "line"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("template_id").alias("templates"))
