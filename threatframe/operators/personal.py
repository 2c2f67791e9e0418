"""Personal data in free text: what a label announces, and what its own make-up tells.

Labelled values: the words of a text are read in order; a word, or two, that is a known label announces the next word, which
counts if it is made of what such a value is made of. Shaped values: runs of characters are cut out and judged by their parts:
an address by its domain, a number by the sizes of its groups of digits, a key by its prefix.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence by category.
CONFIDENCE = {"EMAIL": 0.99, "PHONE": 0.85, "PASSWORD": 0.97, "API_KEY": 0.95, "TOKEN": 0.93, "SESSION_ID": 0.93, "ACCOUNT_NUMBER": 0.9, "EMPLOYEE_ID": 0.95, "NAME": 0.7}
LEAST = 3  #: characters of a hit


class Value(NamedTuple):
    """What a labelled value is made of: a character class, and its least and largest length."""

    kind: str
    of: str
    least: int
    most: int = 10_000


ANY = r"\S"
#: Labels in small letters, without hyphens and underscores; one of two words stands as one.
LABELS = {
    **dict.fromkeys(("password", "passwd", "pwd"), Value("PASSWORD", ANY, 4)),
    **dict.fromkeys(("apikey", "clientsecret", "secretkey"), Value("API_KEY", ANY, 8)),
    **dict.fromkeys(("token", "bearer", "authorization"), Value("TOKEN", "[A-Za-z0-9._-]", 16)),
    "sessionid": Value("SESSION_ID", "[A-Za-z0-9-]", 8),
    **dict.fromkeys(("account", "accountnumber"), Value("ACCOUNT_NUMBER", "[0-9]", 6, 17)),
    "iban": Value("ACCOUNT_NUMBER", "[A-Za-z0-9]", 15, 34),
}
#: The words that labels consist of, as they are looked for in a text.
LABEL_WORDS = ("password", "passwd", "pwd", "key", "apikey", "secret", "token", "bearer", "authorization", "id", "sessionid", "account", "number", "iban")
#: What stands between a label and its value, and between words.
GAP, BREAKS = r"[\"']?\s*[:=#]+", r"[\s\"',;]+"
MARKED = ("pass", "pwd", "key", "secret", "token", "bearer", "authorization", "session", "account", "iban")
PERSON_WORDS = ("user", "users", "for")
#: One of these words and two capitalised ones after it (a line separator may end a word).
PERSON = r"(?<!\S)(?i:users?|for)\s+[A-Z][a-z]*[\x{85}\x{2028}\x{2029}]?\s+[A-Z][a-z]"
#: Runs that may be mail addresses: letters of any script belong to them, so that the end of a foreign word is none.
MAIL_RUN = r"[\p{L}\p{M}\p{N}._%+@-]+"
#: Runs of digits with at most two other characters of numbers between them, standing alone.
PHONE_RUN = r"(?<![\p{L}\p{N}_.])[+(]?[0-9](?:[-. ()]{0,2}[0-9])+(?![\p{L}\p{N}_]|[.-][0-9])"
DIGITS = r"[0-9](?:[-. ()]{0,2}[0-9]){7}"  #: what every number holds
NATIONAL = ([3, 3, 4], [5, 4], [5, 5])  #: sizes of the groups of digits of numbers without a country code


def _when(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often use reads it in its own lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(column: Column, words: tuple) -> Column:
    return reduce(lambda a, b: a | b, (column.contains(w) for w in words))


def label_gaps() -> str:
    """A pattern of a label's last word and the signs after it, which separate it from its value."""
    return rf"(?i)({'|'.join(sorted(LABEL_WORDS, key=len, reverse=True))}){GAP}"


def labelled(text: Column) -> Column:
    """ARRAY<STRUCT<type,value>> of values that a label announces."""
    words = F.filter(F.split(F.regexp_replace(text, label_gaps(), "$1 "), BREAKS), lambda w: w != "")
    bare = lambda w: F.lower(F.translate(w, "_-", ""))
    of = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.struct(F.lit(v.kind).alias("kind"), F.lit(f"^{v.of}+$").alias("of"), F.lit(v.least).alias("least"), F.lit(v.most).alias("most")))))

    def announced(x: Column):
        word, bared = lambda i: F.get(x.words, i), lambda i: F.coalesce(F.get(x.bare, i), F.lit(""))
        two = lambda i: F.concat(bared(i), bared(i + 1))
        at = F.filter(F.transform(x.words, lambda w, i: i), lambda i: bared(i).isin(*LABELS) | two(i).isin(*LABELS))
        return F.flatten(F.transform(at, lambda i: F.array(F.struct(of[bared(i)].alias("label"), word(i + 1).alias("value")), F.struct(of[two(i)].alias("label"), word(i + 2).alias("value")))))

    found = once(once(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, bare).alias("bare"))), announced)
    fits = lambda x: x.label.isNotNull() & x.value.isNotNull() & F.length(x.value).between(x.label.least, x.label.most) & F.regexp_like(x.value, x.label.of)
    iban = lambda x: (x.label.least != LABELS["iban"].least) | x.value.rlike("^[A-Za-z]{2}")
    hits = F.transform(F.filter(found, lambda x: fits(x) & iban(x)), lambda x: F.struct(x.label.kind.alias("type"), x.value.alias("value")))
    return F.when(F.lower(text).rlike("|".join(MARKED)), hits).otherwise(F.array().cast("array<struct<type:string,value:string>>"))


def mails(text: Column, good_domain) -> Column:
    """Mail addresses: one @, something before it, and a domain after it that good_domain accepts."""
    runs = F.transform(F.filter(F.regexp_extract_all(text, F.lit(MAIL_RUN), 0), lambda r: r.contains("@")), lambda r: F.btrim(r, F.lit(".-%+")))
    plain = lambda r: r.rlike("^[ -~]+$") & (F.length(r) - F.length(F.replace(r, F.lit("@"), F.lit(""))) == 1) & ~r.startswith("@")
    return _when(text.contains("@"), F.filter(runs, lambda r: plain(r) & good_domain(F.lower(F.substring_index(r, "@", -1)))))


def phones(text: Column) -> Column:
    """Numbers by their groups of digits: with a country code of one to three digits after a plus, 8 to 15 digits in at most
    five groups; without, as NATIONAL has them. A run that is none is tried in its parts between spaces."""
    runs = F.regexp_extract_all(text, F.lit(PHONE_RUN), 0)
    runs = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.when(r.contains(" "), F.split(r, " ")).otherwise(F.array().cast("array<string>")))))
    sizes = lambda r: F.transform(F.filter(F.split(r, "[^0-9]+"), lambda g: g != ""), F.length)
    sized = F.transform(runs, lambda r: F.struct(r.alias("run"), sizes(r).alias("sizes")))
    digits = lambda r: F.length(F.regexp_replace(r, "[^0-9]", ""))
    abroad = lambda x: x.run.startswith("+") & F.size(x.sizes).between(2, 5) & (F.get(x.sizes, F.lit(0)) <= 3) & digits(x.run).between(8, 15)
    home = lambda x: ~x.run.startswith("+") & reduce(lambda a, b: a | b, (x.sizes == F.array(*map(F.lit, s)) for s in NATIONAL))
    return _when(text.rlike("[0-9]{3}") & text.rlike(DIGITS), F.transform(F.filter(sized, lambda x: abroad(x) | home(x)), lambda x: x.run))


def keys(text: Column) -> Column:
    """Keys that their prefix gives away: AKIA with sixteen capitals or digits, sk- with twenty characters or more."""
    words = F.split(text, r"[^\p{L}\p{N}_-]+")
    return _when(_any(text, ("AKIA", "sk-")), F.filter(words, lambda w: (w.startswith("AKIA") & (F.length(w) == 20) & w.rlike("^[A-Z0-9]+$")) | (w.startswith("sk-") & (F.length(w) >= 23) & w.rlike("^[A-Za-z0-9_-]+$"))))


def employee_ids(text: Column) -> Column:
    """EMP, with or without a hyphen, and four to eight digits."""
    number = lambda w: F.ltrim(F.substring(w, F.lit(4), F.length(w)), F.lit("-"))
    fits = lambda w: F.lower(w).startswith("emp") & number(w).rlike("^[0-9]+$") & F.length(number(w)).between(4, 8) & (F.length(w) - F.length(number(w)) <= 4)
    return _when(F.lower(text).contains("emp"), F.filter(F.split(text, r"[^\p{L}\p{N}_-]+"), fits))


def names(text: Column) -> Column:
    """Two capitalised words of two letters or more after user, users or for."""
    words = F.split(text, r"\s+")
    cut = lambda w: F.regexp_extract(F.coalesce(w, F.lit("")), "^[A-Za-z]*", 0)
    proper = lambda w: (F.length(w).between(2, 21)) & (F.initcap(w) == w)
    at = lambda ws: lambda w, i: F.struct(F.lower(w).isin(*PERSON_WORDS).alias("asked"), F.get(ws, i + 1).alias("one"), cut(F.get(ws, i + 2)).alias("two"), F.get(ws, i + 2).alias("raw"))
    after = once(words, lambda ws: F.transform(ws, at(ws)))
    whole = lambda x: (x.raw == x.two) | x.raw.rlike(r"^[A-Za-z]+[^\p{L}\p{N}_]")
    found = F.filter(after, lambda x: x.asked & x.one.rlike("^[A-Za-z]+$") & proper(x.one) & proper(x.two) & whole(x))
    return _when(text.rlike(PERSON), F.filter(F.transform(found, lambda x: F.concat_ws(" ", x.one, x.two)), lambda v: F.contains(text, v)))


def personal(text: Column, good_domain) -> Column:
    """ARRAY<STRUCT<type,value,confidence>> of the different hits of at least LEAST characters; null gives none."""
    text = F.coalesce(text, F.lit(""))
    sure = lambda kind: F.element_at(F.create_map(*(x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v)))), kind)
    shaped = {"EMAIL": mails(text, good_domain), "PHONE": phones(text), "API_KEY": keys(text), "EMPLOYEE_ID": employee_ids(text), "NAME": names(text)}
    as_kind = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value"))
    hits = [F.transform(found, as_kind(kind)) for kind, found in shaped.items()]
    every = F.filter(F.concat(*hits, labelled(text)), lambda h: F.length(h.value) >= LEAST)
    return F.transform(F.array_distinct(every), lambda h: F.struct(h.type.alias("type"), h.value.alias("value"), sure(h.type).alias("confidence")))
