"""Personal data spans: regular expressions propose, checksums confirm, context words score.

Everything is Spark SQL expressions over one row, so a plan has no shuffle and no Python. A
pattern's matches are ``regexp_extract_all``; their places are the running lengths of the pieces
of ``split`` between them (code points, end exclusive).

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of each kind; one that
fails its check (parts of an address, Luhn, number of digits) is dropped and not tried again. The
extra kind ``iban`` is confirmed by mod 97. Spans of different kinds may overlap. Null and empty
texts have no spans; repeated rows are searched each; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import query, table

# Possessive and look-behind forms of the plain patterns: a match can only begin at the start of
# its run of characters or where the last match ended, so long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
}
#: A text without this has no match of the kind (a cheap exact test before the pattern).
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and words nearby that raise it (fixed values).
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "host|server|addr|login",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.2

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        x = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _mod97(v: Column) -> Column:
    plain = F.regexp_replace(v, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _small_part(p: Column) -> Column:
    z = F.regexp_replace(p, "^0+", "")
    return F.when(F.length(z) <= 3, F.coalesce(z.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))


def _confirmed(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(v, r"\."), _small_part),
        "card": lambda: F.when(n.between(13, 19), _luhn(_digits(v))).otherwise(F.lit(False)),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: _mod97(v),
    }[kind]()


def _located(matches: Column, pieces: Column) -> Column:
    """Matches with their places, in order."""
    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("s"), end.alias("e"), F.get(matches, i).alias("v")))).alias("out"))

    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1),
                       F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def _spans(kind: str, matches: Column, text: Column) -> Column:
    def scored(x: Column) -> Column:
        before = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.concat(text.substr(before + 1, x["s"] - before), F.lit(" "),
                                text.substr(x["e"] + 1, F.lit(CONTEXT_CHARS))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
                        F.round(score, 2).alias("score"))

    found = F.filter(_located(matches, F.split(text, PATTERNS[kind], -1)), lambda x: _confirmed(kind, x["v"]))
    return F.when(F.size(matches) > 0, F.transform(found, scored)).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row as ``row`` (a struct of its columns), its text, and ``spans`` by kind and start."""
    t = F.col("body")
    none = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(t, F.lit(NEEDED[kind])), found).otherwise(none) if kind in NEEDED else found

    # A struct keeps any column of the input apart from the names used here.
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("*", *(matches(k).alias(k) for k in PATTERNS))
    return rows.select("row", "body", F.concat(*(_spans(k, F.col(k), t) for k in PATTERNS)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by ``[KIND]``; overlapping spans become one mark
    that names the first. ``n_chars``, where there is one, follows the text; null texts stay null."""
    body = F.col("body")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], body.substr(acc["at"] + 1, x["start"] - acc["at"]),
                                   F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    found = find_spans(docs, text)
    ordered = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"], -x["end"], x["end"], x["kind"])))
    ordered = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                      x["kind"].alias("kind")))
    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda a: F.concat(a["out"], body.substr(a["at"] + 1, F.length(body))))
    clean = F.when(F.size("spans") > 0, folded).otherwise(F.col("row")[text])
    found = found.select("row", clean.alias("clean"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("clean").isNull(), F.col("row")[c])
                       .otherwise(F.length("clean").cast(kind)).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return found.select(*out)


def _joined(spans: Column, with_score: bool = False) -> Column:
    def one(x: Column) -> Column:
        parts = [x["kind"], x["start"].cast("string"), x["end"].cast("string")]
        return F.concat_ws(":", *parts, *([x["score"].cast("string")] if with_score else []))

    return F.array_join(F.transform(spans, one), ",")


# The plain patterns; RE2 needs no help with long runs.
_SQL_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", PATTERNS["iban"]),
]
_RAW = " UNION ALL ".join(
    f"SELECT doc_id, t, '{k}' AS kind, {i} AS ord, {SCORES[k]}::DOUBLE AS base, '{CONTEXT[k]}' AS near, "
    f"regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d"
    for i, (k, p) in enumerate(_SQL_PATTERNS))
_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_RAW}),
each AS (SELECT doc_id, t, kind, ord, base, near, m, p, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (
  SELECT doc_id, t, kind, ord, base, near, m[i] AS v,
         list_sum(list_transform(p[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
  FROM each),
sized AS (SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS dg,
                 replace(v, ' ', '') AS pl FROM placed),
valid AS (
  SELECT * FROM sized WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'),
                   lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
    WHEN 'phone' THEN length(dg) BETWEEN 9 AND 15
    WHEN 'card' THEN length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1),
                   lambda j: CASE WHEN j % 2 = 1 THEN dg[length(dg) - j + 1]::INT
                              WHEN dg[length(dg) - j + 1]::INT > 4 THEN dg[length(dg) - j + 1]::INT * 2 - 9
                              ELSE dg[length(dg) - j + 1]::INT * 2 END)) % 10 = 0
    ELSE array_to_string(list_transform(string_split(pl[5:] || pl[:4], ''),
                   lambda c: CASE WHEN ord(c) >= 65 THEN (ord(c) - 55)::VARCHAR ELSE c END), '')::HUGEINT % 97 = 1
    END),
scored AS (
  SELECT *, round(base + CASE WHEN regexp_matches(lower(substring(t, (greatest(s - 40, 0) + 1)::BIGINT,
                 (s - greatest(s - 40, 0))::BIGINT) || ' ' || substring(t, (e + 1)::BIGINT, 40)), near)
                 THEN {CONTEXT_GAIN} ELSE 0 END, 2) AS score FROM valid),
spans AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         count(*) FILTER (kind = 'iban') AS n_iban,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY ord, s) FILTER (kind <> 'iban') AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY ord, s) AS spans,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT || ':' || score, ',' ORDER BY ord, s) AS scored
  FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban, coalesce(scored, '') AS scored
FROM d LEFT JOIN spans USING (doc_id)
"""


@query("op1_pii", _SQL)
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = F.filter("spans", lambda x: x["kind"] != "iban")
    count = lambda kind: F.size(of(kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *(count(k) for k in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count("iban"), _joined(F.col("spans"), True).alias("scored"))
