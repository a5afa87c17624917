"""Queries: template mining, dictionary, ids, lookup joins (L6-L10) and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.functions import parsing
from blockwatch.operators import templates as TP
from blockwatch.plans.catalog import register, sql
from blockwatch.plans.sqlviews import cte
from blockwatch.session import written
from blockwatch.sources import views

_LOG_RE = parsing.LOG_LINE_PATTERN.replace("'", "''")
_IP_RE = parsing.IP_PATTERN

cte("v_parsed", f"""
SELECT line_no, regexp_extract(value, '{_LOG_RE}', 3) AS level,
       regexp_extract(value, '{_LOG_RE}', 4) AS content,
       CASE WHEN regexp_extract(value, '{_LOG_RE}', 1) = '-' THEN 'success' ELSE 'fail' END AS status
FROM v_raw WHERE regexp_matches(value, '{_LOG_RE}')""", "v_raw")


def _template_ctes(name: str, src: str, key: str, dep: str) -> None:
    """The CTE ``name`` (``key`` columns, template): rounds of grouping and splitting, unrolled."""
    rounds = []
    for k in range(TP.DEFAULT_ROUNDS):
        rounds.append(f"""
ps{k} AS (SELECT gk, i, count(DISTINCT tok) AS nd, min(tok) AS tok
          FROM (SELECT gk, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM dl{k}) GROUP BY gk, i),
gs{k} AS MATERIALIZED (SELECT gk, count_if(nd = 1)::DOUBLE / count(*) >= 0.8 AS done,
              min(nd * 1000000 + i) FILTER (nd > 1) % 1000000 AS split,
              string_agg(CASE WHEN nd = 1 THEN tok ELSE '<*>' END, ' ' ORDER BY i) AS gtpl
       FROM ps{k} GROUP BY gk),
dl{k + 1} AS MATERIALIZED (SELECT masked, toks, gk || chr(1) || split || chr(1) || toks[split + 1] AS gk
       FROM dl{k} JOIN gs{k} USING (gk) WHERE NOT done)""")
    ends = " UNION ALL ".join(f"SELECT masked, gtpl AS template FROM dl{k} JOIN gs{k} USING (gk) WHERE done"
                              for k in range(TP.DEFAULT_ROUNDS))
    cte(name, f"""
WITH m AS ({src}),
g AS (SELECT *, array_to_string(toks, ' ') AS masked,
             len(toks)::VARCHAR || chr(1) || coalesce(toks[1], '') || chr(1) || coalesce(toks[2], '') AS gk
      FROM m),
dl0 AS MATERIALIZED (SELECT DISTINCT masked, toks, gk FROM g WHERE len(toks) > 0),{",".join(rounds)},
found AS ({ends})
SELECT {key}, coalesce(template, masked) AS template FROM g LEFT JOIN found USING (masked)""", dep)


_template_ctes("v_mined", f"""
SELECT line_no, status,
       list_transform(list_filter(regexp_split_to_array(regexp_replace(content, '{_IP_RE}', '<*>', 'g'),
                                                        '[ \\t\\n\\r\\f]+'), lambda x: x <> ''),
                      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
FROM v_parsed""", "line_no, status", "v_parsed")

cte("v_template_ids", """
SELECT template, occurrences, substr(md5(template), 1, 8) AS event_id,
       'E' || row_number() OVER (ORDER BY occurrences DESC, template) AS template_id
FROM (SELECT template, count(*) AS occurrences FROM v_mined GROUP BY template)""", "v_mined")


def _parsed(spark, sf):
    p = parsing.parse_lines(views.raw_lines(spark, sf), "value")
    return p.select("line_no", "p.level", "p.content", "p.status")


def _mined(spark, sf):
    return written(TP.mine_templates(_parsed(spark, sf)), "mined-lines")  # several branches read it


@register("mine_templates", sql("SELECT line_no, template FROM v_mined", "v_mined"))
def mine_templates(spark, sf):
    return _mined(spark, sf).select("line_no", "template")


@register("template_dictionary", sql("""
SELECT template, substr(md5(template), 1, 8) AS event_id, count(*)::BIGINT AS occurrences
FROM v_mined GROUP BY template""", "v_mined"))
def template_dictionary(spark, sf):
    return TP.template_dictionary(_mined(spark, sf)).select("template", "event_id", "occurrences")


@register("template_ids", sql("""
SELECT template, event_id, occurrences::BIGINT AS occurrences, template_id FROM v_template_ids""",
                              "v_template_ids"))
def template_ids(spark, sf):
    d = TP.template_dictionary(_mined(spark, sf))
    return TP.number_templates(d).select("template", "event_id", "occurrences", "template_id")


@register("template_lookup_join", sql("""
WITH lk AS (SELECT event_id, min_by(template_id, occurrences) AS template_id
            FROM v_template_ids GROUP BY event_id)
SELECT m.line_no, substr(md5(m.template), 1, 8) AS event_id, lk.template_id
FROM v_mined m LEFT JOIN lk ON substr(md5(m.template), 1, 8) = lk.event_id""", "v_mined", "v_template_ids"))
def template_lookup_join(spark, sf):
    mined = _mined(spark, sf).withColumn("event_id", TP.event_id())
    ids = TP.number_templates(TP.template_dictionary(mined.select("template")))
    lookup = TP.first_per_key(ids, "event_id", "template_id", "occurrences")
    return TP.lookup_join(mined.select("line_no", "event_id"), lookup, "event_id")


@register("positional_join", sql("""
SELECT p.line_no, p.level, p.content, m.template
FROM v_parsed p JOIN v_mined m ON p.line_no = m.line_no""", "v_parsed", "v_mined"))
def positional_join(spark, sf):
    parsed = _parsed(spark, sf)
    mined = TP.mine_templates(parsed.select("line_no", "content")).select("line_no", "template")
    return parsed.select("line_no", "level", "content").join(mined, "line_no")


@register("preprocess_end_to_end", sql("""
WITH t AS (SELECT m.line_no, m.status, i.template_id,
                  row_number() OVER (ORDER BY m.line_no) - 1 AS pos
           FROM v_mined m JOIN v_template_ids i USING (template))
SELECT (pos // 20 + 1)::BIGINT AS block_id,
       CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'fail' END AS status,
       count(*)::BIGINT AS n_lines, string_agg(template_id, ' ' ORDER BY pos) AS event_list
FROM t GROUP BY 1""", "v_mined", "v_template_ids"))
def preprocess_end_to_end(spark, sf):
    from blockwatch.plans.detectors import preprocess
    blocks = preprocess(views.raw_lines(spark, sf), block_size=20)
    return blocks.select(F.col("block_id").cast("bigint"), "status", F.col("n_lines").cast("bigint"),
                         F.array_join("event_list", " ").alias("event_list"))


# ---- L6 over whole document texts: every line of every document is a message -----------------

cte("v_doc_lines", """
SELECT doc_id, i - 1 AS line_idx, split_part_list[i] AS content
FROM (SELECT doc_id, string_split(text, chr(10)) AS split_part_list FROM documents),
     LATERAL (SELECT unnest(generate_series(1, len(split_part_list))) AS i)""")

_template_ctes("v_doc_mined", f"""
SELECT doc_id, line_idx,
       list_filter(regexp_split_to_array(
           regexp_replace(regexp_replace(content, '{_IP_RE}', '<*>', 'g'),
                          '[^ \\t\\n\\r\\f]*[0-9][^ \\t\\n\\r\\f]*', '<*>', 'g'),
           '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS toks
FROM v_doc_lines""", "doc_id, line_idx", "v_doc_lines")


@register("mine_templates_text", sql("""
SELECT doc_id, line_idx::BIGINT AS line_idx, template FROM v_doc_mined""", "v_doc_mined"))
def mine_templates_text(spark, sf):
    from blockwatch.sources.tables import read_table
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    doc_lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "content"))
    mined = TP.mine_templates(doc_lines)
    return mined.select("doc_id", F.col("line_idx").cast("bigint"), "template")
