"""Queries of the excerpt pipeline over ``documents``: source is the entity, doc_id the file order, and the day follows from it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import excerpts as X
from ..queries import query
from ..session import table

PATTERN = r"(?i)the\s+\w+"
SPEC = X.ExcerptSpec(PATTERN, 2, 2, 20, 5, 5, question="\nQuestion: What is named here?\n")
TIERED = replace(SPEC, limit=12, recent=2, distant=4, blocks_per_note=10, exclude="(?i)moron", priority="(?i)the\\s+on", keep_empty=True)
CHUNKED = replace(SPEC, chunk=True, question="", day_format="yyyy", label="YYYY")
RECENT = replace(SPEC, limit=15, recent=6, distant=0)
ADAPTIVE = replace(SPEC, before=1, before_few=6, few_notes=49)


def notes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    return t.select(F.col("source").alias("entity"), F.col("doc_id").alias("row_no"), day.alias("day"), "text")


_NOTES = """notes AS (
  SELECT source AS entity, doc_id AS row_no, CAST(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS DATE) AS day,
         regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, count(*) OVER (PARTITION BY source) AS n_notes
  FROM documents),
hit AS (
  SELECT n.*, regexp_extract_all(text, '(?i)the\\s+\\w+') AS ms, string_split_regex(text, '(?i)the\\s+\\w+') AS gs,
         string_split(text, chr(10)) AS lines
  FROM notes n WHERE regexp_matches(text, '(?i)the\\s+\\w+')),
posn AS (
  SELECT h.*, i, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st
  FROM hit h, unnest(range(1, len(ms) + 1)) AS u(i)),
span AS (
  SELECT *, st + length(m) AS en, st - length(replace(substr(text, 1, CAST(st AS BIGINT)), chr(10), '')) AS l0,
         st + length(m) - 1 - length(replace(substr(text, 1, CAST(st + length(m) - 1 AS BIGINT)), chr(10), '')) AS l1
  FROM posn)"""


def _sql_blocks(before: str, after: int, cap: int) -> str:
    return f"""{_NOTES},
ln AS (SELECT DISTINCT entity, row_no, day, n_notes, lines, unnest(range(CAST(l0 AS BIGINT), CAST(l1 AS BIGINT) + 1)) AS line FROM span),
gp AS (SELECT *, {before} AS bf, CASE WHEN line - lag(line) OVER w <= {before} + 2 * {after} THEN 0 ELSE 1 END AS fresh FROM ln WINDOW w AS (PARTITION BY row_no ORDER BY line)),
ig AS (SELECT *, sum(fresh) OVER (PARTITION BY row_no ORDER BY line) AS isle FROM gp),
rg AS (SELECT entity, row_no, day, CAST(isle - 1 AS INTEGER) AS block_no, greatest(min(line) - min(bf), 0) AS s, least(max(line) + {after}, len(any_value(lines))) AS e, any_value(lines) AS lines
       FROM ig GROUP BY entity, row_no, day, isle),
blk AS (SELECT entity, row_no, day, block_no, s, e, array_to_string(lines[CAST(s + 1 AS BIGINT):CAST(e + 1 AS BIGINT)], chr(10)) AS excerpt FROM rg WHERE block_no < {cap})"""


_KEY = "lower(regexp_replace(excerpt, '^\\s+|\\s+$', '', 'g'))"


def _sql_excerpts(spec: X.ExcerptSpec, fmt: str) -> str:
    few = spec.before if spec.before_few is None else spec.before_few
    before = f"CASE WHEN n_notes <= {spec.few_notes} THEN {few} ELSE {spec.before} END"
    drop = f"WHERE NOT regexp_matches(excerpt, '{spec.exclude}')" if spec.exclude else ""
    prio = f"regexp_matches(excerpt, '{spec.priority}')" if spec.priority else "FALSE"
    return f"""{_sql_blocks(before, spec.after, spec.blocks_per_note)},
uq AS (SELECT * FROM blk {drop} QUALIFY row_number() OVER (PARTITION BY entity, {_KEY} ORDER BY row_no, block_no) = 1),
ex AS (SELECT entity, row_no, block_no, strftime(day, '{fmt}') AS day_label, excerpt, {prio} AS is_priority,
        chr(10) || '<<<' || chr(10) || 'Note date ({spec.label}): ' || strftime(day, '{fmt}') || chr(10) || 'Note text:' || chr(10) || excerpt || chr(10) || '>>>' || chr(10) AS rendered FROM uq)"""


def _sql_selected(spec: X.ExcerptSpec) -> str:
    return f"""{_sql_excerpts(spec, '%Y-%m')},
s1 AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, sum(CAST(is_priority AS INTEGER)) OVER (PARTITION BY entity) AS p,
       row_number() OVER (PARTITION BY entity, is_priority ORDER BY rendered, row_no, block_no) AS up FROM ex),
s2 AS (SELECT *, CASE WHEN is_priority THEN 0 WHEN up <= {spec.distant} OR up > n - p - {spec.recent} THEN 1 ELSE 2 END AS kind FROM s1),
s3 AS (SELECT *, sum(CAST(kind = 1 AS INTEGER)) OVER (PARTITION BY entity) AS e1,
       row_number() OVER (PARTITION BY entity, kind ORDER BY md5('{spec.seed}|' || entity || '|' || rendered), row_no, block_no) AS lot FROM s2),
sel AS (SELECT * FROM s3 WHERE CASE WHEN n <= {spec.limit} THEN TRUE WHEN p + e1 <= {spec.limit} THEN kind < 2 OR lot <= {spec.limit} - p - e1
        WHEN p < {spec.limit} THEN kind = 0 OR (kind = 1 AND lot <= {spec.limit} - p) ELSE kind = 0 AND lot <= {spec.limit} END)"""


@query("note_counts_per_entity", "SELECT source AS entity, doc_id AS row_no, count(*) OVER (PARTITION BY source) AS n_notes FROM documents")
def note_counts_per_entity(spark, d):
    return X.note_counts(notes(spark, d)).select("entity", "row_no", "n_notes")


@query("newline_normalize", "SELECT doc_id AS row_no, md5(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), '\\n')) AS digest FROM documents")
def newline_normalize(spark, d):
    return X.whole_note_prompts(notes(spark, d)).select("row_no", F.md5("prompt").alias("digest"))


@query("whole_note_prompts", "SELECT doc_id AS row_no, md5(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) || 'Answer:', chr(10), '\\n')) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def whole_note_prompts(spark, d):
    p = X.whole_note_prompts(notes(spark, d), "\nAnswer:").join(notes(spark, d).select("row_no", F.length("text").cast("long").alias("n")), "row_no")
    return p.select("row_no", F.md5("prompt").alias("digest"), "n")


@query("line_split_offsets", "SELECT doc_id AS row_no, CAST(i - 1 AS INTEGER) AS line, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start, CAST(length(ls[i]) AS INTEGER) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)")
def line_split_offsets(spark, d):
    return X.line_offsets(notes(spark, d)).select("row_no", "line", F.col("start").cast("long").alias("start"), F.length("line_text").alias("n"))


@query("regex_match_offsets", f"WITH {_NOTES} SELECT row_no, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS \"end\" FROM span")
def regex_match_offsets(spark, d):
    n = notes(spark, d).withColumn("text", X.normalize_newlines(F.col("text")))
    return X.match_offsets(n, PATTERN).select("row_no", F.explode("hits").alias("h")).select("row_no", "h.start", "h.end")


@query("match_line_set", f"WITH {_NOTES} SELECT DISTINCT row_no, CAST(unnest(range(CAST(l0 AS BIGINT), CAST(l1 AS BIGINT) + 1)) AS INTEGER) AS line FROM span")
def match_line_set(spark, d):
    n = notes(spark, d).withColumn("text", X.normalize_newlines(F.col("text")))
    return X.match_lines(n, PATTERN).select("row_no", "line")


_BLOCK_COLUMNS = "entity, row_no, block_no, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", md5(excerpt) AS digest"


@query("merge_context_blocks", f"WITH {_sql_blocks('2', 2, 15)} SELECT {_BLOCK_COLUMNS} FROM blk")
def merge_context_blocks(spark, d):
    return X.blocks(notes(spark, d), SPEC).select("entity", "row_no", "block_no", "start", "end", F.md5("excerpt").alias("digest"))


@query("adaptive_context_blocks", f"WITH {_sql_blocks('CASE WHEN n_notes <= 49 THEN 6 ELSE 1 END', 2, 15)} SELECT {_BLOCK_COLUMNS} FROM blk")
def adaptive_context_blocks(spark, d):
    return X.blocks(notes(spark, d), ADAPTIVE).select("entity", "row_no", "block_no", "start", "end", F.md5("excerpt").alias("digest"))


@query("dedup_excerpts_first_wins", f"WITH {_sql_excerpts(SPEC, '%Y-%m')} SELECT entity, row_no, block_no, day_label, md5(excerpt) AS digest FROM ex")
def dedup_excerpts_first_wins(spark, d):
    return X.excerpts(notes(spark, d), SPEC).select("entity", "row_no", "block_no", "day_label", F.md5("excerpt").alias("digest"))


@query("exclude_predicate_blocks", f"WITH {_sql_excerpts(TIERED, '%Y-%m')} SELECT entity, count(*) AS n, sum(length(excerpt))::BIGINT AS chars FROM ex GROUP BY entity")
def exclude_predicate_blocks(spark, d):
    return X.excerpts(notes(spark, d), TIERED).groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.length("excerpt")).alias("chars"))


@query("priority_classified_excerpts", f"WITH {_sql_selected(TIERED)} SELECT entity, row_no, block_no, is_priority, md5(rendered) AS digest FROM sel")
def priority_classified_excerpts(spark, d):
    return X.select_bounded(X.excerpts(notes(spark, d), TIERED), TIERED).select("entity", "row_no", "block_no", "is_priority", F.md5("rendered").alias("digest"))


@query("select_recent_distant_sample", f"WITH {_sql_selected(SPEC)} SELECT entity, row_no, block_no, md5(rendered) AS digest FROM sel")
def select_recent_distant_sample(spark, d):
    return X.select_bounded(X.excerpts(notes(spark, d), SPEC), SPEC).select("entity", "row_no", "block_no", F.md5("rendered").alias("digest"))


@query("select_recent_sample", f"WITH {_sql_selected(RECENT)} SELECT entity, row_no, block_no, md5(rendered) AS digest FROM sel")
def select_recent_sample(spark, d):
    """The latest excerpts and a seeded choice of all others."""
    return X.select_bounded(X.excerpts(notes(spark, d), RECENT), RECENT).select("entity", "row_no", "block_no", F.md5("rendered").alias("digest"))


@query("chunk_by_20", f"""WITH {_sql_excerpts(CHUNKED, '%Y')},
nr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day_label, row_no, block_no) - 1 AS r FROM ex)
SELECT entity, CAST(r // 20 AS INTEGER) AS chunk_no, count(*) AS n_excerpts, md5(replace(string_agg(rendered, '' ORDER BY r), chr(10), '\\n')) AS digest FROM nr GROUP BY entity, r // 20""")
def chunk_by_20(spark, d):
    return X.prompts(notes(spark, d), CHUNKED).select("entity", "chunk_no", "n_excerpts", F.md5("prompt").alias("digest"))


@query("prompts_rendered", f"""WITH {_sql_selected(SPEC)}
SELECT entity, 0 AS chunk_no, count(*) AS n_excerpts, md5(p) AS digest, length(p) AS n_chars FROM (
  SELECT entity, count(*) AS n0, replace(string_agg(rendered, '' ORDER BY rendered) || chr(10) || 'Question: What is named here?' || chr(10), chr(10), '\\n') AS p FROM sel GROUP BY entity) t, unnest(range(n0)) GROUP BY entity, p""")
def prompts_rendered(spark, d):
    return X.prompts(notes(spark, d), SPEC).select("entity", "chunk_no", "n_excerpts", F.md5("prompt").alias("digest"), F.length("prompt").cast("long").alias("n_chars"))


@query("prompts_tiered", f"""WITH {_sql_selected(TIERED)}, asked AS (SELECT DISTINCT entity FROM hit)
SELECT a.entity, md5(replace(coalesce(string_agg(rendered, '' ORDER BY rendered), '') || chr(10) || 'Question: What is named here?' || chr(10), chr(10), '\\n')) AS digest, count(rendered) AS n_excerpts
FROM asked a LEFT JOIN sel ON sel.entity = a.entity GROUP BY a.entity""")
def prompts_tiered(spark, d):
    return X.prompts(notes(spark, d), TIERED).select("entity", F.md5("prompt").alias("digest"), "n_excerpts")


@query("semi_join_whitelist", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_whitelist(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("anti_join_blacklist", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_blacklist(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("union_shards_distinct", "SELECT lang, source FROM documents WHERE doc_id % 3 = 0 UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 1 UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 2")
def union_shards_distinct(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "source")
    parts = [t.filter(F.col("doc_id") % 3 == i).drop("doc_id") for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("positional_zip", "SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels) b ON a.n = b.n")
def positional_zip(spark, d):
    from ..operators.joins import zip_by_order

    a = table(spark, d, "documents").select(F.col("doc_id").alias("left_id"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("right_id"))
    return zip_by_order(a, b, ["left_id"], ["right_id"]).select("left_id", "right_id", "n")


@query("manifest_left_join_status", """WITH m AS (SELECT item_id, sha256(text) AS want FROM benchmark), f AS (SELECT DISTINCT sha256(text) AS got FROM documents UNION SELECT sha256(text) FROM benchmark WHERE item_id % 2 = 0)
SELECT item_id, got IS NULL AS missing, got IS NOT NULL AS valid FROM m LEFT JOIN f ON want = got""")
def manifest_left_join_status(spark, d):
    from ..operators.joins import manifest_status

    b = table(spark, d, "benchmark")
    m = b.select("item_id", F.sha2("text", 256).alias("digest"))
    f = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")).union(b.filter(F.col("item_id") % 2 == 0).select(F.sha2("text", 256)))
    return manifest_status(m, f, "digest").select("item_id", "missing", "valid")
