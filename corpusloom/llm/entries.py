"""Queries of the training-data operators and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, lookalikes, packing, pii, runs, sampling, splits


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: _t(spark, d, name) for name in lookalikes.FIELDS}


QUERIES = {
    "p1_found": lambda s, d: splits.found(_t(s, d, "mls_transcripts")),
    "p1_splits": lambda s, d: splits.split_related(_t(s, d, "mls_transcripts")),
    "p1_check": lambda s, d: splits.checked(_t(s, d, "mls_transcripts")),
    "p1_report": lambda s, d: splits.report(_t(s, d, "mls_transcripts")),
    "p2_found": lambda s, d: sampling.found(_t(s, d, "mls_transcripts"), _t(s, d, "sample_targets")),
    "p2_check": lambda s, d: sampling.checked(_t(s, d, "mls_transcripts"), _t(s, d, "sample_targets")),
    "p2_report": lambda s, d: sampling.report(_t(s, d, "mls_transcripts"), _t(s, d, "sample_targets")),
    "p2_sample": lambda s, d: sampling.sample(_t(s, d, "mls_transcripts"), _t(s, d, "sample_targets")),
    "p3_found": lambda s, d: runs.found(_t(s, d, "mls_aligned"), _t(s, d, "centroids")),
    "p3_runs": lambda s, d: runs.collapse(_t(s, d, "mls_aligned"), _t(s, d, "centroids")),
    "p4_found": lambda s, d: lookalikes.found(_texts(s, d)),
    "p4_classes": lambda s, d: lookalikes.classes(_texts(s, d)),
    "p4_consistent": lambda s, d: lookalikes.consistent(_texts(s, d)),
    "p5_ids": lambda s, d: bpe.encode(_t(s, d, "documents")),
    "p5_round_trip": lambda s, d: bpe.decode(bpe.encode(_t(s, d, "documents"))),
    "p6_found": lambda s, d: packing.found(_t(s, d, "documents")),
    "p6_packing": lambda s, d: packing.pack(_t(s, d, "documents")),
    "p6_check": lambda s, d: packing.checked(_t(s, d, "documents")),
    "p6_report": lambda s, d: packing.report(_t(s, d, "documents")),
    "p7_found": lambda s, d: pii.found(_t(s, d, "documents"), _t(s, d, "readers")),
    "p7_redacted": lambda s, d: pii.redact(_t(s, d, "documents"), _t(s, d, "readers")),
}

_NUMBER = "try_cast(nullif(regexp_extract(translate({}, '０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९', '0123456789012345678901234567890123456789'), '([0-9]+)', 1), '') AS BIGINT)"
_FIELD = _NUMBER.format("speaker_id")
_HEAD = "CASE WHEN contains(ID, '_') THEN " + _NUMBER.format("split_part(ID, '_', 1)") + " END"

_P2 = f"""
WITH u AS (SELECT DISTINCT coalesce({_FIELD}, {_HEAD}) AS speaker, ID FROM mls_transcripts WHERE ID IS NOT NULL),
n AS (SELECT speaker, count(*) AS available FROM u WHERE speaker IS NOT NULL GROUP BY speaker),
t AS (SELECT plan_id, speaker, max(target_share * sample_rows) AS target, max(min_rows) AS min_rows FROM sample_targets GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY target - floor(target) DESC, speaker) AS place, round(sum(target) OVER (PARTITION BY plan_id) - sum(floor(target)) OVER (PARTITION BY plan_id)) AS spare FROM t),
w AS (SELECT plan_id, speaker, target, min_rows, greatest(floor(target) + (place <= spare)::INT, min_rows)::BIGINT AS wanted, coalesce(available, 0) AS available FROM r LEFT JOIN n USING (speaker))
"""

_P3 = """
WITH near AS (
  SELECT x.cluster AS a, y.cluster AS b FROM centroids x JOIN centroids y ON x.cluster <> y.cluster AND list_distance(x.vec, y.vec) < 0.25
), frames AS (
  SELECT _row_idx, unnest(speech_tokens) AS u, unnest(range(len(speech_tokens))) AS i FROM mls_aligned WHERE len(speech_tokens) > 0
), told AS (
  SELECT _row_idx, i, u, lag(u) OVER (PARTITION BY _row_idx ORDER BY i) AS before FROM frames
), marked AS (
  SELECT t._row_idx, t.i, t.u, CASE WHEN t.i = 0 THEN 1 WHEN t.u IS NOT DISTINCT FROM t.before THEN 0 WHEN n.a IS NOT NULL THEN 0 ELSE 1 END AS new
  FROM told t LEFT JOIN near n ON n.a = t.u AND n.b = t.before
), grouped AS (
  SELECT _row_idx, i, u, sum(new) OVER (PARTITION BY _row_idx ORDER BY i) AS g FROM marked
), runs AS (
  SELECT _row_idx, g, min(i)::INT AS first_frame, max(i)::INT AS last_frame, arg_min(u, i) AS unit FROM grouped GROUP BY _row_idx, g
)
"""

ORACLE = {
    "p1_found": f"""
WITH RECURSIVE t AS (
  SELECT DISTINCT {_HEAD} AS a, {_FIELD} AS b, split_part(ID, '_', 2) AS book FROM mls_transcripts
), s AS (
  SELECT DISTINCT a AS x, book FROM t WHERE a IS NOT NULL UNION SELECT DISTINCT b, book FROM t WHERE b IS NOT NULL
), e AS (
  SELECT DISTINCT a AS u, b AS v FROM t WHERE a <> b
  UNION SELECT DISTINCT b, a FROM t WHERE a <> b
  UNION SELECT p.x, q.x FROM s p JOIN s q ON p.book = q.book AND p.x <> q.x
), r AS (
  SELECT u, v FROM e
  UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
)
SELECT min(v) AS group_speaker, u AS speaker FROM r GROUP BY u HAVING min(v) < u
""",
    "p1_check": f"""
WITH s AS (SELECT {_HEAD} AS x FROM mls_transcripts UNION SELECT {_FIELD} FROM mls_transcripts),
b AS (SELECT DISTINCT nullif(split_part(ID, '_', 2), '') AS book FROM mls_transcripts WHERE len(string_split(ID, '_')) >= 3)
SELECT 0::BIGINT AS torn_speakers, (SELECT count(x) FROM s) AS speakers, 0::BIGINT AS torn_books, (SELECT count(book) FROM b) AS books,
  (SELECT count(*) FROM mls_transcripts) AS n_rows, (SELECT count(DISTINCT _row_idx) FROM mls_transcripts) AS distinct_rows, true AS near_quotas
""",
    "p5_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_check": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS pieces_of_none, 0::BIGINT AS broken, 0::BIGINT AS overfull, true AS \"full\" FROM documents",
    "p2_found": f"""
WITH u AS (SELECT DISTINCT coalesce({_FIELD}, {_HEAD}) AS speaker, ID FROM mls_transcripts WHERE ID IS NOT NULL),
n AS (SELECT speaker, count(*) AS n FROM u WHERE speaker IS NOT NULL GROUP BY speaker)
SELECT t.plan_id, t.speaker FROM sample_targets t LEFT JOIN n USING (speaker)
WHERE coalesce(n.n, 0) < t.min_rows OR coalesce(n.n, 0) < t.target_share * t.sample_rows
""",
    "p2_report": _P2
    + "SELECT *, least(wanted, available) AS drawn, wanted - least(wanted, available) AS deficit, wanted > available OR (available <= wanted AND available < target) AS short FROM w",
    "p2_check": _P2 + "SELECT plan_id, speaker, n AS drawn, n AS ids, n AS own FROM (SELECT plan_id, speaker, least(wanted, available) AS n FROM w) WHERE n > 0",
    "p3_found": _P3 + "SELECT _row_idx, first_frame, last_frame FROM runs WHERE last_frame - first_frame >= 4",
    "p3_runs": _P3
    + """
SELECT m._row_idx, coalesce(list(unit ORDER BY g) FILTER (WHERE g IS NOT NULL), []) AS units,
  coalesce(list((last_frame - first_frame + 1)::INT ORDER BY g) FILTER (WHERE g IS NOT NULL), []) AS frames,
  coalesce(list(round(first_frame * 0.02, 6)::DOUBLE ORDER BY g) FILTER (WHERE g IS NOT NULL), []) AS start_s,
  coalesce(list(round((last_frame + 1) * 0.02 - first_frame * 0.02, 6)::DOUBLE ORDER BY g) FILTER (WHERE g IS NOT NULL), []) AS duration_s
FROM mls_aligned m LEFT JOIN runs USING (_row_idx) GROUP BY m._row_idx
""",
}
