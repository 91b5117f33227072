"""Evaluation queries and their SQL.

The evaluation inputs are laid over the tables of the data folder: cards of a note are split into a
reference and a predicted side by their id, events stand for linking runs and answers, order lines for
model calls, questions with their note ids for ranked retrieval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import params
from kgspark.functions import text
from kgspark.graphdata import Z, zettels
from kgspark.operators.metrics import cost, decomposition, generation, linking, retrieval, scorecard
from kgspark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ retrieval


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "qa_pair", "qa_id", "all_zettel_ids", "relevant_zettel_ids").dropDuplicates(["qa_id"])
    r = q.select(F.col("qa_id").alias("qid"), F.posexplode(text.pipe_list(F.col("all_zettel_ids"))).alias("p", "id"))
    t = q.select(F.col("qa_id").alias("qid"), F.explode(text.pipe_list(F.col("relevant_zettel_ids"))).alias("id"))
    return retrieval.first_seen(r.select("qid", "id", F.col("p").alias("rank"))), t.distinct()


_RANKED = """q AS (SELECT DISTINCT ON (qa_id) qa_id AS qid, all_zettel_ids AS a, relevant_zettel_ids AS b, question_type AS qt FROM qa_pair),
ra AS (SELECT qid, trim(x[p]) AS id, p FROM (SELECT qid, string_split(a, '|') AS x, unnest(range(1, len(string_split(a, '|')) + 1)) AS p FROM q) WHERE trim(x[p]) <> ''),
rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY min(p), id) AS rank FROM ra GROUP BY qid, id),
tr AS (SELECT DISTINCT qid, trim(x) AS id FROM (SELECT qid, unnest(string_split(b, '|')) AS x FROM q) WHERE trim(x) <> ''),
nr AS (SELECT qid, count(*) AS n_rel FROM tr GROUP BY 1),
h AS (SELECT rk.qid, rk.rank, tr.id IS NOT NULL AS rel FROM rk LEFT JOIN tr ON tr.qid = rk.qid AND tr.id = rk.id),
g AS (SELECT nr.qid, k, n_rel, count(*) FILTER (rel AND rank <= k) AS hits, min(rank) FILTER (rel) AS fst, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= k), 0) AS dcg
  FROM nr CROSS JOIN (VALUES (3), (5), (7)) ks(k) LEFT JOIN h ON h.qid = nr.qid GROUP BY 1, 2, 3),
mt AS (SELECT qid, k::BIGINT AS k, round(hits / k, 6) AS precision, round(hits / n_rel, 6) AS recall,
  round(CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / k) * (hits / n_rel) / (hits / k + hits / n_rel) END, 6) AS f1, (hits > 0)::INT::DOUBLE AS hit,
  round(coalesce(1 / fst, 0.0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(k, n_rel) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g)"""


@query("""WITH q AS (SELECT DISTINCT ON (qa_id) qa_id, note_id, relevant_zettel_ids AS b FROM qa_pair WHERE note_id IS NOT NULL), c AS (SELECT DISTINCT note_id, zettel_id FROM zettel_card WHERE note_id IS NOT NULL),
w AS (SELECT note_id, string_agg(zettel_id, '|' ORDER BY zettel_id) AS all_zettel_ids, count(*) AS n_total_zettels FROM c GROUP BY 1),
s AS (SELECT qa_id, note_id, trim(x[p]) AS id, p FROM (SELECT qa_id, note_id, string_split(b, '|') AS x, unnest(range(1, len(string_split(b, '|')) + 1)) AS p FROM q)),
k AS (SELECT qa_id, string_agg(id, '|' ORDER BY p) AS ids, count(*) AS n FROM s JOIN c ON c.note_id = s.note_id AND c.zettel_id = s.id GROUP BY 1)
SELECT q.qa_id, q.note_id, all_zettel_ids, coalesce(ids, '') AS relevant_zettel_ids, n_total_zettels, coalesce(n, 0) AS n_relevant_zettels FROM q JOIN w USING (note_id) LEFT JOIN k USING (qa_id)""")
def qa_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Questions with those of their ids that are cards of their note."""
    q = table(spark, d, "qa_pair", "qa_id", "note_id", "relevant_zettel_ids").where("note_id is not null").dropDuplicates(["qa_id"])
    q = q.select("qa_id", "note_id", F.coalesce(text.pipe_list(F.col("relevant_zettel_ids")), F.array().cast("array<string>")).alias("relevant"))
    return retrieval.qa_dataset(q, table(spark, d, "zettel_card", "note_id", "zettel_id"))


def _at_k(spark: SparkSession, d: str) -> DataFrame:
    r, t = _ranked(spark, d)
    return retrieval.at_k(r, t, params.KS)


@query(f"WITH {_RANKED} SELECT qid, k, precision, recall, f1, hit FROM mt")
def precision_recall_k(spark: SparkSession, d: str) -> DataFrame:
    return _at_k(spark, d).select("qid", "k", "precision", "recall", "f1", "hit")


@query(f"WITH {_RANKED} SELECT DISTINCT qid, mrr FROM mt")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return _at_k(spark, d).select("qid", "mrr").distinct()


@query(f"WITH {_RANKED} SELECT qid, k, ndcg FROM mt")
def ndcg_k(spark: SparkSession, d: str) -> DataFrame:
    return _at_k(spark, d).select("qid", "k", "ndcg")


_STATS = ", ".join(f"round(avg({m}), 4) AS {m}_mean, round(median({m}), 4) AS {m}_median, round(stddev_samp({m}), 4) AS {m}_std" for m in ("precision", "recall", "f1", "hit", "mrr", "ndcg"))


@query(f"WITH {_RANKED} SELECT k, count(*) AS n, {_STATS} FROM mt GROUP BY k")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.summary(_at_k(spark, d))


@query(f"WITH {_RANKED}, s AS (SELECT k, round(avg(f1), 6) AS f1 FROM mt GROUP BY 1) SELECT k AS best_k, f1 FROM s ORDER BY f1 DESC, k LIMIT 1")
def best_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.best_k(_at_k(spark, d))


@query(f"""WITH {_RANKED}, s AS (SELECT k, round(avg(f1), 6) AS f1 FROM mt GROUP BY 1), b AS (SELECT k FROM s ORDER BY f1 DESC, k LIMIT 1)
SELECT coalesce(qt, 'unknown') AS question_type, count(*) AS n, round(avg(f1), 4) AS f1 FROM mt JOIN b USING (k) JOIN q USING (qid) GROUP BY 1""")
def f1_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Mean F1 at the best k by question type."""
    m = _at_k(spark, d)
    k = retrieval.best_k(m).select(F.col("best_k").alias("k"))
    q = table(spark, d, "qa_pair", "qa_id", "question_type").dropDuplicates(["qa_id"]).select(F.col("qa_id").alias("qid"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
    return m.join(k, "k").join(q, "qid").groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 4).alias("f1"))


@query(f"WITH {_RANKED} SELECT k, least(floor(f1 * 15) + 1, 15)::BIGINT AS bin, count(*) AS n FROM mt GROUP BY 1, 2")
def f1_histogram(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.histogram(_at_k(spark, d), "f1")


@query(f"WITH {_RANKED} SELECT qid, id, rank FROM rk")
def first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved ids in order, each at its first place."""
    return _ranked(spark, d)[0]


# ------------------------------------------------------------------ decomposition


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    note = table(spark, d, "zettel_card", "zettel_id", "note_id").groupBy("zettel_id").agg(F.min("note_id").alias("note_id")).where("note_id is not null")
    c = zettels(spark, d, "luhmann_id", "thought_type", "tags").join(note, "zettel_id").withColumn("side", F.ascii(F.right("zettel_id", F.lit(1))) % 2)
    return c.where("side = 0"), c.where("side = 1")


_SIDES = f"""{Z}, c AS (SELECT z.*, note_id, ascii(right(z.zettel_id, 1)) % 2 AS side FROM z
  JOIN (SELECT zettel_id, min(note_id) AS note_id FROM zettel_card GROUP BY 1) k USING (zettel_id) WHERE note_id IS NOT NULL),
ref AS (SELECT * FROM c WHERE side = 0), pred AS (SELECT * FROM c WHERE side = 1)"""
_COUNTS = "cn AS (SELECT note_id, r AS ref_count, coalesce(p, 0) AS pred_count, p IS NULL AS no_output, round(coalesce(p, 0) / r, 3) AS count_ratio, abs(coalesce(p, 0) - r)::DOUBLE AS count_mae FROM (SELECT note_id, count(*) AS r FROM ref GROUP BY 1) LEFT JOIN (SELECT note_id, count(*) AS p FROM pred GROUP BY 1) USING (note_id))"


@query(f"WITH {_SIDES}, {_COUNTS} SELECT * FROM cn")
def count_metrics(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.counts(*_sides(spark, d))


_VALID = r"regexp_matches(l, '^[0-9]+([a-z][0-9]*|\.[0-9]+[a-z]?)*$')"
_HIER = """SELECT x.note_id, round(avg(valid::INT), 3) AS valid_share, round(count(DISTINCT l) / count(*), 3) AS unique_ratio,
  round(coalesce(count(*) FILTER (x.p IS NOT NULL AND i.l2 IS NOT NULL) / nullif(count(*) FILTER (x.p IS NOT NULL), 0), 1.0), 3) AS parent_consistency,
  coalesce(max(depth), 0) AS max_depth, round(coalesce(avg(depth), 0.0), 2) AS mean_depth, count(*) FILTER (depth = 1) AS roots
  FROM (SELECT note_id, l, {v} AS valid, CASE WHEN {v} THEN len(regexp_extract_all(l, '([0-9]+|[a-z]+)'))::BIGINT END AS depth,
    CASE WHEN {v} THEN nullif(regexp_replace(l, '([.][0-9]+|[a-z]+|[0-9]+)$', ''), '') END AS p FROM (SELECT note_id, lower(luhmann_id) AS l FROM {t})) x
  LEFT JOIN (SELECT DISTINCT note_id, lower(luhmann_id) AS l2 FROM {t}) i ON i.note_id = x.note_id AND i.l2 = x.p GROUP BY 1"""


@query(f"WITH {_SIDES} {_HIER.format(t='c', v=_VALID)}")
def hierarchy_metrics(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return decomposition.hierarchy(a.unionByName(b))


@query(f"""WITH {_SIDES}, a AS ({_HIER.format(t='ref', v=_VALID)}), b AS ({_HIER.format(t='pred', v=_VALID)})
SELECT a.note_id, abs(a.roots - b.roots) AS root_count_delta, abs(a.max_depth - b.max_depth)::DOUBLE AS depth_mae, round(abs(a.mean_depth - b.mean_depth), 2) AS mean_depth_mae FROM a LEFT JOIN b USING (note_id)""")
def hierarchy_comparison(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.compare_hierarchy(*_sides(spark, d))


_TAG = r"regexp_replace(regexp_replace(lower(trim(t)), '\s+', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g')"
_TAGS = f"""tr AS (SELECT DISTINCT note_id, {_TAG} AS t FROM (SELECT note_id, unnest(tags) AS t FROM ref) WHERE {_TAG} <> ''),
tp AS (SELECT DISTINCT note_id, {_TAG} AS t FROM (SELECT note_id, unnest(tags) AS t FROM pred) WHERE {_TAG} <> ''),
tn AS (SELECT note_id, coalesce(nr, 0) AS nr, coalesce(np, 0) AS np, coalesce(b, 0) AS b FROM (SELECT DISTINCT note_id FROM ref)
  LEFT JOIN (SELECT note_id, count(*) AS nr FROM tr GROUP BY 1) USING (note_id) LEFT JOIN (SELECT note_id, count(*) AS np FROM tp GROUP BY 1) USING (note_id)
  LEFT JOIN (SELECT note_id, count(*) AS b FROM tr JOIN tp USING (note_id, t) GROUP BY 1) USING (note_id)),
tg AS (SELECT note_id, CASE WHEN nr + np = 0 THEN 1.0 ELSE round(coalesce(b / nullif(np, 0), 0), 3) END AS tag_precision, CASE WHEN nr + np = 0 THEN 1.0 ELSE round(coalesce(b / nullif(nr, 0), 0), 3) END AS tag_recall,
  CASE WHEN nr + np = 0 THEN 1.0 WHEN b = 0 THEN 0.0 ELSE round(2 * (b / np) * (b / nr) / (b / np + b / nr), 3) END AS tag_f1, nr - b AS missed, np - b AS extra FROM tn)"""


@query(f"WITH {_SIDES}, {_TAGS} SELECT * FROM tg")
def tag_metrics(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.tags(*_sides(spark, d))


_TYPES = """sh AS (SELECT note_id, coalesce(r.s, 0) AS r, coalesce(p.s, 0) AS p FROM
  (SELECT note_id, coalesce(thought_type, 'unknown') AS t, count(*) / sum(count(*)) OVER (PARTITION BY note_id) AS s FROM ref GROUP BY 1, 2) r FULL JOIN
  (SELECT note_id, coalesce(thought_type, 'unknown') AS t, count(*) / sum(count(*)) OVER (PARTITION BY note_id) AS s FROM pred GROUP BY 1, 2) p USING (note_id, t)),
ty AS (SELECT note_id, round(sum(least(r, p)), 3) AS type_overlap, round(sum(abs(r - p)), 3) AS type_delta FROM sh GROUP BY 1)"""


@query(f"WITH {_SIDES}, {_TYPES} SELECT * FROM ty")
def type_overlap(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.type_overlap(*_sides(spark, d))


def _note_rows(spark: SparkSession, d: str) -> DataFrame:
    ref, pred = _sides(spark, d)
    j = decomposition.counts(ref, pred).join(decomposition.tags(ref, pred), "note_id").join(decomposition.type_overlap(ref, pred), "note_id", "left").fillna(0.0, ["type_overlap"])
    return j.withColumn("model", F.when(F.col("no_output"), "silent").otherwise("splitter"))


_NOTE = f"{_SIDES}, {_COUNTS}, {_TAGS}, {_TYPES}, nt AS (SELECT CASE WHEN no_output THEN 'silent' ELSE 'splitter' END AS model, count_ratio, count_mae, tag_f1, coalesce(type_overlap, 0.0) AS type_overlap FROM cn JOIN tg USING (note_id) LEFT JOIN ty USING (note_id))"
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m}::DOUBLE AS v FROM nt" for m in ("count_ratio", "count_mae", "tag_f1", "type_overlap")) + ")"


@query(f"""WITH {_NOTE}, {_LONG} SELECT model, metric, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std,
round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.95), 4) AS p95 FROM lg GROUP BY 1, 2""")
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per-note metrics joined to one row per note, then summed up per model."""
    return decomposition.model_summary(_note_rows(spark, d), "model", ["count_ratio", "count_mae", "tag_f1", "type_overlap"])


@query(r"""WITH n AS (SELECT note_id, max(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) <> '')))::BIGINT AS num_sentences FROM documents WHERE note_id IS NOT NULL GROUP BY 1),
c AS (SELECT note_id, count(DISTINCT zettel_id) AS cards FROM zettel_card WHERE note_id IS NOT NULL GROUP BY 1)
SELECT num_sentences, count(*) AS notes, round(avg(coalesce(cards, 0)), 4) AS mean_cards FROM c FULL JOIN n USING (note_id) WHERE num_sentences IS NOT NULL GROUP BY 1""")
def cards_per_sentence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents", "note_id", "text").where("note_id is not null").groupBy("note_id").agg(F.max(text.sentence_count(F.col("text"))).alias("num_sentences"))
    return decomposition.cards_per_sentence(table(spark, d, "zettel_card", "note_id", "zettel_id").where("note_id is not null"), n)


# ------------------------------------------------------------------ linking


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    act = F.when(F.col("event_type").isin("view", "click"), "child_of").when(F.col("event_type") == "purchase", "update_of").otherwise("new_root")
    lid = F.when(k % 4 == 0, "1").when(k % 4 == 1, "1.2").when(k % 4 == 2, "1.2a").otherwise("1.2a3")
    x = e.select(F.floor(F.col("event_id") / 2).alias("seq"), (F.col("event_id") % 2).alias("side"), act.alias("action"), lid.alias("luhmann_id"), F.col("value").alias("latency_sec"), F.concat_ws(" ", "event_type", "props").alias("content"))
    return x.where("side = 0"), x.where("side = 1")


_RUN = """ev AS (SELECT event_id // 2 AS seq, event_id % 2 AS side, CASE WHEN event_type IN ('view', 'click') THEN 'child_of' WHEN event_type = 'purchase' THEN 'update_of' ELSE 'new_root' END AS action,
  CASE (props->>'$.k')::INT % 4 WHEN 0 THEN '1' WHEN 1 THEN '1.2' WHEN 2 THEN '1.2a' ELSE '1.2a3' END AS luhmann_id, (props->>'$.k')::INT % 4 + 1 AS dep, value AS latency_sec FROM events),
rf AS (SELECT * FROM ev WHERE side = 0), ts AS (SELECT * FROM ev WHERE side = 1),
zp AS (SELECT r.seq, r.action AS ra, t.action AS ta, r.luhmann_id AS rl, t.luhmann_id AS tl, r.dep AS rd, t.dep AS td FROM rf r JOIN ts t USING (seq))"""


@query(f"WITH {_RUN} SELECT round(avg((ra = ta)::INT), 6) AS action_accuracy FROM zp")
def action_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return linking.positional(*_runs(spark, d)).select("action_accuracy")


@query(f"WITH {_RUN} SELECT round(greatest(0, 1 - avg(abs(rd - td)) / greatest(max(rd), 1)), 6) AS depth_consistency FROM zp")
def depth_consistency(spark: SparkSession, d: str) -> DataFrame:
    return linking.positional(*_runs(spark, d)).select("depth_consistency")


@query(f"WITH {_RUN} SELECT round(coalesce(avg((rd = td)::INT) FILTER (ra = 'child_of' AND ta = 'child_of'), 1.0), 6) AS child_precision FROM zp")
def child_precision(spark: SparkSession, d: str) -> DataFrame:
    return linking.positional(*_runs(spark, d)).select("child_precision")


@query(f"WITH {_RUN} SELECT round(abs((SELECT avg((action = 'new_root')::INT) FROM rf) - (SELECT avg((action = 'new_root')::INT) FROM ts)), 6) AS root_rate_delta")
def root_rate_delta(spark: SparkSession, d: str) -> DataFrame:
    return linking.root_rate_delta(*_runs(spark, d))


_SMOOTH = "SELECT a, coalesce(n, 0) / (SELECT count(*) FROM {t}) + 1e-9 AS s FROM (VALUES ('new_root'), ('child_of'), ('update_of')) v(a) LEFT JOIN (SELECT action AS a, count(*) AS n FROM {t} GROUP BY 1) USING (a)"


@query(f"""WITH {_RUN}, p AS ({_SMOOTH.format(t='rf')}), q AS ({_SMOOTH.format(t='ts')})
SELECT round(sum(p.s / sp * ln((p.s / sp) / (q.s / sq))), 6) AS action_kl FROM p JOIN q USING (a), (SELECT sum(s) AS sp FROM p), (SELECT sum(s) AS sq FROM q)""")
def action_kl(spark: SparkSession, d: str) -> DataFrame:
    return linking.action_kl(*_runs(spark, d))


@query(f"""WITH {_RUN}, h AS (SELECT d, coalesce(r, 0) AS r, coalesce(t, 0) AS t FROM (SELECT unnest(range(1, (SELECT max(dep) FROM ev) + 1)) AS d)
  LEFT JOIN (SELECT dep AS d, count(*) AS r FROM rf GROUP BY 1) USING (d) LEFT JOIN (SELECT dep AS d, count(*) AS t FROM ts GROUP BY 1) USING (d)),
k AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS b FROM h)
SELECT round(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0), 6) AS structure_similarity FROM k""")
def spearman_depth(spark: SparkSession, d: str) -> DataFrame:
    return linking.structure_similarity(*_runs(spark, d))


_PARENT = "nullif(regexp_replace({c}, '([.][0-9]+|[a-z]+|[0-9]+)$', ''), '')"


@query(f"""WITH {_RUN} SELECT seq, left((SELECT event_type || ' ' || props FROM events WHERE event_id = 2 * seq), 60) || '...' AS content_snippet, ra AS action_ref, ta AS action_test, rl AS luhmann_ref, tl AS luhmann_test, ra = ta AS action_match, abs(td - rd)::BIGINT AS depth_diff,
CASE WHEN ra = 'child_of' AND ta = 'child_of' THEN {_PARENT.format(c='rl')} IS NOT DISTINCT FROM {_PARENT.format(c='tl')} END AS prefix_match FROM zp""")
def row_diff(spark: SparkSession, d: str) -> DataFrame:
    return linking.row_diff(*_runs(spark, d))


@query(f"WITH {_RUN} SELECT round(arg_min(latency_sec, seq) / count(*), 6) AS latency_per_card FROM ts")
def latency_per_card(spark: SparkSession, d: str) -> DataFrame:
    return linking.latency_per_card(_runs(spark, d)[1])


@query(f"SELECT action, coalesce(n, 0) AS n FROM (WITH {_RUN} SELECT * FROM (VALUES ('new_root'), ('child_of'), ('update_of')) v(action) LEFT JOIN (SELECT action, count(*) AS n FROM ev GROUP BY 1) USING (action))")
def action_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Rows per action, also those with none."""
    a, b = _runs(spark, d)
    n = a.unionByName(b).groupBy("action").agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(x,) for x in params.ACTIONS], "action string")
    return domain.join(n, "action", "left").fillna(0)


_PARTS = {n: n for n in ("action_accuracy", "depth_consistency", "child_precision", "root_rate_delta", "action_kl", "latency_per_card")} | {"structure_similarity": "spearman_depth"}


@query(
    "WITH s AS (SELECT " + ", ".join(f"({SQL[q]}) AS {n}" for n, q in _PARTS.items()) + ") SELECT *, round("
    + " + ".join(f"{w} * " + ("(1 - greatest(0.0, least(1.0, action_kl / 0.1)))" if m == "action_kl" else m) for m, w in params.LINKER_WEIGHTS.items()) + ", 6) AS overall FROM s"
)
def linker_overall(spark: SparkSession, d: str) -> DataFrame:
    """All linking metrics and their weighted sum in one row."""
    return scorecard.linker_overall(linking.all_metrics(*_runs(spark, d)), params.LINKER_WEIGHTS)


# ------------------------------------------------------------------ answers, scorecards, costs


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    part = lambda i: (((k * i) % 101) / 100).cast("double")
    names = (*generation.POSITIVE, "hallucination")
    return e.select(F.col("event_type").alias("model"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("question_type"), (F.col("value") * 10).alias("latency_ms"), *[part(i + 1).alias(n) for i, n in enumerate(names)])


_SCORES = ", ".join(f"(((props->>'$.k')::INT * {i + 1}) % 101) / 100 AS {n}" for i, n in enumerate((*generation.POSITIVE, "hallucination")))
_ANS = f"an AS (SELECT event_type AS model, 't' || ((props->>'$.k')::INT % 3) AS question_type, value * 10 AS latency_ms, {_SCORES} FROM events)"
_SIX = (*generation.POSITIVE, "hallucination")
_OVER = "0.85 * (" + " + ".join(generation.POSITIVE) + ") / 5 + 0.15 * (1 - hallucination)"
_OVER_AVG = "0.85 * (" + " + ".join(f"avg({p})" for p in generation.POSITIVE) + ") / 5 + 0.15 * (1 - avg(hallucination))"


@query(f"""WITH {_ANS} SELECT model, count(*) AS n, round(avg(latency_ms), 4) AS latency_mean, round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95,
{', '.join(f'round(avg({m}), 4) AS {m}, round(stddev_samp({m}), 4) AS {m}_std' for m in _SIX)}, round({_OVER_AVG}, 4) AS overall FROM an GROUP BY 1""")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return generation.summary(_answers(spark, d))


@query(f"WITH {_ANS} SELECT model, question_type, count(*) AS n, round(avg({_OVER}), 4) AS overall FROM an GROUP BY 1, 2")
def generation_by_type(spark: SparkSession, d: str) -> DataFrame:
    return generation.by_type(_answers(spark, d))


@query(f"""WITH {Z} SELECT count(*) AS zettels, count(*) FILTER (tags IS NULL) AS without_tags, count(*) FILTER (content IS NULL) AS without_content, count(*) FILTER (len(tags) = 0) AS empty_lists,
round(avg(len(tags)), 4) AS mean_tags, sum(coalesce(is_root_topic, false)::INT)::BIGINT AS roots FROM z""")
def list_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean list length, missing values and counts of predicates in one row."""
    z = zettels(spark, d, "tags", "content", "is_root_topic")
    return z.agg(
        F.count("*").alias("zettels"), F.count_if(F.col("tags").isNull()).alias("without_tags"), F.count_if(F.col("content").isNull()).alias("without_content"),
        F.coalesce(F.count_if(F.size("tags") == 0), F.lit(0)).alias("empty_lists"), F.round(F.avg(F.when(F.col("tags").isNotNull(), F.size("tags"))), 4).alias("mean_tags"), F.count_if("is_root_topic").alias("roots"),
    )


@query(f"WITH {_ANS} SELECT model, round(avg(latency_ms), 4) AS mean, round(median(latency_ms), 4) AS median, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM an GROUP BY 1")
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return a.groupBy("model").agg(F.round(F.avg("latency_ms"), 4).alias("mean"), F.round(F.median("latency_ms"), 4).alias("median"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("p95"))


def _means(spark: SparkSession, d: str) -> DataFrame:
    """(model, metric, value) of every event type over the scorecard's metrics."""
    a = _answers(spark, d)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("v")) for k, v in _TAKE.items()])).alias("x")
    return a.select("model", rows).select("model", "x.*").groupBy("model", "metric").agg(F.round(F.avg("v"), 6).alias("value"))


_TAKE = {m[0]: "latency_ms" if m[0].startswith("latency") else _SIX[i % len(_SIX)] for i, m in enumerate(scorecard.METRICS)}
_CFG = "cf(metric, category, direction, lo, hi, target) AS (VALUES " + ", ".join(f"('{m}', '{c}', '{w}', {lo}::DOUBLE, {hi}::DOUBLE, {'NULL' if t is None else t}::DOUBLE)" for m, c, w, lo, hi, t in scorecard.METRICS) + ")"
_MEANS = "mn AS (" + " UNION ALL ".join(f"SELECT model, '{k}' AS metric, round(avg({v}), 6) AS value FROM an GROUP BY 1" for k, v in _TAKE.items()) + ")"
_CLIP = "greatest(0.0, least(1.0, {x}))"
_NORM = """nm AS (SELECT model, metric, category, CASE WHEN direction = 'up' THEN (greatest(lo, least(hi, value)) - lo) / (hi - lo)
  WHEN direction = 'down' THEN 1 - (greatest(lo, least(hi, value)) - lo) / (hi - lo) ELSE 1 - abs(greatest(lo, least(hi, value)) - target) / greatest(abs(lo - target), abs(hi - target)) END AS score FROM mn JOIN cf USING (metric))"""
_CATS = "ca AS (SELECT model, coalesce(category, 'overall') AS category, round(avg(score), 6) AS score FROM nm GROUP BY GROUPING SETS ((model, category), (model)))"


@query(f"WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM} SELECT model, metric, category, round(score, 6) AS score FROM nm")
def scorecard_norm(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM}, {_CATS} SELECT * FROM ca")
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.category_scores(_normalised(spark, d))


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.normalised(_means(spark, d), scorecard.config(spark))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    c = category_scores(spark, d).where("category = 'overall'").select("model", F.col("score").alias("quality"))
    e = table(spark, d, "events", "event_type", "value").where("event_type <> 'error'").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("cost"))
    return c.join(e, "model", "left")


_PRICED = "pr AS (SELECT model, score AS quality, cost FROM ca LEFT JOIN (SELECT event_type AS model, round(avg(value), 6) AS cost FROM events WHERE event_type <> 'error' GROUP BY 1) USING (model) WHERE category = 'overall')"


@query(f"""WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM}, {_CATS}, {_PRICED}, x AS (SELECT *, min(cost) OVER () AS lo, max(cost) OVER () AS hi FROM pr),
y AS (SELECT model, quality, cost, CASE WHEN cost IS NULL THEN 0.5 WHEN hi = lo THEN 1.0 ELSE 1 - (cost - lo) / (hi - lo) END AS cs FROM x)
SELECT model, quality, cost, round(cs, 6) AS cost_score, round(0.85 * quality + 0.15 * round(cs, 6), 4) AS final FROM y""")
def cost_blend(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.cost_blend(_priced(spark, d))


@query(f"""WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM}, {_CATS}, {_PRICED} SELECT model, quality, cost, round(quality / (cost / (SELECT min(cost) FROM pr)), 6) AS quality_cost FROM pr""")
def cost_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.efficiency(_priced(spark, d), "quality", "cost", "quality_cost")


_FINAL = """x AS (SELECT *, min(cost) OVER () AS lo, max(cost) OVER () AS hi FROM pr), fl AS (SELECT model, round(0.85 * quality + 0.15 * round(CASE WHEN cost IS NULL THEN 0.5 WHEN hi = lo THEN 1.0 ELSE 1 - (cost - lo) / (hi - lo) END, 6), 4) AS final FROM x)"""


@query(f"""WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM}, {_CATS}, {_PRICED}, {_FINAL}, o AS (SELECT *, row_number() OVER (ORDER BY final DESC, model) AS rank, floor(final * 100)::BIGINT AS percent FROM fl)
SELECT model, rank, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE '' END AS medal, percent, repeat('█', (percent // 5)::INT) || repeat('░', ((100 - percent) // 5)::INT) AS bar FROM o""")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Models by quality and cost, with medal and bar."""
    return scorecard.ranking(cost_blend(spark, d), "final")


@query(f"""WITH {_ANS}, {_MEANS}, {_CFG}, g AS (SELECT metric, model, CASE direction WHEN 'up' THEN value ELSE -value END AS good FROM mn JOIN cf USING (metric))
SELECT DISTINCT metric, first_value(model) OVER (PARTITION BY metric ORDER BY good DESC, model) AS best, first_value(model) OVER (PARTITION BY metric ORDER BY good, model) AS worst FROM g""")
def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.extremes(_means(spark, d), scorecard.config(spark))


@query(f"""WITH {_ANS}, {_MEANS}, {_CFG}, {_NORM}, {_CATS}, {_PRICED}, {_FINAL}, w AS (SELECT model FROM fl ORDER BY final DESC, model LIMIT 1)
SELECT * FROM (SELECT model, category, score, CASE WHEN score > 0.75 THEN 'strong' WHEN score < 0.6 THEN 'weak' END AS mark FROM ca JOIN w USING (model) WHERE category <> 'overall') WHERE mark IS NOT NULL""")
def strong_and_weak(spark: SparkSession, d: str) -> DataFrame:
    """The winner's strong and weak categories."""
    return scorecard.strong_and_weak(category_scores(spark, d), cost_blend(spark, d))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    log = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("l_returnflag") != "R").alias("success"), F.col("o_orderpriority").alias("model"), (F.col("l_quantity") * 1000).cast("bigint").alias("input_tokens"),
        (F.col("l_linenumber") * 500).cast("bigint").alias("output_tokens"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_tax").alias("amount"),
    )
    prices = o.where(~F.col("o_orderpriority").startswith("5")).groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.min("o_totalprice") / 100, 4).alias("price_in"), F.round(F.max("o_totalprice") / 100, 4).alias("price_out"))
    return cost.priced(log, prices)


_CALLS = """lg AS (SELECT l_returnflag <> 'R' AS success, o_orderpriority AS model, (l_quantity * 1000)::BIGINT AS input_tokens, (l_linenumber * 500)::BIGINT AS output_tokens, l_extendedprice AS duration_ms, l_tax AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pl AS (SELECT o_orderpriority AS model, round(min(o_totalprice) / 100, 4) AS price_in, round(max(o_totalprice) / 100, 4) AS price_out FROM orders WHERE NOT starts_with(o_orderpriority, '5') GROUP BY 1),
cl AS (SELECT *, input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out AS cost FROM lg JOIN pl USING (model) WHERE success)"""


@query(f"WITH {_CALLS} SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 4) AS cost FROM cl GROUP BY ROLLUP (model)")
def cost_join(spark: SparkSession, d: str) -> DataFrame:
    return cost.totals(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT model, round(avg(duration_ms), 4) AS mean_duration, round(avg(amount), 4) AS mean_amount, round(avg(cost), 6) AS mean_cost, round(sum(cost), 4) AS total_cost FROM cl GROUP BY 1")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return cost.by_model(_calls(spark, d))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
round(median(value), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max FROM events GROUP BY 1""")
def describe_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    q = lambda p: F.round(F.percentile(v, F.lit(p)), 4)
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.round(F.max(v), 4).alias("max"),
    )
