"""Queries of the pipelines (context, delete, log, linking) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import params, providers
from kgspark.functions import vectors
from kgspark.graphdata import E, M, R, Z, edges, mentions, related, zettels
from kgspark.operators import graph, oplog, vector
from kgspark.plans import linking, retrieval
from kgspark.queries_vector import _OK
from kgspark.session import cut
from kgspark.streaming import ingest
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


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points: the tenant's notes most similar to each question, by vector search.

    Questions are the notes whose id hashes to a multiple of 50 (ids are no numbers here), asked against all rows.
    """
    z = zettels(spark, d, "user_id", "embedding").where(F.coalesce(vectors.is_usable(F.col("embedding"), 64), F.lit(False)))
    asked = z.where(F.conv(F.substring(F.md5("zettel_id"), 1, 4), 16, 10).cast("int") % 50 == 0)
    q = asked.select(F.col("zettel_id").alias("query_id"), F.col("embedding").alias("q"), "user_id")
    hits = vector.search(q, z.select(F.col("zettel_id").alias("id"), F.col("embedding").alias("v"), "user_id"), params.TOP_K, params.SEARCH_THRESHOLD, ["user_id"])
    return hits.join(q.drop("q"), "query_id").select("query_id", "user_id", F.col("id").alias("zettel_id"), F.col("rank").alias("entry_rank"), "score")


_CONTEXT = f"""{Z}, {E}, {R}, {M},
uz AS (SELECT zettel_id, user_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM z WHERE {_OK}),
sc AS (SELECT a.zettel_id AS query_id, a.user_id, b.zettel_id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS score FROM uz a JOIN uz b ON a.user_id = b.user_id AND a.zettel_id <> b.zettel_id
  WHERE ('0x' || left(md5(a.zettel_id), 4))::INT % 50 = 0),
en AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, zettel_id) AS entry_rank FROM sc WHERE score >= {params.SEARCH_THRESHOLD} QUALIFY entry_rank <= {params.TOP_K}),
kd AS (SELECT e.user_id, e.parent_id, e.child_id, row_number() OVER (PARTITION BY e.user_id, e.parent_id ORDER BY length(z.luhmann_id), z.luhmann_id, e.child_id) AS ord FROM e JOIN z ON z.user_id = e.user_id AND z.zettel_id = e.child_id),
sy AS (SELECT user_id, a_id AS f, b_id AS t FROM r UNION SELECT user_id, b_id, a_id FROM r),
nb AS (SELECT user_id, f, t, row_number() OVER (PARTITION BY user_id, f ORDER BY t) AS ord FROM sy WHERE f <> t QUALIFY ord <= 10),
al AS (SELECT query_id, user_id, zettel_id AS other, entry_rank, 0 AS role, 0 AS ord FROM en
  UNION ALL SELECT query_id, en.user_id, e.parent_id, entry_rank, 1, 1 FROM en JOIN e ON e.user_id = en.user_id AND e.child_id = en.zettel_id
  UNION ALL SELECT query_id, en.user_id, kd.child_id, entry_rank, 2, kd.ord FROM en JOIN kd ON kd.user_id = en.user_id AND kd.parent_id = en.zettel_id
  UNION ALL SELECT query_id, en.user_id, nb.t, entry_rank, 3, nb.ord FROM en JOIN nb ON nb.user_id = en.user_id AND nb.f = en.zettel_id),
fi AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, other ORDER BY least(role, 1), entry_rank, role, ord) = 1),
cx AS (SELECT query_id, user_id, other AS zettel_id, CASE role WHEN 0 THEN 'entry' WHEN 1 THEN 'parent' WHEN 2 THEN 'child' ELSE 'related' END AS role,
  row_number() OVER (PARTITION BY query_id ORDER BY least(role, 1), entry_rank, role, ord, other) AS place FROM fi)"""


def _context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.expand(_entries(spark, d).drop("score"), zettels(spark, d, "user_id", "luhmann_id"), edges(spark, d), related(spark, d), 1)


@query(f"WITH {_CONTEXT} SELECT query_id, zettel_id, role, place FROM cx")
def retrieve_context(spark: SparkSession, d: str) -> DataFrame:
    """Entry points and their surroundings, each node once, in order."""
    return _context(spark, d).select("query_id", "zettel_id", "role", "place")


@query(f"""WITH {_CONTEXT}, bl AS (SELECT query_id, coalesce(thought_type, 'unknown') AS t, string_agg('- ' || coalesce(content, ''), chr(10) ORDER BY place, coalesce(content, '')) AS b FROM cx JOIN z USING (user_id, zettel_id) GROUP BY 1, 2),
bo AS (SELECT query_id, string_agg(upper(t) || ':' || chr(10) || b, chr(10) || chr(10) ORDER BY t) AS body FROM bl GROUP BY 1),
ee AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY min(place), name) AS ord FROM cx JOIN m USING (user_id, zettel_id) GROUP BY 1, 2),
el AS (SELECT query_id, string_agg(name, ', ' ORDER BY ord) AS names FROM ee WHERE ord <= 10 GROUP BY 1)
SELECT query_id, body || coalesce(chr(10) || chr(10) || 'ENTITIES: ' || names, '') AS context FROM bo LEFT JOIN el USING (query_id)""")
def context_string(spark: SparkSession, d: str) -> DataFrame:
    c = _context(spark, d)
    return retrieval.context_text(c, zettels(spark, d, "user_id", "thought_type", "content"), retrieval.entities_of(c, mentions(spark, d)))


@query(f"""WITH {_CONTEXT} SELECT query_id, p.luhmann_id || ' -> ' || z.luhmann_id AS path, row_number() OVER (PARTITION BY query_id ORDER BY place) AS ord
FROM cx JOIN e ON e.user_id = cx.user_id AND e.child_id = cx.zettel_id JOIN z ON z.user_id = cx.user_id AND z.zettel_id = cx.zettel_id JOIN z p ON p.user_id = cx.user_id AND p.zettel_id = e.parent_id QUALIFY ord <= 5""")
def context_paths(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.paths(_context(spark, d), zettels(spark, d, "user_id", "luhmann_id"), edges(spark, d))


@query(f"SELECT query_id, regexp_replace(string_split(context, chr(10))[2], '^- ', '') AS answer, 'ok' AS status FROM ({SQL['context_string']})")
def context_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the stand-in model over every context."""
    return providers.answers(context_string(spark, d))


@query(f"""WITH {_CONTEXT}, ch AS (SELECT user_id, parent_id, string_agg(child_luhmann, ', ' ORDER BY ord) AS kids FROM (SELECT kd.*, z.luhmann_id AS child_luhmann FROM kd JOIN z ON z.user_id = kd.user_id AND z.zettel_id = kd.child_id WHERE ord <= 3) GROUP BY 1, 2),
es AS (SELECT user_id, zettel_id, string_agg(name, ', ' ORDER BY name) AS ents FROM (SELECT user_id, zettel_id, name FROM m QUALIFY row_number() OVER (PARTITION BY user_id, zettel_id ORDER BY name) <= 5) GROUP BY 1, 2),
ln AS (SELECT query_id, entry_rank, '[' || entry_rank || '] ' || coalesce(z.luhmann_id, '') || ' (' || format('{{:.3f}}', score) || ') ' || coalesce(z.content, '') || ' | parent: ' || CASE WHEN p.child_id IS NULL THEN '-' ELSE left(coalesce(p.content, ''), 40) END
  || ' | children: ' || coalesce(kids, '-') || ' | entities: ' || coalesce(ents, '-') AS line
  FROM en JOIN z ON z.user_id = en.user_id AND z.zettel_id = en.zettel_id LEFT JOIN (SELECT e.user_id, e.child_id, z.content FROM e JOIN z ON z.user_id = e.user_id AND z.zettel_id = e.parent_id) p ON p.user_id = en.user_id AND p.child_id = en.zettel_id
  LEFT JOIN ch ON ch.user_id = en.user_id AND ch.parent_id = en.zettel_id LEFT JOIN es ON es.user_id = en.user_id AND es.zettel_id = en.zettel_id)
SELECT query_id, string_agg(line, chr(10) ORDER BY entry_rank) AS block FROM ln GROUP BY 1""")
def decision_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The candidate text a link decision sees, for every question's entry points."""
    e = _entries(spark, d).withColumnRenamed("entry_rank", "rank")
    return retrieval.candidate_block(e, zettels(spark, d, "user_id", "luhmann_id", "content"), edges(spark, d), mentions(spark, d))


# ------------------------------------------------------------------ the operation log


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """Creations of all notes, and an update of each note whose text ends in a digit or a stop."""
    z = zettels(spark, d, "user_id", "luhmann_id", "content", "thought_type", "tags")
    e = edges(spark, d).withColumnRenamed("child_id", "zettel_id")
    cards = z.join(e, ["user_id", "zettel_id"], "left").withColumn("seq", F.lit(1).cast("bigint"))
    made = oplog.created(cards)
    change = z.where(F.col("content").rlike(r"[0-9.]$")).select(F.lit(2).cast("bigint").alias("seq"), "user_id", "zettel_id", F.concat("content", F.lit(" (v2)")).alias("content"))
    return made.unionByName(oplog.updated(change, made))


_VIEW = rf"""{Z}, {E}, cu AS (SELECT z.user_id, z.zettel_id, e.parent_id, z.luhmann_id, z.thought_type, z.tags,
  CASE WHEN regexp_matches(content, '[0-9.]$') THEN content || ' (v2)' ELSE content END AS content, 1::BIGINT AS created_seq, CASE WHEN regexp_matches(content, '[0-9.]$') THEN 2 ELSE 1 END::BIGINT AS updated_seq
  FROM z LEFT JOIN e ON e.user_id = z.user_id AND e.child_id = z.zettel_id)"""


@query(f"WITH {_VIEW} SELECT zettel_id, parent_id, luhmann_id, content, created_seq, updated_seq FROM cu")
def oplog_current(spark: SparkSession, d: str) -> DataFrame:
    return oplog.current(_ops(spark, d)).select("zettel_id", "parent_id", "luhmann_id", "content", "created_seq", "updated_seq")


_TARGETS = "tg AS (SELECT user_id, zettel_id AS target_id FROM cu WHERE thought_type = 'risk')"
_GONE = """bw(id, anc) AS (SELECT zettel_id, parent_id FROM cu WHERE parent_id IS NOT NULL UNION SELECT b.id, c.parent_id FROM bw b JOIN cu c ON c.zettel_id = b.anc WHERE c.parent_id IS NOT NULL),
cy AS (SELECT id FROM bw WHERE anc IN (SELECT id FROM bw WHERE id = anc)),
gn AS (SELECT user_id, target_id, target_id AS zettel_id FROM tg UNION SELECT tg.user_id, target_id, bw.id FROM tg JOIN bw ON bw.anc = tg.target_id WHERE bw.id NOT IN (SELECT id FROM cy))"""


@query(f"WITH RECURSIVE {_VIEW}, {_TARGETS}, {_GONE} SELECT target_id, zettel_id FROM gn")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every risk note with everything below it."""
    v = cut(oplog.current(_ops(spark, d)))
    return oplog.cascade(v, v.where("thought_type = 'risk'")).select("target_id", "zettel_id")


@query(f"""WITH RECURSIVE {_VIEW}, {M}, {_TARGETS}, {_GONE}, tl AS (SELECT user_id, name, count(*) AS n FROM m GROUP BY 1, 2),
mi AS (SELECT gn.user_id, target_id, name, count(*) AS k FROM gn JOIN m USING (user_id, zettel_id) GROUP BY 1, 2, 3),
lo AS (SELECT user_id, target_id, count(*) AS removed FROM mi JOIN tl USING (user_id, name) WHERE k = n GROUP BY 1, 2),
dn AS (SELECT user_id, target_id, count(*) AS n FROM gn GROUP BY 1, 2)
SELECT dn.target_id, cu.luhmann_id, dn.n AS deleted_count, coalesce(lo.removed, 0) AS removed_entities FROM dn JOIN cu ON cu.zettel_id = dn.target_id LEFT JOIN lo ON lo.user_id = dn.user_id AND lo.target_id = dn.target_id""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What deleting each risk note would remove: notes of its subtree and entities nothing else mentions."""
    v = cut(oplog.current(_ops(spark, d)))
    gone = oplog.cascade(v, v.where("thought_type = 'risk'"))
    return oplog.deletion_report(v, gone).select("target_id", "luhmann_id", "deleted_count", "removed_entities")


@query(f"""WITH RECURSIVE {_VIEW}, {_TARGETS}, {_GONE} SELECT user_id, count(*) AS remaining FROM cu WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.user_id = cu.user_id AND gn.zettel_id = cu.zettel_id) GROUP BY 1""")
def delete_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Notes per tenant after all those deletions were appended to the log."""
    ops = _ops(spark, d)
    v = cut(oplog.current(ops))
    gone = oplog.cascade(v, v.where("thought_type = 'risk'"))
    return oplog.current(ops.unionByName(oplog.tombstones(gone, 3))).groupBy("user_id").agg(F.count("*").alias("remaining"))


@query("""WITH x AS (SELECT id, user_id, message_id, row_number() OVER (PARTITION BY user_id, message_id ORDER BY id) AS r FROM history_messages) SELECT id, user_id, message_id FROM x WHERE r = 1""")
def message_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each message once, by its first log row."""
    return ingest.logged_once(table(spark, d, "history_messages", "id", "user_id", "message_id"))


# ------------------------------------------------------------------ cards and linking


@query()
def build_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of every document's sentences, from the stand-in splitter."""
    notes = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("note_id"), "text").where("text is not null")
    return linking.build_cards(linking.validated(providers.sentence_atoms(notes)))


@query()
def fold_linking(spark: SparkSession, d: str) -> DataFrame:
    """Every tenant's notes placed one after the other, with the stand-in decision."""
    z = zettels(spark, d, "user_id", "embedding", "created_at")
    e = edges(spark, d).withColumnRenamed("child_id", "zettel_id")
    ok = F.coalesce(vectors.is_usable(F.col("embedding"), 64), F.lit(False))
    cards = z.join(e, ["user_id", "zettel_id"], "left").select("user_id", F.unix_micros("created_at").alias("seq"), "zettel_id", "parent_id", F.when(ok, F.col("embedding")).alias("embedding"))
    return linking.fold(cards, providers.threshold_decider)
