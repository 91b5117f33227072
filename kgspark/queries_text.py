"""Queries of the text and id functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import luhmann, text
from kgspark.graphdata import Z, zettels
from kgspark.operators import assign, oplog
from kgspark.operators.ranking import row_numbers
from kgspark.sources import files
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


_WS = r"[\s ​]+"


@query(r"""SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS content
FROM (SELECT doc_id, trim(regexp_replace(text, '\p{White_Space}+'::VARCHAR, ' ', 'g')) AS t FROM documents)""".replace(r"\p{White_Space}", r"[\s\v\x{85}\p{Z}]"))
def clean_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.clean_content(F.col("text")).alias("content"))


@query(rf"""WITH {Z}, u AS (SELECT zettel_id, replace(replace(trim(lower(tags[pos])), ' ', '_'), '-', '_') AS t, pos FROM (SELECT zettel_id, tags, unnest(range(1, len(tags) + 1)) AS pos FROM z)),
f AS (SELECT zettel_id, t, row_number() OVER (PARTITION BY zettel_id ORDER BY min(pos)) AS k FROM u WHERE t <> '' GROUP BY 1, 2)
SELECT z.zettel_id, coalesce(g.tags, '') AS tags FROM z LEFT JOIN (SELECT zettel_id, string_agg(t, ', ' ORDER BY k) AS tags FROM f WHERE k <= 5 GROUP BY 1) g USING (zettel_id)""")
def normalize_tags(spark: SparkSession, d: str) -> DataFrame:
    z = zettels(spark, d, "tags")
    return z.select("zettel_id", F.coalesce(F.array_join(text.normalize_tags(F.col("tags")), ", "), F.lit("")).alias("tags"))


@query(r"""SELECT user_id, name, regexp_replace(regexp_replace(lower(trim(display_name)), '\s+', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g') AS tag FROM entity_node""")
def normalize_tag_eval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_node", "user_id", "name", "display_name").select("user_id", "name", text.eval_tag(F.col("display_name")).alias("tag"))


@query(r"""SELECT id, CASE WHEN length(t) > 60 THEN rtrim(left(t, 59)) || '…' ELSE t END AS preview
FROM (SELECT id, trim(regexp_replace(message_text, '\s+', ' ', 'g')) AS t FROM history_messages)""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages", "id", "message_text").select("id", text.preview(F.col("message_text"), 60).alias("preview"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) <> ''))::BIGINT AS sentences FROM documents""")
def sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.sentence_count(F.col("text")).alias("sentences"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?m)(^#{1,6}\s|\*\*[^*\n]+\*\*|`[^`\n]+`|^\s*[-*]\s|\[[^\]\n]+\]\(https?://)') AS is_markdown,
replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS stripped FROM documents""")
def markdown_detect(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is markdown, and the text without tags, escaped."""
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.is_markdown(t).alias("is_markdown"), text.strip_tags(t).alias("stripped"))


@query()
def md_to_html(spark: SparkSession, d: str) -> DataFrame:
    """Restricted HTML of each text (look-around has no SQL equal; golden cases in the tests)."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.md_to_html(F.col("text")).alias("html"))


@query(r"""SELECT id, coalesce(list_reduce(list_filter(string_split(trim(regexp_replace(message_text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''),
  lambda a, w: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 40 THEN a || ' ' || w ELSE a || chr(10) || w END), message_text) AS wrapped FROM history_messages""")
def wrap_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_messages", "id", "message_text").select("id", text.wrap(F.col("message_text"), 40).alias("wrapped"))


@query(r"""SELECT p_partkey, price[1]::DOUBLE AS price_in, price[2]::DOUBLE AS price_out, last_line FROM (
SELECT p_partkey, regexp_extract_all(t, '\d+(?:[.,]\d+)?') AS price, string_split(p_name || chr(10) || p_brand, chr(10))[-1] AS last_line
FROM (SELECT *, 'in ' || (p_size * 1.5)::DECIMAL(10,1)::VARCHAR || ' / out ' || (p_size * 4.5)::DECIMAL(10,1)::VARCHAR AS t FROM part))""")
def price_extract(spark: SparkSession, d: str) -> DataFrame:
    """Two prices out of a text, and the last line of a two-line model name."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    t = F.concat(F.lit("in "), (F.col("p_size") * 1.5).cast("decimal(10,1)").cast("string"), F.lit(" / out "), (F.col("p_size") * 4.5).cast("decimal(10,1)").cast("string"))
    return p.select("p_partkey", text.price(t, 1).alias("price_in"), text.price(t, 2).alias("price_out"), text.last_line(F.concat("p_name", F.lit("\n"), "p_brand")).alias("last_line"))


@query(r"""SELECT qa_id, len(list_filter(list_transform(string_split(all_zettel_ids, '|'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n_all,
len(list_filter(list_transform(string_split(relevant_zettel_ids, '|'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n_relevant FROM qa_pair""")
def pipe_lists(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_pair", "qa_id", "all_zettel_ids", "relevant_zettel_ids")
    n = lambda c: F.size(text.pipe_list(F.col(c))).cast("bigint")
    return q.select("qa_id", F.when(F.col("all_zettel_ids").isNotNull(), n("all_zettel_ids")).alias("n_all"), F.when(F.col("relevant_zettel_ids").isNotNull(), n("relevant_zettel_ids")).alias("n_relevant"))


_DEPTH = "coalesce(len(regexp_extract_all(lower(luhmann_id), '([0-9]+|[a-z]+)')), 0)::BIGINT"
_VALID = r"regexp_matches(lower(luhmann_id), '^[0-9]+([a-z][0-9]*|\.[0-9]+[a-z]?)*$')"


@query(f"WITH {Z} SELECT zettel_id, {_DEPTH} AS depth, CASE WHEN {_VALID} THEN {_DEPTH} END AS valid_depth FROM z")
def luhmann_depth(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("luhmann_id")
    return zettels(spark, d, "luhmann_id").select("zettel_id", luhmann.depth(c).alias("depth"), luhmann.valid_depth(c).alias("valid_depth"))


@query(f"WITH {Z} SELECT zettel_id, CASE WHEN {_VALID} THEN nullif(regexp_replace(lower(luhmann_id), '([.][0-9]+|[a-z]+|[0-9]+)$', ''), '') END AS parent FROM z")
def luhmann_parent(spark: SparkSession, d: str) -> DataFrame:
    return zettels(spark, d, "luhmann_id").select("zettel_id", luhmann.parent(F.col("luhmann_id")).alias("parent"))


@query(f"""WITH {Z} SELECT user_id, coalesce(max(CASE WHEN regexp_matches(luhmann_id, '^[0-9]+$') THEN try_cast(luhmann_id AS BIGINT) END), 0) AS max_root FROM z GROUP BY 1""")
def max_root(spark: SparkSession, d: str) -> DataFrame:
    z = zettels(spark, d, "user_id", "luhmann_id")
    n = F.when(F.col("luhmann_id").rlike("^[0-9]+$"), F.col("luhmann_id").try_cast("bigint"))
    return z.groupBy("user_id").agg(F.coalesce(F.max(n), F.lit(0)).alias("max_root"))


@query(r"""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 0 AS lvl FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2 FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3 FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY length(id), id) AS k FROM n),
lt AS (SELECT *, CASE WHEN k <= 26 THEN chr((96 + k)::INT) WHEN k <= 702 THEN chr((97 + (k - 27) // 26)::INT) || chr((97 + (k - 27) % 26)::INT)
  ELSE chr((97 + (k - 703) // 676)::INT) || chr((97 + ((k - 703) % 676) // 26)::INT) || chr((97 + (k - 703) % 26)::INT) END AS letters FROM o),
t(id, luhmann_id) AS (SELECT id, k::VARCHAR FROM lt WHERE parent IS NULL
  UNION ALL SELECT c.id, CASE WHEN regexp_matches(t.luhmann_id, '^[0-9]+$') THEN t.luhmann_id || '.' || c.k WHEN regexp_matches(t.luhmann_id, '[0-9]$') THEN t.luhmann_id || c.letters
  WHEN regexp_matches(t.luhmann_id, '[a-z]$') THEN t.luhmann_id || c.k ELSE t.luhmann_id || '.1' END FROM t JOIN lt c ON c.parent = t.id)
SELECT id, luhmann_id FROM t""")
def luhmann_assign(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical ids for a whole four-level tree of places, customers and orders."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "region").select(s("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = n.unionByName(table(spark, d, "nation").select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent")))
    n = n.unionByName(table(spark, d, "customer").select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent")))
    n = n.unionByName(table(spark, d, "orders").select(s("o", "o_orderkey").alias("id"), s("c", "o_custkey").alias("parent")))
    return assign.luhmann_ids(n)


@query(r"""SELECT id, CASE regexp_extract(lower(message_type), '\.[^./]+$') WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'txt' ELSE 'unsupported' END AS reader, 'tg_user_' || user_id AS tenant,
replace(replace(message_type, '/', '_'), ':', '_') AS safe FROM history_messages""")
def document_route(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "history_messages", "id", "user_id", "message_type")
    return m.select("id", text.route(F.col("message_type")).alias("reader"), text.tenant(F.col("user_id")).alias("tenant"), text.safe_file_name(F.col("message_type")).alias("safe"))


@query(f"WITH {Z} SELECT zettel_id, CASE WHEN len(tags) > 0 AND len(list_filter(tags, lambda x: x IS NOT NULL)) >= 0 THEN array_to_string(tags, ',') END AS joined, CASE WHEN is_root_topic THEN 'True' ELSE 'False' END AS flag FROM z")
def tag_codecs(spark: SparkSession, d: str) -> DataFrame:
    """The flat metadata form of tags and flags."""
    return zettels(spark, d, "tags", "is_root_topic").select("zettel_id", text.tags_to_text(F.col("tags")).alias("joined"), text.flag_to_text(F.col("is_root_topic")).alias("flag"))


@query("SELECT qa_id, len(list_filter(list_transform(string_split(key_concepts, ','), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM qa_pair WHERE key_concepts IS NOT NULL AND NOT starts_with(trim(key_concepts), '[')")
def coerced_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags out of loosely written lists."""
    q = table(spark, d, "qa_pair", "qa_id", "key_concepts").where(F.col("key_concepts").isNotNull() & ~F.trim("key_concepts").startswith("["))
    return q.select("qa_id", F.size(text.coerced_tags(F.col("key_concepts"))).cast("bigint").alias("n"))


@query("""SELECT zettel_id, row_number() OVER (ORDER BY created_at NULLS FIRST, note_id NULLS FIRST, luhmann_id NULLS FIRST, zettel_id) AS seq
FROM (SELECT zettel_id, min(created_at) AS created_at, min(note_id) AS note_id, min(luhmann_id) AS luhmann_id FROM zettel_card WHERE zettel_id IS NOT NULL GROUP BY 1)""")
def processing_order(spark: SparkSession, d: str) -> DataFrame:
    """The order in which cards are processed: by time, note and id as text."""
    c = table(spark, d, "zettel_card", "zettel_id", "created_at", "note_id", "luhmann_id").where("zettel_id is not null")
    c = c.groupBy("zettel_id").agg(*[F.min(x).alias(x) for x in ("created_at", "note_id", "luhmann_id")])
    return row_numbers(c, [], [F.col(x) for x in ("created_at", "note_id", "luhmann_id", "zettel_id")], "seq").select("zettel_id", "seq")


@query("""WITH n AS (SELECT DISTINCT note_id FROM zettel_card WHERE note_id IS NOT NULL ORDER BY md5(note_id || '|42'), note_id LIMIT 30)
SELECT DISTINCT note_id, zettel_id FROM zettel_card JOIN n USING (note_id)""")
def note_sample(spark: SparkSession, d: str) -> DataFrame:
    """The cards of 30 notes chosen by a seeded hash."""
    c = table(spark, d, "zettel_card", "note_id", "zettel_id").where("note_id is not null")
    picked = files.hash_sample(c.select("note_id").distinct(), "note_id", 30)
    return c.join(picked, "note_id", "left_semi").distinct()


@query("""SELECT '{"note_id":"' || note_id || '","zettel_ids":[' || string_agg('"' || zettel_id || '"', ',' ORDER BY zettel_id) || ']}' AS line
FROM (SELECT DISTINCT note_id, zettel_id FROM zettel_card WHERE note_id IS NOT NULL) GROUP BY note_id""")
def note_map_lines(spark: SparkSession, d: str) -> DataFrame:
    """The map of notes to cards as JSON lines."""
    return files.note_map_lines(table(spark, d, "zettel_card", "note_id", "zettel_id").where("note_id is not null"))


@query("SELECT zettel_id, '[' || strftime(created_at AT TIME ZONE 'UTC', '%d.%m.%Y %H:%M') || ' UTC] ' || content AS content FROM zettel_node WHERE content IS NOT NULL")
def dated_updates(spark: SparkSession, d: str) -> DataFrame:
    """The older form of an update: the text behind a label with its time."""
    z = table(spark, d, "zettel_node", "zettel_id", "content", "created_at").where("content is not null")
    return z.select("zettel_id", text.dated_update(F.col("content"), F.col("created_at")).alias("content"))


@query("SELECT user_id, count(*) AS n FROM zettel_node WHERE user_id <> 'tg_user_7000001' GROUP BY 1")
def tenant_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Rows per tenant once one tenant's partition is left out."""
    return oplog.drop_tenant(table(spark, d, "zettel_node", "user_id"), "tg_user_7000001").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
