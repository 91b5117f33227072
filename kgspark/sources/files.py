"""File sources and sinks, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import schema
from kgspark.functions import text


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole UTF-8 files with unix line ends."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.unix_newlines(F.col("value")).alias("content"))
    return t


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, reader): documents and sound files for a provider to read."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", "content", text.route(F.col("path")).alias("reader"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(path, content) from (path, page, text, tables): every page under a header, with all its tables."""
    block = F.concat(F.format_string("--- page %d ---\n", F.col("page").cast("int")), F.coalesce("text", F.lit("")), F.when(F.size("tables") > 0, F.concat(F.lit("\n"), F.array_join("tables", "\n"))).otherwise(""))
    b = pages.select("path", "page", block.alias("block")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "block"))).alias("b"))
    return b.select("path", F.array_join(F.transform("b", lambda r: r["block"]), "\n\n").alias("content"))


def call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CALL_LOG).option("header", True).csv(path)


def model_files(spark: SparkSession, glob: str, exclude: str, file_schema: str) -> DataFrame:
    """Rows of many CSV files with the model's key from the file name; names with ``exclude`` are skipped."""
    df = spark.read.schema(file_schema).option("header", True).csv(glob)
    name = F.col("_metadata.file_name")
    return df.withColumn("model", text.model_key(name)).where(~F.lower(name).contains(exclude.lower()))


def note_map(spark: SparkSession, path: str) -> DataFrame:
    """(note_id, zettel_id) from a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("note_id", "ids")).select("note_id", F.explode("ids").alias("zettel_id"))


def note_map_lines(links: DataFrame) -> DataFrame:
    """(line): one JSON object per note with its card ids in order, from (note_id, zettel_id)."""
    g = links.distinct().groupBy("note_id").agg(F.sort_array(F.collect_list("zettel_id")).alias("zettel_ids"))
    return g.select(F.to_json(F.struct("note_id", "zettel_ids")).alias("line"))


def write_note_map(links: DataFrame, path: str) -> None:
    note_map_lines(links).write.mode("overwrite").text(path)


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Required columns that a dataset lacks: it is then built anew."""
    return [c for c in needed if c not in df.columns]


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same rows every time, and in any engine that knows MD5."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key), F.lit(f"|{seed}")))


def backup_questions(notes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Plain questions for a deterministic sample of notes, numbered ``Q-BACKUP-0001`` on."""
    s = hash_sample(notes, "note_id", n, seed)
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy(seeded("note_id", seed), "note_id"))
    return s.select(F.format_string("Q-BACKUP-%04d", k).alias("question_id"), "note_id", F.concat(F.lit("What does this note say: "), text.preview(F.col("note_text"), 60)).alias("question"))


def synthetic_notes(spark: SparkSession, n: int, domains: list[str], styles: list[str], seed: int = 42, least: int = 3, most: int = 10) -> DataFrame:
    """Parameters of ``n`` synthetic notes, chosen by a seeded hash; a provider writes the texts."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003))
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (h(k) % len(xs) + 1).cast("int"))
    return spark.range(n).select(F.format_string("note_%06d", "id").alias("note_id"), (h(1) % (most - least + 1) + least).cast("int").alias("num_sentences"), pick(domains, 2).alias("domain"), pick(styles, 3).alias("style"))


def weighted_pool(spark: SparkSession, weights: dict[str, float], n: int) -> DataFrame:
    """(key) with floor(n * weight) copies each, topped up to ``n`` in order of weight."""
    rows = spark.createDataFrame(list(weights.items()), "key string, w double")
    got = rows.withColumn("c", F.floor(F.col("w") * n))
    short = n - sum(int(w * n) for w in weights.values())
    top = [k for k, _ in sorted(weights.items(), key=lambda x: (-x[1], x[0]))]
    extra = {k: short // len(top) + (i < short % len(top)) for i, k in enumerate(top)}
    add = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])[F.col("key")]
    return got.select(F.explode(F.array_repeat("key", (F.col("c") + add).cast("int"))).alias("key"))


def dataset_items(cards: DataFrame) -> DataFrame:
    """(note_id, item): one JSON document per note with its expected cards, for a dataset service."""
    c = cards.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("luhmann_id", "zettel_id", "content", "thought_type"))).alias("expected"))
    return c.select("note_id", F.to_json(F.struct("note_id", "expected")).alias("item"))


def report_rows(rows: DataFrame, section: str) -> DataFrame:
    """(section, key, value) rows of a result table, for a plain-text report."""
    key, *rest = rows.columns
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest])).alias("x")
    return rows.select(F.col(key).cast("string").alias("id"), parts).select(F.lit(section).alias("section"), F.concat_ws(".", "id", "x.k").alias("key"), F.col("x.v").alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.orderBy("section", "key").select(F.concat_ws("\t", "section", "key", "value")).write.mode("overwrite").text(path)


def create_tables(spark: SparkSession, database: str) -> None:
    """Tables of a fresh installation, partitioned by tenant; existing ones are kept."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.history_messages ({schema.MESSAGE}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.ops ({schema.OP}) USING parquet PARTITIONED BY (user_id)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.child_of ({schema.EDGE}) USING parquet PARTITIONED BY (user_id)")


def clear_messages(spark: SparkSession, database: str) -> None:
    spark.sql(f"TRUNCATE TABLE {database}.history_messages")


def run(spark: SparkSession, statement: str, **params) -> DataFrame:
    """A parameterised statement, lazily."""
    return spark.sql(statement, args=params)
