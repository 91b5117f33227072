"""Per-document text quality statistics and the kind of text.

``with_statistics`` adds the statistics with built-in expressions only, so they are computed inside
the scan's stage. ``with_kind`` applies an ordered rule list learned by incremental reduced-error
pruning (``quality_fit``) as one SQL CASE over those statistics: no Python, no shuffle.

Defined results: a null or blank text has zero words, zero ratios and is ``junk``; very long texts are
measured whole; repeated rows give repeated rows; other columns of the input pass through, and the
statistics are added inside one struct column whose name the caller may choose (a column of that name
is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.quality_rules import RULES
from kgspark.tables import table

#: Frequent function words of Russian, English and German (ё written as е).
COMMON = (
    "и в во на с со к о об от до по за из у не что как а но или же бы если то это для при мы он она они его ее их все "
    "всё так уже еще когда чтобы потому поэтому пока где там тут мне нам вам вас нас меня себя был была было были есть "
    "после перед под над без между через около "
    "the of and to in a is on for that with as by at from it we be are was were has have had an or if so not but our "
    "my this there he she they his her you your will would can "
    "der die das und zu den von mit für auf ist wir im des dem nicht ein eine einen sich bei wird um bis am auch hat "
    "nach noch aus sonst ob weil dass sie er es"
).split()

BLANKS = " \n\r\t\u00a0\u200b"
#: What ends a line as a sentence, and what opens it as an item; all patterns run over whole texts, line by line.
_LINES = "(?dm)"
_STOP = r"[.!?…]['\"»”)\]]*+[^\S\n]*+$"
_CLOSED = rf"(?![^\n]*{_STOP})"
_MARK = r"^[^\S\n]*(?:[-*•▪◦‣·→►>+✓✔☐☑☒–—]+|\[[ xXхХ✓]?\]|\(?\d{1,3}[.)]|\(?\p{L}[.)])[^\S\n]+\S"
_SHORT = r"^(?=[^\n]{1,59}$)"
_SEEN = r"(?=[^\n]*[^\s\u200b])"
#: A first line that is one sentence: it introduces what follows and does not count in the shapes of the lines.
_LEAD = r"(?d)^\s*+(?![^\n]*\p{Ll}{2}['\"»”)]*[.!?…]\s+\p{Lu})[^\n]*[.!?…:]['\"»”)\]]*[^\S\n]*\n(?=\s*\S)"


#: Names of the statistics, in order.
STATISTICS = (
    "n_chars n_words mean_word_len symbol_ratio digit_ratio n_lines words_per_line end_punct_share marker_share short_open_share open_chars item_chars "
    "cell_share distinct_lines common_share distinct_words single_share title_share"
).split()


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(_LINES + pattern))


def _held(t: Column, pattern: str) -> Column:
    """Letters and marks of the lines that match, from the match on."""
    return F.length(t) - F.length(F.regexp_replace(t, _LINES + pattern + r"[^\n]*+", ""))


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats", only: set[str] | None = None) -> DataFrame:
    """``df`` with a struct column ``out`` holding the statistics of column ``text``, or ``only`` those of these names."""
    t = F.coalesce(F.col(text), F.lit(""))
    # A generator over one element keeps the optimizer from repeating the expressions of a row in
    # every statistic, and those of the statistics in every rule.
    tmp = "_parts"
    while tmp in df.columns:
        tmp += "_"
    held = lambda c: F.explode(F.array(c))
    plain = F.trim(F.regexp_replace(F.replace(F.lower(t), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", " "))
    made = df.withColumn(tmp, held(F.struct(t.alias("t"), plain.alias("plain"), F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, _LEAD, "")).otherwise(t).alias("body"))))
    whole, plain, body = (F.col(f"{tmp}.{c}") for c in ("t", "plain", "body"))
    parts = F.struct(
        whole.alias("t"), plain.alias("plain"), body.alias("body"),
        F.length(F.regexp_replace(whole, f"[{BLANKS}]+", "")).alias("solid"),
        F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")).alias("w"),
        _count(whole, rf"^{_SEEN}").alias("lines"), _count(body, rf"^{_SEEN}").alias("n_body"),
    )
    made = made.withColumn(tmp, held(parts))
    n_lines, n_body, n_solid, w = (F.col(f"{tmp}.{c}") for c in ("lines", "n_body", "solid", "w"))
    n, n_words = F.length(whole), F.size(w)
    n_word_chars = F.length(plain) - F.greatest(n_words - 1, F.lit(0))

    def several(share: Column) -> Column:
        return F.when(n_lines > 1, share).otherwise(F.lit(0.0))

    def delimited(seen: str, sep: str, least: int = 2) -> Column:
        return F.when(F.contains(body, F.lit(seen)), _count(body, rf"^[^\n]*?{sep}" + rf"(?:[^\n]*?{sep})" * (least - 1) + r"[^\n]*+")).otherwise(0)

    stats = [
        n.alias("n_chars"),
        n_words.alias("n_words"),
        _ratio(n_word_chars, n_words).alias("mean_word_len"),
        _ratio(F.greatest(n_solid - n_word_chars, F.lit(0)), n_solid).alias("symbol_ratio"),
        _ratio(n - F.length(F.regexp_replace(whole, "[0-9]+", "")), n_solid).alias("digit_ratio"),
        n_lines.alias("n_lines"),
        _ratio(n_words, n_lines).alias("words_per_line"),
        _ratio(_count(whole, _STOP), n_lines).alias("end_punct_share"),
        several(_ratio(_count(body, _MARK + _CLOSED), n_body)).alias("marker_share"),
        _ratio(_count(body, _SHORT + _SEEN + _CLOSED), n_body).alias("short_open_share"),
        _ratio(_held(body, _SHORT + _CLOSED), F.length(body)).alias("open_chars"),
        several(_ratio(_held(body, rf"(?:{_SHORT}|(?={_MARK})){_CLOSED}"), F.length(body))).alias("item_chars"),
        several(_ratio(F.greatest(delimited("|", r"\|"), delimited(";", ";"), delimited("\t", "\t"), delimited('"', r'(?:",\s?"|";")', 1), delimited("  ", r"\S {2,}(?=\S)"), delimited(",", r"\S,(?=\S)")), n_body)).alias("cell_share"),
        _ratio(F.size(F.array_distinct(F.split(body, r"\s*\n\s*"))), F.greatest(n_body, F.lit(1))).alias("distinct_lines"),
        _ratio(F.size(F.filter(w, lambda x: x.isin(*COMMON))), n_words).alias("common_share"),
        _ratio(F.size(F.array_distinct(w)), n_words).alias("distinct_words"),
        _ratio(F.regexp_count(plain, F.lit("(?<![^ ])[^ ](?![^ ])")), n_words).alias("single_share"),
        _ratio(F.regexp_count(whole, F.lit(r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})(?!\p{Lu})")), n_words).alias("title_share"),
    ]
    kept = [c for c, name in zip(stats, STATISTICS, strict=True) if only is None or name in only]
    return made.withColumn(out, held(F.struct(*kept))).drop(tmp)


def case_sql(rules: list, stats: str = "stats", default: str = "prose") -> str:
    """The rule list as a SQL CASE expression: first matching rule decides."""
    whens = []
    for kind, conds in rules:
        test = " AND ".join(f"{stats}.{name} {op} {value!r}D" for name, op, value in conds) or "true"
        whens.append(f"WHEN {test} THEN '{kind}'")
    return f"CASE {' '.join(whens)} ELSE '{default}' END" if whens else f"'{default}'"


def with_kind(df: DataFrame, text: str = "text", out: str = "kind", rules: list | None = None, only: set[str] | None = None) -> DataFrame:
    """``df`` with columns ``stats`` (``only`` some, which must hold what the rules test) and ``out`` (prose, list, table or junk)."""
    made = with_statistics(df, text, "stats", only)
    return made.withColumn(out, F.expr(case_sql(RULES if rules is None else rules)))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return with_kind(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    tested = {name for _, conds in RULES for name, _, _ in conds}
    return with_kind(table(spark, d, "documents", "doc_id", "text"), only=tested).where("kind <> 'prose'").select("doc_id", "kind").distinct()


MEASURES = ("mean_word_len", "symbol_ratio", "end_punct_share", "common_share")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document and its kind."""
    s = [F.col("stats.n_words").cast("bigint").alias("n_words"), *[F.round(f"stats.{c}", 6).alias(c) for c in MEASURES]]
    return _rated(spark, d).select("doc_id", *s, "kind")


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics alone, which SQL can express too."""
    return p10_stats(spark, d).drop("kind")


_LIST = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
_SQL = rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS p FROM documents),
b AS (SELECT *, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS w, length(translate(t, ' ' || chr(10) || chr(13) || chr(9) || chr(160) || chr(8203), '')) AS solid,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\x{{200b}}]')) AS l FROM a),
c AS (SELECT *, len(w)::BIGINT AS n_words, length(p) - greatest(len(w) - 1, 0) AS chars FROM b)
SELECT doc_id, n_words, round(coalesce(chars / nullif(n_words, 0), 0.0), 6) AS mean_word_len, round(coalesce(greatest(solid - chars, 0) / nullif(solid, 0), 0.0), 6) AS symbol_ratio,
round(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][''"»”)\]]*\s*$'))) / nullif(len(l), 0), 0.0), 6) AS end_punct_share,
round(coalesce(len(list_filter(w, lambda x: x IN ({_LIST}))) / nullif(n_words, 0), 0.0), 6) AS common_share FROM c"""
QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats, "p10_measures": p10_measures}
SQL: dict[str, str] = {"p10_measures": _SQL}
