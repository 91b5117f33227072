"""Text functions as column expressions (built-ins only, so they stay in whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s+"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WS, " "))


def clean_content(c: Column) -> Column:
    """White space collapsed; a final stop added unless the text ends in ``.``, ``!`` or ``?``; empty stays empty."""
    t = collapse(c)
    return F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def normalize_tags(c: Column, most: int = 5) -> Column:
    """Trimmed, lower case, blanks and hyphens as ``_``; empty ones dropped, each once, the first ``most``."""
    named = F.transform(c, lambda t: F.translate(F.trim(F.lower(t)), " -", "__"))
    return F.slice(F.array_distinct(F.filter(named, lambda t: t.isNotNull() & (t != ""))), 1, most)


def entity_name(c: Column) -> Column:
    """The same normal form for lookups."""
    return F.translate(F.trim(F.lower(c)), " -", "__")


def eval_tag(c: Column) -> Column:
    """Trimmed, lower case, white space as ``_``, everything but letters, digits and ``_`` deleted."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), _WS, "_"), r"[^\p{L}\p{N}_]", "")


def preview(c: Column, width: int) -> Column:
    """White space collapsed; longer texts cut to ``width`` - 1 characters and an ellipsis."""
    t = collapse(c)
    return F.when(F.length(t) > width, F.concat(F.rtrim(F.substring(t, 1, width - 1)), F.lit("…"))).otherwise(t)


def tree_preview(c: Column, depth: Column) -> Column:
    """Cut to max(40, 120 - 4 * depth) characters and three dots."""
    width = F.greatest(F.lit(40), 120 - 4 * depth)
    t = collapse(c)
    return F.when(F.length(t) > width, F.concat(F.left(t, width), F.lit("..."))).otherwise(t)


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[.!?]+"), lambda x: F.trim(F.regexp_replace(x, _WS, " ")) != "")).cast("bigint")


def pipe_list(c: Column, sep: str = r"\|") -> Column:
    """The non-blank trimmed members of a joined list."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def price(c: Column, at: int) -> Column:
    """The ``at``-th decimal number in a text, null if there is none."""
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), 0)
    return F.translate(F.try_element_at(found, F.lit(at)), ",", ".").cast("double")


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), -1)


def md_to_html(c: Column) -> Column:
    """Restricted markdown to restricted HTML: escaping, headings, bold, italic, code, links, bullets."""
    t = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for pattern, to in (
        (r"(?m)^#{1,6}\s+(.+)$", "<b>$1</b>"),
        (r"\*\*([^*\n]+)\*\*", "<b>$1</b>"),
        (r"__([^_\n]+)__", "<b>$1</b>"),
        (r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "<i>$1</i>"),
        (r"`([^`\n]+)`", "<code>$1</code>"),
        (r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>'),
        (r"(?m)^\s*[-*]\s+", "• "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return t


def is_markdown(c: Column) -> Column:
    return c.rlike(r"(?m)(^#{1,6}\s|\*\*[^*\n]+\*\*|`[^`\n]+`|^\s*[-*]\s|\[[^\]\n]+\]\(https?://)")


def strip_tags(c: Column) -> Column:
    """Tags removed and the rest escaped."""
    t = F.regexp_replace(c, r"<[^>]+>", "")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unix_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def wrap(c: Column, width: int | Column) -> Column:
    """Greedy word wrap into lines of at most ``width`` characters; longer words keep a line of their own."""
    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")

    def add(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= width)
        line = F.when(acc["line"] == "", w).when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w)
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"])))
        return F.struct(done.alias("done"), line.alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    end = F.aggregate(words, start, add)
    return F.array_join(F.concat(end["done"], F.array(end["line"])), "\n")


def tenant(c: Column) -> Column:
    return F.concat(F.lit("tg_user_"), c.cast("string"))


def safe_file_name(c: Column) -> Column:
    return F.translate(c, "/:", "__")


def model_key(c: Column) -> Column:
    """The model's key in a file name: the stem without a leading kind and a trailing suffix, lower case."""
    stem = F.regexp_extract(F.lower(c), r"([^/]+?)(?:\.[^./]+)?$", 1)
    return F.regexp_replace(stem, r"^(?:test|linker|atomizer|thoughts)_|_(?:results?|dataset|cards)$", "")


def extension(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"\.[^./]+$", 0)


def route(c: Column) -> Column:
    """How a document of that name is read: ``pdf``, ``txt`` or ``unsupported``."""
    e = extension(c)
    return F.when(e == ".pdf", "pdf").when(e == ".txt", "txt").otherwise("unsupported")


def dated_update(content: Column, at: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(at, "dd.MM.yyyy HH:mm"), F.lit(" UTC] "), content)


def tags_to_text(c: Column) -> Column:
    """Comma-joined tags of the flat metadata form; null for none."""
    return F.when(F.size(c) > 0, F.array_join(c, ","))


def text_to_tags(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def flag_to_text(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def text_to_flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def coerced_tags(c: Column) -> Column:
    """Tags from a list literal, else from comma-separated text; trimmed, non-empty; none for null and ``nan``."""
    listed = F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")
    t = F.when(F.trim(c).startswith("["), listed).otherwise(F.split(c, ","))
    t = F.filter(F.transform(t, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "nan"), F.array().cast("array<string>")).otherwise(F.coalesce(t, F.array().cast("array<string>")))
