"""Languages of paths, token counts, and the lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMMARS = {
    "rust": ["rs"], "python": ["py", "pyi"], "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"],
    "go": ["go"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"], "java": ["java"], "ruby": ["rb"],
}
#: A token of the offline counter: a run of ASCII word characters, or another visible character.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"


def language_of(path: Column) -> Column:
    """Grammar by what follows the last dot (the whole path if there is none); null if unknown."""
    pairs = [F.lit(x) for name, ends in GRAMMARS.items() for e in ends for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), F.element_at(F.split(path, "\\."), -1))


def count_tokens(text: Column) -> Column:
    """Tokens of the offline counter; 0 for null and empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def lines(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, line_no from 0, line (without its line feed),
    start_byte, end_byte (with it), indent and is_blank.  A closing line feed
    starts no further line; empty and null texts have none."""
    parts = F.split(F.col(text), "\n", -1)
    exploded = files.where(F.octet_length(text) > 0).select(key, F.size(parts).alias("n"), F.posexplode(parts).alias("line_no", "line"))
    real = exploded.where((F.col("line_no") < F.col("n") - 1) | (F.octet_length("line") > 0))
    size = F.octet_length("line") + F.when(F.col("line_no") < F.col("n") - 1, 1).otherwise(0)
    lead = F.regexp_extract("line", r"^[ \t]*", 0)
    indent = F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))
    end = F.sum(size).over(window_of(key))
    return real.select(key, F.col("line_no").cast("long").alias("line_no"), "line", (end - size).cast("long").alias("start_byte"), end.cast("long").alias("end_byte"), indent.cast("long").alias("indent"), F.col("line").rlike(r"^[ \t\r]*$").alias("is_blank"))


def window_of(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("line_no")


def break_scores(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Score of breaking after each line but a file's last: 100 next to a blank
    line, and more the less the following line is indented."""
    w = window_of(key)
    scored = rows.select(key, "line_no", "is_blank", F.lead("is_blank").over(w).alias("next_blank"), F.lead("indent").over(w).alias("next_indent"))
    score = F.when(F.col("is_blank") | F.col("next_blank"), 100).otherwise(0) + F.greatest(F.lit(0), 50 - 5 * F.col("next_indent"))
    return scored.where(F.col("next_blank").isNotNull()).select(key, "line_no", score.cast("long").alias("score"))
