"""Units of documents to segments: sentences of every unit, numbered through the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexibridge.functions.sentences import sentences, simple_sentences
from lexibridge.functions.text import normalize_text


def segments(units: DataFrame) -> DataFrame:
    """(path, unit, key, sentence, source_text, seg_idx) of units (path, unit, key, text), in document order.

    seg_idx counts through a path; unit numbers it in the unit. Units without any text give no row.
    """
    each = units.select("path", "unit", "key", F.posexplode(sentences("text")).alias("sentence", "source_text"))
    # Sentences of the units before come from one row a unit, not from a window over all sentences.
    held = each.groupBy("path", "unit").agg(F.count("*").alias("n"))
    before = held.withColumn("first", F.sum("n").over(Window.partitionBy("path").orderBy("unit")) - F.col("n"))
    return each.join(before.drop("n"), ["path", "unit"]).select("path", "unit", "key", "sentence", "source_text", (F.col("first") + F.col("sentence")).alias("seg_idx"))


def simple_spans(units: DataFrame) -> DataFrame:
    """(path, unit, sentence, source_text, display_text, start, end) of units (path, unit, text) by the simpler rules.

    start and end are places in the text, in code points; the spans of a text cover it without gaps. Those of blanks alone stay, with
    an empty source_text, so that formats can be laid over the spans; null and empty texts give no row.
    """
    each = units.select("path", "unit", F.posexplode(simple_sentences("text")).alias("sentence", "piece"))
    # One window a text: its rows are the sentences of a single unit.
    end = F.sum(F.length("piece")).over(Window.partitionBy("path", "unit").orderBy("sentence"))
    ends = each.withColumn("end", end.cast("long"))
    # The blanks of the ends alone are taken off; those of `normalize_text` are runs of any.
    shown = F.regexp_replace("piece", r"^[\s\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{1C}-\x{1F}\x{85}\p{Z}]+\z", "")
    return ends.select("path", "unit", "sentence", normalize_text(shown).alias("source_text"), shown.alias("display_text"), (F.col("end") - F.length("piece")).alias("start"), "end")
