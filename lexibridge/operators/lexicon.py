"""Variant lexicons: merging, words that may not be replaced, and replacement in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(rows: DataFrame) -> DataFrame:
    """(source, target, tags, origins): pairs once each, case ignored, with all tags and origins of their rows."""
    low = rows.select(F.lower(F.trim("source")).alias("source"), F.lower(F.trim("target")).alias("target"), "tag", "origin").where("source <> '' AND target <> '' AND source <> target")
    return low.groupBy("source", "target").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array_sort(F.collect_set("origin")).alias("origins"))


def enabled(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(source, target, enabled): a source with several targets is disabled; then every word that is both an enabled source
    and an enabled target is disabled as a source, until there is none.

    One round leaves no such word: whoever is a source of that kind goes, and targets only shrink with it. The loop
    ends when a round disables nothing, and is bounded for safety.
    """
    counts = pairs.groupBy("source").agg(F.countDistinct("target").alias("n"))
    now = pairs.select("source", "target").distinct().join(counts, "source").withColumn("enabled", F.col("n") == 1).drop("n")
    for _ in range(rounds):
        on = now.where("enabled")
        both = on.select("source").join(on.select(F.col("target").alias("source")), "source", "left_semi").distinct()
        if both.isEmpty():
            return now
        now = now.join(both.withColumn("off", F.lit(True)), "source", "left").withColumn("enabled", F.col("enabled") & F.col("off").isNull()).drop("off")
        now = now.checkpoint() if now.sparkSession.sparkContext.getCheckpointDir() else now
    raise ValueError("the lexicon did not settle")


#: Entries up to which a lexicon is sent to every task.
MOST_ENTRIES = 2_000_000


def converted(texts: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """`texts` with the words of `column` that the lexicon (source, target) has replaced, longest first, between
    word boundaries and in the case that they had. Tags <...> stay as they are. The lexicon goes to every task; a
    larger one than MOST_ENTRIES is refused.
    """
    pairs = {r.source: r.target for r in lexicon.select("source", "target").limit(MOST_ENTRIES + 1).collect()}
    if len(pairs) > MOST_ENTRIES:
        raise ValueError("the lexicon is too large to be sent to every task")
    names = texts.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        longest = max((len(s.split(" ")) for s in pairs), default=0)
        token = re.compile(r"<[^<>]*>|[^\W_]+(?:['-][^\W_]+)*")

        def fitted(old: str, new: str) -> str:
            return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

        def convert(text: str | None) -> str | None:
            if not text or not pairs:
                return text
            spans = [m.span() for m in token.finditer(text)]
            out, at, i = [], 0, 0
            while i < len(spans):
                for n in range(min(longest, len(spans) - i), 0, -1):
                    old = text[spans[i][0] : spans[i + n - 1][1]]
                    new = None if old[0] == "<" else pairs.get(old.lower())
                    if new is not None:
                        out += [text[at : spans[i][0]], fitted(old, new)]
                        at, i = spans[i + n - 1][1], i + n
                        break
                else:
                    i += 1
            return "".join([*out, text[at:]])

        for part in parts:
            part[column] = [convert(t) for t in part[column]]
            yield part[names]

    return texts.mapInPandas(run, texts.schema)
