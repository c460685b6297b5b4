r"""Exact duplicates by recipes of content-defined chunks.

A text without its blanks is cut where its own bytes say so, so that equal passages give
equal chunks wherever they lie. Every distinct chunk is moved once, to the other chunks of
its identifier, and compared with them byte by byte; only identifiers that name one
content each are used. A text is then its recipe, the ordered list of its chunks'
identifiers, and texts are equal exactly where recipes are. Recipes, about one hundredth
of the text, are all that is grouped and joined.

Copies of one text are first summed up within blocks of neighbouring rows, so that no task
ever receives more than one row a block for a text, however many copies there are.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.common import materialise

#: Bytes of a chunk: none ends earlier than LEAST but at the end of its text, none is longer than MOST.
LEAST, MOST = 512, 8192
#: Bits that number the rows of one block.
BLOCK_BITS = 13
BLANKS = r"[\x20\x09-\x0D]+"


def _an_eighth(factor: int) -> str:
    """A pattern for one eighth of all bytes, spread by an odd factor."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b * factor % 256 < 32) + "]"


#: A chunk ends behind three bytes of which each is in its own eighth: at one place in 512 of random bytes.
CHUNK = "(?s).{%d}.{0,%d}?(?:%s|\\z)|.{1,%d}" % (LEAST - 3, MOST - LEAST, "".join(map(_an_eighth, (167, 89, 211))), MOST)


def bare(text: Column) -> Column:
    """The text without spaces, tabs and line ends; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(text: Column) -> Column:
    """The chunks of a text in order, as strings of one character a byte; an empty text has none."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, seed: int, bits: int) -> Column:
    """Two hashes of `bits` bits each."""
    return F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(seed), chunk), 64 - bits).alias("a"), F.shiftrightunsigned(F.xxhash64(chunk, F.lit(seed)), 64 - bits).alias("b"))


def verified_seed(docs: DataFrame, bits: int = 64) -> int:
    """The first seed whose identifiers name one content each, shown by comparing all distinct chunks.

    With 64 bits a seed fails with a probability below 1e-15 at 1e11 chunks; then the next one is tried.
    """
    pieces = docs.select(F.explode(chunks(bare(F.col("text")))).alias("chunk"))
    for seed in count():
        contents = pieces.select(_identifier(F.col("chunk"), seed, bits).alias("chunk_id"), "chunk").distinct()
        if contents.groupBy("chunk_id").count().where("count > 1").count() == 0:
            return seed
    raise AssertionError


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of `docs`: (doc_id, keep_id, group_size, kept, text_sha256).

    Rows are of one group where their texts agree in all but blanks (space, tab to carriage return); a null text is
    empty, and all empty texts are one group. Of a group the row of the most code points in its whole text stays, of
    these the one of the least doc_id (a null id last), of rows that agree in both any one: `kept` marks exactly one row a
    group, keep_id is its doc_id. group_size counts rows. Repeated rows are rows of their own. Only doc_id and
    text are read, so other columns may have any names; an empty table gives no rows.
    bits: size of each half of an identifier; it does not change the result.
    """
    seed = verified_seed(docs, bits)
    text = bare(F.col("text"))
    signed = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), F.transform(chunks(text), lambda c: _identifier(c, seed, bits)).alias("recipe"))
    rows = materialise(signed).withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.shiftright("row", BLOCK_BITS))
    first = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    parts = rows.groupBy("recipe", "block").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    groups = parts.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"))
    named = parts.select("recipe", "block").join(groups, "recipe").select("recipe", "block", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    return rows.join(named, ["recipe", "block"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
