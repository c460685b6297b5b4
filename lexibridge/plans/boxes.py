"""Queries over boxes of text: documents laid out as pages, five words a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.operators import boxes as B
from lexibridge.operators import graphs as G
from lexibridge.plans import views as V
from lexibridge.plans.registry import query


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document in rows of eight boxes; sizes, turns, styles and layers follow from the places alone."""
    lines = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "words")).withColumn("words", F.split("words", " "))
    # Words are cut before parts get rows of their own: a row holds a part's words, not its whole line's.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 5).cast("int")), lambda part: F.array_join(F.slice("words", part * 5 + 1, 5), " "))
    parts = lines.select("page", "line", F.posexplode(cut).alias("part", "text"))
    placed = parts.withColumn("height", (10 + F.col("page") % 3 + F.when(F.col("line") % 11 == 10, 5).otherwise(0)).cast("double"))
    row = F.floor(F.col("part") / 8)
    return placed.select(
        "page",
        F.when(F.col("line") % 17 == 16, "notes").otherwise("body").alias("layer"),
        (F.col("page") * 1_000_000_000 + F.col("line") * 100_000 + F.col("part")).alias("box_id"),
        "line",
        "part",
        "text",
        ((F.col("part") % 8) * 22 * F.col("height") + (F.col("page") + F.col("line") * 3 + F.col("part")) % 5 * 4.0).alias("x"),
        (-18.0 * (F.col("line") * 2 + row) + (F.col("part") % 3)).alias("y"),
        (F.length("text") * F.col("height") * 0.6).alias("width"),
        "height",
        F.when((F.col("page") * 5 + F.col("line")) % 29 == 0, 3.0).when(F.col("part") % 37 == 36, 8.0).otherwise(0.0).alias("rotation"),
        F.when(F.col("part") % 13 == 12, "bold").otherwise("plain").alias("style"),
    )


def lines(laid: DataFrame) -> DataFrame:
    """Rules under and beside some of the boxes."""
    under = laid.where((F.col("line") + F.col("part")) % 7 == 3).select("page", F.lit("h").alias("axis"), (F.col("y") - 4).alias("place"), F.col("x").alias("low"), (F.col("x") + F.col("width")).alias("high"))
    beside = laid.where((F.col("line") * 3 + F.col("part")) % 11 == 5).select("page", F.lit("v").alias("axis"), (F.col("x") + F.col("width") + 1).alias("place"), (F.col("y") - F.col("height")).alias("low"), (F.col("y") + 2 * F.col("height")).alias("high"))
    return under.unionByName(beside)


def _relation_sql(before: str, after: str) -> str:
    within = lambda mark, marks: f"{mark} IN ({', '.join(repr(m) for m in marks)})"
    end, start, title = f"right({before}, 1)", f"left({after}, 1)", f"'{B.TITLE}'"
    return f"""CASE WHEN {before} = '' OR {after} = '' THEN 0
    WHEN {start} = '《' OR regexp_matches({after}, {title}) OR (regexp_matches({before}, {title}) AND length({before}) <= 12) OR ({within(end, B.SENTENCE_ENDS)} AND NOT {within(start, B.CLOSERS)})
        OR ({within(end, B.COLONS)} AND ({within(start, B.LIST_MARKS)} OR regexp_matches({before}, {title}))) OR ({end} = '、' AND {start} = '、') THEN -1
    WHEN ({end} = '-' AND regexp_matches({start}, '^[a-z]')) OR regexp_matches({before}, '({'|'.join(B.CONTINUING)})$') OR {within(end, B.OPEN_ENDS)} OR {within(start, B.CLOSERS)} THEN 1 ELSE 0 END"""


_BOXES_SQL = """split_lines AS (
    SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), parts AS (
    SELECT page, line, string_split(words, ' ') AS words, unnest(range((len(string_split(words, ' ')) - 1) // 5 + 1)) AS part FROM split_lines
), laid AS (
    SELECT page, line, part, array_to_string(list_slice(words, part * 5 + 1, part * 5 + 5), ' ') AS text, CAST(10 + page % 3 + CASE WHEN line % 11 = 10 THEN 5 ELSE 0 END AS DOUBLE) AS height FROM parts
), boxes AS (
    SELECT page, CASE WHEN line % 17 = 16 THEN 'notes' ELSE 'body' END AS layer, page * 1000000000 + line * 100000 + part AS box_id, line, part, text,
           (part % 8) * 22 * height + (page + line * 3 + part) % 5 * 4.0 AS x, CAST(-18.0 * (line * 2 + part // 8) + (part % 3) AS DOUBLE) AS y, length(text) * height * 0.6 AS width, height,
           CASE WHEN (page * 5 + line) % 29 = 0 THEN 3.0 WHEN part % 37 = 36 THEN 8.0 ELSE 0.0 END AS rotation, CASE WHEN part % 13 = 12 THEN 'bold' ELSE 'plain' END AS style FROM laid
)"""
_LINES_SQL = """lines AS (
    SELECT page, 'h' AS axis, y - 4 AS place, x AS low, x + width AS high FROM boxes WHERE (line + part) % 7 = 3
    UNION ALL SELECT page, 'v', x + width + 1, y - height, y + 2 * height FROM boxes WHERE (line * 3 + part) % 11 = 5
)"""
_COLON = lambda t: f"right({t}, 1) IN (':', '：')"
_STANDARD = lambda t: f"regexp_matches({t}, '{B.STANDARD}')"
_PAIRS_SQL = f"""{_BOXES_SQL}, met AS (
    SELECT a.page, a.box_id AS a, b.box_id AS b, (a.height + b.height) / 2 AS mean, abs(a.y - b.y) AS rise, abs(a.rotation - b.rotation) AS turn, trim(a.text) AS text_a, trim(b.text) AS text_b,
           a.x AS x_a, b.x AS x_b, a.x + a.width AS right_a, b.x + b.width AS right_b, a.width AS width_a, b.width AS width_b, a.height AS height_a, b.height AS height_b, a.style <> b.style AS styles_differ, a.y >= b.y AS a_upper,
           least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS wide, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS high
    FROM boxes a JOIN boxes b ON a.page = b.page AND a.layer = b.layer AND a.box_id < b.box_id
    WHERE abs(a.height - b.height) / greatest(a.height, b.height) <= 0.3 AND abs(a.y - b.y) <= (a.height + b.height) / 2 * 3.0 AND abs(a.rotation - b.rotation) <= 5.0
), measured AS (
    SELECT *, rise <= mean * 0.8 AS same_row, CASE WHEN x_a <= x_b THEN x_b - right_a ELSE x_a - right_b END AS gap, CASE WHEN a_upper THEN text_a ELSE text_b END AS upper_text, CASE WHEN a_upper THEN text_b ELSE text_a END AS lower_text,
           CASE WHEN x_a <= x_b THEN text_a ELSE text_b END AS left_text, CASE WHEN x_a <= x_b THEN text_b ELSE text_a END AS right_text,
           CASE WHEN wide <= 0 OR high <= 0 THEN 0.0 ELSE wide * high / (greatest(width_a * height_a, 1e-6) + greatest(width_b * height_b, 1e-6) - wide * high) END AS share FROM met
), related AS (
    SELECT *, CASE WHEN same_row THEN CASE WHEN regexp_matches(left_text, '{B.NUMBER_ONLY}') THEN 1 ELSE {_relation_sql('left_text', 'right_text')} END ELSE {_relation_sql('upper_text', 'lower_text')} END AS relation FROM measured
), scored AS (
    SELECT *, CASE WHEN same_row THEN 1 - rise / (mean * 0.8) ELSE 0.7 * (1 - (rise - mean * 0.8) / (mean * 3.0 - mean * 0.8)) END * 0.4 + CASE WHEN same_row THEN 1 - greatest(0.0, gap) / (mean * 3.0) ELSE 0.8 END * 0.4 + (1 - turn / 5.0) * 0.2 - CASE WHEN styles_differ THEN 0.3 ELSE 0.0 END AS styled
    FROM related WHERE share < 0.5 AND relation >= 0 AND NOT ({_COLON('text_a')} AND {_COLON('text_b')}) AND CASE
        WHEN same_row THEN gap <= mean * 3.0 AND (gap >= -greatest(mean * 2, CASE WHEN width_a > 0 AND width_b > 0 THEN least(width_a, width_b) ELSE mean END * 0.6) OR ({_STANDARD('text_a')} AND {_STANDARD('text_b')}))
        ELSE (wide > 0 OR abs(x_a - x_b) < mean * 3.0) AND NOT (length(lower_text) <= 32 AND {_COLON('lower_text')}) AND NOT {_STANDARD('text_a')} AND NOT {_STANDARD('text_b')} END
), pairs AS (
    SELECT page, a, b, same_row, gap, rise, CASE WHEN relation = 1 THEN least(1.0, styled + 0.15) ELSE styled END AS score FROM scored WHERE styled > 0
)"""


@query(f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scored_pairs(boxes(spark, sf_dir))


_BLOCKED_SQL = f"""{_PAIRS_SQL}, {_LINES_SQL}, asked AS (
    SELECT p.a, p.b, p.page, CASE WHEN same_row THEN 'v' ELSE 'h' END AS axis, CASE WHEN same_row THEN least(a.x, b.x) ELSE least(a.y, b.y) END AS start, CASE WHEN same_row THEN greatest(a.x, b.x) ELSE greatest(a.y, b.y) END AS stop,
           CASE WHEN same_row THEN least(a.y, b.y) ELSE least(a.x, b.x) END AS low, CASE WHEN same_row THEN greatest(a.y + a.height, b.y + b.height) ELSE greatest(a.x + a.width, b.x + b.width) END AS high
    FROM pairs p JOIN boxes a ON a.box_id = p.a JOIN boxes b ON b.box_id = p.b
), blocked AS (
    SELECT a, b FROM asked q WHERE EXISTS (SELECT 1 FROM lines l WHERE l.page = q.page AND l.axis = q.axis AND l.place BETWEEN q.start AND q.stop
        AND ((l.low <= q.low AND l.high >= q.high) OR (l.low <= q.high AND l.high >= q.low AND least(l.high, q.high) - greatest(l.low, q.low) >= 0.5 * (q.high - q.low))))
)"""


@query(f"WITH {_BLOCKED_SQL} SELECT p.page, p.a, p.b, p.same_row, blocked.a IS NOT NULL AS blocked FROM pairs p LEFT JOIN blocked USING (a, b)")
def box_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs a line lies between."""
    laid = boxes(spark, sf_dir)
    return B.marked_pairs(B.scored_pairs(laid, way=True).drop("gap", "rise", "score", "x_a", "x_b"), lines(laid), B.line_bins(laid)).select("page", "a", "b", "same_row", "blocked")


@query(f"""WITH {_BOXES_SQL}, {_LINES_SQL}, shifted AS (SELECT page, axis, round(place / 50) * 50 + 0.0 AS place, low, high FROM lines),
marked AS (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY page, axis, place ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM shifted),
runs AS (SELECT *, sum(new) OVER (PARTITION BY page, axis, place ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT page, axis, place, min(low) AS low, max(high) AS high FROM runs GROUP BY page, axis, place, run""")
def barrier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near one place as runs."""
    return B.merged_lines(lines(boxes(spark, sf_dir)).withColumn("place", F.round(F.col("place") / 50) * 50 + 0.0))


_OPEN_SQL = f"{_BLOCKED_SQL}, open_pairs AS (SELECT p.* FROM pairs p ANTI JOIN blocked USING (a, b) WHERE p.score >= 0.8)"


def _open_pairs(laid: DataFrame) -> DataFrame:
    good = B.scored_pairs(laid, way=True).where("score >= 0.8").drop("gap", "rise")
    return B.unblocked_pairs(good, laid, lines(laid))


@query(f"""WITH RECURSIVE {_OPEN_SQL}, links AS MATERIALIZED (SELECT a, b FROM open_pairs UNION SELECT b, a FROM open_pairs), reach(node, low) AS (
    SELECT a, a FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
) SELECT node, min(low) AS component FROM reach GROUP BY node""")
def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that are connected by good pairs that no line lies between."""
    return G.components(_open_pairs(boxes(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_OPEN_SQL}, sided AS MATERIALIZED (
    SELECT CASE WHEN x.x <= y.x THEN p.a ELSE p.b END AS node, CASE WHEN x.x <= y.x THEN p.b ELSE p.a END AS after, p.score FROM open_pairs p JOIN boxes x ON x.box_id = p.a JOIN boxes y ON y.box_id = p.b WHERE p.same_row
), links AS MATERIALIZED (
    SELECT node, after FROM sided QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, after) = 1 AND row_number() OVER (PARTITION BY after ORDER BY score DESC, node) = 1
), walk(node, head, place) AS (
    SELECT node, node, 0 FROM links WHERE node NOT IN (SELECT after FROM links) UNION ALL SELECT l.after, w.head, w.place + 1 FROM walk w JOIN links l ON l.node = w.node
) SELECT node, head, CAST(place AS BIGINT) AS place, false AS in_ring FROM walk""")
def box_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a row that are each other's best neighbours, with their places in the chain."""
    laid = boxes(spark, sf_dir)
    pairs = _open_pairs(laid).where("same_row")
    ahead = F.col("x_a") <= F.col("x_b")
    sided = pairs.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("after"), "score")
    links = G.cut(B.mutual_best(sided, "node", "after", "score"))
    return G.chain_ranks(links.unionByName(links.select(F.col("after").alias("node")).join(links.select("node"), "node", "left_anti").withColumn("after", F.lit(None).cast("long"))))


_SPACED_SQL = f"""CASE WHEN before IS NULL OR before = '' OR right(before, 1) IN ({', '.join(repr(m) for m in B.UNSPACED)}) OR left(text, 1) IN ({', '.join(repr(m) for m in B.UNSPACED)}) OR regexp_matches(text, '{B.JOINED_NUMBER}')
    OR (regexp_matches(right(before, 1), '[0-9]') AND regexp_matches(text, '{B.MEASURES}')) OR (regexp_matches(right(before, 1), '{B.CJK}') AND regexp_matches(left(text, 1), '{B.CJK}')) OR gap < tall * 0.5 THEN false
    WHEN gap > tall * 1.5 THEN true ELSE regexp_matches(right(before, 1), '{B.CJK}') <> regexp_matches(left(text, 1), '{B.CJK}') END"""


@query(f"""WITH {_BOXES_SQL}, averaged AS (SELECT page * 100000 + line AS cluster, box_id, x, y, height, x + width AS right_edge, trim(text) AS text, avg(height) OVER (PARTITION BY page, line) * 0.8 AS row_height FROM boxes),
ordered AS (SELECT *, row_number() OVER w AS place, lag(text) OVER w AS before, x - lag(right_edge) OVER w AS gap, (height + lag(height) OVER w) / 2 AS tall FROM averaged WINDOW w AS (PARTITION BY cluster ORDER BY -(round_even(y / row_height, 0) * row_height), x, box_id))
SELECT cluster, count(*) AS n_boxes, coalesce(string_agg(CASE WHEN {_SPACED_SQL} THEN ' ' ELSE '' END || text, '' ORDER BY place) FILTER (text <> ''), '') AS text FROM ordered GROUP BY cluster""")
def box_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each line as one text."""
    return B.reading_text(boxes(spark, sf_dir).withColumn("cluster", F.col("page") * 100_000 + F.col("line")))


@query()
def box_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters as sentences; SQL has no form for the vetoes in order of score."""
    laid = boxes(spark, sf_dir)
    barred = lines(laid)
    parts = B.clusters(laid, B.unblocked_pairs(B.scored_pairs(laid, way=True).drop("gap", "rise", "x_a", "x_b"), laid, barred), barred)
    # The confidences come with the texts: another look at `parts` would join all boxes once more.
    return B.reading_text(laid.join(parts, "box_id"), least=("confidence",))
