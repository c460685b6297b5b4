"""Number queries: orders as sentences in two languages, whose numbers SQL writes down from the columns themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibridge.operators import numbergrammar as N
from lexibridge.plans import views as V
from lexibridge.plans.registry import query

#: Sentences by the remainder of o_orderkey: n customer, m a small number, Y M D the day, q its quarter; and the numbers in them.
SENTENCES = [
    ("Paid USD {n} million on {Y}-{M}-{D}, up {m} percent.", ["USD {n}000000", "{Y}-{M2}-{D2}", "{m}"]),
    ("In fiscal year {Y}, Q{q} grew by {m} percentage points.", ["FY{Y}", "Q{q}", "{m}"]),
    ("July {D}, {Y}: {n} kWh and {m}/{n} of it", ["{Y}-07-{D2}", "{n} kWh", "{m}/{n}"]),
    ("共{n}万元，{m}个百分点，{Y}年{M}月{D}日", ["RMB {n}0000", "{m}", "{Y}-{M2}-{D2}"]),
    ("the {m}th century, the {Y}s, {n} BC", ["{m}th century", "{Y}s", "{n} BC"]),
    ("Phase II, one third of 1,0{m},000 and {n}.5", ["Phase 2", "1/3", "10{m}000", "{n}.5"]),
    ("三分之二 of 第二季度, ⅷ and ③", ["2/3", "Q2", "8", "3"]),
    ("twenty thousand, the fifth of PM2.5 at {m}+{n}", ["20000", "5", "PM2.5", "{m}+{n}"]),
    ("XIV and the {n}th; {m}亿千瓦时", ["14", "{n}", "{m}00000000 kWh"]),
    ("壹万贰仟元伍角, {m}.5 percent, 1990-{Y}", ["12000.5", "{m}.5", "1990-{Y}"]),
    ("no. {n} and 一百二十三, 东经{m}°10′5″", ["{n}", "123", "{m}°10'5'' E"]),
    ("单位：亿元, two point five of {n}千米 in May", ["RMB 100000000", "2.5", "{n} kilometers", "5"]),
]
_PARTS = {"n": "1 + o_custkey", "m": "10 + o_orderkey % 89", "Y": "year(o_orderdate)", "M": "month(o_orderdate)", "D": "day(o_orderdate)", "q": "quarter(o_orderdate)"}
_PADDED = {"M2": "lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0')", "D2": "lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')"}


def _filled(sentence: str) -> str:
    """A sentence with its parts as an SQL expression."""
    pieces = [p for part in sentence.replace("'", "''").split("{") for p in part.split("}")]
    known = {**{k: f"CAST({v} AS VARCHAR(20))" for k, v in _PARTS.items()}, **_PADDED}
    return " || ".join(known[p] if i % 2 else f"'{p}'" for i, p in enumerate(pieces) if p or i % 2)


def _chosen(shift: int, which: int) -> str:
    texts = [s[0] if which == 0 else "|".join(s[1]) for s in SENTENCES]
    return f"CASE (o_orderkey + {shift}) % {len(texts)} " + " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(texts)) + " END"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dealt(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))


@query(f"SELECT o_orderkey, {_chosen(0, 1)} AS numbers FROM orders")
def grammar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of every order's sentence."""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.expr(_chosen(0, 0)).alias("text"))
    return N.with_numbers(rows, "text", "found").select("o_orderkey", F.array_join(F.transform("found", lambda x: x.value), "|").alias("numbers"))


_SIDES_SQL = f"""sides AS (SELECT o_orderkey, string_split({_chosen(0, 1)}, '|') AS s, CASE WHEN o_orderkey % 3 = 0 THEN string_split({_chosen(0, 1)}, '|') WHEN o_orderkey % 3 = 1 THEN string_split({_chosen(0, 1)}, '|')[2:] ELSE list_concat(string_split({_chosen(0, 1)}, '|'), ['77777']) END AS t FROM orders)"""


@query(f"""WITH {_SIDES_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN s[1] ELSE '' END AS missing, CASE WHEN o_orderkey % 3 = 2 THEN '77777' ELSE '' END AS extra FROM sides""")
def grammar_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are whole, that lack the first number, or have one more."""
    whole = F.expr(_chosen(0, 0))
    rows = _orders(spark, sf_dir).select("o_orderkey", whole.alias("source_text"))
    # The first number goes with its piece: the target is put together again from the others. Only texts that lose one are cut.
    cut = N.with_pieces(rows.withColumn("losing", F.when(F.col("o_orderkey") % 3 == 1, F.col("source_text"))), "losing", "pieces")
    first = F.array_position(F.transform("pieces", lambda p: p.family.isNotNull()), True)
    shorter = F.array_join(F.transform(F.transform("pieces", lambda p, i: F.when(i + 1 == first, " ").otherwise(p.text)), lambda x: x), "")
    target = F.when(F.col("o_orderkey") % 3 == 0, F.col("source_text")).when(F.col("o_orderkey") % 3 == 1, shorter).otherwise(F.concat("source_text", F.lit(" / 77777")))
    found = N.grammar_differences(cut.select("o_orderkey", "source_text", target.alias("target_text")))
    return found.select("o_orderkey", F.array_join("missing", "|").alias("missing"), F.array_join("extra", "|").alias("extra"))
