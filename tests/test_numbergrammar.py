"""Every family of numbers by hand, in both languages."""

from dataclasses import replace

import pytest

from lexibridge.operators import numbergrammar as N
from lexibridge.plans import catalogue

CASES = {
    "单位：万元 12": ["RMB 10000", "12"],
    "Unit: USD million 7": ["USD 1000000", "7"],
    "up 3.50 percentage points, 2个百分点": ["3.5", "2"],
    "5 percent of 1,200%": ["5", "1200"],
    "USD 12.5 million or RMB 3": ["USD 12500000", "RMB 3"],
    "14.06万元, 3亿美元": ["RMB 140600", "USD 300000000"],
    "22°26'59'' N, 东经113°45′42″": ["22°26'59'' N", "113°45'42'' E"],
    "fiscal year 2023 and 2024财年": ["FY2023", "FY2024"],
    "the 21st century, 20世纪30年代, the 1930s, 19世纪": ["21th century", "1930s", "1930s", "19th century"],
    "221 BC, AD 25, 公元前221年, 公元25年": ["221 BC", "AD 25", "221 BC", "AD 25"],
    "Q3, the second quarter, 第四季度": ["Q3", "Q2", "Q4"],
    "1990-1995, 2001—2003年": ["1990-1995", "2001-2003"],
    "2024/3/5, 2024年03月05日, July 12, 2028, 1 Sept. 2020": ["2024-03-05", "2024-03-05", "2028-07-12", "2020-09-01"],
    "二〇二六年三月二十一日, 一九九九年": ["2026-03-21", "1999"],
    '"12 + 7"': ["12+7"],
    "壹万贰仟元伍角": ["12000.5"],
    "1377亿立方米, 5 亿千瓦时, 8公里": ["137700000000 cubic meters", "500000000 kWh", "8 kilometers"],
    "3百万, 2千, 6千米": ["3000000", "2000", "6 kilometers"],
    "500 million kWh, 3.0 kg, 7 km": ["500000000 kWh", "3 kg", "7"],
    "1,234,567.80 and 12,3": ["1234567.8", "12", "3"],
    "PM2.5 and CO2": ["PM2.5", "CO2"],
    "3/4 of 0.25, 123456": ["3/4", "0.25", "123456"],
    "③ Phase IV 二期": ["3", "Phase 4", "Phase 2"],
    "XIV, mcm, (i) one, e.g. i.e.": ["14", "1900", "1", "1"],
    "Ⅷ ⅸ": ["8", "9"],
    "two-thirds, 四分之三, 一半": ["2/3", "3/4", "1/2"],
    "May, the twentieth, 3rd": ["5", "20", "3"],
    "three point one four, twenty thousand, seven": ["3.14", "20000", "7"],
    "一千二百零三万, 十二, 两": ["12030000", "12", "2"],
    "a 万 of 42": ["10000", "42"],
    "none here": [],
    "": [],
}


def test_every_family(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string").coalesce(1)
    got = {r.t: [v.value for v in r.v] for r in N.with_numbers(df, "t", "v").collect()}
    assert got == CASES


def test_families_take_each_place_once(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string").coalesce(1)
    for r in N.with_pieces(df, "t", "p").collect():
        assert "".join(p.text for p in r.p) == (r.t or "")


@pytest.mark.parametrize(("source", "target", "want"), [("5万元", "RMB 50,000", ([], [], False)), ("二 and 3", "three, two", ([], [], True)), ("7%", "8 percent", (["7"], ["8"], False))])
def test_differences(spark, source, target, want):
    r = N.grammar_differences(spark.createDataFrame([(source, target)], "source_text string, target_text string")).first()
    assert (r.missing, r.extra, r.reordered) == want


def test_a_match_holds_one_of_its_familys_words(spark):
    """Without their words every family is tried on every text: the pieces are the same."""
    df = spark.createDataFrame([(t,) for t in CASES] + [(t.upper(),) for t in CASES] + [("I\nV.\n",), ("x (v\x85",)], "t string").coalesce(1)
    tried = [replace(f, needs=()) for f in N.FAMILIES]
    assert [r.p for r in N.with_pieces(df, "t", "p").collect()] == [r.p for r in N.with_pieces(df, "t", "p", tried).collect()]


@pytest.mark.parametrize("name", ["grammar_numbers", "grammar_differences"])
def test_work_of_one_row_group_is_dealt_out(spark, data, name):
    found = catalogue.queries()[name](spark, data)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # Pieces are not gone through once more for every family.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 0
