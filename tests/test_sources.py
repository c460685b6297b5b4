import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lexibridge.sources import documents, tables

TMX = """<?xml version="1.0"?><tmx><body>
<tu tuid="1"><tuv xml:lang="en-US"><seg>Hello</seg></tuv><tuv xml:lang="de-DE"><seg>Hallo</seg></tuv></tu>
<tu tuid="2"><tuv xml:lang="en"><seg>Only</seg></tuv></tu></body></tmx>"""
TBX = """<?xml version="1.0"?><martif><body>
<termEntry id="7"><langSet xml:lang="en"><tig><term>house</term></tig></langSet><langSet xml:lang="de"><tig><term>Haus</term></tig></langSet></termEntry></body></martif>"""


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tmx_and_tbx(spark, tmp_path):
    got = tables.read_tmx(spark, write(tmp_path / "a.tmx", TMX), "en-US", "de")
    assert [tuple(r) for r in got.collect()] == [("1", "Hello", "Hallo")]
    got = tables.read_tbx(spark, write(tmp_path / "a.tbx", TBX), "en", "de")
    assert [tuple(r) for r in got.collect()] == [("7", "house", "Haus")]


def test_tmx_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("a & b", "x < y"), ("c", "d")], "source_text string, target_text string")
    tables.write_tmx(pairs, f"{tmp_path}/out", "en", "de")
    got = tables.read_tmx(spark, f"{tmp_path}/out", "en", "de").select("source_text", "target_text")
    assert {tuple(r) for r in got.collect()} == {("a & b", "x < y"), ("c", "d")}


def test_csv_header_detection(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Source,Target\nHi,"Ha, llo"\n')
    assert [tuple(r) for r in tables.read_csv(spark, path).collect()] == [("Hi", "Ha, llo")]
    assert tables.read_csv(spark, path, header="no").count() == 2


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Hi</t></si></sst>')
    assert tables.read_workbook(spark, f"{tmp_path}/a.xlsx").first().cells == ["Hi", None, "5"]


def test_memory_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.sdltm")
    db.execute("CREATE TABLE translation_units (id INTEGER, source_segment TEXT, target_segment TEXT)")
    db.execute("INSERT INTO translation_units VALUES (1, '<S><Value>A &amp;</Value><Value> B</Value></S>', '<S><Value>C</Value></S>')")
    db.commit()
    db.close()
    assert tuple(tables.read_memory_database(spark, f"{tmp_path}/a.sdltm").first()) == (1, "A & B", "C")


CASES = [
    ("txt", "One\n\nTwo\nlines\n", [(None, "One"), (None, "Two\nlines")]),
    ("srt", "1\n00:01 --> 00:02\nHi\n\n2\n00:03 --> 00:04\nYou\n", [("00:01 --> 00:02", "Hi"), ("00:03 --> 00:04", "You")]),
    ("properties", "# c\na=1\nb : two \\\n  more\n", [("a", "1"), ("b", "two more")]),
    ("strings", '"k" = "v";\n', [("k", "v")]),
    ("php", "<?php return ['a' => 'x', 'b' => 'y'];", [("a", "x"), ("b", "y")]),
    ("po", 'msgid ""\nmsgstr "head"\n\nmsgid "a"\n"b"\nmsgstr "c"\n', [("ab", "c")]),
    ("json", '{"a": ["x", {"b": "y"}], "n": 1}', [("a.0", "x"), ("a.1.b", "y")]),
    ("html", "<div><p>A <b>b</b></p><script>x</script><p>C</p></div>", [("div/p", "A b"), ("div/p", "C")]),
    ("md", "# Head\ntext one\n\n- item\n", [("#", "Head"), ("", "text one"), ("-", "item")]),
]


@pytest.mark.parametrize("kind, text, want", CASES)
def test_units(spark, tmp_path, kind, text, want):
    got = documents.read_units(spark, write(tmp_path / f"a.{kind}", text), kind).orderBy("unit").collect()
    assert [(r.key, r.text) for r in got] == want


def test_write_back(spark, tmp_path):
    units = documents.read_units(spark, write(tmp_path / "a.properties", "a=1\nb=2\n"), "properties")
    new = units.where("key = 'b'").withColumn("text", F.lit("zwei"))
    assert documents.write_back(units, new, F.concat("key", F.lit("="), "text")).first().value == "a=1\nb=zwei"


MORE = [
    ("yaml", "a:\n  - x\n  - b: y\nn: 1\n", [("a.0", "x"), ("a.1.b", "y")]),
    ("csv", "name;n\nalpha;1,000\n;beta\n", [("0,0", "name"), ("0,1", "n"), ("1,0", "alpha"), ("2,1", "beta")]),
    ("xml", "<topic><title>A <b>bold</b> one</title><body><p>Two</p><p translate='no'>x</p></body></topic>", [("topic/title", "A bold one"), ("topic/body/p", "Two")]),
    ("svg", "<svg xmlns='http://www.w3.org/2000/svg'><title>T</title><text id='a'>One <tspan>two</tspan></text><path d='M0'/></svg>", [("title", "T"), ("text#a", "One two")]),
]


@pytest.mark.parametrize("kind, text, want", MORE)
def test_units_of_more_formats(spark, tmp_path, kind, text, want):
    got = documents.read_units(spark, write(tmp_path / f"a.{kind}", text), kind).orderBy("unit").collect()
    assert [(r.key, r.text) for r in got] == want


def test_malformed_json_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)json"):
        documents.read_units(spark, write(tmp_path / "a.json", "{x"), "json").collect()


def test_only_a_first_row_is_a_header(spark, tmp_path):
    write(tmp_path / "a.csv", "source,target\na,b\nsource,target\n")
    write(tmp_path / "b.csv", "c,d,extra\nSource,Target,x\n")
    got = tables.read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("Source", "Target"), ("a", "b"), ("c", "d"), ("source", "target")]
    assert tables.read_csv(spark, str(tmp_path), header="yes").count() == 3


def test_files_of_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("原文,译文\n你好,hello\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes("\ufeff早,morning\n".encode())
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path), None).collect()} == {("你好", "hello"), ("早", "morning")}
    assert tables.read_terms(spark, str(tmp_path), "csv").count() == 2


def test_tmx_metadata(spark, tmp_path):
    text = TMX.replace('<tu tuid="1">', '<tu tuid="1" creationid="me"><prop type="p">v</prop><note>n</note>')
    r = tables.read_tmx_units(spark, write(tmp_path / "a.tmx", text), "en", "de").first()
    assert (r.metadata.attributes, r.metadata.props[0].value, r.metadata.notes) == ({"creationid": "me"}, "v", ["n"])


def test_written_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a & b", "x <y>", "confirmed"), ("2", "c", "", "none")], "unit_id string, source_text string, target_text string, status string").coalesce(1)
    tables.write_tbx(rows.where("target_text <> ''"), f"{tmp_path}/tbx", "en", "de")
    assert [tuple(r) for r in tables.read_terms(spark, f"{tmp_path}/tbx", "tbx", "en", "de").collect()] == [("a & b", "x <y>")]
    tables.write_xliff(rows, f"{tmp_path}/xliff", "en", "de")
    got = documents.read_bilingual(spark, f"{tmp_path}/xliff").orderBy("unit").collect()
    assert [(r.unit_id, r.source_text, r.target_text, r.status) for r in got] == [("1", "a & b", "x <y>", "final"), ("2", "c", "", "needs-translation")]
    tables.write_csv(rows, f"{tmp_path}/csv", "source_text", "target_text")
    assert sorted(tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/csv", header="yes").na.fill("").collect()) == [("a & b", "x <y>"), ("c", "")]
    tables.write_workbook(rows, f"{tmp_path}/books", "source_text", "target_text")
    (tmp_path / "a.xlsx").write_bytes(spark.read.parquet(f"{tmp_path}/books").first().content)
    assert [tuple(r) for r in tables.read_pairs(spark, f"{tmp_path}/a.xlsx").collect()] == [("a & b", "x <y>"), ("c", "")]
    assert [tuple(r) for r in tables.read_glossary(spark, f"{tmp_path}/a.xlsx").collect()] == [("a & b", "x <y>", "")]


def test_bilingual_files_and_archives(spark, tmp_path):
    unit = '<x xmlns:sdl="s"><trans-unit id="u"><source>A. B.</source><seg-source><mrk mtype="seg" mid="1">A.</mrk> <mrk mtype="seg" mid="2">B.</mrk></seg-source><target><mrk mtype="seg" mid="1">Ä.</mrk></target><sdl:seg-defs><sdl:seg id="1" conf="Translated"/></sdl:seg-defs></trans-unit></x>'
    got = documents.read_bilingual(spark, write(tmp_path / "a.sdlxliff", unit)).collect()
    assert [(r.unit_id, r.source_text, r.target_text, r.status) for r in got] == [("u:1", "A.", "Ä.", "Translated"), ("u:2", "B.", "", None)]
    txml = '<txml><translatable><segment segmentId="s1"><source>Hi</source><target>Ho</target></segment></translatable></txml>'
    assert [tuple(r)[2:5] for r in documents.read_bilingual(spark, write(tmp_path / "a.txml", txml)).collect()] == [("s1", "Hi", "Ho")]
    with zipfile.ZipFile(tmp_path / "inner.zip", "w") as z:
        z.writestr("deep/b.json", '{"k": "v"}')
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(tmp_path / "inner.zip", "inner.zip")
        z.writestr("a.txt", "One\n\nTwo\n")
        z.writestr("skip.bin", "x")
    got = documents.read_archive(spark, f"{tmp_path}/outer.zip").collect()
    assert sorted((r.path.partition("!")[2], r.unit, r.text) for r in got) == [("a.txt", 0, "One"), ("a.txt", 1, "Two"), ("inner.zip!deep/b.json", 0, "v")]


def test_reviewed_columns_stand_by_their_targets(spark):
    rows = spark.createDataFrame([(1, "s", "t", "u"), (2, "s2", "t2", "u2")], "id int, source string, de string, fr string")
    reviewed = spark.createDataFrame([(1, "de", "T!")], "id int, column string, text string")
    got = tables.reviewed_columns(rows, reviewed, ["id"], ["de", "fr"])
    assert got.columns == ["id", "source", "de", "de_reviewed", "fr", "fr_reviewed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "s", "t", "T!", "u", ""), (2, "s2", "t2", "", "u2", "")]


def test_csv_paths_of_any_signs(spark, tmp_path):
    folder = tmp_path / "a b+c"
    folder.mkdir()
    for n, name in enumerate(("x y.csv", "50%20.csv", "[1].csv", "é#?.csv")):
        (folder / name).write_text(f"Source,Target\ns{n},t{n}\n" if n % 2 else f"s{n},t{n}\n", encoding="utf-8")
    for encoding in ("UTF-8", None):
        got = sorted(tuple(r) for r in tables.read_csv(spark, str(folder), encoding).collect())
        assert got == [(f"s{n}", f"t{n}") for n in range(4)]
