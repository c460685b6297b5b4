"""Readers of bilingual tables: CSV, TMX, TBX, workbooks, memory databases. All give source_text, target_text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First cells that mark a header row.
HEADERS = (("source", "target"), ("src", "tgt"), ("source text", "target text"), ("source_text", "target_text"), ("原文", "译文"))


#: Column names of glossaries, for source, target and note.
GLOSSARY_HEADERS = {
    "source_text": {"source", "source_text", "source_term", "term", "原文", "词汇", "词条", "术语"},
    "target_text": {"target", "target_text", "target_term", "translation", "译文", "翻译"},
    "note": {"note", "notes", "comment", "comments", "context", "remark", "remarks", "备注", "说明", "补充解释"},
}


def _names_columns(a: Column, b: Column) -> Column:
    named = F.lit(False)
    for x, y in HEADERS:
        named |= (F.lower(F.trim(a)) == x) & (F.lower(F.trim(b)) == y)
    return F.coalesce(named, F.lit(False))


def read_csv(spark: SparkSession, path: str, encoding: str | None = "UTF-8", header: str = "detect", delimiter: str = ",") -> DataFrame:
    """The first two columns. header: `detect` drops a file's first row if it names the columns, `yes`
    drops it always, `no` never. encoding: None takes every file for UTF-8 if it is valid, else for GB18030."""
    if encoding is None:
        files = spark.read.format("binaryFile").load(path).select("path", F.expr("is_valid_utf8(content)").alias("valid")).collect()  # one row a file
        valid, other = ([_literal(r.path) for r in files if r.valid == v] for v in (True, False))
        reads = [read_csv(spark, valid, "UTF-8", header, delimiter)] if valid or not other else []
        reads += [_decoded_csv(spark, other, header, delimiter)] if other else []
        return reads[0] if len(reads) == 1 else reads[0].unionByName(reads[1])

    def read(where, skip: bool) -> DataFrame:
        rows = spark.read.schema("source_text string, target_text string").csv(where, sep=delimiter, encoding=encoding, multiLine=True, escape='"', header=skip)
        return rows.withColumns({c: F.regexp_replace(c, "^\\x{FEFF}", "") for c in rows.columns})

    if header != "detect":
        return read(path, header == "yes")
    # Files come as they are numbered by the reader: the least number of a file is its first row.
    first = read(path, False).withColumns({"file": F.col("_metadata.file_path"), "n": F.monotonically_increasing_id()}).groupBy("file").agg(F.min_by(_names_columns(F.col("source_text"), F.col("target_text")), "n").alias("named"))
    files = first.collect()  # one row a file
    kinds = [([_as_read(r.file) for r in files if r.named], True), ([_as_read(r.file) for r in files if not r.named], False)]
    reads = [read(paths, skip) for paths, skip in kinds if paths]
    return read(path, False) if not reads else reads[0] if len(reads) == 1 else reads[0].unionByName(reads[1])


def _literal(path: str) -> str:
    """A path that a reader takes as it stands, whatever pattern signs it holds."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _as_read(uri: str) -> str:
    """The path of a file from the URI that the reader gives for it."""
    return _literal(unquote(uri))


def _decoded_csv(spark: SparkSession, paths: list[str], header: str, delimiter: str) -> DataFrame:
    """The same of files in GB18030, which Spark's own reader does not decode: one file at a time in a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        from itertools import islice

        for part in parts:
            for content in part["content"]:
                rows = ([*r, None, None][:2] for r in csv.reader(io.TextIOWrapper(io.BytesIO(content), "gb18030", "replace", newline=""), delimiter=delimiter) if r)
                first = next(rows, None)
                if first is not None and header != "yes" and not (header == "detect" and tuple((x or "").strip().lower() for x in first) in HEADERS):
                    yield pd.DataFrame([first], columns=["source_text", "target_text"])
                while some := list(islice(rows, 5000)):
                    yield pd.DataFrame(some, columns=["source_text", "target_text"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "source_text string, target_text string")


def _pick(texts: Column, language: str, position: int) -> Column:
    """The text of exactly this language, else of its primary language, else at this position."""
    primary = language.split("-")[0].lower()
    exact = F.filter(texts, lambda x: F.lower(x["lang"]) == language.lower())
    alike = F.filter(texts, lambda x: F.substring_index(F.lower(x["lang"]), "-", 1) == primary)
    at = lambda xs, i: F.get(xs, F.lit(i))["text"]
    return F.coalesce(at(exact, 0), at(alike, 0), at(texts, position))


def read_tmx(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """One row per unit that has both texts, with its id."""
    return read_tmx_units(spark, path, source, target).select("unit_id", "source_text", "target_text")


#: Attributes of units that are kept, and of the texts in them.
TMX_ATTRIBUTES = ("creationdate", "creationid", "changedate", "changeid", "usagecount", "lastusagedate", "datatype", "srclang")


def read_tmx_units(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """unit_id, source_text, target_text and metadata: the unit's attributes, properties and notes."""
    own = ", ".join(f"_{a} string" for a in TMX_ATTRIBUTES)
    units = spark.read.format("xml").option("rowTag", "tu").schema(f"_tuid string, {own}, prop array<struct<_type:string,_VALUE:string>>, note array<string>, tuv array<struct<`_xml:lang`:string,_lang:string,seg:string>>").load(path)
    given = F.map_filter(F.create_map(*[x for a in TMX_ATTRIBUTES for x in (F.lit(a), F.col(f"_{a}"))]), lambda k, v: v.isNotNull())
    props = F.transform(F.coalesce("prop", F.array().cast("array<struct<_type:string,_VALUE:string>>")), lambda p: F.struct(p["_type"].alias("type"), p["_VALUE"].alias("value")))
    metadata = F.struct(given.alias("attributes"), props.alias("props"), F.coalesce("note", F.array().cast("array<string>")).alias("notes")).alias("metadata")
    texts = F.transform("tuv", lambda v: F.struct(F.coalesce(v["_xml:lang"], v["_lang"]).alias("lang"), F.trim(v["seg"]).alias("text")))
    rows = units.select(F.col("_tuid").alias("unit_id"), texts.alias("t"), metadata).select("unit_id", _pick(F.col("t"), source, 0).alias("source_text"), _pick(F.col("t"), target, 1).alias("target_text"), "metadata")
    return rows.where((F.coalesce("source_text", F.lit("")) != "") & (F.coalesce("target_text", F.lit("")) != ""))


def read_tbx(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """One row per term entry that has both terms."""
    entries = spark.read.format("xml").option("rowTag", "termEntry").schema("_id string, langSet array<struct<`_xml:lang`:string,tig:struct<term:string>,ntig:struct<termGrp:struct<term:string>>>>").load(path)
    texts = F.transform("langSet", lambda v: F.struct(v["_xml:lang"].alias("lang"), F.trim(F.coalesce(v["tig"]["term"], v["ntig"]["termGrp"]["term"])).alias("text")))
    rows = entries.select(F.col("_id").alias("entry_id"), texts.alias("t")).select("entry_id", _pick(F.col("t"), source, 0).alias("source_text"), _pick(F.col("t"), target, 1).alias("target_text"))
    return rows.where((F.coalesce("source_text", F.lit("")) != "") & (F.coalesce("target_text", F.lit("")) != ""))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of .xlsx files: one task per file, rows as they are read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        local = lambda e: e.tag.rpartition("}")[2]
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                book = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = ["".join(t.text or "" for t in item.iter() if local(t) == "t") for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
                for sheet in sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
                    out = []
                    for _, row in ElementTree.iterparse(book.open(sheet)):
                        if local(row) != "row":
                            continue
                        cells: dict[int, str] = {}
                        for n, c in enumerate(e for e in row if local(e) == "c"):
                            letters = re.match("[A-Z]*", c.get("r") or "")[0]
                            at = -1 if letters else n
                            for x in letters:
                                at = (at + 1) * 26 + ord(x) - 65
                            text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                        out.append((name, sheet, int(row.get("r") or len(out) + 1), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
                        row.clear()
                    yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def read_memory_database(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, source_text, target_text) of SQLite memories with a table translation_units of XML segments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for part in parts:
            for content in part["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                rows = db.execute("SELECT id, source_segment, target_segment FROM translation_units")
                while batch := rows.fetchmany(5000):
                    yield pd.DataFrame(batch, columns=["unit_id", "source", "target"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "unit_id long, source string, target string")
    text = lambda c: unescaped(F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)<Value>(.*?)</Value>"), 1), ""))
    return raw.select("unit_id", text("source").alias("source_text"), text("target").alias("target_text"))


def unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _write_lines(rows: DataFrame, path: str, line: Column, head: str, foot: str) -> None:
    """One text file per partition: head, a line for every row, foot; every file is whole by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        yield from parts
        yield pd.DataFrame({"value": [foot]})

    rows.select(line.alias("value")).mapInPandas(run, "value string").write.text(path)


def _xml(c: str) -> Column:
    return escaped(F.coalesce(F.col(c), F.lit("")))


def write_tmx(pairs: DataFrame, path: str, source: str, target: str) -> None:
    """Memory exchange files of source_text and target_text, one file per partition."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header creationtool="lexibridge" creationtoolversion="1" segtype="sentence" o-tmf="none" adminlang="en" srclang="{source}" datatype="plaintext"/><body>'
    side = lambda lang, c: [F.lit(f'<tuv xml:lang="{lang}"><seg>'), _xml(c), F.lit("</seg></tuv>")]
    _write_lines(pairs, path, F.concat(F.lit("<tu>"), *side(source, "source_text"), *side(target, "target_text"), F.lit("</tu>")), head, "</body></tmx>")


def write_tbx(pairs: DataFrame, path: str, source: str, target: str) -> None:
    """Term exchange files of source_text and target_text, one file per partition."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<martif type="TBX" xml:lang="{source}"><text><body>'
    side = lambda lang, c: [F.lit(f'<langSet xml:lang="{lang}"><tig><term>'), _xml(c), F.lit("</term></tig></langSet>")]
    _write_lines(pairs, path, F.concat(F.lit("<termEntry>"), *side(source, "source_text"), *side(target, "target_text"), F.lit("</termEntry>")), head, "</body></text></martif>")


def write_xliff(segments: DataFrame, path: str, source: str, target: str) -> None:
    """Interchange files of unit_id, source_text, target_text and status, one file per partition."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file original="segments" source-language="{source}" target-language="{target}" datatype="plaintext"><body>'
    state = F.when(F.coalesce(F.col("target_text"), F.lit("")) == "", "needs-translation").when(F.col("status") == "confirmed", "final").otherwise("translated")
    line = F.concat(F.lit('<trans-unit id="'), _xml("unit_id"), F.lit('"><source>'), _xml("source_text"), F.lit('</source><target state="'), state, F.lit('">'), _xml("target_text"), F.lit("</target></trans-unit>"))
    _write_lines(segments.withColumn("unit_id", F.col("unit_id").cast("string")), path, line, head, "</body></file></xliff>")


def write_csv(rows: DataFrame, path: str, *columns: str) -> None:
    """Comma-separated files with a header and a byte order mark before it, as spreadsheets want it."""
    chosen = rows.select(*columns)
    marked = [F.col(c).cast("string").alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(columns)]
    chosen.select(*marked).write.csv(path, header=True, escape='"')


#: What an alignment row is called, by which side is empty and by its level.
ALIGNMENT_STATUS = {"missing": "缺译", "added": "增译", "low": "低置信", "medium": "建议复核", "high": "已对齐"}


def alignment_rows(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs as rows for review: pair_index, source_indices, target_indices, both texts, confidence, level, method, status."""
    # A pair's own row and the units of both sides in one go, so that the alignment that pairs come from runs once.
    head = F.struct("src", "tgt", "confidence", "level", "method")
    none = F.lit(None).cast(pairs.select(head.alias("pair")).schema["pair"].dataType)
    row = lambda side, place, i, pair: F.struct(side.cast("string").alias("side"), place.cast("int").alias("place"), i.cast("int").alias("unit_index"), pair.alias("pair"))
    of = lambda side, c: F.coalesce(F.transform(c, lambda i, place: row(F.lit(side), place, i, none)), F.array())
    each = pairs.select("pair_id", "pair_order", F.explode(F.concat(F.array(row(F.lit(None), F.lit(None), F.lit(None), head)), of("source", "src"), of("target", "tgt"))).alias("u")).select("pair_id", "pair_order", "u.*")
    held = each.join(units.select("pair_id", "side", "unit_index", "text"), ["pair_id", "side", "unit_index"], "left")
    text = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", "text")))), lambda x: x["text"]), " ").alias(f"{side}_text")
    both = held.groupBy("pair_id", "pair_order").agg(F.first("pair", ignorenulls=True).alias("pair"), text("source"), text("target")).select("pair_id", "pair_order", "pair.*", "source_text", "target_text")
    kind = F.when(F.size("tgt") == 0, "missing").when(F.size("src") == 0, "added").otherwise(F.col("level"))
    status = F.element_at(F.create_map(*[F.lit(x) for p in ALIGNMENT_STATUS.items() for x in p]), kind)
    comma = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return both.select("pair_id", F.col("pair_order").alias("pair_index"), comma("src").alias("source_indices"), comma("tgt").alias("target_indices"), "source_text", "target_text", "confidence", F.col("level").alias("confidence_level"), "method", status.alias("status"))


def write_workbook(rows: DataFrame, path: str, *columns: str) -> None:
    """Workbooks (.xlsx) of one sheet, one for each partition, packed in the tasks that hold the rows.

    The sheet is written as it is compressed; a partition that may exceed a sheet's 1048575 rows must be split first.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v is not None else "<c/>"
                line = lambda n, values: sheet.write(f'<row r="{n}">{"".join(map(cell, values))}</row>'.encode())
                sheet.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                line(1, columns)
                n = 1
                for part in parts:
                    for values in part.astype(object).where(part.notna(), None).itertuples(index=False):
                        n += 1
                        line(n, values)
                sheet.write(b"</sheetData></worksheet>")
        yield pd.DataFrame({"rows": [n - 1], "content": [buffer.getvalue()]})

    packed = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInPandas(run, "rows long, content binary")
    packed.where("rows > 0").write.parquet(path)


def reviewed_columns(rows: DataFrame, reviewed: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """`rows` with a column `<target>_reviewed` after each of its `targets`: what `reviewed`
    (keys, column, text) holds for it, else empty. For workbooks that go back to their reviewers."""
    wide = reviewed.groupBy(*keys).pivot("column", targets).agg(F.max("text")) if targets else reviewed.select(*keys).distinct()
    named = wide.select(*keys, *[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(f"{t}_reviewed") for t in targets])
    order = [x for c in rows.columns for x in ([c, f"{c}_reviewed"] if c in targets else [c])]
    return rows.join(named, keys, "left").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c.endswith("_reviewed") and c not in rows.columns else F.col(c) for c in order])


def read_terms(spark: SparkSession, path: str, kind: str, source: str = "", target: str = "") -> DataFrame:
    """source_text, target_text of term lists by their format: csv, xlsx, tmx or tbx; rows without both are left out."""
    if kind == "csv":
        rows = read_csv(spark, path, None)
    elif kind == "xlsx":
        rows = read_pairs(spark, path)
    else:
        rows = {"tmx": read_tmx, "tbx": read_tbx}[kind](spark, path, source, target)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.select(text("source_text").alias("source_text"), text("target_text").alias("target_text")).where("source_text <> '' AND target_text <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source_text, target_text of the first two columns of all sheets; a sheet's first row goes if it names the columns."""
    rows = read_workbook(spark, path).select("row", F.get("cells", F.lit(0)).alias("source_text"), F.get("cells", F.lit(1)).alias("target_text"))
    return rows.where(~((F.col("row") == 1) & _names_columns(F.col("source_text"), F.col("target_text")))).select("source_text", "target_text")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """source_text, target_text, note of glossary workbooks. A sheet's first row that names a source and a
    target column says where they are; sheets without one have them in their first three columns."""
    rows = read_workbook(spark, path)
    names = F.transform("cells", lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), " ", "_"))
    place = {c: F.coalesce(F.get(F.filter(F.transform(names, lambda x, i: F.when(x.isin(sorted(aliases)), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1)).alias(c) for c, aliases in GLOSSARY_HEADERS.items()}
    heads = rows.where("row = 1").select("path", "sheet", F.struct(*place.values()).alias("h")).where("h.source_text >= 0 AND h.target_text >= 0")
    both = rows.join(heads, ["path", "sheet"], "left").where(~((F.col("row") == 1) & F.col("h").isNotNull()))
    cell = lambda c, default: F.trim(F.coalesce(F.when(F.coalesce(F.col(f"h.{c}"), F.lit(default)) >= 0, F.get("cells", F.coalesce(F.col(f"h.{c}"), F.lit(default)))), F.lit(""))).alias(c)
    return both.select(cell("source_text", 0), cell("target_text", 1), cell("note", 2)).where("source_text <> '' AND target_text <> ''")


def import_preview(rows: DataFrame, existing: DataFrame, key: str = "source_text") -> DataFrame:
    """Rows with how often their key comes in the import and whether the table has it."""
    counts = rows.groupBy(key).agg(F.count("*").alias("copies"))
    known = existing.select(key).distinct().withColumn("exists", F.lit(True))
    return rows.join(counts, key).join(known, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
