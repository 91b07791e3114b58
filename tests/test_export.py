import pytest
from pyspark.sql import functions as F

from vellum.operators import export
from vellum.sources import exports

HTML = '<h1 class="a">Title</h1><p style="x: y; color: #A0b1C2; font-size: 9.5pt"><b><i>Cost $5</p><li></li><table><u>t</table><p>plain text'


def pages(spark, n=40):
    return spark.createDataFrame([(i, HTML if i % 3 else "<p>none<b>", "u") for i in range(n)], "page_id long, html string, url string")


def plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns(spark, tmp_path):
    export.write_export(exports.export_frames(pages(spark)), str(tmp_path), 4)
    made = export.open_export(spark, str(tmp_path))
    rows = {r.element_order: r for r in made.elements().where("export_id = 1").collect()}
    assert [rows[k].element_type for k in sorted(rows)] == ["h1", "p", "li", "table", "p"]
    p = rows[1]
    assert p.element_text == "Cost $5" and p.element_html == '<p style="x: y; color: #A0b1C2; font-size: 9.5pt"><b><i>Cost $5' and p.element_metadata == '{"page": 1, "level": 0, "position": 1}'
    assert (p.style_bold, p.style_italic, p.font_size, p.font_color, p.semantic_role, p.word_count, p.char_count) == (True, True, 9.5, "#a0b1c2", "financial_text", 2, 7)
    assert rows[3].style_underline and rows[3].semantic_role == "data_table" and rows[0].font_size == 24.0 and rows[0].semantic_role == "header"
    e = made.exports.where("export_id = 1").first()
    assert e.edit_count == 1 and e.edited_html == HTML.replace("<b>", "<strong>") and e.original_html == HTML and e.source_path == "scans/1/1.pdf"
    s = {r.export_id: r for r in export.summary(made).collect()}
    assert len(s) == 40 and s[1].elements == 5 and s[1].headers == 1 and s[1].words == 6 and s[0].elements == 1


def test_joins_shuffle_nothing(spark, tmp_path, no_broadcast):
    export.write_export(exports.export_frames(pages(spark)), str(tmp_path))
    made = export.open_export(spark, str(tmp_path))
    text = plan(made.elements())
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") >= 2 and "Exchange" not in text
    # the sums of elements are dealt out, the exports stay where they are
    text = plan(export.summary(made)).split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "HashAggregate" in text


def test_other_session(spark, tmp_path, no_broadcast):
    """A session that hasn't written the export knows its buckets from the manifest."""
    export.write_export(exports.export_frames(pages(spark)), str(tmp_path), 4)
    mine = export.open_export(spark, str(tmp_path))
    want = sorted(map(str, mine.elements().collect()))
    mine.forget(spark)
    assert not [t for t in spark.catalog.listTables() if mine.version in t.name]
    other = export.open_export(spark, str(tmp_path), mine.version)
    assert sorted(map(str, other.elements().collect())) == want and "Exchange" not in plan(other.elements())


def test_failed_write_shows_nothing(spark, tmp_path):
    frames = exports.export_frames(pages(spark))
    broken = frames | {"semantics": frames["semantics"].withColumn("semantic_role", F.raise_error(F.lit("lost")).cast("string"))}
    with pytest.raises(Exception, match="lost"):
        export.write_export(broken, str(tmp_path), 2)
    with pytest.raises(FileNotFoundError):
        export.open_export(spark, str(tmp_path))
    first = export.write_export(frames, str(tmp_path), 2)
    with pytest.raises(Exception, match="lost"):
        export.write_export(broken, str(tmp_path), 2)
    assert export.open_export(spark, str(tmp_path)).version == first
    second = export.write_export({k: f.limit(0) for k, f in frames.items()}, str(tmp_path), 2)
    now = export.open_export(spark, str(tmp_path))
    assert now.version == second and now.elements().count() == 0 and export.open_export(spark, str(tmp_path), first).elements().count() > 0


def test_content_of_other_elements(spark, tmp_path):
    """Where content_id and element_id differ, styles follow the one and semantics the other."""
    frames = exports.export_frames(pages(spark, 3))
    content = frames["content"].limit(0).unionByName(spark.createDataFrame([(10, 20, 1, "p", 0, "x", "<p>x", 1, "{}"), (20, 10, 1, "p", 1, "y", "<p>y", 1, "{}"), (None, None, 1, "p", 2, "z", "", 1, "")], frames["content"].schema))
    content = content.select(F.col("element_id"), F.col("content_id"), *content.columns[2:])
    styles = frames["styles"].limit(0).unionByName(spark.createDataFrame([(10, True, False, False, 1.0, "a"), (20, False, False, False, 2.0, "b")], frames["styles"].schema))
    semantics = frames["semantics"].limit(0).unionByName(spark.createDataFrame([(10, "ten", 1, 1, 0.5), (20, "twenty", 1, 1, 0.5)], frames["semantics"].schema))
    export.write_export(frames | {"content": content, "styles": styles, "semantics": semantics}, str(tmp_path), 2)
    made = export.open_export(spark, str(tmp_path))
    assert not made.one_key
    assert {(r.element_text, r.font_size, r.semantic_role) for r in made.elements().collect()} == {("x", 2.0, "ten"), ("y", 1.0, "twenty")}


def test_tables_are_named(spark, tmp_path):
    with pytest.raises(ValueError):
        export.write_export({"content": pages(spark)}, str(tmp_path))
