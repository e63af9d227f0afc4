import re

import pytest
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.sources import html, sinks, tables


def gold_row(i, city="Cairo", reviewer=None, tokens=("pool",)):
    return (i, city, "h", reviewer or f"R{i}", None, None, None, "d", None, None, "p", "n", 1,
            list(tokens) or None, None, None)


def gold(spark, rows):
    return spark.createDataFrame(rows, schemas.GOLD_REVIEWS)


def test_create_if_absent_and_schema_check(spark, tmp_path):
    path = str(tmp_path / "gold")
    assert sinks.create_if_absent(spark, path, schemas.GOLD_REVIEWS)
    assert not sinks.create_if_absent(spark, path, schemas.GOLD_REVIEWS)
    assert spark.read.parquet(path).schema.names == schemas.GOLD_REVIEWS.names
    other = str(tmp_path / "other")
    spark.range(1).write.parquet(other)
    with pytest.raises(ValueError):
        sinks.create_if_absent(spark, other, schemas.GOLD_REVIEWS)


def test_append_new_reconciles_and_reruns_to_nothing(spark, tmp_path):
    path = str(tmp_path / "gold")
    sinks.create_if_absent(spark, path, schemas.GOLD_REVIEWS)
    batch = gold(spark, [gold_row(1), gold_row(2), gold_row(3, reviewer="R2"), gold_row(4, city=None)])
    first = sinks.append_new(batch, path).first()
    assert tuple(first) == (0, 3, 3, 3, True)
    assert tuple(sinks.append_new(batch, path).first()) == (3, 3, 0, 0, True)
    parity = sinks.append_new(batch, path, null_safe=False).first()
    assert (parity["inserted"], parity["ok"]) == (1, True)


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = gold(spark, [gold_row(1), gold_row(2, city="Luxor")])
    sinks.overwrite(df, path, partition_by=["city"], sort_by=["hotel_name"])
    assert sorted(p.name for p in (tmp_path / "t").glob("city=*")) == ["city=Cairo", "city=Luxor"]
    assert spark.read.parquet(path).where("city = 'Luxor'").count() == 1
    sinks.overwrite_known(df.withColumn("extra", F.lit(1)), path, schemas.GOLD_REVIEWS)
    assert spark.read.parquet(path).columns == schemas.GOLD_REVIEWS.names
    sinks.append(df.limit(0), path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 4


def test_a_value_with_a_third_of_the_rows_gets_several_files(spark, tmp_path):
    # Every file of the input holds all values: without dealing, each task would write one file a value.
    source = str(tmp_path / "source")
    wide = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("x")
    )
    wide.write.parquet(source)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400000")
    try:
        sinks.overwrite(spark.read.parquet(source), str(tmp_path / "t"), partition_by=["v"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("v=*")}
    assert len(files) == 41 and files["v=hot"] >= 3
    assert sum(files.values()) <= 60_000 * 80 / 400_000 + 41 + 12
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("v").count().agg(F.sum("count")).first()[0] == 60_000


def test_bucketed_append_does_not_move_the_table(spark, tmp_path):
    name, keys = "bucketed_gold", ["city", "hotel_name", "reviewer_name", "review_date"]
    assert sinks.create_bucketed(spark, name, schemas.GOLD_REVIEWS, keys, 8, str(tmp_path / "b"))
    assert not sinks.create_bucketed(spark, name, schemas.GOLD_REVIEWS, keys, 8)
    first = gold(spark, [gold_row(i) for i in range(40)] + [gold_row(50, reviewer="R2"), gold_row(51, city=None), gold_row(52, city=None, reviewer="R51")])
    assert sinks.append_new_bucketed(first, name, keys).count() == 41
    again = gold(spark, [gold_row(60, reviewer="R3"), gold_row(61), gold_row(62, city=None, reviewer="R51"), gold_row(63, reviewer="R61")])
    unseen = sinks.unseen_in_bucketed(again, name, keys)
    text = unseen._sc._jvm.PythonSQLUtils.explainString(unseen._jdf.queryExecution(), "formatted")
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of 8", text)[1]) < 8
    # The table has no exchange: of the batch one serves its ranking, one brings it to the buckets.
    tree = text[: text.index("\n\n\n")]
    assert "Scan parquet" in tree and tree.count("Exchange") == 2
    assert "Exchange" not in tree[tree.index("Scan parquet") - 200 : tree.index("Scan parquet")]
    added = sinks.append_new_bucketed(again, name, keys).collect()
    assert [r["id"] for r in added] == [61]
    assert sinks.append_new_bucketed(again.unionByName(first), name, keys).count() == 0
    assert spark.read.table(name).count() == 42
    assert sinks.append_new_bucketed(first.limit(0), name, keys).count() == 0


def test_generated_columns_are_stable(spark):
    df = gold(spark, [gold_row(1), gold_row(2)])
    ids = [sorted(r["id"] for r in sinks.with_generated(df).collect()) for _ in range(2)]
    assert ids[0] == ids[1]
    assert sinks.with_generated(df).where("inserted_at IS NULL").count() == 0


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    text = 'two\nlines, a comma and "quotes"'
    df = spark.createDataFrame([("Cairo", text, ["a", "b"]), (None, "x", [])], "City string, `Positive Review` string, tokens array<string>")
    sinks.export_csv(df, path)
    back = tables.scan_csv(spark, path, "City string, `Positive Review` string, tokens string")
    assert back.columns == ["city", "positive_review", "tokens"]
    assert {tuple(r) for r in back.collect()} == {("Cairo", text, '{"a","b"}'), (None, "x", None)}


def test_scans(spark, tmp_path, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    assert tables.scan(spark, path, ["doc_id"], limit=5).count() == 5
    with pytest.raises(Exception):
        tables.scan(spark, str(tmp_path / "missing")).count()
    spark.range(3).write.saveAsTable("scan_me")
    assert tables.table_exists(spark, "scan_me") and not tables.table_exists(spark, "nothing_here")
    assert tables.scan(spark, "scan_me").count() == 3
    links = spark.createDataFrame([("u", "n", None)], "Link string, Name string, is_scraped boolean")
    links.write.parquet(str(tmp_path / "links"))
    assert tables.scan_links(spark, str(tmp_path / "links")).columns == ["link", "name", "is_scraped"]


def test_spread_only_touches_coarse_scans(spark):
    coarse = spark.range(0, 100, 1, 1)
    assert tables.spread_small_scan(coarse, "id").rdd.getNumPartitions() == 4
    fine = spark.range(0, 100, 1, 9)
    assert tables.spread_small_scan(fine, "id") is fine


def test_describe_columns(spark):
    rows = tables.describe_columns(gold(spark, [])).orderBy("ordinal").collect()
    assert [r["name"] for r in rows] == schemas.GOLD_REVIEWS.names
    assert rows[0]["display_type"] == "SERIAL" and rows[13]["type"] == "array<string>"


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["Hotel Name", "sentiment classification"])
    assert schemas.normalize_columns(df).columns == ["hotel_name", "sentiment_classification"]
    with pytest.raises(ValueError):
        schemas.normalize_columns(spark.createDataFrame([(1, 2)], ["A B", "a_b"]))
    known = schemas.keep_known(df.toDF("review_date", "city"), schemas.GOLD_REVIEWS)
    assert known.columns == ["city", "review_date"]


CARD = """<div data-testid="review-card"><img class="b8d1620349 x" alt="Egypt">
<div class="b08850ce41 f546354b44">Mona</div><span data-testid="review-num-nights">3 nights · </span>
<span data-testid="review-room-name">Double <b>Room</b></span>
<div class="b99b6ef58f d14152e7c3">Nice pool</div></div>"""
SECOND = '<div data-testid="review-card"><img alt=""><span class="the nationality">France</span></div>'


def test_review_cards(spark):
    pages = spark.createDataFrame([(7, "<html><p>top</p>" + CARD + SECOND), (8, "<p>none</p>")], "page_id long, html string")
    rows = html.review_cards(pages, "html", ["page_id"]).orderBy("card_no").collect()
    assert [r["page_id"] for r in rows] == [7, 7]
    assert rows[0].asDict() | {"page_id": 0, "card_no": 0} == {
        "page_id": 0, "card_no": 0, "reviewer_name": "Mona", "reviewer_nationality": "Egypt",
        "duration": "3 nights ·", "check_in_date": "No Check-in Date", "travel_type": "No Type",
        "room_type": "Double Room", "review_date": "No Date", "positive_review": "Nice pool",
        "negative_review": "No Negative Feedback", "city": "Unknown City",
    }
    assert rows[1]["reviewer_nationality"] == "France" and rows[1]["reviewer_name"] == "No Name"


def test_nested_text(spark):
    page = '<div id="a"><div>in<br>ner</div> and <p>more</p></div><div id="a">second</div>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "id long, html string")
    got = {r["id"]: r["x"] for r in html.nested_text(rows, "id", "html", "id", "a", "x").collect()}
    assert got == {1: "inner and more", 2: None, 3: None}


NESTED = """<nav aria-label='Breadcrumb'><a class='x'>Home</a><a class="big breadcrumb">Sharm <b>El</b> Sheikh</a></nav>
<div data-testid='review-card'><div class="b08850ce41 f546354b44"><span></span><i>Mona</i> &eacute;</div>
<div class="b99b6ef58f d14152e7c3"><span>Great</span> location &amp; pool<br>near <b>beach</b></div>
<div data-testid="review-negative-text"><div>in<div>ner</div></div></div><span data-testid='review-date'></span></div>"""


def test_cards_keep_nested_text_either_quote_and_entities(spark):
    pages = spark.createDataFrame([(7, "Hotel", NESTED), (8, "None", None), (9, "Open", "<div data-testid=review-card><p>x")], "k long, name string, html string")
    bronze = html.cards_to_bronze(pages, "k", "html", "name")
    assert bronze.columns == schemas.BRONZE_REVIEWS.names
    rows = {r["hotel_name"]: r for r in bronze.collect()}
    first = rows["Hotel"]
    assert first["city"] == "Sharm El Sheikh" and first["reviewer_name"] == "Mona é"
    assert first["positive_review"] == "Great location & pool\nnear beach"
    assert first["negative_review"] == "in\nner" and first["review_date"] == ""
    assert set(rows) == {"Hotel", "Open"} and rows["Open"]["positive_review"] == "No Positive Feedback"
    assert first["id"] != rows["Open"]["id"] and first["scraped_at"] is not None
    deep = html.read_page("<p>one<p>two<ul><li>a<li>b</ul>" + "<div>" * 5000 + "end")
    assert deep.text() == "one\ntwo\na\nb\nend" and deep.written() == "onetwoabend"
    masked = spark.createDataFrame([(1, "h", '<a class="bui_breadcrumb__link_masked">Luxor</a>' + NESTED)], pages.schema)
    assert html.cards_to_bronze(masked, "k", "html", "name").first()["city"] == "Luxor"


def test_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(5), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.overwrite(broken, path)
    assert spark.read.parquet(path).count() == 5
    sinks.overwrite(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if "__old" in p.name] == []


def test_generated_ids_differ_where_keys_are_missing(spark):
    rows = [gold_row(1, city=None), gold_row(1, city=None), gold_row(3), gold_row(3)]
    df = gold(spark, rows).withColumn("_order", F.monotonically_increasing_id())
    ids = [r["id"] for r in sinks.with_generated(df, order="_order").collect()]
    assert len(set(ids)) == 3
    swapped = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string")
    assert sinks.with_generated(swapped, ["a", "b"]).select("id").distinct().count() == 2


def test_staged_tables_can_be_dropped(spark):
    from pathlib import Path

    from reviewlake.session import drop_staged, persist_reliably

    stored = persist_reliably(spark.range(3))
    folder = Path(stored.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and drop_staged(spark) >= 1 and not folder.exists()
