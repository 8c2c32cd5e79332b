"""Edge rows of the marketplace operators that the test tables don't hold."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from kerbline.functions import text as T
from kerbline.operators import directory as D
from kerbline.operators import incremental as I
from kerbline.operators import ledger as L
from kerbline.operators import quality as Q
from kerbline.operators import runs as R
from kerbline.operators import search as S
from kerbline.operators import upsert as U
from kerbline.operators import versions as V
from kerbline.operators.paging import StoredOrder
from kerbline.operators.stored import Folder, KeyedTable, StoredLog
from kerbline.sources import elements, jsonld, paged, posts
from kerbline.sources.markup import tokens
from kerbline.streaming.merge import distinct_within, merge_stream
from kerbline.streaming.recheck import recheck_stream


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_prices_and_formats(spark):
    prices = ["₹ 4.5 Lakh", "4,50,000", "1.2 Cr", "4.5L", "DM for price", "", None, "2 lac"]
    assert column(spark, T.parse_indian_price, prices) == [450000.0, 450000.0, 12000000.0, 4.5, None, None, None, 200000.0]
    prices = ["1.2.3 lakh", "Rs.4.5Lakh", " 12 crore only", "x"]
    assert column(spark, T.parse_indian_price, prices) == [120000.0, 40000.0, 120000000.0, None]
    shown = column(spark, lambda c: T.format_price(c.cast("decimal(12,2)")), [None, 999.0, 1000.0, 99999.5, 99999.05, 100000.0, 150000.0, 9999999.0, 12345678.0], "double")
    assert shown == ["Price on request", "999", "1,000", "99,999.5", "99,999.05", "1.00 L", "1.50 L", "100.00 L", "1.23 Cr"]
    assert column(spark, T.format_km, [None, 999, 1000, 99999, 9999999], "int") == ["—", "999 km", "1,000 km", "99,999 km", "99,99,999 km"]
    assert column(spark, T.parse_km, ["12,345 km", "none", None]) == [12345, None, None]
    assert column(spark, T.capitalize, ["suv car", "", None]) == ["Suv car", "—", "—"]
    assert column(spark, T.slug, ["Motor Mart (Chennai)!", "--a", None]) == ["motor-mart-chennai", "a", None]


def test_titles(spark):
    narrow = column(spark, lambda c: T.parse_title(c), ["2019 Hyundai Creta SX 2020", "Hyundai", ""])
    assert [tuple(r) for r in narrow] == [(2019, "Hyundai", "Creta", "SX 2020"), (None, "Hyundai", None, None), (None, None, None, None)]
    wide = column(spark, lambda c: T.parse_title(c, wide=True), ["1998 Used Maruti 800 (AC) for sale"])
    assert tuple(wide[0]) == (1998, "Maruti", "800", "AC")
    wide = column(spark, lambda c: T.parse_title(c, wide=True), ["2018 Focused Motors X", "secondhand Honda {VXI}", "pre-owned City"])
    assert [tuple(r) for r in wide] == [(2018, "Focused", "Motors", "X"), (None, "Honda", "VXI", None), (None, "pre-owned", "City", None)]


def test_search_rules():
    assert S.like_pattern("a%b_c") == "%a%b_c%" and S.like_pattern(r"a\bc\%") == r"%abc\%%"
    with pytest.raises(ValueError):
        S.like_pattern("x\\")
    with pytest.raises(ValueError):
        S.page_of(None, [], 0)
    given = S.filters_of({"search": "", "minPrice": "0", "page": "2", "fuelType": "diesel", "other": "x"})
    assert given == S.ListingFilters(min_price=0.0, page=2, fuel_type="diesel")


def test_validation(spark):
    media = [("https://a/1", "image"), ("ftp://a/2", "image"), ("http://a/3", "audio"), None]
    rows = [("a", "b", 9999.5, 2000, 0, None), ("a", "b", 10000.0, 1990, 2000000, []), (" \t", "b", None, None, -1, media), ("a", None, 1e8, 2026, None, media), ("a", "b", 1e8 + 1, 2027, 2000001, None), ("a", "b", 20000.0, 2020, 1, media)]
    df = spark.createDataFrame(rows, "make string, model string, price double, year int, km_driven int, media array<struct<url string, type string>>")
    df = df.withColumn("media", F.transform("media", lambda m: F.when(m.isNotNull(), F.struct(m["url"].alias("url"), m["type"].alias("type"), F.lit(None).cast("string").alias("poster_url")))))
    got = Q.validated(df.withColumn("price", F.col("price").cast("decimal(12,2)")), 2025).collect()
    warning = "3 invalid media item(s) filtered"
    assert [r["errors"] for r in got] == [
        ["price 9999.5 outside ₹10000–₹100000000 range"], [], ["make is empty", "year is missing", "kmDriven -1 outside 0–2000000 range", warning], ["model is empty", warning],
        ["price 100000001 outside ₹10000–₹100000000 range", "year 2027 outside 1990–2026 range", "kmDriven 2000001 outside 0–2000000 range"], [warning],
    ]
    assert [r["valid"] for r in got] == [False, True, False, False, False, True] and len(got[5]["media"]) == 1


def test_fold_matches_rows_one_by_one(spark):
    rng = random.Random(4)
    log = [(rng.randrange(6), n, rng.choice([None, n]), rng.choice([None, n]), rng.choice([None, n])) for n in range(200)]
    df = spark.createDataFrame(log, "k int, n int, a int, b int, c int")
    state = {}
    for k, _, a, b, c in log:
        old = state.get(k)
        state[k] = (old[0] if old else a, b, c if c is not None else (old[2] if old else None))
    shape = dict(keys=["k"], seq=["n"], first=["a"], last=["b"], last_known=["c"])
    assert {r["k"]: (r["a"], r["b"], r["c"]) for r in U.fold(df, **shape).collect()} == state
    half = U.fold(df.where("n < 100"), **shape)
    both = U.fold_into(half, df.where("n >= 100"), **shape)
    assert {r["k"]: (r["a"], r["b"], r["c"]) for r in both.collect()} == state
    again = U.fold_into(both.drop("is_new"), df.where("n >= 100"), **shape)
    assert {r["k"]: (r["a"], r["b"], r["c"]) for r in again.collect()} == state


def test_early_stop_and_alignment(spark):
    pages = spark.createDataFrame([(1, 5), (2, 3), (3, 0), (4, 9)], "page int, n_rows int")
    assert {r["page"] for r in I.until_empty(pages).collect()} == {1, 2}
    items = spark.createDataFrame([(0, 1), (0, 2)], "chunk int, index int")
    results = spark.createDataFrame([(0, 1, "x", 0), (0, 1, "y", 1), (0, 9, "z", 2)], "chunk int, index int, value string, pos int")
    assert {(r["index"], r["value"], r["answered"]) for r in I.aligned(items, results).collect()} == {(1, "y", True), (2, None, False)}
    assert {(r["index"], r["value"]) for r in I.aligned(items, results, empty={"value": "none"}).collect()} == {(1, "y"), (2, "none")}


def test_recheck(spark):
    hours = [0, 48, 48.0003, 30, 60, 90, 96.001, None]
    rows = [("a", None if h is None else float(h)) for h in hours] + [(None, 0.0), ("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "k string, h double").withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, h * 3600)"))
    got = {(r["k"], r["h"]): r["processed"] for r in I.greedy_recheck(df, "k", "ts").collect()}
    assert got == {("a", 0): True, ("a", 48): False, ("a", 48.0003): True, ("a", 30): False, ("a", 60): False, ("a", 90): False, ("a", 96.001): True, ("a", None): False, (None, 0): False, ("b", 5): True}


@pytest.mark.parametrize("step", [60_000_000, 100])
def test_successors_of_a_long_key(spark, step):
    """A key over 200,000 slots, and one with 200,000 times in a few slots: time must not grow with their square."""
    n, hours = 200_000, 1 if step > 1000 else 0
    times = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * step + F.pmod(F.xxhash64("id"), F.lit(step))).alias("t"))
    begin = time.time()
    got = I.successors(times, hours).toPandas().sort_values("t")
    assert time.time() - begin < 60
    own = got["t"].to_numpy()
    at = own.searchsorted(own + hours * 3_600_000_000, side="right")
    want = [int(own[k]) if k < n else None for k in at]
    assert len(own) == n and [None if x != x else int(x) for x in got["next"]] == want


def test_recheck_matches_a_row_by_row_model(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(4000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, m int").withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {(r["k"], r["m"]): r["processed"] for r in I.greedy_recheck(df, "k", "ts", hours=3).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    linked = I.greedy_recheck(df.withColumn("other", F.lit(1)), "k", "ts", hours=3, hot_rows=1000)  # the keys have about a thousand each
    assert linked.count() == 3000 and {(r["k"], r["m"]): r["processed"] for r in linked.collect()} == got
    by_links = I.greedy_recheck(df, "k", "ts", hours=3, hot_rows=0)
    assert {(r["k"], r["m"]): r["processed"] for r in by_links.collect()} == got
    clock, want = {}, {}
    for k, m in sorted(set(rows)):
        want[k, m] = k not in clock or m > clock[k] + 180
        if want[k, m]:
            clock[k] = m
    assert got == want


def test_jsonld(spark):
    html = """<script type="application/ld+json">{bad</script><script type="application/ld+json">
    {"@graph": [{"@type": "Car", "name": "2019 Hyundai Creta SX", "brand": {"name": "Hyundai"}, "vehicleModelDate": "2019-05", "fuelType": "Petrol", "url": "/u", "offers": {"price": "4,50,000", "url": "/x"}},
    {"@type": "Car", "name": "no price"}, {"@type": "Car", "name": "Token", "price": 5}, {"@type": "Car", "name": "a b", "brand": {"name": "Maruti Suzuki"}, "price": "2 lakh"}, {"@type": "ListItem", "name": "n", "url": "/u"}]}</script>"""
    car = """<script type="application/ld+json">[{"@type": "Thing"}, {"@type": "Car", "name": "2018 Kia Seltos GT", "brand": {"name": "Kia"}, "model": "Seltos", "vehicleModelDate": 2018, "offers": {"price": "900000 INR"}, "image": "a.jpg"}]</script>
    <script type="application/ld+json">{"@type": "Car", "brand": {"name": "second"}}</script>"""
    pages = spark.createDataFrame([("p", html), ("q", ""), ("r", None), ("https://c/buy-123456789/", car)], "url string, html string")
    got = {r["source_url"]: r for r in jsonld.products(pages.where("url = 'p'"), "https://b", "X", "s").collect()}
    assert [(r["make"], r["model"], r["year"], float(r["price"]), r["fuel_type"]) for r in (got["https://b/u"], got["https://b/"])] == [("Hyundai", "Creta", 2019, 450000.0, "Petrol"), ("Maruti Suzuki", "b", None, 200000.0, None)]
    assert len(got) == 2
    assert [(r["name"], r["link"]) for r in jsonld.listing_links(pages).collect()] == [("n", "/u")]
    one = jsonld.cars(pages, "X", "s").collect()
    assert [(r["make"], r["model"], r["variant"], r["year"], float(r["price"]), r["source_listing_id"], r["photos"]) for r in one] == [("Kia", "Seltos", "GT", 2018, 900000.0, "123456789", ["a.jpg"])]


def test_jsonld_years_distances_and_prices(spark):
    one = lambda k, said: f'<script type="application/ld+json">{{"@type": "Car", "name": "2018 Kia Rio {k}", "url": "/{k}", {said}}}</script>'
    said = [
        '"price": 5, "vehicleModelDate": "new", "productionDate": "2016"', '"price": 5, "productionDate": 2016.0, "mileageFromOdometer": {"value": 0}', '"price": 5, "vehicleModelDate": null, "mileageFromOdometer": {"value": "0"}',
        '"offers": {"lowPrice": 4.5e5}, "mileageFromOdometer": {"value": 1200.4}', '"offers": {"price": null, "lowPrice": "4.5 lakh"}, "price": 7, "mileageFromOdometer": {"value": "1,200 km"}', '"offers": {"price": 0}, "price": 7', '"offers": {"price": "call"}',
    ]
    pages = spark.createDataFrame([("p", "".join(one(k, x) for k, x in enumerate(said)))], "url string, html string")
    got = {int(r["source_url"][-1]): (r["year"], float(r["price"]), r["km_driven"]) for r in jsonld.products(pages, "https://b", "C", "s").collect()}
    assert got == {0: (None, 5.0, None), 1: (2016, 5.0, None), 2: (2018, 5.0, 0), 3: (2018, 450000.0, 1200), 4: (2018, 450000.0, 1200)}


def test_two_captures_of_one_page(spark):
    car = '<script type="application/ld+json">{"@type": "Car", "name": "2018 Kia Rio", "price": 5, "url": "/u"}</script>'
    card = '<div class="listingCard"><h3>2019 Kia X</h3><p class="price">5</p><a href="/used-car-details/z">x</a></div>'
    pages = spark.createDataFrame([("p", car + card), ("p", card), ("q", None)], "url string, html string")
    assert sorted(r["source_url"] for r in elements.products_or_cards(pages, "https://b", "/s", "C", "x").collect()) == ["https://b/u", "https://b/used-car-details/z"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(n % 5, n, n if n % 3 else None) for n in range(60)]
    schema = "k int, n int, c int"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(f"n div 20 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = KeyedTable(spark, f"file://{tmp_path}/table", "k int, c int", ["k"], [], ["c"], parts=4)
    merge_stream(stream, table, f"{tmp_path}/check", ["n"]).awaitTermination()
    want = sorted(map(tuple, U.fold(df, ["k"], ["n"], [], ["c"]).select("k", "c").collect()))
    assert table.version() == 3 and sorted(map(tuple, table.read().collect())) == want
    again = table.merge(df.where("n >= 40"), "stream", 2, ["n"])
    assert again.repeated and table.version() == 3 and again.version == 3 and (again.n_new, again.n_updated) == (0, 5)
    table.vacuum()
    assert sorted(map(tuple, table.read().collect())) == want


def test_keyed_table_lost_races(spark, tmp_path):
    schema, shape = "k int, a int, b int, c int", dict(keys=["k"], first=["a"], last=["b"], last_known=["c"])
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, **shape, parts=8)
    batch = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], schema + ", n int")
    first = table.merge(batch((1, 1, 1, None), (2, 1, 1, 5), (None, 1, 1, 1)), "w", 0, ["n"])
    assert (first.version, first.n_new, first.n_updated) == (1, 2, 0)
    other = KeyedTable(spark, table.folder.root, schema, **shape, parts=8)
    raced = []

    def meanwhile(*rows):
        def run():
            if len(raced) < 1:
                raced.append(other.merge(batch(*rows), "other", 0, ["n"]))

        return run

    # the winner writes the same key: the loser merges again, on top of it
    mine = batch((1, 7, 7, None), (3, 7, 7, None))
    done = table.merge_staged(table.stage(mine), mine.schema, "w", 1, ["n"], before_commit=meanwhile((1, 8, 8, 8), (3, 8, 8, 8)))
    assert raced[0].version == 2 and (done.version, done.n_new, done.n_updated) == (3, 0, 2)
    assert {r["k"]: (r["a"], r["b"], r["c"]) for r in table.read().collect()} == {1: (1, 7, 8), 2: (1, 1, 5), 3: (8, 7, 8)}
    assert {r["k"]: r["is_new"] for r in table.changes("w", 1).collect()} == {1: False, 3: False}
    assert {r["k"]: r["is_new"] for r in table.changes("other", 0, version=2).collect()} == {1: False, 3: True}
    # the winner writes another part: the loser's work stays
    raced.clear()
    part_of = {r["k"]: r["p"] for r in spark.range(40).selectExpr("CAST(id AS INT) AS k").select("k", table.part().alias("p")).collect()}
    far = next(k for k in range(10, 40) if part_of[k] != part_of[1])
    mine = batch((1, 9, 9, None))
    staged = table.stage(mine)
    done = table.merge_staged(staged, mine.schema, "w", 2, ["n"], before_commit=lambda: raced or raced.append(other.merge(batch((far, 1, 1, 1)), "other", 1, ["n"])))
    assert done.version == 5 and table.read().count() == 4 and table.read(1).count() == 2
    assert {r["b"] for r in table.read().where("k = 1").collect()} == {9}
    table.vacuum()
    assert table.read().count() == 4 and table.folder.names("versions") == ["v000000000005.json"]


def test_stored_log(spark, tmp_path):
    log = StoredLog(spark, f"file://{tmp_path}/log", "a int")
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    assert log.read().count() == 0 and log.append(rows, "x") and not log.append(rows, "x") and log.append(rows, "y")
    log.folder.delete("batch=y/_SUCCESS")  # as a failure in the middle of a write leaves it
    assert log.read().count() == 2 and log.append(rows, "y") and log.read().count() == 4


def test_ranks_of_one_huge_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"k{rng.randrange(4)}", rng.randrange(-200_000, 900_000), n) for n in range(4000)]
    rows += [("hot", None, 9001), ("hot", None, 9002)]
    df = spark.createDataFrame(rows, "k string, t long, n int")
    got = {r["n"]: r["rank"] for r in I.ranks(df, "k", ["t", "n"]).collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {n: i + 1 for i, (_, _, n) in enumerate(own)}
    assert got == want
    slots = df.withColumn("s", I.slot_of(df, "t")).groupBy("k", "s").count().agg(F.max("count")).first()[0]
    assert slots < 400  # what one task ranks of the hot group
    assert I.ranks(df.limit(0), "k", ["t", "n"]).count() == 0
    with pytest.raises(ValueError):
        I.ranks(df, "n", ["k"])


def test_stored_migrations(spark, tmp_path):
    stored = V.StoredTables(spark, f"file://{tmp_path}/t", [V.Unique("a", "k"), V.Restrict("b", "k", "a", "k")])
    a, b = spark.createDataFrame([(1, "7"), (2, "x")], "k int, v string"), spark.createDataFrame([(1,), (None,)], "k int")
    assert stored.migrate([("given", lambda _: {"a": a, "b": b})]) == ["given"] and stored.journal() == ["given"]
    steps = [("given", lambda _: 1 / 0), ("more", V.add_column("a", "n", "int", 5))]
    assert stored.migrate(steps) == ["more"] and stored.migrate(steps) == [] and {r["n"] for r in stored.read()["a"].collect()} == {5}
    for step, wrong in (("dangling", lambda t: t | {"a": t["a"].where("k <> 1")}), ("twice", lambda t: t | {"a": t["a"].unionAll(t["a"])})):
        with pytest.raises(V.Broken):
            stored.migrate([(step, wrong)])
    with pytest.raises(Exception, match="is no int"):
        stored.migrate([("kind", V.change_column("a", "v", "int"))])
    assert stored.journal() == ["given", "more"] and stored.read()["a"].count() == 2
    assert stored.migrate([("drop", V.drop_column("a", "v")), ("unused", lambda t: t | {"a": t["a"].where("k <> 2")})]) == ["drop", "unused"]
    assert [tuple(r) for r in stored.read()["a"].collect()] == [(1, 5)] and stored.manifest()["tables"]["b"].startswith("tables/b-given-")


def test_paged_source(spark, tmp_path):
    paged.register(spark)

    def capture(source, page, html):
        folder = tmp_path / "in" / f"source={source}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(html)

    for page in (1, 2):
        capture("a", page, b"listingCard")
    capture("a", 3, b"none")
    capture("a", 4, b"\xff listingCard")  # would fail if it were read
    capture("b", 1, b"itemBox \xc3\xa9")
    capture("b", 3, b"\xff")  # page 2 is missing
    capture("c", 1, b"")
    rows = lambda df: sorted((r["source"], r["page"]) for r in df.collect())
    load = lambda **o: spark.read.format("captured_pages").options(**o).load(f"file://{tmp_path}/in")
    assert rows(load()) == [("a", 1), ("a", 2), ("b", 1)] and rows(load(mostPages=1)) == [("a", 1), ("b", 1)] and rows(load(listing="item")) == [("b", 1)]
    assert load().where("source = 'b'").first()["html"] == "itemBox \u00e9"
    assert spark.read.format("captured_pages").load(f"file://{tmp_path}/nothing").count() == 0

    def run():
        stream = spark.readStream.format("captured_pages").load(f"file://{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start().awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    assert run() == [("a", 1), ("a", 2), ("b", 1)]
    (tmp_path / "in" / "source=b" / "page=3" / "part-0.txt").write_bytes(b"itemBox")
    capture("b", 2, b"itemBox")
    assert run() == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]


def test_runs_over_all_tasks_and_their_reports(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    sources = spark.createDataFrame([("s", "s", 1, 2)], "platform string, handle string, dealer_source_id long, dealer_id long")
    table, log = R.listing_table(spark, f"{root}/t", parts=2), R.RunLog(spark, f"{root}/log")
    rows = spark.range(60, numPartitions=1).selectExpr("id", "'s' AS source_platform", "IF(id = 7, NULL, 'u' || id div 2) AS source_url", "IF(id % 3 = 0, '', 'Kia') AS make", "'Rio' AS model", "2000 AS year")
    dealt = table.dealt(rows, "id").withColumn("task", F.spark_partition_id()).withColumn("part", table.part())
    assert dealt.rdd.getNumPartitions() >= 4 and dealt.select("part", "task").distinct().groupBy("task").count().where("count > 1").count() == 0
    problems = spark.createDataFrame([("x", "late", 1), ("w", "lost", 0)], "url string, message string, position int")
    for number, given in ((0, rows), (0, rows), (1, rows.where("id = 1")), (2, rows.where("id = 1"))):
        R.run_batch(table, log, given, sources, "s", number, "2024-01-01 00:00:00", 1999, ["id"], problems if number < 2 else None)
    bad = [f"{'' if k == 7 else f'u{k // 2}'}: {'sourceUrl is missing' if k == 7 else 'make is empty'}" for k in range(60) if k % 3 == 0 or k == 7]
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    errors = "w: lost\nx: late"
    got = {r["run_id"]: (r["found"], r["new"], r["updated"], r["rejected"], r["reasons_md5"], r["message_md5"]) for r in log.read().collect()}
    assert got["s-0"] == (60, 29, 0, len(bad), digest("\n".join(bad)), digest(f"{errors}\n\nValidation rejections:\n" + "\n".join(bad)))
    assert got["s-1"] == (1, 0, 1, 0, None, digest(errors)) and got["s-2"] == (1, 0, 1, 0, None, None) and len(got) == 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # reports in many pieces
    assert {r["run_id"]: r["message_md5"] for r in log.read().collect()} == {k: v[5] for k, v in got.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_captured_ranges_of_pages(spark, tmp_path):
    paged.register(spark)
    root = f"file://{tmp_path}/in"
    html = F.when(F.col("page") == 1003, "none").otherwise(F.concat(F.lit("itemBox "), "page"))
    pages = spark.range(3000).selectExpr("CAST(2999 - id AS INT) + 1 AS page", "substr(CAST(id AS STRING), 1, 0) || 'a' AS source").withColumn("html", html)
    paged.capture(pages.where("page <> 700"), root)
    load = lambda **o: spark.read.format("captured_pages").options(**o).load(root)
    files = list((tmp_path / "in").rglob("*.parquet"))
    assert len(files) == 6  # a file for a range, not for a page
    assert all((n := [r["page"] for r in spark.read.parquet(f"file://{f}").collect()]) == sorted(n) for f in files)
    assert sorted(r["page"] for r in load().collect()) == list(range(1, 21)) and load(mostPages=5000).count() == 699  # page 700 is missing
    paged.capture(pages.where("page = 700"), root)  # comes later
    spark.createDataFrame([(1002, "itemBox 1002"), (1001, "itemBox 1001")], "page int, html string").coalesce(1).write.parquet(f"{root}/source=d/pages=1001")
    paged.capture(spark.range(1, 1001).selectExpr("'d' AS source", "CAST(id AS INT) AS page", "'itemBox' AS html"), root)
    paged.capture(spark.createDataFrame([("b", 1, "itemBox"), ("b", 3, "itemBox"), ("c", 1, None)], "source string, page int, html string"), root)
    rows = load(mostPages=5000).collect()
    assert sorted((r["source"], r["page"]) for r in rows) == [("a", n) for n in range(1, 1003)] + [("b", 1)] + [("d", n) for n in range(1, 1003)] and all(r["html"] in ("itemBox", f"itemBox {r['page']}") for r in rows)


def test_deep_pages(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "id % 7 AS price").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    order = StoredOrder.build(rows, f"file://{tmp_path}/o", S.sorted_by("price", True))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r["id"] for r in rows.orderBy(*S.sorted_by("price", True)).collect()]
    for page in (1, 2, 41, 83, 84, 85):
        assert [r["id"] for r in order.page(page).collect()] == want[(page - 1) * 24 : page * 24]
    files = order.folder.read_json("index.json")["files"]
    assert order.total() == 2000 and len(files) > 1 and all(len(order.files_of(k)[0]) <= 2 for k in range(1, 84))
    with pytest.raises(ValueError):
        order.page(0)
    assert StoredOrder.build(rows.limit(0), f"file://{tmp_path}/e", S.sorted_by("price", True)).page(1).count() == 0


def test_sitemap_files(spark, tmp_path):
    entries = spark.range(25).selectExpr("concat('/d/', id, '?a=1&b') AS url", "'daily' AS change").coalesce(1)
    folder = Folder(spark, f"file://{tmp_path}/s")
    files = D.export_sitemap(entries, folder, "https://c", size=10)
    assert len(files) >= 3 and files == D.export_sitemap(entries.limit(0), folder, "https://c", size=10)
    texts = [(tmp_path / "s" / "urls" / f).read_text() for f in files]
    assert all(t.count("<url>") <= 10 and "sitemaps.org" in t for t in texts) and sum(t.count("<url>") for t in texts) == 25 and "a=1&amp;b" in texts[0]


def test_recheck_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((rng.randrange(5), rng.randrange(12_000), n) for n in range(400))
    rows.sort(key=lambda r: r[1] + rng.randrange(90))  # up to an hour and a half late
    rows += [(99, 20_000, 1000)]  # drives the watermark past all others
    frame = lambda some: spark.createDataFrame(some, "k int, m int, n int").withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)"))
    want = {(r["n"], r["processed"]) for r in I.greedy_recheck(frame(rows[:-1]), "k", "ts", hours=10).collect()}
    assert 10 < sum(p for _, p in want) < 200
    schema = frame(rows[:1]).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = recheck_stream(stream, "k", "ts", "2 hours", hours=10)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    cuts = [0, 90, 91, 250, 330, 401]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        frame(rows[a:b]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (2, 4):  # stopped and started again on the same state
            run()
    got = {(r["n"], r["processed"]) for r in spark.read.parquet(f"{tmp_path}/out").where("k <> 99").collect()}
    assert got == want


def test_distinct_within(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 05:00:00"), ("b", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = distinct_within(spark.readStream.schema("k string, t timestamp").parquet(f"{tmp_path}/in"), "k", "t")
    stream.writeStream.format("memory").queryName("distinct_rows").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table("distinct_rows").collect()) == ["a", "b"]


def test_ledger_and_health(spark):
    assert L.append_quietly(lambda: None) and not L.append_quietly(lambda: 1 / 0)
    assert L.run_status(0, 0) == "completed" and L.run_status(0, 2) == L.run_status(1, 0) == "completed_with_errors"
    begun = L.started("r1", "source-a", "2024-01-01 00:00:00", spark)
    done = spark.createDataFrame([("r1", "source-a", "completed", "2024-01-01 01:00:00", 5, 3, 2, 0, None, None)], L.RUNS)
    now = L.current(begun.unionByName(done), "run_id", "at").first()
    assert (now["status"], now["started_at"], now["last_at"], now["found"]) == ("completed", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 5)
    assert not L.is_healthy(begun.limit(0))


def test_elements(spark):
    page = elements.Elements("<div><p>a<b>c</b></div>d<br><ul><li>x<li><span>y</span>z</ul></nothing>")
    assert page.tag == ["div", "p", "b", "br", "ul", "li", "li", "span"] and page.end == [3, 3, 3, 4, 8, 6, 8, 8]
    assert [page.text(i) for i in range(8)] == ["ac", "ac", "c", "", "xyz", "x", "yz", "y"] and page.last_child[5:] == [False, True, True]
    assert page.closest(2, "p") == 1 and page.closest(4, "p") is None and not elements.Elements(None).tag
    deep = elements.Elements("<div class='card'><i>x " * 20000 + "</u>" * 20000)
    assert len(deep.tag) == 40000 and deep.end[0] == 40000
    box = '<div data-aut-id="itemBox"><a href="{}"></a><i class="my-title">{}</i><i class="price">{}</i></div>'
    other = '<a href="/item/1"><h3>Kia X</h3><i class="price">5</i></a>'
    assert elements.card_texts(box.format("/u", "Kia", "5") + other) == [("Kia", "5", "", "/u", "", "Kia5")]
    assert elements.card_texts(box.format("", "Kia", "5") + other) == [("Kia X", "5", "", "/item/1", "", "Kia X5")]
    assert elements.card_texts('<li class="card"><h2>t</h2><i class="price">5</i></li>') == [] == elements.card_texts(None)
    linked = '<a href="/used-car-details/z"><div class="usedCarListing"><h3>2019 Kia X</h3><i class="price">5</i></div></a>'
    assert [r[3] for r in elements.listed_texts(linked)] == ["/used-car-details/z"]
    pages = spark.createDataFrame([("p", linked, 1), ("q", "", 1), ("r", None, 1), ("s", "<![x<p", 1)], "url string, html string, at int")
    assert [(r["url"], r["photos"], r["year"]) for r in elements.details_pages(pages).orderBy("url").collect()] == [(u, [], None) for u in "pqrs"]
    assert [(r["page_url"], r["source_url"], r["city"]) for r in elements.products_or_cards(pages, "https://b", "/s", "C", "x").collect()] == [("p", "https://b/used-car-details/z", "C")]
    assert elements.result_cards(pages.limit(0), "https://b").count() == 0


def test_pages_of_one_file_over_all_tasks(spark):
    """Details, result cards and listed cards, structured data and posts: one input task must not stay one."""
    card = '<div class="listingCard"><h3>2019 Kia X</h3><p class="price">5</p></div>'
    rows = spark.range(40).selectExpr("concat('p', id div 2) AS url", f"concat('{card}<b data-aut-id=\"profileName\">n', id div 2, '</b>') AS html")
    pages = spark.createDataFrame(rows.coalesce(1).collect(), rows.schema).coalesce(1)
    assert pages.rdd.getNumPartitions() == 1
    read = [elements.details_pages(pages), elements.result_cards(pages, "https://b"), elements.listed_cards(pages, "https://b", "/s"), jsonld.blocks(pages), posts.page_elements(pages, "url")]
    assert all(df.rdd.getNumPartitions() >= 4 for df in read)
    # copies of a page keep a row each
    assert sorted((r["url"], r["seller_name"]) for r in read[0].collect()) == sorted((f"p{k // 2}", f"n{k // 2}") for k in range(40)) and read[2].count() == 40


def test_boxes_within_boxes():
    """The work of a page grows with its elements, not with the boxes that each of them stands in."""
    for read, box in ((elements.card_texts, '<div class="card">'), (elements.card_texts, '<div data-aut-id="itemBox">'), (elements.listed_texts, '<div class="listingCard">')):
        began = time.monotonic()
        found = read(box * 8000 + '<h2 class="title">2019 Kia X</h2><i class="price">5</i><a href="/item/1">')
        assert time.monotonic() - began < 10 and len(found) == 8000 and found[-1][:4] == ("2019 Kia X", "5", "", "" if read is elements.listed_texts else "/item/1")


def test_pages_with_open_elements():
    """What a browser's tree holds: (tag, text, number of the parent)."""
    known = {
        '<p class="price">5 Lakh<p>12,300 km': [("p", "5 Lakh", -1), ("p", "12,300 km", -1)],
        "<table><tr><td>a<td>b<tr><th>c</table>": [("table", "abc", -1), ("tbody", "abc", 0), ("tr", "ab", 1), ("td", "a", 2), ("td", "b", 2), ("tr", "c", 1), ("th", "c", 5)],
        "<table>x<div>y</div><tr><td>z</table>": [("div", "y", -1), ("table", "z", -1), ("tbody", "z", 1), ("tr", "z", 2), ("td", "z", 3)],
        "<dl><dt>a<dd>b<dt>c</dl>": [("dl", "abc", -1), ("dt", "a", 0), ("dd", "b", 0), ("dt", "c", 0)],
        "<select><option>a<option>b<optgroup><option>c</select>": [("select", "abc", -1), ("option", "a", 0), ("option", "b", 0), ("optgroup", "c", 0), ("option", "c", 3)],
        "<ul><li>a<ul><li>b</ul><li>c</ul>": [("ul", "abc", -1), ("li", "ab", 0), ("ul", "b", 1), ("li", "b", 2), ("li", "c", 0)],
        "<p>a<table><tr><td>b<p>c</td></table>d": [("p", "a", -1), ("table", "bc", -1), ("tbody", "bc", 1), ("tr", "bc", 2), ("td", "bc", 3), ("p", "c", 4)],
        "<h1>a<h2>b</h1>c": [("h1", "a", -1), ("h2", "b", -1)],
        "<div><b>a<div>b</b>c</div>d</div>": [("div", "abcd", -1), ("b", "abcd", 0), ("div", "bc", 1)],
        "<![x<p>y<p>z": [("p", "z", -1)],
        "<script>if (a<b) '</p>'</script>t<i>u": [("script", "if (a<b) '</p>'", -1), ("i", "u", -1)],
    }
    for html, want in known.items():
        page = elements.Elements(html)
        assert [(page.tag[i], page.text(i), page.parent[i]) for i in range(len(page.tag))] == want, html
    card = elements.listed_texts('<div class="listingCard"><h3>2019 Kia X</h3><p class="price">5 Lakh<p>12,300 km<a href="/used-car-details/x?a=1&amp;b=2">')
    assert [(r[1], r[3]) for r in card] == [("5 Lakh", "/used-car-details/x?a=1&b=2")]
    for odd in ("<a " * 300_000, '<a x="' * 200_000, "<!--" * 300_000, "<p><b>" * 100_000, "<table><tr><td>" * 50_000, "<p><table>" + "<i>" * 50_000 + "<div>" * 50_000):
        began = time.monotonic()
        elements.Elements(odd)
        assert time.monotonic() - began < 20


def test_tokens():
    assert list(tokens("<a href='x&amp;y&copy=1' ID=3>&lt;</a/>< 3<!--x--><!-->?")) == [
        ("start", "a", [("href", "x&y&copy=1"), ("id", "3")]), ("text", "<", []), ("end", "a", []), ("text", "<", []), ("text", " 3", []), ("text", "?", []),
    ]
    assert list(tokens(None)) == [] == list(tokens("<a b")) and list(tokens("<title>a&amp;<b></title>")) == [("start", "title", []), ("text", "a&<b>", []), ("end", "title", [])]


def test_posts(spark):
    cdn = "https://scontent.cdninstagram.com/v"
    nine = "".join(f"<img srcset='{cdn}/{k}b.jpg 1x' src='{cdn}/{k}a.jpg'>" for k in range(9))
    same = f'<img src="{cdn}/1.jpg?x=1&amp;ig_cache_key=A"><img src="{cdn}/2.jpg?x=1&amp;ig_cache_key=A">'
    pages = spark.createDataFrame([("a", "https://s/p/1/", nine), ("b", "https://s/p/2/", same), ("c", "https://s/reel/3/", None), ("d", "https://s/p/4/", "")], "handle string, url string, html string")
    got = {r["handle"]: r for r in posts.post_pages(pages).collect()}
    assert [u.rsplit("/", 1)[1] for u in got["a"]["images"]] == [f"{k}{x}.jpg" for k in range(4) for x in "ab"] and got["a"]["n_media"] == 8
    assert got["b"]["images"] == [f"{cdn}/1.jpg?x=1&ig_cache_key=A"]
    assert [(got[h]["caption"], got[h]["images"], got[h]["media"], got[h]["is_reel"]) for h in "cd"] == [("", [], [], True), ("", [], [], False)]
    assert posts.profile_links(pages.limit(0), "https://s").count() == 0


def test_titles_of_cards_are_read_once(spark):
    pages = spark.createDataFrame([("p", '<div class="listingCard"><h3>2019 Kia X Y  Z</h3><p class="price">5</p></div><div class="listingCard"><h3>2019 Kia</h3><p class="price">99999999999</p></div>')], "url string, html string")
    listed, cards = elements.listed_cards(pages, "https://b", "/s"), elements.result_cards(pages, "https://b")
    for df in (listed, cards):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("^(.*?)") == 1 and plan.count("lakh|lac") == 1
    assert [(r["make"], r["model"], r["variant"], r["year"], r["price"]) for r in listed.collect()] == [("Kia", "X", "Y Z", 2019, 5)]
