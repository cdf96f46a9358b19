from offerwatch import config as C
from offerwatch import schemas
from offerwatch.catalog import offers, tables
from offerwatch.functions import html
from offerwatch.operators import completeness, enrich
from offerwatch.plans import monitor
from offerwatch.sources import card_portal, main_portal, node_portal
from offerwatch.sources.pages import embedded_state, fetch_outcome, in_region, query_data, result_ordinal
from pyspark.sql import functions as F

import pages as P


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_PAGES)


def by_key(df):
    return {r["listing_key"]: r for r in df.collect()}


def test_query_selection_takes_first_success(spark):
    body = P.queries("estate", {"v": 2}, extra=[
        {"queryKey": ["other"], "state": {"status": "success", "data": [1]}},
        {"queryKey": ["estate"], "state": {"status": "error", "data": {"v": 0}}},
        {"queryKey": ["estate", 1], "state": {"status": "success", "data": {"v": 1}}},
        {"queryKey": [], "state": {"status": "success", "data": {}}},
    ])
    df = spark.createDataFrame([(body,), ("no state",), ("",), (None,)], "body string")
    got = df.select(F.try_variant_get(query_data(embedded_state(F.col("body")), "estate"), "$.v", "int").alias("v")).collect()
    assert [r.v for r in got] == [1, None, None, None]


def test_fetch_outcomes(spark):
    cases = [(200, True, "ok"), (200, False, "unreadable"), (404, False, "gone"), (429, False, "transient"),
             (500, False, "transient"), (None, False, "transient"), (403, False, "fatal"), (410, True, "fatal")]
    df = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(cases)], "i int, s int, d boolean")
    got = df.orderBy("i").select(fetch_outcome(F.col("s"), F.col("d")).alias("o")).collect()
    assert [r.o for r in got] == [c[2] for c in cases]


def test_search_rows(spark):
    df = frame(spark, P.search([
        P.result(1, name="Byt 2+kk 55\u00a0m²"),          # no-break space before the unit
        P.result(2, name="Byt 2+kk 55 m²", per=363),
        P.result(3, code=9, label="3+kk"),
        P.result(4, name="Byt 40,5 m²", price=0, street=None, images=("", "https://i/b.jpg", "//i/c", "//i/d", "//i/e", "//i/f", "//i/g")),
        P.result(5, label="1+kk", code=2, street="Pod Harfou", name=None, images=()),
    ]))
    got = by_key(main_portal.search_listings(main_portal.search_pages(df)))
    assert set(got) == {"1", "2", "4", "5"}
    assert got["1"].floor_area_sqm == got["2"].floor_area_sqm == 55.0
    assert got["1"].price_czk_per_sqm == 364 and got["2"].price_czk_per_sqm == 363
    assert got["1"].url == C.MAIN_DETAIL_URL + "pronajem/byt/2%2Bkk/x/1"
    assert got["1"].thumb == "https://img/a.jpg?fl=res,400,400,1|shr,,20|webp,60"
    assert got["1"].locality == "Dlouhá, Vysočany, Praha" and not got["1"].is_focus_street
    assert got["4"].price_czk is None and got["4"].total_czk is None and got["4"].locality == "Vysočany, Praha"
    assert got["4"].floor_area_sqm == 40.5
    assert [u.split("?")[0] for u in got["4"].images] == ["https://i/b.jpg", "https://i/c", "https://i/d", "https://i/e", "https://i/f"]
    assert got["5"].is_focus_street and got["5"].images == [] and got["5"].thumb is None and got["5"].floor_area_sqm is None


def test_enrichment_rules(spark):
    df = frame(
        spark,
        P.search([P.result(i, lat=None if i == 2 else 50.1, name="Byt" if i in (3, 8) else "Byt 55 m²") for i in range(1, 9)]),
        P.detail(1), P.detail(2), P.detail(3, images=[{"url": "//n/x"}], seller={"name": ""}),
        P.detail(4, status=404), P.detail(5, status=500), P.detail(6, body="<html></html>"),
        P.detail(7, costOfLiving=None, description="Nájem. Poplatky 2 500 Kč a energie 900 Kč, kauce 30 000 Kč"),
        P.detail(8, floorArea=0),
    )
    found = main_portal.search_listings(main_portal.search_pages(df))
    got = by_key(enrich.enrich(found, main_portal.details(df)))
    assert set(got) == {"1", "2", "3", "5", "6", "7", "8"}
    one = got["1"]
    assert (one.fees_czk, one.fees_source, one.electricity_czk, one.electricity_estimated, one.total_czk) == (3400, "field", 1500, True, 24900)
    assert one.price_czk_per_sqm == round(24900 / 55) and one.fees_missing is False
    assert one.garage is None and one.parking is False           # parkingLots 0 wins over parking true
    assert one.images and one.lat == 50.1 and one.description == "Popis."
    assert (got["2"].lat, got["2"].lon) == (50.11, 14.51)
    assert got["3"].floor_area_sqm == 50.0 and got["3"].seller_name == "Office"
    assert got["3"].images == ["https://n/x?fl=res,800,800,1|shr,,20|jpg,80"]
    assert got["5"].enrich_failed and got["5"].total_czk == 20000 and got["5"].electricity_estimated is False
    assert got["6"].enrich_failed is None and got["6"].description is None
    assert (got["7"].fees_czk, got["7"].fees_source, got["7"].electricity_czk, got["7"].electricity_estimated) == (2500, "text", 2500, False)
    assert got["8"].floor_area_sqm is None and got["8"].price_czk_per_sqm is None


def test_watched_reads(spark):
    df = frame(
        spark,
        P.detail(1, kind="watched", url="u1"), P.detail(2, kind="watched", status=404), P.detail(3, kind="watched", status=503),
        P.detail(4, kind="watched", body="x"), P.detail(6, kind="watched", body=P.queries("other", {})), P.detail(5, kind="watched", categoryTypeCb={"value": 1}, description=None),
    )
    got = by_key(main_portal.watched_reads(df))
    assert {k: r.outcome for k, r in got.items()} == {"1": "ok", "2": "gone", "3": "unreadable", "4": "unreadable", "5": "ok", "6": "unreadable"}
    assert got["4"].error == "no __NEXT_DATA__ in page (HTTP 200)" and got["6"].error == "estate query missing from page"
    p = got["1"].payload
    assert (p.rent_czk, p.total_czk, p.price_czk_per_sqm, p.photo_count, p.district) == (20000, 24900, 498, 0, "Praha 9")
    assert got["2"].payload is None and got["2"].error == "HTTP 404"
    sale = got["5"].payload
    assert (sale.transaction_type, sale.total_czk, sale.price_czk_per_sqm, sale.description) == ("prodej", 20000, 400, "")


def test_nested_adverts(spark):
    absent = P.advert(7)
    del absent["active"]
    state = {"props": {"apollo": {
        "Advert:1": P.advert(1, inner={"deep": [{"x": [P.advert(2, surface=33.5, mainImage=None)]}]}),
        "a": [P.advert(3, disposition="DISP_3_KK"), P.advert(4, gps={"lat": 50.2, "lng": 14.5}), P.advert(5, gps=None),
              P.advert(6, active=None), absent, P.advert(8, archived=True), P.advert(9, offerType="PRODEJ", price=8790000, surface=53, uri=None),
              P.advert(10, surface=54.0)],
        "text": '{"__typename":"Advert","id":99}',
        "Image:1": P.image(1, thumb="t1", main="m1"), "Image:7": P.image("7", main="m7"),
    }}}
    got = by_key(node_portal.adverts(frame(spark, P.node_page(state))))
    assert set(got) == {"bez-1", "bez-2", "bez-7", "bez-9", "bez-10"}
    assert got["bez-10"].title == "Pronájem bytu 2+kk 54.0 m²" and got["bez-10"].floor_area_sqm == 54
    assert (got["bez-1"].total_czk, got["bez-1"].price_czk_per_sqm, got["bez-1"].electricity_estimated) == (20400, 618, True)
    assert got["bez-1"].title == "Pronájem bytu 2+kk 33 m²" and got["bez-2"].title == "Pronájem bytu 2+kk 33.5 m²"
    assert (got["bez-1"].thumb, got["bez-1"].images) == ("t1", ["m1"])
    assert (got["bez-7"].thumb, got["bez-7"].images) == ("m7", ["m7"])
    assert got["bez-2"].images == [] and got["bez-2"].thumb is None
    assert (got["bez-9"].total_czk, got["bez-9"].price_czk_per_sqm, got["bez-9"].url) == (8790000, 165849, None)
    assert got["bez-1"].fees_missing is True and got["bez-1"].approx_location is False


def test_deep_nodes_are_found_at_any_depth(spark):
    deep = P.advert(1)
    for _ in range(60):
        deep = {"k": [deep]}
    got = node_portal.adverts(frame(spark, P.node_page({"root": deep})))
    assert got.count() == 1


def test_advert_details_and_cap(spark):
    def fee_page(id, fee, description="Popis", twin=True):
        nodes = {"list": [P.advert(id)], "main": {**P.advert(id), "fee": fee, "description": description}}
        return P.node_page(nodes, kind="detail", key=f"bez-{id}")

    df = frame(
        spark,
        P.node_page({"a": [P.advert(i) for i in range(1, 6)]}),
        fee_page(1, 5000), fee_page(2, 5001), fee_page(3, None, ""), fee_page(4, 0, "x" * 1300),
    )
    got = by_key(enrich.add_details(node_portal.adverts(df), node_portal.advert_details(df)))
    assert set(got) == {"bez-1", "bez-3", "bez-4", "bez-5"}
    assert got["bez-1"].admin_fee_czk == 5000 and got["bez-1"].description == "Popis"
    assert got["bez-3"].description is None and got["bez-5"].admin_fee_czk is None
    assert len(got["bez-4"].description) == 1200


def test_cards(spark):
    cards = [
        P.card(),
        P.card(slug="praha-9/vysocany/not-hex!", title="Prodej bytu 1 +  KK bez plochy", price="Cena na dotaz", image="https://other/x"),
        P.card(slug="praha-9/x/ab12", title="byt 3+1 70 m²"),
        P.card(slug="praha-9/x/ab13", info="Praha 9 - Libeň"),
        P.card(slug="praha-9/x/ab14", info="", title="byt 2+kk Vysočany 30&nbsp;m²"),
        P.card(slug="praha-9/x/ab15", host="https://elsewhere.example"),
    ]
    closed = by_key(card_portal.card_listings(card_portal.cards(frame(spark, P.card_page(cards + [P.card(slug="a/b/ff")])))))
    assert set(closed) == {"idnes-62af01", "idnes-not-hex!", "idnes-ab14", "idnes-ff"}
    one = closed["idnes-62af01"]
    assert (one.price_czk, one.floor_area_sqm, one.total_czk, one.price_czk_per_sqm) == (23400, 54.5, 24900, 457)
    assert one.title == "Pronájem bytu 2+kk 54 m²" and one.thumb == "https://1gr.cz/x.jpg" and one.images == [one.thumb]
    odd = closed["idnes-not-hex!"]
    assert (odd.disposition, odd.price_czk, odd.floor_area_sqm, odd.thumb, odd.images) == ("1+kk", None, None, None, [])
    assert odd.title == "Pronájem bytu 1+kk  m²" and odd.lat is None and odd.approx_location is False
    assert closed["idnes-ab14"].locality == "Vysočany"
    open_ended = by_key(card_portal.card_listings(card_portal.cards(frame(spark, P.card_page(cards[:1] + [P.card(slug="a/b/ff")], closed=False)))))
    assert set(open_ended) == {"idnes-62af01"}                    # the last card needs an end marker


def test_duplicate_results_keep_last_value_in_first_place(spark):
    df = frame(spark, P.search([P.result(1, price=1000), P.result(2), P.result(1, price=3000)]))
    got = by_key(monitor.main_listings(main_portal.search_pages(df), main_portal.details(df)))
    assert got["1"].price_czk == 3000 and got["1"].ordinal < got["2"].ordinal


def test_coordinates(spark):
    df = frame(spark, P.search([
        P.result(1, lat=50.0, lon=14.0), P.result(2, lat=50.2, lon=14.2), P.result(3, lat=None, lon=14.9),
        P.result(4, lat=0, lon=14.0), P.result(5, lat=None, lon=None, street="Pod Harfou"),
        P.result(6, lat=50.4, lon=14.4, street="Pod Harfou"),
    ]))
    got = by_key(monitor.main_listings(main_portal.search_pages(df), main_portal.details(df)))
    assert round(got["3"].lat, 9) == 50.2 and round(got["3"].lon, 9) == 14.2 and got["3"].approx_location
    assert got["4"].lat == 0 and not got["4"].approx_location
    assert (got["5"].lat, got["5"].lon) == (50.4, 14.4) and got["5"].approx_location
    assert not got["1"].approx_location
    none = frame(spark, P.search([P.result(1, lat=None, lon=None)]))
    only = by_key(monitor.main_listings(main_portal.search_pages(none), main_portal.details(none)))["1"]
    assert (only.lat, only.lon) == (50.1075, 14.507)


def test_completeness(spark):
    def gate(*rows):
        searched = main_portal.search_pages(frame(spark, *rows))
        return completeness.run_gate(searched).first().may_commit

    sale = P.search([P.result(9)], tx="prodej")
    three = [P.result(i) for i in range(3)]
    assert gate(P.search(three), sale)
    assert not gate(P.search(three))                                                   # one type missing
    assert not gate(P.search(three, total=50), sale)                                   # stopped early
    assert gate(P.search(three, total=22), P.search(three, total=22, offset=20, page_no=2), sale)
    assert not gate(P.search(three, total=22), P.search(three, total=22, offset=0, page_no=2), sale)
    assert not gate(P.search([], total=0), sale)                                       # zero rows
    assert not gate(P.search(three, total=22), P.search([], total=22, offset=20, page_no=2), sale)
    missing_total = P.page(C.MAIN_SOURCE, "search", P.queries("estatesSearch", {"results": three}), tx="pronajem")
    assert gate(missing_total, sale)
    assert not gate(P.page(C.MAIN_SOURCE, "search", "", tx="pronajem", status=403), sale)


def test_plain_text_keeps_entities(spark):
    df = spark.createDataFrame([("<b>a</b> \n<i>b&amp;c</i> ",)], "h string")
    assert df.select(html.plain_text(F.col("h")).alias("t")).first().t == "a b&amp;c"


def test_results_are_placed_by_source_type_and_page(spark):
    df = frame(
        spark,
        P.search([P.result(1)], tx="prodej"), P.search([P.result(2)], tx="pronajem"),
        P.card_page([P.card(slug="a/b/aa", price="1 000")], tx="pronajem"), P.card_page([P.card(slug="a/b/aa", price="2 000")], tx="prodej"),
        P.node_page({"x": P.advert(1)}, tx="prodej"), P.detail(1), P.detail(2),
    )
    got = monitor.listings_from_pages(df).orderBy("ordinal").collect()
    assert [r.listing_key for r in got] == ["2", "1", "bez-1", "idnes-aa"]
    assert got[-1].price_czk == 1000                              # sales are searched first there, so rent came last
    assert [r.source for r in got] == list(C.SOURCE_ORDER)[:1] * 2 + list(C.SOURCE_ORDER)[1:]


def test_region_that_cannot_be_decoded_is_kept(spark):
    urls = ["https://m/s?region=Vyso%C4%8Dany", "https://m/s?region=Brno", "https://m/s?region=%ZZ", "https://m/s", None]
    df = frame(spark, *[P.search([P.result(1)], url=u) for u in urls])
    assert [r.url for r in in_region(df, "Vysočany").select("url").collect()] == [urls[0], urls[2], urls[3], urls[4]]


def test_ordinals_of_long_searches_keep_apart(spark):
    df = spark.createDataFrame([("pronajem", 2_000_000, 0), ("pronajem", 1, 3_000_000), ("prodej", 1, 0)], "tx string, page int, pos int")
    got = df.select(result_ordinal(C.MAIN_SOURCE, F.col("tx"), F.col("page"), F.col("pos")).alias("o")).collect()
    assert got[1].o < got[0].o < got[2].o


def rows_of_largest_task(pages):
    return pages.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_main_pages_are_made_in_as_many_tasks_as_there_are_parts_for(spark, monkeypatch):
    # one file of parts is one scan task; the details made there were also sorted there
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 20, raising=False)
    n = tables.load(spark, "/root/testdata/sf0.001", "part").count()
    for pages in (offers._main_pages, offers._watched_pages):
        assert rows_of_largest_task(pages(spark, "/root/testdata/sf0.001").where("kind <> 'search'")) < n / 2


def test_node_and_card_pages_are_made_in_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 20, raising=False)
    node = offers._node_pages(spark, "/root/testdata/sf0.001").where("kind <> 'search'")
    assert rows_of_largest_task(node) < node.count() / 2
    plan = offers._card_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_filled_listings_of_a_run_stay_in_their_tasks(spark):
    # joined by the run they all went to one task
    rows = spark.range(0, 400, 1, 8).select(
        (F.col("id") % 1).cast("string").alias("run_id"), "id", F.when(F.col("id") > 9, 50.0).alias("lat"), F.lit(14.0).alias("lon"),
        F.lit(False).alias("is_focus_street"), F.lit(False).alias("approx_location"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = enrich.fill_coordinates(rows, ["run_id"])
        tasks = [r["task"] for r in filled.select("lat", F.spark_partition_id().alias("task")).collect()]
        assert max(map(tasks.count, set(tasks))) == 50
        assert filled.where("approx_location and lat = 50").count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
