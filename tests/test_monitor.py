import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from offerwatch import config as C
from offerwatch import schemas
from offerwatch.operators import diff, watch
from offerwatch.plans import markers, marts, monitor
from offerwatch.plans.store import RunInProgress, Store, run_name
from offerwatch.session import work_dir
from offerwatch.streaming import runs as streaming
from pyspark.sql import functions as F

import pages as P

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def at(n):
    return START + timedelta(hours=8 * n)


def run_pages(n, rent, sale=((9, 5_000_000),), watched=None, adverts=(), cards=(), complete=True):
    kw = {"run_id": f"landing-{n}", "run_seq": None, "at": at(n)}
    url = "https://main/search?region=Vyso%C4%8Dany&strana=1"
    rows = [
        P.search([P.result(i, price=p) for i, p in rent], total=len(rent) + (0 if complete else 50), url=url, **kw),
        P.search([P.result(i, price=p) for i, p in sale], tx="prodej", url=url, **kw),
        P.search([P.result(777)], url="https://main/search?region=Brno", page_no=2, **kw),
    ]
    rows += [P.detail(i, costOfLiving="3000", **kw) for i, _ in [*rent, *sale]]
    rows += [P.detail(k, kind="watched", status=s, priceCzk=p, **kw) for k, s, p in watched or []]
    if adverts:
        rows.append(P.node_page({"x": [P.advert(i) for i in adverts]}, **kw))
    if cards:
        rows.append(P.card_page([P.card(slug=f"a/b/{c}") for c in cards], **kw))
    return rows


RUNS = [
    run_pages(0, [(1, 20000), (2, 21000)], watched=[("1", 200, 20000), ("5", 404, 0)], adverts=[1], cards=["aa"]),
    run_pages(1, [(1, 20500), (3, 19000)], watched=[("1", 500, 0), ("5", 404, 0)], adverts=[1], cards=["aa"]),
    run_pages(2, [(1, 20500)], complete=False),
    run_pages(3, [(1, 20500), (3, 19000)], watched=[("1", 200, 22000), ("5", 200, 1)], cards=["aa"]),
    run_pages(4, [(1, 20500), (2, 21000), (3, 19000)], watched=[("1", 404, 0), ("5", 200, 1)], cards=["aa"]),
]


@pytest.fixture(scope="module")
def stored(spark):
    """All landings processed by the periodic job; the third is incomplete."""
    root = work_dir(spark, "monitor-test")
    rows = [row for pages in RUNS for row in pages]
    spark.createDataFrame(rows, schemas.RAW_PAGES).write.parquet(f"{root}/raw_pages")
    landed = [(f"landing-{n}", None, at(n)) for n in range(len(RUNS))]
    spark.createDataFrame(landed, schemas.RUNS).write.parquet(f"{root}/landed")
    store = Store(spark, f"{root}/store")
    pages = spark.read.schema(schemas.RAW_PAGES).parquet(f"{root}/raw_pages")
    edits = spark.createDataFrame(
        [("add", "https://main/detail/1", 1), ("add", "https://main/detail/5/", 2), ("add", "https://main/detail", 3)],
        "op string, arg string, ts int",
    )
    assert [r.url for r in monitor.edit_watchlist(store, edits).collect()] == ["https://main/detail"]
    refused = []
    for _ in range(2):  # the second time there is nothing new
        streaming.stream_runs(store, pages, f"{root}/landed", f"{root}/_landed", patience=1, on_incomplete=refused.append).awaitTermination()
    return store, refused


def test_incomplete_run_is_not_committed(stored):
    store, refused = stored
    assert refused == ["landing-2"]
    runs = {r.run_seq: r.run_id for r in store.runs().collect()}
    assert runs == {1: "landing-0", 2: "landing-1", 3: "landing-3", 4: "landing-4"}


def test_changes(stored):
    store, _ = stored
    rows = store.committed("changes", schemas.CHANGES).collect()
    got = {(r.run_seq, r.kind, r.listing_key): r for r in rows}
    assert set(got) == {
        (2, "price_change", "1"), (2, "new", "3"), (3, "removed", "2"), (4, "new", "2"), (4, "removed", "bez-1"),
    }
    moved = got[(2, "price_change", "1")]
    assert (moved.old_price_czk, moved.new_price_czk, moved.old_total_czk, moved.new_total_czk) == (20000, 20500, 24500, 25000)
    gone = got[(3, "removed", "2")]
    assert gone.missing_since.replace(tzinfo=timezone.utc) == at(1) and gone.removed_since.replace(tzinfo=timezone.utc) == at(3)
    assert gone.item.total_czk == 25500


def test_pending_then_removed(stored, spark):
    store, _ = stored
    waiting = {(r.run_seq, r.listing_key) for r in spark.read.parquet(store.path("pending")).select("run_seq", "listing_key").collect()}
    assert waiting == {(2, "2"), (3, "bez-1")}


def test_watched(stored):
    store, _ = stored
    states = {(r.run_seq, r.listing_key): r for r in store.committed("watched", monitor.WATCH_STATE).collect()}
    assert [states[(n, "1")].active for n in (1, 2, 3, 4)] == [True, True, True, False]
    assert states[(2, "1")].fetch_error and states[(2, "1")].payload.rent_czk == 20000
    assert states[(4, "1")].last_active_at.replace(tzinfo=timezone.utc) == at(3) and states[(4, "1")].payload.rent_czk == 22000
    moved = store.committed("watched_changes", monitor.WATCHED_CHANGES).collect()
    assert {(r.run_seq, r.listing_key) for r in moved} == {(3, "1"), (3, "5")}


def test_marts(stored, spark):
    store, _ = stored

    def mart(name, run):
        return spark.read.parquet(f"{store.path(name)}/run_seq={run}")

    listed = {r.listing_key: r for r in mart("mart_listings", 3).collect()}
    assert listed["1"].change_note.startswith("Price changed: 24 900 Kč → 26 900 Kč")      # the watched change wins
    assert listed["3"].change_note is None and "777" not in listed
    watched = {r.listing_key: r for r in mart("mart_watched", 4).collect()}
    assert watched["1"].change_note == f"No longer listed — showing last known details from {at(3):%Y-%m-%dT%H:%M:%SZ}"
    assert watched["1"].transaction_type == "pronajem" and watched["5"].active
    history = mart("mart_history", 4).orderBy(F.desc("event_run_seq"), "kind_order", "listing_key").collect()
    assert [(r.event_run_seq, r.kind, r.listing_key, r.is_watched) for r in history] == [
        (4, "new", "2", False), (4, "removed", "bez-1", False), (3, "price_change", "1", True), (3, "price_change", "5", True),
        (3, "removed", "2", False), (2, "price_change", "1", False), (2, "new", "3", False),
    ]
    stats = mart("run_stats", 1).first()
    assert stats.rent_count == 4 and stats.sale_count == 1
    counts = {(r.what, r["name"]): r.n for r in mart("mart_counts", 2).collect()}
    assert counts == {("events", "new"): 1, ("events", "price_change"): 1, ("events", "pending"): 1,
                      ("listings", C.MAIN_SOURCE): 3, ("listings", C.NODE_SOURCE): 1, ("listings", C.CARD_SOURCE): 1}
    layers = {(r.listing_key, r.layer) for r in mart("mart_map", 1).select("listing_key", "layer").collect()}
    assert ("1", "rent") in layers and ("9", "sale") in layers and ("1", "watched") in layers


def test_history_has_times_and_what_is_watched_now(stored, spark):
    store, _ = stored
    rows = {(r.event_run_seq, r.listing_key): r for r in spark.read.parquet(f"{store.path('mart_history')}/run_seq=4").collect()}
    landing = {2: 1, 3: 3, 4: 4}
    for (run, _key), r in rows.items():
        assert r["at"].replace(tzinfo=timezone.utc) == at(landing[run])
    assert rows[(3, "5")].is_live and rows[(3, "5")].item.total_czk is not None     # on the watch list only
    assert rows[(3, "5")].line.startswith("#5: — → ")
    assert rows[(2, "1")].is_live and rows[(2, "1")].item.price_czk == 22000          # the watched row hides the listed one
    assert not rows[(4, "bez-1")].is_live and rows[(4, "bez-1")].item is not None


def test_newest_events_open_only_the_runs_that_hold_them(stored, spark):
    store, _ = stored
    held = {1: (True, []), 2: (True, [(2, 2)]), 3: (True, [(3, 3), (2, 2)]), 4: (True, [(4, 2), (3, 3), (2, 2)])}
    reach = store.committed("history_reach", monitor.HISTORY_REACH).collect()
    assert {r.run_seq: (r.whole, [tuple(x) for x in r.runs]) for r in reach} == held
    every = [(4, "new", "2"), (4, "removed", "bez-1"), (3, "price_change", "1"), (3, "price_change", "5"), (3, "removed", "2"),
             (2, "price_change", "1"), (2, "new", "3")]
    for cap, first in ((1, 4), (2, 4), (3, 3), (5, 3), (6, 2), (7, 2), (300, 2)):
        found = monitor.newest_history(store, 4, cap)
        assert [(r.run_seq, r.kind, r.listing_key) for r in found.collect()] == every[:cap]
        plan = found._jdf.queryExecution().toString()
        assert f"run_seq >= {first})" in plan or f">= {first})" in plan, plan
    # a run without events takes over what the one before reached
    nothing = schemas.empty(spark, schemas.CHANGES), schemas.empty(spark, monitor.WATCHED_CHANGES)
    row = monitor.history_reach(store, *nothing, 5, 4).first()
    assert (row.whole, [tuple(x) for x in row.runs]) == (False, [(4, 2), (3, 3)])


def test_newest_events_with_a_cap_that_was_raised_or_without_a_reach(spark):
    store = Store(spark, work_dir(spark, "reach"))
    changed = [(n, "new", f"k{i}") for n in range(1, 6) for i in range(3)]
    for n in range(1, 6):
        rows = spark.createDataFrame([c for c in changed if c[0] == n], "run_seq bigint, kind string, listing_key string")
        changes, watched = schemas.conform(rows, schemas.CHANGES, {}), schemas.empty(spark, monitor.WATCHED_CHANGES)
        store.write_run("changes", changes, n)
        if n > 1:  # the first run is older than reaches are
            store.write_run("history_reach", monitor.history_reach(store, changes, watched, n, 4), n)
    newest = sorted(changed, key=lambda c: (-c[0], c[2]))
    for cap in (2, 4, 10, 14, 100):
        assert [(r.run_seq, r.kind, r.listing_key) for r in monitor.newest_history(store, 5, cap).collect()] == newest[:cap]
    last = store.of_run("history_reach", monitor.HISTORY_REACH, 5).first()
    assert (last.whole, [tuple(x) for x in last.runs]) == (False, [(5, 3), (4, 3)])


def test_watch_list_drives_the_run(spark):
    """Read, read, no page, gone: the state survives the run without a page."""
    root = work_dir(spark, "list-run")
    pages = []
    for n, watched in enumerate([[("1", 200, 20000)], [("1", 200, 20000), ("8", 200, 1)], [], [("1", 404, 0)]]):
        pages += run_pages(n, [(3, 19000)], watched=watched)
    landed = spark.createDataFrame(pages, schemas.RAW_PAGES)
    store = Store(spark, root)
    store.write_watchlist(spark.createDataFrame([("1", "u1"), ("2", "u2")], schemas.WATCHLIST))
    for n in range(4):
        monitor.run(store, landed, f"landing-{n}", at(n))
    states = {(r.run_seq, r.listing_key): r for r in store.committed("watched", monitor.WATCH_STATE).collect()}
    assert {k for _, k in states} == {"1", "2"} and len(states) == 8       # 8 is not on the list
    third, fourth = states[(3, "1")], states[(4, "1")]
    assert third.active and third.payload.rent_czk == 20000 and third.fetch_error == "u1: no answer"
    assert third.fetch_error_at.replace(tzinfo=timezone.utc) == at(2)
    assert not fourth.active and fourth.payload.rent_czk == 20000
    assert fourth.last_active_at.replace(tzinfo=timezone.utc) == at(1)
    assert all(states[(n, "2")].unavailable and not states[(n, "2")].active for n in (1, 2, 3, 4))


def test_batch_and_stream_agree(stored, spark):
    store, _ = stored
    streaming.stream_changes(store, store.path("_c1"), out_table="changes_again", runs_per_batch=1).awaitTermination()
    names = ["run_seq", "kind", "listing_key", "old_total_czk", "new_total_czk"]
    again = {tuple(r) for r in spark.read.parquet(store.path("changes_again")).select(*names).collect()}
    assert again == {tuple(r) for r in store.committed("changes", schemas.CHANGES).select(*names).collect()}
    streaming.stream_watch_states(store, store.path("_c2")).awaitTermination()
    columns = [c for c in watch.STATE_COLUMNS if c != "payload"]
    states = store.read_or_empty("watched_states", monitor.WATCH_STATE).select(*columns)
    assert {tuple(r) for r in states.collect()} == {
        tuple(r) for r in store.committed("watched", monitor.WATCH_STATE).select(*columns).collect()
    }


def test_empty_store_reads_empty(spark):
    store = Store(spark, work_dir(spark, "empty"))
    assert store.last_run() is None and store.latest("listings", schemas.LISTING).count() == 0
    assert store.watchlist().count() == 0 and store.committed("changes", schemas.CHANGES).count() == 0


def test_watchlist_versions(spark):
    store = Store(spark, work_dir(spark, "list"))
    one = spark.createDataFrame([("1", "u1")], schemas.WATCHLIST)
    store.write_watchlist(one)
    store.write_watchlist(watch.add_to_watchlist(store.watchlist(), spark.createDataFrame([("2", "u2", 1)], "listing_key string, url string, ts int")))
    assert {r.listing_key for r in store.watchlist().collect()} == {"1", "2"}


def test_two_writers_at_once_lose_no_edit(spark):
    store = Store(spark, work_dir(spark, "two-writers"))
    store.write_watchlist(spark.createDataFrame([("0", "u0")], schemas.WATCHLIST))
    together = threading.Barrier(4, timeout=60)

    def writer(n):
        first = [True]

        def edit(listed):
            if first.pop() if first else False:
                together.wait()  # all have read the same version before any writes the next
            return listed.unionByName(spark.createDataFrame([(str(n), f"u{n}")], schemas.WATCHLIST))

        return store.edit_watchlist(edit)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(writer, range(1, 5)))
    assert sorted(versions) == [2, 3, 4, 5] and store.watchlist_version() == 5
    assert {r.listing_key for r in store.watchlist().collect()} == {"0", "1", "2", "3", "4"}
    assert [store.watchlist(v).count() for v in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 5]


def test_a_run_number_is_given_once(spark):
    store = Store(spark, work_dir(spark, "claims"))
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: markers.put_if_absent(spark, store.path("m"), 1, f"w{n}"), range(6)))
    assert sum(got) == 1 and markers.read(spark, store.path("m"), 1) == f"w{got.index(True)}"
    assert markers.read(spark, store.path("m"), 2) is None and markers.last(spark, store.path("m")) == 1
    assert markers.last(spark, store.path("none")) is None
    assert store.claim_run("a") == 1 and store.claim_run("a") == 1  # a landing that died gets its number again
    with pytest.raises(RunInProgress) as refused:
        store.claim_run("b")
    assert refused.value.args == (1, "a")
    store.commit(1, START, "a")
    assert store.claim_run("b") == 2
    store.release_run(2)
    assert store.claim_run("c") == 2


def test_strict_runs_do_not_take_a_failed_portal_for_removals(spark):
    """The second portal lands nothing in two runs; then it comes back without one of its adverts."""
    store = Store(spark, work_dir(spark, "strict"))
    landed = [run_pages(n, [(1, 20000)], adverts=adverts) for n, adverts in enumerate([[1, 2], [], [], [1]])]
    pages = spark.createDataFrame([row for rows in landed for row in rows], schemas.RAW_PAGES)
    for n in range(4):
        monitor.run(store, pages, f"landing-{n}", at(n), C.MonitorConfig(strict=True))
    changes = store.committed("changes", schemas.CHANGES)
    assert [(r.run_seq, r.kind, r.listing_key) for r in changes.collect()] == []
    waiting = spark.read.parquet(store.path("pending")).select("run_seq", "listing_key", "missing_since_seq")
    assert {tuple(r) for r in waiting.collect()} == {(4, "bez-2", 4)}
    states = {(r.run_seq, r.source): (r.source_seq, r.complete, r.recent) for r in store.committed("source_states", diff.SOURCE_STATE).collect()}
    assert states[(3, C.NODE_SOURCE)] == (1, False, [1]) and states[(4, C.NODE_SOURCE)] == (2, True, [4, 1])
    assert states[(4, C.MAIN_SOURCE)] == (4, True, [4, 3, 2])
    again = monitor.new_events(store, 1, 4, strict=False)
    assert {(r.run_seq, r.kind, r.listing_key) for r in again.collect()} == {(3, "removed", "bez-1"), (3, "removed", "bez-2"), (4, "new", "bez-1")}


def test_open_runs_are_tested_again_in_order_and_given_up_in_the_end(spark):
    root = work_dir(spark, "queue")
    store, told = Store(spark, f"{root}/store"), []
    price = [20000, 20500, 21000, 21500, 22000]

    def call(land, incomplete):
        if land:
            spark.createDataFrame([(f"landing-{n}", None, at(n)) for n in land], schemas.RUNS).write.mode("append").parquet(f"{root}/landed")
        rows = [row for n in range(5) for row in run_pages(n, [(1, price[n])], complete=n not in incomplete)]
        pages = spark.createDataFrame(rows, schemas.RAW_PAGES)
        streaming.stream_runs(store, pages, f"{root}/landed", f"{root}/_landed", patience=2, on_incomplete=told.append)
        return {r.run_id[-1]: (r.state, r.tries) for r in streaming.run_queue(store).collect()}

    first = call([0, 1, 2], incomplete=[1])
    assert first == {"0": ("committed", 1), "1": ("incomplete", 1), "2": ("landed", 0)}  # 2 waits for 1
    assert call([], incomplete=[]) == {"0": ("committed", 1), "1": ("committed", 2), "2": ("committed", 1)}  # completed late
    assert call([3, 4], incomplete=[3])["3"] == ("incomplete", 1)
    last = call([], incomplete=[3])
    assert last["3"] == ("given_up", 2) and last["4"] == ("committed", 1) and told == ["landing-1", "landing-3", "landing-3"]
    assert {r.run_seq: r.run_id for r in store.runs().collect()} == {1: "landing-0", 2: "landing-1", 3: "landing-2", 4: "landing-4"}
    moved = store.committed("changes", schemas.CHANGES).where("kind = 'price_change'").select("run_seq", "old_price_czk", "new_price_czk")
    assert {tuple(r) for r in moved.collect()} == {(2, 20000, 20500), (3, 20500, 21000), (4, 21000, 22000)}


def test_run_name_is_utc():
    assert run_name(datetime(2024, 5, 1, 10, 0, tzinfo=timezone(timedelta(hours=2)))) == "20240501T080000Z"


def test_uncommitted_run_can_be_written_again(spark):
    store = Store(spark, work_dir(spark, "again"))
    df = schemas.conform(spark.createDataFrame([(1, "a")], "run_seq bigint, listing_key string"))
    store.write_run("listings", df, 1)
    assert store.latest("listings", schemas.LISTING).count() == 0
    store.write_run("listings", df, 1)
    store.commit(1, START)
    assert store.latest("listings", schemas.LISTING).count() == 1


def test_sort_puts_nulls_lowest(spark):
    rows = [("a", 2, 1), ("b", None, 2), ("c", 1, 3), ("d", 1, 4)]
    mart = spark.createDataFrame(rows, "listing_key string, price_czk_per_sqm bigint, ordinal bigint")
    assert [r.listing_key for r in marts.query_listings(mart).collect()] == ["b", "c", "d", "a"]
    assert [r.listing_key for r in marts.query_listings(mart, descending=True).collect()] == ["a", "c", "d", "b"]


def test_facets_and_search(spark):
    rows = [("a", "pronajem", "1+kk", "s", True, "Byt U Parku", None, None, 1), ("b", "prodej", "2+kk", "t", False, None, "Park", None, 2),
            ("c", "pronajem", "2+kk", "t", False, None, None, "Praha, PARK 9", 3)]
    mart = spark.createDataFrame(rows, "listing_key string, transaction_type string, disposition string, source string, "
                                       "is_focus_street boolean, title string, city_part string, locality string, ordinal bigint")

    def keys(**kw):
        return [r.listing_key for r in marts.query_listings(mart, sort_key="ordinal", **kw).collect()]

    assert keys() == ["a", "b", "c"] and keys(text="park") == ["a", "b", "c"] and keys(text="parku") == ["a"]
    assert keys(tx="pronajem") == ["a", "c"] and keys(tx="pronajem", disposition="2+kk") == ["c"]
    assert keys(source="t", text="9") == ["c"] and keys(focus_only=True) == ["a"] and keys(tx="") == ["a", "b", "c"]
    assert [r.listing_key for r in marts.same_street(mart).collect()] == ["a"]


def test_history_is_capped_at_the_newest(spark):
    events = spark.range(301).select((F.col("id") + 1).alias("run_seq"), F.lit("new").alias("kind"), F.col("id").cast("string").alias("listing_key"))
    newest = marts.newest_events(marts.history_events(events)).collect()
    assert len(newest) == 300 and newest[0].run_seq == 301 and newest[-1].run_seq == 2


def test_lookup_prefers_watched(spark):
    listed = spark.createDataFrame([("1", "listed"), ("2", "listed")], "listing_key string, title string")
    items = marts.watched_then_listed(spark.createDataFrame([("1", "watched")], listed.schema), listed)
    assert marts.lookup(items, "1").first().title == "watched" and marts.lookup(items, "2").first().title == "listed"
    assert {(r.listing_key, r.title) for r in marts.preferred_items(items).collect()} == {("1", "watched"), ("2", "listed")}
