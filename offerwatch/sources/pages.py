"""Landed raw pages: embedded state, query selection and fetch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch import config as C

# Room in an ordinal for any page number (an int) and for more rows than the text of
# a page can hold; searches are numbered up to 30, so the product stays a bigint.
_ROWS_PER_PAGE = 2**26
_PAGES_PER_TX = 2**31

OK, GONE, TRANSIENT, UNREADABLE, FATAL = "ok", "gone", "transient", "unreadable", "fatal"


def embedded_state(body: Column) -> Column:
    """The JSON document a page carries, as a variant; null when there is none."""
    return F.try_parse_json(F.regexp_extract(body, C.EMBEDDED_STATE, 1))


def query_data(state: Column, key: str) -> Column:
    """Data of the first successful query whose key starts with `key`, as a variant.

    Null when there is no such query; the query's data may itself be a JSON null.
    """
    queries = F.try_variant_get(state, "$.props.pageProps.dehydratedState.queries", "array<variant>")
    wanted = F.filter(
        queries,
        lambda q: (F.try_variant_get(q, "$.queryKey[0]", "string") == key)
        & (F.try_variant_get(q, "$.state.status", "string") == "success"),
    )
    return F.try_variant_get(F.get(wanted, F.lit(0)), "$.state.data", "variant")


def has_data(data: Column) -> Column:
    return data.isNotNull() & ~F.is_variant_null(data)


def fetch_outcome(status: Column, has_data: Column) -> Column:
    """How to read a fetch.

    Only a 404 says the listing is gone. A throttle, a server error or no answer
    at all (null status) says nothing about it; any other error status must stop
    the run; a page without the expected data could not be read.
    """
    return (
        F.when(status.isNull() | status.isin(*C.RETRY_STATUSES), TRANSIENT)
        .when(status == 404, GONE)
        .when(status >= 400, FATAL)
        .when(~F.coalesce(has_data, F.lit(False)), UNREADABLE)
        .otherwise(OK)
    )


def pages_of(pages: DataFrame, source: str, kind: str) -> DataFrame:
    """One portal's pages of one kind; both columns prune partitions of the landed table."""
    return pages.where((F.col("source") == source) & (F.col("kind") == kind))


def in_region(pages: DataFrame, region: str) -> DataFrame:
    """Drop search pages asked for another region; a URL that names none, or none that can be decoded, is kept."""
    asked = F.try_url_decode(F.regexp_extract(F.coalesce("url", F.lit("")), r"[?&]region=([^&#]*)", 1))
    return pages.where((F.col("kind") != "search") | F.coalesce(asked.isin("", region), F.lit(True)))


def result_ordinal(source: str, tx: Column, page_no: Column, position: Column) -> Column:
    """Place of a result in its run: by source, transaction type, page and position."""
    types = F.array(*[F.lit(t) for t in C.SEARCH_ORDER[source]])
    search = F.coalesce(F.array_position(types, tx), F.lit(0)).cast("bigint") + 10 * C.SOURCE_ORDER.index(source)
    return (search * _PAGES_PER_TX + page_no) * _ROWS_PER_PAGE + position
