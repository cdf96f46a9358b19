"""Free text, HTML and JSON over documents, pages, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerwatch import config as C
from offerwatch.catalog.tables import load
from offerwatch.functions import costs, html
from offerwatch.functions import text as X
from offerwatch.sources import node_portal
from offerwatch.sources.pages import fetch_outcome

# Clause breaks without look-around: a sentence break is marked first (twice,
# because neighbouring breaks share a letter), then everything is split.
_WS = r"[\s\v\x{85}\p{Z}]"
_BREAK = f"'([a-zá-ž])\\.{_WS}+([A-ZÁ-Ž])'"
_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
_PLUS = f"'(^|{_WORD})plus($|{_WORD})'"


def _twice(text: str, pattern: str) -> str:
    mark = "'\\1' || chr(30) || '\\2', 'gi'"
    return f"regexp_replace(regexp_replace({text}, {pattern}, {mark}), {pattern}, {mark})"


CLAUSES_SQL = f"""
marked AS (SELECT doc_id, {_twice(_twice('text', _BREAK), _PLUS)} AS text FROM documents),
lists AS (SELECT doc_id, string_split_regex(text, '\\+|;|\\n|,{_WS}+|\\x1e') AS clauses FROM marked),
clauses AS (
  SELECT doc_id, unnest(clauses) AS clause, generate_subscripts(clauses, 1) - 1 AS pos FROM lists)"""


def clause_split(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(X.split_clauses(F.col("text"))).alias("pos", "clause"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("clause").alias("clause_md5"))


def amounts_in_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.transform(X.split_clauses(F.col("text")), X.first_amount).alias("amounts"))
    rows = rows.select("doc_id", F.size("amounts").cast("bigint").alias("n_clauses"), F.array_compact("amounts").alias("found"))
    return rows.select(
        "doc_id",
        "n_clauses",
        F.size("found").cast("bigint").alias("n_amounts"),
        F.get("found", F.lit(0)).alias("first_amount"),
        F.aggregate("found", F.lit(0).cast("bigint"), lambda total, x: total + x).alias("sum_amounts"),
    )


AMOUNTS_IN_TEXT = f"""
WITH {CLAUSES_SQL},
read AS (
  SELECT doc_id, pos,
         TRY_CAST(nullif(regexp_replace(regexp_extract(clause, '(\\d{{1,3}}(?:[ .,]\\d{{3}})+|\\d{{3,6}})', 1), '[ .,]', '', 'g'), '') AS BIGINT) AS amount
  FROM clauses)
SELECT doc_id, count(*) AS n_clauses, count(*) FILTER (amount > 0) AS n_amounts,
       arg_min(amount, pos) FILTER (amount > 0) AS first_amount,
       CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS sum_amounts
FROM read GROUP BY doc_id"""


def fees_from_text(spark, sf_dir):
    """Cost fields and descriptions of every shape, with the amount taken from the part."""
    part = load(spark, sf_dir, "part")
    n = F.floor("p_retailprice").cast("string")
    shape = F.col("p_partkey") % 12
    field = (
        F.when(shape == 0, n)
        .when(shape == 1, F.concat(F.lit("+"), n))
        .when(shape == 2, F.concat(F.lit("+ poplatky 3."), F.substring(n, 1, 3), F.lit(" Kč + el. energie + vratná kauce 20 000 Kč")))
        .when(shape == 3, F.concat(n, F.lit(" Kč plus elektřina 1 200 Kč")))
        .when(shape == 4, F.concat(F.lit("-"), n))
        .when(shape == 5, F.concat(F.lit("provize "), n, F.lit(" Kč, energie 777 Kč")))
        .when(shape == 6, F.concat(F.lit("1_000_"), F.substring(n, 1, 3)))
        .when(shape == 7, F.lit("dohodou"))
        .when(shape == 8, F.lit("0"))
    )
    prose = (
        F.when(shape == 5, "Měsíční výdaje 2 500 Kč, energie 333 Kč")
        .when(shape == 7, F.concat(F.lit("Byt 54 m² z roku 1975 po opravě. Služby "), n, F.lit(" Kč; energie 650 Kč")))
        .when(shape == 9, F.concat(F.lit("Poplatky a energie "), n, F.lit(" Kč")))
        .when(shape == 10, "Vratná kauce a poplatky 9 000 Kč")
        .when(shape == 11, "POPLATKY: 4 500 Kč")
    )
    rows = part.select("p_partkey", field.alias("cost_field"), prose.alias("description"))
    return costs.with_fees(rows, "cost_field", "description").select(
        "p_partkey", "fees_czk", "fees_source", "electricity_explicit"
    )


FEES_FROM_TEXT = """
WITH p AS (SELECT p_partkey, p_partkey % 12 AS shape, CAST(floor(p_retailprice) AS BIGINT) AS n FROM part)
SELECT p_partkey,
       CASE shape WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN CAST('3' || left(CAST(n AS VARCHAR), 3) AS BIGINT)
                  WHEN 3 THEN n WHEN 4 THEN n WHEN 5 THEN 2500
                  WHEN 6 THEN CAST('1000' || left(CAST(n AS VARCHAR), 3) AS BIGINT) WHEN 7 THEN n WHEN 9 THEN n WHEN 11 THEN 500 END AS fees_czk,
       CASE WHEN shape IN (0, 1, 2, 3, 4, 6) THEN 'field' WHEN shape IN (5, 7, 9, 11) THEN 'text' END AS fees_source,
       CAST(CASE shape WHEN 3 THEN 1200 WHEN 5 THEN 777 WHEN 7 THEN 650 WHEN 9 THEN n END AS BIGINT) AS electricity_explicit
FROM p"""


def html_text(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", html.plain_text(F.col("html")).alias("_text")).select(
        "page_id", F.length("_text").cast("bigint").alias("n_chars"), F.md5("_text").alias("text_md5")
    )


def html_links(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    links = html.segments(F.col("html"), r'href="([^"]+)"')
    as_images = F.transform(links, lambda link: F.struct(F.concat(F.lit("/"), link).alias("url")))
    return pages.select(
        "page_id",
        F.size(links).cast("bigint").alias("n_links"),
        F.array_join(html.image_bases(as_images, C.DEFAULTS.max_images), " ").alias("first_links"),
        X.listing_id_from_url(F.col("url")).alias("url_id"),
        X.last_path_segment(F.col("url")).alias("last_segment"),
        html.first_hosted_image(F.concat(F.lit('<img class="x"><img data-src="'), F.col("url"), F.lit('/1gr.cz">'))).alias("image"),
    )


HTML_LINKS = """
WITH l AS (SELECT *, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages)
SELECT page_id, CAST(len(links) AS BIGINT) AS n_links,
       array_to_string(list_transform(links[1:5], lambda x: CASE WHEN x LIKE '/%' THEN 'https:/' || x ELSE '/' || x END), ' ') AS first_links,
       nullif(regexp_extract(url, '/(\\d+)/?$', 1), '') AS url_id,
       list_last(string_split(rtrim(url, '/'), '/')) AS last_segment,
       url || '/1gr.cz' AS image
FROM l"""


def html_cards(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.posexplode(html.segments(F.col("html"), r"(?s)<li>(.*?)(?=<li>|</ul)")).alias("pos", "card"))
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"),
        F.regexp_extract("card", r'href="([^"]+)"', 1).alias("href"), html.plain_text(F.col("card")).alias("label"),
    )


HTML_CARDS = f"""
WITH pieces AS (SELECT page_id, string_split(html, '<li>') AS p FROM pages),
numbered AS (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS last FROM pieces),
kept AS (
  SELECT page_id, i - 2 AS pos, string_split(piece, '</ul')[1] AS card
  FROM numbered WHERE i > 1 AND (i < last OR contains(piece, '</ul')))
SELECT page_id, pos, regexp_extract(card, 'href="([^"]+)"', 1) AS href,
       trim(regexp_replace(regexp_replace(card, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')) AS label
FROM kept"""


def fetch_outcomes(spark, sf_dir):
    key = F.col("page_id") % 9
    status = (
        F.when(key == 0, 404).when(key == 1, 429).when(key == 2, 503).when(key == 3, 403).when(key == 4, F.lit(None)).otherwise(200)
    ).cast("int")
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", fetch_outcome(status, F.col("html").contains("spam")).alias("outcome"))


def json_props(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return events.groupBy("event_type").agg(
        F.count(k).alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k")
    )


def _nested(key, levels):
    """A node of alternating type inside `levels` wrappers, each an object in a list."""
    kind = F.when(key % 3 == 0, "Advert").when(key % 3 == 1, "Image").otherwise("Other")
    inner = F.concat(
        F.lit('{"id":'), key.cast("string"), F.lit(',"__typename":"'), kind,
        F.lit('","text":"[{\\"__typename\\":\\"Advert\\"}]","more":[{"__typename":"Image","id":"in-'), key.cast("string"), F.lit('"}]}'),
    )
    return F.concat(F.repeat(F.lit('{"w":['), levels), inner, F.repeat(F.lit("]}"), levels))


def json_node_walk(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = customers.select("c_custkey", _nested(key, (key % 7).cast("int")).alias("_json"))
    rows = rows.select("c_custkey", F.try_parse_json("_json").alias("_state"), node_portal.json_depth(F.col("_json")).alias("_depth"))
    nodes = node_portal.nodes_of_types(F.col("_state"), F.col("_depth"), (C.ADVERT_NODE, C.IMAGE_NODE))
    found = rows.select("c_custkey", F.col("_depth").cast("bigint").alias("depth"), F.explode(nodes).alias("p"))
    return found.select(
        "c_custkey",
        "depth",
        F.try_variant_get("p.node", "$.__typename", "string").alias("node_type"),
        F.try_variant_get("p.node", "$.id", "string").alias("node_id"),
        F.size("p.path").cast("bigint").alias("level"),
    )


JSON_NODE_WALK = """
SELECT c_custkey, (c_custkey % 7) * 2 + 3 AS depth, CASE c_custkey % 3 WHEN 0 THEN 'Advert' ELSE 'Image' END AS node_type,
       CAST(c_custkey AS VARCHAR) AS node_id, (c_custkey % 7) * 2 AS level
FROM customer WHERE c_custkey % 3 <> 2
UNION ALL
SELECT c_custkey, (c_custkey % 7) * 2 + 3, 'Image', 'in-' || c_custkey, (c_custkey % 7) * 2 + 2 FROM customer"""


def code_map(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    codes = F.element_at(
        F.array(*[F.lit(c) for c in (*C.DISPOSITION_ENUM, "DISP_7_7")]), (F.col("p_size") % 8 + 1).cast("int")
    )
    return part.select(
        "p_partkey", X.label(codes, C.DISPOSITION_ENUM).alias("disposition"),
        X.label((F.col("p_size") % 6).cast("int"), C.DISPOSITION_CODES).alias("by_number"),
    )


CODE_MAP = """
SELECT p_partkey,
       CASE p_size % 8 WHEN 0 THEN '1+kk' WHEN 1 THEN '2+kk' WHEN 2 THEN '3+kk' WHEN 3 THEN '4+kk'
                       WHEN 4 THEN '1+1' WHEN 5 THEN '2+1' WHEN 6 THEN '3+1' END AS disposition,
       CASE p_size % 6 WHEN 2 THEN '1+kk' WHEN 4 THEN '2+kk' END AS by_number
FROM part"""


QUERIES = {
    "clause_split": clause_split,
    "amounts_in_text": amounts_in_text,
    "fees_from_text": fees_from_text,
    "html_text": html_text,
    "html_links": html_links,
    "html_cards": html_cards,
    "fetch_outcomes": fetch_outcomes,
    "json_props": json_props,
    "json_node_walk": json_node_walk,
    "code_map": code_map,
}

ORACLES = {
    "clause_split": f"WITH {CLAUSES_SQL} SELECT doc_id, pos, md5(clause) AS clause_md5 FROM clauses",
    "amounts_in_text": AMOUNTS_IN_TEXT,
    "fees_from_text": FEES_FROM_TEXT,
    "html_text": f"""
        WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')) AS text FROM pages)
        SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "html_links": HTML_LINKS,
    "html_cards": HTML_CARDS,
    "fetch_outcomes": """
        SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'gone' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient'
                 WHEN 3 THEN 'fatal' WHEN 4 THEN 'transient'
                 ELSE CASE WHEN contains(html, 'spam') THEN 'ok' ELSE 'unreadable' END END AS outcome
        FROM pages""",
    "json_props": """
        SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
    "json_node_walk": JSON_NODE_WALK,
    "code_map": CODE_MAP,
}
