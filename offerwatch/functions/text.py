"""Amounts, clauses and labels in free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwatch import config as C


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_clauses(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), C.CLAUSE_BREAK)


def mentions(lowered: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, as plain substrings."""
    hit = lowered.contains(words[0])
    for word in words[1:]:
        hit = hit | lowered.contains(word)
    return hit


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null when there is none.

    Null rather than '' matters for speed: casting '' fails, and a failed cast
    per row costs far more than the match itself.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def first_amount(clause: Column) -> Column:
    """First amount in a clause as a positive bigint, else null."""
    digits = F.regexp_replace(first_match(clause, C.AMOUNT), C.AMOUNT_SEPARATORS, "")
    value = digits.try_cast("bigint")
    return F.nullif(value, F.lit(0))


def _amounts(text: Column, is_fee) -> Column:
    """struct(fee, electricity): for each, the first amount of a clause that may carry it.

    Lower-casing first changes no clause, because breaks ignore case, and saves
    doing it for every keyword of every clause.
    """
    nothing = F.lit(None).cast("bigint")

    def read(found, clause):
        power = mentions(clause, C.ELECTRICITY_KEYWORDS)
        amount = first_amount(clause)
        kept = F.struct(
            F.coalesce(found["fee"], F.when(is_fee(clause, power), amount)).alias("fee"),
            F.coalesce(found["electricity"], F.when(power, amount)).alias("electricity"),
        )
        return F.when(mentions(clause, C.EXCLUDE_KEYWORDS), found).otherwise(kept)

    start = F.struct(nothing.alias("fee"), nothing.alias("electricity"))
    return F.aggregate(split_clauses(F.lower(text)), start, read)


def amounts_in_cost_field(text: Column) -> Column:
    """The field is about monthly costs, so any amount that is not electricity is the fee."""
    return _amounts(text, lambda low, power: ~power)


def amounts_in_description(text: Column) -> Column:
    """In prose a number counts as a fee only next to a fee keyword."""
    return _amounts(text, lambda low, power: mentions(low, C.FEE_KEYWORDS))


def clean_integer(text: Column) -> Column:
    """The whole text as a bigint (sign and single underscores between digits allowed), else null."""
    stripped = trim_space(F.coalesce(text, F.lit("")))
    plain = F.when(stripped.rlike(r"^[+-]?\d+(?:_\d+)*$"), F.regexp_replace(stripped, "_", ""))
    return plain.try_cast("bigint")


def decimal_text(text: Column) -> Column:
    """'54,5' or '54.5' as a double; no text gives null."""
    return F.translate(text, ",", ".").try_cast("double")


def title_area(title: Column, pattern: str = C.TITLE_AREA) -> Column:
    return decimal_text(first_match(title, pattern))


def digits_only(text: Column) -> Column:
    return non_empty(F.regexp_replace(text, r"[^\d]", "")).try_cast("bigint")


def truncate(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def join_parts(*parts: Column) -> Column:
    """Comma-joined non-empty parts; '' when there is none."""
    return F.concat_ws(", ", *[non_empty(p) for p in parts])


def url_quote(text: Column) -> Column:
    """Percent-encode for a URL path segment (form encoding differs in four characters)."""
    quoted = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted


def listing_id_from_url(url: Column) -> Column:
    """Numeric id at the end of a listing URL, else null."""
    return first_match(trim_space(url), C.URL_ID)


def last_path_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def tx_title(tx: Column) -> Column:
    return F.when(tx == C.RENT, C.RENT_TITLE).otherwise(C.SALE_TITLE)


def money(value: Column, group: str = " ") -> Column:
    """'12 345 Kč', or a dash for null."""
    grouped = F.replace(F.format_number(value, 0), F.lit(","), F.lit(group))
    return F.when(value.isNull(), "—").otherwise(F.concat(grouped, F.lit(" Kč")))


def label(code: Column, labels: dict) -> Column:
    """Code to label through a literal map; an unknown code gives null."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)
