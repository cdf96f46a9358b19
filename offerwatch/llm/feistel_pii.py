"""Personal data replaced by pseudonyms of the same format.

Numbers and dates that pass their check are moved within their own format by a
keyed Feistel permutation: a card number becomes another valid card number, a
date another date in the same notation. The permutation depends on the key and
the value alone, so equal values become equal pseudonyms in every document and
different ones stay different, without any table of them.

All is column expressions: texts are split at the finds, and finds and pieces
are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwatch.llm.common import fresh

ROUNDS = 12

# What is looked for, in this order. All but email and secret are numbers or dates.
# A pattern is tried at every character, so none may read on over a long word and then give up: the part of a
# mail before the sign begins where its characters begin, is not given back and has 64 characters at most, as
# mail standards have it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "date": r"(?<![\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{N}/-])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{N}]|\.\p{N})",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\p{N})|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\p{N})",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
}
TOKEN = "|".join(PATTERNS.values())
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6)"
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}\.": "dd.MM.yyyy", r"^\d{2}/": "dd/MM/yyyy"}
#: Dates are permuted among the 400 years from this day on, which are 189 * 773 days.
FIRST_DAY, CYCLE = "1700-01-01", (189, 773)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def once(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(parts: Column, moduli: Column, tag: Column | str, key: str, back: bool = False) -> Column:
    """A permutation of lists of numbers below `moduli`: in each round one part moves by a keyed hash of all others.

    `tag` keeps formats apart. `back` undoes it.
    """
    tag = F.lit(tag) if isinstance(tag, str) else tag
    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def step(state: Column, number: Column) -> Column:
        turn = number % F.size(state)
        others = F.array_join(F.transform(state, lambda x, i: F.when(i == turn, F.lit("*")).otherwise(x.cast("string"))), ",")
        noise = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, number.cast("string"), others), 256), 1, 15), 16, 10).cast("bigint")

        def moved(x: Column, i: Column) -> Column:
            modulus = F.element_at(moduli, i + 1)
            shift = noise % modulus
            return F.when(i == turn, F.pmod(x - shift if back else x + shift, modulus)).otherwise(x)

        return F.transform(state, moved)

    return F.aggregate(rounds, parts, step)


def code(value: Column, base: int, tag: str, key: str, back: bool = False) -> Column:
    """Permutation of a text of digits of `base`, within its length."""

    def of(width: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.ceil(F.length(value) / width).cast("int") - 1)
        chunks = F.transform(cuts, lambda i: F.substring(value, i * width + 1, width))
        return once(
            chunks,
            lambda c: F.array_join(
                F.zip_with(
                    permuted(
                        F.transform(c, lambda x: F.conv(x, base, 10).cast("bigint")),
                        F.transform(c, lambda x: F.round(F.pow(F.lit(float(base)), F.length(x))).cast("bigint")),
                        F.concat(F.lit(tag), F.length(value).cast("string")),
                        key,
                        back,
                    ),
                    c,
                    lambda n, x: F.lpad(F.lower(F.conv(n.cast("string"), 10, base)), F.length(x), "0"),
                ),
                "",
            ),
        )

    width = F.least(F.lit(9), F.greatest(F.lit(1), F.ceil(F.length(value) / 2).cast("int")))
    return F.when(F.length(value) == 0, value).otherwise(once(width, of))


def only(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, f"[^{pattern}]", "")


def filled(shape: Column, digits: Column, letters: Column | None = None, accented: Column | None = None) -> Column:
    """`shape` with its digits, and letters of each kind, replaced in order; capitals stay capitals."""
    empty = F.lit("")
    start = F.struct(empty.alias("out"), digits.alias("d"), (letters if letters is not None else empty).alias("l"), (accented if accented is not None else empty).alias("a"))

    def step(state: Column, char: Column) -> Column:
        small = F.lower(char)
        is_digit = char.rlike("^[0-9]$")
        is_letter = small.rlike("^[a-z]$") if letters is not None else F.lit(False)
        is_accented = small.rlike(f"^[{ACCENTED}]$") if accented is not None else F.lit(False)
        new = (
            F.when(is_digit, F.substring(state["d"], 1, 1)).when(is_letter, F.substring(state["l"], 1, 1))
            .when(is_accented, F.substring(state["a"], 1, 1)).otherwise(char)
        )
        cased = F.when(char == small, new).when(F.length(F.upper(new)) == 1, F.upper(new)).otherwise(new)
        rest = lambda used: F.when(used, F.lit(2)).otherwise(F.lit(1))
        return F.struct(
            F.concat(state["out"], cased).alias("out"),
            F.substring(state["d"], rest(is_digit), F.length(state["d"])).alias("d"),
            F.substring(state["l"], rest(is_letter), F.length(state["l"])).alias("l"),
            F.substring(state["a"], rest(is_accented), F.length(state["a"])).alias("a"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """Sum of Luhn's rule: a number is valid if it is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: once(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def as_date(find: Column) -> Column:
    parsed = F.lit(None).cast("date")
    for pattern, form in DATE_FORMATS.items():
        # parsed and printed again, so that the 31st of a short month is no date
        day = F.to_date(F.try_to_timestamp(find, F.lit(form)))
        parsed = F.when(find.rlike(pattern) & (F.date_format(day, form) == find), day).otherwise(parsed)
    return F.when(F.year(parsed).between(1700, 2099), parsed)


def kind(find: Column) -> Column:
    """Which of PATTERNS a find is, null if it fails the check of its kind."""
    digits = only(find, "0-9")
    checks = {
        "date": as_date(find).isNotNull(),
        "ssn": ~find.rlike("^(?:000|666|9)|-00-|-0000$"),
        "card": (luhn(digits) % 10 == 0) & digits.rlike(CARD_ISSUERS) & F.length(digits).between(13, 19),
        "secret": find.rlike("[0-9]") & find.rlike("[A-Fa-f]"),
    }
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(find.rlike(f"^(?:{pattern})$"), F.when(checks.get(name, F.lit(True)), F.lit(name))).otherwise(out)
    return out


def pseudonym(find: Column, kind_: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a find of a kind; `back` gives the find of a pseudonym."""
    digits = only(find, "0-9")
    number = lambda value, tag: code(value, 10, tag, key, back)

    def card() -> Column:
        """All but the issuer and the check digit is permuted, and the check digit follows."""
        head, body = F.substring(digits, 1, 2), F.substring(digits, F.lit(3), F.length(digits) - 3)
        return filled(find, once(F.concat(head, number(body, "card")), lambda n: F.concat(n, ((10 - luhn(F.concat(n, F.lit("0"))) % 10) % 10).cast("string"))))

    def phone() -> Column:
        """What follows the country code."""
        lead = F.regexp_extract(find, r"^\+\d{1,3}", 0)
        rest = F.substring(find, F.length(lead) + 1, F.length(find))
        return F.concat(lead, filled(rest, number(only(rest, "0-9"), "phone")))

    def ip() -> Column:
        octet = lambda i: F.element_at(F.split(find, r"\."), i).cast("bigint")
        halves = F.array(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4))
        moved = permuted(halves, F.array(F.lit(65536), F.lit(65536)), "ip", key, back)
        return F.array_join(F.flatten(F.transform(moved, lambda x: F.array(F.floor(x / 256).cast("string"), (x % 256).cast("string")))), ".")

    def ssn() -> Column:
        """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        part = lambda i: F.element_at(F.split(find, "-"), i).cast("bigint")
        start = F.array(part(1) - F.when(part(1) > 666, 2).otherwise(1), part(2) - 1, part(3) - 1)
        moved = permuted(start, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, back)
        return once(moved, lambda m: F.concat_ws(
            "-",
            F.lpad((m[0] + F.when(m[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((m[1] + 1).cast("string"), 2, "0"),
            F.lpad((m[2] + 1).cast("string"), 4, "0"),
        ))

    def date() -> Column:
        days = F.date_diff(as_date(find), F.lit(FIRST_DAY).cast("date")).cast("bigint")
        moved = permuted(F.array(F.floor(days / CYCLE[1]), days % CYCLE[1]), F.array(*[F.lit(c) for c in CYCLE]), "date", key, back)
        day = once(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), (m[0] * CYCLE[1] + m[1]).cast("int")))
        out = F.date_format(day, "yyyy-MM-dd")
        for pattern, form in DATE_FORMATS.items():
            out = F.when(find.rlike(pattern), F.date_format(day, form)).otherwise(out)
        return out

    def email() -> Column:
        """Digits and letters of the part before the sign; the host stays."""
        local = F.substring_index(find, "@", 1)
        small = F.lower(local)
        letters = F.translate(code(F.translate(only(small, "a-z"), LETTERS, DIGITS[:26]), 26, "letters", key, back), DIGITS[:26], LETTERS)
        accents = F.translate(code(F.translate(only(small, ACCENTED), ACCENTED, DIGITS[: len(ACCENTED)]), len(ACCENTED), "accented", key, back), DIGITS[: len(ACCENTED)], ACCENTED)
        return F.concat(filled(local, number(only(local, "0-9"), "local"), letters, accents), F.lit("@"), F.substring_index(find, "@", -1))

    def secret() -> Column:
        moved = code(F.lower(find), 16, "secret", key, back)
        return F.when(find == F.lower(find), moved).otherwise(F.upper(moved))

    out = find
    for name, use in (("email", email), ("secret", secret), ("date", date), ("ip", ip), ("phone", phone), ("ssn", ssn), ("card", card)):
        out = F.when(kind_ == name, use()).otherwise(out)
    return out


def rewritten(df: DataFrame, text_col: str, key: str, kinds: str | None = None) -> DataFrame:
    """`df` with pseudonyms in `text_col`, and where `kinds` names one, a column with the finds and the kinds of those that passed.

    Null texts stay null and texts without finds as they are; every row gives
    one row, repeated or not, an empty table none; all columns of `df` stay,
    whatever their names.
    """
    pieces, finds, known = fresh(df, "_pieces", "_finds", "_known")
    text = F.col(text_col)
    has = F.coalesce(text.rlike(r"[0-9@]"), F.lit(False))
    cut = df.select(
        "*",
        F.when(has, F.split(text, TOKEN, -1)).alias(pieces),
        F.when(has, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias(finds),
    )
    rows = cut.withColumn(known, F.transform(finds, lambda f: F.struct(f.alias("find"), kind(f).alias("kind"))))
    names = F.transform(known, lambda k: F.when(k["kind"].isNull(), k["find"]).otherwise(pseudonym(k["find"], k["kind"], key)))
    rest = F.slice(pieces, 2, F.greatest(F.size(finds), F.lit(1)))
    joined = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(names, rest, lambda a, b: F.concat(a, b)), ""))
    new = F.when(F.size(finds) > 0, joined).otherwise(text).alias(text_col)
    return rows.select(*[new if c == text_col else F.col(f"`{c}`") for c in df.columns], *([F.col(known).alias(kinds)] if kinds else []))


def pseudonymise(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """id_col, text_col with pseudonyms, and n_<kind> for each kind of finds.

    One row per row of `df`, repeated or not, with a null id too; null stays
    null, texts without finds stay as they are, and so do numbers that fail
    their check; an empty table gives no rows. The key decides the pseudonyms
    and must be kept secret; whoever has it can undo them. Other columns are not
    read. One pass over whole texts, no shuffle.
    """
    narrow = df.select(id_col, text_col)
    (kinds,) = fresh(narrow, "_kinds")

    def found(name: str) -> Column:
        return F.when(F.col(kinds).isNull(), F.lit(0)).otherwise(F.size(F.filter(kinds, lambda k: k["kind"] == name)))

    known = rewritten(narrow, text_col, key, kinds)
    return known.select(id_col, text_col, *[found(name).alias(f"n_{name}") for name in PATTERNS])
