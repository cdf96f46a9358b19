"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. For each of `samples`
draws, every word gets numbers that depend on the word and the draw alone: two
gamma variables and a uniform one. They decide at which of a fixed ladder of
weights the word stands and how early it comes; the draw is the earliest word
with its step on the ladder. Two documents draw the same with a chance equal to
their generalised Jaccard similarity, sum of minima over sum of maxima, so the
share of equal draws estimates it.

All is column expressions. Words are counted inside the row; only the draws,
folded per document in the task, go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerwatch.llm.common import save
from offerwatch.llm.feistel_pii import once

SAMPLES = 16
#: Runs of neighbouring ids that a task takes at once, and how many quantiles of the ids they are laid out by.
RUN = 1000
QUANTILES = 64


def terms(text: Column) -> Column:
    """Lower-cased words, as hashes, with how often each stands: array of (term, weight). A text without words is one empty word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def counted(h: Column) -> Column:
        """Lengths of the runs of a sorted list, from where one value ends to where the next does."""
        ends = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.get(h, i - 1) != F.get(h, i)))
        return once(ends, lambda e: F.transform(e, lambda end, j: F.struct(F.get(h, end - 1).alias("term"), (end - F.coalesce(F.get(e, j - 1), F.lit(0))).alias("weight"))))

    nothing = F.array(F.struct(F.xxhash64(F.lit("")).alias("term"), F.lit(1).alias("weight")))
    return once(hashes, lambda h: F.when(F.size(h) > 0, counted(h)).otherwise(nothing))


def share(bits: Column, shift: int, width: int) -> Column:
    """`width` bits of a hash as a number between 0 and 1, ends excluded."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("double") + 0.5) / float(1 << width)


def draw(term: Column, log_weight: Column, number: int) -> tuple[Column, Column]:
    """(when, what) of a word in a draw: the logarithm of its time, and a hash of the word and its step."""
    one, two = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    rate = -F.log(share(one, 0, 32) * share(one, 32, 32))  # gamma(2, 1): two exponential times
    size = F.log(-F.log(share(two, 0, 21) * share(two, 21, 21)))  # logarithm of another
    start = share(two, 42, 22)
    step = F.floor(log_weight / rate + start)
    return size - rate * (step - start + 1), F.xxhash64(term, step)


def signatures(rows: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """keys, signature: the draws of the text of each key."""
    words = rows.select(*keys, F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("_t"))
    words = words.select(*keys, F.col("_t.term").alias("_term"), F.log(F.col("_t.weight").cast("double")).alias("_log"))
    draws = [draw(F.col("_term"), F.col("_log"), k) for k in range(samples)]
    found = words.groupBy(*keys).agg(*[F.min_by(what, when).alias(f"_s{k}") for k, (when, what) in enumerate(draws)])
    return found.select(*keys, F.array(*[F.col(f"_s{k}") for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws of two signatures, the estimated similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(signature: Column) -> Column:
    """Sixteen hexadecimal digits for each draw."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(df: DataFrame, id_col: str, text_col: str, samples: int = SAMPLES) -> DataFrame:
    """id_col, fingerprint of every whole text; null and empty texts share one. Rows that are the same in id and text give one row."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    return signatures(rows, ["id", "key"], "text", samples).select(F.col("id").alias(id_col), as_text(F.col("signature")).alias("fingerprint"))


def run_of(df: DataFrame, id_col: str) -> Column:
    """A number for each run of neighbouring ids of about RUN rows, ascending with the id; null ids come first.

    Runs are cut by quantiles of the ids and evenly between two quantiles.
    """
    number = F.col(id_col).cast("double") if not isinstance(df.schema[id_col].dataType, T.StringType) else F.conv(F.rpad(F.hex(F.substring(id_col, 1, 6)), 12, "0").substr(1, 12), 16, 10).cast("double")
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(number, shares, 10000).alias("q")).first()
    if not found["q"]:
        return F.lit(-1).cast("bigint")
    bounds = sorted(set(found["q"]))
    cuts = max(1, -(-found["n"] // (RUN * QUANTILES)))
    starts = F.array(*[F.lit(b) for b in bounds])
    widths = F.array(*[F.lit((c - b) or 1.0) for b, c in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)])
    place = F.greatest(F.size(F.filter(starts, lambda b: b <= number)), F.lit(1))

    def run(i: Column) -> Column:
        within = F.floor((number - F.get(starts, i - 1)) / F.get(widths, i - 1) * cuts)
        return (i - 1) * cuts + F.least(F.greatest(within, F.lit(0)), F.lit(cuts - 1))

    return F.when(number.isNull(), F.lit(-1)).otherwise(once(place, run)).cast("bigint")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text of every row with next_id, next_key and next_text of the row after it by descending id; the first follows the last.

    Rows meet their neighbours in runs of ids, so texts are shuffled once; the
    last row of a run takes the first of the next run, and there is one of
    these for each run. Equal ids are ordered by a hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), run_of(df, id_col).alias("run"), text.alias("text"))
    order = Window.partitionBy("run").orderBy(F.desc_nulls_last("id"), F.desc("key"))
    lined = rows.select(
        "*",
        F.row_number().over(order).alias("place"),
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("id", "key", "text")],
        F.lead(F.lit(True)).over(order).alias("followed"),
    )
    heads = lined.where("place = 1").select(F.col("run").alias("after"), F.struct("id", "key", "text").alias("head"))
    along = Window.orderBy(F.desc("run"))
    all_ = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select(
        "run", F.coalesce(F.lead("run").over(along), F.max("run").over(Window.partitionBy())).alias("after")
    )
    following = all_.join(heads, "after").select("run", "head")
    joined = lined.join(following, "run")
    last = F.col("followed").isNull()
    return joined.select(
        "run", "place", "id", "key", "text", *[F.when(last, F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in ("id", "key", "text")]
    )


def edited_against_next(df: DataFrame, id_col: str, text_col: str, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, and of the text with its second half replaced by the next document's beginning.

    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. One row per row of `df`. Null is an empty text; a table of one
    row is its own next; an empty table has no rows. Other columns are not read.
    """
    rows = with_next(df, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = rows.select("run", "place", "id", "key", "next_id", "next_key", "text", edited.alias("edited"))
    keys = ["run", "place", "id", "key", "next_id", "next_key", "n_chars", "sha", "side"]
    sides = pairs.select(
        *keys[:6],
        F.length("text").cast("bigint").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("_"),
    ).select(*keys[:8], "_.side", "_.t")
    found = save(signatures(sides, keys, "t", samples), "signatures")  # small, and read twice
    both = found.groupBy(*keys[:8]).agg(
        F.first(F.when(F.col("side") == 0, F.col("signature")), ignorenulls=True).alias("own"),
        F.first(F.when(F.col("side") == 1, F.col("signature")), ignorenulls=True).alias("changed"),
    )
    others = found.where("side = 0").groupBy(F.col("id").alias("oid"), F.col("key").alias("okey")).agg(F.first("signature").alias("other"))
    joined = both.join(others, F.col("next_id").eqNullSafe(F.col("oid")) & (F.col("next_key") == F.col("okey")))
    return joined.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("other")).alias("near_next"),
    )
