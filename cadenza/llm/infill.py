"""Fill-in-the-middle transformation of whole texts, with DataFrame functions only.

A text is a row of units (matches of a pattern, one after another). Two cut requests name places by unit; relations
turn them into places by character: matches are exploded with their ordinals, a window sums unit lengths, requests
join the running sums by ordinal, and each document's offsets are aggregated before its text is cut.

Only units next to a cut stand alone: elsewhere runs of up to RUNS[0] units count as one, so a text of n units gives
about n / 512 + 100 rows and not n. These rows go by a key made from id and text, so they are the same whenever a
task runs again, and equal rows are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Units in a run, from coarse to fine; a run without a cut is one row.
RUNS = (512, 32)
#: Bits of a piece's length; its ordinal stands above them.
LENGTH = 31
#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point.
CODE_POINT = "(?s:.)"


def pattern(unit: str, most: int) -> str:
    """What matches a unit, or a run of up to `most` units; what the unit's pattern leaves is cut by code points."""
    one = unit if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"
    return one if most == 1 else f"(?:{one}){{1,{most}}}+"


def matches(text: Column, unit: str, most: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(unit, most)), F.lit(0))


def piece(ordinal: Column, length: Column) -> Column:
    return F.shiftleft(ordinal, LENGTH).bitwiseOR(length.cast("long"))


def pieces(text: Column, first: Column, cuts: list[Column], unit: str, sizes: tuple[int, ...] = RUNS) -> Column:
    """The units of a text, of which the first has the ordinal `first`, as numbers of ordinal and length; the units of a
    run without a cut stand together."""
    if not sizes:
        return F.transform(matches(text, unit), lambda u, i: piece(first + i, F.char_length(u)))
    size = sizes[0]

    def run(part: Column, i: Column) -> Column:
        start = first + i * size
        cut = cuts[0].between(start, start + size - 1) | cuts[1].between(start, start + size - 1)
        return F.when(cut, pieces(part, start, cuts, unit, sizes[1:])).otherwise(F.array(piece(start, F.char_length(part))))

    return F.flatten(F.transform(matches(text, unit, size), run))


def digest_numbers(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit groups of the sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marked(text: Column) -> Column:
    """Whether a text holds a marker, so that a transformed text couldn't be told apart."""
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text; the key's 128 bits stand for (doc_id, text), and rows of one key have one result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256)
    return rows.withColumn("key", F.unhex(F.substring(digest, 1, 32)))


def planned(rows: DataFrame, unit: str, seed: int, plain: int, spm: int) -> DataFrame:
    """A row for each key: n units, form, low and high cut by unit (null if plain), and the pieces around them."""
    runs = rows.withColumn("runs", matches(F.col("text"), unit, RUNS[0]))
    full = F.greatest(F.size("runs") - 1, F.lit(0))
    last = F.coalesce(F.size(matches(F.try_element_at("runs", F.lit(-1)), unit)), F.lit(0))
    counted = runs.withColumn("n", (full * RUNS[0] + F.greatest(last, F.lit(0))).cast("long"))
    h = digest_numbers(F.col("doc_id"), seed)
    is_plain = (F.col("n") == 0) | marked(F.col("text")) | (h[2] % 100 >= 100 - plain)
    formed = counted.withColumn("form", F.when(is_plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"))
    at = [F.when(F.col("form") != "plain", h[k] % (F.col("n") + 1)) for k in range(2)]
    cut = formed.select("key", "text", "n", "form", F.least(*at).alias("low"), F.greatest(*at).alias("high"))
    end = F.array(piece(F.col("n"), F.lit(0)))
    parts = F.when(F.col("form") != "plain", F.concat(pieces(F.col("text"), F.lit(0).cast("long"), [F.col("low"), F.col("high")], unit), end))
    return cut.select("key", F.struct("n", "form", "low", "high", parts.alias("pieces")).alias("plan")).groupBy("key").agg(F.any_value("plan").alias("plan")).select("key", "plan.*")


def offsets(plans: DataFrame) -> DataFrame:
    """key, low_chars, high_chars: where the two cuts of a text lie, in characters."""
    dealt = plans.where("form <> 'plain'").repartition("key")
    units = dealt.select("key", F.posexplode("pieces").alias("at", "unit")).select("key", F.shiftright("unit", LENGTH).alias("ordinal"), F.col("unit").bitwiseAND((1 << LENGTH) - 1).alias("length"))
    before = Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    asked = dealt.select("key", F.explode(F.array(F.struct(F.lit("low").alias("which"), F.col("low").alias("wanted")), F.struct(F.lit("high").alias("which"), F.col("high").alias("wanted")))).alias("request")).select("key", "request.*")
    # written as a difference, the ordinals stay out of the shuffle: both sides are dealt by key already, two requests each
    met = placed.join(asked.hint("merge"), (placed["key"] == asked["key"]) & (F.col("ordinal") - F.col("wanted") == 0)).select(placed["key"], "which", "start")
    return met.groupBy("key").agg(F.max(F.when(F.col("which") == "low", F.col("start"))).alias("low_chars"), F.max(F.when(F.col("which") == "high", F.col("start"))).alias("high_chars"))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the transformed one and its form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = CODE_POINT, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    `unit` is a pattern of a unit that isn't empty. Cuts and forms follow a digest of seed and doc_id: `plain` of 100
    texts stay as they are, `spm` of 100 others have the suffix first, the rest the prefix. Texts without units or with
    a marker are plain, with null for prefix_chars and middle_chars. Null text: an empty one. A null doc_id is digested
    as an empty string; repeated rows have equal results, one each. Texts are used whole, however long. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    plans = Scratch(docs.sparkSession, "infill").table(planned(rows, unit, seed, plain, spm), "plans")
    heads = plans.select("key", "n", "form").join(offsets(plans), "key", "left")
    text, low, high = F.col("text"), F.col("low_chars"), F.col("high_chars")
    prefix, middle, suffix = F.substring(text, F.lit(1), low.cast("int")), F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), F.substring(text, (high + 1).cast("int"), F.lit((1 << 31) - 1))
    psm, spm_text = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_text).otherwise(text)
    return rows.join(heads, "key").select("doc_id", "n", "form", low.alias("prefix_chars"), (high - low).alias("middle_chars"), output.alias("output"))
