"""Substring matches between two tables as an equi-join on selective pieces.

``text LIKE '%phrase%'`` between two tables would compare every pair. Here
each phrase is looked up by one piece of itself, the one that is rarest in the
texts, as told by a table of piece frequencies. The texts list only pieces that
some phrase is looked up by: a filter over the hashes of these pieces, which
grows with the phrases, drops nearly all other pieces before they are shuffled.
The few that pass meet the phrases in a join, and those candidates are
compared in full. Neither frequencies nor filter decide what matches, only how
many candidates there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import cut, spread

#: A phrase is looked up by pieces of the longest of these lengths that it has room for.
PIECE_LENGTHS = (1, 2, 3, 4, 6)
#: One text in so many is counted for the frequencies of pieces.
COUNTED = 16
#: Bits of a filter for each key, and its least and most bits (16 MB); with more keys than that more others pass.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 27


def _pieces(text: Column, length: int) -> Column:
    """Every run of ``length`` characters; a look-ahead lets the runs overlap."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _all_pieces(text: Column, lengths: list[int]) -> Column:
    return _pieces(text, lengths[0]) if len(lengths) == 1 else F.concat(*[_pieces(text, n) for n in lengths])


def _by_length(found: dict[int, Column], n: Column, kind: str) -> Column:
    return reduce(lambda out, item: F.when(n == item[0], item[1]).otherwise(out), found.items(), F.lit(None).cast(kind))


def rarest_pieces(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, shortest: int = 1) -> DataFrame:
    """``_looked, _n, _piece``: each distinct phrase, its piece that is rarest in the texts, and that piece's length.

    Frequencies are counted in a share of the texts that is drawn by their
    hash, and only for pieces that phrases have. Phrases shorter than
    ``shortest`` are left out.
    """
    lengths = sorted({n for n in PIECE_LENGTHS if n >= shortest} | {shortest})
    listed = phrases.select(F.col(phrase).alias("_looked")).filter(F.length("_looked") >= shortest).distinct()
    longest = reduce(lambda out, n: F.when(F.length("_looked") >= n, n).otherwise(out), lengths, F.lit(None).cast("int"))
    own = _by_length({n: _pieces(F.col("_looked"), n) for n in lengths}, F.col("_n"), "array<string>")
    parts = listed.withColumn("_n", longest).select("_looked", "_n", F.explode(F.array_distinct(own)).alias("_piece"))
    sample = texts.filter(F.pmod(F.xxhash64(text), F.lit(COUNTED)) == 0)
    # a phrase that is shorter than the next length is its only piece, so there is nothing to choose
    open_to_choice = [n for n, longer in zip(lengths, [*lengths[1:], None], strict=True) if longer is None or longer > n + 1]
    seen = sample.select(F.explode(_all_pieces(F.col(text), open_to_choice)).alias("_piece"))
    counts = cut(seen.groupBy("_piece").agg(F.count("*").alias("_count")), "counts")
    # most phrases have a piece that the sample lacks, and their other pieces need no count: only the rest is shuffled
    unseen = F.when(~_likely_among(counts, ["_piece"]), F.col("_piece"))
    first = parts.groupBy("_looked", "_n").agg(F.min(unseen).alias("_first"), F.collect_list("_piece").alias("_all"))
    first = cut(first.withColumn("_all", F.when(F.col("_first").isNull(), F.col("_all"))), "first")
    by_count = F.struct(F.coalesce("_count", F.lit(0)), F.col("_piece"))
    left = first.select("_looked", "_n", F.explode("_all").alias("_piece"))
    chosen = left.join(counts, "_piece", "left").groupBy("_looked", "_n").agg(F.min_by("_piece", by_count).alias("_piece"))
    settled = first.filter(F.col("_first").isNotNull()).select("_looked", "_n", F.col("_first").alias("_piece"))
    return cut(settled.unionByName(chosen), "rarest")


def _places(keys: list[str], bits: int) -> list[Column]:
    """The two bits of a row's keys in a filter of ``bits`` bits, a power of two."""
    hashed = F.xxhash64(*keys)
    return [h.bitwiseAND(F.lit(bits - 1).cast("bigint")) for h in (hashed, F.shiftrightunsigned(hashed, 32))]


def _filter(wanted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One row with the bits of all wanted keys, in words of 64, put together from parts of 4096 words."""
    spark = wanted.sparkSession
    place = wanted.select(F.explode(F.array(*_places(keys, bits))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    none = spark.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
    words = place.select(F.shiftright("place", 6).alias("at"), bit.alias("word")).unionByName(none)
    words = words.groupBy("at").agg(F.bit_or("word").alias("word"))

    def in_order(df: DataFrame, at: str, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value])

    parts = words.groupBy(F.shiftright("at", 12).alias("part")).agg(in_order(words, "at", "word").alias("words"))
    return parts.agg(F.flatten(in_order(parts, "part", "words")).alias("words"))


def _likely_among(wanted: DataFrame, keys: list[str]) -> Column:
    """Whether a row's keys are among those of ``wanted``, a written table; it also holds for one in fifty or so of the others."""
    bits = min(max(LEAST_BITS, 1 << (KEY_BITS * wanted.count()).bit_length()), MOST_BITS)
    words = _filter(wanted, keys, bits).scalar()

    def is_set(place: Column) -> Column:
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    return reduce(Column.__and__, map(is_set, _places(keys, bits)))


def likely_in(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys are likely among those of ``wanted``."""
    return df.filter(_likely_among(wanted, keys))


def _listed(texts: DataFrame, text: str, carried: list[Column], chosen: DataFrame) -> DataFrame:
    """One row for each distinct piece of a text that some phrase may be looked up by, as ``_piece``."""
    lengths = sorted(row["_n"] for row in chosen.select("_n").distinct().collect()) or [1]
    pieces = F.array_distinct(_all_pieces(F.col(text), lengths))
    return likely_in(texts.select(*carried, F.explode(pieces).alias("_piece")), chosen, ["_piece"])


def contains_join(
    texts: DataFrame,
    text: str,
    phrases: DataFrame,
    phrase: str,
    shortest: int = 1,
    ids: list[str] | None = None,
) -> DataFrame:
    """All pairs of a text row and a phrase row where the text contains the phrase.

    ``shortest`` states the least phrase length, which spares the shorter
    pieces; shorter phrases do not match, nor do empty ones. Short texts
    travel with their pieces; for longer ones give ``ids``, the columns that
    identify a text row, and only these travel until the candidates, which are
    written, are compared. Both tables are read more than once.
    """
    chosen = rarest_pieces(texts, text, phrases, phrase, shortest)
    keyed = phrases.join(chosen.drop("_n"), phrases[phrase] == chosen["_looked"]).drop("_looked")
    carried = [F.col(c) for c in (texts.columns if ids is None else ids)]
    listed = _listed(spread(texts), text, carried, chosen)
    candidates = listed.join(keyed, "_piece").drop("_piece")
    if ids is not None:
        # texts without a candidate are not shuffled
        candidates = cut(candidates, "candidates")
        candidates = candidates.join(likely_in(texts, candidates, ids), ids)
    return candidates.filter(F.contains(F.col(text), F.col(phrase)))


def piece_load(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, shortest: int = 1) -> DataFrame:
    """One row: ``characters`` of the texts and the ``rows`` that ``contains_join`` makes of their pieces."""
    chosen = rarest_pieces(texts, text, phrases, phrase, shortest)
    made = _listed(texts, text, [], chosen).agg(F.count("*").alias("rows"))
    return texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")).crossJoin(made)
