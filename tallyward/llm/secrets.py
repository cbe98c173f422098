"""Secrets in texts: fixed patterns, and a battery of randomness tests for the rest.

Every run of token characters of ``LEAST`` or more is a candidate; ``=`` ends a
run unless it pads it, so that a value is apart from its name. Its encoding
is inferred from the characters it holds, which gives the alphabet it would be
drawn from if it were a random key; separators do not count unless the run
holds letters of both cases, where they can be symbols. Three tests ask whether it looks drawn that
way: chi-squared of the symbol counts against an even spread, the number of
runs below and above the middle of the alphabet, and the correlation of
neighbours. A candidate that none of them rejects at ``ALPHA`` (a third each)
may be random, but a short word may pass too. So each passing candidate gets
the probability that ordinary text of its length spreads its symbols as
evenly, taking text to use ``EFFECTIVE`` of its letters evenly, and the
candidates of each length class are cut by the step-up rule that holds the
share of false discoveries at ``FDR``. Long candidates have far smaller
probabilities; as each class is cut by itself, they do not carry short ones
with them.

Only built-in functions are used. The cut needs one count per length class and
tenth of a decade, which combines before it is shuffled; the cuts are one
number for each of five classes.

Defined cases: a null text counts as empty and has no spans; a text of any
length is searched whole; repeated rows are searched each by themselves; an
empty table gives an empty result; other columns are dropped unless named in
``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import stored, whole

# The patterns of the known kinds and their least lengths.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of a candidate, and the least number of them.
TOKEN = "[A-Za-z0-9+/_-]"
SEPARATORS = "+/_-="
LEAST = 20
ALPHA = 0.01
FDR = 0.01
#: Upper ends of the length classes; the last class is open.
CLASSES = (28, 40, 64, 128)
#: Share of an alphabet that ordinary text of that alphabet uses evenly.
EFFECTIVE = 0.3
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": LOWER.upper() + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + LOWER.upper(),
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order as ``start, stop, value``; offsets in code points.

    Lengths of the pieces between matches and of the matches add up to the
    offsets. Sums run over blocks, so that a text with very many matches costs
    little more than one pass.
    """
    pieces = F.transform(F.split(text, pattern), lambda x: F.length(x))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inner = values if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(values)), values, lambda gap, v: F.struct(gap.alias("gap"), F.length(v).alias("n"))
    )
    block = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(steps).cast("double"))).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(steps) / block).cast("int") - 1),
        lambda b: F.slice(steps, b * block + 1, block),
    )
    empty = F.array().cast("array<int>")
    bases = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), empty.alias("all")),
        lambda a, x: F.struct(
            (a["at"] + F.aggregate(x, F.lit(0), lambda s, y: s + y["gap"] + y["n"])).alias("at"),
            F.concat(a["all"], F.array(a["at"])).alias("all"),
        ),
    )["all"]
    ends = F.flatten(
        F.zip_with(
            blocks,
            bases,
            lambda x, base: F.aggregate(
                x,
                F.struct(base.alias("at"), empty.alias("all")),
                lambda a, y: F.struct(
                    (a["at"] + y["gap"] + y["n"]).alias("at"),
                    F.concat(a["all"], F.array(a["at"] + y["gap"] + y["n"])).alias("all"),
                ),
            )["all"],
        )
    )
    spans = F.zip_with(
        F.arrays_zip(ends.alias("stop"), values.alias("value")),
        inner,
        lambda s, v: F.struct(
            (s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"), v.alias("value")
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(
        F.array().cast("array<struct<start:int,stop:int,value:string>>")
    )


def known_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed kinds.

    Runs of the access and hex alphabets are taken whole, so asking for the
    least length in the pattern finds the same runs as cutting afterwards.
    """
    return {
        "assign": F.filter(found(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_ASSIGN),
        "access": found(text, f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"),
        "hex": found(text, f"[0-9a-f]{{{LEAST_HEX},}}"),
    }


def candidate() -> str:
    """The pattern of candidates: token characters and padding, ``LEAST`` together.

    A run that is too short without padding may be a little too long for it; its length is looked at afterwards.
    """
    return f"{TOKEN}{{{LEAST},}}=*|{TOKEN}{{{LEAST - 6},{LEAST - 1}}}={{1,6}}"


def bare(token: Column) -> Column:
    """The token without separators and padding."""
    return F.translate(token, SEPARATORS, "")


def encoding(token: Column) -> Column:
    """The smallest alphabet that holds the token; null where no random key is written like that.

    Letters of one case may be grouped by separators, which are no symbols then.
    """
    digit, letter = token.rlike("[0-9]"), token.rlike("[A-Za-z]")
    symbols = bare(token)
    return (
        F.when(symbols.rlike("^[0-9a-f]+$") & digit & letter, "hex")
        .when(symbols.rlike("^[0-9A-F]+$") & digit & letter, "HEX")
        .when(symbols.rlike("^[A-Z2-7]+$") & digit & letter, "base32")
        .when(symbols.rlike("^[0-9a-z]+$") & digit & letter, "base36")
        .when(symbols.rlike("^[0-9A-Z]+$") & digit & letter, "BASE36")
        .when(token.rlike("[a-z]") & token.rlike("[A-Z]"), "base64")
    )


def upper_tail(z: Column) -> Column:
    """Probability above ``z`` under the normal curve; the usual five-term form, good to 1e-7."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds ``p_random`` and ``score`` (minus log10 of the chance for ordinary text) to rows with ``value, code``.

    Symbols are numbered by their place in the alphabet. The sum of squared
    symbol counts comes from how much shorter the token gets without each
    symbol, so a token of any length takes one pass per symbol.
    """
    letters = F.when(F.col("code") == "base64", F.translate("value", "-_=", "+/")).otherwise(bare(F.col("value")))
    alphabet, size = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, symbols in ALPHABETS.items():
        alphabet = F.when(F.col("code") == name, symbols).otherwise(alphabet)
        size = F.when(F.col("code") == name, float(len(symbols))).otherwise(size)
    one = tokens.select(
        "*",
        letters.alias("_t"),
        alphabet.alias("_alphabet"),
        size.alias("_k"),
    )
    places = F.transform(F.filter(F.split("_t", ""), lambda c: c != ""), lambda c: F.call_function("instr", F.col("_alphabet"), c) - 1.0)
    two = one.select(*tokens.columns, "_k", "_alphabet", "_t", places.alias("_x"))
    squares = F.aggregate(
        F.split("_alphabet", ""),
        F.lit(0.0),
        lambda a, c: a
        + F.when(c == "", 0.0).otherwise(
            F.pow((F.length("_t") - F.length(F.call_function("replace", F.col("_t"), c, F.lit("")))).cast("double"), F.lit(2.0))
        ),
    )
    n, k = F.size("_x").cast("double"), F.col("_k")
    middle = (k - 1.0) / 2.0
    high = F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.when(x > middle, 1.0).otherwise(0.0))
    following = F.zip_with(F.slice("_x", 1, F.size("_x") - 1), F.slice("_x", 2, F.size("_x") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    turns = F.aggregate(
        following, F.lit(0.0), lambda a, p: a + F.when((p["x"] > middle) != (p["y"] > middle), 1.0).otherwise(0.0)
    )
    product = F.aggregate(following, F.lit(0.0), lambda a, p: a + (p["x"] - middle) * (p["y"] - middle))
    three = two.select(
        *tokens.columns, n.alias("_n"), "_k", squares.alias("_sq"), high.alias("_high"), turns.alias("_turns"), product.alias("_prod")
    )
    n, k = F.col("_n"), F.col("_k")
    chi = F.col("_sq") * k / n - n
    spread = (chi - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * (n - 1.0) / n)
    # runs given the two counts; all on one side is as far from random as can be
    a, b = F.col("_high"), n - F.col("_high")
    mean = 1.0 + 2.0 * a * b / n
    variance = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
    runs = F.when(variance > 0, (F.col("_turns") + 1.0 - mean) / F.sqrt(variance)).otherwise(9.0)
    # the product of independent neighbours has mean 0 and variance (n - 1) * sigma^4
    serial = F.col("_prod") / (F.sqrt(n - 1.0) * (k * k - 1.0) / 12.0)
    p = F.least(upper_tail(spread), 2.0 * upper_tail(F.abs(runs)), 2.0 * upper_tail(F.abs(serial)))
    # ordinary text: the same statistic if only a part of the alphabet were in use
    used = F.greatest(F.lit(4.0), k * EFFECTIVE)
    ordinary_mean = (k - used) / used * (n - 1.0) + k - 1.0
    ordinary_sd = F.sqrt(2.0 * (k - 1.0) + 4.0 * (k - used) / used * (n - 1.0))
    chance = F.greatest(upper_tail((ordinary_mean - chi) / ordinary_sd), F.lit(1e-300))
    return three.select(*tokens.columns, F.least(F.lit(1.0), 3.0 * p).alias("p_random"), (-F.log10(chance)).alias("score"))


def cuts(tokens: DataFrame) -> DataFrame:
    """``klass, least_score``: the step-up cut of each length class.

    Works on counts per tenth of a decade, rounded so that no false discovery
    is added: a bin is judged by its weakest member. All candidates of a class
    count as tests.
    """
    bins = tokens.groupBy("klass", F.floor(10.0 * F.col("score")).cast("int").alias("bin")).agg(
        F.count("*").alias("tests"), F.sum(F.when(F.col("p_random") >= ALPHA, 1).otherwise(0)).alias("n")
    )
    down = Window.partitionBy("klass").orderBy(F.col("bin").desc())
    ranked = bins.select(
        "klass", "bin", F.sum("n").over(down).alias("found"), F.sum("tests").over(Window.partitionBy("klass")).alias("all")
    )
    holds = F.pow(F.lit(10.0), -F.col("bin") / 10.0) * F.col("all") <= FDR * F.col("found")
    return ranked.filter(holds).groupBy("klass").agg((F.min("bin") / 10.0).alias("least_score"))


def _marked(kind: int):
    # one parameter only: Spark would fill a second one with the index
    return lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"))


def secret_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``found``: all spans as ``start, stop, kind`` by start, then kind as listed.

    Kinds: 0 assign, 1 access, 2 hex, 3 random. One pass over the texts writes
    the spans and the tested candidates, which are few; the cuts are read from
    that table.
    """
    t = whole(text)
    known = known_spans(t)
    parts = [F.transform(spans, _marked(i)) for i, spans in enumerate(known.values())]
    candidates = F.filter(
        found(t, candidate()), lambda x: (F.length(x["value"]) >= LEAST) & encoding(x["value"]).isNotNull()
    )
    rows = stored(
        docs.select(
            *keep, F.monotonically_increasing_id().alias("_row"), F.concat(*parts).alias("_known"), candidates.alias("_tokens")
        ),
        "secrets",
    )
    tokens = rows.select("_row", F.explode("_tokens").alias("x")).select(
        "_row", "x.start", "x.stop", "x.value", encoding(F.col("x.value")).alias("code")
    )
    klass = F.lit(len(CLASSES))
    for i, end in reversed(list(enumerate(CLASSES))):
        klass = F.when(F.length("value") <= end, i).otherwise(klass)
    tested = stored(battery(tokens.withColumn("klass", klass)).drop("value"), "secret-tests")
    limits = {r["klass"]: r["least_score"] for r in cuts(tested).collect()}  # five rows at most
    limit = F.lit(None).cast("double")
    for k, least in limits.items():
        limit = F.when(F.col("klass") == k, least).otherwise(limit)
    random = (
        tested.filter((F.col("p_random") >= ALPHA) & (F.col("score") >= limit))
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "stop", F.lit(3).alias("kind"))).alias("_random"))
    )
    joined = rows.join(random, "_row", "left")
    added = F.coalesce("_random", F.array().cast("array<struct<start:int,stop:int,kind:int>>"))
    order = F.sort_array(
        F.transform(F.concat("_known", added), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    )
    return joined.select(*keep, order.alias("found"))
