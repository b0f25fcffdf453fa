"""Per-row text jobs: numbers claimed in a text, what it asks for, columns it names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescry.functions.names import columns_of

SMALL_WHOLE_NUMBER = 12

# A digit run directly after a letter belongs to a name (PM2.5, Q1), so the
# letter is captured with it and such captures are dropped.
NUMBER_WITH_LEAD = r"(\p{L}?-?[0-9][0-9,]*\.?[0-9]*)"

# Intents in the order they are tested, with their key words. A
# trailing * marks a stem.
INTENTS = (
    ("overview", ("summar*", "overview", "what is this", "what am i looking at", "most important", "what matters",
                  "explain this data*", "tell me about this data*", "what does this data* ")),
    ("outliers", ("unusual", "anomal*", "outlier*", "strange", "odd", "weird", "unexpected", "spike*", "surpris*")),
    ("relationship", ("relationship", "related", "correlat*", "linked", "link between", "affect*", "influenc*", "impact*",
                      "depend*", "driven by", "connection")),
    ("trend", ("trend*", "over time", "growing", "grow", "declin*", "increas*", "decreas*", "rising", "falling", "fell",
               "dropped", "changed over", "trajectory", "momentum")),
    ("rank", ("top", "highest", "best", "most", "largest", "biggest", "leading", "leader", "rank*", "worst", "lowest",
              "smallest", "bottom", "fastest growing", "which category", "which region", "compare")),
    ("aggregate", ("average", "mean", "total", "sum", "how much", "median", "maximum", "minimum")),
    ("count", ("how many rows", "row count", "how many records", "how big")),
    ("describe", ("describe", "tell me about", "what is in", "range of", "distribution", "spread of", "what values")),
)


def six_digits(v: Column) -> Column:
    """A number rounded to six significant digits, halves to even."""
    exponent = F.floor(F.log10(F.abs(v))).cast("int")
    up = F.pow(F.lit(10.0), F.greatest(F.lit(5) - exponent, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(exponent - F.lit(5), F.lit(0)))
    return F.when((v == 0) | (F.abs(v) > 1e300) | (F.abs(v) < 1e-300), v).otherwise(F.rint(v / down * up) / up * down)


def numbers_in(text: Column) -> Column:
    """Array of the distinct numbers a text states, to six significant digits."""
    found = F.filter(F.regexp_extract_all(text, F.lit(NUMBER_WITH_LEAD), F.lit(1)), lambda t: ~t.rlike(r"^\p{L}"))
    plain = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, ",", ""), r"\.$", "").try_cast("double"))
    return F.array_distinct(F.filter(F.transform(plain, six_digits), lambda v: v.isNotNull()))


def number_tokens(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, number): one row per distinct number stated in each text."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.explode(numbers_in(F.col(f"`{text}`"))).alias("number"))


def grounding_audit(texts: DataFrame, text: str, keys: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Per text: how many numbers it states and how many of them are unsupported.

    ``allowed`` holds the supported numbers in a column ``number``. A number
    passes by its size without the sign, and whole numbers from 0 to 12 always
    pass. Each row is judged apart, whatever its keys.
    """
    supported = (
        allowed.select(F.abs(six_digits(F.col("number").cast("double"))).alias("size")).where("size is not null").distinct().withColumn("_met", F.lit(True))
    )
    told = texts.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns_of(keys)).alias("_keys"), numbers_in(F.col(f"`{text}`")).alias("_numbers"))
    rows = told.select("_row", "_keys", F.explode_outer("_numbers").alias("number"))
    small = (F.col("number") == F.floor("number")) & F.col("number").between(0, SMALL_WHOLE_NUMBER)
    met = rows.withColumn("size", F.abs("number")).join(supported, "size", "left")
    judged = met.groupBy("_row").agg(
        F.any_value("_keys").alias("_keys"), F.count("number").cast("int").alias("n_numbers"),
        F.count_if(F.col("number").isNotNull() & ~small & F.col("_met").isNull()).alias("n_unsupported"),
    )
    return judged.select(
        *[F.col("_keys").getField(k).alias(k) for k in keys], "n_numbers", "n_unsupported", (F.col("n_unsupported") == 0).alias("grounded"),
    )


def keyword_pattern(words: Sequence[str]) -> str:
    """Word-bounded alternatives; a stem keeps only its opening bound."""
    parts = [re.escape(w[:-1]) if w.endswith("*") else re.escape(w) + r"\b" for w in words]
    return r"(?U)\b(?:" + "|".join(parts) + ")"


def intent_of(text: Column) -> Column:
    lowered = F.lower(text)
    tagged = F.lit(None).cast("string")
    for name, words in reversed(INTENTS):
        tagged = F.when(lowered.rlike(keyword_pattern(words)), name).otherwise(tagged)
    return tagged


def tag_intent(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """The first intent whose key words occur in each text, or null."""
    return df.select(*[F.col(f"`{k}`") for k in keys], intent_of(F.col(f"`{text}`")).alias("intent"))


def mentioned_columns(df: DataFrame, text: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Which of a table's column names each text mentions, longest name first."""
    lowered = F.lower(F.col(f"`{text}`"))
    hits = []
    for name in sorted(names, key=len, reverse=True):
        spelled = {name.lower(), name.lower().replace("_", " ")}
        pattern = r"(?U)\b(?:" + "|".join(re.escape(s) for s in sorted(spelled)) + r")\b"
        hits.append(F.when(lowered.rlike(pattern), F.lit(name)))
    return df.select(*[F.col(f"`{k}`") for k in keys], F.array_compact(F.array(*hits)).alias("mentioned"))
