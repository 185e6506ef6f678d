"""Scalar functions on columns. All are built from Spark functions unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits, underscores, with - and : inside.
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-:]*[\p{L}\p{N}_])?"
#: Words of letters and digits.
WORD = r"[\p{L}\p{N}]+"
MISSING = ("", "nan", "none", "[]", "{}")


def nonnegative(value: Column) -> Column:
    """As a double; null if it is no finite number of 0 or more."""
    x = value.try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")), x)


def lossless_text(value: Column) -> Column:
    """Whole numbers without a fraction, others in their shortest form; null stays null."""
    x = value.cast("double")
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def labelled_lines(**values: Column) -> Column:
    """`Label: value` lines in the given order, without those that are null."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.replace('_', ' ')}: "), v.cast("string")) for k, v in values.items()])


def size_class(value: Column) -> Column:
    """tiny, small, medium, large to 10, 100, 1000, 10000; xlarge beyond and for NaN; unknown for null or no number."""
    x = value.try_cast("double")
    return (
        F.when(x.isNull(), "unknown").when(F.isnan(x), "xlarge").when(x <= 10, "tiny").when(x <= 100, "small")
        .when(x <= 1000, "medium").when(x <= 10000, "large").otherwise("xlarge")
    )


def tenth(value: Column) -> Column:
    """The one of ten equal bins of [0, 1] that holds a value."""
    return F.least(F.floor(value * 10), F.lit(9)).cast("int")


def token_set(value: Column) -> Column:
    """Distinct parts of a text delimited by commas or bars, without empty ones and `unknown`; null gives an empty set."""
    parts = F.split(F.coalesce(value, F.lit("")), "[,|]")
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "unknown")))


def terms(text: Column) -> Column:
    """Lower-cased retrieval terms in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """A vector over its length in double precision; raises on a length that is 0 or not finite."""
    good = lambda n: (n > 0) & (n < float("inf")) & ~F.isnan(n)
    bad = F.raise_error(F.lit("vector without a finite positive norm")).cast("double")
    # a lambda's argument is worked out once, not for each component
    length = F.transform(F.array(norm(a)), lambda n: F.when(good(n), n).otherwise(bad))
    scaled = F.element_at(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)
    return F.when(F.size(a) > 0, scaled).otherwise(a.cast("array<double>"))


def unit32(a: Column) -> Column:
    """A vector over its length, both rounded to single precision after each step; raises like unit()."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0).cast("float"), lambda s, x: (s + x.cast("float") * x.cast("float")).cast("float"))).cast("float")
    good = (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return F.transform(a, lambda x: (x.cast("float") / F.when(good, n).otherwise(F.raise_error(F.lit("vector without a finite positive norm")).cast("float"))).cast("float"))


def kernel01(similarity: Column) -> Column:
    """A cosine as a similarity in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + similarity) / 2))


def jaccard(a: Column, b: Column, both_empty: float = 0.0, one_empty: float = 0.0) -> Column:
    """Intersection over union of two sets; what empty sets give is the caller's rule."""
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, F.lit(both_empty)).when(empty == 1, F.lit(one_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def node_type(node: Column) -> Column:
    """What stands before `::`; raises where there is none."""
    return F.when(node.contains("::"), F.split_part(node, F.lit("::"), F.lit(1))).otherwise(F.raise_error(F.lit("node without a type")).cast("string"))


def lexical_overlap(query: Column, value: Column) -> Column:
    """Share of a value's distinct words that the query has; null if it has none."""
    own = F.array_distinct(words(value))
    return F.try_divide(F.size(F.array_intersect(own, words(query))).cast("double"), F.size(own))


def overlap_class(share: Column) -> Column:
    return F.when(share < 1 / 3, "Low").when(share < 2 / 3, "Medium").otherwise("High")


def missing(value: Column) -> Column:
    """Null or a text that stands for nothing."""
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(*MISSING)
