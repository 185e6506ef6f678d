"""A corpus pipeline: STAGES take (spark, docs, sf_dir) and return a DataFrame, the next one's docs.

quality drops documents that the classifier rejects; near_duplicates keeps one row (of the smallest id, null
last) of each group, whatever the ids of its rows; repeats cuts out strings of 200 bytes that occur more than once, wherever they stand (whole
characters only, so a document can come out empty but stays); decontamination drops documents that hold
a benchmark item; tokens encodes what is left and decodes it again. All but the last return
the columns of documents, with n_chars of the text as it then is. SQL can't express the first stage.

docs has doc_id and text, and any other columns, whatever their names: the operators get a row as one struct, so no
column of docs takes the place of one of theirs. An empty table gives an empty table. What a stage does with
nulls, empty texts, ties and repeated rows is in its docstring; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagauge.llm.byte_bpe import encode
from datagauge.llm.decontamination import contaminated
from datagauge.llm.frames import stored, table
from datagauge.llm.minhash import near_duplicates
from datagauge.llm.quality import classify
from datagauge.llm.registry import tokenizer
from datagauge.llm.repeats import repeated_spans, without_spans


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the other columns as one struct, beside what operators look at."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame, **made) -> DataFrame:
    """The columns of docs again, with some made anew."""
    return rows.select(*[made.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.3 or more).

    Null and empty texts are scored like others, by statistics that are all 0. Null ids and null labels are never learned from. Repeated
    rows get the same score, and a score of exactly 0.3 is accepted.
    """
    scored = classify(packed(docs), table(spark, sf_dir, "labels"), 0.3)
    return unpacked(scored.where("predicted = 1"), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, a similarity of 0.8.

    Rows are told apart by a 64-bit hash of id and text, so that rows of one id, or of none, are grouped by their texts like
    all others; of a row that occurs again one is kept, by a hash of its other columns. The row of the smallest id stays, a null id
    last; among rows of one id that of the smallest hash. Null, empty and blank texts are near no other.
    """
    key = F.xxhash64("doc_id", "text")
    rows = packed(docs).withColumn("key", key)
    named = rows.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("own"), "text")
    groups = near_duplicates(named, words=5).groupBy(F.col("doc_id").alias("key"), "own", "component_id").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("own").isNull().alias("no_id"), "own", "key", "copies")).alias("first")
    kept = stored(groups.groupBy("component_id").agg(first).select("first.own", "first.key", "first.copies"), "kept")
    left = rows.alias("d").join(kept.alias("k"), (F.col("d.key") == F.col("k.key")) & F.col("d.doc_id").eqNullSafe(F.col("k.own"))).select("d.row", "d.text", "d.key", "k.copies")
    if not kept.where("copies > 1").limit(1).count():
        return unpacked(left, docs)
    again = left.where("copies > 1").groupBy("key").agg(F.min_by(F.struct("row", "text"), F.xxhash64("row")).alias("one")).select("one.*")
    return unpacked(left.where("copies = 1"), docs).unionByName(unpacked(again, docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated strings of 200 bytes.

    Null texts stay null; empty ones and those of fewer than 200 bytes stay as they are. A row that occurs again repeats wholly, so
    both come out empty; null ids are rows of their own. n_chars, if there, follows the text.
    """
    cut = without_spans(repeated_spans(packed(docs), 200), ("kept",))
    made = {"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(cut, docs, text=F.col("kept"), **made)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, and null and empty items are in none. Rows go by their id, null or not, and a hash of the text, so repeated rows go
    or stay together, and other texts of a contaminated id stay.
    """
    name = F.struct("doc_id", F.xxhash64("text").alias("th"))  # ids can be null, or have several texts
    rows = packed(docs)
    found = contaminated(rows.select(name.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), 0.8).select("doc_id.*").distinct()
    both = rows.withColumn("th", F.xxhash64("text")).alias("d")
    gone = found.alias("f")
    return unpacked(both.join(gone, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left_anti"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source (those that docs has), n_tokens, ids, and digests of the ids and of the bytes they decode to.

    Null and empty texts have no ids. Each row is encoded for itself, so repeated rows and null ids stay.
    """
    from public_tokenizers import PATTERN

    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode(docs, tokenizer(spark, "byte_bpe_multi_50k.tiktoken"), PATTERN, output=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=keep)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("repeats", repeats), ("decontamination", decontamination), ("tokens", tokens)]

#: The first stage is a fitted model, which SQL can't express; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
