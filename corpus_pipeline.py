"""A corpus from raw documents to packed sequences: five stages, each of which works on all that the one before it kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
documents for all but the last. run() writes each result as Parquet in the shared folder and rereads it for the next.

Stages judge rows, not ids: rows that share a doc_id, or are repeated, are each judged by their own text. Columns beside
doc_id, text, lang and n_chars are carried through untouched, whatever they are called. Null and empty texts have no
letter, so they go in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common, langid, minhash, packing, suffixes, toxicity

LEAST_LANGUAGE_SCORE = 0.35  # below it no language is told apart from the others


def _aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list]:
    """docs with its columns, but for the used ones, under names that no operator has; and the columns that name them back."""
    names = {c: c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too), and those whose best language is hardly likelier than
    the others. Copies share their fate. Learnt from docs itself; where nothing can be learnt, nothing stays."""
    rows, back = _aside(docs, ["doc_id", "text", "lang"])
    return langid.identify(rows).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, by a model learnt from those of docs that have labels. Null and empty texts
    score as a text of no known terms does; copies share their fate."""
    labels = common.documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows, back = _aside(docs, ["doc_id", "text"])
    return toxicity.rate(rows, labels).filter("predicted = 0").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id (null last): five-word shingles, similarity 0.8. Of
    repeated rows one stays. Texts without words are no one's duplicate."""
    row = common.free_name(docs, "_row")
    docs = common.with_row(docs, row)
    found = minhash.near_duplicates(docs.select("doc_id", "text", row), carry=(row,))
    near = common.save(found.filter("component is not null").select(
        F.col(row).alias("r"), "component", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d")), free=True)
    for t in found._reads:
        common.drop(t)
    keeper = near.groupBy("component").agg(F.min(F.struct("d", "r")).alias("k")).select("component", F.col("k.r").alias("k"))
    gone = near.join(keeper, "component").filter("r <> k").select("r")
    return docs.join(gone, docs[row] == gone.r, "left_anti").drop(row)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id has, and counts n_chars anew where it cut;
    a document with nothing left goes. Rows of one doc_id take nothing from each other."""
    rows, back = _aside(docs, ["doc_id", "text", "n_chars"])
    cut = suffixes.remove_repeats(rows).filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    made = {"text": F.col("kept_text")}
    if "n_chars" in rows.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType)
    return cut.withColumns(made).select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins: UTF-8 bytes and an end mark as tokens. Null texts take no room."""
    return packing.pack(packing.byte_tokens(docs))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: Trained models and near-duplicate groups are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.save(stage(spark, docs, sf_dir), free=True)
        common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
