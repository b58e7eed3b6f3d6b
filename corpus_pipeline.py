"""A training corpus from documents: language ID, near-duplicates, secrets, source mix, packed sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import entropy_mixing, hamming_minhash, hd_language, secret_dfa, vector_packing
from foliant.llm.common import discard, pick, stored, table
from foliant.llm.token_ids import default_tokenizer

#: Documents whose cosine with the nearest language is far below what is usual for their length are rejected, and so are short
#: ones that are no nearer than chance: their letters are like no language learned, or a few words over and over. Short
#: texts that the first space leaves in doubt are compared in the second, where chance is a quarter.
LANGUAGE_SPACES = (hd_language.Space(), hd_language.Space(dimensions=16384))

#: What a training sequence holds. A whole sequence of one document has the greatest attention cost, so that only the number of
#: documents binds beside the tokens: attention kernels are told no more than so many places where a document ends.
SEQUENCE = vector_packing.Capacity(tokens=2048, documents=64, attention=2048 * 2048)


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, and the new names of the columns of documents."""
    at: dict[str, str] = {}
    for i, c in enumerate(docs.columns):
        at.setdefault(c.lower(), f"_s{i}")
    return docs.toDF(*(f"_s{i}" for i in range(len(docs.columns)))), at


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those near no language; others stay as they are.

    Prototypes, and the cosines that are usual, are learned from all documents with a language that are not held
    out. With none to learn from, only documents without a letter could be told apart, and nothing is rejected but null
    and empty texts.
    """
    plain, at = _plain(docs)
    known = pick(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~hd_language.held_out(F.col("doc_id")))
    training = hd_language.training_rows(known)
    grams = hd_language.gram_weights(training, LANGUAGE_SPACES[0].n)
    coarse, fine = (hd_language.prototypes(grams, space) for space in LANGUAGE_SPACES)
    discard(grams)
    if not coarse:
        return plain.where(F.col(at["text"]) != "").toDF(*docs.columns)
    least = hd_language.floors(training, coarse, LANGUAGE_SPACES[0])
    said = plain.withColumn("_language", hd_language.recognised(F.col(at["text"]), coarse, fine, LANGUAGE_SPACES, least))
    return said.where("_language").drop("_language").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    return hamming_minhash.keep_one(docs, hamming_minhash.NearDuplicates(words=5, per_hundred=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark with its kind, and n_chars follows; other documents stay as they are."""
    plain, at = _plain(docs)
    text = at["text"]
    clean = plain.withColumn("_clean", secret_dfa.redacted(F.col(text)))
    changed = ~F.col("_clean").eqNullSafe(F.col(text))
    new = {text: F.col("_clean")}
    if "n_chars" in at:
        new[at["n_chars"]] = F.when(changed, F.length("_clean").cast("long")).otherwise(F.col(at["n_chars"]))
    return clean.select(*(new.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times), so that sources come near their token targets."""
    plain, at = _plain(docs)
    fixed = {"doc_id", "text", "source"}
    mixed = entropy_mixing.mix(plain.toDF(*(next((n for n in fixed if at[n] == c), c) for c in plain.columns)))
    copies = mixed.where("_mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return copies.select(*mixed.columns[: len(docs.columns)]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and copies, placed in sequences of at most 2048 tokens and 64 pieces."""
    packed = vector_packing.pack_documents(docs, default_tokenizer(), SEQUENCE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Languages, hashes and tokens cannot be had in SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
