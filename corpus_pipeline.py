"""The corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Each stage's result is written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconspark.llm.common import Scratch, fold, table
from reconspark.llm.decontaminate import contaminated
from reconspark.llm.language import identify, learn
from reconspark.llm.packing import pack
from reconspark.llm.simhash import near_duplicates
from reconspark.llm.substring import remove_repeats
from reconspark.session import ship
from reconspark.storage import temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SimHash of five-word shingles: 512 bits, of which 0.8 at least are equal; a Jaccard similarity of 0.8 differs in 78 bits, give
#: or take 8, which is what the search aims at.
SHINGLE, LANES, RADIUS, AIM = 5, 8, 102, 82
#: Score from which a prediction replaces another lang; trigrams from which a text is judged by its cosine, and the cosine that a
#: text of random letters stays below (three deviations at 1024 dimensions).
SURE, LONG, NOISE = 0.99, 64, 0.094


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised, and sets lang where it is null or contradicted with a score of SURE.

    Null texts and texts without a letter go, and so do texts of LONG trigrams and more that are no more like any language than random
    letters are. Where two folds of three hold no labelled text all rows are learned from, and where none is labelled letters
    alone count and lang stays.
    """
    models = learn(docs.where(~fold("doc_id", 3, 1))) or learn(docs)
    if not models:
        return docs.where("text rlike '\\\\p{L}'").select(*COLUMNS)
    found = identify(docs.select(*COLUMNS), models).where((F.col("lang_pred") != "und") & ((F.col("trigrams") < LONG) | (F.col("cosine") >= NOISE)))
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*COLUMNS)


def _own_id() -> Column:
    """doc_id, and above all of these a number of the text for rows without one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: that with the smallest id, and of texts with one id the first
    by hash. Rows without an id come last and each of their texts is a document of its own."""
    keyed = docs.select(*COLUMNS, _own_id().alias("__id"), F.xxhash64("text").alias("__tag"))
    groups = near_duplicates(keyed, shingle=SHINGLE, lanes=LANES, radius=RADIUS, aim=AIM, id_col="__id", tag_col="__tag")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.tag").alias("__tag")).distinct()
    kept = keyed.join(first, ["__id", "__tag"], "left_semi")
    same = Window.partitionBy("__id", "__tag").orderBy("lang", "source", "n_chars")
    return kept.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 50 words and more out of the texts; documents of which nothing is left go.

    The document with the smallest id keeps a passage. Rows without an id, and all but the first text (by hash) of an id that several
    texts have, come after those with an id of their own, each with a number of its text; so they lose what others hold, and one of them
    keeps what only they hold.
    """
    keyed = docs.select(*COLUMNS, _own_id().alias("__own"), F.xxhash64("text").alias("__tag"))
    shared = keyed.groupBy("__own").agg(F.min("__tag").alias("__low"), F.max("__tag").alias("__high")).where("__low < __high").select("__own", "__low")
    number = F.col("__tag").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    numbered = keyed.join(shared, "__own", "left").withColumn("__own", F.when(F.col("__tag") > F.col("__low"), number).otherwise(F.col("__own")))
    cut = remove_repeats(numbered.select(*COLUMNS, "__own"), id_col="__own")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where("n_words = 0 or n_removed < n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item. Rows are told apart by their texts, so those without an id or with that of
    another text go or stay by what they hold themselves."""
    tagged = docs.select(*COLUMNS, F.xxhash64("text").alias("__tag"))
    found = contaminated(tagged, table(spark, sf_dir, "benchmark"), id_col="__tag").select(F.col("doc_id").alias("__tag")).distinct()
    return tagged.join(found, "__tag", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens. Rows without an id, or with that of another text, are packed too; their
    pieces bear the id that they have."""
    return pack(docs)


STAGES = [
    ("language identification", language),
    ("SimHash near-duplicates", near_copies),
    ("repeated passages", passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage and its operators have written is deleted once the next one is saved."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.keep(f"stage-{k}")
    return docs
