"""Corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlattice.llm import minhash, mixing, packing, suffix_dedup, toxicity
from bitlattice.llm.common import cut, drop, read, release, tables_made
from bitlattice.llm.queries import tokenizer_path
from bitlattice.llm.suffix_dedup import PASSAGE_WORDS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILARITY = 80  # percent of common word shingles from which on documents are near duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among docs, doesn't reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, once. Rows
    without doc_id or without words are in no group and stay; of rows with one doc_id but other
    texts only those go whose own text is a near duplicate of a smaller doc_id's."""
    kept = minhash.near_duplicates(docs, SIMILARITY)
    gone = kept.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)
    # Rows that are equal in id and text are copies too.
    single = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return single.unionByName(rows.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of PASSAGE_WORDS words or more that also stand elsewhere, in whatever
    white space. In words and not in bytes, as a passage of that many short words may have 130 bytes
    only: of such runs in check_s a quarter have less than 400. Null texts stay null; n_chars is that
    of the new text."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, words=PASSAGE_WORDS)
    text = F.when(~F.col("was_null"), F.col("kept"))
    return out.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, which may be never. Rows are numbered, as doc_id
    may be null or repeated."""
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "mix-rows")
    copies = mixing.mix(rows, row=["row"]).select("row", "copies")
    taken = F.array_repeat(F.lit(1), F.col("copies").cast("int"))  # sequence(1, 0) would count down
    return rows.join(copies, "row").withColumn("copy", F.explode(taken)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row stands in the packed sequences. Null text is an empty document of
    the end id alone; every row is packed, those of null or repeated doc_id too."""
    return packing.pack_documents(docs, tokenizer_path(), {"ids_crc32": F.crc32("ids")}).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; what a
    stage wrote besides, and the result before it, is then deleted."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_made() as made:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*before, *(t for t in made if t is not docs))
        before = [docs]
        release(spark)
    return docs


#: A fitted model, signatures and a tokenizer take part, so SQL can't express the rows.
ORACLE_SQL = None
