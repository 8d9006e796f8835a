"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Rows count one by one in every stage: null or repeated ids are no reason to go, nor is a long text, which is read
whole. Columns beyond those of ``documents`` are returned as they are, whatever their names. An empty table gives an
empty one. What a stage does with a null or empty text, and with rows that are alike, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import crc_mod, discard, release_memory, table, written
from tidewell.llm.decontaminate import judged, mark_spans
from tidewell.llm.jaccard_join import jaccard_groups
from tidewell.llm.language_id import identify
from tidewell.llm.packing import default_tokenizer, pack_documents
from tidewell.llm.quality_cnn import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this calibrated probability of its best language, a document is rejected.
LANG_SCORE = 0.5


def apart(docs: DataFrame):
    """``docs`` with every column but doc_id and text renamed, so that none clashes with an operator's, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__kept{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, list(names.values()), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told: not ``und``, and with a score of LANG_SCORE or more.

    A null text, or one without a letter, has none and goes. Repeated rows are judged alike. Where no document has a
    language to learn from, all go.
    """
    release_memory(spark)
    labelled = table(spark, sf_dir, "documents").where(crc_mod(F.col("doc_id"), 3) != 1)
    docs, names, back = apart(docs)
    return back(identify(docs, labelled, keep=names).where((F.col("lang_pred") != "und") & (F.col("score") >= LANG_SCORE)))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of score 0.3 or more.

    A null text is scored as an empty one. Repeated rows are judged alike. Without labels of both kinds every score
    is the share of label 1, or one half.
    """
    release_memory(spark)
    learn = crc_mod(F.col("doc_id"), 5) != 0
    docs, names, back = apart(docs)
    return back(classify(docs, docs.where(learn), table(spark, sf_dir, "labels").where(learn), keep=names).where(F.col("score") >= 0.3))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows one with the least doc_id (null before all others), and all rows without words.

    Rows count one by one, not by doc_id: those that share an id, or have none, all stay if they aren't linked.
    """
    release_memory(spark)
    docs, _, back = apart(docs)
    has_words = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/"), F.col("text"))
    some = docs.where(has_words).withColumn("__row", F.unhex(F.md5(name.cast("binary"))))
    groups = jaccard_groups(some, key="__row")
    keep = groups.groupBy("component").agg(F.min(F.struct("doc_id", "__row")).alias("m")).select(F.col("m.__row").alias("__row"))
    # rows of one id and text are copies of each other, so that one of them stays
    one = some.join(keep.hint("merge"), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return back(one.unionByName(docs.where(~has_words)))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated by the benchmark.

    A null or empty text has no words and stays. Repeated rows are judged alike. An empty benchmark contaminates none.
    """
    release_memory(spark)
    docs, _, back = apart(docs)
    return back(judged(mark_spans(docs, table(spark, sf_dir, "benchmark"))).where(~F.col("contaminated")))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text has the end id alone. Repeated rows are packed each. The columns are those of the pieces.
    """
    release_memory(spark)
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("language_id", stage_language),
    ("quality", stage_quality),
    ("near_copies", stage_near_copies),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the models of the first two stages, nor the tokens of the last.
ORACLE_SQL = None
