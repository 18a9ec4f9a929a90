"""A training-data pipeline over `documents`: quality, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. The stages' own tables go to the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import WORD, IdFilter, Workspace, table
from vigil.llm.mixing import mix
from vigil.llm.ngram_join import jaccard_classes
from vigil.llm.packing import pack_documents
from vigil.llm.quality import fit, keep_good
from vigil.llm.queries import tokenizer
from vigil.llm.secrets import has_candidate, redact, scan_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text; null and empty texts are scored as padding. It learns from the
    labelled documents of the input tables; without labels of both classes all scores are alike. An empty table gives an empty result."""
    net = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_good(docs, net)


#: What the stages' operators read; the whole row travels beside it in one column, so that no name of a document's column can clash with an operator's.
READ = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    return docs.select(*READ, F.struct(*docs.columns).alias("_doc"))


def numbered(work: Workspace, docs: DataFrame) -> DataFrame:
    """The packed documents with a written number for each row, `_row`: ids may be null or repeat with different texts."""
    rows = work.put(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    return rows.select(*(F.col("_doc").getField(c).alias(c) for c in READ), "_doc", "_row")


def unpacked(rows: DataFrame, columns: list[str], text=None) -> DataFrame:
    """The documents' own columns again, with another text and its length if one is given."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col("_doc").getField(c)).alias(c) for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row of the smallest id stays, a null id counting as the largest; of equal rows without words
    one. Rows are told apart by a number, so null and repeated ids lose nothing else. An empty table gives an empty result. Only rows that a
    fixed-size filter of the leaving ones hits are shuffled; the rest pass as they are read."""
    work, columns = Workspace(spark), docs.columns
    docs = numbered(work, docs)
    classes = jaccard_classes(work, docs.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0")
    classes = classes.select(F.col("doc_id").alias("_row"), F.col("component_id").cast("string").alias("class")).join(docs.select("_row", "doc_id"), "_row")
    # texts without words link with nothing, so their repeated rows are found by the whole row
    bare = docs.where(~F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD)))
    bare = bare.select("_row", F.sha2(F.to_json("_doc"), 256).alias("class"), "doc_id")
    members = work.put(classes.unionByName(bare), "members")
    first = members.groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    first = work.put(first.where("n > 1").select("class", F.col("first._row").alias("stays")), "first")  # written, so that the join can split a hot class
    leaving = work.put(members.join(first, "class").where("_row <> stays").select("_row"), "leaving")
    hit = IdFilter.of(leaving.select(F.col("_row").alias("doc_id"))).column(F.col("_row"))
    kept = docs.where(~hit).unionByName(docs.where(hit).join(leaving, "_row", "left_anti").select(docs.columns))
    return unpacked(kept, columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become [SECRET]. Documents without a candidate, with a null or empty text too, pass as they are read; the others carry
    their text through the scan, so null and repeated ids keep their own. An empty table gives an empty result."""
    suspect = has_candidate(F.coalesce("text", F.lit("")))
    clean = docs.where(~suspect)
    found = scan_secrets(Workspace(spark), packed(docs.where(suspect)), keep_text=True)
    text = F.when(F.size("all_spans") > 0, redact(F.col("text"), F.col("all_spans"))).otherwise(F.col("text"))
    return clean.unionByName(unpacked(found.withColumn("text", text), docs.columns, F.col("text")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each whole taking, and once more for the words of a partial one. Documents not taken, among them all without
    words, go. Rows are told apart by a number, so null and repeated ids keep their own share. An empty table gives an empty result."""
    work, columns = Workspace(spark), docs.columns
    docs = numbered(work, docs)
    taken = mix(work, docs, keep=("_row",)).where("taken > 0").select("_row", "epochs", "cut_from", "cut_to", "cut_again", "size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = lambda a, b: F.when(F.col("cut_to") - F.col("cut_from") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, a.cast("int") + 1, (b - a).cast("int")), " "))
    none = F.expr("cast(array() as array<string>)")
    run = F.when(F.col("cut_to") > F.col("cut_from"), F.array(cut(F.col("cut_from"), F.col("cut_to")))).otherwise(none)
    again = F.when(F.col("cut_again") > 0, F.array(F.array_join(F.slice(words, 1, F.col("cut_again").cast("int")), " "))).otherwise(none)
    texts = F.concat(F.array_repeat("text", F.col("epochs").cast("int")), run, again)
    rows = docs.join(taken, "_row").withColumn("_taken", F.explode(texts))
    return unpacked(rows, columns, F.col("_taken"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of each row's document, null texts as empty, repeated rows each; an empty
    table gives an empty result."""
    return pack_documents(Workspace(spark), docs, tokenizer("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
