"""Queries of the text operators over the driver's tables, with production parameters, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat, debruijn, htmltext, langid, merkle, nbsvm, ogg, packing, pii, simhash, toxicity, trie, wumanber
from helixframe.llm.learning import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(result: DataFrame, folds: int, out: int) -> DataFrame:
    """Adds held_out; rows without a doc_id are never learned from and so count as held out."""
    return result.withColumn("held_out", F.coalesce(fold(folds) == out, F.lit(True)))


def op1_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents. Null and wordless texts have fingerprint 0 and are one group; ties and repeated rows stay; an empty table gives no rows."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    """Languages of all documents. Null texts and texts without letters are und; repeated rows stay; rows without a doc_id count as held out; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    return _held_out(langid.identify(docs, langid.fit(docs)), 4, 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_ogg(spark, sf_dir):
    """All texts through Ogg files and back. Null texts are empty, empty ones 64 zero bytes; repeated rows stay; an empty table gives no rows."""
    return ogg.round_trip(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public tokenizer file that the packing query uses; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir):
    """All documents in sequences of 2048 ids. Null and empty texts are the end id; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark, sf_dir):
    """Personal data of all texts. Null and empty texts have none; overlapping kinds all count; repeated rows stay; an empty table gives no rows."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_debruijn(spark, sf_dir):
    """Repeated windows of all texts removed. Null and wordless texts lose nothing; rows that share a doc_id don't repeat one another; an empty table gives no rows."""
    return debruijn.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_wumanber(spark, sf_dir):
    """Benchmark windows in all texts. Null texts have no words; repeated rows of either table count as they are; an empty benchmark hits nothing, empty documents give no rows."""
    return wumanber.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark, sf_dir):
    """Toxicity of all texts. Null and empty texts get the score of a sentence without evidence; repeated rows stay; without labels all scores are one constant; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return _held_out(scored, 5, 0).select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op9_nbsvm(spark, sf_dir):
    """Quality of all texts. Null and empty texts have no n-grams and get the offset's score; repeated rows stay; without labels all scores are one constant; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    scored = nbsvm.score(docs, nbsvm.fit(docs, _table(spark, sf_dir, "labels")))
    return _held_out(scored, 5, 0).select("doc_id", "held_out", "score", "predicted")


def op10_htmltext(spark, sf_dir):
    """Main text of all pages. Null and empty html have none; null urls are one host; ties go to the deeper container, then by name; repeated rows stay; an empty table gives no rows."""
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op11_chat(spark, sf_dir):
    """All conversations and the awkward one, formatted and read back. Null roles and texts are empty, a null conv_id is one conversation; ties stand by role and text, repeated rows stay; an empty table leaves conversation -7."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.AWKWARD).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.conversations(chat.format_turns(turns.unionByName(odd))))


def op12_merkle(spark, sf_dir):
    """The Merkle manifest of all documents. Null fields are marked, null langs a tree of their own; rows of one doc_id stand by their leaves, repeated rows stay; an empty table gives no rows."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations. Null roles and texts are empty, rows without a conv_id belong to none; tied turns stand by their digest, repeated rows stay; an empty table has no nodes."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_langid, op3_ogg, op4_packing, op5_pii, op6_debruijn, op7_wumanber, op8_toxicity, op9_nbsvm, op10_htmltext, op11_chat, op12_merkle, op13_trie)}
ORACLES = {"op7_wumanber": wumanber.SQL, "op11_chat": chat.SQL, "op12_merkle": merkle.SQL, "op13_trie": trie.SQL}
