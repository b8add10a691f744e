"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, fill_in_middle, language_id, license_scan, lm_score, ngram_join, prefix_trie, simhash, source_mix, suffix_dedup, url_filter
from .common import show_code, table
from .oracles import ORACLES  # noqa: F401

#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Fixed value: the extra conversation of the chat query.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def crc_mod(doc_id, k: int):
    """crc32 of the id as text, modulo ``k`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes cut from all documents."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_characters=False)
    return cut.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"),
                      F.col("_sha256").alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, and read back from the tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    made = chat_format.format_chats(rows.unionByName(extra))

    def read(batches):
        enc = chat_format.encoder(chat_format.VOCABULARY)
        for batch in batches:
            out = []
            for conv, tokens, mask in zip(batch.column("conv_id").to_pylist(), batch.column("tokens"), batch.column("loss_mask"), strict=True):
                tokens, mask = tokens.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False)
                turns = list(chat_format.read_turns(enc, tokens))
                loss = "".join(chat_format.loss_texts(enc, tokens, mask))
                out.append({"conv_id": conv, "n_turns": len(turns), "loss_chars": len(loss),
                            "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                            "formatted_chars": len(chat_format.render(enc, tokens))})
            if out:
                yield from pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                                                ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])).to_batches()

    return made.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, from the profiles of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit_profiles(docs.where(crc_mod(F.col("doc_id"), 3) != 1), "lang")
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of all documents."""
    found = license_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
                        F.array_min("_places").alias("first_word"), F.array_max("_places").alias("last_word"),
                        F.array_join("_base", ",").alias("base_labels"), F.array_join("_labels", ",").alias("labels"), F.col("_score").alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by counts and a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_documents(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source."""
    return source_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return ngram_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_t", "_group")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its family's first turns."""
    numbered = prefix_trie.number_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.share_heads(numbered, family=20, most=4))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and read back."""
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim, form = F.col("_fim"), F.col("_form")
    return made.select("doc_id", F.col("_n_units").alias("n"), form.alias("form"), F.col("_prefix_chars").alias("prefix_chars"),
                       F.col("_middle_chars").alias("middle_chars"), F.sha2(fim, 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restore(fim, form), 256).alias("restored_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and the groups of near fingerprints."""
    return simhash.near_groups(simhash.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        show_code(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _query(f) for f in (
    op1_suffix_dedup, op2_embedding_dedup, op3_chat_format, op4_decontaminate, op5_language_id, op6_url_filter, op7_license_scan, op8_lm_score, op9_source_mix, op10_ngram_join,
    op11_prefix_trie, op12_fill_in_middle, op13_simhash)}
