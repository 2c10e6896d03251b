"""The registered queries of the corpus operators, each over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, lloyd, mixing, pseudonyms, quality, recompression, sentencepieces, sharding, suffixes, urlfilter, vptree, whitening
from plumbline.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return wrap


@query("op1_virtual_slots")
def _shards(t: Tables) -> DataFrame:
    return sharding.shard_documents(t.documents, shards=24)


@query("op6_source_mix", mixing.ORACLE_SQL)
def _mix(t: Tables) -> DataFrame:
    return mixing.mix_sources(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_wu_manber", decontaminate.ORACLE_SQL)
def _decontaminate(t: Tables) -> DataFrame:
    found = decontaminate.find_benchmark(t.documents.select("doc_id", "text"), t.benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_pu_quality")
def _quality(t: Tables) -> DataFrame:
    scored = quality.classify(t.documents.select("doc_id", "text"), t.labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_prefix_tree_join", jaccard.ORACLE_SQL)
def _jaccard(t: Tables) -> DataFrame:
    return jaccard.jaccard_components(t.documents)


@query("op9_vp_trees")
def _neighbours(t: Tables) -> DataFrame:
    index = vptree.build_index(t.embeddings)
    return vptree.nearest(index, t.embeddings.filter("vec_id % 50 = 0"))


@query("op5_link_graph", urlfilter.oracle_sql())
def _urls(t: Tables) -> DataFrame:
    return urlfilter.judge_urls(t.pages).select("page_id", "host", "path", "rule", "verdict")


@query("op7_recompression", recompression.ORACLE_SQL)
def _substrings(t: Tables) -> DataFrame:
    return recompression.dedup_substrings(t.documents)


@query("op8_suffix_family")
def _bytes(t: Tables) -> DataFrame:
    return suffixes.dedup_bytes(t.documents)


@query("op3_feistel_pseudonyms")
def _pseudonyms(t: Tables) -> DataFrame:
    out = pseudonyms.pseudonymised(t.documents.select("doc_id", "text"), pseudonyms.DEMO_KEY)
    return out.select("doc_id", "text", F.size("found").alias("n_found"), F.transform("found", lambda x: F.concat_ws("@", x["kind"], x["place"])).alias("found"))


def piece_model() -> str:
    """Path of the public model that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_merge_rounds")
def _tokens(t: Tables) -> DataFrame:
    model = piece_model()
    both = sentencepieces.decoded(sentencepieces.encoded(t.documents, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_member_lloyd", lloyd.oracle_sql())
def _codes(t: Tables) -> DataFrame:
    return lloyd.code_table(t.embeddings)


@query("op12_secular_whitening")
def _whitening(t: Tables) -> DataFrame:
    return whitening.whitened(t.embeddings)
