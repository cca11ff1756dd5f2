"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, balltree, kd_shards, langid, mixing, periodic, personal, pieces, secrets, tokenids, topk, toxicity, transport

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "op1_transport_streams": transport.op1_transport_streams,
        "op2_blob_ledger": secrets.op2_blob_ledger,
        "op3_range_coder": tokenids.op3_range_coder,
        "op4_kd_shards": kd_shards.op4_kd_shards,
        "op5_bag_minhash": bagminhash.op5_bag_minhash,
        "op6_entropy_mix": mixing.op6_entropy_mix,
        "op7_histogram_topk": topk.op7_histogram_topk,
        "op8_toxicity_cnn": toxicity.op8_toxicity_cnn,
        "op9_merge_dropout": pieces.op9_merge_dropout,
        "op10_language_id": langid.op10_language_id,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_contextual_pii": personal.op12_contextual_pii,
        "op13_ball_tree_search": balltree.op13_ball_tree_search,
        "language_id_pages": langid.language_id_pages,
    }
    return found


def oracle_sql() -> dict[str, str]:
    return {"op7_histogram_topk": topk.OP7_SQL, "op13_ball_tree_search": balltree.OP13_SQL}
