"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from comptoir.llm import bpe, centroids, chat, imatch, lattice, lines, packing, pii, quality, runs, simhash, token_files, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_imatch": imatch.op4_imatch,
    "op5_packing": packing.op5_packing,
    "op6_bpe": bpe.op6_bpe,
    "op7_chat": chat.op7_chat,
    "op8_urls": urls.op8_urls,
    "op9_token_files": token_files.op9_token_files,
    "op10_lattice": lattice.op10_lattice,
    "op11_runs": runs.op11_runs,
    "op12_centroids": centroids.op12_centroids,
    "op13_lines": lines.op13_lines,
}

ORACLES: dict[str, str] = {
    "op7_chat": chat.OP7_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_lines": lines.OP13_SQL,
}
