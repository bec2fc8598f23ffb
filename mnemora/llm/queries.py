"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from mnemora.llm import decontamination, knn

_WHERE = {
    "op1_toxicity": "toxicity",
    "op2_pii": "pii",
    "op3_quality": "quality",
    "op4_decontamination": "decontamination",
    "op5_knn_join": "knn",
    "op6_chat": "chat",
    "op7_mixing": "mixing",
    "op8_language": "language",
    "op9_html": "html",
    "op10_simhash": "simhash",
}


def _query(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"mnemora.llm.{module}"), name)(spark, sf_dir)

    return run


QUERIES = {name: _query(name, module) for name, module in _WHERE.items()}

ORACLE_SQL: dict[str, str] = {"op4_decontamination": decontamination.OP4_SQL, "op5_knn_join": knn.OP5_SQL}
