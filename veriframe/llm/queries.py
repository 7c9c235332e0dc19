"""The queries of the training-data operators, one of each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm.decontaminate import ORACLE_OP8, op8_decontaminate
from veriframe.llm.exact_dedup import ORACLE_OP2, op2_exact_dedup
from veriframe.llm.hard_negatives import ORACLE_OP12, op12_hard_negatives
from veriframe.llm.html_text import op1_html_text
from veriframe.llm.line_dedup import ORACLE_OP4, op4_line_dedup
from veriframe.llm.mixing import op6_mixing
from veriframe.llm.personal_data import op13_personal_data
from veriframe.llm.prefix_trie import ORACLE_OP11, op11_prefix_trie
from veriframe.llm.secrets import op5_secret_scan
from veriframe.llm.simhash import op10_simhash
from veriframe.llm.token_counts import op9_token_counts
from veriframe.llm.toxicity import op3_toxicity
from veriframe.llm.url_filter import ORACLE_OP7, op7_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_html_text, op2_exact_dedup, op3_toxicity, op4_line_dedup, op5_secret_scan, op6_mixing, op7_url_filter, op8_decontaminate, op9_token_counts, op10_simhash, op11_prefix_trie, op12_hard_negatives, op13_personal_data)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": ORACLE_OP2, "op4_line_dedup": ORACLE_OP4, "op7_url_filter": ORACLE_OP7, "op8_decontaminate": ORACLE_OP8, "op11_prefix_trie": ORACLE_OP11, "op12_hard_negatives": ORACLE_OP12}
