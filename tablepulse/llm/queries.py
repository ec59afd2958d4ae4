"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablepulse.llm.bpe import op9_bpe_pair_index
from tablepulse.llm.classifier import op7_quality_classifier
from tablepulse.llm.collocations import OP11_SQL, op11_phrases
from tablepulse.llm.decontamination import op1_decontamination
from tablepulse.llm.licenses import op6_license_scan
from tablepulse.llm.line_dedup import OP4_SQL, op4_line_dedup
from tablepulse.llm.packing import op12_best_fit
from tablepulse.llm.personal_data import op10_personal_data
from tablepulse.llm.perspectives import OP2_SQL, op2_perspectives
from tablepulse.llm.quality_rules import op5_quality_rules
from tablepulse.llm.revisits import OP8_SQL, op8_revisits
from tablepulse.llm.simhash_pivots import op3_simhash_pivots
from tablepulse.llm.vector_codes import OP13_SQL, op13_orchard_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        *(op1_decontamination, op2_perspectives, op3_simhash_pivots, op4_line_dedup, op5_quality_rules, op6_license_scan),
        *(op7_quality_classifier, op8_revisits, op9_bpe_pair_index, op10_personal_data, op11_phrases, op12_best_fit, op13_orchard_codes),
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspectives": OP2_SQL, "op4_line_dedup": OP4_SQL, "op8_revisits": OP8_SQL, "op11_phrases": OP11_SQL, "op13_orchard_codes": OP13_SQL}
