"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .op1_fingerprints import op1_fingerprints
from .op2_lines import op2_lines
from .op3_mixing import ORACLE_SQL as MIXING_SQL
from .op3_mixing import op3_mixing
from .op4_simhash import op4_simhash
from .op5_quality import op5_quality
from .op6_language import op6_language
from .op7_tokens import op7_tokens
from .op8_decontamination import op8_decontamination
from .op9_secrets import op9_secrets
from .op10_html import op10_html


def queries() -> dict:
    import corpus_pipeline

    every = (op1_fingerprints, op2_lines, op3_mixing, op4_simhash, op5_quality, op6_language, op7_tokens, op8_decontamination, op9_secrets, op10_html)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op3_mixing": MIXING_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
