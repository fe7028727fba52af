"""Queries of this subpackage, by name, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op12_token_alignment
from .ann import op5_nearest
from .byte_bpe import op3_byte_bpe
from .jaccard import op8_jaccard_join
from .licenses import op9_licenses
from .line_dedup import op1_line_dedup
from .packing import op4_packing
from .quality import OP7_SQL, op7_quality_rules
from .sharding import op2_sharding
from .toxicity import op6_toxicity
from .variants import op13_spelling_variants
from .warc import OP11_SQL, op11_warc
from .wavelet import op10_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_byte_bpe, op4_packing, op5_nearest, op6_toxicity, op7_quality_rules,
                            op8_jaccard_join, op9_licenses, op10_token_output, op11_warc, op12_token_alignment, op13_spelling_variants)}
ORACLE: dict[str, str] = {"op7_quality_rules": OP7_SQL, "op11_warc": OP11_SQL}
