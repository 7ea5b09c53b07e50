"""Registry of the queries of this subpackage: name -> function of (spark, sf_dir), and their DuckDB SQL where SQL can express them."""
from __future__ import annotations

from . import urls
from .bpe import op7_byte_bpe
from .media import op2_media_columns
from .orderhash import op9_order_minhash
from .packing import op10_packing
from .quality import op6_quality_rules
from .secrets import op3_secret_scans
from .sparse import op8_suffix_array_dedup
from .substring import op5_substring_dedup
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (urls.op1_url_filters, op2_media_columns, op3_secret_scans, op4_toxicity, op5_substring_dedup, op6_quality_rules, op7_byte_bpe, op8_suffix_array_dedup, op9_order_minhash, op10_packing)}
ORACLES = {"op1_url_filters": urls.ORACLE_SQL}
