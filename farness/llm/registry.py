"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from farness.llm.op1 import op1_quality_model
from farness.llm.op2 import op2_url_filter
from farness.llm.op3 import op3_decontamination
from farness.llm.op4 import op4_language_id
from farness.llm.op5 import OP5_SQL, op5_line_dedup
from farness.llm.op6 import op6_packing
from farness.llm.op7 import OP7_SQL, op7_quality_rules
from farness.llm.op8 import OP8_SQL, op8_license_scan
from farness.llm.op9 import op9_near_duplicates
from farness.llm.op10 import op10_token_files

QUERIES = {f.__name__: f for f in (op1_quality_model, op2_url_filter, op3_decontamination, op4_language_id, op5_line_dedup, op6_packing, op7_quality_rules, op8_license_scan, op9_near_duplicates, op10_token_files)}
ORACLES = {"op5_line_dedup": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_license_scan": OP8_SQL}
