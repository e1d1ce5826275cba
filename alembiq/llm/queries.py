"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op5_decontaminate
from .golden import OP12_SQL, op12_golden
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .preference import OP7_SQL, op7_preference
from .quality import op3_quality
from .simhash import op4_simhash
from .spotsigs import OP9_SQL, op9_spotsigs
from .token_output import op6_token_output
from .toxicity import op1_toxicity
from .url_filter import op11_urls
from .warc import OP8_SQL, op8_warc
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_output": op6_token_output,
    "op7_preference": op7_preference,
    "op8_warc": op8_warc,
    "op9_spotsigs": op9_spotsigs,
    "op10_mixing": op10_mixing,
    "op11_urls": op11_urls,
    "op12_golden": op12_golden,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op7_preference": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_spotsigs": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op12_golden": OP12_SQL,
}
