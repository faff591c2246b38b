"""The queries of this folder, and their SQL where SQL can state them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, html, langid, licenses, media, neardup, packing, pii, substring, toxicity
from millrace.llm.common import small_batches



def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The function, in a session that is set up for batches of whole texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


QUERIES = {
    f.__name__: query(f)
    for f in (media.op1_media, decontaminate.op2_decontamination, toxicity.op3_toxicity, langid.op4_language, neardup.op5_minhash, packing.op6_packing, licenses.op7_licenses, pii.op8_pii, substring.op9_recompression, html.op10_html)
}
ORACLE = {"op2_decontamination": decontaminate.ORACLE, "op5_minhash": neardup.ORACLE, "op9_recompression": substring.ORACLE}
