"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liftworks.llm import langid, licenses, manifest, metric, minhash, mixing, packing, pii, quality, spelling, suffix, topk, toxicity
from liftworks.llm.common import staged, temporaries


def contained(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its rows written, so that all else it has written goes when it returns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with temporaries():
            return staged(query(spark, sf_dir), keep=True)

    return run


QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_minhash": contained(minhash.op2_minhash),
    "op3_topk": topk.op3_topk,
    "op4_toxicity": contained(toxicity.op4_toxicity),
    "op5_licenses": licenses.op5_licenses,
    "op6_mixing": contained(mixing.op6_mixing),
    "op7_quality": contained(quality.op7_quality),
    "op8_pii": pii.op8_pii,
    "op9_language": contained(langid.op9_language),
    "op10_packing": packing.op10_packing,
    "op11_embeddings": metric.op11_embeddings,
    "op12_manifest": manifest.op12_manifest,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {
    "op2_minhash": minhash.SQL,
    "op3_topk": topk.SQL,
    "op5_licenses": licenses.SQL,
    "op6_mixing": mixing.SQL,
    "op11_embeddings": metric.SQL,
    "op12_manifest": manifest.SQL,
    "op13_spelling": spelling.SQL,
}
