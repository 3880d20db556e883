"""The corpus pipeline: documents in, a deduplicated and weighted mixture out.

Each stage is an operator of ``quillframe.llm`` applied to all rows that the
stage before it kept, written as Parquet and read again. All stages but the
last return the columns of documents.

Cases: null and empty texts fail the quality rules and go in the first stage.
Rows that repeat an id are judged each by its own text; of equal rows the near-dedup
keeps one. A null source is a source of its own in the mixture. Other columns stay as
they are, but for ``copy``: the mixture numbers its copies there, in place of a column of
that name. An empty table passes all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import decontaminate, mixture, quality, secrets, simhash
from quillframe.llm.common import QUERIES, table
from quillframe.session import configure, scratch_path

STAGES = [
    ("quality rules", quality.keep_good),
    ("simhash near-dedup", simhash.drop_near_copies),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("secret scans", secrets.redact_live),
    ("source mixture", mixture.mix_sources),
]

#: The first stage's trees are learned from the labels, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES["pipeline"] = run
