"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it
kept, and returns them with the columns of ``documents``; the last returns packed pieces.
Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

import uuid

from tessera.llm import decontaminate, jaccard, line_dedup, packing, quality
from tessera.llm.common import cleared, deleted, shared_folder


def quality_stage(spark, docs, sf_dir):
    """Drops documents that the Bradley-Terry classifier rejects."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark, docs, sf_dir):
    """Drops repeated lines; the documents stay."""
    return line_dedup.deduplicated(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of linked documents stays, the one with the smallest doc_id."""
    return jaccard.representatives(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Drops contaminated documents."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark, docs, sf_dir):
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier's fit and the packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again; a stage's own tables, and its input, go once its rows are stored."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark).rstrip('/')}/tessera/stage{k}-{uuid.uuid4().hex}"
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            deleted(spark, read)
        docs, read = spark.read.parquet(path), path
