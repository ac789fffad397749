"""A corpus pipeline: documents in, token ids out.

Each stage works on all that the stage before it kept; what it returns is
written as Parquet and read again as the next stage's documents.

1. quality_rules: documents that the rules reject go.
2. near_duplicates: one document of each group stays, whose texts are linked by
   a similarity of 0.8 or more of five-word shingles; candidates come from
   SimHash fingerprints, each link is checked exactly.
3. repeated_passages: byte strings of 200 or more that start elsewhere too are
   cut out, at whole characters.
4. mixing: documents are repeated or dropped until each source is near its
   target share.
5. tokens: every text is encoded; the ids and their digests are returned.

Defined results: null and empty texts fail the first stage, as do all of fewer
than 20 words; texts of any length are read whole; repeated rows are one group
of the second stage; rows without id are kept or dropped like others, last in
their group; an empty table gives no tokens; further columns, whatever their
names, are carried to the last stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from quern.llm.common import delete_folders, new_folder, release, table, watch_folders


@dataclass
class Scratch:
    """The folders that a stage has made for itself, and what it read."""

    stage: int
    inputs: frozenset[str]
    folders: list[str] = field(default_factory=list)


#: What stages have left, by thread and folder of the tables.
_left: dict[tuple[int, str], list[Scratch]] = {}


def stage(number: int):
    """A stage that first deletes the tables which the one before has left for itself.

    Its predecessor's result has been written when this stage reads other
    files than its predecessor did, as ``run`` and any caller that follows the
    contract sees to; then nothing reads these tables any more. Stages that
    read the same files, other tables or in other threads are left alone.
    """

    def decorate(f):
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = Scratch(number, frozenset(docs.inputFiles()))
            left = _left.setdefault((get_ident(), sf_dir), [])
            done = [s for s in left if s.stage == number - 1 and own.inputs and s.inputs.isdisjoint(own.inputs)]
            for s in done:
                delete_folders(spark, s.folders)
                left.remove(s)
            release(spark)
            left.append(own)
            with watch_folders(own.folders):
                return f(spark, docs, sf_dir)

        return run_stage

    return decorate


@stage(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


@stage(1)
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@stage(2)
def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


@stage(3)
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


@stage(4)
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(bpe.default_ranks())
    encoded = bpe.encode(docs, ranks)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeat_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can't express the stages (robust estimates, tries, suffix arrays, BPE); they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, work in STAGES:
        out = new_folder(spark, f"stage-{name}")
        work(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        delete_folders(spark, before)
        before = [out]
    for s in _left.pop((get_ident(), sf_dir), []):
        delete_folders(spark, s.folders)
    return docs
