"""A profile kept up to date (AGG-16, JOB-05).

Every landing adds its own members with their numbers to a store of ``snapshot.py``, and those of
the issues it replaces with negative numbers; nothing that landed before is read again.
The profile is worked out from the sums: a member is in a distinct set as long as its sum
is positive, counts are sums. The birth year needs the earliest issues, whose (key,
created) are kept in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile as pf
from . import snapshot as sn

CREATED = "created"


def _created(issues: DataFrame) -> DataFrame:
    return issues.select("repo", "key", F.col("fields.created").alias("created"))


def _signed(new: DataFrame, old: DataFrame | None) -> DataFrame:
    plus = new.withColumn("n", F.lit(1).cast("long"))
    return plus if old is None else plus.unionByName(old.withColumn("n", F.lit(-1).cast("long")))


def land(spark: SparkSession, root: str, issues: DataFrame, repos: DataFrame, replaced: DataFrame | None = None,
         batch: str | None = None) -> sn.Snapshot:
    """Add landed issue documents; ``replaced`` are the documents, as they landed, whose place they take.

    A batch that is in the store's ledger is not read.
    """
    held = sn.latest(spark, root)
    if batch is not None and sn.done(held, batch):
        return held
    old = None if replaced is None else pf.document_members(replaced, repos)
    members = pf.member_counts(_signed(pf.document_members(issues, repos), old)).where("n <> 0")
    created = _signed(_created(issues), None if replaced is None else _created(replaced))
    created = created.groupBy("repo", "key", "created").agg(F.sum("n").alias("n")).where("n <> 0")
    return sn.commit(spark, root, {sn.MAIN: members, CREATED: created}, batch, base=held)


def members(spark: SparkSession, root: str, snapshot: sn.Snapshot | None = None) -> DataFrame:
    """(repo, kind, name, n) over all landings."""
    return pf.member_counts(sn.read(spark, root, snapshot=snapshot)).where("n <> 0")


def stored_profile(spark: SparkSession, root: str, repos: DataFrame, type_catalog: DataFrame | None = None,
                   link_catalog: DataFrame | None = None) -> DataFrame:
    """The profile of all that landed, equal to ``profile.profile`` over the documents as they are now."""
    held = sn.latest(spark, root)
    created = sn.read(spark, root, CREATED, held).groupBy("repo", "key", "created").agg(F.sum("n").alias("n")).where("n > 0")
    return pf.profile_of(members(spark, root, held), created, repos, type_catalog, link_catalog)


def compact(spark: SparkSession, root: str) -> sn.Snapshot:
    """The sums of all landings in place of the landings; the ledger of batches stays."""
    held = sn.latest(spark, root)
    created = sn.read(spark, root, CREATED, held).groupBy("repo", "key", "created").agg(F.sum("n").alias("n")).where("n <> 0")
    parts = {sn.MAIN: [sn.write_part(members(spark, root, held), root)], CREATED: [sn.write_part(created, root, CREATED)]}
    return sn.publish(spark, root, held._replace(version=held.version + 1, parts=parts))
