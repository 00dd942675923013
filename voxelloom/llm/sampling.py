"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, cap: int | None, among: Column | None = None) -> DataFrame:
    """(doc_id, label, and the columns of ``docs``): one row for each of about ``cap`` labelled ids outside the held-out fold.

    ``labels`` may repeat an id: the largest label counts, null labels do not. So may ``docs``: the smallest row of an id
    counts. ``among`` is a further condition on the id. Above ``cap`` labelled ids an even share by hash of the id is
    taken, and only its ids, at most about ``cap``, are broadcast; without ``cap`` all labelled ids are met.
    """
    known = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known if among is None else known.filter(among)
    if cap is not None:
        n = known.count()
        if n > cap:
            known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < int(_STEPS * cap / n))
        known = F.broadcast(known)
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select("doc_id", "label", "_row.*")
