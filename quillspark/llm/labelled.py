"""Bounded labelled samples and the split by document id that both classifiers use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


#: Bytes of text that a fit takes to the driver at most; rows past it, in the order of the ids' hash, are left out.
SAMPLE_BYTES = 48 << 20
#: A text of more than this part of those bytes waits until all others had their turn, so that no text keeps the others out.
LARGE = 16


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int, most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``bound`` allowed rows and ``most_bytes`` bytes, by id.

    Rows with a null id or label teach nothing. Texts of more than a sixteenth of ``most_bytes`` come last,
    the smallest first, and teach as far as the others leave room. Of labels that repeat an id the largest counts, of texts
    that repeat an id the smallest. Both bounds hold before anything is collected.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).where(allowed)
    ids = ids.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``bound`` ids
    rows = rows.groupBy("doc_id", "at", "y").agg(F.min("text").alias("text"))  # at most ``bound`` rows from here on
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = rows.select("doc_id", "at", size.alias("size"))  # no text goes through the window
    turn = F.when(F.col("size") > most_bytes // LARGE, F.col("size")).otherwise(0)
    before = F.sum("size").over(W.orderBy(turn, "at", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = sizes.withColumn("so_far", before).where(F.col("so_far") <= most_bytes).select("doc_id")
    t = rows.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "y").toArrow()
    order = pa.compute.sort_indices(t, [("doc_id", "ascending")])
    y = (t.column("y").take(order).to_numpy() > 0).astype(np.int8)
    return t.column("text").take(order).combine_chunks(), y
