"""Mixing sources to target weights by Efraimidis-Spirakis sampling with complete epochs first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, OWN, RANK, Cuts, bounded_batches, keyed, numbered, real_id

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Rows of a source whose sampling keys are sorted and summed together; larger sources have more buckets.
BUCKET_ROWS = 4096
SEED = 17
_LETTERS = K.bytes_table((65, 90), (97, 122), (128, 255))


def _sizes(batches):
    """(key, doc, source, text) to (key, doc, source, size, quality): the words of the whole text, and a
    weight from 0.1 to 1 by the share of letters among the bytes of its words."""
    for b in batches:
        data, offsets = K.utf8(b.column(b.num_columns - 1))
        starts, ends, by_text = K.word_spans(data, offsets, K.SPACE)
        inside = np.append(0, np.cumsum(ends - starts))
        seen = np.diff(inside[by_text])
        letters = np.append(0, np.cumsum(_LETTERS[data], dtype=np.int64))
        share = np.diff(letters[offsets]) / np.maximum(seen, 1)
        quality = np.clip(share, 0.1, 1.0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(by_text)), pa.array(quality)], ["key", "doc", "source", "size", "quality"])


def source_targets(cuts: Cuts, sizes: DataFrame, weights=WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """(source, rows, source_size, target) from (source, rows, source_size).

    Sources in code point order, null last, have the weights in turn. All words are shared by weight;
    a target stops at ``most`` times its source's size and the rest is shared again among the others
    until none is above. The driver sees two sums for each round, never the sources.
    """
    ordered = numbered(cuts, sizes.withColumn("none", F.col("source").isNull()), "none", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col(RANK) % len(weights) + 1).cast("int"))
    rows = cuts.write(ordered.select("source", "rows", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    rate = -1.0
    while True:
        capped = F.col("w") * rate > F.col("cap") if rate >= 0 else F.lit(False)
        taken, open_ = rows.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        new = (total - (taken or 0.0)) / open_ if open_ else rate
        if new == rate or not open_:
            break
        rate = new
    return rows.select("source", "rows", "source_size", F.least(F.col("w") * rate, "cap").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MAX_EPOCHS, seed: int = SEED, keep_key: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row: the words that the mix takes.

    Each source's target is met by whole epochs of all its documents, then by a sample without
    replacement: keys -ln(u) / quality with u from the hash of id, text and seed, in ascending order,
    until the budget is met as nearly as whole documents can (a document is taken if at least half of
    it fits). Keys fall into buckets by their size; a prefix sum runs over the buckets' sums and one
    within each bucket, so no source is sorted in one task. Null and empty texts have size 0 and take
    nothing; null ids stay null; a null source is a source; repeated rows are documents of their own
    and tie in their key. An empty table gives an empty result. Reruns agree.
    """
    cuts = Cuts(docs.sparkSession, "mixing")
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, F.col(source_col).cast("string").alias("source"))
    rows = cuts.write(rows.mapInArrow(_sizes, "key long, doc long, source string, size long, quality double"))
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    targets = source_targets(cuts, sizes, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = cuts.write(targets.withColumnRenamed("source", "from"))

    bits = F.shiftrightunsigned(F.xxhash64("key", "doc", F.lit(seed)), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    drawn = rows.join(targets, F.col("source").eqNullSafe(F.col("from"))).withColumn("draw", -F.log(uniform) / F.col("quality"))
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    drawn = drawn.withColumn("bucket", F.least(F.floor(buckets * (1 - F.exp(-F.col("draw")))), buckets - 1).cast("long"))
    sums = drawn.groupBy("from", "bucket").agg(F.sum("size").alias("in_bucket"))
    across = Window.partitionBy("from").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("from").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy("from", "bucket").orderBy("draw", "key", "doc").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("near", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    drawn = drawn.join(sums, F.col("from").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    extra = (F.col("before") + F.col("near") + F.col("size") / 2 <= F.col("budget")) & (F.col("size") > 0) & (F.col("epochs") < most)
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    out = [real_id("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")]
    return drawn.select(*[F.col("key").alias(KEY)] * keep_key, *out)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with their text and copies; rows that it doesn't take are left out.

    Rows equal in id and text share the larger number of copies where the budget ends between them."""
    mixed = mix_sources(docs, id_col, text_col, source_col, keep_key=True).where("copies > 0")
    mixed = mixed.groupBy(KEY).agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("taken").alias("taken"), F.max("copies").alias("copies"))
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    key = keyed(docs, id_col, text_col, *[c.alias(OWN + "c" + str(i)) for i, c in enumerate(own.values())])
    both = key.join(mixed, KEY)
    return both.select(*[F.col(OWN + "c" + str(i)).alias(c) for i, c in enumerate(own)], *[c for c in mixed.columns if c != KEY and c not in own])
