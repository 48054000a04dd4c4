"""Document fingerprints from closed syncmers, by DataFrame functions alone.

The letters of a text are short runs of its lower-cased characters: a run of letters or of digits ends with
the first of a few rare ones (so texts without spaces have letters too, wherever they begin), each other
character, and each letter of scripts without cases, is a letter of its own. A k-mer is four letters, its
inner substrings are the three pairs of neighbours. It is chosen, as an anchor, if a pair of least hash lies at its
edge, which depends on nothing outside the k-mer: an edit changes only the choices of the k-mers that it
touches. Two markers before and after the text give short texts k-mers too.

Texts match by position: an element of a fingerprint is two neighbouring anchors and the distance between
their positions, so it is shared only by texts that have both anchors at one offset. The fingerprint is
the bottom sketch of the elements' hashes.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, OWN, real_id

SKETCH = 64
#: Letters of a k-mer; the rule below is written for inner substrings of two.
KMER = 4
#: Letters (of scripts with cases) up to one of jqxzkvw, digits up to a 7, else single characters.
_RUN, _DIGITS = r"[\p{L}\p{M}&&[^\p{Lo}jqxzkvw]]", r"[\p{N}&&[^7]]"
_TOKENS = rf"{_RUN}++[jqxzkvw]?+|[jqxzkvw]|\p{{Lo}}|{_DIGITS}++7?+|7|[^\s\p{{L}}\p{{M}}\p{{N}}]"
_MARK = 0x7FEDCBA987654321


def _shift(array: Column, by: int, less: int) -> Column:
    """The elements from ``by`` on, ``less`` fewer than there are; needs that many."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - less, F.lit(0)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: for each k-mer in order its hash if it is a closed syncmer, else null.

    Each step is a column of its own that reads arrays only as arguments, so the work is linear in the
    length of the text and no array is computed again for each element.
    """
    h, s, e = OWN + "h", OWN + "s", OWN + "e"
    mark = F.array(F.lit(_MARK), F.lit(_MARK + 1))
    df = df.withColumn(h, F.concat(mark, F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), 0), lambda t: F.xxhash64(t)), mark))
    df = df.withColumn(s, F.zip_with(_shift(F.col(h), 0, 1), _shift(F.col(h), 1, 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(e, F.zip_with(_shift(F.col(s), 0, 2), _shift(F.col(s), 2, 2), lambda a, b: F.struct(F.least(a, b).alias("edge"), F.xxhash64(a, b).alias("v"))))
    df = df.withColumn(out, F.zip_with(F.col(e), _shift(F.col(s), 1, 2), lambda p, m: F.when(p["edge"] <= m, p["v"])))
    return df.drop(h, s, e)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, anchor): the closed syncmers of every text, by the letter they start at.

    The two markers before the text count as letters -2 and -1. Null and empty texts have the markers'
    k-mer at most. Rows are independent, repeated ones too; extra columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias(OWN + "t"))
    rows = with_anchors(rows, OWN + "t", OWN + "a")
    return rows.select("doc_id", F.posexplode(OWN + "a").alias("position", "anchor")).where("anchor is not null").withColumn("position", F.col("position") - 2)


def with_sketch(df: DataFrame, text: str, out: str, size: int = SKETCH) -> DataFrame:
    """Adds ``out``: the ``size`` least hashes of neighbouring anchors and their distance, or the hash of a text
    with fewer than two anchors."""
    a, d = OWN + "a", OWN + "d"
    df = with_anchors(df, text, a)
    df = df.withColumn(d, F.array_compact(F.transform(a, lambda v, i: F.when(v.isNotNull(), F.struct(v.alias("v"), i.alias("i"))))))
    df = df.withColumn(d, F.array_distinct(F.zip_with(_shift(F.col(d), 0, 1), _shift(F.col(d), 1, 1), lambda x, y: F.xxhash64(x["v"], y["v"], y["i"] - x["i"]))))
    df = df.withColumn(out, F.when(F.size(d) == 0, F.array(F.xxhash64(text))).otherwise(F.slice(F.sort_array(d), 1, size)))
    return df.drop(a, d)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated Jaccard similarity of the sets behind two sketches: the shared part of the least ``size``
    of their union. Exact for sets that fit in a sketch, else with a standard error of 0.0625 at most."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least)


def shown(sketch: Column) -> Column:
    """The sketch as text: eight hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))


def with_next(rows: DataFrame, doc: str, tie: str, *columns: str, buckets: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the row that follows by ``doc`` descending, then ``tie``
    descending; after the last comes the first.

    The ids' quantiles split the rows into buckets, in which they are sorted; an id that is several quantiles
    (null ids, say) has as many buckets, by its rows' ties. Each bucket also gets the
    row that follows its last. Only quantiles and the buckets' first ids come to the driver, as many as
    there are buckets. Rows are shuffled once.
    """
    spark = rows.sparkSession
    n = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = rows.agg(F.percentile_approx(doc, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    splits, times = sorted(set(quantiles)), Counter(quantiles)
    bucket, flag, at, after = OWN + "bucket", OWN + "flag", OWN + "at", OWN + "after"
    number = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s > F.col(doc))) if splits else F.lit(0)
    frequent = [(v, r) for v, r in times.items() if r > 1]
    if frequent:
        high = F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(1 << 63))), 33)
        part = F.lit(0)
        for v, r in frequent:
            part = F.when(F.col(doc) == v, r - F.shiftright(high * r, 31)).otherwise(part)
        number = (number * (max(times.values()) + 1) + part).cast("int")
    firsts = sorted((r[0], *r[1]) for r in rows.select(number.alias(bucket), F.struct(doc, tie).alias("row")).groupBy(bucket).agg(F.max("row")).collect())
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    copied = spark.createDataFrame([(d, t, b) for (_, d, t), b in zip(firsts, before, strict=True)], f"{at} long, {at}t long, {after} int")
    rows = rows.withColumn(bucket, number)
    rows = rows.join(F.broadcast(copied), (F.col(doc) == F.col(at)) & (F.col(tie) == F.col(at + "t")), "left")
    own = F.struct(F.col(bucket).alias("b"), F.lit(0).alias("f"))
    more = F.struct(F.col(after).alias("b"), F.lit(1).alias("f"))
    kept = [c for c in rows.columns if c not in (bucket, at, at + "t", after)]
    rows = rows.select(*kept, F.explode(F.when(F.col(after).isNull(), F.array(own)).otherwise(F.array(own, more))).alias(flag))
    # plain columns and one selection, so that one window over one shuffle gives all the values
    rows = rows.select(*kept, F.col(flag + ".b").alias(bucket), F.col(flag + ".f").alias(at))
    window = Window.partitionBy(bucket).orderBy(at, F.desc(doc), F.desc(tie))
    rows = rows.select(*kept, at, *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return rows.where(F.col(at) == 0).drop(at)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has the last third of the characters (rounded down) replaced by as many, or all,
    from the start of the next document by descending id; after the last comes the first. Null texts
    are empty; null ids come first in that order and stay null; equal ids are ordered by the hash of
    their texts. Equal texts have equal fingerprints, so equal empty texts are alike by 1. A single
    row is its own next document. Extra columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    doc, tie, text, sketch, edited = (OWN + x for x in ("doc", "tie", "text", "sketch", "edited"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias(doc), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    rows = rows.withColumn(tie, F.xxhash64(text))
    rows = with_next(with_sketch(rows, text, sketch), doc, tie, text, sketch)
    size = F.char_length(text)
    cut = F.floor(size / 3).cast("int")
    rows = rows.select(doc, text, sketch, f"next_{sketch}", size.cast("long").alias("n_chars"), F.concat(F.left(text, size - cut), F.left(f"next_{text}", cut)).alias(edited))
    rows = with_sketch(rows, edited, edited + "_sketch")
    return rows.select(
        real_id(doc).alias("doc_id"), "n_chars", F.sha2(edited, 256).alias("edited_sha256"), shown(F.col(sketch)).alias("fingerprint"), shown(F.col(edited + "_sketch")).alias("edited_fingerprint"),
        likeness(F.col(sketch), F.col(edited + "_sketch")).alias("near_edited"), likeness(F.col(sketch), F.col(f"next_{sketch}")).alias("near_next"),
    )
