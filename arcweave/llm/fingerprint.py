"""Canonical exact fingerprints of documents.

DataFrame functions only: the Unicode normaliser is the ICU class that Spark itself
ships with, called on the JVM side through the SQL function ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import indexed
from .common import Scratch


def canonical(text: F.Column) -> F.Column:
    """Compatibility-composed (NFKC), case-folded text; runs of Unicode white space become one space, ends are trimmed.

    Folding may leave what is not composed, so the text is composed before and after.
    Spark counts ``reflect`` as non-deterministic: put it in a projection of its own,
    ahead of aggregates and windows.
    """
    composed = lambda t: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"(?U)\s+", " "))


def wide_hash(text: F.Column) -> F.Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 with independent seeds."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), text))), 16, "0") for seed in ("first", "second")])


def collided_texts(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Canonical texts that share a wide hash with another canonical text.

    ``rows``: __h (hash) and __canon.  Each hash's least and greatest canonical text
    are compared byte by byte; map-side partial aggregation makes one row a hash and
    task of any group of copies.  Returns None if every bucket holds one text, else
    __dh, __dc and __rank, the rank (1 on) of a text in its bucket.
    """
    mixed = rows.groupBy("__h").agg(F.min("__canon").alias("lo"), F.max("__canon").alias("hi")).filter("lo <> hi")
    mixed = scratch.keep(mixed.select(F.col("__h").alias("__dh")), "collisions")
    if mixed.isEmpty():
        return None
    several = rows.join(mixed, F.col("__h") == F.col("__dh"), "left_semi").distinct()
    return several.select(F.col("__h").alias("__dh"), F.col("__canon").alias("__dc"), F.row_number().over(Window.partitionBy("__h").orderBy("__canon")).alias("__rank"))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds ``out``: equal for two rows exactly if their canonical texts have equal bytes.

    Rows are grouped by a wide hash of the canonical text and compared byte by byte
    inside equal buckets; where a bucket holds several texts, each text's rank is
    appended, so a hash collision can't join two texts.  Null text counts as empty; an
    empty table gives an empty result; all columns of ``docs`` stay, whatever their
    names (but ``out``, which is replaced).
    """
    names = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*names).alias("__row"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("__canon"))
    rows = rows.withColumn("__h", wide_hash(F.col("__canon")))
    apart = collided_texts(rows.select("__h", "__canon"), Scratch(docs.sparkSession, "fingerprint"))
    rank = F.lit("")
    if apart is not None:
        rows = rows.join(apart, (F.col("__h") == F.col("__dh")) & (F.col("__canon") == F.col("__dc")), "left")
        rank = F.coalesce(F.concat(F.lit("-"), F.col("__rank").cast("string")), F.lit(""))
    return rows.select("__row.*", F.concat("__h", rank).alias(out))


def _ring(own: DataFrame, scratch: Scratch) -> DataFrame:
    """Every distinct row and its neighbours in ascending doc_id, the last one's next being the first.

    ``own``: k1, k2 (name of a row: hashes of id and text), doc_id, n_chars, __h and
    __rank.  Rows hold no texts.  Equal rows are one, with their number as ``times``.
    Rows are numbered from range partitions and meet by number, so no task needs more
    than its share.  Rows of one id follow each other by name; a null id sorts first.
    Adds next_h and next_rank, and of the row before its name (p1, p2) and length.
    """
    rows = own.groupBy("k1", "k2").agg(F.count("*").alias("times"), F.any_value("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.any_value("__h").alias("__h"), F.any_value("__rank").alias("__rank"))
    rows = scratch.keep(indexed(rows, ["doc_id", "k1", "k2"], "at"), "ring")
    n = F.lit(max(1, rows.count()))
    after = rows.select(F.pmod(F.col("at") - 1, n).alias("at"), F.col("__h").alias("next_h"), F.col("__rank").alias("next_rank"))
    before = rows.select(F.pmod(F.col("at") + 1, n).alias("at"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_chars").alias("p_chars"))
    return scratch.keep(rows.join(after, "at").join(before, "at").drop("at"), "neighbours")


def _quarter(n: F.Column) -> F.Column:
    return F.floor(n / 4).cast("int")


def edited_texts(docs: DataFrame, ring: DataFrame) -> DataFrame:
    """Rows of ``ring`` with their text and edited text, each as often as it occurs.

    ``docs``: k1, k2, text.  A row sends the row before it the few code points that its
    edited text takes; whole texts move once, to the task of their name.
    """
    texts = docs.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(ring, ["k1", "k2"])
    heads = texts.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), _quarter(F.col("p_chars"))).alias("head"))
    both = texts.join(heads, ["k1", "k2"])
    # Of equal rows all but the last are followed by themselves.
    both = both.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy", "zero"))
    q = _quarter(F.col("n_chars"))
    last = F.col("copy") == 0
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - q), F.when(last, F.col("head")).otherwise(F.substring("text", F.lit(1), q)))
    same = (F.col("__h") == F.col("next_h")) & (F.col("__rank") == F.col("next_rank"))
    return both.withColumn("edited", edited).withColumn("near_next", (~last | same).cast("double")).drop("head", "copy", "zero", "times")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document in ascending id.  Ids may be of any orderable
    type; a null id sorts first; rows of one id follow each other by a hash of id and
    text, and a single row is followed by itself.  Null text counts as empty; an empty
    table gives an empty result; other columns, whatever their names, are not read.
    An exact digest has no degrees: likeness is 1.0 for equal canonical texts, else
    0.0, and equal hashes are confirmed on the bytes.  Rank suffixes of collided
    buckets are as in :func:`fingerprint_documents`.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(*[F.xxhash64(F.lit(seed), "doc_id", "text").alias(k) for k, seed in (("k1", "third"), ("k2", "fourth"))], "doc_id", "text")
    own = rows.withColumn("__canon", canonical(F.col("text"))).withColumn("__h", wide_hash(F.col("__canon")))
    apart = collided_texts(own.select("__h", "__canon"), scratch)
    if apart is None:
        own = own.withColumn("__rank", F.lit(""))
    else:
        own = own.join(apart, (F.col("__h") == F.col("__dh")) & (F.col("__canon") == F.col("__dc")), "left")
        own = own.withColumn("__rank", F.coalesce(F.concat(F.lit("-"), F.col("__rank").cast("string")), F.lit("")))
    ring = _ring(own.select("k1", "k2", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "__h", "__rank"), scratch)
    out = edited_texts(rows.select("k1", "k2", "text"), ring)
    out = out.withColumn("__ec", canonical(F.col("edited"))).withColumn("__eh", wide_hash(F.col("__ec")))
    # The canonical text is formed again only where the hashes agree.
    near = F.when(F.col("__h") == F.col("__eh"), (canonical(F.col("text")) == F.col("__ec")).cast("double")).otherwise(F.lit(0.0))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.concat("__h", "__rank").alias("fingerprint"), F.col("__eh").alias("edited_fingerprint"), near.alias("near_edited"), "near_next", *([] if apart is None else ["__ec"]))
    if apart is not None:
        out = out.join(apart, (F.col("edited_fingerprint") == F.col("__dh")) & (F.col("__ec") == F.col("__dc")), "left")
        out = out.withColumn("edited_fingerprint", F.concat("edited_fingerprint", F.coalesce(F.concat(F.lit("-"), F.col("__rank").cast("string")), F.lit("")))).drop("__dh", "__dc", "__rank", "__ec")
    return out


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
