"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of
``SAMPLES`` functions, every term draws r and c from Gamma(2, 1) and b from
Uniform(0, 1), fixed by hashes of the term and the function alone; with
t = floor(ln(weight) / r + b) the term's value is ln(c) - r * (t - b + 1), and the
function samples the term of the least value, with its t. Two texts' samples
agree with a probability of their generalised Jaccard similarity
(sum of smaller weights over sum of larger ones), so that the share of equal
samples estimates it. The least value stands for its sample: it depends on term
and t alone, and 32 bits of its hash are kept.

Native: words, counts and values are DataFrame expressions; values are the
arguments of plain minima, which stay within generated code. A text's terms
never leave its task; only fingerprints do.

Defined results: a null text counts as empty; an empty text's fingerprint is
empty, with likeness 1 to an empty text and 0 to others. Equal texts have equal
fingerprints. A null id counts as the least one. Repeated rows are computed once and
given as often as they occur; where texts share an id, the id's least text is the next
document's. An empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import Workspace, named
from loomline.llm.quality import words_of

SAMPLES = 32
_NO_ID = -(1 << 63)
_LOW = (1 << 32) - 1


def term_counts(text: Column) -> tuple[Column, Column, Column]:
    """Stages of an array of (h, n): the hash of each distinct word and how often it occurs.

    To be put in columns one after another: sorted word hashes (``_sorted``), places where a
    new one starts (``_starts``), and the array.
    """
    hashes = F.sort_array(F.transform(words_of(text), lambda w: F.xxhash64(w)))
    starts = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    starts = F.when(F.size("_sorted") > 0, starts).otherwise(F.array().cast("array<int>"))
    counts = F.transform("_starts", lambda s, j: F.struct(F.get("_sorted", s).alias("h"), (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - s).alias("n")))
    return hashes, starts, counts


def sample_value(h: Column, log_weight: Column, k: int) -> Column:
    """The value of a term for function k; the term of the least one is sampled."""
    bits = [F.xxhash64(h, F.lit(3 * k + j)) for j in range(3)]
    half = lambda x: ((F.shiftrightunsigned(x, 32) + 0.5) * 2.0**-32, (x.bitwiseAND(F.lit(_LOW)) + 0.5) * 2.0**-32)
    (u, v), (w, x) = half(bits[0]), half(bits[1])
    r, c = -F.log(u * v), -F.log(w * x)
    b = (F.shiftrightunsigned(bits[2], 11) + 0.5) * 2.0**-53
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1)


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, samples): an array of 32-bit samples (null for a text without words) for each distinct keys.

    If ``texts`` is already distributed by some of the keys, nothing is shuffled.
    """
    hashes, starts, counts = term_counts(F.col(text))
    a = texts.select(*keys, hashes.alias("_sorted"))
    a = a.select("*", starts.alias("_starts")).select(*keys, counts.alias("_terms"))
    a = a.select(*keys, F.explode_outer("_terms").alias("_term")).select(*keys, F.col("_term.h").alias("_h"), F.log(F.col("_term.n").cast("double")).alias("_w"))
    least = a.groupBy(*keys).agg(*(F.min(sample_value(F.col("_h"), F.col("_w"), k)).alias(f"_m{k}") for k in range(samples)))
    kept = F.transform(F.array(*(f"_m{k}" for k in range(samples))), lambda m: F.xxhash64(m).bitwiseAND(F.lit(_LOW)).cast("long"))
    return least.select(*keys, F.when(F.col("_m0").isNotNull(), kept).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the texts' generalised Jaccard similarity."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal).cast("double")


def printed(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def next_ids(ids: DataFrame, space: Workspace) -> DataFrame:
    """(_k, _next): each distinct id with the next smaller one; the least one with the greatest.

    Ids are range-partitioned; each range finds its own pairs, and a row for each range links the ranges.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = space.table("ids", ids.distinct().repartitionByRange(n, F.col("_k").desc()).withColumn("_part", F.spark_partition_id()))
    inner = ranged.withColumn("_next", F.lead("_k").over(W.partitionBy("_part").orderBy(F.col("_k").desc())))
    heads = ranged.groupBy("_part").agg(F.max("_k").alias("_head"))
    after = heads.select("_part", F.lead("_head").over(W.orderBy("_part")).alias("_after"), F.max("_head").over(W.partitionBy()).alias("_first"))
    return inner.join(after, "_part").select("_k", F.coalesce("_next", "_after", "_first").alias("_next"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, and likenesses to the edited text and to the next document.

    The edited text has the last third (rounded down) of its code points replaced by as many first ones (or all) of the next document, by descending id.
    """
    space = Workspace(docs.sparkSession, "fingerprints")
    own = docs.select(F.coalesce(named(doc_id).cast("long"), F.lit(_NO_ID)).alias("_k"), F.coalesce(named(text), F.lit("")).alias("_t"))
    third = F.floor(F.length("_t") / 3).cast("int")
    chain = space.table("chain", next_ids(own.select("_k"), space).join(own.groupBy("_k").agg(F.max(third).alias("_most")), "_k"))
    asked = chain.select(F.col("_next").alias("_k"), F.col("_k").alias("_for"), "_most")
    # both joins deal out the same (_k, _t): one exchange of the texts
    pieces = own.join(asked, "_k").select("_for", F.substring("_t", F.lit(1), F.col("_most")).alias("_piece")).groupBy("_for").agg(F.min("_piece").alias("_piece"))
    both = own.join(pieces.withColumnRenamed("_for", "_k"), "_k")
    edited = F.concat(F.substring("_t", F.lit(1), F.length("_t") - third), F.substring("_piece", F.lit(1), third))
    both = both.select("_k", F.length("_t").cast("long").alias("_n"), F.xxhash64("_t").alias("_x"), "_t", edited.alias("_e"))
    both = both.select("_k", "_n", "_x", F.sha2("_e", 256).alias("_sha"), F.inline(F.array(F.struct(F.lit(0).alias("_which"), F.col("_t").alias("_text")), F.struct(F.lit(1).alias("_which"), F.col("_e").alias("_text")))))
    found = fingerprints(both, ["_k", "_n", "_x", "_sha", "_which"], "_text", samples)
    found = found.groupBy("_k", "_n", "_x", "_sha").agg(F.max(F.when(F.col("_which") == 0, F.col("samples"))).alias("_f"), F.max(F.when(F.col("_which") == 1, F.col("samples"))).alias("_g"))
    found = space.table("found", found)
    repeated = own.groupBy("_k", F.length("_t").cast("long").alias("_n"), F.xxhash64("_t").alias("_x")).agg(F.count("*").alias("_times")).where("_times > 1")
    following = found.groupBy("_k").agg(F.min(F.struct("_n", "_x", "_f"))["_f"].alias("_h")).withColumnRenamed("_k", "_next")
    out = found.join(chain.select("_k", "_next"), "_k").join(following, "_next")
    out = out.join(repeated, ["_k", "_n", "_x"], "left").withColumn("_time", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)))))
    return out.select(
        F.nullif("_k", F.lit(_NO_ID)).alias(doc_id),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        printed(F.col("_f")).alias("fingerprint"),
        printed(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_h")).alias("near_next"),
    )
