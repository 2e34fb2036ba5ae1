"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame functions only.

A paragraph (a line, cut further after clause marks so that long lines have parts) hashes to a vector of SIGNS lanes
of +1 or -1 and WIDE lanes of 32 bits. A document's fingerprint is the sum of its paragraphs' vectors, lane by lane
modulo 2**62, with the number of paragraphs in a last lane. The sum does not depend on order, so equal multisets are
equal; adding or taking away a paragraph, or another document, adds or subtracts its vector (`combine`), without the
rest of the text. No text has enough paragraphs for the signs' sums to reach the modulus.

Each sign lane is a random projection of the paragraph counts, so inner products of two fingerprints estimate those of
the counts: `likeness` is 2ab / (aa + bb), 1 for equal ones and about 0 for strangers, with a standard error of
1 / sqrt(SIGNS).

Sums run in packed words, four narrow lanes to a word, which are added to the wide lanes every BLOCK paragraphs,
before a narrow lane can overflow.

Defined cases: null text is empty and sums to zero; two empty texts are alike (1), an empty and another text are not
(0); rows that repeat a doc_id are each given their own result, their successor is the next distinct doc_id with its
least text; a null doc_id comes first; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import carried
from tideline.session import cut

#: Four 64-bit hashes a paragraph; of each, 15 masks pick four bits that lie 15 apart, one to a narrow lane.
SEEDS, SHIFTS, STEP, IN_WORD = range(4), range(15), 15, 4
NARROW = (1 << 14) - 1
ONES = sum(1 << STEP * k for k in range(IN_WORD))
WORDS = len(SEEDS) * len(SHIFTS)
SIGNS, WIDE = WORDS * IN_WORD, 2 * len(SEEDS)
COUNT = SIGNS + WIDE  # place of the number of paragraphs
BLOCK = 8192  # a narrow lane holds twice as many
LOW32, MODULUS = (1 << 32) - 1, (1 << 62) - 1
#: Lines, and parts of lines after clause marks.
BREAK = r"\n+|(?<=[.!?;:,|]) +"
FIRST = -(2**63)


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _packed(h: Column) -> list[Column]:
    """What a paragraph adds: packed bits, halves of its hashes, and one."""
    bits = [F.shiftrightunsigned(h[f"h{s}"], k).bitwiseAND(F.lit(ONES)) for s in SEEDS for k in SHIFTS]
    halves = [x for s in SEEDS for x in (F.shiftrightunsigned(h[f"h{s}"], 32), h[f"h{s}"].bitwiseAND(F.lit(LOW32)))]
    return [*bits, *halves, F.lit(1).cast("long")]


def _spread(narrow: Column) -> Column:
    """The lanes of packed sums: ones less zeros of every sign, the halves, the count."""
    n = narrow[WORDS + WIDE]
    signs = F.transform(F.slice(narrow, 1, WORDS), lambda w: F.array(*[F.shiftright(w, STEP * k).bitwiseAND(F.lit(NARROW)) * 2 - n for k in range(IN_WORD)]))
    return F.concat(F.flatten(signs), F.slice(narrow, WORDS + 1, WIDE + 1))


def vector(text: Column) -> Column:
    """SIGNS signed lanes, WIDE lanes and the number of paragraphs, of one text."""
    paragraphs = F.filter(F.split(text, BREAK), lambda p: p != "")
    hashed = F.transform(paragraphs, lambda p: F.struct(*[F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in SEEDS]))

    def add(acc, h):
        narrow, lanes = acc["narrow"], acc["lanes"]
        full = narrow[WORDS + WIDE] >= BLOCK
        sums = F.zip_with(F.when(full, _zeros(WORDS + WIDE + 1)).otherwise(narrow), F.array(*_packed(h)), lambda x, y: x + y)
        return F.struct(sums.alias("narrow"), F.when(full, combine(lanes, _spread(narrow))).otherwise(lanes).alias("lanes"))

    start = F.struct(_zeros(WORDS + WIDE + 1).alias("narrow"), _zeros(COUNT + 1).alias("lanes"))
    return F.aggregate(hashed, start, add, lambda acc: F.when(acc["lanes"][COUNT] == 0, _spread(acc["narrow"])).otherwise(combine(acc["lanes"], _spread(acc["narrow"]))))


def combine(a: Column, b: Column, take_away: bool = False) -> Column:
    """Fingerprint of two multisets together, or of `a` without the paragraphs of `b`."""
    sign = -1 if take_away else 1
    (a_signs, a_rest), (b_signs, b_rest) = ((F.slice(x, 1, SIGNS), F.slice(x, SIGNS + 1, WIDE + 1)) for x in (a, b))
    whole = F.zip_with(a_rest, b_rest, lambda x, y: (x + y * sign).bitwiseAND(F.lit(MODULUS)))
    return F.concat(F.zip_with(a_signs, b_signs, lambda x, y: x + y * sign), whole)


def text_form(v: Column) -> Column:
    return F.sha2(F.array_join(v.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Estimate of 2ab / (aa + bb) over paragraph counts, within 0 and 1."""
    zero = F.lit(0.0)
    terms = F.zip_with(F.slice(a, 1, SIGNS).cast("array<double>"), F.slice(b, 1, SIGNS).cast("array<double>"), lambda x, y: F.struct((x * y).alias("ab"), (x * x + y * y).alias("sq")))
    return F.aggregate(
        terms,
        F.struct(zero.alias("ab"), zero.alias("sq")),
        lambda acc, t: F.struct((acc["ab"] + t["ab"]).alias("ab"), (acc["sq"] + t["sq"]).alias("sq")),
        lambda s: F.when(s["sq"] == 0, F.lit(1.0)).otherwise(F.greatest(zero, F.lit(2.0) * s["ab"] / s["sq"])),
    )


def successors(ids: DataFrame) -> DataFrame:
    """(id, next): the next larger id of each distinct id, the least after the largest.

    Ids are range-partitioned; only each partition's least id (one row per partition) is looked at across partitions.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.repartitionByRange(4 * parts, "id").withColumn("pid", F.spark_partition_id()))
    heads = ranged.groupBy("pid").agg(F.min("id").alias("head"))
    over = Window.orderBy("pid")
    heads = heads.select("pid", F.coalesce(F.lead("head").over(over), F.min("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("pid").orderBy("id")))
    return inside.join(F.broadcast(heads), "pid").select("id", F.coalesce("next", "after").alias("next"), "n")


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, the vector and its text form."""
    rows = docs.select(*carried(keep, ("vector", "fingerprint")), vector(F.coalesce(F.col(text), F.lit(""))).alias("vector"))
    return rows.withColumn("fingerprint", text_form(F.col("vector")))


def compare_with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text keeps the first characters and takes its last floor(n / 2) from the start of the next document.
    Texts are shuffled once by id and their starts once more to the document before.
    """
    kind = docs.schema[doc_id].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if not whole:
        raise TypeError("doc_id must be an integer column")
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("id"), t.alias("text"))
    ids = own.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    before = successors(ids).select(F.col("next").alias("id"), F.col("id").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    own = own.withColumn("vector", vector(F.col("text")))
    sent = own.join(before, "id").select(F.col("to").alias("id"), F.struct(F.substring(F.col("text"), F.lit(1), F.col("take")).alias("tail"), F.col("vector").alias("next")).alias("s"))
    sent = sent.groupBy("id").agg(F.min("s").alias("s"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = own.join(sent, "id").select(
        F.when(F.col("id") == FIRST, F.lit(None)).otherwise(F.col("id")).cast(kind).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "vector",
        F.col("s.next").alias("next"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("s.tail"), F.lit(1), half)).alias("edited"),
    )
    done = both.select("doc_id", "n_chars", "vector", "next", F.sha2("edited", 256).alias("edited_sha256"), F.array(vector(F.col("edited"))).alias("e"))
    done = done.select("doc_id", "n_chars", "edited_sha256", "vector", "next", F.explode("e").alias("edited"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("vector")).alias("fingerprint"),
        text_form(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next")).alias("near_next"),
    )
