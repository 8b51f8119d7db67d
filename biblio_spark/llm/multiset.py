"""Homomorphic multiset fingerprints of documents: sums of wide vectors hashed from paragraphs.

The vector of a paragraph has two halves. The first is ``WIDE`` numbers modulo 2^32 hashed from the whole paragraph; sums of
them tell multisets of paragraphs apart. The second is ``SIGNS`` numbers modulo 2^20, for each of which every run of three words
of the paragraph counts +1 or -1 by one bit of its hash; the distance of two sums estimates how many runs they do not share. A
fingerprint is the sum over the paragraphs, so their order does not matter, and a paragraph is inserted or deleted by
adding or subtracting its vector, without the rest of the text.

All steps are DataFrame functions. The hash is XXH64, which is fast but not proof against texts made to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.storage import materialize, release

WIDE, WIDE_BITS = 16, 32
SIGNS, SIGN_BITS = 64, 20
#: Words of one run.
RUN = 3

_LOW32 = 0xFFFFFFFF
#: The lowest bit of either half of a 64-bit number.
_TWO = 0x100000001


def _runs(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each run of words of each paragraph: keys, the paragraph, the run's place in it and hash, the paragraph's number of words.
    Line feeds part paragraphs, spaces words; a paragraph of fewer than three words has one run of all, one without words (or an
    empty text) one row that counts nothing."""
    rows = texts.select(*keys, F.explode(F.split(text, "\n")).alias("_paragraph"))
    rows = rows.select(*keys, "_paragraph", F.filter(F.split("_paragraph", " "), lambda w: w != "").alias("_words"))
    run = lambda i: F.xxhash64(*(F.get("_words", i + F.lit(d)) for d in range(RUN)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - RUN, F.lit(0)))
    return rows.select(*keys, "_paragraph", F.size("_words").alias("_size"), F.posexplode(F.transform(starts, run)).alias("_place", "_h"))


_TOTALS = [*(f"_w{i}" for i in range(WIDE)), *(f"_b{i}" for i in range(SIGNS // 2)), "_runs"]


def _totals(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and _TOTALS: the sums over the paragraphs of the texts with equal keys."""
    rows = _runs(texts, keys, text)
    none = F.lit(0).cast("long")
    hashed = [F.xxhash64(F.lit(i), "_paragraph") for i in range(WIDE // 2)]
    halves = [h for x in hashed for h in (x.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(x, 32))]
    counts = (F.col("_place") == 0) & (F.col("_paragraph") != "")
    wide = [F.sum(F.when(counts, h).otherwise(none)) for h in halves]
    # two counters in one number: no text has 2^31 words
    bits = [F.sum(F.when(F.col("_size") > 0, F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_TWO))).otherwise(none)) for i in range(SIGNS // 2)]
    runs = F.sum((F.col("_size") > 0).cast("long"))
    return rows.groupBy(*keys).agg(*(c.alias(n) for c, n in zip([*wide, *bits, runs], _TOTALS, strict=True)))


def _vector(total) -> Column:
    """The fingerprint from ``total(name)`` for each of _TOTALS: sums modulo 2^32 and, for each bit, runs that have it less runs that have
    not, modulo 2^20."""
    low = [total(f"_b{i}").bitwiseAND(F.lit(_LOW32)) for i in range(SIGNS // 2)]
    high = [F.shiftrightunsigned(total(f"_b{i}"), 32) for i in range(SIGNS // 2)]
    signs = [(2 * b - total("_runs")).bitwiseAND(F.lit((1 << SIGN_BITS) - 1)).cast("int") for b in low + high]
    return F.struct(F.array(*(total(f"_w{i}").bitwiseAND(F.lit(_LOW32)) for i in range(WIDE))).alias("wide"), F.array(*signs).alias("signs"))


def _reduced(wide: Column, signs: Column) -> Column:
    return F.struct(
        F.transform(wide, lambda x: x.bitwiseAND(F.lit(_LOW32))).alias("wide"),
        F.transform(signs, lambda x: x.bitwiseAND(F.lit((1 << SIGN_BITS) - 1))).alias("signs"),
    )


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _reduced(F.zip_with(a["wide"], b["wide"], lambda x, y: x + y), F.zip_with(a["signs"], b["signs"], lambda x, y: x + y))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it holds."""
    return _reduced(F.zip_with(a["wide"], b["wide"], lambda x, y: x - y), F.zip_with(a["signs"], b["signs"], lambda x, y: x - y))


def _centred(x: Column) -> Column:
    """A number modulo 2^SIGN_BITS as the one nearest to zero."""
    half = 1 << (SIGN_BITS - 1)
    return (x + F.lit(half)).bitwiseAND(F.lit(2 * half - 1)) - F.lit(half)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 less the share of word runs that only one of both has, as the sign sums estimate it from the squared norm of their
    difference (standard error of the norm 18 %). Equal fingerprints have 1, also those without words."""
    square = lambda v: F.aggregate(F.transform(v, lambda x: _centred(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x * x)
    apart = square(F.zip_with(a["signs"], b["signs"], lambda x, y: x - y))
    both = square(a["signs"]) + square(b["signs"])
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def as_text(a: Column) -> Column:
    """A fingerprint as lower-case hex digits, 8 a wide number and 5 a sign sum."""
    digits = lambda values, n: F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(a["wide"], WIDE_BITS // 4), digits(a["signs"], SIGN_BITS // 4)))


def fingerprints(docs: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """keys and fp of every combination of ``keys``: the fingerprint of the paragraphs of all its rows together. Null and empty texts
    have none and add nothing; null keys are a group. Sums are taken before the shuffle, so a group of any size is no burden."""
    texts = docs.select(*keys, F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("_text"))
    return _totals(texts, keys, "_text").select(*keys, _vector(F.col).alias("fp"))


#: A document by what may repeat or be null: its id and a hash of its text.
_KEY = ["_id", "_none", "_hash"]
_NEXT = ["_next_id", "_next_none", "_next_hash"]


def _following(ids: DataFrame) -> DataFrame:
    """``ids`` with the key of the next document in descending id order (null ids last, equal ids by hash), the first after the last.

    Ids are dealt by ranges and written with the number of their range; within a range the next row follows. A range's last row is
    followed by the first row of the next range, one row a range."""
    order = [F.col("_none").asc(), F.col("_id").desc(), F.col("_hash").asc()]
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialize(ids.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*_KEY)
    ahead = F.lead(key).over(W.partitionBy("_range").orderBy(*order))
    # least by (none, -id, hash): ids are compared as decimals, which -id cannot leave
    first = F.min(F.struct("_none", (-F.col("_id").cast("decimal(20,0)")).alias("d"), "_hash", "_id"))
    firsts = sorted(placed.groupBy("_range").agg(first.alias("f")).collect(), key=lambda r: r["_range"])  # a row for each range
    if not firsts:
        return placed.drop("_range").withColumns({n: F.col(k) for n, k in zip(_NEXT, _KEY, strict=True)})
    after = [(r["_range"], s["f"]) for r, s in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    rows = [(n, f["_id"], f["_none"], f["_hash"]) for n, f in after]
    starts = ids.sparkSession.createDataFrame(rows, "_range int, _f_id long, _f_none boolean, _f_hash long")
    out = placed.withColumn("_ahead", ahead).join(F.broadcast(starts), "_range")
    picked = {n: F.when(F.col("_ahead").isNull(), F.col(f"_f{k}")).otherwise(F.col(f"_ahead.{k}")) for n, k in zip(_NEXT, _KEY, strict=True)}
    return out.withColumns(picked).drop("_range", "_ahead", "_f_id", "_f_none", "_f_hash")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending id order, the first after the last. Its fingerprint is the text's own less the paragraphs from
    the cut one on, and with those that take their place, so what stays is never hashed twice. Null texts are empty. Null ids
    come last, rows of one id follow the hashes of their texts, rows equal in id and text are one document in that order and
    each give the same row; a single document is its own next. Other columns are left aside. An empty table gives an empty one.

    Next documents are found on ids and hashes alone. Texts are dealt once, by key; the beginnings that next documents lend (a
    third of the text) once more. Sums are complete in the task that has the text.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    number = docs[id_column].cast("long")
    rows = docs.select(
        F.coalesce(number, F.lit(0)).alias("_id"), number.isNull().alias("_none"), F.xxhash64(F.lit("text"), text).alias("_hash"), text.alias("_text")
    )
    ids = rows.select(*_KEY, F.length("_text").cast("long").alias("_n")).groupBy(*_KEY).agg(F.max("_n").alias("_n"), F.count("*").alias("_copies"))
    chain = materialize(_following(ids), "chain")
    texts = rows.select(*_KEY, "_text")
    if not chain.where("_copies > 1").isEmpty():
        texts = texts.dropDuplicates(_KEY)
    asked = chain.select(*_KEY, "_n", "_copies", *_NEXT)
    lent = texts.select(*(F.col(k).alias(n) for k, n in zip(_KEY, _NEXT, strict=True)), F.col("_text").alias("_other"))
    # the hints keep a lender's texts from being sent whole to every task
    loans = lent.hint("merge").join(asked, _NEXT).select(*_KEY, *_NEXT, "_n", "_copies", F.expr("substring(_other, 1, cast(_n div 3 as int))").alias("_lent"))
    met = texts.hint("merge").join(loans, _KEY)
    stay = F.expr("substring(_text, 1, cast(_n - _n div 3 as int))")
    met = met.withColumn("_stay", stay).withColumn("_sha", F.sha2(F.concat("_stay", "_lent"), 256))
    # 1: paragraphs that end before the cut, 2: the text from there on, 3: what takes its place
    met = met.withColumn("_back", F.locate("\n", F.reverse("_stay")))
    met = met.withColumn("_at", F.when(F.col("_back") > 0, F.length("_stay") - F.col("_back") + 1).otherwise(0))
    parts = F.array(
        F.struct(F.lit(1).alias("part"), F.expr("substring(_text, 1, _at)").alias("t")),
        F.struct(F.lit(2).alias("part"), F.expr("substring(_text, _at + 1)").alias("t")),
        F.struct(F.lit(3).alias("part"), F.concat(F.expr("substring(_stay, _at + 1)"), F.col("_lent")).alias("t")),
    )
    own = [*_KEY, *_NEXT, "_n", "_copies", "_sha"]
    sums = _totals(met.select(*own, F.explode(parts).alias("p")).select(*own, "p.part", "p.t"), [*own, "part"], "t")
    # by the vectors' sums: own text = 1 + 2; with the paragraphs of 2 deleted and those of 3 inserted, 1 + 3
    both = [F.sum(F.when(F.col("part") != out, F.col(n)).otherwise(0)).alias(f"{n}_{name}") for n in _TOTALS for out, name in ((3, "own"), (2, "edited"))]
    done = sums.groupBy(*own).agg(*both)
    vectors = [_vector(lambda n, name=name: F.col(f"{n}_{name}")).alias(name) for name in ("own", "edited")]
    done = materialize(done.select(*own, *vectors), "fingerprints")
    after = done.select(*(F.col(k).alias(n) for k, n in zip(_KEY, _NEXT, strict=True)), F.col("own").alias("after"))
    out = done.join(after, _NEXT).select(
        F.when(~F.col("_none"), F.col("_id")).alias("doc_id"),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        F.col("own").alias("fp"),
        F.col("edited").alias("edited_fp"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"),
    )
    return out.drop("_copy")
