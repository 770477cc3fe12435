"""Document fingerprints by a homomorphic multiset hash, with DataFrame operations only.

A paragraph (line) hashes to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo powers of two. So the order of paragraphs does not matter, and a paragraph is put in or taken out by adding
or subtracting its vector. The vector has EXACT lanes modulo 2^32, hashes of the whole paragraph, which tell equality; and
LANES lanes modulo 2^16, in which each run of WORDS words of the paragraph counts +1 or -1 in one lane. The cosine of two
documents' LANES (a count sketch) estimates that of their multisets of runs: their likeness.

A fingerprint is a map from lane to value, without zeros; its string form lists the EXACT lanes, then the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm._common import Workspace, input_bytes, table

LANES, EXACT, WORDS = 128, 8, 3
#: Bytes of input for each shuffle partition, and ranges of doc_id for each partition.
PARTITION_BYTES, RANGES = 8 << 20, 8
#: The key of a null doc_id: before all others.
NULL_KEY = -(1 << 63)


def units(paragraph: Column) -> Column:
    """A paragraph's vector as an array of (lane, v): lanes below LANES from its runs of words, then the EXACT lanes."""
    def runs(words: Column) -> Column:
        many = F.size(words) >= WORDS
        starts = F.sequence(F.lit(0), F.when(many, F.size(words) - WORDS).otherwise(F.lit(0)))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
        return F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(LANES)).cast("int").alias("lane"), (F.lit(1) - 2 * F.shiftrightunsigned(h, 63)).cast("long").alias("v")))

    # The words are bound as a lambda's variable, so that the line is split once. A line of fewer words is one run.
    signed = F.get(F.transform(F.array(F.split(paragraph, " ")), runs), 0)
    wide = [F.xxhash64(F.lit(k), paragraph) for k in range(EXACT // 2)]
    parts = [F.struct(F.lit(LANES + 2 * k + j).alias("lane"), (F.shiftrightunsigned(h, 32) if j else h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v")) for k, h in enumerate(wide) for j in (0, 1)]
    return F.concat(signed, F.array(*parts))


def reduced(lane: Column, v: Column) -> Column:
    """A lane's sum modulo its power: 0 to 2^32 - 1 for EXACT lanes, -2^15 to 2^15 - 1 for the others."""
    return F.when(lane >= LANES, F.pmod(v, F.lit(1 << 32))).otherwise(F.pmod(v + (1 << 15), F.lit(1 << 16)) - (1 << 15))


def as_map(entries: Column) -> Column:
    kept = F.filter(F.transform(entries, lambda x: F.struct(x["lane"].alias("lane"), reduced(x["lane"], x["v"]).alias("v"))), lambda x: x["v"] != 0)
    return F.map_from_entries(F.array_sort(kept))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint a with the paragraphs of b put in (sign 1) or taken out (-1)."""
    sums = F.map_zip_with(a, b, lambda k, x, y: reduced(k, F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0))))
    return F.map_filter(sums, lambda k, v: v != 0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if equal, else the cosine of the LANES lanes, not below 0."""
    square = lambda m: F.aggregate(F.map_values(F.map_filter(m, lambda k, v: k < LANES)), F.lit(0).cast("long"), lambda s, v: s + v * v)
    products = F.map_zip_with(a, b, lambda k, x, y: F.when(k < LANES, F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    dot = F.aggregate(F.map_values(products), F.lit(0).cast("long"), lambda s, v: s + v)
    norm = F.sqrt(square(a).cast("double")) * F.sqrt(square(b).cast("double"))
    return F.when(F.map_entries(a) == F.map_entries(b), 1.0).when(norm == 0, 0.0).otherwise(F.least(F.greatest(dot / norm, F.lit(0.0)), F.lit(1.0)))


def as_string(m: Column) -> Column:
    """EXACT lanes as 8 hex digits each, a colon, then lane and value of each other lane in 2 and 4."""
    exact = F.concat(*[F.lpad(F.hex(F.coalesce(F.element_at(m, F.lit(LANES + k)), F.lit(0))), 8, "0") for k in range(EXACT)])
    rest = F.filter(F.map_entries(m), lambda x: x["key"] < LANES)
    listed = F.transform(rest, lambda x: F.concat(F.lpad(F.hex(x["key"].cast("long")), 2, "0"), F.lpad(F.hex(F.pmod(x["value"], F.lit(1 << 16))), 4, "0")))
    return F.lower(F.concat(exact, F.lit(":"), F.array_join(listed, "")))


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and fingerprint (a map) of each row's text; rows with equal keys are taken as parts of one document."""
    lines = docs.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_line"))
    each = lines.select(*keys, F.explode(units(F.col("_line"))).alias("_u")).select(*keys, "_u.lane", "_u.v")
    sums = each.groupBy(*keys, "lane").agg(F.sum("v").alias("v"))
    return sums.groupBy(*keys).agg(as_map(F.collect_list(F.struct("lane", "v"))).alias("fingerprint"))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds).bit_length()
    sizes = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])
    return F.aggregate(sizes, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(listed, at + s - 1) <= key), at + s).otherwise(at))


def compare_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): its fingerprint, that of its edited text, and how alike they and its successor's are.

    The successor is the next row by doc_id (null first, equal ones by text), after the last the first; a lone row is its
    own. The edited text has the last floor(n_chars / 4) code points replaced by the successor's first as many, or all
    it has. A null text counts as empty. Rows that repeat each give a row. Empty tables give an empty result.

    Texts are shuffled once, by ranges of doc_id; the successor of a range's last row comes from a table of the ranges'
    first rows, and so does its fingerprint.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    n = max(1, input_bytes(docs) // PARTITION_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(NULL_KEY))
    shares = [i / (n * RANGES) for i in range(1, n * RANGES)]
    found = docs.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", shares, 0.2 / (n * RANGES)) if shares else []
    rows = rows.withColumn("key", key).withColumn("range", _range_of(key, sorted({int(b) for b in found})))
    lowest = rows.select("range", "key").groupBy("range").agg(F.min("key").alias("key"))
    first = rows.join(F.broadcast(lowest.select("key")), "key", "left_semi").groupBy("range").agg(F.min("text").alias("first"))
    ring = Window.orderBy("range")  # one row for each range
    first = first.withColumn("start", F.first("first").over(ring))
    after = work.stored(first.select(F.col("range").alias("_range"), F.coalesce(F.lead("first").over(ring), F.col("start")).alias("after")), "firsts")
    line = Window.partitionBy("range").orderBy("key", "text")
    placed = rows.repartition(n, "range").withColumn("rn", F.row_number().over(line)).withColumn("next", F.lead("text").over(line))
    placed = placed.join(F.broadcast(after) if input_bytes(after) < 1 << 20 else after, F.col("range") == F.col("_range"), "left").withColumn("next", F.coalesce("next", "after")).drop("_range", "after")
    n_chars = F.char_length("text").cast("long")
    cut = (n_chars - F.floor(n_chars / 4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), cut), F.substring(F.col("next"), F.lit(1), F.floor(n_chars / 4).cast("int")))
    placed = placed.select("range", "rn", "doc_id", n_chars.alias("n_chars"), "text", edited.alias("edited"))
    marks = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t"), F.lit(None).cast("string").alias("note")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("note")))
    both = placed.select("range", "rn", "doc_id", "n_chars", F.explode(marks).alias("x"))
    lines = both.select("range", "rn", "doc_id", "n_chars", "x.which", F.posexplode(F.split("x.t", "\n")).alias("i", "line"), F.col("x.note").alias("whole"))
    # The edited text's digest goes along with its first line, so that the rows are not joined to their documents again.
    note = F.when((F.col("which") == 1) & (F.col("i") == 0), F.col("whole"))
    empty = F.struct(F.lit(-1).alias("lane"), F.lit(0).cast("long").alias("v"))
    tagged = lines.select("range", "rn", "doc_id", "n_chars", "which", note.alias("note"), F.explode(F.concat(units(F.col("line")), F.when(note.isNotNull(), F.array(empty)).otherwise(F.array().cast("array<struct<lane:int,v:bigint>>")))).alias("u"))
    tagged = tagged.select("range", "rn", "doc_id", "n_chars", "which", F.col("u.lane").alias("lane"), F.when(F.col("u.lane") < 0, F.col("note")).alias("note"), F.col("u.v").alias("v"))
    sums = tagged.groupBy("range", "rn", "doc_id", "n_chars", "which", "lane", "note").agg(F.sum("v").alias("v"))
    of = lambda which: F.collect_list(F.when((F.col("which") == which) & (F.col("lane") >= 0), F.struct("lane", "v")))
    whole = sums.groupBy("range", "rn", "doc_id", "n_chars").agg(of(0).alias("own"), of(1).alias("changed"), F.max("note").alias("edited_sha256"))
    whole = whole.select("range", "rn", "doc_id", "n_chars", "edited_sha256", as_map(F.col("own")).alias("own"), as_map(F.col("changed")).alias("changed"))
    by_place = Window.partitionBy("range").orderBy("rn")
    whole = whole.withColumn("following", F.lead("own").over(by_place))
    told = whole.select("range", "rn", "doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), F.when(F.col("following").isNotNull(), likeness(F.col("own"), F.col("following"))).alias("near_next"), F.when(F.col("following").isNull() | (F.col("rn") == 1), F.col("own")).alias("own"))
    told = work.stored(told, "documents")
    ends = told.where("own is not null")
    starts = ends.where("rn = 1").select("range", F.col("own").alias("mine")).withColumn("zero", F.first("mine").over(ring))
    starts = starts.select(F.col("range").alias("_range"), F.coalesce(F.lead("mine").over(ring), F.col("zero")).alias("following"))
    last = ends.where("near_next is null").join(starts, F.col("range") == F.col("_range")).withColumn("near_next", likeness(F.col("own"), F.col("following")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return told.where("near_next is not null").select(names).union(last.select(names))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
