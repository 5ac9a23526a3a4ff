"""Document fingerprints of closed syncmers, in DataFrame operations alone.

A text's words are hashed; an s-mer is SMALL words in a row, a k-mer LARGE. A k-mer is a closed syncmer if the least of its
s-mers is the first or the last: a property of the k-mer alone, so that an edit changes no anchor that it does not touch.
Of a text's distinct syncmers the SKETCH with the least hashes are its fingerprint (all of them where sketch is None), each
with the place of its first word in the low POSITION_BITS bits, which hold any place that a text of 2^31 bytes has.
likeness() estimates the Jaccard similarity of two texts' syncmers from two fingerprints; with_aligned() matches anchors by
place: the share of common anchors at their middle shift.

Words are cut by what stands beside a cut, at any length of text: at ASCII white space; around each character of a script
that is written without blanks; and, AROUND characters or more from both ends of a run without white space, behind a
character of BREAKS. So addresses, hashes and minified lines fall into pieces that an edit elsewhere leaves as they are.

The next document in descending order comes by one exchange of texts. The keys alone (doc_id and a hash of the text) are
sorted; each RANGE_ROWS-th begins a range (at most MAX_RANGES, or one for each sort partition). A row finds its range by
binary search; ranges are sorted within a window, and the last row of the range below comes along as a guest. Rows that are
alike in identifier and text and fill several ranges are spread over them. No arithmetic is done on identifiers.

Defined cases: a null text is empty, with an empty fingerprint; under LARGE words, all words make one anchor; two empty
fingerprints have likeness 1, an empty and another 0; a null id counts as the least long, so it comes last in descending
order, and equal ids are ordered by their text's hash, descending; a table of one row is its own next; very long texts are
hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribe.llm.common import table

SMALL, LARGE, SKETCH, POSITION_BITS = 2, 5, 64, 28
AROUND, BREAKS = 16, "048aeiAEI!-/:-@\\[-`{-~"
RANGE_ROWS, MAX_RANGES = 1500, 100_000
LEAST_ID = -(1 << 63)

#: Thai and Lao, Myanmar, Khmer, kana, Han of the basic plane.
UNSPACED = "\\x{E00}-\\x{EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
#: White space, and what a run is made of: characters above it, of one UTF-16 unit.
BLANK, SOLID = "[\\x20\\x09-\\x0D]", "[!-\\x{D7FF}\\x{E000}-\\x{FFFF}]"


def words(text: Column) -> Column:
    # Where no run is long enough for a break and no unspaced script stands, blanks are the only cuts: the same words, sooner.
    plain = ~text.rlike(f"(?<!{SOLID}){SOLID}{{{2 * AROUND}}}|[{UNSPACED}]")
    cuts = f"{BLANK}+|(?<=[{UNSPACED}])|(?=[{UNSPACED}])|(?<={SOLID}{{{AROUND - 1}}}[{BREAKS}])(?={SOLID}{{{AROUND}}})"
    return F.filter(F.when(plain, F.split(text, f"{BLANK}+")).otherwise(F.split(text, cuts)), lambda w: w != "")


def turned(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseOR(F.shiftrightunsigned(x, 63))


def with_fingerprint(df: DataFrame, text: str, name: str, sketch: int | None = SKETCH) -> DataFrame:
    """Adds the array of anchors of a text column (not null): hash in the high bits, place in the low ones, sorted."""
    w, s, v = f"_{name}_w", f"_{name}_s", f"_{name}_v"
    inner = LARGE - SMALL  # s-mers of a k-mer, less one
    low = (1 << POSITION_BITS) - 1
    out = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a.bitwiseXOR(turned(b)))
    out = out.withColumn(s, pairs)

    def anchor(x: Column, i: Column) -> Column:
        last = F.get(s, i + inner)
        between = F.least(*(F.get(s, i + k) for k in range(1, inner)))
        edge = (between >= x) | (between >= last)
        kmer = F.xxhash64(x, F.get(s, i + SMALL), last)
        return F.when(edge, kmer.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    picked = F.sort_array(F.filter(F.transform(F.slice(s, 1, F.greatest(F.size(s) - inner, F.lit(0))), anchor), lambda x: x.isNotNull()))
    out = out.withColumn(v, picked)
    high = lambda x: F.shiftright(x, POSITION_BITS)
    distinct = F.filter(v, lambda x, i: (i == 0) | (high(x) != high(F.get(v, i - 1))))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w).bitwiseAND(F.lit(~low)))).otherwise(F.array().cast("array<long>"))
    return out.withColumn(name, F.when(F.size(w) >= LARGE, distinct if sketch is None else F.slice(distinct, 1, sketch)).otherwise(whole)).drop(w, s, v)


def hashes(anchors: Column) -> Column:
    return F.transform(anchors, lambda x: F.shiftright(x, POSITION_BITS))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the SKETCH least hashes of both fingerprints, the share that both have."""
    least = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(least, hashes(a)), hashes(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(least))


def with_aligned(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds, 0 to 1: of the anchors that both fingerprints have, the share at their middle shift of places; 0 if none."""
    low = F.lit((1 << POSITION_BITS) - 1)
    places, shifts = f"_{name}_p", f"_{name}_s"
    out = df.withColumn(places, F.map_from_arrays(hashes(F.col(b)), F.transform(b, lambda x: x.bitwiseAND(low))))
    moved = F.transform(a, lambda x: F.col(places)[F.shiftright(x, POSITION_BITS)] - x.bitwiseAND(low))
    out = out.withColumn(shifts, F.sort_array(F.filter(moved, lambda x: x.isNotNull())))
    out = out.withColumn(places, F.get(shifts, F.floor(F.size(shifts) / 2).cast("int")))
    same = F.size(F.filter(shifts, lambda x: x == F.col(places)))
    return out.withColumn(name, F.when(F.size(shifts) > 0, same / F.size(shifts)).otherwise(0.0)).drop(places, shifts)


def text_of(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.hex(x))), ".")


def longs(values: list[int]) -> Column:
    """An array the optimizer folds to one literal, however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


class Ranges:
    """Ranges of the order (key, tag): where each begins, and how many ranges rows alike in both fill there."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        per = max(RANGE_ROWS, n // MAX_RANGES)
        # In order; the last part of it parts rows that are alike. The low bits of a place count the rows of a sort partition.
        self.rows = rows.select("key", "tag")
        order = self.rows.orderBy("key", "tag", F.monotonically_increasing_id()).select("key", "tag", F.monotonically_increasing_id().alias("place"))
        within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
        cuts = order.where(within % per == 0).groupBy("key", "tag").agg(F.count("*").alias("n")).orderBy("key", "tag").collect()
        self.keys, self.tags, self.fill = [r.key for r in cuts], [r.tag for r in cuts], [r.n for r in cuts]
        self.first = [0]
        for many in self.fill:
            self.first.append(self.first[-1] + many)

    def number(self) -> Column:
        """The last beginning that is not beyond a row, from 0: a binary search."""
        keys, tags = longs(self.keys), longs(self.tags)
        steps = [1 << b for b in reversed(range(len(self.keys).bit_length()))]

        def step(at: Column, by: Column) -> Column:
            key, tag = F.get(keys, at + by), F.get(tags, at + by)
            return F.when((key < F.col("key")) | ((key == F.col("key")) & (tag <= F.col("tag"))), at + by).otherwise(at)

        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), step)

    def seat(self) -> Column:
        """A row's range; rows equal to a beginning are spread by salt over the ranges that they fill."""
        at = F.col("number")
        own = (F.get(longs(self.keys), at) == F.col("key")) & (F.get(longs(self.tags), at) == F.col("tag"))
        many, first = F.get(longs(self.fill), at), F.get(longs(self.first), at)
        return first + F.when(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), many)).otherwise(many - 1)

    def hosts(self) -> DataFrame:
        """key, tag, hosts: the ranges to which the last row of a range goes as a guest; beyond the last comes the first."""
        tops = self.rows.withColumn("number", self.number()).groupBy("number").agg(F.max(F.struct("key", "tag")).alias("top"))
        after = F.get(longs(self.first), F.pmod(F.col("number") + 1, F.lit(len(self.keys))))
        ends = tops.select("top.key", "top.tag", after.alias("host"))
        starts = self.rows.sparkSession.range(len(self.keys)).withColumn("id", F.col("id").cast("int"))
        many, first = F.get(longs(self.fill), F.col("id")), F.get(longs(self.first), F.col("id"))
        alike = starts.where(many > 1).select(F.get(longs(self.keys), F.col("id")).alias("key"), F.get(longs(self.tags), F.col("id")).alias("tag"), F.explode(F.sequence(first + 1, first + many - 1)).alias("host"))
        return ends.unionByName(alike).groupBy("key", "tag").agg(F.collect_list("host").alias("hosts"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, its fingerprint and that of its edited text, the next document's, and likenesses."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumns({"key": F.coalesce("doc_id", F.lit(LEAST_ID)), "tag": F.xxhash64("text")})
    ranges = Ranges(own)
    if not ranges.keys:
        seated = own.withColumns({"seat": F.lit(0).cast("long"), "guest": F.lit(0)})
    else:
        hosts = F.broadcast(ranges.hosts())  # at most MAX_RANGES and the sort's partitions, twice
        guests = own.join(hosts, ["key", "tag"]).groupBy("key", "tag").agg(F.first("text").alias("text"), F.first("hosts").alias("hosts"))
        guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "tag", F.explode("hosts").alias("seat"), F.lit(1).alias("guest"))
        seated = own.withColumn("number", ranges.number()).select("doc_id", "text", "key", "tag", ranges.seat().alias("seat"), F.lit(0).alias("guest")).unionByName(guests)
    marked = with_fingerprint(seated, "text", "own")
    order = W.partitionBy("seat").orderBy(F.desc("guest"), "key", "tag")
    follow = marked.select("*", F.lag("text").over(order).alias("next_text"), F.lag("own").over(order).alias("next")).where("guest = 0")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edits = follow.select("doc_id", "own", "next", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    out = with_fingerprint(edits, "edited", "edit")
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("own").alias("anchors"), F.col("edit").alias("edited_anchors"), F.col("next").alias("next_anchors"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_aligned(fingerprints(table(spark, sf_dir, "documents")), "anchors", "edited_anchors", "aligned_edited")
    near = lambda other: likeness(F.col("anchors"), F.col(other))
    return found.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("anchors")).alias("fingerprint"), text_of(F.col("edited_anchors")).alias("edited_fingerprint"), near("edited_anchors").alias("near_edited"), near("next_anchors").alias("near_next"), "aligned_edited")
