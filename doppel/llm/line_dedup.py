"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line (text between line feeds) of at least ``min_bytes`` bytes is dropped when an
equal line, or one within ``edits`` byte edits, occurs earlier in the corpus, in
order of document id and line number. All lines are judged on the input, so the
result doesn't depend on what else is dropped. Distances count bytes of UTF-8.

* Equal lines collapse first, by two hashes; the join sees every distinct line once.
* A line of length ``l`` is cut into ``edits + 1`` segments, so a line within
  ``edits`` edits holds one of them unchanged. The segments are the index, with
  their length class and number in the key; a line probes, for each length that a
  partner may have, the substrings that can be the partner's segment when edits
  before and after it are accounted for.
* Index and probes meet in an equi-join on the hashed key. Its condition compares
  parity bitmaps of words and of letters: an edit touches at most two words and
  their replacement, and two letters, so more different bits rule a pair out.
* What is left is verified by edit distance: a band of ``2 * edits + 1`` diagonals
  in the bits of one integer, one step per byte.

Defined cases: a null text has no lines and stays null; an empty text has one empty
line. Rows that repeat an id and text are one document and get the same result. A
null id comes first. Other columns are not read, clashing names do no harm. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, broadcast_if_small, let

EDITS = 2
MIN_BYTES = 24
WORD_BITS = 40
LETTERS = "etaoinsrhldcumgbfpwyv"
CONF = {
    # a table that is written needs the shuffles it came from no more; else their files pile up until the driver collects garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # the JVM only interprets methods above 8000 bytes, as fused stages with the keys' expressions are; Spark splits those it doesn't fuse
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line: the last ones take the remainder."""
    n = edits + 1
    base = F.floor(length / n).cast("int")
    short = n - length % n
    return i * base + F.greatest(F.lit(0), i - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(length: Column, i: int, data: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(data, start + 1, size))


def index_keys(data: Column, length: Column, edits: int) -> list[Column]:
    return [_key(length, i, data, *_segment(length, i, edits)) for i in range(edits + 1)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter by, segment, shift)``: where a partner's segment may begin.

    Before segment ``i`` at most ``i`` edits lie, or else an earlier segment is
    unchanged too; after it at most ``edits - i``, by the same argument.
    """
    return [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1) for shift in range(-edits, 2 * edits + 1)
            if abs(shift) <= i and abs(shift - less) <= edits - i]


def probe_keys(data: Column, length: Column, edits: int) -> list[Column]:
    """One column a place, null where the line has no such substring."""
    keys = []
    for less, i, shift in probe_places(edits):
        other = length - less
        start, size = _segment(other, i, edits)
        start = start + shift
        inside = (other > edits) & (start >= 0) & (start + size <= length)
        keys.append(F.when(inside, _key(other, i, data, start, size)))
    return keys


def _bit(at: Column) -> Column:
    """Bit ``at`` modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def word_parity(line: Column) -> Column:
    """Bitmap in which every word flips one of 64 bits."""
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(_bit(F.hash(w))))


def parity_bits(line: Column, words: Column) -> Column:
    """Bitmap of a line with the given ``word_parity``, which is folded to 40 bits; every letter of
    ``LETTERS`` flips one of 21 more; the last two bits are the length modulo 4."""
    bits = words.bitwiseXOR(F.shiftrightunsigned(words, WORD_BITS)).bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long"))
    for i, letter in enumerate(LETTERS):
        without = F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        bits = bits + F.when((F.octet_length(line) - without) % 2 == 1, _bit(F.lit(WORD_BITS + i))).otherwise(0)
    bits = bits + F.call_function("shiftleft", F.octet_length(line).cast("long") % 4, F.lit(WORD_BITS + len(LETTERS)))
    # never null, or else a null test would compute it once more
    return F.coalesce(bits, F.lit(0).cast("long"))


def _may_be_close(x: str, y: str, edits: int) -> Column:
    """What the bitmaps of two lines allow when ``edits`` edits lie between them.

    An edit touches two words at most and their replacement. A substitution touches
    two letters, an insertion or deletion one, and at least as many of these are
    needed as the lengths differ.
    """
    differ = F.col(x).bitwiseXOR(F.col(y))
    words = F.lit((1 << WORD_BITS) - 1).cast("long")
    letters = F.lit((1 << len(LETTERS)) - 1 << WORD_BITS).cast("long")
    length = lambda c: F.shiftrightunsigned(c, WORD_BITS + len(LETTERS)) % 4
    longer = F.pmod(length(x) - length(y), F.lit(4))
    by = F.least(longer, 4 - longer) if edits < 3 else F.lit(0)
    return (F.bit_count(differ.bitwiseAND(words)) <= 3 * edits) & (F.bit_count(differ.bitwiseAND(letters)) <= 2 * edits - by)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two binaries whose lengths differ by at most ``edits`` and are larger.

    Exact up to ``edits``; larger distances give some value above. The vertical
    differences of the band's cells are bits of two integers; adding carries matches
    along a diagonal. Down to the last row the band's lower edge is followed, then
    the last row.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    edge = b"\xff"

    def long(x) -> Column:
        return F.lit(x).cast("long")

    def within(x: Column) -> Column:
        return x.bitwiseAND(long(mask))

    def inverted(x: Column) -> Column:
        return x.bitwiseXOR(long(mask))

    def run(args: Column) -> Column:
        padded, other, rows = args["padded"], args["other"], args["rows"]

        def step(state: Column, j: Column) -> Column:
            byte = F.substring(other, j + 1, F.lit(1))
            match = long(0)
            for r in range(width):
                match = match + F.when(F.substring(padded, j + (r + 1), F.lit(1)) == byte, long(1 << r)).otherwise(long(0))

            def columns(s: Column) -> Column:
                diagonal = within(((s["m"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["m"]).bitwiseOR(s["vn"]))
                return F.struct(diagonal.alias("d"), s["vp"].alias("vp"), s["vn"].alias("vn"))

            def move(s: Column) -> Column:
                more = s["vn"].bitwiseOR(inverted(s["d"].bitwiseOR(s["vp"])))
                less = s["d"].bitwiseAND(s["vp"])
                down = F.shiftright(s["d"], 1)
                last = F.call_function("shiftleft", long(1), F.greatest(F.lit(0), rows - 1 - j + edits).cast("int"))
                dist = F.when(j < rows - edits, state["dist"] + F.when(s["d"].bitwiseAND(long(top)) == 0, 1).otherwise(0)).otherwise(
                    state["dist"] + F.when(more.bitwiseAND(last) != 0, 1).otherwise(0) - F.when(less.bitwiseAND(last) != 0, 1).otherwise(0))
                return F.struct(less.bitwiseOR(inverted(within(down.bitwiseOR(more)))).alias("vp"),
                                down.bitwiseAND(more).alias("vn"), dist.cast("int").alias("dist"))

            new = let(let(F.struct(match.alias("m"), state["vp"].alias("vp"), state["vn"].alias("vn")), columns), move)
            # the followed cell is at most the band's width above the least of its column, which never falls
            return F.when(state["dist"] > edits + width, state).otherwise(new)

        start = F.struct(long(((1 << (edits + 1)) - 1) << edits).alias("vp"), long(0).alias("vn"), F.lit(edits).cast("int").alias("dist"))
        return F.aggregate(F.sequence(F.lit(0), F.length(other) - 1), start, step)["dist"]

    pad = F.lit(edge * edits)
    return let(F.struct(F.concat(pad, a, F.lit(edge * (edits + 1))).alias("padded"), b.alias("other"),
                        F.length(a).alias("rows")), run)


def trimmed_distance(a: Column, b: Column, edits: int, block: int = 16) -> Column:
    """``banded_distance`` of what is left without the blocks that begin or end both alike."""
    def equal_blocks(x: Column, y: Column, start_x, start_y, n: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & (
            F.substring(x, start_x(i) + 1, F.lit(block)) == F.substring(y, start_y(i) + 1, F.lit(block))))
        return ((F.array_position(same, False) - 1) * block).cast("int")

    def measured(t: Column) -> Column:
        n = F.least(F.length(t["a"]), F.length(t["b"]))
        blocks = F.floor(n / block).cast("int")
        la, lb = F.length(t["a"]), F.length(t["b"])
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), (n - edits - 1).alias("most"),
                        equal_blocks(t["a"], t["b"], lambda i: i * block, lambda i: i * block, blocks).alias("front"),
                        equal_blocks(t["a"], t["b"], lambda i: la - (i + 1) * block, lambda i: lb - (i + 1) * block, blocks).alias("back"))

    def cut(t: Column) -> Column:
        front = F.least(t["front"], t["most"])
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), front.alias("front"), F.least(t["back"], t["most"] - front).alias("back"))

    def distance(t: Column) -> Column:
        part = lambda x: F.substring(x, t["front"] + 1, F.length(x) - t["front"] - t["back"])
        return banded_distance(part(t["a"]), part(t["b"]), edits)

    return let(let(let(F.struct(a.alias("a"), b.alias("b")), measured), cut), distance)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """``id, fp, at, line`` of every line that is long enough."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    return src.where(F.octet_length("line") >= min_bytes)


def similar_lines(docs: DataFrame, scratch: Scratch, edits: int, min_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``a, a2, b, b2`` between different lines within ``edits`` edits; a line is two hashes of its text."""
    data, length = F.col("line").cast("binary"), F.octet_length("line")
    keys = {"index": index_keys(data, length, edits), "probe": probe_keys(data, length, edits)}
    named = {f"{side}{i}": c for side, columns in keys.items() for i, c in enumerate(columns)}
    # bits and keys follow from the line: they are shuffled for the collapse in its place, being shorter
    each = _lines(docs, id_col, text_col, min_bytes).withColumn("words", word_parity(F.col("line"))).select(
        F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), parity_bits(F.col("line"), F.col("words")).alias("bits"),
        *[c.alias(name) for name, c in named.items()])
    lines = each.distinct()
    # both sides take their keys from all of them, so that they read the same shuffle
    lines = lines.select("h", "bits", F.array(*named).alias("keys"))

    def postings(start: int, n: int) -> DataFrame:
        return lines.select("h", "bits", F.explode(F.array_compact(F.slice("keys", start, n))).alias("key"))

    index = postings(1, len(keys["index"]))
    probe = postings(1 + len(keys["index"]), len(keys["probe"]))
    x, y = index.alias("x"), probe.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") != F.col("y.h")) & _may_be_close("x.bits", "y.bits", edits))
    pairs = scratch.write(pairs.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct(), "pairs")
    wanted = broadcast_if_small(scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted"))
    texts = _lines(docs, id_col, text_col, min_bytes).select(F.xxhash64("line").alias("h"), "line").join(wanted, "h", "left_semi").distinct()
    texts = scratch.write(texts, "texts")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(
        texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    # few bytes but much work: dealt out evenly, as coalescing by size would put it into one task
    both = both.repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = F.abs(F.octet_length("line_a") - F.octet_length("line_b")) <= edits
    # nested, so that the distance is only computed where the lengths allow it
    distance = F.when(near, trimmed_distance(F.col("line_a").cast("binary"), F.col("line_b").cast("binary"), edits))
    return both.withColumn("distance", distance).where(F.col("distance") <= edits).select(
        "a", F.xxhash64(F.lit(1), "line_a").alias("a2"), "b", F.xxhash64(F.lit(1), "line_b").alias("b2"))


def duplicate_lines(docs: DataFrame, scratch: Scratch, edits: int, min_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, dropped, n_links`` of documents with lines to drop or with links."""
    links = scratch.write(similar_lines(docs, scratch, edits, min_bytes, id_col, text_col), "links")
    occurrences = scratch.write(_lines(docs, id_col, text_col, min_bytes).select(
        "id", "fp", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")), "occurrences")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "at")
    distinct = scratch.write(occurrences.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("b2").alias("a2"), F.col("a").alias("b"), F.col("a2").alias("b2")))
    ends = sides.select(F.col("a").alias("h"), F.col("a2").alias("h2")).distinct()
    linked = scratch.write(distinct.join(ends, ["h", "h2"], "left_semi"), "linked")
    other = linked.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("first").alias("other_first"))
    one = linked.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("first").alias("own_first"))
    near = sides.join(other, ["b", "b2"]).join(one, ["a", "a2"]).groupBy("a", "a2").agg(
        F.max(F.col("other_first") < F.col("own_first")).alias("near_earlier"), F.count(F.lit(1)).alias("links"))
    marked = distinct.join(near.withColumnsRenamed({"a": "h", "a2": "h2"}), ["h", "h2"], "left").where("n > 1 OR links > 0")
    hits = occurrences.join(marked, ["h", "h2"]).select(
        "id", "fp", "at", F.coalesce("links", F.lit(0)).alias("links"),
        (F.coalesce("near_earlier", F.lit(False)) | (place != F.col("first"))).alias("drop"))
    # a document's lines are bounded by its own length; a set, as rows that repeat a document count once
    lines = hits.groupBy("id", "fp").agg(F.collect_set(F.struct("at", "drop", "links")).alias("lines"))
    return lines.select("id", "fp", F.transform(F.filter("lines", lambda x: x["drop"]), lambda x: x["at"]).alias("dropped"),
                        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["links"]).alias("n_links"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """``id``, the columns ``keep``, ``text`` without the dropped lines, ``n_lines, n_dropped, n_links``, one row per input row."""
    keep = keep or []
    scratch = Scratch(docs.sparkSession, "line-dedup", CONF)
    found = duplicate_lines(docs, scratch, edits, min_bytes, id_col, text_col).withColumnsRenamed({"id": "_id", "fp": "_fp"})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("fp"),
                       *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(let(F.split("text", "\n"), left))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select(F.col("id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], text.alias("text"),
                       n_lines.alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
