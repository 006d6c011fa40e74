"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

The unit of the edit distance is the word: two lines are linked if at most `threshold`
words must be inserted, removed or exchanged to turn one into the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import components, content
from labspark.llm.sketches import let
from labspark.session import MAX_BROADCAST_BYTES, checkpointed

#: Shorter lines are only linked to their exact copies.
LEAST_WORDS = 5
THRESHOLD = 1
#: Lines that share a segment are compared pair by pair in buckets up to this size.
MAX_BUCKET = 48


def _codes(line: Column) -> Column:
    """A hash per word."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def _even(line: Column) -> Column:
    """The line with one space between words, which are what spaces, tabs and carriage returns part."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))


def _word_count(line: Column) -> Column:
    """Words of a line that has one space between words."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _begin(length: Column, segment: int, parts: int) -> Column:
    """Where a segment of `parts` even ones begins in a line of that many words."""
    return F.floor(length * segment / parts).cast("int")


def segment_keys(line: Column, words: Column, threshold: int = THRESHOLD) -> Column:
    """Keys of the line's threshold + 1 segments, then of the substrings with which it probes others' segments.

    A line of n words indexes its own segments under (n, number, text). It probes lines
    of n - d words, d up to the threshold, at the places where segment i may stand: at
    most i - 1 words off when counted from the left, and threshold + 1 - i words off when
    counted from the right. Lines of fewer than LEAST_WORDS words have no keys and are not probed.
    """
    parts, keys, probes = threshold + 1, [], []

    def first(text: Column, n: Column) -> Column:
        return F.call_function("substring_index", text, F.lit(" "), n)

    for d in range(parts):
        length = words - d
        for i in range(1, parts + 1):
            start = _begin(length, i - 1, parts)
            size = _begin(length, i, parts) - start
            for shift in range(max(1 - i, d - (parts - i)), min(i - 1, d + (parts - i)) + 1):
                at = start + shift
                own = d == 0 and shift == 0
                cut = line if i == parts and shift == d else first(line, at + size)
                cut = cut if i == 1 else first(cut, -size)
                fits = (length >= LEAST_WORDS) & (at >= 0) & (at + size <= words) & (size > 0)
                (keys if own else probes).append(F.when(fits, F.xxhash64(length, F.lit(i), cut)))
    return F.array(*keys, *probes)


def within(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether two word arrays are at most `threshold` edits apart.

    Bit-parallel over a band: for each error count e a bit set of the 2 * threshold + 1
    diagonals on which the prefixes read so far are at most e edits apart. Each word of
    `b` updates all sets at once.
    """
    diagonals = range(-threshold, threshold + 1)
    every = (1 << (2 * threshold + 1)) - 1
    first = [sum(1 << (d + threshold) for d in range(e + 1)) for e in range(threshold + 1)]

    def bits(*parts: Column) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y), parts).bitwiseAND(every)

    def step(sets: Column, j: Column) -> Column:
        same = [F.coalesce(F.when((j + d) >= 0, F.get(a, F.greatest(j + d, F.lit(0)))) == F.get(b, j), F.lit(False)) for d in diagonals]
        match = reduce(lambda x, y: x + y, [F.when(s, 1 << i).otherwise(0) for i, s in enumerate(same)])

        def moved(m: Column) -> Column:
            out: list[Column] = []
            for e in range(threshold + 1):
                stay = sets[e].bitwiseAND(m)
                if e:
                    before = sets[e - 1]
                    stay = bits(stay, before, F.shiftright(before, 1), F.shiftleft(out[e - 1], 1), sets[e].bitwiseAND(m))
                out.append(stay)
            return F.array(*out)

        return let(match, moved)

    start = F.array(*[F.lit(x) for x in first])
    steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.element_at(F.aggregate(steps, start, step), threshold + 1)
    apart = F.size(a) - F.size(b)
    return F.when(F.abs(apart) > threshold, False).otherwise(
        F.getbit(last.cast("long"), F.least(F.greatest(apart + threshold, F.lit(0)), F.lit(2 * threshold))) == 1
    )


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, content, pos, line, words) for every line that is not blank, lower-cased, with single spaces."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), content(doc_id, text).alias("content"), F.posexplode(F.split(F.lower(F.col(text)), "\n")).alias("pos", "line")
    )
    rows = rows.withColumn("line", _even(F.col("line"))).withColumn("words", _word_count(F.col("line")))
    return rows.filter("line <> ''")


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _sent(wanted: DataFrame) -> DataFrame:
    """`wanted` broadcast if its rows and lists are within MAX_BROADCAST_BYTES by count, before any row is fetched."""
    held = wanted.agg(F.sum(F.lit(24) + 16 * F.size("wanted")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(wanted) if held <= MAX_BROADCAST_BYTES else wanted.hint("merge")


def _texts(docs: DataFrame, doc_id: str, text: str, places: DataFrame) -> DataFrame:
    """(h, codes) of the lines at the places (h, first): only documents that hold one are split."""
    wanted = places.groupBy(F.col("first.doc_id").alias("d"), F.col("first.content").alias("c")).agg(
        F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h")).alias("wanted")
    )
    wanted = _sent(checkpointed(wanted))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), content(doc_id, text).alias("content"), F.col(text).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))
    found = keyed.join(wanted, same).select(F.split("text", "\n").alias("lines"), "wanted")
    lines = found.select("lines", F.explode("wanted").alias("w")).select("w.h", F.lower(F.get("lines", F.col("w.pos"))).alias("line"))
    # Rows repeated with their id give a line twice.
    return lines.groupBy("h").agg(F.min("line").alias("line")).select("h", _codes(_even(F.col("line"))).alias("codes"))


def _stars(lines: DataFrame) -> DataFrame:
    """Links among (h, codes) that may be one word apart, without pairs.

    Every line emits itself and each variant with one word left out. Lines that leave out
    the same place to the same variant differ in that word alone and link to the smallest
    of them; a line that is itself the variant links to all that lead to it.
    """
    n = F.size("codes")
    variants = F.transform(
        F.sequence(F.lit(0), n), lambda p: F.struct(
            F.xxhash64(F.concat(F.slice("codes", F.lit(1), p), F.slice("codes", p + 2, n))).alias("variant"), p.alias("place")
        )
    )  # at place n nothing is left out
    out = lines.select("h", n.alias("n"), F.explode(variants).alias("v")).select(
        "h", "v.variant", F.when(F.col("v.place") == F.col("n"), -1).otherwise(F.col("v.place")).alias("place")
    )
    tops = out.groupBy("variant", "place").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    same = tops.filter("low <> high and place >= 0").select("variant", "place", "low")
    whole = tops.filter("place = -1").select("variant", "low")
    stars = out.join(same, ["variant", "place"]).select(F.col("low").alias("a"), F.col("h").alias("b"))
    shorter = out.filter("place >= 0").join(whole, "variant").select(F.col("low").alias("a"), F.col("h").alias("b"))
    return stars.unionByName(shorter).filter("a <> b").distinct()


def links(occurrences: DataFrame, firsts: DataFrame, docs: DataFrame, doc_id: str, text: str, threshold: int = THRESHOLD, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Verified pairs (a, b) of line hashes that join all lines at most `threshold` words apart into their classes.

    `occurrences` has (h, keys), `firsts` a place of each hash. Buckets up to `max_bucket` lines are compared pair by
    pair. Lines of larger buckets are linked through their variants, a number of rows in
    proportion to their words; a threshold above one knows no such way and compares all.
    """
    emitted = occurrences.select("h", F.posexplode("keys").alias("at", "key")).filter("key is not null")
    emitted = emitted.select("h", "key", (F.col("at") <= threshold).alias("own"))
    lines = emitted.groupBy("key", "h").agg(F.max("own").alias("own"))
    sizes = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any")).filter("n > 1 and any")
    sizes = checkpointed(sizes.select("key", "n"))  # as a table, so that the join can split a hot key
    met = checkpointed(lines.join(sizes.hint("merge"), "key"))  # the sizes grow with the data: no broadcast
    cold = met if threshold > 1 else met.filter(f"n <= {max_bucket}")
    index = cold.filter("own").select("key", F.col("h").alias("a"))
    probe = cold.select("key", F.col("h").alias("b"), "own")
    pairs = index.join(probe, "key").filter("a <> b and (not own or a < b)")
    near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = checkpointed(_texts(docs, doc_id, text, firsts.join(met.select("h").distinct(), "h", "left_semi")))
    if threshold == 1:
        hot = met.filter(f"n > {max_bucket}").select("h").distinct()
        near = near.unionByName(_stars(known.join(hot, "h", "left_semi")))
    left = known.select(F.col("h").alias("a"), F.col("codes").alias("left"))
    right = known.select(F.col("h").alias("b"), F.col("codes").alias("right"))
    checked = near.join(left, "a").join(right, "b").filter(within(F.col("left"), F.col("right"), threshold))
    return checked.select("a", "b")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, content, pos) of every line to remove: all of a class but its first.

    First is the line of smallest doc_id (null last), then text hash, then position.
    Rows equal in id and text are one document. Equal lines, however short, are one before any search.
    """
    keys = segment_keys(F.col("line"), F.col("words"), threshold)
    rows = checkpointed(
        lines_of(docs, doc_id, text).select("doc_id", "content", "pos", _hash(F.col("line")).alias("h"), keys.alias("keys"))
    )
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "content", "pos")
    firsts = checkpointed(rows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    groups = components(links(rows, firsts, docs, doc_id, text, threshold, max_bucket), "a", "b")
    rooted = firsts.join(groups, F.col("h") == F.col("node"), "left").filter("n > 1 or root is not null")
    rooted = checkpointed(rooted.select("h", "first", F.coalesce("root", "h").alias("root")))
    owners = rooted.groupBy("root").agg(F.min("first").alias("owner"))
    members = rooted.join(owners, "root").select("h", "owner")
    return (
        rows.select("doc_id", "content", "pos", "h")
        .join(members, "h")
        .filter(place != F.col("owner"))
        .select("doc_id", "content", "pos")
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """`docs` with repeated lines taken out of `text`; _llm_lines and _llm_removed count lines.

    All rows and columns stay; columns of the input that are called _llm_lines or _llm_removed
    are replaced. Null texts stay null; a text may become empty; an empty table gives no rows.
    A very long text is one row's work, in time that grows with its lines.
    """
    docs = docs.drop("_llm_lines", "_llm_removed")
    gone = repeated_lines(docs, doc_id, text, threshold, max_bucket)
    lists = gone.distinct().groupBy("doc_id", "content").agg(F.collect_list("pos").alias("_llm_gone"))
    lists = lists.select(F.col("doc_id").alias("_llm_id"), F.col("content").alias("_llm_of"), "_llm_gone")
    keyed = docs.withColumn("_llm_content", content(doc_id, text))
    same = F.col(doc_id).eqNullSafe(F.col("_llm_id")) & (F.col("_llm_content") == F.col("_llm_of"))
    split = F.split(F.col(text), "\n")
    stays = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_llm_gone"))  # noqa: E731  one pass, however many lines go
    kept = let(split, lambda parts: F.array_join(F.transform(stays(parts), lambda i: F.get(parts, i)), "\n"))
    out = keyed.join(lists, same, "left")
    removed = F.coalesce(F.size("_llm_gone"), F.lit(0)).cast("long")
    new = F.when(F.col("_llm_gone").isNull(), F.col(text)).otherwise(kept)
    return out.select(
        *[new.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("_llm_lines"),
        F.when(F.col("_llm_gone").isNull(), 0).otherwise(removed).cast("long").alias("_llm_removed"),
    )
