"""Document fingerprints: closed syncmers, in DataFrame functions only.

A k-mer of characters is an anchor when the least hash among its inner s-mers is that of the first or the last one.
Whether a k-mer is an anchor depends on nothing around it, so texts that share a passage share its anchors, and their
positions line up. The text is laid out as four bytes a character, so that each s-mer is one slice. A text of fewer than
k characters is its own single anchor; an empty one has none. For the same reason the anchors of two parts put together are
those of either part and of the k - 1 characters on both sides of the seam: the edited text's are not sought anew.

The fingerprint of a text holds the number of its distinct anchors and, of the least of them by hash (SKETCH at least, one
in SPARSE of a long text, all of a short one), the hash and the first position. Likeness is positional: of the anchors of
both texts with hashes that both fingerprints cover, the share that is in both at a consistent offset, which is the best
class of offsets SLACK characters wide. So texts that share a passage in place are alike, however long, and a text whose
sections were reordered is like the original by its largest section only. It is exact where both fingerprints hold all
anchors, else an estimate from them whose error falls with the texts' length.

Neighbours in the order of doc_id come without a join or a global sort: rows are dealt into ranges whose starts are rows
that occur, and the first row of each range is dealt to the range before it, too; the first of all follows the last of
all. A doc_id (or null) that fills several ranges is split by the hashes of its texts. The number of ranges grows with the
rows, up to MOST_RANGES; then the ranges grow. Ranges are sorted once: the next text, and then the next sketch, are looked up
in rows that lie in order, so that neither anchors nor sketches are shuffled or sorted.

Defined cases: a null text is empty; very long texts are read whole; a null doc_id comes last; rows of one doc_id, and
all of null, are ordered by the hashes of their texts, so that repeated rows follow each other (and lie in one range); a
single document is its own neighbour; two empty texts are alike (1), an empty and another are not (0); an empty table gives no rows; columns of
the input that are not asked for are not looked at, and with_next() keeps all but those named next_<column>.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import table

K, S = 12, 10
SKETCH, SPARSE, SLACK = 64, 16, 64
ROWS_A_RANGE, MOST_RANGES = 2000, 1 << 16
LAST_ID = (1 << 63) - 1
#: In place of a start's tie: all rows of its key belong to the range that it opens.
ANY_TIE = -1 << 63


#: One anchor as a number: the upper half of its hash, then its position.
UPPER, LOWER = "-4294967296L", "4294967295L"
PACKED = f"(a.anchor & {UPPER}) | a.position"


def anchors_sql(text: str, k: int = K, s: int = S, packed: bool = False) -> str:
    """anchors() as an SQL expression; packed: an array of numbers as PACKED has them."""
    n = f"char_length({text})"
    smers = f"transform(sequence(1, 4 * {n} - {4 * s - 1}, 4), i -> xxhash64(substring(b, i, {4 * s})))"
    entry = lambda at, anchor: f"({anchor} & {UPPER}) | {at}" if packed else f"struct({at} AS position, {anchor} AS anchor)"
    if k > 2 * s:
        raise ValueError("k is at most 2 s")
    inside = range(1, k - s)
    least = lambda at: " AND ".join(f"g[i + {at}] <= g[i + {j}]" for j in (*inside, 0, k - s) if j != at)  # noqa: E731  # stops at the first that is less
    edge = "g[i + 1] >= least(g[i], g[i + 2])" if k - s == 2 else f"({least(0)}) OR ({least(k - s)})"
    taken = f"transform(filter(sequence(0, {n} - {k}), i -> {edge}), i -> {entry('i', f'xxhash64(g[i], g[i + {k - s}])')})"  # k <= 2 s: both edges together are the k-mer
    many = f"transform(array(encode({text}, 'UTF-32')), b -> transform(array({smers}), g -> {taken})[0])[0]"
    whole = f"xxhash64(encode({text}, 'UTF-32'))"
    one = f"array({entry('0', whole)})"
    none = f"filter({one}, x -> false)"
    return f"CASE WHEN {n} >= {k} THEN {many} WHEN {n} > 0 THEN {one} ELSE {none} END"


def anchors(text: str, k: int = K, s: int = S) -> Column:
    """array<struct<position, anchor>> of the text column's closed syncmers; positions in characters from 0."""
    return F.expr(anchors_sql(text, k, s))


def joined_sql(first: str, found: str, rest: str, k: int = K, s: int = S) -> str:
    """The packed anchors of concat(first, rest) as an SQL expression, from those of a text that begins with `first`."""
    n, before = f"at + char_length({rest})", f"least(at, {k - 1})"
    moved = lambda text, by: f"transform(array({by}), d -> transform({anchors_sql(text, k, s, packed=True)}, a -> a + d))[0]"
    none = "filter(array(0L), a -> false)"
    seam = f"concat(right({first}, {before}), left({rest}, {k - 1}))"  # the whole of a text of fewer than k characters
    across = f"CASE WHEN {n} < {k} OR {before} + least(char_length({rest}), {k - 1}) >= {k} THEN {moved(seam, f'at - {before}')} ELSE {none} END"
    after = f"CASE WHEN char_length({rest}) >= {k} THEN {moved(rest, 'at')} ELSE {none} END"
    # lengths are bound, as a lambda would count them again for each anchor
    return f"transform(array(char_length({first})), at -> concat(transform(array(at - {k}), e -> filter({found}, a -> (a & {LOWER}) <= e))[0], {across}, {after}))[0]"


#: The first entry of each hash in a column of sorted packed anchors; the sketch of a column of such entries.
DISTINCT = "filter({o}, (x, i) -> i = 0 OR shiftright(x, 32) <> shiftright({o}[i - 1], 32))"
LEAST = "named_struct('n', size({d}), 'anchors', slice({d}, 1, greatest({size}, size({d}) div {sparse})))"


def sketch(found: str, size: int = SKETCH, sparse: int = SPARSE) -> Column:
    """struct<n, anchors>: the number of distinct hashes in a column, or expression, of anchors, and the least of them with their first positions."""
    ordered = f"sort_array(transform({found}, a -> {PACKED}))"
    distinct = f"transform(array({ordered}), o -> {DISTINCT.format(o='o')})[0]"
    return F.expr(f"transform(array({distinct}), d -> {LEAST.format(d='d', size=size, sparse=sparse)})[0]")


def sketched(df: DataFrame, found: dict[str, str], size: int = SKETCH, sparse: int = SPARSE) -> DataFrame:
    """df with columns of sketches in place of expressions of packed anchors.

    Step by step, so that arrays are sorted outside of any lambda: there Spark sorts them as plain numbers.
    """
    df = df.withColumns({c: F.expr(f"sort_array({x})") for c, x in found.items()})
    df = df.withColumns({c: F.expr(DISTINCT.format(o=c)) for c in found})
    return df.withColumns({c: F.expr(LEAST.format(d=c, size=size, sparse=sparse)) for c in found})


def fingerprint(sk: str) -> Column:
    """Hexadecimal digits: the number of distinct anchors, then hash and position of each; '' without any."""
    return F.expr(f"CASE WHEN {sk}.n = 0 THEN '' ELSE lower(concat(lpad(hex({sk}.n), 8, '0'), array_join(transform({sk}.anchors, x -> lpad(hex(x), 16, '0')), ''))) END")


def unpacked(text: Column) -> Column:
    """The sketch that fingerprint() wrote; hashes count as signed."""
    number = lambda at, n: F.conv(F.substr(text, at, F.lit(n)), 16, -10).cast("bigint")
    entries = F.transform(F.sequence(F.lit(9), F.length(text) - 15, F.lit(16)), lambda at: number(at, 16))
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("anchors"))
    return F.when(F.length(text) < 24, none).otherwise(F.struct(number(F.lit(1), 8).cast("int").alias("n"), entries.alias("anchors")))


def likeness(a: str, b: str, slack: int = SLACK) -> Column:
    """The positional likeness of two columns of sketches."""
    # hashes up to the last one of an incomplete sketch are covered; the side is told by the lowest bit
    last = lambda s: f"CASE WHEN {s}.n > size({s}.anchors) THEN shiftright(element_at({s}.anchors, -1), 32) ELSE {LAST_ID}L END"
    side = lambda s, bit: f"transform(filter({s}.anchors, x -> shiftright(x, 32) <= c), x -> (x & -4294967296L) | shiftleft(x & 2147483647L, 1) | {bit}L)"
    both = f"transform(array(least({last(a)}, {last(b)})), c -> sort_array(concat({side(a, 0)}, {side(b, 1)})))[0]"
    place = lambda x: f"(shiftright({x} & 4294967294L, 1))"
    # neighbours of one hash are a pair: first a's, then b's or the other way round
    offset = f"CASE WHEN (m[i] & 1) = 0 THEN {place('m[i]')} - {place('m[i + 1]')} ELSE {place('m[i + 1]')} - {place('m[i]')} END"
    pairs = "filter(sequence(0, size(m) - 2), i -> shiftright(m[i], 32) = shiftright(m[i + 1], 32))"
    offsets = f"transform(array(m), m -> CASE WHEN size(m) < 2 THEN array() ELSE transform({pairs}, i -> {offset}) END)[0]"
    run = "named_struct('at', x, 'n', CASE WHEN s.n > 0 AND x = s.at THEN s.n + 1 ELSE 1 END, 'most', greatest(s.most, CASE WHEN s.n > 0 AND x = s.at THEN s.n + 1 ELSE 1 END))"
    grid = lambda shift: f"aggregate(sort_array(transform(o, d -> cast(floor((d + {shift}) / {slack}) AS bigint))), named_struct('at', 0L, 'n', 0, 'most', 0), (s, x) -> {run}, s -> s.most)"
    share = f"CASE WHEN size(m) = 0 THEN IF({a}.n = {b}.n, 1D, 0D) ELSE greatest({grid(0)}, {grid(slack // 2)}) / (size(m) - size(o)) END"
    return F.expr(f"transform(array({both}), m -> transform(array({offsets}), o -> {share})[0])[0]")


def start_at(starts: list[tuple[int, int]], n: Column, part: str) -> Column:
    """The key or tie of start n, counted from 1; of the last or first one where there is no such start, null where there is none."""
    numbers = [s[("key", "tie").index(part)] for s in starts]
    at = F.from_json(F.lit(str(numbers)), "array<bigint>")  # folded to one literal, however many there are
    return F.try_element_at(at, F.greatest(F.least(n, F.lit(len(starts))), F.lit(1)))


def start_is(starts: list[tuple[int, int]], n: Column, part: str) -> Column:
    """Whether start n exists and has the row's own key or tie."""
    return F.coalesce((n > 0) & (start_at(starts, n, part) == F.col(part)), F.lit(False))


def starts_before(starts: list[tuple[int, int]]) -> Column:
    """How many of the sorted starts are at or before the row's (key, tie), by binary search."""
    if not starts:
        return F.lit(0)

    def fits(lo: Column, step: Column) -> Column:
        key, tie = (start_at(starts, lo + step, part) for part in ("key", "tie"))
        return (lo + step <= len(starts)) & ((key < F.col("key")) | ((key == F.col("key")) & (tie <= F.col("tie"))))

    steps = F.lit([1 << i for i in reversed(range(len(starts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(fits(lo, step), lo + step).otherwise(lo))


def range_starts(df: DataFrame) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """The sorted (key, tie) with which ranges of df(key, tie) open, and the first of all rows; there is a range before the first start.

    A key that fills several ranges is split by its ties, which are hashes: of each equal part of their values, the least one
    that occurs opens a range.
    """
    n, low = df.select(F.count(F.lit(1)), F.min("key")).first()
    levels = 0
    while 1 << levels < min(n // ROWS_A_RANGE, MOST_RANGES):
        levels += 1
    shares = [(i + 1) / (1 << levels) for i in range((1 << levels) - 1)]
    filled = Counter(df.select(F.percentile_approx("key", shares, 100_000)).first()[0] if shares and n else [])
    starts = [(key, ANY_TIE) for key in sorted(filled)]
    if any(times > 1 for times in filled.values()):
        at = starts_before(starts)
        many = F.try_element_at(F.from_json(F.lit(str([filled[key] for key, _ in starts])), "array<int>"), F.greatest(at, F.lit(1)))
        part = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("many")), F.col("many") - 1)
        hot = df.select("key", "tie", F.when(start_is(starts, at, "key"), many).alias("many")).where("many > 1")
        opening = [(r["key"], r["tie"]) for r in hot.groupBy("key", part.alias("part")).agg(F.min("tie").alias("tie")).collect()]
        starts = sorted([s for s in starts if filled[s[0]] == 1] + opening)
    return starts, (low, min((tie for key, tie in starts if key == low), default=ANY_TIE))


def in_ranges(df: DataFrame, order: str, by: str) -> DataFrame:
    """(row, by, key, tie, range, guest): df's rows without `by`, that column, and where they lie in ascending order of a long column.

    following() sees each row's successor; the first row follows the last. Rows with a guest over 0 are the successors of
    their range's last row, and to be dropped then.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != by))
    dealt = df.select(row.alias("row"), F.col(f"`{by}`").alias("by"), F.coalesce(F.col(f"`{order}`").cast("long"), F.lit(LAST_ID)).alias("key"))
    dealt = dealt.withColumn("tie", F.xxhash64("by"))
    starts, (low, least) = range_starts(dealt)
    dealt = dealt.withColumn("range", starts_before(starts))
    opens = start_is(starts, F.col("range"), "key") & (start_is(starts, F.col("range"), "tie") | (start_at(starts, F.col("range"), "tie") == ANY_TIE))
    first = (F.col("key") == low) & ((F.lit(least) == ANY_TIE) | (F.col("tie") == least))
    place = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    places = F.array_compact(F.array(place(F.col("range"), 0), F.when(opens, place(F.col("range") - 1, 1)), F.when(first, place(F.lit(len(starts)), 2))))
    dealt = dealt.select("row", "by", "key", "tie", F.explode(places).alias("place")).select("row", "by", "key", "tie", "place.range", "place.guest")
    return dealt.repartition(F.col("range"))


def following(column: str | Column) -> Column:
    """A column's value in the next row of in_ranges(). The window is by columns alone, so that a second one finds the rows sorted."""
    return F.lead(column).over(W.partitionBy("range").orderBy("guest", "key", "tie", "by"))


def with_next(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in ascending order of a long column; the first follows the last."""
    value = lambda c: F.col("by" if c == columns[0] else f"row.`{c}`")
    led = in_ranges(df, order, columns[0]).withColumns({f"next_{c}": following(value(c)) for c in columns}).where("guest = 0")
    own = [c for c in df.columns if c not in [f"next_{x}" for x in columns]]
    return led.select(*(value(c).alias(c) for c in own), *(f"`next_{c}`" for c in columns))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = in_ranges(docs, "doc_id", "text").withColumn("next", F.coalesce(following("by"), F.lit("")))
    n = F.char_length("by")
    half = F.shiftright(n, 1)  # a quotient counts as nullable, and arrays that may hold nulls are not sorted as plain numbers
    rows = rows.withColumns({"n_chars": n.cast("long"), "kept": F.substr("by", F.lit(1), n - half), "taken": F.substr("next", F.lit(1), half)}).drop("next")
    rows = rows.withColumns({"edited_sha256": F.sha2(F.concat("kept", "taken"), 256), "found": F.expr(anchors_sql("by", packed=True))})
    rows = sketched(rows, {"sketch": "found", "edited_sketch": joined_sql("kept", "found", "taken")}).drop("found", "kept", "taken")
    rows = rows.withColumn("next_sketch", following("sketch")).where("guest = 0")
    return rows.select(
        "row.doc_id", "n_chars", "edited_sha256", fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
