"""Problem 3: splitting long texts at natural boundaries, and checking stored chunks against their text.

A text is handled in ranges, each with a halo on either side. A worker finds the boundaries of its range and works out, for every place where a piece could enter the range, where the
pieces leave it again; these tables are stitched in order, which tells each range its true entry, and the pieces are then cut out range by range at their offsets. The result is that of
one pass over the whole text, whatever the ranges. A page shorter than a range is simply one range.

``split_files`` reads giant files by byte ranges, a range at a time and never whole; offsets are the prefix sums of the ranges' decoded lengths. ``split_texts`` takes texts
that sit in a table's cells, where a cell is loaded whole by its reader and ranges are strides of code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.sources.shared import write_through

#: Code points of a range; of a chunk at most; of a lead-in at most; below which no cut is looked for.
RANGE, MAX_CHARS, LEAD_IN, MIN_CHARS = 65_536, 700, 60, 350
#: Bytes of a range of a file.
FILE_RANGE = 1 << 20
#: Unicode White_Space as a regex class (Java and Python).
BLANK = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NON_BLANK = "[^" + BLANK[1:]

_BOUNDARY = re.compile(rf"(?P<p>\n{BLANK}*\n{BLANK}*)|(?P<s>[।॥৷.?!…]+[\"'”’)\]]*{BLANK}+)|(?P<l>\n{BLANK}*)|(?P<w>{BLANK}+)")
_STRENGTH = {"p": 3, "s": 2, "l": 1, "w": 1}
_LEADING, _EDGES = re.compile(f"{BLANK}*"), re.compile(rf"^{BLANK}+|{BLANK}+\Z")


def boundaries(text: str, offset: int) -> list[list[int]]:
    """Offsets of the boundaries of a slice that begins at ``offset``, by strength: [all, lines and words, sentences, paragraphs]."""
    out: list[list[int]] = [[], [], [], []]
    for m in _BOUNDARY.finditer(text):
        at = offset + m.end()
        out[0].append(at)
        out[_STRENGTH[m.lastgroup or "w"]].append(at)
    return out


def next_cut(marks: list[list[int]], at: int, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> int:
    """End of the piece that begins at ``at``: the last strongest boundary from ``least`` to ``limit`` past it, else the last one before, else the limit."""
    for strength in (3, 2, 1):
        k = bisect_right(marks[strength], at + limit) - 1
        if k >= 0 and marks[strength][k] >= at + least:
            return marks[strength][k]
    k = bisect_right(marks[0], at + least) - 1
    return marks[0][k] if k >= 0 and marks[0][k] > at else at + limit


def exits(marks: list[list[int]], lo: int, hi: int, length: int, limit: int, least: int) -> list[int]:
    """Where pieces that enter a range [lo, hi) leave it, for every entry in [lo, lo + limit), as runs: entry, exit, entry, exit, ... (an entry holds until the next)."""
    leaves: dict[int, int] = {}
    runs: list[int] = []
    for entry in range(lo, min(lo + limit, length)):
        path, at = [], entry
        while at < hi and length - at > limit and at not in leaves:
            path.append(at)
            at = next_cut(marks, at, limit, least)
        out = leaves.get(at, at if at >= hi else length)
        leaves.update(dict.fromkeys(path, out))
        if not runs or runs[-1] != out:
            runs += [entry, out]
    return runs


def stitch(ranges: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(r, entry) of the ranges (r, hi, exits) that a piece begins in, by following the exits from the text's start."""
    out, at = [], 0
    for r, hi, runs in sorted(ranges):
        if at < hi:
            out.append((r, at))
            k = bisect_right(runs[::2], at) - 1
            at = runs[2 * k + 1] if k >= 0 else at
    return out


def cut_range(piece: str, begin: int, lo: int, hi: int, entry: int, length: int, limit: int, least: int, lead_in: int) -> list[tuple[int, int, str, str]]:
    """(char_start, char_end, text, what lies up to ``lead_in`` before it) of the pieces that begin in a range, without blanks at their ends."""
    marks = boundaries(piece, begin)
    out, at = [], entry
    while at < min(hi, length):
        end = length if length - at <= limit else next_cut(marks, at, limit, least)
        raw = piece[at - begin : end - begin]
        body = _EDGES.sub("", raw)
        if body:
            start = at + _LEADING.match(raw).end()
            out.append((start, start + len(body), body, piece[max(start - begin - lead_in, 0) : start - begin]))
        at = end
    return out


def whole_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_chars, r, lo, hi, begin, piece: texts as one range each."""
    n, zero = F.length("text").cast("long"), F.lit(0).cast("long")
    return texts.select(*keys, n.alias("n_chars"), F.lit(0).alias("r"), zero.alias("lo"), n.alias("hi"), zero.alias("begin"), F.col("text").alias("piece"))


def text_ranges(texts: DataFrame, keys: list[str], range_size: int = RANGE, halo: int = 1) -> DataFrame:
    """keys, n_chars, r, lo, hi, begin, piece: texts in ranges [lo, hi) of ``range_size``, each with ``halo`` code points on either side
    (fewer at the text's ends), from ``begin`` on. A range carries its own piece alone."""
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, text in pdf[[*keys, "text"]].itertuples(index=False):
                rows = [
                    (*key, len(text), r, lo, min(lo + range_size, len(text)), max(lo - halo, 0), text[max(lo - halo, 0) : lo + range_size + halo])
                    for r, lo in enumerate(range(0, len(text), range_size))
                ]
                yield pd.DataFrame(rows, columns=[*keys, "n_chars", "r", "lo", "hi", "begin", "piece"], dtype=object)

    return texts.mapInPandas(cut, f"{schema}, n_chars long, r int, lo long, hi long, begin long, piece string")


def _chunks(single: DataFrame | None, several: DataFrame, keys: list[str], limit: int, least: int, lead_in: int) -> DataFrame:
    """Chunks of texts given as ranges (keys, n_chars, r, lo, hi, begin, piece with a halo of limit + lead_in); those in ``single`` are whole texts."""
    types = {f.name: f.dataType.simpleString() for f in several.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs = [exits(boundaries(t, b), lo, hi, n, limit, least) for t, b, lo, hi, n in zip(pdf["piece"], pdf["begin"], pdf["lo"], pdf["hi"], pdf["n_chars"])]
            yield pdf[[*keys, "r", "hi"]].assign(runs=runs)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [stitch(list(zip(t["r"], t["hi"], t["runs"]))) for t in ([{k: [row[k] for row in rows] for k in ("r", "hi", "runs")} for rows in pdf["t"]])]
            yield pdf[keys].assign(e=[[{"r": r, "entry": at} for r, at in rows] for rows in found])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [cut_range(t, b, lo, hi, at, n, limit, least, lead_in) for t, b, lo, hi, at, n in zip(*(pdf[c] for c in ("piece", "begin", "lo", "hi", "entry", "n_chars")))]
            rows = [(*key, *x) for key, found in zip(pdf[keys].itertuples(index=False), own) for x in found]
            yield pd.DataFrame(rows, columns=[*keys, "char_start", "char_end", "text", "lead"], dtype=object)

    # texts of one range are entered at their start; of the others only the tables of exits (a few numbers a range) come together
    tables = several.mapInPandas(leave, f"{schema}, r int, hi long, runs array<long>")
    gathered = tables.groupBy(*keys).agg(F.collect_list(F.struct("r", "hi", "runs")).alias("t"))
    entries = gathered.mapInPandas(enter, f"{schema}, e array<struct<r:int,entry:long>>").select(*keys, F.explode("e").alias("e")).select(*keys, "e.r", "e.entry")
    ready = several.join(entries, [*keys, "r"])
    if single is not None:
        ready = single.withColumn("entry", F.lit(0).cast("long")).unionByName(ready)
    pieces = ready.mapInPandas(cut, f"{schema}, char_start long, char_end long, text string, lead string")
    w = Window.partitionBy(*keys).orderBy("char_start")
    before = F.lag("char_start").over(w)
    size = F.when(before.isNull(), F.lit(0)).otherwise(F.least(F.lit(lead_in), F.col("char_start") - before)).cast("int")
    numbered = pieces.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("size", size)
    embed = F.concat(F.right("lead", F.col("size")), F.col("text"))
    return numbered.select(*keys, "ordinal", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), "text", embed.alias("embed_text"))


def split_texts(texts: DataFrame, keys: list[str], limit: int = MAX_CHARS, lead_in: int = LEAD_IN, range_size: int = RANGE) -> DataFrame:
    """Chunks of every text longer than ``limit``: keys, ordinal, char_start, char_end, text, embed_text.

    ``texts`` has the keys and ``text``; a key counts once (with its smallest text), other columns are ignored. Chunks don't
    overlap; blanks at their ends belong to no chunk. embed_text puts up to ``lead_in`` code points before the chunk (but
    no more than back to the start of the chunk before) in front of it; the first chunk has none. Null, empty and shorter texts have no rows.
    """
    n = F.length("text")
    long = texts.where(n > limit).groupBy(*keys).agg(F.min("text").alias("text"))
    return _chunks(whole_texts(long.where(n <= range_size), keys), text_ranges(long.where(n > range_size), keys, range_size, limit + lead_in), keys, limit, MIN_CHARS, lead_in)


def read_range(path: str, start: int, end: int, halo: int) -> tuple[str, int, int]:
    """(text, code points before the range, code points of the range) of the bytes [start, end) of a UTF-8 file with up to ``halo`` bytes on either side.

    A character belongs to the range that its first byte is in. Bytes that are no UTF-8 become U+FFFD.
    """
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        size = source.size()
        lo, hi = max(start - halo - 4, 0), min(end + halo + 4, size)
        raw = source.read_at(hi - lo, lo)

    def at_start(pos: int) -> int:
        """The first byte from ``pos`` on that begins a character."""
        while lo < pos < hi and raw[pos - lo] & 0xC0 == 0x80:
            pos += 1
        return pos

    first, one, two, last = at_start(lo + (4 if lo else 0)), at_start(start), at_start(min(end, size)), hi
    if hi < size:
        last = hi - 4
        while last > two and raw[last - lo] & 0xC0 == 0x80:
            last -= 1
    parts = [raw[x - lo : y - lo].decode("utf-8", "replace") for x, y in ((first, one), (one, two), (two, last))]
    return "".join(parts), len(parts[0]), len(parts[1])


def split_files(spark: SparkSession, path: str, limit: int = MAX_CHARS, lead_in: int = LEAD_IN, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Chunks of every UTF-8 file under ``path`` that is longer than ``limit``: path, ordinal, char_start, char_end, text, embed_text, as by ``split_texts``.

    Files are read twice by byte ranges: once for their lengths in code points, whose prefix sums are the ranges' offsets, once for their boundaries and pieces. No file is ever in
    one row or one task. Empty files have no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")  # contents aren't read
    last = F.floor((F.col("length") - 1) / range_bytes).cast("int")
    parts = listed.select("path", F.explode(F.sequence(F.lit(0), last)).alias("r")).repartition("path", "r")
    halo = 4 * (limit + lead_in)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(n=[read_range(p, r * range_bytes, (r + 1) * range_bytes, 0)[2] for p, r in zip(pdf["path"], pdf["r"])])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                text, before, _ = read_range(row.path, row.r * range_bytes, (row.r + 1) * range_bytes, halo)
                yield pd.DataFrame({"path": [row.path], "n_chars": row.n_chars, "r": row.r, "lo": row.lo, "hi": row.hi, "begin": row.lo - before, "piece": text})

    lengths = write_through(parts.mapInPandas(measure, "path string, r int, n long"), "lengths")
    w = Window.partitionBy("path").orderBy("r")
    placed = lengths.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n"))
    whole = placed.groupBy("path").agg(F.max("hi").alias("n_chars")).where(F.col("n_chars") > limit)
    ranges = placed.join(whole, "path").repartition("path", "r").mapInPandas(load, "path string, n_chars long, r int, lo long, hi long, begin long, piece string")
    return _chunks(None, ranges, ["path"], limit, MIN_CHARS, lead_in)


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per (document_id, page_no) with a text; repeated deliveries are the caller's to drop by key."""
    return pages.select("document_id", "page_no", "text").where("text is not null")


def broken_chunks(chunks: DataFrame, pages: DataFrame, limit: int = MAX_CHARS, lead_in: int = LEAD_IN, range_size: int = RANGE) -> DataFrame:
    """(id, kind): the rules that each stored chunk breaks: oversized, mid_word, stale, gap, overlap.

    Of a chunk id delivered several times the latest counts. Offsets outside the text are clipped; a chunk whose page has
    no text is checked against an empty one; a null offset counts as 0, a null text or embed_text as empty. A page text's
    deliveries must be equal (the smallest counts otherwise).

    Chunks and page ranges meet once, by page; a text of several ranges is checked range by range and the findings are combined,
    so no long text is gathered in a task; of a page's chunks only offsets are ordered. Stored offsets are given, so no boundary table is built.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    light = chunks.select(
        "id", "document_id", "page_no", "ordinal", zero("char_start").alias("cs"), zero("char_end").alias("ce"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("embed_text", F.lit("")).alias("embed"), "created_at",
    ).repartition("document_id", "page_no")
    latest = Window.partitionBy("document_id", "page_no", "id").orderBy(F.col("created_at").desc_nulls_last(), "cs", "ce", "text", "embed")
    own = light.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n", "created_at")
    order = Window.partitionBy("document_id", "page_no").orderBy("ordinal", "id")
    own = own.withColumn("prev", F.lag("cs").over(order)).withColumn(
        "reach", F.greatest(F.coalesce(F.max("ce").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0)))
    own = own.withColumn("s", F.greatest(F.when(F.col("prev").isNull(), F.col("cs")).otherwise(F.greatest("prev", F.col("cs") - lead_in)), F.lit(0)))

    keys = ["document_id", "page_no"]
    texts = page_texts(pages).groupBy(*keys).agg(F.min("text").alias("text"))
    short = whole_texts(texts.where(F.length("text") <= range_size), keys)
    spread = text_ranges(texts.where(F.length("text") > range_size), keys, range_size)

    # pages of one range (or without a text): each chunk meets its range once
    one = own.join(short, keys, "left").join(spread.where("r = 0").select(*keys, F.lit(True).alias("many")), keys, "left")
    bare = one.where("many is null").withColumns({"piece": F.coalesce("piece", F.lit("")), "begin": zero("begin"), "lo": zero("lo"), "n_chars": zero("n_chars")})
    facts = _facts(bare, range_size)
    single = facts.select("id", F.col("ce") - F.col("cs"), *_FACTS).toDF("id", "extent", *_FACTS)

    # longer texts: a chunk meets every range that its extent, its lead-in and the gap before it touch
    first = F.floor(F.greatest(F.least("s", "reach", F.col("cs") - 1), F.lit(0)) / range_size)
    final = F.floor(F.greatest(F.least(F.greatest("ce", "cs"), F.col("n_chars")), F.lit(0)) / range_size)
    heads = spread.where("r = 0").select(*keys, "n_chars")
    rows = own.join(heads, keys).withColumn("r", F.explode(F.sequence(first, F.greatest(final, first)).cast("array<int>"))).drop("n_chars")
    parts = _facts(rows.join(spread, [*keys, "r"]), range_size)
    both = parts.groupBy("id").agg(
        F.max(F.col("ce") - F.col("cs")).alias("extent"), F.sum("text_chars").alias("text_chars"), F.sum("lead_chars").alias("lead_chars"),
        *[F.max(c).alias(c) for c in _FACTS if not c.endswith("_chars")],
    ).select("id", "extent", *_FACTS)

    found = single.unionByName(both)
    kinds = F.array(
        F.when(F.col("extent") > limit, "oversized"),
        F.when((F.col("start_inside") | F.col("end_inside")) & F.col("holds_blank"), "mid_word"),
        F.when(F.col("text_differs") | (F.col("text_chars") != F.col("text_len")), "stale"),
        F.when(F.col("gap_filled"), "gap"),
        F.when(F.col("lead_differs") | F.col("tail_differs") | (F.col("lead_chars") + F.col("text_len") != F.col("embed_len")), "overlap"),
    )
    return found.select("id", F.explode(F.array_compact(kinds)).alias("kind"))


_FACTS = ["start_inside", "end_inside", "holds_blank", "text_differs", "gap_filled", "lead_differs", "tail_differs", "text_chars", "lead_chars", "text_len", "embed_len"]


def _facts(rows: DataFrame, range_size: int) -> DataFrame:
    """What one range tells about a chunk. ``piece`` holds the range with a halo of one code point."""
    hi = F.least(F.col("lo") + range_size, F.col("n_chars"))

    def cut(a: Column, b: Column) -> Column:
        """The part of t[a, b) within the range."""
        a, b = F.greatest(a, F.col("lo")), F.least(b, hi)
        return F.substring(F.col("piece"), a - F.col("begin") + 1, F.greatest(b - a, F.lit(0)))

    def at(pos: Column) -> Column:
        """The code point at an offset within the range or its halo, else empty."""
        return F.when((pos >= F.col("begin")) & (pos < F.col("n_chars")), F.substring(F.col("piece"), pos - F.col("begin") + 1, F.lit(1))).otherwise(F.lit(""))

    def solid(c: Column) -> Column:
        return c.rlike(f"^{NON_BLANK}")

    def here(pos: Column) -> Column:
        return (pos >= F.col("lo")) & (pos < F.col("lo") + range_size)

    cs, ce, s = F.greatest(F.col("cs"), F.lit(0)), F.col("ce"), F.col("s")
    own, lead = cut(cs, ce), cut(s, cs)
    skip = F.greatest(F.col("lo") - cs, F.lit(0))
    lead_skip = F.greatest(F.col("lo") - s, F.lit(0))
    return rows.withColumns({"own": own, "lead": lead}).select(
        "id", "cs", "ce",
        (here(F.col("cs")) & solid(at(F.col("cs") - 1)) & solid(at(F.col("cs")))).alias("start_inside"),
        (here(F.col("ce") - 1) & solid(at(F.col("ce") - 1)) & solid(at(F.col("ce")))).alias("end_inside"),
        F.col("own").rlike(BLANK).alias("holds_blank"),
        (F.substring(F.col("text"), skip + 1, F.length("own")) != F.col("own")).alias("text_differs"),
        cut(F.col("reach"), cs).rlike(NON_BLANK).alias("gap_filled"),
        (F.substring(F.col("embed"), lead_skip + 1, F.length("lead")) != F.col("lead")).alias("lead_differs"),
        # what follows the lead-in must be the chunk's stored text
        (F.right(F.col("embed"), F.length("text")) != F.col("text")).alias("tail_differs"),
        F.length("own").alias("text_chars"), F.length("lead").alias("lead_chars"), F.length("text").alias("text_len"), F.length("embed").alias("embed_len"),
    )
