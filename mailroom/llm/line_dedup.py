"""Line dedup by content-defined chunks of lines, on DataFrame functions only.

``line_dedup(docs)`` returns ``docs`` with every repeated multi-line chunk cut
out of ``text`` but for its first occurrence in the corpus, ``n_chars`` set to
the new length (if there is such a column), and ``n_removed`` (long): the lines
cut out of the row's text (``_ld_n_removed``, if ``docs`` has an ``n_removed``).

How it works
  1. A text is a sequence of *lines*: it is cut after each line break, and long
     lines are wrapped after each sentence end (``. `` ``! `` ``? ``), because
     passages are pasted into running text, too. A line keeps its separator, so
     the lines of a text concatenate to the text.
  2. Each line is hashed (without white space at its ends), and a rolling hash
     runs over windows of two line hashes. A chunk ends where the rolling hash is
     a local minimum, smaller than its neighbours on both sides. The rule looks
     at four lines around a border and nowhere else: an insertion shifts no
     border beyond them, and a passage is cut alike wherever it was pasted. Two
     minima are never adjacent, so chunks have two lines or more (the first and
     the last of a text may have one).
  3. What repeats lies in lines that recur, so line hashes are counted first, and
     those found more than once are marked in a bitmap of bounded size, which is
     broadcast. Only the *runs* of neighbouring lines in it, and blank ones, go
     on. A line that the bitmap lets through by chance costs time and changes
     nothing, since all that follows compares hashes or bytes of its own.
  4. The chunks in a run are grouped by a 64-bit hash (partial aggregate: a chunk
     held by a third of all rows is one row after the map side), which counts them,
     finds the occurrence with the smallest (doc_id, row, line), which stays, and
     compares their *bytes*: the group is by hash and text first, and a hash that
     then stands for several texts is never looked up without its text.
  5. A shared passage rarely begins and ends at chunk borders. So the first
     occurrence of a chunk brings the 64-bit hashes of the lines before and after
     it, on either side until they have ``LONG`` words or its run ends, and what is
     cut elsewhere grows from the verified chunk outward over lines that equal
     these, until the lines differ. Lines are only cut for equal ones at an earlier
     place, so the first place of every line stays.
  6. A single-line chunk, and one of fewer than ``min_words`` words, never goes:
     short lines recur by chance. Occurrences (without text) are joined to the
     repeated chunks, hot ones by a broadcast of bounded size (``util.meet``), and
     each row gets the set of lines to cut. Of the texts, the lines that recur move
     twice, to their runs and to be compared, and those of rows that lose lines
     move once more, to meet them; a bitmap of these rows leaves the others in place.
  7. A passage of few lines may hold no whole chunk, so every run of lines of
     ``LONG`` words or more is searched for as well. Its *windows* are the
     shortest runs of that many words from each of its lines on, and up to each;
     they cover it, and they do not depend on what stands around it. A line of
     ``LONG`` words is a window of its own. Blank lines do not count. A window is
     known by 96 bits, hashes of its lines' hashes. So a line goes exactly if it is
     in a run of ``LONG`` words that an earlier place holds, too, or in a repeated
     chunk of 4 and 5.

Defined cases: null texts stay null, and empty ones empty; a text whose chunks
all go becomes empty, its row stays; a row with a null doc_id sorts first;
repeated rows are ordered by a row number of the scan; an empty table gives an
empty result; further columns pass through untouched (inside, the operator uses
names that start with ``_ld``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import meet, ready, stored

MIN_WORDS = 12
LONG = 51  # words: runs of lines with over 50 are found wherever they stand
REACH = 2 ** 31 - 1  # lines that a cut may grow over: no bound, beyond LONG words the windows go on
MOST_BITS = 2 ** 27  # of a bitmap that is broadcast: at most 2 million rows of 64 bits
_CUT = r"(?<=\n)|(?<=[.!?]\x20)"
_MARK = "\x01"


def _lines(text):
    """Lines with their separators: a control character is put after each and
    split at, which is much cheaper than the pattern; texts that hold that
    character are split by the pattern."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    fast = F.split(marked, _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, _CUT, -1)).otherwise(fast)


def _part(array: str, begin, end):
    """Elements begin (0-based) to end (exclusive); slice() copies a whole array that was read."""
    return F.when(end > begin, F.transform(F.sequence(begin, end - 1), lambda i: F.get(array, i))).otherwise(
        F.transform(F.array().cast("array<int>"), lambda i: F.get(array, i)))


def _hash(line):
    return F.xxhash64(F.rtrim(F.rtrim(line, F.lit("\n"))))


def _hashes(lines: str):
    return F.transform(lines, _hash)


def chunked(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_ld_lines``, the lines of the text, ``_ld_hash``, their
    hashes, ``_ld_last``, whether a line is the last of its chunk, and
    ``_ld_ends``, the number of lines before the end of each chunk, ascending."""
    df = df.withColumn("_ld_lines", _lines(F.col(text)))
    df = df.withColumn("_ld_hash", _hashes("_ld_lines"))
    # roll[i]: over lines i - 1 and i (0-based); the first line rolls alone
    df = df.withColumn("_ld_roll", F.transform("_ld_hash", lambda x, i: F.xxhash64(x, F.coalesce(F.get("_ld_hash", i - 1), F.lit(0).cast("long")))))
    # null after the last line, which ends a chunk, and before the first, which may not
    least = lambda x, i: (x < F.get("_ld_roll", i - 1)) & (x < F.get("_ld_roll", i + 1))
    df = df.withColumn("_ld_last", F.transform("_ld_roll", lambda x, i: (i + 1 == F.size("_ld_roll")) | F.coalesce(least(x, i), F.lit(False))))
    ends = F.filter(F.transform("_ld_last", lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull())
    return df.withColumn("_ld_ends", ends).drop("_ld_roll")


def _n_words(line):
    """The number of ``\\S+``: spaces and one, in a line whose only white space is single spaces."""
    bare = F.trim(F.replace(line, F.lit("\n"), F.lit("")))
    plain = (bare != "") & ~F.contains(bare, F.lit("  ")) & ~bare.rlike(r"[\t\x0B\f\r]")
    return F.when(plain, F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).otherwise(
        F.regexp_count(line, F.lit(r"\S+")))


def _let(value, use):
    """``use(value)`` with the value computed once for each row: a column that
    a lambda reads may be put into it, and be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(min_words: int):
    """The chunks that lie in a run of lines as a whole and may go, as an array of key,
    b (first line), e (line after the last) and text (its lines without white space at the end)."""
    places = lambda flag, more: F.filter(F.transform(flag, lambda x, i: F.when(x, i + more)), lambda x: x.isNotNull())
    some = lambda array, s: F.slice(array, s["b"] + 1, s["e"] - s["b"])
    # an end before the first begin is of a chunk that begins before the run; the last chunk may have no end in it
    span = _let(places("_ld_begins", 0), lambda begin: F.zip_with(
        begin, F.filter(places("_ld_last", 1), lambda e: e > F.get(begin, 0)), lambda b, e: F.struct(b.alias("b"), e.alias("e"))))
    chunk = _let(F.col("_ld_words"), lambda words: F.filter(span, lambda s: (s["e"] - s["b"] > 1) & (
        F.aggregate(some(words, s), F.lit(0), lambda n, x: n + x) >= min_words)))
    chunk = _let(F.col("_ld_lines"), lambda lines: F.transform(chunk, lambda s: F.struct(
        (s["b"] + F.col("_ld_from")).alias("b"), (s["e"] + F.col("_ld_from")).alias("e"), F.rtrim(
            F.array_join(some(lines, s), ""), F.lit("\n ")).alias("text"))))
    return F.transform(chunk, lambda c: F.struct(F.xxhash64(c["text"]).alias("key"), c["b"].alias("b"), c["e"].alias("e"), c["text"].alias("text")))


def _bitmap(keys: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """A bitmap of the keys (long, a stored table) as rows of 64 bits, and its size:
    16 bits for a key, and never over MOST_BITS, however many there are."""
    size = 64
    while size < min(16 * keys.count(), MOST_BITS):
        size *= 2
    at = F.col(key).bitwiseAND(F.lit(size - 1))
    bits = keys.select(F.shiftright(at, 6).alias("_ld_word"), F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))").alias("bit"))
    return stored(bits.groupBy("_ld_word").agg(F.bit_or("bit").alias("_ld_bits")), name), size


def _marked(rows: DataFrame, key: str, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with _ld_may: true wherever the key is in the bitmap's table, and for some others."""
    bits, size = bitmap
    j = rows.withColumn("_ld_word", F.shiftright(F.col(key).bitwiseAND(F.lit(size - 1)), 6)).join(F.broadcast(bits), "_ld_word", "left")
    may = F.coalesce(F.getbit("_ld_bits", F.col(key).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return j.withColumn("_ld_may", may).drop("_ld_word", "_ld_bits")


def _runs(texts: DataFrame, min_words: int) -> DataFrame:
    """The runs of lines that may recur, each line by itself: _ld_from (first line), _ld_hash, _ld_words and
    _ld_till (words of the row's such lines up to it) of its lines, and _ld_spans, the chunks in it. Lines that do not recur are in no repeated chunk or run, so a
    line left in needlessly costs time only, and blank lines stay."""
    # here and below the outer form: no filter on the number of elements, which would compute them twice
    counts = texts.select(F.explode_outer(_lines(F.col("text"))).alias("x")).select(_hash(F.col("x")).alias("_ld_h")).groupBy("_ld_h").agg(F.count("*").alias("n"))
    again = _bitmap(stored(counts.where("n > 1").select("_ld_h"), "ld-again"), "_ld_h", "ld-bits")
    cut = chunked(texts).select("doc_id", "_ld_row", "_ld_lines", "_ld_last", F.posexplode_outer("_ld_hash").alias("i", "h"))
    cut = _marked(cut, "h", again).withColumn("t", F.get("_ld_lines", F.col("i")))
    cut = cut.where(F.col("_ld_may") | (F.col("t") < "!") & ~F.col("t").rlike(r"\S"))
    words = F.least(_n_words(F.col("t")), F.lit(max(LONG, min_words)))
    begins = F.coalesce(F.get("_ld_last", F.col("i") - 1), F.lit(True))
    cut = cut.select("doc_id", "_ld_row", "i", "h", "t", words.alias("w"), begins.alias("b"), F.get("_ld_last", F.col("i")).alias("e"))
    by = Window.partitionBy("_ld_row").orderBy("i")
    lines = F.sort_array(F.collect_list(F.struct("i", "h", "w", "till", "b", "e", "t")))
    cut = cut.withColumns({"run": F.col("i") - F.row_number().over(by), "till": F.sum("w").over(by)})
    runs = cut.groupBy("_ld_row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("i").alias("_ld_from"), F.sum("w").alias("n"), lines.alias("l"))
    of = {"_ld_hash": "h", "_ld_words": "w", "_ld_till": "till", "_ld_begins": "b", "_ld_last": "e", "_ld_lines": "t"}
    runs = runs.where(F.col("n") >= min(LONG, min_words)).select("doc_id", "_ld_row", "_ld_from", *[F.col(f"l.{c}").alias(k) for k, c in of.items()])
    return stored(runs.select("doc_id", "_ld_row", "_ld_from", "_ld_hash", "_ld_words", "_ld_till", _spans(min_words).alias("_ld_spans")), "ld-runs")


def _at(chunk: str):
    return F.struct("doc_id", "_ld_row", f"{chunk}.b", f"{chunk}.e").alias("_ld_at")


def _with_near(groups: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` (keys, n, _ld_keep) with _ld_near: hashes of the lines before the
    first occurrence, nearest first, and after it, until they have LONG words or
    the run ends: the next line does not recur."""
    of = F.struct(*keys, "n", "_ld_keep")
    firsts = groups.groupBy(F.col("_ld_keep._ld_row").alias("_ld_row")).agg(F.collect_list(of).alias("_ld_of"))
    j = runs.select("_ld_row", "_ld_from", "_ld_hash", "_ld_words").join(firsts, "_ld_row")

    def lines_of(some):  # words in the upper bits, lines in the lower
        got = F.aggregate(some, F.lit(0).cast("long"), lambda got, n: F.when(got < LONG << 32, got + n.cast("long") * 2 ** 32 + 1).otherwise(got))
        return (got % 2 ** 32).cast("int")

    def until(some, rest):
        """Lines of ``some`` that have LONG words, looked for in ``rest``, all lines, if these have not."""
        few = F.when(F.aggregate(some, F.lit(0), lambda a, n: a + n) >= LONG, some).otherwise(rest)
        return lines_of(few)

    def near(g):
        b, e = g["_ld_keep"]["b"] - F.col("_ld_from"), g["_ld_keep"]["e"] - F.col("_ld_from")
        low = F.greatest(b - 16, F.lit(0))
        n = F.size("_ld_words")
        back = until(F.reverse(_part("_ld_words", low, b)), F.reverse(_part("_ld_words", F.lit(0), b)))
        on = until(_part("_ld_words", e, F.least(e + 16, n)), _part("_ld_words", e, n))
        return F.struct(*[g[k].alias(k) for k in [*keys, "n"]], g["_ld_keep"].alias("_ld_keep"), F.struct(
            F.reverse(_part("_ld_hash", b - back, b)).alias("before"), _part("_ld_hash", e, e + on).alias("after")).alias("_ld_near"))

    here = F.filter("_ld_of", lambda g: (g["_ld_keep"]["b"] >= F.col("_ld_from")) & (g["_ld_keep"]["b"] < F.col("_ld_from") + F.size("_ld_hash")))
    return stored(j.select(F.explode_outer(F.transform(here, near)).alias("g")).where("g is not null").select("g.*"), "ld-near")


def _windows(runs: DataFrame) -> DataFrame:
    """One row for each window: _ld_at, _ld_key and _ld_check."""
    long = runs.where(F.aggregate("_ld_words", F.lit(0), lambda a, n: a + n) >= LONG)
    lines = long.select("doc_id", "_ld_row", "_ld_from", F.posexplode_outer("_ld_hash").alias("i", "h"), "_ld_words", "_ld_till")
    lines = lines.select("doc_id", "_ld_row", "_ld_from", (F.col("_ld_from") + F.col("i")).alias("b"), "h",
                         F.get("_ld_words", F.col("i")).alias("w"), F.get("_ld_till", F.col("i")).alias("till"))
    run = Window.partitionBy("_ld_row", "_ld_from")
    # words before the line's end and before it, which no two lines have alike, since blank ones are left out
    lines = lines.where("w > 0").withColumn("since", F.col("till") - F.col("w"))
    on, up = run.orderBy("since").rangeBetween(0, LONG - 1), run.orderBy("till").rangeBetween(1 - LONG, 0)
    lines = lines.withColumns({"on_l": F.collect_list("h").over(on), "on_e": F.max("b").over(on), "on_n": F.max("till").over(on) - F.col("since")})
    lines = lines.withColumns({"on_key": F.xxhash64("on_l"), "on_check": F.hash("on_l")}).drop("on_l")
    lines = lines.withColumns({"up_l": F.collect_list("h").over(up), "up_b": F.min("b").over(up), "up_n": F.col("till") - F.min("since").over(up)})

    def window(enough, key, check, b, e):
        return F.when(enough, F.struct(key.alias("key"), check.alias("check"), b.alias("b"), (e + 1).alias("e")))

    # the shortest run from a line on, and up to it, unless it is the shortest from its first line on, too
    both = F.array(window(F.col("on_n") >= LONG, F.col("on_key"), F.col("on_check"), F.col("b"), F.col("on_e")),
                   window(F.col("up_n") - F.col("w") >= LONG, F.xxhash64("up_l"), F.hash("up_l"), F.col("up_b"), F.col("b")))
    wins = lines.select("doc_id", "_ld_row", F.explode(both).alias("w")).where("w is not null")
    return wins.select(F.col("w.key").alias("_ld_key"), F.col("w.check").alias("_ld_check"), _at("w"))


def _long_runs(runs: DataFrame) -> DataFrame:
    """(row, lines to cut: b, e) of the windows that an earlier place holds."""
    wins = stored(_windows(runs), "ld-windows")
    keys = ["_ld_key", "_ld_check"]
    first = stored(wins.groupBy(keys).agg(F.count("*").alias("n"), F.min("_ld_at").alias("_ld_keep")).where("n > 1"), "ld-first")
    j = meet(wins, first, keys).where(~F.col("_ld_at").eqNullSafe(F.col("_ld_keep")))
    none = F.array().cast("array<bigint>")
    return j.select("_ld_at._ld_row", F.struct("_ld_at.b", "_ld_at.e", none.alias("before"), none.alias("after")).alias("_ld_cut"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """See the module's text. ``docs``: doc_id (long), text, other columns."""
    ready(docs.sparkSession)
    # a row's number tells repeated doc_ids apart; passes over a table of files number its rows alike
    rows = docs.withColumn("_ld_row", F.monotonically_increasing_id())
    runs = _runs(rows.select("doc_id", "_ld_row", "text").where("text is not null and text <> ''"), min_words)
    spans = runs.select("doc_id", "_ld_row", F.explode("_ld_spans").alias("c"))
    keyed = spans.select(F.col("c.key").alias("_ld_key"), _at("c"))
    chunks = spans.select(F.col("c.key").alias("_ld_key"), F.col("c.text").alias("_ld_text"), _at("c"))
    # a text moves once for each task that holds it, then only the number of texts of its key is wanted
    texts = chunks.groupBy("_ld_key", "_ld_text").agg(F.count("*").alias("n"), F.min("_ld_at").alias("_ld_keep"))
    seen = stored(texts.groupBy("_ld_key").agg(F.sum("n").alias("n"), F.min("_ld_keep").alias("_ld_keep"), (F.count("*") == 1).alias("same"))
                  .where("n > 1"), "ld-seen")
    gone = _later(keyed, _with_near(seen.where("same"), runs, ["_ld_key"]), ["_ld_key"])
    if not (clash := seen.where("NOT same").select("_ld_key")).isEmpty():
        keys = ["_ld_key", "_ld_text"]
        gone = gone.union(_later(chunks.join(clash, "_ld_key", "left_semi"), _with_near(
            texts.join(clash, "_ld_key", "left_semi").where("n > 1"), runs, keys), keys))
    gone = gone.union(_long_runs(runs))
    gone = gone.groupBy("_ld_row").agg(F.collect_list("_ld_cut").alias("_ld_gone"))
    return _without(rows, stored(gone, "ld-gone"), docs.columns)


def _alike(a, b):
    """How many leading elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(n)


def _later(occurrences: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(row, chunk to cut: b, e, lines near the first occurrence) of the
    occurrences that are not their group's first."""
    j = meet(occurrences, groups, keys).where(~F.col("_ld_at").eqNullSafe(F.col("_ld_keep")))
    return j.select("_ld_at._ld_row", F.struct("_ld_at.b", "_ld_at.e", "_ld_near.before", "_ld_near.after").alias("_ld_cut"))


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    name = "_ld_n_removed" if "n_removed" in columns else "n_removed"
    some = gone.select(F.xxhash64("_ld_row").alias("_ld_key"))
    rows = _marked(rows.withColumn("_ld_key", F.xxhash64("_ld_row")), "_ld_key", _bitmap(some, "_ld_key", "ld-rows"))
    # rows that lose nothing stay where they are; the others always by sort-merge: the same plan for few and for many rows to change
    whole = rows.where(~F.col("_ld_may")).select(*columns, F.lit(0).cast("long").alias(name))
    j = rows.where("_ld_may").join(gone.hint("merge"), "_ld_row", "left")
    cut = j.withColumn("_ld_lines", F.when(F.col("_ld_gone").isNotNull(), _lines(F.col("text"))))
    cut = cut.withColumn("_ld_hash", _hashes("_ld_lines"))

    def reach(c):
        low = F.greatest(c["b"] - F.size(c["before"]), F.lit(0))
        before = F.reverse(_part("_ld_hash", low, c["b"]))
        after = _part("_ld_hash", c["e"], F.least(c["e"] + F.size(c["after"]), F.size("_ld_hash")))
        return F.when(F.size(c["before"]) + F.size(c["after"]) == 0, F.sequence(c["b"], c["e"] - 1)).otherwise(
            F.sequence(c["b"] - _alike(before, c["before"]), c["e"] - 1 + _alike(after, c["after"])))

    cut = cut.withColumn("_ld_lost", F.array_distinct(F.flatten(F.transform("_ld_gone", reach)))).drop("_ld_hash")
    cut = cut.withColumn("_ld_stay", F.when(F.col("_ld_gone").isNotNull(), F.array_except(
        F.sequence(F.lit(0), F.size("_ld_lines") - 1), "_ld_lost")))
    cut = cut.withColumn("_ld_new", F.array_join(F.transform("_ld_stay", lambda i: F.get("_ld_lines", i)), ""))
    out = {"text": F.coalesce("_ld_new", "text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_ld_gone").isNull(), F.col("n_chars")).otherwise(
            F.length("_ld_new")).cast(rows.schema["n_chars"].dataType)
    removed = F.when(F.col("_ld_gone").isNull(), F.lit(0)).otherwise(F.size("_ld_lost")).cast("long")
    return cut.select(*[out.get(c, F.col(c)).alias(c) for c in columns], removed.alias(name)).union(whole)
