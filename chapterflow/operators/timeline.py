"""Timed words, segments and intervals.

Words are (video_id, pos, word, start_s, end_s, confidence); ``pos`` counts a
video's words from 0 in list order without holes. All operators spread a video over blocks (see ``blocks``), so no
step gathers a whole video.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chapterflow.functions import text as T
from chapterflow.functions.timefmt import srt_time
from chapterflow.operators import blocks, runs
from chapterflow.operators.blocks import BLOCK

BLOCK_WORDS = 65536
#: Crowded cells that are sent to all tasks; above that number they are joined.
BROADCAST_CELLS = 10_000
#: Buckets of videos whose words are not in order; the list of them is sent to all tasks.
TANGLED_BUCKETS = 65_536
SENTENCE_ENDS = r"[.!?:;]"

# --- fixed values -----------------------------------------------------------
NOISE_WORDS = ["eh", "ah", "um", "uh", "mhm", "mmm", "tipo", "este"]
KEPT_SHORT_WORDS = ["no", "sí", "yo", "me", "te", "se", "la", "el", "lo"]
# ----------------------------------------------------------------------------


def captions(
    words: DataFrame,
    keys: tuple[str, ...] = ("video_id",),
    gap_s: float = 0.5,
    max_words: int = 25,
    legacy_duplicate_tail: bool = False,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Group words into captions, numbered from 1 inside each key.

    A caption closes after a word holding sentence punctuation, before a
    silence longer than ``gap_s``, or at ``max_words``. The word count
    restarts at every natural break, so a caption starts where the distance
    to the last break is a multiple of ``max_words``. Blank words are skipped.
    ``legacy_duplicate_tail`` repeats a last caption closed by its own last
    word, as the original writer did.

    Words are put together where they are read (see ``runs``), and sections
    are shuffled in place of words: one row for words of a key that follow
    each other in a batch, with its captions as far as they are known there.
    Along the key, a section learns three numbers from those before it (words,
    start of the run it continues, captions). Only pieces of captions that
    cross a border of sections are shuffled again. Keys whose words are out of
    order or come twice, told by the bucket of their hash, are cut into blocks
    of ``block_words`` and shuffled word by word.
    """
    k = list(keys)
    ends = F.col("word").rlike(SENTENCE_ENDS).alias("ends")
    spoken = words.filter(F.col("word").rlike(rf"(?U){T.NON_SPACE}")).select(*k, "pos", "word", "start_s", "end_s", ends)
    has_key = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in k])
    spoken = spoken.filter(has_key)
    # Nothing may be null that is joined: joins ask for that on one side only, and the shuffles would differ by it.
    sections = runs.caption_sections(spoken, k, gap_s, max_words).filter(has_key)
    sections = sections.withColumn("first", F.coalesce("first", F.lit(0))).repartition(*k, "first")
    sections = sections.withColumn("said", F.xxhash64(*sections.columns))
    bucket = F.coalesce(F.pmod(F.xxhash64(*k), F.lit(TANGLED_BUCKETS)).cast("int"), F.lit(0)).alias("bucket")

    # One row per section. With all columns asked for, both uses of the sections have the same shuffle, which runs once.
    facts = ("last", "n", "first_break", "last_break", "opened", "head_start", "tail_end", "tail_ends", "tangled")
    thin = sections.groupBy(*k, "first").agg(
        *[F.max(c).alias(c) for c in facts], F.count(F.lit(1)).alias("same"), F.max("said").alias("said")
    ).filter("said is not null")
    along = Window.partitionBy(*k).orderBy("first")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    starts_run = F.lag("tail_ends").over(along) | (F.col("head_start") - F.lag("tail_end").over(along) > gap_s)
    thin = thin.withColumns(
        {
            "mixed": F.col("tangled") | (F.col("same") > 1) | F.coalesce(F.lag("last").over(along) >= F.col("first"), F.lit(False)),
            "base": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "starts_run": F.when(F.lag("n").over(along).isNull(), F.lit(True)).otherwise(F.coalesce(starts_run, F.lit(False))),
        }
    )
    mixed = F.broadcast(thin.filter("mixed").select(bucket).distinct())
    own_start = F.when(F.col("starts_run"), F.col("base") + 1)
    thin = thin.withColumn(
        "head_run", F.coalesce(own_start, F.max(F.coalesce(F.col("base") + F.col("last_break"), own_start)).over(earlier))
    )
    head = F.coalesce(F.col("first_break") - 1, F.col("n"))
    at = lambda i: F.floor((i - F.col("head_run") + max_words) / max_words)
    thin = thin.withColumns(
        {
            # Words that the caption opened before may still take, and captions the section opens.
            "goes_on": F.pmod(F.col("head_run") - F.col("base") - 1, F.lit(max_words)),
            "all_opened": at(F.col("base") + head) - at(F.col("base")) + F.col("opened"),
        }
    )
    thin = thin.select(
        *k, "first", "said", bucket, "goes_on", "tail_ends", F.coalesce(F.sum("all_opened").over(earlier), F.lit(0)).alias("cues"),
        F.coalesce(F.lead("goes_on").over(along) > 0, F.lit(False)).alias("goes_further"), F.lead("first").over(along).isNull().alias("is_last"),
        (F.col("all_opened") + (F.col("goes_on") > 0).cast("long")).alias("pieces"),
    ).join(mixed, "bucket", "left_anti")
    # The sections stay as they are shuffled: an equality would be one more key, by which they are shuffled anew.
    placed = sections.select(*k, "first", F.col("said").alias("own"), "head", "caps").join(thin, [*k, "first"])
    placed = placed.filter((F.col("own") <= F.col("said")) & (F.col("own") >= F.col("said")))

    # The words before a section's first break are cut into captions now that it is known where the run starts.
    def piece(begin: Column, n: Column) -> Column:
        said = F.slice("head", begin + 1, n)
        return F.struct(
            F.get("head", begin)["start_s"].alias("start_s"), F.get("head", begin + n - 1)["end_s"].alias("end_s"), n.cast("long").alias("n_words"),
            F.array_join(F.transform(said, lambda x: x["word"]), " ").alias("said"),
        )

    size, taken = F.size("head"), F.least(F.size("head"), F.col("goes_on").cast("int"))
    begins = F.when(size > taken, F.sequence(taken, size - 1, F.lit(max_words)))
    cut = F.coalesce(F.transform(begins, lambda x: piece(x, F.least(F.lit(max_words), size - x))), F.slice("caps", 1, 0))
    open_one = F.when(taken > 0, F.array(piece(F.lit(0), taken))).otherwise(F.slice("caps", 1, 0))

    def opened(rows: DataFrame) -> DataFrame:
        """A row for each caption, or piece of one, of the sections."""
        rows = rows.select(*k, "first", "cues", "goes_on", "goes_further", "is_last", "pieces", "tail_ends", F.posexplode_outer(F.concat(open_one, cut, "caps")).alias("i", "x"))
        rows = rows.filter("i is not null")
        is_end = F.col("i") == F.col("pieces") - 1
        return rows.select(
            *k, "first", (F.col("cues") + F.col("i") + (F.col("goes_on") == 0).cast("long")).alias("cue"), "x.*", F.col("tail_ends").alias("ends"),
            (F.col("is_last") & is_end).alias("final"), (((F.col("i") == 0) & (F.col("goes_on") > 0)) | (is_end & F.col("goes_further"))).alias("crosses"),
        )

    crossing = opened(placed.filter("goes_on > 0 or goes_further")).filter("crosses").groupBy(*k, "cue").agg(
        F.min_by("start_s", "first").alias("start_s"),
        F.max_by("end_s", "first").alias("end_s"),
        F.max_by("ends", "first").alias("ends"),
        F.max("final").alias("final"),
        F.sum("n_words").alias("n_words"),
        blocks.ordered_join(F.col("first"), F.col("said"), " ").alias("said"),
    )
    whole = opened(placed).filter("not crosses").select(*crossing.columns)
    # A place adds nothing, but keeps the bucket of a constant key from being one: its join would be a nested loop.
    spread = spoken.withColumn("bucket", bucket + F.pmod(F.xxhash64("pos"), F.lit(1)).cast("int")).join(mixed, "bucket", "left_semi").drop("bucket")
    caps = whole.unionByName(crossing).unionByName(_captions_by_block(spread, k, gap_s, max_words, block_words).select(*crossing.columns))
    n_words = F.col("n_words")
    if legacy_duplicate_tail:
        repeated = F.col("final") & (F.col("ends") | (n_words >= max_words))
        copies = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        caps = caps.withColumn("copy", F.explode(copies)).withColumn("cue", F.col("cue") + F.col("copy"))
    return caps.select(
        *k, "cue", "start_s", "end_s", n_words.alias("n_words"), T.tighten(F.col("said")).alias("text"),
    )


def _captions_by_block(spoken: DataFrame, k: list[str], gap_s: float, max_words: int, block_words: int) -> DataFrame:
    """The captions of spoken words in any order, which shuffle by key and block."""
    rows = blocks.spread(spoken, k, "pos", block_words)
    along = blocks.block_window(k, "pos")
    breaks = F.lag("ends").over(along) | (F.col("start_s") - F.lag("end_s").over(along) > gap_s)
    local = rows.select(
        "*", F.row_number().over(along).cast("long").alias("r"), breaks.alias("breaks")
    ).withColumn("run", F.max(F.when(F.col("breaks"), F.col("r"))).over(blocks.so_far(k, "pos")))

    # One row per block: its size, its first and last break, the captions
    # opened after its first break, and its border words. No word is null;
    # asking so makes this shuffle the same as that of the words, so it runs once.
    opened = F.col("run").isNotNull() & ((F.col("r") - F.col("run")) % max_words == 0)
    per_block = local.groupBy(*k, BLOCK).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("breaks"), F.col("r"))).alias("first_break"),
        F.max("run").alias("last_break"),
        F.sum(opened.cast("long")).alias("opened"),
        F.min_by("start_s", "r").alias("head_start"),
        F.max_by("end_s", "r").alias("tail_end"),
        F.max_by("ends", "r").alias("tail_ends"),
        F.first("word").alias("said"),
    ).filter("said is not null")
    earlier = blocks.blocks_before(k)
    border = Window.partitionBy(*k).orderBy(BLOCK)
    starts_run = F.lag("tail_ends").over(border) | (F.col("head_start") - F.lag("tail_end").over(border) > gap_s)
    per_block = per_block.withColumns(
        {
            "base": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "total": F.sum("n").over(Window.partitionBy(*k)),
            "starts_run": F.coalesce(starts_run, F.lit(True)),
        }
    )
    own_start = F.when(F.col("starts_run"), F.col("base") + 1)
    per_block = per_block.withColumn(
        "head_run", F.coalesce(own_start, F.max(F.coalesce(F.col("base") + F.col("last_break"), own_start)).over(earlier))
    )
    head = F.coalesce(F.col("first_break") - 1, F.col("n"))
    at = lambda i: F.floor((i - F.col("head_run") + max_words) / max_words)
    per_block = per_block.withColumn("head_opened", at(F.col("base") + head) - at(F.col("base")))
    per_block = per_block.select(
        *k, BLOCK, "base", "total", "head_run",
        F.coalesce(F.sum(F.col("head_opened") + F.col("opened")).over(earlier), F.lit(0)).alias("cues"),
    )

    placed = local.join(per_block, [*k, BLOCK], "left")
    i = F.col("base") + F.col("r")
    run = F.coalesce(F.col("base") + F.col("run"), F.col("head_run"))
    placed = placed.select(
        *k, BLOCK, "pos", "word", "start_s", "end_s", "ends", "cues", i.alias("i"),
        ((i - run) % max_words == 0).alias("opens"), (i == F.col("total")).alias("final"),
    )
    cue = F.col("cues") + F.sum(F.col("opens").cast("long")).over(blocks.so_far(k, "pos"))
    placed = placed.select(*k, BLOCK, "word", "start_s", "end_s", "ends", "i", "final", cue.alias("cue"))

    # A block's pieces of captions are joined where the block lies; between blocks only text travels.
    pieces = placed.groupBy(*k, BLOCK, "cue").agg(
        F.min_by("start_s", "i").alias("start_s"),
        F.max_by("end_s", "i").alias("end_s"),
        F.max_by("ends", "i").alias("ends"),
        F.max("final").alias("final"),
        F.count(F.lit(1)).alias("n_words"),
        blocks.ordered_join(F.col("i"), F.col("word"), " ").alias("said"),
    )
    return pieces.groupBy(*k, "cue").agg(
        F.min_by("start_s", BLOCK).alias("start_s"),
        F.max_by("end_s", BLOCK).alias("end_s"),
        F.max_by("ends", BLOCK).alias("ends"),
        F.max("final").alias("final"),
        F.sum("n_words").alias("n_words"),
        blocks.ordered_join(F.col(BLOCK), F.col("said"), " ").alias("said"),
    )


def captions_from_text(chapters: DataFrame, keys: tuple[str, ...] = ("video_id", "number")) -> DataFrame:
    """Captions for text without word times: sentences share the span equally.

    A sentence ends at ``.!?`` once more than ten characters have gathered.
    Row-local: one chapter row in, its captions out.
    """
    sentences = F.regexp_extract_all("transcript", F.lit(r"(?s)(.{10,}?[.!?]|.+\z)"), F.lit(1))
    sentences = F.filter(F.transform(sentences, T.strip), lambda s: s != "")
    k = list(keys)
    cut = chapters.select(*k, "start_s", "end_s", sentences.alias("__all"))
    step = (F.col("end_s") - F.col("start_s")) / F.size("__all")
    rows = cut.select(*k, "start_s", step.alias("__step"), F.posexplode_outer("__all").alias("__i", "text"))
    rows = rows.filter("__i is not null")
    return rows.select(
        *k,
        (F.col("__i") + 1).cast("long").alias("cue"),
        (F.col("start_s") + F.col("__i") * F.col("__step")).alias("start_s"),
        (F.col("start_s") + (F.col("__i") + 1) * F.col("__step")).alias("end_s"),
        "text",
    )


def crowded_cells(df: DataFrame, keys: list[str], cell_rows: int, rows: Column | None = None) -> DataFrame:
    """(keys.., __salts) of cells with more than ``cell_rows`` rows: as many salts as give each that many."""
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    counts = df.groupBy(*keys).agg(n.alias("__n")).filter(F.col("__n") > cell_rows)
    return counts.select(*keys, F.ceil(F.col("__n") / cell_rows).cast("int").alias("__salts"))


def interval_join(
    many: DataFrame,
    few: DataFrame,
    on: tuple[str, ...] = ("video_id",),
    bucket_s: float = 60.0,
    cell_rows: int = 100_000,
) -> DataFrame:
    """Inner join on closed-interval overlap of (start_s, end_s).

    Both sides are cut to ``bucket_s`` cells and equi-joined per cell; a pair
    meeting in several cells is kept only in the first common one. Rows of
    ``many`` that follow each other in one cell are packed where they are read
    (see ``runs``), so packs are shuffled in place of rows. A first pass counts
    the rows of ``many`` in each cell: a cell with more than ``cell_rows``
    gets salts after its count, and ``few`` is repeated for these cells alone,
    so a crowded cell is worked on by many tasks and thin ones are left as
    they are. Columns of ``few`` that clash get the suffix ``_r``.
    """

    def bounds(df: DataFrame, side: str) -> DataFrame:
        a, b = F.floor(F.col("start_s") / bucket_s), F.floor(F.col("end_s") / bucket_s)
        return df.withColumns({f"__first_{side}": F.least(a, b), f"__last_{side}": F.greatest(a, b)})

    def cells(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("__cell", F.explode(F.sequence(f"__first_{side}", f"__last_{side}"))).drop(f"__last_{side}")

    given, others = many.columns, [c for c in many.columns if c not in on]
    bounded = bounds(many, "l").filter("__first_l is not null")
    left = cells(runs.packs(bounded, [*on, "__first_l", "__last_l"]).withColumnRenamed("n", "__n"), "l")
    right = cells(bounds(few, "r"), "r")
    clash = [c for c in few.columns if c in given and c not in on]
    right = right.withColumnsRenamed({c: c + "_r" for c in clash})
    added = [c for c in right.columns if c not in (*on, "__cell", "__first_r")]
    keys = [*on, "__cell"]
    crowded = crowded_cells(left, keys, cell_rows, F.col("__n"))
    known = crowded.limit(BROADCAST_CELLS + 1).collect()
    if known:
        # Few crowded cells go to all tasks; more of them meet the rows by their key.
        marks = F.broadcast(many.sparkSession.createDataFrame(known, crowded.schema)) if len(known) <= BROADCAST_CELLS else crowded
        salts = F.coalesce("__salts", F.lit(1))
        # Places tell packs with the same times apart, such as those of untimed words at 0.
        told_by = [F.get(c, F.lit(0)) for c in ("pos", "start_s", "end_s") if c in given]
        left = left.join(marks, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*told_by), salts).cast("int")).drop("__salts")
        right = right.join(marks, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
        keys.append("__salt")
    met = left.join(right, keys).filter(F.col("__cell") == F.greatest("__first_l", "__first_r"))
    pairs = met.select(*on, *added, F.inline_outer(F.arrays_zip(*others)))
    pairs = pairs.filter((F.col("end_s") >= F.col("start_s_r")) & (F.col("start_s") <= F.col("end_s_r")))
    return pairs.select(*on, *others, *added)


def chapter_words(words: DataFrame, chapters: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Words of each chapter; a word touching two chapters belongs to both."""
    spans = chapters.select("video_id", "number", "start_s", "end_s")
    hit = interval_join(words, spans, bucket_s=bucket_s)
    return hit.select("video_id", "number", *[c for c in words.columns if c != "video_id"])


def chapter_captions(words: DataFrame, chapters: DataFrame) -> DataFrame:
    """Captions per chapter: from words where any overlap, else from its text."""
    k = ("video_id", "number")
    inside = chapter_words(words.select("video_id", "pos", "word", "start_s", "end_s"), chapters)
    timed = captions(inside, keys=k).select(*k, "cue", "start_s", "end_s", "text", F.lit("words").alias("origin"))
    # With all columns of the captions asked for, both uses have the same shuffles, which run once.
    covered = timed.groupBy(*k).agg(F.max(F.struct("start_s", "end_s", "text")).alias("said")).filter("said is not null").select(*k)
    plain = captions_from_text(chapters.join(covered, list(k), "left_anti"))
    return timed.unionByName(plain.withColumn("origin", F.lit("text")))


def srt_documents(cues: DataFrame, keys: tuple[str, ...] = ("video_id",), cues_per_part: int = 20000) -> DataFrame:
    """Subtitle documents. One part per key unless it has over ``cues_per_part`` cues.

    Parts joined by a newline in ``part`` order are the whole document, so
    no document, however long, is assembled in one task.
    """
    entry = F.concat_ws(
        "\n",
        F.col("cue").cast("string"),
        F.concat(srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.col("end_s"))),
        F.col("text"),
        F.lit(""),
    )
    part = F.expr(f"(cue - 1) div {cues_per_part}")
    return cues.groupBy(*keys, part.alias("part")).agg(
        blocks.ordered_join(F.col("cue"), entry, "\n").alias("srt"), F.count(F.lit(1)).alias("n_cues")
    )


def word_order_issues(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words that start before their predecessor ends.

    Neighbours are compared where they are read (see ``runs``); one row per
    run is shuffled, and the borders of a video's runs are compared along
    them. Where runs of a video overlap in places, or places are missing or
    out of order, its words are shuffled and compared one by one. These videos
    are told by the bucket of their hash, so no list of them grows.
    """
    w = words.select("video_id", "pos", "word", "start_s", "end_s")
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(TANGLED_BUCKETS)).cast("int")
    rows = runs.order_runs(w).repartition("video_id")
    # With all columns asked for, both uses of the rows have the same shuffle, which runs once.
    along = Window.partitionBy("video_id").orderBy("first", "last", "tangled")
    tangled = F.col("tangled") | F.coalesce(F.lag("last").over(along) >= F.col("first"), F.lit(False))
    rows = rows.select(
        *rows.columns, bucket.alias("bucket"), tangled.alias("mixed"),
        F.lag("last_word").over(along).alias("prev_word"), F.lag("last_end").over(along).alias("prev_end"),
    )
    mixed = rows.filter("mixed").groupBy("bucket").agg(F.max(F.xxhash64(*rows.columns)).alias("said"))
    mixed = F.broadcast(mixed.filter("said is not null").select("bucket"))
    border = F.struct(F.col("first").alias("pos"), "word", "start_s", "prev_word", "prev_end")
    early = F.when(F.col("start_s") < F.col("prev_end"), F.array(border)).otherwise(F.slice("found", 1, 0))
    named = F.transform(F.concat("found", early), lambda x: F.struct(F.col("video_id"), F.col("bucket"), x.alias("x")))
    near = rows.select(F.inline(named)).join(mixed, "bucket", "left_anti").select("video_id", "x.*")
    rest = blocks.with_lag(
        w.withColumn("bucket", bucket).join(mixed, "bucket", "left_semi").drop("bucket"),
        ["video_id"], "pos", block_words, prev_word=F.col("word"), prev_end=F.col("end_s"),
    ).filter(F.col("start_s") < F.col("prev_end"))
    message = F.format_string(
        "Word '%s' at %ss starts before '%s' ends at %ss",
        F.col("word"), F.col("start_s").cast("string"), F.col("prev_word"), F.col("prev_end").cast("string"),
    )
    return near.unionByName(rest.select(*near.columns)).select("video_id", "pos", message.alias("message"))


def silences(words: DataFrame, gap_s: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    w = words.select("video_id", "pos", "start_s", "end_s")
    w = blocks.with_lag(w, ["video_id"], "pos", block_words, prev_end=F.col("end_s"))
    return w.filter(F.col("start_s") - F.col("prev_end") > gap_s).select(
        "video_id", F.col("prev_end").alias("start_s"), F.col("start_s").alias("end_s")
    )


def failed_regions(transcripts: DataFrame, words: DataFrame, gap_s: float = 5.0) -> DataFrame:
    """Where transcription failed, for transcripts carrying a failure marker.

    Silences longer than ``gap_s``, or the whole duration if no word exists.
    Silences are found first: they are few, so the join that keeps marked
    videos moves little.
    """
    marked = transcripts.filter(F.col("text").contains(T.FAILED_MARKER)).select("video_id", "duration_s")
    gaps = silences(words, gap_s).join(marked.select("video_id"), "video_id", "left_semi")
    with_words = words.select("video_id").distinct()
    silent = marked.join(with_words, "video_id", "left_anti").select(
        "video_id", F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")
    )
    return gaps.unionByName(silent)


def confidence_windows(transcripts: DataFrame, words: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Mean word confidence per time window; windows without words report 0.

    A word counts where it lies wholly inside the closed window. Words are
    summed by window where they are read, so a crowded window sends one row a
    task. Only a last window that ends with its video before a word of it does
    is summed again, with that end.
    """
    spans = transcripts.filter(F.col("duration_s") > 0).select("video_id", "duration_s")
    n = F.ceil(F.col("duration_s") / window_s)
    windows = spans.select(
        "video_id", "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("window")
    ).withColumns(
        {
            "start_s": F.col("window") * F.lit(window_s),
            "end_s": F.least((F.col("window") + 1) * F.lit(window_s), F.col("duration_s")),
        }
    )
    cell = F.floor(F.col("start_s") / window_s)
    # A zero-length word on a border lies inside the window on either side.
    on_border = (F.col("end_s") == F.col("start_s")) & (F.col("start_s") == cell * window_s) & (cell > 0)
    placed = words.select(
        "video_id", F.explode(F.when(on_border, F.array(cell - 1, cell)).otherwise(F.array(cell))).alias("window"), F.col("end_s").alias("w_end"), "confidence"
    ).filter(F.col("w_end") <= (F.col("window") + 1) * F.lit(window_s))
    sums = [F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("c")]
    k = ["video_id", "window", "start_s", "end_s"]
    total = windows.join(placed.groupBy("video_id", "window").agg(*sums, F.max("w_end").alias("last")), ["video_id", "window"], "left")
    cut = total.filter(F.col("last") > F.col("end_s")).select(*k)
    again = placed.join(cut, ["video_id", "window"]).filter(F.col("w_end") <= F.col("end_s")).groupBy(*k).agg(*sums)
    whole = total.filter(F.col("last").isNull() | (F.col("last") <= F.col("end_s"))).select(*k, "s", "c")
    # Videos without any word report no window at all.
    spoken = words.select("video_id").distinct()
    n_words = F.coalesce("c", F.lit(0).cast("long"))
    return whole.unionByName(cut.join(again, k, "left")).join(spoken, "video_id", "left_semi").select(
        *k, n_words.alias("n_words"), F.coalesce(F.col("s") / F.col("c"), F.lit(0.0)).alias("confidence")
    )


def transcript_issues(transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """One row per problem of a transcript."""
    plain = T.strip(F.replace(F.col("text"), F.lit(T.FAILED_MARKER), F.lit("")))
    marked = F.col("text").contains(T.FAILED_MARKER)
    found = F.array_compact(
        F.array(
            F.when((plain == "") & ~marked, F.lit("Transcription text is empty")),
            F.when(F.col("duration_s") <= 0, F.concat(F.lit("Duration is non-positive: "), F.col("duration_s").cast("string"))),
            F.when(
                (F.col("confidence") < 0) | (F.col("confidence") > 1),
                F.concat(F.lit("Confidence out of bounds: "), F.col("confidence").cast("string")),
            ),
        )
    )
    scalar = transcripts.select("video_id", F.lit(-1).cast("long").alias("pos"), F.explode(found).alias("message"))
    return scalar.unionByName(word_order_issues(words))


def validate_transcripts(transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """Validation row per transcript; the messages are ``transcript_issues``."""
    counted = words.groupBy("video_id").agg(F.count(F.lit(1)).alias("word_count"))
    issues = transcript_issues(transcripts, words).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_issues"))
    markers = F.regexp_count("text", F.lit(r"\[TRANSCRIPTION_FAILED\]")).cast("long")
    base = transcripts.select("video_id", "duration_s", "confidence", markers.alias("failed_region_count"))
    joined = base.join(counted, "video_id", "left").join(issues, "video_id", "left")
    n_issues = F.coalesce("n_issues", F.lit(0).cast("long"))
    return joined.select(
        "video_id",
        (n_issues == 0).alias("is_valid"),
        (F.col("failed_region_count") > 0).alias("has_failed_regions"),
        "failed_region_count",
        F.coalesce("word_count", F.lit(0).cast("long")).alias("word_count"),
        "duration_s",
        "confidence",
        n_issues.alias("n_issues"),
    )


def _containing(probes: DataFrame, spans: DataFrame, bucket_s: float, *carried: str, short: bool = False) -> DataFrame:
    """For each (video_id, probe_id, at_s), the first span in list order around it, with its ``carried`` columns.

    ``short`` columns travel with the spans, which then meet the points once.
    """
    points = probes.select("video_id", "probe_id", F.col("at_s").alias("start_s"), F.col("at_s").alias("end_s"))
    if short:
        hits = interval_join(spans, points, bucket_s=bucket_s)
        one = hits.groupBy("video_id", "probe_id").agg(F.min_by(F.struct("pos", *carried), "pos").alias("first"))
        return one.select("video_id", "probe_id", "first.*")
    # Only places and times meet the points; what is carried joins the one span found.
    hits = interval_join(spans.select("video_id", "pos", "start_s", "end_s"), points, bucket_s=bucket_s)
    first = hits.groupBy("video_id", "probe_id").agg(F.min(F.struct("pos", F.col("start_s_r").alias("at_s"))).alias("first"))
    found = first.select("video_id", "probe_id", "first.*").join(spans, ["video_id", "pos"]).filter(F.col("at_s").between(F.col("start_s"), F.col("end_s")))
    one = found.groupBy("video_id", "probe_id").agg(F.min_by(F.struct("pos", *carried), "pos").alias("first"))
    return one.select("video_id", "probe_id", "first.*")


def word_at(words: DataFrame, probes: DataFrame, bucket_s: float = 10.0) -> DataFrame:
    """The first word spoken at each probe time, or nulls."""
    spans = words.select("video_id", "pos", "start_s", "end_s", "word", "confidence")
    return probes.join(_containing(probes, spans, bucket_s, "word", "confidence", short=True), ["video_id", "probe_id"], "left")


def segment_at(segments: DataFrame, probes: DataFrame, bucket_s: float = 10.0) -> DataFrame:
    """The first segment covering each probe time; missing bounds count as 0."""
    spans = segments.select(
        "video_id", "pos",
        F.coalesce("start_s", F.lit(0.0)).alias("start_s"), F.coalesce("end_s", F.lit(0.0)).alias("end_s"),
        "text",
    )
    return probes.join(_containing(probes, spans, bucket_s, "text"), ["video_id", "probe_id"], "left")


def snap_to_segments(probes: DataFrame, segments: DataFrame, block_s: float = 3600.0) -> DataFrame:
    """Nearest-segment snap of (video_id, probe_id, ratio, duration_s).

    The target is ratio x duration. Inside any segment it stays; otherwise it
    moves to the nearest segment start, the earlier one on a tie. Segments and
    targets are merged on the time axis; running values per time block give
    the latest end so far, the last start and the next start, so neither a
    fan-out join nor a whole video in one task is needed.
    """
    k = ["video_id"]
    inner = (F.col("ratio") > 0) & (F.col("ratio") < 1)
    fixed = F.when(inner, F.lit(None)).when(F.col("ratio") <= 0, F.lit(0.0)).otherwise(F.col("duration_s"))
    # A row is a segment (0; "value" is its end), a target to snap (1) or one that is settled (2; "value" is where).
    asked = probes.select(
        *k, "probe_id", (F.col("ratio") * F.col("duration_s")).alias("t"),
        F.when(inner, 1).otherwise(2).alias("kind"), fixed.cast("double").alias("value"),
    )
    given = segments.select(
        *k, F.lit(None).cast(dict(probes.dtypes)["probe_id"]).alias("probe_id"), F.col("start_s").alias("t"),
        F.lit(0).alias("kind"), F.col("end_s").alias("value"),
    )
    axis = blocks.spread(given.unionByName(asked), k, "t", block_s)
    seg_start, seg_end = F.when(F.col("kind") == 0, F.col("t")), F.when(F.col("kind") == 0, F.col("value"))
    # All that looks along a block shares one sort, and the join behind it asks for no other.
    so_far = blocks.so_far(k, "t", "kind")
    following = F.expr("lead(case when kind = 0 then t end) ignore nulls")
    local = axis.select(
        "*", F.max(seg_end).over(so_far).alias("reach"), F.max(seg_start).over(so_far).alias("last"),
        following.over(blocks.block_window(k, "t", "kind")).alias("next"),
    )
    found = blocks.carry(
        local.filter("kind > 0"), k, source=axis, once=True,
        __reach=(F.max(seg_end), "max_before"),
        __last=(F.max(seg_start), "max_before"),
        __next=(F.min(seg_start), "first_after"),
    )
    found = found.withColumns(
        {
            "reach": F.greatest("reach", "__reach"), "last": F.greatest("last", "__last"),
            "next": F.coalesce("next", "__next"),
        }
    )
    nearest = (
        F.when(F.col("next").isNull(), F.col("last"))
        .when(F.col("last").isNull(), F.col("next"))
        .when(F.abs(F.col("last") - F.col("t")) <= F.abs(F.col("next") - F.col("t")), F.col("last"))
        .otherwise(F.col("next"))
    )
    snapped = F.when(F.col("reach") >= F.col("t"), F.col("t")).otherwise(F.coalesce(nearest, F.col("t")))
    at = F.when(F.col("kind") == 1, snapped).otherwise(F.col("value"))
    return found.select(*k, "probe_id", at.alias("at_s"))


def clean_words(
    words: DataFrame,
    noise: list[str] | None = None,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Drop noise words, stray short words and immediate repeats.

    A repeat is judged against the previous kept word. A video that would
    lose every word keeps them all.
    """
    k = ["video_id"]
    w = blocks.spread(words, k, "pos", block_words)
    spoken = F.lower(T.strip(F.col("word")))
    usable = ~spoken.isin(NOISE_WORDS if noise is None else noise) & (
        (F.length(spoken) > 2) | spoken.isin(KEPT_SHORT_WORDS if keep is None else keep)
    )
    w = w.withColumns({"__w": spoken, "__usable": F.coalesce(usable, F.lit(False))})
    # The first usable word of a video is never a repeat, so "any usable" means "any kept".
    w = blocks.carry(
        w, k,
        __any=(F.max("__usable"), "max_all"),
        __tail=(F.max_by(F.when(F.col("__usable"), F.col("__w")), F.when(F.col("__usable"), F.col("pos"))), "last_before"),
    )
    previous = F.coalesce(
        F.last(F.when(F.col("__usable"), F.col("__w")), ignorenulls=True).over(blocks.before(k, "pos")), F.col("__tail")
    )
    w = w.withColumn("__prev", previous)
    kept = F.col("__usable") & ~F.col("__w").eqNullSafe(F.col("__prev"))
    return w.filter(kept | ~F.col("__any")).select(*words.columns)


def speaker_turns(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Consecutive words of one speaker as (turn, speaker, start_s, end_s, n_words)."""
    k = ["video_id"]
    w = words.select(*k, "pos", "speaker", "start_s", "end_s")
    w = blocks.with_lag(w, k, "pos", block_words, __prev=F.col("speaker"))
    changed = (~F.col("speaker").eqNullSafe(F.col("__prev"))).cast("long")
    w = blocks.add_running_sum(w, k, "pos", "turn", changed)
    return w.groupBy(*k, "turn").agg(
        F.min_by("speaker", "pos").alias("speaker"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.count(F.lit(1)).alias("n_words"),
    )


def transcript_stats(transcripts: DataFrame, words: DataFrame) -> DataFrame:
    """Mean seconds per word, plus whether words exist at all."""
    counted = words.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    mean = F.when(n > 0, F.round(F.col("duration_s") / n, 4)).otherwise(F.lit(0.0))
    return transcripts.join(counted, "video_id", "left").select(
        "video_id", n.alias("word_count"), (n > 0).alias("has_word_timestamps"), mean.alias("seconds_per_word")
    )
