"""Transcript tables derived from the given tables, at any scale.

Everything is a narrow projection of one source row (tokens, lines, times in
whole milliseconds) unless noted, so the derivations add no shuffle. Arrays
are opened with the outer generators and a null filter: for the plain ones
the optimizer adds a size check that evaluates the array expression twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterflow.functions import text as T

PROVIDERS = ["groq", "assemblyai", "openai", "mlx-whisper"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over the cores where it has fewer splits than cores.

    Rows grow manifold when texts become words, and a file of one row group
    would leave all of that to one task. Tables of many files are left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def _start_ms(pos: str) -> Column:
    return F.expr(f"{pos} * 400 + 700 * ({pos} div 12) + 6000 * ({pos} div 150)")


def _timed(rows: DataFrame, key: str) -> DataFrame:
    """(key.., pos, word) with word times and confidence."""
    start, width = _start_ms("pos"), 100 + 15 * F.least(F.length("word"), F.lit(18))
    return rows.withColumns(
        {
            "start_s": start / F.lit(1000.0),
            "end_s": (start + width) / F.lit(1000.0),
            "confidence": F.expr(f"(50 + ({key} * 7 + pos * 13) % 51) / 100D"),
        }
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_from(table(spark, sf_dir, "documents"))


def words_from(documents: DataFrame) -> DataFrame:
    """Words of documents; also usable on a stream of them."""
    docs = documents.select(F.col("doc_id").alias("video_id"), "text")
    rows = docs.select("video_id", F.posexplode_outer(_tokens(F.col("text"))).alias("p", "word")).filter("p is not null")
    rows = rows.select("video_id", F.col("p").cast("long").alias("pos"), "word")
    return _timed(rows, "video_id")


#: Deliveries of the live feed; words of a part come one delivery after it at the latest, its mark with them.
PARTS = 5


def word_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and marks with the delivery in which each arrives: long videos first, some words late.

    Every word comes twice, as from two overlapping chunks; the second copy
    may come one delivery later.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), _tokens(F.col("text")).alias("toks"))
    docs = docs.withColumn("n", F.size("toks").cast("long"))
    docs = docs.withColumn("duration_s", _last_end_ms(F.col("toks")) / F.lit(1000.0))
    after = F.when(F.col("n") > 1000, 0).otherwise(2)
    said = docs.select("video_id", "n", "duration_s", after.alias("after"), F.posexplode("toks").alias("p", "word"))
    said = _timed(said.withColumn("pos", F.col("p").cast("long")), "video_id")
    part = F.expr(f"pos * {PARTS} div n")
    copies = said.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    late = F.when((F.col("pos") % 97 == 5) | ((F.col("copy") == 1) & (F.col("pos") % 2 == 0)), 1).otherwise(0)
    none = F.lit(None)
    heard = copies.select(
        "video_id", "pos", "word", "start_s", "end_s", "confidence", none.cast("double").alias("from_s"), none.cast("double").alias("to_s"), "duration_s",
        none.cast("boolean").alias("final"), "copy", (F.col("after") + part + late).cast("int").alias("delivery"),
    )
    # The mark of a part: its first word and that of the next part.
    at = lambda p: F.expr(f"cast(ceil({p} * n / {PARTS}) as bigint)")
    marks = docs.select("video_id", "n", "duration_s", after.alias("after"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    marks = marks.withColumns({"pos0": at("part"), "pos1": at("(part + 1)"), "final": F.col("part") == PARTS - 1})
    marks = marks.select(
        "video_id", F.when(F.col("final"), F.col("n")).alias("pos"), none.cast("string").alias("word"), none.cast("double").alias("start_s"),
        none.cast("double").alias("end_s"), none.cast("double").alias("confidence"),
        F.when(F.col("part") == 0, F.lit(0.0)).otherwise(_start_ms("pos0") / F.lit(1000.0)).alias("from_s"),
        F.when(F.col("final"), F.col("duration_s")).otherwise(_start_ms("pos1") / F.lit(1000.0)).alias("to_s"), "duration_s",
        "final", F.lit(0).alias("copy"), (F.col("after") + F.col("part") + 1).cast("int").alias("delivery"),
    )
    return heard.unionByName(marks)


def words_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.when(F.col("pos") % 37 == 5, F.lit(0.45)).otherwise(F.lit(0.0))
    return words(spark, sf_dir).withColumns(
        {"start_s": F.round(F.col("start_s") - back, 3), "end_s": F.round(F.col("end_s") - back, 3)}
    )


def _last_end_ms(toks: Column) -> Column:
    n = F.size(toks)
    return F.when(
        n > 0, _start_ms("(n - 1)") + 100 + 15 * F.least(F.length(F.element_at(toks, -1)), F.lit(18))
    ).otherwise(F.lit(0)).cast("long")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per document, with a failure marker on every eleventh."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")
    cut = docs.withColumn("toks", _tokens(F.col("text"))).withColumn("n", F.size("toks").cast("long"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        F.lit(0).cast("long"),
        lambda acc, p: acc + 50 + (F.col("video_id") * 7 + p * 13) % 51,
    )
    marker = F.when(F.col("video_id") % 11 == 0, F.lit(" " + T.FAILED_MARKER)).otherwise(F.lit(""))
    return cut.select(
        "video_id",
        F.concat("text", marker).alias("text"),
        (_last_end_ms(F.col("toks")) / F.lit(1000.0)).alias("duration_s"),
        F.when(F.col("n") > 0, total / (F.col("n") * 100.0)).otherwise(F.lit(0.0)).alias("confidence"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("video_id") % 4 + 1).cast("int")).alias("provider"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words per segment.

    Segments are cut where a document is read, so whole ones travel and not
    their words. Documents of one id share their segments.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), _tokens(F.col("text")).alias("toks"))
    parts = F.regexp_extract_all(F.array_join("toks", " "), F.lit("[^ ]++(?: [^ ]++){0,11}"), F.lit(0))
    rows = docs.select("video_id", F.size("toks").cast("long").alias("n"), F.posexplode_outer(parts).alias("seg", "said")).filter("seg is not null")
    # A word ends before the next one starts, so the last one has the latest end.
    rows = rows.select("video_id", F.col("seg").cast("long").alias("pos"), F.expr("least(seg * 12 + 11, n - 1)").alias("last"), "said")
    end_ms = _start_ms("last") + 100 + 15 * F.least(F.length(F.substring_index("said", " ", -1)), F.lit(18))
    rows = rows.select("video_id", "pos", end_ms.alias("end_ms"), "said")
    # Tokens hold no blank, so a text is cut into its words again where documents share a segment.
    placed = F.flatten(F.transform("all", lambda t: F.transform(F.split(t, " "), lambda w, i: F.struct(i.alias("i"), w.alias("w")))))
    merged = F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    shared = rows.groupBy("video_id", "pos").agg(F.max("end_ms").alias("end_ms"), F.collect_list("said").alias("all"))
    return shared.withColumn("first", F.expr("pos * 12")).select(
        "video_id", "pos", (_start_ms("first") / F.lit(1000.0)).alias("start_s"), (F.col("end_ms") / F.lit(1000.0)).alias("end_s"),
        F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(merged).alias("text"),
    )


def dirty_text(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return dirty_from(table(spark, sf_dir, "documents"), keep)


def dirty_from(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with recogniser debris in front; also usable on a stream."""
    docs = documents.select("doc_id", "text", *keep)
    prefix = (
        F.when(F.col("doc_id") % 6 == 1, F.lit("[Risas] (MÚSICA) "))
        .when(F.col("doc_id") % 6 == 2, F.lit("eh um hmm "))
        .when(F.col("doc_id") % 6 == 3, F.lit("la La LA la casa "))
        .when(F.col("doc_id") % 6 == 4, F.lit("hola ,mundo!!! sí.....no "))
        .when(F.col("doc_id") % 6 == 5, F.lit("\\u00bfC\\u00f3mo est\\u00e1s? \xa0\x07"))
        .otherwise(F.lit(""))
    )
    return docs.select("doc_id", F.concat(prefix, F.col("text")).alias("text"), *keep)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(
        F.array(*map(F.lit, [".mp4", ".mov", ".avi", ".mkv", ".wmv"])), (F.col("doc_id") % 5 + 1).cast("int")
    )
    duration = 60 + (F.col("doc_id") * 977) % 20000
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        duration.cast("double").alias("duration_s"),
        (duration * 32000).cast("long").alias("size_bytes"),
        ext.alias("extension"),
        F.concat(F.lit("media/"), F.col("doc_id").cast("string"), ext).alias("path"),
        (1 + F.col("doc_id") % 3).alias("speakers"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("provider"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("chunk_index"),
        (F.col("turn") * 1170.0).alias("start_s"),
        (F.col("turn") * 1170.0 + 1200.0).alias("end_s"),
    )


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the chunks that succeeded."""
    turns = table(spark, sf_dir, "conversations").filter((F.col("conv_id") + F.col("turn")) % 7 != 0)
    return turns.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("chunk_index"),
        "text",
        F.expr("(60 + (turn * 11) % 40) / 100D").alias("confidence"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("turn") % 4 + 1).cast("int")).alias("provider"),
        F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")).alias("model"),
    )


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each successful chunk, times local to the chunk."""
    turns = table(spark, sf_dir, "conversations").filter((F.col("conv_id") + F.col("turn")) % 7 != 0)
    rows = turns.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("chunk_index"),
        F.posexplode_outer(_tokens(F.col("text"))).alias("p", "word"),
    ).filter("p is not null").select("video_id", "chunk_index", F.col("p").cast("long").alias("pos"), "word")
    return _timed(rows, "video_id")


def speaker_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all turns on one time axis; ``pos`` leaves 100000 places per turn."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.col("conv_id").alias("video_id"), "turn", F.col("role").alias("speaker"),
        F.posexplode_outer(_tokens(F.col("text"))).alias("p", "word"),
    ).filter("p is not null")
    pos = F.col("turn") * 100000 + F.col("p")
    start = F.col("turn") * 1170000 + F.col("p").cast("long") * 400
    return rows.select(
        "video_id", pos.cast("long").alias("pos"), "speaker", "word",
        (start / F.lit(1000.0)).alias("start_s"), ((start + 300) / F.lit(1000.0)).alias("end_s"),
    )


def chapter_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter per non-blank line; times follow the share of characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")
    cut = docs.select(
        "video_id",
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"),
        _tokens(F.col("text")).alias("toks"),
    )
    cut = cut.withColumn("n", F.size("toks").cast("long")).select(
        "video_id", "lines", _last_end_ms(F.col("toks")).alias("ms")
    )
    upto = F.aggregate(
        F.col("lines"),
        F.array(F.lit(0).cast("long")),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))),
    )
    cut = cut.filter(F.size("lines") > 0).withColumn("upto", upto)
    cut = cut.withColumn("total", F.element_at("upto", -1))

    def chapter(line: Column, i: Column) -> Column:
        number = (i + 1).cast("long")
        share = lambda j: F.floor(F.col("ms") * F.get("upto", j) / F.col("total")) / F.lit(1000.0)
        return F.struct(
            number.alias("number"),
            # Six tokens are whole in the first seven pieces; one of these is empty where the line begins with a blank.
            F.array_join(F.slice(F.array_remove(F.split(line, r"\s+", 8), ""), 1, 6), " ").alias("title"),
            share(i).alias("start_s"),
            share(i + 1).alias("end_s"),
            ((40 + (F.col("video_id") * 3 + number * 17) % 61) / F.lit(100.0)).alias("confidence"),
            line.alias("transcript"),
            (F.size("lines") == number).alias("is_last"),
        )

    return cut.select(
        "video_id", (F.col("ms") / F.lit(1000.0)).alias("duration_s"), F.transform("lines", chapter).alias("chapters")
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapter_arrays(spark, sf_dir).select(
        "video_id", "duration_s", F.inline_outer("chapters")
    ).filter("number is not null")


def chapters_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with shifted starts and a short tail, to be repaired or audited."""
    shift = 7.0 * (F.col("number") % 3 - 1)
    return chapters(spark, sf_dir).withColumns(
        {
            "start_s": F.round(F.greatest(F.col("start_s") + shift, F.lit(0.0)), 3),
            "end_s": F.round(F.when(F.col("is_last"), F.col("end_s") - 4.0).otherwise(F.col("end_s")), 3),
        }
    )


def block_chapters(spark: SparkSession, sf_dir: str, plan: DataFrame) -> DataFrame:
    """Two local chapters per planned block, none for every fifth block."""
    answered = plan.filter((F.col("video_id") + F.col("block")) % 5 != 0)
    half = (F.col("end_s") - F.col("start_s")) / 2
    rows = answered.select("video_id", "block", half.alias("half"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("number"))
    return rows.select(
        "video_id", "block", "number", ((F.col("number") - 1) * F.col("half")).alias("start_s"),
        (F.col("number") * F.col("half")).alias("end_s"),
    )


def block_answers(prompts: DataFrame) -> DataFrame:
    """Model answers to prompts about blocks: two chapters each over the text of the prompt, sound or damaged.

    By (video + block) % 7: plain, fenced, bare keys in prose with other
    brackets (one chapter), broken off in a third chapter, a field missing,
    no answer at all, a trailing comma.
    """
    said = F.regexp_replace("prompt", r'[,:{}\[\]"\\\\]', " ")
    half = F.ceil(F.length("said") / 2).cast("int")
    chapter = lambda k, text: F.to_json(
        F.struct(
            F.lit(k).alias("number"), F.concat(F.lit(f"Parte {k} de "), F.col("block").cast("string")).alias("title"),
            F.lit("00:00:00.000").alias("start_time"), F.lit("00:00:01.000").alias("end_time"), F.lit(k * 2.0).alias("start_seconds"),
            F.lit(k * 2.0 + 2.0).alias("end_seconds"), F.lit(0.5 + k / 4).alias("confidence"), text.alias("transcript"),
        )
    )
    rows = prompts.withColumn("said", said).withColumns(
        {"a": chapter(1, F.substring(F.col("said"), F.lit(1), half)), "b": chapter(2, F.substring(F.col("said"), half + 1, F.length("said")))}
    )
    both = F.concat(F.lit("["), F.col("a"), F.lit(","), F.col("b"), F.lit("]"))
    bare = F.regexp_replace("a", r'"(number|title|start_time|end_time|start_seconds|end_seconds|confidence|transcript)":', "$1:")
    way = (F.col("video_id") + F.col("block")) % 7
    text = (
        F.when(way == 0, both)
        .when(way == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```")))
        .when(way == 2, F.concat(F.lit("Nota [uno]: "), F.regexp_replace(bare, r"\}\z", ",}"), F.lit(" y [dos]")))
        .when(way == 3, F.concat(F.lit("["), F.col("a"), F.lit(","), F.col("b"), F.lit(',{"number":3,"title":"cort{ado')))
        .when(way == 4, F.regexp_replace(both, '"confidence":0.75,', ""))
        .when(way == 5, F.lit("No puedo ayudar con eso."))
        .otherwise(F.regexp_replace(both, r"\]\z", ",]"))
    )
    return rows.select("video_id", "block", text.alias("text"))


def short_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40-second chunks every 30 seconds, so their words do overlap."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("chunk_index"),
        (F.col("turn") * 30.0).alias("start_s"),
        (F.col("turn") * 30.0 + 40.0).alias("end_s"),
    )


HIGHLIGHT_TYPES = [
    "insight", "warning", "example", "takeaway", "demo", "hook", "controversial", "definition", "unheard-of",
]
IMPORTANCES = ["alta", "media", "baja", "unknown"]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with concepts, terms, eight highlights, goals and scores."""
    rows = chapters(spark, sf_dir).withColumn("toks", _tokens(F.col("transcript")))
    concepts = F.slice(F.array_distinct(F.filter("toks", lambda t: F.length(t) >= 9)), 1, 5)
    rows = rows.withColumn("key_concepts", concepts)
    v, n = F.col("video_id"), F.col("number")

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))

    # Printing a number by a format costs many times its padding.
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    second = F.floor("start_s")
    highlight = lambda j: F.struct(
        F.concat(F.lit("00:"), two((second + j) / 60 % 60), F.lit(":"), two((second + j) % 60), F.lit(".000")).alias("timestamp"),
        pick(HIGHLIGHT_TYPES, v + n + j).alias("type"),
        F.concat(F.lit("h"), j.cast("string")).alias("label"),
        F.array_join(F.slice("toks", F.lit(1), 6 + 4 * j), " ").alias("quote"),
        pick(IMPORTANCES, v + n + j).alias("importance"),
    )
    c = F.col("key_concepts")
    return rows.select(
        "video_id", "number", "title", "start_s", "end_s", "transcript", "key_concepts",
        F.concat(F.lit("About "), F.col("title")).alias("description"),
        F.lit("").alias("context"),
        F.slice(F.split("title", " "), F.lit(1), (n % 9).cast("int")).alias("summary_bullets"),
        F.transform(
            c,
            lambda t: F.struct(
                t.alias("term"), F.lit("concepto").alias("type"), (1 + n % 3).cast("int").alias("frequency"), F.lit("").alias("definition")
            ),
        ).alias("terms_used"),
        F.create_map(F.lit("personas"), F.slice(c, 1, 2), F.lit("tecnologías"), F.slice(c, 3, 1)).alias("entities_detected"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), highlight).alias("highlights"),
        F.struct(
            F.lit("intermedio").alias("difficulty_level"),
            F.array().cast("array<string>").alias("prerequisites"),
            F.slice("toks", F.lit(1), (n % 6).cast("int")).alias("learning_objectives"),
            F.array().cast("array<string>").alias("teaching_methods"),
        ).alias("pedagogy"),
        F.struct(
            F.col("confidence").alias("segmentation_score"),
            ((50 + (v * 5 + n) % 51) / F.lit(100.0)).alias("transcription_quality"),
            ((55 + (v * 11 + n * 3) % 46) / F.lit(100.0)).alias("content_coherence"),
            F.lit(False).alias("needs_review"),
            F.array().cast("array<string>").alias("review_reasons"),
        ).alias("confidence"),
    )


def chapter_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter arrays as model answers, clean or damaged in one of seven ways."""
    rows = chapter_arrays(spark, sf_dir)
    asked = F.transform(
        "chapters",
        lambda c: F.struct(
            c["number"].alias("number"), c["title"].alias("title"),
            F.lit("00:00:00.000").alias("start_time"), F.lit("00:00:01.000").alias("end_time"),
            c["start_s"].alias("start_seconds"), c["end_s"].alias("end_seconds"),
            c["confidence"].alias("confidence"), c["transcript"].alias("transcript"),
        ),
    )
    rows = rows.select("video_id", asked.alias("asked")).select(
        "video_id", F.to_json("asked").alias("j"), F.to_json(F.col("asked")[0]).alias("first")
    )
    way, j = F.col("video_id") % 8, F.col("j")
    bare = F.regexp_replace(
        j, r'"(number|title|start_time|end_time|start_seconds|end_seconds|confidence|transcript)":', "$1:"
    )
    text = (
        F.when(way == 0, j)
        .when(way == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
        .when(way == 2, F.concat(F.lit("Claro: "), j, F.lit(" fin.")))
        .when(way == 3, F.concat(F.expr("left(j, length(j) - 1)"), F.lit(",]")))
        .when(way == 4, bare)
        .when(way == 5, F.substring(j, 1, 30))
        .when(way == 6, F.concat(j, F.lit(" Espero que ayude.")))
        .otherwise(F.col("first"))
    )
    return rows.select("video_id", text.alias("text"))


def enrichment_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichments as model answers; one in five lacks a section, one is fenced."""
    e = enriched(spark, sf_dir)
    parts = dict(
        chapter=F.struct("title"),
        content=F.struct("description", "context", "summary_bullets"),
        knowledge=F.struct("terms_used", "key_concepts", "entities_detected"),
        highlights=F.slice("highlights", F.lit(1), (F.col("number") % 3).cast("int")),
        pedagogy=F.col("pedagogy"),
        confidence=F.col("confidence"),
    )
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    short = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items() if n != "pedagogy"]))
    way = (F.col("video_id") + F.col("number")) % 5
    text = (
        F.when(way == 3, short).when(way == 4, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    )
    return e.select("video_id", "number", text.alias("text"))


def asr_responses(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """Every document as a recogniser response of one dialect."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")
    cut = docs.withColumn("toks", _tokens(F.col("text"))).withColumn("n", F.size("toks").cast("long"))
    ms = dialect == "millis"

    def word(w: Column, i: Column) -> Column:
        p = i.cast("long")
        start = p * 400 + 700 * F.floor(p / 12) + 6000 * F.floor(p / 150)
        end = start + 100 + 15 * F.least(F.length(w), F.lit(18))
        confidence = (50 + (F.col("video_id") * 7 + p * 13) % 51) / F.lit(100.0)
        times = [start, end] if ms else [start / F.lit(1000.0), end / F.lit(1000.0)]
        named = w.alias("text" if ms else "word")
        fields = [named, times[0].alias("start"), times[1].alias("end")]
        return F.struct(*fields) if dialect == "segmented" else F.struct(*fields, confidence.alias("confidence"))

    cut = cut.withColumn("words", F.transform("toks", word))
    if dialect == "seconds":
        body = F.struct("text", "words")
    elif ms:
        body = F.struct("text", "words", _last_end_ms(F.col("toks")).alias("audio_duration"), F.lit(0.0).alias("confidence"))
    elif dialect == "text":
        body = F.struct(F.concat(F.lit("  "), F.col("text")).alias("text"), F.size("toks").alias("n"))
    else:
        # "words" is named twice, so the optimizer computes it once and not per segment.
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(12))
        body = F.struct("text", F.transform(starts, lambda s: F.struct(F.slice("words", s + 1, 12).alias("words"))).alias("segments"))
    models = ["tiny", "large-v3", "other"]
    return cut.select(
        "video_id", F.to_json(body).alias("body"), F.lit(dialect).alias("provider"),
        F.element_at(F.array(*map(F.lit, models)), (F.col("video_id") % 3 + 1).cast("int")).alias("model"),
    )


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("long")


def progress_from(events: DataFrame) -> DataFrame:
    """Progress events of all seven types; also usable on a stream of events."""
    e = events.withColumn("k", _k())
    kind = (
        F.when(F.col("event_type") == "signup", F.lit("stage_start"))
        .when((F.col("event_type") == "view") & (F.col("k") >= 85), F.lit("stage_complete"))
        .when(F.col("event_type") == "view", F.lit("stage_progress"))
        .when(F.col("event_type") == "click", F.lit("cost_update"))
        .when(F.col("event_type") == "purchase", F.lit("chapter_complete"))
        .when(F.col("k") < 40, F.lit("warning"))
        .otherwise(F.lit("stage_error"))
    )
    stages = F.array(*map(F.lit, ["extract", "transcribe", "segment", "enrich", "materialize"]))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
        F.element_at(stages, (F.col("k") % 5 + 1).cast("int")).alias("stage"),
        (F.col("k") % 5).alias("stage_index"), F.lit(5).cast("long").alias("total_stages"),
        (F.col("k") / 100.0).alias("progress"),
        F.when(F.col("k") % 4 != 0, F.col("k") * 3).alias("eta_seconds"),
        (F.col("value") / 1000.0).alias("cost_usd"), F.lit(0.1).alias("budget_usd"),
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("message"),
        (F.col("k") % 20).alias("chapter_number"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_from(table(spark, sf_dir, "events"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    failed = F.col("event_type") == "error"
    chunk = F.col("k") % 3 != 0
    texts = F.array(*map(F.lit, ["Audio duration exceeded", "429 rate limit", "503 unavailable", "401 bad key"]))
    codes = F.array(*map(F.lit, [400, 429, 503, 401]))
    at = (F.col("k") % 4 + 1).cast("int")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt_number"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("event_id") % 4 + 1).cast("int")).alias("provider"),
        F.when(chunk, F.lit("chunk")).otherwise(F.lit("full")).alias("strategy"),
        F.when(chunk, F.col("k") % 10).alias("chunk_index"),
        (F.col("value") / 1000.0).alias("cost_usd"), (~failed).alias("success"),
        F.when(failed, F.element_at(texts, at)).alias("error_message"),
        F.when(failed, F.element_at(codes, at)).alias("status"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser and a model usage row per document."""
    models = ["deepseek", "groq", "openai", "other"]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "n_chars")
    at = (F.col("video_id") % 4 + 1).cast("int")
    both = F.array(
        F.struct(
            F.lit("asr").alias("kind"), F.element_at(F.array(*map(F.lit, PROVIDERS)), at).alias("provider"),
            F.col("n_chars").cast("double").alias("duration_s"), F.lit(0).cast("long").alias("tokens"),
        ),
        F.struct(
            F.lit("model").alias("kind"), F.element_at(F.array(*map(F.lit, models)), at).alias("provider"),
            F.lit(0.0).alias("duration_s"), (F.col("n_chars") * 100).alias("tokens"),
        ),
    )
    return docs.select("video_id", F.inline(both))


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages before ``doc_id % 6`` are done."""
    stages = F.array(*map(F.lit, ["extract", "transcribe", "segment", "enrich", "materialize"]))
    done = F.slice(stages, F.lit(1), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.explode(done).alias("stage"), F.lit(True).alias("success")
    )
