"""Model responses (free text that should hold JSON) to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow import schemas as S
from chapterflow.functions.text import once, strip


#: Fields of a chapter in a model's answer, all required.
CHAPTER_FIELDS = ["number", "title", "start_time", "end_time", "start_seconds", "end_seconds", "confidence", "transcript"]


def sealed(df: DataFrame) -> DataFrame:
    """The same rows, opaque to filters applied later.

    The optimizer moves filters below projections by copying the projected
    expressions into them; for a chain of parsing columns that repeats the
    parsing many times over. Filters stop at a generator's output.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def _json_or_null(c: Column) -> Column:
    """The text if it is exactly one JSON value.

    Inside brackets, trailing text or a second value breaks the parse or adds
    an element; on its own the parser would accept it.
    """
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, c)


def _outermost(c: Column, left: str, right: str) -> Column:
    found = F.regexp_extract(c, rf"(?s)\{left}.*\{right}", 0)
    return F.when(c.contains(left), F.nullif(found, F.lit("")))


def _holds(c: Column, *signs: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in signs])


def _where(c: Column, signs: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """Replace a pattern that needs one of the signs; other texts are not searched for it."""
    return once(c, lambda c: F.when(_holds(c, *signs), F.regexp_replace(c, pattern, replacement)).otherwise(c))


def _tidied(c: Column) -> Column:
    """Drop trailing commas and quote bare keys."""
    c = _where(c, ("}", "]"), r"(?U),\s*([}\]])", "$1")
    return strip(_where(c, (":",), r"(?U)([{,]\s*)(\w+)(\s*:)", '$1"$2"$3'))


def _mended(c: Column, left: str = "{[", right: str = "}]") -> Column:
    """Drop code fences, cut from the first opening to the last closing character of the given ones, tidy up."""
    opening, closing = ("".join(f"\\{x}" for x in signs) for signs in (left, right))
    c = _where(c, ("```",), r"(?iU)```json\s*|\s*```", "")
    c = _where(c, tuple(left), rf"(?s)\A[^{opening}]*([{opening}])", "$1")
    return _tidied(_where(c, tuple(right), rf"(?s)([{closing}])[^{closing}]*\z", "$1"))


def balanced_pattern(depth: int) -> str:
    """Pattern of an object whose braces close, those inside strings not counted, nested up to ``depth`` deep.

    All loops are possessive, so nothing is tried twice and the matcher's
    stack does not grow with the text.
    """
    inner = r'[^{}"]++|"(?:[^"\\]++|\\.)*+"'
    found = rf"\{{(?:{inner})*+\}}"
    for _ in range(depth):
        found = rf"\{{(?:{inner}|{found})*+\}}"
    return f"(?s){found}"


def whole_objects(c: Column, keys: list[str], depth: int = 4) -> Column:
    """The complete objects of a truncated or mixed text that have any of the keys, as a JSON array (null if none)."""
    objects = F.regexp_extract_all(c, F.lit(balanced_pattern(depth)), F.lit(0))
    read = F.transform(objects, lambda o: F.coalesce(_json_or_null(o), _json_or_null(_tidied(o))))
    known = F.filter(read, lambda o: F.coalesce(F.arrays_overlap(F.json_object_keys(o), F.array(*map(F.lit, keys))), F.lit(False)))
    return F.when(c.contains("{") & (F.size(known) > 0), F.concat(F.lit("["), F.array_join(known, ","), F.lit("]")))


def scrape_pairs(c: Column) -> Column:
    """``key: value`` pairs anywhere in the text, as a JSON object (null if none).

    Quoted values are read first, then values up to a comma, line end or
    brace; a later find of the same key wins.
    """
    found = []
    # A key is read from the start of its word and given up as a whole; without a colon there is no pair.
    key = r'(?U)"?(?<!\w)(\w++)"?\s*+:'
    c = F.when(c.contains(":"), c).when(c.isNotNull(), F.lit(""))
    for pattern in (key + r'\s*"([^"]*)"', key + r'\s*([^,\n}]+)'):
        keys = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
        found.append(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), strip(v).alias("v"))))
    merged = F.aggregate(
        F.concat(*found),
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, p: F.concat(F.filter(acc, lambda q: q["k"] != p["k"]), F.array(p)),
    )
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"(?s)\A\[(.*)\]\z", "$1")
    fields = F.transform(
        merged, lambda p: F.concat(quoted(p["k"]), F.lit(":"), F.coalesce(_json_or_null(p["v"]), quoted(p["v"])))
    )
    return F.when(F.size(merged) > 0, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


def extract_json(responses: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Add ``json`` and the ``parse_stage`` that found it (``failed`` if none did).

    Candidates become columns one by one, each built only where the earlier
    ones failed, so a clean response is parsed once. A damaged text is cut at
    the outer brackets of either kind, then at its outer braces, then at its
    outer square brackets. With ``keys`` the complete objects of a text that
    breaks off are kept before single pairs are scraped.
    """
    c = F.col(text_col)
    candidates = [
        ("whole", strip(c)),
        ("object", _outermost(c, "{", "}")),
        ("array", _outermost(c, "[", "]")),
        ("mended", _mended(c)),
        # Without brackets of the other kind these are the cut before.
        ("mended", F.when(_holds(c, "[", "]"), _mended(c, "{", "}"))),
        ("mended", F.when(_holds(c, "{", "}"), _mended(c, "[", "]"))),
    ]
    if keys:
        candidates.append(("balanced", whole_objects(c, keys)))
    rows = responses.withColumns({"json": F.lit(None).cast("string"), "parse_stage": F.lit(None).cast("string")})
    for stage, candidate in candidates:
        rows = rows.withColumn("__try", F.when(F.col("json").isNull(), candidate))
        rows = rows.withColumn("__found", _json_or_null(F.col("__try")))
        rows = rows.withColumns(
            {
                "json": F.coalesce("json", "__found"),
                "parse_stage": F.coalesce("parse_stage", F.when(F.col("__found").isNotNull(), F.lit(stage))),
            }
        ).drop("__try", "__found")
    rows = rows.withColumn("__found", F.when(F.col("json").isNull(), scrape_pairs(c)))
    scraped = F.when(F.col("__found").isNotNull(), F.lit("scraped")).otherwise(F.lit("failed"))
    return sealed(
        rows.withColumns(
            {"json": F.coalesce("json", "__found"), "parse_stage": F.coalesce("parse_stage", scraped)}
        ).drop("__found")
    )


def read_chapters(responses: DataFrame, keys: tuple[str, ...] = ("video_id",), array_mode: str = "all") -> DataFrame:
    """(keys.., parse_stage, verdict, chapters, text): every response parsed once, with its chapters as an array.

    ``keys`` name a response: a video, or a video and the block of its text
    that was asked about. ``verdict`` is ``ok``, ``incomplete`` (a chapter
    lacks a field or its confidence is out of range, which rejects the
    response) or ``unread``. ``array_mode="first"`` keeps only the first
    object of an array that was embedded in other text.
    """
    found = extract_json(responses.select(*keys, "text"), keys=CHAPTER_FIELDS)
    as_array = F.when(F.col("json").startswith("["), F.col("json")).otherwise(
        F.concat(F.lit("["), F.col("json"), F.lit("]"))
    )
    rows = F.from_json(as_array, S.CHAPTERS_JSON)
    if array_mode == "first":
        rows = F.when(F.col("parse_stage") == "array", F.slice(rows, 1, 1)).otherwise(rows)
    sound = F.forall("chapters", lambda c: F.coalesce(sound_chapter(c.getField), F.lit(False)))
    verdict = F.when(F.coalesce(F.size("chapters"), F.lit(0)) < 1, "unread").when(sound, "ok").otherwise("incomplete")
    return sealed(found.withColumn("chapters", rows).select(*keys, "parse_stage", verdict.alias("verdict"), "chapters", "text"))


def sound_chapter(field) -> Column:
    """Are all fields of a chapter there and is its confidence a share? ``field`` gives a field by name."""
    complete = F.lit(True)
    for c in CHAPTER_FIELDS:
        complete = complete & field(c).isNotNull()
    return complete & field("confidence").between(0, 1)


def chapter_rows(read: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """The chapters of ``read_chapters``, one row each."""
    opened = read.select(*keys, "parse_stage", F.posexplode_outer("chapters").alias("__i", "__row"))
    return opened.filter("__i is not null").select(*keys, "parse_stage", "__row.*")


def parse_chapters(
    responses: DataFrame, array_mode: str = "all", keys: tuple[str, ...] = ("video_id",)
) -> tuple[DataFrame, DataFrame]:
    """Chapter rows of each response, sound or not, and a quarantine of responses without any."""
    found = read_chapters(responses, keys, array_mode)
    quarantine = found.filter("verdict = 'unread'").select(*keys, "parse_stage", F.col("text").alias("raw_response"))
    return chapter_rows(found, keys), quarantine


def parse_enrichments(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed enrichments and rejects with the list of missing top-level keys."""
    needed = ["chapter", "content", "knowledge", "highlights", "pedagogy", "confidence"]
    found = extract_json(responses, keys=needed)
    keys = F.json_object_keys("json")
    missing = F.array_except(F.array(*map(F.lit, needed)), F.coalesce(keys, F.array().cast("array<string>")))
    whole = F.coalesce(F.col("json").startswith("{"), F.lit(False)) & (F.size("missing") == 0)
    found = found.withColumn("missing", missing).withColumn("whole", whole)
    e = F.when(F.col("whole"), F.from_json("json", S.ENRICHMENT_JSON))
    texts = F.array().cast("array<string>")
    highlights = F.transform(
        F.coalesce(F.col("e.highlights"), F.array().cast(f"array<{S.HIGHLIGHT}>")),
        lambda h: F.struct(
            F.coalesce(h["timestamp"], F.lit("")).alias("timestamp"),
            F.coalesce(h["type"], F.lit("insight")).alias("type"),
            F.coalesce(h["label"], F.lit("")).alias("label"),
            F.coalesce(h["quote"], F.lit("")).alias("quote"),
            F.coalesce(h["importance"], F.lit("media")).alias("importance"),
        ),
    )
    typed = found.withColumn("e", e).select(
        "video_id", "number", "missing", "whole",
        F.coalesce("e.content.description", F.lit("")).alias("description"),
        F.coalesce("e.content.context", F.lit("")).alias("context"),
        F.coalesce("e.content.summary_bullets", texts).alias("summary_bullets"),
        F.col("e.knowledge.terms_used").alias("terms_used"),
        F.coalesce("e.knowledge.key_concepts", texts).alias("key_concepts"),
        F.col("e.knowledge.entities_detected").alias("entities_detected"),
        highlights.alias("highlights"),
        F.col("e.pedagogy").alias("pedagogy"),
        F.col("e.confidence").alias("confidence"),
    )
    in_domain = F.forall(
        "highlights", lambda h: h["type"].isin(S.HIGHLIGHT_TYPES) & h["importance"].isin(S.IMPORTANCES)
    )
    reason = F.when(~F.col("whole"), F.array_join("missing", ", ")).when(~in_domain, F.lit("highlight outside its domain"))
    # Both tables come from one reading of each response.
    typed = sealed(typed.withColumns({"sound": F.col("whole") & in_domain, "reason": reason}).drop("missing", "whole"))
    rejects = typed.filter("reason is not null").select("video_id", "number", "reason")
    return typed.filter("sound").drop("sound", "reason"), rejects
