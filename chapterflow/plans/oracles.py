"""The queries as DuckDB SQL over the same tables.

``CTES`` holds the derived tables; a query names the ones it needs.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

PROVIDERS = "['groq', 'assemblyai', 'openai', 'mlx-whisper']"
WS = r"[\s\x1c-\x1f]"
WORDCHAR = r"[\p{L}\p{M}\p{N}_]"


def _start(p: str) -> str:
    return f"({p} * 400 + 700 * ({p} // 12) + 6000 * ({p} // 150))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _toks(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def _blanks(c: str) -> str:
    return _strip(f"regexp_replace({c}, ' +', ' ', 'g')")


def _hms_parts(total: str) -> tuple[str, str, str]:
    return f"({total}) // 3600", f"({total}) % 3600 // 60", f"({total}) % 60"


def srt(c: str) -> str:
    ms = f"CAST(round_even({c} * 1000, 0) AS BIGINT)"
    h, m, s = _hms_parts(f"{ms} // 1000")
    return f"printf('%02d:%02d:%02d,%03d', {h}, {m}, {s}, {ms} % 1000)"


def clock(c: str) -> str:
    ms = f"greatest(CAST(round_even({c} * 1000, 0) AS BIGINT), 0)"
    h, m, s = _hms_parts(f"{ms} // 1000")
    return f"printf('%02d:%02d:%02d.%03d', {h}, {m}, {s}, {ms} % 1000)"


def hms(c: str) -> str:
    h, m, s = _hms_parts(f"CAST(trunc({c}) AS BIGINT)")
    return f"printf('%d:%02d:%02d', {h}, {m}, {s})"


def human(c: str) -> str:
    t = f"CAST(trunc({c}) AS BIGINT)"
    h, m, s = _hms_parts(t)
    return f"CASE WHEN {t} >= 3600 THEN printf('%dh %dm %ds', {h}, {m}, {s}) ELSE printf('%dm %ds', {m}, {s}) END"


def slug(c: str) -> str:
    folded = f"translate(lower({c}), 'áàâãäåéèêëíìîïóòôõöúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc')"
    cleaned = rf"regexp_replace({folded}, '[^a-z0-9\s-]', '', 'g')"
    return rf"coalesce(nullif(trim(regexp_replace({cleaned}, '[\s-]+', '-', 'g'), '-'), ''), 'chapter')"


def tighten(c: str) -> str:
    for mark in ".,?!":
        c = f"replace({c}, ' {mark}', '{mark}')"
    return _strip(c)


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    CTES[name] = (needs.split(), sql)


def oracle(name: str, needs: str, body: str) -> None:
    seen: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in seen:
            seen.append(n)

    for n in needs.split():
        add(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in seen)
    ORACLES[name] = _six_digits((f"WITH {head}\n" if head else "") + body)


def _six_digits(sql: str) -> str:
    """Spell ``round(x, 6)`` the way ``queries.rounded`` computes it, ties included."""
    at = sql.find("round(")
    while at >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith(", 6"):
            sql = f"{sql[:at]}(floor(({inner[:-3]}) * 1e6 + 0.500001) / 1e6){sql[end:]}"
        at = sql.find("round(", at + 1)
    return sql


cte("tok", f"SELECT doc_id AS video_id, text, {_toks('text')} AS t FROM documents")
cte(
    "words",
    f"""SELECT video_id, pos, word, {_start('pos')} / 1000::DOUBLE AS start_s,
        ({_start('pos')} + 100 + 15 * least(length(word), 18)) / 1000::DOUBLE AS end_s,
        (50 + (video_id * 7 + pos * 13) % 51) / 100::DOUBLE AS confidence
        FROM (SELECT video_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tok)""",
    "tok",
)
cte(
    "disordered",
    """SELECT video_id, pos, word, round(start_s - CASE WHEN pos % 37 = 5 THEN 0.45 ELSE 0 END, 3) AS start_s,
        round(end_s - CASE WHEN pos % 37 = 5 THEN 0.45 ELSE 0 END, 3) AS end_s FROM words""",
    "words",
)
cte(
    "transcripts",
    f"""SELECT d.doc_id AS video_id, d.text || CASE WHEN d.doc_id % 11 = 0 THEN ' [TRANSCRIPTION_FAILED]' ELSE '' END AS text,
        coalesce(max(w.end_s), 0) AS duration_s, coalesce(sum(CAST(round(w.confidence * 100) AS BIGINT)) / (count(w.pos) * 100::DOUBLE), 0) AS confidence,
        {PROVIDERS}[d.doc_id % 4 + 1] AS provider, count(w.pos) AS n_words
        FROM documents d LEFT JOIN words w ON w.video_id = d.doc_id GROUP BY d.doc_id, d.text""",
    "words",
)
cte(
    "segments",
    """SELECT video_id, pos // 12 AS pos, min(start_s) AS start_s, max(end_s) AS end_s,
        string_agg(word, ' ' ORDER BY pos) AS text FROM words w GROUP BY video_id, w.pos // 12""",
    "words",
)
cte(
    "dirty",
    r"""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '[Risas] (MÚSICA) ' WHEN 2 THEN 'eh um hmm ' WHEN 3 THEN 'la La LA la casa '
        WHEN 4 THEN 'hola ,mundo!!! sí.....no ' WHEN 5 THEN replace('~u00bfC~u00f3mo est~u00e1s? ', '~', chr(92)) || chr(160) || chr(7) ELSE '' END || text AS text
        FROM documents""",
)
cte(
    "media",
    f"""SELECT doc_id AS video_id, CAST(60 + (doc_id * 977) % 20000 AS DOUBLE) AS duration_s, (60 + (doc_id * 977) % 20000) * 32000 AS size_bytes,
        ['.mp4', '.mov', '.avi', '.mkv', '.wmv'][doc_id % 5 + 1] AS extension, 1 + doc_id % 3 AS speakers,
        {PROVIDERS}[doc_id % 4 + 1] AS provider FROM documents""",
)
cte(
    "lines",
    r"""SELECT doc_id AS video_id, generate_subscripts(l, 1) AS number, unnest(l) AS line FROM
        (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)""",
)
cte(
    "chapters",
    f"""SELECT l.video_id, number, array_to_string({_toks('line')}[1:6], ' ') AS title,
        floor(ms * (upto - length(line)) / total) / 1000::DOUBLE AS start_s, floor(ms * upto / total) / 1000::DOUBLE AS end_s,
        (40 + (l.video_id * 3 + number * 17) % 61) / 100::DOUBLE AS confidence, line AS transcript, ms / 1000::DOUBLE AS duration_s,
        number = n AS is_last
        FROM (SELECT *, sum(length(line)) OVER (PARTITION BY video_id ORDER BY number) AS upto,
              sum(length(line)) OVER (PARTITION BY video_id) AS total, count(*) OVER (PARTITION BY video_id) AS n FROM lines) l
        JOIN (SELECT video_id, CAST(round(duration_s * 1000) AS BIGINT) AS ms FROM transcripts) d ON d.video_id = l.video_id""",
    "lines transcripts",
)
cte(
    "rough",
    """SELECT * REPLACE (round(greatest(start_s + 7.0 * (number % 3 - 1), 0), 3) AS start_s,
        round(CASE WHEN is_last THEN end_s - 4 ELSE end_s END, 3) AS end_s) FROM chapters""",
    "chapters",
)

# --- text -------------------------------------------------------------------

_ESC = dict(zip(["a1", "bf", "ed", "e9", "e1", "f3", "fa", "f1", "c1", "c9", "cd", "d3", "da", "d1"], "¡¿íéáóúñÁÉÍÓÚÑ"))


def decode(c: str) -> str:
    for code, ch in _ESC.items():
        c = rf"replace({c}, '\u00{code}', '{ch}')"
    return c


def unicode_clean(c: str) -> str:
    c = rf"regexp_replace(nfc_normalize({c}), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    return _blanks(f"replace({c}, chr(160), ' ')")


def markers(c: str) -> str:
    for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), ("<", ">")):
        for w in ("aplausos", "risas", "música", "risa", "aplauso"):
            c = f"regexp_replace({c}, '(?i){a}{w}{b}', '', 'g')"
    for w in ("ininteligible", "inaudible", "indistinto", "background", "noise", "silence"):
        c = rf"regexp_replace({c}, '(?i)\[.*?{w}.*?\]', '', 'g')"
    return _blanks(c)


def repetitions(c: str) -> str:
    """Over a table with columns text_in, t (tokens) and l (lower tokens)."""
    kept = "list_filter(range(1, len(t) + 1), lambda i: NOT coalesce(l[i] = l[i - 1] AND l[i] = l[i - 2] AND i > 2, false))"
    word = "CASE WHEN i > 1 AND l[i] = l[i - 1] THEN t[i - 1] ELSE t[i] END"
    return f"CASE WHEN len(t) <= 2 THEN {c} ELSE array_to_string(list_transform({kept}, lambda i: {word}), ' ') END"


def punctuation(c: str) -> str:
    c = rf"regexp_replace({c}, '\s+([,.!?;:])', '\1', 'g')"
    c = rf"regexp_replace({c}, '([,.!?;:])([A-Za-záéíóúñÁÉÍÓÚÑ])', '\1 \2', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g')"
    return _strip(rf"regexp_replace({c}, '\.{{4,}}', '...', 'g')")


def by_word(c: str, case: str) -> str:
    """Rewrite maximal runs of word characters with a CASE over ``w``."""
    runs = rf"regexp_extract_all({c}, '{WORDCHAR}+|[^\p{{L}}\p{{M}}\p{{N}}_]+')"
    return f"array_to_string(list_transform({runs}, lambda w: {case}), '')"


def fillers(c: str) -> str:
    c = by_word(c, "CASE WHEN regexp_full_match(w, '(?i)(eh|em|um|uh|hm+|mmm+|este|esta|ueno)') THEN '' ELSE w END")
    c = rf"regexp_replace({c}, '({WORDCHAR})¿\s*', '\1', 'g')"
    return _blanks(rf"regexp_replace({c}, '({WORDCHAR})¡\s*', '\1', 'g')")


oracle("decode_escapes", "dirty", f"SELECT doc_id, {decode('text')} AS text FROM dirty")
oracle("clean_unicode", "dirty", f"SELECT doc_id, {unicode_clean('text')} AS text FROM dirty")
oracle("remove_markers", "dirty", f"SELECT doc_id, {markers('text')} AS text FROM dirty")
_spaced = rf"list_filter(string_split_regex(text, '[\s{{x}}]+'), lambda x: x <> '')".replace("{x}", r"\x1c-\x1f\x{a0}\x0b\x{85}")
cte("spaced", f"SELECT doc_id, text, t, list_transform(t, lambda x: lower(x)) AS l FROM (SELECT doc_id, text, {_spaced} AS t FROM dirty)", "dirty")
oracle("remove_repetitions", "spaced", f"SELECT doc_id, {repetitions('text')} AS text FROM spaced")
oracle("normalize_punctuation", "dirty", f"SELECT doc_id, {punctuation('text')} AS text FROM dirty")
oracle("remove_fillers", "dirty", f"SELECT doc_id, {fillers('text')} AS text FROM dirty")
cte("clean1", f"SELECT doc_id, {markers(unicode_clean(decode('text')))} AS text FROM dirty", "dirty")
cte("clean2", f"SELECT doc_id, text, t, list_transform(t, lambda x: lower(x)) AS l FROM (SELECT doc_id, text, {_toks('text')} AS t FROM clean1)", "clean1")
cte("clean3", f"SELECT doc_id, {punctuation(repetitions('text'))} AS text FROM clean2", "clean2")
cte("clean", f"SELECT doc_id, {fillers('text')} AS text FROM clean3", "clean3")
oracle("preprocess", "clean", "SELECT doc_id, text FROM clean")
oracle("preprocess_keep_fillers", "clean3", "SELECT doc_id, text FROM clean3")
oracle("stage_round_trip", "clean", "SELECT doc_id, text FROM clean")
oracle("process_stage_stream", "clean", "SELECT doc_id, text FROM clean")
oracle("process_stage_repeated", "clean", "SELECT doc_id, text FROM clean")
oracle(
    "cleaning_report", "dirty clean",
    """SELECT lang, count(*) AS n_docs, sum(length(b.text)) AS chars_before, sum(length(a.text)) AS chars_after,
       round(avg(1 - length(a.text) / length(b.text)), 6) AS mean_reduction, round(quantile_disc(1 - length(a.text) / length(b.text), 0.1), 6) AS p10_reduction,
       round(quantile_disc(1 - length(a.text) / length(b.text), 0.5), 6) AS p50_reduction, round(quantile_disc(1 - length(a.text) / length(b.text), 0.9), 6) AS p90_reduction
       FROM documents d JOIN dirty b USING (doc_id) JOIN clean a USING (doc_id) GROUP BY lang""",
)
_RULES = [
    ("cicatras?", "psiquiatras"), ("quiatri[ae]s?", "psiquiatras"), ("psiqui[ae]tr[ia]", "psiquiatría"), ("arbon[ií]a", "armonía"),
    ("disina", "decidí"), ("abolos?", "ambos"), ("sen[oó]", "señor"), ("can[oó]", "canción"), ("ficiinas", "funciones"),
    ("ayototema", "Ayotzinapa"), ("ayom[ií]", "Ayomi"), ("(eh|ah|um|uh|mhm|mmm|este|esto|tipo)", ""),
]
_RULES_AFTER = [("depresi[oó]n", "depresión"), ("ansiedad", "ansiedad"), ("estr[eé]s", "estrés")]


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match(w, '(?i){p}') THEN '{r}'" for p, r in rules) + " ELSE w END"


def corrections(c: str) -> str:
    edge, start = r"($|[^\p{L}\p{M}\p{N}_])", r"(^|[^\p{L}\p{M}\p{N}_])"
    c = by_word(c, _case(_RULES))
    for p, r in (("padre.*psiquiatra", "padre psiquiatra"), ("salud.*mental", "salud mental"), ("trauma.*infancia", "trauma de infancia")):
        c = rf"regexp_replace({c}, '(?i){start}{p}{edge}', '\1{r}\2', 'g')"
    return by_word(c, _case(_RULES_AFTER))


oracle("apply_corrections", "dirty", f"SELECT doc_id, {corrections('text')} AS text FROM dirty")
oracle(
    "tidy_punctuation", "dirty",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[.!?]{2,}', '.', 'g'), '[\s\x1c-\x1f\x{a0}\x0b]+', ' ', 'g'), '.,!?;: ') AS text FROM dirty",
)
oracle("snippets", "dirty", "SELECT doc_id, left(text, 200) AS text FROM dirty")
_expanded = by_word("text", "CASE WHEN regexp_full_match(w, '(?i)terapia') THEN 'terapia psicológica' WHEN regexp_full_match(w, '(?i)consejer[íi]a') THEN 'consejería psicológica' ELSE w END")
oracle(
    "expand_terms", "",
    rf"""SELECT doc_id, CASE WHEN lang = 'es' THEN regexp_replace({_expanded}, '(?i)(^|[^\p{{L}}\p{{N}}_])apoyo($|[^\p{{L}}\p{{N}}_\n].*?|[^\p{{L}}\p{{N}}_\n].*)emocional', '\1apoyo emocional', 'g') ELSE text END AS text
       FROM (SELECT doc_id, lang, 'Terapia, consejería. El apoyo muy emocional: terapias ' || text AS text FROM documents)""",
)
oracle("slugs", "chapters", f"SELECT video_id, number, {slug('title')} AS slug FROM chapters")
oracle(
    "time_formats", "chapters",
    f"""SELECT video_id, number, {srt('start_s')} AS srt, {clock('start_s')} AS clock, {hms('end_s')} AS hms,
       {human('end_s * 7')} AS human,
       CASE WHEN number % 5 = 0 THEN '--' WHEN e < 60 THEN printf('%ds', e)
            WHEN e < 3600 THEN CASE WHEN e % 60 > 0 THEN printf('%dm %ds', e // 60, e % 60) ELSE printf('%dm', e // 60) END
            ELSE printf('%dh %dm', e // 3600, e % 3600 // 60) END AS eta,
       printf('$%.2f', floor(end_s) / 100) AS usd, round(start_s, 6) AS parsed, 0::DOUBLE AS malformed
       FROM (SELECT *, CAST(trunc(end_s * 3) AS BIGINT) AS e FROM chapters)""",
)

# --- timeline ---------------------------------------------------------------


def caption_sql(source: str, keys: str, gap: float = 0.5, most: int = 25) -> str:
    return f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY first) AS cue, start_s, end_s, n_words, text, ends FROM (
      SELECT {keys}, min(pos) AS first, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s, count(*) AS n_words,
             {tighten("string_agg(word, ' ' ORDER BY pos)")} AS text, arg_max(ends, pos) AS ends FROM (
        SELECT *, (row_number() OVER (PARTITION BY {keys}, run ORDER BY pos) - 1) // {most} AS sub FROM (
          SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY {keys} ORDER BY pos) AS run FROM (
            SELECT *, coalesce(lag(ends) OVER w OR start_s - lag(end_s) OVER w > {gap}, true) AS opens FROM (
              SELECT *, regexp_matches(word, '[.!?:;]') AS ends FROM {source})
            WINDOW w AS (PARTITION BY {keys} ORDER BY pos))))
      GROUP BY {keys}, run, sub)"""


cte("caps", caption_sql("words", "video_id"), "words")
oracle("captions", "caps", "SELECT video_id, cue, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n_words, text FROM caps")
cte("caps7", caption_sql("words", "video_id", 0.2, 7), "words")
oracle(
    "captions_legacy_tail", "caps7",
    """SELECT video_id, cue + c AS cue, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n_words, text FROM (
       SELECT *, unnest(CASE WHEN cue = max(cue) OVER (PARTITION BY video_id) AND (ends OR n_words >= 7) THEN [0, 1] ELSE [0] END) AS c FROM caps7)""",
)


def srt_sql(source: str, keys: str) -> str:
    entry = f"cue || chr(10) || {srt('start_s')} || ' --> ' || {srt('end_s')} || chr(10) || text || chr(10)"
    return f"SELECT {keys}, 0 AS part, string_agg({entry}, chr(10) ORDER BY cue) AS srt, count(*) AS n_cues FROM {source} GROUP BY {keys}"


oracle("srt_documents", "caps", srt_sql("caps", "video_id"))
cte(
    "text_caps",
    rf"""SELECT video_id, number, i AS cue, start_s + (i - 1) * step AS start_s, start_s + i * step AS end_s, s[i] AS text FROM (
        SELECT video_id, number, start_s, (end_s - start_s) / len(s) AS step, s, unnest(range(1, len(s) + 1)) AS i FROM (
          SELECT video_id, number, start_s, end_s, list_filter(list_transform(
            regexp_extract_all(transcript, '(?s)(.{{10,}}?[.!?]|.+\z)', 1), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM chapters))""",
    "chapters",
)
oracle("captions_from_text", "text_caps", "SELECT video_id, number, cue, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text FROM text_caps")
cte(
    "inside",
    """SELECT c.video_id, c.number, w.pos, w.word, w.start_s, w.end_s FROM chapters c JOIN words w
       ON w.video_id = c.video_id AND w.end_s >= c.start_s AND w.start_s <= c.end_s""",
    "words chapters",
)
oracle("chapter_words", "inside", "SELECT video_id, number, pos, word FROM inside")
cte("inside_timed", "SELECT * FROM inside WHERE video_id % 4 <> 2", "inside")
cte("chapter_caps_timed", caption_sql("inside_timed", "video_id, number"), "inside_timed")
oracle(
    "chapter_captions", "chapter_caps_timed text_caps",
    """SELECT video_id, number, cue, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text, 'words' AS origin FROM chapter_caps_timed
       UNION ALL SELECT video_id, number, cue, round(start_s, 6), round(end_s, 6), text, 'text' FROM text_caps t
       WHERE NOT EXISTS (SELECT 1 FROM inside_timed i WHERE i.video_id = t.video_id AND i.number = t.number)""",
)
cte("chapter_caps", caption_sql("inside", "video_id, number"), "inside")
cte(
    "chapter_cues",
    """SELECT video_id, number, cue, start_s, end_s, text FROM chapter_caps
       UNION ALL SELECT video_id, number, cue, start_s, end_s, text FROM text_caps t
       WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.video_id = t.video_id AND i.number = t.number)""",
    "chapter_caps text_caps",
)
oracle("chapter_srt", "chapter_cues", srt_sql("chapter_cues", "video_id, number"))
cte(
    "order_issues",
    """SELECT video_id, pos, 'Word ''' || word || ''' at ' || start_s || 's starts before ''' || pw || ''' ends at ' || pe || 's' AS message
       FROM (SELECT *, lag(word) OVER w AS pw, lag(end_s) OVER w AS pe FROM disordered WINDOW w AS (PARTITION BY video_id ORDER BY pos))
       WHERE start_s < pe""",
    "disordered",
)
oracle("word_order_issues", "order_issues", "SELECT * FROM order_issues")
oracle(
    "failed_regions", "words transcripts",
    """SELECT video_id, round(pe, 6) AS start_s, round(start_s, 6) AS end_s FROM
       (SELECT video_id, start_s, lag(end_s) OVER (PARTITION BY video_id ORDER BY pos) AS pe FROM words)
       WHERE start_s - pe > 5 AND video_id IN (SELECT video_id FROM transcripts WHERE contains(text, '[TRANSCRIPTION_FAILED]'))
       UNION ALL SELECT video_id, 0, duration_s FROM transcripts WHERE contains(text, '[TRANSCRIPTION_FAILED]') AND n_words = 0""",
)
oracle(
    "confidence_windows", "words transcripts",
    """SELECT g.video_id, g.w AS window, g.a AS start_s, round(g.b, 6) AS end_s, count(w.pos) AS n_words, round(coalesce(avg(w.confidence), 0), 6) AS confidence
       FROM (SELECT video_id, w, w * 60::DOUBLE AS a, least((w + 1) * 60::DOUBLE, duration_s) AS b FROM
             (SELECT video_id, duration_s, unnest(range(CAST(ceil(duration_s / 60) AS BIGINT))) AS w FROM transcripts WHERE duration_s > 0)) g
       LEFT JOIN words w ON w.video_id = g.video_id AND w.start_s >= g.a AND w.end_s <= g.b GROUP BY ALL""",
)
cte(
    "unsound",
    """SELECT video_id, CASE WHEN video_id % 13 = 3 THEN '  ' ELSE text END AS text, CASE WHEN video_id % 17 = 4 THEN 0 ELSE duration_s END AS duration_s,
       CASE WHEN video_id % 19 = 5 THEN 1.5 ELSE confidence END AS confidence, n_words FROM transcripts""",
    "transcripts",
)
cte(
    "issues",
    rf"""SELECT * FROM order_issues UNION ALL
       SELECT video_id, -1, 'Transcription text is empty' FROM unsound WHERE {_strip("replace(text, '[TRANSCRIPTION_FAILED]', '')")} = '' AND NOT contains(text, '[TRANSCRIPTION_FAILED]')
       UNION ALL SELECT video_id, -1, 'Duration is non-positive: ' || CAST(duration_s AS DOUBLE) FROM unsound WHERE duration_s <= 0
       UNION ALL SELECT video_id, -1, 'Confidence out of bounds: ' || CAST(confidence AS DOUBLE) FROM unsound WHERE confidence < 0 OR confidence > 1""",
    "order_issues unsound",
)
oracle("transcript_issues", "issues", "SELECT * FROM issues")
oracle(
    "validate_transcripts", "issues",
    """SELECT u.video_id, coalesce(i.n, 0) = 0 AS is_valid, contains(text, '[TRANSCRIPTION_FAILED]') AS has_failed_regions,
       CAST((length(text) - length(replace(text, '[TRANSCRIPTION_FAILED]', ''))) / 22 AS BIGINT) AS failed_region_count,
       n_words AS word_count, round(duration_s, 6) AS duration_s, round(confidence, 6) AS confidence, coalesce(i.n, 0) AS n_issues
       FROM unsound u LEFT JOIN (SELECT video_id, count(*) AS n FROM issues GROUP BY 1) i USING (video_id)""",
)
cte("probes", "SELECT video_id, number AS probe_id, round(start_s + 0.1, 3) AS at_s FROM chapters", "chapters")
oracle(
    "word_at", "probes words",
    """SELECT p.video_id, p.probe_id, p.at_s, min(w.pos) AS pos, arg_min(w.word, w.pos) AS word, round(arg_min(w.confidence, w.pos), 6) AS confidence
       FROM probes p LEFT JOIN words w ON w.video_id = p.video_id AND w.start_s <= p.at_s AND p.at_s <= w.end_s GROUP BY ALL""",
)
oracle(
    "segment_at", "probes segments",
    """SELECT p.video_id, p.probe_id, p.at_s, min(s.pos) AS pos, arg_min(s.text, s.pos) AS text
       FROM probes p LEFT JOIN segments s ON s.video_id = p.video_id AND s.start_s <= p.at_s AND p.at_s <= s.end_s GROUP BY ALL""",
)
oracle(
    "snap_to_segments", "chapters segments",
    """SELECT p.video_id, p.probe_id, round(CASE WHEN ratio <= 0 THEN 0 WHEN ratio >= 1 THEN any_value(duration_s)
         WHEN bool_or(s.start_s <= t AND t <= s.end_s) THEN any_value(t)
         ELSE arg_min(s.start_s, abs(s.start_s - t) * 1000000 + s.pos / 1000) END, 6) AS at_s
       FROM (SELECT video_id, number AS probe_id, number / 8.0::DOUBLE - 0.125 AS ratio, duration_s, (number / 8.0::DOUBLE - 0.125) * duration_s AS t FROM chapters) p
       JOIN segments s USING (video_id) GROUP BY p.video_id, p.probe_id, ratio""",
)
oracle(
    "clean_words", "words",
    """SELECT video_id, pos, word FROM (
         SELECT *, lag(CASE WHEN usable THEN lw END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY pos) AS prev,
                bool_or(usable) OVER (PARTITION BY video_id) AS any_usable FROM (
           SELECT *, lower(word) AS lw, lower(word) NOT IN ('eh', 'ah', 'um', 'uh', 'mhm', 'mmm', 'tipo', 'este')
             AND (length(lower(word)) > 2 OR lower(word) IN ('no', 'sí', 'yo', 'me', 'te', 'se', 'la', 'el', 'lo')) AS usable FROM words))
       WHERE (usable AND lw IS DISTINCT FROM prev) OR NOT any_usable""",
)
cte(
    "speaker_words",
    f"""SELECT video_id, turn * 100000 + p AS pos, role AS speaker, (turn * 1170000 + p * 400) / 1000::DOUBLE AS start_s,
        (turn * 1170000 + p * 400 + 300) / 1000::DOUBLE AS end_s FROM
        (SELECT conv_id AS video_id, turn, role, unnest(range(len({_toks('text')}))) AS p FROM conversations)""",
)
oracle(
    "speaker_turns", "speaker_words",
    """SELECT video_id, turn, arg_min(speaker, pos) AS speaker, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS n_words FROM (
         SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY video_id ORDER BY pos) AS turn FROM (
           SELECT *, speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY video_id ORDER BY pos) AS changed FROM speaker_words))
       GROUP BY video_id, turn""",
)
oracle(
    "transcript_stats", "transcripts",
    """SELECT video_id, n_words AS word_count, n_words > 0 AS has_word_timestamps,
       CASE WHEN n_words > 0 THEN CAST(round(CAST(CAST(duration_s / n_words AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) ELSE 0 END AS seconds_per_word FROM transcripts""",
)

# --- chunks and media -------------------------------------------------------

oracle("supported_media", "media", "SELECT video_id, extension, size_bytes FROM media WHERE extension IN ('.mp4', '.mov', '.avi', '.mkv')")


def chunk_sql(source: str, length: str, overlap: float = 30, merge: bool = False) -> str:
    n = f"CASE WHEN duration_s <= {length} THEN 1 ELSE CAST(ceil((duration_s - {length}) / ({length} - {overlap})) AS BIGINT) + 1 END"
    cut = f"n > 1 AND duration_s - (n - 1) * step < 0.3 * len" if merge else "false"
    return f"""SELECT video_id, k AS chunk_index, round(k * step, 6) AS start_s,
      round(CASE WHEN k = n - 1 THEN duration_s ELSE least(k * step + len, duration_s) END, 6) AS end_s, n AS n_chunks FROM (
      SELECT *, unnest(range(n)) AS k FROM (SELECT video_id, duration_s, step, len, CASE WHEN {cut} THEN n - 1 ELSE n END AS n FROM (
        SELECT video_id, duration_s, CAST({length} - {overlap} AS DOUBLE) AS step, CAST({length} AS DOUBLE) AS len, {n} AS n FROM {source})))"""


oracle("plan_chunks", "media", chunk_sql("media", "1200"))
oracle("plan_chunks_merged_tail", "media", chunk_sql("media", "600", merge=True))
cte(
    "routed",
    """SELECT video_id, duration_s, CASE WHEN size_bytes > 25 * 1024 * 1024 OR duration_s > 1800 THEN 'chunked' ELSE 'full' END AS strategy,
       CASE provider WHEN 'groq' THEN 8 WHEN 'assemblyai' THEN 30 WHEN 'openai' THEN 25 WHEN 'mlx' THEN 20 ELSE 20 END AS chunk_min FROM media""",
    "media",
)
oracle("route_media", "routed", "SELECT video_id, strategy, chunk_min FROM routed")
cte("long_media", "SELECT * FROM routed WHERE strategy = 'chunked'", "routed")
oracle("routed_chunk_plan", "long_media", chunk_sql("long_media", "(chunk_min * 60)"))
oracle(
    "eligible_providers", "media",
    """SELECT m.video_id, c.provider FROM media m JOIN (VALUES ('groq', 0, 26214400), ('assemblyai', 0, 0), ('openai', 0, 26214400), ('mlx-whisper', 3600, 0)) c(provider, s, b)
       ON (c.s = 0 OR m.duration_s <= c.s) AND (c.b = 0 OR m.size_bytes <= c.b)""",
)
oracle(
    "media_strategy", "media",
    """SELECT video_id, CASE WHEN duration_s > 14400 THEN 'split first' WHEN speakers > 1 THEN 'assemblyai' WHEN duration_s < 1800 THEN 'groq'
       WHEN duration_s < 7200 THEN 'groq chunked' ELSE 'assemblyai or mlx-whisper' END AS advice FROM media""",
)
cte(
    "results",
    f"""SELECT conv_id AS video_id, turn AS chunk_index, text, (conv_id + turn) % 7 <> 0 AS ok, (60 + (turn * 11) % 40) / 100::DOUBLE AS confidence,
        {PROVIDERS}[turn % 4 + 1] AS provider, 'model-' || turn % 3 AS model FROM conversations""",
)
oracle(
    "reassemble", "results",
    """SELECT video_id, 0 AS part, string_agg(CASE WHEN ok THEN text ELSE '[TRANSCRIPTION_FAILED]' END, ' ' ORDER BY chunk_index) AS text,
       round(coalesce(avg(confidence) FILTER (ok), 0), 6) AS confidence, max(chunk_index) * 1170.0::DOUBLE + 1200 AS duration_s,
       coalesce(arg_min(provider, chunk_index) FILTER (ok), 'unknown') AS provider, coalesce(arg_min(model, chunk_index) FILTER (ok), 'unknown') AS model,
       count(*) AS n_chunks, count(*) FILTER (NOT ok) AS failed_chunks FROM results GROUP BY video_id""",
)
cte(
    "chunk_words",
    f"""SELECT video_id, chunk_index, pos, word, {_start('pos')} / 1000::DOUBLE AS s, ({_start('pos')} + 100 + 15 * least(length(word), 18)) / 1000::DOUBLE AS e,
        (50 + (video_id * 7 + pos * 13) % 51) / 100::DOUBLE AS confidence FROM
        (SELECT video_id, chunk_index, unnest(t) AS word, unnest(range(len(t))) AS pos FROM
          (SELECT video_id, chunk_index, {_toks('text')} AS t FROM results WHERE ok))""",
    "results",
)
oracle(
    "reassembled_words", "chunk_words",
    """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, pos) - 1 AS pos, chunk_index, word,
       round(s + chunk_index * 1170.0::DOUBLE, 6) AS start_s, round(e + chunk_index * 1170.0::DOUBLE, 6) AS end_s FROM chunk_words""",
)
oracle(
    "reassembled_words_best", "chunk_words",
    """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, pos) - 1 AS pos, chunk_index, word, round(st, 6) AS start_s FROM (
         SELECT *, avg(confidence) FILTER (later = 0) OVER w AS early, avg(confidence) FILTER (later = 1) OVER w AS late FROM (
           SELECT *, CASE WHEN tail THEN chunk_index WHEN head THEN chunk_index - 1 END AS ov, CASE WHEN tail THEN 0 WHEN head THEN 1 END AS later FROM (
             SELECT *, coalesce(nxt AND st >= (chunk_index + 1) * 30.0 AND st <= chunk_index * 30.0 + 40, false) AS tail,
                    coalesce(prv AND st <= (chunk_index - 1) * 30.0 + 40, false) AS head FROM (
               SELECT w.*, s + chunk_index * 30.0::DOUBLE AS st,
                 EXISTS (SELECT 1 FROM chunk_words n WHERE n.video_id = w.video_id AND n.chunk_index = w.chunk_index + 1) AS nxt,
                 EXISTS (SELECT 1 FROM chunk_words n WHERE n.video_id = w.video_id AND n.chunk_index = w.chunk_index - 1) AS prv FROM chunk_words w)))
         WINDOW w AS (PARTITION BY video_id, ov))
       WHERE ov IS NULL OR later = CASE WHEN late > coalesce(early, -1) THEN 1 ELSE 0 END""",
)

# --- chapters ---------------------------------------------------------------

oracle(
    "chapter_context", "chapters",
    """SELECT video_id, number, lag(title) OVER w AS prev_title, lead(title) OVER w AS next_title, count(*) OVER (PARTITION BY video_id) AS total_chapters
       FROM chapters WINDOW w AS (PARTITION BY video_id ORDER BY number)""",
)


def block_sql(threshold: int, size: int) -> str:
    return f"""SELECT video_id, b AS block, n AS n_blocks, CASE WHEN n = 1 THEN text ELSE substring(text, (b - 1) * {size} + 1, {size}) END AS text,
      (b - 1) * {size} / rate AS start_s, CASE WHEN n = 1 THEN len ELSE least(b * {size}, len) END / rate AS end_s FROM (
      SELECT *, unnest(range(1, n + 1)) AS b FROM (
        SELECT video_id, text, length(text) AS len, CASE WHEN duration_s > 0 THEN length(text) / duration_s ELSE 15 END AS rate,
               CASE WHEN length(text) > {threshold} THEN CAST(ceil(length(text) / {size}) AS BIGINT) ELSE 1 END AS n FROM transcripts))"""


cte("blocks", block_sql(3000, 2000), "transcripts")
cte("blocks_default", block_sql(30000, 20000), "transcripts")
_cols = f"video_id, block, n_blocks, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, {clock('(end_s - start_s)')} AS duration"
oracle("plan_blocks", "blocks", f"SELECT text, {_cols} FROM blocks")
oracle("plan_blocks_default", "blocks_default", f"SELECT {_cols} FROM blocks_default")
oracle(
    "merge_block_chapters", "blocks",
    """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY block, k) AS number, block, round(start_s + (k - 1) * half, 6) AS start_s,
       round(start_s + k * half, 6) AS end_s FROM
       (SELECT video_id, block, start_s, (end_s - start_s) / 2 AS half, unnest([1, 2]) AS k FROM blocks WHERE (video_id + block) % 5 <> 0)""",
)
cte(
    "answered",
    r"""SELECT video_id, block, start_s AS offset_s, (video_id + block) % 7 AS way, ceil(length(said) / 2)::BIGINT AS half, said FROM
        (SELECT *, regexp_replace(text, '[,:{}\[\]"\\]', ' ', 'g') AS said FROM blocks)""",
    "blocks",
)
oracle(
    "segmented_blocks", "answered",
    f"""SELECT video_id, number, block, title, round(a, 6) AS start_s, round(b, 6) AS end_s, {clock("a")} AS start_time, {clock("b")} AS end_time, confidence, transcript, confidence < 0.7 AS needs_review FROM (
          SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY block, k) AS number, block, 'Parte ' || k || ' de ' || block AS title,
            offset_s + k * 2::DOUBLE AS a, offset_s + (k * 2 + 2)::DOUBLE AS b, 0.5 + k / 4 AS confidence,
            CASE k WHEN 1 THEN left(said, half) ELSE substr(said, half + 1) END AS transcript
          FROM (SELECT *, unnest([1, 2]) AS k FROM answered WHERE way NOT IN (4, 5)) WHERE NOT (way = 2 AND k = 2))""",
)
oracle("blocks_to_ask_again", "answered", "SELECT video_id, block FROM answered WHERE way IN (4, 5)")
oracle(
    "read_block_answers", "answered",
    """SELECT video_id, block, CASE way WHEN 0 THEN 'whole' WHEN 1 THEN 'array' WHEN 2 THEN 'mended' WHEN 3 THEN 'balanced' WHEN 4 THEN 'whole' WHEN 5 THEN 'failed' ELSE 'mended' END AS parse_stage,
       CASE way WHEN 4 THEN 'incomplete' WHEN 5 THEN 'unread' ELSE 'ok' END AS verdict, CASE way WHEN 2 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS n_chapters FROM answered""",
)
oracle("unsegmented_videos", "blocks", "SELECT video_id FROM blocks GROUP BY 1 HAVING bool_and((video_id + block) % 5 = 0)")
oracle(
    "estimate_ratios", "chapters transcripts",
    """SELECT video_id, number, round(greatest(s / n, 0), 6) AS start_ratio, round(CASE WHEN e < 0 THEN 1 ELSE least((e + length(right(transcript, 50))) / n, 1) END, 6) AS end_ratio FROM (
       SELECT c.video_id, c.number, c.transcript, length(t.text) AS n,
         CASE WHEN instr(t.text, left(c.transcript, 50)) > 0 THEN instr(t.text, left(c.transcript, 50)) ELSE instr(t.text, left(c.transcript, 20)) END - 1 AS s,
         CASE WHEN instr(t.text, right(c.transcript, 50)) > 0 THEN instr(t.text, right(c.transcript, 50)) ELSE instr(t.text, right(c.transcript, 20)) END - 1 AS e
       FROM chapters c JOIN transcripts t USING (video_id))""",
)
oracle(
    "repair_chapters", "rough",
    """, RECURSIVE_PLACEHOLDER""",
)
ORACLES["repair_chapters"] = ORACLES["repair_chapters"].replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\n, RECURSIVE_PLACEHOLDER",
    """,
fold AS (
  SELECT video_id, number, start_s AS s, least(CASE WHEN end_s <= start_s THEN start_s + 1 ELSE end_s END, duration_s) AS e FROM rough WHERE number = 1
  UNION ALL
  SELECT r.video_id, r.number, greatest(r.start_s, f.e + 0.1::DOUBLE),
    least(CASE WHEN r.end_s <= greatest(r.start_s, f.e + 0.1::DOUBLE) THEN greatest(r.start_s, f.e + 0.1::DOUBLE) + 1 ELSE r.end_s END, r.duration_s)
  FROM fold f JOIN rough r ON r.video_id = f.video_id AND r.number = f.number + 1),
edge AS (
  SELECT f.video_id, f.number, CASE WHEN f.number = 1 AND s > 1 THEN 0 ELSE s END AS s, CASE WHEN r.is_last AND e < r.duration_s - 1 THEN r.duration_s ELSE e END AS e
  FROM fold f JOIN rough r USING (video_id, number))
SELECT video_id, number, floor((CASE WHEN s < lag(e) OVER w THEN lag(e) OVER w + 0.1::DOUBLE ELSE s END) * 1e6 + 0.500001) / 1e6 AS start_s,
  floor((CASE WHEN lead(s) OVER w > e + 5 THEN lead(s) OVER w - 0.1::DOUBLE ELSE e END) * 1e6 + 0.500001) / 1e6 AS end_s
FROM edge WINDOW w AS (PARTITION BY video_id ORDER BY number)""",
)
oracle("flag_for_review", "chapters", "SELECT video_id, number, confidence, confidence < 0.7 AS needs_review FROM chapters")
oracle("review_queue", "chapters", "SELECT video_id, number, confidence FROM chapters WHERE confidence < 0.7 ORDER BY confidence, video_id, number LIMIT 100")
oracle(
    "audit_chapters", "rough",
    """SELECT video_id, number, unnest(list_filter([
         CASE WHEN end_s - start_s < 30 THEN 'too short' END, CASE WHEN end_s - start_s > 480 THEN 'too long' END,
         CASE WHEN number <> coalesce(pn, 0) + 1 THEN 'number out of sequence' END,
         CASE WHEN start_s - pe > 0.001 THEN 'gap' END, CASE WHEN start_s - pe < -0.001 THEN 'overlap' END,
         CASE WHEN pn IS NULL AND start_s > 0.001 THEN 'does not start at zero' END,
         CASE WHEN is_last AND abs(end_s - duration_s) > 0.001 THEN 'does not end at the duration' END], lambda x: x IS NOT NULL)) AS issue
       FROM (SELECT *, lag(end_s) OVER w AS pe, lag(number) OVER w AS pn FROM rough WINDOW w AS (PARTITION BY video_id ORDER BY number))
       UNION ALL SELECT video_id, 0, 'chapter count out of band' FROM rough GROUP BY video_id, duration_s
       HAVING NOT CASE WHEN duration_s < 300 THEN count(*) BETWEEN 1 AND 2 WHEN duration_s < 900 THEN count(*) BETWEEN 2 AND 4
         WHEN duration_s < 1800 THEN count(*) BETWEEN 3 AND 6 WHEN duration_s < 3600 THEN count(*) BETWEEN 6 AND 10
         WHEN duration_s < 7200 THEN count(*) BETWEEN 10 AND 15 ELSE count(*) BETWEEN 15 AND 20 END""",
)
cte(
    "routes",
    """SELECT video_id, provider, CASE WHEN video_id % 3 = 0 THEN 'segment_optimized' WHEN provider IN ('assemblyai', 'mlx-whisper') THEN 'advanced' ELSE 'clean' END AS processor,
       CASE WHEN video_id % 3 <> 0 AND provider IN ('assemblyai', 'mlx-whisper') THEN 'segmenter-basic' ELSE 'segmenter' END AS template, text, duration_s FROM transcripts""",
    "transcripts",
)
oracle("route_transcripts", "routes", "SELECT video_id, provider, processor, template FROM routes")
oracle(
    "assemble_enriched", "chapters",
    """SELECT video_id, number, title, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
       round(CASE WHEN video_id % 4 <> 3 AND number % 4 = 0 THEN 0.8 ELSE confidence END, 6) AS confidence,
       CASE WHEN video_id % 4 <> 3 AND number = 2 THEN '' ELSE transcript END AS transcript,
       CASE WHEN video_id % 4 <> 3 THEN false END AS needs_review, CASE WHEN video_id % 4 <> 3 THEN 'About ' || title END AS description
       FROM chapters WHERE video_id % 4 <> 3 OR number <> 2""",
)
cte("shared_slugs", f"SELECT video_id, number, {slug("CASE WHEN number % 3 = 0 THEN 'Capítulo final' ELSE title END")} AS slug FROM chapters", "chapters")
oracle(
    "resolve_slugs", "shared_slugs",
    """SELECT video_id, number, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM
       (SELECT *, row_number() OVER (PARTITION BY video_id, slug ORDER BY number) AS n FROM shared_slugs)""",
)
oracle("resolve_slugs_last_wins", "shared_slugs", "SELECT video_id, max(number) AS number, slug FROM shared_slugs GROUP BY video_id, slug")
cte(
    "stats",
    f"SELECT *, CAST(trunc(end_s - start_s) AS BIGINT) AS duration_seconds, len({_toks('transcript')}) AS word_count FROM chapters",
    "chapters",
)
oracle("chapter_stats", "stats", "SELECT video_id, number, duration_seconds, word_count FROM stats")
oracle(
    "chapter_rollup", "stats",
    f"""SELECT {PROVIDERS}[video_id % 4 + 1] AS provider, confidence < 0.7 AS needs_review, count(*) AS chapters, sum(word_count) AS words,
       sum(duration_seconds) AS seconds FROM stats GROUP BY ROLLUP (provider, needs_review)""",
)
cte(
    "enriched",
    f"""SELECT *, list_filter(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN length(toks[i]) >= 9 AND list_position(toks, toks[i]) = i THEN toks[i] END), lambda x: x IS NOT NULL)[1:5] AS concepts,
        ['insight', 'warning', 'example', 'takeaway', 'demo', 'hook', 'controversial', 'definition', 'unheard-of'] AS types, ['alta', 'media', 'baja', 'unknown'] AS imps
        FROM (SELECT *, {_toks('transcript')} AS toks FROM chapters)""",
    "chapters",
)
oracle(
    "chapter_metadata", "enriched",
    f"""SELECT video_id, number, title, {slug('title')} AS slug, {clock('start_s')} AS start_time, round(end_s, 6) AS end_seconds,
       CASE WHEN number % 2 = 0 THEN 'About ' || title ELSE transcript END AS summary, len(concepts) AS n_topics, round(confidence, 6) AS confidence FROM enriched""",
)
oracle(
    "chapter_manifest", "enriched",
    """SELECT video_id, number, replace(lower(title), ' ', '-') AS slug, CAST(trunc(end_s - start_s) AS BIGINT) AS duration_seconds, len(toks) AS word_count,
       'About ' || title AS description, types[(video_id + number) % 9 + 1] AS first_highlight,
       round((55 + (video_id * 11 + number * 3) % 46) / 100, 6) AS coherence FROM enriched""",
)
oracle(
    "clip_manifest", "chapters media",
    f"""SELECT video_id, number, 'media/' || video_id || extension AS source, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
       'chapters/' || video_id || '/' || s || '/' || s || '.mp4' AS target FROM (
         SELECT *, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS s FROM (
           SELECT *, row_number() OVER (PARTITION BY video_id, base ORDER BY number) AS n FROM (
             SELECT c.video_id, number, extension, c.start_s, c.end_s, {slug('title')} AS base FROM chapters c JOIN media m USING (video_id))))""",
)


def index_sql(source: str, summary: str, topics: str = "''") -> str:
    stamp = lambda c: f"{hms(c)} || ' (' || CAST(trunc({c}) AS BIGINT) || 's)'"
    nl = "chr(10)"
    entry = f"""'## ' || lpad(CAST(idx AS VARCHAR), CAST(greatest(2, length(CAST(total AS VARCHAR))) AS INTEGER), '0') || ' — ' || title || {nl} || {nl}
      || '- **Start**: ' || {stamp('start_s')} || {nl} || '- **End**: ' || {stamp('end_s')} || {nl}
      || '- **Duration**: ' || {human('(end_s - start_s)')} || {nl} || '- **Slug**: `' || {slug('title')} || '`' || {nl}
      || '- **Folder**: `' || {slug('title')} || '/`' || {nl}
      || CASE WHEN summary <> '' THEN {nl} || summary || {nl} ELSE '' END || {topics}
      || CASE WHEN idx < total THEN {nl} || '---' || {nl} ELSE '' END"""
    return rf"""SELECT video_id, 0 AS part, regexp_replace('# Chapters' || {nl} || {nl} || 'Total: ' || max(total) || ' chapters  •  Source duration: ' || {hms('max(end_s)')}
      || '  •  Generated: 2024-01-01 00:00:00' || {nl} || {nl} || string_agg({entry}, {nl} ORDER BY idx), '\s+$', '') || {nl} AS markdown FROM (
        SELECT *, {_strip(summary)} AS summary, row_number() OVER (PARTITION BY video_id ORDER BY start_s, number) AS idx, count(*) OVER (PARTITION BY video_id) AS total FROM {source})
      GROUP BY video_id"""


oracle("chapter_index", "chapters", index_sql("chapters", "left(transcript, 200)"))
oracle(
    "enriched_index", "enriched",
    index_sql(
        "enriched", "CASE WHEN number % 2 = 0 THEN 'About ' || title ELSE transcript END",
        "CASE WHEN len(concepts) > 0 THEN chr(10) || '**Key topics**: ' || array_to_string(concepts, ', ') || chr(10) ELSE '' END",
    ),
)

# --- model answers ----------------------------------------------------------

# Residues 3 and 4 are damaged: arrays are mended whole, one chapter alone can
# also be cut out as an object. Mending quotes bare keys, which breaks texts
# that look like keys themselves; those can only be scraped.
cte(
    "answers",
    r"""SELECT video_id, video_id % 8 AS way, count(*) AS n, sum(number) AS total, max(number) AS last,
        bool_or(regexp_matches(title || ' ' || transcript, '[{,]\s*[\p{L}\p{N}_]+\s*:')) AS keylike FROM chapters GROUP BY video_id""",
    "chapters",
)
cte(
    "parsed",
    """SELECT video_id, CASE way WHEN 0 THEN 'whole' WHEN 7 THEN 'whole' WHEN 5 THEN 'scraped'
         WHEN 3 THEN CASE WHEN n = 1 THEN 'object' WHEN NOT keylike THEN 'mended' ELSE 'scraped' END
         WHEN 4 THEN CASE WHEN NOT keylike THEN 'mended' ELSE 'scraped' END
         ELSE CASE WHEN n = 1 THEN 'object' ELSE 'array' END END AS parse_stage,
       CASE WHEN way IN (5, 7) OR (way IN (3, 4) AND keylike) THEN 1 ELSE n END AS n_chapters,
       CASE WHEN way IN (5, 7) THEN 1 WHEN way IN (3, 4) AND keylike THEN last ELSE total END AS sum_number, way FROM answers""",
    "answers",
)
oracle("parse_chapters", "parsed", "SELECT video_id, parse_stage, n_chapters, sum_number FROM parsed")
oracle("validate_chapters", "parsed", "SELECT video_id, n_chapters FROM parsed WHERE way <> 5")
oracle(
    "quarantined_responses", "",
    r"""SELECT doc_id AS video_id, 'failed' AS parse_stage, regexp_replace(text, '[:{}\[\]]', '', 'g') AS raw_response FROM documents""",
)
cte("judged", """SELECT *, (video_id + number) % 5 AS way, list_transform(range(number % 3), lambda j: (types[(video_id + number + j) % 9 + 1] <> 'unheard-of')
       AND (imps[(video_id + number + j) % 4 + 1] <> 'unknown')) AS oks FROM enriched""", "enriched")
oracle(
    "parse_enrichments", "judged",
    """SELECT video_id, number, 'About ' || title AS description, len(concepts) AS n_concepts, number % 3 AS n_highlights, round(confidence, 6) AS segmentation_score
       FROM judged WHERE way <> 3 AND NOT list_contains(oks, false)""",
)
oracle(
    "rejected_enrichments", "judged",
    """SELECT video_id, number, CASE WHEN way = 3 THEN 'pedagogy' ELSE 'highlight outside its domain' END AS reason
       FROM judged WHERE way = 3 OR list_contains(oks, false)""",
)
oracle(
    "segment_prompts", "routes",
    f"""SELECT video_id, template, CASE template WHEN 'segmenter' THEN 'Video: ' || source || ' (' || {clock('duration_s')} || ')' || chr(10) || 'Tema: ' || lang || chr(10) || r.text || chr(10) || '{{{{UNKNOWN}}}}'
       ELSE source || '|' || {clock('duration_s')} || '|' || r.text END AS prompt FROM routes r JOIN documents d ON d.doc_id = r.video_id""",
)
oracle(
    "enrich_prompts", "chapters",
    f"""SELECT video_id, number, source || ' ' || number || '/' || count(*) OVER (PARTITION BY video_id) || ' ' || {clock('start_s')} || '-' || {clock('end_s')} || chr(10)
       || '< ' || coalesce(lag(title) OVER w, 'N/A') || ' > ' || coalesce(lead(title) OVER w, 'N/A') || chr(10) || transcript AS prompt
       FROM chapters c JOIN documents d ON d.doc_id = c.video_id WINDOW w AS (PARTITION BY video_id ORDER BY number)""",
)
oracle(
    "template_sections", "",
    """SELECT doc_id, CASE WHEN lang <> 'en' THEN 'Idioma: ' || lang || '.' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Sin tema.' END || ' ' || doc_id AS prompt FROM documents""",
)
_scores = {
    "segmentation_score": ("confidence", 0.7, 0.5),
    "transcription_quality": ("(50 + (video_id * 5 + number) % 51) / 100::DOUBLE", 0.8, 0.6),
    "content_coherence": ("(55 + (video_id * 11 + number * 3) % 46) / 100::DOUBLE", 0.8, 0.7),
}
oracle(
    "grade_confidence", "chapters",
    "SELECT video_id, number, "
    + ", ".join(f"CASE WHEN {e} < {r} THEN 'review' WHEN {e} < {w} THEN 'warning' ELSE 'ok' END AS {m}_grade" for m, (e, w, r) in _scores.items())
    + ", " + " OR ".join(f"{e} < {r}" for e, _, r in _scores.values()) + " AS needs_review, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {e} < {r} THEN 'Low {m} (' || {e} || ' < {r} threshold)' END" for m, (e, _, r) in _scores.items())
    + ") AS review_reasons FROM chapters",
)
oracle(
    "audit_enrichment", "enriched",
    """SELECT video_id, number, unnest(list_filter([
         CASE WHEN least(number % 9, len(string_split(title, ' '))) > 6 THEN 'more than 6 bullets' END,
         'more than 6 highlights', CASE WHEN len(toks) > 25 THEN 'quote over 25 words' END,
         CASE WHEN least(number % 6, len(toks)) > 4 THEN 'more than 4 objectives' END,
         CASE WHEN len(list_filter(range(8), lambda j: NOT ((floor(start_s) + j) % 3600 BETWEEN floor(start_s) AND end_s))) > 0 THEN 'highlight outside the chapter' END
         ], lambda x: x IS NOT NULL)) AS issue FROM enriched""",
)
oracle(
    "term_fidelity", "enriched",
    """SELECT video_id, number, term, 1 + number % 3 AS declared, found, found > 0 AS faithful FROM (
         SELECT video_id, number, term, CAST((length(lower(transcript)) - length(replace(lower(transcript), lower(term), ''))) / length(lower(term)) AS BIGINT) AS found
         FROM (SELECT *, unnest(concepts) AS term FROM enriched))""",
)
oracle(
    "top_highlights", "enriched",
    """SELECT video_id, number, place, type, 'h' || j AS label, importance FROM (
         SELECT *, row_number() OVER (PARTITION BY video_id, number ORDER BY list_position(['insight', 'warning', 'example', 'takeaway', 'demo', 'hook', 'controversial', 'definition'], type), j) AS place FROM (
           SELECT video_id, number, j, types[(video_id + number + j) % 9 + 1] AS type, imps[(video_id + number + j) % 4 + 1] AS importance
           FROM (SELECT *, unnest(range(8)) AS j FROM enriched)) WHERE type <> 'unheard-of' AND importance <> 'unknown') WHERE place <= 6""",
)
oracle(
    "top_terms", "enriched",
    """SELECT video_id, number, row_number() OVER (PARTITION BY video_id, number ORDER BY encode(term)) AS place, term, 1 + number % 3 AS frequency
       FROM (SELECT *, unnest(concepts) AS term FROM enriched) QUALIFY place <= 3""",
)
oracle(
    "knowledge_index", "enriched",
    """SELECT kind, name, count(*) AS mentions, count(DISTINCT video_id) AS videos FROM (
         SELECT video_id, 'term' AS kind, unnest(concepts) AS name FROM enriched UNION ALL SELECT video_id, 'concept', unnest(concepts) FROM enriched
         UNION ALL SELECT video_id, 'entity:personas', unnest(concepts[1:2]) FROM enriched UNION ALL SELECT video_id, 'entity:tecnologías', unnest(concepts[3:3]) FROM enriched)
       GROUP BY kind, name""",
)
cte("asked", "SELECT doc_id AS request_id, text, length(text) AS n FROM documents")
oracle(
    "model_attempts", "asked",
    """SELECT request_id, unnest(range(1, k + 1)) AS attempt, unnest(list_transform(range(1, k + 1), lambda i: CASE WHEN n % 5 > 1 OR i < k OR false THEN 'primary' ELSE 'backup' END)) AS provider,
       unnest(list_transform(range(1, k + 1), lambda i: i = k AND n % 35 <> 0)) AS success,
       unnest(list_transform(range(1, k + 1), lambda i: CASE WHEN i = k AND n % 35 <> 0 THEN NULL WHEN n % 5 = 1 AND i < k THEN 'transient' ELSE 'permanent' END)) AS error_class
       FROM (SELECT *, CASE WHEN n % 5 = 0 THEN 2 WHEN n % 5 = 1 THEN 4 ELSE 1 END AS k FROM asked)""",
)
oracle(
    "resolve_attempts", "asked",
    """SELECT request_id, CASE WHEN n % 5 = 0 THEN 2 WHEN n % 5 = 1 THEN 4 ELSE 1 END AS n_attempts, CASE WHEN n % 5 = 0 THEN 2 WHEN n % 5 = 1 THEN 4 ELSE 1 END AS attempt,
       CASE WHEN n % 5 > 1 THEN 'primary' ELSE 'backup' END AS provider, n % 35 <> 0 AS success, CASE WHEN n % 35 = 0 THEN 'permanent' END AS error_class,
       CASE WHEN n % 35 <> 0 THEN CASE WHEN n % 5 > 1 THEN 'primary:' ELSE 'backup:' END || text END AS response FROM asked""",
)

# --- recogniser answers -----------------------------------------------------

_last = "t[len(t)] AS last_word, CASE WHEN len(t) > 0 THEN " + _start("(len(t) - 1)") + " / 1000::DOUBLE END"
_mean = "(SELECT round(avg(confidence), 4) FROM words w WHERE w.video_id = k.video_id)"
_model = "['tiny', 'large-v3', 'other'][video_id % 3 + 1]"
_size = f"CASE {_model} WHEN 'tiny' THEN 0.6 WHEN 'large-v3' THEN 0.94 ELSE 0.7 END"
_duration = "coalesce((SELECT max(end_s) FROM words w WHERE w.video_id = k.video_id), 0)"
_last_conf = "CASE WHEN len(t) > 0 THEN (50 + (video_id * 7 + (len(t) - 1) * 13) % 51) / 100::DOUBLE END"


def ingest_sql(confidence: str, duration: str, last_conf: str, words: bool = True, chars: str = "length(text)") -> str:
    last = f"len(t) AS n_words, {_last} AS last_start" if words else "0 AS n_words, NULL AS last_word, NULL AS last_start"
    return f"""SELECT video_id, {chars} AS n_chars, round({confidence}, 6) AS confidence, round({duration}, 6) AS duration_s, {_model} AS model,
      NULL AS error, {last}, {last_conf} AS last_confidence FROM tok k"""


cte("mean_conf", "SELECT video_id, CAST(round(CAST(CAST(sum(confidence ORDER BY pos) / count(*) AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS m FROM words GROUP BY 1", "words")
oracle("ingest_asr_seconds", "tok words mean_conf", ingest_sql("coalesce((SELECT m FROM mean_conf c WHERE c.video_id = k.video_id), 1)", _duration, _last_conf))
oracle("ingest_asr_millis", "tok words", ingest_sql("1", _duration, _last_conf))
oracle("ingest_asr_text", "tok", ingest_sql("1", "0", "NULL", words=False, chars=f"length({_strip('text')})"))
oracle("ingest_asr_segmented", "tok words", ingest_sql(_size, _duration, f"CASE WHEN len(t) > 0 THEN {_size} END", chars=f"length({_strip('text')})"))
oracle("ingested_words", "words", "SELECT video_id, pos, word, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(confidence, 6) AS confidence FROM words")

# --- operations -------------------------------------------------------------

cte(
    "attempts",
    f"""SELECT *, CASE WHEN k % 3 <> 0 THEN 'chunk' ELSE 'full' END AS strategy, {PROVIDERS}[event_id % 4 + 1] AS provider, event_type <> 'error' AS success, value / 1000 AS cost,
        CASE WHEN event_type = 'error' THEN ['duration', 'transient', 'transient', 'permanent'][k % 4 + 1] END AS error_class
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
)
oracle("classify_errors", "attempts", "SELECT user_id AS run_id, event_id AS attempt_number, error_class FROM attempts WHERE NOT success")
cte(
    "costs",
    f"""SELECT doc_id AS video_id, 'asr' AS kind, {PROVIDERS}[doc_id % 4 + 1] AS provider, [0.0004, 0.0004, 0.006, 0.001][doc_id % 4 + 1]::DOUBLE * n_chars / 60 AS cost_usd, doc_id % 4 = 3 AS defaulted FROM documents
        UNION ALL SELECT doc_id, 'model', ['deepseek', 'groq', 'openai', 'other'][doc_id % 4 + 1], [0.14, 0.0007, 2.5, 0.01][doc_id % 4 + 1]::DOUBLE * n_chars * 100 / 1000000, doc_id % 4 = 3 FROM documents""",
)
oracle("estimate_costs", "costs", "SELECT video_id, kind, provider, round(cost_usd, 6) AS cost_usd, defaulted FROM costs")
cte("gate", "SELECT user_id AS run_id, event_id AS seq, cost AS cost_usd, sum(cost) OVER (PARTITION BY user_id ORDER BY event_id) AS total_usd FROM attempts", "attempts")
oracle("budget_gate", "gate", "SELECT run_id, seq, round(cost_usd, 6) AS cost_usd, round(total_usd, 6) AS total_usd, total_usd > 1 AS over_budget FROM gate")
oracle("first_breaches", "gate", "SELECT run_id, min(seq) AS seq, round(arg_min(total_usd, seq), 6) AS total_usd FROM gate WHERE total_usd > 1 GROUP BY 1")
oracle(
    "transcription_summary", "attempts",
    """SELECT user_id AS run_id, round(sum(cost), 6) AS total_cost_usd, bool_or(strategy = 'chunk') AS used_chunking,
       count(DISTINCT CASE WHEN strategy = 'chunk' THEN k % 10 END) AS chunk_count, count(*) FILTER (strategy = 'chunk' AND NOT success) AS failed_chunks, count(*) AS n_attempts
       FROM attempts GROUP BY 1""",
)
oracle(
    "provider_scorecard", "attempts",
    """SELECT provider, count(*) AS calls, count(*) FILTER (success) AS successes, count(*) FILTER (NOT ps AND pp = provider) AS retries, count(*) FILTER (NOT ps AND pp <> provider) AS fallbacks,
       count(*) FILTER (error_class = 'transient') AS transient_errors, count(*) FILTER (error_class = 'permanent') AS permanent_errors,
       count(*) FILTER (error_class = 'duration') AS duration_errors, round(sum(cost), 6) AS cost_usd FROM
       (SELECT *, lag(success) OVER w AS ps, lag(provider) OVER w AS pp FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY provider""",
)
oracle(
    "cheapest_combination", "",
    """SELECT doc_id, CAST(n_chars AS DOUBLE) AS duration_s, n_chars * 100 AS tokens, 'assemblyai' AS asr_provider, 'groq' AS model_provider,
       round(0.0004::DOUBLE * (n_chars / 60) + 0.0007::DOUBLE * (n_chars * 100 / 1000000), 6) AS cost_usd FROM documents""",
)
oracle(
    "capability_gaps", "transcripts",
    """SELECT video_id, provider, missing, CASE missing WHEN 'word_timestamps' THEN CASE provider WHEN 'mlx-whisper' THEN 'assemblyai' ELSE 'assemblyai,mlx-whisper' END
         WHEN 'utterances' THEN '' ELSE 'assemblyai' END AS suggested FROM (
         SELECT video_id, provider, CASE video_id // 4 % 4 WHEN 0 THEN CASE WHEN provider IN ('groq', 'openai') THEN 'word_timestamps' END
           WHEN 1 THEN CASE provider WHEN 'assemblyai' THEN NULL WHEN 'mlx-whisper' THEN 'speaker_diarization' ELSE 'word_timestamps,speaker_diarization' END
           WHEN 2 THEN 'utterances' END AS missing FROM transcripts) WHERE missing IS NOT NULL""",
)
oracle(
    "resume_plan", "",
    """SELECT doc_id AS video_id, coalesce(['extract', 'transcribe', 'segment', 'enrich', 'materialize'][doc_id % 6 + 1], 'done') AS resume_stage, doc_id % 6 AS stage_index FROM documents""",
)
cte(
    "report",
    """SELECT t.video_id, t.duration_s, t.duration_s * (1 + t.video_id % 4) AS run_seconds, t.video_id % 5 AS fallbacks, t.video_id % 8 AS retries,
       coalesce(c.n, 0) AS chapters_generated, coalesce(c.low, 0) AS warnings_count, coalesce(c.bad, 0) AS needs_review_count, a.provider AS asr_provider, m.provider AS model_provider,
       a.cost_usd AS asr_cost_usd, m.cost_usd AS model_cost_usd, a.cost_usd + m.cost_usd AS total_cost_usd
       FROM transcripts t LEFT JOIN (SELECT video_id, count(*) AS n, count(*) FILTER (confidence < 0.7) AS low, count(*) FILTER (confidence < 0.5) AS bad FROM chapters GROUP BY 1) c USING (video_id)
       JOIN costs a ON a.video_id = t.video_id AND a.kind = 'asr' JOIN costs m ON m.video_id = t.video_id AND m.kind = 'model'""",
    "transcripts chapters costs",
)
oracle(
    "processing_report", "report",
    """SELECT * REPLACE (round(duration_s, 6) AS duration_s, round(run_seconds, 6) AS run_seconds, round(asr_cost_usd, 6) AS asr_cost_usd,
       round(model_cost_usd, 6) AS model_cost_usd, round(total_cost_usd, 6) AS total_cost_usd) FROM report""",
)
oracle(
    "report_warnings", "chapters",
    """SELECT video_id, number, 'low_confidence' AS warning_type, confidence AS confidence_score, 'Low segmentation confidence - manual review recommended' AS message FROM chapters WHERE confidence < 0.7""",
)
oracle(
    "alerts", "report",
    """SELECT video_id, 'error' AS level, 'cost above budget' AS alert FROM report WHERE total_cost_usd / 0.5 > 1
       UNION ALL SELECT video_id, 'warning', 'cost above 80% of budget' FROM report WHERE total_cost_usd / 0.5 > 0.8 AND total_cost_usd / 0.5 <= 1
       UNION ALL SELECT video_id, 'error', 'no chapters' FROM report WHERE chapters_generated = 0
       UNION ALL SELECT video_id, 'warning', 'more than 3 warnings' FROM report WHERE warnings_count > 3
       UNION ALL SELECT video_id, 'warning', 'more than 1 chapter to review' FROM report WHERE needs_review_count > 1
       UNION ALL SELECT video_id, 'warning', 'more than 2 fallbacks' FROM report WHERE fallbacks > 2
       UNION ALL SELECT video_id, 'warning', 'more than 5 retries' FROM report WHERE retries > 5
       UNION ALL SELECT video_id, 'warning', 'slower than twice the media duration' FROM report WHERE run_seconds > 2 * duration_s""",
)

# --- streams ----------------------------------------------------------------

cte(
    "progress",
    """SELECT user_id AS run_id, event_id AS seq, k, value / 1000 AS cost, CASE WHEN event_type = 'signup' THEN 'stage_start' WHEN event_type = 'view' AND k >= 85 THEN 'stage_complete'
         WHEN event_type = 'view' THEN 'stage_progress' WHEN event_type = 'click' THEN 'cost_update' WHEN event_type = 'purchase' THEN 'chapter_complete'
         WHEN k < 40 THEN 'warning' ELSE 'stage_error' END AS type FROM attempts""",
    "attempts",
)
# Each event sees the stage that was current when it arrived, as a sequential fold would.
cte("staged", "SELECT *, last_value(CASE WHEN type = 'stage_start' THEN k % 5 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS at_stage FROM progress", "progress")
_state = """SELECT run_id, arg_max(['extract', 'transcribe', 'segment', 'enrich', 'materialize'][k % 5 + 1], seq) FILTER (type = 'stage_start') AS current_stage,
  coalesce(arg_max(k % 5, seq) FILTER (type = 'stage_start'), 0) AS stage_index, CASE WHEN bool_or(type = 'stage_start') THEN 5 ELSE 0 END AS total_stages,
  coalesce(round(arg_max(CASE type WHEN 'stage_start' THEN 0 WHEN 'stage_complete' THEN 1 ELSE k / 100 END, seq) FILTER (type IN ('stage_start', 'stage_progress', 'stage_complete')), 6), 0) AS stage_progress,
  nullif(arg_max(CASE WHEN type = 'stage_progress' AND k % 4 <> 0 THEN k * 3 ELSE -1 END, seq) FILTER (type IN ('stage_progress', 'stage_complete')), -1) AS eta_seconds,
  coalesce(round(arg_max(cost, seq) FILTER (type = 'cost_update'), 6), 0) AS total_cost, CASE WHEN bool_or(type = 'cost_update') THEN 0.1 END AS budget,
  coalesce(arg_max(k % 20, seq) FILTER (type = 'chapter_complete'), 0) AS chapters_completed, count(*) FILTER (type = 'stage_error') AS errors, count(*) FILTER (type = 'warning') AS warnings,
  coalesce(arg_max(type = 'stage_start', seq) FILTER (type IN ('stage_start', 'stage_error') OR (type = 'stage_complete' AND at_stage = 4)), false) AS is_running,
  coalesce(arg_max(type = 'stage_complete', seq) FILTER (type = 'stage_start' OR (type = 'stage_complete' AND at_stage = 4)), false) AS is_complete,
  coalesce(arg_max(type = 'stage_error', seq) FILTER (type IN ('stage_start', 'stage_error')), false) AS is_failed FROM staged GROUP BY run_id"""
oracle("run_state", "staged", _state)
oracle("run_state_stream", "staged", _state)
oracle("run_messages", "progress", "SELECT run_id, seq, type, 'm' || k AS message FROM progress WHERE type IN ('stage_error', 'warning')")
oracle(
    "spend_alerts_stream", "progress",
    """SELECT run_id, round(max(cost), 6) AS spent_usd, 0.1 AS budget_usd, CASE WHEN max(cost) / 0.1 > 1 THEN 'error' WHEN max(cost) / 0.1 > 0.8 THEN 'warning' ELSE 'ok' END AS level
       FROM progress WHERE type = 'cost_update' GROUP BY run_id""",
)
oracle(
    "confidence_windows_stream", "words",
    """SELECT video_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST(floor(start_s / 60) * 60 AS BIGINT) AS start_ts, count(*) AS n_words, round(avg(confidence), 6) AS confidence
       FROM words GROUP BY 1, 2""",
)
oracle(
    "captions_live", "words",
    f"""SELECT video_id, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS n_words, {tighten("string_agg(word, ' ' ORDER BY pos)")} AS text FROM (
         SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY video_id ORDER BY pos) AS run FROM (
           SELECT *, coalesce(start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY pos) > 0.5, true) AS opens FROM words)) GROUP BY video_id, run""",
)
ORACLES["captions_closed_stream"] = ORACLES["captions"]
ORACLES["confidence_windows_closed_stream"] = ORACLES["confidence_windows"]
ORACLES["spend_alerts_closed_stream"] = ORACLES["spend_alerts_stream"]
oracle("distinct_words_closed_stream", "words", "SELECT video_id, pos, word FROM words")
oracle("distinct_words_stream", "words", "SELECT video_id, pos, word FROM words")
