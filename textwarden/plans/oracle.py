"""DuckDB SQL that states each registered query a second time, in another way.

The SQL explodes, joins and ranks where the library works inside the row, and trims,
collapses and counts with other functions. Only word lists and limits are shared.
"""

from __future__ import annotations

from textwarden import config
from textwarden.plans.queries import BYO_WORDS, DETECTED, FINE_GRID

WS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
TOKEN_BREAK = r"[^\p{L}\p{M}\p{N}]+"

DOCS = "SELECT doc_id AS k, text, lang FROM documents"
MESSAGES = r"""
    SELECT doc_id * 1000000 + pos AS k, doc_id, pos, text FROM (
        SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS text
        FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]') AS parts FROM documents))"""
LABELLED = "SELECT doc_id AS k, text, lang, toxic AS expected FROM documents JOIN labels USING (doc_id)"


def values(rows) -> str:
    def cell(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows) + ")"


PROFILE = values((lang, word) for lang, words in config.DEFAULT_PROFILE.items() for word in words)
LEXICON = values(
    (word, config.DEFAULT_MODEL.weights["toxic"][word], config.DEFAULT_MODEL.weights["not_toxic"][word])
    for word in config.DEFAULT_MODEL.vocabulary
)
ALIASES = values(config.LANGUAGE_ALIASES.items())
NAMES = values(config.LANGUAGE_NAMES.items())
SUPPORTED = ", ".join(f"'{code}'" for code in config.LANGUAGE_NAMES)
THRESHOLDS = values(config.LANGUAGE_THRESHOLDS.items())


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def collapse(chars: str) -> str:
    """Collapse runs in a list of characters."""
    return (
        f"array_to_string(list_filter({chars}, lambda x, i: NOT (i > 2 AND x <> chr(10)"
        f" AND {chars}[i-1] = x AND {chars}[i-2] = x)), '')"
    )


def words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '[{WS}]+'), lambda x: x <> ''))"


def warning(stripped: str) -> str:
    return f"""CASE WHEN {stripped} = '' THEN '{config.BLANK_WARNING}'
        WHEN {words(stripped)} < 3 THEN
        'Short text (' || {words(stripped)} || ' words) — classification may be unreliable' END"""


def cleaned(source: str) -> str:
    """CTEs ``src``, ``clean(k, s, cleaned)``: stripped and collapsed texts."""
    return f"""
    src AS ({source}),
    chars AS (SELECT k, s, string_split(s, '') AS a FROM (SELECT k, {strip("text")} AS s FROM src)),
    clean AS (SELECT k, s, {collapse("a")} AS cleaned FROM chars)"""


def raw(source: str) -> str:
    """The same CTEs without cleaning."""
    return f"src AS ({source}), clean AS (SELECT k, text AS s, text AS cleaned FROM src)"


TOKENS = rf"""
    tok AS (SELECT * FROM (
        SELECT k, unnest(string_split_regex(lower(cleaned), '{TOKEN_BREAK}')) AS t FROM clean)
        WHERE t <> '')"""

VOTES = rf"""
    votes AS (
        SELECT k, lang, count(*) AS n FROM tok JOIN {PROFILE} p(lang, w) ON t = w GROUP BY ALL
        UNION ALL
        SELECT k, CASE WHEN 5 * sum(regexp_matches(t, '[ٹڈڑںھہے]')::INT) >= count(*) THEN 'ur'
                WHEN 5 * sum(regexp_matches(t, '[پچژگکی]')::INT) >= count(*) THEN 'fa' ELSE 'ar' END, count(*)
        FROM tok
        WHERE regexp_matches(t, '^[\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}]') GROUP BY k),
    best AS (SELECT k, lang AS raw, n FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, lang) AS r FROM votes)
        WHERE r = 1)"""

LANGUAGE = f"""
    found AS (
        SELECT k, s, CASE WHEN s = '' THEN 'unknown' ELSE coalesce(raw, 'unknown') END AS language_raw,
            CASE WHEN s = '' THEN 'unknown' WHEN coalesce(target, raw) IN ({SUPPORTED})
                THEN coalesce(target, raw) ELSE 'en' END AS language
        FROM clean LEFT JOIN best USING (k) LEFT JOIN {ALIASES} a(alias, target) ON alias = raw)"""

SCORES = f"""
    logits AS (
        SELECT k, {config.TOXIC_BIAS} + coalesce(sum(up), 0) AS x_t,
            {config.NOT_TOXIC_BIAS} + coalesce(sum(down), 0) AS x_n
        FROM clean LEFT JOIN (
            SELECT * FROM tok JOIN {LEXICON} l(w, up, down) ON t = w) USING (k)
        GROUP BY k),
    scores AS (
        SELECT k, 1 / (1 + exp(-x_t / 1000.0::DOUBLE)) AS toxic, 1 / (1 + exp(-x_n / 1000.0::DOUBLE)) AS not_toxic
        FROM logits)"""


def moderated(
    source: str,
    threshold: str = "NULL",
    limit_toxic: str = "NULL",
    limit_other: str = "NULL",
    other: str = "0.5",
) -> str:
    """CTE ``rows``: one moderated row per source row, flags on unrounded scores."""
    return f"""{cleaned(source)}, {TOKENS}, {VOTES}, {LANGUAGE}, {SCORES},
    limits AS (
        SELECT k, s, language, language_raw, toxic, not_toxic,
            coalesce({threshold}, t, 0.5)::DOUBLE AS threshold_used,
            {limit_toxic} AS limit_toxic, {limit_other} AS limit_other
        FROM found JOIN scores USING (k) JOIN src USING (k)
        LEFT JOIN {THRESHOLDS} h(code, t) ON code = language),
    flags AS (
        SELECT *, toxic >= coalesce(limit_toxic, threshold_used) AS toxic_flagged,
            not_toxic >= coalesce(limit_other, {other}) AS not_toxic_flagged
        FROM limits),
    rows AS (
        SELECT k, language, language_raw,
            CASE WHEN s <> '' AND toxic_flagged THEN 'toxic' ELSE 'clean' END AS verdict,
            CASE WHEN s = '' THEN 0 ELSE round(greatest(toxic, not_toxic), 4) END::DOUBLE AS confidence,
            CASE WHEN s <> '' THEN threshold_used END AS threshold_used,
            CASE WHEN s <> '' THEN round(toxic, 4) END AS toxic_score,
            CASE WHEN s <> '' THEN toxic_flagged END AS toxic_flagged,
            CASE WHEN s <> '' THEN round(not_toxic, 4) END AS not_toxic_score,
            CASE WHEN s <> '' THEN not_toxic_flagged END AS not_toxic_flagged,
            coalesce({warning("s")}, '') AS warnings, toxic, not_toxic, s
        FROM flags)"""


FLAT = "toxic_score, toxic_flagged, not_toxic_score, not_toxic_flagged"
ROW = f"language, language_raw, verdict, confidence, threshold_used, {FLAT}, warnings"

EVALUATED = f"""{moderated(LABELLED)},
    ev AS (SELECT k AS doc_id, lang, expected, (verdict = 'toxic')::INT AS predicted, toxic AS score
        FROM rows JOIN src USING (k))"""

# All texts reach .5 on one of the two labels, but that is left to the data to show.
EVALUATED_MAX = f"""{moderated(LABELLED)},
    ev AS (SELECT k AS doc_id, lang, expected,
            (greatest(toxic, not_toxic) >= threshold_used)::INT AS predicted,
            greatest(toxic, not_toxic) AS score
        FROM rows JOIN src USING (k))"""

COUNTS = """
    sum((predicted = 1 AND expected = 1)::INT)::BIGINT AS tp,
    sum((predicted = 1 AND expected = 0)::INT)::BIGINT AS fp,
    sum((predicted = 0 AND expected = 1)::INT)::BIGINT AS fn,
    sum((predicted = 0 AND expected = 0)::INT)::BIGINT AS tn, count(predicted) AS total,
    sum((predicted IS NULL)::INT)::BIGINT AS undecided"""

METRICS = """
    round((tp + tn) / total, 4) AS accuracy,
    CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END::DOUBLE AS "precision",
    CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END::DOUBLE AS recall,
    CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn))
        / (tp / (tp + fp) + tp / (tp + fn)), 4) ELSE 0 END::DOUBLE AS f1"""

BY_LANG = f"""{EVALUATED},
    counts AS (SELECT lang, {COUNTS} FROM ev GROUP BY lang
        UNION ALL SELECT 'overall', {COUNTS} FROM ev),
    metrics AS (SELECT *, {METRICS} FROM counts)"""

TOKEN_WEIGHTS = f"""{raw(LABELLED)}, {TOKENS},
    seen AS (SELECT DISTINCT k, t FROM tok),
    totals AS (SELECT sum(expected) AS pos, count(*) - sum(expected) AS neg FROM src),
    per AS (SELECT t AS tok, sum(expected)::BIGINT AS n_toxic, (count(*) - sum(expected))::BIGINT AS n_clean
        FROM seen JOIN src USING (k) GROUP BY t HAVING count(*) >= 5),
    weights AS (SELECT tok, n_toxic, n_clean, round(1000 * ln(
            ((n_toxic + 0.5::DOUBLE) / (pos - n_toxic + 0.5::DOUBLE))
            / ((n_clean + 0.5::DOUBLE) / (neg - n_clean + 0.5::DOUBLE))))::BIGINT AS w_milli
        FROM per, totals)"""

LEARNED = f"""{TOKEN_WEIGHTS},
    model AS (SELECT tok AS w, trunc(w_milli * 0.5)::BIGINT AS up FROM weights),
    ev AS (SELECT k AS doc_id, any_value(lang) AS lang, any_value(expected) AS expected,
            1 / (1 + exp(-(-2000 + coalesce(sum(up), 0)) / 1000.0::DOUBLE)) AS score
        FROM src LEFT JOIN (SELECT k, up FROM tok JOIN model ON t = w) USING (k) GROUP BY k)"""


# Naive Bayes, fitted on the labelled documents whose key's hash begins above 3.
HELD = "substring(md5(k::VARCHAR), 1, 1) IN ('0', '1', '2', '3')"
BAYES = f"""
    fit_src AS ({LABELLED}),
    fit_tok AS (SELECT expected, t FROM (
        SELECT expected, unnest(string_split_regex(lower(text), '{TOKEN_BREAK}')) AS t FROM fit_src WHERE NOT {HELD})
        WHERE t <> ''),
    per AS (SELECT t, sum(expected) AS pos, count(*) - sum(expected) AS neg FROM fit_tok GROUP BY t),
    tot AS (SELECT sum(pos) AS pos, sum(neg) AS neg, count(*) AS size FROM per),
    bias AS (SELECT round(1000 * ln((sum(expected) + 1)::DOUBLE / (count(*) - sum(expected) + 1)))::BIGINT AS b
        FROM fit_src WHERE NOT {HELD}),
    bayes AS (SELECT per.t AS w, round(1000 * ln(((per.pos + 1)::DOUBLE / (tot.pos + size))
        / ((per.neg + 1)::DOUBLE / (tot.neg + size))))::BIGINT AS up FROM per, tot),
    scored AS (SELECT k, 1 / (1 + exp(-(b + coalesce(x, 0)) / 1000.0::DOUBLE)) AS score FROM clean
        LEFT JOIN (SELECT k, sum(up) AS x FROM tok JOIN bayes ON t = w GROUP BY k) USING (k), bias)"""


# The same with each of the folds left out in turn.
FOLD = "(strpos('0123456789abcdef', substring(md5(k::VARCHAR), 1, 1)) - 1) % 4"
OUT_OF_FOLD = f"""
    all_src AS (SELECT *, {FOLD} AS fold FROM ({LABELLED})),
    all_tok AS (SELECT k, expected, fold, t FROM (SELECT k, expected, fold,
        unnest(string_split_regex(lower(text), '{TOKEN_BREAK}')) AS t FROM all_src) WHERE t <> ''),
    folds AS (SELECT unnest([0, 1, 2, 3]) AS f),
    per AS (SELECT f, t, sum(expected) AS pos, count(*) - sum(expected) AS neg
        FROM all_tok JOIN folds ON fold <> f GROUP BY ALL),
    tot AS (SELECT f, sum(pos) AS pos, sum(neg) AS neg, count(*) AS size FROM per GROUP BY f),
    bias AS (SELECT f, round(1000 * ln((sum(expected) + 1)::DOUBLE / (count(*) - sum(expected) + 1)))::BIGINT AS b
        FROM all_src JOIN folds ON fold <> f GROUP BY f),
    bayes AS (SELECT per.f, t, round(1000 * ln(((per.pos + 1)::DOUBLE / (tot.pos + size))
        / ((per.neg + 1)::DOUBLE / (tot.neg + size))))::BIGINT AS w FROM per JOIN tot USING (f)),
    sums AS (SELECT k, sum(w) AS x FROM all_tok JOIN bayes ON fold = f AND all_tok.t = bayes.t GROUP BY k),
    oof AS (SELECT k AS doc_id, lang, expected, fold::INT AS fold,
        1 / (1 + exp(-(b + coalesce(x, 0)) / 1000.0::DOUBLE)) AS score
        FROM all_src LEFT JOIN sums USING (k) JOIN bias ON fold = f)"""


# Three-character pieces of tokens between blanks; shares per language from documents not held out.
LEARNED_LANGUAGE = f"""{raw(DOCS)}, {TOKENS},
    words AS (SELECT DISTINCT t FROM tok),
    pieces AS (SELECT t, substring(' ' || t || ' ', i, 3) AS g
        FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM words)),
    seen AS (SELECT lang, g, count(*) AS n FROM tok JOIN src USING (k) JOIN pieces USING (t)
        WHERE NOT {HELD} GROUP BY ALL),
    totals AS (SELECT lang, sum(n) AS total FROM seen GROUP BY lang),
    size AS (SELECT count(DISTINCT g) AS size FROM seen),
    grams AS (SELECT a.g, totals.lang, round(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / (total + size)))::BIGINT AS w
        FROM (SELECT DISTINCT g FROM seen) a CROSS JOIN totals CROSS JOIN size
        LEFT JOIN seen ON seen.g = a.g AND seen.lang = totals.lang),
    per_word AS (SELECT t, lang, sum(w) AS w FROM pieces JOIN grams USING (g) GROUP BY ALL),
    sums AS (SELECT k, per_word.lang, sum(w) AS w FROM tok JOIN per_word USING (t) GROUP BY ALL),
    tops AS (SELECT k, max(w) AS top FROM sums GROUP BY k),
    won AS (SELECT k, min(lang) FILTER (w = top) AS lang, round(1 / sum(exp((w - top)::DOUBLE / 1000)), 4) AS confidence
        FROM sums JOIN tops USING (k) GROUP BY k),
    told AS (SELECT k, coalesce(won.lang, 'unknown') AS detected, coalesce(confidence, 0)::DOUBLE AS confidence
        FROM src LEFT JOIN won USING (k))"""


def grid(points) -> str:
    return values((f"{p}",) for p in points).replace("'", "")


def sweep(points, by: str = "") -> str:
    return f"""sweep AS (SELECT {by} th::DOUBLE AS threshold,
            sum((score >= th AND expected = 1)::INT)::BIGINT AS tp,
            sum((score >= th AND expected = 0)::INT)::BIGINT AS fp,
            sum((score < th AND expected = 1)::INT)::BIGINT AS fn,
            sum((score < th AND expected = 0)::INT)::BIGINT AS tn, count(*) AS total
        FROM ev CROSS JOIN {grid(points)} g(th) GROUP BY ALL)"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


REQUESTS = """
    req AS (SELECT doc_id, CASE WHEN source <> 'src0' THEN text END AS text,
        CASE WHEN lang <> 'en' THEN n_chars / 10000 END AS th FROM documents),
    checked AS (SELECT doc_id, [
        CASE WHEN text IS NULL THEN 'missing_text' END,
        CASE WHEN length(text) = 0 THEN 'text_too_short' END,
        CASE WHEN length(text) > 5000 THEN 'text_too_long' END,
        CASE WHEN th < 0 OR th > 1 THEN 'threshold_out_of_range' END] AS found FROM req),
    errors AS (SELECT doc_id, list_filter(found, lambda x: x IS NOT NULL) AS errors FROM checked)"""

# What each kind of body of the query holds, told without JSON.
BODIES = """
    kinds AS (SELECT doc_id, doc_id % 11 AS kind, text, length(text) AS n, n_chars / 10000 AS th FROM documents),
    found AS (SELECT doc_id, kind, n, th,
        CASE WHEN kind IN (1) THEN 'missing_text' WHEN kind = 2 THEN 'null_text'
            WHEN kind IN (3, 4) THEN 'text_not_a_string' WHEN n < 1 THEN 'text_too_short'
            WHEN n > 5000 THEN 'text_too_long' END AS of_text,
        CASE WHEN kind IN (4, 6) THEN 'threshold_not_a_number'
            WHEN kind IN (0, 1, 2, 5) AND th > 1 THEN 'threshold_out_of_range' END AS of_threshold,
        CASE WHEN kind = 6 THEN 'thresholds_not_an_object' WHEN kind = 8 THEN 'thresholds_not_numbers'
            WHEN kind = 7 AND th > 1 THEN 'threshold_out_of_range' END AS of_labels FROM kinds),
    checked AS (SELECT doc_id, CASE WHEN kind IN (0, 5, 6, 7, 8) THEN n END AS n_text,
        CASE WHEN kind IN (0, 1, 2, 5) AND th <= 1 THEN round(th, 4) END AS threshold,
        CASE WHEN kind = 7 THEN round(th, 4) END AS toxic_threshold,
        CASE WHEN kind > 8 THEN 'bad_body' ELSE concat_ws(',', of_text, of_threshold, of_labels) END AS errors
        FROM found)"""

BATCH_ROWS = """
    SELECT doc_id * 1000000 + position AS k, doc_id, position, text, own FROM (
        SELECT doc_id, generate_subscripts(texts, 1) - 1 AS position, unnest(texts) AS text, own
        FROM (SELECT doc_id, string_split(text, chr(10)) AS texts,
                CASE WHEN lang = 'es' THEN 0.04 END AS own FROM documents)
        WHERE len(texts) BETWEEN 1 AND 100)"""

CONVERSATIONS = "SELECT conv_id * 1000000 + turn AS k, conv_id, turn, text FROM conversations"


def preview(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substring({text}, 1, {n}) || '...' ELSE {text} END"


def _lines() -> str:
    return f"""{BY_LANG},
    took AS (SELECT coalesce(lang, 'overall') AS lang, round(avg(length(text) / 100.0), 2) AS ms
        FROM src GROUP BY ROLLUP (lang)),
    shown AS (SELECT *, CASE WHEN lang = 'overall' THEN '**Overall**'
        ELSE coalesce(name, lang) END AS label FROM metrics JOIN took USING (lang) LEFT JOIN {NAMES} n(code, name) ON code = lang)"""


def sql() -> dict[str, str]:
    """Oracle text by query name."""
    pct = "format('{{:.1f}}%', round({} * 100, 1))".format
    nulls = ", ".join(f"'{m}'" for m in config.CSV_NULL_MARKERS)
    docs_found = f"{raw(DOCS)}, {TOKENS}, {VOTES}, {LANGUAGE}"
    mod = moderated(DOCS)
    row_number_counts = "SELECT {0}, count(*) AS n FROM rows GROUP BY {0}".format
    scores6 = "SELECT k AS doc_id, round(toxic, 6) AS toxic, round(not_toxic, 6) AS not_toxic FROM scores"
    stats = """count(*) AS n, round(avg(score), 4) AS avg_score, round(min(score), 4) AS min_score,
        round(max(score), 4) AS max_score"""
    measures = """accuracy, false_positives, false_negatives, toxic_avg_score, clean_avg_score, separation"""
    per_model = """SELECT coalesce(lang, 'overall') AS lang, sum((predicted = expected)::INT) / count(*) AS accuracy,
        sum((predicted > expected)::INT)::DOUBLE AS false_positives,
        sum((predicted < expected)::INT)::DOUBLE AS false_negatives,
        avg(score) FILTER (expected = 1) AS toxic_avg_score,
        avg(score) FILTER (expected = 0) AS clean_avg_score,
        (avg(score) FILTER (expected = 1) > avg(score) FILTER (expected = 0))::INT::DOUBLE AS separation"""
    return {
        "text_column": f"""SELECT conv_id, turn, role, text FROM conversations
            WHERE text IS NOT NULL AND text NOT IN ({nulls})""",
        "batch_requests": q(
            moderated(BATCH_ROWS, threshold="own"),
            """SELECT doc_id, position, language, verdict, confidence, threshold_used, warnings
            FROM rows JOIN src USING (k)""",
        ),
        "validate": q(REQUESTS, "SELECT doc_id, array_to_string(errors, ',') AS errors FROM errors"),
        "validate_batch": """
            SELECT doc_id, n AS n_texts, CASE WHEN n > 100 THEN 'batch_too_large' ELSE '' END AS errors
            FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents)""",
        "typed_requests": q(BODIES, "SELECT * FROM checked"),
        "typed_batches": """SELECT conv_id, CASE WHEN kind = 0 THEN n WHEN kind = 4 THEN 0 END AS n_texts,
                CASE WHEN kind = 4 THEN 0.0::DOUBLE END AS threshold,
                CASE kind WHEN 0 THEN CASE WHEN n > 100 THEN 'batch_too_large' ELSE '' END WHEN 3 THEN 'texts_not_an_array'
                    WHEN 4 THEN 'batch_empty' ELSE 'texts_not_strings' END AS errors
            FROM (SELECT conv_id, conv_id % 5 AS kind, count(*) AS n FROM conversations GROUP BY conv_id)""",
        "dead_letters": q(
            BODIES,
            """SELECT doc_id, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS status, errors,
                CASE WHEN errors <> '' THEN true END AS has_raw, n_text FROM checked""",
        ),
        "reject_summary": q(
            REQUESTS,
            "SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM errors) GROUP BY reason",
        ),
        "sanitise": q(
            cleaned(MESSAGES),
            f"""SELECT doc_id, pos, cleaned, coalesce({warning("s")}, '') AS warnings
            FROM clean JOIN src USING (k)""",
        ),
        "blank_rows": q(
            cleaned(MESSAGES),
            f"""SELECT doc_id, pos, 'unknown' AS language, 'clean' AS verdict, 0::BIGINT AS n_categories,
                0.0::DOUBLE AS confidence, NULL::DOUBLE AS threshold_used,
                '{config.BLANK_WARNING}' AS warnings
            FROM clean JOIN src USING (k) WHERE s = ''""",
        ),
        "word_stats": f"SELECT doc_id, {words('text')} AS n_words FROM documents",
        "short_text": q(
            cleaned(MESSAGES),
            f"""SELECT doc_id, pos, {warning("s")} AS warning FROM clean JOIN src USING (k)
            WHERE s <> '' AND {words("s")} < 3""",
        ),
        "collapse_repeats": f"""
            SELECT doc_id, md5(short) AS digest, length(text) - length(short) AS removed
            FROM (SELECT doc_id, text, {collapse("a")} AS short
                FROM (SELECT doc_id, text, string_split(text, '') AS a FROM documents))""",
        "normalise_strict": rf"""
            SELECT doc_id, md5(plain) AS digest, length(plain) AS length
            FROM (SELECT doc_id, regexp_replace({collapse("a")}, '[^\p{{L}}\p{{N}}_{WS}]', '', 'g') AS plain
                FROM (SELECT doc_id, string_split(lower(text), '') AS a FROM documents))""",
        "preview": "SELECT doc_id, "
        + ", ".join(f"{preview('text', n)} AS first_{n}" for n in (80, 60, 55, 48, 40))
        + " FROM documents",
        "lang_raw": q(docs_found, "SELECT k AS doc_id, language_raw FROM found"),
        "lang_mapped": q(docs_found, "SELECT k AS doc_id, language FROM found"),
        "lang_candidates": q(
            docs_found
            + f""", cand AS (SELECT k, sum(n) AS total, string_agg(lang || '>' || coalesce(target, lang), ','
                ORDER BY n DESC, lang) AS candidates
                FROM votes LEFT JOIN {ALIASES} a(alias, target) ON alias = lang GROUP BY k)""",
            """SELECT k AS doc_id, language_raw AS detected_raw, language AS detected_mapped,
                coalesce(round(n / total, 4), 0)::DOUBLE AS confidence, coalesce(candidates, '') AS candidates
            FROM found LEFT JOIN cand USING (k) LEFT JOIN best USING (k)""",
        ),
        "dim_languages": q(
            docs_found,
            f"""SELECT code, any_value(name) AS name, count(k) AS n_docs
            FROM {NAMES} n(code, name) LEFT JOIN found ON language = code GROUP BY code""",
        ),
        "dim_aliases": q(
            docs_found,
            f"""SELECT alias, any_value(maps_to) AS maps_to,
                coalesce(any_value(name), 'Unknown') AS target_name, count(k) AS n_target_docs
            FROM {ALIASES} a(alias, maps_to) LEFT JOIN {NAMES} n(code, name) ON code = maps_to
            LEFT JOIN found ON language = maps_to GROUP BY alias""",
        ),
        "dim_categories": q(
            mod,
            """SELECT 'toxic' AS category, coalesce(sum(toxic_flagged::INT), 0)::BIGINT AS n_docs FROM rows
            UNION ALL SELECT 'not_toxic', coalesce(sum(not_toxic_flagged::INT), 0)::BIGINT FROM rows""",
        ),
        "lang_override": q(
            docs_found,
            """SELECT k AS doc_id, language_raw, CASE WHEN lang = 'fr' THEN 'fr' ELSE language END AS language
            FROM found JOIN src USING (k)""",
        ),
        "lang_profile": q(
            f"""{raw(DOCS)}, {TOKENS},
            counted AS (SELECT lang, t AS tok, count(*) AS n FROM tok JOIN src USING (k) GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank FROM counted),
            top AS (SELECT * FROM ranked WHERE rank <= 15)""",
            """SELECT * FROM top WHERE tok NOT IN (SELECT tok FROM top GROUP BY tok
                HAVING count(*) = (SELECT count(DISTINCT lang) FROM top))""",
        ),
        "lang_confusion": q(
            docs_found,
            "SELECT lang, count(*) AS total, "
            + ", ".join(
                f"sum((language_raw = '{code}')::INT)::BIGINT AS as_{code}" for code in DETECTED
            )
            + """, round(avg((lang = language_raw)::INT), 4) AS agreement
            FROM found JOIN src USING (k) GROUP BY lang""",
        ),
        "lang_learned": q(LEARNED_LANGUAGE, "SELECT k AS doc_id, detected, confidence FROM told"),
        "lang_learned_confusion": q(
            LEARNED_LANGUAGE,
            f"SELECT lang, detected, count(*) AS n FROM told JOIN src USING (k) WHERE {HELD} GROUP BY ALL",
        ),
        "threshold_lookup": f"""SELECT doc_id, lang, coalesce(t, 0.5)::DOUBLE AS threshold FROM documents
            LEFT JOIN {ALIASES} a(alias, target) ON alias = lang
            LEFT JOIN {THRESHOLDS} h(code, t) ON code = coalesce(target, lang)""",
        "threshold_override": q(
            moderated(DOCS, threshold="CASE lang WHEN 'de' THEN 0.0 WHEN 'en' THEN 0.99 END"),
            "SELECT k AS doc_id, threshold_used, verdict FROM rows",
        ),
        "threshold_per_category": q(
            moderated(
                DOCS,
                threshold="0.6",
                limit_toxic="CASE WHEN lang = 'fr' THEN 0.04 END",
                limit_other="CASE WHEN lang = 'en' THEN 0.95 END",
            ),
            f"SELECT k AS doc_id, verdict, {FLAT} FROM rows",
        ),
        "tokens": rf"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest,
                md5(array_to_string(t[1:512], ' ')) AS cut_digest, len(t) > 512 AS truncated
            FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '{TOKEN_BREAK}'),
                lambda x: x <> '') AS t FROM documents)""",
        "tokens_by_lang": q(
            f"{raw(DOCS)}, {TOKENS}, n AS (SELECT k, lang, count(t) AS n FROM src LEFT JOIN tok USING (k) GROUP BY ALL)",
            """SELECT lang, count(*) AS n_texts, round(avg(n), 4) AS avg_tokens, min(n) AS min_tokens,
                max(n) AS max_tokens FROM n GROUP BY lang""",
        ),
        "score_labels": q(f"{raw(DOCS)}, {TOKENS}, {SCORES}", scores6),
        "score_join": q(f"{raw(DOCS)}, {TOKENS}, {SCORES}", scores6),
        "softmax_scores": q(
            f"{raw(DOCS)}, {TOKENS}, {SCORES}",
            """SELECT k AS doc_id, round(exp(x_t / 1000) / (exp(x_t / 1000) + exp(x_n / 1000)), 6) AS toxic,
                round(exp(x_n / 1000) / (exp(x_t / 1000) + exp(x_n / 1000)), 6) AS not_toxic FROM logits""",
        ),
        "toxic_score": q(
            f"{raw(DOCS)}, {TOKENS}, {SCORES}",
            """SELECT k AS doc_id, round(toxic, 4) AS toxic_score, 0.0::DOUBLE AS threat_score,
                'toxic,not_toxic' AS labels FROM scores""",
        ),
        "token_weights": q(TOKEN_WEIGHTS, "SELECT * FROM weights"),
        "trained_scores": q(
            f"{raw(DOCS)}, {TOKENS}, {BAYES}",
            "SELECT k AS doc_id, round(score, 4) AS score, (score >= 0.5)::INT AS predicted FROM scored",
        ),
        "holdout_metrics": q(
            f"""{raw(DOCS)}, {TOKENS}, {BAYES},
            ev AS (SELECT lang, expected, (score >= 0.5)::INT AS predicted
                FROM fit_src JOIN scored USING (k) WHERE {HELD}),
            counts AS (SELECT lang, {COUNTS} FROM ev GROUP BY lang UNION ALL SELECT 'overall', {COUNTS} FROM ev)""",
            f"SELECT *, {METRICS} FROM counts",
        ),
        "oof_scores": q(OUT_OF_FOLD, "SELECT doc_id, lang, expected, fold, round(score, 4) AS score FROM oof"),
        "oof_metrics": q(
            f"""{OUT_OF_FOLD}, ev AS (SELECT lang, expected, (score >= 0.5)::INT AS predicted FROM oof),
            counts AS (SELECT lang, {COUNTS} FROM ev GROUP BY lang UNION ALL SELECT 'overall', {COUNTS} FROM ev)""",
            f"SELECT *, {METRICS} FROM counts",
        ),
        "oof_calibrate": q(
            f"""{OUT_OF_FOLD},
            points AS (SELECT lang, score, sum(expected) AS pos, count(*) - sum(expected) AS neg FROM oof GROUP BY ALL),
            cuts AS (SELECT lang, score AS threshold,
                (sum(pos) OVER above)::BIGINT AS tp, (sum(neg) OVER above)::BIGINT AS fp,
                (sum(pos) OVER (PARTITION BY lang))::BIGINT - tp AS fn, (sum(neg) OVER (PARTITION BY lang))::BIGINT - fp AS tn
                FROM points WINDOW above AS (PARTITION BY lang ORDER BY score DESC)),
            ranked AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f, row_number() OVER (PARTITION BY lang
                ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, threshold DESC) AS r,
                max(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0)) OVER (PARTITION BY lang) > 0
                AS separable FROM cuts)""",
            """SELECT lang, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f, 4) AS f1, separable
            FROM ranked WHERE r = 1""",
        ),
        "src_csv": f"SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND text NOT IN ({nulls})",
        "src_csv_typed": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE round(value, 4) END::DOUBLE AS value,
                strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS seen,
                strftime(ts, '%Y-%m-%d') AS day, user_id % 2 = 0 AS even,
                CASE WHEN event_id % 2 = 0 THEN '1' ELSE event_type END AS mixed,
                'bigint,double,timestamp,date,boolean,string' AS kinds FROM events""",
        "recorded_runs": q(
            mod,
            """SELECT lang AS name, count(*) AS batch_size, count(*) AS total_texts,
                sum((verdict = 'toxic')::INT)::BIGINT AS flagged_count, sum((verdict <> 'toxic')::INT)::BIGINT AS clean_count,
                sum((s = '')::INT)::BIGINT AS skipped_count, 0::BIGINT AS undecided_count, true AS timed
            FROM rows JOIN src USING (k) GROUP BY lang""",
        ),
        "meaning_gap": q(
            f"""labelled AS ({LABELLED}),
            firsts AS (SELECT expected || '-' || floor(log2(n_chars + 1))::INT AS meaning, labelled.lang,
                min(k) AS k FROM labelled JOIN (SELECT doc_id AS k, n_chars FROM documents) USING (k)
                WHERE labelled.lang IN ('en', 'de', 'es', 'fr') GROUP BY ALL),
            {moderated("SELECT k, text, meaning, firsts.lang AS lang FROM firsts JOIN (SELECT doc_id AS k, text FROM documents) USING (k)")},
            m AS (SELECT meaning, {", ".join(
                f"round(avg(toxic) FILTER (lang = '{code}'), 4) AS {code}" for code in ("en", "de", "es", "fr")
            )} FROM rows JOIN src USING (k) GROUP BY meaning)""",
            """SELECT meaning, en, de, es, fr, round(de - en, 4) AS gap_de, round(es - en, 4) AS gap_es,
                round(fr - en, 4) AS gap_fr FROM m""",
        ),
        "sink_results": q(
            moderated("SELECT item_id AS k, text FROM benchmark"),
            f"""SELECT {preview("text", 80)} AS text, language, verdict, toxic_score,
                coalesce(threshold_used::VARCHAR, 'N/A') AS threshold
            FROM rows JOIN src USING (k)""",
        ),
        "sink_detail": q(
            moderated(CONVERSATIONS),
            "SELECT conv_id, turn, verdict, confidence, toxic_score, toxic_flagged FROM rows JOIN src USING (k)",
        ),
        "sink_by_verdict": q(mod, "SELECT k AS doc_id, language, verdict, confidence FROM rows"),
        "stream_once": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type",
        "stream_verdict_rate": """
            SELECT strftime(window_start, '%Y-%m-%d') AS window_start, n AS total_texts, flagged AS flagged_count, flagged / n AS flagged_share
            FROM (SELECT date_trunc('day', ts) AS window_start, count(*) AS n,
                    sum((value > 100)::INT)::BIGINT AS flagged FROM events GROUP BY 1)
            WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
        "stream_bayes": q(f"{raw(DOCS)}, {TOKENS}, {BAYES}", "SELECT k AS doc_id, round(score, 4) AS score FROM scored"),
        "stream_language": q(LEARNED_LANGUAGE, "SELECT k AS doc_id, detected, confidence FROM told"),
        "stream_by_verdict": q(mod, "SELECT k AS doc_id, language, verdict, confidence FROM rows"),
        "stream_history": """SELECT conv_id, rank, turn, text FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC)::INT AS rank FROM conversations)
            WHERE rank <= 20""",
        "byo_scores": f"""SELECT doc_id, round(1 - pow(0.5, n), 6) AS toxic,
                round(pow(0.5, n), 6) AS not_toxic
            FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '{BYO_WORDS}')) AS n FROM documents)""",
        "byo_moderate": q(
            f"""{mod}, own AS (SELECT k, CASE WHEN s = '' THEN NULL ELSE 1 - pow(0.5, n) END AS toxic FROM rows JOIN (
                SELECT k, len(regexp_extract_all(lower(text), '{BYO_WORDS}')) AS n FROM src) USING (k))""",
            """SELECT k AS doc_id, CASE WHEN own.toxic >= threshold_used THEN 'toxic' ELSE 'clean' END AS verdict,
                round(greatest(own.toxic, 1 - own.toxic), 4) AS confidence, threshold_used,
                own.toxic >= threshold_used AS toxic_flagged, NULL::VARCHAR AS error
            FROM rows JOIN own USING (k)""",
        ),
        "error_rows": q(
            moderated(CONVERSATIONS),
            """SELECT role, count(*) AS total_texts,
                sum((role <> 'user' AND verdict = 'toxic')::INT)::BIGINT AS flagged_count,
                sum((role <> 'user' AND verdict = 'clean')::INT)::BIGINT AS clean_count,
                sum((role = 'user')::INT)::BIGINT AS undecided_count
            FROM rows JOIN src USING (k) JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn)
            GROUP BY role""",
        ),
        "moderate": q(mod, f"SELECT k AS doc_id, {ROW} FROM rows"),
        "stream_moderate": q(mod, f"SELECT k AS doc_id, {ROW} FROM rows"),
        "category_flags": q(mod, f"SELECT k AS doc_id, {FLAT} FROM rows"),
        "verdict_any_label": q(
            moderated(DOCS, threshold="0.95", other="threshold_used"),
            f"""SELECT k AS doc_id, {FLAT},
                CASE WHEN greatest(toxic, not_toxic) >= 0.95 THEN 'toxic' ELSE 'clean' END AS verdict
            FROM rows""",
        ),
        "max_label_rule": q(
            mod,
            """SELECT CASE WHEN greatest(toxic, not_toxic) >= 0.5 THEN 'toxic' ELSE 'clean' END AS verdict,
                count(*) AS n FROM rows GROUP BY 1""",
        ),
        "top_category": q(
            f"{raw(DOCS)}, {TOKENS}, {SCORES}",
            """SELECT k AS doc_id, CASE WHEN toxic >= not_toxic THEN 'toxic' ELSE 'not_toxic' END AS top_category,
                round(greatest(toxic, not_toxic), 4) AS top_score FROM scores""",
        ),
        "flagged_list": q(
            moderated(DOCS, limit_other="0.95"),
            """SELECT k AS doc_id, CASE WHEN toxic_flagged AND not_toxic_flagged THEN 'toxic, not_toxic'
                WHEN toxic_flagged THEN 'toxic' WHEN not_toxic_flagged THEN 'not_toxic' ELSE 'none' END AS flagged
            FROM rows""",
        ),
        "safe_verdict": q(
            rf"""src AS ({MESSAGES}),
            clean AS (SELECT k, text AS s, regexp_replace({collapse("a")}, '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')
                AS cleaned FROM (SELECT k, text, string_split(lower(text), '') AS a FROM src)),
            {TOKENS}, {SCORES},
            routed AS (SELECT doc_id, pos, {words("text")} >= 3 AS long, round(toxic, 4) AS score, not_toxic
                FROM src JOIN scores USING (k))""",
            f"""SELECT doc_id, pos,
                CASE WHEN NOT long OR score < 0.5 THEN 'clean' WHEN score < 0.85 THEN 'needs_review'
                    ELSE 'toxic' END AS verdict,
                CASE WHEN long THEN CASE WHEN score >= 0.5 AND score < 0.85 THEN 'uncertain' ELSE 'high' END
                    END AS certainty,
                CASE WHEN long THEN score ELSE 0 END::DOUBLE AS max_score,
                CASE WHEN NOT long THEN '{config.SHORT_NOTE}' END AS note,
                CASE WHEN long THEN 0.5::DOUBLE END AS threshold_used,
                CASE WHEN long THEN 2 ELSE 0 END::BIGINT AS n_categories,
                CASE WHEN long THEN not_toxic >= 0.5 END AS not_toxic_flagged
            FROM routed""",
        ),
        "display_rows": q(
            moderated("SELECT item_id AS k, text FROM benchmark"),
            f"""SELECT {preview("text", 80)} AS text, language, verdict, toxic_score,
                coalesce(threshold_used::VARCHAR, 'N/A') AS threshold
            FROM rows JOIN src USING (k)""",
        ),
        "batch_summary": q(
            moderated(CONVERSATIONS),
            """SELECT conv_id, count(*) AS total_texts, sum((verdict = 'toxic')::INT)::BIGINT AS flagged_count,
                (count(*) - sum((verdict = 'toxic')::INT))::BIGINT AS clean_count, 0::BIGINT AS undecided_count
            FROM rows JOIN src USING (k) GROUP BY conv_id""",
        ),
        "verdict_counts": q(mod, row_number_counts("verdict")),
        "language_counts": q(moderated(MESSAGES), row_number_counts("language")),
        "class_crosstab": """SELECT lang, (count(*) - sum(toxic))::BIGINT AS clean, sum(toxic)::BIGINT AS toxic
            FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
        "accuracy": q(
            EVALUATED,
            """SELECT sum((predicted = expected)::INT)::BIGINT AS correct, count(*) AS total,
                round(avg((predicted = expected)::INT), 4) AS accuracy FROM ev""",
        ),
        "accuracy_by_lang": q(
            EVALUATED,
            """SELECT lang, sum((predicted = expected)::INT)::BIGINT AS correct, count(*) AS total,
                round(avg((predicted = expected)::INT), 4) AS accuracy FROM ev GROUP BY lang""",
        ),
        "confusion": q(EVALUATED, f"SELECT lang, {COUNTS} FROM ev GROUP BY lang"),
        "metrics_by_lang": q(BY_LANG, "SELECT * FROM metrics"),
        "error_rates": q(
            EVALUATED,
            """SELECT lang, sum((predicted > expected)::INT)::BIGINT AS fp,
                sum(1 - expected)::BIGINT AS negatives,
                coalesce(round(avg(predicted) FILTER (expected = 0), 4), 0) AS fpr,
                sum((predicted < expected)::INT)::BIGINT AS fn, sum(expected)::BIGINT AS positives,
                coalesce(round(avg(1 - predicted) FILTER (expected = 1), 4), 0) AS fnr
            FROM ev GROUP BY lang""",
        ),
        "score_stats": q(EVALUATED, f"SELECT expected, {stats} FROM ev GROUP BY expected"),
        "score_histogram": q(
            f"""{LEARNED}, r AS (SELECT lang, expected, round(score, 4) AS s FROM ev),
            ranges AS (SELECT lang, expected, min(s) AS mn, max(s) AS mx FROM r GROUP BY ALL)""",
            """SELECT lang, expected,
                CASE WHEN mn = mx THEN 5 ELSE least(9, floor((s - mn) / (mx - mn) * 10)::INT) END AS bin,
                count(*) AS n, any_value(mn) AS range_min, any_value(mx) AS range_max
            FROM r JOIN ranges USING (lang, expected) GROUP BY ALL""",
        ),
        "latency_summary": """SELECT event_type, count(value) AS n, round(avg(value), 2) AS avg_ms,
            round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms FROM events GROUP BY event_type""",
        "throughput": """SELECT n AS batch_size, count(*) AS runs, round(sum(ms) / sum(n), 2) AS per_text_ms,
                round(sum(n) * 1000 / sum(ms), 2) AS texts_per_sec
            FROM (SELECT user_id, count(*) AS n, sum(value) AS ms FROM events GROUP BY user_id) GROUP BY n""",
        "threshold_sweep": q(
            f"{EVALUATED}, {sweep(config.SWEEP_GRID)}", f"SELECT *, {METRICS} FROM sweep"
        ),
        "threshold_calibrate": q(
            f"""{LEARNED}, {sweep(FINE_GRID, "lang,")},
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang
                ORDER BY CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END DESC,
                    threshold DESC) AS r,
                max(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0))
                    OVER (PARTITION BY lang) > 0 AS separable
                FROM (SELECT *, {METRICS} FROM sweep))""",
            "SELECT lang, threshold, tp, fp, fn, tn, f1, separable FROM ranked WHERE r = 1",
        ),
        "score_gap": q(
            f"""{EVALUATED}, m AS (SELECT expected, {", ".join(
                f"round(avg(score) FILTER (lang = '{code}'), 4) AS {code}" for code in ("en", "de", "es", "fr")
            )} FROM ev GROUP BY expected)""",
            """SELECT expected, en, de, es, fr, round(de - en, 4) AS gap_de, round(es - en, 4) AS gap_es,
                round(fr - en, 4) AS gap_fr FROM m""",
        ),
        "false_positives": q(
            EVALUATED_MAX,
            "SELECT doc_id, lang, round(score, 4) AS score FROM ev WHERE expected = 0 AND predicted = 1",
        ),
        "false_negatives": q(
            EVALUATED,
            "SELECT doc_id, lang, round(score, 4) AS score FROM ev WHERE expected = 1 AND predicted = 0",
        ),
        "misclassified": q(
            EVALUATED,
            f"""SELECT doc_id, ev.lang, CASE ev.expected WHEN 1 THEN 'TOXIC' ELSE 'CLEAN' END AS expected_label,
                CASE predicted WHEN 1 THEN 'TOXIC' ELSE 'CLEAN' END AS predicted_label,
                {preview("text", 55)} AS preview
            FROM ev JOIN src ON k = doc_id WHERE ev.expected <> predicted""",
        ),
        "edge_kinds": q(
            moderated(MESSAGES),
            rf"""SELECT CASE WHEN rows.s = '' THEN 'blank'
                    WHEN NOT regexp_matches(rows.s, '[\p{{L}}\p{{N}}]') THEN 'symbols'
                    WHEN {words("rows.s")} < 3 THEN 'short'
                    WHEN cleaned <> rows.s THEN 'repeats'
                    WHEN regexp_matches(rows.s, '\p{{Lu}}') AND upper(rows.s) = rows.s THEN 'caps'
                    WHEN regexp_matches(rows.s, '[A-Za-z]')
                        AND regexp_matches(rows.s, '[\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}\x{{900}}-\x{{97F}}]')
                        THEN 'mixed_script' ELSE 'plain' END AS kind,
                count(*) AS n, sum((verdict = 'toxic')::INT)::BIGINT AS flagged,
                sum((warnings <> '')::INT)::BIGINT AS warned
            FROM rows JOIN clean USING (k) GROUP BY 1""",
        ),
        "ensemble": q(
            f"""{moderated(LABELLED)},
            pair AS (SELECT expected, greatest(toxic, not_toxic) >= threshold_used AS a, verdict = 'toxic' AS b
                FROM rows JOIN src USING (k)),
            ev AS (SELECT 'first' AS model, expected, a::INT AS predicted FROM pair
                UNION ALL SELECT 'second', expected, b::INT FROM pair
                UNION ALL SELECT 'both', expected, (a AND b)::INT FROM pair
                UNION ALL SELECT 'either', expected, (a OR b)::INT FROM pair),
            counts AS (SELECT model, {COUNTS} FROM ev GROUP BY model)""",
            f"SELECT *, {METRICS} FROM counts",
        ),
        "ensemble_undecided": q(
            f"""{moderated(LABELLED)},
            pair AS (SELECT expected, CASE WHEN lang <> 'fr' THEN greatest(toxic, not_toxic) >= threshold_used END AS a,
                CASE WHEN length(text) <= 2000 THEN verdict = 'toxic' END AS b
                FROM rows JOIN src USING (k)),
            ev AS (SELECT 'first' AS model, expected, a::INT AS predicted FROM pair
                UNION ALL SELECT 'second', expected, b::INT FROM pair
                UNION ALL SELECT 'both', expected, CASE WHEN a + b IS NOT NULL THEN (a AND b)::INT END
                    FROM (SELECT expected, a::INT AS a, b::INT AS b FROM pair)
                UNION ALL SELECT 'either', expected, CASE WHEN a + b IS NOT NULL THEN (a OR b)::INT END
                    FROM (SELECT expected, a::INT AS a, b::INT AS b FROM pair)),
            counts AS (SELECT model, {COUNTS} FROM ev GROUP BY model)""",
            f"SELECT *, {METRICS} FROM counts",
        ),
        "model_compare_undecided": q(
            f"""{moderated(LABELLED)},
            two AS (SELECT expected, (greatest(toxic, not_toxic) >= threshold_used)::INT AS a,
                CASE WHEN NOT (expected = 1 AND verdict = 'toxic') THEN (verdict = 'toxic')::INT END AS b
                FROM rows JOIN src USING (k)),
            m AS (SELECT 'accuracy' AS metric, round(avg((a = expected)::INT), 4) AS x, round(avg((b = expected)::INT), 4) AS y
                    FROM two
                UNION ALL SELECT 'false_positives', sum((a > expected)::INT), sum((b > expected)::INT) FROM two)""",
            """SELECT metric, x::DOUBLE AS max_label, y::DOUBLE AS toxic_label, CASE WHEN x = y THEN '-'
                WHEN (metric = 'false_positives') = (x < y) THEN 'max_label' ELSE 'toxic_label' END AS winner FROM m""",
        ),
        "paired_results": q(
            moderated(LABELLED),
            """SELECT expected, (greatest(toxic, not_toxic) >= threshold_used)::INT AS predicted_a,
                (verdict = 'toxic')::INT AS predicted_b, count(*) AS n
            FROM rows JOIN src USING (k) GROUP BY ALL""",
        ),
        "model_compare": q(
            f"""{moderated(LABELLED)},
            a AS ({per_model} FROM (SELECT lang, expected, greatest(toxic, not_toxic) AS score,
                (greatest(toxic, not_toxic) >= threshold_used)::INT AS predicted FROM rows JOIN src USING (k))
                GROUP BY ROLLUP (lang)),
            b AS ({per_model} FROM (SELECT lang, expected, toxic AS score, (verdict = 'toxic')::INT AS predicted
                FROM rows JOIN src USING (k)) GROUP BY ROLLUP (lang)),
            la AS (SELECT * FROM a UNPIVOT INCLUDE NULLS (x FOR metric IN ({measures}))),
            lb AS (SELECT * FROM b UNPIVOT INCLUDE NULLS (y FOR metric IN ({measures})))""",
            """SELECT lang, metric, round(x, 4) AS max_label, round(y, 4) AS toxic_label,
                CASE WHEN x IS NULL OR y IS NULL OR metric = 'toxic_avg_score' OR round(x, 4) = round(y, 4) THEN '-'
                    WHEN (metric IN ('false_positives', 'false_negatives', 'clean_avg_score')) = (x < y)
                    THEN 'max_label' ELSE 'toxic_label' END AS winner
            FROM la JOIN lb USING (lang, metric)""",
        ),
        "append_rows": """SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars
            FROM (SELECT text, lang FROM documents UNION ALL SELECT text, NULL FROM benchmark) GROUP BY lang""",
        "report_lines": q(
            _lines(),
            f"""SELECT lang, '| ' || label || ' | ' || total || ' | ' || {pct("accuracy")} || ' | '
                || {pct('"precision"')} || ' | ' || {pct("recall")} || ' | '
                || format('{{:.2f}}', round(f1, 2)) || ' | ' || format('{{:.2f}}', ms) || 'ms |' AS line FROM shown""",
        ),
        "report_metrics": q(
            BY_LANG,
            """SELECT 'keywords' AS model, 0.5::DOUBLE AS threshold, lang, accuracy, "precision", recall, f1,
                tp, fp, fn, tn, total FROM metrics""",
        ),
        "head_preview": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5",
        "recent_history": q(
            moderated(f"{CONVERSATIONS} ORDER BY conv_id DESC, turn DESC LIMIT 20"),
            f"""SELECT conv_id, turn, {preview("text", 60)} AS text, language, verdict, threshold_used
            FROM rows JOIN src USING (k)""",
        ),
    }
