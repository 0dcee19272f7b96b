"""The engine's own queries by name, over the whole of the tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import marking, text as T
from .operators import corpus, metrics, modeldata, tokenizers
from .plans import corpora
from .profiles import LATIN, TAMIL
from .sources import readers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _all() -> None:
    """The modules that hold the rest of the queries; they register what they hold."""
    from . import catalog_models, catalog_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.document_lines(_table(spark, sf, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# -- pieces of SQL that many queries share -----------------------------------------------------------------------

_LINES = "SELECT doc_id, source, lang, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)"
_WITH = f"WITH lines AS ({_LINES})"
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",!?\"\\-%''"
_WORD = rf"[{_LATIN}]+(?:\.[{_LATIN}]+)*|[0-9]+(?:\.[0-9]+)?|[,!?\"\-%'']"


def _toks(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def _bad(c: str) -> str:
    return rf"length(regexp_replace({c}, '[{_LATIN}\s0-9,!?\x22\-%''.]', '', 'g'))"


def _words(c: str) -> str:
    return rf"array_to_string(regexp_extract_all(regexp_replace({c}, '[\x{{0B80}}-\x{{0BFF}}]+', ' ', 'g'), '{_WORD}'), ' ')"


_RATES = ("contamination_rate", "non_alpha_rate", "encoding_anomaly_rate", "duplicate_ratio", "invalid_line_rate")


def _hygiene_sql(by: str) -> str:
    return rf"""
        SELECT {by}, count(*) AS total_lines, CAST(sum(length(line)) AS BIGINT) AS total_chars,
               round(100.0 * sum({_bad('line')}) / sum(length(line)), 6) AS contamination_rate,
               round(100.0 * sum(length(line) - length(regexp_replace(line, '[\pN\pP\pS]', '', 'g'))) / sum(length(line)), 6) AS non_alpha_rate,
               round(100.0 * count(*) FILTER (WHERE line <> '' AND (contains(line, chr(65533)) OR regexp_matches(line, '(^|[\s\p{{Cc}}\p{{Cf}}])\pM'))) / count(*), 6) AS encoding_anomaly_rate,
               round(100.0 * (count(*) FILTER (WHERE line <> '') - count(DISTINCT line) FILTER (WHERE line <> '')) / count(*), 6) AS duplicate_ratio,
               round(100.0 * count(*) FILTER (WHERE len({_toks('line')}) < 2) / count(*), 6) AS invalid_line_rate
        FROM lines"""


# -- hygiene ----------------------------------------------------------------------------------------------------


@_query(f"{_WITH} {_hygiene_sql('source')} GROUP BY source")
def hygiene_by_source(spark, sf):
    return _rounded(metrics.hygiene(_lines(spark, sf)), *_RATES)


@_query(f"{_WITH} {_hygiene_sql('lang')} GROUP BY ROLLUP (lang)")
def hygiene_by_lang(spark, sf):
    return _rounded(metrics.hygiene(_lines(spark, sf), "lang", total=True), *_RATES)


def _band_sql(c: str, a: int, b: int) -> str:
    return f"CASE WHEN {c} < {a} THEN 'acceptable' WHEN {c} < {b} THEN 'investigate' ELSE 'concerning' END AS {c}_band"


@_query(f"{_WITH}, h AS ({_hygiene_sql('lang')} GROUP BY lang) SELECT lang, {', '.join(_band_sql(c, *metrics.BANDS[c]) for c in _RATES)} FROM h")
def hygiene_bands(spark, sf):
    return metrics.banded(metrics.hygiene(_lines(spark, sf), "lang")).select("lang", *[f"{c}_band" for c in _RATES])


_ACUTE = "chr(769)"


@_query(rf"""{_WITH}, odd AS (SELECT doc_id, line_no, replace(replace(line, ' a', ' ' || {_ACUTE} || 'a'), 'zz', chr(65533)) AS line FROM lines)
    SELECT doc_id, line_no, CASE WHEN contains(line, chr(65533)) THEN 'replacement char' ELSE 'orphaned mark' END AS reason FROM odd
    WHERE contains(line, chr(65533)) OR regexp_matches(line, '(^|[\s\p{{Cc}}\p{{Cf}}])\pM')""")
def anomalous_lines(spark, sf):
    """With marks and replacement characters put in, as the tables have none."""
    odd = F.regexp_replace(F.regexp_replace("line", " a", " ́a"), "zz", "�")
    return _lines(spark, sf).select("doc_id", "line_no", T.anomaly(odd).alias("reason")).where("reason is not null")


@_query(rf"""{_WITH}, n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY source, doc_id, line_no) AS k FROM lines)
    SELECT source, doc_id, line_no, 'short' AS "check", 'short' AS reason, line FROM lines WHERE len({_toks('line')}) < 2
    UNION ALL SELECT source, doc_id, line_no, 'contaminated', 'disallowed char', line FROM lines WHERE line <> '' AND {_bad('line')} > 0
    UNION ALL SELECT source, doc_id, line_no, 'anomalous', CASE WHEN contains(line, chr(65533)) THEN 'replacement char' ELSE 'orphaned mark' END, line FROM lines
        WHERE line <> '' AND (contains(line, chr(65533)) OR regexp_matches(line, '(^|[\s\p{{Cc}}\p{{Cf}}])\pM'))
    UNION ALL SELECT source, doc_id, line_no, 'duplicate', 'duplicate', line FROM n WHERE line <> '' AND k > 1""")
def line_audit(spark, sf):
    return corpus.audit(_lines(spark, sf))


# -- lexical profile --------------------------------------------------------------------------------------------


def _profile_sql(by: str) -> str:
    return rf"""{_WITH}, t AS (SELECT {by}, unnest({_toks('line')}) AS token FROM lines)
        SELECT {by}, count(*) AS word_count, count(DISTINCT token) AS types, round(count(DISTINCT token) / count(*), 6) AS ttr, round(entropy(token), 6) AS unigram_entropy FROM t GROUP BY {by}"""


@_query(_profile_sql("lang"))
def profile_by_lang(spark, sf):
    return _rounded(metrics.profile(metrics.token_counts(_lines(spark, sf), "lang"), "lang"), "ttr", "unigram_entropy")


@_query(_profile_sql("source"))
def profile_by_source(spark, sf):
    return _rounded(metrics.profile(metrics.token_counts(_lines(spark, sf)), "source"), "ttr", "unigram_entropy")


@_query(f"{_WITH} SELECT lang, len({_toks('line')}) AS sentence_length, count(*) AS line_count FROM lines GROUP BY ALL")
def sentence_length_hist(spark, sf):
    return metrics.length_histogram(_lines(spark, sf), "lang")


@_query(f"""{_WITH}, n AS (SELECT lang, len({_toks('line')}) AS n FROM lines)
    SELECT lang, count(n) AS "count", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS "min", {', '.join(f'round(quantile_cont(n, {q}), 6) AS {a}' for q, a in ((0.5, 'p50'), (0.75, 'p75'), (0.9, 'p90'), (0.95, 'p95'), (0.999, 'p99_9')))}, max(n) AS "max"
    FROM n GROUP BY lang""")
def length_describe(spark, sf):
    lines = _lines(spark, sf).select("lang", F.size(T.tokens("line")).cast("long").alias("n"))
    return _rounded(metrics.describe(lines, "n", "lang"), "mean", "std", "p50", "p75", "p90", "p95", "p99_9")


@_query(f"{_WITH}, n AS (SELECT len({_toks('line')}) AS n FROM lines) SELECT least(CAST(floor(n * 50 / 200.0) AS BIGINT), 49) AS bin, count(*) AS n FROM n WHERE n BETWEEN 0 AND 200 GROUP BY 1")
def length_bins(spark, sf):
    return metrics.histogram(_lines(spark, sf).select(F.size(T.tokens("line")).alias("n")), "n", 0, 200)


def _mtld_sql(by: str) -> str:
    """A fold over each group's words: what has been seen since the last reset, how many words that was, and the resets."""
    known = "list_contains(a.seen, x.seen[1])"
    types, limit = f"(len(a.seen) + CASE WHEN {known} THEN 0 ELSE 1 END)", "CAST(0.72 AS DOUBLE)"
    full = f"{types} / (a.n + 1) <= {limit}"
    step = f"struct_pack(seen := CASE WHEN {full} THEN a.seen[1:0] WHEN {known} THEN a.seen ELSE list_append(a.seen, x.seen[1]) END, n := CASE WHEN {full} THEN 0 ELSE a.n + 1 END, f := CASE WHEN {full} THEN a.f + 1 ELSE a.f END)"
    return f"""{_WITH}, w AS (SELECT {by}, flatten(list({_toks('line')} ORDER BY doc_id, line_no)) AS t FROM lines GROUP BY {by}), p AS (SELECT {by}, t FROM w UNION ALL SELECT {by}, list_reverse(t) FROM w),
        s AS (SELECT {by}, len(t) AS total, list_reduce(list_transform(t, lambda x: struct_pack(seen := [x], n := CAST(0 AS BIGINT), f := CAST(0 AS BIGINT))), lambda a, x: {step}, struct_pack(seen := CAST([] AS VARCHAR[]), n := CAST(0 AS BIGINT), f := CAST(0 AS BIGINT))) AS s FROM p),
        f AS (SELECT {by}, total, s.f + CASE WHEN s.n > 0 THEN (1 - len(s.seen) / s.n) / (1 - {limit}) ELSE 0 END AS factors FROM s)
        SELECT {by}, round(avg(CASE WHEN factors > 0 THEN total / factors ELSE 0 END), 6) AS mtld FROM f GROUP BY {by}"""


@_query(_mtld_sql("lang"))
def mtld_by_lang(spark, sf):
    return _rounded(metrics.mtld(_lines(spark, sf), "lang"), "mtld")


_TOKENS = f"{_WITH}, t AS (SELECT lang, unnest({_toks('line')}) AS token FROM lines)"


@_query(f"""{_TOKENS}, a AS (SELECT DISTINCT token FROM t WHERE lang = 'en'), b AS (SELECT DISTINCT token FROM t WHERE lang = 'fr')
    SELECT (SELECT count(*) FROM a) AS first_types, (SELECT count(*) FROM b) AS second_types, (SELECT count(*) FROM a JOIN b USING (token)) AS shared,
           round((SELECT count(*) FROM a JOIN b USING (token)) / (SELECT count(*) FROM b), 6) AS share""")
def vocab_overlap(spark, sf):
    counts = metrics.token_counts(_lines(spark, sf), "lang")
    return _rounded(metrics.vocabulary_overlap(counts.where("lang = 'en'"), counts.where("lang = 'fr'")), "share")


@_query(f"""{_TOKENS}, c AS (SELECT token, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM t WHERE lang IN ('en', 'fr') GROUP BY token),
    p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
    SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_divergence FROM p""")
def token_divergence(spark, sf):
    return _rounded(metrics.divergence(metrics.token_counts(_lines(spark, sf), "lang"), "lang", "en", "fr"), "js_divergence")


@_query(f"""{_WITH}, w AS (SELECT lang, {_toks('line')} AS w FROM lines WHERE lang IN ('en', 'fr')), p AS (SELECT DISTINCT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w WHERE len(w) > 1),
    s AS (SELECT pair, count(*) AS k FROM p GROUP BY pair) SELECT round(count(*) FILTER (WHERE k = 2) / count(*), 6) AS jaccard, count(*) AS bigrams FROM s""")
def bigram_similarity(spark, sf):
    return _rounded(metrics.bigram_jaccard(_lines(spark, sf), "lang", "en", "fr"), "jaccard")


@_query(f"""{_WITH}, t AS (SELECT doc_id, line_no, unnest({_toks('line')}) AS token, unnest(range(len({_toks('line')}))) AS place FROM lines)
    SELECT token, row_number() OVER (ORDER BY min(struct_pack(doc_id, line_no, place))) - 1 AS id, count(*) AS n FROM t GROUP BY token""")
def token_dictionary(spark, sf):
    return metrics.dictionary(_lines(spark, sf))


# -- cleaning and routing ---------------------------------------------------------------------------------------


@_query(f"{_WITH} SELECT doc_id, line_no, {_words('line')} AS words FROM lines")
def extract_words(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", T.joined(T.extract_words("line")).alias("words"))


#: A letter of the Tamil script for each of a few Latin ones: the tables hold no Tamil.
_FROM, _TO = "aeioukctpnmrly", "அஎஇஒஉகசதபநமரலய"
_TA = "[\\x{0B80}-\\x{0BFF}]"


def _tamil(c: str | Column) -> Column:
    return F.replace(F.replace(F.translate(c, _FROM, _TO), F.lit("s"), F.lit("்")), F.lit("d"), F.lit("கள்"))


#: The same for str.translate().
_TO_TAMIL = str.maketrans(dict(zip(_FROM, _TO, strict=True)) | {"s": "்", "d": "கள்"})


_TAMIL = f"replace(replace(translate(line, '{_FROM}', '{_TO}'), 's', '்'), 'd', 'கள்')"
_WITH_TAMIL = f"{_WITH}, tamil AS (SELECT doc_id, source, line_no, {_TAMIL} AS line FROM lines)"


@_query(rf"""{_WITH_TAMIL} SELECT doc_id, line_no, array_to_string(regexp_extract_all(regexp_replace(line, '[A-Za-z]+', ' ', 'g'), '{_TA}+(?:\.{_TA}+)*|[0-9]+(?:\.[0-9]+)?|[,!?\"\-%'']'), ' ') AS words,
    CASE WHEN len({_toks('line')}) = 0 THEN 0.0 ELSE round(len(list_filter({_toks('line')}, lambda x: regexp_matches(x, '{_TA}'))) / len({_toks('line')}), 6) END AS ratio FROM tamil""")
def tamil_words(spark, sf):
    found = _lines(spark, sf).select("doc_id", "line_no", T.words_and_ratio("line", TAMIL, _TO_TAMIL).alias("found"))
    return _rounded(found.select("doc_id", "line_no", "found.words", "found.ratio"), "ratio")


_RATIO = f"CASE WHEN len({_toks('line')}) = 0 THEN 0.0 ELSE len(list_filter({_toks('line')}, lambda x: regexp_matches(x, '[{_LATIN}]'))) / len({_toks('line')}) END"


@_query(f"{_WITH} SELECT doc_id, line_no, round({_RATIO}, 6) AS ratio, CASE WHEN {_RATIO} < 0.3 THEN 'below' ELSE 'above' END AS verdict FROM lines")
def content_ratios(spark, sf):
    return _rounded(corpus.route_ratio(_lines(spark, sf)).select("doc_id", "line_no", "ratio", "verdict"), "ratio")


@_query(f"""{_WITH}, r AS (SELECT source, {_RATIO} AS ratio FROM lines) SELECT source, count(*) FILTER (WHERE ratio >= 0.3) AS above, count(*) FILTER (WHERE ratio < 0.3) AS below, count(*) AS total,
    round(count(*) FILTER (WHERE ratio >= 0.3) / count(*), 6) AS pass_ratio, round(avg(ratio), 6) AS mean_ratio FROM r GROUP BY source""")
def content_ratio_verdicts(spark, sf):
    return _rounded(corpus.ratio_report(corpus.route_ratio(_lines(spark, sf))), "pass_ratio", "mean_ratio")


@_query(f"{_WITH} SELECT source, CASE WHEN len({_toks('line')}) > 2500 THEN 'long' ELSE 'main' END AS verdict, count(*) AS n FROM lines GROUP BY ALL")
def long_line_router(spark, sf):
    return corpus.route_long(_lines(spark, sf)).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


_STRIP_WEB = r"regexp_replace(regexp_replace({}, 'https?://\S+', '', 'g'), '&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);', '', 'g')"


@_query(f"SELECT page_id, {_words(_STRIP_WEB.format('html'))} AS text FROM pages")
def web_cleanup(spark, sf):
    return _table(spark, sf, "pages").select("page_id", T.clean_web("html").alias("text"))


#: The lines with addresses put in that touch words, marks and each other.
_ADDRESSED = "replace(replace(line, ' a', ' a@b.co.uk;a'), ' e', ' (e@x.com,e) https://x.y/e e_1%+-@x-1.org.e @x.org e@x.1 ')"


@_query(rf"""{_WITH} SELECT doc_id, line_no, {_words("regexp_replace(regexp_replace(regexp_replace(" + _ADDRESSED + r", 'https?://\S+', '', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g'), '&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);', '', 'g')")} AS words FROM lines""")
def literary_cleanup(spark, sf):
    line = F.replace(F.replace("line", F.lit(" a"), F.lit(" a@b.co.uk;a")), F.lit(" e"), F.lit(" (e@x.com,e) https://x.y/e e_1%+-@x-1.org.e @x.org e@x.1 "))
    return _lines(spark, sf).select("doc_id", "line_no", T.joined(T.literary_words(line)).alias("words"))


def _wiki_sql(c: str) -> str:
    # the fixed values, written down apart from the engine's
    steps = [*[(r"\{\{[^{}]*\}\}", "")] * 3, (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"<ref[^>]*/>", ""), (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", ""), (r"\[\[([^\]|]*\|)?([^\]]*)\]\]", r"\2")]
    steps += [(r"\[https?://\S+\s+([^\]]*)\]", r"\1"), (r"\[https?://\S+\]", ""), ("''''''|''''", ""), (r"(?m)^[=]+\s*|\s*[=]+$", "")]
    for pattern, new in steps:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


#: What is put into the documents, in this order: headings, links of all kinds, templates, references, emphasis.
_MARKUP = (
    (". ", ".\n== "),
    (" a", " [[b|a]] [[a|]] [[]] [[|a]] [[a]]a"),
    (" i", " [http://i]i [i] [https://i.x i i] [http://i.x ] [https://i]"),
    (" e", ' {{{{x}}e}} <ref name="q">r</ref><ref name=\'q\'/> '),
    (" o", " ==\n\n==\no '''o'' <!-- o\no -->"),
)


def _put_in(c: str) -> str:
    for old, new in _MARKUP:
        new = new.replace("'", "''").replace("\n", "' || chr(10) || '")
        c = f"replace({c}, '{old}', '{new}')"
    return c


@_query(f"SELECT doc_id, {_wiki_sql(_put_in('text'))} AS text FROM documents")
def wiki_cleanup(spark, sf):
    """The documents with markup put in."""
    text = F.col("text")
    for old, new in _MARKUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _table(spark, sf, "documents").select("doc_id", T.clean_wiki(text).alias("text"))


@_query(r"""WITH c AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}') AS c FROM documents)
    SELECT doc_id, unnest(range(len(c))) AS chunk_no, unnest(c) AS chunk FROM c""")
def chunk_split(spark, sf):
    return _long(_table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks("text")).alias("chunk_no", "chunk")), "chunk_no")


@_query(rf"{_WITH} SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '([,!?\x22\-%''.])', '\1\1', 'g'), ',+', ',', 'g'), '\.+', '.', 'g'), '''+', '''', 'g'), '-+', '-', 'g') AS line FROM lines")
def punct_run_collapse(spark, sf):
    doubled = F.regexp_replace("line", r"([,!?\"\-%'.])", "$1$1")
    return _lines(spark, sf).select("doc_id", "line_no", T.collapse_punctuation(doubled).alias("line"))


@_query(rf"{_WITH} SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '([,!?\x22\-%''.])', ' \1', 'g'), '\s+([,!?\x22\-%''.])', '\1', 'g') AS line FROM lines")
def punct_spacing(spark, sf):
    apart = F.regexp_replace("line", r"([,!?\"\-%'.])", " $1")
    return _lines(spark, sf).select("doc_id", "line_no", T.tighten_punctuation(apart).alias("line"))


_VOWELS = "aeiou"
_MARKED = rf"regexp_replace(line, '([{_VOWELS}])', '\1' || {_ACUTE}, 'g')"


def _accented() -> Column:
    return F.regexp_replace("line", f"([{_VOWELS}])", "$1́")


@_query(f"{_WITH} SELECT doc_id, line_no, nfc_normalize({_MARKED}) AS line FROM lines")
def nfc_lines(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", T.nfc(_accented()).alias("line"))


# -- pages ------------------------------------------------------------------------------------------------------


_ANCHORS = r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS a FROM pages), t AS (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS tag FROM a),
    l AS (SELECT page_id, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(tag, '(?s)>(.*)</a>', 1), '<[^>]+>', '', 'g')) AS anchor FROM t)"""


@_query(f"{_ANCHORS} SELECT anchor, arg_max('https://host.test' || href, struct_pack(page_id, pos)) AS url FROM l WHERE starts_with(href, '/') GROUP BY anchor")
def page_links(spark, sf):
    return readers.page_links(_table(spark, sf, "pages"), "/", root="https://host.test")


# -- merge, dedup, split, sample --------------------------------------------------------------------------------

_FIRST = f"{_WITH}, n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY source, doc_id, line_no) AS k, count(*) OVER (PARTITION BY line) AS copies FROM lines)"


@_query(f"{_FIRST} SELECT source, doc_id, line_no, line, copies FROM n WHERE k = 1")
def dedup_kept(spark, sf):
    return corpus.first_of_equals(_lines(spark, sf)).where("kept").select("source", "doc_id", "line_no", "line", "copies")


@_query(f"{_FIRST} SELECT source, doc_id, line_no, sha256(line) AS line_sha256 FROM n WHERE k > 1")
def dedup_dropped(spark, sf):
    return corpus.first_of_equals(_lines(spark, sf)).where(~F.col("kept")).select("source", "doc_id", "line_no", T.digest("line").alias("line_sha256"))


@_query(f"{_FIRST} SELECT count(*) AS total, count(*) FILTER (WHERE k = 1) AS unique_lines, count(*) FILTER (WHERE k > 1) AS dropped FROM n")
def dedup_counts(spark, sf):
    return corpus.dedup_report(corpus.first_of_equals(_lines(spark, sf)))


_TURNS = "SELECT 'conversations' AS source, conv_id AS doc_id, turn AS line_no, text AS line FROM conversations"
_MERGED = f"{_WITH}, m AS (SELECT source, doc_id, line_no, line FROM lines UNION ALL {_TURNS})"


@_query(f"{_MERGED} SELECT source, count(*) FILTER (WHERE regexp_matches(line, '[{_LATIN}]')) AS written, count(*) FILTER (WHERE NOT regexp_matches(line, '[{_LATIN}]')) AS skipped FROM m GROUP BY source")
def merge_counts(spark, sf):
    turns = _table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    merged = corpus.merge([_lines(spark, sf).select("source", "doc_id", "line_no", "line"), turns])
    return merged.groupBy("source").agg(F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("skipped"))


_KEY = "md5('42|' || source || '|' || doc_id || '|' || line_no)"
_SPLIT = f"{_FIRST}, u AS (SELECT source, doc_id, line_no, line FROM n WHERE k = 1), s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_KEY}) <= floor(0.1 * (SELECT count(*) FROM u)) THEN 'test' ELSE 'train' END AS split FROM u)"


def _split(spark, sf) -> DataFrame:
    kept = corpus.first_of_equals(_lines(spark, sf)).where("kept").select("source", "doc_id", "line_no", "line")
    return corpus.exact_split(kept)


@_query(f"{_SPLIT} SELECT source, doc_id, line_no, split FROM s")
def split_rows(spark, sf):
    return _split(spark, sf).select("source", "doc_id", "line_no", "split")


@_query(f"{_SPLIT} SELECT split, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY split")
def split_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@_query(f"""{_WITH}, r AS (SELECT source, doc_id, line_no, line FROM lines WHERE NOT ({_RATIO} < 0.3) AND regexp_matches(line, '[{_LATIN}]')), n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY source, doc_id, line_no) AS k FROM r),
    u AS (SELECT * FROM n WHERE k = 1), s AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY {_KEY}) <= floor(0.1 * (SELECT count(*) FROM u)) THEN 'test' ELSE 'train' END AS split FROM u)
    SELECT source, split, count(*) AS n FROM s GROUP BY ALL""")
def corpus_build(spark, sf):
    """All of it: routed, merged, deduplicated, split."""
    built = corpora.build(_lines(spark, sf).select("source", "doc_id", "line_no", "line"))
    return built.split.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_WITH} SELECT source, doc_id, line_no, line FROM lines ORDER BY {_KEY}, source, doc_id, line_no LIMIT 100")
def sample_lines(spark, sf):
    return corpus.sample(_lines(spark, sf), 100).select("source", "doc_id", "line_no", "line")


@_query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3")
def sample_per_source(spark, sf):
    return corpus.sample_each(_table(spark, sf, "documents"), "source", 3).select("doc_id", "source")


@_query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 68 = 0")
def systematic_sample(spark, sf):
    """By the rank of the row, whatever the numbers are."""
    return corpus.every_nth(_table(spark, sf, "documents"), 68).select("doc_id", "source")


# -- marking ----------------------------------------------------------------------------------------------------


# The rules as pairs of patterns, left and right of a cut, written down apart from the engine's table.
_SQL_V, _SQL_C = "[அஆஇஈஉஊஎஏஐஒஓஔ]", "கஙசஞடணதநபமயரலவழளறன"
_SQL_CORE = [
    ("அ", "அ|ஆ"),
    ("அ", "இ|ஈ"),
    ("அ", "உ|ஊ"),
    ("அ", "எ|ஏ|ஒ|ஓ|ஐ|ஔ"),
    ("இ|ஈ", _SQL_V),
    ("உ|ஊ", _SQL_V),
    ("எ|ஏ|ஒ|ஓ|ஐ|ஔ", _SQL_V),
    ("ி|ீ|ை", _SQL_V),
    ("ு|ூ", _SQL_V),
    ("ா|ெ|ே|ொ|ோ|ௌ", _SQL_V),
    ("இ|ஈ|ஐ", _SQL_V),
    ("ஏ", _SQL_V),
    (f"[{_SQL_C}]்", _SQL_V),
    ("வடக்கு|தெற்கு|குடக்கு|குணக்கு|கிழக்கு|மேற்கு", r"\S"),
    ("கண்|பண்|மண்|தண்|எண்|வண்", _SQL_V),
    (_SQL_V, "ஐ"),
    (_SQL_V, "(?:உ|க்)கு"),
    (_SQL_V, "ஆல்|னால்"),
    (_SQL_V, "இல்|அல்"),
    (_SQL_V, "இடம்|உடன்|முன்|பின்|ஓடு|ஓடே"),
    (_SQL_V, "கள்"),
    (f"[{_SQL_C}]்", "கள்"),
    (_SQL_V, "வர்கள்|வர்"),
    ("ி|உ|அ", "போ|வா|இரு|உள்|கொள்|விடு|ஆகு"),
    ("த்து|ட்டு", "கொள்|விடு|போ|ஆகு"),
    ("ஆன|என்|உம்", r"\S"),
    ("[௦-௯0-9]+", "ஆம்(?: நாள்| ஆண்டு)?"),
    ("[௦-௯0-9]+", "ஐ"),
    ("அந்த|இந்த|அத்துணை|இத்துணை|எத்துணை|அவ்வகை|இவ்வகை|எவ்வகை|மற்று|மற்றை|மற்ற|அரை|பாதி", r"\S"),
]
_SQL_AGGRESSIVE = [
    ("[ாிீுூெேைொோௌ]", "ய|வ"),
    ("ங்", "க"),
    ("ஞ்", "ச"),
    ("ண்", "ட"),
    ("ந்", "த"),
    ("ம்", "ப"),
    ("ன்", "ற"),
    ("ங்|ஞ்|ண்|ந்|ம்|ன்", "க|ச|ட|த|ப|ற"),
    ("ல்", "ச"),
    ("ர்|ற்", "ர"),
    ("ன்|ண்", "ட|த"),
]


def _cuts_sql(c: str, rules: list[tuple[str, str]] = _SQL_CORE, doubled: bool = False) -> str:
    sets = []
    for left, right in rules:
        parts = rf"string_split(regexp_replace({c}, '({left})({right})', '\1' || chr(1) || '\2', 'g'), chr(1))"
        sets.append(f"(SELECT list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT)) FROM (SELECT {parts} AS p))")
    if doubled:  # any consonant, the sign, and the same again; after one such pair the search goes on behind it
        alike = "|".join(f"{x}்{x}" for x in _SQL_C)
        parts = rf"string_split(regexp_replace({c}, '({alike})', chr(1) || '\1', 'g'), chr(1))"
        sets.append(f"(SELECT list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + 2 AS BIGINT)) FROM (SELECT {parts} AS p))")
    return f"list_sort(list_distinct(flatten([{', '.join(sets)}])))"


@_query(f"{_WITH_TAMIL} SELECT doc_id, line_no, array_to_string({_cuts_sql('line')}, ',') AS cuts FROM tamil")
def boundary_cuts(spark, sf):
    """Of the lines written in Tamil letters."""
    lines = _lines(spark, sf).select("doc_id", "line_no", _tamil("line").alias("line"))
    return lines.select("doc_id", "line_no", F.array_join(marking.boundaries("line").cast("array<string>"), ",").alias("cuts"))


_DOUBLES = "".join(f"{x}்{x} " for x in _SQL_C)


@_query(f"""{_WITH_TAMIL}, d AS (SELECT doc_id, line_no, line || ' {_DOUBLES}' AS line FROM tamil) SELECT doc_id, line_no, array_to_string({_cuts_sql('line', _SQL_CORE + _SQL_AGGRESSIVE, True)}, ',') AS cuts FROM d""")
def all_boundary_cuts(spark, sf):
    """By both tiers of rules, of the lines written in Tamil letters with each doubled consonant at the end."""
    line = F.concat(_tamil("line"), F.lit(f" {_DOUBLES}"))
    lines = _lines(spark, sf).select("doc_id", "line_no", line.alias("line"))
    return lines.select("doc_id", "line_no", F.array_join(marking.boundaries("line", marking.CORE + marking.AGGRESSIVE).cast("array<string>"), ",").alias("cuts"))


@_query(f"""{_WITH_TAMIL}, c AS (SELECT doc_id, line_no, line, list_filter({_cuts_sql('line')}, lambda x: x > 0 AND x < length(line)) AS cuts FROM tamil)
    SELECT doc_id, line_no, array_to_string(list_transform(range(0, len(cuts) + 1), lambda i: substring(line, CAST(coalesce(list_extract(cuts, i), 0) AS BIGINT) + 1, coalesce(list_extract(cuts, i + 1), length(line)) - coalesce(list_extract(cuts, i), 0))), '⟂') AS marked, true AS restores FROM c""")
def boundary_marks(spark, sf):
    lines = _lines(spark, sf).select("doc_id", "line_no", _tamil("line").alias("line")).withColumn("marked", marking.mark("line"))
    return lines.select("doc_id", "line_no", "marked", (marking.unmark("marked") == F.col("line")).alias("restores"))


@_query(f"{_WITH}, c AS (SELECT unnest(regexp_extract_all({_MARKED}, '[{_VOWELS}]\\x{{0301}}')) AS cluster FROM lines) SELECT cluster, count(*) AS n FROM c GROUP BY cluster")
def grapheme_counts(spark, sf):
    """Of the lines with their vowels marked."""
    found = _lines(spark, sf).select(F.explode(T.graphemes(_accented())).alias("cluster")).where(F.length("cluster") > 1)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""{_WITH} SELECT doc_id, line_no, replace(replace(replace(replace(replace(line, 'a', chr(57344)), 'e', chr(57345)), 'i', chr(57346)), 'o', chr(57347)), 'u', chr(57348)) AS shown, true AS restores FROM lines""")
def grapheme_placeholders(spark, sf):
    lines = _lines(spark, sf).select("doc_id", "line_no", _accented().alias("line"))
    table = marking.placeholder_map(lines)
    lines = lines.withColumn("shown", marking.substitute("line", table))
    return lines.select("doc_id", "line_no", "shown", (marking.restore("shown", table) == F.col("line")).alias("restores"))


# -- tokenizers -------------------------------------------------------------------------------------------------

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(line, '^\s+|\s+$', '', 'g')), ',+', ',', 'g'), '\.+', '.', 'g'), '''+', '''', 'g'), '-+', '-', 'g')"
_PIECES = f"{_WITH}, w AS (SELECT '▁' || unnest(string_split({_NORMAL}, ' ')) AS word FROM lines WHERE {_NORMAL} <> ''), words AS (SELECT word, count(*) AS n FROM w GROUP BY word)"


@_query(f"{_PIECES} SELECT word, n FROM words")
def word_table(spark, sf):
    return tokenizers.word_counts(_lines(spark, sf))


@_query(f"""{_PIECES}, p AS (SELECT unnest(list_transform(range(1, length(word)), lambda i: word[i])) AS "left", unnest(list_transform(range(1, length(word)), lambda i: word[i + 1])) AS "right", n FROM words WHERE length(word) > 1)
    SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""")
def pair_frequencies(spark, sf):
    return tokenizers.pair_counts(tokenizers.word_counts(_lines(spark, sf)))


@_query(f"""{_PIECES}, s AS (SELECT unnest(flatten(list_transform(range(1, length(word) + 1), lambda i: list_transform(range(1, least(4, length(word) - i + 1) + 1), lambda k: substring(word, i, k))))) AS piece, n FROM words),
    c AS (SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY piece) SELECT piece, n FROM c WHERE n > 1 OR length(piece) = 1 ORDER BY length(piece) = 1 DESC, n * length(piece) DESC, piece LIMIT 1000""")
def seed_pieces(spark, sf):
    return tokenizers.seed_pieces(tokenizers.word_counts(_lines(spark, sf)), 1000, 4)


def _variant(family: str):
    def run(spark, sf):
        split = _split(spark, sf)
        _, report = corpora.variant_report(split.where("split = 'train'"), split.where("split = 'test'"), f"01_metaspace_codepoint_{family}", 1000, unused=10, **({"seed_size": 4000, "shrink": 0.5} if family == "unigram" else {}))
        rows = [(report["variant"], report["words"], report["tokens"], report["unknown"], report["fertility"], report["oov_rate"])]
        return tokenizers.leaderboard(spark.createDataFrame(rows, "variant string, words long, tokens long, unknown long, fertility double, oov_rate double"))

    run.__doc__ = f"Learnt on nine tenths of the distinct lines and measured on the rest, {family}."
    return run


for _family in tokenizers.FAMILIES:
    _QUERIES[f"tokenizer_{_family}"] = _variant(_family)


def _toy(spark, sf, family: str = "bert") -> tokenizers.Model:
    return tokenizers.train(family, tokenizers.word_counts(_table(spark, sf, "benchmark"), "text"), 600, unused=5)


@_query()
def masked_rows(spark, sf):
    """Token arrays of the benchmark's texts, cut, masked and padded; the choice is a hash, the model is learnt."""
    model = _toy(spark, sf)
    rows = modeldata.model_rows(tokenizers.encode(_table(spark, sf, "benchmark"), model, "text"), model, 128)
    rows = modeldata.padded(rows.withColumn("batch", F.floor(F.col("item_id") / 16)), model)
    return modeldata.masked(rows, model, key="item_id").select("item_id", "input_ids", "attention_mask", "labels")


# -- pairs, labels, logs ----------------------------------------------------------------------------------------

_PAIRS = "SELECT conv_id, turn, text AS sentence1, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS sentence2 FROM conversations"


def _pairs(spark, sf) -> DataFrame:
    return modeldata.turn_pairs(_table(spark, sf, "conversations"))


@_query(f"SELECT * FROM ({_PAIRS}) WHERE sentence2 IS NOT NULL")
def turn_pairs(spark, sf):
    return _pairs(spark, sf)


def _extremes(what: str, x: str) -> str:
    return f"round(avg({x}), 6) AS mean_{what}, min({x}) AS min_{what}, max({x}) AS max_{what}"


@_query(f"SELECT {_extremes('first', 'length(sentence1)')}, {_extremes('second', 'length(sentence2)')}, {_extremes('difference', 'length(sentence1) - length(sentence2)')} FROM ({_PAIRS}) WHERE sentence2 IS NOT NULL")
def pair_char_lengths(spark, sf):
    out = modeldata.char_lengths(_pairs(spark, sf))
    return _long(_rounded(out, *[c for c in out.columns if c.startswith("mean")]), *[c for c in out.columns if not c.startswith("mean")])


_PAIR_TOKENS = f"{_toks('sentence1')}, {_toks('sentence2')}"


@_query(f"""WITH p AS (SELECT least(len({_toks('sentence1')}) + len({_toks('sentence2')}) + 3, 128) AS n FROM ({_PAIRS}) WHERE sentence2 IS NOT NULL)
    SELECT round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.99), 6) AS p99, count(*) FILTER (WHERE n >= 128) AS truncated, round(count(*) FILTER (WHERE n >= 128) / count(*), 6) AS truncated_share FROM p""")
def pair_token_lengths(spark, sf):
    a, b = modeldata.longest_first(T.tokens("sentence1"), T.tokens("sentence2"), 125)
    rows = _pairs(spark, sf).select((F.size(a) + F.size(b) + 3).alias("num_tokens"))
    return _rounded(modeldata.length_stats(rows), "median", "p99", "truncated_share")


@_query(f"""WITH p AS (SELECT * FROM ({_PAIRS}) WHERE sentence2 IS NOT NULL) SELECT p.* FROM p ANTI JOIN (SELECT DISTINCT sentence1, sentence2 FROM p WHERE turn = 0) h USING (sentence1, sentence2)""")
def pairs_not_held_out(spark, sf):
    """Without the pairs that open a conversation, wherever they occur."""
    pairs = _pairs(spark, sf)
    held = pairs.where("turn = 0").select(F.col("sentence1").alias("a"), F.col("sentence2").alias("b")).distinct().toDF("sentence1", "sentence2")
    return modeldata.without_pairs(pairs, held)


def _bare(role: str) -> str:
    return rf"SELECT DISTINCT token FROM (SELECT trim(unnest({_toks('text')}), '.,:()[]') AS token FROM conversations WHERE role = '{role}') WHERE token <> ''"


@_query(f"""WITH a AS ({_bare('user')}), b AS ({_bare('assistant')}) SELECT (SELECT count(*) FROM a) AS first_types, (SELECT count(*) FROM b) AS second_types, (SELECT count(*) FROM a JOIN b USING (token)) AS shared,
    round((SELECT count(*) FROM a JOIN b USING (token)) / (SELECT count(*) FROM b), 6) AS share""")
def bare_word_overlap(spark, sf):
    turns = _table(spark, sf, "conversations")
    sides = [modeldata.bare_words(turns.where(F.col("role") == r), "text") for r in ("user", "assistant")]
    return _rounded(metrics.vocabulary_overlap(*sides), "share")


@_query("SELECT quality, CASE quality WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' END AS label_name, count(*) AS n FROM labels GROUP BY ALL")
def label_distribution(spark, sf):
    return modeldata.named(modeldata.label_counts(_table(spark, sf, "labels"), "quality"), "quality").select("quality", "label_name", "n")


def _f1(k: int) -> str:
    return f"coalesce(2.0 * count(*) FILTER (WHERE quality = {k} AND toxic = {k}) / nullif(count(*) FILTER (WHERE quality = {k}) + count(*) FILTER (WHERE toxic = {k}), 0), 0.0)"


@_query(f"""SELECT round(count(*) FILTER (WHERE quality = toxic) / count(*), 6) AS accuracy, {', '.join(f'round({_f1(k)}, 6) AS f1_{k}' for k in range(3))}, round(({' + '.join(map(_f1, range(3)))}) / 3, 6) AS macro_f1 FROM labels""")
def classification_metrics(spark, sf):
    return _rounded(modeldata.classification_metrics(_table(spark, sf, "labels"), "quality", "toxic"), "accuracy", "f1_0", "f1_1", "f1_2", "macro_f1")


@_query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS place FROM embeddings")
def logit_argmax(spark, sf):
    return _table(spark, sf, "embeddings").select("vec_id", modeldata.argmax("embedding").alias("place"))


@_query("SELECT count(*) AS vectors, count(*) FILTER (WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS unsound FROM embeddings")
def vector_soundness(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    unsound = modeldata.unsound_vectors(vectors).agg(F.count(F.lit(1)).alias("unsound"))
    return vectors.agg(F.count(F.lit(1)).alias("vectors")).join(F.broadcast(unsound))  # a row each


_HISTORY = "SELECT event_id AS step, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value END AS eval_loss FROM events"


def _history(spark, sf) -> DataFrame:
    events = _table(spark, sf, "events")
    kind = events.agg(F.min("event_type").alias("kind"))
    return events.join(F.broadcast(kind)).select(F.col("event_id").alias("step"), F.when(F.col("event_type") == F.col("kind"), F.col("value")).alias("eval_loss"))  # one row is broadcast


@_query(f"SELECT min(eval_loss) AS best_loss, arg_min(step, struct_pack(eval_loss, step)) AS best_step FROM ({_HISTORY}) WHERE eval_loss IS NOT NULL")
def best_evaluation(spark, sf):
    return modeldata.best_evaluation(_history(spark, sf))


@_query(f"SELECT step, eval_loss, round(exp(eval_loss / 100), 6) AS perplexity FROM ({_HISTORY}) WHERE eval_loss IS NOT NULL ORDER BY step DESC LIMIT 8")
def last_evaluations(spark, sf):
    return _rounded(modeldata.last_evaluations(_history(spark, sf)).withColumn("perplexity", modeldata.perplexity(F.col("eval_loss") / 100)), "perplexity")


@_query("""WITH b AS (SELECT event_id, user_id, value, row_number() OVER w AS r, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, r - max(CASE WHEN before IS NULL OR value < before THEN r END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since_best FROM b)
    SELECT event_id, user_id, best, since_best, max(CASE WHEN since_best >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM s""")
def running_best(spark, sf):
    return modeldata.running_best(_table(spark, sf, "events").select("event_id", "user_id", "value"), "value", "event_id", "user_id").select("event_id", "user_id", "best", "since_best", "stopped")
