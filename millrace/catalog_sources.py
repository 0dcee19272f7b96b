"""Queries over sources and sinks: what is written in a form is read again in it, and compared with the table it came from."""

from __future__ import annotations

import io
import json
import lzma
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _ACUTE, _LATIN, _MARKED, _PAIRS, _VOWELS, _WITH, _accented, _hygiene_sql, _lines, _long, _query, _RATES, _rounded, _split, _SPLIT, _table, _toks, _wiki_sql, _words
from .functions import marking, text as T
from .operators import corpus, metrics, modeldata
from .plans import corpora
from .sources import names, readers, writers
from .tables import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources ----------------------------------------------------------------------------------------------------


_DUMP = f"SELECT doc_id, {_wiki_sql('text')} AS text FROM documents WHERE doc_id % 3 = 0"
_CHUNKS = r"string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}')"


@_query(rf"""WITH d AS ({_DUMP}), c AS (SELECT {_words('chunk')} AS line FROM (SELECT unnest({_CHUNKS}) AS chunk FROM d)), l AS (SELECT line FROM c WHERE line <> '')
    SELECT CASE WHEN len({_toks('line')}) > 2500 THEN 'long' ELSE 'main' END AS verdict, line, count(*) AS n FROM l GROUP BY ALL""")
def dump_lines(spark, sf):
    """The documents as pages of a compressed XML dump, of which one namespace in three is kept, to routed lines."""
    text = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    page = F.concat(F.lit("<page><title>t</title><ns>"), (F.col("doc_id") % 3).cast("string"), F.lit('</ns><revision><text bytes="1" xml:space="preserve">'), F.coalesce(text, F.lit("")), F.lit("</text></revision></page>"))

    def framed(batches):
        yield pa.RecordBatch.from_pydict({"line": ["<mediawiki>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"line": ["</mediawiki>"]})

    path = _folder(spark, "dump")
    pages = _table(spark, sf, "documents").select(page.alias("line")).mapInArrow(framed, "line string")
    pages.write.option("compression", "bzip2").text(path)
    return corpora.wiki_lines(readers.wiki_pages(spark, path)).groupBy("verdict", "line").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT 'r' || n_regionkey || '.txt.xz' AS source, trim(n_name) AS line, count(*) AS n FROM nation GROUP BY ALL")
def xz_lines(spark, sf):
    """The nations of each region as a compressed file."""
    path = _folder(spark, "xz")
    for r in _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).collect():  # 25 rows
        writers.put(spark, f"{path}/r{r['n_regionkey']}.txt.xz", lzma.compress("".join(f" {n} \r\n" for n in r["names"]).encode()))
    return readers.xz_lines(spark, f"{path}/*.xz").groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT 'r' || n_regionkey || '.txt' AS member, n_name AS line FROM nation WHERE n_regionkey < 3")
def zip_members(spark, sf):
    """Three of the five members of an archive."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as archive:
        for r in _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).collect():  # 25 rows
            archive.writestr(f"r{r['n_regionkey']}.txt", "\n".join(r["names"]))
    path = f"{_folder(spark, 'zip')}/a.zip"
    writers.put(spark, path, body.getvalue())
    return readers.zip_members(spark, path, ("r0.txt", "r1.txt", "r2.txt")).select("member", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))


@_query(f"{_WITH} SELECT line, count(*) AS n FROM lines GROUP BY line")
def text_files(spark, sf):
    """All lines written as text and read again."""
    path = _folder(spark, "lines")
    writers.lines(_lines(spark, sf), path)
    return readers.text_lines(spark, path, "\n").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_name AS sentence1, 'it is ' || n_name AS sentence2, CAST(n_nationkey % 3 AS INT) AS gold_label, CASE n_nationkey % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label_name FROM nation")
def pair_file(spark, sf):
    """A split of labelled pairs from its JSON file, under another name than it is asked by."""
    path = f"{_folder(spark, 'pairs')}/dev.json"
    rows = _table(spark, sf, "nation").collect()  # 25 rows
    writers.put(spark, path, json.dumps({"validation": [{"premise": r["n_name"], "hypothesis": "it is " + r["n_name"], "label": r["n_nationkey"] % 3} for r in rows]}, indent=1).encode())
    return modeldata.named(readers.pair_rows(spark, path, "validation"))


@_query("""SELECT row_number() OVER (ORDER BY fertility) - 1 AS place, variant, fertility, vocab_size FROM
    (SELECT 'v_' || r_regionkey AS variant, 1.5 - r_regionkey / CAST(10 AS DOUBLE) AS fertility, CAST(r_regionkey * 100 AS INT) AS vocab_size FROM region WHERE r_regionkey <> 2)""")
def leaderboard_of_files(spark, sf):
    """The variants that have both of their files, by fertility."""
    from .operators import tokenizers

    root = _folder(spark, "variants")
    for r in _table(spark, sf, "region").collect():  # 5 rows
        key = r["r_regionkey"]
        writers.put(spark, f"{root}/v_{key}/metrics.json", json.dumps({"fertility": 1.5 - key / 10, "oov_rate": 0.5, "vocab_size": key * 100}, indent=1).encode())
        if key != 2:
            writers.put(spark, f"{root}/v_{key}/tokenizer.json", b"{}")
    board = tokenizers.leaderboard(readers.variant_metrics(spark, root).drop("oov_rate"))
    return corpus.numbered(board, ("fertility", "variant"), "place")


@_query(f"""{_WITH}, c AS (SELECT DISTINCT unnest(regexp_extract_all({_MARKED}, '[{_VOWELS}]\\x{{0301}}')) AS cluster FROM lines)
    SELECT cluster, chr(CAST(57344 + row_number() OVER (ORDER BY cluster) - 1 AS INT)) AS shown FROM c""")
def placeholder_file(spark, sf):
    """The placeholders of the lines with their vowels marked, saved and loaded."""
    lines, path = _lines(spark, sf).select(_accented().alias("line")), _folder(spark, "placeholders")
    writers.placeholders(marking.placeholder_map(lines), lines, path)
    return spark.range(1).select(F.explode(readers.placeholder_table(spark, path)).alias("cluster", "shown"))


_STATE = "SELECT n_nationkey * 10 AS step, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey * 7 % 11 + 3) / CAST(10 AS DOUBLE) END AS eval_loss FROM nation"


@_query(f"WITH s AS ({_STATE}) SELECT CAST(step AS BIGINT) AS step, eval_loss, abs(eval_loss - (SELECT min(eval_loss) FROM s)) < 1e-9 AS best, round(exp(eval_loss), 6) AS perplexity FROM s WHERE eval_loss IS NOT NULL")
def evaluation_history(spark, sf):
    """The evaluations of a trainer's state file, with the best of them flagged."""
    keys = [r["n_nationkey"] for r in _table(spark, sf, "nation").collect()]  # 25 rows
    loss = {k: (k * 7 % 11 + 3) / 10 for k in keys if k % 3 == 0}
    log = [{"step": k * 10, "epoch": k / 2, **({"eval_loss": loss[k]} if k in loss else {"loss": 1.0})} for k in keys]
    path = f"{_folder(spark, 'state')}/trainer_state.json"
    writers.put(spark, path, json.dumps({"global_step": 240, "epoch": 12.0, "best_metric": min(loss.values()), "best_model_checkpoint": "c", "log_history": log}).encode())
    return _rounded(modeldata.evaluations(readers.trainer_history(spark, path)), "perplexity").select("step", "eval_loss", "best", "perplexity")


_BODY = r"regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<(script|style|template)[^>]*>.*?</(script|style|template)>|<!--.*?-->', '<x>', 'g')"
_TEXTS = rf"list_filter(string_split_regex(regexp_replace(replace(replace({_BODY}, '&quot;', chr(34)), '&#x27;', chr(39)), '&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);', ' ', 'g'), '<[^>]+>'), lambda x: x <> '')"
_NODES = rf"string_split(regexp_replace(array_to_string({_TEXTS}, chr(10)), '\n$', ''), chr(10))"
_PLAIN = r"regexp_replace(regexp_replace(raw, 'https?://\S+', '', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '', 'g')"


@_query(rf"""WITH n AS (SELECT page_id, {_NODES} AS nodes FROM pages), l AS (SELECT page_id, unnest(range(len(nodes))) AS line_no, unnest(nodes) AS raw FROM n), w AS (SELECT page_id, line_no, {_words(_PLAIN)} AS line FROM l)
    SELECT page_id, line_no, line FROM w WHERE regexp_matches(line, '[{_LATIN}]')""")
def page_lines(spark, sf):
    """The lines of the pages' bodies, by an HTML parser."""
    return _long(readers.page_lines(_table(spark, sf, "pages")), "line_no")


@_query(rf"WITH n AS (SELECT page_id, {_NODES} AS nodes FROM pages) SELECT page_id, len(nodes) AS lines FROM n WHERE len(nodes) > 0 AND nodes <> ['']")
def page_line_counts(spark, sf):
    """The same as a table function in SQL."""
    from .functions import tables

    tables.register(spark)
    _table(spark, sf, "pages").createOrReplaceTempView("millrace_pages")
    return spark.sql("SELECT page_id, count(*) AS lines FROM millrace_pages, LATERAL html_lines(html) GROUP BY page_id")


@_query("SELECT source, source || '_above_threshold.txt' AS above, source || '_below_threshold.txt' AS below, source || '_long.txt' AS long FROM (SELECT DISTINCT source FROM documents)")
def derived_names(spark, sf):
    found = _table(spark, sf, "documents").select("source").distinct().withColumn("file", F.concat(F.lit("data/"), "source", F.lit(".txt")))
    return found.select("source", *[F.regexp_replace(names.derived("file", tail), "^data/", "").alias(name) for name, tail in (("above", "_above_threshold"), ("below", "_below_threshold"), ("long", "_long"))])


@_query("SELECT n_name AS line, CAST(1 AS BIGINT) AS builds FROM nation")
def built_once(spark, sf):
    """A table that is asked for twice and made once."""
    path, builds = _folder(spark, "once"), []

    def make(at):
        builds.append(at)
        writers.lines(_table(spark, sf, "nation"), at, "n_name")

    for _ in range(2):
        readers.once(spark, path, make)
    return readers.text_lines(spark, path).select("line", F.lit(len(builds)).cast("long").alias("builds"))


# -- sinks ------------------------------------------------------------------------------------------------------


@_query(f"{_WITH} SELECT source, CASE WHEN len({_toks('line')}) > 20 THEN 'long' ELSE 'main' END AS verdict, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY ALL")
def routed_files(spark, sf):
    """Long lines beside the others, written by verdict and read again."""
    path = _folder(spark, "routed")
    writers.routed(corpus.route_long(_lines(spark, sf), 20), path)
    return spark.read.parquet(path).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line").cast("long")).alias("chars"))


@_query(f"{_SPLIT} SELECT source, doc_id, line_no, line, split FROM s")
def split_files(spark, sf):
    path = _folder(spark, "split")
    writers.split(_split(spark, sf), path)
    return spark.read.parquet(path).select("source", "doc_id", "line_no", "line", "split")


_DOWN = _SPLIT.replace("<= floor(0.1 * (SELECT count(*) FROM u))", "<= (SELECT count(*) FROM u) - CAST(floor(CAST(0.9 AS DOUBLE) * (SELECT count(*) FROM u)) AS BIGINT)")


@_query(f"{_DOWN} SELECT source, doc_id, line_no, split FROM s")
def split_train_down(spark, sf):
    """The split that rounds the train rows down."""
    kept = corpus.first_of_equals(_lines(spark, sf)).where("kept").select("source", "doc_id", "line_no", "line")
    return corpus.exact_split(kept, train_down=True).select("source", "doc_id", "line_no", "split")


@_query(f"{_WITH} {_hygiene_sql('source')} GROUP BY source")
def hygiene_csv(spark, sf):
    """The summary of each source, as a CSV file."""
    path, report = _folder(spark, "hygiene"), _rounded(metrics.hygiene(_lines(spark, sf)), *_RATES)
    writers.report(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path)


@_query(f"{_WITH} SELECT lang, len({_toks('line')}) AS sentence_length, count(*) AS line_count FROM lines GROUP BY ALL")
def histogram_json(spark, sf):
    """The lengths of lines, as JSON."""
    path, report = _folder(spark, "histogram"), metrics.length_histogram(_lines(spark, sf), "lang")
    writers.json_rows(report, path)
    return spark.read.schema(report.schema).json(path)


# -- what the other queries leave out ---------------------------------------------------------------------------


@_query(rf"{_WITH} SELECT doc_id, line_no, nfc_normalize({_MARKED}) <> {_MARKED} AS odd FROM lines")
def not_composed_lines(spark, sf):
    """An earlier definition of an anomaly, of the lines with their vowels marked."""
    return _lines(spark, sf).select("doc_id", "line_no", T.not_composed(_accented()).alias("odd"))


@_query(f"{_WITH} SELECT source, count(*) AS total_lines, CAST(0 AS BIGINT) AS total_chars, {', '.join(f'CAST({100 if c == "invalid_line_rate" else 0} AS DOUBLE) AS {c}' for c in _RATES)} FROM (SELECT source FROM (SELECT source, row_number() OVER (PARTITION BY source) AS k FROM lines) WHERE k = 1) GROUP BY source")
def hygiene_of_nothing(spark, sf):
    """One blank line of each source: rates without a denominator are 0."""
    blank = _lines(spark, sf).groupBy("source").agg(F.lit("").alias("line"))
    return metrics.hygiene(blank)


@_query(f"{_WITH}, spoken AS (SELECT * FROM lines WHERE line <> ''), h AS ({_hygiene_sql('source')} GROUP BY source) SELECT source, total_lines, total_chars, {', '.join(f'round({c} / 100, 6) AS {c}' for c in _RATES)} FROM h".replace("FROM lines GROUP", "FROM spoken GROUP").replace("6) AS contamination_rate,", "9) AS contamination_rate,", 1))
def hygiene_fractions(spark, sf):
    """Shares instead of percentages, of the lines that aren't blank."""
    return _rounded(metrics.hygiene(_lines(spark, sf).where("line <> ''"), percent=False), *_RATES)


@_query(f"""{_WITH}, s AS (SELECT source, doc_id, line_no, line, 'short' AS "check" FROM lines WHERE len({_toks('line')}) < 2), k AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || source || '|' || doc_id || '|' || line_no), source, doc_id, line_no) AS k FROM s)
    SELECT source, doc_id, line_no, "check", line FROM k WHERE k <= 20""")
def audit_examples(spark, sf):
    """At most twenty examples of the lines that are too short."""
    return corpus.audit(_lines(spark, sf), most=20).where(F.col("check") == "short").select("source", "doc_id", "line_no", "check", "line")


@_query(rf"""{_WITH} SELECT doc_id, line_no, array_to_string(regexp_extract_all(regexp_replace(replace(replace(line, 'a', 'அ'), 'e', 'ி'), '[A-Za-z]+', '', 'g'), '[\x{{0B80}}-\x{{0BFF}}]+(?:\.[\x{{0B80}}-\x{{0BFF}}]+)*|[0-9]+(?:\.[0-9]+)?|[,!?\x22\-%'']'), ' ') AS words FROM lines""")
def fused_words(spark, sf):
    """Words whose neighbours join where foreign letters stood between them."""
    from .profiles import TAMIL

    line = F.replace(F.replace("line", F.lit("a"), F.lit("அ")), F.lit("e"), F.lit("ி"))
    return _lines(spark, sf).select("doc_id", "line_no", T.joined(T.extract_words(line, TAMIL, fuse=True)).alias("words"))


@_query(f"""{_WITH}, c AS (SELECT unnest(regexp_extract_all({_MARKED}, '[{_VOWELS}]\\x{{0301}}')) AS cluster FROM lines WHERE lang = 'en'
    UNION ALL SELECT unnest(regexp_extract_all(regexp_replace(text, '([xyz])', '\\1' || {_ACUTE}, 'g'), '[xyz]\\x{{0301}}')) FROM conversations) SELECT DISTINCT cluster FROM c""")
def cluster_union(spark, sf):
    """The clusters of two corpora together."""
    one = _lines(spark, sf).where("lang = 'en'").select(_accented().alias("line"))
    two = _table(spark, sf, "conversations").select(F.regexp_replace("text", "([xyz])", "$1́").alias("line"))
    return marking.clusters(one.unionByName(two))


@_query("""SELECT 'documents' AS name, s, s * 6 AS total_steps, CAST(round_even(0.06 * s * 6, 0) AS BIGINT) AS warm_up_steps FROM (SELECT CAST(ceil(ceil(count(*) / 16.0) / 4.0) AS BIGINT) AS s FROM documents)
    UNION ALL SELECT 'pairs', s, s * 6, CAST(round_even(0.06 * s * 6, 0) AS BIGINT) FROM (SELECT CAST(ceil(ceil(count(*) / 16.0) / 4.0) AS BIGINT) AS s FROM (""" + _PAIRS + ") WHERE sentence2 IS NOT NULL)")
def training_schedule(spark, sf):
    rows = []
    for name, df in (("documents", _table(spark, sf, "documents")), ("pairs", modeldata.turn_pairs(_table(spark, sf, "conversations")))):
        s = modeldata.schedule(df.count())
        rows.append((name, s["steps_per_epoch"], s["total_steps"], s["warm_up_steps"]))
    return spark.createDataFrame(rows, "name string, s long, total_steps long, warm_up_steps long")
