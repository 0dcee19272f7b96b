"""Queries over tokenizers and token arrays whose models are few enough merges for SQL to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _NORMAL, _PAIRS, _PIECES, _TAMIL, _WITH, _WITH_TAMIL, _accented, _cuts_sql, _lines, _long, _MARKED, _query, _rounded, _table, _tamil, _toks
from .functions import marking, text as T
from .operators import modeldata, tokenizers
from .plans import corpora
from .tables import shared_dir, written

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,"
_MERGES = (("t", "h"), ("i", "n"), ("th", "e"), ("▁", "the"), ("e", "r"), ("a", "n"), ("an", "d"), ("▁", "and"), ("in", "g"), ("o", "n"), ("e", "s"), ("on", "s"))


def _bpe() -> tokenizers.Model:
    tokens = [*tokenizers.reserved(5), "▁", *_LETTERS, *(a + b for a, b in _MERGES)]
    return tokenizers.Model("bpe", {t: i for i, t in enumerate(tokens)}, _MERGES)


def _ids_sql(word: str) -> str:
    """The ids of a word: symbols between signs, joined merge by merge. The merges make each token in one way, so the order of ranks is enough."""
    out = f"regexp_replace({word}, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g')"
    for a, b in _MERGES:
        out = f"replace({out}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a + b}' || chr(2))"
    table = ", ".join(f"'{t}': {i}" for t, i in _bpe().vocab.items() if not t.startswith("["))
    return f"list_transform(list_filter(string_split(replace({out}, chr(1), ''), chr(2)), lambda x: x <> ''), lambda x: coalesce(map_extract(MAP {{{table}}}, x)[1], 0))"


def _line_ids(c: str) -> str:
    """The ids of a line's words, one after the other."""
    normal = _NORMAL.replace("line", c)
    return f"CASE WHEN {normal} = '' THEN [] ELSE flatten(list_transform(string_split({normal}, ' '), lambda w: {_ids_sql(chr(39) + '▁' + chr(39) + ' || w')})) END"


_ENCODED = f"{_WITH}, e AS (SELECT doc_id, line_no, line, {_line_ids('line')} AS ids FROM lines)"


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@_query(f"{_ENCODED} SELECT doc_id, line_no, array_to_string(ids, ',') AS ids FROM e")
def merge_encoding(spark, sf):
    """Byte-pair encoding of all lines by a model of twelve merges."""
    return tokenizers.encode(_lines(spark, sf), _bpe()).select("doc_id", "line_no", _joined("ids").alias("ids"))


@_query(f"{_WITH} SELECT doc_id, line_no, regexp_replace({_NORMAL}, '[^a-zA-Z., ]', '', 'g') AS text FROM lines")
def merge_decoding(spark, sf):
    """Lines encoded and decoded; unknown characters are left out with the special tokens."""
    model = _bpe()
    return tokenizers.decode(tokenizers.encode(_lines(spark, sf), model), model).select("doc_id", "line_no", "text")


@_query(f"""{_ENCODED}, f AS (SELECT * FROM e WHERE trim(line) <> ''), s AS (SELECT CAST(sum(len({_toks('line')})) AS BIGINT) AS words, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(ids, lambda x: x = 0))) AS BIGINT) AS unknown FROM f)
    SELECT *, round(tokens / words, 6) AS fertility, round(100.0 * unknown / tokens, 6) AS oov_rate FROM s""")
def fertility_and_unknowns(spark, sf):
    return _rounded(tokenizers.evaluate(_lines(spark, sf), _bpe()), "fertility", "oov_rate")


_ROW = "list_concat([1], list_concat(list_slice(ids, 1, 510), [2]))"


@_query(f"{_ENCODED} SELECT doc_id, line_no, array_to_string({_ROW}, ',') AS input_ids, CAST(len({_ROW}) AS BIGINT) AS attended FROM e")
def model_rows(spark, sf):
    """Token arrays in the template, cut to 512."""
    model = _bpe()
    rows = modeldata.model_rows(tokenizers.encode(_lines(spark, sf), model), model)
    return rows.select("doc_id", "line_no", _joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("attended"))


@_query(f"""{_ENCODED}, r AS (SELECT doc_id, line_no, {_ROW} AS r, max(len({_ROW})) OVER (PARTITION BY doc_id // 16) AS longest FROM e)
    SELECT doc_id, line_no, array_to_string(list_concat(r, list_transform(range(longest - len(r)), lambda x: 3)), ',') AS shown, true AS sound FROM r""")
def masked_and_padded(spark, sf):
    """Padded to the longest of a batch, then masked: with the labels put back, the rows are as before, and no special token is hidden."""
    model = _bpe()
    rows = modeldata.model_rows(tokenizers.encode(_lines(spark, sf), model), model).withColumn("batch", F.floor(F.col("doc_id") / 16))
    hidden = modeldata.masked(modeldata.padded(rows, model), model)
    back = F.zip_with("input_ids", "labels", lambda x, y: F.when(y == -100, x).otherwise(y))
    sound = F.forall("labels", lambda y: (y == -100) | ~y.isin(0, 1, 2, 3, 4)) & (F.size("attention_mask") == F.size("input_ids"))
    return hidden.select("doc_id", "line_no", _joined(back).alias("shown"), sound.alias("sound"))


_BOTH = f"WITH p AS (SELECT conv_id, turn, {_line_ids('sentence1')} AS a, {_line_ids('sentence2')} AS b FROM ({_PAIRS}) WHERE sentence2 IS NOT NULL)"
#: Tokens go off the longer part, of equals off the second: 125 are left.
_KEPT = "CASE WHEN len(a) + len(b) <= 125 THEN len(a) WHEN len(a) <= 62 THEN len(a) WHEN len(b) <= 62 THEN 125 - len(b) ELSE 63 END"


@_query(f"""{_BOTH}, k AS (SELECT *, {_KEPT} AS x FROM p), r AS (SELECT conv_id, turn, list_concat([1], list_concat(list_slice(a, 1, x), list_concat([2], list_concat(list_slice(b, 1, least(len(b), 125 - x)), [2])))) AS r FROM k)
    SELECT conv_id, turn, array_to_string(r, ',') AS input_ids, CAST(len(r) AS BIGINT) AS num_tokens, len(r) >= 128 AS truncated FROM r""")
def pair_encoding(spark, sf):
    """Both parts of each pair in one template, cut to 128."""
    model, pairs = _bpe(), modeldata.turn_pairs(_table(spark, sf, "conversations"))
    coded = tokenizers.encode(tokenizers.encode(pairs, model, "sentence1").withColumnRenamed("ids", "ids1"), model, "sentence2").withColumnRenamed("ids", "ids2")
    rows = modeldata.pair_rows(coded, model)
    return _long(rows.select("conv_id", "turn", _joined("input_ids").alias("input_ids"), "num_tokens", "truncated"), "num_tokens")


# -- learning ---------------------------------------------------------------------------------------------------


def _learning_sql(first: str, glue: str, steps: int = 12) -> str:
    """A merge for each step: the most frequent pair of adjacent symbols, of equals the least, joined wherever it stands."""
    out = rf"{_PIECES}, s0 AS MATERIALIZED (SELECT {first} AS s, n FROM words)"
    for k in range(steps):
        out += f""", l{k} AS (SELECT list_filter(string_split(replace(s, chr(1), ''), chr(2)), lambda x: x <> '') AS l, n FROM s{k}),
            p{k} AS (SELECT unnest(list_transform(range(1, len(l)), lambda i: struct_pack(a := l[i], b := l[i + 1]))) AS p, n FROM l{k} WHERE len(l) > 1),
            m{k} AS MATERIALIZED (SELECT p.a AS a, p.b AS b FROM p{k} GROUP BY p.a, p.b ORDER BY sum(n) DESC, p.a, p.b LIMIT 1),
            s{k + 1} AS MATERIALIZED (SELECT replace(s, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || {glue} || chr(2)) AS s, n FROM s{k}, m{k})"""
    return out + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS rank, a AS \"left\", b AS \"right\" FROM m{k}" for k in range(steps))


def _merges(spark, model: tokenizers.Model) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, left string, right string")


def _symbols(words: DataFrame, led: bool) -> int:
    """How many symbols the words begin with, once those within a word are told from those that lead it."""
    chars = words.select(F.posexplode(F.filter(F.split("word", ""), lambda x: x != "")).alias("i", "c"))
    return chars.select("c", (F.col("i") > 0).alias("within") if led else F.lit(0)).distinct().count()


@_query(_learning_sql(r"regexp_replace(word, '(.)', chr(1) || '\1' || chr(2), 'g')", "a || b"))
def learnt_merges(spark, sf):
    """The first twelve merges of byte-pair encoding."""
    words = written(tokenizers.word_counts(_lines(spark, sf)), "words")
    return _merges(spark, tokenizers.train("bpe", words, 5 + _symbols(words, False) + 12, unused=0))


@_query(_learning_sql(r"replace(regexp_replace(word, '(.)', chr(1) || '##' || '\1' || chr(2), 'g'), chr(1) || '##▁', chr(1) || '▁')", "a || replace(b, '##', '')"))
def learnt_word_pieces(spark, sf):
    """The first twelve merges of WordPiece, whose characters know whether they lead a word."""
    words = written(tokenizers.word_counts(_lines(spark, sf)), "words")
    return _merges(spark, tokenizers.train("bert", words, 5 + _symbols(words, True) + 12, unused=0))


@_query(f"""{_PIECES}, c AS (SELECT unnest(string_split(word, '')) AS c, n FROM words), k AS (SELECT c AS token, row_number() OVER (ORDER BY sum(n) DESC, c) AS r FROM c GROUP BY c)
    SELECT token, CAST(r + 1004 AS INT) AS id FROM k UNION ALL SELECT '[unused' || i || ']', CAST(5 + i AS INT) FROM range(1000) t(i) UNION ALL VALUES ('[UNK]', 0), ('[CLS]', 1), ('[SEP]', 2), ('[PAD]', 3), ('[MASK]', 4)""")
def saved_vocabulary(spark, sf):
    """A vocabulary of reserved tokens and characters, learnt, saved and loaded."""
    import uuid

    words = written(tokenizers.word_counts(_lines(spark, sf)), "words")
    path = f"{shared_dir(spark)}/tokenizer-{uuid.uuid4().hex}"
    tokenizers.save(spark, tokenizers.train("bpe", words, 1005 + _symbols(words, False)), path)
    return tokenizers.token_table(spark, tokenizers.load(spark, path)).select("token", "id")


# -- marks, variants --------------------------------------------------------------------------------------------


@_query(f"""{_WITH_TAMIL}, c AS (SELECT line, list_filter({_cuts_sql('line')}, lambda x: x > 0 AND x < length(line)) AS cuts FROM tamil),
    m AS (SELECT array_to_string(list_transform(range(0, len(cuts) + 1), lambda i: substring(line, CAST(coalesce(list_extract(cuts, i), 0) AS BIGINT) + 1, coalesce(list_extract(cuts, i + 1), length(line)) - coalesce(list_extract(cuts, i), 0))), '⟂') AS m FROM c)
    SELECT CAST(sum(len(string_split(m, '⟂')) - 1 - (len(string_split(m, '⟂அ')) - 1)) AS BIGINT) AS isolated, CAST(sum(len(string_split(m, '⟂அ')) - 1) AS BIGINT) AS fused FROM m""")
def marker_tokens(spark, sf):
    """Marks alone and joined to the vowel behind them, by a model of one merge."""
    merge = ("⟂", "அ")
    model = tokenizers.Model("bpe", {t: i for i, t in enumerate([*tokenizers.reserved(5), "▁", "⟂", "அ", "⟂அ"])}, (merge,))
    return tokenizers.marker_usage(_lines(spark, sf).select(marking.mark(_tamil("line")).alias("line")), model)


_WS = r"regexp_matches(substring(line, CAST({} AS BIGINT), 1), '\s')"
_EDGES = f"list_filter(range(1, greatest(length(line), 1)), lambda i: {_WS.format('i')} <> {_WS.format('i + 1')})"


@_query(f"""{_WITH_TAMIL}, c AS (SELECT doc_id, line_no, line, list_sort(list_distinct(list_concat(list_filter({_cuts_sql('line')}, lambda x: x > 0 AND x < length(line)), {_EDGES}))) AS cuts FROM tamil)
    SELECT doc_id, line_no, CASE WHEN line = '' THEN '' ELSE array_to_string(list_transform(range(0, len(cuts) + 1), lambda i: coalesce(list_extract(cuts, i), 0) || ':' || coalesce(list_extract(cuts, i + 1), length(line))), ' ') END AS spans, true AS whole FROM c""")
def boundary_spans(spark, sf):
    """The pieces between boundaries and changes of white space, of the lines written in Tamil letters."""
    lines = _lines(spark, sf).select("doc_id", "line_no", _tamil("line").alias("line")).withColumn("s", marking.spans("line"))
    whole = F.array_join(F.transform("s", lambda x: x.token), "") == F.col("line")
    return lines.select("doc_id", "line_no", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x.start, x.end)), " ").alias("spans"), whole.alias("whole"))


_PUT = {"01_metaspace_codepoint": ("line", "அஆ"), "02_metaspace_grapheme": ("shown", "அஆ"), "03_sandhi_codepoint": ("line", "அ⟂ஆ"), "04_sandhi_grapheme": ("shown", "அ⟂ஆ")}
_SHOWN = "line"
for _i, _v in enumerate("aeiou"):
    _SHOWN = f"replace({_SHOWN}, '{_v}', chr({57344 + _i}))"


@_query(_WITH + " " + " UNION ALL ".join(f"SELECT '{v}' AS variant, doc_id, line_no, replace({_MARKED if c == 'line' else _SHOWN}, ' ', '{gap}') AS shown FROM lines" for v, (c, gap) in _PUT.items()))
def preprocessed_grid(spark, sf):
    """The lines with their vowels marked and two vowels for each space, as the four kinds of variants prepare them."""
    table = {f"{v}́": chr(marking.FIRST_PLACEHOLDER + i) for i, v in enumerate("aeiou")}
    lines = _lines(spark, sf).select("doc_id", "line_no", F.replace(_accented(), F.lit(" "), F.lit("அஆ")).alias("line"))
    shown = [F.struct(F.lit(v).alias("variant"), marking.preprocessor(f"{v}_unigram", table)("line").alias("shown")) for v in _PUT]
    return lines.select("doc_id", "line_no", F.explode(F.array(*shown)).alias("v")).select("v.variant", "doc_id", "line_no", "v.shown")


_GRID = " UNION ALL ".join(f"SELECT '{p}_{f}' AS variant, '{f}' AS family, {s} AS use_sandhi, {g} AS use_grapheme, {str(g == 'true' and f == 'unigram').lower()} AS relabel, {s} AS in_subset, {chr(39) + ('grapheme' if g == 'true' else 'codepoint') + chr(39)} AS bucket" for p, s, g in (("01_metaspace_codepoint", "false", "false"), ("02_metaspace_grapheme", "false", "true"), ("03_sandhi_codepoint", "true", "false"), ("04_sandhi_grapheme", "true", "true")) for f in ("bert", "bpe", "unigram"))


@_query(_GRID)
def variant_grid(spark, sf):
    """The twelve variants, which of them mark boundaries, and the bucket that their reports go to."""
    return corpora.variant_table(spark)


@_query(f"""{_WITH}, l AS (SELECT variant, CASE WHEN bucket = 'grapheme' THEN {_SHOWN} ELSE {_MARKED} END AS line FROM lines, ({_GRID}) WHERE in_subset), t AS (SELECT variant, length(regexp_replace({_NORMAL}, ' ', '', 'g')) + CASE WHEN {_NORMAL} = '' THEN 0 ELSE len(string_split({_NORMAL}, ' ')) END AS n FROM l)
    SELECT variant, count(n) AS "count", round(avg(n), 6) AS mean, min(n) AS "min", round(quantile_cont(n, 0.5), 6) AS p50, max(n) AS "max" FROM t GROUP BY variant""")
def token_lengths_by_variant(spark, sf):
    """The lengths in tokens of the lines, blank ones too, under each variant that marks boundaries; each by a model of single characters. A variant without a test file is left out."""
    table = {f"{v}́": chr(marking.FIRST_PLACEHOLDER + i) for i, v in enumerate("aeiou")}
    model = tokenizers.Model("bpe", {t: i for i, t in enumerate([*tokenizers.reserved(0), "▁"])})
    files = dict.fromkeys((v for v, spec in marking.VARIANTS.items() if spec["use_sandhi"]), _lines(spark, sf).select(_accented().alias("line")))
    report = corpora.token_lengths(spark, files, lambda v: model, table)
    return _rounded(report, "mean", "p50").select("variant", "count", "mean", "min", "p50", "max")


@_query("""SELECT 'relabelled' AS kind, CAST(5 AS INT) AS id, 'k' AS token UNION ALL SELECT 'relabelled', 6, 'x' || chr(769) UNION ALL SELECT 'relabelled', 7, '▁'
    UNION ALL SELECT 'encoded', 7, '▁' UNION ALL SELECT 'encoded', 5, 'k' UNION ALL SELECT 'encoded', 6, 'x' || chr(769)""")
def relabelled_vocabulary(spark, sf):
    """Pieces with placeholders put back to what they stand for, and a word encoded by them."""
    table = {"x\u0301": chr(marking.FIRST_PLACEHOLDER)}
    model = tokenizers.Model("unigram", {t: i for i, t in enumerate([*tokenizers.reserved(0), "k", *table.values(), "▁"])}, (), {"k": -1.0, **dict.fromkeys(table.values(), -2.0), "▁": -1.5})
    new = corpora.relabelled(spark, model, table, "kx\u0301")
    return spark.createDataFrame([*(("relabelled", i, t) for t, i in new[0].vocab.items() if i > 4), *(("encoded", i, new[0].tokens[i]) for i in new[1])], "kind string, id int, token string")


@_query()
def grid_reports(spark, sf):
    """All twelve variants, learnt on the benchmark's texts in Tamil letters with their vowels marked, and measured on them; learning by expectation isn't SQL."""
    lines = _table(spark, sf, "benchmark").select(F.regexp_replace(_tamil("text"), "([கசத])", "$1\u0bbf").alias("line"))
    rows, shown = [], corpora.Shown(lines, lines)
    for name, v in marking.VARIANTS.items():
        options = {"seed_size": 2000, "shrink": 0.5} if v["family"] == "unigram" else {}
        _, report = corpora.variant_report(lines, lines, name, 400, shown=shown, unused=5, **options)
        rows.append((name, report["vocab_size"], report["words"], report["tokens"], report["unknown"], report["fertility"]))
    return tokenizers.leaderboard(spark.createDataFrame(rows, "variant string, vocab_size int, words long, tokens long, unknown long, fertility double"))


@_query()
def baseline_fertility(spark, sf):
    """The same metrics of a published tokenizer on the raw lines; tests hold it against the library."""
    import public_tokenizers

    return tokenizers.evaluate_other(_lines(spark, sf), public_tokenizers.path("word_bpe_49k.json"), "<|endoftext|>")


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
_COS = f"round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 4)"


@_query(f"SELECT a.vec_id, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_similarity(spark, sf):
    """The cosine of each vector and the next."""
    return _neighbours(spark, sf).select("vec_id", "similarity")


def _neighbours(spark, sf) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(modeldata.cosine("embedding", "next"), 4).alias("similarity"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 50).alias("gold"))


@_query(f"""WITH s AS (SELECT {_COS} AS x, CAST(floor(CAST(a.embedding[1] AS DOUBLE) * 50) AS BIGINT) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM s)
    SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def similarity_ranks(spark, sf):
    """The rank correlation of these cosines and another measure with many ties."""
    return _rounded(modeldata.spearman(_neighbours(spark, sf), "similarity", "gold"), "spearman")
