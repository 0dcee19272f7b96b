"""Whole plans: sources to a split corpus, a corpus to its tables of metrics, a variant to its report."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marking, text as T
from ..operators import corpus, metrics, tokenizers
from ..profiles import LATIN, ScriptProfile
from ..sources import writers
from ..tables import written
from . import config


def wiki_lines(pages: DataFrame, profile: ScriptProfile = LATIN) -> DataFrame:
    """verdict and line of the chunks of cleaned pages that hold words."""
    chunks = pages.select(F.explode(T.chunks(T.clean_wiki("text"))).alias("chunk"))
    return corpus.route_long(chunks.select(T.joined(T.extract_words("chunk", profile)).alias("line")).where("line <> ''"))


def web_lines(raw: DataFrame, profile: ScriptProfile = LATIN) -> DataFrame:
    return raw.select("*", T.clean_web(F.col("line"), profile).alias("clean")).drop("line").withColumnRenamed("clean", "line").where("line <> ''")


@dataclass(frozen=True)
class Corpus:
    """Frames of one lazy plan: nothing is materialised between them."""

    routed: DataFrame
    merged: DataFrame
    marked: DataFrame
    split: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.marked.where("kept").drop("kept", "copies")

    @property
    def dropped(self) -> DataFrame:
        return self.marked.where(~F.col("kept"))


def build(lines: DataFrame, profile: ScriptProfile = LATIN, share: float = 0.1, seed: int = 42) -> Corpus:
    """Lines of all sources, routed by content ratio, merged, deduplicated and split. lines: source, doc_id, line_no, line."""
    routed = corpus.route_ratio(lines, profile)
    merged = corpus.merge([routed.where("verdict = 'above'").drop("ratio", "verdict")], profile).where("written").drop("written")
    marked = corpus.first_of_equals(merged)
    kept = marked.where("kept").drop("kept", "copies")
    return Corpus(routed, merged, marked, corpus.exact_split(kept, share, seed))


def measure(lines: DataFrame, by: str = "source", profile: ScriptProfile = LATIN, order: tuple[str, ...] = ("doc_id", "line_no")) -> dict[str, DataFrame]:
    """Hygiene, profile (with MTLD) and length tables of each group."""
    lexical = metrics.profile(metrics.token_counts(lines, by), by).join(metrics.mtld(lines, by, order), by, "left")
    return {"hygiene": metrics.hygiene(lines, by, profile), "profile": lexical, "lengths": metrics.length_histogram(lines, by)}


class Shown:
    """Training and test lines as variants show them. What variants have in common is made once: placeholders, and tables of distinct words."""

    def __init__(self, train: DataFrame, test: DataFrame):
        self.train, self.test = train, test
        self.tables: dict[bool, dict[str, str]] = {}
        self.counts: dict[tuple, DataFrame] = {}

    def table(self, use_sandhi: bool, use_grapheme: bool) -> dict[str, str]:
        if not use_grapheme:
            return {}
        if use_sandhi not in self.tables:
            both = self.train.select("line") if self.train is self.test else self.train.select("line").unionByName(self.test.select("line"))
            self.tables[use_sandhi] = marking.placeholder_map(both.select(marking.preprocess("line", use_sandhi, False).alias("line")))
        return self.tables[use_sandhi]

    def lines(self, df: DataFrame, use_sandhi: bool, use_grapheme: bool) -> DataFrame:
        return df.select(marking.preprocess("line", use_sandhi, use_grapheme, self.table(use_sandhi, use_grapheme)).alias("line"))

    def words(self, of_test: bool, use_sandhi: bool, use_grapheme: bool) -> DataFrame:
        """The distinct words of the training or test lines, written; of one frame for both, one table."""
        key = of_test and self.test is not self.train, use_sandhi, use_grapheme
        if key not in self.counts:
            self.counts[key] = written(tokenizers.word_counts(self.lines(self.test if of_test else self.train, use_sandhi, use_grapheme)), "words")
        return self.counts[key]


def variant_report(train: DataFrame, test: DataFrame, variant: str | dict, vocab_size: int, sample: str = "", shown: Shown | None = None, **options) -> tuple[tokenizers.Model, dict]:
    """A variant's model, learnt on train, and its metrics on test; seconds are for the caller to take. A variant is a name of the grid or its settings.

    shown: what other variants of the same lines have made already.
    """
    v = variant if isinstance(variant, dict) else marking.VARIANTS.get(variant)
    if v is None:
        raise ValueError(f"unknown variant {variant!r}")
    alone, shown, kind = shown is None, shown or Shown(train, test), (v["use_sandhi"], v["use_grapheme"])
    table = shown.table(*kind)
    model = tokenizers.train(v["family"], shown.words(False, *kind), vocab_size, held=True, **options)
    # one variant looks at the test lines once, without a shuffle; several have their distinct words in common
    row = (tokenizers.evaluate(shown.lines(test, *kind), model) if alone else tokenizers.evaluate_counts(shown.words(True, *kind), model)).first().asDict()
    report = {"variant": v.get("name", variant), "vocab_size": len(model.vocab), **row}
    if sample:
        one = train.sparkSession.createDataFrame([(sample,)], "line string")
        coded = tokenizers.decode(tokenizers.encode(shown.lines(one, *kind), model), model).select("line", "ids", "text").first()
        names = model.tokens
        report["sample_text"] = {"raw": sample, "marked": coded["line"], "encoded_tokens": [names[i] for i in coded["ids"]], "decoded": coded["text"]}
        if table:
            back = train.sparkSession.createDataFrame([(coded["text"],)], "t string")
            report["sample_text"]["decoded_restored"] = back.select(marking.restore("t", table).alias("t")).first()[0]
    return (model.relabelled(table) if v["relabel"] else model), report


def run_variants(train: DataFrame, test: DataFrame, settings: list[dict], out: str, vocab_size: int = tokenizers.VOCAB, sample: str = "", **options) -> list[dict]:
    """The reports of all the variants; each one's tokenizer.json and metrics.json are written to a folder of its name."""
    spark, reports, shown = train.sparkSession, [], Shown(train, test)
    for v in settings:
        spec = {"name": v["name"], "family": config.FAMILIES[v["model_type"]], "use_sandhi": bool(v.get("use_sandhi")), "use_grapheme": bool(v.get("use_grapheme"))}
        spec["relabel"] = bool(v.get("relabel_vocab_after_save")) and spec["use_grapheme"]
        model, report = variant_report(train, test, spec, vocab_size, sample, shown, **(options if spec["family"] != "unigram" else {k: x for k, x in options.items() if k == "unused"}))
        writers.put(spark, f"{out}/{v['name']}/tokenizer.json", tokenizers.as_json(model).encode())
        writers.put(spark, f"{out}/{v['name']}/metrics.json", json.dumps(report, ensure_ascii=False, indent=2).encode())
        reports.append(report)
    return reports


def variant_table(spark: SparkSession) -> DataFrame:
    """The grid of variants, which of them mark boundaries (the subset that marker tables are made of), and the bucket of their reports."""
    rows = [(name, v["family"], v["use_sandhi"], v["use_grapheme"], v["relabel"]) for name, v in marking.VARIANTS.items()]
    table = spark.createDataFrame(rows, "variant string, family string, use_sandhi boolean, use_grapheme boolean, relabel boolean")
    return table.withColumns({"in_subset": F.contains("variant", F.lit("sandhi")), "bucket": F.when(F.contains("variant", F.lit("grapheme")), "grapheme").otherwise("codepoint")})


def token_lengths(spark: SparkSession, files: dict[str, DataFrame], model_of: Callable[[str], tokenizers.Model], table: dict[str, str]) -> DataFrame:
    """Lengths in tokens of the lines of each variant that marks boundaries and has a test file: a row of statistics each. Blank lines count."""
    groups: dict[tuple, tuple] = {}  # variants that have one file, one way to show it and one model are measured once
    for name, v in marking.VARIANTS.items():
        if v["use_sandhi"] and name in files:
            model = model_of(name)
            groups.setdefault((id(files[name]), v["use_grapheme"], id(model)), (files[name], v["use_grapheme"], model, []))[3].append(name)
    out = None
    for df, use_grapheme, model, names in groups.values():
        count = tokenizers.token_numbers(spark, model)(marking.preprocess("line", True, use_grapheme, table))
        stats = metrics.describe(df.select(F.lit(names[0]).alias("variant"), count.alias("n")), "n", "variant")
        stats = stats.withColumn("variant", F.explode(F.array(*map(F.lit, names))))
        out = stats if out is None else out.unionByName(stats)
    if out is None:
        raise ValueError("no variant has a test file")
    return out


def relabelled(spark: SparkSession, model: tokenizers.Model, table: dict[str, str], sample: str) -> tuple[tokenizers.Model, list[int]]:
    """The model with its placeholders put back, and what it makes of a sample; a sample that it can't encode is an error."""
    new = model.relabelled(table)
    ids = tokenizers.encode(spark.createDataFrame([(sample,)], "line string"), new).first()["ids"]
    if new.unk in ids:
        raise ValueError(f"the relabelled vocabulary doesn't cover {sample!r}")
    return new, list(ids)
