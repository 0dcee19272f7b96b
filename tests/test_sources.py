import bz2
import json
import lzma

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus
from millrace.plans import corpora
from millrace.profiles import TAMIL
from millrace.sources import readers, writers


def test_wiki_dump(spark, tmp_path):
    page = '<page><ns>{}</ns><revision><text bytes="3" xml:space="preserve">{}</text></revision></page>'
    body = "<mediawiki>" + page.format(0, "அ. ஆ! x\n\nஇ [[ஈ|உ]]") + page.format(1, "no") + "<page><revision><text>none</text></revision></page></mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(body.encode()))
    pages = readers.wiki_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert pages.count() == 1
    lines = corpora.wiki_lines(pages, TAMIL).collect()
    assert [r.line for r in lines] == ["அ", "ஆ !", "இ உ"] and {r.verdict for r in lines} == {"main"}
    assert readers.wiki_pages(spark, str(tmp_path / "d.xml.bz2"), ()).count() == 3


def test_compressed_lines(spark, tmp_path):
    (tmp_path / "w.txt.xz").write_bytes(lzma.compress(" அ \r b\nc\x0bd\n\n".encode()))
    assert [r.line for r in readers.xz_lines(spark, str(tmp_path / "w.txt.xz")).collect()] == ["அ \r b", "c\x0bd", ""]
    with pytest.raises(ValueError):
        readers.text_lines(spark, str(tmp_path / "w.txt.xz"))
    (tmp_path / "a_above_threshold.txt").write_text("x\ny\r\nz")
    (tmp_path / "a_below_threshold.txt").write_text("q")
    got = readers.text_lines(spark, str(tmp_path / "*_above_threshold.txt")).collect()
    assert [(r.source, r.line) for r in got] == [("a_above_threshold.txt", x) for x in "xyz"]


def test_pages(spark):
    html = '<html><head><style>p{}</style><title>t</title></head><body><a href="/a/x.html">One</a><a href="/a/y.html"><b>One</b></a><a href="/q">no</a><!-- c --><p>Hello, world &amp; me@x.org https://u.v/w</p><script>"</p>"</script><p>123</p></body></html>'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    links = readers.page_links(pages, "/a/", ".html", "https://h.test").collect()
    assert [(r.anchor, r.url) for r in links] == [("One", "https://h.test/a/y.html")]
    assert [r.line for r in readers.page_lines(pages).collect()] == ["One", "One", "no", "Hello , world"]


def test_a_reference_ends_with_its_sign(spark):
    pages = spark.createDataFrame([(1, "u", "<body><p>eau&amp;&amp</p><p>a &quot b &quot; c&am</p></body>")], "page_id long, url string, html string")
    assert [r.line for r in readers.page_lines(pages).collect()] == ["eau amp", 'a quot b " c am']


def test_a_page_is_read_or_is_an_error():
    assert readers.lines_of_page("<body><p>a</p><![foo]><p>b</p><![%x]]><p>c</p></body>") == ["a", "b", "c"]
    assert readers.lines_of_page("<body>a<![CDATA[b]]>c</body>") == ["a", "c"]
    with pytest.raises(TypeError):
        readers.lines_of_page(7)


def test_json_sources(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps({"validation": [{"premise": "p", "hypothesis": "h", "label": 2}]}))
    assert readers.pair_rows(spark, str(tmp_path / "dev.json"), "validation").first() == ("p", "h", 2)
    for name, has in (("v1", True), ("v2", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps({"fertility": 1.5, "oov_rate": 0.1, "vocab_size": 9}, indent=1))
        if has:
            (tmp_path / name / "tokenizer.json").write_text("{}")
    assert [tuple(r) for r in readers.variant_metrics(spark, str(tmp_path)).collect()] == [("v1", 1.5, 0.1, 9)]
    (tmp_path / "map.json").write_text(json.dumps({"கி": ""}))
    assert spark.range(1).select(readers.placeholder_table(spark, str(tmp_path / "map.json"))).first()[0] == {"கி": ""}
    (tmp_path / "state.json").write_text(json.dumps({"global_step": 4, "best_metric": 1.0, "log_history": [{"step": 2, "loss": 3.0}, {"step": 4, "eval_loss": 1.0}]}))
    assert [r.eval_loss for r in readers.trainer_history(spark, str(tmp_path / "state.json")).collect()] == [None, 1.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "above", "train"), ("b", "below", "test")], "line string, verdict string, split string")
    writers.lines(df, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]
    writers.routed(df, str(tmp_path / "r"))
    writers.split(df, str(tmp_path / "s"))
    assert {r.verdict for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"above", "below"}
    assert spark.read.parquet(f"{tmp_path}/s/split=test").first().line == "b"
    writers.report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["line", "verdict", "split"]
    writers.json_rows(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.placeholders({"கி": ""}, df, str(tmp_path / "p"))
    assert json.loads(spark.read.text(str(tmp_path / "p")).first()[0]) == {"கி": ""}


def _lines(spark, texts):
    return spark.createDataFrame([("s", i, 0, t) for i, t in enumerate(texts)], "source string, doc_id long, line_no long, line string")


def test_dedup_is_exact(spark):
    got = corpus.first_of_equals(_lines(spark, ["x", "x ", "X", "x"])).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True, True, False]


@pytest.mark.parametrize("n", [0, 1, 7, 10, 19, 200])
def test_split_sizes(spark, n):
    lines = _lines(spark, [f"line {i}" for i in range(n)])
    got = corpus.exact_split(lines)
    assert got.where("split = 'test'").count() == n // 10 and got.where("split = 'train'").count() == n - n // 10
    assert corpus.exact_split(lines, train_down=True).where("split = 'train'").count() == int(0.9 * n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus.exact_split(lines.repartition(3)).collect()))


def test_shuffled_split(spark):
    import random

    labels = ["test"] * 2 + ["train"] * 21
    random.Random(42).shuffle(labels)
    got = corpus.shuffled_split(_lines(spark, [f"line {i}" for i in range(23)])).orderBy("doc_id").collect()
    assert [r.split for r in got] == labels
    with pytest.raises(ValueError):
        corpus.shuffled_split(_lines(spark, "abc"), most=2)


def test_build_keeps_every_line_somewhere(spark):
    built = corpora.build(_lines(spark, ["a b", "a b", "1 2 3 4", "", "c"]))
    assert built.routed.count() == 5 and built.kept.count() == 2 and built.dropped.count() == 1 and built.split.count() == 2
    tables = corpora.measure(_lines(spark, ["a b", "a b"]))
    assert tables["profile"].first().word_count == 4 and tables["hygiene"].first().duplicate_ratio == 50.0
    assert corpus.sample(_lines(spark, "abc"), 2).count() == 2 and corpus.sample_each(_lines(spark, "abc"), "source", 2).count() == 2
    assert tables["lengths"].select(F.sum("line_count")).first()[0] == 2


def test_variant_report(spark):
    lines = _lines(spark, ["கடவுள்அருள் கி", "கி கீ"])
    model, report = corpora.variant_report(lines, lines, "04_sandhi_grapheme_unigram", 60, sample="கி", unused=1, seed_size=100)
    assert report["words"] == 4 and report["oov_rate"] == 0.0 and report["sample_text"]["decoded_restored"] == "கி"
    assert not any(0xE000 <= ord(c) <= 0xF8FF for t in model.vocab for c in t)
    with pytest.raises(ValueError):
        corpora.variant_report(lines, lines, "none", 60)


def test_archives_names_and_once(spark, tmp_path):
    import zipfile

    from pyspark.errors import PythonException

    from millrace.sources import names

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "1")
    assert readers.zip_members(spark, str(tmp_path / "a.zip"), ("x.txt",)).first() == ("x.txt", bytearray(b"1"))
    with pytest.raises(PythonException, match="lacks y.txt"):
        readers.zip_members(spark, str(tmp_path / "a.zip"), ("y.txt",)).collect()
    paths = spark.createDataFrame([("/d.x/a.b.txt",), ("/d.x/a",), (".txt",)], "p string")
    assert [r[0] for r in paths.select(names.derived("p", "_z")).collect()] == ["/d.x/a.b_z.txt", "/d.x/a_z", ".txt_z"]
    made = []
    for _ in range(2):
        readers.once(spark, str(tmp_path / "o"), lambda p: (made.append(p), spark.range(1).write.parquet(p)))
    assert len(made) == 1
