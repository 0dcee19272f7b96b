"""Phonological boundaries and grapheme placeholders: lossless marks for subword training.

A rule is two patterns, left and right; it matches left then right and cuts between them. Rules are matched each on the
source text, without overlap within a rule, and their cuts are united. This is done in Arrow batches by compiled
patterns; built_in_boundaries() says the same with built-in functions, at many times the cost for so many patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, CUT = "⟂", "\x01"
#: Cuts of a rule in a line up to which their offsets are added up one by one.
FEW = 64
FIRST_PLACEHOLDER, MOST_PLACEHOLDERS = 0xE000, 6400

V = "[அஆஇஈஉஊஎஏஐஒஓஔ]"
C = "[கஙசஞடணதநபமயரலவழளறன]"
VIRAMA = "்"
_NOT_SPACE = r"[^\s\x1c-\x1f]"


@dataclass(frozen=True)
class Rule:
    group: str
    left: str
    right: str


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


CORE = (
    Rule("vowels", "அ", "[அஆ]"),
    Rule("vowels", "அ", "[இஈ]"),
    Rule("vowels", "அ", "[உஊ]"),
    Rule("vowels", "அ", "[எஏஒஓஐஔ]"),
    Rule("vowels", "[இஈ]", V),
    Rule("vowels", "[உஊ]", V),
    Rule("vowels", "[எஏஒஓஐஔ]", V),
    Rule("glides", "[ிீை]", V),
    Rule("glides", "[ுூ]", V),
    Rule("glides", "[ாெேொோௌ]", V),
    Rule("glides", "[இஈஐ]", V),
    Rule("glides", "ஏ", V),
    Rule("consonants", C + VIRAMA, V),
    Rule("directions", _any("வடக்கு", "தெற்கு", "குடக்கு", "குணக்கு", "கிழக்கு", "மேற்கு"), _NOT_SPACE),
    Rule("roots", _any("கண்", "பண்", "மண்", "தண்", "எண்", "வண்"), V),
    Rule("cases", V, "ஐ"),
    Rule("cases", V, _any("உ", "க்") + "கு"),
    Rule("cases", V, _any("ஆல்", "னால்")),
    Rule("cases", V, _any("இல்", "அல்")),
    Rule("cases", V, _any("இடம்", "உடன்", "முன்", "பின்", "ஓடு", "ஓடே")),
    Rule("cases", V, "கள்"),
    Rule("cases", C + VIRAMA, "கள்"),
    Rule("cases", V, _any("வர்கள்", "வர்")),
    Rule("participles", "[ிஉஅ]", _any("போ", "வா", "இரு", "உள்", "கொள்", "விடு", "ஆகு")),
    Rule("participles", _any("த்து", "ட்டு"), _any("கொள்", "விடு", "போ", "ஆகு")),
    Rule("participles", _any("ஆன", "என்", "உம்"), _NOT_SPACE),
    Rule("numerals", "[௦-௯0-9]+", "ஆம்(?: நாள்| ஆண்டு)?"),
    Rule("numerals", "[௦-௯0-9]+", "ஐ"),
    Rule("triggers", _any("அந்த", "இந்த", "அத்துணை", "இத்துணை", "எத்துணை", "அவ்வகை", "இவ்வகை", "எவ்வகை", "மற்று", "மற்றை", "மற்ற", "அரை", "பாதி"), _NOT_SPACE),
)
#: One of the glide rules says the same as a vowel rule and is left out; the cuts are the same.
AGGRESSIVE = (
    Rule("glide letters", "[ாிீுூெேைொோௌ]", "[யவ]"),
    *[Rule("nasals", n + VIRAMA, s) for n, s in zip("ஙஞணநமன", "கசடதபற", strict=True)],
    Rule("nasals", "[ஙஞணநமன]" + VIRAMA, "[கசடதபற]"),
    Rule("doubled", f"(?<letter>{C})" + VIRAMA, "\\k<letter>"),
    Rule("laterals", "ல்", "ச"),
    Rule("rhotics", "[ரற]" + VIRAMA, "ர"),
    Rule("alveolars", "[னண]" + VIRAMA, "[டத]"),
)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rule_cuts(text: Column, rule: Rule) -> Column:
    """Offsets of a rule's cuts: the lengths of the parts between the signs put in, summed up."""
    marked = F.regexp_replace(text, f"(?U)(?<l>{rule.left})(?<r>{rule.right})", "${l}" + CUT + "${r}")
    none = F.array().cast("array<int>")
    add = lambda done, part: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(part)))
    few = lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), none, add)
    # of many parts, their sums would be copied too often: the signs' own places, less the signs before each
    signs = lambda m: F.filter(F.transform(F.split(m, ""), lambda x, i: F.when(x == CUT, i)), lambda i: i.isNotNull())
    many = lambda m: F.transform(signs(m), lambda i, k: i - k)
    return _let(marked, lambda m: F.when(~F.contains(m, F.lit(CUT)), none).otherwise(_let(F.split(m, CUT), lambda parts: F.when(F.size(parts) <= FEW, few(parts)).otherwise(many(m)))))


def built_in_boundaries(c: Column | str, rules: tuple[Rule, ...] = CORE) -> Column:
    """boundaries() without Python. The text must not hold U+0001."""
    cuts = lambda t: F.array_sort(F.array_distinct(F.concat(*[_rule_cuts(t, rule) for rule in rules])))
    return _let(_col(c), lambda t: F.when(t.rlike(r"[^\x00-\x{02ff}]"), cuts(t)).otherwise(F.array().cast("array<int>")))


def _python(rule: Rule) -> re.Pattern:
    left, right = (re.sub(r"\(\?<(\w+)>", r"(?P<\1>", x).replace(r"\k<letter>", "(?P=letter)") for x in (rule.left, rule.right))
    return re.compile(f"(?P<l>{left})(?P<r>{right})")


#: All rules need a character beyond these.
_NONE = re.compile("[\x00-\u02ff]*")
#: What the rules of this module look at: runs of these, and what follows a run, unless that is white space.
_RUN, _TAMIL = re.compile(r"[\u0b80-\u0bff0-9]+\S?"), re.compile("[\u0b80-\u0bff]")
#: Runs that a task remembers, and how long they are at most.
REMEMBERED, RUN_CHARS = 200_000, 64


def cutter(rules: tuple[Rule, ...]):
    """A function from a text to the sorted offsets of its cuts. By this module's own rules, equal runs are cut once."""
    patterns = [_python(r) for r in rules]

    def found(text: str) -> list[int]:
        return sorted({m.start("r") for p in patterns for m in p.finditer(text)})

    if not set(rules) <= {*CORE, *AGGRESSIVE}:
        return lambda text: [] if _NONE.fullmatch(text) else found(text)
    seen: dict[str, list[int]] = {}

    def cuts(text: str) -> list[int]:
        out: list[int] = []
        if not _TAMIL.search(text):
            return out
        for m in _RUN.finditer(text):
            at = seen.get(run := m.group())
            if at is None:
                at = found(run)
                if len(run) <= RUN_CHARS:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[run] = at
            if at:
                a = m.start()
                out += [a + x for x in at]
        return out

    return cuts


def boundaries(c: Column | str, rules: tuple[Rule, ...] = CORE) -> Column:
    """Sorted distinct offsets of the cuts, in code points."""
    cuts = cutter(rules)

    @F.arrow_udf("array<int>")
    def found(s: pa.Array) -> pa.Array:
        return pa.array([cuts(t) for t in s.to_pylist()], pa.list_(pa.int32()))

    return found(_col(c))


def _col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mark(c: Column | str, lang: Column | str | None = None, rules: tuple[Rule, ...] = CORE) -> Column:
    """The text with a mark at each cut inside it; English text as it is. unmark() undoes it."""
    cuts = cutter(rules)

    @F.arrow_udf("string")
    def put(s: pa.Array) -> pa.Array:
        def one(text: str) -> str:
            at = [x for x in cuts(text) if 0 < x < len(text)]
            return MARK.join([text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]) if at else text

        return pa.array([one(t) for t in s.to_pylist()], pa.string())

    text = _col(c)
    return put(text) if lang is None else F.when(F.lower(_col(lang)).isin("en", "english"), text).otherwise(put(text))


def unmark(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(MARK), F.lit(""))


#: A change between white space and all else.
_EDGE = re.compile(r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
_SPANS = "array<struct<token:string,start:int,end:int>>"


def pieces(text: str, cuts: list[int]) -> list[tuple[str, int, int]]:
    """The pieces between the cuts and changes of white space, and where they begin and end."""
    ends = sorted({0, len(text), *cuts, *(m.start() for m in _EDGE.finditer(text))})
    return [(text[a:b], a, b) for a, b in zip(ends, ends[1:])]


def _tiled(texts: list[str], cuts) -> pa.Array:
    """pieces() of many texts at once: they tile the texts, so their tokens are the texts' own bytes between other offsets."""
    ends = np.cumsum([0, *map(len, texts)])
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, back = np.unique(points, return_inverse=True)
    space = np.array([chr(k).isspace() for k in kinds.tolist()], bool)[back]
    edge = np.zeros(len(points) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[ends] = True
    for start, text in zip(ends.tolist(), texts):
        if at := cuts(text):
            edge[np.asarray(at) + start] = True
    edges = np.flatnonzero(edge)
    first = np.searchsorted(edges, ends)  # of each text, and where the last one ends
    begin = np.repeat(ends[:-1], np.diff(first))
    encoded = whole.encode()
    bytes_at = np.append(np.flatnonzero((np.frombuffer(encoded, np.uint8) & 0xC0) != 0x80), len(encoded))
    token = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(bytes_at[edges].astype(np.int32)), pa.py_buffer(encoded))
    place = [pa.array((x - begin).astype(np.int32)) for x in (edges[:-1], edges[1:])]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([token, *place], ["token", "start", "end"]))


def spans(c: Column | str, rules: tuple[Rule, ...] = CORE) -> Column:
    """token, start, end of the pieces between all cuts and changes of white space; together they are the text."""
    cuts = cutter(rules)

    @F.arrow_udf(_SPANS)
    def found(s: pa.Array) -> pa.Array:
        return _tiled(s.to_pylist(), cuts)

    return found(_col(c))


# -- graphemes ------------------------------------------------------------------------------------------------


def clusters(lines: DataFrame, column: str = "line") -> DataFrame:
    """The distinct clusters of several code points."""
    found = lines.select(F.explode(F.regexp_extract_all(_col(column), F.lit(r"\X"), F.lit(0))).alias("cluster"))
    return found.where((F.length("cluster") > 1) & (F.col("cluster") != " ")).distinct()


def placeholder_map(lines: DataFrame, column: str = "line") -> dict[str, str]:
    """Each cluster's private-use character, in code point order. At most 6,400 rows reach the driver; more is an error."""
    rows = [r[0] for r in clusters(lines, column).orderBy("cluster").limit(MOST_PLACEHOLDERS + 1).collect()]
    if len(rows) > MOST_PLACEHOLDERS:
        raise ValueError(f"more than {MOST_PLACEHOLDERS} clusters")
    return {cluster: chr(FIRST_PLACEHOLDER + i) for i, cluster in enumerate(rows)}


def _literal(table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def substitute(c: Column | str, table: dict[str, str]) -> Column:
    mapping = _literal(table)
    return F.array_join(F.transform(F.regexp_extract_all(_col(c), F.lit(r"\X"), F.lit(0)), lambda g: F.coalesce(F.try_element_at(mapping, g), g)), "")


def restore(c: Column | str, table: dict[str, str]) -> Column:
    mapping = _literal({v: k for k, v in table.items()})
    return F.array_join(F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), lambda g: F.coalesce(F.try_element_at(mapping, g), g)), "")


def preprocess(c: Column | str, use_sandhi: bool, use_grapheme: bool, table: dict[str, str] | None = None, lang: Column | str | None = None) -> Column:
    """Boundary marks first, placeholders second; without either the text itself."""
    out = _col(c)
    if use_sandhi:
        out = mark(out, lang)
    if use_grapheme:
        out = substitute(out, table or {})
    return out


#: The grid of twelve variants: family, marks, graphemes, and whether the vocabulary is relabelled after saving.
VARIANTS = {
    f"{prefix}_{family}": {"family": family, "use_sandhi": s, "use_grapheme": g, "relabel": g and family == "unigram"}
    for prefix, s, g in (("01_metaspace_codepoint", False, False), ("02_metaspace_grapheme", False, True), ("03_sandhi_codepoint", True, False), ("04_sandhi_grapheme", True, True))
    for family in ("bert", "bpe", "unigram")
}


def variants(only: str | None = None) -> dict[str, dict]:
    """The variants, or the one named; none of that name is an error."""
    found = {k: v for k, v in VARIANTS.items() if only is None or k == only}
    if not found:
        raise ValueError(f"unknown variant {only!r}")
    return found


def preprocessor(variant: str, table: dict[str, str] | None = None, saved: bool = False):
    """The preprocessing of a variant; of a saved relabelled vocabulary, without placeholders. Unknown names are errors."""
    v = variants(variant)[variant]
    return lambda c, lang=None: preprocess(c, v["use_sandhi"], v["use_grapheme"] and not (saved and v["relabel"]), table, lang)
