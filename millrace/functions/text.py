"""Column functions on text. Each takes a column (or its name) and returns a column; nulls act as empty text."""

from __future__ import annotations

import re
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..profiles import LATIN, WS, WS_CHARS, ScriptProfile


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(_text(c), WS), lambda x: x != "")


def strip(c: Column | str) -> Column:
    return F.btrim(_text(c), F.lit(WS_CHARS))


def extract_words(c: Column | str, profile: ScriptProfile = LATIN, fuse: bool = False) -> Column:
    """The profile's words, numbers and marks. Foreign runs part their neighbours, or with fuse let them join."""
    return F.regexp_extract_all(F.regexp_replace(_text(c), profile.strip, "" if fuse else " "), F.lit(profile.word), F.lit(0))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def has_script(c: Column | str, profile: ScriptProfile = LATIN) -> Column:
    return _text(c).rlike(profile.letters)


#: White space and all else, as Python's patterns have them.
_S, _NOT_S = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
# What counts as markup, a link, an address or an entity.
WIKI_STEPS = (
    *[(r"\{\{[^{}]*\}\}", "")] * 3,
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]+>", ""),
    (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
    (rf"(?U)\[https?://{_NOT_S}+{_S}+([^\]]*)\]", "$1"),
    (rf"(?U)\[https?://{_NOT_S}+\]", ""),
    (r"'''|''", ""),
    (rf"(?mdU)^=+{_S}*|{_S}*=+$", ""),
)
URL = rf"(?U)https?://{_NOT_S}+"
ENTITY = r"&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);"
#: A match begins where a run of an address's characters does, or where the last match ended.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def _steps(c: Column, steps) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def clean_wiki(c: Column | str) -> Column:
    """Wiki markup to text: templates (three levels), references, comments, tags, links, emphasis, headings."""
    return strip(_steps(_text(c), WIKI_STEPS))


def clean_web(c: Column | str, profile: ScriptProfile = LATIN) -> Column:
    """Links and entities dropped, the profile's words joined by single spaces."""
    return joined(extract_words(_steps(_text(c), ((URL, ""), (ENTITY, ""))), profile))


def literary_words(c: Column | str, profile: ScriptProfile = LATIN) -> Column:
    """As clean_web, with addresses dropped too; an array."""
    return extract_words(_steps(_text(c), ((URL, ""), (EMAIL, ""), (ENTITY, ""))), profile)


def strip_web(c: Column | str) -> Column:
    """Links and entities alone dropped."""
    return _steps(_text(c), ((URL, ""), (ENTITY, "")))


def chunks(c: Column | str) -> Column:
    """Parts between blank lines and after sentence ends."""
    return F.split(_text(c), r"(?U)\n{2,}|(?<=[.!?])\s+")


def content_ratio(c: Column | str, profile: ScriptProfile = LATIN) -> Column:
    """Share of tokens that hold a letter of the script; 0 without tokens."""
    share = lambda t: F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda x: x.rlike(profile.real_word))) / F.size(t))
    return F.get(F.transform(F.array(tokens(c)), share), F.lit(0))  # the line is split once


#: Tokens that a task remembers, and how long they are at most.
REMEMBERED, TOKEN_CHARS = 200_000, 64


def _python(pattern: str) -> re.Pattern:
    """A profile's pattern, in Python's spelling of code points."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]{4})\}", r"\\u\1", pattern))


class _Tokens:
    """words: of a token, its words joined by single spaces; real: the tokens that hold a letter of the script. Those of a batch are looked at together."""

    def __init__(self, profile: ScriptProfile, letters: dict[int, str]):
        self.letters = letters
        self.strip, self.word, self.letter = map(_python, (profile.strip, rf"{profile.word}|\n", profile.real_word))
        self.words: dict[str, str] = {}
        self.real: set[str] = set()

    def meet(self, tokens: set[str]) -> None:
        """Know these tokens, and as many of those before as are remembered."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.real.clear()
        fresh = [*tokens.difference(self.words)]
        shown = "\n".join(fresh).translate(self.letters)  # no token holds white space
        words = " ".join(self.word.findall(self.strip.sub(" ", shown))).split("\n")
        self.words.update(zip(fresh, [w.strip(" ") for w in words]))
        self.real.update([t for t, x in zip(fresh, shown.split("\n")) if self.letter.search(x)])

    def forget(self, tokens: set[str]) -> None:
        """Endless tokens aren't remembered."""
        for t in [t for t in tokens if len(t) > TOKEN_CHARS]:
            del self.words[t]
            self.real.discard(t)


def words_and_ratio(c: Column | str, profile: ScriptProfile = LATIN, letters: dict[int, str] | None = None) -> Column:
    """words, ratio: joined(extract_words()) and content_ratio() of a line by one pass, in which a task remembers tokens.

    No word reaches over white space, so a line's words are those of its tokens. letters: what is put for a letter
    before, as str.translate() has it; no white space.
    """
    held: list[_Tokens] = []

    @F.arrow_udf("struct<words:string,ratio:double>")
    def found(s: pa.Array) -> pa.Array:
        if not held:
            held.append(_Tokens(profile, letters or {}))
        known, lines = held[0], [line.split() for line in s.to_pylist()]
        tokens = set(chain.from_iterable(lines))
        known.meet(tokens)
        words, real = known.words.__getitem__, known.real.__contains__
        joined_ = pa.array([" ".join(filter(None, map(words, t))) for t in lines], pa.string())
        ratios = pa.array([sum(map(real, t)) / len(t) if t else 0.0 for t in lines], pa.float64())
        known.forget(tokens)
        return pa.StructArray.from_arrays([joined_, ratios], ["words", "ratio"])

    return found(_text(c))


def disallowed_chars(c: Column | str, profile: ScriptProfile = LATIN) -> Column:
    return F.regexp_count(_text(c), F.lit(profile.disallowed))


def non_alpha_chars(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(r"[\p{N}\p{P}\p{S}]"))


def orphaned_mark(c: Column | str) -> Column:
    """A combining mark at the start, or after white space or a control or format character."""
    return _text(c).rlike(r"(?U)(?:^|[\s\p{Cc}\p{Cf}])\p{M}")


def anomaly(c: Column | str) -> Column:
    """Why a line is anomalous, or null."""
    return F.when(_text(c).contains("�"), "replacement char").when(orphaned_mark(c), "orphaned mark")


def collapse_punctuation(c: Column | str) -> Column:
    """Runs of , . ' - become one; ! and ? stay."""
    return _steps(_text(c), ((r",+", ","), (r"\.+", "."), (r"'+", "'"), (r"-+", "-")))


def tighten_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"(?U)\s+([,!?\"\-%'.])", "$1")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode's composed form; Spark has no function for it."""
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else "")


def not_composed(c: Column | str) -> Column:
    """Whether the text differs from its composed form: an earlier definition of an anomaly."""
    return nfc(c) != _text(c)


def normalise(c: Column | str) -> Column:
    """Stripped, composed, with runs of marks collapsed."""
    return collapse_punctuation(nfc(strip(c)))


def graphemes(c: Column | str) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(_text(c), F.lit(r"\X"), F.lit(0))


def digest(c: Column | str) -> Column:
    return F.sha2(_text(c), 256)
