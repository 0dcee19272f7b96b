"""What a script's operators need to know of it."""

from __future__ import annotations

from dataclasses import dataclass

#: White space as Python's str.split() has it; Java's class lacks U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]+"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
PUNCTUATION = ",!?\"-%'"


@dataclass(frozen=True)
class ScriptProfile:
    """letter: inside of a character class; strip: what becomes one space before words are found."""

    name: str
    letter: str
    strip: str
    lang: str

    @property
    def letters(self) -> str:
        return f"[{self.letter}]"

    @property
    def word(self) -> str:
        """A run of letters joined by single dots, a number, or one mark."""
        return rf"[{self.letter}]+(?:\.[{self.letter}]+)*|[0-9]+(?:\.[0-9]+)?|[,!?\"\-%']"

    @property
    def real_word(self) -> str:
        return rf"[{self.letter}]"

    @property
    def disallowed(self) -> str:
        return rf"(?U)[^{self.letter}\s\x1c-\x1f0-9,!?\"\-%'.]"


TAMIL = ScriptProfile("tamil", r"\x{0B80}-\x{0BFF}", "[A-Za-z]+", "ta")
LATIN = ScriptProfile("latin", "A-Za-zÀ-ÖØ-öø-ÿ", r"[\x{0B80}-\x{0BFF}]+", "en")
PROFILES = {p.name: p for p in (TAMIL, LATIN)}
