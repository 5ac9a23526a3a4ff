"""Rule sets: ordered pattern-replacement pairs, folded into one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space (Java's \s knows ASCII alone).
WS = r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value: the characters of a word, beyond ASCII too; word ends are spelt with it, as \b differs among engines.
WORD = r"[\p{L}\p{N}_]"
END = rf"(?!{WORD})"

#: The words that open a block.
BLOCK_WORDS = ("def", "if", "else", "elif", "for", "while", "class", "try", "except", "finally", "with")


@dataclass(frozen=True)
class RuleSet:
    """A named list of (pattern, replacement), in Java's regular expressions, for some languages (none: for all)."""

    name: str
    rules: tuple[tuple[str, str], ...]
    languages: tuple[str, ...] = ()

    def apply(self, text: Column) -> Column:
        for pattern, replacement in self.rules:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    def serves(self, language: str) -> bool:
        return not self.languages or language in self.languages


#: Keywords as they come apart, head and tail, in the order of application; a blank run may part them.
SPLIT_KEYWORDS = (
    ("pr", "int", "print"), ("pr", "lnt", "print"), ("retur", "n", "return"), ("im", "port", "import"), ("fr", "om", "from"), ("wh", "ile", "while"),
    ("el", "if", "elif"), ("el", "se", "else"), ("ex", "cept", "except"), ("fi", "nally", "finally"), ("cl", "ass", "class"), ("ra", "nge", "range"),
    ("le", "n", "len"), ("in", "put", "input"), ("Tr", "ue", "True"), ("Fa", "lse", "False"), ("No", "ne", "None"), ("as", "sert", "assert"),
    ("la", "mbda", "lambda"), ("gl", "obal", "global"), ("yie", "ld", "yield"), ("ra", "ise", "raise"), ("con", "tinue", "continue"), ("bre", "ak", "break"),
)
#: Whole words in which rn stood for m or the like.
MISREAD_WORDS = (("returm", "return"), ("prirnt", "print"), ("irnport", "import"), ("frorn", "from"), ("randon", "random"))
#: The dashes of an arrow, in the order of application.
DASHES = ("-", "—", "–")


def rejoined(head: str, tail: str, word: str) -> tuple[str, str]:
    # Letters first: what stands before is looked at only where they do.
    return f"{head}(?<!{WORD}{head}){WS}*{tail}{END}", word


ARROWS = RuleSet("arrows", tuple((f"{WS}*{d}{WS}*>{WS}*", " -> ") for d in DASHES))
KEYWORDS = RuleSet(
    "keywords",
    (
        rejoined("de", "f", "def"),
        # A currency sign is no part of a word, so that the word must go on after it.
        (f"de(?<!{WORD}de)(?:f{END}|[£€](?={WORD}))", "def"),
        *(rejoined(*k) for k in SPLIT_KEYWORDS),
    ),
    ("python",),
)
MISREAD = RuleSet("misread", tuple((f"{a}(?<!{WORD}{a}){END}", b) for a, b in MISREAD_WORDS), ("python",))
CATALOGUE = (ARROWS, KEYWORDS, MISREAD)
