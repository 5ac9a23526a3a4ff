"""Functions of lines and of outputs: quotes, blocks, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribe.functions.clean import lines_of
from scribe.functions.rules import BLOCK_WORDS, WS

#: How lines begin that go on with a block, the longest text that is shown and the mark of what was cut.
CLOSERS = ("else:", "else :", "elif ", "except:", "except ", "finally:")
MOST_OUTPUT, CUT_MARK = 10_000, "[...output truncated]"


def is_block_starter(line: Column) -> Column:
    """A block word, then nothing or something that is neither letter nor digit."""
    return line.rlike(rf"^(?:{'|'.join(BLOCK_WORDS)})(?![\p{{L}}\p{{N}}])")


def is_block_closer(line: Column) -> Column:
    out = F.lit(False)
    for start in CLOSERS:
        out = out | F.startswith(line, F.lit(start))
    return out


def without_escapes(line: Column) -> Column:
    return F.regexp_replace(line, r"(?d)\\.", "")


def odd_quotes(line: Column, quote: str) -> Column:
    bare = without_escapes(line)
    return (F.length(bare) - F.length(F.replace(bare, F.lit(quote), F.lit("")))) % 2 == 1


def balance_quotes(text: Column) -> Column:
    """Closes, in each line, the double and then the single quotes that stand an odd number of times."""

    def closed(line: Column, quote: str) -> Column:
        return F.when(odd_quotes(line, quote), F.concat(F.regexp_replace(line, f"{WS}+\\z", ""), F.lit(quote))).otherwise(line)

    double = F.transform(lines_of(text), lambda x: closed(x, '"'))
    return F.array_join(F.transform(double, lambda x: closed(x, "'")), "\n")


def truncated(text: Column) -> Column:
    return F.when(F.length(text) > MOST_OUTPUT, F.concat(F.substring(text, 1, MOST_OUTPUT), F.lit(CUT_MARK))).otherwise(text)


def is_truncated(text: Column) -> Column:
    return F.length(text) > MOST_OUTPUT


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1 << 20)))


def escaped_html(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out
