"""Cleaning of transcribed source text: line ends, tabs, indentation, characters read wrongly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribe.functions.rules import BLOCK_WORDS, CATALOGUE, END, WS

IDENT, IDENT_OR_DIGIT = "[A-Za-z_]", "[A-Za-z_0-9]"
#: Nine quotation marks and the backtick, and what each becomes.
QUOTES, PLAIN = "‘’′ʼ“”«»″`", "''''\"\"\"\"\"'"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def by_line(text: Column, change) -> Column:
    """Applies a function of a line to each line."""
    return F.array_join(F.transform(lines_of(text), change), "\n")


def norm_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def expand_tabs(text: Column, width: int = 4) -> Column:
    """Each tab reaches to the next multiple of width in its line."""

    def line(x: Column) -> Column:
        parts = F.split(x, "\t", -1)
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.aggregate(rest, F.get(parts, 0), lambda held, part: F.concat(held, F.repeat(F.lit(" "), width - F.length(held) % width), part))

    return F.when(F.contains(text, F.lit("\t")), by_line(text, line)).otherwise(text)


def rstrip_lines(text: Column) -> Column:
    return by_line(text, lambda x: F.regexp_replace(x, f"{WS}+\\z", ""))


def blank(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+", "") == ""


def leading(x: Column) -> Column:
    """How many spaces begin a line."""
    return F.length(x) - F.length(F.ltrim(x))


def reindent(text: Column, width: int = 4) -> Column:
    """Scales indentation so that its smallest step becomes width; both roundings are to even."""
    steps = F.filter(F.transform(lines_of(text), lambda x: F.when(~blank(x), leading(x)).otherwise(F.lit(0))), lambda n: n > 0)
    least = F.array_min(steps)

    def line(x: Column, m: Column) -> Column:
        scaled = F.bround(leading(x).cast("double") * (F.lit(float(width)) / m))
        snapped = (F.bround(scaled / width) * width).cast("int")
        return F.when(blank(x), F.lit("")).when(leading(x) > 0, F.concat(F.repeat(F.lit(" "), snapped), F.ltrim(x))).otherwise(x)

    # The smallest step is bound once, as the only element of an array.
    scaled = F.get(F.transform(F.array(least), lambda m: F.array_join(F.transform(lines_of(text), lambda x: line(x, m)), "\n")), 0)
    return F.when(least.isNull() | (least == width), text).otherwise(scaled)


def whitespace(text: Column) -> Column:
    return reindent(rstrip_lines(expand_tabs(norm_newlines(text))))


def fold_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, PLAIN)


def inverted_bang(text: Column) -> Column:
    first = F.regexp_replace(text, f"(?<={IDENT})¡(?={IDENT_OR_DIGIT})", "i")
    return F.regexp_replace(first, rf"(?<=[\p{{L}}\p{{N}}_])¡(?={IDENT_OR_DIGIT})", "i")


def numeric_confusions(text: Column) -> Column:
    """In tokens with a digit, O is 0, and l or I beside a digit is 1."""
    pieces = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_.]+|[^A-Za-z0-9_.]+"), 0)

    def token(x: Column) -> Column:
        out = F.replace(x, F.lit("O"), F.lit("0"))
        for pattern in ("(?<=[0-9])l", "l(?=[0-9])", "(?<=[0-9])I", "I(?=[0-9])"):
            out = F.regexp_replace(out, pattern, "1")
        return F.when(x.rlike("[0-9]"), out).otherwise(x)

    return F.array_join(F.transform(pieces, token), "")


def semicolon_colon(text: Column) -> Column:
    return F.regexp_replace(text, f"(?dm)^({WS}*(?:{'|'.join(BLOCK_WORDS)}){END}.+);{WS}*$", "$1:")


def brace_paren(text: Column) -> Column:
    opened = F.regexp_replace(text, r"((?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]*)\{", "$1(")
    return F.regexp_replace(opened, r"(?<=\()([^{}]*)\}", "$1)")


def pipe_in_ident(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<={IDENT})\|(?={IDENT})", "l")


def dollar_in_ident(text: Column) -> Column:
    inside = F.regexp_replace(text, rf"(?<={IDENT})\$(?={IDENT_OR_DIGIT})", "S")
    return F.regexp_replace(inside, rf"\$(?={IDENT})", "S")


def bang_in_ident(text: Column) -> Column:
    return F.regexp_replace(text, f"(?<={IDENT})!(?={IDENT_OR_DIGIT})", "l")


def equality_fix(text: Column) -> Column:
    def line(x: Column) -> Column:
        return F.when(x.rlike(f"^{WS}*(?:if|elif|while){END}"), F.regexp_replace(x, "(?<![=!<>:]) = (?!=)", " == ")).otherwise(x)

    return by_line(text, line)


def correction(text: Column, language: str) -> Column:
    """All corrections short of parsing, for one language, in their order."""
    text = whitespace(text)
    for rules in CATALOGUE:
        if rules.serves(language):
            text = rules.apply(text)
    text = numeric_confusions(inverted_bang(fold_quotes(text)))
    if language == "python":
        for fix in (semicolon_colon, brace_paren, pipe_in_ident, dollar_in_ident, bang_in_ident, equality_fix):
            text = fix(text)
    return text
