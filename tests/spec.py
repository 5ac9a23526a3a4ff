"""A specification of the cleaning steps, letter by letter, for comparison: no regular expressions."""

from decimal import ROUND_HALF_EVEN, Decimal

OPENING = {"def", "if", "else", "elif", "for", "while", "class", "try", "except", "finally", "with"}
LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
DIGITS = set("0123456789")


def wordy(c):
    """A word's character, in any script; the empty string stands for a text's ends."""
    return c == "_" or c.isalnum()


def char(t, i):
    return t[i] if 0 <= i < len(t) else ""


def past_blanks(t, i):
    while char(t, i).isspace():
        i += 1
    return i


def newlines(t):
    out = ""
    for i, c in enumerate(t):
        if c == "\r":
            out += "\n"
        elif c != "\n" or char(t, i - 1) != "\r":
            out += c
    return out


def tabs(t):
    out, column = "", 0
    for c in t:
        wide = 4 - column % 4 if c == "\t" else 1
        out += " " * wide if c == "\t" else c
        column = 0 if c in "\n\r" else column + wide
    return out


def rstrip(t):
    out = []
    for row in t.split("\n"):
        end = len(row)
        while end and row[end - 1].isspace():
            end -= 1
        out.append(row[:end])
    return "\n".join(out)


def whole(x):
    return int(Decimal(x).quantize(Decimal(1), ROUND_HALF_EVEN))


def reindent(t):
    rows = []
    for row in t.split("\n"):
        lead = 0
        while char(row, lead) == " ":
            lead += 1
        rows.append((lead, row[lead:]))
    step = min([lead for lead, rest in rows if lead and rest.strip()], default=4)
    if step == 4:
        return t
    scale = 4.0 / step
    return "\n".join(" " * 4 * whole(whole(lead * scale) / 4) + rest if rest.strip() else "" for lead, rest in rows)


def arrows(t):
    for dash in ("-", "—", "–"):
        out, fixed, i = "", 0, 0  # fixed: how much of out is an arrow's already
        while i < len(t):
            head = past_blanks(t, i + 1)
            if t[i] == dash and char(t, head) == ">":
                while len(out) > fixed and out[-1].isspace():
                    out = out[:-1]
                out += " -> "
                fixed, i = len(out), past_blanks(t, head + 1)
            else:
                out += t[i]
                i += 1
        t = out
    return t


def rejoin(t, head, tail, word):
    out, i = "", 0
    while i < len(t):
        if t.startswith(head, i) and not wordy(char(t, i - 1)):
            at = past_blanks(t, i + len(head))
            if t.startswith(tail, at) and not wordy(char(t, at + len(tail))):
                out += word
                i = at + len(tail)
                continue
        out += t[i]
        i += 1
    return out


def keywords(t, pairs):
    t = rejoin(t, "de", "f", "def")
    out, i = "", 0
    while i < len(t):
        sign = char(t, i + 2)
        ends = wordy(char(t, i + 3)) != wordy(sign)  # a word ends or begins behind the sign
        if t.startswith("de", i) and not wordy(char(t, i - 1)) and sign and sign in "£€f" and ends:
            out += "def"
            i += 3
        else:
            out += t[i]
            i += 1
    for head, tail, word in pairs:
        out = rejoin(out, head, tail, word)
    return out


def numbers(t):
    def token(x):
        if not DIGITS & set(x):
            return x
        x = ["0" if c == "O" else c for c in x]
        for letter in "lI":
            for side in (-1, 1):
                x = ["1" if c == letter and char(x, i + side) in DIGITS else c for i, c in enumerate(x)]
        return "".join(x)

    out, held = "", ""
    for c in t:
        if c in LETTERS or c in DIGITS or c == ".":
            held += c
        else:
            out += token(held) + c
            held = ""
    return out + token(held)


def first_word(row):
    bare = row.lstrip()
    end = 0
    while wordy(char(bare, end)):
        end += 1
    return bare[:end], bare[end:]


def semicolon(t):
    """Rows are read on; blank rows behind a mended one are eaten up to the last of them."""
    rows, out, i = t.split("\n"), [], 0
    while i < len(rows):
        row = rows[i]
        word, rest = first_word(row)
        bare = row.rstrip()
        i += 1
        if word in OPENING and bare.endswith(";") and len(rest.rstrip()) > 1:
            row = bare[:-1] + ":"
            while i < len(rows) and not rows[i].strip():
                i += 1
        out.append(row)
    return "\n".join(out)


def braces(t):
    out = ""
    for i, c in enumerate(t):
        at = i
        while char(t, at - 1) in LETTERS | DIGITS and at:
            at -= 1
        named = c == "{" and at < i and t[at] in LETTERS and not wordy(char(t, at - 1))
        out += "(" if named else c
    t, out, open_ = out, "", False
    for c in t:
        out += ")" if c == "}" and open_ else c
        open_ = c == "(" or open_ and c not in "{}"
    return out


def swapped(t, old, new, fits):
    return "".join(new if c == old and fits(char(t, i - 1), char(t, i + 1)) else c for i, c in enumerate(t))


def pipe(t):
    return swapped(t, "|", "l", lambda a, b: a in LETTERS and b in LETTERS)


def dollar(t):
    t = swapped(t, "$", "S", lambda a, b: a in LETTERS and b in LETTERS | DIGITS)
    return swapped(t, "$", "S", lambda a, b: b in LETTERS)


def bang(t):
    return swapped(t, "!", "l", lambda a, b: a in LETTERS and b in LETTERS | DIGITS)


def inverted(t):
    t = swapped(t, "¡", "i", lambda a, b: a in LETTERS and b in LETTERS | DIGITS)
    return swapped(t, "¡", "i", lambda a, b: wordy(a) and b in LETTERS | DIGITS)


def equality(t):
    def mended(row):
        out, i = "", 0
        while i < len(row):
            lone = row.startswith(" = ", i) and char(row, i + 3) != "=" and char(row, i - 1) not in set("=!<>:")
            out += " == " if lone else row[i]
            i += 3 if lone else 1
        return out

    return "\n".join(mended(row) if first_word(row)[0] in ("if", "elif", "while") else row for row in t.split("\n"))
