"""Correction of texts: what the engine that this one follows asserts of itself, and its known quirks."""

import random
import time
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from scribe.operators import repair
from scribe.plans.correct import correct_syntax

CASES = [
    ("valid", "print('hello world')", "python", True, ["print"], [], None),
    ("empty", "", "python", False, [], [], "notes"),
    ("blank", " \n\t", "java", False, [], [], "notes"),
    ("curly", "print(“hello”)", "python", True, ['"'], ["“", "”"], None),
    ("semicolon", "def foo();\n    pass", "python", True, ["def foo():"], [], None),
    ("dollar_js", "var $el = document.getElementById('test');", "javascript", True, ["$el"], [], None),
    ("bang_js", "if (!valid) { return false; }", "javascript", True, ["!valid"], [], None),
    ("split", "de f foo():\n    pr int('hello')", "python", True, ["def", "print"], [], None),
    ("name_js", "var de_f = 'test';", "javascript", True, ["de_f"], [], None),
    ("java", "public class Main { public static void main(String[] a) {} }", "JAVA ", True, [], [], None),
    ("cpp", '#include <iostream>\nint main() { std::cout << "hi"; }', "cpp", True, [], [], None),
    ("unfixable", "def foo(\n    if x", "python", False, [], [], "notes"),
    ("balanced", "x = (1 + 2)\nprint(x)", "python", True, ["x = (1 + 2)\nprint(x)"], [], None),
    ("backtick", "x = `hello`", "python", True, ["'hello'"], ["`"], None),
    ("backtick_js", "var x = `hello`", "javascript", True, ["'hello'"], ["`"], None),
    ("null", None, "python", False, [], [], "notes"),
    ("arrow", "def f(a) - > int:\n  return 1", "python", True, ["def f(a) -> int:\n    return 1"], [], None),
    ("triple", 's = """a\nb"""', "python", True, ['"""a\nb"""'], [], None),
]


def test_cases(spark):
    df = spark.createDataFrame([(c[0], c[1], c[2]) for c in CASES], "id string, text string, language string")
    got = {r.id: r for r in correct_syntax(df).collect()}
    assert len(got) == len(CASES)
    for name, _, _, ok, has, lacks, notes in CASES:
        r = got[name]
        assert r.ok == ok, name
        assert all(h in r.corrected for h in has) and not any(x in r.corrected for x in lacks), name
        assert (r.diagnostics is None) == (notes is None), name
        assert notes is None or all(n.message and n.suggestion is not None for n in r.diagnostics)


def test_default_language(spark):
    df = spark.createDataFrame([("if x = 1: pass", None)], "text string, language string")
    assert correct_syntax(df).first().corrected == "if x == 1: pass"


def test_nested_chain_changes_meaning_by_default():
    code = "if a:\n    if b:\n        c\n    elif d:\n        e\n    else:\n        f"
    assert repair.infer_structure(code) == code.replace("    else:", "else:")
    assert repair.infer_structure(code, strict=True) == code


def test_scans_differ_in_escapes():
    assert repair.missing_closers("'\\'(' (") == ")"
    assert repair.stray_closers("'\\')") == [3]
    assert repair.fit_brackets("x = [1, 2))") == "x = [1, 2]"


@pytest.mark.parametrize(("text", "ok"), [("x = 1", True), ("x = (", True), ("x = )", False), ("a\0b", False), ("(" * 500, False)])
def test_repair_never_raises(text, ok):
    corrected, parsed, notes = repair.repaired(text, text)
    assert parsed == ok and isinstance(corrected, str) and (notes is None or not ok)


def test_balance_notes():
    text, notes = repair.balanced_quotes("a = \"b\nc = 'd'")
    assert text == "a = \"b\"\nc = 'd'" and [n["line"] for n in notes] == [1]
    text, notes = repair.balanced_brackets("f(a\n]")
    assert text == "f(a\n)" and len(notes) == 2 and notes[1]["line"] == 2


def test_one_python_node(spark):
    df = spark.createDataFrame([("x", "python")], "text string, language string")
    plan = correct_syntax(df.select(F.col("text"), F.col("language")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1


def plain_structure(text, strict=False):
    """What infer_structure means, by looking up the lines above for each line."""
    rows = text.split("\n")
    if len(rows) < 2:
        return text
    depth = lambda row: len(row) - len(row.lstrip())
    words = {"def", "if", "else", "elif", "for", "while", "class", "try", "except", "finally", "with"}
    for i, row in enumerate(rows):
        bare = row.lstrip()
        if not bare:
            continue
        if bare.startswith(repair.CLOSERS):
            kind, hidden = ("if " if bare[:4] in ("else", "elif") else "try:"), 0
            for above in rows[:i][::-1]:
                if above.lstrip().startswith(repair.CLOSERS) and not strict:
                    hidden += 1
                elif above.lstrip().startswith(kind) and (not strict or depth(above) <= depth(row)):
                    if not hidden:
                        rows[i] = " " * depth(above) + bare if depth(above) != depth(row) else row
                        break
                    hidden -= 1
        elif i and (opener := rows[i - 1].strip()).endswith(":") and depth(row) <= depth(rows[i - 1]):
            if any(opener.startswith(w) and not opener[len(w)].isalnum() for w in words):
                rows[i] = " " * (depth(rows[i - 1]) + 4) + bare
    return "\n".join(rows)


LINES = ["if x:", "if x", "else:", "elif y:", "try:", "except:", "except E:", "finally:", "x = 1", "def f():", "while 1:", "else :", "", "   ", "if_ x:", "format:", "with:", "class A:  "]


def test_structure_matches_a_search_for_each_line():
    draw = random.Random(3)
    for _ in range(4000):
        text = "\n".join(" " * draw.choice([0, 0, 2, 4, 8]) + draw.choice(LINES) for _ in range(draw.randint(1, 12)))
        for strict in (False, True):
            assert repair.infer_structure(text, strict) == plain_structure(text, strict)


def test_repairs_are_linear():
    took = []
    for n in (4_000, 32_000):
        text = "\n".join(["if x:", "    y", "else:", "    z"] * n + ["}"] * n)
        at = time.thread_time()
        repair.infer_structure(text)
        repair.infer_structure(text, strict=True)
        repair.balanced_brackets(text)
        took.append(time.thread_time() - at)
    assert took[1] < 24 * took[0] + 0.2


def quote_ends(line):
    """The quotes left odd, by taking out escaped pairs from the left."""
    bare = "".join(p for i, p in enumerate(line.replace("\\\\", "").split("\\")) for p in ([p] if not i else [p[1:]]))
    return [q for q in "\"'" if bare.count(q) % 2]


def test_fixes_on_every_line():
    draw = random.Random(9)
    parts = ["if x", "def f()", "x = 'a", 'y = "b', "else", "while (a", "'c'", "\\'", "\\\\", " ", "  for", "iffy", ":"]
    for _ in range(1500):
        rows = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 4))) for _ in range(draw.randint(1, 6))]
        text = "\n".join(rows)
        for number in (None, -1, 0, *range(1, len(rows) + 2)):
            colon, string = list(rows), list(rows)
            if number and 1 <= number <= len(rows):
                row = rows[number - 1]
                word = "".join(takewhile(lambda c: c.isalnum() or c == "_", row.lstrip()))
                if word in {"def", "if", "else", "elif", "for", "while", "class", "try", "except", "finally", "with"} and not row.rstrip().endswith(":"):
                    colon[number - 1] = row.rstrip() + ":"
                if odd := quote_ends(row):
                    string[number - 1] = row.rstrip() + odd[0]
            assert repair.close_colon(text, number) == "\n".join(colon)
            assert repair.close_string(text, number) == "\n".join(string)
