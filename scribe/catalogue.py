"""Query catalogue of the correction engine: each query over whole tables, and the SQL that says the same.

The driver's tables hold few of the marks that rules mend, so text queries first smudge the texts: plain replacements, the
same in both engines. Regular expressions of the SQL know no lookaround: they capture what stands beside and run twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.functions import clean, lines, rules
from scribe.operators import gate, layout, limiter, repair
from scribe.plans.correct import correct_syntax
from scribe.plans.evaluate import evaluate
from scribe.sources import history
from scribe.streaming.limiter import admit_stream, run_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_WS = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_WORD = r"\p{L}\p{N}_"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, smudge: list[tuple[str, str]], name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    out = F.coalesce(F.col(text), F.lit(""))
    for a, b in smudge:
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), out.alias("text"))


def sql_texts(smudge: list[tuple[str, str]], name: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    out = f"coalesce({text}, '')"
    for a, b in smudge:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"(SELECT {key} AS id, {out} AS text FROM {name})"


def rewritten(expr: str, pattern: str, to: str, times: int = 1) -> str:
    for _ in range(times):
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return expr


def text_query(name: str, change: Callable[[Column], Column], smudge: list[tuple[str, str]], sql: Callable[[str], str]) -> None:
    """A query of one text function over smudged documents: id, out, changed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = texts(spark, sf_dir, smudge).withColumn("out", change(F.col("text")))
        return rows.select("id", "out", (F.col("out") != F.col("text")).alias("changed"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT id, {sql('text')} AS out, ({sql('text')}) <> text AS changed FROM {sql_texts(smudge)}"


def per_line(expr: str, body: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, chr(10)), lambda l: {body}), chr(10))"


def whole_words(expr: str, pairs) -> str:
    for core, to in pairs:
        expr = rewritten(expr, f"(^|[^{SQL_WORD}]){core}($|[^{SQL_WORD}])", rf"\1{to}\2", 2)
    return expr


# --- white space

LF, CRLF, CR, TAB = "\n", "\r\n", "\r", "\t"
text_query("norm_newlines", clean.norm_newlines, [(".\n", ".\r\n"), (", ", ",\r")], lambda t: f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
text_query(
    "expand_tabs", clean.expand_tabs, [(", ", "\t"), (".\n", ".\n\t\t")],
    lambda t: per_line(t, "list_reduce(string_split(l, chr(9)), lambda a, s: a || repeat(' ', 4 - length(a) % 4) || s)"),
)
text_query("rstrip_lines", clean.rstrip_lines, [(".\n", ". \t \n"), (",", ", ")], lambda t: per_line(t, f"regexp_replace(l, {quoted(SQL_WS + '+$')}, '')"))


def sql_reindent(t: str) -> str:
    lead = "(length(l) - length(ltrim(l, ' ')))"
    blank = f"(regexp_replace(l, {quoted('^' + SQL_WS + '+')}, '') = '')"
    m = f"list_min(list_filter(list_transform(string_split({t}, chr(10)), lambda l: CASE WHEN {blank} THEN 0 ELSE {lead} END), lambda n: n > 0))"
    snapped = f"CAST(round_even(round_even({lead}::DOUBLE * (4.0::DOUBLE / {m}), 0) / 4.0::DOUBLE, 0) * 4 AS INTEGER)"
    body = f"CASE WHEN {blank} THEN '' WHEN {lead} > 0 THEN repeat(' ', {snapped}) || ltrim(l, ' ') ELSE l END"
    return f"CASE WHEN {m} IS NULL OR {m} = 4 THEN {t} ELSE {per_line(t, body)} END"


text_query("reindent", clean.reindent, [(".\nT", ".\n   T"), (".\nA", ".\n     A"), (".\nE", ".\n  E"), ("\nS", "\n   \nS")], sql_reindent)

# --- rules

text_query(
    "arrow_rules", rules.ARROWS.apply, [(" the ", " - > "), (" of ", "\n—>  "), (" la ", "-->"), (" der ", " –\t> ")],
    lambda t: rewritten(rewritten(rewritten(t, f"{SQL_WS}*-{SQL_WS}*>{SQL_WS}*", " -> "), f"{SQL_WS}*—{SQL_WS}*>{SQL_WS}*", " -> "), f"{SQL_WS}*–{SQL_WS}*>{SQL_WS}*", " -> "),
)


def sql_keywords(t: str) -> str:
    # A word that is whole already must not match: it would use up the blank before the next one on every run.
    first = rewritten(whole_words(t, [(f"de{SQL_WS}+f", "def")]), f"(^|[^{SQL_WORD}])de[£€]([{SQL_WORD}])", r"\1def\2", 2)
    return whole_words(first, [(f"{a}{SQL_WS}{'+' if a + b == w else '*'}{b}", w) for a, b, w in rules.SPLIT_KEYWORDS])


text_query("keyword_rules", rules.KEYWORDS.apply, [(" the ", " de f "), (" of ", " pr int in put "), (" to ", " Tr\nue "), (" la ", " retur  n "), (" de ", " de£x el se "), ("é", "éin put ")], sql_keywords)
text_query("rn_rules", rules.MISREAD.apply, [(" the ", " returm prirnt "), (" of ", " frorn, "), (" la ", " randon\n"), (" der ", " birnport irnport ")], lambda t: whole_words(t, rules.MISREAD_WORDS))

# --- characters

text_query(
    "fold_quotes", clean.fold_quotes, [(" the ", " ‘the’ "), (" la ", " “la” «x» "), (" der ", " `der′ ″ʼ ")],
    lambda t: f"translate({t}, {quoted(clean.QUOTES)}, {quoted(clean.PLAIN)})",
)
text_query(
    "inverted_bang", clean.inverted_bang, [("on", "¡n"), ("é", "é¡x"), ("de", "d¡¡e")],
    lambda t: rewritten(rewritten(t, "([A-Za-z_])¡([A-Za-z_0-9])", r"\1i\2", 2), f"([{SQL_WORD}])¡([A-Za-z_0-9])", r"\1i\2", 2),
)


def sql_numbers(t: str) -> str:
    token = "replace(l, 'O', '0')"
    for pattern, to in (("([0-9])l", r"\11"), ("l([0-9])", r"1\1"), ("([0-9])I", r"\11"), ("I([0-9])", r"1\1")):
        token = rewritten(token, pattern, to)
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z0-9_.]+|[^A-Za-z0-9_.]+'), lambda l: CASE WHEN regexp_matches(l, '[0-9]') THEN {token} ELSE l END), ''), '')"


text_query("numeric_confusions", clean.numeric_confusions, [("an", "1O"), (" th", " 0.O5l"), ("er", "l2I"), ("en", "3ll")], sql_numbers)
text_query(
    "semicolon_colon", clean.semicolon_colon, [(".\nT", ";\nif T"), (".\nA", ";  \n\n  def A"), (".\n", ";\nelse\n")],
    lambda t: rewritten(t, f"(?m)^({SQL_WS}*(?:{'|'.join(rules.BLOCK_WORDS)})[^{SQL_WORD}\\n].*);{SQL_WS}*$", r"\1:"),
)
text_query(
    "brace_paren", clean.brace_paren, [(" th", "{th"), (" o", "}o"), ("é", "é{"), (" la ", " (la} ")],
    lambda t: rewritten(rewritten(t, f"(^|[^{SQL_WORD}])([A-Za-z_][A-Za-z0-9_]*)\\{{", r"\1\2(", 2), r"\(([^{}]*)\}", r"(\1)"),
)
text_query("pipe_in_ident", clean.pipe_in_ident, [("ol", "o|l"), ("en", "e|n"), ("th", "t|h"), (" o", " | o")], lambda t: rewritten(t, r"([A-Za-z_])\|([A-Za-z_])", r"\1l\2", 2))
text_query(
    "dollar_in_ident", clean.dollar_in_ident, [("st", "$t"), (" th", " $th"), ("er", "$$e"), ("en", "e$3")],
    lambda t: rewritten(rewritten(t, r"([A-Za-z_])\$([A-Za-z_0-9])", r"\1S\2", 2), r"\$([A-Za-z_])", r"S\1"),
)
text_query("bang_in_ident", clean.bang_in_ident, [("ol", "o!"), ("le", "!e"), ("en", "e!!n"), (" la ", " a != 3 ")], lambda t: rewritten(t, "([A-Za-z_])!([A-Za-z_0-9])", r"\1l\2", 2))


def sql_equality(t: str) -> str:
    fixed = rewritten(rewritten("l", r"([^=!<>:]) = ([^=])", r"\1 == \2", 2), r"([^=!<>:]) = $", r"\1 == ")
    return per_line(t, f"CASE WHEN regexp_matches(l, {quoted(f'^{SQL_WS}*(?:if|elif|while)($|[^{SQL_WORD}])')}) THEN {fixed} ELSE l END")


text_query("equality_fix", clean.equality_fix, [(".\nT", ".\nif T"), (".\nA", ".\n  while A"), (", ", " = "), (" the ", " != = "), (" of ", " == ")], sql_equality)

# --- lines

LINES = [(".\nT", ".\nif T"), (".\nA", ".\nelse: A"), (".\nE", ".\ntry_E"), (" the ", ' "the '), (" of ", " \\'of' ")]


@query(
    "block_line_flags",
    f"""SELECT id, line_no, regexp_matches(line, {quoted(f"^(?:{'|'.join(rules.BLOCK_WORDS)})($|[^" + chr(92) + "p{L}" + chr(92) + "p{N}])")}) AS starter,
    {" OR ".join(f"starts_with(line, {quoted(c)})" for c in lines.CLOSERS)} AS closer
    FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {sql_texts(LINES)})""",
)
def block_line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, LINES).select("id", F.posexplode(clean.lines_of(F.col("text"))).alias("k", "line"))
    return rows.select("id", (F.col("k") + 1).cast("long").alias("line_no"), lines.is_block_starter(F.col("line")).alias("starter"), lines.is_block_closer(F.col("line")).alias("closer"))


def sql_odd(line: str, quote: str) -> str:
    bare = f"regexp_replace({line}, {quoted(chr(92) * 2 + '.')}, '', 'g')"
    return f"((length({bare}) - length(replace({bare}, {quoted(quote)}, ''))) % 2 = 1)"


@query(
    "quote_parity",
    f"""SELECT id, count(*) FILTER ({sql_odd("line", '"')}) AS odd_double, count(*) FILTER ({sql_odd("line", "'")}) AS odd_single
    FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM {sql_texts(LINES)}) GROUP BY id""",
)
def quote_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lambda q: F.size(F.filter(clean.lines_of(F.col("text")), lambda x: lines.odd_quotes(x, q))).cast("long")
    return texts(spark, sf_dir, LINES).select("id", odd('"').alias("odd_double"), odd("'").alias("odd_single"))


def sql_closed(line: str, quote: str) -> str:
    return f"CASE WHEN {sql_odd(line, quote)} THEN regexp_replace({line}, {quoted(SQL_WS + '+$')}, '') || {quoted(quote)} ELSE {line} END"


def sql_balanced(t: str) -> str:
    return f"array_to_string(list_transform(list_transform(string_split({t}, chr(10)), lambda l: {sql_closed('l', chr(34))}), lambda l: {sql_closed('l', chr(39))}), chr(10))"


text_query("balance_quotes", lines.balance_quotes, LINES, sql_balanced)


@query(
    "truncate_output",
    f"""SELECT doc_id, CASE WHEN length(t) > {lines.MOST_OUTPUT} THEN substr(t, 1, {lines.MOST_OUTPUT}) || {quoted(lines.CUT_MARK)} ELSE t END AS out,
    length(t) > {lines.MOST_OUTPUT} AS truncated, length(t) AS original_length FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def truncate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", lines.truncated(t).alias("out"), lines.is_truncated(t).alias("truncated"), F.length(t).cast("long").alias("original_length"))


# --- history

EVALUATIONS = """(SELECT 'r' || event_id AS request_id, date_trunc('minute', ts) AS timestamp, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'timeout' END AS execution_status,
    event_type AS language, coalesce(value, 0.0) AS processing_time FROM events)"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "success").when(F.col("event_id") % 3 == 1, "error").otherwise("timeout")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), "event_id").alias("request_id"), F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("timestamp"), status.alias("execution_status"), F.col("event_type").alias("language"), F.coalesce("value", F.lit(0.0)).alias("processing_time"),
    )


def stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


SQL_STAMPED = "request_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, execution_status, language, processing_time"


@query("history_recent", f"SELECT {SQL_STAMPED} FROM {EVALUATIONS} ORDER BY timestamp DESC NULLS LAST, request_id LIMIT {history.TOP}")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(history.recent(evaluations(spark, sf_dir)))


@query("history_lookup", f"SELECT {SQL_STAMPED} FROM {EVALUATIONS} WHERE request_id = 'r42'")
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(history.lookup(evaluations(spark, sf_dir), "r42"))


@query(
    "history_log_projection",
    f"""SELECT 'r' || doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS auto_corrected, substr(coalesce(text, ''), 1, {history.KEPT}) AS recognized_text,
    substr('fixed ' || coalesce(text, ''), 1, {history.KEPT}) AS corrected_text, '' AS stdout, substr(coalesce(source, ''), 1, {history.KEPT}) AS stderr,
    coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'java' END, 'python') AS language, 'subprocess' AS sandbox_mode, round_even(n_chars / 8.0::DOUBLE, 2) AS processing_time FROM documents""",
)
def history_log_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), "doc_id").alias("request_id"), F.lit("success").alias("execution_status"), (F.col("n_chars") / F.lit(8.0)).alias("processing_time"), F.col("text").alias("recognized_text"), F.concat(F.lit("fixed "), F.coalesce("text", F.lit(""))).alias("corrected_text"),
        F.lit(None).cast("string").alias("stdout"), F.col("source").alias("stderr"), (F.col("doc_id") % 2 == 0).alias("auto_corrected"), F.when(F.col("doc_id") % 5 != 0, "java").alias("language"), F.lit(None).cast("string").alias("sandbox_mode"),
    )
    return history.log_rows(responses).drop("timestamp", "execution_status")


@query(
    "history_insert_first_wins",
    """WITH c AS (SELECT 'c' || conv_id AS request_id, turn, role, conv_id FROM conversations), old AS (SELECT request_id, turn, role FROM c WHERE turn = 0 AND conv_id % 2 = 0),
    new AS (SELECT request_id, turn, role, row_number() OVER (PARTITION BY request_id ORDER BY turn DESC, role) AS n FROM c)
    SELECT * FROM old UNION ALL SELECT request_id, turn, role FROM new WHERE n = 1 AND request_id NOT IN (SELECT request_id FROM old)""",
)
def history_insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("request_id"), "turn", "role", "conv_id")
    old = rows.where("turn = 0 AND conv_id % 2 = 0").drop("conv_id")
    return old.unionByName(history.new_rows(old, rows.drop("conv_id"), F.desc("turn"), F.col("role")))


# --- gates

SQL_NAME = "CASE page_id % 7 WHEN 0 THEN url || '.PNG' WHEN 1 THEN url || '.tar.jpeg' WHEN 2 THEN '' WHEN 3 THEN 'noextension' WHEN 4 THEN NULL WHEN 5 THEN '.jpg' ELSE url END"
SQL_LANGUAGE = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Python' || chr(9) WHEN 2 THEN 'RUBY' WHEN 3 THEN 'cpp' ELSE 'javascript' END"
SQL_NORMAL = rf"regexp_replace(lower(coalesce(language, 'python')), '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"
IN_LANGUAGES = "IN ('python', 'javascript', 'java', 'cpp')"


@query(
    "upload_gate",
    f"""SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 429 WHEN page_id % 13 = 5 THEN 413 WHEN {SQL_NORMAL} NOT {IN_LANGUAGES} THEN 400 WHEN page_id % 6 = 4 THEN 400 WHEN coalesce(name, '') = '' THEN 400
    WHEN NOT (contains(name, '.') AND lower(list_last(string_split(name, '.'))) IN ('png', 'jpg', 'jpeg')) THEN 400 ELSE 200 END AS status
    FROM (SELECT page_id, {SQL_NAME} AS name, {SQL_LANGUAGE} AS language FROM pages)""",
)
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    name = F.when(p % 7 == 0, F.concat(url, F.lit(".PNG"))).when(p % 7 == 1, F.concat(url, F.lit(".tar.jpeg"))).when(p % 7 == 2, "").when(p % 7 == 3, "noextension").when(p % 7 == 4, F.lit(None)).when(p % 7 == 5, ".jpg").otherwise(url)
    language = F.when(p % 5 == 0, F.lit(None)).when(p % 5 == 1, " Python\t").when(p % 5 == 2, "RUBY").when(p % 5 == 3, "cpp").otherwise("javascript")
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), language.alias("language"))
    status = gate.request_status(p % 11 != 3, F.col("language"), p % 6 != 4, F.col("name"), F.when(p % 13 == 5, gate.MOST_BYTES + 1).otherwise(gate.MOST_BYTES))
    return rows.select("page_id", status.alias("status"))


SQL_CODE_LANGUAGE = "CASE event_id % 6 WHEN 0 THEN 'Python ' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'cpp' WHEN 4 THEN 'bash' ELSE NULL END"


def sql_command() -> str:
    whens = " ".join(f"WHEN '{k}' THEN {quoted((c + ' && ' if c else '') + r)}" for k, (_, c, r, _, _) in gate.COMMANDS.items())
    return f"CASE {SQL_NORMAL} {whens} END"


@query(
    "exec_routing",
    f"""SELECT event_id, CASE WHEN {SQL_NORMAL} NOT {IN_LANGUAGES} THEN 'none' WHEN docker THEN 'docker' WHEN need THEN 'none' WHEN {SQL_NORMAL} <> 'python' THEN 'none' ELSE 'subprocess' END AS sandbox_mode,
    CASE WHEN {SQL_NORMAL} NOT {IN_LANGUAGES} THEN 'Unsupported language: ''' || {SQL_NORMAL} || '''. Supported: python, javascript, java, cpp' WHEN docker THEN ''
    WHEN need THEN 'Docker sandbox is required but not available. Set REQUIRE_DOCKER=false or start the Docker daemon.'
    WHEN {SQL_NORMAL} <> 'python' THEN 'Language ''' || {SQL_NORMAL} || ''' requires Docker for execution, but Docker is not available.' ELSE '' END AS reason, {sql_command()} AS command
    FROM (SELECT event_id, {SQL_CODE_LANGUAGE} AS language, user_id % 2 = 0 AS docker, user_id % 3 = 0 AS need FROM events)""",
)
def exec_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    language = F.when(e % 6 == 0, "Python ").when(e % 6 == 1, "javascript").when(e % 6 == 2, "java").when(e % 6 == 3, "cpp").when(e % 6 == 4, "bash")
    rows = table(spark, sf_dir, "events").select("event_id", language.alias("language"), (u % 2 == 0).alias("docker"), (u % 3 == 0).alias("need"))
    r = gate.route(F.col("language"), F.col("docker"), F.col("need"))
    return rows.select("event_id", r["sandbox_mode"].alias("sandbox_mode"), r["reason"].alias("reason"), gate.command(F.col("language")).alias("command"))


@query("exec_status", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN user_id % 3 = 0 THEN 'success' ELSE 'error' END AS status FROM events")
def exec_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", gate.exec_status(F.col("user_id") % 3, F.col("event_id") % 7 == 0).alias("status"))


MESSAGES = ("Unterminated string literal (detected at line 1)", "unexpected EOF while parsing", "expected ':'", "unmatched ')'", "'(' was never closed", "invalid syntax. Perhaps you forgot a comma?", "unexpected indent", "unindent does not match any outer indentation level", "cannot assign to literal", "EOF while scanning triple-quoted string literal", "EOL while scanning string literal")
SQL_MESSAGE = f"CASE o_orderkey % {len(MESSAGES) + 1} " + " ".join(f"WHEN {i} THEN {quoted(m)}" for i, m in enumerate(MESSAGES)) + " END"
SQL_ADVICE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(message, '')), {quoted(p)})" for p in parts) + f" THEN {quoted(text)}" for parts, text in repair.ADVICE) + f" ELSE {quoted(repair.OTHER_ADVICE)} END"


def cases(key: Column, values: tuple) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)).otherwise(out)
    return out


@query("suggest_cause", f"SELECT o_orderkey, {SQL_ADVICE} AS suggestion FROM (SELECT o_orderkey, {SQL_MESSAGE} AS message FROM orders)")
def suggest_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = cases(F.col("o_orderkey") % (len(MESSAGES) + 1), MESSAGES)
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.suggestion(message).alias("suggestion"))


SQL_JSON = """'{"request_id":"r' || event_id || '","language":"' || event_type || '","auto_corrected":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"user_id":' || user_id || '}'"""


@query("response_json", f"SELECT event_id, {SQL_JSON} AS body FROM events")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.concat(F.lit("r"), "event_id").alias("request_id"), F.col("event_type").alias("language"), (F.col("event_id") % 2 == 0).alias("auto_corrected"), F.col("user_id").cast("long").alias("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(*fields)).alias("body"))


# --- limiter: 6 hours, 3 requests (at 60 seconds and 10 nothing in these tables is denied)

SPAN, MOST = 6 * 3600, 3
#: Where the stream's input is cut: it is run once for each part, so that its state is carried through restarts.
CUTS = ("2024-01-08", "2024-01-16", "2024-01-24")
SQL_LIMITER = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS allowed, [t] AS held FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, len(list_filter(f.held, lambda x: x > e.t - {SPAN * 1_000_000})) < {MOST},
CASE WHEN len(list_filter(f.held, lambda x: x > e.t - {SPAN * 1_000_000})) < {MOST} THEN list_append(list_filter(f.held, lambda x: x > e.t - {SPAN * 1_000_000}), e.t) ELSE list_filter(f.held, lambda x: x > e.t - {SPAN * 1_000_000}) END
FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, event_id, allowed FROM f"""


@query("rate_limit_admission", SQL_LIMITER)
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.admitted(table(spark, sf_dir, "events"), window=SPAN, most=MOST)


@query("rate_limit_stream", SQL_LIMITER)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "limiter")
    source = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    part = F.lit(0)
    for cut in CUTS:
        part = part + F.when(F.col("ts") >= F.lit(cut).cast("timestamp"), 1).otherwise(0)
    for k in range(len(CUTS) + 1):
        source.where(part == k).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/source")
        found = run_to_table(admit_stream(stream, window=SPAN, most=MOST), folder)
    return found


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: within spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    import tempfile
    import uuid

    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="scribe-")
    return f"{held.rstrip('/')}/scribe/{name}-{uuid.uuid4().hex}"


# --- layout: each document is a page; line k of its text is a band of ink at y = 20 k

PIXELS = """(SELECT doc_id AS image_id, 20 * k + dy AS y, x0 + dx AS x, 1 + length(line) % 225 AS v FROM
(SELECT doc_id, line, k, 4 + length(line) % 14 AS height, 10 * (1 + length(line) % 4) AS x0 FROM
(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents) WHERE line <> ''),
(SELECT unnest(range(18)) AS dy), (SELECT unnest([0, 7]) AS dx) WHERE dy < height)"""
SQL_PROFILE = f"(SELECT image_id, y, CAST(sum(v) AS BIGINT) AS profile FROM {PIXELS} GROUP BY image_id, y)"
SQL_REGIONS = f"""(SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY min(y)) AS line_no, min(y) AS y_start, max(y) AS y_end FROM
(SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS island FROM (SELECT *, max(profile) OVER (PARTITION BY image_id) AS top FROM {SQL_PROFILE}) WHERE profile > floor(top * 0.02::DOUBLE))
GROUP BY image_id, island HAVING max(y) - min(y) + 1 >= 10)"""
SQL_OFFSETS = f"""(SELECT r.image_id, r.line_no, r.y_start, r.y_end, min(p.x) AS x_offset FROM {SQL_REGIONS} r JOIN {PIXELS} p ON p.image_id = r.image_id AND p.y BETWEEN r.y_start AND r.y_end GROUP BY ALL)"""
SQL_LEVELS = f"""(SELECT o.image_id, line_no, x_offset, CAST(CASE WHEN step IS NULL THEN 0 ELSE greatest(round_even((x_offset - least) / step::DOUBLE, 0), 0) END AS INTEGER) AS indent_level FROM {SQL_OFFSETS} o JOIN
(SELECT image_id, min(gap) AS step, min(x_offset) AS least FROM (SELECT image_id, x_offset, x_offset - lag(x_offset) OVER (PARTITION BY image_id ORDER BY x_offset) AS gap FROM (SELECT DISTINCT image_id, x_offset FROM {SQL_OFFSETS})) GROUP BY image_id) b ON b.image_id = o.image_id)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(clean.lines_of(F.coalesce("text", F.lit("")))).alias("k", "line")).where("line <> ''")
    n = F.length("line")
    bands = rows.select(F.col("doc_id").alias("image_id"), (20 * F.col("k")).alias("y0"), (10 * (1 + n % 4)).alias("x0"), (1 + n % 225).alias("v"), F.explode(F.sequence(F.lit(0), 3 + n % 14)).alias("dy"))
    return bands.select("image_id", (F.col("y0") + F.col("dy")).alias("y"), F.explode(F.array(F.col("x0"), F.col("x0") + 7)).alias("x"), "v")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = pixels(spark, sf_dir)
    return layout.offsets(ink, layout.regions(layout.profile(ink)))


@query("seg_profile", f"SELECT * FROM {SQL_PROFILE}")
def seg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.profile(pixels(spark, sf_dir))


@query("seg_regions", f"SELECT * FROM {SQL_REGIONS}")
def seg_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions(layout.profile(pixels(spark, sf_dir)))


@query("seg_crop_offset", f"SELECT * FROM {SQL_OFFSETS}")
def seg_crop_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(spark, sf_dir)


@query("indent_levels", f"SELECT * FROM {SQL_LEVELS}")
def indent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.indent_levels(page_lines(spark, sf_dir).select("image_id", "line_no", "x_offset"))


@query(
    "assemble_lines",
    f"""SELECT image_id, CASE WHEN count(*) = 1 THEN any_value('line ' || line_no) ELSE string_agg(repeat('    ', indent_level) || 'line ' || line_no, chr(10) ORDER BY line_no) END AS text FROM {SQL_LEVELS} GROUP BY image_id""",
)
def assemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.indent_levels(page_lines(spark, sf_dir).select("image_id", "line_no", "x_offset"))
    return layout.assembled(rows.withColumn("text", F.concat(F.lit("line "), "line_no")))


@query(
    "seg_merge_boxes",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 100 AS INTEGER) AS s, CAST(l_partkey % 100 + 5 + l_suppkey % 30 - 1 AS INTEGER) AS e,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 100, l_linenumber, l_suppkey % 30) AS n FROM lineitem WHERE 5 + l_suppkey % 30 >= 10),
    m AS (SELECT image_id, n, s AS y_start, e AS y_end, 1 AS line_no FROM b WHERE n = 1 UNION ALL
    SELECT m.image_id, b.n, CASE WHEN joins THEN m.y_start ELSE b.s END, CASE WHEN joins THEN greatest(m.y_end, b.e) ELSE b.e END, CASE WHEN joins THEN m.line_no ELSE m.line_no + 1 END
    FROM m JOIN b ON b.image_id = m.image_id AND b.n = m.n + 1, LATERAL (SELECT greatest(least(m.y_end, b.e) - greatest(m.y_start, b.s) + 1, 0) / least(m.y_end - m.y_start + 1, b.e - b.s + 1)::DOUBLE >= 0.5 AS joins))
    SELECT image_id, line_no, y_start, max(y_end) AS y_end FROM m GROUP BY image_id, line_no, y_start""",
)
def seg_merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 10).alias("x"), (part % 100).cast("int").alias("y"), F.lit(20).alias("w"), (5 + supp % 30).cast("int").alias("h"))
    return layout.merged_boxes(boxes)


# --- parser: snippets by order key, expected results by hand

SNIPPETS = {
    "structural_inference": (
        repair.structure_udf,
        (("if a:\nb", "if a:\n    b"), ("try:\n    a\n    except:\n    b", "try:\n    a\nexcept:\n    b"), ("one line", "one line"), ("if a:\n    b\n  else:\n    c", "if a:\n    b\nelse:\n    c"), ("define:\nx", "define:\nx"), ("if a:\n   if b:\n      c\n   elif d:\n      e\n   else:\n      f", "if a:\n   if b:\n      c\n   elif d:\n      e\nelse:\n      f")),
    ),
    "balance_brackets": (
        repair.balance_brackets_udf,
        (("f(a[1", "f(a[1])"), ("a)b", "ab"), ("x = '(' + ']'", "x = '(' + ']'"), ("{(}", "{()}"), ("f(x) ]\n", "f(x) \n"), ("f('\\'', (", "f('\\'', ())")),
    ),
    "fix_missing_colon": (
        lambda t: repair.close_colon_udf(t, F.lit(1)),
        (("if x", "if x:"), ("else  ", "else:"), ("define x", "define x"), ("while a:\n b", "while a:\n b"), ("  for i in y\nz", "  for i in y:\nz"), ("x = 1", "x = 1")),
    ),
    "fix_unterminated": (
        lambda t: repair.close_string_udf(t, F.lit(1)),
        (('a = "b', 'a = "b"'), ("a = 'b  ", "a = 'b'"), ("a = 'b'", "a = 'b'"), ("a = '\\''", "a = '\\''"), ("x\n'", "x\n'"), ("\"'", "\"'\"")),
    ),
}


def snippet_query(name: str, fix, pairs: tuple) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_orderkey", cases(F.col("o_orderkey") % len(pairs), tuple(a for a, _ in pairs)).alias("text"))
        return rows.select("o_orderkey", fix(F.col("text")).alias("out"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT o_orderkey, CASE o_orderkey % {len(pairs)} " + " ".join(f"WHEN {i} THEN {quoted(b)}" for i, (_, b) in enumerate(pairs)) + " END AS out FROM orders"


for _name, (_fix, _pairs) in SNIPPETS.items():
    snippet_query(_name, _fix, _pairs)

#: text, language, corrected, ok, first message.
CORRECTIONS = (
    ("print('hello world')", "python", "print('hello world')", True, None),
    ("", "python", "", False, "Empty input"),
    ("print(“hello”)", "Python ", 'print("hello")', True, None),
    ("def foo();\n    pass", "python", "def foo():\n    pass", True, None),
    ("var $el = document.getElementById(`test`);", "javascript", "var $el = document.getElementById('test');", True, None),
    ("if (!valid) { return false; }", "javascript", "if (!valid) { return false; }", True, None),
    ("de f foo():\n    pr int('hello')", "python", "def foo():\n    print('hello')", True, None),
    ("x = (1 + 2", "python", "x = (1 + 2)", True, None),
    ("if x = 1:\ny = 2", "python", "if x == 1:\n    y = 2", True, None),
    ("while va|ue", "python", "while value:", False, "expected an indented block after 'while' statement on line 1"),
    ("a = 'b", "python", "a = 'b'", True, None),
    ("total = 1O + l2", "python", "total = 10 + 12", True, None),
    ("x = [1, 2))", "python", "x = [1, 2]", True, None),
    ("for i in ra nge(3)\n  print(i)", "python", "for i in range(3):\n    print(i)", True, None),
)


def sql_cases(column: int, cast: str = "") -> str:
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else quoted(v)
    return f"CASE o_orderkey % {len(CORRECTIONS)} " + " ".join(f"WHEN {i} THEN {value(c[column])}" for i, c in enumerate(CORRECTIONS)) + f" END{cast}"


@query("correct_syntax_full", f"SELECT o_orderkey, {sql_cases(2)} AS corrected, {sql_cases(3)} AS ok, {sql_cases(4, '::VARCHAR')} AS message FROM orders")
def correct_syntax_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % len(CORRECTIONS)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cases(key, tuple(c[0] for c in CORRECTIONS)).alias("text"), cases(key, tuple(c[1] for c in CORRECTIONS)).alias("language"))
    return correct_syntax(rows).select("o_orderkey", "corrected", "ok", F.get("diagnostics", 0)["message"].alias("message"))


@query("correct_documents")
def correct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as if they were transcribed Python: mostly the path that fails to parse."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("python").alias("language"))
    return correct_syntax(rows).select("doc_id", "corrected", "ok", F.size(F.coalesce("diagnostics", F.array())).alias("n_diagnostics"))


#: A band of ink of h rows is cut out with a row on each side; the page is 200 wide; odd bands are indented.
SQL_LINE = "repeat('    ', i % 2) || 'x = ' || (200 * (14 + (s_suppkey + i) % 5))"
SQL_PAGE = f"(SELECT s_suppkey, 1 + s_suppkey % 4 AS n, array_to_string(list_transform(range(1 + s_suppkey % 4), lambda i: {SQL_LINE}), chr(10)) AS body FROM supplier)"


@query(
    "evaluate_pages",
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS request_id, 200 AS http_status, CAST(NULL AS VARCHAR) AS error, body AS recognized_text, body AS corrected_text, n = 1 AS auto_corrected,
    '' AS stdout, 'Execution is refused: no executor was given.' AS stderr, 'error' AS execution_status, false AS stdout_truncated, false AS stderr_truncated, 0 AS original_stdout_length,
    44 AS original_stderr_length, 'python' AS language, 'none' AS sandbox_mode FROM {SQL_PAGE}""",
)
def evaluate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small drawn pages, one for each supplier, through cleaning, segmentation, a stub recogniser, correction and refused execution."""
    import pandas as pd

    from scribe.sources.images import page

    def draw(parts):
        for part in parts:
            pages = [page([(20 + 30 * i, 12 + (k + i) % 5, 10 + 30 * (i % 2)) for i in range(1 + k % 4)], 150, 200) for k in part["s_suppkey"]]
            yield pd.DataFrame({"image_id": part["s_suppkey"].astype(str), "height": 150, "width": 200, "channels": 1, "data": [p.tobytes() for p in pages]})

    images = table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(draw, "image_id string, height int, width int, channels int, data binary")
    return evaluate(images).drop("diagnostics", "processing_time")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents corrected as source text, as history rows, the newest 20."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id").alias("request_id"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "python").otherwise("javascript").alias("language"))
    fixed = correct_syntax(docs)
    responses = fixed.select("request_id", F.when(F.col("ok"), "success").otherwise("error").alias("execution_status"), F.lit(0.0).alias("processing_time"), F.col("text").alias("recognized_text"), F.col("corrected").alias("corrected_text"), F.lit("").alias("stdout"), F.lit("").alias("stderr"), F.col("ok").alias("auto_corrected"), "language", F.lit("none").alias("sandbox_mode"))
    return history.recent(history.log_rows(responses, F.lit("2024-01-01 00:00:00").cast("timestamp")))
