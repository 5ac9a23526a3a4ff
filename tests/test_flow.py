"""Requests from admission to history; execution by route; what workers hold; the driver's contract without llm."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribe.functions import rules
from scribe.operators import execute, repair
from scribe.plans.evaluate import LOADED, Loader, answer, health, reader_of
from scribe.sources import history
from scribe.sources.images import page
from scribe.streaming.limiter import admit_stream, run_to_table

REQUEST = "request_id string, client string, ts timestamp, language string, has_file boolean, file_name string, size long"


def test_requests(spark, tmp_path):
    rows = [(f"r{k:02d}", "one", k, "python", True, "a.png", 10) for k in range(12)]
    rows += [("big", "two", 1, "python", True, "a.png", 6 << 20), ("tongue", "two", 2, "cobol", True, "a.png", 1), ("none", "two", 3, "java", False, None, 0), ("text", "two", 4, "java", True, "a.txt", 1), ("js", "two", 5, " JavaScript", True, "b.JPG", 1), ("lost", "two", 6, "python", True, "c.jpeg", 1)]
    requests = spark.createDataFrame(rows, REQUEST.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds(F.col("ts")))
    drawn = page([(20, 15, 10)], 150, 200).tobytes()
    images = spark.createDataFrame([(r[0], 150, 200, 1, drawn) for r in rows if r[0] != "lost"], "image_id string, height int, width int, channels int, data binary")
    path = f"{tmp_path}/history"
    got = {r.request_id: r for r in answer(requests, images, executor={"subprocess": execute.python_process}, history=path).collect()}
    assert set(got) == {r[0] for r in rows}
    status = {k: r.http_status for k, r in got.items()}
    assert [status[f"r{k:02d}"] for k in range(12)] == [200] * 10 + [429] * 2
    assert (status["big"], status["tongue"], status["none"], status["text"], status["js"], status["lost"]) == (413, 400, 400, 400, 200, 500)
    assert got["r00"].execution_status == "success" and got["r00"].sandbox_mode == "subprocess" and got["r00"].corrected_text == "x = 3400"
    assert got["js"].execution_status == "error" and "requires Docker" in got["js"].stderr and got["js"].sandbox_mode == "none"
    assert all(r.processing_time >= (r.processing_time or 0) >= 0 for r in got.values() if r.http_status == 200)
    assert got["r00"].processing_time > 0 and got["r11"].error == "Rate limit exceeded"
    logged = {r.request_id for r in spark.read.parquet(path).collect()}
    assert logged == {k for k, s in status.items() if s == 200}
    answer(requests, images, history=path)
    assert history.create(spark, path).count() == len(logged)  # the first write stays


def test_processes_have_no_network():
    code = "import socket\ntry:\n    socket.socket()\nexcept PermissionError as e:\n    print(e)\nimport os\nprint(sorted(os.environ)[:1])"
    got = execute.python_process(code, "python")
    assert got["status"] == "success" and got["stdout"].startswith("network access is disabled")
    assert "Traceback" in execute.python_process("1 / 0", "python")["stderr"]


def test_containers_are_removed(tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    fake = tmp_path / "docker"
    fake.write_text(f'#!/bin/sh\necho "$@" >> {calls}\ncase "$1" in run) exec sleep 30;; esac\n')
    fake.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    monkeypatch.setitem(execute.COMMANDS, "python", (*execute.COMMANDS["python"][:4], 1))
    got = execute.container("image")("print(1)", "python")
    lines = calls.read_text().splitlines()
    name = lines[0].split("--name ")[1].split()[0]
    assert got["status"] == "timeout" and got["sandbox_mode"] == "docker"
    assert lines[1:] == [f"kill {name}", f"rm --force {name}"]


def test_routes(spark):
    df = spark.createDataFrame([("print(1)", "python"), ("x", "java"), ("x", "cobol")], "corrected string, language string")
    docker = lambda code, language: execute.result("in a container", "", "success", 0.1, "docker")
    modes = lambda executor, need=False: [r.execution.sandbox_mode for r in execute.executed(df, executor, require_docker=need).collect()]
    assert modes({"docker": docker}) == ["docker", "docker", "none"]
    assert modes({"subprocess": execute.python_process}) == ["subprocess", "none", "none"]
    assert modes({"subprocess": execute.python_process}, True) == ["none"] * 3


def test_loaders_load_once():
    loads, sizes = [], []

    def load(variant, device):
        loads.append((variant, device))
        return lambda lines: sizes.append(len(lines)) or [f"{x.shape[0]}" for x in lines]

    loader = Loader(load, "light", "cpu", batch=4)
    for _ in range(3):
        assert reader_of(loader)([np.zeros((k + 1, 3)) for k in range(10)]) == [str(k + 1) for k in range(10)]
    assert loads == [("light", "cpu")] and sizes == [4, 4, 2] * 3
    LOADED.clear()
    told = health(loader, {"docker": execute.refused})
    assert (told["model_variant"], told["device"], told["docker_available"]) == ("light", "cpu", True)


def test_streams_out_of_order_fail(spark, tmp_path):
    row = lambda k: [(1, k, k)]
    write = lambda k: spark.createDataFrame(row(k), "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    write(50)
    stream = admit_stream(spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(f"{tmp_path}/in"))
    assert run_to_table(stream, f"{tmp_path}/out").count() == 1
    write(60)
    assert run_to_table(stream, f"{tmp_path}/out").count() == 2
    write(40)
    with pytest.raises(Exception, match="order of time|STREAM_FAILED|terminated"):
        run_to_table(stream, f"{tmp_path}/out")


def test_queries_stay_without_what_llm_needs():
    code = "import sys\nsys.modules['xxhash'] = None\nimport __spark_entry__ as e\nassert 'keyword_rules' in e.queries() and 'op2_simhash_near_dedup' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=100)


def test_fixed_values():
    """Written out once more, as the SQL of some queries is made from the library's own tables."""
    words = "print print return import from while elif else except finally class range len input True False None assert lambda global yield raise continue break".split()
    assert [w for _, _, w in rules.SPLIT_KEYWORDS] == words
    assert all(w == a + b for a, b, w in rules.SPLIT_KEYWORDS if (a, b) != ("pr", "lnt"))
    assert dict(rules.MISREAD_WORDS) == {"returm": "return", "prirnt": "print", "irnport": "import", "frorn": "from", "randon": "random"}
    causes = {
        "unterminated string literal": "an unclosed string", "EOL while scanning": "an unclosed string", "unexpected EOF": "the file ends", "EOF while scanning": "the file ends", "expected ':'": "trailing colon",
        "unmatched ')'": "stray closer", "'(' was never closed": "stray closer", "invalid syntax": "a typo", "unexpected indent": "4-space", "unindent does not match": "dedented", "something else": "Inspect the indicated line",
    }
    assert all(part in repair.advice(message) for message, part in causes.items())
