"""Layout, gates, limiter, history, images, execution, evaluation."""

import datetime as dt
import random
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import functions as F

from scribe.operators import execute, gate, layout, limiter, vision
from scribe.plans.evaluate import evaluate, health
from scribe.sources import history, images
from scribe.streaming.limiter import admit_stream, run_to_table

PAGES = {
    "single": (100, 400, [(20, 30, 10)], 1),
    "four": (300, 400, [(20, 25, 10), (80, 25, 10), (140, 25, 40), (200, 25, 10)], 4),
    "offsets": (200, 400, [(20, 25, 10), (80, 25, 60), (140, 25, 10)], 3),
    "unordered": (300, 400, [(200, 25, 10), (20, 25, 10), (100, 25, 10)], 3),
    "blank": (100, 400, [], 1),
}


def test_segmentation_of_pages():
    for height, width, bands, n in PAGES.values():
        found = vision.segmented(images.page(bands, height, width))
        assert len(found) == n and found == sorted(found)
        if bands:
            assert found == [(y, y + h - 1, x) for y, h, x in sorted(bands)]
    assert vision.segmented(np.zeros((5, 5), np.uint8)) == [(0, 4, 0)] and vision.segmented(np.zeros((3, 90), np.uint8)) == [(0, 2, 0)]
    try:
        vision.segmented(None)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_regions_in_spark_are_numpys(spark):
    rows = [(k, y, x, 225) for k, (_, w, bands, _) in PAGES.items() for y0, h, x0 in bands for y in range(y0, y0 + h) for x in (x0, w - 21)]
    ink = spark.createDataFrame(rows, "image_id string, y int, x int, v int")
    got = layout.offsets(ink, layout.regions(layout.profile(ink))).collect()
    want = {(k, n + 1, y, y + h - 1, x) for k, (_, _, bands, _) in PAGES.items() for n, (y, h, x) in enumerate(sorted(bands))}
    assert {tuple(r) for r in got} == want


def test_thin_and_faint_rows(spark):
    rows = [("a", y, 0, 200) for y in range(9)] + [("a", y, 0, 200) for y in range(20, 30)] + [("a", 31, 0, 4), ("b", 1, 0, 0)]
    ink = spark.createDataFrame(rows, "image_id string, y int, x int, v int")
    assert [tuple(r) for r in layout.regions(layout.profile(ink)).collect()] == [("a", 1, 20, 29)]


def test_indentation(spark):
    rows = [("a", 1, 10), ("a", 2, 40), ("a", 3, 55), ("b", 1, 7), ("c", 1, 0), ("c", 2, 2), ("c", 3, 5)]
    got = layout.indent_levels(spark.createDataFrame(rows, "image_id string, line_no int, x_offset int")).collect()
    assert {(r.image_id, r.line_no): r.indent_level for r in got} == {("a", 1): 0, ("a", 2): 2, ("a", 3): 3, ("b", 1): 0, ("c", 1): 0, ("c", 2): 1, ("c", 3): 2}
    text = layout.assembled(spark.createDataFrame([("a", 2, 1, "b"), ("a", 1, 0, "a"), ("z", 1, 3, "one")], "image_id string, line_no int, indent_level int, text string"))
    assert {r.image_id: r.text for r in text.collect()} == {"a": "a\n    b", "z": "one"}


def test_boxes(spark):
    rng = random.Random(1)
    boxes = [(i % 40, rng.randrange(50), rng.randrange(120), 5, rng.randrange(5, 40)) for i in range(400)] + [(99, 0, 0, 5, 10), (99, 0, 5, 5, 10), (99, 0, 11, 5, 10)]
    got = defaultdict(list)
    for r in layout.merged_boxes(spark.createDataFrame(boxes, "image_id int, x int, y int, w int, h int")).collect():
        got[r.image_id].append((r.line_no, r.y_start, r.y_end))
    for k in {b[0] for b in boxes}:
        own = [b[1:] for b in boxes if b[0] == k]
        lines = vision.joined_boxes(own)
        assert sorted(got[k]) == [(n + 1, a, b) for n, (a, b) in enumerate(lines)], k
    assert sorted(got[99]) == [(1, 0, 14), (2, 11, 20)]


def test_ink_boxes():
    ink = np.zeros((12, 12), int)
    ink[1, 1], ink[2, 2], ink[3, 1] = 99, 99, 99  # corners touch
    ink[8:10, 5:9] = 99
    ink[5, 5] = 30
    assert sorted(vision.ink_boxes(ink)) == [(1, 1, 2, 3), (5, 8, 4, 2)]


def test_cleaning_of_pages():
    page = images.page([(40, 20, 20), (90, 20, 60)], 160, 300)
    out = vision.preprocessed(page[:, :, None])
    assert out.shape == page.shape and out.dtype == np.uint8
    turned = vision.deskewed(page)
    assert turned is page
    gray = vision.grayscale(np.dstack([np.full((4, 4), v, np.uint8) for v in (10, 20, 200)]))
    assert abs(int(gray[0, 0]) - round(0.114 * 10 + 0.587 * 20 + 0.299 * 200)) <= 1
    slope = np.full((200, 300), 255, np.uint8)
    for x in range(20, 280):
        slope[80 + x // 10 : 100 + x // 10, x] = 0
    angle = vision.skew(slope)
    assert 4 < abs(angle) < 8 and abs(vision.skew(vision.deskewed(slope))) < 1.5


def brute_limiter(rows, window, most):
    held, out = defaultdict(deque), {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        own = held[key]
        while own and own[0] <= t - window:
            own.popleft()
        out[i] = len(own) < most
        if out[i]:
            own.append(t)
    return out


def test_limiter(spark, tmp_path):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(4), rng.randrange(400), i) for i in range(600)] + [(9, 0, 1000 + i) for i in range(11)] + [(9, 60, 1020), (9, 59, 1019)]
    want = brute_limiter(rows, 60, 10)
    df = spark.createDataFrame([(k, base + dt.timedelta(seconds=t), i) for k, t, i in rows], "user_id long, ts timestamp, event_id long")
    assert {r.event_id: r.allowed for r in limiter.admitted(df).collect()} == want
    assert want[1009] and not want[1010] and not want[1019] and want[1020]
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert {r.event_id: r.allowed for r in run_to_table(admit_stream(stream), f"{tmp_path}/out").collect()} == want


def test_history(spark, tmp_path):
    path = f"{tmp_path}/history"
    rows = [("a", "success", 1.005, "x" * 600, None, "", "", True, None, None), ("b", "error", 2.0, None, "y", "", "", False, "java", "docker"), ("a", "late", 3.0, "z", "", "", "", True, "cpp", "none")]
    responses = spark.createDataFrame(rows, "request_id string, execution_status string, processing_time double, recognized_text string, corrected_text string, stdout string, stderr string, auto_corrected boolean, language string, sandbox_mode string")
    when = F.lit("2024-05-05 00:00:00").cast("timestamp")
    history.append(spark, path, history.log_rows(responses, when), F.col("processing_time"))
    history.append(spark, path, history.log_rows(responses, when))
    table = history.create(spark, path)
    got = {r.request_id: r for r in table.collect()}
    assert table.count() == 2 and got["a"].execution_status == "success" and len(got["a"].recognized_text) == 500
    assert got["a"].language == "python" and got["a"].sandbox_mode == "subprocess" and got["a"].auto_corrected == 1
    assert [r.request_id for r in history.recent(table, 5).collect()] == ["a", "b"]
    assert history.lookup(table, "b").count() == 1 and history.lookup(table, "zz").count() == 0
    assert '"count":2' in history.envelope(history.recent(table)).first().body


def test_history_plans(spark, tmp_path):
    path = f"{tmp_path}/h"
    table = history.create(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(history.recent(table))
    assert "PushedFilters: [IsNotNull(request_id), EqualTo(request_id,q)]" in plan(history.lookup(table, "q"))


def test_execution_is_refused_by_default(spark):
    df = spark.createDataFrame([("print(1)", "python")], "corrected string, language string")
    r = execute.executed(df).first().execution
    assert r.status == "error" and r.sandbox_mode == "none" and "refused" in r.stderr


def test_trusted_execution(spark):
    codes = ["print('hello')", "print('x' * 20000)", "1/0", "if if if", "import time; time.sleep(30)"]
    results = [execute.python_process(c, "python", seconds=3) for c in codes]
    assert [r["status"] for r in results] == ["success", "success", "error", "error", "timeout"]
    assert results[1]["stdout_truncated"] and len(results[1]["stdout"]) == 10_021 and results[1]["original_stdout_length"] == 20_001
    assert "ZeroDivisionError" in results[2]["stderr"]
    assert "requires Docker" in execute.python_process("x", "java")["stderr"]
    df = spark.createDataFrame([("print(2)", "python"), (None, None)], "corrected string, language string")
    assert [r.execution.status for r in execute.executed(df, execute.python_process).collect()] == ["success", "success"]


def test_container_command():
    for language, (name, _, _, memory, _) in gate.COMMANDS.items():
        own = execute.container_command(language, "/f", "img")
        line = " ".join(own)
        assert own[:2] == ["docker", "run"] and "--network none" in line and "--read-only" in line and "--cap-drop ALL" in line
        assert f"--memory {memory}" in line and "/f:/source:ro" in line and name in own[-1]
    assert "&&" in execute.container_command("java", "/f", "img")[-1]
    assert "Unsupported" in execute.container("img")("x", "bash")["stderr"]


def test_evaluation_of_files(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "good.png").write_bytes(images.png(images.page([(30, 25, 10), (90, 25, 50)], 150, 200)))
    (folder / "one.png").write_bytes(images.png(images.code_page(["x = 1"], least=120)))
    (folder / "bad.png").write_bytes(b"not an image")
    got = {r.request_id.rsplit("/", 1)[-1]: r for r in evaluate(images.read_images(spark, str(folder))).collect()}
    assert got["good.png"].http_status == 200 and got["good.png"].recognized_text.count("\n") == 1 and got["good.png"].sandbox_mode == "none"
    assert got["one.png"].recognized_text.startswith("x = ")
    bad = [r for k, r in got.items() if r.http_status == 500]
    assert len(bad) == 1 and "decode" in bad[0].error
    assert images.read_uploads(spark, str(folder)).count() == 3
    assert health()["execution"] is False
