"""What stands between the engine and models outside: replies, judges, processes, images, literals, SQL."""

import ast
import json
import random
import struct
import subprocess
import sys
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import prompts
from plumbline.plans import judging
from plumbline.schemas import SamplingConfig
from plumbline.sources import images, replies, scorer


@pytest.fixture()
def endpoint():
    """A chat endpoint that counts what it is asked, refuses some requests once, and notes how many run at a time."""
    seen = {"asked": [], "most": 0, "now": 0, "times": []}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            with lock:
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                first = text not in seen["asked"]
                seen["asked"].append(text)
                seen["times"].append(time.monotonic())
            time.sleep(0.05)
            code = 503 if "busy" in text and first else 429 if "limit" in text and first else 400 if "bad" in text else 500 if "down" in text else 200
            body = json.dumps({"choices": [{"message": {"content": json.dumps({"extracted_answer": text[-1:], "is_correct": True})}}]}).encode()
            with lock:
                seen["now"] -= 1
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(body if code == 200 else b"")

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_judge_retries_what_may_pass(endpoint):
    url, seen = endpoint
    judge = scorer.http_judge(url, "m", retries=2, backoff=0.01, failed=None)()
    assert [json.loads(r)["extracted_answer"] if r else None for r in judge(["busy 1", "limit 2", "bad 3", "down 4", "5"])] == ["1", "2", None, None, "5"]
    assert [seen["asked"].count(t) for t in ("busy 1", "limit 2", "bad 3", "down 4", "5")] == [2, 2, 1, 3, 1]
    assert scorer.http_judge("http://127.0.0.1:1/", "m", retries=1, backoff=0.01)()(["x"]) == [scorer.NO_VERDICT]


def test_judge_asks_side_by_side_and_not_too_often(endpoint):
    url, seen = endpoint
    scorer.http_judge(url, "m", concurrent=8)()([str(i) for i in range(24)])
    assert 2 <= seen["most"] <= 8
    seen["times"].clear()
    scorer.http_judge(url, "m", concurrent=8, per_second=40)()([str(i) for i in range(20)])
    assert max(seen["times"]) - min(seen["times"]) >= 18 / 40


def test_equal_questions_are_asked_once_and_kept(spark, endpoint, tmp_path):
    url, seen = endpoint
    folder = f"file://{tmp_path}/kept"
    df = spark.createDataFrame([(i, f"ask {i % 4}") for i in range(40)] + [(40, "busy 7"), (41, "bad 8"), (42, None)], "digest int, q string").repartition(5)
    judge = scorer.http_judge(url, "m", concurrent=4, failed=None)
    got = {r.digest: r.verdict for r in replies.answered(df, "q", "verdict", judge, folder).collect()}
    assert sorted(seen["asked"]) == sorted({f"ask {k}" for k in range(4)} | {"busy 7", "bad 8"}) and len(got) == 43
    assert all(json.loads(got[i])["extracted_answer"] == str(i % 4) for i in range(40)) and got[40] is got[41] is got[42] is None
    seen["asked"].append("(second run)")
    again = {r.digest: r.verdict for r in replies.answered(df, "q", "verdict", judge, folder).collect()}
    assert sorted(seen["asked"][seen["asked"].index("(second run)") + 1 :]) == ["bad 8", "busy 7"]  # what failed is asked again
    assert json.loads(again[40])["extracted_answer"] == "7" and again[0] == got[0]
    assert replies.answered(df, "q", "verdict", judge).where("verdict is not null").count() == 41  # without a folder


def test_a_judging_stage_over_kept_replies(spark, endpoint, tmp_path):
    url, seen = endpoint
    c = "array<struct<text:string,extracted_answer:string,is_correct:boolean>>"
    df = spark.createDataFrame([("q", "p", "A", [("....", None, False)])] * 5, f"question_id string, problem string, gold_answer string, candidates {c}")
    judge = scorer.http_judge(url, "m", failed=None)
    ask = lambda asked: replies.answered(asked, "prompt", "reply", judge, f"file://{tmp_path}/kept")
    for _ in range(2):
        assert [r.stats.correct for r in judging.judged_records(df, ask).collect()] == [1] * 5
    assert len(seen["asked"]) == 1


def test_a_named_model_is_made_once_in_a_process(spark, tmp_path):
    made = str(tmp_path)

    def factory():
        import os
        import uuid

        (Path(made) / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [str(os.getpid())] * len(texts)

    df = spark.range(64).withColumn("t", F.lit("x")).repartition(16)
    pids = set()
    for _ in range(2):
        pids |= {r.y for r in scorer.scored_batches(df, "t", "y", factory, name="stub").select("y").collect()}
    names = [p.name.split("-")[0] for p in Path(made).iterdir()]
    assert sorted(names) == sorted(pids) and len(names) <= 8
    scorer.scored_batches(df, "t", "y", factory).collect()
    assert len(list(Path(made).iterdir())) == len(names) + 16  # without a name one in each task


PROFILES = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession, functions as F
from plumbline.sources import scorer
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").getOrCreate()
make = lambda: lambda texts: ["y"] * len(texts)
for cpus in (1, 2):
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build
    df = scorer.scored_batches(spark.range(6).withColumn("t", F.lit("x")), "t", "y", make, name="stub", profile=profile)
    print("rows", df.count())
"""


def test_models_are_placed_by_profiles(tmp_path):
    """Two profiles of tasks, on executors of a small cluster."""
    repo = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", PROFILES, repo], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert out.stdout.split("\\n")[:1] and out.stdout.count("rows 6") == 2, out.stderr[-2000:]


# Images ------------------------------------------------------------------------------------------


def png_file(pixels, colour, bits=8, palette=None, filters=(0, 1, 2, 3, 4), split=1, interlace=0):
    """A PNG of samples (height x width x samples), each line with another filter."""
    height, width, samples = pixels.shape
    raw = pixels.astype(">u2").tobytes() if bits == 16 else pixels.astype(np.uint8).tobytes()
    stride, step = width * samples * bits // 8, samples * bits // 8
    lines, above = b"", bytes(stride)
    for y in range(height):
        row, kind = raw[y * stride : (y + 1) * stride], filters[y % len(filters)]
        out = bytearray()
        for x in range(stride):
            a, b, c = row[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((row[x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines += bytes([kind]) + bytes(out)
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(lines)
    parts = [data[i : i + max(1, len(data) // split + 1)] for i in range(0, len(data), max(1, len(data) // split + 1))]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlace))
    return images.SIGNATURE + head + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, bits", [(0, 8), (2, 8), (3, 8), (4, 8), (6, 8), (0, 16), (2, 16), (6, 16)])
def test_png_of_all_kinds_and_filters(colour, bits):
    draw = np.random.default_rng(colour + bits)
    palette = draw.integers(0, 256, (9, 3), dtype=np.uint8) if colour == 3 else None
    p = draw.integers(0, 9 if colour == 3 else 2**bits, (11, 7, images.SAMPLES[colour]))
    got = images.pixels(png_file(p, colour, bits, palette, split=3))
    top = p >> (bits - 8)
    want = palette[top[..., 0]] if colour == 3 else np.repeat(top[..., :1], 3, axis=2) if colour in (0, 4) else top[..., :3]
    assert got.shape == (11, 7, 3) and (got == want).all()


def test_bytes_that_are_no_image():
    good = png_file(np.zeros((3, 3, 1), int), 0)
    assert images.pixels(None) is None and images.pixels(good).shape == (3, 3, 3)
    broken = bytearray(good)
    broken[45] ^= 1
    for raw in (b"", b"GIF89a", good[:-5], good[:30], bytes(broken), png_file(np.zeros((3, 3, 1), int), 0, interlace=1), images.SIGNATURE, png_file(np.full((2, 2, 1), 5), 3, palette=np.zeros((2, 3), np.uint8))):
        with pytest.raises(ValueError):
            images.pixels(raw)


def test_generators_get_the_pixels_of_their_questions(spark):
    def make(prompt, n, pixels):
        return [{"text": f"{prompt} {None if pixels is None else pixels.shape} {i}"} for i in range(n)]

    file = png_file(np.zeros((2, 5, 3), int), 2)
    rows = [("q", "ask", (bytearray(file),)), ("none", "ask", None), ("null", "ask", (None,)), ("bad", "ask", (bytearray(b"x"),))]
    df = spark.createDataFrame(rows, "question_id string, prompt string, image_1 struct<bytes:binary>")
    got = scorer.generated(df, "prompt", lambda: make, "text string", SamplingConfig(n_samples=2), image="image_1")
    assert sorted((r.question_id, r.candidate.text) for r in got.collect()) == [("none", "ask None 0"), ("none", "ask None 0"), ("null", "ask None 0"), ("null", "ask None 0"), ("q", "ask (2, 5, 3) 0"), ("q", "ask (2, 5, 3) 0")]
    shown = {r.question_id: r.image for r in images.described(df).collect()}
    assert (shown["q"].width, shown["q"].height, shown["none"], shown["null"]) == (5, 2, None, None) and shown["bad"].fault and shown["bad"].width is None


# Literals ----------------------------------------------------------------------------------------

LITERALS = [
    "['a', -1, 1_000]", "['a' 'b']", r"[r'a\\b']", r"['\x41', 'é', '\n']", "['a', ['x', 'y']]", "['it\\'s', \"it's\", 'say \"x\"']", "[]", " ['a']", "\n['a']", "['a',]", "['a', None, True, 2.5, 1e3]",
    "('a',)", "'a'", "[a]", "['a'", "['a'] + ['b']", "", "None", "{'a': 1}", "[{'a': 1}, {1, 2}, b'x', 1j]", "['a\nb']", "['\t']", "['a' , \"b, ['c']\"]", "['']", "[" * 400 + "]" * 400, "['" + "x" * 50_000 + "']", "[\x01]", "['a'\x01]", "['a'] # note", "[...]", "['a','b'  ,  'c']",
]


def plain_lines(text):
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return ""
    return "".join(f"{chr(65 + i)}. {x}\n" for i, x in enumerate(value)) if isinstance(value, list) else ""


def test_literals_are_read_as_python_reads_them(spark):
    draw = random.Random(4)
    made = [repr([draw.choice(["a", "it's", 'q"', "b\\", "é\n", 1, -2.5, None, ["x"], ("y",), {"k": 1}]) for _ in range(draw.randint(0, 6))]) for _ in range(200)]
    texts = [*LITERALS, *made, "[" + ", ".join(f"'o{i}'" for i in range(60)) + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, x string")
    got = [r.y for r in df.select("i", prompts.option_list(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [plain_lines(t) for t in texts] + [""]


# SQL ---------------------------------------------------------------------------------------------


def test_functions_of_sql_are_the_columns(spark):
    from plumbline.functions import sql

    assert sql.register(spark, "pl_") == [f"pl_{n}" for n in sql.FUNCTIONS]
    texts = ["so \\boxed{A}", "The answer is (C)", "\\boxed{-1.50}", "it's 'quoted' \\ and = 3", None, "", "Confidence: 77%"]
    df = spark.createDataFrame([(t,) for t in texts], "answer string").withColumn("reply", F.col("answer"))
    df.createOrReplaceTempView("pl_answers")
    for name, (arguments, _, made) in sql.FUNCTIONS.items():
        column = arguments.split()[0]
        if column in ("answer", "reply"):
            assert [r[0] for r in spark.sql(f"SELECT pl_{name}({column}) FROM pl_answers").collect()] == [r[0] for r in df.select(made()).collect()]
    assert spark.sql("SELECT pl_token_jitter(array(-1.0D, -0.5D, -0.1D, -2.0D), 2)").first()[0] > 0 and spark.sql("SELECT pl_token_jitter(array(-1.0D, -0.5D))").first()[0] == 0
    plan = spark.sql("SELECT pl_boxed_answer(answer) FROM pl_answers")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="'\\ab1.0(+ AS", max_size=12))
def test_quoted_texts_in_sql_stay_as_they_are(spark, text):
    from plumbline.functions.sql import sql_text

    assert spark.sql(f"SELECT {sql_text(F.concat(F.lit(text), F.lit('+(')))}").first()[0] == text + "+("
