"""The boundary to the outside: tools in isolated subprocesses, models behind a replayable client.

Both are safe to run again: a retried task repeats tool runs in fresh processes, and a replay client answers from a table.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillflow.operators.rewards import EXEC_FAILED, EXEC_OK

STDERR_CLIP = 300
MEMORY_BYTES = 512 << 20
#: Starts once and forks for every job, a line of JSON: the child leaves the loop and runs the job in a process of its own, under
#: its limits and with no input; the parent answers with a line of (return code or null, stdout, stderr). Arguments come as
#: JSON, so none is ever spliced into source.
RUNNER = """
import atexit, json, os, resource, select, sys, time

def last():
    # After the job's threads and exit handlers. Taking the interpreter down would copy all memory shared with the parent.
    try:
        for f in (sys.stdout, sys.stderr):
            if f and not f.closed:
                f.flush()
    except Exception:
        os._exit(120)
    os._exit(returned)

def outcome(pid, ends, seconds):
    until, left, got, code = time.monotonic() + seconds, set(ends), {e: [] for e in ends}, None
    while code is None and (wait := until - time.monotonic()) > 0:
        for e in select.select(left, [], [], wait)[0] if left else ():
            got[e].append(os.read(e, 65536))
            if not got[e][-1]:
                left.discard(e)
        if not left:
            done, status = os.waitpid(pid, os.WNOHANG)
            if done:
                code = os.waitstatus_to_exitcode(status)
            else:
                time.sleep(0.0005)
    if code is None:
        os.kill(pid, 9)
        os.waitpid(pid, 0)
    out, err = (b"".join(got[e]).decode(errors="replace").replace("\\r\\n", "\\n").replace("\\r", "\\n") for e in ends)
    return code, out, err

while True:
    line = sys.stdin.readline()
    if not line:
        os._exit(0)
    job, ends, own = json.loads(line), *zip(os.pipe(), os.pipe())
    pid = os.fork()
    if not pid:
        break
    for end in own:
        os.close(end)
    print(json.dumps(outcome(pid, ends, job["wall"])), flush=True)
    for end in ends:
        os.close(end)

for end in ends:
    os.close(end)
none = os.open(os.devnull, os.O_RDONLY)
for end, at in ((none, 0), (own[0], 1), (own[1], 2)):
    os.dup2(end, at)
    os.close(end)
os.chdir(job["where"])
for what, most in job["limits"].items():
    resource.setrlimit(getattr(resource, what), (most, most))
atexit.register(last)
space, returned = {"__name__": "tool"}, 0
try:
    exec(compile(job["code"], "tool", "exec"), space)
    if job["function"]:
        print(space[job["function"]](**job["args"]))
except SystemExit as e:
    returned = (e.code if isinstance(e.code, int) else int(e.code is not None)) & 255
    raise
except BaseException:
    returned = 1
    raise
"""


class Runner:
    """Runs code in processes without environment, one for each run, all forked from one that is started when it is first needed."""

    def __init__(self) -> None:
        self.server: subprocess.Popen | None = None

    def __enter__(self) -> Runner:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.server:
            self.server.kill()
            self.server.communicate()
            self.server = None

    def run(self, code: str, function: str | None = None, args: dict | None = None, timeout: float = 10.0) -> dict:
        """{status: Success or Error, stdout, stderr} of code, or of one function of it."""
        if self.server is None or self.server.poll() is not None:
            self.close()
            self.server = subprocess.Popen([sys.executable, "-I", "-c", RUNNER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd="/", env={"PATH": os.defpath})
        limits = {"RLIMIT_AS": MEMORY_BYTES, "RLIMIT_CPU": int(timeout) + 1, "RLIMIT_FSIZE": 1 << 20}
        with tempfile.TemporaryDirectory() as where:
            job = {"code": code, "function": function, "args": args or {}, "where": where, "limits": limits, "wall": max(1.0, timeout)}
            try:
                self.server.stdin.write(json.dumps(job).encode() + b"\n")
                self.server.stdin.flush()
                line = self.server.stdout.readline()
            except BrokenPipeError:
                line = b""
        if not line:  # the code has ended the process it is forked from
            self.close()
            return {"status": "Error", "stdout": "", "stderr": "Execution ended its runner"}
        returned, out, err = json.loads(line)
        if returned is None:
            return {"status": "Error", "stdout": "", "stderr": "Execution timed out"}
        return {"status": "Error" if returned else "Success", "stdout": out.strip(), "stderr": err[-STDERR_CLIP:]}


def run_code(code: str, function: str | None = None, args: dict | None = None, timeout: float = 10.0) -> dict:
    """{status: Success or Error, stdout, stderr} of code, or of one function of it, in a process without environment."""
    with Runner() as runner:
        return runner.run(code, function, args, timeout)


RESULT = "status string, stdout string, stderr string, tool_result string, reward_delta double"


def run_in_sandbox(url: str, code: str, function: str | None = None, args: dict | None = None, timeout: float = 10.0) -> dict:
    """The same by a sandbox server: posts {code, language}, reads {status, run_result}. A server that fails is an error of
    the run; nothing is ever run here in its place."""
    call = f"\nimport json as _json\nprint({function}(**_json.loads({json.dumps(json.dumps(args or {}))})))\n" if function else ""
    asked = urllib.request.Request(url, json.dumps({"code": code + call, "language": "python"}).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            reply = json.load(got)
    except (OSError, ValueError) as e:
        return {"status": "Error", "stdout": "", "stderr": f"sandbox: {e}"[-STDERR_CLIP:]}
    result = reply.get("run_result") or {}
    return {"status": "Success" if reply.get("status") == "Success" else "Error", "stdout": (result.get("stdout") or "").strip(), "stderr": (result.get("stderr") or "")[-STDERR_CLIP:]}


def execute_jobs(jobs: DataFrame, partitions: int | None = None, sandbox: str | None = None) -> DataFrame:
    """Adds the result columns to (.., code, function, args json, timeout). Partitions bound how many tools run at once; by default
    jobs are dealt over all cores, however few partitions their small rows lie in.

    sandbox: the address of a sandbox server, by default that of the session's setting rillflow.sandbox.url; without one,
    tools run in local processes.
    """
    sandbox = sandbox or jobs.sparkSession.conf.get("rillflow.sandbox.url", None)
    rows = jobs.repartition(partitions or jobs.sparkSession.sparkContext.defaultParallelism)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Runner() as runner:
            yield from finished(runner, batches)

    def finished(runner: Runner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for code, function, args, timeout in zip(*(batch.column(c).to_pylist() for c in ("code", "function", "args", "timeout")), strict=True):
                try:
                    given = json.loads(args or "{}")
                except ValueError:
                    given = None
                if not isinstance(given, dict):
                    got = {"status": "Error", "stdout": "", "stderr": "arguments must be a JSON object"}
                else:
                    got = run_in_sandbox(sandbox, code or "", function, given, float(timeout or 10)) if sandbox else runner.run(code or "", function, given, float(timeout or 10))
                ok = got["status"] == "Success"
                out.append({**got, "tool_result": (got["stdout"] or "(no output)") if ok else f"Error: {got['stderr']}", "reward_delta": EXEC_OK if ok else EXEC_FAILED})
            made = [pa.array([r[f.name] for r in out], pa.float64() if f.name == "reward_delta" else pa.string()) for f in result]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *result.names])

    # The jobs' own columns stay Arrow arrays, so keys come back as they were, nulls among 64-bit numbers too.
    result = StructType.fromDDL(RESULT)
    return rows.mapInArrow(work, StructType([*jobs.schema.fields, *result.fields]))


class ModelClient(Protocol):
    """Replies to prompts. generate adds `reply` (null where there is none) to rows of (prompt, turn)."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class ReplayClient:
    """Answers from a table (prompt, turn, reply); what it does not hold stays null, as a call that failed."""

    def __init__(self, replies: DataFrame) -> None:
        self.replies = replies.select(F.sha2("prompt", 256).alias("_p"), F.col("turn").alias("_t"), "reply")

    def generate(self, prompts: DataFrame) -> DataFrame:
        keyed = prompts.withColumn("_h", F.sha2("prompt", 256))
        return keyed.join(self.replies, (F.col("_h") == F.col("_p")) & (F.col("turn") == F.col("_t")), "left").drop("_h", "_p", "_t")


class FunctionClient:
    """Calls a Python function (texts to replies) in Arrow batches; repartition before it to bound concurrency."""

    def __init__(self, function) -> None:
        self.function = function

    def generate(self, prompts: DataFrame) -> DataFrame:
        ask = F.pandas_udf(lambda texts: pd.Series(self.function(texts.tolist())), "string")
        return prompts.withColumn("reply", ask("prompt"))
