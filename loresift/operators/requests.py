"""Model requests that survive lost tasks: every answer is logged under the hash of its prompt as soon as it is there.

Prompts are dealt by their hash into buckets, one folder of the log each. A task reads what its buckets' folders
hold, asks only for what is missing, a bounded number of requests at a time, and appends each answer to a file of
its own before it goes on. So a task that is run again, an attempt that runs beside another, or the same job tomorrow
repeats only open requests. Equal prompts are asked once. Errors are not logged: they are asked again.

The log is a folder that all executors reach as files.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import local_path


class Log:
    """Answers of one bucket."""

    def __init__(self, folder: str, bucket: int):
        self.folder = f"{folder}/{bucket:05d}"
        self.lock, self.file = threading.Lock(), None

    def answers(self) -> dict[str, str]:
        """What is logged, by key. A line that was cut off when its writer died is no answer."""
        out = {}
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                with open(f"{self.folder}/{name}", "rb") as f:
                    for line in f:
                        try:
                            said = json.loads(line)
                            out[said["key"]] = said["payload"]
                        except (ValueError, KeyError):
                            continue
        return out

    def add(self, key: str, payload: str) -> None:
        with self.lock:
            if self.file is None:
                os.makedirs(self.folder, exist_ok=True)
                self.file = open(f"{self.folder}/{uuid.uuid4().hex}.jsonl", "wb")  # noqa: SIM115 (closed by close)
            self.file.write(json.dumps({"key": key, "payload": payload}).encode() + b"\n")
            self.file.flush()
            os.fsync(self.file.fileno())

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Pace:
    """At most so many calls a second from one task; 0 is no bound."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            at = max(self.next, now := time.monotonic())
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


def logged(prompts: DataFrame, ask: Callable[[str, str], tuple[str | None, str | None]], log: str, *, model: str = "", buckets: int = 64, in_flight: int = 4, per_second: float = 0.0) -> DataFrame:
    """(query_id, payload, error) of (query_id, system_prompt, user_prompt). `ask` turns a prompt into (payload,
    error); it is called by at most `in_flight` threads of a task, and of prompts that are not in the log."""
    folder = local_path(log)
    key = F.sha2(F.concat_ws("\u0000", F.lit(model), "system_prompt", "user_prompt"), 256)
    rows = prompts.select("query_id", "system_prompt", "user_prompt", key.alias("key"))
    bucket = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    one = rows.groupBy("key").agg(F.first("system_prompt").alias("system_prompt"), F.first("user_prompt").alias("user_prompt")).withColumn("bucket", bucket)

    def run(batches):
        pace, logs, known = Pace(per_second), {}, {}

        def get(key, bucket, system, user):
            if key in known[bucket]:
                return known[bucket][key], None
            pace.wait()
            payload, error = ask(system, user)
            if payload is not None and error is None:
                logs[bucket].add(key, payload)
            return payload, error

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                for n in sorted(set(b["bucket"])):
                    if n not in logs:
                        logs[n] = Log(folder, n)
                        known[n] = logs[n].answers()
                got = list(pool.map(get, b["key"], b["bucket"], b["system_prompt"], b["user_prompt"]))
                yield pd.DataFrame({"key": b["key"], "payload": [p for p, _ in got], "error": [e for _, e in got]})
        for x in logs.values():
            x.close()

    dealt = one.repartitionById(buckets, "bucket")
    said = dealt.mapInPandas(run, "key string, payload string, error string")
    return rows.select("query_id", "key").join(said, "key").select("query_id", "payload", "error")
