"""Batches of statements for a text-completion service: prompts, requests through a given client, replies as rows."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP = "#S_#T#O#P_#"
#: A client: from messages and a stop text to the reply's text. The factory runs once for each Python worker.
Client = Callable[[list[dict], str | None], str]


class BadReply(ValueError):
    """A reply that isn't the rows that were asked for."""


class ServiceError(Exception):
    """What a client raises if the service fails, and may not fail the next time."""


def questions(tasks: Sequence[str]) -> dict[str, str]:
    """``Question0``, ``Question1``, ... of the tasks in order."""
    return {f"Question{i}": t for i, t in enumerate(tasks)}


def prompt(statements: Column | str, tasks: Mapping[str, Sequence[str] | None], background: str, target: str = "statement", identifier: str = "id", stop: str = STOP) -> Column:
    """The prompt for a JSON list of statements. One task is answered under ``response``, several under ``Question0..n``."""
    own = F.col(statements) if isinstance(statements, str) else statements
    keys = ["response"] if len(tasks) == 1 else list(questions(list(tasks)))
    asked = "\n".join(f"{k}: {t}" + (f" Choose from: {json.dumps(list(c), ensure_ascii=False)}" if c else " Answer freely.") for k, (t, c) in zip(keys, tasks.items()))
    form = json.dumps([{**dict.fromkeys(keys, "..."), identifier: f"<the statement's {identifier}>"}])
    head = f"Background: {background}\nBelow is a JSON list. Judge the value of {target!r} of each entry on its own.\n{asked}\nReply with JSON of this form, an entry for each statement, then {stop}\n{form}\nStatements:\n"
    return F.concat(F.lit(head), own, F.lit("\nJSON ="))


def chunks(df: DataFrame, size: int | None, target: str = "statement", identifier: str = "id") -> DataFrame:
    """``chunk BIGINT, n INT, statements``: JSON lists of up to ``size`` statements in order of identifier; None makes one list.

    Rows are numbered without a global sort: by hash into groups of many chunks, then in their group.
    """
    pair = F.struct(F.col(identifier), F.col(target))
    own = df.select(F.col(identifier), F.col(target))
    if size is None:
        return own.agg(F.lit(0).cast("long").alias("chunk"), F.count("*").cast("int").alias("n"), F.to_json(F.array_sort(F.collect_list(pair))).alias("statements"))
    from pyspark.sql import Window

    groups = own.withColumn("_g", F.pmod(F.xxhash64(identifier), F.lit(max(1, df.sparkSession.sparkContext.defaultParallelism))))
    numbered = groups.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("_g").orderBy(identifier, target)) - 1) / size))
    out = numbered.groupBy("_g", "_k").agg(F.count("*").cast("int").alias("n"), F.to_json(F.array_sort(F.collect_list(pair))).alias("statements"))
    return out.select((F.shiftleft(F.col("_k").cast("long"), 20) + F.col("_g")).alias("chunk"), "n", "statements")


def parse_reply(text: str | None, expected: int) -> tuple[list[dict], bool, bool]:
    """(rows, wrong form, wrong number): a JSON list, in a fenced block or bare; one that ends in dots was cut off, null is no reply."""
    try:
        if text is None or text.endswith("..."):
            raise BadReply("cut off")
        fenced = re.search(r"```json(.*?)```", text, re.DOTALL)
        rows = json.loads(fenced.group(1).strip() if fenced else text, strict=False)
        return (rows, not (isinstance(rows, list) and all(isinstance(r, dict) for r in rows)), len(rows) != expected)
    except (ValueError, TypeError):
        return [], True, True


def reply_rows(text: Column | str) -> Column:
    """The rows of a reply as ``ARRAY<MAP<STRING, STRING>>``, in the JVM; null where it has another form."""
    own = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(own, r"(?s)```json(.*?)```", 1)
    body = F.when(fenced != "", F.trim(fenced)).otherwise(own)
    return F.when(~own.endswith("..."), F.from_json(body, "array<map<string,string>>"))


def default_messages(text: str) -> list[dict]:
    return [{"role": "user", "content": text}]


class Limiter:
    """At most ``calls`` in ``period`` seconds, in one Python worker."""

    def __init__(self, calls: int, period: float):
        self.calls, self.period, self.times = calls, period, []

    def wait(self) -> None:
        now = time.monotonic()
        self.times = [t for t in self.times if now - t < self.period]
        if len(self.times) >= self.calls:
            time.sleep(self.period - (now - self.times[0]))
        self.times.append(time.monotonic())


def classify(
    df: DataFrame,
    tasks: Mapping[str, Sequence[str] | None],
    client: Callable[[], Client],
    background: str = "",
    target: str = "statement",
    identifier: str = "id",
    size: int | None = None,
    result: str = "rows",
    stop: str | None = STOP,
    messages: Callable[[str], list[dict]] = default_messages,
    prompts: Callable[..., Column] = prompt,
    on_form: str = "raise",
    on_number: str = "raise",
    one_by_one: bool = False,
    calls: int = 1000,
    period: float = 60.0,
    tries: int = 8,
    pause: float = 1.0,
    retry: tuple[type[Exception], ...] = (ServiceError, ConnectionError, TimeoutError),
    workers: int | None = None,
) -> DataFrame:
    """``chunk, answer MAP<STRING, STRING>, error`` (``rows``), or ``chunk, reply, error`` (``raw``).

    A call that fails by one of ``retry`` is tried again, up to ``tries`` times, after a random part of ``pause``,
    doubled each time up to a minute; the last failure is raised. Any other failure counts as a reply of wrong form
    and number. ``on_form``: skip or raise; ``on_number``: warn (the error column says so), ignore or raise.
    ``one_by_one`` asks again for each statement of a list whose reply was wrong. The limit is for each of ``workers``
    partitions. ``prompts`` makes the prompt, with the arguments of ``prompt``; without a ``size`` it has all statements.
    """
    if result not in ("rows", "raw") or on_form not in ("skip", "raise") or on_number not in ("warn", "ignore", "raise"):
        raise ValueError("result: rows or raw; on_form: skip or raise; on_number: warn, ignore or raise")
    marked = stop or ""
    lists = chunks(df, size, target, identifier).select("chunk", "n", "statements")
    lists = lists.repartition(workers) if workers else lists
    header = prompts("statements", tasks, background, target, identifier, marked)
    asked = lists.withColumn("prompt", header)
    # for single statements: what stands before and after them in a prompt
    before, after = [r for r in df.sparkSession.range(1).select(F.split(prompts(F.lit("\x00"), tasks, background, target, identifier, marked), "\x00").alias("x")).first()["x"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, limit = client(), Limiter(calls, period)

        def ask(text: str) -> str | None:
            for k in range(tries):
                limit.wait()
                try:
                    return own(messages(text), stop)
                except retry:
                    if k + 1 == tries:
                        raise
                    time.sleep(min(pause * 2**k, 60) * random.random())
                except Exception:
                    return None
            raise AssertionError

        for frame in frames:
            out = []
            for chunk, n, statements, text in frame.itertuples(index=False):
                reply = ask(text)
                if result == "raw":
                    out.append((chunk, reply, "form" if reply is None else None))
                    continue
                rows, form, number = parse_reply(reply, n)
                if (form or number) and one_by_one:
                    rows, form, number = [], False, False
                    for s in json.loads(statements):
                        some, f, m = parse_reply(ask(before + json.dumps([s], ensure_ascii=False) + after), 1)
                        rows, form, number = rows + ([] if f else some), form or f, number or m
                if form and on_form == "raise":
                    raise BadReply(f"not a list of rows: {(reply or "")[:200]!r}")
                if number and not form and on_number == "raise":
                    raise BadReply(f"{len(rows)} rows for {n} statements")
                error = "form" if form else "number" if number and on_number == "warn" else None
                rows = [] if form and not one_by_one else rows
                out += [(chunk, {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in r.items()}, error) for r in rows] or [(chunk, None, error)]
            yield pd.DataFrame(out, columns=["chunk", "answer" if result == "rows" else "reply", "error"])

    kind = "answer map<string,string>" if result == "rows" else "reply string"
    return asked.select("chunk", "n", "statements", "prompt").mapInPandas(run, f"chunk long, {kind}, error string")
