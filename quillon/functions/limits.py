"""Time: how long a call takes, and calls that may not take longer."""

from __future__ import annotations

import functools
import multiprocessing
import time
from collections.abc import Callable


def timed(report: Callable[[str, float], None]) -> Callable:
    """A decorator that reports a function's name and seconds."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                report(f.__name__, time.perf_counter() - began)

        return call

    return wrap


def _child(pipe, f: Callable, args: tuple, kwargs: dict) -> None:
    try:
        pipe.send((True, f(*args, **kwargs)))
    except Exception as e:
        pipe.send((False, e))


def call_within(seconds: float, f: Callable, *args, **kwargs):
    """The result of a call in a process of its own; TimeoutError, and the process ended, if it takes longer."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)
    p = context.Process(target=_child, args=(there, f, args, kwargs), daemon=True)
    p.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise TimeoutError(f"more than {seconds} s")
        good, value = here.recv()
    finally:
        if p.is_alive():
            p.terminate()
        p.join()
        here.close()
    if not good:
        raise value
    return value
