"""Decorators for plain Python functions: times, retries, caches, checks."""

from __future__ import annotations

import functools
import logging
import time
import tracemalloc
import warnings
from collections.abc import Callable

log = logging.getLogger("gridloom")


def timer(f: Callable) -> Callable:
    """Log how long each call takes."""

    @functools.wraps(f)
    def run(*args, **options):
        began = time.perf_counter()
        try:
            return f(*args, **options)
        finally:
            log.info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return run


def retry(max_attempts: int = 3, delay: float = 1.0, exceptions: tuple[type[BaseException], ...] = (Exception,)) -> Callable:
    """Call again after these errors, waiting longer each time; the last error is raised."""
    if max_attempts < 1:
        raise ValueError("at least one attempt")

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            for attempt in range(max_attempts):
                try:
                    return f(*args, **options)
                except exceptions as error:
                    if attempt == max_attempts - 1:
                        raise
                    log.warning("%s failed (%s), trying again", f.__name__, error)
                    time.sleep(delay * 2**attempt)

        return run

    return wrap


def log_call(f: Callable) -> Callable:
    """Log each call and what it returns or raises, by kind."""

    @functools.wraps(f)
    def run(*args, **options):
        log.info("%s called", f.__name__)
        try:
            out = f(*args, **options)
        except Exception as error:
            log.info("%s raised %s", f.__name__, type(error).__name__)
            raise
        log.info("%s returned %s", f.__name__, type(out).__name__)
        return out

    return run


def memory_usage(f: Callable) -> Callable:
    """Log the peak of Python's memory during each call."""

    @functools.wraps(f)
    def run(*args, **options):
        nested = tracemalloc.is_tracing()
        if not nested:
            tracemalloc.start()
        tracemalloc.reset_peak()
        try:
            return f(*args, **options)
        finally:
            log.info("%s peaked at %.1f MB", f.__name__, tracemalloc.get_traced_memory()[1] / 1e6)
            if not nested:
                tracemalloc.stop()

    return run


#: Results by arguments, which must be hashable.
cache = functools.cache


def deprecated(message: str = "") -> Callable:
    """Warn at each call."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            warnings.warn(f"{f.__name__} is deprecated. {message}".strip(), DeprecationWarning, stacklevel=2)
            return f(*args, **options)

        return run

    return wrap


def suppress(default: object = None, exceptions: tuple[type[BaseException], ...] = (Exception,)) -> Callable:
    """Log these errors and return ``default`` instead."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            try:
                return f(*args, **options)
            except exceptions as error:
                log.warning("%s failed: %s", f.__name__, error)
                return default

        return run

    return wrap


def validate(**checks: Callable[[object], bool]) -> Callable:
    """Refuse arguments, by name, that don't pass their check."""
    import inspect

    def wrap(f: Callable) -> Callable:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(*args, **options):
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            for name, check in checks.items():
                if name in bound.arguments and not check(bound.arguments[name]):
                    raise ValueError(f"{f.__name__}: {name}={bound.arguments[name]!r} is not valid")
            return f(*args, **options)

        return run

    return wrap


def once(f: Callable) -> Callable:
    """Run at the first call only; later ones return what that returned."""
    out: list = []

    @functools.wraps(f)
    def run(*args, **options):
        if not out:
            out.append(f(*args, **options))
        return out[0]

    return run
