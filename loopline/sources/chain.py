"""Sources as callables returning DataFrames, asked in order or all at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of failure from the one that says most about the question to the one that says least.
CODES = ["INVALID_INPUT", "NOT_FOUND", "UNSUPPORTED", "RATE_LIMITED", "UPSTREAM_AUTH", "UPSTREAM_UNAVAILABLE"]


class SourceError(Exception):
    """A typed failure; an empty answer is not one."""

    def __init__(self, code: str, message: str, source: str | None = None) -> None:
        super().__init__(message)
        self.code, self.source = code, source


@dataclass
class Source:
    """A named source with the questions it can answer."""

    name: str
    upstream: str
    answers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    evidence: bool = True


def _failure(e: Exception, source: str) -> SourceError:
    return e if isinstance(e, SourceError) else SourceError("UPSTREAM_UNAVAILABLE", str(e), source)


def combined(failures: list[SourceError], question: str) -> SourceError:
    """The failure to report for several: an unreachable source outranks 'not found', which may then be wrong."""
    codes = {f.code for f in failures}
    for code in ("INVALID_INPUT", "UPSTREAM_UNAVAILABLE", "RATE_LIMITED", "UPSTREAM_AUTH", "NOT_FOUND"):
        if code in codes:
            return SourceError(code, "; ".join(f"{f.source}: {f}" for f in failures if f.code == code))
    return SourceError("UNSUPPORTED", f"no source answers {question}")


def first(sources: list[Source], question: str, *args, miss: Callable[[DataFrame], bool] | None = None) -> tuple[str, DataFrame]:
    """The first source's answer that neither fails nor is a miss; invalid input ends the chain at once."""
    failures: list[SourceError] = []
    for s in sources:
        if question not in s.answers:
            continue
        try:
            df = s.answers[question](*args)
            if miss and miss(df):
                failures.append(SourceError("NOT_FOUND", "no answer", s.name))
                continue
            return s.name, df
        except Exception as e:  # noqa: BLE001
            f = _failure(e, s.name)
            if f.code == "INVALID_INPUT":
                raise f from e
            failures.append(f)
    raise combined(failures, question)


def ask_all(sources: list[Source], question: str, *args) -> tuple[DataFrame | None, dict[str, SourceError]]:
    """All answers united with ``source``, ``prio``, ``upstream`` and ``counted``, and the failures by source."""
    out, failed = None, {}
    for prio, s in enumerate(sources, 1):
        if question not in s.answers:
            continue
        try:
            df = s.answers[question](*args)
        except Exception as e:  # noqa: BLE001
            failed[s.name] = _failure(e, s.name)
            continue
        df = df.withColumns({"source": F.lit(s.name), "prio": F.lit(prio), "upstream": F.lit(s.upstream), "counted": F.lit(s.evidence)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def capabilities(sources: list[Source]) -> list[dict]:
    """What each source answers."""
    return [{"source": s.name, "upstream": s.upstream, "evidence": s.evidence, "answers": sorted(s.answers)} for s in sources]
