"""Control flow of a span of C# statements: what leaves it, and whether its start and end can be reached."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from factloom.sources.csharp import Token, _closing, tokens

_LOOPS = {"for", "foreach", "while"}
_HEADED = _LOOPS | {"if", "using", "lock", "fixed", "switch"}


@dataclass
class Flow:
    """Lines of returns and of other ways out, and whether what follows can be reached."""

    returns: list[tuple[int, str]] = field(default_factory=list)
    exits: list[tuple[int, str]] = field(default_factory=list)
    end: bool = True
    breaks: bool = False
    first: int | None = None
    dead: list[int] = field(default_factory=list)


def _line_text(ts: list[Token]) -> str:
    text = " ".join(t.text for t in ts)
    return text if len(text) <= 120 else text[:120] + "..."


def _statement(ts: list[Token], at: int, flow: Flow, inside: tuple[int, int], loop: bool) -> tuple[int, bool, bool]:
    """The place after the statement at ``at``, whether its end can be reached, and whether it breaks out of the loop around."""
    word, line = ts[at].text, ts[at].line
    counted = inside[0] <= line <= inside[1]
    if word == "{":
        end = _closing(ts, at)
        open_, broke = _sequence(ts[at + 1 : end], flow, inside, loop)
        return end + 1, open_, broke
    if word in _HEADED and at + 1 < len(ts) and ts[at + 1].text == "(":
        head = _closing(ts, at + 1)
        forever = word in ("while", "for") and _endless(word, ts[at + 2 : head])
        if word == "switch" and head + 1 < len(ts):
            end = _closing(ts, head + 1)
            _sequence([t for t in ts[head + 2 : end]], flow, inside, True)
            return end + 1, True, False
        after, open_, broke = _statement(ts, head + 1, flow, inside, loop or word in _LOOPS) if head + 1 < len(ts) else (len(ts), True, False)
        if word == "if":
            if after < len(ts) and ts[after].text == "else" and after + 1 < len(ts):
                after, other, more = _statement(ts, after + 1, flow, inside, loop)
                return after, open_ or other, broke or more
            return after, True, broke
        if word in _LOOPS:
            return after, broke or not forever, False
        return after, open_, broke
    if word == "do":
        after, open_, broke = _statement(ts, at + 1, flow, inside, True)
        end = next((k for k in range(after, len(ts)) if ts[k].text == ";"), len(ts) - 1)
        forever = _endless("while", ts[after + 2 : end - 1]) if after + 2 < len(ts) else False
        return end + 1, broke or not forever, False
    if word in ("try", "checked", "unchecked", "unsafe") and at + 1 < len(ts) and ts[at + 1].text == "{":
        after, open_, broke = _statement(ts, at + 1, flow, inside, loop)
        while after < len(ts) and ts[after].text in ("catch", "finally"):
            final = ts[after].text == "finally"
            start = next((k for k in range(after, len(ts)) if ts[k].text == "{"), None)
            if start is None:
                return len(ts), open_, broke
            after, other, more = _statement(ts, start, flow, inside, loop)
            open_, broke = (open_ and other) if final else (open_ or other), broke or more
        return after, open_, broke
    end = at
    while end < len(ts) and ts[end].text != ";":
        end = _closing(ts, end) + 1 if ts[end].text in ("(", "{", "[") else end + 1
    if counted and word == "return":
        flow.returns.append((line, _line_text(ts[at : end + 1])))
    elif counted and word in ("throw", "goto") or counted and word in ("break", "continue") and not loop:
        flow.exits.append((line, _line_text(ts[at : end + 1])))
    return end + 1, word not in ("return", "throw", "goto", "break", "continue"), word == "break"


def _endless(word: str, head: list[Token]) -> bool:
    texts = [t.text for t in head]
    if word == "while":
        return texts == ["true"]
    middle = [k for k, t in enumerate(texts) if t == ";"]
    return len(middle) == 2 and texts[middle[0] + 1 : middle[1]] in ([], ["true"])


def _sequence(ts: list[Token], flow: Flow, inside: tuple[int, int], loop: bool) -> tuple[bool, bool]:
    at, open_, broke = 0, True, False
    while at < len(ts):
        if ts[at].text in ("case", "default") and loop:
            colon = next((k for k in range(at, len(ts)) if ts[k].text == ":"), None)
            if colon is not None:
                at, open_ = colon + 1, True
                continue
        if ts[at].text == ";":
            at += 1
            continue
        line = ts[at].line
        if inside[0] <= line <= inside[1]:
            if flow.first is None:
                flow.first = line
                flow.end = open_
            if not open_:
                flow.dead.append(line)
        at, passes, more = _statement(ts, at, flow, inside, loop)
        open_, broke = open_ and passes, broke or (more and open_)
    return open_, broke


def control_flow(text: str, start: int, stop: int) -> dict | None:
    """Of the statements on lines ``start`` to ``stop`` of a file: whether the first can be reached and the end can, returns, other exits, and lines that can't be reached; none if no statement stands there.

    The span is read by itself, from the first brace or statement on it; conditions are not evaluated, but for ``true`` and none in a loop.
    """
    ts = [t for t in tokens(text) if start <= t.line <= stop]
    depth, keep = 0, []
    for t in ts:  # a brace that closes what was opened before the span ends it there
        depth += (t.text == "{") - (t.text == "}")
        if depth < 0:
            depth = 0
            continue
        keep.append(t)
    if stop < start or not keep:
        return None
    flow = Flow()
    open_, _ = _sequence(keep, flow, (start, stop), False)
    return {"start_reachable": flow.end, "end_reachable": open_, "returns": flow.returns, "exits": flow.exits, "unreachable": flow.dead}


def analyze_control_flow(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``(file, start, stop, start_reachable, end_reachable, returns, exits, unreachable)`` of ``requests(file, start, stop)`` in ``files(file, text)``; spans without statements give none."""
    asked = files.join(requests, "file").select("file", "text", "start", "stop")

    def look(batches):
        for pdf in batches:
            rows = []
            for f, text, a, b in zip(pdf.file, pdf.text, pdf.start, pdf.stop, strict=True):
                found = control_flow(text, int(a), int(b)) if text is not None else None
                if found:
                    rows.append((f, int(a), int(b), found["start_reachable"], found["end_reachable"], [f"{n}: {x}" for n, x in found["returns"]], [f"{n}: {x}" for n, x in found["exits"]], found["unreachable"]))
            yield pd.DataFrame(rows, columns=["file", "start", "stop", "start_reachable", "end_reachable", "returns", "exits", "unreachable"])

    return asked.mapInPandas(look, "file string, start int, stop int, start_reachable boolean, end_reachable boolean, returns array<string>, exits array<string>, unreachable array<int>")
