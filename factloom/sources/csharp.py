"""Facts from C# text: a lexer and a declaration parser, run file by file with ``mapInPandas``.

Only names are resolved, not overloads or inferred types; facts that rest on a name alone say so
(``confidence = 'name_only'``). Bodies give uses of names with their kind, calls, throws, catches, try blocks, event
subscriptions, locals and complexity.

Facts by ``kind``, beside ``file``, ``project``, ``line``, ``col`` and the holder's full name in ``container``:

* ``namespace``, ``using``, ``type`` (``detail``: class, struct, interface, enum, record, delegate), ``base``, ``attribute`` (``detail``: arguments);
* ``member`` (``detail``: method, constructor, destructor, property, indexer, field, constant, event, operator, conversion; ``type``: its type; ``n``,
  ``m``, ``nest``: cyclomatic and cognitive score and deepest nesting, of a property's worst accessor);
* ``param`` (``n``: place, ``type``, ``detail``: modifier, ``extra``: default);
* ``ref`` (``detail``: one of ``REF_KINDS``), ``call`` (``detail``: constructor or method, ``n``: arguments, ``type``: type arguments, ``extra``: what
  stands before, ``m``: 1 if the value is dropped, 2 if it is awaited);
* ``throw`` (name or ``(rethrow)``, ``extra``: the clause's type in which it stands, ``n``: try block), ``catch`` (``detail``: empty, rethrows; ``n``: has a filter; ``m``: try block), ``try`` (``n``: its number in the member);
* ``subscribe`` (name: left side, ``detail``: ``+=`` or ``-=``, ``extra``: handler), ``local`` (``type``, ``detail``: using or plain, ``extra``: new, call or
  value), ``kept`` (a local that is returned, passed on, assigned or disposed of).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.shared import cut

SCHEMA = "file string, project string, kind string, name string, full_name string, container string, line int, end_line int, modifiers string, detail string, n int, m int, confidence string, col int, nest int, type string, extra string"

#: Rows that a task holds before they go on.
FACTS_AT_ONCE = 5_000
# The kinds of a reference.
REF_KINDS = ["attribute", "base_type", "cast", "declaration", "invocation", "method_group", "nameof", "object_creation", "read", "readwrite", "type_argument", "type_check", "type_constraint", "typeof", "usage", "write", "xml_doc"]

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*)|(?P<string>\$?@?\$?"(?:""|\\.|[^"])*"|'(?:\\.|[^'\\])+')|(?P<name>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\?=?|\?\.|&&|\|\||::|[-+*/%&|^<>=!]=|\+\+|--|.)""",
    re.S | re.M | re.X,
)
# C# keywords that the parser looks for.
_TYPE_KINDS = {"class", "struct", "interface", "enum", "record"}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "partial", "extern", "unsafe", "new", "const", "required", "volatile", "file", "ref", "fixed", "implicit", "explicit"}
_BRANCHES = {"if", "for", "foreach", "while", "do", "catch"}
_NESTING = {"if", "for", "foreach", "while", "do", "switch", "catch"}
_NOT_CALLS = _BRANCHES | {"switch", "using", "lock", "fixed", "return", "throw", "new", "typeof", "sizeof", "default", "checked", "unchecked", "when", "await", "in", "is", "as", "and", "or", "not", "base", "this", "stackalloc", "nameof"}
_WORDS = _NOT_CALLS | _MODIFIERS | {"else", "do", "try", "finally", "goto", "break", "continue", "yield", "var", "out", "params", "true", "false", "null", "void", "int", "long", "short", "byte", "bool", "string", "object", "double", "float", "decimal", "char", "uint", "ulong", "ushort", "sbyte", "dynamic", "get", "set", "init", "add", "remove", "value", "where", "event", "operator", "class", "struct", "interface", "enum", "record", "namespace", "case", "is", "as"}
_PLAIN = {"var", "int", "string", "bool", "long", "double", "object", "decimal"}
_CREF = re.compile(r'\bcref\s*=\s*"(?:[A-Z]:)?([\w.]+)')


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int = 0


def tokens(text: str) -> list[Token]:
    """Tokens without white space, comments and directives; lines and columns from 1."""
    out, line, begin = [], 1, 0
    text = text.removeprefix("\ufeff")
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], line, m.start() - begin + 1))
        breaks = m[0].count("\n")
        if breaks:
            line += breaks
            begin = m.start() + m[0].rindex("\n") + 1
    return out


def _closing(ts: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end if there is none."""
    pair = {"(": ")", "{": "}", "[": "]"}
    opener, depth = ts[at].text, 0
    for i in range(at, len(ts)):
        if ts[i].text == opener:
            depth += 1
        elif ts[i].text == pair[opener]:
            depth -= 1
            if not depth:
                return i
    return len(ts) - 1


def complexity(body: list[Token], own: str = "") -> tuple[int, int, int]:
    """Cyclomatic and cognitive score and deepest nesting of a body.

    Cyclomatic: 1, and 1 for each branch, ``?:``, case with a value, ``&&``, ``||`` and ``??``.
    Cognitive: a control structure costs 1 and its nesting; ``else`` costs 1, a run of one logical
    operator 1, ``goto`` 1, and calling itself 1 once.
    """
    cyclomatic, cognitive, deepest = 1, 0, 0
    blocks: list[tuple[str, bool]] = []  # closing bracket, whether it nests
    nesting, pending, single, last_logic, recursed = 0, False, 0, "", False
    i = 0
    while i < len(body):
        t, text = body[i], body[i].text
        if t.kind == "name" and text in _NESTING:
            after_else = text == "if" and i and body[i - 1].text == "else"
            after_do = text == "while" and i and body[i - 1].text == "}" and _closes_do(body, i - 1)
            if text in _BRANCHES and not after_do:
                cyclomatic += 1
            if not after_do:
                cognitive += 1 if after_else else 1 + nesting + single
                pending = True
                deepest = max(deepest, nesting + single + 1)
            if i + 1 < len(body) and body[i + 1].text == "(":
                end = _closing(body, i + 1)
                inner = _logic(body[i + 2 : end])
                cyclomatic, cognitive = cyclomatic + inner[0], cognitive + inner[1]
                i = end + 1
                if i < len(body) and body[i].text != "{" and not after_do:
                    single += 1
                    pending = False
                continue
        elif t.kind == "name" and text == "else":
            if not (i + 1 < len(body) and body[i + 1].text == "if"):
                cognitive += 1
                pending = True
        elif t.kind == "name" and text == "goto":
            cognitive += 1
        elif t.kind == "name" and text == "case":
            cyclomatic += 1
        elif text in ("&&", "||", "??"):
            cyclomatic += 1
            if text != "??" and text != last_logic:
                cognitive += 1
            last_logic = text if text != "??" else last_logic
        elif text == "?" and _ternary(body, i):
            cyclomatic += 1
            cognitive += 1 + nesting + single
        elif text == own and not recursed and i + 1 < len(body) and body[i + 1].text == "(":
            cognitive, recursed = cognitive + 1, True
        if text == "{":
            blocks.append(("}", pending))
            nesting += pending
            pending = False
        elif text == "}" and blocks:
            nesting -= blocks.pop()[1]
        if text in (";", "{", "}"):
            last_logic, single = "", 0
        i += 1
    return cyclomatic, cognitive, deepest


def _logic(part: list[Token]) -> tuple[int, int]:
    cyclomatic = cognitive = 0
    last = ""
    for k, t in enumerate(part):
        if t.text in ("&&", "||", "??"):
            cyclomatic += 1
            cognitive += t.text != "??" and t.text != last
            last = t.text if t.text != "??" else last
        elif t.text == "?" and _ternary(part, k):
            cyclomatic, cognitive = cyclomatic + 1, cognitive + 1
    return cyclomatic, cognitive


def _closes_do(body: list[Token], at: int) -> bool:
    depth = 0
    for i in range(at, -1, -1):
        depth += (body[i].text == "}") - (body[i].text == "{")
        if not depth:
            return bool(i) and body[i - 1].text == "do"
    return False


def _ternary(body: list[Token], at: int) -> bool:
    depth = 0
    for t in body[at + 1 :]:
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return False
        elif t.text == ";" or (t.text == "," and not depth):
            return False
        elif t.text == ":" and not depth:
            return True
    return False


@dataclass
class _File:
    rows: list[tuple] = field(default_factory=list)

    def add(self, kind: str, name: str, container: str, at: Token, end: int | None = None, mods: str = "", detail: str = "", n: int = 0, m: int = 0, sure: bool = True, nest: int = 0, type_: str = "", extra: str = "") -> None:
        full = f"{container}.{name}" if container and kind in ("namespace", "type", "member", "param") else name
        self.rows.append((kind, name, full, container, at.line, end or at.line, mods, detail, int(n), int(m), "exact" if sure else "name_only", at.col, int(nest), type_, extra))


def _text(ts: list[Token]) -> str:
    """Tokens as one text, with a space only between words."""
    out = ""
    for t in ts:
        out += " " + t.text if out and (out[-1].isalnum() or out[-1] in "_,") and (t.text[0].isalnum() or t.text[0] in "_@") else t.text
    return out


def _dotted(ts: list[Token], at: int) -> tuple[str, int]:
    """The dotted name from ``at`` on, without type arguments, and the place after it."""
    name, k = ts[at].text, at + 1
    while k + 1 < len(ts):
        if ts[k].text == "<" and (end := _angle(ts, k)) is not None:
            k = end + 1
        elif ts[k].text in (".", "::") and ts[k + 1].kind == "name":
            name, k = f"{name}.{ts[k + 1].text}", k + 2
        else:
            break
    if k < len(ts) and ts[k].text == "<" and (end := _angle(ts, k)) is not None:
        k = end + 1
    return name, k


def _angle(ts: list[Token], at: int) -> int | None:
    """The place of the ``>`` that closes type arguments opened at ``at``; none if they are no type arguments."""
    depth = 0
    for k in range(at, len(ts)):
        if ts[k].text == "<":
            depth += 1
        elif ts[k].text == ">":
            depth -= 1
            if not depth:
                return k
        elif ts[k].kind != "name" and ts[k].text not in (",", ".", "?", "[", "]", "(", ")", "::"):
            return None
    return None


def _parts(ts: list[Token], by: str = ",") -> list[list[Token]]:
    """Tokens cut at top-level ``by``."""
    out: list[list[Token]] = [[]]
    k = 0
    while k < len(ts):
        end = _closing(ts, k) if ts[k].text in ("(", "[", "{") else _angle(ts, k) if ts[k].text == "<" else None
        if end is not None:
            out[-1] += ts[k : end + 1]
            k = end + 1
        elif ts[k].text == by:
            out.append([])
            k += 1
        else:
            out[-1].append(ts[k])
            k += 1
    return [x for x in out if x]


def _types(out: _File, ts: list[Token], owner: str, kind: str) -> None:
    """Uses of type names in a type's position; those in type arguments are ``type_argument``."""
    depth = 0
    for k, t in enumerate(ts):
        depth += (t.text == "<") - (t.text == ">")
        if t.kind == "name" and t.text not in _WORDS and not (k + 1 < len(ts) and ts[k + 1].text == "."):
            out.add("ref", t.text, owner, t, detail="type_argument" if depth else kind, sure=False)


def _params(out: _File, ts: list[Token], member: str) -> list[str]:
    """Facts of a parameter list, and its types."""
    types = []
    for n, part in enumerate(_parts(ts)):
        while part and part[0].text == "[":
            part = part[_closing(part, 0) + 1 :]
        mods = []
        while part and part[0].text in ("this", "ref", "out", "in", "params", "scoped", "readonly"):
            mods.append(part[0].text)
            part = part[1:]
        equals = next((k for k, t in enumerate(part) if t.text == "="), len(part))
        if equals >= 2 and part[equals - 1].kind == "name":
            types.append(_text(part[: equals - 1]))
            out.add("param", part[equals - 1].text, member, part[equals - 1], detail=" ".join(mods), n=n, type_=types[-1], extra=_text(part[equals + 1 :]))
            _types(out, part[: equals - 1], member, "declaration")
    return types


def _use(ts: list[Token], i: int, named: set[int], typed: set[int]) -> str | None:
    """The kind of the name at ``i`` as a reference; none for a declared or labelled name."""
    before = ts[i - 1].text if i else ""
    k = i
    while k >= 2 and ts[k - 1].text in (".", "?.") and ts[k - 2].kind == "name":
        k -= 2
    head = ts[k - 1].text if k else ""
    _, after = (ts[i].text, i + 1) if not (i + 1 < len(ts) and ts[i + 1].text == "<" and _angle(ts, i + 1) is not None) else (ts[i].text, _angle(ts, i + 1) + 1)
    then = ts[after].text if after < len(ts) else ""
    if i in named:
        return "nameof"
    if i in typed:
        return "typeof"
    if i and (ts[i - 1].kind == "name" and before not in _WORDS or before in _PLAIN):
        return None
    if then == "." and before != "new" and head in ("new", "is", "as"):
        return "usage"
    if head == "new":
        return "object_creation"
    if head in ("is", "as", "not") or (head == "case" and then not in (":", "when")):
        return "type_check"
    if then == "(":
        return "invocation"
    if then in ("=", "??=") and after + 1 < len(ts):
        return "write" if then == "=" else "readwrite"
    if then in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--") or head in ("++", "--"):
        return "readwrite"
    if head == "out":
        return "write"
    if head == "ref":
        return "readwrite"
    if before == "(" and then == ")" and after + 1 < len(ts) and (ts[after + 1].kind in ("name", "string", "number") or ts[after + 1].text == "(") and (i < 2 or ts[i - 2].kind != "name" or ts[i - 2].text in ("return", "await")) and ts[after + 1].text not in ("is", "as", "in", "when", "and", "or"):
        return "cast"
    if then and after < len(ts) and ts[after].kind == "name" and then not in _WORDS:
        return "declaration"
    if then == ":" and before in ("{", ";", "}"):
        return None
    return "read"


def _handler(ts: list[Token]) -> str:
    """What is subscribed: a lambda or delegate by its place, else the name."""
    if any(t.text == "=>" for t in ts):
        return f"<lambda at {ts[0].line}>"
    if ts and ts[0].text == "delegate":
        return f"<anonymous at {ts[0].line}>"
    if ts and ts[0].text == "new":
        ts = ts[next((k for k, t in enumerate(ts) if t.text == "("), 0) + 1 : -1]
    return _text(ts)


def _body(out: _File, ts: list[Token], member: str) -> None:
    named: set[int] = set()
    typed: set[int] = set()
    tries: list[tuple[int, int]] = []  # protected tokens
    clauses: list[tuple[int, int, str]] = []
    asks = {"nameof": named, "typeof": typed, "sizeof": typed, "default": typed}
    for i, t in enumerate(ts):
        if t.text in asks and i + 1 < len(ts) and ts[i + 1].text == "(":
            inside = range(i + 2, _closing(ts, i + 1))
            last = [k for k in inside if ts[k].kind == "name"]
            asks[t.text].update(last)
        elif t.text == "try" and i + 1 < len(ts) and ts[i + 1].text == "{":
            end = _closing(ts, i + 1)
            out.add("try", "try", member, t, ts[end].line, n=len(tries))
            tries.append((i + 2, end))
    inner = {x for i in range(1, len(ts)) if ts[i].text == "<" and ts[i - 1].kind == "name" and (end := _angle(ts, i)) is not None for x in range(i, end + 1)}
    owner = lambda i: max((k for k, (a, b) in enumerate(tries) if a <= i < b), default=-1)
    for i, t in enumerate(ts):
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.text == "catch":
            caught = _dotted(ts, i + 2)[0] if after == "(" and i + 2 < len(ts) else "(bare catch)"
            start = next((k for k in range(i, len(ts)) if ts[k].text == "{"), None)
            end = _closing(ts, start) if start is not None else i
            block = ts[start + 1 : end] if start is not None else []
            before = [k for k, (_, b) in enumerate(tries) if b < i]
            which = max(before, key=lambda k: tries[k][1], default=-1)
            out.add("catch", caught, member, t, detail="empty" if not block else "rethrows" if any(b.text == "throw" and n + 1 < len(block) and block[n + 1].text == ";" for n, b in enumerate(block)) else "", n=any(b.text == "when" for b in ts[i:start]), m=which)
            if start is not None:
                clauses.append((start, end, caught))
        elif t.text == "throw":
            name = _dotted(ts, i + 2)[0] if after == "new" and i + 2 < len(ts) else ""
            within = min((x for x in clauses if x[0] < i < x[1]), key=lambda x: x[1] - x[0], default=None)
            again = after == ";" or after == ""
            out.add("throw", name or ("(rethrow)" if again else f"({after})"), member, t, sure=bool(name), n=owner(i), extra=within[2] if within else "")
        elif t.text in ("+=", "-=") and i and ts[i - 1].kind == "name":
            end = next((k for k in range(i, len(ts)) if ts[k].text == ";"), len(ts))
            out.add("subscribe", ts[i - 1].text, member, ts[i - 1], detail=t.text, sure=False, extra=_handler(ts[i + 1 : end]))
        if t.kind != "name" or t.text in _WORDS or i in inner:
            continue
        use = _use(ts, i, named, typed)
        if use:
            out.add("ref", t.text, member, t, detail=use, sure=False)
        close = _angle(ts, i + 1) if after == "<" else None
        opened = close + 1 if close is not None and close + 1 < len(ts) else i + 1
        if opened < len(ts) and ts[opened].text == "(":
            _call(out, ts, i, opened, member)
        if close is not None:
            _types(out, ts[i + 1 : close + 1], member, "type_argument")
        if after == "=" and i and (ts[i - 1].kind == "name" or ts[i - 1].text in (">", "]", "?")) and ts[i - 1].text not in _WORDS - _PLAIN:
            _local(out, ts, i, member)
    for i, t in enumerate(ts):
        if t.text == "return" or t.text in ("out", "using"):
            k = i + 1 + (i + 1 < len(ts) and ts[i + 1].text == "(")
            if k < len(ts) and ts[k].kind == "name" and (k + 1 >= len(ts) or ts[k + 1].text in (";", ")", ",")):
                out.add("kept", ts[k].text, member, ts[k], detail=t.text, sure=False)
        elif t.text == "=" and i + 2 < len(ts) and ts[i + 1].kind == "name" and ts[i + 1].text not in _WORDS and ts[i + 2].text in (";", ","):
            out.add("kept", ts[i + 1].text, member, ts[i + 1], detail="assigned", sure=False)
        elif t.kind == "name" and i + 3 < len(ts) and ts[i + 1].text in (".", "?.") and ts[i + 2].text in ("Dispose", "DisposeAsync", "Close") and ts[i + 3].text == "(":
            out.add("kept", t.text, member, t, detail="disposed", sure=False)
        elif t.text in ("(", ",") and i + 2 < len(ts) and ts[i + 1].kind == "name" and ts[i + 1].text not in _WORDS and ts[i + 2].text in (",", ")"):
            out.add("kept", ts[i + 1].text, member, ts[i + 1], detail="passed", sure=False)


def _call(out: _File, ts: list[Token], i: int, opened: int, member: str) -> None:
    """A call of the name at ``i`` whose arguments open at ``opened``."""
    k, chained = i, False
    while k >= 2 and ts[k - 1].text in (".", "?."):
        if ts[k - 2].kind == "name":
            k -= 2
        elif ts[k - 2].text in (")", "]"):
            chained = True
            depth, k = 0, k - 2
            while k >= 0:
                depth += (ts[k].text in (")", "]")) - (ts[k].text in ("(", "["))
                if not depth:
                    break
                k -= 1
            if k >= 1 and ts[k - 1].kind == "name":
                k -= 1
            elif k >= 1 and ts[k - 1].text == ">":
                while k > 0 and ts[k].text != "<":
                    k -= 1
                k = max(k - 1, 0)
        else:
            break
    head = ts[k - 1].text if k > 0 else ""
    if head == "new" and chained:  # a method of what is made
        k -= 1
        head = ts[k - 1].text if k > 0 else ""
    new = head == "new"
    end = _closing(ts, opened)
    awaited = head == "await"
    dropped = not awaited and head in ("", "{", "}", ";", "else", "do", ")") and end + 1 < len(ts) and ts[end + 1].text == ";"
    dropped = dropped or (new and (k < 2 or ts[k - 2].text in ("{", "}", ";")) and end + 1 < len(ts) and ts[end + 1].text == ";")
    out.add("call", ts[i].text, member, ts[i], detail="constructor" if new else "method", n=len(_parts(ts[opened + 1 : end])), m=2 if awaited else int(dropped), sure=False, type_=_text(ts[i + 2 : opened - 1]), extra=_text(ts[k : max(i - 1, k)]))


def _local(out: _File, ts: list[Token], i: int, member: str) -> None:
    """A local ``T name = value`` whose name stands at ``i``."""
    k = i - 1
    while k > 0 and ts[k - 1].text not in (";", "{", "}", "(", ")", "using", "await", "const", "else", "=>", "return", ","):
        k -= 1
    lead = ts[k - 1].text if k else ""
    if lead == "(" and k >= 2 and ts[k - 2].text == "using":
        lead = "using"
    value = ts[i + 2 : i + 4]
    if lead == "return" or not value:
        return
    made = "new" if value[0].text == "new" else "call" if any(t.text == "(" for t in ts[i + 2 : next((x for x in range(i, len(ts)) if ts[x].text == ";"), len(ts))]) else "value"
    type_ = _text(ts[k:i])
    if made == "new" and type_ == "var" and len(value) > 1:
        type_ = _dotted(ts, i + 3)[0]
    out.add("local", ts[i].text, member, ts[i], detail="using" if lead == "using" else "plain", sure=False, type_=type_, extra=made)


def _members(out: _File, ts: list[Token], scope: str, inside: str) -> None:
    """Declarations between ``ts``; ``inside`` is the kind of what holds them."""
    i = 0
    while i < len(ts):
        attributes: list[tuple[str, Token, str]] = []
        while i < len(ts) and ts[i].text == "[":
            end = _closing(ts, i)
            k = i + 1
            while k < end:
                if ts[k].kind == "name" and ts[k - 1].text in ("[", ",", ":"):
                    name, k2 = ts[k].text, k + 1
                    while k2 + 1 < end and ts[k2].text == ".":
                        name, k2 = ts[k2 + 1].text, k2 + 2
                    args = ""
                    if k2 < end and ts[k2].text == "(":
                        close = _closing(ts, k2)
                        args = " ".join(x.text for x in ts[k2 + 1 : close])
                        k2 = close + 1
                    if ts[k2].text != ":":
                        attributes.append((name, ts[k], args))
                    k = max(k2, k + 1)
                else:
                    k += 1
            i = end + 1
        start = i
        mods = []
        while i < len(ts) and ts[i].text in _MODIFIERS:
            mods.append(ts[i].text)
            i += 1
        if i >= len(ts):
            return
        modifiers = " ".join(mods)
        word = ts[i].text
        if word == "using" and inside in ("file", "namespace"):
            end = next((k for k in range(i, len(ts)) if ts[k].text == ";"), len(ts) - 1)
            out.add("using", _text(ts[i + 1 : end]), scope, ts[i])
            i = end + 1
            continue
        if word == "namespace":
            k = i + 1
            while k < len(ts) and ts[k].text not in ("{", ";"):
                k += 1
            name = "".join(t.text for t in ts[i + 1 : k])
            out.add("namespace", name, scope, ts[i])
            whole = f"{scope}.{name}" if scope else name
            if k < len(ts) and ts[k].text == "{":
                end = _closing(ts, k)
                _members(out, ts[k + 1 : end], whole, "namespace")
                i = end + 1
            else:
                _members(out, ts[k + 1 :], whole, "namespace")
                return
            continue
        if word in _TYPE_KINDS and i + 1 < len(ts):
            k = i + (2 if word == "record" and ts[i + 1].text in ("class", "struct") else 1)
            name = ts[k].text
            stop = k
            while stop < len(ts) and ts[stop].text not in ("{", ";"):
                stop = _closing(ts, stop) + 1 if ts[stop].text == "(" else stop + 1
            heads = ts[k + 1 : stop]
            owner = f"{scope}.{name}" if scope else name
            wheres = [x for x in range(len(heads)) if heads[x].text == "where" and x + 2 < len(heads) and heads[x + 2].text == ":"]
            colon = next((x for x in range(len(heads)) if heads[x].text == ":" and not any(w < x for w in wheres)), None)
            end = _closing(ts, stop) if stop < len(ts) and ts[stop].text == "{" else min(stop, len(ts) - 1)
            out.add("type", name, scope, ts[k], ts[end].line, modifiers, word)
            if heads and heads[0].text == "(" and word == "record":
                _params(out, heads[1 : _closing(heads, 0)], f"{owner}.{name}")
            for part in _parts(heads[colon + 1 : wheres[0] if wheres else None]) if colon is not None else []:
                cut = next((x for x in range(len(part)) if part[x].text == "("), len(part))
                out.add("base", _text(part[:cut]), owner, part[0], sure=False)
                _types(out, part[:cut], owner, "base_type")
            for w in wheres:
                stop_at = next((x for x in wheres if x > w), len(heads))
                _types(out, heads[w + 3 : stop_at], owner, "type_constraint")
            for a, at, args in attributes:
                out.add("attribute", a, owner, at, detail=args)
                out.add("ref", a.rpartition(".")[2], owner, at, detail="attribute", sure=False)
            if word != "enum" and stop < len(ts) and ts[stop].text == "{":
                _members(out, ts[stop + 1 : end], owner, "type")
            i = end + 1
            continue
        if word == "delegate" and inside in ("file", "namespace", "type"):
            end = next((x for x in range(i, len(ts)) if ts[x].text == ";"), len(ts) - 1)
            opened = next((x for x in range(i, end) if ts[x].text == "("), end)
            name_at = opened - 1
            if ts[name_at].text == ">":
                name_at = next((x - 1 for x in range(opened, i, -1) if ts[x].text == "<"), name_at)
            name = ts[name_at].text
            out.add("type", name, scope, ts[name_at], ts[end].line, modifiers, "delegate", type_=_text(ts[i + 1 : name_at]))
            _params(out, ts[opened + 1 : _closing(ts, opened)], f"{scope}.{name}" if scope else name)
            i = end + 1
            continue
        # a member ends at ';' or after its block; '=>' and '=' bodies run to ';'
        k, opened = i, None
        while k < len(ts) and ts[k].text not in (";", "{", "=", "=>"):
            k = _closing(ts, k) + 1 if ts[k].text in ("(", "[") else k + 1
        name_at, kind = _declared(ts, i, min(k, len(ts)), k, scope.rpartition(".")[2])
        if k < len(ts) and ts[k].text == "{":
            opened, end = k, _closing(ts, k)
            if end + 1 < len(ts) and ts[end + 1].text == "=":
                end = next((x for x in range(end, len(ts)) if ts[x].text == ";"), end)
        else:
            end = k
            while end < len(ts) and ts[end].text != ";":
                end = _closing(ts, end) + 1 if ts[end].text in ("(", "[", "{") else end + 1
        end = min(end, len(ts) - 1)
        if name_at is not None and inside == "type":
            type_from = i + 1 if ts[i].text in ("event", "delegate", "~") else i
            name = {"operator": "operator " + "".join(t.text for t in ts[name_at + 1 : name_at + 3] if t.text not in ("(", ")")), "indexer": "this[]", "destructor": "~" + ts[name_at].text}.get(kind, ts[name_at].text)
            type_ = _text(ts[type_from:name_at])
            if kind == "operator":
                stop = next((x for x in range(name_at, len(ts)) if ts[x].text == "("), name_at)
                name = "operator " + "".join(t.text for t in ts[name_at + 1 : stop] if t.text != "checked")
                modifiers = f"{modifiers} checked".strip() if ts[name_at + 1].text == "checked" else modifiers
            elif kind == "conversion":
                stop = next((x for x in range(name_at, len(ts)) if ts[x].text == "("), name_at)
                name = "implicit" if "implicit" in mods else "explicit"
                type_ = _text([t for t in ts[name_at + 1 : stop] if t.text != "checked"])
                modifiers = f"{modifiers} checked".strip() if ts[name_at + 1].text == "checked" else modifiers
            names = [(name, ts[name_at])]
            if kind in ("field", "event") and opened is None:
                names += [(part[0].text, part[0]) for part in _parts(ts[name_at:end])[1:] if part[0].kind == "name"]
            whole = f"{scope}.{name}"
            body = ts[opened + 1 : end] if opened is not None else ts[k + 1 : end] if k < end else []
            if kind in ("property", "indexer", "event") and opened is not None:
                scores = max((complexity(x) for x in _accessors(body)), default=(0, 0, 0))
            elif kind in ("method", "constructor", "destructor", "operator", "conversion") or (kind == "property" and k < len(ts) and ts[k].text == "=>"):
                scores = complexity(body, ts[name_at].text)
            else:
                scores = (0, 0, 0)
            at_args = next((x for x in range(name_at, min(k, len(ts))) if ts[x].text == ("[" if kind == "indexer" else "(")), None)
            types = _params(out, ts[at_args + 1 : _closing(ts, at_args)], whole) if at_args is not None and kind not in ("field", "event", "property", "constant") else []
            for one, at in names:
                out.add("member", one, scope, at, ts[end].line, modifiers, kind, scores[0], scores[1], nest=scores[2], type_=type_, extra=", ".join(types))
            _types(out, ts[type_from:name_at], whole, "declaration")
            for a, at, args in attributes:
                out.add("attribute", a, whole, at, detail=args)
                out.add("ref", a.rpartition(".")[2], whole, at, detail="attribute", sure=False)
            initial = next((x for x in range(at_args, k) if ts[x].text == ":"), None) if kind == "constructor" and at_args is not None else None
            if initial is not None and initial + 1 < k:
                out.add("call", scope.rpartition(".")[2] if ts[initial + 1].text == "this" else "base", whole, ts[initial + 1], detail="constructor", sure=False)
                body = [*ts[initial + 2 : k], Token("op", ";", ts[initial].line), *body]
            _body(out, body, whole)
        i = end + 1


def _declared(ts: list[Token], i: int, stop: int, k: int, own: str) -> tuple[int | None, str]:
    """Where the name of the member that starts at ``i`` stands, and what kind of member it is; ``k`` is where its head ends."""
    if i >= len(ts):
        return None, ""
    for x in range(i, stop):
        if ts[x].text == "operator":
            back = {t.text for t in ts[max(0, x - 1) : x]} & {"implicit", "explicit"}
            follows = ts[x + 1].text if x + 1 < len(ts) else ""
            if follows == "checked" and x + 2 < len(ts):
                follows = ts[x + 2].text
            word = follows[:1].isalpha() and follows not in ("true", "false")
            return x, "conversion" if back or word or x == i else "operator"
        if ts[x].text == "this" and x + 1 < len(ts) and ts[x + 1].text == "[":
            return x, "indexer"
        if ts[x].text in ("=", "=>", "{", "("):
            break
    if ts[i].text == "~":
        return i + 1, "destructor"
    name_at = next((x for x in range(i, stop) if ts[x].kind == "name" and x + 1 < len(ts) and ts[x + 1].text in ("(", "{", ";", "=", "=>", "<", ",") and (ts[x + 1].text != "<" or _generic_method(ts, x + 1)) and not _inside_angle(ts, i, x)), None)
    if name_at is None:
        return None, ""
    follow = ts[name_at + 1].text
    if ts[i].text == "event":
        return name_at, "event"
    if follow == "(" and name_at == i:
        return name_at, "constructor"
    if follow in ("(", "<"):
        return name_at, "method"
    if follow in ("{", "=>"):
        return name_at, "property"
    return name_at, "constant" if any(t.text == "const" for t in ts[max(0, i - 4) : i]) else "field"


def _inside_angle(ts: list[Token], low: int, at: int) -> bool:
    depth = 0
    for x in range(low, at):
        depth += (ts[x].text == "<") - (ts[x].text == ">")
    return depth > 0


def _accessors(body: list[Token]) -> list[list[Token]]:
    """The bodies of a property's or an event's accessors."""
    out, k = [], 0
    while k < len(body):
        if body[k].text == "{":
            end = _closing(body, k)
            out.append(body[k + 1 : end])
            k = end + 1
        elif body[k].text == "=>":
            end = next((x for x in range(k, len(body)) if body[x].text == ";"), len(body))
            out.append(body[k + 1 : end])
            k = end + 1
        else:
            k += 1
    return out


def _generic_method(ts: list[Token], at: int) -> bool:
    depth = 0
    for k in range(at, len(ts)):
        depth += (ts[k].text == "<") - (ts[k].text == ">")
        if not depth:
            return k + 1 < len(ts) and ts[k + 1].text == "("
        if ts[k].kind != "name" and ts[k].text not in "<>,.?[]":
            return False
    return False


def extract(text: str) -> list[tuple]:
    """All facts of one file's text, as rows of ``SCHEMA`` without file and project."""
    out = _File()
    _members(out, tokens(text), "", "file")
    for m in _CREF.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        out.add("ref", m[1].rpartition(".")[2], "", Token("name", m[1], line, m.start(1) - text.rfind("\n", 0, m.start(1))), detail="xml_doc", sure=False)
    return out.rows


def is_generated(path: Column | str, text: Column | str) -> Column | bool:
    """By name (.g.cs, .designer.cs) or by a mark in the first 1024 characters; of columns, a column."""
    if isinstance(path, str):
        low = path.lower()
        return low.endswith((".g.cs", ".designer.cs")) or "<auto-generated" in text[:1024].lower()
    low = F.lower(path)
    return low.endswith(".g.cs") | low.endswith(".designer.cs") | F.coalesce(F.lower(F.substring(text, 1, 1024)).contains("<auto-generated"), F.lit(False))


def is_build_output(path: Column) -> Column:
    """The second sense of generated: below an ``obj`` folder, or without a path."""
    clean = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return (clean == "") | clean.contains("/obj/")


def scan_files(files: DataFrame, project: str | None = None, generated: bool = False) -> DataFrame:
    """``files(file, project, text)`` as tools scan them: the project filter first, then the first project of each file, in order of project; generated ones only if asked.

    A text without a path is known by its content.
    """
    kept = files if project is None else files.where(F.lower("project") == project.lower())
    kept = kept if generated else kept.where(~is_generated(F.coalesce("file", F.lit("")), F.col("text")))
    identity = F.coalesce(F.nullif("file", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256))
    return kept.groupBy(identity.alias("file")).agg(F.min(F.struct("project", "text")).alias("x")).select("file", "x.project", "x.text")


def facts(files: DataFrame) -> DataFrame:
    """Facts of ``files(file, project, text)``: the first of each (project, file) is parsed; a null text has none."""
    rows = files.select("project", "file", "text").where("text is not null")
    # texts are not sorted to find those of one name: only names are counted, and texts of repeated ones compared
    again = cut(rows.groupBy("project", "file").count().where("count > 1").select(F.col("project").alias("_project"), F.col("file").alias("_file")))
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("file").eqNullSafe(F.col("_file"))
    # texts are small beside the work that they make, so Spark is not left to put many into one task
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows
    if not again.isEmpty():
        smallest = rows.join(again, same, "left_semi").groupBy("project", "file").agg(F.min("text").alias("text"))
        once = rows.join(again, same, "left_anti").unionByName(smallest)
    once = once.repartition(width, "project", "file")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            # a file's facts are many times its text in memory, so they go on before the batch is done
            rows = ((f, p, *row) for p, f, t in zip(pdf.project, pdf.file, pdf.text, strict=True) for row in extract(t))
            while some := list(islice(rows, FACTS_AT_ONCE)):
                yield pd.DataFrame(some, columns=names)

    return once.mapInPandas(parse, SCHEMA)
