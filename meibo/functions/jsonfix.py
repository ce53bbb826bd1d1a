"""Reading a model's answer as JSON, in whatever form it came.

``parse_answer`` takes plain JSON, fenced JSON, JSON after a thinking block or between other words,
JSON inside a JSON string, and Python literals.  An answer that ends before its value does is
``BROKEN``; text without any value is ``NOTHING``.
"""

from __future__ import annotations

import json
import re


class _Mark:
    def __init__(self, name: str) -> None:
        self.name = name

    def __repr__(self) -> str:
        return self.name


BROKEN, NOTHING = _Mark("BROKEN"), _Mark("NOTHING")
_END = object()

_THINK = re.compile(r"<think(?:ing)?>.*?</think(?:ing)?>", re.S | re.I)
_OPEN_THINK = re.compile(r"<think(?:ing)?>", re.I)
_FENCE = re.compile(r"```[A-Za-z0-9_-]*[ \t]*\n?")
_WS = " \t\r\n\f\v　\xa0﻿​"
_NUMBER = re.compile(r"[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_WORD = re.compile(r"[A-Za-z_]+")
_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "NaN": None, "nan": None, "undefined": None}
_ESC = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "a": "\a", "v": "\v", "\n": ""}


class _Broken(Exception):
    pass


class _Bad(Exception):
    pass


def _string(s: str, i: int) -> tuple[str, int]:
    """The quoted string at s[i] and the position after it; either quote, JSON or Python escapes."""
    quote, out, i = s[i], [], i + 1
    n = len(s)
    while True:
        if i >= n:
            raise _Broken
        c = s[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\\":
            if i + 1 >= n:
                raise _Broken
            e = s[i + 1]
            width = {"u": 4, "x": 2, "U": 8}.get(e)
            if width:
                code = s[i + 2 : i + 2 + width]
                if len(code) < width:
                    raise _Broken
                try:
                    out.append(chr(int(code, 16)))
                except (ValueError, OverflowError):
                    raise _Bad from None
                i += 2 + width
            else:
                out.append(_ESC.get(e, e))
                i += 2
        else:
            out.append(c)
            i += 1


def _lenient(s: str, i: int, stack: list[list] | None = None) -> tuple[object, int]:
    """The value at s[i], of any depth (no recursion), and the position after it.

    ``stack`` holds the containers that are open, as [container, pending key or _END]; given an empty list, the caller sees
    how far it came.
    """
    n = len(s)
    stack = [] if stack is None else stack
    value: object = _END
    while True:
        while i < n and s[i] in _WS:
            i += 1
        if value is not _END:
            if not stack:
                return value, i
            box = stack[-1]
            if isinstance(box[0], list):
                box[0].append(value)
            else:
                box[0][box[1]] = value
                box[1] = _END
            value = _END
            if i >= n:
                raise _Broken
            if s[i] == ",":
                i += 1
                while i < n and s[i] in _WS:
                    i += 1
            elif s[i] not in "]})":
                raise _Bad
        if i >= n:
            raise _Broken
        c = s[i]
        if stack and c in "]})":
            box, _ = stack.pop()
            if (c == "}") != isinstance(box, dict):
                raise _Bad
            value, i = box, i + 1
            continue
        if stack and isinstance(stack[-1][0], dict) and stack[-1][1] is _END:
            if c not in "\"'":
                raise _Bad
            key, i = _string(s, i)
            while i < n and s[i] in _WS:
                i += 1
            if i >= n:
                raise _Broken
            if s[i] != ":":
                raise _Bad
            stack[-1][1] = key
            i += 1
            continue
        if c in "[(":
            stack.append([[], _END])
            i += 1
        elif c == "{":
            stack.append([{}, _END])
            i += 1
        elif c in "\"'":
            value, i = _string(s, i)
        elif m := _NUMBER.match(s, i):
            text = m.group().replace("_", "")
            try:
                value = int(text)
            except ValueError:
                value = float(text)
            i = m.end()
        elif m := _WORD.match(s, i):
            if m.group() not in _WORDS:
                if m.end() >= n and any(w.startswith(m.group()) for w in _WORDS):
                    raise _Broken
                raise _Bad
            value, i = _WORDS[m.group()], m.end()
        else:
            raise _Bad


def _value(text: str) -> object:
    """The first whole value in the text; BROKEN if the first that begins does not end."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    start, broken = 0, False
    while True:
        hits = [k for k in (text.find("[", start), text.find("{", start)) if k >= 0]
        quoted = text.lstrip(_WS)
        if start == 0 and quoted[:1] in ("\"", "'"):
            hits.append(len(text) - len(quoted))
        if not hits:
            return BROKEN if broken else NOTHING
        at = min(hits)
        try:
            value, _ = _lenient(text, at)
            return value
        except _Broken:
            # nothing that begins inside an unfinished value may stand for it
            return BROKEN
        except _Bad:
            start = at + 1


def parse_answer(text: str | None) -> object:
    """The answer's value, NOTHING (null, empty, no value in it) or BROKEN (it breaks off)."""
    if text is None:
        return NOTHING
    for _ in range(5):
        text = text.strip(_WS)
        if not text:
            return NOTHING
        text = _THINK.sub("", text)
        if _OPEN_THINK.search(text):
            return BROKEN
        text = _FENCE.sub("", text).strip(_WS)
        if not text:
            return NOTHING
        value = _value(text)
        if not isinstance(value, str):
            return value
        text = value
    return NOTHING


def completed_answer(text: str | None) -> object:
    """The answer's value, and of one that breaks off what was whole in it: open arrays and objects are closed, a field without value and a text or number cut short are left out.

    An option for extraction; problem 3's tables leave broken-off answers out.
    """
    value = parse_answer(text)
    if value is not BROKEN:
        return value
    bare = _FENCE.sub("", _THINK.sub("", text or ""))
    starts = [k for k in (bare.find("["), bare.find("{")) if k >= 0]
    if not starts:
        return NOTHING
    open_: list[list] = []
    try:
        return _lenient(bare, min(starts), open_)[0]
    except (_Broken, _Bad):
        pass
    for (box, key), (child, _) in reversed(list(zip(open_, open_[1:]))):
        if isinstance(box, list):
            box.append(child)
        elif key is not _END:
            box[key] = child
    return open_[0][0] if open_ else NOTHING


def last_object(text: str | None) -> dict | None:
    """The last whole object that stands by itself in a text, as where a model corrects its own answer."""
    bare, at, last = _FENCE.sub("", _THINK.sub("", text or "")), 0, None
    while (at := bare.find("{", at)) >= 0:
        try:
            value, at = _lenient(bare, at)
            last = value if isinstance(value, dict) else last
        except (_Broken, _Bad):
            at += 1
    return last


def only_keys(value: object, allowed: frozenset[str]) -> object:
    """An object without the keys that are not ``allowed``; anything else as it is."""
    return {k: v for k, v in value.items() if k in allowed} if isinstance(value, dict) else value
