"""One reading of a source text for everything that needs its structure: tokens, bracket pairs, calls, statements.

The text is cut into tokens once; brackets are paired, so a call knows its arguments and the call around it, and a
comma or bracket in a string is no structure. A bracket that is never closed ends with the one around it or the text. No language is parsed fully.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_RULE = (
    r"(?P<text>\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`)|(?P<note>NOTE)|(?P<word>[$@\w]+(?:(?:\.|->|::)[$@\w]+)*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<bind>:=|(?<![=!<>+*/%&|^-])=(?![=>]))|(?P<line>\n)|(?P<other>[^\s])"
)
_TOKEN = re.compile(_RULE.replace("NOTE", r"//[^\n]*|/\*.*?(?:\*/|\Z)"), re.S)
#: Where # opens a comment.
_HASH_TOKEN = re.compile(_RULE.replace("NOTE", r"#[^\n]*"), re.S)
_PAIR = {")": "(", "]": "[", "}": "{"}
#: So many brackets back a partner is looked for; one that lies deeper closes nothing.
_DEEP = 200
_FIXED = re.compile(r"(?:true|false|null|undefined|None|\d+(?:\.\d+)?)\Z")


@dataclass
class Token:
    kind: str
    start: int
    end: int
    value: str


@dataclass
class Call:
    callee: str
    start: int
    end: int
    args: list[tuple[int, int]]
    around: int | None
    before: str


@dataclass
class Source:
    text: str
    tokens: list[Token] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    #: (start, end) of statements: a line, with the lines that its open parentheses pull in.
    statements: list[tuple[int, int]] = field(default_factory=list)
    #: name -> (start, end) of what is bound to it last.
    bound: dict[str, tuple[int, int]] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def cut(self, span: tuple[int, int]) -> str:
        return self.text[span[0] : span[1]].strip()

    def within(self, span: tuple[int, int]) -> list[Token]:
        at = bisect_right(self.tokens, span[0] - 1, key=lambda t: t.start)
        out = []
        while at < len(self.tokens) and self.tokens[at].start < span[1]:
            out.append(self.tokens[at])
            at += 1
        return out


def fixed_tokens(tokens: list[Token]) -> bool:
    """Literals only, alone or in array brackets."""
    tokens = [t for t in tokens if t.kind not in ("line", "note")]
    for t in tokens:
        if t.kind == "text" and not (t.value[0] == "`" and "$" in t.value) or t.kind == "comma" or t.value in ("[", "]"):
            continue
        if t.kind != "word" or not _FIXED.match(t.value):
            return False
    return bool(tokens)


def fixed(expression: str) -> bool:
    return fixed_tokens([Token(m.lastgroup or "", m.start(), m.end(), m.group()) for m in _TOKEN.finditer(expression)])


def read(text: str, span_lines: int = 6, hash_notes: bool = False) -> Source:
    """Statements take in at most ``span_lines`` lines; ``hash_notes`` where # opens a comment."""
    src = Source(text, starts=[0, *(m.end() for m in re.finditer("\n", text))])
    open_at: list[tuple[str, int | None]] = []
    begun, depth, count, callee_of, last_close = 0, 0, 1, {}, None
    binding: tuple[str, int] | None = None
    prev: Token | None = None
    earlier: Token | None = None
    for m in (_HASH_TOKEN if hash_notes else _TOKEN).finditer(text):
        t = Token(m.lastgroup or "", m.start(), m.end(), m.group())
        if t.kind == "line":
            if depth > 0 and count < span_lines:
                count += 1
            else:
                src.statements.append((begun, t.start))
                if binding:
                    src.bound[binding[0]] = (binding[1], t.start)
                begun, depth, count, binding = t.end, 0, 1, None
            src.tokens.append(t)
            prev = None
            continue
        if t.kind == "open":
            made = None
            if t.value == "(" and prev and prev.kind == "word":
                callee, start = prev.value, prev.start
                if earlier and earlier.value == "." and last_close is not None and last_close[1] == earlier.start:
                    callee, start = f"{callee_of.get(last_close[0], '')}().{callee}", last_close[2]
                made = len(src.calls)
                before = src.tokens[-2].value if len(src.tokens) > 1 else ""
                src.calls.append(Call(callee, start, len(text), [(t.end, len(text))], next((k for _, k in reversed(open_at) if k is not None), None), before))
            open_at.append((t.value, made))
            depth += t.value == "("
        elif t.kind == "close" and any(x == _PAIR[t.value] for x, _ in open_at[-_DEEP:]):
            while open_at[-1][0] != _PAIR[t.value]:
                open_at.pop()
            _, made = open_at.pop()
            depth -= t.value == ")"
            if made is not None:
                call = src.calls[made]
                call.args[-1] = (call.args[-1][0], t.start)
                call.end = t.end
                callee_of[made] = call.callee
                last_close = (made, t.end, call.start)
        elif t.kind == "comma" and open_at and open_at[-1][1] is not None:
            call = src.calls[open_at[-1][1]]
            call.args[-1] = (call.args[-1][0], t.start)
            call.args.append((t.end, len(text)))
        elif t.kind == "bind" and binding is None and depth == 0:
            words = [x.value for x in src.within((begun, t.start)) if x.kind in ("word", "other")]
            named = words[words.index(":") - 1] if ":" in words[1:] else words[-1] if words else ""
            if named and "." not in named:
                binding = (named, t.end)
        src.tokens.append(t)
        if t.kind != "note":
            earlier, prev = prev, t
    src.statements.append((begun, len(text)))
    if binding:
        src.bound[binding[0]] = (binding[1], len(text))
    for c in src.calls:
        c.args = [a for a in c.args if text[a[0] : a[1]].strip()]
    return src
