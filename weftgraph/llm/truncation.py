"""Texts cut off before their end: a stack automaton over the text, and a baseline of endings per source.

The automaton reads a whole text once, character by character where something can open or close. Its stack holds what
is open: code fences, inline code, brackets, double quotes and typographic quotes, markup tags, escapes. A blank line
ends what belongs to a paragraph (brackets, quotes, inline code, tags), but not fences and not the brackets and quotes
of a structured text (JSON, log lines), which are followed over all its lines. It also looks at how the text ends: a
stand-in for a missing rest, a broken multibyte sequence or escape, a sentence terminator. A text is then

* cut, if a fence, a structured text or inline code is still open, or brackets, quotes or a tag of the last paragraph
  are and it has no terminator, or a stand-in follows an unfinished sentence;
* complete, if it ends with a terminator, a closed fence or a whole emoji reply;
* undecided otherwise: its last line has no terminator. Then the endings of its source decide: the shape of the
  last line (digits and words replaced) is a habit of the source, such as a signature, a list item or a log
  trailer, or it is not and the text was cut.

Counts of endings cover all documents; only shapes are shuffled, with partial counts per task. Texts that are equal
but for their digits count once, however often they are held, so that copies of one cut text are no habit; only
replies of one line of at most ``BRIEF`` pieces ("LGTM") count row by row.

Defined cases. Null, empty and blank texts are complete. A null source is a source of its own. Repeated texts
are judged alike. Length plays no part except that a path ending at a dot is unfinished.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT, COMPLETE, UNDECIDED = "cut", "complete", "undecided"

#: One stand-in for a missing rest at the end of what was read so far; none is longer than ``_LONGEST``.
_STAND_IN = re.compile(r"(?:…|\.{3}|\[\s*(?:…|\.\.\.)\s*\]|[\[(<{]\s*/?(?:snip(?:ped)?|cut|more|truncated|continued|continues|clipped|omitted|shortened|rest (?:cut|omitted))\b[^\])>}\n]{0,40}[\])>}]|\(\+\d{1,12} (?:more )?(?:chars?|characters|bytes|lines)\)|\b(?:read more|see more|show more))\Z", re.I)
_LONGEST = 64
_TRAILS_OFF = re.compile(r"(?:\b(?:and so on|and so forth|etc|usw|et cetera|etcétera|y así|und so weiter|ainsi de suite|hmm+|well|wait|so|anyway|or not|maybe|who knows)|など)\Z", re.I)
_TERMINATORS, _CLOSERS = ".!?。！？｡؟।", "\"'”’»)]`*_"
#: A source path that ends at the dot before its suffix.
_OPEN_PATH = re.compile(r"[`(\"']*(?:src|lib|pkg|app|internal|packages|tests?)/(?:[\w-]+/)*[\w-]+\.")
#: A rule across the page that says the text was cut.
_RULE = re.compile(r"\s*[-=*_~]{2,}[^\n]*\b(?:cut|snip|truncated|too (?:large|long)|clipped|omitted|continued)\b[^\n]*[-=*_~]{2,}\s*\Z", re.I)
#: A signature line.
_SIGNATURE = re.compile(r"^--? ?[A-Z][\w.-]*(?: [A-Z][\w.-]*){0,3}$")
#: Who speaks, in front of a reply.
_SPEAKER = re.compile(r"^[\w.-]{1,20}: ")
_STRUCTURED = re.compile(r"\s*(?:[\[{]|\$ |at \w|\w*Error: )")
#: A line of a log starts anew, whatever the one before it left open.
_LOG_LINE = re.compile(r"\s*(?:\[[^\[\]\n]*\] \S|\$ |at \w|\w*Error: )")
_BROKEN = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&[a-zA-Z#0-9]{0,7}|\\)\Z")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_OPENERS = set(_PAIRS.values())
#: What can open or close something, and ends of lines.
_MARKS = re.compile(r"\\.|[()\[\]{}\"“”«»`\n]|</?[a-zA-Z][\w-]*(?:\s[^<>\n]*)?>", re.S)
_VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "p", "li"])
BRIEF, _PIECES = 4, 12
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")


class _Open:
    """What is open, innermost last, with counts so that a look costs the same however much is open."""

    def __init__(self):
        self.stack: list[str] = []
        self.count: dict[str, int] = {}

    def __contains__(self, x: str) -> bool:
        return self.count.get(x, 0) > 0

    def push(self, x: str) -> None:
        self.stack.append(x)
        self.count[x] = self.count.get(x, 0) + 1

    def close(self, x: str) -> None:
        """Closes the innermost ``x`` and all that was opened in it; nothing where none is open."""
        while x in self:
            top = self.stack.pop()
            self.count[top] -= 1
            if top == x:
                break

    @property
    def top(self) -> str:
        return self.stack[-1] if self.stack else ""


def open_at_end(text: str) -> tuple[bool, bool, list[str]]:
    """(whether a code fence is open, whether a structured text is, what is open in the last paragraph). The whole
    text is read; brackets of a structured text close over lines, of prose within their paragraph."""
    fence, begun = False, 0
    block, paragraph = _Open(), _Open()
    structured = bool(_STRUCTURED.match(text))
    for m in _MARKS.finditer(text):
        t = m.group()
        if t == "\n":
            line = text[begun : m.start()].strip()
            begun = m.end()
            if line.startswith("```"):
                fence, block, paragraph = not fence, _Open(), _Open()
            elif not line:
                paragraph = _Open()
            if block.stack and _LOG_LINE.match(text, begun):
                block = _Open()
            if not fence and not block.stack:
                structured = bool(_STRUCTURED.match(text, begun))
                paragraph = _Open() if structured else paragraph
            continue
        if fence or t[0] == "\\":
            continue
        held = block if structured else paragraph
        if t == '"' or t == "`" and not structured:
            if held.top == "`" != t:
                continue
            if t in held:
                held.close(t)
            else:
                held.push(t)
        elif t == "`" or held.top == "`" or structured and held.top == '"':
            continue
        elif t in _OPENERS:
            held.push(t)
        elif t in _PAIRS:
            held.close(_PAIRS[t])
        elif not structured and not t.endswith("/>"):
            name = "<" + t.strip("</>").split()[0].lower()
            if t[1] == "/":
                held.close(name)
            elif name[1:] not in _VOID:
                held.push(name)
    if text[begun:].lstrip().startswith("```"):
        fence, paragraph = not fence, _Open()
    return fence, structured and bool(block.stack), [] if structured else paragraph.stack


def shape(line: str, words: bool) -> str:
    """The last line with digits as 0 and, on request, words as w or W; a longer line than 12 pieces as its hash."""
    out = []
    for t in _TOKEN.findall(line):
        if t[0].isdigit():
            out.append("0")
        elif words and t[0].isalpha():
            out.append("W" if t[0].isupper() else "w")
        else:
            out.append(t.lower())
    whole = " ".join(out)
    return whole if len(out) <= _PIECES else hashlib.blake2b(whole.encode("utf-8", "replace"), digest_size=12).hexdigest()


def identity(text: str | None) -> tuple[int, bool]:
    """(hash of the text with digits as 0, whether it is a brief reply as a whole)."""
    end = text.strip() if isinstance(text, str) else ""
    brief = "\n" not in end and len(end) <= 100 and len(_TOKEN.findall(end)) <= BRIEF
    return int.from_bytes(hashlib.blake2b(_DIGITS.sub("0", end).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), brief


def before_stand_ins(end: str) -> tuple[int, str]:
    """(length of ``end`` without what stands in for a rest, the first of these stand-ins or "")."""
    at, first = len(end), ""
    while True:
        while at and end[at - 1].isspace():
            at -= 1
        m = _STAND_IN.search(end, max(0, at - _LONGEST), at)
        if not m:
            return at, first
        at, first = m.start(), m.group()
        while at and first in ("...", "…") and end[at - 1] in ".…":
            at -= 1


def judge(text: str | None) -> tuple[str, str, str, int]:
    """(verdict, exact shape, word shape, pieces in the last line)."""
    done, cut = (COMPLETE, "", "", 0), (CUT, "", "", 0)
    end = text.rstrip() if isinstance(text, str) else ""
    if not end:
        return done
    fence, structure, paragraph = open_at_end(end)
    if fence:
        return cut
    last = end[end.rfind("\n") + 1 :].strip()
    if last.startswith("```"):
        return done
    if _BROKEN.search(end, max(0, len(end) - 9)) or _RULE.match(last) and "\n" in end:
        return cut
    at, stand = before_stand_ins(end)
    if stand:
        if _TRAILS_OFF.search(end, max(0, at - 40), at) and stand[-1] not in "])>}":
            return done
        return cut if at else done
    if structure or "`" in paragraph and "`" in last:
        return cut
    if _SIGNATURE.match(last):
        return done
    bare = end.rstrip(_CLOSERS)
    if bare and bare[-1] in _TERMINATORS:
        word = bare[max(bare.rfind(" "), bare.rfind("\n")) + 1 :]
        return cut if len(bare) == len(end) and _OPEN_PATH.fullmatch(word) else done
    pieces = _TOKEN.findall(last)
    if not any(ch.isalnum() for ch in pieces[-1]) and ord(pieces[-1][-1]) > 0x2190 and not pieces[-1][-1].isalpha() and ord(pieces[-1][-1]) not in (0x3001, 0xFF0C):
        return done
    if paragraph:
        return cut
    return UNDECIDED, shape(last, False), shape(_SPEAKER.sub("", last), True), len(pieces)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [judge(t) for t in pdf["__text"]]
            same = [identity(t) for t in pdf["__text"]]
            yield pd.DataFrame({key: pdf[key], "__source": pdf["__source"], "verdict": [x[0] for x in v], "exact": [x[1] for x in v], "words": [x[2] for x in v], "pieces": [x[3] for x in v], "same": [x[0] for x in same], "brief": [x[1] for x in same]})

    slim = docs.select(F.col(key), F.coalesce(F.col(source), F.lit("\0")).alias("__source"), F.col(text).alias("__text"))
    return slim.mapInPandas(run, f"`{key}` {kind}, __source string, verdict string, exact string, words string, pieces int, same long, brief boolean")


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, is_cut`` for every document.

    A shape is a habit of a source if at least 3 texts and 0.5 % of its different texts end in exactly that
    line (digits aside), or at least 3 and 2 % in a line of at most 8 pieces of that word pattern (speakers
    aside); or the same, at 0.3 % and 1 %, over all sources. Brief replies count as often as they stand there.
    """
    from weftgraph.session import Stash

    stash = Stash(docs.sparkSession, "truncation")
    rows = stash.put(judged(docs, key, text, source), "judged")
    kinds = ["verdict", "exact", "words", "pieces", "brief", "same"]
    per_source = stash.put(rows.groupBy("__source", *kinds).agg(F.count("*").alias("c")), "texts")
    overall = per_source.groupBy(*kinds).agg(F.sum("c").alias("c"))
    times = F.when(F.col("brief"), F.col("c")).otherwise(F.lit(1))
    size = per_source.groupBy("__source").agg(F.sum(times).alias("n"))
    everything = overall.agg(F.sum(times).alias("n_all"))
    open_ = rows.where(F.col("verdict") == UNDECIDED)
    both = F.explode(F.array(F.struct(F.lit("exact").alias("how"), F.col("exact").alias("shape")), F.struct(F.when(F.col("pieces") <= 8, F.lit("words")).alias("how"), F.col("words").alias("shape"))))

    def endings(texts: DataFrame, *by: str) -> DataFrame:
        each = texts.where(F.col("verdict") == UNDECIDED).select(*by, times.alias("c"), both.alias("s")).select(*by, "c", "s.how", "s.shape")
        return each.where(F.col("how").isNotNull()).groupBy(*by, "how", "shape").agg(F.sum("c").alias("c"))

    counts = endings(per_source, "__source")
    exact = F.col("how") == "exact"
    own = counts.join(size, "__source").where(F.when(exact, (F.col("c") >= 3) & (F.col("c") >= 0.005 * F.col("n"))).otherwise((F.col("c") >= 3) & (F.col("c") >= 0.02 * F.col("n"))))
    total = endings(overall).crossJoin(everything)  # one row of totals
    total = total.where(F.when(exact, (F.col("c") >= 3) & (F.col("c") >= 0.003 * F.col("n_all"))).otherwise((F.col("c") >= 3) & (F.col("c") >= 0.01 * F.col("n_all"))))
    by_exact = own.where(exact).select("__source", F.col("shape").alias("exact"), F.lit(1).alias("h1"))
    by_words = own.where(~exact).select("__source", F.col("shape").alias("words"), F.lit(1).alias("h2"))
    all_exact = total.where(exact).select(F.col("shape").alias("exact"), F.lit(1).alias("h3"))
    all_words = total.where(~exact).select(F.col("shape").alias("words"), F.lit(1).alias("h4"))
    marked = open_.join(by_exact, ["__source", "exact"], "left").join(by_words, ["__source", "words"], "left").join(all_exact, "exact", "left").join(all_words, "words", "left")
    habit = F.coalesce("h1", "h3", F.when(F.col("pieces") <= 8, F.coalesce("h2", "h4")))
    undecided = marked.select(key, "__source", habit.isNull().alias("is_cut"))
    decided = rows.where(F.col("verdict") != UNDECIDED).select(key, "__source", (F.col("verdict") == CUT).alias("is_cut"))
    return decided.unionByName(undecided).select(key, F.when(F.col("__source") != "\0", F.col("__source")).alias("source"), "is_cut")
