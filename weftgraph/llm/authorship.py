"""Files nobody wrote: generated, minified, vendored, or data stored as code.

A file is judged where its text lies. First come layout statistics against thresholds per language (``LAYOUTS``):
longest and mean line, share of white space and of letters and digits, density of numeric literals, share of long
encoded runs, and the share of code lines that repeat one shape. Shares that are counted over few characters or lines
are taken at the careful end of their confidence interval, so a short file needs clearer signs and none is left out.

Output of a generator that writes like a person, and a copy of a library file, have the layout of hand-written code.
For these the file's own statements decide: a notice in a comment on lines of its own, anywhere in the text (the same
words in a string literal are none), folders that hold a tool's output or a dependency, and a library's release line.
A notice is scored, not looked up: being made by something, made automatically, a tool, a warning that changes are
lost, and being about the file count for it, a remark that the file is kept by hand counts against it and against
the folder. Away from the head of the file a notice must begin with words that speak of the file. Only the verdict
and a sketch are shuffled.

Copies that lost their notice are found by sketch: each body gives the ``SKETCH`` smallest and every ``SCALE``-th of
its hashes of ``RUN`` consecutive code lines, a body of fewer lines one hash if it has ``WORDS`` words (less is common
to unrelated files). A file is a copy if at least half of them are marks that stand in third-party files, or in files
of at least ``REPOS`` repos, its own included; equal bodies of fewer repos cannot be told from own code moved about.
Hashes are pre-aggregated per task and the join carries hashes only.

Defined cases. Null, empty and blank content, and configuration files (JSON, YAML, properties), are never found.
The current version of an id counts, repeated rows do not matter. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Stash

CONFIG = frozenset(["json", "yml", "yaml", "env", "properties", "toml", "ini", "lock", "md", "txt"])
SKETCH, SCALE, REPOS, RUN, WORDS = 12, 16, 3, 5, 20


@dataclass(frozen=True)
class Layout:
    """Thresholds of a language: beyond any of them a file is not hand-written. The values of ``LAYOUTS`` lie midway
    between what hand-written files reach and what machine-made files start from."""

    longest: int = 1500
    mean: float = 120.0
    space: float = 0.08
    numbers: float = 0.30
    encoded: float = 0.60
    shapes: float = 0.64
    stubs: float = 0.72


LAYOUTS = {
    "js": Layout(mean=115.0, encoded=0.62, stubs=0.70), "mjs": Layout(mean=115.0, encoded=0.62, stubs=0.70), "ts": Layout(mean=125.0, numbers=0.33, stubs=0.68), "mts": Layout(mean=130.0, numbers=0.33, stubs=0.70), "py": Layout(space=0.07, numbers=0.36, stubs=0.66),
    "go": Layout(space=0.06, encoded=0.66, stubs=0.66), "java": Layout(mean=130.0, space=0.09, stubs=0.66), "rs": Layout(space=0.09, encoded=0.64, stubs=0.70), "c": Layout(numbers=0.33, stubs=0.70), "h": Layout(numbers=0.33, stubs=0.70), "rb": Layout(space=0.07, stubs=0.66),
}

#: What a notice of a tool is made of, each with its worth; a line, or two lines that follow each other, needs 2.
_CUES = [
    (2, re.compile(r"@generated\b|<auto-?generated\b", re.I)),
    (1, re.compile(r"\b(?:made|generated|written|produced|created|emitted|compiled|built|rendered|derived|output)(?: \w+ly)? (?:by|from|with|using|of)\b", re.I)),
    (1, re.compile(r"\b(?:auto|machine)(?:matically)?[- ]?(?:made|generated|written|produced|created)\b|\b(?:made|generated|written|produced|created) automatically\b", re.I)),
    (1, re.compile(r"\b(?:tool|compiler|generator|code-?gen|[\w.]+-gen|transpiler|bundler)\b", re.I)),
    (1, re.compile(r"\b(?:do not|don't|never|should not|must not) (?:\w+ly )?(?:edit|modify|change|touch)\b|\binstead of (?:editing|changing)\b|\b(?:changes|edits|modifications)\b.{0,60}\b(?:lost|overwritten|discarded|undone)\b|\bre-?generate\b", re.I)),
    (1, re.compile(r"^(?:(?:this|the) )?(?:(?:source |code )?(?:file|module|header)|code|source)\b|^generated\b", re.I)),
    (-3, re.compile(r"(?<!not )(?<!n't )(?<!never )\b(?:edit(?:ed)?|maintained|kept|written|changed?)(?: only)? by hand\b|\bhand[- ](?:written|edited|maintained)\b|\bno longer\b|\b(?:not|never) (?:auto-?)?generated\b|\bused to be\b", re.I)),
]
#: Away from the head a notice begins by speaking of the file.
_OF_FILE = re.compile(r"^(?:(?:(?:this|the) )?(?:(?:source |code )?(?:file|module|header)|code|source)\b|@generated\b|<auto-?generated\b|(?:auto|machine)(?:matically)?[- ]?(?:made|generated|written|produced|created)\b|(?:made|generated|written|produced|output) (?:by|from|with|using)\b|(?:do not|don't|never) (?:\w+ly )?(?:edit|modify|change)\b)", re.I)
_OTHERS = re.compile(r"\bcopyright (?:\(c\) )?(?:\d{4}[ ,-]*)*the [\w.-]+ (?:authors|contributors)\b|\bsee the upstream (?:repository|project)\b|\bvendored from\b|\bcopied (?:verbatim )?from https?://|@preserve\b|@license\b", re.I)
_OTHERS_LINE = re.compile(r"^(?:copyright (?:\(c\) )?(?:\d{4}[ ,-]*)*the [\w.-]+ (?:authors|contributors)\b|(?:this file (?:was|is) )?(?:vendored from\b|copied verbatim from https?://)|@preserve\b|@license\b)", re.I)
_MARK = " \t\r﻿/*#!;-=\"'"
#: Comments and string literals of a language family, in the order of the text; what is left is code.
_STRING = r"\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'"
_C_LIKE = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|"
_PARTS = {
    "js": re.compile(_C_LIKE + _STRING + r"|`(?:\\.|[^`\\])*+`|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/", re.S),
    "go": re.compile(_C_LIKE + r"`[^`]*+`|" + _STRING, re.S),
    "rs": re.compile(_C_LIKE + r"\bb?r(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*+\"|'(?:\\.[^'\n]*|[^'\\\n])'", re.S),
    "c": re.compile(_C_LIKE + r'"""(?:\\.|[^\\])*?"""|' + _STRING, re.S),
    "py": re.compile(r"(?P<comment>#[^\n]*)|\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|" + _STRING, re.S),
    "rb": re.compile(r"(?P<comment>#[^\n]*|^=begin\b.*?(?:^=end\b|\Z))|<<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z]\w*)(?P=q).*?^\s*(?P=tag)$|" + _STRING, re.S | re.M),
}
_FAMILY = {"js": "js", "mjs": "js", "ts": "js", "mts": "js", "go": "go", "rs": "rs", "py": "py", "rb": "rb"}

_RELEASE = re.compile(r"^[@\w.-]+ v?\d+\.\d+\.\d+(?:[-+][\w.]+)?$")
_FOLDER = re.compile(r"/(?:node_modules|bower_components|jspm_packages|site-packages|third[_-]?party|3rd[_-]?party|vendor|vendored|external|externals|deps|Godeps|Pods|Carthage)/", re.I)
_OUTPUT = re.compile(r"/_*(?:auto[-_]?)?gen(?:erated)?(?:[-_](?:src|sources?|code|files?))?_*/", re.I)
_MIN_NAME = re.compile(r"[.-](?:min|bundle|packed|prod)\.m?js$|\.map$", re.I)
_STUB_NAME = re.compile(r"(?:_pb2?(?:_grpc)?|\.pb|\.pb\.gw|_generated|\.generated|\.g|\.designer)\.\w+$", re.I)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)\b")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:0x[0-9a-fA-F]{2},\s*){8,}")
_WORD, _DIGITS, _TEXT = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\d+(?:\.\d+)?"), re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
#: A sentence is no line of code.
_SENTENCE = re.compile(r"[A-Z][\w',-]*(?: [\w',-]+){3,}[.!?]")


def suffix(path: str) -> str:
    _, dot, end = path.rsplit("/", 1)[-1].rpartition(".")
    return end.lower() if dot else ""


def comments(path: str, text: str) -> tuple[list[str], list[str], str]:
    """(lines of the comments before the first code, lines of the later ones, the code without comments on lines of
    their own). Comments count if they stand on lines of their own; lines come without their marks, with an empty
    line between two comments that do not follow each other. Comments in string literals are none."""
    head: list[str] = []
    later: list[str] = []
    code: list[str] = []
    at, kept = 0, 0
    first = True
    for m in _PARTS[_FAMILY.get(suffix(path), "c")].finditer(text):
        s, e = m.span()
        if m["comment"] is None or text[text.rfind("\n", 0, s) + 1 : s].strip(" \t\r﻿"):
            continue
        between = text[at:s].strip(" \t\r\n﻿")
        first = first and not between
        out = head if first else later
        if between or not out:
            out.append("")
        out += [x.strip(_MARK) for x in m["comment"].split("\n")]
        code.append(text[kept:s])
        at = kept = e
    return head, later, "".join(code) + text[kept:]


def tool_score(line: str) -> int:
    """How clearly a line says that a tool made the file it stands in."""
    return sum(worth for worth, cue in _CUES if cue.search(line))


def stated(path: str, head: list[str], later: list[str]) -> str | None:
    """"vendored", "generated", "own" (kept by hand) or None, by comments and folders."""
    opening = [x for x in head if x]
    pairs = lambda lines: [f"{a} {b}".rstrip() for a, b in zip(lines, [*lines[1:], ""], strict=False) if a]
    # A sentence may run on in the next line.
    near, far = pairs(head), [x for x in pairs(later) if _OF_FILE.match(x)]
    if _FOLDER.search("/" + path) or _OTHERS.search(" ".join(opening)) or (opening and _RELEASE.match(opening[0])) or any(map(_OTHERS_LINE.match, pairs(later))):
        return "vendored"
    scores = [tool_score(x) for x in [*near, *far, *opening]]
    if max(scores, default=0) >= 2:
        return "generated"
    if min(scores, default=0) < 0:
        return "own"
    return "generated" if _OUTPUT.search("/" + path) else None


def _bound(k: float, n: int, side: int, z: float = 1.64) -> float:
    """End of the confidence interval of a share of ``k`` in ``n`` (Wilson): the lower for -1, the upper for 1."""
    return (k + z * z / 2 + side * z * (max(0.0, k * (1 - k / n)) + z * z / 4) ** 0.5) / (n + z * z)


def layout_reason(path: str, text: str, code: str) -> str | None:
    """Why the layout alone rules out a human hand, or None; ``code`` is the text without comments on own lines."""
    t = LAYOUTS.get(suffix(path), Layout())
    n = len(text)
    used = [x for x in text.split("\n") if x.strip()]
    if not used:
        return None
    longest, mean = max(map(len, used)), sum(map(len, used)) / len(used)
    if _bound(sum(len(m) for m in _RUN.findall(text)), n, -1) > t.encoded:
        return "encoded"
    if _bound(sum(len(m) for m in _NUMBER.findall(text)), n, -1) > t.numbers:
        return "data"
    space = _bound(sum(map(text.count, " \t\n\r")), n, 1)
    letters = sum(ch.isalnum() for ch in text) / n
    if (space < t.space and letters < 0.85 and mean > t.mean / 2) or longest > t.longest or (mean > t.mean and space < 1.5 * t.space):
        return "minified"
    shapes: dict[str, int] = {}
    used = [x for x in code.split("\n") if x.strip(" \t\r﻿")]
    for x in used:
        if not _SENTENCE.fullmatch(x.strip()):
            s = _DIGITS.sub("0", _WORD.sub("w", _TEXT.sub("s", x))).strip()
            shapes[s] = shapes.get(s, 0) + 1
    ranked = sorted(shapes.items(), key=lambda x: -x[1])
    top = max((c for s, c in ranked if len(s) > 2), default=0)
    if used and (_bound(top, len(used), -1) > t.shapes or _bound(sum(c for _, c in ranked[:3]), len(used), -1) > t.stubs):
        return "repetitive"
    return None


def judge(path: str, text: str | None) -> tuple[str | None, bool, list[int]]:
    """(reason or None, whether the file shows third-party evidence, its sketch where copies are looked for)."""
    if not isinstance(text, str) or not text.strip() or suffix(path) in CONFIG:
        return None, False, []
    head, later, code = comments(path, text)
    said = stated(path, head, later)
    reason = layout_reason(path, text, code)
    if said == "vendored":
        return "vendored", True, sketch(code)
    if reason is None and said == "generated":
        reason = "generated"
    if reason is None and _MIN_NAME.search(path) and len(text) / (text.count("\n") + 1) > 80:
        reason = "minified"
    return reason, False, sketch(code) if reason is None else []


def sketch(code: str) -> list[int]:
    """Hashes of runs of code lines; white space and line ends aside."""
    body = [x for x in (x.strip(" \t\r﻿") for x in code.split("\n")) if len(x) > 1]
    if len(body) < RUN and sum(len(_WORD.findall(x)) for x in body) < WORDS:
        return []
    runs = ("\n".join(body[i : i + RUN]) for i in range(max(1, len(body) - RUN + 1)))
    seen = sorted({int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in runs})
    return seen[:SKETCH] + [h for h in seen[SKETCH:] if h % SCALE == 0]


def unwritten(nodes: DataFrame) -> DataFrame:
    """``nodes``: code_nodes rows. Returns ``id, reason`` of current file rows that nobody wrote."""
    stash = Stash(nodes.sparkSession, "authorship")
    files = nodes.where((F.col("kind") == "file") & F.col("id").isNotNull()).select("id", "ord", "indexed_at", "repo", "file_path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons, others, sketches = [], [], []
            for path, text in zip(pdf["file_path"], pdf["content"], strict=True):
                path = path if isinstance(path, str) else ""
                reason, third, marks = judge(path, text)
                reasons.append(reason)
                others.append(third)
                sketches.append(np.asarray(marks, dtype=np.int64))
            yield pd.DataFrame({"id": pdf["id"], "ord": pdf["ord"], "indexed_at": pdf["indexed_at"], "repo": pdf["repo"], "reason": reasons, "third": others, "marks": sketches})

    judged = files.mapInPandas(run, "id string, ord long, indexed_at timestamp_ntz, repo string, reason string, third boolean, marks array<long>")
    best = judged.groupBy("id").agg(F.max(F.struct("indexed_at", "ord", "repo", "reason", "third", "marks")).alias("v")).select("id", "v.repo", "v.reason", "v.third", "v.marks")
    best = stash.put(best, "current")
    marks = best.where(F.size("marks") > 0).select("id", "repo", "reason", "third", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    # A hot mark arrives as one partial row per task and repo; 'repos' stops counting above REPOS.
    known = marks.groupBy("mark", "repo").agg(F.max("third").alias("third")).groupBy("mark").agg(F.max("third").alias("third"), F.count("*").alias("repos")).where(F.col("third") | (F.col("repos") >= REPOS)).select("mark")
    shared = marks.where(F.col("reason").isNull()).join(known, "mark", "left_semi").groupBy("id", "n").agg(F.count("*").alias("hits")).where(F.col("hits") * 2 >= F.col("n"))
    return best.where(F.col("reason").isNotNull()).select("id", "reason").unionByName(shared.select("id", F.lit("copied").alias("reason")))
