"""Credentials in source code and configuration: found by a trained score, blanked in place.

1. One pass over all texts lists candidates (private key blocks, passwords in URLs, assigned or quoted values,
   values in pieces) with their context, and counts character pairs. Counts merge over all texts into a Markov
   model of ordinary code and values.
2. Plain patterns give weak labels to the candidates they are sure of: key blocks with a key in them, known formats
   and random values under telling names on one side, placeholders, values written as references, digests, public
   keys, long encoded data and words on the other.
3. Logistic regression is trained on a bounded sample of the labelled candidates (``fit_rows``) over the Markov
   likelihood, the form of the value, the surrounding identifiers and the path, and calibrated on a held-out
   fifth of it. Everything scoring at least ``threshold`` is a credential, labelled or not.
4. The model is a few numbers; ``redact`` applies it in one narrow pass and blanks the values character by
   character, so quotes, line ends and the rest of the text stay as they are.

Defined cases. Null and empty content has no credentials and is returned as it is. Lines are split at "\\n" and
counted from 1; a value in pieces and a key block count at their first line. Values of any length are read whole;
those of 4 to 7 characters are candidates under a telling name only, shorter ones only as passwords in URLs.
Identifiers are read in the ``CONTEXT`` characters before a value. Repeated rows are judged alike, the current
version of an id counts. Without labels of both kinds the weak labels themselves decide.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Stash

#: Characters before a value, on its line, in which identifiers are read.
CONTEXT = 90
CONFIG = frozenset(["json", "yml", "yaml", "env", "properties", "toml", "ini", "cfg", "conf"])
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"((?:(?!-----(?:BEGIN|END) ).)*+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
#: Without its end a block reaches as far as its header and base64 lines.
_PEM_OPEN = re.compile(r"((?:(?:\\[nr]|\s)*+[A-Z][A-Za-z-]+: [^\n\\]*+)*+(?:(?:\\[nr]|[\s\"'`+.,\\])*+(?:[A-Za-z0-9+/]{16,}+={0,2}(?=\s*(?:\\[nr]|[\r\n\"'`]|\Z))|[A-Za-z0-9+/]{1,15}(?:={1,2}|\Z)))*+)")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,24}://[^\s:/@\"'`<>]*+:([^\s@\"'`/<>]++)@")
_VALUE = re.compile(r"([\"'`=:])\s?(?:(?:Bearer|Basic|Token|bearer|basic|token) )?([A-Za-z0-9+/_.~!@#$%^&*?-]{4,}={0,2})")
_PIECE = re.compile(r"[\"'`]\s*(?:\+|\.\.|\.|&|\\?\n)?\s*(?:\\?\n\s*)?[\"'`]([A-Za-z0-9+/_.~!@#$%^&*?=-]{4,})(?=[\"'`])")
_LISTED = re.compile(_PIECE.pattern.replace("(?:\\+|", "(?:,|\\+|", 1))
_COMMENT = re.compile(r"[ \t]*(?://|#|/\*|\*|--|<!--|;)")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_STRONG = re.compile(r"(?:api|access|private|signing|service|session|client|webhook|auth|db|database|account|encryption|master|deploy|admin|user|root|refresh|bearer|storage|shared|app|ssh|jwt|bot|license|registry)[ ]?(?:key|token|secret|password|passwd|pass|pwd|credential)s?\b|\b(?:password|passwd|passphrase|pwd|secret|credentials?|authorization)\b|\b(?:login|connect|sign ?in|authenticate) ?(?:as|with)?\b")
#: A word of ``_STRONG`` holds one of these.
_STEM = re.compile(r"key|token|secret|pass|pwd|cred|auth|login|connect|sign", re.I)
_WEAK = re.compile(r"\b(?:token|key|auth|pass|bearer|basic|apikey|login)\b")
_DIGEST = re.compile(r"\b(?:integrity|digest|checksum|sha ?\d*|md ?5|hash|etag|fingerprint|commit|revision|public|nonce|uuid|guid|image)\b")
_PLACEHOLDER = re.compile(r"^(?:(.)\1{3,}.*|.*(?:x{4,}|\*{3,}|\.{3,}|_{4,}|-{4,}|0{8,}|1234567).*)$|replace[_-]?(?:me|this)|change[_-]?(?:me|it|this)|\byour[_-]|[_-](?:here|goes)\b|example|placeholder|dummy|sample[_-]?(?:key|token|secret)|redacted|insert[_-]|todo|fixme|not[_-]?(?:a|the|real|set)|fake|\bnone\b|\bnull\b|foobar|lorem", re.I)
#: The whole value is written as a reference; a word such as "vault" inside a value says nothing.
_REFERENCE = re.compile(r"^//|^(?:\$[A-Z][A-Z0-9_]*|%[A-Z][A-Z0-9_]*%|<.*)$|^(?:[\w.]+-ref|vault|ssm|arn|kms|secretsmanager|op|keychain|file|ref|config|secrets?|env|environ)[:/]|^(?:process\.)?env(?:iron)?[.\[]|\$[{(]|\{\{|\bgetenv\b|[:/.-]secrets?/")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HEX, _JWT = re.compile(r"^(?:0x)?[0-9a-fA-F]+$"), re.compile(r"^ey[A-Za-z0-9_-]{8,}\.ey[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}$")
_KNOWN = re.compile(r"^(?:(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{16}|AIza[\w-]{35}|(?:sk|rk)[-_](?:live_|test_|proj-|ant-)?[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_\w{20,}|shp(?:at|ss)_\w{16,}|ya29\.[\w-]{16,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*)$")
_PUBLIC = re.compile(r"^(?:(?:pk|pub|public|publishable)[-_]|ssh-(?:rsa|ed25519|dss)\b|ecdsa-|AAAA[BC]3Nza)", re.I)
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"\d")
_MIXED = re.compile(r"[a-z][A-Z]+[a-z]+[A-Z]+[a-z]*[A-Z]|^[A-Z0-9]{16,}$")
_PREFIXED = re.compile(r"^[a-z]{2,8}\d?(?:[-_.][a-z]{2,8})?[-_.](?=[A-Za-z0-9_.-]*\d)(?=[A-Za-z0-9_.-]*[A-Z])[A-Za-z0-9_.-]{12,}$")
_PASSWORD = re.compile(r"^(?=[^\d]*\d)(?=.*[A-Za-z])[A-Za-z]+(?:[-_.]?[A-Za-z]+){0,3}\d{1,4}[!#%$@&*?^~]*$")
_NUMERIC = re.compile(r"^[\d.:/TZ+%_-]+$|^v?\d+(?:\.\d+)+\S{0,12}$|^\d{4}-\d\d-\d\d")
_PATH = re.compile(r"^(?:[.~]?/|[\w-]+/)[\w./-]+$|^[\w-]+(?:\.[a-z]{2,6}){1,2}$|^\w+(?:\.\w+)+\($")

FEATURES = [
    "markov", "entropy", "log_len", "digits", "upper", "lower", "other", "changes", "hex", "hex_size", "uuid", "jwt", "known", "prefixed", "public", "password_form", "data_uri", "sha_prefix",
    "placeholder", "reference", "numeric", "path_form", "blob", "strong", "weak", "digest_name", "strong_x_random", "strong_x_password", "random_free", "url", "pem", "header", "quoted", "comment", "config_file", "test_path",
]


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    value: str
    left: str
    kind: str
    quoted: bool
    comment: bool
    spans: tuple[tuple[int, int], ...]
    alone: bool


def _words(text: str) -> str:
    return " ".join(w.lower() for w in _SPLIT.findall(text))


def candidates(text: str, config: bool) -> list[Candidate]:
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for begin in _PEM.finditer(text):
            m = _PEM_BODY.match(text, begin.end()) or _PEM_OPEN.match(text, begin.end())
            body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m.group(1))
            if body:
                out.append(Candidate(begin.start(), m.end(), body, "", "pem", True, False, (m.span(1),), False))
            taken.append((begin.start(), m.end()))
    if "://" in text:
        for m in _URL.finditer(text):
            s, e = m.span(1)
            out.append(Candidate(s, e, m.group(1), "", "url", True, False, ((s, e),), False))
            taken.append(m.span())
    upto, k, line_at, line_seen = 0, 0, 0, 0
    taken.sort()
    for m in _VALUE.finditer(text):
        s, e = m.span(2)
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s < upto or (k < len(taken) and taken[k][0] <= s):
            continue
        v = m.group(2)
        quoted = m.group(1) in "\"'`"
        if not _LETTER.search(v):
            continue
        digit = bool(_DIGIT.search(v))
        newline = text.rfind("\n", line_seen, s)
        begin = line_at = newline + 1 if newline >= 0 else line_at
        line_seen = s
        left = text[max(begin, s - CONTEXT) : s]
        if (len(v) < 8 or not (digit or _MIXED.search(v))) and not (_STEM.search(left) and _STRONG.search(_words(left))):
            continue
        comment = bool(_COMMENT.match(text, begin))
        after = text[e : e + 1]
        if not quoted:
            inside = left.count('"') % 2 == 1 or left.count("'") % 2 == 1 or left.count("`") % 2 == 1
            if after in "([{" and after:
                continue
            if not (config or comment or inside):
                continue
            if inside:
                quoted = True
            elif not (after == "" or after.isspace() or after in ",;#\"'"):
                continue
        elif after not in "\"'`;" and not after.isspace():
            if after in "([{<|\\:" or after == "":
                continue
        if not quoted or after in "\"'`;":
            v2 = v.rstrip(".,") if not quoted else v
            e -= len(v) - len(v2)
            v = v2
        spans, whole, end = [(s, e)], v, e
        piece = _LISTED if "concat" in left or "join" in left else _PIECE
        while quoted and (p := piece.match(text, end)):
            spans.append(p.span(1))
            whole += p.group(1)
            end = p.end(1)
        upto = end
        line_end = text.find("\n", e)
        line_end = line_end if line_end >= 0 else len(text)
        alone = len(spans) > 3 or (len(v) > 40 and line_end - begin - len(v) < 40 and (line := text[begin:line_end].strip())[:1] in "\"'`" and len(line) - len(v) < 5)
        out.append(Candidate(s, end, whole, left, "value", quoted, comment, tuple(spans), alone))
    out.sort(key=lambda c: c.start)
    return out


def features(c: Candidate, config: bool, test: bool, logp: np.ndarray) -> list[float]:
    v, n = c.value, max(1, len(c.value))
    raw = np.frombuffer(v.encode("ascii", "replace"), np.uint8) & 127
    markov = float(logp[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0
    counts = np.bincount(raw)
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    dig, up, low = sum(x.isdigit() for x in v), sum(x.isupper() for x in v), sum(x.islower() for x in v)
    kinds = [0 if x.isdigit() else 1 if x.isupper() else 2 if x.islower() else 3 for x in v]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    name = _words(c.left)
    tail = " ".join(name.split()[-7:])
    strong = bool(_STRONG.search(tail)) or c.kind != "value"
    hexed = bool(_HEX.match(v)) and dig > 0
    known = bool(_KNOWN.match(v))
    block = c.kind == "pem"
    public = not block and (bool(_PUBLIC.match(v)) or "PUBLIC KEY" in c.left)
    low_left = c.left.lower()
    data_uri = "base64," in low_left or low_left.rstrip().endswith("data:")
    sha = bool(re.match(r"^(?:sha\d{1,3}|md5)[-:=]", v)) or bool(re.search(r"(?:sha\d{1,3}|md5)[-:]$", low_left))
    # A key block without a key: too little in it, or too few different characters.
    place = (n < 32 or len(set(v)) < 16) if block else bool(_PLACEHOLDER.search(v)) or len(set(v.lower())) <= min(3, n - 1)
    ref = not block and bool(_REFERENCE.search(v))
    numeric, path = bool(_NUMERIC.match(v)), bool(_PATH.match(v)) and not known
    random = float(entropy > 3.2 and changes > 0.25 and n >= 12 and not hexed and not path)
    return [
        markov, entropy, math.log(n), dig / n, up / n, low / n, 1 - (dig + up + low) / n, changes, hexed, hexed and n in (32, 40, 56, 64, 96, 128), bool(_UUID.match(v)), bool(_JWT.match(v)), known,
        bool(_PREFIXED.match(v)), public, bool(_PASSWORD.match(v)), data_uri, sha, place, ref, numeric, path, c.kind == "value" and (c.alone or (n > 120 and not known)), strong, bool(_WEAK.search(tail)), bool(_DIGEST.search(tail)),
        strong * random, strong and bool(_PASSWORD.match(v)), random * (not strong) * (not data_uri) * (not sha) * (not c.alone), c.kind == "url", block, bool(re.search(r"(?:bearer|basic) ?$|authorization|x-[\w-]+", low_left)), c.quoted, c.comment, config, test,
    ]


def weak_label(x: list[float]) -> int:
    """1 a sure credential, 0 surely none, -1 not known; by plain patterns only."""
    f = dict(zip(FEATURES, x, strict=True))
    if f["pem"]:
        return 0 if f["placeholder"] else 1
    if f["placeholder"] or f["reference"] or f["uuid"] or f["data_uri"] or f["sha_prefix"] or f["numeric"] or f["public"] or f["blob"]:
        return 0
    if f["url"] or f["known"] or f["jwt"]:
        return 1
    if f["hex"]:
        return 1 if f["strong"] and f["header"] else 0 if not f["strong"] else -1
    if f["strong"] and (f["strong_x_random"] or f["password_form"]):
        return 1
    if f["path_form"] or (not f["strong"] and not f["weak"] and not f["prefixed"] and (f["entropy"] < 3.0 or f["changes"] < 0.2)):
        return 0
    return -1


@dataclass(frozen=True)
class Model:
    logp: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    trained: bool

    def score(self, x: list[float]) -> float:
        if not self.trained:
            return {1: 1.0, 0: 0.0, -1: 0.0}[weak_label(x)]
        z = float((np.asarray(x, float) - self.mean) / self.scale @ self.weights[1:] + self.weights[0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * z + self.shift))))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, logp: np.ndarray) -> Model:
    k = x.shape[1] if len(x) else len(FEATURES)
    if len(x) < 20 or not 0 < y.mean() < 1:
        return Model(logp, np.zeros(k), np.ones(k), np.zeros(k + 1), 1.0, 0.0, False)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    held = np.arange(len(x)) % 5 == 0
    if not 0 < y[held].mean() < 1 or not 0 < y[~held].mean() < 1:
        held = np.ones(len(x), bool)
        w = _newton(z, y, 1.0)
    else:
        w = _newton(z[~held], y[~held], 1.0)
    raw = (np.c_[np.ones(held.sum()), z[held]] @ w)[:, None]
    pos, neg = y[held].sum(), held.sum() - y[held].sum()
    soft = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    shift, slope = _newton(raw, soft, 1e-3)
    return Model(logp, mean, scale, w, float(max(slope, 1e-3)), float(shift), True)


def _test_path(path: str) -> bool:
    return bool(re.search(r"(?:^|/)(?:tests?|spec|fixtures?|__tests__|mocks?|examples?)/", path))


def _scan(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(128 * 128, np.int64)
        for pdf in batches:
            rows = []
            for o, path, text in zip(pdf["ord"], pdf["file_path"], pdf["content"], strict=True):
                if not isinstance(text, str) or not text:
                    continue
                raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int32)
                pairs += np.bincount(raw[:-1] * 128 + raw[1:], minlength=128 * 128)
                path = path if isinstance(path, str) else ""
                config = path.rpartition(".")[2].lower() in CONFIG
                found = candidates(text, config)
                if not found:
                    continue
                ends = [i for i, ch in enumerate(text) if ch == "\n"]
                test = _test_path(path)
                for c in found:
                    rows.append((o, bisect_right(ends, c.start - 1) + 1, c.start, c.end, c.value, c.left, c.kind, c.quoted, c.comment, c.alone, config, test, None, None))
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)
        at = np.flatnonzero(pairs)
        none = [None] * len(at)
        if len(at):
            yield pd.DataFrame({c: none for c in _COLUMNS} | {"pair": at, "n": pairs[at]}, columns=_COLUMNS)

    slim = nodes.where(F.col("content").isNotNull()).select("ord", "file_path", "content")
    return slim.mapInPandas(run, "ord long, line_no long, start long, end long, value string, left string, kind string, quoted boolean, comment boolean, alone boolean, config boolean, test boolean, pair long, n long")


_COLUMNS = ["ord", "line_no", "start", "end", "value", "left", "kind", "quoted", "comment", "alone", "config", "test", "pair", "n"]
#: What the features of a candidate are made of.
_JUDGED = ["value", "left", "kind", "quoted", "comment", "alone", "config", "test"]


def _features_of(pdf: pd.DataFrame, logp: np.ndarray) -> list[list[float]]:
    return [
        features(Candidate(0, 0, v, left, kind, bool(q), bool(c), (), bool(al)), bool(cf), bool(ts), logp)
        for v, left, kind, q, c, al, cf, ts in zip(pdf["value"], pdf["left"], pdf["kind"], pdf["quoted"], pdf["comment"], pdf["alone"], pdf["config"], pdf["test"], strict=True)
    ]


def train(scanned: DataFrame, fit_rows: int = 20000) -> Model:
    """Markov model from the pair counts of all texts (at most 16384 numbers), regression from at most
    ``fit_rows`` different candidates, those of the smallest hashes of all that the features are made of: copies of
    a file count once and every run picks the same."""
    counts = np.zeros((128, 128))
    for r in scanned.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair // 128, r.pair % 128] = r.n
    smooth = counts + 0.5
    logp = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    cands = scanned.where(F.col("ord").isNotNull())
    cands = cands.select(*_JUDGED).withColumn("h", F.xxhash64(*_JUDGED))
    total = cands.select("h").distinct().count()
    share = min(1.0, 1.2 * fit_rows / max(1, total))
    sample = cands.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).distinct().orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(fit_rows).toPandas()
    x = np.asarray(_features_of(sample, logp), float).reshape(len(sample), len(FEATURES))
    y = np.asarray([weak_label(list(r)) for r in x])
    use = y >= 0
    return fit(x[use], y[use].astype(float), logp)


def _winners(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("indexed_at", "ord")).alias("v")).select("id", F.col("v.ord").alias("ord"))


def find(nodes: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """(``id, line_no, start, end, score`` of current rows, the model)."""
    stash = Stash(nodes.sparkSession, "credentials")
    scanned = stash.put(_scan(nodes), "scanned")
    model = train(scanned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = np.asarray([model.score(x) for x in _features_of(pdf, model.logp)], float)
            yield pdf[["ord", "line_no", "start", "end"]].assign(score=score)[score >= threshold]

    hits = scanned.where(F.col("ord").isNotNull()).mapInPandas(run, "ord long, line_no long, start long, end long, score double")
    return hits.join(_winners(nodes), "ord").select("id", "line_no", "start", "end", "score"), model


def redact_text(text: str | None, path: str, model: Model, threshold: float = 0.5) -> tuple[str | None, int]:
    if not isinstance(text, str) or not text:
        return text if isinstance(text, str) else None, 0
    config = path.rpartition(".")[2].lower() in CONFIG
    spans = [s for c in candidates(text, config) if model.score(features(c, config, _test_path(path), model.logp)) >= threshold for s in c.spans]
    if not spans:
        return text, 0
    out, at = [], 0
    for s, e in sorted(spans):
        if s < at:
            continue
        out.append(text[at:s])
        out.append(re.sub(r"\\[nr]|[^\r\n]", lambda m: m.group() if len(m.group()) > 1 else "*", text[s:e]))
        at = e
    return "".join(out) + text[at:], len(spans)


def redact(nodes: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``id, content, n_blanked`` of current rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [redact_text(t, p if isinstance(p, str) else "", model, threshold) for t, p in zip(pdf["content"], pdf["file_path"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "content": [d[0] for d in done], "n_blanked": [d[1] for d in done]})

    now = nodes.select("id", "ord", "file_path", "content").join(_winners(nodes).select("ord"), "ord", "left_semi")
    return now.mapInPandas(run, "id string, content string, n_blanked int")
