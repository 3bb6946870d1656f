"""Scalar functions as Column expressions: paths, identifiers, token estimates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a path places a file, first match wins. Kept free of look-around so that SQL can repeat them.
INTENT_RULES = [
    ("generated", r"(^|/)(dist|build|coverage|generated|gen)(/|$)|\.(d\.ts|min\.[^.]+)$"),
    ("fixture", r"(^|/)(fixtures?|__fixtures__|mocks?|__mocks__)(/|$)"),
    ("bench", r"(^|/)(bench|benches|benchmark|benchmarks|eval)(/|$)"),
    ("test", r"(^|/)(test|tests|__tests__|spec|specs)(/|$)|\.(test|spec)\.|(^|/)(test_[^/]+|[^/]+_(test|spec))\.[^/]+$"),
    ("main", r"(^|/)(src|lib|app|cmd|pkg|internal)(/|$)"),
]
EXCLUDED_INTENTS = ["test", "fixture", "bench", "generated"]
#: Naming conventions of test files.
TEST_FILE = r"\.test\.|\.spec\.|_test\.|__tests__|(^|/)Test[^/]*\.java$|Test\.php$|(^|/)(?i:test_[^/]*\.py)$|(?i:_test\.py)$|(?i:_spec\.rb)$"
#: Fixed value: where the lexical tokenizer splits.
SEPARATORS = r"[\s\-_./\\:(){}\[\]<>,\"'`~!@#$%^&*+=|;?]+"


def path_intent(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = None
    for name, rule in INTENT_RULES:
        out = F.when(p.rlike(rule), name) if out is None else out.when(p.rlike(rule), name)
    return out.otherwise("unknown")


def intent_sql(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({path}), '{r}') THEN '{n}'" for n, r in INTENT_RULES) + " ELSE 'unknown' END"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), d).otherwise(".")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def first_segments(path: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, n), "/")


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def lexical_tokens(text: Column) -> Column:
    """Lower-case pieces of 2 to 64 characters, repeated ones kept."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: (F.length(t) >= 2) & (F.length(t) <= 64))


def estimated_tokens(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.ceil((words * 1.3 + F.length(text) * 0.25) / 2)).cast("int")


def decision_points(text: Column) -> Column:
    """Branches in a piece of code; ``else if`` counts for both of its patterns."""
    patterns = [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\?(?!\?)"]
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(p))
    return out


def name_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def uri_encode(text: Column) -> Column:
    """Percent encoding of a URI component: all but letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uri_decode(text: Column) -> Column:
    """The text of a URI component; null where an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
