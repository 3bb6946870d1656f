"""Queries of search, contracts and change impact, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.text import EXCLUDED_INTENTS, SEPARATORS, intent_sql
from weftgraph.graph import GRAPH_SQL, edges, meta_sql, nodes
from weftgraph.operators import contracts as K
from weftgraph.operators import impact as I
from weftgraph.operators import search as S
from weftgraph.queries.graph import _CALLERS, _bfs, _named
from weftgraph.sources.published import published
from weftgraph.tables import current, load

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TEXT = ["id", "ord", "kind", "name", "file_path", "content"]
ASK = "how to load the token cache"
HUB = "emitEvent"


def _register(sql: str | None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return deco


_SEP = SEPARATORS.replace("'", "''")
_TOKENS = f"""toks AS (SELECT id, ord, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, kind, file_path, substring(coalesce(content, ''), 1, 1000))), '{_SEP}'), lambda t: length(t) >= 2 AND length(t) <= 64) AS l
 FROM nodes WHERE kind NOT IN ('directory', 'cluster', 'flow')),
docs AS (SELECT id, ord, len(l) AS dl FROM toks), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(l) AS term FROM toks) GROUP BY 1, 2)"""


def _bm25_sql(query: str, limit: int) -> str:
    terms = ", ".join(f"'{t}'" for t in S.query_tokens(query))
    return f"""hit AS (SELECT * FROM post WHERE term IN ({terms})),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1), ok AS (SELECT term, df, n, avgdl FROM dfs, corpus WHERE NOT (n > 100 AND df / n > 0.6)),
bm AS (SELECT d.id, d.ord, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score FROM hit JOIN ok USING (term) JOIN docs d USING (id) GROUP BY 1, 2),
top AS (SELECT * FROM bm ORDER BY score DESC, ord, id LIMIT {limit})"""


def _index(spark, d) -> S.Index:
    """The search index of all nodes, stored on the shared file system by the first query that needs it."""
    build = lambda: S.index_tables(S.build_index(nodes(spark, d, _TEXT)))
    return S.stored_index(published(spark, [f"{d}/code_nodes.parquet"], "index", build, {"postings": ["bucket"]}))


@_register(f"WITH {GRAPH_SQL}, {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1")
def t3_index_terms(spark, d):
    return _index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_register(f"WITH {GRAPH_SQL}, {_TOKENS}, {_bm25_sql(ASK, 20)} SELECT id, score FROM top")
def t4_bm25(spark, d):
    return S.bm25(_index(spark, d), ASK, 20).select("id", "score")


@_register(None)
def t6_index_update(spark, d):
    """The index after all nodes of one repo are deleted and indexed again: equal to a fresh one."""
    n = nodes(spark, d, [*_TEXT, "repo"])
    some = n.where("repo = 'quarry-core'")
    index = S.update_index(_index(spark, d), some, some.select("id"))
    return S.bm25(index, ASK, 20).select("id", "score")


SQL["t6_index_update"] = SQL["t4_bm25"]


def _lexical_sql(query: str) -> str:
    total, cover = [], []
    for t in S.lexical_terms(query):
        s = f"(CASE WHEN lower(name) = '{t}' THEN 14 WHEN starts_with(lower(name), '{t}') THEN 9 WHEN contains(lower(name), '{t}') THEN 6 ELSE 0 END + CASE WHEN contains(lower(file_path), '{t}') THEN 4 ELSE 0 END + CASE WHEN contains(lower(coalesce(content, '')), '{t}') THEN 2 ELSE 0 END)"
        total.append(s)
        cover.append(f"CASE WHEN {s} > 0 THEN 1 ELSE 0 END")
    ban = ", ".join(f"'{x}'" for x in EXCLUDED_INTENTS)
    return f"""lx AS (SELECT id, name, file_path, kind, {' + '.join(total)} AS t, {' + '.join(cover)} AS c FROM nodes WHERE kind NOT IN ('directory', 'cluster', 'flow')),
lxs AS (SELECT id, name, file_path, CAST(t + CASE WHEN c > 1 THEN c * c * 3 ELSE 0 END + CASE WHEN kind IN ('function', 'class', 'interface', 'method') THEN 1 ELSE 0 END AS BIGINT) AS score FROM lx WHERE t > 0 AND {intent_sql('file_path')} NOT IN ({ban})),
lxt AS (SELECT * FROM lxs ORDER BY score DESC, name, file_path, id LIMIT 20)"""


@_register(f"WITH {GRAPH_SQL}, {_lexical_sql('where is the invoice portal queue')} SELECT id, name, file_path, score FROM lxt")
def t8_lexical(spark, d):
    return S.lexical(nodes(spark, d, _TEXT), "where is the invoice portal queue", 20)


@_register(f"WITH {GRAPH_SQL} SELECT {intent_sql('file_path')} AS intent, count(*) AS n FROM nodes WHERE file_path IS NOT NULL GROUP BY 1")
def t9_path_intents(spark, d):
    return nodes(spark, d, ["id", "ord", "file_path"]).where("file_path is not null").groupBy(T.path_intent(F.col("file_path")).alias("intent")).agg(F.count("*").alias("n"))


_VECTORS = """vecs AS (SELECT id, embedding FROM (SELECT id, embedding, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, ord DESC) AS rn FROM code_vectors WHERE id IS NOT NULL)
 WHERE rn = 1 AND len(embedding) = 384 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
q AS (SELECT embedding AS q FROM vecs ORDER BY id LIMIT 1)"""
_COS = "list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x))))"


def usable_vectors(spark, d):
    v = current(load(spark, d, "code_vectors").select("id", "ord", "indexed_at", "embedding"), ["id", "embedding"])
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("embedding") == 384) & finite & F.exists("embedding", lambda x: x != 0))


def _first_vector(v):
    return v.orderBy("id").limit(1).select(F.col("embedding").alias("q"))


@_register(f"WITH {_VECTORS} SELECT id, round({_COS}, 6) AS score FROM vecs, q ORDER BY score DESC, id LIMIT 20")
def t11_vector_top(spark, d):
    v = usable_vectors(spark, d)
    return S.vector_top(v, _first_vector(v), 20)


@_register(f"""WITH {GRAPH_SQL}, {_TOKENS}, {_bm25_sql(ASK, 60)}, {_VECTORS},
lr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM top), vt AS (SELECT id, round({_COS}, 6) AS score FROM vecs, q ORDER BY score DESC, id LIMIT 60), vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vt),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, CAST(rank AS DOUBLE) AS rank FROM lr UNION ALL SELECT id, CAST(rank AS DOUBLE) FROM vr) GROUP BY 1)
SELECT f.id, n.name, n.file_path, f.score, CAST(lr.rank AS INTEGER) AS lexical_rank, CAST(vr.rank AS INTEGER) AS vector_rank FROM f JOIN nodes n USING (id) LEFT JOIN lr USING (id) LEFT JOIN vr USING (id)
WHERE {intent_sql('n.file_path')} NOT IN ('test', 'fixture', 'bench', 'generated') ORDER BY f.score DESC, n.name, n.file_path, f.id LIMIT 20""")
def t12_hybrid(spark, d):
    n, v = nodes(spark, d, _TEXT), usable_vectors(spark, d)
    words = S.ranked(S.bm25(_index(spark, d), ASK, 60))
    return S.hybrid(n, words, S.ranked(S.vector_top(v, _first_vector(v), 60)), 20)


@_register(f"""WITH {GRAPH_SQL}, {_TOKENS}, {_bm25_sql(ASK, 100000000)}, r AS (SELECT n.repo, top.id, row_number() OVER (PARTITION BY n.repo ORDER BY score DESC, top.id) AS k FROM top JOIN nodes n ON n.id = top.id)
SELECT repo, id, round(1.0 / CAST(60 + k AS DOUBLE), 9) AS score FROM r WHERE k <= 20 ORDER BY score DESC, repo, id LIMIT 20""")
def t18_federated(spark, d):
    n = nodes(spark, d, [*_TEXT, "repo"])
    return S.federated(S.bm25(_index(spark, d), ASK, None).join(n.select("id", "repo"), "id").select("repo", "id", "score"), 20)


@_register("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE CAST(ceil((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE) + length(text) * CAST(0.25 AS DOUBLE)) / 2) AS INTEGER) END AS n FROM documents""")
def t20_token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("n"))


# ---------------------------------------------------------------- contracts

_LOWN = "lower(name)"


@_register(f"""WITH {GRAPH_SQL} SELECT repo, 'export' AS kind, name, id AS node_id FROM nodes WHERE exported AND kind IN ({', '.join(f"'{k}'" for k in K.EXPORTED_KINDS)})
UNION ALL SELECT repo, 'route', name, id FROM nodes WHERE kind = 'route'
UNION ALL SELECT repo, CASE WHEN contains({_LOWN}, 'event') OR contains({_LOWN}, 'message') THEN 'event' ELSE 'schema' END, name, id FROM nodes WHERE kind IN ('interface', 'type_alias')
 AND (contains({_LOWN}, 'event') OR contains({_LOWN}, 'message') OR contains({_LOWN}, 'schema') OR contains({_LOWN}, 'dto') OR contains({_LOWN}, 'request') OR contains({_LOWN}, 'response'))""")
def i16_contracts(spark, d):
    return K.extract(nodes(spark, d, ["id", "ord", "repo", "kind", "name", "exported"]))


_NORM = "list_distinct(list_filter(list_transform(coalesce({p}, []), lambda x: coalesce(regexp_replace(lower(x.type), '[\\[\\]?<>\\s]', '', 'g'), '')), lambda t: t <> ''))"
_RN = "regexp_replace(lower({r}), '[\\[\\]?<>\\s]', '', 'g')"
_PAIRS = " OR ".join(f"(rx = '{a}' AND ry = '{b}') OR (rx = '{b}' AND ry = '{a}')" for a, b in K.COMPATIBLE)


@_register(f"""WITH rows_ AS (SELECT * FROM contracts WHERE repo IS NOT NULL AND name IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY ord DESC) AS rn FROM rows_) WHERE rn = 1),
ex AS (SELECT p.repo AS provider_repo, p.name AS provider, c.repo AS consumer_repo, c.name AS consumer, p.kind AS pk, c.kind AS ck, {_NORM.format(p='p.parameters')} AS sa, {_NORM.format(p='c.parameters')} AS sb, coalesce(len(p.parameters), 0) AS na, coalesce(len(c.parameters), 0) AS nb,
 {_RN.format(r='p.return_type')} AS rx, {_RN.format(r='c.return_type')} AS ry, coalesce(p.return_type, '') = '' OR coalesce(c.return_type, '') = '' AS miss FROM rows_ p JOIN last c ON c.name = p.name AND c.repo <> p.repo),
ts AS (SELECT *, CAST(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 WHEN len(sa) = 0 AND len(sb) = 0 THEN 1 WHEN len(sa) = 0 OR len(sb) = 0 THEN 0 ELSE len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) END AS DOUBLE) AS pt,
 CAST(CASE WHEN miss THEN 0.5 WHEN rx = ry THEN 1 WHEN {_PAIRS} THEN 0.8 ELSE 0 END AS DOUBLE) AS rt, 1 - abs(na - nb) / greatest(na, nb, 1) AS pc FROM ex),
sc AS (SELECT *, CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) * pt + CAST(0.2 AS DOUBLE) * rt + CAST(0.1 AS DOUBLE) * pc AS s0 FROM ts),
exact AS (SELECT provider_repo, provider, consumer_repo, consumer, CASE WHEN pk = 'route' THEN 'route-match' ELSE 'name-match' END AS match_kind,
 least(1.0, greatest(CASE WHEN pt > 0.8 THEN least(1.0, s0 * CAST(1.2 AS DOUBLE)) ELSE s0 END, CASE WHEN pk = ck THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END)) AS confidence FROM sc),
who AS (SELECT DISTINCT repo, name FROM rows_),
near AS (SELECT p.repo, p.name, c.repo, c.name, 'name-match', CAST(0.4 AS DOUBLE) FROM who p JOIN who c ON p.repo <> c.repo AND length(p.name) >= 4 AND length(c.name) >= 4 AND (contains(lower(p.name), lower(c.name)) OR contains(lower(c.name), lower(p.name)))
 WHERE NOT EXISTS (SELECT 1 FROM who w WHERE w.repo = c.repo AND w.name = p.name)),
al AS (SELECT * FROM exact UNION ALL SELECT * FROM near)
SELECT provider_repo, provider, consumer_repo, consumer, match_kind, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY provider_repo, provider, consumer_repo, consumer ORDER BY confidence DESC, match_kind DESC) AS rn FROM al) WHERE rn = 1""")
def i17_contract_links(spark, d):
    return K.match(load(spark, d, "contracts").select("ord", "repo", "kind", "name", "parameters", "return_type"))


@_register("SELECT repo, kind, name FROM contracts WHERE kind = 'grpc'")
def sv13_group_contracts(spark, d):
    return K.filtered(load(spark, d, "contracts"), kind="grpc").select("repo", "kind", "name")


# ---------------------------------------------------------------- change impact

CHANGED = ["quarry-core/shared/log/emit.ts", "quarry-core/shared/result/wrap.ts", "quarry-core/shared/text/pad.ts"]
DIFF = """--- a/quarry-core/shared/log/emit.ts
+++ b/quarry-core/shared/log/emit.ts
@@ -1,3 +1,4 @@
 import x
+const added = 1;
 rest
--- a/quarry-core/shared/text/pad.ts
+++ b/quarry-core/shared/text/pad.ts
@@ -2 +2,2 @@
-old
+new
+more
"""
_LIST = ", ".join(f"'{c}'" for c in CHANGED)
_MANY = """er AS (SELECT DISTINCT target AS src, source AS dst FROM edges WHERE kind IN ('calls', 'imports')),
cl AS (SELECT id AS origin, id, 0 AS depth FROM chg UNION SELECT c.origin, e.dst, c.depth + 1 FROM cl c JOIN er e ON e.src = c.id WHERE c.depth < 2),
pr AS (SELECT DISTINCT origin, id FROM cl WHERE id <> origin)"""


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, chg AS (SELECT id, name FROM nodes WHERE file_path IN ({_LIST})), {_MANY},
k AS (SELECT c.id, c.name, (SELECT count(*) FROM pr WHERE origin = c.id) AS n_affected, (SELECT count(*) FROM edges WHERE kind = 'calls' AND target = c.id) AS n_callers,
 EXISTS (SELECT 1 FROM edges e JOIN nodes s ON s.id = e.source WHERE e.kind = 'imports' AND e.target = c.id AND (contains(s.file_path, '.test.') OR contains(s.file_path, '.spec.'))) AS has_test FROM chg c),
r AS (SELECT *, CASE WHEN n_affected > 50 THEN 'HIGH' WHEN n_affected >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM k) SELECT *, risk <> 'LOW' AND NOT has_test AS is_gap FROM r""")
def g12_pr_impact(spark, d):
    return I.pr_impact(nodes(spark, d, ["id", "ord", "name", "file_path"]), edges(spark, d, ["calls", "imports"]), CHANGED)[0]


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, chg AS (SELECT id, name FROM nodes WHERE file_path IN ({_LIST})), {_MANY},
im AS (SELECT DISTINCT id FROM pr WHERE id NOT IN (SELECT id FROM chg) AND id IN (SELECT id FROM nodes)) SELECT n.file_path, count(*) AS n FROM im JOIN nodes n USING (id) GROUP BY 1 ORDER BY n DESC, file_path LIMIT 5""")
def g12_files_to_review(spark, d):
    n = nodes(spark, d, ["id", "ord", "name", "file_path"])
    return I.files_to_review(n, I.pr_impact(n, edges(spark, d, ["calls", "imports"]), CHANGED)[1])


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, ch(f, line) AS (VALUES ('{CHANGED[0]}', 2), ('{CHANGED[2]}', 2), ('{CHANGED[2]}', 3)),
seed AS (SELECT DISTINCT n.id FROM nodes n JOIN ch ON n.file_path = ch.f AND CASE WHEN n.end_line IS NOT NULL THEN ch.line BETWEEN n.start_line AND n.end_line ELSE abs(ch.line - n.start_line) <= 3 END),
{_bfs('SELECT id FROM seed', _CALLERS, 5)} SELECT (SELECT count(*) FROM seed) AS n_changed, count(*) AS n_affected, CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM found""")
def g11_detect_changes(spark, d):
    return I.detect_changes(nodes(spark, d, ["id", "ord", "file_path", "start_line", "end_line"]), edges(spark, d, ["calls", "imports"]), I.diff_lines(spark, DIFF))


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, c AS (SELECT e.source, e.target, n.name AS caller, e.ord FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls'),
w AS (SELECT id AS cur, ['padCell'] AS path, CAST([] AS BIGINT[]) AS o, 0 AS h FROM ({_named('padCell')}) UNION ALL SELECT c.source, list_prepend(c.caller, w.path), list_append(w.o, c.ord), w.h + 1 FROM w JOIN c ON c.target = w.cur WHERE w.h < 3)
SELECT h AS n, array_to_string(path, ' > ') AS path FROM (SELECT * FROM w WHERE h = 3 OR (h > 0 AND cur NOT IN (SELECT target FROM c)) ORDER BY h, o LIMIT 5)""")
def g16_call_paths(spark, d):
    return I.call_paths(nodes(spark, d, ["id", "ord", "name"]), edges(spark, d, ["calls"]), "padCell")


_ME = f"(SELECT id FROM ({_named('padCell')}))"


@_register(rf"""WITH {GRAPH_SQL}, t AS (SELECT id FROM nodes WHERE regexp_matches(file_path, '{T.TEST_FILE.replace("(?i:", "(")}'))
SELECT DISTINCT e.source AS id FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls' AND e.target IN {_ME} AND e.source NOT IN (SELECT target FROM edges WHERE kind = 'imports' AND source IN (SELECT id FROM t))""")
def g17_untested_callers(spark, d):
    return I.untested_callers(nodes(spark, d, ["id", "ord", "name", "file_path"]), edges(spark, d, ["calls", "imports"]), "padCell")


@_register(f"""WITH {GRAPH_SQL} SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{c[0]}'" for p, c in I.CASES)} ELSE '{I.DEFAULT_CASES[0]}' END AS first_case FROM nodes WHERE kind = 'function'""")
def g18_suggested_cases(spark, d):
    return nodes(spark, d, ["id", "ord", "kind", "name"], ["function"]).select("id", I.suggested_cases(F.col("name"))[0].alias("first_case"))


@_register(f"WITH {GRAPH_SQL} SELECT id, substring(CASE WHEN {meta_sql('summary')} IS NOT NULL THEN concat_ws(chr(10), '[' || kind || '] ' || name, trim(split_part(coalesce(content, ''), chr(10), 1)), {meta_sql('summary')}) ELSE concat_ws(chr(10), concat_ws(' ', kind, name), file_path, coalesce(content, '')) END, 1, 512) AS text FROM nodes")
def t15_embedding_text(spark, d):
    return nodes(spark, d, ["id", "kind", "name", "file_path", "content", "metadata"]).select("id", S.embedding_text().alias("text"))


@_register(f"WITH {GRAPH_SQL}, {_TOKENS}, {_bm25_sql(ASK, 20)} SELECT t.id, n.name, n.file_path, t.score FROM top t JOIN nodes n USING (id)")
def t14_scoped_search(spark, d):
    """The best mode without vectors."""
    return S.scoped("auto", S.ranked(S.bm25(_index(spark, d), ASK, 20), F.desc("score"), "ord", "id"), None, nodes(spark, d, ["id", "name", "file_path"]), 20)[0].select("id", "name", "file_path", "score")


@_register("SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in I.INTENTS) + " ELSE 'auto' END AS intent FROM documents WHERE text IS NOT NULL")
def t21_question_intents(spark, d):
    """The intent a text would have as a question."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", I.question_intents(F.col("text")).alias("intent"))
