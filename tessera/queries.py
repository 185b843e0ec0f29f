"""Queries over the driver's tables and small literal inputs, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import closure, recon, review, structure, sweep
from .plans import rules as R
from .session import ship
from .sources import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DOCS = "c AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
PAGES = "c AS (SELECT 'pages/' || page_id || '.html' AS path, html AS content FROM pages)"
CONV = "c AS (SELECT 'conv/' || conv_id || '/' || turn || '-' || role || '.md' AS path, text AS content FROM conversations)"
FILES = r"f AS (SELECT path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM (SELECT path, string_split_regex(content, '\r\n|\r|\n') AS p FROM c WHERE content IS NOT NULL))"
LINES = "l AS (SELECT path, ls, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM f)"


def _redact(text: str) -> str:
    for pattern, replacement in T.REDACTIONS:
        pattern = pattern.replace("(?iu)", "(?i)").replace("(?<![A-Za-z0-9+/=_-])", "").replace("(?![A-Za-z0-9+/=_-])", "")
        for k in (1, 2, 3):
            replacement = replacement.replace(f"${k}", f"\\{k}")
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return text


def _hits_sql(source: str, rules: list) -> str:
    """All matches of RE2-safe rules over a corpus: h(path, line, rule_id, start, match_excerpt, w, id...)."""
    each = " UNION ALL ".join(f"SELECT path, ls, line, text, {_q(r.id)} AS rule_id, {_q(r.layer)} AS layer, {_q(r.precision)} AS precision, {_q(r.question)} AS question, {_q(r.version)} AS version, regexp_extract_all(text, {_q(('(?i)' if r.ignore_case else '') + r.condition)}) AS ms, string_split_regex(text, {_q(('(?i)' if r.ignore_case else '') + r.condition)}) AS gs FROM l WHERE regexp_matches(text, {_q(('(?i)' if r.ignore_case else '') + r.condition)})" for r in rules)
    run = "[A-Za-z0-9+/=_-]*"
    return f"""{source}, {FILES}, {LINES}, m AS ({each}),
e AS (SELECT *, generate_subscripts(ms, 1) AS k FROM m),
s AS (SELECT *, CAST(list_sum(list_transform(gs[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) AS INT) AS start, length(ms[k]) AS n FROM e),
b AS (SELECT *, greatest(0, start - 24) AS lo, least(length(text), start + n + 24) AS hi FROM s),
w AS (SELECT *, length(regexp_extract(reverse(substr(text, 1, lo)), '^{run}')) AS x, length(regexp_extract(substr(text, hi + 1), '^{run}')) AS y, sha256(nfc_normalize(array_to_string(list_slice(ls, greatest(1, line - 20), line + 20), chr(10)))) AS wsha FROM b),
h AS (SELECT *, left({_redact(r"regexp_replace(substr(text, lo - x + 1, hi + y - lo + x), '^\s+|\s+$', '', 'g')")}, 200) AS match_excerpt, row_number() OVER (PARTITION BY path, rule_id, wsha ORDER BY line, start) - 1 AS ordinal FROM w),
ledger AS (SELECT left(sha256(path || chr(0) || rule_id || chr(0) || wsha || chr(0) || ordinal), 16) AS id, path AS file, CAST(line AS INT) AS line, layer, 'pattern' AS source, rule_id, precision, question, match_excerpt, 'unresolved' AS status, version AS catalog_version, 'lines-20' AS window_spec, start, ordinal FROM h)"""


GENERIC = R.generic()
DOC_RULES = GENERIC
DOC_HITS, PAGE_HITS = _hits_sql(DOCS, DOC_RULES), _hits_sql(PAGES, GENERIC)


def _doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.pattern_hits(C.documents(spark, sf_dir, even=True), DOC_RULES)


@query(f"WITH {DOCS}, {FILES}, {LINES} SELECT path, CAST(line AS INT) AS line, text FROM l")
def lines_explode(spark, sf_dir):
    return sweep.lines_of(C.documents(spark, sf_dir))


@query(f"WITH {CONV}, {FILES} SELECT 'markdown' AS language, count(*) AS files, CAST(sum(len(ls)) AS BIGINT) AS lines FROM f HAVING count(*) > 0")
def language_counts(spark, sf_dir):
    return recon.by_language(C.conversations(spark, sf_dir).unionByName(C.pages(spark, sf_dir)))


@query(f"WITH {DOCS}, {FILES} SELECT count(*) AS files_total, CAST(sum(len(ls)) AS BIGINT) AS loc_total FROM f")
def loc_total(spark, sf_dir):
    return C.documents(spark, sf_dir).agg(F.count("*").alias("files_total"), F.sum(F.size(T.split_lines(F.col("content")))).cast("long").alias("loc_total"))


PATHS = "('a/SKILL.md'), ('b/x.PY'), ('c.mdc'), ('d/README'), ('.env'), ('tests/x.ts'), ('src/test_a.py'), ('src/a_test.go'), ('pkg/conf.YAML'), ('SECURITY.md'), ('x/.github/dependabot.yml'), ('.github/dependabot.yml'), ('K.Json')"


@query(rf"WITH p AS (SELECT * FROM (VALUES {PATHS}) t(path)) SELECT path, coalesce(regexp_extract(lower(path), '\.[^./]*$') IN ('.mdc', '.md', '.txt', '.json', '.yaml', '.yml', '.toml'), false) AS prose FROM p")
def prose_inventory(spark, sf_dir):
    return values(spark, PATHS, "path").select("path", T.is_prose(F.col("path")).alias("prose"))


@query("SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE regexp_matches(source || '/' || doc_id || '.md', '^src1[^/]*/[0-9]5[^/]*\\.md$')")
def glob_filter(spark, sf_dir):
    return C.documents(spark, sf_dir).filter(F.col("path").rlike(T.glob_regex("**/src1*/?5*.md"))).select("path")


@query(rf"WITH p AS (SELECT * FROM (VALUES {PATHS}) t(path)) SELECT count(*) FILTER (regexp_matches(path, {_q(recon.TEST_FILE)})) AS test_files FROM p")
def test_file_count(spark, sf_dir):
    return values(spark, PATHS, "path").agg(F.count_if(F.col("path").rlike(recon.TEST_FILE)).alias("test_files"))


@query(f"WITH {DOC_HITS} SELECT * EXCLUDE (start, ordinal) FROM ledger")
def pattern_hits_all(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select(*sweep.LEDGER)


@query(f"WITH {PAGE_HITS} SELECT rule_id, count(*) AS hits, count(DISTINCT file) AS files FROM ledger GROUP BY rule_id")
def pattern_hits_by_rule(spark, sf_dir):
    found = sweep.pattern_hits(C.pages(spark, sf_dir, even=True), GENERIC)
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("file").alias("files"))


@query(f"WITH {DOC_HITS} SELECT file, line, rule_id, start FROM ledger")
def hit_offsets(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select("file", "line", "rule_id", "start")


@query(f"WITH {DOC_HITS} SELECT id, ordinal FROM ledger")
def candidate_id(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select("id", "ordinal")


@query(f"WITH {DOCS}, {FILES}, {LINES} SELECT path, CAST(line AS INT) AS line, sha256(nfc_normalize(array_to_string(list_slice(ls, greatest(1, line - 20), line + 20), chr(10)))) AS window_sha256 FROM l")
def window_sha256(spark, sf_dir):
    hashed = C.documents(spark, sf_dir, even=True).select("path", T.window_shas(F.col("content")).alias("shas"))
    # lines that share a window come after its first one, which is at most RADIUS + 1 lines from the end
    shared = F.get("shas", F.greatest(F.lit(0), F.size("shas") - T.RADIUS - 1))
    each = hashed.select("path", shared.alias("shared"), F.posexplode("shas").alias("pos", "own"))
    return each.select("path", (F.col("pos") + 1).alias("line"), F.coalesce("own", "shared").alias("window_sha256"))


@query(f"WITH {DOC_HITS}, o AS (SELECT DISTINCT file, line, rule_id FROM ledger) SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS places FROM o a JOIN o b ON a.file = b.file AND a.line = b.line AND a.rule_id < b.rule_id GROUP BY ALL")
def rule_redundancy_pairs(spark, sf_dir):
    return review.redundancy(_doc_hits(spark, sf_dir))


@query(f"WITH {DOC_HITS} SELECT source, layer, rule_id, count(*) AS n FROM ledger GROUP BY ROLLUP (source, layer, rule_id)")
def rollup_source_layer_rule(spark, sf_dir):
    return _doc_hits(spark, sf_dir).rollup("source", "layer", "rule_id").agg(F.count("*").alias("n"))


SAME = "('a.md', 'secret = \"abcdef\"'), ('b.md', 'x\nsecret = \"abcdef\" secret = \"abcdef\"\ny'), ('c.md', NULL), ('d.md', '')"


@query(f"WITH {_hits_sql(f'c AS (SELECT * FROM (VALUES {SAME}) t(path, content))', DOC_RULES)} SELECT id, file, line, start, ordinal FROM ledger")
def ordinal_identical_windows(spark, sf_dir):
    return sweep.pattern_hits(values(spark, SAME, "path, content"), DOC_RULES).select("id", "file", "line", "start", "ordinal")


SECRETS = "('postgres://admin:hunter2@db/app'), ('run --password hunter22 now'), ('DB_PASSWORD=swordfish'), ('{\"api_key\": \"abcd efgh\"}'), ('Authorization: Bearer abcdef12'), ('plain text'), ('0123456789abcdef0123456789abcdef0123'), ('pw: abc'), ('mysql -p sesame99 -h x')"


@query(f"SELECT text, {_redact('text')} AS redacted FROM (VALUES {SECRETS}) t(text)")
def redact(spark, sf_dir):
    return values(spark, SECRETS, "text").select("text", T.redact(F.col("text")).alias("redacted"))


@query(f"WITH {DOC_HITS} SELECT file, line, rule_id, start, match_excerpt, length(match_excerpt) AS n FROM ledger")
def excerpt_capped(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select("file", "line", "rule_id", "start", "match_excerpt", F.length("match_excerpt").cast("long").alias("n"))


SURFACES = "('x/SKILL.md', 'name: a\ndescription: does b\n description: no'), ('skill.MD', 'description: x'), ('p/pyproject.toml', '[project.scripts]\na = \"b.c:d\"\nurl = \"http://x\"'), ('.mcp.json', '{\"a\": {\"command\": \"x\", \"url\": \"y\"}}'), ('q/mcp.json', '\"url\" : 1')"


@query(rf"""WITH c AS (SELECT * FROM (VALUES {SURFACES}) t(path, content)), {FILES}, {LINES}
SELECT path AS file, CAST(line AS INT) AS line, 'surface.skill_activation' AS rule_id FROM l WHERE regexp_matches(path, '(?i)(^|/)SKILL\.md$') AND regexp_matches(text, '^description:\s*\S')
UNION ALL SELECT path, CAST(line AS INT), 'surface.cli_command' FROM l WHERE regexp_matches(path, '(?i)(^|/)pyproject\.toml$') AND regexp_matches(text, '^\s*["'']?[\w.-]+["'']?\s*=\s*["''][\w.]+:[\w.]+["'']')
UNION ALL SELECT path, CAST(line AS INT), 'surface.mcp_server' FROM l WHERE regexp_matches(path, '(?i)(^|/)\.?mcp\.json$') AND regexp_matches(text, '"(?:command|url)"\s*:')""")
def surface_one_per_line(spark, sf_dir):
    return sweep.surface_hits(values(spark, SURFACES, "path, content"), R.kinds()).select("file", "line", "rule_id")


@query(f"WITH p AS (SELECT * FROM (VALUES {PATHS}) t(path)) SELECT path FROM p WHERE path IN ('SECURITY.md', '.github/dependabot.yml', '.bandit')")
def semi_present_files(spark, sf_dir):
    wanted = values(spark, "('SECURITY.md'), ('.github/dependabot.yml'), ('.bandit')", "path")
    return values(spark, PATHS, "path").join(wanted, "path", "left_semi")


GRAPH = "SELECT doc_id AS src, (doc_id * 2 + 1) % 997 AS dst FROM documents UNION SELECT doc_id, (doc_id * 7) % 499 FROM documents WHERE doc_id % 3 = 0"
WALK = f"WITH RECURSIVE e AS ({GRAPH}), r(node) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM e JOIN r ON e.src = r.node)"


def _graph(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    edges = spark.sql(GRAPH.replace("documents", "tessera_documents"))
    return edges, closure.reach(edges, spark.sql("SELECT 1L AS path"))


@query(f"{WALK} SELECT node FROM r")
def closure_bfs(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select(F.col("path").alias("node"))


@query(f"{WALK} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT node FROM r)")
def unreachable_anti(spark, sf_dir):
    nodes = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return closure.unreachable(nodes, _graph(spark, sf_dir)[1]).select(F.col("path").alias("doc_id"))


@query(rf"WITH {CONV} SELECT regexp_extract(path, '[^/]+$') AS name, count(*) AS n, min(path) AS first FROM c GROUP BY ALL HAVING count(*) > 1")
def basename_ambiguity(spark, sf_dir):
    paths = C.conversations(spark, sf_dir)
    return paths.groupBy(T.basename(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")


JOINS = "('a/b', '../c.md'), ('a', './b/../c.md'), ('', '../x'), ('a', '/etc/x'), ('a', '~/x'), ('a/b/c', '../../d'), ('', 'x//y/.')"


@query("SELECT * FROM (VALUES ('a/b', '../c.md', 'a/c.md'), ('a', './b/../c.md', 'a/c.md'), ('', '../x', NULL), ('a', '/etc/x', NULL), ('a', '~/x', NULL), ('a/b/c', '../../d', 'a/d'), ('', 'x//y/.', 'x/y')) t(folder, ref, path)")
def lexical_join(spark, sf_dir):
    return values(spark, JOINS, "folder, ref").select("folder", "ref", T.lexical_join(F.col("folder"), F.col("ref")).alias("path"))


TREE = "('SKILL.md', 'See [guide](docs/guide.md) and scripts/run.sh.\nIf needed, read notes.md or https://x.example/a.md'), ('docs/guide.md', 'Back to ../SKILL.md, ../../out.md and gone.md; also run.sh'), ('scripts/run.sh', 'cat ./lib.js\ncat data.bin'), ('scripts/lib.ts', 'import x from \"./run.sh\"'), ('a/notes.md', 'x'), ('b/notes.md', 'y'), ('alone.md', 'no one')"


def _tree(spark):
    files = values(spark, TREE, "path, content")
    resolved = closure.resolve(closure.references(files), files)
    roots = closure.default_roots(files)
    reached = closure.reach(resolved.filter("dst is not null").select(F.col("from_path").alias("src"), "dst"), roots)
    return files, resolved, roots, reached


@query("SELECT * FROM (VALUES ('SKILL.md', 1, 'docs/guide.md', 'docs/guide.md', NULL), ('SKILL.md', 1, 'scripts/run.sh', 'scripts/run.sh', NULL), ('SKILL.md', 2, 'notes.md', NULL, 'closure.ambiguous_reference'), ('SKILL.md', 2, 'https://x.example/a.md', NULL, 'closure.remote_resource'), ('docs/guide.md', 1, '../SKILL.md', 'SKILL.md', NULL), ('docs/guide.md', 1, '../../out.md', NULL, 'closure.escaping_reference'), ('docs/guide.md', 1, 'gone.md', NULL, 'closure.missing_reference'), ('docs/guide.md', 1, 'run.sh', 'scripts/run.sh', NULL), ('scripts/run.sh', 1, './lib.js', 'scripts/lib.ts', NULL), ('scripts/run.sh', 2, 'data.bin', NULL, 'closure.missing_reference'), ('scripts/lib.ts', 1, './run.sh', 'scripts/run.sh', NULL)) t(from_path, line, raw, dst, rule_id)")
def resolve_first_success(spark, sf_dir):
    return _tree(spark)[1].select("from_path", "line", "raw", "dst", "rule_id")


@query("SELECT * FROM (VALUES ('SKILL.md', 'direct', ['docs/guide.md:1']), ('docs/guide.md', 'direct', ['SKILL.md:1']), ('scripts/run.sh', 'direct', ['SKILL.md:1', 'docs/guide.md:1', 'scripts/lib.ts:1']), ('scripts/lib.ts', 'direct', ['scripts/run.sh:1'])) t(path, load, referenced_from)")
def origins_collect_set(spark, sf_dir):
    _, resolved, _, reached = _tree(spark)
    return closure.members(resolved, reached)


@query("SELECT * FROM (VALUES ('SKILL.md', 2, 'closure.remote_resource', 'lines-20'), ('SKILL.md', 0, 'closure.unresolved_citations', 'citation-set'), ('docs/guide.md', 0, 'closure.unresolved_citations', 'citation-set'), ('scripts/run.sh', 2, 'closure.missing_reference', 'lines-20')) t(file, line, rule_id, window_spec)")
def citations_grouped(spark, sf_dir):
    files, resolved, roots, reached = _tree(spark)
    return closure.records(resolved, files, reached, roots).select("file", "line", "rule_id", "window_spec")


@query("SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, 'closure.content_changed' AS rule_id, 'code' AS layer, left(sha256('docs/' || source || '/' || doc_id || '.md' || chr(0) || 'closure.content_changed' || chr(0) || sha256('the file changed between two reads: the first had digest ' || sha256(text) || ', the second ' || sha256(text || 'x')) || chr(0) || '0'), 16) AS id, 'digest-pair' AS window_spec FROM documents WHERE doc_id % 10 = 0")
def content_changed_records(spark, sf_dir):
    files = C.documents(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    now = F.when(number % 10 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    altered = closure.changed(files.select("path", F.sha2("content", 256).alias("sha256")), files.select("path", F.sha2(now, 256).alias("sha256")))
    none = spark.createDataFrame([], "from_path string, line int, raw string, load string, dst string, rule_id string, reason string")
    paths = files.select("path")
    return closure.records(none, files, paths, paths, altered).select("file", "rule_id", "layer", "id", "window_spec")


@query("SELECT * FROM (VALUES ('SKILL.md', 2, 'closure.remote_resource', 'code', 'If needed, read notes.md or https://x.example/a.md'), ('SKILL.md', 0, 'closure.unresolved_citations', 'code', '1 paths named here lead nowhere: notes.md'), ('docs/guide.md', 0, 'closure.unresolved_citations', 'code', '2 paths named here lead nowhere: ../../out.md, gone.md'), ('scripts/run.sh', 2, 'closure.missing_reference', 'code', 'cat data.bin'), ('nowhere.md', 0, 'closure.missing_reference', 'code', 'nowhere.md')) t(file, line, rule_id, layer, match_excerpt)")
def closure_excerpts(spark, sf_dir):
    files, resolved, roots, _ = _tree(spark)
    roots = roots.unionByName(closure.given(spark, ["./nowhere.md"]))
    resolved = resolved.unionByName(closure.absent(roots, files))
    reached = closure.reach(resolved.filter("dst is not null").select(F.col("from_path").alias("src"), "dst"), roots)
    return closure.records(resolved, files, reached, roots).select("file", "line", "rule_id", "layer", "match_excerpt")


@query(f"""{WALK}, p AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id NOT IN (SELECT node FROM r))
SELECT count(*) || ' files are reached from no entry, and so lie outside the closure: ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM p ORDER BY path LIMIT 5)) || CASE WHEN count(*) > 5 THEN ', and ' || (count(*) - 5) || ' more' ELSE '' END AS gap FROM p HAVING count(*) > 0""")
def closure_gaps(spark, sf_dir):
    reached = _graph(spark, sf_dir)[1]
    files = C.documents(spark, sf_dir).withColumn("number", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"))
    inside = files.join(reached.select(F.col("path").alias("number")), "number", "left_semi").select("path")
    inventory = files.select("path", F.length("content").cast("long").alias("size"), F.lit("").alias("sha256"), F.lit(False).alias("is_binary"))
    described = closure.described(inside.select("path", F.lit("direct").alias("load"), F.array().cast("array<string>").alias("referenced_from")), inventory, files)
    return closure.gaps(described, inventory, inside)


LOADS = "SELECT doc_id % 50 AS target, CASE doc_id % 7 WHEN 0 THEN 'direct' WHEN 1 THEN 'conditional' ELSE 'fetch' END AS load FROM documents"


@query(f"SELECT target, CASE min(CASE load WHEN 'direct' THEN 0 WHEN 'conditional' THEN 1 ELSE 2 END) WHEN 0 THEN 'direct' WHEN 1 THEN 'conditional' ELSE 'fetch' END AS load FROM ({LOADS}) GROUP BY target")
def load_label_min(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("target"), F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 7 == 1, 1).otherwise(2).alias("rank"))
    return d.groupBy("target").agg(F.element_at(F.array(F.lit("direct"), F.lit("conditional"), F.lit("fetch")), F.min("rank") + 1).alias("load"))


@query("SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def href_references(spark, sf_dir):
    links = C.table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"))


@query("SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, sha256(text) AS was, sha256(text || 'x') AS now FROM documents WHERE doc_id % 10 = 0")
def digest_changed(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "doc_id", "text")
    after = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return closure.changed(docs.select("path", F.sha2("text", 256).alias("sha256")), docs.select("path", F.sha2(after, 256).alias("sha256")))


@query(f"WITH {DOC_HITS} SELECT source, count(*) AS n FROM (SELECT source FROM ledger UNION ALL SELECT 'surface' FROM ledger WHERE rule_id = 'generic.email') GROUP BY source")
def ledger_block_replace(spark, sf_dir):
    hits = _doc_hits(spark, sf_dir)
    old = hits.filter("rule_id = 'generic.email'").withColumn("source", F.lit("surface")).unionByName(hits.limit(0))
    stale = hits.filter("rule_id = 'generic.ipv4'")
    return review.replace_block(old.unionByName(stale), "pattern", hits).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {DOC_HITS} SELECT id FROM ledger EXCEPT ALL SELECT id FROM ledger WHERE line > 1")
def ids_lost_except(spark, sf_dir):
    hits = _doc_hits(spark, sf_dir)
    return review.lost(hits, hits.filter("line > 1"))


SNAP = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = {w} THEN 'b' ELSE 'a' END AS window_sha256, CASE WHEN doc_id % 41 = 0 THEN '{s}' ELSE 'lines-20' END AS window_spec, CASE WHEN doc_id % 13 = 0 THEN '{v}' ELSE '2026.9' END AS catalog_version, CASE WHEN doc_id % 17 = 0 THEN '{v}' ELSE '1' END AS target_version, CASE WHEN doc_id % 19 = 0 THEN '{m}' ELSE 'm' END AS manifest_sha256, {more} FROM {t} WHERE doc_id % 11 <> {gone}"
NOW = {"w": 1, "s": "block-20", "v": "2026.10", "m": "n", "more": "DATE '2026-06-01' AS today, doc_id % 2 = 0 AS rule_changed", "gone": 3}
PRIOR = {"w": 9, "s": "lines-20", "v": "2026.8", "m": "m", "more": "CASE WHEN doc_id % 7 = 0 THEN DATE '2025-06-01' ELSE DATE '2026-05-01' END AS verified_day, 180 AS ttl_days, doc_id % 3 = 0 AS by_grant", "gone": 4}


@query(f"""WITH a AS ({SNAP.format(t='documents', **NOW)}), b AS ({SNAP.format(t='documents', **PRIOR)}),
j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'vanished'
WHEN a.window_spec <> b.window_spec OR a.window_sha256 <> b.window_sha256 THEN 'invalidated'
WHEN a.rule_changed AND string_split(a.catalog_version, '.')::INT[] > string_split(b.catalog_version, '.')::INT[] THEN 'invalidated'
WHEN b.by_grant AND a.manifest_sha256 <> b.manifest_sha256 THEN 'invalidated'
WHEN a.target_version <> b.target_version OR date_diff('day', b.verified_day, a.today) > b.ttl_days THEN 'expired' ELSE 'fresh' END AS freshness FROM a FULL JOIN b ON a.id = b.id)
SELECT id, freshness, CASE freshness WHEN 'new' THEN 'hard' WHEN 'invalidated' THEN 'hard' WHEN 'expired' THEN 'soft' WHEN 'vanished' THEN 'follow-up' END AS queue FROM j""")
def rereview_full_outer(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return review.rereview(*[spark.sql(SNAP.format(t="tessera_documents", **x)) for x in (NOW, PRIOR)])


RESOLVED = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'finding' WHEN 1 THEN 'verified-ok' WHEN 2 THEN 'deferred' WHEN 3 THEN 'unresolved' ELSE 'fine' END AS status, CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'bounded by the caller' END AS rationale, 'r' AS verified_by, DATE '2026-06-01' AS verified_at, '1' AS catalog_version, '1' AS target_version, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'w' END AS window_sha256, 'lines-20' AS window_spec, 'f' AS anchor FROM {t}"


@query(f"""WITH r AS ({RESOLVED.format(t='documents')}) SELECT id, 'unknown status' AS fault FROM r WHERE status NOT IN ('finding', 'verified-ok', 'deferred', 'unresolved')
UNION ALL SELECT id, 'no rationale' FROM r WHERE status IN ('finding', 'verified-ok', 'deferred') AND coalesce(trim(rationale), '') = ''
UNION ALL SELECT id, 'no verification record' FROM r WHERE status = 'verified-ok' AND coalesce(trim(rationale), '') <> '' AND window_sha256 IS NULL""")
def resolution_faults(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return review.resolution_faults(spark.sql(RESOLVED.format(t="tessera_documents")))


GONE = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'still-vulnerable' WHEN 1 THEN 'no-longer-vulnerable' WHEN 2 THEN 'inconclusive' END AS poc, doc_id % 3 = 0 AS anchor, CAST(doc_id % 5 AS INT) AS widened FROM {t}"


@query(f"""WITH g AS ({GONE.format(t='documents')}),
s AS (SELECT id, 1 AS strength, 'poc' AS step, 'survives' AS outcome FROM g WHERE poc = 'still-vulnerable' UNION ALL SELECT id, 1, 'poc', 'probably fixed, to be confirmed' FROM g WHERE poc = 'no-longer-vulnerable'
UNION ALL SELECT id, 2, 'anchor', 'moved, to be reviewed' FROM g WHERE anchor UNION ALL SELECT id, 3, 'sweep', 'rephrased, to be reviewed' FROM g WHERE widened > 0 UNION ALL SELECT id, 4, 'manual', 'to be judged' FROM g)
SELECT id, arg_min(step, strength) AS step, arg_min(outcome, strength) AS outcome FROM s GROUP BY id""")
def vanished_follow_up(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return review.follow_up(spark.sql(GONE.format(t="tessera_documents")))


@query(f"WITH {DOC_HITS} SELECT count(*) AS unresolved, count(*) = 0 AS passes FROM ledger")
def gate_unresolved(spark, sf_dir):
    return review.gate(_doc_hits(spark, sf_dir))


REACH = ", ".join(_q(x) for x in review.REACHABILITY)
FINDINGS = f"SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS impact, CASE CAST(doc_id % 11 AS INT) {' '.join(f'WHEN {k} THEN {_q(x)}' for k, x in enumerate(review.REACHABILITY))} ELSE 'by magic' END AS reachability, CASE doc_id % 3 WHEN 0 THEN 'poc' WHEN 1 THEN 'instruction' END AS evidence_type, doc_id % 5 = 0 AS dangerous, doc_id % 7 = 0 AS crosses_boundary FROM "


@query(f"""WITH f AS ({FINDINGS} documents), n(name, place) AS (VALUES ('informational', 1), ('observation', 2), ('low', 3), ('medium', 4), ('high', 5), ('critical', 6)),
c AS (SELECT id, 1 AS k, 'no proof' AS cap, 'observation' AS most FROM f WHERE evidence_type IS NULL
UNION ALL SELECT id, 2, 'instruction', 'medium' FROM f WHERE evidence_type = 'instruction' AND NOT dangerous
UNION ALL SELECT id, 3, 'cli-only', 'medium' FROM f WHERE reachability = 'cli-only' AND NOT crosses_boundary
UNION ALL SELECT id, 4, 'unreachable', 'informational' FROM f WHERE reachability = 'unreachable'),
l AS (SELECT f.id, c.k, c.cap, m.place FROM f JOIN n i ON i.name = f.impact JOIN c ON c.id = f.id JOIN n m ON m.name = c.most WHERE m.place < i.place),
g AS (SELECT id, min(place) AS place, string_agg(cap, ',' ORDER BY k) AS capped_by FROM l GROUP BY id)
SELECT f.id, CASE WHEN f.reachability IN ({REACH}) THEN coalesce((SELECT name FROM n WHERE n.place = g.place), f.impact) END AS severity, coalesce(g.capped_by, '') AS capped_by FROM f LEFT JOIN g ON f.id = g.id""")
def severity_caps(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return review.severity(spark.sql(FINDINGS + "tessera_documents"))


HISTORY = "SELECT user_id AS id, CAST(event_id % 6 AS INT) AS version, min(event_id) % 2 = 0 AS present, min(event_id) % 3 = 0 AS declined FROM {t} GROUP BY user_id, CAST(event_id % 6 AS INT)"


@query(f"""WITH h AS ({HISTORY.format(t='events')}), w AS (SELECT *, lag(present) OVER (PARTITION BY id ORDER BY version) AS p, coalesce(max(present::INT) OVER (PARTITION BY id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever FROM h)
SELECT id, version, CASE WHEN present AND NOT coalesce(p, true) AND ever = 1 THEN 'regressed' WHEN present AND declined THEN 'wont-fix' WHEN present THEN 'open' WHEN ever = 1 THEN 'fixed' ELSE 'absent' END AS state FROM w""")
def lifecycle_lag(spark, sf_dir):
    C.table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    return review.lifecycle(spark.sql(HISTORY.format(t="tessera_events")))


CLOSED = "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 END AS residue_id FROM {t}"


@query(f"WITH c AS ({CLOSED.format(t='documents')}) SELECT id, 'fixed' AS status, NULL::BIGINT AS derived_from FROM c UNION ALL SELECT residue_id, 'open', id FROM c WHERE residue_id IS NOT NULL")
def partial_fixes(spark, sf_dir):
    C.table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return review.residues(spark.sql(CLOSED.format(t="tessera_documents")))


GRANTS = "('a', 'write', 'x'), ('b', 'load', 'x/y/z.md'), ('c', 'load', 'xy/z.md'), ('a', 'load', 'x/own.md'), ('d', 'write', 'x/y'), ('e', 'write', 'x/y/z.md/q')"


@query(f"WITH g AS (SELECT * FROM (VALUES {GRANTS}) t(component, access, path)) SELECT DISTINCT w.component AS writer, l.component AS loader, l.path FROM g w JOIN g l ON w.access = 'write' AND l.access = 'load' AND w.component <> l.component AND (l.path = w.path OR starts_with(l.path, w.path || '/'))")
def composition_self_join(spark, sf_dir):
    return review.composition(values(spark, GRANTS, "component, access, path"))


BYTES = "('text', '48656C6C6F0A'), ('empty', ''), ('nul', '4100'), ('tabs', '090A0D1B1C1D1E0B0C'), ('edge', '00" + "41" * 19 + "'), ('over', '00" + "41" * 18 + "')"


@query("SELECT * FROM (VALUES ('text', false), ('empty', false), ('nul', true), ('tabs', false), ('edge', false), ('over', true)) t(name, is_binary)")
def binary_by_share(spark, sf_dir):
    return values(spark, BYTES, "name, x").select("name", T.is_binary(F.unhex("x")).alias("is_binary"))


SOURCE = "('p.py', 'import os, subprocess\n\ndef save(p, data):\n    f = open(p, \"w\")\n    f.write(data)\n    os.chmod(p, 384)\n\ndef is_allowed(x):\n    if x in (\"a\", \"b\"):\n        return False\n    return True\n\ndef run(name):\n    subprocess.run(f\"ls {name}\")\n    os.system(\"ls\")\n'), ('bad.py', 'def ('), ('n.md', 'open(p)')"


def _structure(rule: str):
    def run(spark, sf_dir):
        hits = structure.structure_hits(values(spark, SOURCE, "path, content"), R.structural())
        return hits.filter(F.col("rule_id") == rule).select("id", "file", "line", "rule_id", "match_excerpt", "window_spec")

    return run


for _rule in R.structural():
    QUERIES[_rule.id.replace(".", "_")] = (lambda f: lambda spark, sf_dir: f(ship(spark), sf_dir))(_structure(_rule.id))


def agentic_hits(spark, sf_dir):
    """All 21 agentic rules over documents, pages and conversations as files; their dialect is Java's, so no DuckDB form."""
    files = C.documents(spark, sf_dir, even=True).unionByName(C.pages(spark, sf_dir, even=True)).unionByName(C.conversations(spark, sf_dir, even=True))
    return sweep.pattern_hits(files, R.agentic()).select(*sweep.LEDGER)


QUERIES["agentic_hits"] = lambda spark, sf_dir: agentic_hits(ship(spark), sf_dir)
