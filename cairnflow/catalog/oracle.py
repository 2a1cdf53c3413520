"""SQL twins of the registered queries, for an engine with the test tables as views.

Common table expressions are named once in ``LAYERS`` and pulled in by name.
"""

from __future__ import annotations

from cairnflow.functions.stopwords import ENGLISH

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def clean(x: str) -> str:
    for name, char in (
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("nbsp", " "),
        ("copy", "©"), ("middot", "·"), ("hellip", "…"), ("amp", "&"),
    ):
        x = f"replace({x}, '&{name};', '{char}')"
    return collapse(rf"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


LAYERS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        (),
        """SELECT d.doc_id AS id, CAST(d.doc_id AS VARCHAR) AS external_id, d.source,
        split_part(d.text, chr(10), 1) AS title, d.text AS body,
        'https://example.test/' || d.doc_id AS url,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 720 AS INTEGER)) AS published_at,
        CAST(d.n_chars AS INTEGER) AS engagement_score, d.text AS document_text,
        l.quality = 1 AS is_problem,
        CASE WHEN l.quality IS NOT NULL THEN CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 END AS problem_confidence,
        CASE WHEN l.quality = 1 THEN CAST(e.embedding AS DOUBLE[]) END AS embedding,
        CASE WHEN l.quality = 1 AND e.embedding IS NOT NULL THEN 'fixture-64' END AS embedding_model,
        e.label AS vector_label, CAST(e.embedding AS DOUBLE[]) AS raw_vector
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    ),
    "tokens": (
        ("items",),
        r"""SELECT id, unnest(regexp_extract_all(lower(document_text), '[\p{L}\p{N}_]{2,}')) AS term, is_problem FROM items""",
    ),
    "counts": (
        ("tokens",),
        "SELECT term, count(*) FILTER (is_problem) AS yes, count(*) FILTER (NOT is_problem) AS no FROM tokens WHERE is_problem IS NOT NULL GROUP BY term",
    ),
    "totals": (("counts",), "SELECT sum(yes) AS ny, sum(no) AS nn, count(*) AS v FROM counts"),
    "cur": (
        ("items",),
        """SELECT CAST(100 + vector_label AS BIGINT) AS cluster_id, id AS item_id, embedding
        FROM items WHERE embedding IS NOT NULL""",
    ),
    "prev": (
        ("items",),
        """SELECT CAST(vector_label AS BIGINT) AS cluster_id, id AS item_id, raw_vector AS embedding FROM items
        WHERE raw_vector IS NOT NULL AND CASE WHEN vector_label <= 2 THEN coalesce(is_problem, false) AND id % 2 = 0
        WHEN vector_label <= 4 THEN true WHEN vector_label <= 8 THEN coalesce(is_problem, false) ELSE false END""",
    ),
    "cur_centroid": (
        ("cur",),
        """SELECT cluster_id, list(m ORDER BY pos) AS centroid FROM (SELECT cluster_id, pos, avg(v) AS m FROM
        (SELECT cluster_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM cur) GROUP BY ALL)
        GROUP BY cluster_id""",
    ),
    "prev_centroid": (
        ("prev",),
        """SELECT cluster_id, list(m ORDER BY pos) AS centroid FROM (SELECT cluster_id, pos, avg(v) AS m FROM
        (SELECT cluster_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM prev) GROUP BY ALL)
        GROUP BY cluster_id""",
    ),
    "cand": (
        ("cur_centroid", "prev_centroid"),
        """SELECT *, row_number() OVER (ORDER BY sim DESC, cur, prev) AS rn FROM (
        SELECT c.cluster_id AS cur, p.cluster_id AS prev,
        round(list_cosine_similarity(c.centroid, p.centroid), 12) AS sim
        FROM cur_centroid c, prev_centroid p) WHERE sim >= 0.4""",
    ),
    "greedy": (
        ("cand",),
        """SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS curs, CAST([] AS BIGINT[]) AS prevs,
        CAST(NULL AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS prev, CAST(NULL AS DOUBLE) AS sim
        UNION ALL SELECT c.rn,
        CASE WHEN list_contains(g.curs, c.cur) OR list_contains(g.prevs, c.prev) THEN g.curs ELSE list_append(g.curs, c.cur) END,
        CASE WHEN list_contains(g.curs, c.cur) OR list_contains(g.prevs, c.prev) THEN g.prevs ELSE list_append(g.prevs, c.prev) END,
        CASE WHEN list_contains(g.curs, c.cur) OR list_contains(g.prevs, c.prev) THEN NULL ELSE c.cur END,
        CASE WHEN list_contains(g.curs, c.cur) OR list_contains(g.prevs, c.prev) THEN NULL ELSE c.prev END,
        CASE WHEN list_contains(g.curs, c.cur) OR list_contains(g.prevs, c.prev) THEN NULL ELSE c.sim END
        FROM greedy g JOIN cand c ON c.rn = g.rn + 1""",
    ),
    "matches": (
        ("cur_centroid", "greedy"),
        """SELECT c.cluster_id AS current_cluster_id, g.prev AS previous_cluster_id,
        coalesce(g.sim, 0.0) AS similarity, CASE WHEN g.prev IS NULL THEN 'new' ELSE 'matched' END AS status
        FROM cur_centroid c LEFT JOIN (SELECT * FROM greedy WHERE cur IS NOT NULL) g ON g.cur = c.cluster_id""",
    ),
    "clusters": (
        ("cur",),
        """SELECT cluster_id, 'cluster ' || cluster_id AS label, count(*) AS document_count FROM cur GROUP BY cluster_id""",
    ),
    "prev_clusters": (("prev",), "SELECT cluster_id, count(*) AS document_count FROM prev GROUP BY cluster_id"),
    "trends": (
        ("clusters", "prev_clusters", "matches"),
        """SELECT *, CASE WHEN previous_cluster_id IS NULL THEN 'new'
        WHEN growth_rate IS NULL THEN CASE WHEN absolute_change > 0 THEN 'rising' ELSE 'stable' END
        WHEN growth_rate > 0.2 THEN 'rising' WHEN growth_rate < -0.2 THEN 'falling' ELSE 'stable' END AS status FROM (
        SELECT c.cluster_id AS current_cluster_id, m.previous_cluster_id, c.label, c.document_count AS current_count,
        coalesce(p.document_count, 0) AS previous_count, c.document_count - coalesce(p.document_count, 0) AS absolute_change,
        CASE WHEN p.document_count > 0 THEN CAST(c.document_count - p.document_count AS DOUBLE) / p.document_count END AS growth_rate,
        CASE WHEN m.previous_cluster_id IS NOT NULL THEN m.similarity END AS similarity
        FROM clusters c JOIN matches m ON m.current_cluster_id = c.cluster_id
        LEFT JOIN prev_clusters p ON p.cluster_id = m.previous_cluster_id)""",
    ),
    "stats": (
        ("cur", "items"),
        """SELECT m.cluster_id, count(DISTINCT i.source) AS source_count, avg(i.problem_confidence) AS average_problem_confidence
        FROM cur m JOIN items i ON i.id = m.item_id GROUP BY m.cluster_id""",
    ),
    "ranked": (
        ("clusters", "stats", "trends"),
        """SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, document_count DESC, cluster_id) AS rank FROM (
        SELECT *, round(0.35 * volume_score + 0.35 * growth_score + 0.15 * source_diversity_score
        + 0.15 * average_problem_confidence, 12) AS opportunity_score FROM (
        SELECT c.cluster_id, c.label, c.document_count, s.source_count, s.average_problem_confidence, t.growth_rate, t.status,
        CAST(c.document_count AS DOUBLE) / max(c.document_count) OVER () AS volume_score,
        CASE t.status WHEN 'new' THEN 0.75 WHEN 'stable' THEN 0.25 WHEN 'rising' THEN
        coalesce(t.growth_rate / max(CASE WHEN t.status = 'rising' AND t.growth_rate > 0 THEN t.growth_rate END) OVER (), 0.0)
        ELSE 0.0 END AS growth_score,
        CAST(s.source_count AS DOUBLE) / max(s.source_count) OVER () AS source_diversity_score
        FROM clusters c JOIN stats s USING (cluster_id) JOIN trends t ON t.current_cluster_id = c.cluster_id))""",
    ),
    "history": (
        (),
        """SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS id,
        date_trunc('day', ts) AS created_at,
        count(*) FILTER (event_type = 'error') AS total_problems, count(DISTINCT user_id) AS cluster_count,
        count(*) FILTER (event_type = 'signup') AS new_count, count(*) FILTER (event_type = 'purchase') AS rising_count,
        count(*) FILTER (event_type = 'view') AS stable_count, count(*) FILTER (event_type = 'click') AS falling_count
        FROM events GROUP BY ALL""",
    ),
    "docs": ((), "SELECT doc_id, text, source, n_chars, split_part(text, chr(10), 1) AS title FROM documents"),
    "solutions": (
        (),
        "SELECT CAST(100 + s_nationkey % 12 AS BIGINT) AS cluster_id, s_name AS name FROM supplier WHERE s_acctbal > 5000",
    ),
    "breakdown": (
        ("items",),
        """SELECT source, problem_count, share + CASE WHEN nth = 1 THEN 1.0 - sum(share) OVER () ELSE 0 END AS percentage FROM (
        SELECT source, problem_count, CAST(problem_count AS DOUBLE) / sum(problem_count) OVER () AS share,
        row_number() OVER (ORDER BY problem_count, source DESC) AS nth
        FROM (SELECT source, count(*) AS problem_count FROM items WHERE is_problem GROUP BY source))""",
    ),
    "terms": (
        ("cur", "items"),
        """SELECT m.cluster_id, m.item_id, t.term, count(*) AS tf FROM cur m JOIN items i ON i.id = m.item_id,
        LATERAL (SELECT unnest(regexp_extract_all(lower(i.document_text), '[\\p{L}\\p{N}_]{2,}')) AS term) t
        WHERE t.term NOT IN (@STOP@) GROUP BY ALL""",
    ),
    "keywords": (
        ("terms", "cur"),
        """SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS position FROM (
        SELECT cluster_id, term, round(sum(unit) / n, 9) AS score FROM (
        SELECT cluster_id, item_id, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id, item_id)) AS unit FROM (
        SELECT t.cluster_id, t.item_id, t.term, s.n,
        t.tf * (ln((1 + s.n) / CAST(1 + count(*) OVER (PARTITION BY t.cluster_id, t.term) AS DOUBLE)) + 1) AS w
        FROM terms t JOIN (SELECT cluster_id, CAST(count(*) AS DOUBLE) AS n FROM cur GROUP BY cluster_id) s USING (cluster_id)))
        GROUP BY cluster_id, term, n)""",
    ),
}


def sql(body: str, *layers: str) -> str:
    """``body`` behind the named layers and everything they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in LAYERS[name][0]:
                need(other)
            ordered.append(name)

    for name in layers:
        need(name)
    text = ", ".join(f"{name} AS ({LAYERS[name][1]})" for name in ordered)
    if "@STOP@" in text:
        text = text.replace("@STOP@", ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH))
    return f"WITH RECURSIVE {text} {body}" if ordered else body


def when(modulus: int) -> str:
    return f"doc_id % {modulus}"


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
HISTORY = "total_problems cluster_count new_count rising_count stable_count falling_count".split()
NOT_BLANK_TITLE = f"{strip('title')} <> ''"


def series(granularity: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in HISTORY)
    period = STAMP.format(f"date_trunc('{granularity}', created_at)")
    return sql(f"SELECT {period} AS period_start, {sums} FROM history GROUP BY 1", "history")


RANK_COLUMNS = """cluster_id, label, CAST(rank AS BIGINT) AS rank, round(opportunity_score, 6) AS opportunity_score, document_count,
coalesce(round(growth_rate, 6), -999.0) AS growth_rate, status, source_count,
round(average_problem_confidence, 6) AS average_problem_confidence"""

HN = f"""SELECT CAST(doc_id AS VARCHAR) AS external_id, 'hackernews' AS source, title,
md5(CASE WHEN doc_id % 17 = 3 THEN '' ELSE text END) AS body_md5,
CASE WHEN doc_id % 17 = 6 THEN 'https://news.ycombinator.com/item?id=' || doc_id ELSE 'https://example.test/' || doc_id END AS url,
source AS author, 1704067200 + doc_id AS published_epoch, CAST(n_chars AS INTEGER) AS engagement_score
FROM docs WHERE doc_id % 17 NOT IN (0, 1, 2, 4, 5, 7) AND title <> ''"""
GITHUB = f"""SELECT 'org/' || source || '#' || doc_id AS external_id, 'github' AS source, title,
md5(CASE WHEN doc_id % 17 = 3 THEN '' ELSE text END) AS body_md5, 'https://example.test/' || doc_id AS url,
CASE WHEN doc_id % 17 IN (8, 9) THEN '?' ELSE source END AS author,
1704067200 + doc_id - CASE WHEN doc_id % 17 = 7 THEN 7200 ELSE 0 END AS published_epoch,
CASE WHEN doc_id % 17 = 10 THEN -1 ELSE CAST(n_chars AS INTEGER) END AS engagement_score
FROM docs WHERE doc_id % 17 NOT IN (0, 1, 2, 4, 5, 6) AND {NOT_BLANK_TITLE}"""
STACK_TITLE = "CASE WHEN doc_id % 17 = 2 THEN 'Why & how?' ELSE title END"
STACK = f"""SELECT 'site' || doc_id % 3 || '#' || doc_id AS external_id, 'stackexchange' AS source, {STACK_TITLE} AS title,
md5(CASE WHEN doc_id % 17 = 5 THEN '' ELSE text END) AS body_md5, 'https://example.test/' || doc_id AS url,
CASE WHEN doc_id % 17 IN (6, 7, 8) THEN '?' ELSE source END AS author, 1704067200 + doc_id AS published_epoch,
CASE WHEN doc_id % 17 = 9 THEN -1 ELSE CAST(n_chars AS INTEGER) END AS engagement_score
FROM docs WHERE doc_id % 17 NOT IN (0, 1, 3, 4) AND (doc_id % 17 = 2 OR {NOT_BLANK_TITLE})"""
REDDIT_VALID = f"doc_id % 17 NOT IN (0, 1, 2, 5, 7, 9, 10) AND {NOT_BLANK_TITLE}"
REDDIT = f"""SELECT CAST(doc_id AS VARCHAR) AS external_id, 'reddit' AS source, title, md5(text) AS body_md5,
CASE WHEN doc_id % 17 = 4 THEN 'https://www.reddit.com/r/' || doc_id ELSE 'https://example.test/' || doc_id END AS url,
CASE WHEN doc_id % 17 = 11 THEN '?' ELSE source END AS author, 1704067200 + doc_id AS published_epoch,
CASE WHEN doc_id % 17 = 8 THEN -1 ELSE CAST(n_chars AS INTEGER) END AS engagement_score
FROM docs WHERE {REDDIT_VALID}"""

FEED_SCAN = f"""SELECT h.external_id, f.feed_order, f.position FROM (
SELECT item_id, min(feed_order) AS feed_order, arg_min(position, feed_order) AS position FROM (
SELECT 1 AS feed_order, -doc_id AS position, doc_id AS item_id FROM docs WHERE doc_id % 3 = 0
UNION ALL SELECT 2, doc_id, doc_id FROM docs WHERE doc_id % 2 = 0
UNION ALL SELECT 3, doc_id, doc_id FROM docs WHERE doc_id % 5 = 0) GROUP BY item_id) f
JOIN ({HN}) h ON h.external_id = CAST(f.item_id AS VARCHAR)"""
# A page is reached when all pages before it are there and hold three issues at least.
PAGED_SCAN = f"""SELECT g.external_id, CAST(split_part(g.external_id, '#', 2) AS BIGINT) AS issue,
list_position(['org/src1', 'org/src0', 'org/src2'], r.repository) AS place FROM ({GITHUB}) g JOIN (
SELECT *, row_number() OVER (PARTITION BY repository ORDER BY page) AS nth,
coalesce(min(issues) OVER (PARTITION BY repository ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS least
FROM (SELECT 'org/' || source AS repository, doc_id // 120 + 1 AS page, count(*) AS issues FROM docs GROUP BY ALL)) r
ON g.external_id LIKE r.repository || '#%' AND CAST(split_part(g.external_id, '#', 2) AS BIGINT) // 120 + 1 = r.page
WHERE r.repository IN ('org/src1', 'org/src0', 'org/src2') AND r.page = r.nth AND r.least >= 3"""
LISTING_SCAN = f"""SELECT CAST(doc_id AS VARCHAR) AS external_id, CASE source WHEN 'src2' THEN 1 ELSE 2 END AS turn,
doc_id AS position FROM docs WHERE source IN ('src2', 'src0') AND {REDDIT_VALID}"""

CUE_SQL = (
    r"\bi wish\b",
    r"\bis there (a|an|any) (tool|app|way|service|library)\b",
    r"\b(frustrat\w+|annoy\w+|tedious|painful|struggl\w+)\b",
    r"\b(manual(ly)?|by hand|copy(ing)? and past\w+)\b",
    r"\b(keeps?|kept) (fail\w+|break\w+|copying|crash\w+)\b",
    r"\b(los(e|ing)|wast(e|ing)) (\w+ ){0,3}(hours?|days?|time)\b",
    r"\b(can ?not|can''t|unable to|no way to)\b",
    r"\b(fails?|breaks?|crash(es)?) (unpredictably|randomly|every)\b",
)
CUES = " + ".join(f"CAST(regexp_matches(lower(document_text), '{c}') AS INTEGER)" for c in CUE_SQL)
COSINE = "round(1 - list_cosine_similarity(a.embedding, b.embedding), 6)"


def oracle() -> dict[str, str]:
    good_line = "doc_id % 13 NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)"
    good_answer = "doc_id % 11 IN (0, 1, 7, 8, 9, 10)"
    public = "NOT coalesce(is_problem, false)"
    return {
        # sources
        "hackernews_items": sql(HN, "docs"),
        "hackernews_feed_ids": sql(
            """SELECT CAST(doc_id // 500 AS BIGINT) AS page, CAST(doc_id % 500 AS INTEGER) AS position, doc_id AS item_id
            FROM docs WHERE doc_id % 7 > 2 AND (doc_id // 500) % 5 <> 3""", "docs"),
        "hackernews_feed_scan": sql(FEED_SCAN, "docs"),
        "hackernews_feed_first": sql(f"{FEED_SCAN} ORDER BY feed_order, position LIMIT 60", "docs"),
        "github_issues": sql(GITHUB, "docs"),
        "stackexchange_questions": sql(STACK, "docs"),
        "stackexchange_pages": sql(
            f"""SELECT q.external_id FROM ({STACK}) q JOIN (
            SELECT site, page FROM (SELECT site, page, row_number() OVER (PARTITION BY site ORDER BY page) AS nth FROM (
            SELECT DISTINCT doc_id % 3 AS site, doc_id // 150 + 1 AS page FROM docs)) WHERE page = nth AND page <= 7) p
            ON q.external_id LIKE 'site' || p.site || '#%' AND CAST(split_part(q.external_id, '#', 2) AS BIGINT) // 150 + 1 = p.page
            WHERE p.site IN (0, 2)""", "docs"),
        "conditional_pipeline": sql(
            f"""SELECT external_id, CAST(n > 0 AS INTEGER) AS is_problem, CASE WHEN n > 2 THEN 0.9 WHEN n = 2 THEN 0.8 WHEN n = 1 THEN 0.6 ELSE 0.5 END
            AS confidence, CAST(n > 0 AS INTEGER) AS has_vector FROM (SELECT external_id, {CUES} AS n FROM (
            SELECT g.external_id, concat_ws(chr(10) || chr(10), nullif({clean('d.title')}, ''), nullif({clean("CASE WHEN d.doc_id % 17 = 3 THEN '' ELSE d.text END")}, '')) AS document_text
            FROM ({GITHUB}) g JOIN docs d ON split_part(g.external_id, '#', 2) = CAST(d.doc_id AS VARCHAR)))""", "docs"),
        "analysis_run": sql(
            """SELECT run, count(*) FILTER (is_problem) AS available, count(*) FILTER (is_problem AND embedding IS NOT NULL) AS embedded,
            1 AS balanced, 1 AS covered FROM items, (SELECT unnest([1, 2]) AS run) GROUP BY run""", "items"),
        "latest_run_analytics": sql(
            """SELECT 'opportunity' AS part, CAST(cluster_id AS VARCHAR) AS name, CAST(rank AS DOUBLE) AS value FROM ranked WHERE rank <= 10
            UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S'), CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) FROM events GROUP BY ALL""", "ranked"),
        "too_few_points": "SELECT vec_id AS id, -1 AS cluster_id FROM embeddings",
        "exported_worklist": sql("SELECT source, external_id, sha256(document_text) AS digest FROM items WHERE is_problem IS NULL", "items"),
        "resumed_results": sql(
            """SELECT source, external_id, CAST(length(document_text) % 2 = 0 AS INTEGER) AS is_problem,
            CASE WHEN id % 2 = 0 THEN 'first' ELSE 'second' END AS classifier_name FROM items WHERE is_problem IS NULL""", "items"),
        "github_paged_scan": sql(f"SELECT external_id FROM ({PAGED_SCAN})", "docs"),
        "github_paged_first": sql(f"SELECT external_id FROM ({PAGED_SCAN}) ORDER BY place, issue LIMIT 20", "docs"),
        "reddit_posts": sql(REDDIT, "docs"),
        "reddit_listing_scan": sql(LISTING_SCAN, "docs"),
        "reddit_listing_first": sql(f"{LISTING_SCAN} ORDER BY turn, doc_id LIMIT 15", "docs"),
        "multi_source_union": sql(
            f"""SELECT source, source_order, count(*) AS n FROM (SELECT source, 1 AS source_order FROM ({REDDIT})
            UNION ALL SELECT source, 2 FROM ({HN}) UNION ALL SELECT source, 3 FROM ({GITHUB})) GROUP BY ALL""", "docs"),
        "classification_lines": sql(
            f"""SELECT doc_id, CASE WHEN {good_line} THEN source ELSE '?' END AS source,
            CASE WHEN {good_line} THEN CAST(doc_id AS VARCHAR) ELSE '?' END AS external_id,
            CASE WHEN {good_line} AND n_chars >= 400 THEN 1 ELSE 0 END AS is_problem,
            CASE WHEN {good_line} THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 100 ELSE -1 END AS confidence,
            CASE doc_id % 13 WHEN 0 THEN 'wrong fields' WHEN 1 THEN 'wrong fields' WHEN 2 THEN 'is_problem must be a boolean'
            WHEN 3 THEN 'confidence must be between 0 and 1' WHEN 4 THEN 'confidence must be a number' WHEN 5 THEN 'repeated key'
            WHEN 6 THEN 'reason must be non-blank text' WHEN 7 THEN 'malformed JSON' WHEN 8 THEN 'blank line'
            WHEN 9 THEN 'not an object' ELSE 'ok' END AS verdict FROM docs""", "docs"),
        "classification_duplicates": sql(
            """SELECT source, count(*) AS occurrences, CASE WHEN count(DISTINCT n_chars >= 400) = 1 AND count(DISTINCT n_chars % 2) = 1
            THEN 'identical' ELSE 'contradictory' END AS kind FROM docs GROUP BY source HAVING count(*) > 1""", "docs"),
        "model_outputs": sql(
            f"""SELECT doc_id, CAST(NOT ({good_answer} OR doc_id % 11 = 7) AS INTEGER) AS malformed,
            CASE WHEN doc_id % 11 = 7 OR {good_answer} AND n_chars >= 400 THEN 1 ELSE 0 END AS is_problem,
            CASE WHEN doc_id % 11 = 7 THEN 0.5 WHEN {good_answer} THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 100 ELSE -1 END AS confidence,
            CASE WHEN doc_id % 11 = 7 THEN 'uses ``` marks' WHEN {good_answer} THEN 'length ' || n_chars ELSE '?' END AS reason FROM docs""", "docs"),
        "work_items": sql(
            f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'wrong fields' WHEN doc_id % 5 = 1
            THEN 'source must be non-blank text' ELSE 'ok' END AS verdict FROM docs""", "docs"),
        "evaluation_cases": sql(
            """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'expected_is_problem must be a boolean' ELSE 'ok' END AS verdict
            FROM docs""", "docs"),
        "export_unclassified": sql(
            "SELECT source, external_id, md5(document_text) AS text_md5 FROM items WHERE is_problem IS NULL", "items"),
        "pending_work": sql(
            "SELECT source, external_id FROM items WHERE is_problem IS NULL AND id % 3 <> 0", "items"),
        "lookup_by_key": sql(
            "SELECT id, url FROM items WHERE is_problem", "items"),
        "lookup_by_hash": sql(
            f"""SELECT min(id) AS id, h AS dedup_hash FROM (SELECT id, sha256({collapse('lower(document_text)')}) AS h, is_problem FROM items)
            GROUP BY h HAVING bool_or(coalesce(is_problem, false))""", "items"),
        "known_keys": sql(
            "SELECT external_id, CAST(is_problem IS NOT NULL AS INTEGER) AS known FROM items", "items"),
        # filters and scalars
        "problem_filter": sql("SELECT id, source FROM items WHERE is_problem", "items"),
        "vector_space": sql("SELECT id, round(list_sum(embedding), 6) AS total FROM items WHERE embedding IS NOT NULL", "items"),
        "run_members": sql("SELECT cluster_id, item_id FROM cur WHERE cluster_id = 105", "cur"),
        "cluster_set": sql("SELECT cluster_id, item_id FROM cur WHERE cluster_id <> 109", "cur"),
        "pending_embedding": sql("SELECT id FROM items WHERE is_problem AND embedding IS NULL", "items"),
        "public_documents": sql(
            "SELECT id, title, url, coalesce(problem_confidence, 0.0) AS problem_confidence FROM items", "items"),
        "clean_text": f"SELECT page_id, {clean('html')} AS cleaned FROM pages",
        "document_text_and_hash": sql(
            f"""SELECT doc_id, md5(joined) AS text_md5, sha256({collapse('lower(joined)')}) AS dedup_hash FROM (
            SELECT doc_id, concat_ws(chr(10) || chr(10), nullif({clean('title')}, ''), nullif({clean('text')}, '')) AS joined FROM docs)""",
            "docs"),
        "excerpt": f"""SELECT doc_id, CASE WHEN length(c) <= 180 THEN c ELSE substring(c, 1, 180) || '…' END AS excerpt
            FROM (SELECT doc_id, {collapse('text')} AS c FROM documents)""",
        "words": r"""SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (
            SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)""",
        "period_starts": f"""SELECT {STAMP.format("date_trunc('day', ts)")} AS day, {STAMP.format("date_trunc('week', ts)")} AS week,
            {STAMP.format("date_trunc('month', ts)")} AS month, count(*) AS n FROM events GROUP BY ALL""",
        "iso_timestamps": sql(
            """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 1704067200 + doc_id - CASE doc_id % 4 WHEN 2 THEN 7200 ELSE 0 END END
            AS epoch FROM docs""", "docs"),
        "vector_functions": """SELECT a.vec_id, round(sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm,
            round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
            1 AS valid FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        # aggregates
        "problems_per_source": sql("SELECT source, count(*) AS problem_count FROM items WHERE is_problem GROUP BY source", "items"),
        "cluster_statistics": sql(
            "SELECT cluster_id, source_count, round(average_problem_confidence, 6) AS average_problem_confidence FROM stats", "stats"),
        "document_counts": sql("SELECT cluster_id, document_count FROM clusters", "clusters"),
        "source_breakdown": sql("SELECT source, problem_count, round(percentage, 6) AS percentage FROM breakdown", "breakdown"),
        "centroids": sql(
            """SELECT cluster_id, CAST(pos AS INTEGER) AS position, round(v, 6) AS value FROM (SELECT cluster_id, unnest(centroid) AS v,
            generate_subscripts(centroid, 1) AS pos FROM cur_centroid)""", "cur_centroid"),
        "trend_distribution": sql(
            """SELECT count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'rising') AS rising_count,
            count(*) FILTER (status = 'stable') AS stable_count, count(*) FILTER (status = 'falling') AS falling_count FROM trends""", "trends"),
        "series_day": series("day"),
        "series_week": series("week"),
        "series_month": series("month"),
        "last_periods": sql(
            f"""SELECT {STAMP.format("date_trunc('day', created_at)")} AS period_start, total_problems FROM history
            ORDER BY created_at DESC LIMIT 3""", "history"),
        "classifier_evaluation": """SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
            round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
            round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2.0 * tp + fp + fn), 6) AS f1_score FROM (
            SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (NOT e AND p) AS fp,
            count(*) FILTER (e AND NOT p) AS fn FROM (SELECT l.quality = 1 AS e, d.n_chars >= 400 AS p
            FROM labels l JOIN documents d USING (doc_id)))""",
        "misclassified": """SELECT doc_id, CAST(quality = 1 AS INTEGER) AS expected FROM labels JOIN documents USING (doc_id)
            WHERE (quality = 1) <> (n_chars >= 400)""",
        "ingestion_statistics": sql(
            """SELECT coalesce(source, 'total') AS source, count(*) AS acquired, count(*) FILTER (is_problem) AS problems,
            count(*) FILTER (NOT is_problem) AS non_problems, count(embedding) AS embedded, count(*) FILTER (id % 10 = 0) AS malformed
            FROM items GROUP BY ROLLUP (source)""", "items"),
        "insertion_statistics": sql(
            """SELECT coalesce(source, 'total') AS source, count(*) AS acquired, count(*) FILTER (is_problem IS NULL) AS new_items,
            count(*) FILTER (is_problem IS NOT NULL) AS existing_items FROM items GROUP BY ROLLUP (source)""", "items"),
        "analysis_summary": sql(
            """SELECT count(*) AS available, count(embedding) AS embedded, (SELECT count(*) FROM cur WHERE item_id % 5 > 0) AS assigned,
            count(embedding) - (SELECT count(*) FROM cur WHERE item_id % 5 > 0) AS noise,
            (SELECT count(*) FROM trends WHERE status = 'new') AS new_clusters,
            (SELECT count(*) FROM trends WHERE status = 'rising') AS rising_clusters,
            (SELECT count(*) FROM trends WHERE status = 'stable') AS stable_clusters,
            (SELECT count(*) FROM trends WHERE status = 'falling') AS falling_clusters FROM items WHERE is_problem""", "trends", "items", "cur"),
        "import_report": sql(
            f"""SELECT count(*) FILTER (d.id IS NOT NULL AND d.is_problem IS NULL) AS imported,
            count(*) FILTER (d.is_problem IS NOT NULL) AS skipped, count(*) FILTER (d.id IS NULL) AS missing FROM (
            SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE CAST(doc_id AS VARCHAR) END AS external_id FROM docs WHERE {good_line}) c
            LEFT JOIN items d USING (source, external_id)""", "docs", "items"),
        # runs, matching, trends, ranking
        "latest_run": sql(f"SELECT id, {STAMP.format('created_at')} AS created_at FROM history ORDER BY created_at DESC LIMIT 1", "history"),
        "latest_compatible_run": sql(
            f"""SELECT id, {STAMP.format('created_at')} AS created_at FROM history WHERE id % 3 = 1 AND id <> (SELECT max(id) FROM history WHERE id % 3 = 1)
            ORDER BY created_at DESC LIMIT 1""", "history"),
        "run_predecessors": sql(
            "SELECT id, coalesce(lag(id) OVER (PARTITION BY id % 3 ORDER BY created_at, id), -1) AS previous_id FROM history", "history"),
        "cluster_matching": sql(
            """SELECT current_cluster_id, coalesce(previous_cluster_id, -1) AS previous_cluster_id, round(similarity, 6) AS similarity, status
            FROM matches""", "matches"),
        "trend_detection": sql(
            """SELECT current_cluster_id, coalesce(previous_cluster_id, -1) AS previous_cluster_id, current_count, previous_count,
            absolute_change, coalesce(round(growth_rate, 6), -999.0) AS growth_rate, status, coalesce(round(similarity, 6), -999.0) AS similarity
            FROM trends""", "trends"),
        "opportunity_ranking": sql(
            f"""SELECT {RANK_COLUMNS}, round(volume_score, 6) AS volume_score, round(growth_score, 6) AS growth_score,
            round(source_diversity_score, 6) AS source_diversity_score FROM ranked""", "ranked"),
        "topic_keywords": sql(
            "SELECT cluster_id, CAST(position AS INTEGER) AS position, term, round(score, 6) AS score FROM keywords WHERE position <= 5", "keywords"),
        "topic_labels": sql(
            "SELECT cluster_id, string_agg(term, ', ' ORDER BY position) AS label FROM keywords WHERE position <= 5 GROUP BY cluster_id", "keywords"),
        "market_coverage": sql(
            """SELECT c.cluster_id, count(s.name) AS solution_count, CASE WHEN count(s.name) = 0 THEN 'non_presidiato'
            WHEN count(s.name) < 5 THEN 'parzialmente_coperto' ELSE 'saturo' END AS coverage
            FROM clusters c LEFT JOIN solutions s ON s.cluster_id = c.cluster_id GROUP BY c.cluster_id""", "clusters", "solutions"),
        "lexical_classification": sql(
            f"""SELECT id, CAST(n > 0 AS INTEGER) AS is_problem, CASE WHEN n > 2 THEN 0.9 WHEN n = 2 THEN 0.8 WHEN n = 1 THEN 0.6 ELSE 0.5 END
            AS confidence FROM (SELECT id, {CUES} AS n FROM items)""", "items"),
        "nearest_problems": sql(
            f"""SELECT b.id, {COSINE} AS distance FROM (SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings ORDER BY vec_id LIMIT 1) a,
            items b WHERE b.embedding IS NOT NULL ORDER BY 1 - list_cosine_similarity(a.embedding, b.embedding), b.id LIMIT 20""", "items"),
        "batch_search": sql(
            f"""SELECT query_id, item_id, CAST(position AS INTEGER) AS position, round(distance, 6) AS distance FROM (
            SELECT a.vec_id AS query_id, b.id AS item_id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), b.embedding) AS distance,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), b.embedding), b.id) AS position
            FROM embeddings a, items b WHERE b.embedding IS NOT NULL) WHERE position <= 5""", "items"),
        "approximate_search": sql(
            """SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM items WHERE embedding IS NOT NULL)) AS neighbours,
            1 AS recall_is_high FROM embeddings""", "items"),
        "word_count_classification": sql(
            """SELECT i.id, CAST(t >= 0 AS INTEGER) AS is_problem, round(1 / (1 + exp(-least(abs(t), 700))), 6) AS confidence FROM (
            SELECT i.id, coalesce(o.odds, 0) + ln((SELECT count(*) FILTER (is_problem) + 1 FROM items) / (SELECT count(*) FILTER (NOT is_problem) + 1 FROM items)) AS t
            FROM items i LEFT JOIN (
                SELECT id, sum(ln((yes + 1) / (ny + v)) - ln((no + 1) / (nn + v))) AS odds FROM tokens JOIN counts USING (term), totals GROUP BY id) o USING (id)) i""",
            "items", "tokens", "counts", "totals"),
        "document_weights": sql(
            """SELECT id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS largest FROM (
            SELECT id, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w
            FROM (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term), (SELECT count(*) AS n FROM items)) GROUP BY id""", "items", "tokens"),
        "projected_vectors": sql(
            f"""SELECT id, 128 AS dimensions, 1.0 AS norm, 'projected-words-128' AS embedding_model FROM items
            WHERE is_problem AND {strip('document_text')} <> ''""", "items"),
        "cleaned_documents": """
            WITH doc AS (SELECT doc_id, string_split(nfc_normalize(coalesce(text, '')), chr(10)) AS l FROM documents),
            line AS (SELECT l, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(l, lambda x: trim(x, ' ')))) AS l FROM doc) WHERE l <> '' GROUP BY l),
            often AS (SELECT coalesce(list(l), []) AS often FROM line WHERE n > 0.01 * (SELECT count(*) FROM documents) AND n >= 10),
            kept AS (SELECT doc_id, len(l) AS n, list_filter(l, lambda x: NOT list_contains(often, trim(x, ' '))) AS k FROM doc, often),
            whole AS (SELECT doc_id, n - len(k) AS gone, array_to_string(k, chr(10)) AS t FROM kept)
            SELECT doc_id, sha256(t) AS digest, CAST(gone AS INTEGER) AS removed_lines,
            CASE WHEN length(trim(t, ' ' || chr(9) || chr(13) || chr(10))) = 0 THEN 'empty' WHEN length(trim(t, ' ' || chr(9) || chr(13) || chr(10))) < 200 THEN 'too short' ELSE '' END AS reason FROM whole""",
        # item table
        "upsert": sql(
            """SELECT external_id, source, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS version,
            CASE WHEN id % 6 = 0 THEN 0 WHEN id % 6 = 3 THEN 1 ELSE coalesce(CAST(is_problem AS INTEGER), -1) END AS is_problem,
            CAST(embedding IS NOT NULL AND id % 6 <> 0 AS INTEGER) AS has_vector FROM items WHERE is_problem IS NOT NULL OR id % 3 = 0""", "items"),
        "upsert_batches": sql(
            """SELECT external_id, source, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS version,
            CASE WHEN id % 6 = 0 THEN 0 WHEN id % 6 = 3 THEN 1 ELSE coalesce(CAST(is_problem AS INTEGER), -1) END AS is_problem,
            CAST(embedding IS NOT NULL AND id % 6 <> 0 AS INTEGER) AS has_vector FROM items WHERE is_problem IS NOT NULL OR id % 3 = 0""", "items"),
        "insert_new": sql("SELECT source, external_id FROM items WHERE is_problem IS NULL", "items"),
        "id_clash_ranks": sql(
            """
            SELECT source, external_id, nth FROM (
                SELECT source, external_id, is_problem, row_number() OVER (
                    PARTITION BY substr(md5(source || ':' || external_id), 1, 3)
                    ORDER BY is_problem IS NULL, source, external_id
                ) - 1 AS nth
                FROM items
            ) WHERE is_problem IS NULL AND nth > 0
            """,
            "items",
        ),
        "apply_classifications": sql(
            f"""SELECT external_id, CASE WHEN is_problem IS NOT NULL THEN CAST(is_problem AS INTEGER) WHEN {good_line.replace('doc_id', 'id')}
            THEN CAST(engagement_score >= 400 AS INTEGER) ELSE -1 END AS is_problem FROM items""", "items"),
        "overwrite_classifications": sql(
            f"""SELECT external_id, CASE WHEN {good_line.replace('doc_id', 'id')} THEN CAST(engagement_score >= 400 AS INTEGER)
            ELSE coalesce(CAST(is_problem AS INTEGER), -1) END AS is_problem,
            CAST(embedding IS NOT NULL AND NOT ({good_line.replace('doc_id', 'id')} AND engagement_score < 400) AS INTEGER) AS has_vector
            FROM items""", "items"),
        "attach_embeddings": sql(
            "SELECT id, CAST(coalesce(is_problem, false) AND raw_vector IS NOT NULL AS INTEGER) AS has_vector FROM items", "items"),
        "embedding_report": sql(
            f"""SELECT count(*) AS selected, count(*) FILTER (is_problem AND id % 2 = 1) AS embedded,
            count(*) FILTER ({public}) AS errors FROM items WHERE raw_vector IS NOT NULL""", "items"),
        "missing_members": sql("SELECT m.cluster_id, m.item_id FROM cur m WHERE m.item_id % 4 = 0", "cur"),
        # quality
        "item_violations": sql(
            """SELECT id, rule FROM (SELECT id, unnest(list_filter([
            CASE WHEN embedding IS NOT NULL AND id % 9 = 0 THEN 'embedding and model come together' END,
            CASE WHEN embedding IS NOT NULL AND id % 9 = 1 THEN 'model is not blank' END,
            CASE WHEN is_problem IS NOT NULL AND id % 9 = 2 THEN 'verdict and its facts come together' END,
            CASE WHEN is_problem IS NOT NULL AND id % 9 = 3 THEN 'confidence is between 0 and 1' END], lambda x: x IS NOT NULL)) AS rule FROM items)""",
            "items"),
        "repeated_keys": "SELECT source, lang, count(*) AS occurrences FROM documents GROUP BY source, lang HAVING count(*) > 1",
        "classification_violations": sql(
            """SELECT doc_id, 'reason is not blank' AS rule FROM docs WHERE doc_id % 7 = 0 UNION ALL
            SELECT doc_id, 'confidence is a finite number between 0 and 1' FROM docs WHERE doc_id % 5 = 0""", "docs"),
        "coverage_violations": sql(
            """SELECT cluster_id, CASE WHEN cluster_id = 109 THEN 'missing' ELSE 'repeated' END AS problem FROM clusters WHERE cluster_id IN (100, 109)
            UNION ALL SELECT 7, 'unknown'""", "clusters"),
        "match_violations": sql(
            """SELECT current_cluster_id, 'similarity is a cosine' AS rule FROM matches WHERE current_cluster_id = 101
            UNION ALL SELECT current_cluster_id, 'unmatched clusters have status new' FROM matches WHERE previous_cluster_id IS NULL""", "matches"),
        "trend_violations": sql(
            """SELECT current_cluster_id, 'unknown status' AS rule FROM trends WHERE status = 'falling'
            UNION ALL SELECT current_cluster_id, rule FROM trends, (VALUES ('count equals the cluster''s'),
            ('change is the difference of the counts')) r(rule) WHERE status = 'stable'""", "trends"),
        "ranking_violations": sql(
            "SELECT cluster_id, 'label equals the cluster''s' AS rule FROM ranked WHERE rank <= 3", "ranked"),
        "match_rules": sql(
            """SELECT current_cluster_id, rule FROM matches, (VALUES ('current cluster matched twice'), ('previous cluster matched twice')) r(rule),
            (VALUES (1), (2)) twice(n) WHERE current_cluster_id = 100 AND (previous_cluster_id IS NOT NULL OR rule LIKE 'current%')
            UNION ALL SELECT current_cluster_id + 1000, 'unknown current cluster' FROM matches WHERE current_cluster_id = 103
            UNION ALL SELECT current_cluster_id, 'unknown previous cluster' FROM matches WHERE current_cluster_id = 104 AND previous_cluster_id IS NOT NULL
            UNION ALL SELECT current_cluster_id, 'matched clusters have status matched and a similarity' FROM matches
            WHERE current_cluster_id = 105 AND previous_cluster_id IS NOT NULL""", "matches"),
        "trend_rules": sql(
            """SELECT current_cluster_id, rule FROM trends, (VALUES ('clusters without a previous one are new'),
            ('clusters without a previous one have no previous count'), ('similarity comes with a previous cluster')) r(rule) WHERE current_cluster_id = 100
            UNION ALL SELECT current_cluster_id, 'cluster has one trend' FROM trends, (VALUES (1), (2)) twice(n) WHERE current_cluster_id = 101
            UNION ALL SELECT current_cluster_id, 'cluster has a trend' FROM trends WHERE current_cluster_id = 102
            UNION ALL SELECT current_cluster_id, 'clusters with a previous one are not new' FROM trends WHERE current_cluster_id = 103
            UNION ALL SELECT current_cluster_id, 'similarity is a cosine' FROM trends WHERE current_cluster_id = 104
            UNION ALL SELECT current_cluster_id, 'change is the difference of the counts' FROM trends WHERE current_cluster_id IN (105, 108)
            UNION ALL SELECT current_cluster_id, 'growth is finite' FROM trends WHERE current_cluster_id = 106
            UNION ALL SELECT current_cluster_id, 'unknown previous cluster' FROM trends WHERE current_cluster_id = 107
            UNION ALL SELECT current_cluster_id, 'counts are not negative' FROM trends WHERE current_cluster_id = 108
            UNION ALL SELECT current_cluster_id + 1000, 'unknown current cluster' FROM trends WHERE current_cluster_id = 109""", "trends"),
        "ranking_rules": sql(
            """SELECT cluster_id, rule FROM ranked, (VALUES ('rank is unique'), ('cluster has one rank')) r(rule), (VALUES (1), (2)) twice(n) WHERE cluster_id = 100
            UNION ALL SELECT cluster_id, 'cluster is ranked' FROM ranked WHERE cluster_id = 101
            UNION ALL SELECT cluster_id, 'rank is positive' FROM ranked WHERE cluster_id = 102
            UNION ALL SELECT cluster_id, 'growth is finite' FROM ranked WHERE cluster_id = 103
            UNION ALL SELECT cluster_id, 'count equals the cluster''s' FROM ranked WHERE cluster_id = 104
            UNION ALL SELECT cluster_id + 1000, 'unknown cluster' FROM ranked WHERE cluster_id = 105""", "ranked"),
        "history_violations": sql(
            "SELECT id, 'metadata equals the latest run''s' AS rule FROM history WHERE id % 3 <> (SELECT max(id) % 3 FROM history)", "history"),
        "membership_violations": sql(
            """SELECT cluster_id, 'cluster uses one model' AS rule FROM (SELECT cluster_id, count(DISTINCT item_id % 2) AS n FROM cur GROUP BY cluster_id)
            WHERE n <> 1""", "cur"),
        # query surface
        "cluster_detail": sql(f"SELECT {RANK_COLUMNS} FROM ranked WHERE cluster_id = 105", "ranked"),
        "top_opportunities": sql(f"SELECT {RANK_COLUMNS} FROM ranked WHERE rank <= 3", "ranked"),
        "exact_duplicates": sql(
            """SELECT id, kept_id, copies, 'same text' AS reason FROM (SELECT id, min(id) OVER w AS kept_id, count(*) OVER w AS copies
            FROM items WHERE document_text IS NOT NULL WINDOW w AS (PARTITION BY document_text)) WHERE copies > 1""", "items"),
        "url_duplicates": sql(
            """SELECT id, kept_id, copies, 'same address' AS reason FROM (SELECT page_id AS id, min(page_id) OVER w AS kept_id,
            count(*) OVER w AS copies FROM pages WINDOW w AS (PARTITION BY page_id // 4)) WHERE copies > 1"""),
        "cluster_citations": sql(
            f"""SELECT cluster_id, {STAMP.format('min(published_at)')} AS first_cited, {STAMP.format('max(published_at)')} AS last_cited
            FROM cur m JOIN items i ON i.id = m.item_id GROUP BY cluster_id""", "cur", "items"),
        "cluster_sources": sql(
            """SELECT cluster_id, source, documents, round(CAST(documents AS DOUBLE) / sum(documents) OVER (PARTITION BY cluster_id), 6) AS share
            FROM (SELECT cluster_id, source, count(*) AS documents FROM cur m JOIN items i ON i.id = m.item_id GROUP BY ALL)""", "cur", "items"),
        "cluster_representatives": sql(
            """SELECT cluster_id, item_id, place FROM (SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id
            ORDER BY round(list_cosine_similarity(m.embedding, c.centroid), 9) DESC, item_id) AS place
            FROM cur m JOIN cur_centroid c USING (cluster_id)) WHERE place <= 3""", "cur", "cur_centroid"),
        "filtered_clusters": sql(
            """SELECT cluster_id, document_count, matching FROM clusters JOIN (SELECT cluster_id, count(*) AS matching FROM cur m
            JOIN items i ON i.id = m.item_id WHERE source IN ('src0', 'src3', 'src5') AND published_at >= TIMESTAMP '2024-01-05'
            AND published_at < TIMESTAMP '2024-01-25' GROUP BY cluster_id) USING (cluster_id) WHERE document_count >= 3""", "clusters", "cur", "items"),
        "success_metrics": sql(
            """SELECT count(*) AS documents,
            round(CAST(count(*) FILTER (is_problem AND embedding IS NOT NULL) AS DOUBLE) / count(*) FILTER (is_problem), 6) AS embedding_coverage,
            round(CAST(count(*) FILTER (trim(url) <> '') AS DOUBLE) / count(*), 6) AS link_coverage,
            (SELECT count(DISTINCT cluster_id) FROM cur) AS clusters,
            (SELECT round(CAST(count(DISTINCT c.cluster_id) FILTER (s.name IS NOT NULL) AS DOUBLE) / count(DISTINCT c.cluster_id), 6)
            FROM cur c LEFT JOIN solutions s ON s.cluster_id = c.cluster_id) AS market_coverage FROM items""", "items", "cur", "solutions"),
        "clusters_by_coverage": sql(
            """SELECT cluster_id, document_count, document_count AS matching FROM clusters c
            WHERE (SELECT count(*) FROM solutions s WHERE s.cluster_id = c.cluster_id) < 5""", "clusters", "solutions"),
        "dashboard_summary": sql(
            f"""SELECT (SELECT CAST(sum(problem_count) AS BIGINT) FROM breakdown) AS total_problems, (SELECT count(*) FROM clusters) AS total_clusters,
            count(*) FILTER (status = 'new') AS new_clusters, count(*) FILTER (status = 'rising') AS rising_clusters,
            count(*) FILTER (status = 'stable') AS stable_clusters, count(*) FILTER (status = 'falling') AS falling_clusters,
            (SELECT count(*) FROM breakdown) AS source_count, (SELECT max(id) FROM history) AS latest_run_id,
            (SELECT {STAMP.format('max(created_at)')} FROM history) AS latest_run_created_at FROM trends""", "trends", "breakdown", "history"),
        "opportunities": sql(f"SELECT {RANK_COLUMNS} FROM ranked WHERE status = 'rising' ORDER BY rank LIMIT 20", "ranked"),
        "cluster_page": sql(
            f"SELECT {RANK_COLUMNS} FROM ranked ORDER BY growth_rate DESC NULLS LAST, cluster_id LIMIT 5 OFFSET 2", "ranked"),
        "dashboard_trends": sql(
            f"""SELECT {STAMP.format("date_trunc('week', created_at)")} AS period_start, CAST(sum(total_problems) AS BIGINT) AS total_problems,
            (SELECT count(*) FROM trends WHERE status = 'rising') AS rising_now FROM history GROUP BY 1 ORDER BY 1 DESC LIMIT 2""",
            "history", "trends"),
        "cluster_documents": sql(
            f"""SELECT i.id, {STAMP.format('published_at')} AS published_at, problem_confidence FROM cur m JOIN items i ON i.id = m.item_id
            WHERE m.cluster_id = 105 ORDER BY i.published_at DESC, i.id LIMIT 10""", "cur", "items"),
        # streaming
        "stream_daily_problems": f"""SELECT {STAMP.format("date_trunc('day', ts)")} AS period_start, count(*) AS problem_count FROM events
            WHERE event_type = 'error' GROUP BY 1""",
        "stream_weekly_problems": f"""SELECT {STAMP.format("date_trunc('week', ts)")} AS period_start, count(*) AS problem_count FROM events
            WHERE event_type = 'error' GROUP BY 1""",
        "stream_monthly_problems": f"""SELECT {STAMP.format("date_trunc('month', ts)")} AS period_start, count(*) AS problem_count FROM events
            WHERE event_type = 'error' GROUP BY 1""",
        "stream_insert_new": sql("SELECT source, external_id FROM items WHERE is_problem IS NULL", "items"),
    }
