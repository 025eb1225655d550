"""DuckDB SQL for the queries, from shared common table expressions."""

from __future__ import annotations

import re

from .params import CAVEAT, LOW_CONFIDENCE, PHRASES, SIGNALS, THRESHOLDS, WEIGHTS

R = 6
_D = lambda x: f"CAST({x} AS DOUBLE)"
_TIER = lambda s: f"CASE WHEN {s} < 25 THEN 'low' WHEN {s} < 50 THEN 'medium' WHEN {s} < 75 THEN 'high' ELSE 'critical' END"
_RANK = lambda s: f"list_position(['low','medium','high','critical'], {s}) - 1"
# The default globs and the words of bug-fix subjects, as in params.py and functions/commits.py.
EXCLUDED = r"regexp_matches(path, '^(.*/)?(node_modules|dist|build|out|vendor)/.*$') OR regexp_matches(path, '^(.*/)?([^/]*\.min\.js|[^/]*\.bundle\.js|[^/]*\.map|[^/]*\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$')"
BUGFIX = r"""(regexp_matches(subject, '(?i)\b(bugfix(e[sd])?|fix(e[sd])?|bug|defect|fault|crash|hotfix|patch|regression|broke(n)?)\b') OR regexp_matches(subject, '(?i)\b(close[sd]?|fix(e[sd])?|resolve[sd]?)\s+#[0-9]+')) AND NOT regexp_matches(subject, '(?i)\b(merge|cherry[- ]pick|revert)\b')"""
RAW = (*SIGNALS, "complexity")
_BOUND = ", ".join(f"min(ln(1+{_D(s)})) lo_{s}, max(ln(1+{_D(s)})) hi_{s}" for s in RAW)
_UNIT = ", ".join(f"CASE WHEN hi_{s} > lo_{s} THEN (ln(1+{_D(s)}) - lo_{s}) / (hi_{s} - lo_{s}) ELSE 0.0::DOUBLE END norm_{s}" for s in RAW)
_CORE = " + ".join(f"norm_{s} * {WEIGHTS[s]}::DOUBLE" for s in SIGNALS)
_SHARES = ", ".join(f"CASE WHEN core > 0 THEN norm_{s} * {WEIGHTS[s]}::DOUBLE / core ELSE 0.0::DOUBLE END share_{s}" for s in SIGNALS)
_DOMINANT = " ".join(f"WHEN share_{s} = greatest({', '.join(f'share_{x}' for x in SIGNALS)}) THEN '{s}'" for s in SIGNALS)
_LIST = ", ".join(f"struct_pack(minus := -share_{s}, place := {i}, signal := '{s}', phrase := '{PHRASES[s]}')" for i, s in enumerate(SIGNALS))
_PART = lambda n: f"concat('src/part_', {n} % 20, '/file_', {n}, '.ts')"
_REASONS = "concat_ws(', ', CASE WHEN max_depth >= 5 THEN 'deeply nested' ELSE 'nested' END || ' (depth ' || max_depth || ')', CASE WHEN line_count >= 20 THEN 'long block (' || line_count || ' lines)' END)"

CTES: dict[str, str] = {
    "commits": """SELECT c_mktsegment AS repo, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey DESC) AS walk_seq, o_orderkey AS sha,
        concat('dev_', CAST(o_custkey % 12 AS VARCHAR)) AS author, strftime(o_orderdate, '%Y-%m-%d') AS author_date, o_orderdate AS author_ts,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'fix crash in importer' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN concat('closes #', CAST(o_orderkey AS VARCHAR))
             WHEN o_orderpriority = '2-HIGH' THEN 'prefix the config keys' WHEN o_orderpriority = '3-MEDIUM' THEN 'Revert "fix the parser bug"' ELSE 'add dark mode toggle' END AS subject, o_orderkey % 10 = 0 AS is_merge
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "touches": f"""SELECT m.repo, m.walk_seq, l_linenumber AS row_no, m.sha, m.author, m.author_date, m.author_ts, m.subject, {BUGFIX} AS is_bugfix,
        CASE WHEN l_linenumber = 1 THEN {_PART('l_partkey')} ELSE concat(CASE p_type WHEN 'PROMO' THEN 'dist/' WHEN 'LARGE' THEN 'lib/core/' ELSE concat('src/', lower(p_type), '/') END, replace(lower(p_brand), '#', '_'), '.ts') END AS path,
        CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM lineitem JOIN commits m ON l_orderkey = m.sha JOIN part ON l_partkey = p_partkey""",
    "files": f"""SELECT ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][doc_id % 5 + 1] AS repo, {_PART('doc_id')} AS path,
        array_to_string(list_transform(string_split(text, chr(10)), lambda l: repeat('    ', length(l) % 7) || l), chr(10)) AS content FROM documents""",
    "changes": "SELECT change_id, repo, path, length(path) AS pos FROM (SELECT DISTINCT CAST(sha AS VARCHAR) AS change_id, repo, path FROM touches UNION ALL SELECT DISTINCT CAST(sha AS VARCHAR), repo, 'src/new/file.ts' FROM touches) t",
    "refs": "SELECT repo, arg_min(author_ts, walk_seq) AS ref_ts FROM commits WHERE author_ts IS NOT NULL GROUP BY repo",
    "aged": "SELECT t.*, greatest(epoch_ms(ref_ts) - epoch_ms(author_ts), 0) AS age FROM touches t JOIN refs USING (repo)",
    "file_author": f"""SELECT repo, path, author, count(*) AS commits, count(*) FILTER (is_bugfix) AS bugfix_commits, sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted,
        sum(pow(0.5::DOUBLE, age / 31536000000::DOUBLE)) AS recency_weight, count(*) FILTER (age <= 7776000000) AS recent_commits FROM aged GROUP BY ALL""",
    "seen": "SELECT repo, path, arg_min(author_date, (author_ts, walk_seq)) AS first_seen, arg_max(author_date, (author_ts, -walk_seq)) AS last_seen FROM touches GROUP BY ALL",
    "churn_all": """SELECT repo, path, sum(commits)::BIGINT AS commits, sum(bugfix_commits)::BIGINT AS bugfix_commits, sum(lines_added)::BIGINT AS lines_added, sum(lines_deleted)::BIGINT AS lines_deleted, count(*) AS n_authors,
        sum(recency_weight) AS recency_weight, sum(recent_commits)::BIGINT AS recent_commits, max(commits) / sum(commits)::DOUBLE AS top_share, 1 - max(commits) / sum(commits)::DOUBLE AS fragmentation, sum(bugfix_commits) / sum(commits)::DOUBLE AS bugfix_density FROM file_author GROUP BY ALL""",
    "minor": "SELECT repo, path, count(*) FILTER (f.commits / c.commits::DOUBLE < 0.05::DOUBLE) AS minor_contributors FROM file_author f JOIN churn_all c USING (repo, path) GROUP BY ALL",
    "churn": f"SELECT * FROM churn_all JOIN minor USING (repo, path) JOIN seen USING (repo, path) WHERE NOT ({EXCLUDED})",
    "commit_paths": "SELECT * FROM (SELECT DISTINCT repo, walk_seq, path FROM touches) d JOIN (SELECT repo, walk_seq FROM (SELECT DISTINCT repo, walk_seq, path FROM touches) x GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50) s USING (repo, walk_seq)",
    "co_change": f"""SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS shared_commits FROM (SELECT * FROM commit_paths WHERE NOT ({EXCLUDED})) a JOIN (SELECT * FROM commit_paths WHERE NOT ({EXCLUDED})) b ON a.repo = b.repo AND a.walk_seq = b.walk_seq AND a.path < b.path GROUP BY ALL""",
    "strong": "SELECT p.*, shared_commits / greatest(coalesce(a.commits, 0), coalesce(b.commits, 0))::DOUBLE AS strength FROM co_change p LEFT JOIN churn a ON a.repo = p.repo AND a.path = path_a LEFT JOIN churn b ON b.repo = p.repo AND b.path = path_b WHERE shared_commits >= 5 AND greatest(coalesce(a.commits, 0), coalesce(b.commits, 0)) > 0",
    "links": "SELECT repo, path_a AS path, path_b AS partner, strength, shared_commits FROM strong UNION ALL SELECT repo, path_b, path_a, strength, shared_commits FROM strong",
    "partners": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY strength DESC, shared_commits DESC, partner) AS partner_rank FROM links) x WHERE partner_rank <= 5",
    "lines": r"""SELECT repo, path, i - 1 AS line, CASE WHEN regexp_matches(l, '^[ \t]*\r?$') THEN -1 ELSE length(regexp_extract(l, '^[ \t]*')) // 4 END AS depth FROM (SELECT repo, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM files) x""",
    "complexity": "SELECT repo, path, coalesce(sum(depth) FILTER (depth >= 0), 0)::BIGINT AS total, coalesce(avg(depth) FILTER (depth >= 0), 0)::DOUBLE AS mean, coalesce(max(depth) FILTER (depth >= 0), 0)::INT AS max, count(*) FILTER (depth >= 0) AS lines FROM lines GROUP BY ALL",
    "runs": "SELECT repo, path, min(line) AS start_line, max(line) AS end_line, max(depth) AS max_depth, max(line) - min(line) + 1 AS line_count FROM (SELECT *, sum(CASE WHEN depth BETWEEN 0 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line) AS gid FROM lines) x WHERE depth >= 3 GROUP BY repo, path, gid HAVING max(line) - min(line) + 1 >= 3",
    "regions": f"""SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY score DESC, start_line) AS region_rank FROM (SELECT *, {_TIER('score')} AS severity FROM (SELECT *, CAST(round(100 * (0.7::DOUBLE * least(1.0::DOUBLE, max_depth / 10.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, line_count / 60.0::DOUBLE))) AS INT) AS score FROM runs) x) y""",
    "raw": "SELECT c.repo, c.path, commits AS freq, lines_added + lines_deleted AS churn, recency_weight AS recency, n_authors AS authors, fragmentation AS ownership, bugfix_density, commits, recent_commits, coalesce(k.coupling, 0) AS coupling, coalesce(x.total, 0) AS complexity FROM churn c LEFT JOIN (SELECT repo, path, max(strength) AS coupling FROM links GROUP BY ALL) k USING (repo, path) LEFT JOIN complexity x USING (repo, path)",
    "norm": f"SELECT raw.*, {_UNIT} FROM raw JOIN (SELECT repo, {_BOUND} FROM raw GROUP BY repo) b USING (repo)",
    "scored": f"SELECT *, CAST(round(100 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, core * (0.5::DOUBLE + 0.5::DOUBLE * norm_complexity) * (1 + bugfix_density)))) AS INT) AS score FROM (SELECT *, {_CORE} AS core FROM norm) x",
    "risk": f"SELECT *, {_TIER('score')} AS tier, CASE WHEN commits <= 0 THEN 'stable' WHEN recent_commits / commits::DOUBLE >= 0.5 AND commits >= 3 THEN 'rising' WHEN recent_commits / commits::DOUBLE <= 0.1::DOUBLE THEN 'cooling' ELSE 'stable' END AS trend, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM scored",
    "shared": f"SELECT *, {_SHARES} FROM risk",
    "explained": f"""SELECT *, CASE WHEN dominant IS NULL THEN 'Not enough history to attribute this score. {CAVEAT}' ELSE 'Mostly because it ' || array_to_string(list_transform(list_filter(ranked, lambda r: r.minus < 0)[1:2], lambda r: (CASE WHEN r.signal = 'coupling' AND coalesce(partner, '') <> '' THEN 'is coupled to ' || partner ELSE r.phrase END) || ' (' || CAST(CAST(round(-r.minus * 100) AS INT) AS VARCHAR) || '%)'), ' and ') || '. {CAVEAT}' END AS sentence,
        array_to_string(list_transform(ranked, lambda r: r.signal || ' ' || CAST(CAST(round(-r.minus * 100) AS INT) AS VARCHAR) || '%'), ' · ') AS line FROM (SELECT *, CASE WHEN core > 0 THEN CASE {_DOMINANT} END END AS dominant, CAST(round(core * 100) AS INT) AS core_pct, list_sort([{_LIST}]) AS ranked,
        CASE WHEN share_coupling > 0 THEN top_partner END AS partner FROM shared LEFT JOIN (SELECT repo, path, partner AS top_partner FROM partners WHERE partner_rank = 1) p USING (repo, path)) x""",
    "set_": "SELECT change_id, repo, lower(path) AS lower_path, arg_min(path, (pos, path)) AS path, min(pos) AS pos FROM changes GROUP BY ALL",
}
_ORDER = list(CTES)


def sql(select: str, ctes: dict[str, str] = CTES) -> str:
    """select with the table expressions that it needs."""
    need: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(ctes[name])
    return "WITH " + ", ".join(f"{n} AS ({ctes[n]})" for n in _ORDER if n in need) + " " + select if need else select


_PCT = lambda x: f"CAST(CAST(round({x} * 100) AS INT) AS VARCHAR) || '%'"
_OWN = "CASE dominant " + " ".join(f"WHEN '{s}' THEN share_{s}" for s in SIGNALS) + " END"
_ROW = f"""'| ' || concat_ws(' | ', rank, replace(path, '|', '\\|'), score, tier, CASE trend WHEN 'rising' THEN '↑ rising' WHEN 'stable' THEN '→ stable' ELSE '↓ cooling' END, freq, churn, authors, {_PCT('ownership')}, {_PCT('coupling')}, complexity, coalesce(dominant || ' ' || {_PCT(_OWN)}, '—')) || ' |'"""
# The report's heads, as in sources/report.py.
_HEADS = "| # | File | Score | Tier | Trend | Commits | Churn | Authors | Ownership | Coupling | Complexity | Why |"
_RULE = "| - | ---- | ----: | ---- | ----- | ------: | ----: | ------: | --------: | -------: | ---------: | ---- |"
_ROUNDED = lambda *c: ", ".join(f"round({x}, {R}) AS {x}" for x in c)
_CHURN = f"repo, path, commits, bugfix_commits, lines_added, lines_deleted, n_authors, recent_commits, first_seen, last_seen, minor_contributors, {_ROUNDED('recency_weight', 'top_share', 'fragmentation', 'bugfix_density')}"

SELECTS: dict[str, str] = {
    "s1_log_dump": "SELECT repo, walk_seq, author, subject, is_bugfix, path, added, deleted, count(*) AS n FROM touches GROUP BY ALL",
    "s2_walk_order": "SELECT repo, sha, walk_seq FROM commits",
    "s3_text_contents": "SELECT doc_id, length(text) AS n FROM documents WHERE strlen(text) <= 1500000 AND NOT contains(text, chr(0))",
    "s1_log_lines": "SELECT repo, walk_seq, author, subject, is_bugfix, path, added, deleted FROM touches",
    "s4_changed_paths": "SELECT change_id, repo, path, CAST(3 * pos AS BIGINT) AS pos FROM changes",
    "s5_snapshot": f"SELECT repo, path, commits, bugfix_commits, lines_added, lines_deleted, n_authors, first_seen, last_seen, recent_commits, minor_contributors, {_ROUNDED('recency_weight', 'top_share')} FROM churn_all JOIN minor USING (repo, path) JOIN seen USING (repo, path)",
    "s5_snapshot_pairs": "SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS shared_commits FROM commit_paths a JOIN (SELECT * FROM commit_paths) b ON a.repo = b.repo AND a.walk_seq = b.walk_seq AND a.path < b.path GROUP BY ALL",
    "s5_resumed_scan": "SELECT repo, path, score, rank, tier, sentence FROM explained",
    "s6_json_report": f"SELECT repo, rank, path, score, tier, trend, dominant, core_pct, sentence AS summary, {_ROUNDED('share_freq', 'share_coupling')} FROM explained",
    "s7_markdown_report": f"""SELECT repo, CAST(rank + 6 AS INT) AS line_no, {_ROW} AS line FROM explained UNION ALL SELECT repo, CAST(i AS INT), CASE i WHEN 1 THEN '# Hotspot Risk Report' WHEN 3 THEN n || CASE WHEN n = 1 THEN ' scored file' ELSE ' scored files' END || ', ranked by risk (relative within this repo — not a literal "% buggy").' WHEN 5 THEN '{_HEADS}' WHEN 6 THEN '{_RULE}' ELSE '' END FROM (SELECT repo, count(*) AS n FROM risk GROUP BY repo) g, range(1, 7) r(i) UNION ALL SELECT repo, CAST(count(*) + 7 AS INT), '' FROM risk GROUP BY repo""",
    "p1_since_window": "SELECT repo, walk_seq, sha FROM commits WHERE author_ts >= TIMESTAMP '1998-08-02' - INTERVAL 24 MONTH",
    "p2_without_merges": "SELECT repo, count(*) AS n FROM commits WHERE NOT is_merge GROUP BY repo",
    "p3_rename": r"SELECT CASE row_no % 3 WHEN 0 THEN replace(path, '/', '/sub/') ELSE path END AS path, count(*) AS n FROM touches GROUP BY ALL",
    "p4_repo_key": "SELECT path, count(*) AS n FROM touches GROUP BY path",
    "p5_line_count": "SELECT repo, sum(CASE WHEN row_no % 3 = 0 THEN 0 ELSE added END)::BIGINT AS added FROM touches GROUP BY repo",
    "p6_exclusion": f"SELECT path, count(*) AS n FROM touches WHERE NOT ({EXCLUDED}) GROUP BY path",
    "p7_pair_exclusion": "SELECT repo, path_a, path_b, shared_commits FROM co_change",
    "p8_bugfix": f"SELECT subject, {BUGFIX} AS is_bugfix, count(*) AS n FROM commits GROUP BY ALL",
    "p9_min_severity": f"SELECT repo, path, start_line, severity FROM regions WHERE {_RANK('severity')} >= 1",
    "p10_lookup": "SELECT c.change_id, repo, path, score, rank FROM changes c JOIN risk USING (repo, path)",
    "a1_file_churn": f"SELECT {_CHURN} FROM churn_all JOIN minor USING (repo, path) JOIN seen USING (repo, path)",
    "a2_author_commits": "SELECT repo, path, author, commits FROM file_author",
    "a5_reference_date": "SELECT repo, strftime(ref_ts, '%Y-%m-%d') AS ref_date FROM refs",
    "a10_co_change": "SELECT repo, path_a, path_b, shared_commits FROM co_change",
    "a11_links": f"SELECT repo, path, partner, shared_commits, {_ROUNDED('strength')} FROM links",
    "a12_coupling_signal": f"SELECT repo, path, round(max(strength), {R}) AS coupling FROM links GROUP BY ALL",
    "a13_normalised": f"SELECT repo, path, {_ROUNDED(*(f'norm_{s}' for s in RAW))} FROM norm",
    "a14_complexity": f"SELECT repo, path, total, {_ROUNDED('mean')}, max, lines FROM complexity",
    "a15_folder_tree": f"""SELECT repo, path, parent_path, name, depth, is_file, area, score, {_TIER('score')} AS tier, row_number() OVER (PARTITION BY repo, parent_path ORDER BY area DESC, name, is_file) AS sibling_rank FROM (SELECT repo, array_to_string(s[1:d], '/') AS path, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], '/') END AS parent_path, CASE WHEN d > 0 THEN s[d] ELSE '' END AS name, d AS depth, d = len(s) AS is_file, sum(greatest(churn, 1))::DOUBLE AS area, max(score) AS score FROM (SELECT *, string_split(path, '/') AS s, unnest(range(0, len(string_split(path, '/')) + 1))::INT AS d FROM risk) x GROUP BY ALL) y""",
    "a16_by_severity": "SELECT repo, path, severity, string_agg(start_line || '-' || end_line, ',' ORDER BY region_rank) AS ranges FROM regions GROUP BY ALL",
    "a17_confidence": f"SELECT repo, count(*) AS files, max(score) AS top_score, CASE WHEN count(*) < 5 OR max(score) < 15 THEN '{LOW_CONFIDENCE}' END AS note FROM risk GROUP BY repo",
    "w1_partners": f"SELECT repo, path, partner_rank, partner, shared_commits, {_ROUNDED('strength')} FROM partners",
    "w2_ranking": f"SELECT repo, path, score, tier, trend, rank, {_ROUNDED('core')} FROM risk",
    "w3_regions": f"SELECT repo, path, start_line, end_line, max_depth, line_count, score, severity, {_REASONS} AS reasons, region_rank FROM regions",
    "w3_regions_by_window": f"SELECT repo, path, start_line, end_line, max_depth, line_count, score, severity, {_REASONS} AS reasons, region_rank FROM regions",
    "w6_normalised_by_window": f"SELECT repo, path, {_ROUNDED('norm_churn')} FROM norm",
    "l1_top_files": "SELECT repo, path, score, rank FROM risk WHERE rank <= 20",
    "l1_hotspots": "SELECT repo, path, score, rank FROM risk WHERE rank <= 20",
    "l2_newest_commits": "SELECT repo, count(*) AS n, sum(added)::BIGINT AS added FROM touches WHERE walk_seq <= 50 GROUP BY repo",
    "l3_order": "SELECT repo, path, score FROM risk",
    "j4_changed_with_score": "SELECT change_id, repo, path, score, tier, row_number() OVER (PARTITION BY change_id ORDER BY score DESC, path) AS place FROM set_ JOIN (SELECT repo, path, score, tier FROM risk) r USING (repo, path)",
    "j5_changed_without_history": "SELECT change_id, repo, path FROM set_ ANTI JOIN risk USING (repo, path)",
    "j6_hints": f"SELECT s.change_id, s.repo, s.path, p.partner, shared_commits, round(strength, {R}) AS strength, 'usually changes with ' || s.path || ' (' || CAST(CAST(round(strength * 100) AS INT) AS VARCHAR) || '%, ' || shared_commits || '×) — not in your working set' AS hint FROM set_ s JOIN partners p USING (repo, path) WHERE partner_rank = 1 AND strength >= 0.02::DOUBLE AND NOT EXISTS (SELECT 1 FROM set_ q WHERE q.change_id = s.change_id AND q.repo = s.repo AND lower(q.path) = lower(p.partner))",
    "j7_position": f"SELECT l.repo, l.path, l.line, start_line, end_line, score, severity, {_REASONS} AS reasons FROM (SELECT repo, path, line FROM lines UNION ALL SELECT repo, path, 0 FROM files) l JOIN regions r ON l.repo = r.repo AND l.path = r.path AND l.line BETWEEN start_line AND end_line WHERE {_RANK('severity')} >= 1",
    "j7_regions": f"SELECT repo, path, start_line AS line, '⚠ Risk: ' || severity || ' · depth 0 · ' || line_count || ' lines' AS label FROM regions WHERE {_RANK('severity')} >= 1",
    "j8_change_review": f"SELECT change_id, repo, path, 'scored' AS kind, CAST(score AS VARCHAR) AS what FROM set_ JOIN (SELECT repo, path, score FROM risk) r USING (repo, path) UNION ALL SELECT change_id, repo, path, 'new', NULL FROM set_ ANTI JOIN risk USING (repo, path) UNION ALL SELECT s.change_id, s.repo, s.path, 'hint', p.partner FROM set_ s JOIN partners p USING (repo, path) WHERE partner_rank = 1 AND strength >= 0.02::DOUBLE AND NOT EXISTS (SELECT 1 FROM set_ q WHERE q.change_id = s.change_id AND q.repo = s.repo AND lower(q.path) = lower(p.partner))",
    "c14_names": "SELECT DISTINCT repo, path, string_split(path, '/')[-1] AS name, CAST(len(string_split(path, '/')) AS INT) AS segments FROM touches",
    "u2_working_set": "SELECT change_id, repo, path, CAST(pos + 500 AS BIGINT) AS pos FROM set_ UNION ALL SELECT change_id, repo, 'docs/Second.md', CAST(4294967296 + min(pos) - 5 AS BIGINT) FROM changes GROUP BY ALL",
    "u3_commit_paths": "SELECT repo, walk_seq, path FROM commit_paths",
    "c7_explanation": f"SELECT repo, path, dominant, core_pct, partner, line, sentence, {_ROUNDED(*(f'share_{s}' for s in SIGNALS))} FROM explained",
    "c10_activity": f"SELECT repo, path, concat_ws(' · ', 'Changed ' || freq || '× by ' || authors || CASE WHEN authors = 1 THEN ' author' ELSE ' authors' END, CASE WHEN ownership >= 0.6::DOUBLE THEN 'fragmented ownership' WHEN ownership >= 0.3::DOUBLE THEN 'shared ownership' END, CASE WHEN coupling >= 0.6::DOUBLE THEN 'strongly coupled to other files' WHEN coupling >= 0.3::DOUBLE THEN 'coupled to other files' END, CASE WHEN churn > 0 THEN churn || ' lines churned' END) AS activity, 'commits ' || freq || ' · churn ' || churn || ' · authors ' || authors || ' · ownership ' || {_PCT('ownership')} || ' fragmented · coupling ' || {_PCT('coupling')} || ' · complexity ' || complexity AS signals, CASE tier WHEN 'critical' THEN '!!' WHEN 'high' THEN '!' WHEN 'medium' THEN '·' ELSE '' END AS badge, CASE trend WHEN 'rising' THEN '↑' WHEN 'stable' THEN '→' ELSE '↓' END AS arrow FROM risk",
    "c13_region_texts": "SELECT repo, path, start_line, '⚠ Risk: ' || severity || ' · depth ' || max_depth || ' · ' || line_count || ' lines' AS label, '🔥 **Risky code (' || severity || ')** — ' || concat_ws(', ', CASE WHEN max_depth >= 5 THEN 'deeply nested' ELSE 'nested' END || ' (depth ' || max_depth || ')', CASE WHEN line_count >= 20 THEN 'long block (' || line_count || ' lines)' END) || '.' || chr(10) || chr(10) || '_Change this region carefully._' AS hover FROM regions",
    "c15_partner_labels": f"SELECT repo, path, partner_rank, {_PCT('strength')} || ' · ' || partner AS label, 'co-changed ' || shared_commits || '×' AS detail FROM partners",
}
ORACLES: dict[str, str] = {k: sql(v) for k, v in SELECTS.items()}

#: The scan of a window has the same expressions over the window's touches.
_WINDOW = CTES | {
    "touches": CTES["touches"] + " WHERE m.author_ts >= TIMESTAMP '1998-08-02' - INTERVAL 24 MONTH",
    "refs": "SELECT repo, arg_min(author_ts, walk_seq) AS ref_ts FROM touches WHERE author_ts IS NOT NULL GROUP BY repo",
    "files": CTES["files"] + " WHERE false",
}
ORACLES["p1_scan_window"] = sql("SELECT repo, path, freq, churn, rank, score FROM risk", _WINDOW)
