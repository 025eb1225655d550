"""Queries over the shared tables, one or more for each operator; oracles.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import testdata as td
from .functions import code as fc
from .functions import commits as fm
from .functions import paths as fp
from .functions import text as ft
from .operators import churn, code, coupling, history, review, risk, tree
from .params import SIGNALS, Params
from .plans import scan
from .sources import report, snapshot, tables
from .sources.shared import drop_stored, new_folder, stored

P = Params()
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def churn_of(spark, sf, touches=None):
    return scan.churn_of(td.touches(spark, sf) if touches is None else touches, P, td.commits(spark, sf))


def history_of(spark, sf):
    """Churn and links, stored: touches are derived once and read twice."""
    t = stored(td.touches(spark, sf), "touches")
    files = stored(churn_of(spark, sf, t), "churn")
    links = stored(scan.links_of(t, files, P), "links")
    drop_stored(t)
    return files, links


def links_of(spark, sf):
    files, links = history_of(spark, sf)
    drop_stored(files)
    return links


def partners_of(spark, sf):
    return coupling.partners(links_of(spark, sf), P.top_k)


def norm_of(spark, sf, history=None):
    files, links = history or history_of(spark, sf)
    raw = stored(risk.signals(files, code.complexity(td.files(spark, sf)), coupling.coupling_signal(links)), "signals")
    if history is None:
        drop_stored(files, links)
    return risk.normalised(raw)


def risk_of(spark, sf, p=Params(explain=False)):
    """The scan of the shared tables; their touches are stored first, as they are joins."""
    t = stored(td.touches(spark, sf), "touches")
    out = scan.scan(t, td.files(spark, sf), p, td.commits(spark, sf))
    drop_stored(t)
    return out


def explained_of(spark, sf):
    return risk_of(spark, sf, P)


def regions_of(spark, sf):
    return code.regions(td.files(spark, sf))


def with_reasons(regions):
    return regions.withColumn("reasons", F.array_join("reasons", ", "))


def set_of(spark, sf):
    return review.working_set(td.changes(spark, sf))


@query
def s1_log_dump(spark, sf):
    """Dumps of 500 commits each, made from the touches and parsed again as whole texts."""
    t = td.touches(spark, sf)
    row = F.format_string("%d\t%d\t%s", "added", "deleted", "path")
    one = t.groupBy("repo", "walk_seq", "sha", "author", "author_date", "subject").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    text = F.concat_ws("\n", F.concat_ws("\0", F.col("sha").cast("string"), "author", "author_date", "subject"), F.lit(""), "rows", F.lit(""))
    per = one.groupBy("repo", F.floor((F.col("walk_seq") - 1) / 500).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("walk_seq", text.alias("t")))).alias("c"))
    # commits without lines are not in the dump: the walk number comes from the first field
    parsed = history.parse_log(per.select("repo", "segment", F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("value")), segment="segment")
    walk = td.commits(spark, sf).select(F.col("sha").cast("string").alias("sha"), F.col("walk_seq").alias("w"))
    return parsed.join(walk, "sha").groupBy("repo", F.col("w").alias("walk_seq"), "author", "subject", "is_bugfix", "path", "added", "deleted").agg(F.count(F.lit(1)).alias("n"))


@query
def s1_log_lines(spark, sf):
    """Dumps of 5000 commits in blocks of 1000 lines, which cut commits anywhere, parsed line by line."""
    t = td.touches(spark, sf)
    c = t.groupBy("repo", "walk_seq", "sha", "author", "author_date", "subject").agg(F.array_sort(F.collect_list(F.struct("row_no", F.format_string("%d\t%d\t%s", "added", "deleted", "path").alias("t")))).alias("r"))
    head = F.concat_ws("\0", F.col("sha").cast("string"), "author", "author_date", "subject")
    lines = c.select("repo", "walk_seq", F.posexplode(F.concat(F.array(head, F.lit("")), F.transform("r", lambda x: x["t"]), F.array(F.lit("")))).alias("i", "value"))
    dump = F.floor((F.col("walk_seq") - 1) / 5000)
    order = W.partitionBy("repo", "segment").orderBy("walk_seq", "i")
    lines = lines.withColumn("segment", dump).withColumn("at", F.row_number().over(order)).withColumn("block", F.floor(F.col("at") / 1000))
    parsed = history.parse_log_lines(lines)
    walk = td.commits(spark, sf).select(F.col("sha").cast("string").alias("sha"), F.col("walk_seq").alias("w"))
    return parsed.join(walk, "sha").select("repo", F.col("w").alias("walk_seq"), "author", "subject", "is_bugfix", "path", "added", "deleted")


@query
def s2_walk_order(spark, sf):
    return history.with_walk_order(td.commits(spark, sf).drop("walk_seq")).select("repo", "sha", "walk_seq")


@query
def s3_text_contents(spark, sf):
    d = td.table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return tables.text_contents(d).select("doc_id", F.char_length("content").alias("n"))


@query
def s4_changed_paths(spark, sf):
    """Each path written twice in other ways, and blank lines between; the first place counts."""
    c = td.changes(spark, sf).select("change_id", "repo", "pos", F.posexplode(F.array(F.concat(F.lit("  ./"), "path"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit(" "))).alias("i", "value"))
    return tables.changed_paths(c.withColumn("pos", 3 * F.col("pos") + F.col("i")))


SAVED_FIRST = ("BUILDING", "MACHINERY")


def snapshot_of(spark, sf):
    path, t, c = new_folder(spark, "snapshots"), stored(td.touches(spark, sf), "touches"), td.commits(spark, sf)
    some = F.col("repo").isin(*SAVED_FIRST)
    for touches, commits in ((t.where(some), c.where(some)), (t, c)):
        drop_stored(*scan.resumed(touches, P, commits, path)[2])
    drop_stored(t)
    return snapshot.load(spark, path, snapshot.hits(spark, path, history.heads(c), scan.settings_of(P)))


@query
def s5_snapshot(spark, sf):
    """Churn of all repos as a snapshot has it, excluded paths too: two repos saved first, the others by a resumed walk."""
    df = churn.with_ownership(snapshot_of(spark, sf)[0])
    return rounded(df.select("repo", "path", "commits", "bugfix_commits", "lines_added", "lines_deleted", "n_authors", "first_seen", "last_seen", "recent_commits", "recency_weight", "top_share", "minor_contributors"), "recency_weight", "top_share")


@query
def s5_snapshot_pairs(spark, sf):
    """Co-change of all repos as a snapshot has it."""
    return snapshot_of(spark, sf)[1]


@query
def s5_resumed_scan(spark, sf):
    """The whole scan, of which two repos' histories come from a snapshot."""
    path, t, c = new_folder(spark, "snapshots"), stored(td.touches(spark, sf), "touches"), td.commits(spark, sf)
    some = F.col("repo").isin(*SAVED_FIRST)
    drop_stored(*scan.resumed(t.where(some), P, c.where(some), path)[2])
    out = scan.scan(t, td.files(spark, sf), P, c, path).select("repo", "path", "score", "rank", "tier", "sentence")
    drop_stored(t)
    return out


@query
def s6_json_report(spark, sf):
    path = new_folder(spark, "report")
    snapshot.write_json(explained_of(spark, sf), path)
    schema = "repo string, rank int, path string, score int, tier string, trend string, explanation struct<shares:struct<freq:double,coupling:double>,dominant:string,corePct:int,summary:string>"
    df = spark.read.schema(schema).json(path).withColumns({"dominant": F.col("explanation.dominant"), "core_pct": F.col("explanation.corePct"), "summary": F.col("explanation.summary"), "share_freq": F.col("explanation.shares.freq"), "share_coupling": F.col("explanation.shares.coupling")})
    return rounded(df.drop("explanation"), "share_freq", "share_coupling")


@query
def s7_markdown_report(spark, sf):
    return report.markdown(explained_of(spark, sf))


@query
def p1_since_window(spark, sf):
    return history.since(td.commits(spark, sf), 24, F.lit("1998-08-02").cast("timestamp")).select("repo", "walk_seq", "sha")


@query
def p2_without_merges(spark, sf):
    return history.without_merges(td.commits(spark, sf)).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query
def p3_rename(spark, sf):
    """Paths written as renames: in braces with an empty old or new side, and whole."""
    kind, first, rest = F.col("row_no") % 3, F.substring_index("path", "/", 1), F.regexp_replace("path", "^[^/]*/", "")
    written = F.when(kind == 0, F.replace("path", F.lit("/"), F.lit("/{ => sub}/"))).when(kind == 1, F.concat(first, F.lit("/{old => }/"), rest)).otherwise(F.concat(F.lit("old/x.ts => "), F.col("path")))
    return td.touches(spark, sf).select(fp.resolve_rename(written).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query
def p4_repo_key(spark, sf):
    written = F.when(F.col("row_no") % 2 == 0, F.concat(F.lit(".\\"), F.replace("path", F.lit("/"), F.lit("\\")))).otherwise(F.col("path"))
    return td.touches(spark, sf).select(fp.repo_key(written).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query
def p5_line_count(spark, sf):
    written = F.when(F.col("row_no") % 3 == 0, F.lit("-")).otherwise(F.col("added").cast("string"))
    return td.touches(spark, sf).groupBy("repo").agg(F.sum(fm.line_count(written)).alias("added"))


@query
def p6_exclusion(spark, sf):
    return td.touches(spark, sf).where(~fp.is_excluded(F.col("path"), P.exclude)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query
def p7_pair_exclusion(spark, sf):
    """The limit counts excluded files, too; then pairs with an excluded end go."""
    pairs = coupling.co_change(td.touches(spark, sf), P.max_files_per_commit)
    return pairs.where(~fp.is_excluded(F.col("path_a"), P.exclude) & ~fp.is_excluded(F.col("path_b"), P.exclude))


@query
def p8_bugfix(spark, sf):
    return td.commits(spark, sf).groupBy("subject", fm.is_bugfix(F.col("subject")).alias("is_bugfix")).agg(F.count(F.lit(1)).alias("n"))


@query
def p9_min_severity(spark, sf):
    return code.at_least(regions_of(spark, sf), "medium").select("repo", "path", "start_line", "severity")


@query
def p10_lookup(spark, sf):
    keys = td.changes(spark, sf).select("change_id", "repo", F.concat(F.lit("./"), "path").alias("path"))
    return risk.lookup(keys, risk_of(spark, sf).select("repo", "path", "score", "rank")).select("change_id", "repo", "path", "score", "rank")


@query
def a1_file_churn(spark, sf):
    f = churn.file_churn(churn.file_author(td.touches(spark, sf), commits=td.commits(spark, sf)))
    own = ("recency_weight", "top_share", "fragmentation", "bugfix_density")
    return rounded(f.select("repo", "path", "commits", "bugfix_commits", "lines_added", "lines_deleted", "n_authors", "recent_commits", "first_seen", "last_seen", "minor_contributors", *own), *own)


@query
def a2_author_commits(spark, sf):
    return churn.file_author(td.touches(spark, sf)).where("coalesce(author, '') <> ''").select("repo", "path", "author", "commits")


@query
def a5_reference_date(spark, sf):
    return history.reference_dates(td.commits(spark, sf)).select("repo", F.date_format("ref_ts", "yyyy-MM-dd").alias("ref_date"))


@query
def a10_co_change(spark, sf):
    return coupling.co_change(td.touches(spark, sf), P.max_files_per_commit, P.exclude)


@query
def a11_links(spark, sf):
    return rounded(links_of(spark, sf), "strength")


@query
def a12_coupling_signal(spark, sf):
    return rounded(coupling.coupling_signal(links_of(spark, sf)), "coupling")


@query
def a13_normalised(spark, sf):
    names = [f"norm_{s}" for s in risk.RAW]
    return rounded(norm_of(spark, sf).select("repo", "path", *names), *names)


@query
def a14_complexity(spark, sf):
    return rounded(code.complexity(td.files(spark, sf)), "mean")


@query
def a15_folder_tree(spark, sf):
    return tree.folder_tree(risk_of(spark, sf))


@query
def a16_by_severity(spark, sf):
    spell = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"].cast("string"), r["end_line"].cast("string"))), ",")
    return code.by_severity(regions_of(spark, sf)).withColumn("ranges", spell)


@query
def a17_confidence(spark, sf):
    return risk.confidence(risk_of(spark, sf))


@query
def w1_partners(spark, sf):
    return rounded(partners_of(spark, sf), "strength")


@query
def w2_ranking(spark, sf):
    return rounded(risk_of(spark, sf).select("repo", "path", "score", "tier", "trend", "rank", "core"), "core")


@query
def w3_regions(spark, sf):
    return with_reasons(regions_of(spark, sf))


@query
def w3_regions_by_window(spark, sf):
    return with_reasons(code.regions_by_window(td.files(spark, sf)))


@query
def w6_normalised_by_window(spark, sf):
    return rounded(risk.normalised_by_window(risk.signals(churn_of(spark, sf)), "churn").select("repo", "path", "norm_churn"), "norm_churn")


@query
def l1_top_files(spark, sf):
    return risk.top(risk_of(spark, sf).drop("rank"), P.top_n).select("repo", "path", "score", "rank")


@query
def l1_hotspots(spark, sf):
    """The job of the top list: the ranking's first files."""
    return scan.hotspots(risk_of(spark, sf), P).select("repo", "path", "score", "rank")


@query
def l2_newest_commits(spark, sf):
    kept = history.touches_of(td.touches(spark, sf), history.newest(td.commits(spark, sf), 50))
    return kept.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("added"))


@query
def l3_order(spark, sf):
    return risk.in_order(risk_of(spark, sf)).select("repo", "path", "score")


@query
def j4_changed_with_score(spark, sf):
    return review.with_score(set_of(spark, sf), risk_of(spark, sf))


@query
def j5_changed_without_history(spark, sf):
    return review.without_history(set_of(spark, sf), risk_of(spark, sf))


@query
def j6_hints(spark, sf):
    h = review.hints(set_of(spark, sf), partners_of(spark, sf), 0.02)
    return rounded(h.withColumn("hint", ft.hint_text(F.col("path"), F.col("strength"), F.col("shared_commits"))), "strength")


@query
def j7_position(spark, sf):
    """Every line of every file is looked up, the first of each file twice."""
    lines = F.concat(F.array(F.lit(0)), F.sequence(F.lit(0), F.size(F.split("content", "\n")) - 1))
    at = td.files(spark, sf).select("repo", "path", F.explode(lines).alias("line"))
    return with_reasons(code.at_position(at, regions_of(spark, sf)))


@query
def j7_regions(spark, sf):
    """The job of an editor: regions from the wanted severity on, found and labelled at their first lines."""
    found = scan.code_regions(td.files(spark, sf), P)
    return code.at_position(found.select("repo", "path", F.col("start_line").alias("line")), found, P.min_severity).select("repo", "path", "line", fc.region_label(F.col("severity"), F.lit(0), F.col("end_line") - F.col("start_line") + 1).alias("label"))


@query
def j8_change_review(spark, sf):
    """All change sets at once: scored files, those without history and hints, one row for each."""
    files, links = history_of(spark, sf)
    raw = stored(risk.signals(files, code.complexity(td.files(spark, sf)), coupling.coupling_signal(links)), "signals")
    ranking, partners = risk.ranked(risk.scored(risk.normalised(raw))), stored(coupling.partners(links, P.top_k), "partners")
    drop_stored(files, links, raw)
    scored, unknown, hints = scan.change_review(td.changes(spark, sf), ranking, partners, Params(hint_floor=0.02))
    kinds = (scored.select("change_id", "repo", "path", F.lit("scored").alias("kind"), F.col("score").cast("string").alias("what")), unknown.select("change_id", "repo", "path", F.lit("new").alias("kind"), F.lit(None).cast("string").alias("what")), hints.select("change_id", "repo", "path", F.lit("hint").alias("kind"), F.col("partner").alias("what")))
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query
def p1_scan_window(spark, sf):
    """The scan of the last 24 months, from touches alone: the window goes by the touches' own dates."""
    p = Params(since_months=24, as_of="1998-08-02", explain=False)
    return scan.scan(td.touches(spark, sf), None, p).select("repo", "path", "freq", "churn", "rank", "score")


@query
def c14_names(spark, sf):
    """Base name and folder depth of every touched path."""
    paths = td.touches(spark, sf).select("repo", "path").distinct()
    return paths.select("repo", "path", fp.base_name(F.col("path")).alias("name"), F.size(fp.segments(F.col("path"))).alias("segments"))


@query
def u2_working_set(spark, sf):
    """Two lists: the second has other spellings at smaller places, and a file of its own."""
    first = td.changes(spark, sf)
    second = first.select("change_id", "repo", F.explode(F.array(F.upper("path"), F.lit("docs/Second.md"))).alias("path"), (F.col("pos") - 5).alias("pos"))
    return review.working_set(review.all_changes(first.withColumn("pos", F.col("pos") + 500), second)).select("change_id", "repo", "path", "pos")


@query
def u3_commit_paths(spark, sf):
    return coupling.commit_paths(td.touches(spark, sf), P.max_files_per_commit)


@query
def c7_explanation(spark, sf):
    e = explained_of(spark, sf)
    names = [f"share_{s}" for s in SIGNALS]
    return rounded(e.withColumns({f"share_{s}": F.col(f"shares.{s}") for s in SIGNALS}).select("repo", "path", "dominant", "core_pct", "partner", "line", "sentence", *names), *names)


@query
def c10_activity(spark, sf):
    col = F.col
    text = ft.activity(col("freq"), col("authors"), col("ownership"), col("coupling"), col("churn"))
    line = ft.signal_line(col("freq"), col("churn"), col("authors"), col("ownership"), col("coupling"), col("complexity").cast("bigint"))
    return risk_of(spark, sf).select("repo", "path", text.alias("activity"), line.alias("signals"), ft.tier_badge(col("tier")).alias("badge"), ft.trend_arrow(col("trend")).alias("arrow"))


@query
def c13_region_texts(spark, sf):
    r = regions_of(spark, sf)
    return r.select("repo", "path", "start_line", fc.region_label(F.col("severity"), F.col("max_depth"), F.col("line_count")).alias("label"), fc.region_hover(F.col("severity"), F.col("reasons")).alias("hover"))


@query
def c15_partner_labels(spark, sf):
    return partners_of(spark, sf).select("repo", "path", "partner_rank", ft.partner_label(F.col("strength"), F.col("partner")).alias("label"), F.concat(F.lit("co-changed "), F.col("shared_commits").cast("string"), F.lit("×")).alias("detail"))
