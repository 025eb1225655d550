"""The three jobs: scan and ranking, change review, and code regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_excluded
from ..operators import churn, code, coupling, explain, history, review, risk
from ..params import Params
from ..sources import snapshot
from ..sources.shared import drop_stored, stored


def churn_of(touches: DataFrame, p: Params = Params(), commits: DataFrame | None = None) -> DataFrame:
    """File churn without excluded paths; the reference date is that of the whole walk."""
    kept = touches.where(~is_excluded(F.col("path"), p.exclude))
    authors = churn.file_author(kept, p.half_life_days, p.recent_days, touches if commits is None else commits)
    return churn.file_churn(authors, p.minor_threshold)


def links_of(touches: DataFrame, files: DataFrame, p: Params = Params()) -> DataFrame:
    return coupling.strengths(coupling.co_change(touches, p.max_files_per_commit, p.exclude), files, p.min_support)


def in_window(touches: DataFrame, p: Params = Params(), commits: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Touches and commits of the history window. Touches without a commit table are filtered by their own dates."""
    if not p.since_months:
        return touches, commits
    if p.as_of is None:
        raise ValueError("a history window needs the date it ends at: Params(as_of=...)")
    end = F.lit(p.as_of).cast("timestamp")
    if commits is None:
        return history.since(touches, p.since_months, end), None
    commits = history.since(commits, p.since_months, end)
    return history.touches_of(touches, commits), commits


def settings_of(p: Params) -> str:
    """What the walk's results depend on, besides the head: part of a snapshot's key."""
    return f"since={p.since_months};as_of={p.as_of if p.since_months else ''};files={p.max_files_per_commit};half_life={p.half_life_days:g};recent={p.recent_days:g}"


def resumed(touches: DataFrame, p: Params, commits: DataFrame | None, path: str, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(churn, pairs, stored tables that they read) of all repos, before exclusion: from snapshots of the repos' heads where there
    are any; the other repos are walked and saved. heads: (repo, head_sha), else the first commits of the walk."""
    heads = stored(history.heads(touches if commits is None else commits) if heads is None else heads, "heads")
    settings = settings_of(p)
    found = stored(snapshot.hits(touches.sparkSession, path, heads, settings), "hits")
    saved, saved_pairs = snapshot.load(touches.sparkSession, path, found)
    missing = lambda df: df if df is None else df.join(found, "repo", "left_anti")
    touches, commits = in_window(missing(touches), p, missing(commits))
    authors = churn.file_author(touches, p.half_life_days, p.recent_days, touches if commits is None else commits)
    walked = stored(churn.file_churn(authors, p.minor_threshold, arrays=True).select("repo", *snapshot.names(snapshot.FIELDS)), "walked")
    pairs = stored(coupling.co_change(touches, p.max_files_per_commit), "pairs")
    snapshot.save(walked, pairs, heads, path, settings)
    drop_stored(heads)
    files = churn.with_ownership(saved.unionByName(walked), p.minor_threshold)
    return files, saved_pairs.unionByName(pairs), [found, walked, pairs]


def scan(touches: DataFrame, contents: DataFrame | None = None, p: Params = Params(), commits: DataFrame | None = None, snapshots: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """The ranked and explained result: one row per file with history.

    snapshots: a folder; repos whose head has a snapshot there are not walked, the others are saved. Paths are excluded when
    snapshots are read, so that other globs need no new walk. Eager: churn and links are stored in the shared folder, so that
    touches are read twice and nothing is derived twice; the result is a stored table too, and all others are deleted.
    Of the contents only six numbers for each file leave their tasks.
    """
    if snapshots is None:
        touches, commits = in_window(touches, p, commits)
        used = [files := stored(churn_of(touches, p, commits), "churn")]
        pairs = coupling.co_change(touches, p.max_files_per_commit, p.exclude)
    else:
        files, pairs, used = resumed(touches, p, commits, snapshots, heads)
        used.append(files := stored(files.where(~is_excluded(F.col("path"), p.exclude)), "churn"))
        pairs = pairs.where(~is_excluded(F.col("path_a"), p.exclude) & ~is_excluded(F.col("path_b"), p.exclude))
    used.append(links := stored(coupling.strengths(pairs, files, p.min_support), "links"))
    cx = None if contents is None else code.complexity(contents, p.spaces_per_indent)
    used.append(raw := stored(risk.signals(files, cx, coupling.coupling_signal(links)), "signals"))
    used.append(out := risk.ranked(risk.scored(risk.normalised(raw), p.weights, p.thresholds)))
    result = stored(explain.explained(out, coupling.partners(links, p.top_k), p.weights) if p.explain else out, "ranking")
    drop_stored(*used)
    return result


def hotspots(ranking: DataFrame, p: Params = Params()) -> DataFrame:
    """The first top_n files of each repo."""
    return ranking.where(F.col("rank") <= max(1, p.top_n))


def change_review(changes: DataFrame, ranking: DataFrame, partners: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, without history, hints) of all change sets at once."""
    changed = review.working_set(changes)
    return review.with_score(changed, ranking), review.without_history(changed, ranking), review.hints(changed, partners, p.hint_floor)


def code_regions(contents: DataFrame, p: Params = Params()) -> DataFrame:
    return code.at_least(code.regions(contents, p.spaces_per_indent, p.min_depth, p.min_lines), p.min_severity)
