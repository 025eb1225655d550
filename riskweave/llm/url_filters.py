"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table, at most MAX_TRAIN rows: an argument, or by default the
file labelled_urls.tsv beside this module (196 addresses written down from general knowledge: half well-known or typical
sites of adult content, betting, pharmacy spam, advertising and tracking, piracy and fraud, half of news, science,
government, reference and hobbies) with some 2,500 that composed() makes from words of both kinds. It scores any number of pages in one narrow Arrow pass.

Defined cases: a null url, or one without '://', has an empty host and path, fits no rule and is allowed by the model's
bias alone; very long urls are read whole. Ties between rules of one length go to the longer host, then to the earlier
rule. Repeated rows stay; an empty table gives no rows. Columns of the input named host, path, rule, block_score or
verdict are replaced; others pass through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import add_columns, table

#: The rules of the production query, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

LABELLED_URLS = Path(__file__).with_name("labelled_urls.tsv")
MAX_TRAIN = 10_000
ENDINGS = ("com", "net", "org")
DIMS = 1 << 14


def read_labelled(path: str | Path = LABELLED_URLS) -> list[tuple[str, int]]:
    """(url, label) of a file of lines `label TAB url`; lines that start with # are comments."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return [(url, int(label)) for line in lines if line and not line.startswith("#") for label, url in [line.split("\t", 1)]]


# Words of unwanted and of wanted addresses, and of either; written down from general knowledge.
UNWANTED = "sex porn xxx nude naked cams milf escort hentai erotic fetish adult hookup swinger lust hardcore casino poker slots betting bookie jackpot roulette bingo lottery spins wager blackjack viagra cialis pills pharmacy meds steroid slimming botox torrent warez crack keygen serial nulled pirate rip adserver adclick banner popunder tracker pixel clicks sponsor affiliate telemetry beacon bonus prize winner giveaway cash loan payday doubler forex rich replica counterfeit fakeid verify unlock airdrop backlinks followers spyware cheat hack".split()
WANTED = "news times daily herald journal tribune gazette science physics biology chemistry algebra astronomy history museum library archive university college school academy institute research faculty health clinic hospital nursing ministry council parliament court weather climate forecast atlas travel hiking garden cooking recipes kitchen bakery music orchestra theatre film gallery photography books poetry literature review grammar dictionary encyclopedia wiki reference docs developer software linux python forum community football cycling chess knitting birds nature forest river insurance energy rail transport airport furniture bicycle charity".split()
EITHER = "my the best online free top world net web live zone hub club city info page home store now".split()
SHAPES = ("{a}{b}", "{a}-{b}", "{e}{a}", "{a}{e}", "{e}-{a}-{b}", "{b}.{a}", "{a}{n}", "{a}{b}{e}")


def composed(each: int = 16) -> list[tuple[str, int]]:
    """Labelled addresses by a rule: each word with `each` others of its kind, in all shapes, with and without a path."""
    rows = []
    for y, words in ((1, UNWANTED), (0, WANTED)):
        for i, a in enumerate(words):
            for j in range(each):
                h = zlib.crc32(f"{a}{j}".encode())
                b, e = words[(i + 1 + h % (len(words) - 1)) % len(words)], EITHER[h // 97 % len(EITHER)]
                host = SHAPES[j % len(SHAPES)].format(a=a, b=b, e=e, n=h % 90 + 10)
                path = ("/", f"/{b}", f"/{a}/{h % 1000}", f"/{e}/{b}.html")[h // 7 % 4]
                rows.append((f"https://{('www.', '')[h % 2]}{host}.{ENDINGS[h // 3 % 3]}{path}", y))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    parsed = sorted(((v, r, *r.partition("/")[::2]) for v, r in rules), key=lambda x: (-len(x[1]), -len(x[2])))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r, h, p in reversed(parsed):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, dims: int = DIMS) -> np.ndarray:
    """Sorted distinct buckets of the 3- to 5-grams of the host and the path."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in (3, 4, 5):
            out.update(zlib.crc32(f"{mark}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % dims for i in range(len(s) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest) if mark else None
    if not m:
        return "", ""
    return m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]


def variants(url: str) -> list[str]:
    """The address with and without www., under common endings and without its path, so that none of these tells the labels apart."""
    host, path = split_url(url)
    bare, ending = host.removeprefix("www.").rsplit(".", 1) if "." in host else (host, "")
    return sorted({f"x://{w}{bare}.{e}{p}" for w in ("", "www.") for e in (ending, *ENDINGS) for p in (path, "/")})


def fit(labelled=None, dims: int = DIMS, steps: int = 600, rate: float = 20.0, l2: float = 1e-5, prior: float = 0.1, more=None) -> np.ndarray:
    """Weights (dims, then the bias) by full gradient steps. labelled: (url, 0 or 1) pairs, of which all variants are learned;
    more: such pairs learned as they are; MAX_TRAIN of both at most. By default the file's addresses, and the composed ones.

    Both labels weigh the same. The bias stays at the log-odds of `prior`, the share of unwanted pages among all; the
    table's own share is not it.
    """
    more = composed() if labelled is None and more is None else list(more or ())
    labelled = read_labelled() if labelled is None else list(labelled)
    if len(labelled) + len(more) > MAX_TRAIN:
        raise ValueError(f"the labelled URL table is limited to {MAX_TRAIN} rows")
    labelled = [(v, y) for u, y in labelled for v in variants(u)] + more
    rows = [features(*split_url(u), dims) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    x = np.concatenate([np.full(len(r), 1 / np.sqrt(max(1, len(r)))) for r in rows]) if rows else np.zeros(0)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        z = np.bincount(at, x * w[col], len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) * weight
        w -= rate * (np.bincount(col, x * g[at], dims) + l2 * w)
    return np.append(w, b)


def score(df: DataFrame, weights: np.ndarray, host: str = "host", path: str = "path") -> DataFrame:
    """Adds block_score, the chance that the page is unwanted."""

    def run(hosts, paths):
        out = []
        for h, p in zip(hosts, paths, strict=True):
            f = features(h or "", p or "", len(weights) - 1)
            z = weights[f].sum() / np.sqrt(max(1, len(f))) + weights[-1]
            out.append(float(1 / (1 + np.exp(-z))))
        return [out]

    return add_columns(df, [host, path], [T.StructField("block_score", T.DoubleType())], run)


def judge(pages: DataFrame, weights: np.ndarray, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, block_score and verdict."""
    host, path = host_and_path(F.col(url))
    df = score(pages.withColumns({"host": host, "path": path}), weights)
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "verdict": F.coalesce(says, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))})


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, fit()).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))
