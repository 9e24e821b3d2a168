"""URL allow and block rules: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, ALLOW = "block", "allow"
#: (host, path, verdict)
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
#: Verdict for urls that no rule fits.
DEFAULT = ALLOW
#: A trie is broadcast up to this many rules; larger rule sets go through ``judge_by_join``.
MAX_BROADCAST_RULES = 200_000
#: Keys that the pages of one host are dealt to where they meet its rules.
SALTS = 16
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts are the same in any case of A-Z, in urls and in rules.
LOWER = str.maketrans(UPPER_CASE, LOWER_CASE)


class Trie:
    """Nodes are dicts of children by label, first reversed host labels, then path segments.

    A rule ends at the node of its last full segment, and holds the rest of its path as a prefix of the next one.
    """

    def __init__(self, rules):
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the path trie of this host
            *full, rest = path.split("/")
            for segment in full:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((rest, host + path, verdict))

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest rule that fits: most host labels, then longest path; block before allow on a tie. An empty host fits none."""
        node, best = self.hosts if host else {}, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path.split("/")) or best
        return best

    @staticmethod
    def _path(node, segments):
        best = None
        for segment in segments:
            fits = [(len(rest), verdict == BLOCK, rule, verdict) for rest, rule, verdict in node.get(None, ()) if segment.startswith(rest)]
            if fits:
                best = max(fits)[2:]
            node = node.get(segment)
            if node is None:
                break
        return best


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or a text without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER_CASE, LOWER_CASE)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(urls: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``urls`` with host, path, rule and verdict columns (replacing any of those names but ``url``'s own).

    Null, empty or relative urls have an empty host and path, fit no rule and get ``default``. Rows stay as they
    are, repeated or not; an empty table gives no rows. Hosts of rules are taken in any case. Equal rules that disagree:
    block wins. Up to ``max_broadcast`` rules go through the trie, more through ``judge_by_join``; both give the same.
    """
    names = ("host", "path", "rule", "verdict")
    if url in names:
        raise ValueError(f"the url column must not be named {url!r}")
    host, path = host_path(F.col(url))
    parts = urls.drop(*names).withColumns({"host": host, "path": path})
    if len(rules) > max_broadcast:
        return judge_by_join(parts, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(hosts, paths)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return parts.withColumn("_found", look("host", "path")).withColumns({"rule": F.col("_found.rule"), "verdict": F.col("_found.verdict")}).drop("_found")


def judge_by_join(parts: DataFrame, rules, default: str = DEFAULT, salts: int = SALTS) -> DataFrame:
    """The same verdicts for rule sets too large to broadcast: nodes of the trie as keys of a shuffled join.

    A rule stands at its host and the full segments of its path; a pair (host, path) asks at every suffix of its host and
    every run of its first segments, as deep as rules go. Hosts that many pages share are salted. ``parts`` has host and
    path; empty hosts fit no rule.
    """
    node = lambda path: path[: path.rfind("/") + 1]
    stated = [(host.translate(LOWER), node(path), path, host + path, verdict) for host, path, verdict in rules]
    listed = parts.sparkSession.createDataFrame(stated, "rule_host string, rule_node string, rule_path string, rule string, verdict string")
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    labels_deep = max((len(h.split(".")) for h, *_ in stated), default=1)
    nodes_deep = max((n.count("/") for _, n, *_ in stated), default=0)
    pairs = parts.where("host <> ''").select("host", "path").distinct()
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, labels_deep)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i)), "."))
    # all but the last piece of a path's first pieces are full segments
    pieces = F.slice(F.split("path", "/"), 1, nodes_deep + 1)
    nodes = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/"))))
    asked = pairs.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).withColumn("rule_host", F.explode(suffixes)).withColumn("rule_node", F.explode(nodes))
    fits = asked.join(listed, ["rule_host", "rule_node", "salt"]).where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), F.col("verdict") == BLOCK, "rule")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
    return parts.join(best, ["host", "path"], "left").select(*[f"`{c}`" for c in parts.columns], F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, pre, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, h || pre AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, length(pre) DESC, v DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""
