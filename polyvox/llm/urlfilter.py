"""URL filters: a trie over reversed host labels, then path segments, then the characters of a rule's last, open segment.

Rules are (verdict, host, path). A rule fits its host and every subdomain when
the url's path starts with the rule's path; of several that fit, the longest
wins: more host labels first, then the longer path. The rules are configuration,
not data: they are broadcast, and their size is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fixed rules of query op9.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Largest rule set, in characters of hosts and paths, that is shipped with every task.
MAX_RULE_CHARS = 64_000_000

Edge = tuple[int, str]
#: Kinds of edges: a host label, the step from a host to its paths, a whole path segment, a character of an open one.
_LABEL, _PATH, _SEGMENT, _CHAR = range(4)


class Trie:
    """Nodes are numbers and edges one flat table, so that deep rules neither nest nor recurse when the trie is sent to tasks.

    A host's labels lead from the right to the node of the host. Its paths begin one step below: whole segments first, then the text after the last
    slash of a rule's path character by character, for a rule may end within a segment. Where two rules
    have the same host and path, the later one replaces the earlier one.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple[int, int, str], int] = {}
        self.ends: dict[int, tuple[str, str]] = {}
        self.nodes = 1
        chars = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"not a verdict: {verdict!r}")
            chars += len(host) + len(path)
            if chars > MAX_RULE_CHARS:
                raise ValueError(f"the rules exceed {MAX_RULE_CHARS} characters")
            *whole, last = path.split("/")
            host = host.lower()
            way = [*((_LABEL, x) for x in reversed(host.split("."))), (_PATH, ""), *((_SEGMENT, x) for x in whole), *((_CHAR, x) for x in last)]
            self.ends[self._node(way)] = (host + path, verdict)

    def _node(self, way: Iterable[Edge]) -> int:
        node = 0
        for kind, name in way:
            below = self.edges.setdefault((node, kind, name), self.nodes)
            self.nodes += below == self.nodes
            node = below
        return node

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None: more host labels first, then the longer path."""
        found, node = None, 0
        for label in reversed(host.split(".")):
            node = self.edges.get((node, _LABEL, label))
            if node is None:
                break
            paths = self.edges.get((node, _PATH, ""))
            if paths is not None:
                found = self._longest_path(paths, path) or found  # a longer host beats any path of a shorter one
        return found

    def _longest_path(self, node: int, path: str) -> tuple[str, str] | None:
        found, start = None, 0
        while True:
            stop = path.find("/", start)
            segment = path[start : stop if stop >= 0 else len(path)]
            at = node
            found = self.ends.get(at, found)
            for char in segment:
                at = self.edges.get((at, _CHAR, char))
                if at is None:
                    break
                found = self.ends.get(at, found)
            node = self.edges.get((node, _SEGMENT, segment)) if stop >= 0 else None
            if node is None:
                return found
            start = stop + 1


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, tail = rest.partition("/")
    return host.encode().lower().decode(), slash + tail


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    One row comes out for each that goes in, repeated rows and null ids
    included. A url that is null or without '://' has an empty host and path,
    fits no rule and gets `default`, as does every url that no rule fits. An
    empty table gives an empty result; other columns of pages are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = trie.value.longest
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = longest(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
