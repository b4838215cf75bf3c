"""Operator 13, HTML extraction by consensus host paths.

First pass: the containers of each page are scored, and the page votes for the path of the best one
(tags and classes from the root, numbers in them made alike). Spark adds the votes of a host up, from partial
counts of each batch; paths with a twentieth of a host's votes win, so a host has twenty at most. Second pass: the
winners of its host come to each page, and the text of the containers that lie on the winning path is
the page's. A page that no winning path of its host fits gives the text of its own best container.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, release, table
from tessera.llm.containers import Page, parse
from tessera.llm.terms import attached
from tessera.runtime import ship

#: A path wins if this share of its host's votes is for it.
SHARE = 0.05
_ROWS = 128


def with_host(pages: DataFrame) -> DataFrame:
    """Adds host: that of the url, lower-case, without user and port; null for a url without one."""
    found = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return pages.withColumn("host", F.when(found != "", found))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes of pages (html, host): one vote of each page with prose for its best container's path."""
    ship(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[str, str]] = Counter()
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = parse(html or "")
                    scores = page.scores()
                    best = page.best(scores)
                    if best is not None and scores[best] > 0:
                        found[host, page.path(best)] += 1
            release()
            hosts, paths = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(found.values()), pa.int64())], names=["host", "path", "votes"])

    partial = pages.where(F.col("host").isNotNull()).select("host", "html").mapInArrow(run, "host string, path string, votes long")
    return partial.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(found: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths: those with `share` of a host's votes at least, most votes first, then by path."""
    totals = found.groupBy("host").agg(F.sum("votes").alias("total"))
    won = found.join(totals, "host").where(F.col("votes") >= F.col("total") * share)
    order = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return won.groupBy("host").agg(order.getField("path").alias("paths"))


def chosen(page: Page, paths: Sequence[str]) -> list[int]:
    """The containers whose text is the page's: those on the path with most votes that has text here,
    or on a longer winning path below it that holds nine tenths of its worth; else the page's own best."""
    scores = page.scores()
    steps: dict[tuple[int, str], int] = {}
    ends: dict[int, int] = {}
    for k, path in enumerate(paths):
        state = 0
        for label in path.split(">") if path else ():
            state = steps.setdefault((state, label), len(steps) + 1)
        ends.setdefault(state, k)
    states: list[int | None] = [0]
    on: dict[int, list[int]] = {0: [0]} if 0 in ends and scores[0] is not None else {}
    for node in range(1, len(scores)):
        above = states[page.parent[node]]
        state = None if above is None else steps.get((above, page.label[node]))
        states.append(state)
        if state in ends and state is not None and scores[node] is not None:
            on.setdefault(state, []).append(node)
    worth = {ends[s]: (sum(scores[v] for v in nodes), nodes) for s, nodes in on.items()}
    usable = [k for k in sorted(worth) if worth[k][0] > 0]
    if not usable:
        best = page.best(scores)
        return [] if best is None else [best]
    at = usable[0]
    for k in sorted(usable, key=lambda k: len(paths[k])):
        if paths[k].startswith(paths[at] + ">") and worth[k][0] >= 0.9 * worth[at][0]:
            at = k
    return _without_links(page, worth[at][1])


def _without_links(page: Page, nodes: list[int]) -> list[int]:
    """Of several containers on one path those whose text isn't for the greater part links."""
    if len(nodes) < 2:
        return nodes
    of, wanted = [-1] * len(page.parent), set(nodes)
    length, linked = Counter(), Counter()
    for node, above in enumerate(page.parent):
        of[node] = node if node in wanted else of[above] if above >= 0 else -1
    for node, text, share, *_ in page.blocks:
        length[of[node]] += len(text)
        linked[of[node]] += share * len(text)
    return [v for v in nodes if linked[v] <= 0.5 * length[v]]


def text_of(page: Page, nodes: Sequence[int]) -> str:
    """The text of all blocks within nodes, in page order."""
    take = [False] * len(page.parent)
    wanted = set(nodes)
    for node, above in enumerate(page.parent):
        take[node] = node in wanted or (above >= 0 and take[above])
    return " ".join(b[1] for b in page.blocks if take[b[0]])


def main_texts(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text (the article's), n_chars of pages (page_id, url, html).

    A null or empty html, and a page without text, give an empty text. A page whose url is null or has no
    host doesn't vote and is taken by itself. Repeated rows each get their row and vote; other columns are
    ignored, and an empty table gives an empty one. White space is what Unicode calls so.
    """
    ship(pages.sparkSession)
    rows = with_host(pages.select("page_id", "url", "html"))
    won = cut(winners(votes(rows), share), "host-paths")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                texts = []
                for html, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist()):
                    page = parse(html or "")
                    texts.append(text_of(page, chosen(page, paths or ())))
                text = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text, pc.utf8_length(text).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])
            release()

    kind = pages.schema["page_id"].dataType.simpleString()
    return attached(rows, won, ["host"]).select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`; see main_texts."""
    return main_texts(table(spark, sf_dir, "pages"))


#: For pages as those of the tables: one article, marked up as such, of headings, paragraphs, bold and breaks.
OP13_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
plain AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'), '\s+', ' ', 'g')) AS body FROM inner_html),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(body, '&#x27;', ''''), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM decoded
"""
