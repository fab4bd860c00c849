"""Main text of pages by a site style tree.

The element trees of all pages of a host are merged: elements with the same
labels from the root down (tag, classes and id, digits alike) are one node,
and the sequences of children seen below it are its styles.  Two entropies,
to the base of the number of pages, say how important a node is:

* presentation: a node whose pages all have one style says nothing, one with
  many styles does.  The composite importance of an element weighs its own
  by 1 - GAMMA ** styles against that of its children;
* content: a text that stands on many pages of the host spreads evenly (high
  entropy, template); a node's content importance is one less the mean
  entropy of its texts.

A node seen on few pages leans on its parent's composite importance, on the
tree merged over all hosts, and on what markup says of it.  Branches of low
importance are removed; the blocks that are left are the main text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_slices
from .html_text import Block, Element, host_of, node_id, read_page

#: attenuation of the children's importance for each further style
GAMMA = 0.9
#: pages that the evidence from elsewhere counts as
BACKING = 20.0
#: branches below this importance go
LEAST = 0.6
#: the site that stands for the tree of all hosts (no host name)
ALL = "*"
#: removed (host, node) pairs that are broadcast at most
SMALL = 200_000
SALTS = 32
SLICE_BYTES = 4 << 20

#: what markup says of a text: (kind, importance before any evidence, factor)
ARTICLE, PART, OPEN, LIKELY, ASIDE, NAMED = range(6)
KINDS = {ARTICLE: (1.0, 1.0),  # straight in an article or main element
         PART: (1.0, 1.0),     # in a container inside one
         LIKELY: (0.9, 1.0),   # no such element; its class calls it content, or no class does
         OPEN: (0.5, 1.0),     # no such element; another branch is called content
         ASIDE: (0.4, 0.5),    # outside the page's article
         NAMED: (0.0, 0.5)}    # menu, header, footer, sidebar, notice, advert, form, comment
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody thead tr td th "
                  "caption header hgroup center".split())

_BLOCK = pa.struct([("node", pa.int64()), ("text", pa.string())])
_CONTENT = pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("times", pa.int64())])
_TREE = pa.struct([("node", pa.int64()), ("path", pa.list_(pa.int64())), ("style", pa.int64()),
                   ("pages", pa.int64()), ("share", pa.float64()), ("kind", pa.int32())])
_SCHEMA = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()),
                     ("blocks", pa.list_(_BLOCK)), ("content", pa.list_(_CONTENT)), ("tree", pa.list_(_TREE))])


def _direct(element: Element, parents: dict[int, Element]) -> bool:
    """Whether only flow elements stand between an element and its landmark."""
    while element.tag in _FLOW and (above := parents.get(id(element))) is not None:
        element = above
    return element.tag in ("article", "main")


def kinds_of(blocks: list[Block], elements: list[Element]) -> list[int]:
    parents = {id(kid): e for e in elements for kid in e.kids}
    article = any(b.element.landmark and not b.element.named for b in blocks)
    likely = any(b.element.likely and not b.element.named for b in blocks)
    out = []
    for e in (b.element for b in blocks):
        if e.named:
            out.append(NAMED)
        elif article:
            out.append(ASIDE if not e.landmark else ARTICLE if _direct(e, parents) else PART)
        else:
            out.append(LIKELY if e.likely or not likely else OPEN)
    return out


def read_tree(page: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(blocks, distinct texts of each node, distinct nodes and styles) of a
    page.  The text of an element is a leaf below it."""
    blocks, elements = read_page(page)
    texts: dict[int, dict[int, Block]] = {}
    leaves, content = [], {}
    for b, kind in zip(blocks, kinds_of(blocks, elements)):
        leaf = node_id(f"{b.element.node}#{kind}")
        texts.setdefault(id(b.element), {})[leaf] = kind
        leaves.append({"node": leaf, "text": b.text})
        key = (leaf, node_id(b.text))
        content[key] = content.get(key, 0) + 1
    tree: dict[tuple[int, int], dict] = {}
    seen: set[int] = set()
    share = {id(elements[0]): 1.0}

    def add(node, path, style, weight, kind):
        if (node, style) not in tree:
            tree[node, style] = {"node": node, "path": path, "style": style, "kind": kind,
                                 "pages": int(node not in seen), "share": 0.0 if node in seen else weight}
            seen.add(node)

    for e in elements:
        own = texts.get(id(e), {})
        if not own and not e.kids:
            continue
        # equal neighbours count once, so the number of paragraphs is no style
        labels = [k.label for i, k in enumerate(e.kids) if not i or k.label != e.kids[i - 1].label]
        labels += ["#"] * len(own)
        for k in e.kids:
            share[id(k)] = 1 / len(labels)
        add(e.node, list(e.path), node_id("|".join(labels)), share[id(e)], -1)
        for leaf, kind in own.items():
            add(leaf, [*e.path, leaf], 0, 1 / len(labels), kind)
    return leaves, [{"node": n, "feature": f, "times": c} for (n, f), c in content.items()], list(tree.values())


def read_pages(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host and the parsed page of every row."""

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in text_slices(batch, "html", SLICE_BYTES):
                urls = part.column("url").cast(pa.string())
                read = [read_tree(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(read)), pa.int64()), part.column("page_id").cast(pa.int64()), urls,
                     pa.array([host_of(u) for u in urls.to_pylist()], pa.string())]
                    + [pa.array([r[i] for r in read], _SCHEMA.field(4 + i).type) for i in range(3)], schema=_SCHEMA)
                row += len(read)

    struct = "array<struct<node: bigint, {}>>"
    return pages.select("page_id", "url", "html").mapInArrow(run, ", ".join([
        "row long, page_id long, url string, host string", "blocks " + struct.format("text: string"),
        "content " + struct.format("feature: bigint, times: bigint"),
        "tree " + struct.format("path: array<bigint>, style: bigint, pages: bigint, share: double, kind: int")]))


def _entropy(total: Column, n_log_n: Column) -> Column:
    """Entropy (nats) of counts with this sum and this sum of n ln n."""
    return F.log(total) - n_log_n / total


def node_table(parsed: DataFrame) -> DataFrame:
    """site, node, path, kind, pages, styles, share and own importance of
    every node, for each host and for all hosts together."""
    both = F.explode(F.array("host", F.lit(ALL))).alias("site")
    styles = (parsed.select("host", F.inline("tree")).select(both, "*")
              .groupBy("site", "node", "style")
              .agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.sum("share").alias("share"),
                   F.first("path").alias("path"), F.first("kind").alias("kind")))
    shape = (styles.groupBy("site", "node")
             .agg(F.sum("pages").alias("pages"), F.sum("share").alias("share"), F.count("*").alias("styles"),
                  _entropy(F.sum("n"), F.sum(F.col("n") * F.log("n"))).alias("style_entropy"),
                  F.first("path").alias("path"), F.first("kind").alias("kind")))
    texts = (parsed.select("host", F.inline("content")).select(both, "*")
             .groupBy("site", "node", "feature")
             .agg(_entropy(F.sum("times"), F.sum(F.col("times") * F.log("times"))).alias("entropy"))
             .groupBy("site", "node").agg(F.avg("entropy").alias("text_entropy")))
    own = (F.when(F.col("pages") < 2, 1.0)
           .when(F.col("kind") >= 0, 1 - F.col("text_entropy") / F.log("pages"))
           .otherwise(F.least(F.lit(1.0), F.col("style_entropy") / F.log("pages"))))
    return shape.join(texts, ["site", "node"], "left").select(
        "site", "node", "path", "kind", "pages", "styles", "share", own.alias("own"))


def composite(nodes: DataFrame) -> DataFrame:
    """site, node, importance: own importance mixed with that of the children,
    down to the texts.

    The recursion is linear, so a node adds its own part, times the weights
    on its path, to each of its ancestors (at most html_text.DEPTH).
    """
    fade = F.pow(F.lit(GAMMA), F.least("styles", F.lit(60)))
    above = nodes.select("site", F.col("node").alias("parent"), F.col("pages").alias("parent_pages"),
                         F.log(fade).alias("parent_fade"))
    edge = F.col("parent_fade") + F.log(F.col("share") / F.col("parent_pages"))
    weighed = (nodes.withColumn("parent", F.try_element_at("path", F.lit(-2)))
               .join(above, ["site", "parent"], "left")
               .select("site", "node", "path", F.coalesce(edge, F.lit(0.0)).alias("edge"),
                       F.when(F.col("kind") >= 0, F.col("own")).otherwise((1 - fade) * F.col("own")).alias("part")))
    step = weighed.select("site", F.col("node").alias("ancestor"), "edge")
    chain = (weighed.select("site", "node", F.explode("path").alias("ancestor"))
             .join(step, ["site", "ancestor"]).groupBy("site", "node").agg(F.sum("edge").alias("chain")))
    reached = weighed.join(chain, ["site", "node"])
    sums = (reached.select("site", F.explode("path").alias("node"), (F.col("part") * F.exp("chain")).alias("part"))
            .groupBy("site", "node").agg(F.sum("part").alias("part")))
    return sums.join(chain, ["site", "node"]).select(
        "site", "node", F.least(F.lit(1.0), F.col("part") / F.exp("chain")).alias("importance"))


def _backed(pages: str, own: Column, other: Column) -> Column:
    return (F.col(pages) * own + BACKING * other) / (F.col(pages) + BACKING)


def score_texts(nodes: DataFrame, importance: DataFrame) -> DataFrame:
    """site, node, kind, pages, score of the text nodes of every host."""
    texts = nodes.filter("kind >= 0")
    prior, factor = (F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in KINDS.items()]) for i in (0, 1))
    everywhere = texts.filter(F.col("site") == ALL).select(
        "node", _backed("pages", F.col("own"), prior).alias("everywhere"))
    parent = importance.select("site", F.col("node").alias("parent"), "importance")
    backed = (texts.filter(F.col("site") != ALL).withColumn("parent", F.element_at("path", -2))
              .join(parent, ["site", "parent"]).join(everywhere, "node"))
    here = _backed("pages", F.col("own"), _backed("pages", F.col("importance"), F.col("everywhere")))
    # text straight in an article element is no template however often it
    # repeats: a host may hold copies of one page
    low = F.least(here, F.col("everywhere"))
    score = F.when(F.col("kind") == ARTICLE, F.greatest(low, F.lit(LEAST))).otherwise(low)
    return backed.select("site", "node", "kind", "pages", (score * factor).alias("score"))


def extract(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Blocks are joined by an empty line, in page order.  Null html is an empty
    page; text is empty if no branch is left.  A null or unreadable url
    belongs to the host ''.  Repeated rows are pages of their own, a null
    page_id is passed on, other columns are ignored, an empty table gives no
    rows; a very long page is read whole, as a slice of its own.
    """
    scratch = Scratch(pages.sparkSession, "style-tree")
    parsed = scratch.table(read_pages(pages), "pages", "zstd")
    nodes = scratch.table(node_table(parsed), "nodes")
    low = scratch.table(score_texts(nodes, composite(nodes)).filter(F.col("score") < LEAST)
                        .select(F.col("site").alias("host"), "node"), "low")
    if low.count() <= small:
        of_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
        marked = parsed.join(F.broadcast(of_host), "host", "left")
    else:
        # the nodes of a page (no texts) meet the removed ones; a hot host is salted
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of_page = (parsed.select("row", "host", F.explode(F.array_distinct("blocks.node")).alias("node"))
                   .withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
                   .join(salted.hint("merge"), ["host", "node", "salt"])
                   .groupBy("row").agg(F.collect_list("node").alias("low")))
        marked = parsed.join(of_page, "row", "left")
    kept = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("low", F.array().cast("array<bigint>")), b["node"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    # the texts are not written once more: the result reads the parsed pages
    scratch.forget(nodes)
    scratch.keep()
    return (marked.select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
