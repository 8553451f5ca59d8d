"""Main text of web pages by wrapper induction.

Pages are read in chunks of about 2 MB, once: a chunk's row holds the texts of its pages by node, and, beside them,
each different page as (host, shape of its tree, per node: hash, length and linked length of the text).

* Equal pages count once; pages of one shape are added up node by node in plain aggregates, so a host with a third
  of all pages costs narrow rows that combine before the shuffle.
* The trees of a host are aligned by simple tree matching, 64 at a time in rounds, into one template: a node has the
  least and greatest hash of its texts over all pages. Where they are the same on three different pages or more, the
  text is part of the template; where they vary, it is a slot.
* Each tree is matched with its host's template: slots are content, template nodes and slots that consist of links
  aren't. Menus, headers, forms, adverts and comments vary from page to page too; their tags and names tell them.
  If slots lie within an article, only these count.

Decisions go back to the chunks that hold such pages, and texts are joined there.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common, markup

CHUNK = 2_000_000  # characters of markup in a chunk; a longer page is alone
FAN = 64  # trees of a host aligned by one task
SEEN = 3  # different pages with one text at a node that make it part of the template
LINKS = 0.6  # share of linked characters that makes a slot a menu
STEP = 256  # rows of the matching of children kept at once; others are computed again from every STEPth

_CHUNKS = (
    "chunk long, packed binary, pages array<struct<host:string,shape:string,tree:string,page:long,"
    "nodes:array<struct<hash:long,chars:long,linked:long>>>>"
)
_PAGES = "page_id long, url string, text string"
_NODE = pa.struct([("hash", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])
_PAGE = pa.struct(
    [("host", pa.string()), ("shape", pa.string()), ("tree", pa.string()), ("page", pa.int64()), ("nodes", pa.list_(_NODE))]
)
_PACKED = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.string()),
        ("nodes", pa.list_(pa.int32())), ("texts", pa.list_(pa.large_string())),
    ]
)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: F.Column) -> F.Column:
    """Host of an address in small letters, '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _packed(rows: list) -> tuple[bytes, list[dict]]:
    """A chunk: texts of its pages, and its different pages as hashes."""
    columns, different = {name: [] for name in _PACKED.names}, {}
    for page_id, url, host, source in rows:
        page = markup.read(source)
        tree = page.shape()
        shape = hashlib.blake2b(tree.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        for name, value in zip(
            columns, (page_id, url, host, shape, [p[0] for p in page.pieces], [p[1] for p in page.pieces]), strict=True
        ):
            columns[name].append(value)
        by_node: dict[int, list] = {}
        for node, text, linked in page.pieces:
            by_node.setdefault(node, []).append((text, linked))
        nodes = [
            {
                "hash": _hash("\n".join(t for t, _ in by_node[k])) if k in by_node else None,
                "chars": sum(len(t) for t, _ in by_node.get(k, ())),
                "linked": sum(n for _, n in by_node.get(k, ())),
            }
            for k in range(len(page.labels))
        ]
        whole = _hash(repr([n["hash"] for n in nodes]))
        different[host, shape, whole] = {"host": host, "shape": shape, "tree": tree, "page": whole, "nodes": nodes}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_pydict(columns, schema=_PACKED))
    return sink.getvalue().to_pybytes(), list(different.values())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33

    def chunk(rows: list) -> pa.RecordBatch:
        packed, pages = _packed(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([packed], pa.binary()), pa.array([pages], pa.list_(_PAGE))],
            names=["chunk", "packed", "pages"],
        )

    rows, size = [], 0
    for batch in batches:
        sources = batch.column(3)
        for k, (page_id, url, host) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            source = sources[k].as_py() or ""
            if rows and size + len(source) > CHUNK:
                yield chunk(rows)
                number += 1
                rows, size = [], 0
            rows.append((page_id, url, host, source))
            size += len(source)
    if rows:
        yield chunk(rows)


# a tree in a task: nodes as lists [parent, label, away, least hash, greatest hash, pages, characters, linked characters]
Tree = list[list]


def _children(tree: Tree) -> list[list[int]]:
    below: list[list[int]] = [[] for _ in tree]
    for k, node in enumerate(tree[1:], 1):
        below[node[0]].append(k)
    return below


class _Matching:
    """Simple tree matching of two trees with equal roots: `pairs` maps nodes of `other` to nodes of `one`.

    Subtrees that no weight can tell apart are one kind, and kinds are compared once.
    """

    def __init__(self, one: Tree, other: Tree):
        self.one, self.other = one, other
        self.below_one, self.below_other = _children(one), _children(other)
        shared = {x[3] for x in one if x[3] == x[4]} & {y[3] for y in other if y[3] == y[4]}
        kinds: dict[tuple, int] = {}
        self.kind_one = _kinds(one, self.below_one, shared, kinds)
        self.kind_other = _kinds(other, self.below_other, shared, kinds)
        self.sizes: dict[tuple[int, int], int] = {}
        self.pairs = {0: 0}
        waiting = [(0, 0)]
        while waiting:
            for a, b in self.lined_up(*waiting.pop()):
                self.pairs[b] = a
                waiting.append((a, b))

    def alike(self, a: int, b: int) -> int:
        """Weight of putting node b on node a: 0 if their tags differ."""
        x, y = self.one[a], self.other[b]
        if x[2] != y[2] or x[1].split(" ", 1)[0] != y[1].split(" ", 1)[0]:
            return 0
        same_text = x[3] is not None and x[3] == x[4] == y[3] == y[4]
        return 1 + 2 * (x[1] == y[1]) + 2 * same_text

    def size(self, a: int, b: int) -> int:
        """Weight of the best matching of the trees below a and b."""
        kinds = self.kind_one[a], self.kind_other[b]
        if kinds not in self.sizes:
            own = self.alike(a, b)
            if own and self.below_one[a] and self.below_other[b]:
                own += sum(self.size(x, y) for x, y in self.lined_up(a, b))
            self.sizes[kinds] = own
        return self.sizes[kinds]

    def lined_up(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs of children in order, of the greatest weight together.

        Rows of the table are whole-array steps. Of two trees of very many children every STEPth row is kept, and the
        rows between are computed again on the way back: memory in proportion to the children times their number / STEP.
        """
        left, right = self.below_one[a], self.below_other[b]
        if not left or not right:
            return []
        # one row of weights for each kind on the left, by the kinds on the right
        first_left = {self.kind_one[x]: x for x in reversed(left)}
        first_right = {self.kind_other[y]: y for y in reversed(right)}
        place = {kind: k for k, kind in enumerate(first_right)}
        at = np.fromiter((place[self.kind_other[y]] for y in right), np.int64, len(right))
        weights = {
            kind: np.fromiter((self.size(x, y) for y in first_right.values()), np.int64, len(first_right))
            for kind, x in first_left.items()
        }

        def row(above: np.ndarray, x: int) -> np.ndarray:
            new = np.zeros_like(above)
            found = weights[self.kind_one[x]][at]
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + found), out=new[1:])
            return new

        kept = [np.zeros(len(right) + 1, np.int64)]
        last = kept[0]
        for i, x in enumerate(left[: len(left) - (len(left) - 1) % STEP - 1], 1):
            last = row(last, x)
            if i % STEP == 0:
                kept.append(last)
        pairs, i, j = [], len(left), len(right)
        while i and j:
            start = (i - 1) // STEP * STEP
            best = [kept.pop()]
            for x in left[start:i]:
                best.append(row(best[-1], x))
            while i > start and j:
                if best[i - start][j] == best[i - start - 1][j]:
                    i -= 1
                elif best[i - start][j] == best[i - start][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[i], right[j]))
        return pairs[::-1]


def _kinds(tree: Tree, below: list[list[int]], shared: set, kinds: dict[tuple, int]) -> list[int]:
    """A number per node: nodes of one number have equal labels, shared texts and children of equal numbers."""
    out = [0] * len(tree)
    for k in range(len(tree) - 1, -1, -1):  # children come after their parent
        _, label, away, low, high, *_ = tree[k]
        text = low if low == high and low in shared else None
        out[k] = kinds.setdefault((label, away, text, tuple(out[c] for c in below[k])), len(kinds))
    return out


def _added_up(x: list, y: list) -> list:
    low = [h for h in (x[3], y[3]) if h is not None]
    high = [h for h in (x[4], y[4]) if h is not None]
    return [*x[:3], min(low, default=None), max(high, default=None), *(p + q for p, q in zip(x[5:], y[5:], strict=True))]


def aligned(one: Tree, other: Tree) -> Tree:
    """Both trees as one: matched nodes are added up, the others keep their places between them."""
    matching = _Matching(one, other)
    out: Tree = []
    waiting: deque[tuple[int, int | None, int | None]] = deque([(-1, 0, 0)])
    while waiting:
        parent, a, b = waiting.popleft()
        node = one[a] if b is None else other[b] if a is None else _added_up(one[a], other[b])
        out.append([parent, *node[1:]])
        here = len(out) - 1
        left = deque(matching.below_one[a] if a is not None else ())
        for y in matching.below_other[b] if b is not None else []:
            x = matching.pairs.get(y)
            while x is not None and left[0] != x:
                waiting.append((here, left.popleft(), None))
            if x is not None:
                left.popleft()
            waiting.append((here, x, y))
        waiting.extend((here, x, None) for x in left)
    return out


def _tree(shape: str, nodes: list) -> Tree:
    out = []
    for line, node in zip(shape.split("\n"), nodes, strict=True):
        parent, away, label = line.split(" ", 2)
        out.append([int(parent), label, away == "-", node["low"], node["high"], node["pages"], node["chars"], node["linked"]])
    return out


def _templates(group: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in group.sort_values("shape")["nodes"]:
        tree = json.loads(text)
        whole = tree if whole is None else aligned(whole, tree)
    return group.head(1).assign(nodes=json.dumps(whole, ensure_ascii=True))


def kept_nodes(template: Tree, tree: Tree) -> list[bool]:
    """Which nodes of a page's tree are content, by its host's template."""
    on = _Matching(template, tree).pairs
    within, kept = [], []
    for k, (parent, label, away, *_) in enumerate(tree):
        tag = label.split(" ", 1)[0]
        within.append(not away and (tag in ("article", "main") or (k > 0 and within[parent])))
        _, _, _, low, high, pages, chars, linked = template[on[k]] if k in on else tree[k]
        constant = low is not None and low == high and pages >= SEEN
        menu = not within[k] and tag not in markup.HEADINGS and chars > 0 and linked >= LINKS * chars
        kept.append(not (away or constant or menu))
    named = [not node[2] for node in tree]
    for choice in (_both(kept, within), _both(named, within), kept):
        if any(k and node[6] for k, node in zip(choice, tree, strict=True)):
            return choice
    return named  # copies only: nothing varies, so nothing is told apart


def _both(one: list[bool], other: list[bool]) -> list[bool]:
    return [x and y for x, y in zip(one, other, strict=True)]


def _decisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = [
            "".join("+" if k else "-" for k in kept_nodes(json.loads(template), json.loads(nodes)))
            for template, nodes in zip(batch["template"], batch["nodes"], strict=True)
        ]
        yield batch[["host", "shape"]].assign(kept=kept)


def _rows_to_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes = [
            json.dumps(_tree(tree, [n.asDict() if hasattr(n, "asDict") else n for n in rows]))
            for tree, rows in zip(batch["tree"], batch["rows"], strict=True)
        ]
        yield batch[["host", "shape"]].assign(nodes=nodes)


def _trees(chunks: DataFrame) -> DataFrame:
    """(host, shape, nodes): each host's trees, their nodes added up over different pages."""
    pages = chunks.select(F.explode("pages").alias("p")).select("p.*")
    once = pages.groupBy("host", "shape", "page").agg(F.first("tree").alias("tree"), F.first("nodes").alias("nodes"))
    nodes = once.select("host", "shape", "tree", F.posexplode("nodes").alias("at", "node"))
    added = nodes.groupBy("host", "shape", "at").agg(
        F.first("tree").alias("tree"),
        F.min("node.hash").alias("low"),
        F.max("node.hash").alias("high"),
        F.count("node.hash").alias("pages"),
        F.sum("node.chars").alias("chars"),
        F.sum("node.linked").alias("linked"),
    )
    rows = F.array_sort(F.collect_list(F.struct("at", "low", "high", "pages", "chars", "linked")))
    whole = added.groupBy("host", "shape").agg(F.first("tree").alias("tree"), rows.alias("rows"))
    return whole.mapInPandas(_rows_to_trees, "host string, shape string, nodes string")


def _template_of(trees: DataFrame) -> DataFrame:
    """(host, template): the trees of each host aligned, FAN at a time."""
    counts = trees.groupBy("host").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    work = trees.join(counts, "host").withColumn("slot", F.pmod(F.xxhash64("shape"), F.greatest(F.ceil(F.col("n") / FAN), F.lit(1))))
    schema = "host string, shape string, nodes string, n long, slot long"
    while True:
        # slots left after this round
        work = work.select("host", "shape", "nodes", "n", "slot").groupBy("host", "slot").applyInPandas(_templates, schema)
        most = -(-most // FAN)
        if most <= 1:
            return work.select("host", F.col("nodes").alias("template"))
        work = work.withColumn("n", F.ceil(F.col("n") / FAN)).withColumn("slot", F.pmod("slot", F.greatest(F.ceil(F.col("n") / FAN), F.lit(1))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, decisions in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            kept = {(d["host"], d["shape"]): [k for k, c in enumerate(d["kept"]) if c == "+"] for d in decisions}
            kept = {key: frozenset(nodes) for key, nodes in kept.items()}
            for part in pa.ipc.open_stream(packed.as_buffer()):
                rows = zip(*(part.column(c).to_pylist() for c in ("host", "shape", "nodes", "texts")), strict=True)
                texts = [
                    " ".join(t for n, t in zip(nodes, pieces, strict=True) if n in kept[host, shape])
                    for host, shape, nodes, pieces in rows
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars), one row per input row.

    Blocks are joined by a space in page order, white space within them is one space, character references are
    decoded; `n_chars` counts code points. Null or empty markup gives an empty text. Pages without an address or
    with one without a host belong to the host ''. Null and repeated ids stay as they are; equal pages of a host
    count once for its template and all get their text. A host with fewer than three different pages at a node has
    no template there, and where nothing of an article or page would be left there are copies only: then tags and
    names alone decide. Very long pages are read whole, alone in their chunk. Among
    equally good alignments (ties) the one with the later children is taken, whatever the order of the rows.
    An empty table gives none. Only the three named columns are read.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        host_of(F.col(f"`{url}`")).alias("host"),
        F.col(f"`{html}`").alias("html"),
    )
    chunks = common.stored(rows.mapInArrow(_chunks, _CHUNKS))
    trees = common.stored(_trees(chunks))
    pairs = trees.join(_template_of(trees), "host")
    decisions = pairs.mapInPandas(_decisions, "host string, shape string, kept string")
    held = chunks.select("chunk", F.explode("pages").alias("p")).select("chunk", "p.host", "p.shape").distinct()
    by_chunk = held.join(decisions, ["host", "shape"]).groupBy("chunk").agg(
        F.collect_list(F.struct("host", "shape", "kept")).alias("decisions")
    )
    found = chunks.select("chunk", "packed").join(by_chunk, "chunk").select("packed", "decisions").mapInArrow(_texts, _PAGES)
    return found.withColumn("n_chars", F.length("text").cast("long"))
