"""Spelling variants: words at edit distance one, found by a trie of letter-group counts.

A word's path in the trie is its length and then its counts of successive letter groups. One
inserted, deleted or replaced letter changes a path by a surplus of at most one in one group and a
deficit of at most one in another, so a depth-first search that may spend one of each reaches
every near word; the words at the leaves it reaches are verified letter by letter. Each pair is found from one side only: a
shorter word looks for longer ones (surplus only), and words of one length look for those that
first differ by a surplus.

The top of the trie is dealt over the cluster: a node of the top levels is a cell, one cell's words and the queries whose
search enters it meet in one task, and cells of more than ``cell_words`` words are divided by
further levels until they are small or their paths end.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored

#: Letter groups, in the order of the trie's levels; other letters count towards the length alone.
GROUPS = ("e", "a", "n", "i", "t", "r", "s", "o", "u", "lh", "dc", "mpgb")
#: Levels of the trie, besides the length, that divide words into cells at first.
TOP = 2
CELL_WORDS = 8192
#: A form is at least this many times as frequent as its variant.
DOMINANCE = 5
#: Leaves of more words than this are searched by halves of words instead of word by word.
LEAF = 16


def _paths(words: DataFrame) -> DataFrame:
    """Adds ``path``: the length and the count of each letter group."""
    size = F.length("word")
    counts = [(size - F.length(F.translate("word", g, ""))) for g in GROUPS]
    return words.withColumn("path", F.array(size, *counts))


def _node(depth: int, path: str = "path") -> Column:
    return F.array_join(F.slice(path, 1, depth + 1), ".")


def _cells(words: DataFrame, top: int, cell_words: int) -> list[DataFrame]:
    """Per level from ``top`` on the nodes reached (node, hot); hot nodes have too many words and go on a level deeper."""
    levels, rest, depth = [], words.select("path"), top
    while True:
        sized = rest.groupBy(_node(depth).alias("node")).count()
        nodes = stored(sized.select("node", ((F.col("count") > cell_words) & F.lit(depth < len(GROUPS))).alias("hot")))
        levels.append(nodes)
        if nodes.where("hot").isEmpty():
            return levels
        rest = rest.join(nodes.where("hot"), _node(depth) == F.col("node"), "left_semi")
        depth += 1


def _descend(df: DataFrame, keep: list[str], level: int) -> DataFrame:
    """The children that each query may enter at a level: same count, one more (surplus), one fewer (deficit)."""
    own, up, down, no = F.col("path")[level], F.col("up"), F.col("down"), F.lit(False)

    def child(count, up, down):
        return F.struct(F.concat_ws(".", "node", count.cast("string")).alias("node"), up.alias("up"), down.alias("down"))

    options = F.array(
        child(own, up, down),
        F.when(up, child(own + 1, no, down)),
        F.when(~up & down & (own > 0), child(own - 1, no, no)),
    )
    return df.select(*keep, F.explode(F.array_compact(options)).alias("child")).select(*keep, "child.*")


def _queries(words: DataFrame, levels: list[DataFrame], top: int) -> DataFrame:
    """(cell, word, n, path, up, down): the cells that each word's search enters, with its budget there.

    ``up`` and ``down`` tell whether a surplus and, after it, a deficit may still be spent; the search
    for words of the next length has no deficit.
    """
    keep = ["word", "n", "path"]
    kinds = F.array(*[F.struct(F.lit(d).alias("more"), F.lit(d == 0).alias("down")) for d in (0, 1)])
    at = words.withColumn("kind", F.explode(kinds)).select(
        *keep, (F.col("path")[0] + F.col("kind.more")).cast("string").alias("node"), F.lit(True).alias("up"), "kind.down"
    )
    for level in range(1, top + 1):
        at = _descend(at, keep, level)
    out = None
    for i, nodes in enumerate(levels):
        found = at.join(nodes, "node")
        done = found.where("not hot").select(F.col("node").alias("cell"), *keep, "up", "down")
        out = done if out is None else out.unionByName(done)
        at = _descend(found.where("hot"), keep, min(top + i + 1, len(GROUPS)))
    return out


def _own_cells(words: DataFrame, levels: list[DataFrame], top: int) -> DataFrame:
    """(cell, word, n, path): each word in the one cell that holds it."""
    out, rest = None, words
    for i, nodes in enumerate(levels):
        found = rest.withColumn("node", _node(top + i)).join(nodes, "node")
        done = found.where("not hot").select(F.col("node").alias("cell"), *words.columns)
        out = done if out is None else out.unionByName(done)
        rest = found.where("hot").select(*words.columns)
    return out


def near(a: str, b: str) -> bool:
    """Whether ``b`` comes from ``a`` by one replaced letter or, if it is longer, by one inserted letter."""
    i, size = 0, len(a)
    while i < size and a[i] == b[i]:
        i += 1
    if len(b) == size:
        return i < size and a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :]


class Leaf:
    """The words of one path; in large leaves they are looked up by the half that one edit leaves alone."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.halves: dict[int, dict] = {}

    def candidates(self, word: str):
        if len(self.words) <= LEAF:
            return self.words
        size, cut = len(word), len(word) // 2
        if size not in self.halves:
            table = self.halves[size] = defaultdict(list)
            for w in self.words:
                table["head", w[0][:cut]].append(w)
                table["tail", w[0][len(w[0]) - (size - cut) :]].append(w)
        table = self.halves[size]
        return {*table.get(("head", word[:cut]), ()), *table.get(("tail", word[cut:]), ())}


def trie(words, depth: int):
    """Nested dicts over the counts of the levels from ``depth`` on, down to leaves; ``words``: (word, n, path)."""
    root = None
    for word, n, path in words:
        levels = path[depth:]
        if root is None:
            root = {} if levels else Leaf()
        node = root
        for j, c in enumerate(levels):
            below = node.get(c)
            if below is None:
                below = node[c] = {} if j + 1 < len(levels) else Leaf()
            node = below
        node.words.append((word, n))
    return root


def search(node, path, level: int, up: bool, down: bool, found: list) -> None:
    """Depth-first: appends (leaf, whether the surplus is unspent) for each leaf within the budget."""
    if level == len(path):
        found.append((node, up))
        return
    own = path[level]
    if (below := node.get(own)) is not None:
        search(below, path, level + 1, up, down, found)
    if up:
        if (below := node.get(own + 1)) is not None:
            search(below, path, level + 1, False, down, found)
    elif down and own and (below := node.get(own - 1)) is not None:
        search(below, path, level + 1, False, False, found)


def _meet(key, queries: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one cell: its words as a trie below the cell's node, searched for every query."""
    out = []
    if len(queries) and len(words):
        depth = key[0].count(".") + 1
        root = trie(zip(words["word"], words["n"], (p.tolist() for p in words["path"])), depth)
        for word, n, path, up, down in zip(queries["word"], queries["n"], queries["path"], queries["up"], queries["down"]):
            leaves: list = []
            search(root, path.tolist(), depth, up, down, leaves)
            for leaf, unspent in leaves:
                for other, other_n in leaf.candidates(word):
                    # words of one path meet in both orders
                    if near(word, other) and (word < other or not unspent or len(other) > len(word)):
                        out.append((word, n, other, other_n))
    return pd.DataFrame(out, columns=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, top: int = TOP, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, other, other_n): each pair of near words once. ``words`` (word, n) must be stored and distinct."""
    placed = _paths(words.select("word", F.col("n").cast("long").alias("n")))
    levels = _cells(placed, top, cell_words)
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + words.count() // cell_words)
    queries = _queries(placed, levels, top).repartition(parts, "cell")
    own = _own_cells(placed, levels, top).toDF("cell", "word", "n", "path").repartition(parts, "cell")
    return queries.groupBy("cell").cogroup(own.groupBy("cell")).applyInPandas(_meet, "word string, n long, other string, other_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, target): targets followed to the last, the way doubling each time.

    A form is DOMINANCE times as frequent as its variant, so chains have no cycle and their length is
    the logarithm of the largest count at most.
    """
    at = stored(links)
    while True:
        on = at.select(F.col("word").alias("via"), F.col("target").alias("far"))
        if at.join(on, at["target"] == on["via"], "left_semi").isEmpty():
            return at.withColumnRenamed("target", "root")
        joined = at.join(on, at["target"] == on["via"], "left")
        at = stored(joined.select("word", F.coalesce("far", "target").alias("target")))


def group(tokens: DataFrame, word_col="word", min_length=6, min_count=5, top: int = TOP, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word of ``min_length`` letters found ``min_count`` times.

    ``tokens`` has one row per occurrence; null words and other columns are left out. ``form`` is the near word of largest n (ties:
    the smallest in code-point order) if its n is DOMINANCE times the word's or more, else null, as
    ``form_n`` then is; ``root`` follows forms to the last. Letters count as code points. Without rows
    there are none. Words are counted before they are shuffled; a task holds one cell's words and the
    queries that enter it, a bounded number unless more words than ``cell_words`` share a whole path.
    """
    token = F.col(f"`{word_col}`")
    counted = tokens.select(token.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    words = stored(counted.where(F.col("n") >= min_count))
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    ))
    sides = near_pairs(words, top, cell_words).select(F.explode(both).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    seen = stored(sides.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best))
    ruled = -F.col("best.less") >= DOMINANCE * F.col("n")
    formed = seen.select(
        F.col("word").alias("of"), "n_near", F.when(ruled, F.col("best.form")).alias("form"),
        F.when(ruled, -F.col("best.less")).alias("form_n"),
    )
    roots = _roots(formed.where("form is not null").select(F.col("of").alias("word"), F.col("form").alias("target")))
    full = words.join(formed, F.col("word") == F.col("of"), "left").join(roots, "word", "left")
    return full.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
