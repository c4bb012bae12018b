"""Reply trees: root-to-leaf paths by self-joins, branches ranked by score, chosen paths as conversations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import col, union_all
from prepkit.sources.scratch import materialize

HOT_MESSAGES = 100_000  # a tree with more messages is hot, if it also holds 1 / HOT_TREES of all
HOT_TREES = 10_000  # so there are fewer hot trees than this


@dataclass(frozen=True)
class Template:
    """Marks of a turn, ``opening`` role ``middle`` text ``closing``, and the control strings that texts may not hold.

    A control string is one of ``<`` and ``[`` and then others. In texts, backslashes between its first
    character and the rest are one more than written; so no text holds a control string, and
    taking one away gives the text back. Roles are URL-encoded.
    """

    opening: str = "<|im_start|>"
    middle: str = "\n"
    closing: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not {self.opening, self.closing.rstrip("\n")} <= set(self.controls) or self.middle != "\n":
            raise ValueError("the marks of a turn are control strings and a line break")
        if any(len(c) < 2 or c[0] not in "<[" or set(c[1:]) & set("<[\\") for c in self.controls):
            raise ValueError("a control string starts with < or [ and has neither of them, nor a backslash, after that")

    def _held(self) -> str:
        """A control string's first character, the backslashes after it, and a look at the rest."""
        rests = {f: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f) for f in "<["}
        return "|".join(rf"(?:(?<={re.escape(f)})(?=\\*(?:{r})))" for f, r in rests.items() if r)

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._held(), "\\\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"(?:{self._held()})\\", "")

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.opening), F.url_encode(role), F.lit(self.middle))

    def turns(self, formatted: Column) -> Column:
        """Array of ``(role, text, segment)`` read back from a formatted conversation; texts unescaped."""
        segments = F.split(formatted, re.escape(self.opening), -1)
        segments = F.slice(segments, F.lit(2), F.size(segments))

        def turn(segment: Column) -> Column:
            role = F.substring_index(segment, self.middle, 1)
            start = F.length(role) + len(self.middle)
            text = F.substring(segment, start + 1, F.length(segment) - start - len(self.closing))
            return F.struct(F.url_decode(role).alias("role"), self.unescaped(text).alias("text"), segment.alias("segment"))

        return F.transform(segments, turn)

    def masked(self, formatted: Column, spans: Column) -> Column:
        """The unescaped text under the loss mask, spans one after the other."""
        segments = F.split(formatted, re.escape(self.opening), -1)

        def text(span: Column) -> Column:
            segment = F.element_at(segments, span["turn"] + 2)
            return self.unescaped(F.substring(segment, (span["offset"] + 1).cast("int"), span["length"].cast("int")))

        return F.array_join(F.transform(F.filter(spans, lambda s: s["loss"]), text), "")


def linear_links(rows: DataFrame, tree_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Links of conversations without branches: every turn answers the one before, a null turn comes first."""
    turns = rows.select(col(tree_col).alias("tree"), F.struct(col(order_col).alias("turn")).alias("node")).distinct()
    before = F.lag("node").over(Window.partitionBy("tree").orderBy("node"))
    return turns.select("tree", "node", before.alias("parent"), F.lit(None).cast("double").alias("score"))


def reply_links(
    messages: DataFrame, tree_col: str = "tree", id_col: str = "id", parent_col: str = "parent", score_col: str = "score"
) -> DataFrame:
    """``(tree, node, parent, score)``: one row per node; of rows with the same id the smallest parent, the mean score."""
    node = messages.select(
        col(tree_col).alias("tree"),
        F.struct(col(id_col).alias("id")).alias("node"),
        F.when(col(parent_col).isNotNull(), F.struct(col(parent_col).alias("id"))).alias("parent"),
        col(score_col).cast("double").alias("score"),
    )
    return node.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.avg("score").alias("score"))


def _jumps(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node's ``(tree, node, depth, total, scored)`` from its root, and tables of 2^k-th ancestors.

    Each round joins the nodes that have not reached a root to all and doubles the distance, so the number
    of rounds is the logarithm of the longest path, and short paths leave early. Nodes on a cycle, or below one, never reach a root and are left out:
    rounds end when they are all that is left, which the largest tree's number of nodes bounds.
    """
    known = links.select("tree", F.col("node").alias("up"))
    parents = known.withColumn("there", F.lit(True))
    same = F.col("l.tree").eqNullSafe(F.col("p.tree")) & (F.col("l.parent") == F.col("p.up"))
    table = links.alias("l").join(parents.alias("p"), same, "left").select(
        "l.tree",
        "l.node",
        F.when(F.col("p.there"), F.col("l.parent")).alias("up"),
        F.lit(1).cast("bigint").alias("depth"),
        F.coalesce("l.score", F.lit(0.0)).alias("total"),
        F.col("l.score").isNotNull().cast("bigint").alias("scored"),
    )
    table = materialize(table, "replies")
    done, going, ups = [table.where("up is null")], table.where("up is not null"), []
    most = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        if not going.take(1):
            break
        ups.append(going.select("tree", "node", "up"))
        a, b = going.alias("a"), union_all([*done, going]).alias("b")
        same = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))
        more = [(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("depth", "total", "scored")]
        table = materialize(a.join(b, same).select("a.tree", "a.node", "b.up", *more), "replies")
        done.append(table.where("up is null"))
        going = table.where("up is not null")
    return union_all(done).drop("up"), ups


def best_branches(links: DataFrame, best: int = 1) -> DataFrame:
    """``(tree, path, rank, score, node, step)``: the nodes, from the root on, of each tree's ``best`` branches.

    A branch ends in a node without replies. Its score is the mean of its nodes' scores (nulls aside;
    without any score it comes last); ties go to the smaller leaf. ``path`` is the leaf. A node
    whose parent is null or not in the tree is a root.
    """
    links = materialize(links, "reply_links")
    table, ups = _jumps(links)
    inner = links.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = table.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    score = F.when(F.col("scored") > 0, F.col("total") / F.col("scored"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "node")
    ranked = leaves.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    columns = ["tree", "path", "rank", "score", "node", "step"]
    steps = ranked.select("tree", F.col("node").alias("path"), "rank", "score", "node", F.col("depth").alias("step"))
    parts = [materialize(steps, "paths")]
    for k in reversed(range(len(ups))):  # every distance to the leaf is one sum of powers of two, the largest first
        up = ups[k].select(F.col("tree").alias("t"), F.col("node").alias("of"), "up")
        found = union_all(parts).join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("of")))
        above = found.select("tree", "path", "rank", "score", F.col("up").alias("node"), (F.col("step") - 2**k).alias("step"))
        parts.append(materialize(above.select(*columns), "paths"))
    return union_all(parts)


def _near(messages: DataFrame, steps: DataFrame) -> DataFrame:
    """The messages, without those of hot trees that no chosen path needs.

    A tree is grouped whole where its paths are written, so a tree with most of the rows has to lose
    the rest before that. Hot trees are fewer than ``HOT_TREES``, which bounds the broadcast list.
    """
    sizes = messages.groupBy("tree").count()
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    hot = sizes.where(F.col("count") > max(HOT_MESSAGES, rows // HOT_TREES)).select(F.col("tree").alias("t"))
    hot = materialize(hot, "hot_trees")
    if not hot.take(1):
        return messages
    same = F.col("tree").eqNullSafe(F.col("t"))
    chosen = steps.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    wanted = messages.join(F.broadcast(hot), same, "left_semi").join(
        chosen, same & (F.col("node") == F.col("n")), "left_semi"
    )
    return messages.join(F.broadcast(hot), same, "left_anti").unionByName(wanted)


def format_paths(messages: DataFrame, steps: DataFrame, template: Template = Template()) -> DataFrame:
    """``(tree, path, rank, score, n_turns, formatted, spans)`` of chosen paths over messages ``(tree, node, role, text)``.

    ``spans`` has for each turn its number, the code points of its escaped text (``start`` in the
    conversation, ``offset`` after the opening mark, ``length``) and whether it is trained on. Rows that
    share a node follow each other, by role and text. Texts move once: rows and path steps are dealt
    together by tree, met there by node and joined to conversations in the order of the steps.
    """
    near = _near(messages, steps)
    said = near.select(
        "tree",
        "node",
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
        F.lit(None).cast(steps.select(F.struct("path", "rank", "score", "step")).schema[0].dataType).alias("at"),
    )
    placed = steps.select(
        "tree", "node", F.lit(None).cast(said.schema["said"].dataType).alias("said"), F.struct("path", "rank", "score", "step").alias("at")
    )
    dealt = said.unionByName(placed).repartition("tree")
    nodes = dealt.groupBy("tree", "node").agg(
        F.array_sort(F.collect_list("said")).alias("said"), F.collect_list("at").alias("at")
    )
    turns = nodes.select("tree", "said", F.explode("at").alias("at")).select("tree", "at.*", F.posexplode("said").alias("nth", "said"))
    header, text = template.header(F.col("said.role")), template.escaped(F.col("said.text"))
    trained = F.col("said.role").isin(*template.trained)
    parts = turns.select("tree", "path", "rank", "score", "step", "nth", header.alias("header"), text.alias("body"), trained.alias("loss"))
    size = F.length("header") + F.length("body") + len(template.closing)
    order = Window.partitionBy("tree", "path").orderBy("step", "nth")
    parts = parts.select(
        "*",
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("before"),
        (F.row_number().over(order) - 1).alias("turn"),
    )
    span = F.struct(
        "turn",
        (F.col("before") + F.length("header")).cast("bigint").alias("start"),
        (F.length("header") - len(template.opening)).cast("bigint").alias("offset"),
        F.length("body").cast("bigint").alias("length"),
        "loss",
    )
    piece = F.struct("turn", span.alias("span"), F.concat("header", "body", F.lit(template.closing)).alias("piece"))
    joined = parts.groupBy("tree", "path").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"), F.array_sort(F.collect_list(piece)).alias("pieces")
    )
    return joined.select(
        "tree",
        "path",
        "rank",
        "score",
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.array_join("pieces.piece", "").alias("formatted"),
        F.col("pieces.span").alias("spans"),
    )


def format_trees(
    messages: DataFrame,
    tree_col: str = "tree",
    id_col: str = "id",
    parent_col: str = "parent",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str = "score",
    best: int = 1,
    template: Template = Template(),
) -> DataFrame:
    """The ``best`` branches of every reply tree, each formatted as one conversation (see ``format_paths``).

    Null roles and texts are empty strings; null trees are one tree; a null parent, or one that is not
    in the tree, makes a root; rows with the same id (nulls too) are one node, said one after the
    other; messages on or below a cycle of replies belong to no path. A conversation is one row, so
    it has to fit in one, as the text it is. Other columns are not read; an empty table gives no rows.
    """
    links = reply_links(messages, tree_col, id_col, parent_col, score_col)
    said = messages.select(
        col(tree_col).alias("tree"), F.struct(col(id_col).alias("id")).alias("node"), col(role_col).alias("role"), col(text_col).alias("text")
    )
    return format_paths(said, best_branches(links, best), template)


def format_conversations(
    rows: DataFrame,
    tree_col: str = "conv_id",
    order_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """Conversations without branches as trees of one path, ordered by turn, then role and text (see ``format_trees``)."""
    said = rows.select(
        col(tree_col).alias("tree"), F.struct(col(order_col).alias("turn")).alias("node"), col(role_col).alias("role"), col(text_col).alias("text")
    )
    return format_paths(said, best_branches(linear_links(rows, tree_col, order_col)), template)
