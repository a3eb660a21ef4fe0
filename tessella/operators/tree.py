"""Trees from flat item rows: hierarchy, depth filter, pre-order, paths and containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import anchor, generate_id, let
from tessella.schema import NODE_COLUMNS

#: Items: doc_id, seq, line, title, type, is_section, depth, metadata.
ITEM_COLUMNS = ["doc_id", "seq", "line", "title", "type", "is_section", "depth", "metadata"]


def greatest(columns: list[Column]) -> Column:
    """The greatest of any number of columns, nulls apart."""
    return reduce(lambda a, b: F.greatest(a, b), columns, F.lit(None).cast("int"))


def filter_depth(nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """Nodes no deeper than ``max_depth``; 0 and None filter nothing.  A child is always deeper
    than its parent, so dropping deep rows drops whole subtrees."""
    return nodes.where(F.col("depth") <= max_depth) if max_depth else nodes


def assemble(items: DataFrame, max_depth: int | None = None, levels: int = 7) -> DataFrame:
    """Outline nodes from items whose sections are at most ``levels`` deep.

    A section's parent is the nearest earlier section of smaller depth; any other item is a
    leaf under the latest section.  The nearest open section of each level is a running maximum,
    so the whole assembly is windows over one shuffle by document.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    section = F.col("is_section")
    under = F.coalesce(F.last(F.when(section, F.col("depth")), ignorenulls=True).over(before), F.lit(0)) + 1
    rows = filter_depth(items.withColumn("depth", F.when(section, F.col("depth")).otherwise(under)), max_depth)
    rows = rows.withColumn("rn", F.row_number().over(order))
    at = {k: F.col(f"at{k}") for k in range(1, levels + 1)}
    rows = rows.select("*", *[F.max(F.when(section & (F.col("depth") == k), F.col("rn"))).over(before).alias(f"at{k}") for k in at])
    above = {k: ~section | (F.col("depth") > k) for k in at}
    parent = greatest([F.when(above[k], at[k]) for k in at])
    is_open = [at[k].isNotNull() & above[k] & (at[k] > F.coalesce(greatest([at[j] for j in range(1, k)]), F.lit(0))) for k in at]
    depth = reduce(lambda a, b: a + b.cast("int"), is_open, F.lit(1))
    rows = rows.select("doc_id", (F.col("rn") - 1).alias("node_id"), (parent - 1).alias("parent_id"), "title", "type", F.col("depth").cast("int").alias("depth"), depth.alias("tree_depth"), "line", "is_section", "metadata")
    return finish(rows)


def assemble_unbounded(items: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``assemble`` for sections of any depth: a stack is folded over each document's items.
    It needs no window, so it also runs on streams once items are grouped by document."""
    group = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line", "title", "type", "is_section", "depth", "metadata"))).alias("items"))
    return finish(group.select("doc_id", F.explode(fold_tree(F.col("items"), max_depth)).alias("n")).select("doc_id", "n.*"))


def fold_tree(items: Column, max_depth: int | None = None) -> Column:
    """The nodes of one document as an array, by a fold over its ordered items."""
    stack = "array<struct<depth:int,node:int>>"
    node = "struct<node_id:int,parent_id:int,title:string,type:string,depth:int,tree_depth:int,line:int,is_section:boolean,metadata:string>"

    def step(acc, x):
        kept = F.when(x["is_section"], F.filter(acc["stack"], lambda s: s["depth"] < x["depth"])).otherwise(acc["stack"])
        top = F.try_element_at(kept, F.lit(-1))
        depth = F.when(x["is_section"], x["depth"]).otherwise(F.coalesce(top["depth"], F.lit(0)) + 1).cast("int")
        number = F.size(acc["out"])
        fits = depth <= max_depth if max_depth else F.lit(True)
        row = F.struct(number.alias("node_id"), top["node"].alias("parent_id"), x["title"].alias("title"), x["type"].alias("type"), depth.alias("depth"), (F.size(kept) + 1).alias("tree_depth"), x["line"].cast("int").alias("line"), x["is_section"].alias("is_section"), x["metadata"].alias("metadata"))
        pushed = F.when(x["is_section"], F.concat(kept, F.array(F.struct(depth.alias("depth"), number.alias("node"))))).otherwise(kept)
        return F.struct(F.when(fits, pushed).otherwise(acc["stack"]).cast(stack).alias("stack"), F.when(fits, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).cast(f"array<{node}>").alias("out"))

    start = F.struct(F.array().cast(stack).alias("stack"), F.array().cast(f"array<{node}>").alias("out"))
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def finish(rows: DataFrame) -> DataFrame:
    """Node columns of assembled items: positions, ids and, for sections, anchors."""
    line = F.col("line").cast("int")
    named = rows.withColumn("line", line).withColumn("id", generate_id(F.col("title"), F.col("type"), line)).withColumn("anchor", F.when(F.col("is_section"), anchor(F.col("title"))))
    missing = {"col": F.when(F.col("line").isNotNull(), F.lit(1)).cast("int"), "end_line": F.lit(None).cast("int"), "end_col": F.lit(None).cast("int")}
    return named.withColumns(missing).select(*NODE_COLUMNS)


def renumber(nodes: DataFrame) -> DataFrame:
    """Node ids from 0 without gaps after rows were dropped, in the order of the old ones."""
    order = Window.partitionBy("doc_id").orderBy("node_id")
    numbered = nodes.withColumn("new_id", F.row_number().over(order) - 1)
    parents = numbered.select("doc_id", F.col("node_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return numbered.join(parents, ["doc_id", "parent_id"], "left").withColumn("node_id", F.col("new_id")).withColumn("parent_id", F.col("new_parent")).select(*NODE_COLUMNS)


def path_rows(nodes: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, all): each document's nodes in order, as structs of ``node_id``, ``path`` (the titles
    from the root to the node) and ``columns``.

    Pre-order makes the ancestors the latest earlier nodes of each smaller tree depth, so the
    path is a fold over the document's nodes and needs no recursion.  The columns are carried
    along, so the nodes aren't joined to their paths.
    """
    group = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "tree_depth", "title", F.struct(*columns).alias("own")))).alias("all"))
    own = group.schema["all"].dataType.elementType["own"].dataType.simpleString()

    def step(acc, x):
        path = F.concat(F.slice(acc["path"], 1, x["tree_depth"] - 1), F.array(x["title"]))
        return let(path, lambda p: F.struct(p.alias("path"), F.concat(acc["out"], F.array(F.struct(x["node_id"].alias("node_id"), p.alias("path"), x["own"].alias("own")))).alias("out")))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(f"array<struct<node_id:int,path:array<string>,own:{own}>>").alias("out"))
    return group.select("doc_id", F.aggregate("all", start, step, lambda acc: acc["out"]).alias("all"))


def with_paths(nodes: DataFrame, max_nesting: int = 64) -> DataFrame:
    """``nodes`` with ``path``, the titles from the root to the node."""
    columns = [c for c in nodes.columns if c != "doc_id"]
    rows = path_rows(nodes, *columns)
    return rows.select("doc_id", F.explode("all").alias("p")).select(*["doc_id" if c == "doc_id" else F.col(f"p.own.{c}") for c in nodes.columns], "p.path")


def enclosing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each ``inner`` row (doc_id, start, end, ...) with ``outer_id``, the innermost of the
    ``outer`` intervals (doc_id, outer_id, start, end) that hold it, or null.

    Intervals nest, so the innermost holder is the last one to start that hasn't ended: rows of both
    sides are put in order of place and the open intervals are folded, per document.
    """
    i = inner.withColumn("_row", F.struct(*inner.columns))
    sides = i.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("outer_id"), "_row").unionByName(
        outer.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.lit(0).alias("side"), F.col("outer_id").cast("int").alias("outer_id")), allowMissingColumns=True
    )
    order = F.struct("s", (-F.col("e")).alias("e"), "side", "outer_id", "_row")
    group = sides.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    stack_type = "array<struct<e:int,outer_id:int>>"
    out_type = f"array<struct<outer_id:int,row:{i.schema['_row'].dataType.simpleString()}>>"

    def step(acc, x):
        kept = F.filter(acc["stack"], lambda s: s["e"] >= -x["e"])
        top = F.try_element_at(kept, F.lit(-1))
        out = F.when(x["side"] == 1, F.concat(acc["out"], F.array(F.struct(top["outer_id"].alias("outer_id"), x["_row"].alias("row"))))).otherwise(acc["out"])
        pushed = F.when(x["side"] == 0, F.concat(kept, F.array(F.struct((-x["e"]).cast("int").alias("e"), x["outer_id"].alias("outer_id"))))).otherwise(kept)
        return F.struct(pushed.cast(stack_type).alias("stack"), out.cast(out_type).alias("out"))

    start = F.struct(F.array().cast(stack_type).alias("stack"), F.array().cast(out_type).alias("out"))
    return group.select(F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("o")).select("o.row.*", "o.outer_id")
