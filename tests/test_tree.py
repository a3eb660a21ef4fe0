"""Tree operators against plain stacks on random input."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import tree

ITEMS = "doc_id string, seq int, line int, title string, type string, is_section boolean, depth int, metadata string"


def _random_items(docs, seed, blocks):
    r = random.Random(seed)
    out = []
    for d in range(docs):
        for i in range(r.randint(0, 25)):
            section = not blocks or r.random() < 0.7
            out.append((str(d), i * 2, i + 1, f"t{i}", "heading" if section else "block", section, r.randint(1, 6) if section else None, None))
    return out


def _stack(items, max_depth=None):
    """(doc_id, node_id, parent_id, depth, tree_depth), by a stack of open sections."""
    out, stacks, counts = [], {}, {}
    for doc_id, _, _, _, _, section, depth, _ in items:
        stack = stacks.setdefault(doc_id, [])
        own = depth if section else (stack[-1][0] if stack else 0) + 1
        if max_depth and own > max_depth:
            continue
        if section:
            while stack and stack[-1][0] >= own:
                stack.pop()
        node = counts[doc_id] = counts.get(doc_id, -1) + 1
        out.append((doc_id, node, stack[-1][1] if stack else None, own, len(stack) + 1))
        if section:
            stack.append((own, node))
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("max_depth", [None, 3])
def test_assembly(spark, blocks, max_depth):
    items = _random_items(80, 7 + blocks, blocks)
    df = spark.createDataFrame(items, ITEMS)
    # a block under a section that is cut off goes with it, so the stack keeps cut sections' depths
    want = _stack(items) if max_depth is None else None
    for plan in (lambda: tree.assemble(df, max_depth, 6), lambda: tree.assemble_unbounded(df, max_depth)):
        got = sorted(tuple(r) for r in plan().select("doc_id", "node_id", "parent_id", "depth", "tree_depth").collect())
        if want is not None:
            assert got == want
        elif not blocks:
            assert got == _stack(items, max_depth)
        assert all(r[3] <= (max_depth or 99) for r in got)


def test_paths(spark):
    nodes = tree.assemble(spark.createDataFrame(_random_items(40, 3, True), ITEMS), levels=6)
    rows = {(r.doc_id, r.node_id): r for r in tree.with_paths(nodes).collect()}
    for r in rows.values():
        up = rows[r.doc_id, r.parent_id].path if r.parent_id is not None else []
        assert r.path == [*up, r.title] and len(r.path) == r.tree_depth


def test_enclosing(spark):
    r = random.Random(5)
    outer, inner = [], []

    def nest(doc, a, b, depth):
        outer.append((doc, len(outer), a, b))
        at = a
        while depth and at < b - 4 and r.random() < 0.8:
            x = r.randint(at, b - 3)
            y = r.randint(x + 1, b)
            nest(doc, x, y, depth - 1)
            at = y

    for doc in "abc":
        nest(doc, 0, 400, 4)
        inner += [(doc, x := r.randint(0, 450), x + 1, f"{doc}{i}") for i in range(60)]
    got = tree.enclosing(spark.createDataFrame(inner, "doc_id string, start int, end int, name string"), spark.createDataFrame(outer, "doc_id string, outer_id int, start int, end int")).collect()
    assert len(got) == len(inner)
    for row in got:
        holders = [(b - a, -i, i) for d, i, a, b in outer if d == row.doc_id and a <= row.start and row.end <= b]
        assert row.outer_id == (min(holders)[2] if holders else None)


def test_renumber_and_filter(spark):
    nodes = tree.assemble(spark.createDataFrame(_random_items(20, 9, False), ITEMS), levels=6)
    cut = tree.renumber(tree.filter_depth(nodes, 2)).collect()
    by = {}
    for r in cut:
        by.setdefault(r.doc_id, set()).add(r.node_id)
    assert all(ids == set(range(len(ids))) for ids in by.values())
    assert all(r.parent_id is None or r.parent_id < r.node_id for r in cut)
    assert tree.filter_depth(nodes, 0) is nodes


def test_one_shuffle_for_assembly(spark):
    items = spark.createDataFrame(_random_items(5, 1, True), ITEMS)
    plan = tree.assemble(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert F.col("x") is not None
