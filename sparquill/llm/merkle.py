"""A Merkle manifest of a dataset: a hash per row, per group and of all, with a proof per row.

Levels are built by windows: rows of a level are partitioned by group and parent
index, and an ordered full-frame collect_list gives each row its run, from which come
the parent's preimage and the siblings; of each run the first row stays as the
parent. A parent keeps the rows below it with the siblings met so far, for LEVELS levels,
that is, FAN ** LEVELS rows at most; then it is written and the next levels start from
the written parents. All windows of one such stage share one shuffle, by group and block
of rows. Proofs are then completed from the top down: each stage's parents meet the
paths of the stage above by a join of parents, a 64th of the rows.

So a group with all rows of the table is spread over tasks like any other, and stages grow
with the logarithm of the largest group. Places in groups come from per-partition
totals (see numbering).

Digests are sha256. They are kept as bytes and hashed as lower-case hex text.

Defined results: null and repeated ids are rows like others, nulls first, ties ordered
by leaf, which makes them alike; null values hash as `-`; groups of one row have their
leaf as subroot; one group alone has its subroot as root; a proof without siblings is
empty; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.common import crc32_of, store
from sparquill.llm.numbering import number_rows

FAN = 2
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _nothing() -> Column:
    return F.lit(b"")


def _value(col: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value's text."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row's values, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(_value, values)), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _hash(digests: Column) -> Column:
    """The digest of digests that stand one after another as bytes."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _joined(run: Column) -> Column:
    return F.aggregate(run, _nothing(), lambda a, m: F.concat(a, m["h"]))


def _level(nodes: DataFrame, fan: int) -> DataFrame:
    """One level up: the first row of each run becomes the parent."""
    whole = Window.partitionBy("g", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = nodes.withColumn("parent", F.expr(f"idx div {fan}")).withColumn("run", F.collect_list(F.struct("idx", "h", "below")).over(whole))
    # a column of its own: inside a lambda, "c" would mean the new count of the select below
    parents = run.where(F.col("idx") == F.col("parent") * fan).withColumn("grows", F.col("c") > 1)
    grows = F.col("grows")

    def with_siblings(m: Column) -> Column:
        others = _joined(F.filter("run", lambda o: o["idx"] != m["idx"]))
        return F.transform(m["below"], lambda b: F.struct(b["row"].alias("row"), F.when(grows, F.concat(b["path"], others)).otherwise(b["path"]).alias("path")))

    return parents.select(
        "g", "block", F.col("parent").alias("idx"),
        F.when(grows, F.expr(f"(c + {fan - 1}) div {fan}")).otherwise(F.lit(1)).cast("long").alias("c"),
        F.when(grows, _hash(_joined(F.col("run")))).otherwise(F.col("h")).alias("h"),
        F.flatten(F.transform("run", with_siblings)).alias("below"),
    )


def _stage(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """`levels` levels in one shuffle: a row per block, with the rows below and their siblings inside the block."""
    nodes = nodes.withColumn("block", F.expr(f"idx div {fan**levels}")).repartition("g", "block")
    for _ in range(levels):
        nodes = _level(nodes, fan)
    return store(nodes.drop("block"), "merkle")


def build(nodes: DataFrame, largest: int, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """The stages of the trees over nodes (g, idx, c, h, row); the last has one row per group, its h the group's root.

    idx is the place in the group g, c the number of the group's rows, largest the largest c.
    """
    left = 0
    while fan**left < largest:
        left += 1
    stages: list[DataFrame] = []
    while left or not stages:
        row = F.struct("idx") if stages else F.col("row")
        below = F.array(F.struct(row.alias("row"), _nothing().alias("path"))).alias("below")
        upper = (stages[-1] if stages else nodes).select("g", "idx", "c", "h", below)
        stages.append(_stage(upper, fan, min(left, levels)))
        left -= min(left, levels)
    return stages


def paths(stages: list[DataFrame], top: DataFrame) -> DataFrame:
    """(g, row, path, and the columns of top but idx): the siblings of each row from its level up, and then those of top (g, idx = 0, path, ...)."""
    rest = [c for c in top.columns if c not in ("g", "idx", "path")]
    for stage in reversed(stages):
        upper = top.withColumnRenamed("path", "above")
        met = stage.select("g", "idx", "below").join(upper, ["g", "idx"])
        opened = met.select("g", F.explode("below").alias("b"), "above", *rest)
        top = opened.select("g", F.col("b.row").alias("row"), F.concat("b.path", "above").alias("path"), *rest)
        if stage is not stages[0]:
            top = top.select("g", F.col("row.idx").alias("idx"), "path", *rest)
    return top


def _fold(state: Column, path: Column, fan: int) -> Column:
    """Climb one tree: state (h, i, c, at) with h the digest at place i of c, at the bytes of path used."""
    steps = F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda n: F.pow(F.lit(float(fan)), n) < state["c"]))

    def up(s: Column, _: Column) -> Column:
        left = s["i"] % fan
        right = F.least(F.lit(fan), s["c"] - s["i"] + left) - 1 - left
        before = F.substring(path, s["at"] + 1, (left * 32).cast("int"))
        after = F.substring(path, (s["at"] + 1 + left * 32).cast("int"), (right * 32).cast("int"))
        return F.struct(
            _hash(F.concat(before, s["h"], after)).alias("h"),
            F.floor(s["i"] / fan).alias("i"),
            F.floor((s["c"] + (fan - 1)) / fan).alias("c"),
            (s["at"] + (left + right) * 32).cast("int").alias("at"),
        )

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), state, up)).otherwise(state)


def _state(h: Column, i: Column, c: Column, at: Column) -> Column:
    return F.struct(h.alias("h"), i.cast("long").alias("i"), c.cast("long").alias("c"), at.cast("int").alias("at"))


def fold(found: DataFrame, leaf: Column, fan: int = FAN) -> DataFrame:
    """The result of proofs with folded: the root that a leaf leads to along the row's path."""
    low = found.withColumn("low", _fold(_state(leaf, F.col("idx"), F.col("n_rows"), F.lit(0)), F.col("path"), fan))
    high = _fold(_state(F.col("low.h"), F.col("group_idx"), F.col("n_groups"), F.col("low.at")), F.col("path"), fan)
    return low.withColumn("folded", high["h"]).drop("low")


def proofs(rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """rows (g, key, leaf, payload) with idx, n_rows, group_idx, n_groups, path, subroot and root, digests as bytes.

    g is the group, a string without nulls whose order is the groups' order; payload, a struct, goes along.
    """
    placed = number_rows(rows, ["g", "key", "leaf"], group="g")
    nodes = placed.select("g", F.col("at").alias("idx"), F.col("n_rows").alias("c"), F.col("leaf").alias("h"), F.struct("at", "n_rows", "key", "leaf", "payload").alias("row"))
    nodes = store(nodes, "leaves")
    trees = build(nodes, nodes.agg(F.max("c")).first()[0] or 0, fan, levels)

    subroots = trees[-1].select("g", F.col("h").alias("subroot"))
    ranked = number_rows(subroots, ["g"])
    groups = ranked.select(F.lit("").alias("g"), F.col("at").alias("idx"), F.col("n_rows").alias("c"), F.col("subroot").alias("h"), F.struct("g", "subroot", F.col("at").alias("group_idx"), F.col("n_rows").alias("n_groups")).alias("row"))
    groups = store(groups, "subroots")
    tree = build(groups, groups.count(), fan, levels)
    crown = tree[-1].select("g", "idx", _nothing().alias("path"), F.col("h").alias("root"))
    tops = paths(tree, crown).select("row.*", "path", "root")

    every = paths(trees, store(tops.withColumn("idx", F.lit(0).cast("long")), "tops"))
    return every.select("g", "row.key", "row.leaf", F.col("row.at").alias("idx"), "row.n_rows", "group_idx", "n_groups", "path", "subroot", "root", "row.payload")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", key: str = "doc_id", tampered: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """Per row: its key, leaf, group's subroot, root and proof (siblings' hex digests, from the leaf up), and folded_root.

    folded_root comes from the row's leaf and proof; where `tampered` gives other values
    for some columns, from the leaf of those.
    """
    values = {c: F.col(c) for c in columns}
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    other = leaf_of(*(values | (tampered or {})).values())
    rows = docs.select(g.alias("g"), F.col(key).alias("key"), leaf_of(*values.values()).alias("leaf"), F.struct(other.alias("other")).alias("payload"))
    found = fold(proofs(rows, fan), F.col("payload.other"), fan)
    return found.select(F.col("key").alias(key), *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), _hex(F.col("path")).alias("proof"), _hex(F.col("folded")).alias("folded_root"))


def one_more_char(key: str = "doc_id", every: int = 7) -> dict[str, Column]:
    """Tampering for tests of a manifest: n_chars plus one in the rows whose key's crc32 `every` divides."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return {"n_chars": F.when(crc32_of(key) % every == 0, more.cast("string")).otherwise(F.col("n_chars").cast("string"))}
