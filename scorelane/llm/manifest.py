"""Merkle manifest of a table of documents, with a proof for every row.

Leaves lie in branches (one per ``lang``), in the order of ``doc_id``. The nodes of
all branches form one table per level, keyed by branch and place. On each level the
nodes are joined to themselves at the place of their sibling: with a fan-out of two
that is the place with its last bit turned, else the other slots of the run, as
shifted offsets. The nodes in slot zero, which then know their whole run, emit the
parents. A level has half as many rows as the one below it, and keys are unique, so
no join has a hot key, however large a branch is. The roots of the branches are the
leaves of a tree of the same kind.

Proofs go down the same way: a node's proof is its siblings and its parent's proof,
so each level is joined once to the one above it. A proof is packed into one binary
value; which of a node's siblings stand before it follows from its place and from the
number of leaves in its branch.

Digests are given as lowercase hex, and are concatenated so.

Defined results: nulls are ``-`` in a leaf; a null ``lang`` is the first branch; a
null ``doc_id`` comes before all others; rows of equal ``doc_id`` (ties, repeated
rows) lie in the order of their leaves; empty texts have length 0, and texts of any
length are hashed whole inside the JVM; an empty table gives no rows. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import ROW_KEY, identified, staged
from scorelane.llm.order import PLACE, numbered
from scorelane.session import few

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Documents whose id has a checksum that this divides are tampered with.
TAMPERED = 7

_HEX = 64


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field_text(value: Column) -> Column:
    """A value as it stands in a leaf: its UTF-8 bytes' count and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return _sha(F.concat(*(field_text(v) for v in values)))


def leaves(documents: DataFrame) -> DataFrame:
    """A row per document: ``branch``, ``doc_id``, its leaf and the leaf it has once tampered with."""
    rows = identified(documents.select(*FIELDS), "manifest-input")
    columns = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("branch"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(columns).alias("leaf"),
        F.when(chosen & F.col("n_chars").isNotNull(), leaf_digest(changed)).alias("altered"),
        ROW_KEY,
    )


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes (``branch``, ``place``, ``digest``) with the digests ``before`` and ``after`` them in their run."""
    known = nodes.select(F.col("branch").alias("b"), F.col("place").alias("p"), F.col("digest").alias("other"))
    empty = F.unhex(F.lit(""))
    if fanout == 2:
        beside = nodes["place"].bitwiseXOR(F.lit(1))
        joined = nodes.join(known, (nodes["branch"] == known["b"]) & (beside == known["p"]), "left")
        other, even = F.coalesce("other", empty), F.col("place") % 2 == 0
        return joined.select(
            *nodes.columns,
            F.when(even, empty).otherwise(other).alias("before"),
            F.when(even, other).otherwise(empty).alias("after"),
        )
    slot = F.col("place") % fanout
    shifted = nodes.select(
        "branch", "place", F.explode(F.sequence(F.lit(1), F.lit(fanout - 1))).alias("shift")
    ).withColumn("beside", F.col("place") - slot + (slot + F.col("shift")) % fanout)
    met = shifted.join(known, (shifted["branch"] == known["b"]) & (shifted["beside"] == known["p"]))

    def side(wanted: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(wanted, F.struct("beside", "other"))))
        return F.unhex(F.array_join(F.transform(found, lambda x: F.hex(x["other"])), ""))

    sides = met.groupBy("branch", "place").agg(
        side(F.col("beside") < F.col("place")).alias("before"), side(F.col("beside") > F.col("place")).alias("after")
    )
    joined = nodes.join(sides, ["branch", "place"], "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("before", "after")})


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The parents of a level's nodes with their siblings, out of the nodes in slot zero."""
    run = _hex(F.concat("digest", "after"))
    return level.where(F.col("place") % fanout == 0).select(
        "branch", F.floor(F.col("place") / fanout).alias("place"), _sha(run).alias("digest")
    )


def tree(nodes: DataFrame, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all branches' trees, each with siblings, as stages; the last are the roots.

    Roots of smaller trees end on a lower level, where they are alone in their branch.
    """
    levels, now = [], nodes
    while True:
        level = staged(with_siblings(now, fanout), f"{name}-level")
        levels.append(level)
        if level.where(F.col("place") > 0).isEmpty():
            return levels
        # Alone in its branch: a root, which has no parent.
        others = level.where((F.col("place") > 0) | (F.length("after") > 0))
        now = parents(others, fanout)


def roots(levels: list[DataFrame]) -> DataFrame:
    """``branch`` and ``digest`` of each tree's root."""
    alone = (F.col("place") == 0) & (F.length("after") == 0)
    return _union([level.where(alone).select("branch", "digest") for level in levels])


def proofs(levels: list[DataFrame], name: str, above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """``branch``, ``place`` and ``proof`` of the lowest level's nodes.

    ``above`` has the proofs of the branches' roots in a higher tree.
    """
    empty = F.unhex(F.lit(""))
    known = None
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number].withColumn("own", F.concat("before", "after"))
        root = (F.col("place") == 0) & (F.length("after") == 0)
        top = level.where(root).select("branch", "place")
        if above is None:
            top = top.withColumn("proof", empty)
        else:
            top = top.join(above, "branch")
        if known is None:
            known = top
        else:
            upper = known.select(F.col("branch").alias("b"), F.col("place").alias("p"), "proof")
            inner = level.where(~root)
            up = F.floor(inner["place"] / fanout)
            inner = inner.join(upper, (inner["branch"] == upper["b"]) & (up == upper["p"]))
            known = top.unionByName(inner.select("branch", "place", F.concat("own", "proof").alias("proof")))
        known = staged(known, f"{name}-proof") if number else known
    return known


def folded(digest: Column, proof: Column, path: Column, fanout: int = FANOUT) -> Column:
    """The root that follows from ``digest`` and its ``proof``.

    ``path`` is an array of (place, count) pairs, one for each tree from the lowest
    up: where the node lies among the tree's ``count`` leaves.
    """

    def climb(state: Column, tree_path: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(tree_path["count"].cast("double"))) + 2))
        start = F.struct(
            state["digest"].alias("digest"), state["at"].alias("at"),
            tree_path["place"].alias("place"), tree_path["count"].alias("count"),
        )

        def step(now: Column, _: Column) -> Column:
            slot = now["place"] % fanout
            beside = F.least(F.lit(fanout).cast("long"), now["count"] - now["place"] + slot) - 1
            before = F.substring(proof, now["at"], slot * _HEX)
            after = F.substring(proof, now["at"] + slot * _HEX, (beside - slot) * _HEX)
            up = F.struct(
                F.sha2(F.concat(before, now["digest"], after), 256).alias("digest"),
                (now["at"] + beside * _HEX).alias("at"),
                F.floor(now["place"] / fanout).alias("place"),
                F.ceil(now["count"] / fanout).alias("count"),
            )
            return F.when(now["count"] > 1, up).otherwise(now)

        return F.aggregate(steps, start, step, lambda s: F.struct(s["digest"].alias("digest"), s["at"].alias("at")))

    start = F.struct(digest.alias("digest"), F.lit(1).cast("long").alias("at"))
    return F.aggregate(path, start, climb, lambda s: s["digest"])


def manifest(documents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row per document: its leaf, subroot, root, proof, and whether it still verifies.

    ``folded_root`` is computed from the altered leaf, if there is one, and the
    siblings of the untampered tree. ``place`` and ``n_leaves`` locate the leaf.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    found = staged(leaves(documents), "manifest-leaves")
    placed = numbered(found, "branch", ["doc_id", "leaf", ROW_KEY], "manifest-places").drop(ROW_KEY)
    levels = tree(placed.select("branch", PLACE, F.col("leaf").alias("digest")), "manifest", fanout)
    counts = placed.groupBy("branch").agg(F.count(F.lit(1)).alias("n_leaves"))
    subroots = staged(roots(levels).join(counts, "branch"), "manifest-subroots")

    # The tree of the branches: all of them are leaves of one branch.
    one = subroots.select(F.lit("all").alias("branch"), F.col("branch").alias("name"), "digest")
    ranked = staged(numbered(one, "branch", ["name"], "manifest-branches"), "manifest-ranked")
    upper = tree(ranked.select("branch", PLACE, "digest"), "manifest-top", fanout)
    over = proofs(upper, "manifest-top", fanout=fanout).withColumnRenamed("proof", "over")
    named = ranked.select(F.col("name").alias("branch"), PLACE, F.col("digest").alias("subroot"))
    top = roots(upper).select(F.col("digest").alias("root"))
    total = ranked.agg(F.count(F.lit(1)).alias("n_branches"))
    above = over.drop("branch").join(named, PLACE).withColumnRenamed(PLACE, "rank")
    about = few(
        above.join(subroots.select("branch", "n_leaves"), "branch").join(F.broadcast(top)).join(F.broadcast(total)),
        "manifest-about",
    )
    paths = proofs(levels, "manifest", about.select("branch", F.col("over").alias("proof")), fanout)
    rows = placed.join(paths, ["branch", PLACE]).join(about, "branch")
    told = _hex(F.coalesce("altered", "leaf"))
    proof = _hex(F.col("proof"))
    steps = F.array(
        F.struct(F.col(PLACE).alias("place"), F.col("n_leaves").alias("count")),
        F.struct(F.col("rank").alias("place"), F.col("n_branches").alias("count")),
    )
    checked = rows.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        folded(told, proof, steps, fanout).alias("folded_root"),
        PLACE,
        "n_leaves",
        proof.alias("proof"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _union(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found
