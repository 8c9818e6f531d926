"""A Merkle manifest of a dataset: leaves of rows, a tree a source, a tree over the sources, proofs, and folding from kept hash states.

The leaves of a source are numbered by sorting all rows by range, so no
source is sorted in one task. They are cut into blocks of FAN ** LEVELS
consecutive leaves, which are whole subtrees; the tops of the blocks are the
leaves of the next round, until every source has one top, its subroot. The
subroots make one tree more. Then the way back sends each block what lies
above it, and the block's task folds every leaf to the root.

A parent keeps a copy of its hash state from before each child. To fold a
leaf is to take the copy before its slot, to go on with the replacement and
the siblings to the right only, and so on with the parent's slot: what lies
to the left is never hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.llm.columns import numbered, place
from orrery.plans.durable import cut

FAN = 3
LEVELS = 7
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROOT_TREE = "r"


def hashed(*fields: Column) -> Column:
    """SHA-256 of the fields, each - if null, else its UTF-8 byte count, a colon and its text (integers in decimal)."""
    said = []
    for f in fields:
        text = f.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


class Parent:
    """Children hashed one after another, with a copy of the state from before each."""

    __slots__ = ("before", "digest", "kids")

    def __init__(self, kids: list[bytes]):
        state, self.before, self.kids = hashlib.sha256(), [], kids
        for kid in kids:
            self.before.append(state.copy())
            state.update(kid)
        self.digest = state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.kids[:slot]), b"".join(self.kids[slot + 1 :])

    def fold(self, slot: int, kid: bytes) -> bytes:
        return resumed(self.before[slot], kid, b"".join(self.kids[slot + 1 :]))


def resumed(state, kid: bytes, right: bytes) -> bytes:
    """The digest of a parent from its state before a child's slot, the child and what stands to the right."""
    state = state.copy()
    state.update(kid)
    state.update(right)
    return state.hexdigest().encode()


class Subtree:
    """The parents over consecutive nodes, level by level: LEVELS of them, or fewer if the first block of a tree is not full."""

    def __init__(self, digests: list[bytes], block: int):
        whole = block > 0 or len(digests) == BLOCK
        self.levels: list[list[Parent]] = []
        while len(digests) > 1 or whole and len(self.levels) < LEVELS:
            parents = [Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
            self.levels.append(parents)
            digests = [p.digest for p in parents]
        self.top = digests[0]

    def path(self, at: int) -> tuple[list[bytes], list[bytes]]:
        """Left and right siblings of a node and of those above it, in this block."""
        lefts, rights = [], []
        for parents in self.levels:
            left, right = parents[at // FAN].siblings(at % FAN)
            lefts.append(left)
            rights.append(right)
            at //= FAN
        return lefts, rights

    def fold(self, at: int, digest: bytes) -> bytes:
        for parents in self.levels:
            digest = parents[at // FAN].fold(at % FAN, digest)
            at //= FAN
        return digest


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """Tree, block and rows of each block, across Arrow's batches; the rows come in order."""
    held, key = [], None
    for batch in batches:
        tree, block = batch.column("tree"), batch.column("block")
        n = batch.num_rows
        if not n:
            continue
        other = pc.or_(pc.not_equal(tree.slice(1), tree.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        for a, b in pairwise([0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]):
            now = (tree[a].as_py(), block[a].as_py())
            if held and now != key:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


def _together(rows: Iterator[list], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of at least a block's rows out of lists of rows."""
    held: list = []
    for some in rows:
        held += some
        if len(held) >= BLOCK:
            yield _batch(held, names, kinds)
            held = []
    if held:
        yield _batch(held, names, kinds)


def _batch(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _blocks(rows: DataFrame) -> DataFrame:
    """Whole blocks of FAN ** LEVELS nodes in one task each, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _numbered_within(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with pos, their number within their tree, and the size of the largest tree.

    Rows are sorted by range; only the first tree of a partition can have
    begun in an earlier one, so a number a partition is all that must be known.
    """
    kept = rows.columns
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    held = cut(ranges.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = held.groupBy(part, "tree").agg(F.count("*").alias("n")).groupBy("part")
    named = (F.min("tree").alias("first"), F.max("tree").alias("last"), F.min_by("n", "tree").alias("head"), F.max_by("n", "tree").alias("tail"), F.max("n").alias("most"))
    before: dict[int, int] = {}
    tree, run, most = None, 0, 0
    # a row a partition, whatever the number of rows
    for r in sorted(sizes.agg(*named).collect(), key=lambda r: r["part"]):
        before[r["part"]] = earlier = run if r["first"] == tree else 0
        run = r["tail"] + (earlier if r["first"] == r["last"] else 0)
        most = max(most, earlier + r["head"], run, r["most"])
        tree = r["last"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, after = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column("tree")
            if after is None:
                after = before[batch.column("at")[0].as_py() >> 33]
            elif own[0].as_py() != tree:
                after = 0
            other = np.flatnonzero(pc.not_equal(own.slice(1), own.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate(([0], other))
            pos = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            pos[: starts[1] if len(starts) > 1 else n] += after
            tree, after = own[n - 1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(pos // BLOCK), pa.array(pos)], names=[*kept, "block", "pos"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema)
    return held.mapInArrow(number, f"{kinds}block long, pos long"), most


def _tops(nodes: DataFrame) -> DataFrame:
    """tree, block, pos and digest of the top of each block of nodes (tree, block, pos, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([(tree, block // BLOCK, block, Subtree(_bytes(of, "digest"), block).top.decode())] for tree, block, of in _groups(batches))
        return _together(rows, ["tree", "block", "pos", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    return _blocks(nodes.select("tree", "block", "pos", "digest")).mapInArrow(run, "tree string, block long, pos long, digest string")


def _bytes(rows: pa.Table, name: str) -> list[bytes]:
    return rows.column(name).cast(pa.binary()).to_pylist()


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of these, until every tree has one."""
    tables = [nodes]
    while most > 1:
        tables.append(cut(_tops(tables[-1])))
        most = -(-most // BLOCK)
    return tables


_LINES = pa.list_(pa.string())


def _text(parts: list[bytes]) -> list[str]:
    return [p.decode() for p in parts]


def _below(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, block, pos, digest, subroot, root, lefts and rights of nodes, from those of the tops of their blocks."""
    heads = tops.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), "subroot", "root", "lefts", "rights")
    rows = _blocks(heads.unionByName(nodes.select("tree", "block", "pos", "digest"), allowMissingColumns=True))

    def paths(block: int, of: pa.Table) -> list:
        head, rest = of.slice(0, 1).to_pylist()[0], of.slice(1)
        digests = _bytes(rest, "digest")
        tree = Subtree(digests, block)
        out = []
        for i, digest in enumerate(digests):
            lefts, rights = tree.path(i)
            out.append((head["tree"], block // BLOCK, 0, digest.decode(), head["subroot"], head["root"], _text(lefts) + head["lefts"], _text(rights) + head["rights"]))
        at = rest.column("pos").to_pylist()
        return [(t, p // BLOCK, p, *others) for p, (t, _, _, *others) in zip(at, out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int64()
        return _together((paths(block, of) for _, block, of in _groups(batches)), names, [text, number, number, text, text, text, _LINES, _LINES])

    names = ["tree", "block", "pos", "digest", "subroot", "root", "lefts", "rights"]
    return rows.mapInArrow(run, "tree string, block long, pos long, digest string, subroot string, root string, lefts array<string>, rights array<string>")


def _folded(tops: DataFrame, leaves: DataFrame) -> DataFrame:
    """Every leaf with its proof, and the root that its claimed digest folds to."""
    head = ("subroot", "root", "lefts", "rights")
    heads = tops.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *head)
    rows = _blocks(heads.unionByName(leaves, allowMissingColumns=True))

    def proofs(block: int, of: pa.Table) -> list:
        above, rest = of.slice(0, 1).to_pylist()[0], of.slice(1)
        digests, claims, ids = _bytes(rest, "digest"), _bytes(rest, "claimed"), rest.column("id").to_pylist()
        tree = Subtree(digests, block)
        upper = [(hashlib.sha256(left.encode()), right.encode()) for left, right in zip(above["lefts"], above["rights"], strict=True)]
        out = []
        for i, (digest, claimed) in enumerate(zip(digests, claims, strict=True)):
            folded = tree.fold(i, claimed)
            for state, right in upper:
                folded = resumed(state, folded, right)
            lefts, rights = tree.path(i)
            out.append((ids[i], digest.decode(), above["subroot"], above["root"], _text(lefts) + above["lefts"], _text(rights) + above["rights"], folded.decode()))
        return out

    arrow = to_arrow_type(leaves.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        return _together((proofs(block, of) for _, block, of in _groups(batches)), names, [arrow, text, text, text, _LINES, _LINES, text])

    names = ["id", "leaf", "subroot", "root", "lefts", "rights", "folded_root"]
    return rows.mapInArrow(run, f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, lefts array<string>, rights array<string>, folded_root string")


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changed: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
) -> DataFrame:
    """The id, leaf, subroot, root, lefts, rights, folded_root and verified of every row of docs.

    leaf is the digest of a row's fields. changed takes the fields by name and
    gives those of the row to be verified in its place (by default the same).
    lefts and rights are the proof: per level from the leaf to the root the
    siblings before and after, hex digests without a separator. folded_root is
    what the changed row and the proof give; verified, whether it is the root.

    Rows of a source ascend by id (nulls first; equal ids by leaf, equal rows
    in any order, as their digests are the same), sources by their UTF-8 bytes
    (null first, an empty one apart from it). Repeated rows are leaves of
    their own. Texts are of any length that a task can hold. Further columns,
    whatever their names, are left out. An empty table gives an empty result.
    """
    of = numbered(docs)
    held = {f: F.col(place(docs, f)) for f in fields}
    leaf = hashed(*held.values())
    claimed = hashed(*changed(held).values()) if changed else leaf
    tree = F.coalesce(F.concat(F.lit("v"), F.col(place(docs, group_col)).cast("string")), F.lit("n"))
    rows = cut(of.select(F.col(place(docs, id_col)).alias("id"), tree.alias("tree"), leaf.alias("digest"), claimed.alias("claimed")))
    leaves, most = _numbered_within(rows, ["id", "digest"])
    tables = _climb(leaves, most)
    subroots = tables[-1].select(F.lit(_ROOT_TREE).alias("tree"), F.col("tree").alias("name"), "digest")
    listed, sources = _numbered_within(subroots, ["name"])
    upper = _climb(listed, sources)
    empty = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "block", "pos", "digest", F.col("digest").alias("subroot"), F.col("digest").alias("root"), empty.alias("lefts"), empty.alias("rights"))
    for nodes in reversed(upper[:-1]):
        paths = _below(paths, nodes)
    named = listed.select("pos", "name").join(paths.select("pos", "digest", "root", "lefts", "rights"), "pos")
    paths = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "lefts", "rights")
    for nodes in reversed(tables[1:-1]):
        paths = _below(paths, nodes)
    out = _folded(paths, leaves)
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "lefts", "rights", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_ends(fields: dict[str, Column]) -> dict[str, Column]:
    """A row of documents whose text lost its line ends, where the CRC of its id is even; else as it is."""
    even = F.coalesce(F.crc32(fields["doc_id"].cast("string")) % 2 == 0, F.lit(False))
    return fields | {"text": F.when(even, F.replace(fields["text"], F.lit("\n"), F.lit(""))).otherwise(fields["text"])}


def digests(proofs: DataFrame) -> DataFrame:
    """The rows with proof_sha256, the digest of all siblings from the leaf to the root, each level's from left to right."""
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    said = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(said)})"


def _sql_tree(name: str, leaves: str) -> str:
    return f"""{name}(k, lev, pos, digest) AS ({leaves}
  UNION ALL SELECT k, lev + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {name}) WHERE n > 1 GROUP BY k, lev, pos // {FAN})"""


def _sql_sides(name: str) -> str:
    return f"""SELECT c.k, c.pos, c.lev, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < c.pos), '') AS l,
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > c.pos), '') AS r
  FROM {name} AS c LEFT JOIN {name} AS s ON s.k = c.k AND s.lev = c.lev AND s.pos // {FAN} = c.pos // {FAN} AND s.pos <> c.pos
  WHERE c.lev < (SELECT max(lev) FROM {name} AS t WHERE t.k = c.k) GROUP BY ALL"""


#: CRC-32 of the decimal id, bit by bit: a byte is taken in, then eight shifts (the polynomial is a fixed value).
_SQL_CRC = """list_reduce(list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""

ORACLE_SQL = f"""WITH RECURSIVE docs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, coalesce('v' || source, 'n') AS k, {_sql_leaf("text")} AS leaf,
      CASE WHEN {_SQL_CRC} % 2 = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS claimed FROM documents)),
{_sql_tree("low", "SELECT k, 0, pos, leaf FROM docs")},
tops AS MATERIALIZED (SELECT k, arg_max(digest, lev) AS subroot, max(lev) AS height, row_number() OVER (ORDER BY k) - 1 AS place FROM low GROUP BY k),
{_sql_tree("high", "SELECT 'r', 0, place, subroot FROM tops")},
sides AS MATERIALIZED ({_sql_sides("low")}), over AS MATERIALIZED ({_sql_sides("high")}),
steps AS MATERIALIZED (
  SELECT d.k, d.pos, s.lev, s.l, s.r FROM docs AS d JOIN sides AS s ON s.k = d.k AND s.pos = d.pos // CAST(pow({FAN}, s.lev) AS BIGINT)
  UNION ALL SELECT d.k, d.pos, t.height + o.lev, o.l, o.r FROM docs AS d JOIN tops AS t ON t.k = d.k JOIN over AS o ON o.pos = t.place // CAST(pow({FAN}, o.lev) AS BIGINT)),
fold(k, pos, lev, digest) AS (SELECT k, pos, 0, claimed FROM docs
  UNION ALL SELECT f.k, f.pos, f.lev + 1, sha256(s.l || f.digest || s.r) FROM fold AS f JOIN steps AS s ON s.k = f.k AND s.pos = f.pos AND s.lev = f.lev),
ends AS (SELECT k, pos, arg_max(digest, lev) AS folded_root FROM fold GROUP BY k, pos),
told AS (SELECT k, pos, sha256(string_agg(l || r, '' ORDER BY lev)) AS proof FROM steps GROUP BY k, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM docs JOIN tops USING (k) JOIN ends USING (k, pos) LEFT JOIN told USING (k, pos), (SELECT arg_max(digest, lev) AS root FROM high)"""
