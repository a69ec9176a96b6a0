"""Operator 3: n-gram Jaccard join as a blocked sparse matrix product of document by n-gram incidence.

Documents with one and the same set are one node.  The n-grams of all nodes are
brought together by block (a range of hashes), which gives each n-gram's document
frequency.  An n-gram that one node alone has makes no product, so a node needs only
its shared n-grams, rarest first, and how many others come before them.  Of that order
the first ``n - ceil(t * n) + 1`` enter the product: two sets that reach the similarity
``t`` have one of these in common.

The product of a block is a join of the incidence with itself on the n-gram; overlap
counts of a pair are added up over the blocks, and pairs are discarded by the bounds
that follow from their sizes and from the places of what they share:

    need = ceil(t / (1 + t) * (n_a + n_b))
    at one n-gram:   min(n_a - place_a, n_b - place_b) >= need
    over all blocks: count + min(n_a - 1 - last_a, n_b - 1 - last_b) >= need

What is left is counted exactly on the shared n-grams (as 64-bit hashes) of both sets.

A group of nodes that share an n-gram isn't expanded into all its pairs.  First each
node is paired with the group's hub, the node with the fewest rarer n-grams; that
links most copies, and components are settled.  Then, in groups of which some nodes
are still apart, those outside the group's largest component meet all nodes of other
components, so no link that joins two components is lost.

Nodes that share an n-gram ``CROWD`` times or more in one batch are sent as one list
for that n-gram, which goes to any task; its block gets their number alone.

Nulls and edge cases: a null or empty text, or one without words, has no n-grams and is
linked with nothing; fewer words than ``width`` are one n-gram; a null doc_id
takes part as a text, gets its component, and never names one unless all of the
component are null; repeated rows give one row each; empty tables give no rows;
other columns are ignored by ``join`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import group_released, hashed_words, release, released, shingles, small_batches, starts, written
from quarry.llm.components import components

WIDTH, PERCENT = 5, 75
#: Entries of the incidence that a block has on average.
BLOCK_ENTRIES = 700_000
#: So many nodes of a batch that share an n-gram are sent apart from its block.
CROWD = 8
SURVEY = {"kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "node": pa.int64(), "n": pa.int64(), "grams": pa.binary(), "owners": pa.binary(), "nodes": pa.binary()}
MET = {"kind": pa.int32(), "doc_id": pa.int64(), "key": pa.int64(), "node": pa.int64(), "n": pa.int64(), "gram": pa.int64(), "df": pa.int64(), "nodes": pa.binary()}
#: Kinds of rows: a document, entries of a block, the nodes of one crowded n-gram, numbers of crowded n-grams.
DOC, ENTRIES, LIST, NUMBER = range(4)


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'binary' if t == pa.binary() else 'long'}" for c, t in kinds.items())


def filled(kinds: dict[str, pa.DataType], rows: int, **columns) -> pa.RecordBatch:
    """A batch of so many rows; columns that aren't given are null, and a number stands for all rows."""
    made = [pa.nulls(rows, t) if c not in columns else pa.array(np.full(rows, columns[c])).cast(t) if isinstance(columns[c], int) else pa.array(columns[c]).cast(t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(made, names=list(kinds))


def row_key():
    """A row by its id and text: repeated rows share it."""
    return F.xxhash64("doc_id", "text").alias("key")


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, n = hashed_words(texts)
    at, whole = starts(n), shingles(words, width)
    out = []
    for k, m in enumerate(n.tolist()):
        if m >= width:
            out.append(np.unique(whole[at[k] : at[k] + m - width + 1]))
        else:
            out.append(shingles(words[at[k] : at[k] + m], m) if m else words[:0])
    return out


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)


def edges_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


def surveyed(docs: DataFrame, width: int, blocks: int, crowd: int) -> DataFrame:
    """One pass over the texts: a row per document, and the incidence of each batch packed by block."""

    def survey(batch):
        sets = sets_of(batch.column("text").to_pylist(), width)
        names = [node_of(g) if len(g) else None for g in sets]
        key = batch.column("key")
        yield filled(SURVEY, len(sets), kind=DOC, block=pc.bit_wise_and(key, (1 << 30) - 1).to_numpy() % blocks, doc_id=batch.column("doc_id"), key=key, node=pa.array(names, pa.int64()), n=[len(g) for g in sets])
        # A text that the batch holds many times enters once.
        own = {name: g for name, g in zip(names, sets, strict=True) if name is not None}
        if not own:
            return
        nodes, sets = np.array(list(own), np.int64), list(own.values())
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets])
        order = np.argsort(grams, kind="stable")
        at = edges_of(grams[order])
        length = np.diff(at)
        many = np.flatnonzero(length >= crowd)
        alone = np.ones(len(grams), bool)
        if len(many):
            among = [order[at[k] : at[k + 1]] for k in many.tolist()]
            alone[np.concatenate(among)] = False
            which = grams[order[at[many]]]
            yield filled(SURVEY, len(many), kind=LIST, block=block_of(which + nodes[:1].view(np.uint64), blocks), node=which.view(np.int64), nodes=[nodes[owner[x]].tobytes() for x in among])
            block = block_of(which, blocks)
            by = np.argsort(block, kind="stable")
            cut = edges_of(block[by])
            number = length[many].astype(np.uint32)
            yield filled(SURVEY, len(cut) - 1, kind=NUMBER, block=block[by][cut[:-1]], grams=[which[by[a:b]].tobytes() for a, b in zip(cut, cut[1:], strict=False)], owners=[number[by[a:b]].tobytes() for a, b in zip(cut, cut[1:], strict=False)])
        grams, owner = grams[alone], owner[alone]
        block = block_of(grams, blocks)
        by = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")
        grams, owner, block = grams[by], owner[by], block[by]
        rows = []
        for a, b in zip(cut := edges_of(block).tolist(), cut[1:], strict=False):
            # Entries of a block lie by node, so the numbers of nodes are small steps.
            here, count = np.unique(owner[a:b], return_counts=True)
            rows.append((int(block[a]), grams[a:b].tobytes(), zlib.compress(count.astype(np.uint32).tobytes(), 1), nodes[here].tobytes()))
        if rows:
            number, packed, owners, names = zip(*rows, strict=True)
            yield filled(SURVEY, len(rows), kind=ENTRIES, block=list(number), grams=list(packed), owners=list(owners), nodes=list(names))

    def run(batches):
        for batch in small_batches(batches, 5_000_000):
            yield from survey(batch)
            release()

    return docs.select("doc_id", "text", row_key()).mapInArrow(released(run), ddl(SURVEY))


def met(survey: DataFrame) -> DataFrame:
    """By block: (node, gram, df) of n-grams that two nodes or more have, df of crowded n-grams; documents and lists go through."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        of = lambda kind: rows.filter(pc.equal(rows["kind"], kind))
        read = lambda part, name, kind: np.frombuffer(b"".join(x.as_py() for x in part[name]), kind)
        docs, entries, lists, numbers = (of(k) for k in (DOC, ENTRIES, LIST, NUMBER))
        out = [filled(MET, docs.num_rows, kind=DOC, **{c: docs[c].combine_chunks() for c in ("doc_id", "key", "node", "n")})]
        out.append(filled(MET, lists.num_rows, kind=LIST, gram=lists["node"].combine_chunks(), nodes=lists["nodes"].combine_chunks()))
        count = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in entries["owners"]), np.uint32)
        grams, nodes = read(entries, "grams", np.uint64), np.repeat(read(entries, "nodes", np.int64), count)
        order = np.argsort(grams, kind="stable")
        grams, nodes = grams[order], nodes[order]
        # Copies of a text in several batches: few, since only n-grams found twice or more are put in order.
        same = grams[1:] == grams[:-1]
        crowded, add = read(numbers, "grams", np.uint64), read(numbers, "owners", np.uint32)
        twice = np.append(same, False) | np.append(False, same) if len(grams) else np.zeros(0, bool)
        if len(crowded):
            crowded, where = np.unique(crowded, return_inverse=True)
            add = np.bincount(where, add, len(crowded)).astype(np.int64)
            twice |= np.isin(grams, crowded)
        grams, nodes = grams[twice], nodes[twice]
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        once = np.append(True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1]))[: len(grams)]
        grams, nodes = grams[once], nodes[once]
        at = edges_of(grams)
        df, kinds = np.diff(at), grams[at[:-1]]
        if len(crowded):
            place = np.searchsorted(crowded, kinds)
            known = (place < len(crowded)) & (crowded[np.minimum(place, len(crowded) - 1)] == kinds)
            df[known] += add[place[known]]
            add[place[known]] = df[known]
            out.append(filled(MET, len(crowded), kind=NUMBER, gram=crowded.view(np.int64), df=add))
        df = np.repeat(df, np.diff(at))
        keep = df > 1
        out.append(filled(MET, int(keep.sum()), kind=ENTRIES, node=nodes[keep], gram=grams[keep].view(np.int64), df=df[keep]))
        return pa.Table.from_batches(out)

    return survey.groupBy("block").applyInArrow(group_released(run), ddl(MET))


def shared_sets(rows: DataFrame) -> DataFrame:
    """(node, n, grams): of each node that shares any, the number of all its n-grams, and its shared ones, rarest first."""

    def each(batches):
        for batch in batches:
            for gram, df, nodes in zip(*(batch.column(c).to_pylist() for c in ("gram", "df", "nodes")), strict=True):
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.frombuffer(nodes, np.int64)), "gram": pa.array(np.full(len(nodes) // 8, gram)), "df": pa.array(np.full(len(nodes) // 8, df))})

    entries = rows.where(F.col("kind") == ENTRIES).select("node", "gram", "df")
    numbers = rows.where(F.col("kind") == NUMBER).select("gram", "df")
    lists = rows.where(F.col("kind") == LIST).select("gram", "nodes").join(numbers, "gram").select("gram", "df", "nodes").mapInArrow(released(each), "node long, gram long, df long")
    sizes = rows.where((F.col("kind") == DOC) & F.col("node").isNotNull()).select("node", "n").distinct()
    null = F.lit(None).cast("long")
    both = entries.unionByName(lists).select("node", null.alias("n"), F.struct("df", "gram").alias("g")).unionByName(sizes.select("node", "n", F.lit(None).cast("struct<df:long,gram:long>").alias("g")))
    grouped = both.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("g")).alias("g")).where(F.size("g") > 0)
    return grouped.select("node", "n", F.col("g.gram").alias("grams"))


def need(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that reach the similarity."""
    return F.ceil((percent * (a + b)) / F.lit(100.0 + percent) - 1e-9)


def incidence(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, place) of the n-grams that enter the product; ``place`` is among all of the node's, those of its own first."""
    own = F.col("n") - F.size("grams")
    enter = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - own
    rows = sets.select("node", "n", own.alias("own"), F.posexplode(F.slice("grams", 1, F.greatest(enter, F.lit(0)).cast("int"))).alias("k", "gram"))
    return rows.select("gram", "node", "n", (F.col("own") + F.col("k")).alias("place"))


def _product(left: DataFrame, right: DataFrame, percent: int, apart) -> DataFrame:
    """(a, b, n_a, n_b) of pairs of rows that share n-grams: overlap counts added up, pairs below the bounds discarded."""
    x, y = left.select("gram", F.struct(*[c for c in left.columns if c != "gram"]).alias("x")), right.select("gram", F.struct(*[c for c in right.columns if c != "gram"]).alias("y"))
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met_ = x.join(y, (x["gram"] == y["gram"]) & apart & (room >= need(F.col("x.n"), F.col("y.n"), percent)))
    first = F.col("x.node") < F.col("y.node")
    side = lambda c, low: F.when(first if low else ~first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    pairs = met_.select(side("node", True).alias("a"), side("node", False).alias("b"), side("n", True).alias("n_a"), side("n", False).alias("n_b"), side("place", True).alias("p_a"), side("place", False).alias("p_b"))
    added = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("count"), F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"))
    more = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1
    return added.where(F.col("count") + more >= need(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity, counted on all shared n-grams."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    overlap = F.size(F.array_intersect("x", "y"))
    return both.withColumn("o", overlap).where(F.expr(f"100 * o >= {percent} * (n_a + n_b - o)")).select("a", "b")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_entries: int = BLOCK_ENTRIES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, key, n_shingles, group) of each row; documents of one group are linked, and group is null without n-grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, size // (7 * block_entries))
    rows = written(met(surveyed(docs, width, blocks, crowd)), "met")
    known = rows.where(F.col("kind") == DOC).select("doc_id", "key", F.col("n").alias("n_shingles"), "node")
    sets = written(shared_sets(rows), "sets")
    entries = written(incidence(sets, percent), "incidence")

    # Every node with its group's hub.
    hubs = entries.groupBy("gram").agg(F.min(F.struct("place", "n", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("gram", "hub.*")
    links = written(_verified(_product(entries, hubs, percent, F.col("x.node") != F.col("y.node")), sets, percent), "links")
    parts = components(links)

    # What is still apart.
    placed = written(entries.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "placed")
    main = placed.groupBy("gram", "part").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = placed.join(main.select("gram", "main"), "gram").withColumn("outside", F.col("part") != F.col("main")).drop("main")
    apart = (F.col("x.part") != F.col("y.part")) & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
    more = written(_verified(_product(open_.where("outside"), open_, percent, apart), sets, percent), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    group = F.coalesce("component", "node").alias("group")
    return known.join(parts, "node", "left").select("doc_id", "key", "n_shingles", group)


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    named = classes(docs, **options)
    least = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return named.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns kept; of repeated rows one stays."""
    named = written(classes(docs, **options), "classes")
    # Documents without n-grams are groups of their own.
    first = named.groupBy("group", F.when(F.col("group").isNull(), F.col("key")).alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("d"))
    kept = docs.join(first.select(F.col("d.key").alias("first_key")), F.xxhash64(docs["doc_id"], docs["text"]) == F.col("first_key"), "left_semi")
    rows, keys = named.agg(F.count("*"), F.count_distinct("key")).first()
    return kept if rows == keys else kept.dropDuplicates(["doc_id", "text"])
