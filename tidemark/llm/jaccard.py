"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

The overlaps wanted are entries of D x D', D being the document by n-gram incidence matrix. It is multiplied block
by block, a block being a range of n-grams: in each block, documents that share an n-gram meet, their counts
add up, and pairs that cannot reach the bound are discarded. The bounds come from sizes: |a| and |b| must be
within 4:3, an overlap of ceil(3 (|a| + |b|) / 7) is needed, and only the first |a| - ceil(3 |a| / 4) + 1 columns of a
document, in one global order, have to be multiplied to meet every possible partner; a pair that first meets at
places i and j of its rows can share no more than 1 + min(|a| - 1 - i, |b| - 1 - j). The order puts n-grams
that recur last, by counts taken over all documents, so that shared passages rarely meet. Survivors are
verified by their whole rows: exact overlap, exact bound.

The overlap is not accumulated over all columns: beyond a document's first columns lie those that recur most, whose products
are most of the work and would only complete counts of pairs that the first columns have already named. Their part is
multiplied for the survivors alone, as the intersection of the two whole rows.

Rows with equal sets are one node. A column with up to `SHORT` nodes yields all its pairs. A longer one
first yields pairs with one leader only, the row in which it comes first; once these are verified and connected,
it yields the pairs of nodes that are still in different components, in blocks of bounded size, so nothing that could join
components is left out and a large group of near copies costs no square of its size. A column that more than `HEAVY` rows hold
is dealt over several blocks of the product by node, with a leader in each.

Nodes and shingles are 64-bit hashes; among n distinct sets n**2 / 2**65 pairs are expected to be taken for equal.

Defined results: null, empty and wordless texts have no shingle, link with nothing and keep their own id as component; fewer
than five words are one shingle; repeated rows link through their equal sets; a null id never names a
component unless it is alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, chunks, give_back, partitions, scratch, small_batches, thrifty
from tidemark.llm.components import components
from tidemark.llm.kernels import U, mix, shingles

PERCENT = 75
SHORT = 8
FLUSH = 500_000
RECUR = 2
HOT_LEAST, HOT_MOST = 4, 1 << 20
BLOCK_POSTINGS = 1_000_000
SEGMENT_LEAST, SEGMENT_MOST = 512, 8192
HEAVY = 100_000
BROADCAST_IDS = 1_000_000
POSTING = np.dtype([("gram", "<u4"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4"), ("heavy", "u1")])


def needed(n, m):
    """The least overlap with which sets of n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix_length(n):
    return n - -(-PERCENT * n // 100) + 1


def row_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct shingles."""
    row, h = shingles(data, offsets)
    cut = np.searchsorted(row, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def node_of(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(own + U(0x2545F4914F6CDD1D)).sum(keepdims=True) + U(len(own)))[0].astype(np.int64))


def _survey(docs: DataFrame) -> Stored:
    """A row (rowno, doc_id, n, node) for each document, and rows with n-grams that recur (grams, counts) without these."""
    schema = "rowno long, doc_id long, n long, node long, grams binary, counts binary"
    names = ["rowno", "doc_id", "n", "node", "grams", "counts"]

    def run(batches):
        held, seen, size = [], set(), 0

        def flush():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= RECUR
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([grams[often].tobytes()], pa.binary()), pa.array([counts[often].astype(np.int64).tobytes()], pa.binary())], names)

        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row0, data, offsets in chunks(batch, "text"):
                for i, own in enumerate(row_sets(data, offsets)):
                    if len(own):
                        n[row0 + i], node[row0 + i] = len(own), node_of(own)
                        if node[row0 + i] not in seen:
                            seen.add(int(node[row0 + i]))
                            held.append(own)
                            size += len(own)
                if size > FLUSH:
                    yield flush()
                    held, seen, size = [], set(), 0
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rowno"), batch.column("doc_id"), pa.array(n), pa.array(node, mask=n == 0), none, none], names)
        if held:
            yield flush()

    return Stored(docs.mapInArrow(thrifty(run), schema))


def _hot(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that recur most and their counts, sorted by n-gram; at most HOT_MOST. They only settle an order."""

    def spread(batches):
        for batch in batches:
            for g, c in zip(batch.column("grams"), batch.column("counts")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], ["gram", "count"])

    rows = survey.where("grams is not null").select("grams", "counts").mapInArrow(thrifty(spread), "gram long, count long")
    top = rows.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "gram").limit(HOT_MOST)
    found = top.toArrow()
    gram = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    out = gram[order], found.column("count").to_numpy()[order]
    del found, gram, order
    give_back()
    return out


def _postings(docs: DataFrame, hot, blocks: int) -> DataFrame:
    """(block, postings): each document's first columns in the global order, packed by block of columns."""
    shared, heavy = docs.sparkSession.sparkContext.broadcast(hot), HEAVY

    def run(batches):
        grams, counts = shared.value
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            g, node, n, at, parts = (np.concatenate(c) for c in zip(*held))
            part = mix(node.view(np.uint64) ^ U(0x6A09E667F3BCC909)) % parts.astype(np.uint64)
            block = (((g >> U(32)) + part) % U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            packed = np.empty(len(g), POSTING)
            packed["gram"], packed["node"], packed["size"], packed["at"], packed["heavy"] = (g & U(0xFFFFFFFF))[order], node[order], n[order], at[order], (parts > 1)[order]
            block = block[order]
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]].astype(np.int32)), pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["block", "postings"])

        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                for own in row_sets(data, offsets):
                    if not len(own):
                        continue
                    node = node_of(own)
                    if node in seen:  # an equal set has been sent by this task
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    p = prefix_length(len(own))
                    count = np.zeros(len(own), np.int64)
                    if len(grams):
                        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                        count = np.where(grams[at] == own, counts[at], 0)
                        order = np.argsort(count, kind="stable")
                        own, count = own[order], count[order]
                    size += p
                    held.append((own[:p], np.full(p, node), np.full(p, len(own), np.uint32), np.arange(p, dtype=np.uint32), 1 + count[:p] // heavy))
                if size > FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(thrifty(run), "block int, postings binary")


def _may_link(n, m, i, j):
    n, m, i, j = (np.asarray(x, np.int64) for x in (n, m, i, j))
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (1 + np.minimum(n - 1 - i, m - 1 - j) >= needed(n, m))


def multiply(p: np.ndarray):
    """One block of columns: (pairs: node, node, size, size; how often they met; whether they may link by some
    meeting) (long columns: gram, node, size, place), and how many short columns each node shares. All meetings of a short
    column count."""
    p = p[np.lexsort((p["at"], p["node"], p["gram"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["gram"][1:] != p["gram"][:-1]) | (p["node"][1:] != p["node"][:-1])
    p = p[new]
    start = np.flatnonzero(np.append(True, p["gram"][1:] != p["gram"][:-1])) if len(p) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(p)))
    own = np.repeat(length, length)
    some = (own > 1) | (p["heavy"] > 0)
    p, own = p[some], own[some]
    few = p[(own <= SHORT) & (p["heavy"] == 0)]
    met, open_ = [np.zeros((0, 4), np.int64)], [np.zeros(0, bool)]

    def add(a, b, all_meetings):
        n, m = a["size"].astype(np.int64), b["size"].astype(np.int64)
        may = _may_link(n, m, a["at"], b["at"])
        keep = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m) if all_meetings else may
        swap = a["node"] > b["node"]
        x, y = np.where(swap, b["node"], a["node"]), np.where(swap, a["node"], b["node"])
        met.append(np.stack([x, y, np.where(swap, m, n), np.where(swap, n, m)], 1)[keep])
        open_.append(may[keep])

    for d in range(1, SHORT):
        if len(few) <= d:
            break
        same = few["gram"][d:] == few["gram"][:-d]
        if not same.any():
            break
        add(few[:-d][same], few[d:][same], True)
    long = p[(own > SHORT) | (p["heavy"] > 0)]
    if len(long):
        order = np.lexsort((long["node"], long["at"], long["gram"]))
        head = np.append(True, long["gram"][1:] != long["gram"][:-1])
        size = np.diff(np.append(np.flatnonzero(head), len(long)))
        leader = np.repeat(long[order][head], size)
        other = leader["node"] != long["node"]
        add(leader[other], long[other], False)
    pairs, at, counts = np.unique(np.concatenate(met), axis=0, return_inverse=True, return_counts=True)
    may = np.bincount(at.ravel(), weights=np.concatenate(open_), minlength=len(pairs)) > 0
    return pairs, counts, may, long, np.unique(few["node"], return_counts=True)


def _products(postings: DataFrame) -> DataFrame:
    """kind 0: nodes x, y of n and m shingles that met c times, may: at a place from where they can link. kind 1: node y, of n shingles, has long column x at place m.
    kind 2: node y shares c short columns."""

    def run(key, table):
        p = np.concatenate([np.frombuffer(b.as_py(), POSTING) for b in table.column("postings")])
        pairs, counts, may, long, (sharing, shared) = multiply(p)
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(pairs), len(long), len(sharing)])
        none = np.zeros(len(sharing), np.int64)
        column = long["gram"].astype(np.int64) | np.where(long["heavy"] > 0, np.int64(-1), np.int64(key[0].as_py())) << np.int64(32)
        return pa.table(
            {
                "kind": kind,
                "x": np.concatenate([pairs[:, 0], column, none]),
                "y": np.concatenate([pairs[:, 1], long["node"], sharing]),
                "c": np.concatenate([counts, np.zeros(len(long), np.int64), shared]),
                "n": np.concatenate([pairs[:, 2], long["size"].astype(np.int64), none]),
                "m": np.concatenate([pairs[:, 3], long["at"].astype(np.int64), none]),
                "may": np.concatenate([may, np.zeros(len(long) + len(none), bool)]),
            }
        )

    return postings.groupBy("block").applyInArrow(run, "kind int, x long, y long, c long, n long, m long, may boolean")


def _reachable(pairs: DataFrame, longs: DataFrame) -> DataFrame:
    """The pairs (x, y, c, n, m) that can reach the overlap they need. c counts the first columns they met in; they may
    share as many long ones as both have, uncounted, and beyond the first columns no more than a row has left."""
    a, b = longs.select(F.col("node").alias("x"), F.col("long").alias("lx")), longs.select(F.col("node").alias("y"), F.col("long").alias("ly"))
    left = F.ceil(PERCENT * F.greatest("n", "m") / 100) - 1
    most = F.col("c") + F.least(F.coalesce("lx", F.lit(0)), F.coalesce("ly", F.lit(0))) + left  # c has every meeting in a short column
    need = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    return pairs.join(a, "x", "left").join(b, "y", "left").where(most >= need).select("x", "y")


def _verified(pairs: DataFrame, docs: DataFrame, survey: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets link, by exact overlap of whole rows."""
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    first = survey.where("node is not null").groupBy("node").agg(F.min("rowno").alias("rowno"))
    ids = Stored(first.join(nodes, "node", "left_semi").select("rowno"))
    wanted = ids.read()
    n = wanted.count()

    def rows(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                found = [s for s in row_sets(data, offsets) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "grams"])

    own = docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "rowno", "left_semi").select("text")
    sets = own.mapInArrow(thrifty(rows), "node long, grams array<long>")
    a, b = sets.select(F.col("node").alias("x"), F.col("grams").alias("gx")), sets.select(F.col("node").alias("y"), F.col("grams").alias("gy"))
    met = pairs.join(a, "x").join(b, "y").select("x", "y", F.size("gx").alias("n"), F.size("gy").alias("m"), F.size(F.array_intersect("gx", "gy")).alias("both"))
    return met.where(100 * F.col("both") >= PERCENT * (F.col("n") + F.col("m") - F.col("both"))).select("x", "y").distinct()


def _open_pairs(columns: DataFrame, comps: DataFrame | None, longs: DataFrame) -> DataFrame:
    """(x, y, n, m): pairs of nodes that share a long column, may link, and are in different components."""
    named = columns.withColumn("comp", F.col("y")) if comps is None else columns.join(comps.withColumnRenamed("node", "y"), "y", "left").withColumn("comp", F.coalesce("comp", "y"))
    named = named.join(longs.select(F.col("node").alias("y"), (F.col("long") + F.col("short")).alias("all")), "y", "left")
    named = Stored(named.select("x", "y", "n", "m", "comp", "all")).read()
    sizes = Stored(named.groupBy("x").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("x", "rows")).read()
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    segment = min(SEGMENT_MOST, max(SEGMENT_LEAST, int(total) // partitions(columns)))  # no part much above a task's mean
    cut = F.ceil(F.col("rows") / segment).cast("int")
    rows = named.join(sizes, "x").withColumn("cut", cut).withColumn("s", F.pmod(F.xxhash64("y"), F.col("cut")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.select("x", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "s", "y", "n", "m", "comp", "all")

    def run(key, table):
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        y, n, m, comp, s, every = (table.column(c).to_numpy()[order] for c in ("y", "n", "m", "comp", "s", "all"))
        a, b = key[1].as_py(), key[2].as_py()
        out = [np.zeros((0, 4), np.int64)]
        for lo in range(0, len(y), 256):
            i = np.arange(lo, min(lo + 256, len(y)))
            j = np.arange(lo, np.searchsorted(n, 4 * n[i[-1]] // 3, "right"))  # by size, only these can link
            ok = (comp[i][:, None] != comp[j]) & (i[:, None] < j) & _may_link(n[i][:, None], n[j], m[i][:, None], m[j])
            left = -(-PERCENT * np.maximum(n[i][:, None], n[j]) // 100) - 1
            ok &= np.minimum(every[i][:, None], every[j]) + left >= needed(n[i][:, None], n[j])
            if a != b:
                ok &= s[i][:, None] != s[j]
            r, c = np.nonzero(ok)
            r, c = i[r], j[c]
            swap = y[r] > y[c]
            r, c = np.where(swap, c, r), np.where(swap, r, c)
            out.append(np.stack([y[r], y[c], n[r], n[c]], 1))
        found = np.concatenate(out)
        return pa.table({k: found[:, j] for j, k in enumerate(("x", "y", "n", "m"))})

    return rows.groupBy("x", "a", "b").applyInArrow(run, "x long, y long, n long, m long").distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with a unique rowno in the order of the input."""
    return Stored(docs.withColumn("rowno", F.monotonically_increasing_id())).read()


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs(doc_id, text)."""
    with scratch():
        return linked(numbered(docs.select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame) -> DataFrame:
    """(rowno, doc_id, n_shingles, component_id, kept) for stored docs(rowno, doc_id, text) with unique rowno. kept: a text without words,
    or the row of its component with the least doc_id (null last), then the least rowno."""
    small_batches(docs.sparkSession)
    docs = docs.select("rowno", F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch() as own:
        table = _survey(docs)
        survey = table.read()
        members = survey.where("grams is null")
        total = members.agg(F.sum(prefix_length_column(F.col("n")))).first()[0] or 0
        hot = _hot(survey)
        products = Stored(_products(_postings(docs, hot, max(1, -(-int(total) // BLOCK_POSTINGS)) * 4))).read()
        columns = products.where("kind = 1")
        longs = Stored(products.where("kind > 0").groupBy(F.col("y").alias("node")).agg(F.count_if(F.col("kind") == 1).alias("long"), F.sum("c").alias("short"))).read()
        met = Stored(products.where("kind = 0").groupBy("x", "y").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.max("m").alias("m"), F.bool_or("may").alias("may"))).read()
        edges = Stored(_verified(Stored(_reachable(met.where("may"), longs)).read(), docs, members)).read()
        comps = None if edges.isEmpty() else components(edges)
        if not columns.isEmpty():
            pairs = _open_pairs(columns, comps, longs).join(met.select("x", "y", "c"), ["x", "y"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
            pairs = Stored(_reachable(pairs, longs)).read()
            if not pairs.isEmpty():
                more = Stored(_verified(pairs, docs, members)).read()
                if not more.isEmpty():
                    comps = components(edges.unionByName(more))
        if comps is None:
            named = members.withColumn("comp", F.col("node"))
        else:
            named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = own.keep(Stored(named.select("rowno", "doc_id", F.col("n").alias("n_shingles"), "comp")))
        least = own.keep(Stored(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rowno"))["rowno"].alias("first"))))
    out = named.join(least, "comp", "left")
    kept = F.col("comp").isNull() | (F.col("rowno") == F.col("first"))
    return out.select("rowno", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"))


def prefix_length_column(n):
    return n - F.ceil(PERCENT * n / 100) + 1


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES: dict = {}
