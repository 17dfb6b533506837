"""Substring dedup over suffix arrays: bytes covered by a string of `width` bytes that also starts earlier go.

The corpus is far larger than any shard, so windows of `width` bytes are first dealt out by content: a window's
anchor is the least hash among its 32-byte grams, the leftmost if several, and neighbouring windows of one anchor
form a context (their bytes). Equal windows have equal anchors, so shards by anchor lose no match. Equal contexts are
aggregated, in each task and again for each block of anchors: the earliest stays, all windows of the others have an
earlier start. Only anchors with different contexts are left, and of these contexts only such as agree with another on half of what a
window has beside its anchor, on one side (equal windows do); their texts are fetched and dealt into shards by anchor. The contexts of an
anchor that has more than `HOT` of them are cut into their windows first, and these dealt by anchor and window, about `HOT` to a shard, so
none grows with one anchor (a whole anchor's contexts are at most 1.4 MB). A shard streams into a text in its task and is sorted by external induced sorting (see induced.py): tuples
of position and common prefix in queues that spill to disk beyond a budget, everything as long as the text in mapped files beyond it,
recursion on names beyond `base`. Runs of suffixes with common prefixes of `width` or more
are equal windows, and all but the earliest go. Contexts are laid out in the order (doc_id, row, offset), so
the earliest is the least position. Row numbers are given once, in the order of the input, and stored with it. Strings are judged on the
input; nothing is approximate but 64-bit hashes of contexts.

Defined results: a null text counts as empty; texts shorter than `width` lose nothing; matches never cross documents;
rows that share a doc_id, or have none, are documents of their own in the order of their rows, so of repeated rows the first stays
whole; a null id ranks first; an empty table gives an empty result; extra columns travel along in `deduplicate`
unless named like one that it adds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Stored, chunks, partitions, small_batches, thrifty
from tidemark.llm.induced import SEGMENT, Space, blocks, suffixes
from tidemark.llm.kernels import U, mix, powers

WIDTH = 100
GRAM = 32

PIECE = 1 << 20
FLUSH = 400_000
SHARD_BYTES = 1 << 20
BUDGET = 64 << 20
HOT = 8192
NAME_BYTES = 16
BROADCAST_IDS = 1_000_000
BLOCK_ENTRIES = 500_000
_BYTES = np.random.Generator(np.random.PCG64(4242)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
ENTRY = np.dtype([("gram", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("span", "u1"), ("rel", "u1"), ("left", "<u2"), ("right", "<u2")])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(row, first window, last window, anchor's hash, context's hash, anchor - first, and 16-bit hashes of what stands left and right of
    the anchor, 0 if the row ends there) of every context; places count from the run's start."""
    n, k, half = len(data), width - GRAM + 1, (width - GRAM) // 2
    parts = []
    if n >= width:
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.append(U(0), np.cumsum(_BYTES[data] * up[:n]))
            grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        bits = U(max(20, int(n).bit_length()))
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        size = -(-len(packed) // k) * k
        full = np.full(size, ~U(0))
        full[: len(packed)] = packed
        rows = full.reshape(-1, k)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        anchor = (np.minimum(back[:windows], ahead[k - 1 : k - 1 + windows]) & ((U(1) << bits) - U(1))).astype(np.int64)
        length = np.diff(offsets)
        count = np.maximum(length - width + 1, 0)
        row = np.repeat(np.arange(len(length)), count)
        p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
        a = anchor[p]
        if len(p):
            new = np.append(True, (a[1:] != a[:-1]) | (row[1:] != row[:-1]))
            start = np.flatnonzero(new)
            lo, hi = p[start], p[np.append(start[1:], len(p)) - 1]
            with np.errstate(over="ignore"):
                context = mix((sums[hi + width] - sums[lo]) * down[lo] + (hi - lo + 1).astype(np.uint64) * U(0xD6E8FEB86659FD93)) ^ mix((a[start] - lo).astype(np.uint64) + U(11))
            own, at = row[start], a[start]

            def side(b, e, fits):
                b, e = np.where(fits, b, 0), np.where(fits, e, 0)
                with np.errstate(over="ignore"):
                    return np.where(fits, (mix((sums[e] - sums[b]) * down[b]) >> U(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))

            left = side(at - half, at, at - half >= offsets[own])
            right = side(at + GRAM, at + GRAM + half, at + GRAM + half <= offsets[own + 1])
            parts = [own, lo, hi, grams[at], context, at - lo, left, right]
    return parts or [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] + [np.zeros(0, np.uint16)] * 2


def _pieces(batch: pa.RecordBatch, width: int):
    """chunks() of the text column, with a long row cut into overlapping pieces: (first row, data, offsets, place of the data in its row)."""
    for row0, data, offsets in chunks(batch, "text", PIECE):
        if len(data) <= 4 * PIECE:
            yield row0, data, offsets, 0
            continue
        for at in range(0, max(1, len(data) - width + 1), PIECE):
            part = data[at : at + PIECE + width - 1]
            yield row0, part, np.array([0, len(part)], np.int64), at


def _merged(row, lo, hi, width):
    """(row, starts, ends) of merged byte ranges for windows lo..hi, by row."""
    order = np.lexsort((lo, row))
    row, lo, end = row[order], lo[order].astype(np.int64), hi[order].astype(np.int64) + width
    if not len(row):
        return []
    cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        s, e = lo[a:b], np.maximum.accumulate(end[a:b])
        new = np.append(True, s[1:] > e[:-1])
        last = np.append(np.flatnonzero(new)[1:], b - a) - 1
        out.append((int(row[a]), s[new], e[last]))
    return out


NULL_ID = np.iinfo(np.int64).min
_RANGES = "rowno long, starts array<long>, ends array<long>"


def _range_batch(rows):
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]


def _dealt(docs: DataFrame, blocks: int, width: int) -> DataFrame:
    """Blobs of entries by block of anchors, and (block < 0) ranges that repeat within one task."""

    def run(batches):
        held, size = [], 0
        kinds = [pa.int32(), pa.binary()]

        def flush():
            e = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            order = np.lexsort((e["lo"], e["row"], e["doc"], e["context"], e["gram"]))
            e = {k: v[order] for k, v in e.items()}
            again = np.append(False, (e["gram"][1:] == e["gram"][:-1]) & (e["context"][1:] == e["context"][:-1]))
            rows = _merged(e["row"][again], e["lo"][again], e["lo"][again] + e["span"][again], width)
            if rows:
                none = pa.nulls(len(rows), kinds[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32) % blocks), none, *_range_batch(rows)], ["block", "entries", "rowno", "starts", "ends"])
            e = {k: v[~again] for k, v in e.items()}
            block = (e["gram"] >> U(32)).astype(np.int64) % blocks
            order = np.argsort(block, kind="stable")
            packed = np.empty(len(block), ENTRY)
            packed["gram"] = (e["gram"] & U(0xFFFFFFFF))[order]
            for k in ("context", "doc", "row", "lo", "span", "rel", "left", "right"):
                packed[k] = e[k][order]
            block = block[order]
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            blobs = pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            m = len(cut) - 1
            yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]].astype(np.int32)), blobs, pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], ["block", "entries", "rowno", "starts", "ends"])

        for batch in batches:
            ids = batch.column("doc").fill_null(int(NULL_ID)).to_numpy()
            rows = batch.column("rowno").to_numpy()
            for row0, data, offsets, at in _pieces(batch, width):
                row, lo, hi, gram, context, rel, left, right = anchors(data, offsets, width)
                if len(row):
                    held.append({"gram": gram, "context": context, "doc": ids[row + row0], "row": rows[row + row0], "lo": lo - offsets[row] + at, "span": hi - lo, "rel": rel, "left": left, "right": right})
                    size += len(row)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(thrifty(run), f"block int, entries binary, {_RANGES}")


def _agrees(e: np.ndarray, side: str) -> np.ndarray:
    """Which contexts have the same bytes as another of their anchor on one side."""
    key = (e["gram"].astype(np.uint64) << U(16)) | e[side].astype(np.uint64)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return (n[at] > 1) & (e[side] > 0)


def _matched(dealt: DataFrame, width: int) -> DataFrame:
    """Ranges that go, and (starts null) contexts whose text is wanted: gram, lo, size, of document doc; parts: over how many shards
    the anchor's windows are dealt."""
    names, hot = ["rowno", "starts", "ends", "doc", "gram", "lo", "size", "parts"], HOT

    def run(key, table):
        mine = table.column("entries").drop_null()
        e = np.concatenate([np.frombuffer(b.as_py(), ENTRY) for b in mine]) if len(mine) else np.zeros(0, ENTRY)
        e = e[np.lexsort((e["lo"], e["row"], e["doc"], e["context"], e["gram"]))]
        same_gram = np.append(False, e["gram"][1:] == e["gram"][:-1])[: len(e)]
        again = same_gram & np.append(False, e["context"][1:] == e["context"][:-1])[: len(e)]
        gone = e[again]
        rows = _merged(gone["row"], gone["lo"], gone["lo"].astype(np.int64) + gone["span"], width)
        first = e[~again]
        wanted = first[_agrees(first, "left") | _agrees(first, "right")]
        _, own, many = np.unique(wanted["gram"], return_inverse=True, return_counts=True)
        parts = np.where(many > hot, -(-many * (width - GRAM + 1) // hot), 1)[own] if len(wanted) else np.zeros(0, np.int64)
        through = table.filter(table.column("rowno").is_valid()).select(names[:3])
        k, m = len(rows), len(wanted)
        block = np.int64(key[0].as_py()) << np.int64(32)
        cols = [pa.concat_arrays([a, b]) for a, b in zip(_range_batch(rows), [pa.array(wanted["row"]), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))])]
        cols += [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x)]) for x in (wanted["doc"], wanted["gram"].astype(np.int64) | block, wanted["lo"].astype(np.int64), wanted["span"].astype(np.int64) + width, parts.astype(np.int64))]
        out = pa.table(cols, names=names)
        for x in names[3:]:
            through = through.append_column(x, pa.nulls(through.num_rows, pa.int64()))
        return pa.concat_tables([out, through.cast(out.schema)])

    return dealt.groupBy("block").applyInArrow(run, f"{_RANGES}, doc long, gram long, lo long, size long, parts long")


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose `rowno` is (not) in a stored table of distinct ones, broadcast up to a counted size."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rowno", how)


def _cut(raw: np.ndarray, parts: int, width: int):
    """(first byte, end byte, part) of runs of windows, each window in the part that its bytes' hash names."""
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(U(0), np.cumsum(_BYTES[raw] * up[: len(raw)]))
        own = mix((sums[width:] - sums[:-width]) * down[: len(raw) - width + 1]) % U(parts)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return first, np.append(first[1:], len(own)) + width - 1, own[first].astype(np.int64)


def _contexts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(gram, doc, rowno, lo, bytes) of the wanted contexts; those of an anchor that is dealt over several parts are cut into runs of windows, and gram
    names the anchor's part."""
    grouped = wanted.groupBy("rowno").agg(F.collect_list(F.struct("gram", "lo", "size", "parts")).alias("spans"))
    ids = Stored(wanted.select("rowno").distinct()).read()
    own = only(docs, ids).join(grouped, "rowno")

    def run(batches):
        for batch in batches:
            ids, numbers, spans = batch.column("doc").to_numpy(), batch.column("rowno").to_numpy(), batch.column("spans")
            for row0, data, offsets in chunks(batch, "text", PIECE):
                grams, docs_, rows, los, out = [], [], [], [], []
                for i in range(len(offsets) - 1):
                    flat = spans[row0 + i].values
                    gram, lo, size, parts = (flat.field(c).to_numpy() for c in ("gram", "lo", "size", "parts"))
                    text = data[offsets[i] : offsets[i + 1]]
                    hot = np.flatnonzero(parts > 1)
                    whole = np.flatnonzero(parts == 1)
                    pieces = [(gram[whole], lo[whole], lo[whole] + size[whole])]
                    for j in hot:
                        a, e, part = _cut(text[lo[j] : lo[j] + size[j]], int(parts[j]), width)
                        with np.errstate(over="ignore"):
                            pieces.append(((mix(part.astype(np.uint64) + U(1)) ^ gram[j : j + 1].view(np.uint64)).view(np.int64), lo[j] + a, lo[j] + e))
                    gram, a, e = (np.concatenate(x) for x in zip(*pieces))
                    grams.append(gram)
                    docs_.append(np.full(len(a), ids[row0 + i]))
                    rows.append(np.full(len(a), numbers[row0 + i]))
                    los.append(a)
                    raw = text.tobytes()
                    out += [raw[x:y] for x, y in zip(a.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (grams, docs_, rows, los)], pa.array(out, pa.binary())], ["gram", "doc", "rowno", "lo", "bytes"])

    return own.mapInArrow(thrifty(run), "gram long, doc long, rowno long, lo long, bytes binary")


class Shard:
    """Contexts joined to one text of small integers (1 ends a context, 0 all), held in memory up to the budget and in files beyond."""

    def __init__(self, space: Space):
        self.space, self.held, self.size = space, 0, 0
        self.kinds = {"text": np.int32, "row": np.int64, "lo": np.int64, "start": np.int64}
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in self.kinds}
        self.files: dict[str, str] = {}

    def add(self, rows: np.ndarray, los: np.ndarray, contexts: pa.Array) -> None:
        """Contexts in the order of their documents, after all that were added before."""
        contexts = contexts.cast(pa.large_binary())
        offsets = np.frombuffer(contexts.buffers()[1], np.int64, len(contexts) + 1, contexts.offset * 8)
        flat = np.frombuffer(contexts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        text = np.ones(len(flat) + len(size), np.int32)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat.astype(np.int32) + 2
        start = self.size + offsets[:-1] - offsets[0] + np.arange(len(size))
        self.size += len(text)
        for name, part in (("text", text), ("row", rows), ("lo", los), ("start", start)):
            self.parts[name].append(part)
            self.held += part.nbytes
        if self.held > self.space.budget:
            self.dump()

    def dump(self) -> None:
        for name, parts in self.parts.items():
            if name not in self.files:
                self.files[name] = self.space.path()
            with open(self.files[name], "ab") as f:
                for part in parts:
                    f.write(np.ascontiguousarray(part, self.kinds[name]).tobytes())
            parts.clear()
        self.held = 0

    def arrays(self):
        """text (with the 0 at its end), row, lo, start."""
        self.parts["text"].append(np.zeros(1, np.int32))
        if not self.files:
            return tuple(np.concatenate(p).astype(self.kinds[k], copy=False) for k, p in self.parts.items())
        self.dump()
        return tuple(np.memmap(self.files[k], kind, "r") for k, kind in self.kinds.items())


def repeated(shard: Shard, width: int, budget: int = BUDGET, base: int | None = None):
    """Yield (row, lo, hi) of the windows of these contexts that also start earlier in one of them, some at a time."""
    space = shard.space
    text, row, lo, start = shard.arrays()
    n = len(text)
    gone = space.zeros(n, bool)
    pos, lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def settle(pos, lcp):
        head = np.append(True, lcp[1:] < width)
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(pos, first)
        late = pos != np.repeat(least, np.diff(np.append(first, len(pos))))
        gone[pos[late]] = True

    for p, own in suffixes(text, budget, max(64, budget // NAME_BYTES) if base is None else base, space):
        pos, lcp = np.concatenate((pos, p)), np.concatenate((lcp, own))
        cut = np.flatnonzero(lcp < width)
        if len(cut) and cut[-1] > 0:  # whole groups so far
            settle(pos[: cut[-1]], lcp[: cut[-1]])
            pos, lcp = pos[cut[-1] :], lcp[cut[-1] :]
        elif len(pos) > 4 * SEGMENT:  # a group that is longer than some segments: its least so far stands for it
            least = pos.min()
            gone[pos[pos != least]] = True
            pos, lcp = np.array([least]), lcp[:1]
    if len(pos):
        settle(pos, lcp)
    for a, e in blocks(n):
        at = np.flatnonzero(gone[a:e]) + a
        if not len(at):
            continue
        own = np.searchsorted(start, at, "right") - 1
        size = np.append(start[own[own + 1 < len(start)] + 1], np.full(int((own + 1 >= len(start)).sum()), n - 1)) - 1 - start[own]
        inside = at - start[own] <= size - width  # a window of the context, not one that runs beyond it
        at, own = at[inside], own[inside]
        if not len(at):
            continue
        new = np.append(True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        o = own[first]
        yield np.array(row[o]), lo[o] + at[first] - start[o], lo[o] + at[last] - start[o]


def _sorted_out(contexts: DataFrame, shards: int, width: int, budget: int) -> DataFrame:
    """Ranges of the contexts that also start earlier, found in a suffix array for each shard. A shard is a partition; it streams into its task."""

    def run(batches):
        with Space(budget) as space:
            shard = Shard(space)
            for batch in batches:
                shard.add(batch.column("rowno").to_numpy(), batch.column("lo").to_numpy(), batch.column("bytes"))
            if not shard.size:
                return
            for row, lo, hi in repeated(shard, width, budget):
                yield pa.RecordBatch.from_arrays(_range_batch(_merged(row, lo, hi, width)), names=["rowno", "starts", "ends"])

    return contexts.repartition(shards, "gram").sortWithinPartitions("doc", "rowno", "lo").select("rowno", "lo", "bytes").mapInArrow(thrifty(run), _RANGES)


def ranges(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """(rowno, parts: array<struct<starts, ends>>) of what goes, for stored docs(doc, rowno, text) with unique rowno."""
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions(docs), -(-int(n) * 2 // (width - GRAM) // BLOCK_ENTRIES)) * 2
    found = Stored(_matched(_dealt(docs, blocks, width), width)).read()
    gone = found.where("starts is not null").select("rowno", "starts", "ends")
    wanted = found.where("starts is null").select("doc", "rowno", "gram", "lo", "size", "parts")
    total = wanted.agg(F.sum("size")).first()[0] or 0
    if total:
        shards = max(partitions(docs), -(-int(total) // SHARD_BYTES))
        gone = gone.unionByName(Stored(_sorted_out(_contexts(docs, wanted, width), shards, width, budget)).read())
    return gone.groupBy("rowno").agg(F.collect_list(F.struct("starts", "ends")).alias("parts"))


ADDED = ("kept", "n_bytes", "n_removed", "n_spans", "spans")


def deduplicate(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """docs with kept (bytes), n_bytes, n_removed, n_spans and spans (byte ranges that went)."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*ADDED, "doc", "rowno", "parts")])
    numbered = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))), "rowno": F.monotonically_increasing_id()})
    keyed = Stored(numbered).read()
    parts = Stored(ranges(keyed.select("doc", "rowno", "text"), width, budget)).read()
    ids = Stored(parts.select("rowno")).read()
    touched = only(keyed, ids).join(parts, "rowno")
    fields = docs.columns
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ADDED[1:4]], T.StructField("spans", kind)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            kept, numbers, spans = [], [], []
            found = batch.column("parts")
            for row0, data, offsets in chunks(batch, "text", PIECE):
                for i in range(len(offsets) - 1):
                    own = data[offsets[i] : offsets[i + 1]]
                    flat = found[row0 + i].values
                    size, runs = len(own), []
                    if flat is not None and size:
                        edge = np.zeros(size + 1, np.int32)
                        np.add.at(edge, flat.field("starts").flatten().to_numpy(), 1)
                        np.add.at(edge, flat.field("ends").flatten().to_numpy(), -1)
                        off = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate(([False], off, [False])).astype(np.int8)))
                        runs = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                        own = own[~off]
                    kept.append(own.tobytes())
                    numbers.append((size, size - len(own), len(runs)))
                    spans.append(runs)
            cols = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], pa.array(kept, pa.binary()), *cols, pa.array(spans, arrow)], [*fields, *ADDED])

    changed = touched.select(*fields, "parts").mapInArrow(thrifty(cut), schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    same = only(keyed, ids, "left_anti").select(*fields, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"), size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast(kind).alias("spans"))
    return changed.unionByName(same)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, str]], width: int = WIDTH) -> list[tuple]:
    """The rows of op1 from a plain dictionary of strings, for tests."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        off = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s in seen:
                off[p : p + width] = b"\1" * width
            seen.add(s)
        kept = bytes(b for b, o in zip(raw, off) if not o)
        runs = sum(1 for i, o in enumerate(off) if o and (i == 0 or not off[i - 1]))
        out.append((doc, len(raw), sum(off), runs, hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict = {}
