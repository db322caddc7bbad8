"""Line deduplication over range-partitioned line hashes.

Each text is cut at \\n; a line's key is the line without the white space at its ends, A-Z
lower-cased, as a 128-bit hash. (hash, document, position) rows are range-partitioned by hash
and document and sorted by hash, document, position, so a hot key is spread over as many
partitions as it needs, and each partition streams its runs once, holding no run: only whether
a run has reached ``min_docs`` documents, and up to ``HELD`` rows before that. A run that touches its
partition's edge with fewer documents than that, or has more rows before that, is decided afterwards from
the run summaries (two for each partition, and one for ``HELD`` rows). Text isn't shuffled with the lines: the result is a
compressed keep bitmap for each touched document, which ``apply`` joins to the texts.

``policy`` "all": every line of a key found in ``min_docs`` documents goes. "after_first": its
first line by (document, position) stays. Keys under ``min_chars`` code points never go.
Null or empty text: one empty line. Rows of one id are one document; a null id counts as one,
too; each row gets its own bitmap by the hash of its text. First lines are told by document, position
and hash of the text; rows that repeat in all of these stay or go together. An empty table gives no rows. Columns
besides id, text and ``extra`` aren't read; an ``extra`` column with the name of a result is left out.
A long text's lines are taken in parts of ``PIECE`` bytes; its
bytes are held whole, and those of one line at some 20 bytes for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

DROP, PENDING, SUMMARY, FIRST = 0, 1, 2, 3
HELD = 200_000
PIECE = 8 << 20


def line_keys(buf: np.ndarray, offs: np.ndarray, min_chars: int = 1) -> tuple[np.ndarray, ...]:
    """(text, position, h1, h2) of the lines whose keys have ``min_chars`` code points."""
    ls, le, ld = tk.lines(buf, offs)
    s, e, _ = tk.spans(buf, offs, tk.NOT_SPACE)
    a, b = np.searchsorted(s, ls), np.searchsorted(s, le)
    pos = np.arange(len(ld)) - np.searchsorted(ld, np.arange(len(offs) - 1))[ld]
    some = np.flatnonzero(b > a)
    ks, ke = s[a[some]], e[b[some] - 1]
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    ok = chars[ke] - chars[ks] >= min_chars
    some, ks, ke = some[ok], ks[ok], ke[ok]
    w = tk.eights(buf, tk.LOWER)
    return ld[some], pos[some], tk.span_hash(w, ks, ke), tk.span_hash(w, ks, ke, 1)


def _keys(texts: pa.Array, min_chars: int, piece: int = PIECE) -> Iterator[tuple]:
    """(first row, end row, and ``line_keys``) of slices; a text above ``piece`` bytes is taken in parts that end before a line's end."""
    for lo, hi, buf, offs in tk.slices(texts):
        if len(buf) <= piece:
            yield lo, hi, *line_keys(buf, offs, min_chars)
            continue
        for i in range(hi - lo):
            at, seen, end = int(offs[i]), 0, int(offs[i + 1])
            while at <= end:
                cut = np.flatnonzero(buf[at + piece : end] == 10)[:1] if at + piece < end else ()
                stop = at + piece + int(cut[0]) if len(cut) else end
                d, pos, h1, h2 = line_keys(buf[at:stop], np.array([0, stop - at]), min_chars)
                yield lo, hi, d + i, pos + seen, h1, h2
                seen += int((buf[at:stop] == 10).sum()) + 1
                at = stop + 1


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, d, pos, h1, h2 in _keys(b.column(2), min_chars):
                take = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "row", "pos", "h1", "h2"])

    return run


def _stream(min_docs: int, after_first: bool, kind: pa.DataType):
    names = ["kind", "h1", "h2", "id", "row", "pos", "n", "part"]

    def out(part: int, kinds: np.ndarray, h1, h2, ids: pa.Array, row, pos, n) -> pa.RecordBatch:
        m = len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), ids, pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int64()), pa.array(np.full(m, part), pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key = None  # the run at hand
        docs, last, opens, first_kept = 0, None, True, False
        held: list[pa.RecordBatch] = []  # its rows while it has under min_docs documents
        spilled = False  # whether some of them are out, pending

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            if edge or opens or spilled:
                yield out(part, np.array([SUMMARY]), [key[0]], [key[1]], pa.array([None], kind), [0], [0], [docs])
                if docs < min_docs:
                    for r in held:
                        yield r

        for b in batches:
            if not b.num_rows:
                continue
            ids, row, pos, h1, h2 = b.columns
            h1, h2, row, pos = (np.asarray(x) for x in (h1, h2, row, pos))
            doc = ids.dictionary_encode(null_encoding="encode")
            code = np.asarray(doc.indices)
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(h1)]])
            new = np.ones(len(h1), np.int64)
            new[1:] = code[1:] != code[:-1]
            new[starts] = 1
            total = np.add.reduceat(new, starts)
            inner = np.arange(1, len(starts) - 1)  # runs that begin and end in this batch
            if len(inner):
                big = inner[total[inner] >= min_docs]
                if len(big):
                    at = np.concatenate([np.arange(starts[i] + after_first, ends[i]) for i in big])
                    yield out(part, np.full(len(at), DROP), h1[at], h2[at], ids.take(pa.array(at)), row[at], pos[at], np.zeros(len(at)))
            for i in [0] if len(starts) == 1 else [0, len(starts) - 1]:
                at = np.arange(starts[i], ends[i])
                k = (h1[at[0]], h2[at[0]])
                mine = ids[int(at[0])].as_py()
                if k != key:
                    yield from close(False)
                    opens = key is None
                    if len(starts) > 1 and i == len(starts) - 1:
                        opens = False
                    key, docs, held, first_kept, spilled = k, 0, [], False, False
                    here = int(total[i])
                else:
                    here = int(total[i]) - (mine == last)
                last = ids[int(at[-1])].as_py()
                docs += here
                kinds = np.full(len(at), PENDING)
                if after_first and not first_kept:
                    kinds[0] = FIRST
                    first_kept = True
                rows = out(part, kinds, h1[at], h2[at], ids.take(pa.array(at)), row[at], pos[at], np.zeros(len(at)))
                if docs < min_docs:
                    held.append(rows)
                    if sum(r.num_rows for r in held) > HELD:
                        yield from held
                        held, spilled = [], True
                else:
                    for r in [*held, rows]:
                        now = np.asarray(r.column(0))
                        keep = np.flatnonzero((now != FIRST) | opens)
                        if len(keep):
                            r = r.take(pa.array(keep))
                            now = now[keep]
                            yield pa.RecordBatch.from_arrays([pa.array(np.where(now == FIRST, FIRST, DROP), pa.int32()), *r.columns[1:]], names)
                    held = []
            # a run that began in this batch as its last one and isn't the partition's first is closed at its start
        yield from close(True)

    return run


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, policy: str = "all", folders: list[str] | None = None) -> DataFrame:
    """(id, row: hash of the text, pos) of every line to drop; reads the tables in ``folders``, if given one to fill."""
    if policy not in ("all", "after_first"):
        raise ValueError(f"unknown policy {policy}")
    spark = docs.sparkSession
    field = docs.schema[id_col].dataType
    sql = field.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    use = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    rows, lines = shared.written(use.mapInArrow(_explode(min_chars), f"id {sql}, row long, pos int, h1 long, h2 long"), "lines")
    by = rows.repartitionByRange(shared.parts(spark), "h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos", "row")
    found, runs_at = shared.written(by.mapInArrow(_stream(min_docs, policy == "after_first", to_arrow_type(field)), f"kind int, h1 long, h2 long, id {sql}, row long, pos int, n long, part int"), "runs")
    shared.remove(spark, lines)
    if folders is not None:
        folders.append(runs_at)
    key = ["h1", "h2"]
    runs = found.where(F.col("kind") == SUMMARY).groupBy(*key).agg(F.sum("n").alias("total"), F.min("part").alias("from")).where(F.col("total") >= min_docs)
    late = found.where(F.col("kind") == PENDING).join(runs, key, "left_semi").select("id", "row", "pos")
    later = found.where(F.col("kind") == FIRST).join(runs, key).where(F.col("part") > F.col("from")).select("id", "row", "pos")
    return found.where(F.col("kind") == DROP).select("id", "row", "pos").unionByName(late).unionByName(later)


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(id, row, n_dropped, bitmap): zlib of one bit for each line up to the last one dropped and to a whole byte, 1 to keep."""
    kind = dropped.schema["id"].dataType.simpleString()
    got = dropped.groupBy("id", "row").agg(F.collect_set("pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = np.asarray(b.column(2).offsets)
            v = np.asarray(b.column(2).values)
            maps = []
            for i in range(b.num_rows):
                p = v[o[i] : o[i + 1]]
                bits = np.ones((int(p.max()) // 8 + 1) * 8, bool)
                bits[p] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(o), pa.int64()), pa.array(maps, pa.binary())], ["id", "row", "n_dropped", "bitmap"])

    return got.mapInArrow(run, f"id {kind}, row long, n_dropped long, bitmap binary")


def keep_lines(text: str | None, bitmap: bytes | None) -> str:
    """The kept lines of a text."""
    parts = (text or "").split("\n")
    if bitmap is None:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
    return "\n".join(x for i, x in enumerate(parts) if i >= len(bits) or bits[i])


def apply(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id and ``extra`` columns with n_lines, n_dropped and kept (the kept text)."""
    extra = tuple(c for c in extra if c not in (id_col, "n_lines", "n_dropped", "kept"))
    left = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__row"), *(F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)))
    both = left.join(maps.hint("shuffle_hash"), left["__id"].eqNullSafe(maps["id"]) & (left["__row"] == maps["row"]), "left")
    kinds = [docs.schema[c].dataType.simpleString() for c in extra]
    n = len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, maps_ = b.column(1).to_pylist(), b.column(3).to_pylist()
            kept = [t or "" if m is None else keep_lines(t, m) for t, m in zip(texts, maps_, strict=True)]
            lines = pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64())
            dropped = pa.array([x or 0 for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lines, dropped, pa.array(kept, pa.string()), *b.columns[4:]], ["__id", "n_lines", "n_dropped", "kept", *(f"__x{i}" for i in range(n))])

    got = both.select("__id", "__text", "n_dropped", "bitmap", *(f"__x{i}" for i in range(n))).mapInArrow(
        run, f"__id {docs.schema[id_col].dataType.simpleString()}, n_lines long, n_dropped long, kept string" + "".join(f", __x{i} {k}" for i, k in enumerate(kinds))
    )
    return got.select(F.col("__id").alias(id_col), "n_lines", "n_dropped", "kept", *(F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, policy: str = "all", extra: tuple[str, ...] = ()) -> DataFrame:
    folders: list[str] = []
    maps, _ = shared.written(bitmaps(drops(docs, id_col, text_col, min_docs, min_chars, policy, folders)), "bitmaps")
    shared.remove(docs.sparkSession, *folders)
    return apply(docs, maps, id_col, text_col, extra)
