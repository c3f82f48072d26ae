"""Large JSON arrays of records in parallel (SRC-01, SRC-05, SRC-07): one file is read by many tasks.

Spark's text source cuts a file into splits at ``}``, so neither indentation nor line ends matter and a split never
starts within an escape. A first pass notes for each split how its quotes and brackets change the state, once for a
start outside a string and once for a start inside; prefix sums over the splits of a file give the state in which each
one really starts. The last pass cuts elements at the commas of depth one. An element that lies in several splits
leaves a fragment in each, and fragments are put together by a window over the file's splits. The first pass keeps both
ends of every split, which hold its fragments; only a split whose ends hold no comma of depth one, or which touches depth zero
between them, is read once more for them.

Pieces are many and short, so what each one costs counts: it goes to Python as one string signed by its split, and only the marks among its bytes are looked at.

A file is an array when it starts with ``[``, its brackets and quotes close, and only white space surrounds it. Other files
give no rows and are reported as a whole (a null document); empty and blank files are not reported. An element that cannot be parsed is reported alone, null
elements give no row, an empty array gives none. An element must fit into one task's memory, a file need not.
"""
from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.session import materialise, small_side

ELEMENT, HEAD, TAIL, BAD, UNKNOWN = 0, 1, 2, 3, 4
BLANK = b" \t\r\n"
QUOTE, OPEN, CLOSE, COMMA, BRACE, UNBRACE = 1, 2, 3, 4, 5, 6
MARKS = bytes({34: QUOTE, 91: OPEN, 93: CLOSE, 44: COMMA, 123: BRACE, 125: UNBRACE}.get(i, 0) for i in range(256))
#: Bytes kept of a split's start; of its end two to four times as many.
END = 1 << 14
#: Bytes of elements that travel as one row.
ROW_BYTES = 1 << 20
FAR = 1 << 60


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): a file's text up to each ``}``, in order within a split."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def signed(sign, value="value"):
    """A piece behind the sign of its split, which ends with a line: every column more is paid for with each piece that goes to Python."""
    return F.concat(sign, F.lit("\n"), value).alias("value")


def joined(values: pa.Array, skip: int) -> bytes:
    """Pieces without their first bytes, each followed by its separator."""
    n = len(values)
    start = np.frombuffer(values.buffers()[1], np.int32)[values.offset:][:n + 1]
    parts = np.stack([start[:-1], start[:-1] + skip], 1).ravel()
    parts = pa.Array.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(np.append(parts, start[-1])), values.buffers()[2]])
    values = parts.take(pa.array(np.arange(1, 2 * n, 2))).cast(pa.large_binary())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values), pa.scalar(b"}", pa.large_binary()))[0].as_py() + b"}"


def symbols(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of quotes, brackets and commas. A quote after an odd run of backslashes is none."""
    kind = np.frombuffer(bytearray(raw).translate(MARKS), np.uint8)
    if b"\\" in raw:
        a = np.frombuffer(raw, np.uint8)
        slash = np.flatnonzero(a == 92)
        edge = np.flatnonzero(np.diff(slash) != 1)
        first, end = slash[np.append(0, edge + 1)], slash[np.append(edge, len(slash) - 1)] + 1
        escaped = end[(end - first) % 2 == 1]
        escaped = escaped[escaped < len(a)]
        kind[escaped[a[escaped] == 34]] = 0
    at = np.flatnonzero(kind != 0)
    return at, kind[at]


def steps(kind: np.ndarray) -> np.ndarray:
    """+1 where a bracket opens, -1 where one closes."""
    return ((kind == OPEN) | (kind == BRACE)).astype(np.int8) - ((kind == CLOSE) | (kind == UNBRACE)).astype(np.int8)


def within(kind: np.ndarray, parity: int) -> np.ndarray:
    """1 inside a string."""
    return (np.cumsum(kind == QUOTE, dtype=np.uint8) + np.uint8(parity)) & 1


def runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """The sign and the text of each split in a batch of signed pieces (a task may read several splits, one after the other)."""
    values = batch.column(0).cast(pa.binary())
    lo = 0
    while lo < len(values):
        sign = values[lo].as_py().split(b"\n", 1)[0] + b"\n"
        other = lambda i: bytes(memoryview(values[i].as_buffer())[:len(sign)]) != sign
        hi = bisect.bisect_left(range(len(values)), True, lo + 1, key=other)
        yield sign[:-1], joined(values.slice(lo, hi - lo), len(sign))
        lo = hi


class Totals:
    """What a split adds to the state, for a start outside and one inside a string, with both its ends."""

    def __init__(self, end: int) -> None:
        self.end, self.size, self.parity, self.gain = end, 0, 0, (0, 0)
        self.head, self.tail, self.low = b"", [], (FAR, FAR)

    def feed(self, raw: bytes) -> None:
        at, kind = symbols(raw)
        inside, step = within(kind, self.parity), steps(kind)
        depth = [g + np.cumsum(np.where(inside == side, step, 0), dtype=np.int64) for side, g in enumerate(self.gain)]
        lowest = lambda lo, hi: tuple(int(x[lo:hi].min(initial=FAR)) for x in depth)
        # the end of the split so far: from a piece's start on, so that no escape is cut
        cut = 0 if len(raw) <= 2 * self.end else raw.find(b"}", len(raw) - 2 * self.end) + 1
        middle, last = np.searchsorted(at, [max(0, self.end - self.size), cut]).tolist()
        if cut:
            self.drop(len(self.tail))
            self.lower(lowest(middle, last))
        before = (self.parity + int((kind[:last] == QUOTE).sum())) & 1, *(int(x[last - 1]) if last else g for x, g in zip(depth, self.gain))
        self.tail.append((raw[cut:], before, lowest(max(middle, last), None)))
        while sum(len(x[0]) for x in self.tail[1:]) >= 2 * self.end:
            self.drop(1)
        self.head += raw[:max(0, self.end - self.size)]
        self.size += len(raw)
        self.parity = (self.parity + int((kind == QUOTE).sum())) & 1
        self.gain = tuple(int(x[-1]) if len(x) else g for x, g in zip(depth, self.gain))

    def lower(self, low: tuple[int, int]) -> None:
        self.low = tuple(map(min, self.low, low))

    def drop(self, n: int) -> None:
        for x in self.tail[:n]:
            self.lower(x[2])
        del self.tail[:n]

    def row(self) -> tuple:
        """Totals; the start of the split, unless its end holds it whole; the end with the state before it; the least depth between."""
        tail = b"".join(x[0] for x in self.tail)
        rest = self.size - len(tail)
        return self.parity, *self.gain, self.head[:rest] if rest else None, tail, *self.tail[0][1], *self.low


TOTALS = "name long, block long, parity long, outside long, inside long, head binary, tail binary, tail_parity long, tail_outside long, tail_inside long, low_outside long, low_inside long"


def split_totals(end: int = END) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``TOTALS``, one for each split of pieces signed by name and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, totals = None, None
        form = [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in TOTALS.split(", ")]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((*map(int, at.split()), *totals.row()), form)], names=[n for n, _ in form])
        for batch in batches:
            for split, raw in runs(batch):
                if at != split:
                    if at:
                        yield row()
                    at, totals = split, Totals(end)
                totals.feed(raw)
        if at:
            yield row()
    return run


def strings(values: list[bytes]) -> pa.Array:
    return pa.array([x.decode(errors="replace") for x in values], pa.string())


class Cutter:
    """Cuts a split that starts in a given state: whole elements, fragments at its ends, and text that no array may hold."""

    def __init__(self, parity: int, depth: int, last: int | None = None) -> None:
        self.parity, self.depth, self.last, self.kept, self.inside, self.marks = parity, depth, last, [], depth > 0, 0

    def feed(self, raw: bytes) -> Iterator[tuple[int, pa.Array]]:
        at, kind = symbols(raw)
        bare = within(kind, self.parity) == 0
        after = self.depth + np.cumsum(np.where(bare, steps(kind), 0), dtype=np.int64)
        mark = bare & ((after == 1) & ((kind == COMMA) | (kind == OPEN)) | (after == 0) & (kind == CLOSE))
        where, what = at[mark], kind[mark]
        other = np.append(np.flatnonzero(what != COMMA), len(what))
        self.marks += len(what)
        flat, lo, i = None, 0, 0
        while i < len(what):
            self.kept.append(raw[lo:where[i]])
            text, self.kept, lo, to = b"".join(self.kept), [], int(where[i]) + 1, int(what[i])
            if to == OPEN:
                if text.strip(BLANK) not in (b"", b"\xef\xbb\xbf") or self.last is not None or self.inside:
                    yield BAD, strings([b""])
            elif self.last in (OPEN, COMMA):
                if not (self.last == OPEN and to == CLOSE and not text.strip(BLANK)):
                    yield ELEMENT, strings([text.strip(BLANK)])
            elif self.last is None and self.inside:
                yield HEAD, strings([text])
            else:
                yield BAD, strings([b""])
            self.last, i = to, i + 1
            # commas in a row hold whole elements
            stop = int(other[np.searchsorted(other, i)])
            if to != CLOSE and stop > i:
                if flat is None:
                    flat = bytearray(raw)
                    np.frombuffer(flat, np.uint8)[where] = 32
                yield ELEMENT, between(flat, where[i - 1:stop])
                self.last, lo, i = COMMA, int(where[stop - 1]) + 1, stop
        self.kept.append(raw[lo:])
        self.parity = (self.parity + int((kind == QUOTE).sum())) & 1
        self.depth = int(after[-1]) if len(after) else self.depth

    def finish(self) -> Iterator[tuple[int, pa.Array]]:
        """The text after a split's last mark."""
        text = b"".join(self.kept)
        if self.last in (OPEN, COMMA):
            yield TAIL, strings([text])
        elif self.last is None and self.inside:
            yield HEAD, strings([text])
        elif text.strip(BLANK) not in (b"", b"}"):              # pieces carry their separator, the file's last one has none
            yield BAD, strings([b""])


def between(flat: bytearray, marks: np.ndarray) -> pa.Array:
    """The texts between marks (which are blanks by now), without white space around them."""
    x = pa.StringArray.from_buffers(len(marks) - 1, pa.py_buffer(marks.astype(np.int32)), pa.py_buffer(flat))
    try:
        x.validate(full=True)
    except pa.ArrowInvalid:
        x = strings([bytes(flat[a:b]) for a, b in zip(marks.tolist(), marks[1:].tolist())])
    return pc.ascii_trim(x, BLANK.decode())


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, kind, documents) of pieces signed by split, start and depth."""
    at, split, cutter, out = None, None, None, []

    def batch_of() -> pa.RecordBatch:
        keys, kinds, lists = [], [], [0]
        for split, kind, texts in out:
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            part = (np.cumsum(size, dtype=np.int64) - size) // ROW_BYTES
            ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            keys += [split] * len(ends)
            kinds += [kind] * len(ends)
            lists += [lists[-1] + e for e in ends]
        texts = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.concat_arrays([x for _, _, x in out]))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), texts], names=["split", "kind", "documents"])

    for batch in batches:
        for sign, raw in runs(batch):
            if at != sign:
                if at:
                    out += [(split, *x) for x in cutter.finish()]
                at, (split, start, depth) = sign, map(int, sign.split())
                cutter = Cutter(start, depth)
            out += [(split, *x) for x in cutter.feed(raw)]
        if out:
            yield batch_of()
    if at:
        out += [(split, *x) for x in cutter.finish()]
    if out:
        yield batch_of()


def cut_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, document) of what is no whole element, from the ends of splits; ``UNKNOWN`` where they do not tell."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cutter, found = Cutter(r["start"], r["depth"]), []
            if r["head"] is not None:
                found += cutter.feed(r["head"])
                side = "inside" if r["start"] else "outside"
                clear = cutter.last in (OPEN, COMMA) and cutter.depth > 0 and r["depth"] + r["low_" + side] > 0
                cutter = Cutter((r["start"] + r["tail_parity"]) & 1, r["depth"] + r["tail_" + side], COMMA)
            if r["tail"]:
                found += cutter.feed(r["tail"])
            found += cutter.finish()
            if r["head"] is not None and not (clear and cutter.marks):
                found = [(UNKNOWN, strings([b""]))]
            out += [(r["file"], r["block"], kind, x.as_py()) for kind, texts in found if kind != ELEMENT for x in texts]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["file", "block", "kind", "document"])


def or_fail(column: str, message: str):
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(message)))


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, file): files by the hash that stands for them between passes; no content is read."""
    x = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    x = x.groupBy(F.xxhash64("file").alias("name")).agg(F.min("file").alias("file"), F.max("file").alias("other"))
    return x.select("name", F.when(F.col("file") == F.col("other"), F.col("file")).otherwise(F.raise_error(F.lit("two files with one hash"))).alias("file"))


def cut_elements(text: DataFrame, state: DataFrame, every: bool = True) -> DataFrame:
    """(split, kind, documents) of the pieces whose splits are in ``state`` (split, start, depth, and left where they are not wanted)."""
    state = state.select("split", F.concat_ws(" ", "split", "start", "depth").alias("sign"), *(["left"] if every else []))
    rows = text.select(F.xxhash64("file", "block").alias("split"), "value", F.monotonically_increasing_id().alias("at")).join(small_side(state), "split", "left" if every else "inner")
    if every:
        # a split that the first pass has not seen (Spark cut the file otherwise) is an error, never a lost row
        rows = rows.where(F.col("left").isNull()).withColumn("sign", or_fail("sign", "splits changed between two passes"))
    rows = rows.select("split", "at", signed("sign"))
    rows = rows.repartition("split").sortWithinPartitions("split", "at") if "BroadcastHashJoin" not in plan_of(rows) else rows
    return rows.select("value").mapInArrow(cut, "split long, kind int, documents array<string>")


def array_elements(spark: SparkSession, path: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(file, documents): the texts of elements of array files, many a row; (file): files that are no array."""
    text = pieces(spark, path)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = materialise(text.select(signed(F.concat_ws(" ", F.xxhash64("file"), "block"))).mapInArrow(split_totals(end), TOTALS), "totals")
    state = totals.select("name", "block", "parity", "outside", "inside").join(file_names(spark, path), "name", "left")
    state = state.withColumn("file", or_fail("file", "files changed between two passes"))
    state = state.withColumn("start", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    state = state.withColumn("gain", F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside")))
    state = state.withColumn("depth", F.coalesce(F.sum("gain").over(before), F.lit(0)))
    state = materialise(state.withColumn("split", F.xxhash64("file", "block")), "splits")
    if state.groupBy("split").count().where("count > 1").limit(1).count():
        raise RuntimeError("two splits with one hash")
    # the last piece of a file gets a bracket too many, which closes nothing: from an even array the sum is then -1
    ends = state.groupBy("file").agg((F.sum("parity") % 2).alias("open"), F.sum("gain").alias("rest"))
    unclosed = ends.where((F.col("open") != 0) | (F.col("rest") != -1)).select("file")

    # what needs other splits is little and written once
    known = totals.drop("parity", "outside", "inside").join(small_side(state.select("name", "block", "file", "start", "depth")), ["name", "block"])
    rest = materialise(known.mapInArrow(cut_ends, "file string, block long, kind int, document string"), "fragments")
    unknown = rest.where(F.col("kind") == UNKNOWN)
    if unknown.limit(1).count():
        again = materialise(state.join(unknown.select("file", "block"), ["file", "block"], "left_semi").select("file", "block", "split", "start", "depth"), "unknown")
        found = cut_elements(text, again.select("split", "start", "depth"), every=False).where(F.col("kind") != ELEMENT)
        found = found.join(small_side(again.select("split", "file", "block")), "split").select("file", "block", "kind", F.explode("documents").alias("document"))
        rest = rest.where(F.col("kind") != UNKNOWN).union(materialise(found, "fragments"))
    fragments = rest.where(F.col("kind").isin(HEAD, TAIL))
    number = F.sum((F.col("kind") == TAIL).cast("long")).over(Window.partitionBy("file").orderBy("block", "kind"))
    whole = fragments.withColumn("number", number).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "document"))).alias("parts"))
    whole = whole.select("file", F.array(F.regexp_replace(F.array_join("parts.document", ""), r"^[ \t\r\n]+|[ \t\r\n]+$", "")).alias("documents"))
    wrong = materialise(unclosed.union(rest.where(F.col("kind") == BAD).select("file")).distinct(), "wrong")
    state = materialise(state.join(small_side(wrong.withColumn("left", F.lit(True))), "file", "left").select("split", "file", "start", "depth", "left"), "state")
    good = cut_elements(text, state.drop("file")).where(F.col("kind") == ELEMENT).join(small_side(state.select("split", "file")), "split").select("file", "documents")
    return good.union(whole.join(small_side(wrong), "file", "left_anti")), wrong


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def read_large_arrays(spark: SparkSession, path: str, schema, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_file``, (file, document) of what is no row): array files of any size and layout, see above."""
    s = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    corrupt, options = T.StructField("_corrupt_record", T.StringType()), {"columnNameOfCorruptRecord": "_corrupt_record"}
    elements, wrong = array_elements(spark, path, end)
    # a parser for each element costs as much as its parsing: a row's elements are parsed as one array, and alone if that is not sound.
    # Generators keep what is parsed; a projection would be repeated in every filter on it
    array = T.StructType([T.StructField("v", T.ArrayType(s)), corrupt])
    text = F.concat(F.lit('{"v":['), F.concat_ws(",", "documents"), F.lit("]}"))
    parsed = F.struct("documents", F.when(F.size("documents") > 1, F.from_json(text, array, options)).alias("all"))
    x = elements.select("file", F.explode(F.array(parsed)).alias("p")).select("file", "p.documents", "p.all")
    sound = F.col("all").isNotNull() & F.col("all._corrupt_record").isNull() & (F.size("all.v") == F.size("documents"))
    alone = F.transform("documents", lambda d: F.struct(d.alias("document"), F.from_json(d, T.StructType([*s.fields, corrupt]), options).alias("r")))
    right = lambda e: e["document"].startswith("{") & e["r"]["_corrupt_record"].isNull()
    row = lambda e: F.when(right(e), F.struct(*[e["r"][f].alias(f) for f in s.fieldNames()]))
    good = x.select("file", F.explode(F.when(sound, F.col("all.v")).otherwise(F.transform(alone, row))).alias("r")).where(F.col("r").isNotNull())
    good = good.select(*[F.col("r").getField(f).alias(f) for f in s.fieldNames()], F.col("file").alias("_file"))
    broken = F.filter(alone, lambda e: (e["document"] != "null") & ~right(e))
    bad = x.select("file", F.explode(F.when(~sound, F.transform(broken, lambda e: e["document"]))).alias("document"))
    return good, bad.union(wrong.select("file", F.lit(None).cast("string")))
