"""Line deduplication with a tree of log templates.

A line of at least ``MIN_WORDS`` words is parsed as a log line: words with a digit, an at sign or an address
become ``<*>``; its number of words and its ``DEPTH`` leading words name a leaf of a tree of fixed depth.
Inside a leaf a word is constant at its place where two documents have it there. If ``SIMILAR`` in 100 of a
line are constant, that many of them, those of the most lines, are its template and the rest is variable, else
it stands for itself. Counts only order the words of a line, so a value of a variable field stays variable
however often it occurs, as long as the words around it occur more often. A shorter line, which has too few words to
tell fields from text, is its own template, as it stands but for white space. A template that occurs in two or more
documents is recurring: its first line (smallest document id, then place) stays and all others are dropped.

Lines travel as hashes, and the lines of leaves that stand in one document alone do not travel at all. Only leaves with
different lines in different documents need words, as hashes of leaf, place and word: a line's are sent once for every
few thousand lines of a task, and they are counted with partial sums. Lines that cannot have enough constants go before
their constants are joined. Bitmaps of fixed size tell these cases apart where lines are read; what a full bitmap lets
through costs time and changes nothing. A leaf, however hot, is never gathered. Written tables are deleted once what is
made of them is written.

Edge cases: a missing or empty text has no lines to drop and is returned as it is, and so is a text of which
nothing is dropped. A line without a word stays. Documents without an id are returned as they are and make nothing
recur. Rows that repeat id and text are one document; rows that repeat an id with another text are documents of
their own. Lines repeated inside one document alone stay. Other columns are carried along. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.staging import discard, stage
from .hashing import parts
from .tables import unused

MIN_WORDS = 8
DEPTH = 2
SIMILAR = 75  # of 100
LEAF_BITS = 24
KEY_BITS = 26
HELD = 1 << 19  # keys of the lines that a task puts together
WILD = "<*>"
_VARIABLE = re.compile(r"[0-9@]|://")
_MARKS = b"0123456789@:"
_hash = xxhash.xxh3_64_intdigest


def masked(words: list[str]) -> list[str]:
    """Words of a line, variable ones as ``WILD``."""
    line = " ".join(words).encode()
    if len(line.translate(None, _MARKS)) == len(line):
        return words
    return [WILD if _VARIABLE.search(w) else w for w in words]


def leaf_of(words: list[str]) -> int:
    """Leaf of a line: of its number of words, and of the leading ones, masked."""
    return _hash(" ".join([str(len(words)), *(WILD if _VARIABLE.search(w) else w for w in words[:DEPTH])]), 1)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _parsed(docs: DataFrame) -> DataFrame:
    """(id, doc, line_no, leaf, line) of all lines with a word; a short line is a leaf of its own."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in parts(whole.column(2)):
                batch = whole.slice(a, b - a)
                row, line_no, leaf, line = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    for k, one in enumerate((text or "").split("\n")):
                        if words := one.split():
                            long = len(words) >= MIN_WORDS
                            found = _hash(" ".join(masked(words))) if long else _hash(" ".join(words), 2)
                            row.append(i), line_no.append(k), line.append(found)
                            leaf.append(leaf_of(words) if long else found)
                at = pa.array(row, pa.int64())
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line_no, pa.int64()), _longs(leaf), _longs(line)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "doc", "line_no", "leaf", "line"])

    return docs.where("id IS NOT NULL").select("id", "doc", "text").mapInArrow(
        run, f"id {kind}, doc long, line_no long, leaf long, line long"
    )


def _bitmaps(keys: DataFrame, n_bits: int, *conditions: str) -> list[bytes]:
    """For each condition the bits of the slots of those ``key`` that meet it, tables of fixed size put together in Spark."""
    slot = F.shiftrightunsigned("key", 64 - n_bits)
    bits = [F.expr(f"bitmap_construct_agg(bit) FILTER (WHERE {c})") for c in conditions]
    rows = keys.withColumns({"b": F.bitmap_bucket_number(slot + 1), "bit": F.bitmap_bit_position(slot + 1)}).groupBy("b").agg(*bits)
    found = [bytearray((1 << n_bits) // 8) for _ in conditions]
    for b, *own in rows.collect():
        for out, some in zip(found, own):
            out[(b - 1) * len(some) : b * len(some)] = some
    return [bytes(out) for out in found]


def _among(keys: np.ndarray, bits: bytes, n_bits: int) -> np.ndarray:
    """Which of ``keys`` a bitmap lets through."""
    slot = (keys.view(np.uint64) >> np.uint64(64 - n_bits)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7) & 1).astype(bool)


def _met(parsed: DataFrame, bits: bytes) -> DataFrame:
    """Lines of ``parsed`` in leaves that the bitmap lets through."""
    held = parsed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_among(batch.column(3).to_numpy(), held.value, LEAF_BITS)))

    return parsed.mapInArrow(run, parsed.schema)


def _worded(docs: DataFrame, bits: bytes) -> DataFrame:
    """(line, low, high, often, keys) of the long lines in leaves that the bitmap lets through: smallest and largest document,
    occurrences, a key for each leaf, place and word. A line may come several times, with other occurrences each time."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, places, low, high, often, keys, ends = held.value, {}, [], [], [], [], [0]

        def taken() -> pa.RecordBatch:
            longs = [pa.array(x, pa.int64()) for x in (low, high, often)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(keys))
            return pa.RecordBatch.from_arrays([_longs(list(places)), *longs, listed], ["line", "low", "high", "often", "keys"])

        for batch in batches:
            for a, b in parts(batch.column(1)):
                for doc, text in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns)):
                    for one in (text or "").split("\n"):
                        words = one.split()
                        if len(words) < MIN_WORDS:
                            continue
                        leaf = leaf_of(words)
                        slot = leaf >> (64 - LEAF_BITS)
                        if not bits[slot >> 3] >> (slot & 7) & 1:
                            continue
                        words = masked(words)
                        line = _hash(" ".join(words))
                        at = places.setdefault(line, len(places))
                        if at < len(often):
                            low[at], high[at], often[at] = min(low[at], doc), max(high[at], doc), often[at] + 1
                            continue
                        low.append(doc), high.append(doc), often.append(1)
                        own = f"{leaf - (leaf >> 63 << 64)} "
                        keys += [_hash(f"{own}{k} {w}") for k, w in enumerate(words)]
                        ends.append(len(keys))
                if len(keys) >= HELD:
                    yield taken()
                    places, low, high, often, keys, ends = {}, [], [], [], [], [0]
        yield taken()

    # a line of another leaf that the bitmap lets through stands alone in it: its words make it a template of its own
    return docs.where("id IS NOT NULL").select("doc", "text").mapInArrow(run, "line long, low long, high long, often long, keys array<long>")


def _placed(worded: DataFrame, bits: bytes) -> DataFrame:
    """(line, most, keys) of the lines of which the bitmap lets at least ``most`` keys through, as many as a template has."""
    held = worded.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            good = _among(keys, held.value, KEY_BITS)
            row = np.repeat(np.arange(len(n)), n)
            left, most = np.bincount(row[good], minlength=len(n)), (SIMILAR * n.astype(np.int64) + 99) // 100
            enough = left >= most
            ends = np.concatenate(([0], np.cumsum(left[enough]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[good & enough[row]]))
            cols = [batch.column(0).filter(pa.array(enough)), pa.array(most[enough]), listed]
            yield pa.RecordBatch.from_arrays(cols, ["line", "most", "keys"])

    return worded.select("line", "keys").mapInArrow(run, "line long, most long, keys array<long>")


def _generalised(worded: DataFrame) -> DataFrame:
    """(line, template), written: the template of every line whose constants are enough."""
    agreed = worded.select("low", "high", "often", F.explode("keys").alias("key")).groupBy("key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("often").alias("n_word")
    )
    agreed = stage(agreed.where("low != high").select("key", "n_word"), "templates-constants")
    placed = _placed(worded, *_bitmaps(agreed, KEY_BITS, "true")).dropDuplicates(["line"])
    counted = placed.select("line", "most", F.explode("keys").alias("key")).join(agreed, "key")
    constants = F.array_sort(F.collect_list(F.struct((-F.col("n_word")).alias("order"), "key")))
    found = counted.groupBy("line", "most").agg(constants.alias("constants")).where("size(constants) >= most")
    # an order-free digest of the constants and their places; a key holds its leaf, and that the number of words
    taken = F.array_sort(F.transform(F.slice("constants", 1, F.col("most").cast("int")), lambda c: c["key"]))
    found = stage(found.select("line", F.xxhash64(taken).alias("template")), "templates-general")
    discard(agreed)
    return found


def recurring(docs: DataFrame) -> DataFrame:
    """(id, doc, line_no) of the lines to drop from ``docs`` (id, doc, text), as a written table."""
    parsed = stage(_parsed(docs), "templates-lines")
    leaves = parsed.groupBy(F.col("leaf").alias("key")).agg(
        F.min("doc").alias("x"), F.max("doc").alias("y"), (F.min("line") != F.max("line")).alias("many")
    )
    shared, mixed = _bitmaps(leaves.where("x != y"), LEAF_BITS, "true", "many")
    met = stage(_met(parsed, shared), "templates-met")
    discard(parsed)
    worded = stage(_worded(docs, mixed), "templates-words")
    general = _generalised(worded)
    discard(worded)
    named = met.join(general, "line", "left").withColumn("template", F.coalesce("template", "line"))
    known = named.groupBy("template").agg(
        F.min("doc").alias("x"), F.max("doc").alias("y"), F.min(F.struct("id", "doc", "line_no")).alias("kept")
    ).where("x != y").select("template", "kept")
    known = stage(known, "templates-known")  # a table of known size, so a hot template's rows are split in the join
    drops = named.join(known, "template").where("NOT (id = kept.id AND doc = kept.doc AND line_no = kept.line_no)")
    drops = stage(drops.select("id", "doc", "line_no"), "templates-drops")
    discard(met, general, known)
    return drops


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without its recurring lines, all columns as they were.

    ``counts`` adds n_lines and n_dropped (long); a clashing name gets underscores in front.
    """
    names = list(docs.columns)
    at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = F.col(f"c{at}"), F.col(f"c{text_at}")
    keyed = plain.withColumn("doc", F.xxhash64(id_, text))
    drops = recurring(keyed.select(id_.alias("id"), "doc", text.alias("text")))
    drops = drops.groupBy("id", "doc").agg(F.collect_set(F.col("line_no").cast("int")).alias("drops"))
    same = (id_ == drops["id"]) & (keyed["doc"] == drops["doc"])
    joined = keyed.join(drops, same, "left").select(*plain.columns, "drops")
    # a text is taken apart once, not for each of its lines
    cut = let(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda k: F.get(lines, k)
    ), "\n"))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    done = joined.select(
        *[F.when(F.col("drops").isNull(), text).otherwise(cut).alias(c) if c == f"c{text_at}" else F.col(c) for c in plain.columns],
        F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n_lines).cast("long").alias("a"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("b"),
    )
    if not counts:
        return done.drop("a", "b").toDF(*names)
    first = unused("n_lines", names)
    return done.toDF(*names, first, unused("n_dropped", [*names, first]))
