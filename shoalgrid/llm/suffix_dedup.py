"""Suffix-array deduplication: most-significant-digit passes over suffixes, only as deep as the threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shoalgrid.llm.store import written

#: First digit: a suffix is filed under the k-gram of least hash among those inside its first ``threshold`` bytes.
GRAM = 32
#: Second digit: suffixes filed under one place go in blocks of this many starts.
BLOCK = 8
#: Bytes hashed at a time; a longer text is cut into pieces (the order found does not depend on the cuts).
PIECE = 1 << 20
#: So many pieces of a task are thinned together before the shuffle.
HELD = 8
#: One document in so many shows which k-grams are hot: those with HOT_LEAST units there and one unit in HOT_SHARE, so at
#: most HOT_SHARE of them. What is filed under a hot one is dealt to HOT_SALTS tasks.
HOT_SAMPLE, HOT_LEAST, HOT_SHARE, HOT_SALTS = 64, 32, 100_000, 64
#: A null id inside.
NO_ID = -(1 << 63)
#: Marks a packed place of a hot k-gram.
_HOT = 128
#: Places in a buffer, which pass for the low bits of a hash: no buffer is longer.
PLACES = 1 << 21
_PLACE = np.uint64(PLACES - 1)
#: Constants of two independent hash functions of 64 bits.
_LANES = [
    [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)],
    [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)],
]


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _LANES[lane][3]
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    c = _LANES[lane]
    return _mixed(a * c[0] + _mixed(b * c[1] + c[2], lane), lane)


def gram_hashes(buf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of the 32-byte string at each place, and two independent ones of the 64-byte string, each from two of half its length."""
    h32, h64 = [], []
    for lane in (0, 1):
        h = np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), strides=(1,))
        for half in (8, 16):
            h = _pair(h[:-half], h[half:], lane)
        h32.append(h)
        h64.append(_pair(h[:-32], h[32:], lane))
    return h32[0], h64


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (leftmost of ties) among ``width`` in a row, for each first place."""
    x = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    if rest:
        x = np.minimum(x[:-rest], x[rest:])
    return (x & _PLACE).astype(np.int64)


def _span_hash(h64: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Two hashes of text[start : start + length], 64 <= length <= 192, each from three 64-byte hashes that cover it."""
    rest = length - 64
    return [_pair(_pair(h[start], h[start + rest // 2], k), h[start + rest] + length.astype(np.uint64), k) for k, h in enumerate(h64)]


def units(buf: np.ndarray, ends: np.ndarray, threshold: int) -> dict[str, np.ndarray]:
    """Units of suffixes that are filed under one place of ``buf``: key (of the k-gram there), rest and rest2 (of the whole
    string that the unit's first ``threshold`` bytes cover), start and n (how many starts in a row).

    ends: where the text ends that each byte is in; suffixes shorter than the threshold are in no unit.
    """
    h32, h64 = gram_hashes(buf)
    n = len(buf) - threshold + 1
    at = _least(h32, threshold - GRAM + 1)[:n]
    valid = np.arange(threshold, threshold + n) <= ends[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | (ends[1:n] != ends[: n - 1])
    start = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append((new | ~valid)[1:], True) & valid) + 1
    size = stop - start
    rest, rest2 = _span_hash(h64, start, size + (threshold - 1))
    return {"key": h32[at[start]], "rest": rest, "rest2": rest2, "start": start, "n": size}


def blocks(buf: np.ndarray, start: np.ndarray, n: np.ndarray, threshold: int) -> dict[str, np.ndarray]:
    """The next digit for units: aligned blocks of BLOCK starts before a unit's place.

    unit (index), key: of the string that all starts of a whole block share; rest and rest2: of what the block's own
    starts cover; start, n, slot (of its first start, counted down to 0) and digit (n by BLOCK by 2, 128 bits of each whole string).
    """
    h32, h64 = gram_hashes(buf)
    last = start + n - 1
    place = last + np.argmin(h32[last[:, None] + np.arange(threshold - GRAM + 1)] & ~_PLACE, axis=1)
    unit = np.repeat(np.arange(len(n)), n)
    each = np.arange(len(unit)) + np.repeat(start - (np.cumsum(n) - n), n)
    offset = place[unit] - each
    group, slot = offset // BLOCK, offset % BLOCK
    new = np.ones(len(unit), dtype=bool)
    new[1:] = (unit[1:] != unit[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(unit)))
    core = place[unit[first]] - group[first] * BLOCK
    key = _pair(_pair(h64[0][core], h64[0][core + threshold - BLOCK + 1 - 64]), (place[unit[first]] - core).astype(np.uint64))
    digit = np.zeros((len(first), BLOCK, 2), dtype="<u8")
    digit[np.repeat(np.arange(len(first)), count), slot] = np.stack([_pair(h[each], h[each + threshold - 64], k) for k, h in enumerate(h64)], axis=1)
    rest, rest2 = (_pair(h, slot[first].astype(np.uint64), k) for k, h in enumerate(_span_hash(h64, each[first], count + (threshold - 1))))
    return {"unit": unit[first], "key": key, "rest": rest, "rest2": rest2, "start": each[first], "n": count, "slot": slot[first], "digit": digit}


def removed_mask(size: int, kept: np.ndarray, threshold: int) -> np.ndarray:
    """Which bytes of a text go, given the suffixes that are first of their kind as packed (start, n)."""
    if size < threshold:
        return np.zeros(size, dtype=bool)
    starts = size - threshold + 1
    step = np.zeros(starts + 1, dtype=np.int64)
    np.add.at(step, kept >> 8, 1)
    np.add.at(step, (kept >> 8) + (kept & 127), -1)
    gone = np.cumsum(step[:-1]) == 0
    edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
    cover = np.zeros(size + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(edge == 1), 1)
    np.add.at(cover, np.flatnonzero(edge == -1) + threshold - 1, -1)
    return np.cumsum(cover[:-1]) > 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8", copy=False).view("<i8")


def _salts(hot: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """0, or for hot rows 1 and more by ``rest``."""
    return np.where(hot, rest.astype("<u8", copy=False) % np.uint64(HOT_SALTS) + np.uint64(1), np.uint64(0)).astype(np.int64)


#: Columns of the rows of a pass; equal key, rest and rest2 are equal strings.
ROWS = "key long, rest long, rest2 long, doc long, twin long, at long, salt long"


def _batch(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def _arrow_units(threshold: int, hot_keys: np.ndarray):
    """(doc, twin, text) batches to units, of equal ones in some pieces the first; at packs start, whether hot, and n."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        def found_in(held: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
            lengths = np.array([len(t) for *_, t in held])
            begin = np.cumsum(lengths) - lengths
            found = units(np.frombuffer(b"".join(t for *_, t in held), np.uint8), np.repeat(begin + lengths, lengths), threshold)
            which = np.searchsorted(begin, found["start"], side="right") - 1
            doc, twin, shift = (np.array([x[i] for x in held], dtype=np.int64)[which] for i in range(3))
            key = _signed(found["key"])
            hot = np.isin(key, hot_keys)
            at = (found["start"] - begin[which] + shift) << 8 | hot * _HOT | found["n"]
            return [key, _signed(found["rest"]), _signed(found["rest2"]), doc, twin, at, _salts(hot, found["rest"])]

        def thinned(parts: list[list[np.ndarray]]) -> Iterator:
            columns = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort(columns[5::-1])
            key, rest, rest2 = (x[order] for x in columns[:3])
            new = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]) | (rest2[1:] != rest2[:-1])
            order = order[np.append(True, new)[: len(key)]]
            for a in range(0, len(order), 100_000):
                yield _batch([x[order[a : a + 100_000]] for x in columns], names)

        held, size, parts = [], 0, []
        for batch in batches:
            for doc, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                for a in range(0, max(0, len(text) - threshold + 1), PIECE):
                    part = text[a : a + PIECE + threshold - 1]
                    if size + len(part) > PLACES:
                        parts.append(found_in(held))
                        held, size = [], 0
                    held.append((doc, twin, a, part))
                    size += len(part)
                    if size >= PIECE:
                        parts.append(found_in(held))
                        held, size = [], 0
                    if len(parts) == HELD:
                        yield from thinned(parts)
                        parts = []
        if held:
            parts.append(found_in(held))
        if parts:
            yield from thinned(parts)

    return run


def _arrow_first(batches: Iterator) -> Iterator:
    """Rows sorted by key, rest, rest2, doc, twin, at: the first of each string, and whether its key has another (``open``).

    A salted key has its strings in several tasks and counts as open.
    """
    import pyarrow as pa

    last = None  # the newest first row, its key and string, and whether the one before has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*batch.schema.names, "open"]
        salted = batch.column(batch.schema.get_field_index("salt")).to_numpy() > 0
        key, rest, rest2 = (batch.column(k).to_numpy() for k in range(3))
        new = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]) | (rest2[1:] != rest2[:-1])
        new = np.append(last is None or (key[0], rest[0], rest2[0]) != last[1], new)
        rows = np.flatnonzero(new)
        if not len(rows):
            continue
        k = key[rows]
        before = np.append(last is not None and k[0] == last[1][0], k[1:] == k[:-1]) | salted[rows]
        out = batch.take(pa.array(rows))
        if last is not None:
            yield _batch([*last[0].columns, pa.array([bool(last[2] or (before[0] and k[0] == last[1][0]))])], names)
        ready = out.slice(0, len(rows) - 1)
        yield _batch([*ready.columns, pa.array(before[:-1] | (before[1:] & (k[1:] == k[:-1])), pa.bool_())], names)
        at = rows[-1]
        last = (out.slice(len(rows) - 1), (k[-1], rest[at], rest2[at]), bool(before[-1]))
    if last is not None:
        yield _batch([*last[0].columns, pa.array([last[2]])], [*last[0].schema.names, "open"])


def _first_of_each(rows: DataFrame) -> DataFrame:
    """One radix pass: rows go to the task of their key (and salt) and are sorted there; groups stream by, whatever their size."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    order = rows.repartition("key", "salt").sortWithinPartitions("key", "rest", "rest2", "doc", "twin", "at")
    return order.mapInArrow(_arrow_first, f"{schema}, open boolean")


def _arrow_blocks(threshold: int):
    """(doc, twin, text, ats) batches to blocks with their digits; at packs start, slot and n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def emit(held: list[tuple[int, int, bytes, np.ndarray, int]]) -> pa.RecordBatch:
            """held: doc, twin, a stretch of the text, units there (packed) and where the stretch starts."""
            lengths = np.array([len(x[2]) for x in held])
            begin = np.cumsum(lengths) - lengths
            which = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
            shift = (np.array([x[4] for x in held]) - begin)[which]
            packed = np.concatenate([x[3] for x in held])
            found = blocks(np.frombuffer(b"".join(x[2] for x in held), np.uint8), (packed >> 8) - shift, packed & 127, threshold)
            at = (found["start"] + shift[found["unit"]]) << 8 | found["slot"] << 4 | found["n"]
            doc, twin = (np.array([x[i] for x in held], dtype=np.int64)[which[found["unit"]]] for i in range(2))
            digit = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16 * BLOCK), len(at), [None, pa.py_buffer(found["digit"].tobytes())])
            salt = _salts((packed & _HOT > 0)[found["unit"]], found["rest"])
            columns = [_signed(found["key"]), _signed(found["rest"]), _signed(found["rest2"]), doc, twin, at, salt, digit.cast(pa.binary())]
            return _batch(columns, ["key", "rest", "rest2", "doc", "twin", "at", "salt", "digit"])

        held, size = [], 0
        for batch in batches:
            for doc, twin, text, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text, packed = text.as_py(), np.sort(packed.values.to_numpy())
                start, n = packed >> 8, packed & 127
                # Units that lie near each other are cut out together, in stretches of PIECE / 2 and a unit at most.
                part = start // (PIECE // 2)
                cuts = np.flatnonzero((start[1:] > (start + n)[:-1] + 2 * threshold) | (part[1:] != part[:-1])) + 1
                for own in np.split(np.arange(len(packed)), cuts):
                    a, b = int(start[own[0]]), int(start[own[-1]] + n[own[-1]]) + threshold - 1
                    held.append((doc, twin, text[a:b], packed[own], a))
                    size += b - a
                    if size >= PIECE // 2:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)

    return run


def _arrow_suffixes(batches: Iterator) -> Iterator:
    """Open blocks to their single starts: (key, digit, digit2, doc, twin, at)."""
    for batch in batches:
        key, doc, twin, at = (batch.column(i).to_numpy() for i in range(4))
        digit = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u8").reshape(-1, BLOCK, 2)
        start, slot, n = at >> 8, at >> 4 & 15, at & 15
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = digit[row, slot[row] - step]
        yield _batch([key[row], _signed(own[:, 0].copy()), _signed(own[:, 1].copy()), doc[row], twin[row], (start[row] + step) << 8 | 1], ["key", "digit", "digit2", "doc", "twin", "at"])


def _arrow_result(threshold: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, kept in zip(batch.column(1), batch.column(2)):
                text = np.frombuffer(text.as_py(), np.uint8)
                kept = kept.values.to_numpy() if kept.is_valid else np.empty(0, dtype=np.int64)
                gone = removed_mask(len(text), kept, threshold)
                spans = int(np.count_nonzero(np.diff(np.append(np.int8(0), gone.view(np.int8))) == 1))
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """(doc, twin, text, ats): the places of each document beside its text."""
    own = places.groupBy(F.col("doc").alias("k"), F.col("twin").alias("j")).agg(F.collect_list("at").alias("ats"))
    return texts.join(own, (texts.doc == own.k) & (texts.twin == own.j), how).select("doc", "twin", "text", "ats")


def hot_grams(texts: DataFrame, threshold: int) -> np.ndarray:
    """Keys that very many units are filed under, by the units of one document in HOT_SAMPLE. They only decide what is salted, not what is found."""
    some = texts.filter(F.pmod(F.xxhash64("doc", "twin"), F.lit(HOT_SAMPLE)) == 0)
    keys = some.mapInArrow(_arrow_units(threshold, np.empty(0, np.int64)), ROWS).groupBy("key", "doc", "twin").count().groupBy("key").count()
    counts = written(keys.filter(F.col("count") >= HOT_LEAST), "grams")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return np.sort(np.array([r["key"] for r in counts.filter(F.col("count") * HOT_SHARE >= total).select("key").collect()], dtype=np.int64))


def first_suffixes(texts: DataFrame, threshold: int = 100) -> DataFrame:
    """(doc, twin, at) of the suffixes of (doc, twin, text) whose first ``threshold`` bytes start nowhere earlier.

    ``at`` packs a start and a number of starts in a row. The digits of a suffix, most significant first: the
    k-gram of least hash inside its first bytes (so equal suffixes have it, and about 30 in a row share it), then
    the string that a block of 8 starts shares, then the whole. A pass deals rows by their digit and sorts; rows
    that agree on everything are copies, a digit that only one kind of row has ends there, and only the rest goes
    on to the next digit.
    """
    long = texts.filter(F.length("text") >= threshold)
    top = long.mapInArrow(_arrow_units(threshold, hot_grams(long, threshold)), ROWS)
    top = written(_first_of_each(top).select("doc", "twin", "at", "open"), "units")
    parts = _with_places(texts, top.filter("open"), "inner")
    parts = parts.mapInArrow(_arrow_blocks(threshold), f"{ROWS}, digit binary")
    only = [F.when(F.col("open"), F.col(c)).alias(c) for c in ("key", "digit")]
    parts = written(_first_of_each(parts).select("doc", "twin", "at", "open", *only), "blocks")
    single = parts.filter("open").select("key", "doc", "twin", "at", "digit").mapInArrow(_arrow_suffixes, "key long, digit long, digit2 long, doc long, twin long, at long")
    single = single.groupBy("key", "digit", "digit2").agg(F.min(F.struct("doc", "twin", "at")).alias("first")).select("first.*")
    start, n = F.shiftright("at", 8), F.col("at").bitwiseAND(F.lit(15).cast("long"))
    closed = parts.filter("not open").select("doc", "twin", F.shiftleft(start, 8).bitwiseOR(n).alias("at"))
    return top.filter("not open").select("doc", "twin", "at").union(closed).union(single)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, text): null ids as the least number; twin is 0, or the text's hash for an id that stands for several texts."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("doc")
    texts = docs.select(doc, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    shared = texts.select("doc", F.xxhash64("text").alias("h")).groupBy("doc").agg((F.min("h") != F.max("h")).alias("several"))
    shared = written(shared.filter("several").select(F.col("doc").alias("k")), "shared-ids")
    if not shared.limit(1).count():
        return texts.select("doc", F.lit(0).cast("long").alias("twin"), "text")
    marked = texts.join(shared, texts.doc == F.col("k"), "left")
    return marked.select("doc", F.when(F.col("k").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("twin"), "text")


def remove_repeats(docs: DataFrame, threshold: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of each text that are covered by a string of ``threshold`` bytes that also starts earlier.

    Earlier is in a document of smaller id, or before in the same one. Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256 (of the bytes that stay). Strings are compared by hashes: a pass groups by 64 bits
    of a shared part, and strings that share it are told apart by 128 bits of the whole string.

    Null and empty texts have 0 bytes and the hash of none; a null id is smaller than all others; rows of one id and
    text are one document seen again and get equal results; different texts of one id (or of none) stand in the order
    of their hashes; other columns are ignored; no rows give none. Ids are whole numbers (text raises TypeError), and the
    least long counts as null.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of a whole number type: its order says which text is earlier")
    if not 64 + BLOCK - 1 <= threshold <= 128:
        raise ValueError("the threshold must be from 71 to 128 bytes")
    texts = _documents(docs, id_col, text_col)
    kept = first_suffixes(texts, threshold)
    out = _with_places(texts, kept, "left").select("doc", "text", "ats")
    out = out.mapInArrow(_arrow_result(threshold), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID).cast("long"), F.col("doc_id")))


REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, CAST(len(x) / 2 - 99 AS BIGINT))) AS i,
             unnest(list_transform(range(0, CAST(len(x) / 2 - 99 AS BIGINT)), lambda i : md5_number(substr(x, 2 * i + 1, 200)))) AS k
      FROM d WHERE len(x) >= 200),
f AS (SELECT k, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM s GROUP BY k HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.k = f.k WHERE s.doc_id <> f.first.doc_id OR s.i <> f.first.i),
o AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 AS joins FROM r),
n AS (SELECT doc_id, i, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
g AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, span),
h AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM g),
t AS (SELECT d.doc_id, any_value(d.x) AS x, sum(h.b - h.a) AS n_removed, count(*) AS n_spans, max(h.b) AS upto,
             string_agg(substr(d.x, 2 * h.upto + 1, 2 * (h.a - h.upto)), '' ORDER BY h.a) AS kept
      FROM d JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN d.x ELSE t.kept || substr(t.x, 2 * t.upto + 1) END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
