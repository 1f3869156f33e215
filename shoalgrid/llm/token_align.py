"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.llm.store import in_slices, written

#: Folder of the public vocabularies; a parameter of ``align``, the files are never copied.
TOKENIZERS = "/opt/tokenizers"
#: Texts go to blocks of about this many bytes (a longer text is a block of its own), which bounds a task's arrays.
BLOCK_BYTES = 1 << 20
#: Longer texts are encoded by the slower of two encoders of the same vocabulary, whose pattern matcher has no stack to overflow.
FAST_CHARS = 100_000
#: Ids of B are below this in a link's number ``a * STRIDE + b``.
STRIDE = 1 << 24

BLOCK_SCHEMA = (
    "block long, doc_id {id}, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "n_links array<long>, links binary, pairs array<long>, counts array<long>"
)


def _byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Tokenizers:
    """Both encoders, with the bytes of every id."""

    def __init__(self, folder: str):
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        letters = _byte_letters()
        path = f"{folder}/byte_bpe_50k.json"
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = {k: bytes(letters[c] for c in piece) for piece, k in vocab.items()}
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        # Ids of a byte-level vocabulary are in the order of its merges, so they serve as ranks.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={v: k for k, v in self.a_bytes.items() if k != vocab.get("<|endoftext|>")}, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        ids = range(self.piece.piece_size())
        plain = {k: self.piece.id_to_piece(k) for k in ids}
        self.b_bytes = {k: bytes([int(p[1:-1], 16)]) if self.piece.is_byte(k) else p.replace("▁", " ").encode() for k, p in plain.items()}

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by A and by B; none where the joined bytes of either are not those of a space and the text."""
        a = self.fast.encode_ordinary(" " + text) if len(text) <= FAST_CHARS else self.slow.encode(" " + text, add_special_tokens=False).ids
        b = self.piece.encode(text, num_threads=1)
        whole = (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
        return (a, b) if same else ([], [])


@lru_cache(maxsize=1)
def _tables(folder: str):
    """The encoders, lengths of ids in bytes, and each id's text before a comma or the end of its part of a group."""
    import numpy as np

    t = _Tokenizers(folder)
    of = lambda found: np.array([len(found.get(k, b"")) for k in range(max(found) + 1)], dtype=np.int64)
    la, lb = of(t.a_bytes), of(t.b_bytes)
    signs = [b"%d," % k for k in range(len(la))] + [b"%d|" % k for k in range(len(la))] + [b"%d," % k for k in range(len(lb))] + [b"%d;" % k for k in range(len(lb))]
    return t, la, lb, signs


def components(a_ends, b_ends):
    """Group labels of A's and B's tokens, given where each ends in one line of bytes that both cover.

    Every token points to the token that overlaps it and reaches farthest right, of the two that end together to B's;
    one that no other outreaches is terminal. Successors of successors, all tokens at once, double the distance a
    round until each token points to the terminal one of its component. Labels are numbers from 0 in order of place.
    """
    import numpy as np

    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)  # B's token over the last byte of each of A's
    over_b = np.minimum(np.searchsorted(a_ends, b_ends), max(n - 1, 0))
    jump = np.concatenate([n + over_a, np.where(a_ends[over_b] > b_ends, over_b, n + np.arange(len(b_ends))) if n else n + np.arange(len(b_ends))])
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    terminal = np.zeros(n + len(b_ends), dtype=np.int64)
    terminal[jump] = 1
    labels = (np.cumsum(terminal) - 1)[jump]
    return labels[:n], labels[n:]


def _aligned(texts: list, folder: str) -> dict:
    """What a block's texts give: per text counts and hash, and all links as numbers in order."""
    import hashlib

    import numpy as np

    t, la, lb, signs = _tables(folder)
    both = [t.encode(x) if x else ([], []) for x in texts]
    n_a, n_b = (np.array([len(x[k]) for x in both], dtype=np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in both for i in x[k]), dtype=np.int64, count=int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    a_ends, b_ends = np.cumsum(la[a]), np.cumsum(lb[b])
    ga, gb = components(a_ends, b_ends)
    a_last, b_last = np.append(ga[1:] != ga[:-1], True)[: len(a)], np.append(gb[1:] != gb[:-1], True)[: len(b)]
    links = a[a_last] * STRIDE + b[b_last]
    # A token's place in the written form: its own kind's earlier tokens and the other kind's of earlier (for B: and of its own) groups.
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + np.searchsorted(gb, ga)] = a + a_last * len(la)
    codes[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = 2 * len(la) + b + b_last * len(lb)
    doc_a = np.concatenate([[0], np.cumsum(n_a)])
    first = np.concatenate([[0], np.cumsum(a_last)])[doc_a]
    hashes, at = [], 0
    for k in (n_a + n_b).tolist():
        written_form = b"".join([signs[c] for c in codes[at : at + k].tolist()])[:-1]
        hashes.append(hashlib.sha256(written_form).hexdigest() if k else "")
        at += k
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(first), "sha": hashes, "links": links}


def _blocks(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        number = TaskContext.get().partitionId() << 33

        def row(ids: list, texts: list):
            got = _aligned(texts, folder)
            pairs, place, counts = np.unique(got["links"], return_inverse=True, return_counts=True)
            line = [[number], [ids], *([got[k]] for k in ("n_a", "n_b", "n_groups", "sha", "n_groups")), [place.astype("<u4").tobytes()], [pairs], [counts]]
            types = [pa.int64(), pa.list_(id_type), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(line, types)], names=names)

        ids, texts, held = [], [], 0
        for batch in in_slices(batches):
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if held and held + len(text) > BLOCK_BYTES:
                    yield row(ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(key)
                texts.append(text)
                held += len(text) + 1
        if ids:
            yield row(ids, texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK_SCHEMA.format(id=f"array<{kind}>"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups_sha256 of every row, by both public tokenizers.

    A block of texts, about 1 MB, is one line of bytes for the pointer jumping; it keeps its links as places in the
    list of its distinct id pairs. Only those lists are counted over the corpus and go back to their blocks, so a
    pair that every text holds has a row a block in the shuffle, not one a text.

    Null and empty texts, and texts that either tokenizer doesn't give back whole, have no tokens: zeros and an empty
    groups_sha256. Equal rows and rows without an id each come back; other columns are ignored; no rows give none.
    """
    blocks = written(_blocks(docs, id_col, text_col, folder), "aligned")
    lists = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", "x.pairs", "x.counts")
    totals = lists.groupBy("pairs").agg(F.sum("counts").alias("total"))
    # A vocabulary bounds the pairs of an id of B: its window holds no more rows than A has ids.
    most = F.max("total").over(Window.partitionBy(F.pmod("pairs", F.lit(STRIDE))))
    totals = written(totals.withColumn("best", F.col("total") == most), "pair_counts")
    back = lists.select("block", "place", "pairs").join(totals, "pairs").groupBy("block")
    back = back.agg(F.collect_list(F.struct("place", "total", "best")).alias("found"))  # as many as the block's distinct pairs
    both = blocks.drop("pairs", "counts").join(back, "block", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "links", "found.place", "found.total", "found.best")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in in_slices(batches, 1):
            row = {n: batch.column(k)[0] for k, n in enumerate(batch.schema.names)}
            ids, sha = row["doc_id"].values, row["groups_sha256"].values
            n_a, n_b, n_groups, n_links = (np.asarray(row[k].values) for k in ("n_a", "n_b", "n_groups", "n_links"))
            links = np.frombuffer(row["links"].as_py(), dtype="<u4")
            total, best = np.zeros(2, dtype=object), np.zeros(0)
            if len(links):
                place = np.asarray(row["place"].values)
                total, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
                total[place], best[place] = np.asarray(row["total"].values), np.asarray(row["best"].values.to_numpy(zero_copy_only=False))
            ends = np.cumsum(n_links)

            def sums(of):
                run = np.concatenate([[0], np.cumsum(of[links])]) if len(links) else np.zeros(1, dtype=np.int64)
                return np.diff(run[np.concatenate([[0], ends])]).astype(np.int64)

            columns = [ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links, sums(best), sums(total))), sha]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
