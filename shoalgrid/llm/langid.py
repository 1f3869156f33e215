"""Language identification by unigram models that sum over all segmentations."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.store import in_slices, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language, about, that the piece probabilities are learned from.
TRAIN_DOCS = 4_000
#: Probability of a character that is no piece.
FLOOR = 1e-6
#: Words of up to so many characters are scored many at a time; the sums of longer ones would leave the range of doubles
#: and are taken by their logs, a word at a time. The result is the same.
LONGEST = 32
#: Words whose scores a task remembers.
REMEMBERED = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a public SentencePiece vocabulary that stand for text; U+2581 marks a word's start."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no SentencePiece vocabulary at {path}: give the path of one")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _codes(words: Sequence[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), size).astype(np.uint64)


class Segmenter:
    """Forward sums over all segmentations of words into pieces, for several languages at once.

    probability: pieces by languages.
    """

    def __init__(self, vocabulary: Sequence[str], probability: np.ndarray):
        self.none = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        self.languages = probability.shape[1]
        # One row more for strings that are no piece, and one for characters that are none.
        self.p = np.vstack([probability, np.zeros(self.languages), np.full(self.languages, FLOOR)])
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)
        # Beginnings of pieces by their hash, and the piece that a beginning is as a whole.
        sizes = np.array([len(v) for v in vocabulary], dtype=np.int64)
        hashes, own = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for size in np.unique(sizes):
            ids = np.flatnonzero(sizes == size)
            codes = _codes([vocabulary[i] for i in ids], int(size))
            h = np.zeros(len(ids), dtype=np.uint64)
            for k in range(int(size)):
                h = self._step(h, codes[:, k])
                hashes.append(h)
                own.append(ids if k + 1 == size else np.full(len(ids), self.none))
        hashes, own = np.concatenate(hashes), np.concatenate(own)
        order = np.lexsort((own, hashes))
        first = np.append(True, np.diff(hashes[order]) != 0)[: len(order)]
        self.keys = np.append(hashes[order][first], np.uint64(0))
        self.piece = np.append(own[order][first], self.none)
        self.nothing = len(self.keys) - 1
        # Hash tables from some bits of the key to the beginning; what finds its place taken goes to the next, by other bits.
        self.tables, left, shift = [], np.arange(self.nothing), 0
        while len(left):
            table = np.full(1 << _TABLE_BITS, self.nothing, dtype=np.int32)
            table[self._slot(self.keys[left], shift)] = left
            self.tables.append((shift, table))
            left = left[table[self._slot(self.keys[left], shift)] != left]
            shift += 11

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * _BASE
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def _beginnings(self, h: np.ndarray) -> np.ndarray:
        """The beginning of a piece that has each hash, ``nothing`` if none has."""
        out = np.full(len(h), self.nothing, dtype=np.int64)
        for shift, table in self.tables:
            own = table[self._slot(h, shift)]
            out = np.where(self.keys[own] == h, own, out)
        return out

    def _found(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray | slice, np.ndarray]]:
        """(start, size, which words, their pieces) by start for words of one length."""
        found = []
        for i in range(codes.shape[1]):
            active, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
            for size in range(1, min(self.longest, codes.shape[1] - i) + 1):
                h = self._step(h, codes[active, i + size - 1])
                node = self._beginnings(h)
                own = self.piece[node]
                if size == 1:
                    found.append((i, 1, slice(None), np.where(own == self.none, self.none + 1, own)))
                elif (own != self.none).any():
                    found.append((i, size, active[own != self.none], own[own != self.none]))
                active, h = active[node != self.nothing], h[node != self.nothing]
                if not len(active):
                    break
        return found

    def _forward(self, found: list, n: int, size: int) -> np.ndarray:
        a = np.zeros((size + 1, n, self.languages))
        a[0] = 1
        for i, k, which, own in found:
            a[i + k, which] += a[i, which] * self.p[own]
        return a

    def _by_length(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, codes) of words of one length, the word mark before each; longer words than LONGEST one at a time."""
        lengths = np.array([len(w) for w in words])
        for size in np.unique(lengths):
            where = np.flatnonzero(lengths == size)
            for part in np.array_split(where, len(where) // 8192 + 1 if size <= LONGEST else len(where)):
                yield part, _codes(["▁" + words[i] for i in part], int(size) + 1)

    def _ending(self, codes: np.ndarray) -> np.ndarray:
        """Of one word: the piece of size longest, ..., 2, 1 that ends at each place (places by sizes)."""
        out = np.full((len(codes), self.longest), self.none, dtype=np.int32)
        h = np.zeros(len(codes), dtype=np.uint64)
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = self._step(h[: len(codes) - size + 1], codes[size - 1 :])
            out[size - 1 :, self.longest - size] = self.piece[self._beginnings(h)]
        out[:, -1] = np.where(out[:, -1] == self.none, self.none + 1, out[:, -1])
        return out

    def _log_forward(self, ids: np.ndarray) -> np.ndarray:
        """Logs of the forward sums of one word up to each place, from the pieces that end there."""
        size, width = ids.shape
        sums = np.full((width + size, self.languages), -np.inf)
        sums[width - 1] = 0
        for j in range(size):
            terms = sums[j : j + width] + self.log_p[ids[j]]
            most = terms.max(axis=0)
            sums[j + width] = most + np.log(np.exp(terms - most).sum(axis=0))
        return sums[width - 1 :]

    def log_probability(self, words: Sequence[str]) -> np.ndarray:
        """Words by languages: log of the sum over all segmentations of the whole word."""
        out = np.zeros((len(words), self.languages))
        for where, codes in self._by_length(words):
            if codes.shape[1] <= LONGEST + 1:
                out[where] = np.log(self._forward(self._found(codes), len(where), codes.shape[1])[-1])
            else:
                out[where] = self._log_forward(self._ending(codes[0]))[-1]
        return out

    def expected(self, words: Sequence[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected number of each piece in each language, words counted by ``counts`` (words by languages), and the log likelihood."""
        sums = np.zeros((self.none + 2, self.languages))
        likelihood = 0.0

        def add(seen: list[tuple[np.ndarray, np.ndarray]]) -> None:
            own, n = (np.concatenate(x) for x in zip(*seen))
            for g in range(self.languages):
                sums[:, g] += np.bincount(own, weights=n[:, g], minlength=len(sums))

        for where, codes in self._by_length(words):
            size = codes.shape[1]
            if size <= LONGEST + 1:
                found = self._found(codes)
                a = self._forward(found, len(where), size)
                b = np.zeros_like(a)
                b[size] = 1
                for i, k, which, own in reversed(found):
                    b[i, which] += b[i + k, which] * self.p[own]
                share = counts[where] / a[size]
                likelihood += float((counts[where] * np.log(a[size])).sum())
                add([(own, a[i, which] * self.p[own] * b[i + k, which] * share[which]) for i, k, which, own in found])
            else:
                # The sum from a place on is the forward sum of the same pieces read from the end.
                ids = self._ending(codes[0])
                back = np.full_like(ids, self.none)
                for k in range(1, self.longest + 1):
                    back[k - 1 :, self.longest - k] = ids[k - 1 :, self.longest - k][::-1]
                a, b = self._log_forward(ids), self._log_forward(back)[::-1]
                whole = a[-1]
                likelihood += float((counts[where] * whole).sum())
                each = [(k, ids[k - 1 :, self.longest - k]) for k in range(1, min(self.longest, size) + 1)]
                add([(own, np.exp(a[: size - k + 1] + self.log_p[own] + b[k:] - whole) * counts[where]) for k, own in each])
        return sums[: self.none], likelihood


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(text: str) -> list[str]:
    """The words that are learned from and scored: runs without white space, in lower case."""
    return text.lower().split()


def _counted(batches: Iterator) -> Iterator:
    """(lang, text) batches to (lang, word, n)."""
    import pyarrow as pa

    for batch in in_slices(batches):
        n: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            n.update((lang, w) for w in words_of(text.as_py()))
        if n:
            lang, word = zip(*n)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n.values(), pa.int64())], names=["lang", "word", "n"])


def train(
    docs: DataFrame, vocabulary: Sequence[str], train_docs: int = TRAIN_DOCS, smoothing: float = 0.1, settled: float = 1e-3, rounds: int = 100
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces by languages), by expectation-maximisation.

    docs: (doc_id, text, lang). Learns from about ``train_docs`` documents a language, those of least hash of the
    id, until the log likelihood gains less than the share ``settled`` in a round; raises an error if it has not
    settled in ``rounds``. Words are counted and their expected pieces summed by Spark; what comes to the driver is a
    number for each piece and language.
    """
    spark = docs.sparkSession
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((len(vocabulary), 0))
    share = F.create_map(*[F.lit(x) for g in languages for x in (g, min(1.0, train_docs / counts[g]))])
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.filter(place < share[F.col("lang")]).select("lang", "text")
    words = sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), "words")
    index = {g: i for i, g in enumerate(languages)}
    p = np.full((len(vocabulary), len(languages)), 1 / len(vocabulary))
    before = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((list(vocabulary), p, index))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            own, prob, at = shared.value
            segmenter, sums, likelihood, held = Segmenter(own, prob), 0, 0.0, []

            def add() -> None:
                nonlocal sums, likelihood, held
                counted = np.zeros((len(held), len(at)))
                counted[np.arange(len(held)), [at[g] for g, _, _ in held]] = [n for _, _, n in held]
                more, part = segmenter.expected([w for _, w, _ in held], counted)
                sums, likelihood, held = sums + more, likelihood + part, []

            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns))
                if len(held) > 50_000:
                    add()
            if held:
                add()
            if isinstance(sums, np.ndarray):
                piece, g = np.nonzero(sums)
                columns = [np.append(piece, -1), np.append(g, 0), np.append(sums[piece, g], likelihood)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["piece", "g", "n"])

        sums = words.mapInArrow(run, "piece long, g long, n double").groupBy("piece", "g").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        likelihood = float(sums.loc[sums["piece"] < 0, "n"].sum())
        sums = sums[sums["piece"] >= 0]
        p = np.full(p.shape, smoothing)
        p[sums["piece"], sums["g"]] += sums["n"]
        p /= p.sum(axis=0)
        if before is not None and likelihood - before <= settled * abs(before):
            return languages, p
        before = likelihood
    raise RuntimeError(f"piece probabilities did not settle in {rounds} rounds")


def predict(docs: DataFrame, vocabulary: Sequence[str], languages: Sequence[str], p: np.ndarray) -> DataFrame:
    """(doc_id, held_out, text) to doc_id, held_out, lang_pred and score, the posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast((list(vocabulary), list(languages), p))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, names, prob = shared.value
        segmenter = Segmenter(own, prob)
        known: dict[str, int] = {}
        logs = np.zeros((0, len(names)))

        def totals(words: list[str]) -> np.ndarray:
            nonlocal known, logs
            new = list({w for w in words if w not in known})
            if new:
                if len(known) + len(new) > REMEMBERED:
                    known, logs, new = {}, np.zeros((0, len(names))), list(set(words))
                known.update(zip(new, range(len(logs), len(logs) + len(new))))
                logs = np.vstack([logs, segmenter.log_probability(new)])
            return logs[np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))]

        for batch in batches:
            found: list[tuple[str, float]] = [("und", 0.0)] * batch.num_rows
            held: list[tuple[int, int]] = []
            words: list[str] = []

            def score(held: list, words: list) -> None:
                rows = totals(words)
                ends = np.cumsum([n for _, n in held])
                upto = np.vstack([np.zeros(len(names)), np.cumsum(rows, axis=0)])
                for (i, n), e in zip(held, ends):
                    odds = upto[e] - upto[e - n]
                    odds = np.exp(odds - odds.max())
                    found[i] = (names[int(odds.argmax())], float(odds.max() / odds.sum()))

            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                if names and text and any(map(str.isalpha, text)):
                    mine = words_of(text)
                    held.append((i, len(mine)))
                    words += mine
                    if len(words) > 50_000:
                        score(held, words)
                        held, words = [], []
            if held:
                score(held, words)
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(
    docs: DataFrame, path: str = VOCABULARY, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score (0 to 1).

    Learns piece probabilities per language from texts with a language that are not held out; a text's probability
    is the product over its words of the sums over their segmentations into pieces of the fixed vocabulary at
    ``path`` (words and pieces in lower case; a character that is no piece has a small fixed probability).

    Of languages equally probable the first by name is given. Null texts and those without a letter (a numeral is none)
    are ``und`` with score 0, as is everything if there is nothing to learn
    from; a null id counts as empty text for the split; equal rows are predicted alike; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).withColumn("held_out", held_out("doc_id"))
    vocabulary = pieces(path)
    known = rows.filter("not held_out AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    languages, p = train(known, vocabulary, train_docs)
    return predict(rows, vocabulary, languages, p)
