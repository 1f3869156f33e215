"""Tokenizer alignment, conversation repair and neighbour search against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shoalgrid.llm import conversations, neighbours, token_align

DATA = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, cost string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute_repair(rows):
    """The least (cost, audit) by dynamic programming over prefixes with strings, all ways kept by (state, letters used)."""
    seen, faults = set(), []
    for _, role, text in rows:
        flaw = "b" if not text.strip(SPACE) else "d" if (role, text) in seen else "t" if text.strip(SPACE)[-1] not in ".!?" else "g"
        seen.add((role, text))
        faults.append(flaw)
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    # (state, number of letters) to (cost, audit, output): of one length the least prefix is that of the least whole.
    ways = {("", 0): (0, "", ())}

    def note(into, key, way):
        if key not in into or way[:2] < into[key][:2]:
            into[key] = way

    def with_insertions(ways):
        out = dict(ways)
        todo = list(ways)
        for _ in range(2):
            more = {}
            for state, k in todo:
                cost, audit, lines = out[state, k]
                new = "a" if state == "u" else "u"
                note(more, (new, k + 1), (cost + conversations.INSERT, audit + "I", (*lines, (None, new))))
            todo = []
            for key, way in more.items():
                if key not in out or way[:2] < out[key][:2]:
                    out[key] = way
                    todo.append(key)
        return out

    for at, ((_, role, text), flaw) in enumerate(zip(rows, faults)):
        after = {}
        for (state, k), (cost, audit, lines) in with_insertions(ways).items():
            note(after, (state, k + 1), (cost + 2, audit + "D", lines))
            if flaw in "gt":
                cost += 5 * (flaw == "t")
                for new in moves[state]:
                    if role[:1] == new:
                        note(after, (new, k + 1), (cost, audit + "K", (*lines, (at, None))))
                    if new != "s":
                        note(after, (new, k + 1), (cost + 1, audit + "R", (*lines, (at, new))))
        ways = after
    cost, audit, lines = min(w for (s, _), w in with_insertions(ways).items() if s in ("", "a"))
    names = {"u": "user", "a": "assistant"}
    texts = [f"{names.get(new, rows[at][1] if at is not None else '')}:{rows[at][2] if at is not None else ''}" for at, new in lines]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()


def check_repair(spark, rows, parts=3):
    got = {tuple(r) for r in conversations.repair(spark.createDataFrame(rows, CONV).repartition(parts)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {(conv, *brute_repair(here)) for conv, here in damage(rows).items()}
    assert got == want
    return got


def test_repair_by_brute_force(spark):
    r = random.Random(3)
    texts = ["Yes.", "no", "", " \t", "What?", "Hm!  ", "a. b", None, "é…", "🙂?"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = [(c, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{r.random()}.", "x") for c in [*range(60), None] for _ in range(r.randrange(1, 14))]
    got = check_repair(spark, rows + rows[:9])
    assert len({len(g[-2]) for g in got}) > 5 and any("R" in g[-2] for g in got)


def test_repair_of_whole_tables_and_empty(spark):
    rows = [tuple(r) + ("",) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    check_repair(spark, rows)
    check_repair(spark, rows, 1)
    assert conversations.repair(spark.createDataFrame([], CONV)).count() == 0
    dropped = next(k for k in range(99) if zlib.crc32(f"1:{k}".encode()) % 20 == 0)
    check_repair(spark, [(1, dropped, "user", "Hi.", "")])


def test_repair_of_long_conversations(spark, monkeypatch):
    """One conversation has most rows, one message of it most turns: it lies in many partitions, in several segments each."""
    r = random.Random(5)
    rows = [(7, k, r.choice(["user", "assistant", "system"]), "Same." if r.random() < 0.3 else f"{k}{r.choice(['.', ''])}", "") for k in range(150)]
    rows += [(7, 1600, "user", "Again and again.", "")] * 70 + [(k, 0, "user", "Hi.", "") for k in range(20)]
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 8)
    got = check_repair(spark, rows)
    assert max(len(g[-2]) for g in got) > 200


@pytest.mark.parametrize("cost", [1, 3, 5])
def test_segments_multiply(monkeypatch, cost):
    """Whole conversations and their segments, cut anywhere, give the brute-force audit, also where insertions are cheap enough to be chosen."""
    monkeypatch.setattr(conversations, "INSERT", cost)
    for f in (conversations._row_edges, conversations._insertions, conversations._ends):
        f.cache_clear()
    r, audits = random.Random(cost), ""
    for _ in range(150):
        rows = [(0, r.choice(["user", "assistant", "system", "tool"]), f"{k}" + r.choice([".", ".", ".", ""])) for k in range(r.randrange(1, 12))]
        faults = [(role[:1], "g" if text.endswith(".") else "t") for _, role, text in rows]
        want = brute_repair(rows)[5:7]
        assert conversations.cheapest(faults) == want
        cuts = sorted(r.choices(range(len(rows) + 1), k=3))
        parts = [faults[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        assert conversations.cheapest_of_segments([conversations.segment_table(p) for p in parts]) == want
        audits += want[1]
    for f in (conversations._row_edges, conversations._insertions, conversations._ends):
        f.cache_clear()
    assert ("I" in audits) == (cost < 3)  # at 3 and more, deleting is as cheap and sorts first


def test_scalars():
    """The minimum of integers is the least cost and then the ASCII-least letters, also of a shorter audit and its continuation."""
    made = [(c, x) for c in (0, 3, 7) for n in range(4) for x in itertools.product((1, 2, 3, 4), repeat=n)]
    by_integer = sorted(made, key=lambda m: conversations._one(m[0], list(m[1]), 5))
    assert by_integer == sorted(made)
    assert all(conversations._read(conversations._one(c, list(x), 5), 5) == (c, "".join(" DIKR"[k] for k in x)) for c, x in made)


@pytest.fixture(scope="module")
def tokenizers():
    return token_align._Tokenizers(token_align.TOKENIZERS)


def brute_align(texts):
    import collections

    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{token_align.TOKENIZERS}/byte_bpe_50k.json")
    slow.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.TOKENIZERS}/piece_bpe_32k.model")
    letters = token_align._byte_letters()
    rows, count = [], collections.Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = slow.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in slow.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(piece.id_to_piece, b)]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b = [], []
        a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
        groups, links, at, bt = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)) if a else []:
            i, j = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[at:i])) + "|" + ",".join(map(str, b[bt:j])))
            links.append((a[i - 1], b[j - 1]))
            at, bt = i, j
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for na, nb, ng, links, sha in rows]


ODD = [None, "", "a▁b", " lead", "tail ", "éé", "ﬁ 🙂🙂‍", "<|endoftext|> <s>", "\x00\x01", "\n\n\t x", "日本語テキスト", "x" * 3000, " " * 4000, "one", "one", "�", "don't  we'll"]


def test_align_by_brute_force(spark, monkeypatch):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    rows = [(None if k % 9 == 0 else k, t, "clash", k) for k, t in enumerate(texts)]
    want = sorted(((k, *w) for (k, *_), w in zip(rows, brute_align(texts))), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, place long")
    for size in (2000, 4 << 20):
        monkeypatch.setattr(token_align, "BLOCK_BYTES", size)
        got = sorted((tuple(r) for r in token_align.align(docs.repartition(3)).collect()), key=str)
        assert got == want
    assert any(w[1] for w in want) and token_align.align(docs.limit(0)).count() == 0


def test_long_texts_use_the_same_vocabulary(tokenizers):
    for text in (" " * 150_000 + "x", "ab " * 50_000, "q" * 120_000):
        a, b = tokenizers.encode(text)
        assert a and b and tokenizers.fast.encode_ordinary(" " + text[:90_000]) == tokenizers.slow.encode(" " + text[:90_000], add_special_tokens=False).ids


def test_pointer_jumping():
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 60)
        a, b = (sorted({*r.sample(range(1, n + 1), r.randrange(0, n)), n}) for _ in range(2))
        ga, gb = token_align.components(np.array(a), np.array(b))
        both = sorted(set(a) & set(b))
        place = lambda end: sum(x < end for x in both)
        assert ga.tolist() == [place(x) for x in a] and gb.tolist() == [place(x) for x in b]


def brute_nearest(rows, k=20, every=20):
    import numpy as np

    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = {}
    for q, v in good:
        if q is not None and q % every == 0:
            found = {(-float((w * v).sum()), i is None, i or 0) for i, w in good if i != q}
            want[q] = [(None if none else i, -s) for s, none, i in sorted(found)[:k]]
    return want


def nearest(spark, rows, **kw):
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3), **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    return got


def test_neighbours_recall_and_copies(spark, monkeypatch):
    """Recall with structure and without, on many small lists; a third of all rows are one vector, scores and ties are exact."""
    import numpy as np

    monkeypatch.setattr(neighbours, "LIST_ROWS", 24)
    monkeypatch.setattr(neighbours, "GROUP_VECTORS", 50)
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 7)
    r = np.random.default_rng(1)
    for kind in ("clusters", "noise", "norms"):
        v = r.normal(size=(1200, 12))
        v = v * 0.2 + r.normal(size=(20, 12))[r.integers(20, size=1200)] * 2 if kind == "clusters" else v * r.lognormal(size=(1200, 1)) if kind == "norms" else v
        v[r.permutation(1200)[:400]] = v[0]
        rows = [(int(k), [float(x) for x in v[k]], 1) for k in range(1200)]
        want, got = brute_nearest(rows), nearest(spark, rows)
        assert got.keys() == want.keys()
        hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / len(want[q]) for q in want]
        assert sum(hits) / len(hits) >= 0.9, kind
        assert all(abs(s - v[q] @ v[a]) < 1e-9 for q, x in got.items() for a, s in x)
        same = [q for q in want if rows[q][1] == rows[0][1]]
        assert same and all(got[q] == want[q] for q in same)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (40, [inf, 1.0], 0), (6, [3.0], 0), (7, [0.5, 0.5], 0), (None, [2.0, 2.0], 0), (-20, [-1.0, 1.0], 0)]
    got = nearest(spark, rows)
    six = [(None, 6.0), (20, 5.0), (6, 3.0), (7, 1.5), (-20, 1.0)]
    assert got[0] == six and got[20] == [(None, 6.0), (0, 5.0), (6, 3.0), (7, 1.5), (-20, 1.0)] and set(got) == {0, 20, -20}
    assert nearest(spark, rows[3:8]) == {} and neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearest(spark, [(0, [1.0], 0)]) == {}


def test_neighbours_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), nearest(spark, rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
