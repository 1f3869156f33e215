"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import in_slices

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Entropy looks at these strings; a class is (name, pattern of the whole string, least bits a character in some window).
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+\Z", re.DOTALL), 2.9),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+\Z", re.DOTALL), 3.6),
)
#: Where that finds nothing, each of these runs inside counts by the first class that it is of. Least bits: about the lowest
#: hundredth of random runs of 20 characters. The patterns ask for kinds that change often, as they don't in names and numbered words.
RUN = re.compile(r"[A-Za-z0-9]{20,}")
RUN_CLASSES = (
    *CLASSES,
    ("lower", re.compile(r"(?=[a-z]+[0-9]+[a-z]+[0-9]|[0-9]+[a-z]+[0-9]+[a-z])[a-z0-9]+\Z"), 3.35),
    ("upper", re.compile(r"(?=[A-Z]+[0-9]+[A-Z]|[0-9]+[A-Z]+[0-9])[A-Z0-9]+\Z"), 3.25),
    ("letters", re.compile(r"(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+\Z"), 3.6),
)
#: Strings that look random and are no secrets.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"\d{4}-\d{2}-\d{2}[-_T0-9]*"),  # date
    re.compile(r"(.{1,4})\1{4,}.?"),  # a short unit repeated
    re.compile(r"(?=.*EXAMPLE).*"),  # placeholders of documentation
)
WINDOW = 20


def most_entropy(text: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy, bits a character, of a window of ``text`` (the whole text if shorter).

    Moving on by one character changes two counts, so two terms of the sum of n * log2(n).
    """
    size = min(window, len(text))
    if not size:
        return 0.0
    term = [0.0] + [n * math.log2(n) for n in range(1, size + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
        if i >= size - 1:
            least = min(least, total)
    return math.log2(size) - least / size


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' spans."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _secret(text: str, classes: Iterable[tuple], allow: Iterable[re.Pattern]) -> bool:
    """Whether ``text`` is of some class, and a window of it at or above the entropy of the first such class."""
    for name, kind, least in classes:
        if kind.match(text):
            # Letters alone: a quarter of either case at least, which CamelCase hasn't.
            mixed = name != "letters" or 4 <= 16 * sum(map(str.isupper, text)) / len(text) <= 12
            return mixed and not any(x.fullmatch(text) for x in allow) and most_entropy(text) >= least
    return False


def find_entropy(text: str, allow: Iterable[re.Pattern] = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidate strings of some class with a window at or above that class's entropy.

    Of a candidate that isn't one as a whole (a key joined to a name by = or _), the runs of letters and digits that are.
    Letters of a single case are never found: long words have as much entropy.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        if _secret(m[0], CLASSES, allow):
            found.append((m.start(), 3, m.end()))
        elif not any(x.fullmatch(m[0]) for x in allow):
            runs = RUN.finditer(text, m.start(), m.end())
            found += [(x.start(), 3, x.end()) for x in runs if _secret(x[0], RUN_CLASSES, allow)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, upto = [], 0
    for a, _, b in spans:
        if a >= upto:
            out += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are kind:start:end in code points, end exclusive, by start and then kind as in ``KINDS``;
    ``base_sha256`` is over the fixed patterns' spans alone, ``spans`` has all. Null and empty texts have none
    (the hash is that of the empty string); equal rows, null ids and other columns make no difference.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
        for batch in in_slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = find_base(text or "")
                extra = find_entropy(text or "")
                kinds = [k for _, k, _ in base]
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(3)), sha, joined(sorted(base + extra)), len(extra)))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``; all rows and columns stay, null text stays null."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            texts = [
                t and redacted(t, sorted(find_base(t) + find_entropy(t)), mark) for t in batch.column(at).to_pylist()
            ]
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
