"""Secret scans: fixed patterns, and values in credential context judged by what guessing them would cost.

The guess cost is that of the cheapest way to put a value together from segments: dictionary words (also capitalised or
with digit substitutions), dates and years, keyboard walks, alphabet or digit runs, repeats of what stands before, and
brute force for the rest. Costs are log10 of guesses; a segment costs JOIN besides its own. A dynamic program over ends,
with the spans that are still open (brute force, walks, runs, repeats), finds the minimum over all divisions.

The dictionary is a short list of frequent passwords, followed by the words of a public vocabulary in its order of rank.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tokens import default_path
from gleaner.runtime import prepare, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: [A-Z0-9]+ and [0-9a-f]+ of the least length: the same matches as without it and a later test of the length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a value may stand that no fixed pattern takes: names of credentials, then a link word or sign, then a value.
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)|pwd|pass|secret|credentials?|private[_\x20-]key|auth[_\x20-]?(?:key|token)|access[_\x20-](?:key|token)|token|api[_\x20-]?key)["']?\x20*(?:is|was|->|=>|:=|[:=])\x20*["'<(\[]?([^\s"'<>()\[\]]{8,})""",
    re.ASCII | re.IGNORECASE,
)
KINDS = ("assign", "access", "hex", "guess")
#: log10 of guesses from which a value in context counts as a secret.
COSTLY = 10.0
#: The highest cost that is told.
MOST = 64.0
#: The longest dictionary word, and the longest block that is found repeated.
LONGEST, BLOCK = 20, 32
#: log10 of guesses: another segment; a character by brute force, and of a walk, run or repeat beyond its start; the start
#: of a walk or run of three characters, of one character repeated three times, and of a repeat (and log10 of its distance).
JOIN, BRUTE, STEP, WALK, RUN, SAME, AGAIN = 0.3, 1.0, 0.002, 1.7, 1.3, 1.0, 0.5

# Frequent words of passwords, most frequent first.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow michael "
    "superman batman trustno1 hello freedom whatever secret test guest root user changeme default example love baseball jordan hunter "
    "summer winter spring autumn january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday server database system access computer internet service company account office public "
    "private token key pass word the and for you are not this that with from have time good day new house cat dog blue red green black "
    "white happy lucky magic star king queen angel flower cookie coffee orange apple banana cheese chocolate"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
ROWS = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
YEAR = re.compile(r"(?:19|20)\d\d")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
_ranks: dict[str, dict[str, float]] = {}


def ranks(path: str | None = None) -> dict[str, float]:
    """Dictionary words with log10 of their rank: the fixed ones, then those of a tokenizer's vocabulary file, of which
    a smaller id means a more frequent word."""
    path = path or default_path()
    if path not in _ranks:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        known = dict.fromkeys(WORDS)
        for w in sorted(vocabulary, key=vocabulary.get):
            w = w.removeprefix("Ġ").translate(ASCII_LOWER)
            if 3 <= len(w) <= LONGEST and w.isascii() and w.isalpha():
                known.setdefault(w)
        _ranks[path] = {w: math.log10(i + 2) for i, w in enumerate(known)}
    return _ranks[path]


def words_at(value: str, low: str, plain: str, i: int, known: dict[str, float]) -> Iterator[tuple[int, float]]:
    """(end, cost) of the dictionary words that start at i."""
    for text, extra in ((low, 0.0), (plain, 0.3)) if plain != low else ((low, 0.0),):
        for m in range(3, min(LONGEST, len(value) - i) + 1):
            rank = known.get(text[i : i + m])
            if rank is not None:
                own = value[i : i + m]
                yield i + m, rank + extra + (0.0 if own == low[i : i + m] else 0.3 if own[1:] == low[i + 1 : i + m] or own.isupper() else 1.0)


def dates_at(value: str, i: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the years and dates that start at i."""
    if value[i] in "0123456789":
        for end in range(i + 4, min(i + 10, len(value)) + 1):
            if end == i + 4 and YEAR.fullmatch(value, i, end):
                yield end, 2.1
            if DATE.fullmatch(value, i, end):
                yield end, 4.6 if value[i:end].isdigit() else 5.2


def follows(a: str, b: str) -> Iterator[int]:
    """Which of the kinds of CHAINS go on from character a to b."""
    if a == b:
        yield 0
    elif "0" <= a <= "9" and "0" <= b <= "9" or "a" <= a <= "z" and "a" <= b <= "z":
        step = ord(b) - ord(a)
        if step in (1, -1):
            yield 1 if step == 1 else 2
    x, y = ROWS.get(a), ROWS.get(b)
    if x is not None and y is not None and x[0] == y[0] and y[1] - x[1] in (1, -1):
        yield 3 if y[1] > x[1] else 4


CHAINS = (("repeat", SAME), ("run", RUN), ("run", RUN), ("walk", WALK), ("walk", WALK))
Way = tuple[float, int, str]


def guess_cost(value: str, enough: float = math.inf, path: str | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for the value, and the segments (start, end, kind) of its cheapest division. As soon as no
    division can cost less than `enough`, that is given instead, without segments."""
    n, low, known = len(value), value.translate(ASCII_LOWER), ranks(path)
    plain = low.translate(SUBSTITUTES)
    none: Way = (math.inf, 0, "")
    best: list[Way] = [(0.0, 0, ""), *[none] * n]  # cost of the first characters; start and kind of their last segment
    brute, chains = none, [none] * len(CHAINS)
    kept, blocks = [0] * len(CHAINS), [(0, none)] * (BLOCK + 1)  # transitions in a row; matches in a row and the open repeat
    for end in range(n + 1):
        if end:
            # spans that end here and may go on: each from its start, or from one character before
            new = best[end - 1][0] + JOIN + BRUTE
            brute = min((brute[0] + BRUTE, brute[1], "brute"), (new, end - 1, "brute"))
            here = min(best[end], brute)
            on = set(follows(low[end - 2], low[end - 1])) if end > 1 else ()
            for k, (kind, cost) in enumerate(CHAINS):
                kept[k] = kept[k] + 1 if k in on else 0
                way = (chains[k][0] + STEP, chains[k][1], kind) if kept[k] else none
                if kept[k] >= 2:
                    way = min(way, (best[end - 3][0] + JOIN + cost + 3 * STEP, end - 3, kind))
                chains[k] = way
                here = min(here, way)
            for size in range(2, min(BLOCK, end - 1) + 1):
                same, open_ = blocks[size]
                if value[end - 1] != value[end - 1 - size]:
                    if same:
                        blocks[size] = (0, none)
                    continue
                way = (open_[0] + STEP, open_[1], "repeat")
                if same + 1 >= size:
                    way = min(way, (best[end - size][0] + JOIN + AGAIN + math.log10(size) + size * STEP, end - size, "repeat"))
                blocks[size] = (same + 1, way)
                here = min(here, way)
            best[end] = here
            if end % 64 == 0 and min([brute[0], *(c[0] for c in chains), *(b[1][0] for b in blocks), *(b[0] for b in best[max(0, end - LONGEST - BLOCK) : end + 1])]) >= enough:
                return enough, []
        if end < n:
            cost = best[end][0] + JOIN
            for to, own in words_at(value, low, plain, end, known):
                best[to] = min(best[to], (cost + own, end, "word"))
            for to, own in dates_at(value, end):
                best[to] = min(best[to], (cost + own, end, "date"))
    parts, end = [], n
    while end:
        _, start, kind = best[end]
        parts.append((start, end, kind))
        end = start
    return best[n][0], parts[::-1]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every secret, in code points, by start and then kind."""
    found = []
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    if "pass" in low or "secret" in low or "token" in low or "key" in low or "pwd" in low or "credential" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        taken = [(a, b) for a, b, _ in found]
        for m in CONTEXT.finditer(text):
            a, value = m.start(1), m[1].rstrip(".,;:!?")
            if len(value) >= 8 and not any(x < a + len(value) and a < y for x, y in taken) and guess_cost(value, COSTLY)[0] >= COSTLY:
                found.append((a, a + len(value), 3))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))




def cost_at(text: str, start: int, end: int, kind: int) -> float | None:
    """The guess cost of a value in credential context; MOST stands for all costs from there on. None for other kinds."""
    value = {0: lambda: ASSIGN.fullmatch(text, start, end)[2], 3: lambda: text[start:end]}.get(kind)
    return None if value is None else min(MOST, guess_cost(value(), MOST)[0])


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
    for batch in batches:
        out = []
        for x in batch.column(1):
            t = x.as_py() or ""
            out.append([{"kind": KINDS[k], "start": a, "end": b, "cost": cost_at(t, a, b, k)} for a, b, k in spans(t)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, found (kind, start, end of each secret, in code points, end exclusive, and the
    guess cost of values in credential context).

    Null texts are empty. Rows of null or equal doc_id are scanned like any other; an empty table gives no rows; extra
    columns aren't read. Overlapping spans of different kinds are all reported; a value of kind `guess` never overlaps an `assign`.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long,cost:double>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by the mark (overlapping ones by one); all columns stay.

    Null texts stay null and empty ones empty. Rows of null or equal doc_id are treated like any other; an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for x in batch.column(at):
                t = x.as_py()
                parts, done = [], 0
                for a, b, _ in spans(t or ""):
                    if a >= done:
                        parts += [t[done:a], mark]
                    done = max(done, b)
                out.append(t if not parts else "".join(parts) + t[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of query(): the spans of the fixed patterns."""
    return query(spark, sf_dir).drop("spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(F.filter("found", lambda s: s["kind"] != "guess"), text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", text), ",").alias("spans"),
    )


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGNED = "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?"""
#: Places of matches, from what lies between them: regexp_extract_all and the split by the same pattern.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(n, kind, p) AS (VALUES (0, 'assign', '{ASSIGNED}[A-Za-z0-9+/_.=-]+'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')),
m AS (SELECT doc_id, 0 AS n, regexp_extract_all(t, '{ASSIGNED}[A-Za-z0-9+/_.=-]+') AS ms, regexp_extract_all(t, '{ASSIGNED}([A-Za-z0-9+/_.=-]+)', 1) AS vs, string_split_regex(t, '{ASSIGNED}[A-Za-z0-9+/_.=-]+') AS gs FROM d
  UNION ALL SELECT doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d),
r AS (SELECT doc_id, n, unnest(ms) AS x, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM m),
o AS (SELECT doc_id, n, v, sum(length(g) + length(x)) OVER w - length(x) AS a, sum(length(g) + length(x)) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id, n ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, n, kind || ':' || a || ':' || b AS span, a FROM o JOIN k USING (n) WHERE length(v) >= CASE n WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
g AS (SELECT doc_id, count(*) FILTER (WHERE n = 0) AS n0, count(*) FILTER (WHERE n = 1) AS n1, count(*) FILTER (WHERE n = 2) AS n2, string_agg(span, ',' ORDER BY a, n) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
