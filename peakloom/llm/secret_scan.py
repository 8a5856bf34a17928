"""Secret scan: fixed patterns, and credential values whose password guess cost is high.

The guess cost of a value is the least cost of splitting it into dictionary words, dates, repeats of blocks of any
length, keyboard walks and brute-forced characters, found by dynamic programming over its end positions (log10 of
guesses). Words come from frequent passwords and from the ranked vocabularies of two public tokenizers.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Contexts whose values are judged by guess cost. A scheme word may stand between separator and value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|login|(?:api|access|private|client|secret)[_-]?(?:key|secret))["']?\x20*[:=]\x20*["']?(?:(?:bearer|basic|token)\x20+["']?)?([^\s"'<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
#: A value is a secret from this cost (log10 of guesses) on.
GUESS_COST = 10.0
KINDS = ("assign", "access", "hex", "guess")

# Frequent words in passwords, most frequent first.
WORDS = """password qwerty admin welcome letmein login master monkey dragon secret hello iloveyou sunshine princess
football baseball shadow superman batman trustno access user test guest root pass love summer winter spring autumn
changeme default example sample token key server system office company internet computer michael jordan hunter
charlie freedom whatever flower cookie orange banana cheese pepper ginger silver golden purple yellow thunder
please none null true false your here value string""".split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
# Rows along which sequences run.
ROWS = ("1234567890", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(r[i], r[i + 1], 1) for r in ROWS for i in range(len(r) - 1)} | {(r[i + 1], r[i], -1) for r in ROWS for i in range(len(r) - 1)}
# The rows of a US keyboard, plain and with shift; each row lies half a key to the right of the one above.
KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
PLACE = {c: (x, y) for rows in (KEYS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row) if c != " "}
SHIFT = {c for row in SHIFTED for c in row if c != " "}
#: Steps from a key to its neighbours.
STEPS = {(-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (-1, 1)}
#: Keys at which a walk may start, and neighbours of a key on average.
STARTS = len(PLACE) // 2
DEGREE = sum((x + dx, y + dy) in set(PLACE.values()) for x, y in set(PLACE.values()) for dx, dy in STEPS) / STARTS
DATE = re.compile(r"(?:19|20)\d\d[-/.]?[01]\d[-/.]?[0-3]\d|[0-3]\d[-/.][01]\d[-/.](?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
#: Leet spellings undone before words are looked up.
LEET = str.maketrans("@013457$", "aoleasts")


def char_cost(c: str) -> float:
    """log10 of the guesses for one brute-forced character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else 1.52


@functools.cache
def word_ranks() -> dict[str, int]:
    """Rank of every known word of three letters or more, from 1: the best of WORDS and two vocabularies, most frequent first."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    english = [w.removesuffix("</w>") for w in sorted(vocab, key=vocab.get) if w.endswith("</w>")]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip()]
    many = [w[1:].lower() for w in pieces if w.startswith(" ")]
    ranks = dict(RANK)
    for words in (english, many):
        known = dict.fromkeys(w for w in words if len(w) >= 3 and w.isalpha())
        for k, w in enumerate(known, 1):
            ranks[w] = min(k, ranks.get(w, k)) if w not in RANK else RANK[w]
    return ranks


@functools.cache
def longest_word() -> int:
    return max(map(len, word_ranks()))


def common_length(value: str, a: int, b: int, way: int) -> int:
    """How many characters from a and from b > a on agree: forwards (way 1), or backwards from those before them (-1)."""
    n, step = 0, 8
    most = len(value) - b if way == 1 else a
    while n < most:
        m = min(step, most - n)
        same = value[a + n : a + n + m] == value[b + n : b + n + m] if way == 1 else value[a - n - m : a - n] == value[b - n - m : b - n]
        if same:
            n, step = n + m, 2 * step
        elif m == 1:
            break
        else:
            step = m // 2
    return n


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal runs in which a block of any length stands twice or more (single characters: three times).

    A run of period p holds a multiple of p whose character comes again p further on, so those are looked at and extended.
    Periods that are multiples of one that the whole value has, and runs whose block is itself a repeat, are left to the
    shorter block.
    """
    n, found, whole = len(value), [], []
    for p in range(1, n // 2 + 1):
        if any(p % q == 0 for q in whole):
            continue
        a = 0
        while a + p < n:
            if value[a] != value[a + p]:
                a += p
                continue
            ahead = common_length(value, a, a + p, 1)
            start, end = a - common_length(value, a, a + p, -1), a + p + ahead
            block = value[start : start + p]
            if end - start >= max(2 * p, 3) and (block + block).find(block, 1) == p:
                found.append((start, end, p))
                if end - start == n:
                    whole.append(p)
            a += p * (ahead // p + 1)
    return found


@functools.cache
def walk_cost(length: int, turns: int) -> float:
    """log10 of the walks of at most so many keys and turns: starts, ways to deal the turns out, and neighbours at each turn."""
    if length > 40:  # further keys cost what the choice at a turn costs on average
        return walk_cost(40, min(turns, 39)) + (length - 40) * math.log10(1 + (DEGREE - 1) * turns / length)
    return math.log10(sum(math.comb(k - 1, t - 1) * STARTS * DEGREE**t for k in range(2, length + 1) for t in range(1, min(turns, k - 1) + 1)))


def walks(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the maximal walks of three or more characters from key to neighbouring key."""
    found, i, n = [], 0, len(value)
    while i < n - 2:
        j, turns, last = i, 0, None
        while j + 1 < n and value[j] in PLACE and value[j + 1] in PLACE:
            (x, y), (u, v) = PLACE[value[j]], PLACE[value[j + 1]]
            if (u - x, v - y) not in STEPS:
                break
            turns, last, j = turns + ((u - x, v - y) != last), (u - x, v - y), j + 1
        if j - i >= 2:
            up = sum(c in SHIFT for c in value[i : j + 1])
            down = j + 1 - i - up
            mixed = 0.0 if not up else math.log10(2) if not down else min(up, down) * math.log10(2 * (up + down) / min(up, down))
            found.append((i, j + 1, walk_cost(j + 1 - i, turns) + mixed))
        i = max(j, i + 1)
    return found


def spans_of(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of every word, date, repeat, sequence and keyboard walk in value."""
    low, plain, n, found = value.lower(), value.lower().translate(LEET), len(value), []
    if len(low) != n:  # a letter that two stand for
        low = plain = value
    ranks, longest = word_ranks(), longest_word()
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = min(ranks.get(low[i:j], 1e9), 2 * ranks.get(plain[i:j], 1e9))
            if rank < 1e9:
                found.append((i, j, math.log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0)))
        if m := DATE.match(value, i):
            found.append((i, m.end(), math.log10(200) if m.end() - i == 4 else math.log10(365 * 200)))
    for i, j, p in repeats(value):
        block = char_cost(value[i]) if p == 1 else guess_cost(value[i : i + p])
        found.append((i, j, block + math.log10(j - i)))
    for way in (1, -1):  # maximal sequences
        i = 0
        while i < n - 1:
            j = i
            while j + 1 < n and (low[j], low[j + 1], way) in NEXT:
                j += 1
            if j - i >= 2:
                found.append((i, j + 1, math.log10(4 * 26 * (j + 1 - i))))
            i = max(j, i + 1)
    return found + walks(value)


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of value."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in spans_of(value):
        ends.setdefault(b, []).append((a, cost))
    best = [0.0] * (len(value) + 1)
    for j in range(1, len(value) + 1):
        best[j] = min([best[j - 1] + char_cost(value[j - 1]), *(best[a] + cost for a, cost in ends.get(j, ()))])
    return best[-1]


def priced(text: str, threshold: float = GUESS_COST) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, cost) of every secret, in order; kind indexes KINDS. Every credential-context value is priced,
    those of base spans too: assignments carry the cost of their value, access keys and hex runs have none."""
    costs: dict[str, float] = {}  # a text may repeat its values

    def cost(value: str) -> float:
        if value not in costs:
            costs[value] = guess_cost(value)
        return costs[value]

    found = [(m.start(), 0, m.end(), cost(m[2])) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), None) for m in HEX_LONG.finditer(text)]
    found += [(m.start(1), 3, m.end(1), cost(m[1])) for m in CONTEXT.finditer(text) if cost(m[1]) >= threshold]
    return sorted(found, key=lambda s: s[:3])


def scan(text: str, threshold: float = GUESS_COST) -> list[tuple[int, int, int]]:
    """The same without costs."""
    return [s[:3] for s in priced(text, threshold)]


#: Maximal runs of HEX of the least length: the same matches as HEX with short ones dropped.
HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GUESS_COST) -> DataFrame:
    """(id, secrets array<struct<kind, start, end, value, cost>>) of every whole text, by start, then kind.

    Positions are code points, end exclusive. A value in a credential context whose guess cost reaches the threshold is a
    span of kind guess, also inside an assignment, whose own span then stays beside it. Null and empty texts have no secrets; null ids pass through; repeated
    rows repeat; an empty table gives no rows; columns other than the two named are ignored.
    """

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e], "cost": c} for s, k, e, c in priced(text, threshold)] for text in map(str, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "secrets"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, secrets array<struct<kind:string,start:int,end:int,value:string,cost:double>>")
