"""Secret scans: fixed credential patterns, and password guess-cost dynamic programming on credential-context values.

Every value that stands in a credential context (a key such as password or auth, then : or =, or a Bearer header) is
taken whole, to white space or its closing quote, symbols included, and cut into segments of least total guess cost (log10
of guesses): ranked words with capitals and letter substitutions, dates, repeats of a unit, keyboard walks, alphabet runs,
and brute-force characters. Any part of a walk, a repeat or a run can be a segment. Words are the passwords that are tried
first, then the words of a public tokenizer's vocabulary in order of their ids, which is that of their frequency; its
place is a parameter. A value whose cheapest cut costs GUESS_LEAST or more is reported as kind guess, unless it is a
placeholder: a template (<...>, ${...}, %...%), or words that only tell what to fill in (your_password_here).

Edge cases: a null text is empty and has no spans; texts are scanned whole; rows are independent, so repeated rows,
null ids and empty tables need no care; columns named like the added ones are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.encoding import located

KINDS = ("assign", "access", "hex", "guess")
GUESS_LEAST = 8.0
REPLACEMENT = "[SECRET]"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"""(?:(?:password|passwd|pwd|passphrase|secret|token|credentials?|auth|authorization|bearer|(?:api|access|private|client)_?key)["']?\x20*[:=]\x20*|(?<![^\W_])bearer\x20+(?=\S*\d))""", re.I)
_KEY_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
# A scheme is no part of the value. In quotes the value is what stands between them on a line, else what white space ends,
# or a quote with white space or closing signs after it.
_VALUE = re.compile(r"""(?P<quote>["'])(?:(?:bearer|basic)\x20+)?(?P<quoted>(?:[^"'\\\r\n]|\\.|(?!(?P=quote))["']|["'](?=\w))+)(?P=quote)|["']?(?:(?:bearer|basic)\x20+)?(?P<bare>(?:[^\s"'`]|["'`](?![\s,;:.?)\]}>/<&"'`]|\Z))+)""", re.I)

# Words that guessers try first, in rough order of frequency.
COMMON = """password admin welcome login letmein monkey dragon master qwerty sunshine princess football baseball shadow
superman michael jennifer jordan hunter trustno secret token key test testing example sample demo changeme change default
user username guest root server client service system public private access account google apple summer winter spring autumn
hello world love money freedom whatever nothing something starwars batman soccer hockey killer pepper ginger cookie cheese
computer internet database oracle postgres mysql redis docker github linux windows android company office secure security
value string none null true false placeholder your here insert todo fixme redacted hidden dummy fake temp temporary local
localhost production staging development config settings api app web data file home mail email phone""".split()
# Letters that digits and signs stand for, and rows of a keyboard.
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}
ROWS = ("1234567890-=", "qwertyuiop", "asdfghjkl", "zxcvbnm")

# What placeholders are made of; one of the first kind must be there.
ORDERS = "your my enter insert replace change changeme put add fill set use here example sample dummy placeholder redacted todo fixme xxx xxxx none null undefined optional required hidden removed".split()
THINGS = "password passwd pwd pass passphrase secret token key api apikey access private public client auth bearer credential credentials user username name value string text id the a an this that some with from in of to for and or me it is not by test demo default actual real own new old".split()

#: The vocabulary that words come from, and the shortest ones that count.
WORDS_FILE, SHORTEST = "byte_bpe_50k.json", 3
UNIT = 8  # the longest unit of a repeat
#: Of a long run, segments begin this near to the start of the run or to their end. Others can't be cheaper: to take a
#: repeat or run from its start costs less than a segment more.
REACH = 24
_SEGMENT = math.log10(2)  # where to cut, for each segment
_DATES = [(re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log10(365 * 130) + 0.3), (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log10(365 * 130) + 0.3), (re.compile(r"(?:19|20)\d\d"), 2.1)]
_PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_STEP = math.log10(3)  # the next key of a walk
_TEMPLATE = re.compile(r"<[^<>]*>|\$?\{.*\}|\$\(.*\)|%\w+%|\$[A-Za-z_]\w*|\[[^\[\]]*\]|(?:process\.env|os\.environ|env|getenv)\b.*")


@functools.cache
def ranks(path: str) -> tuple[dict[str, int], int]:
    """(rank of each word from 1, length of the longest): COMMON first, then the vocabulary's words by id."""
    with open(located(path), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [t.removeprefix("\u0120").lower() for t in sorted(vocabulary, key=vocabulary.get)]
    found = dict.fromkeys([*COMMON, *(w for w in words if len(w) >= SHORTEST and w.isascii() and w.isalpha())])
    return {w: i + 1 for i, w in enumerate(found)}, max(map(len, found))


def is_placeholder(value: str) -> bool:
    if _TEMPLATE.fullmatch(value):
        return True
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]
    return not any(c.isdigit() for c in value) and any(w in ORDERS for w in words) and all(w in ORDERS or w in THINGS for w in words)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def _near(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE:
        return False
    (x, y), (u, v) = _PLACE[a], _PLACE[b]
    return a != b and abs(x - u) <= 1 and abs(y - v) <= 1


def _lowered(value: str) -> tuple[str, str]:
    """value in lower case, and with letters for the signs that stand for them."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    return low, "".join(LEET.get(c, c) for c in low)


def segment_cost(value: str, path: str = WORDS_FILE) -> float:
    """What value costs as one segment, infinite where it is none. guess_cost finds the cheapest cut by these costs."""
    n, (low, plain) = len(value), _lowered(value)
    costs = [_char_cost(value)] if n == 1 else []
    for text, extra in ((low, 0.0), (plain, 0.6)):
        if n >= SHORTEST and (rank := ranks(path)[0].get(text)) is not None:
            costs.append(math.log10(rank + 1) + extra + (0.5 if value != low else 0.0))
    costs += [cost for pattern, cost in _DATES if pattern.fullmatch(value)]
    for unit in range(1, min(UNIT, n // 2) + 1):
        if n >= 3 and n % unit == 0 and value == value[:unit] * (n // unit):
            costs.append(sum(map(_char_cost, value[:unit])) + math.log10(n // unit))
    if n >= 3 and len(steps := {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)}) == 1 and steps <= {-1, 1}:
        costs.append(_char_cost(value[0]) + math.log10(2 * n))
    if n >= 4 and all(map(_near, low, low[1:])):
        costs.append(math.log10(len(_PLACE)) + (n - 1) * _STEP)
    return min(costs, default=math.inf) + (_SEGMENT if n > 1 else 0.0)


def guess_cost(value: str, path: str = WORDS_FILE) -> float:
    """log10 of the guesses of the cheapest cut of value; 0 for an empty one. Time grows with the length of value."""
    n, (low, plain) = len(value), _lowered(value)
    known, longest = ranks(path)
    chars = [_char_cost(c) for c in value]
    best, walks = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    dates: dict[int, list[tuple[int, float]]] = {}
    for i, c in enumerate(value):
        if c.isdigit():
            for pattern, cost in _DATES:
                if m := pattern.match(value, i):
                    dates.setdefault(m.end(), []).append((i, cost))
    same = [0] * (UNIT + 1)  # by unit: characters up to here that are those one unit before
    run, step, walk = 1, 0, 1  # lengths of the alphabet run, its direction, and of the walk that end here
    for j in range(1, n + 1):
        cost = best[j - 1] + chars[j - 1]
        for i in range(max(0, j - longest), j - SHORTEST + 1):
            for text, extra in ((low, 0.0), (plain, 0.6)):
                if (rank := known.get(text[i:j])) is not None:
                    cost = min(cost, best[i] + math.log10(rank + 1) + extra + (0.5 if value[i:j] != low[i:j] else 0.0) + _SEGMENT)
        for i, c in dates.get(j, ()):
            cost = min(cost, best[i] + c + _SEGMENT)
        if j > 1:
            turn = ord(low[j - 1]) - ord(low[j - 2])
            run, step = (run + 1 if turn == step else 2, turn) if abs(turn) == 1 else (1, 0)
            for i in range(j - run, j - 2):
                if i - (j - run) < REACH or j - i <= REACH:
                    cost = min(cost, best[i] + chars[i] + math.log10(2 * (j - i)) + _SEGMENT)
            walk = walk + 1 if _near(low[j - 2], low[j - 1]) else 1
            if walk >= 4:
                walks[j] = min(best[j - 4] + math.log10(len(_PLACE)) + 3 * _STEP + _SEGMENT, walks[j - 1] + _STEP if walk > 4 else math.inf)
                cost = min(cost, walks[j])
        for unit in range(1, min(UNIT, j - 1) + 1):
            same[unit] = same[unit] + 1 if value[j - 1] == value[j - 1 - unit] else 0
            if same[unit] < unit or any(unit % p == 0 and same[p] >= same[unit] for p in range(1, unit)):
                continue  # no two units yet, or a repeat of a shorter one
            start = j - same[unit] - unit
            near = range(j - 2 * unit, max(start, j - REACH) - 1, -unit)
            far = range(start + (j - start) % unit, min(start + REACH, near[-1] if near else j - 2 * unit + 1), unit)
            for i in (*near, *far):
                if j - i >= 3:
                    cost = min(cost, best[i] + sum(chars[i : i + unit]) + math.log10((j - i) // unit) + _SEGMENT)
        best[j] = cost
    return best[n]


def _values(text: str) -> Iterator[tuple[int, int, int]]:
    """(start of the key, start, end) of the whole values in credential contexts; none that lies in the one before."""
    last = 0
    for key in _KEY.finditer(text):
        if key.end() < last and text[key.end()] not in "\"'":
            continue
        if m := _VALUE.match(text, key.end()):
            start, end = m.span("bare" if m["quoted"] is None else "quoted")
            if end > last:
                last = end
                yield key.start(), start, end


def spans(text: str | None, path: str = WORDS_FILE) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted: base spans of each kind, and values that are hard to guess."""
    text = text or ""
    low, out = text.lower(), []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(h in low for h in _KEY_HINTS):
        out += [(a, 3, b) for _, a, b in _values(text) if not is_placeholder(text[a:b]) and guess_cost(text[a:b], path) >= GUESS_LEAST]
    return sorted(out)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with every span, or union of overlapping spans, replaced; a span of kind assign to the end of its value."""
    out, at = [], 0
    whole = {key: end for key, _, end in _values(text)} if any(k == 0 for _, k, _ in found) else {}
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end, whole.get(start, 0) if kind == 0 else 0)
    return "".join([*out, text[at:]])


def _said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_secrets(docs: DataFrame, path: str = WORDS_FILE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(6)]
            for text in batch.column("text"):
                found = spans(text.as_py(), path)
                base = _said([x for x in found if x[1] < 3])
                for c, x in zip(cols, [*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(base.encode()).hexdigest(), _said(found)], strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, path: str = WORDS_FILE) -> DataFrame:
    """docs with all spans in text replaced; n_chars, where there is one, is counted anew for changed texts. A null
    text stays null."""
    columns, at = docs.columns, docs.columns.index("text")
    count = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), batch.column(count).to_pylist() if count is not None else None
            for i, text in enumerate(texts):
                if text and (found := spans(text, path)):
                    texts[i] = redacted(text, found)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                cols[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
