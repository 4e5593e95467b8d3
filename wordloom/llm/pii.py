"""Personal data by a semi-Markov conditional random field.

The model scores whole spans: a span of up to `MAX_TOKENS` tokens gets, for each
type, the weights of its features (its shape, checksums, the characters cut off
on either side, the words before it). A labelling is a sequence of typed spans
and of single tokens outside them; dynamic programming over bounded spans finds
the best one, so boundaries and types are chosen together. Weights are fitted by
gradient ascent on the likelihood of `TRAIN_ISLANDS` synthetic passages.

A span of an entity must hold an "@" or `LEAST_DIGITS` digits, or look like a secret
(a known prefix, a long run of both cases and digits, what is assigned to a secret
word), and may only cross white space between pieces that have digits or "@" or hold
or begin a secret; a span by its looks crosses none. So the field falls apart into
islands, runs of such pieces, and decoding each by itself is the same as decoding
the whole text, however long.

Defined cases: a null text stays null, and an empty one empty, without entities;
rows are independent, so repeated rows repeat their results; text without any
entity is left as it is, byte for byte. Texts and islands of any length are decoded
whole. Of types that score alike the first of `TYPES` counts, of labellings that
score alike the one whose spans end first. Other columns stay, whatever their names.
An empty table gives no rows. A secret with fewer than four digits needs a
known prefix, both cases and a digit in 20 characters, or a secret word before it.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, release, word_spans

TYPES = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN")
MAX_TOKENS = 16
LEAST_DIGITS = 4
#: Bound of the training sample.
TRAIN_ISLANDS = 700
EPOCHS = 40
#: Spans whose features are held at once.
SCORED = 4096

FOUND = "struct<text:string,entities:array<struct<start:int,length:int,type:string>>>"

_TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
_DIGITS = re.compile(r"\d")
_SHAPES = tuple(
    re.compile(p)
    for p in (
        r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
        r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
        r"\d{13,19}",
        r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}",
        r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]\d{3,4}",
        r"\+\d{7,15}",
        r"(?=[0-9a-f]*[a-f])[0-9a-f]{20,128}",
        r"(?=[\w-]*\d)(?=[\w-]*[A-Za-z])(?:[A-Za-z]{2,6}[-_])*[A-Za-z0-9_]{20,128}",
        r"(?:sk|pk|ghp|gho|xox[bp]|glpat|AKIA|ASIA|AIza)[-_]?[A-Za-z0-9_-]{14,128}",
        r"(?=\w*\d)(?=\w*[A-Za-z])\w{8,64}",
        r"\d{3}-\d{2}-\d{4}",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?",
        r"\d{1,6}",
    )
)
_SECRET_WORDS = re.compile(r"(?i)(?:token|secret|passw|api|key|bearer|auth)\w*\W*$")
_NUMBER_WORDS = re.compile(r"(?i)(?:phone|tel|call|mobile|fax)\w*\W*$")
_PREFIXED = r"(?:(?:sk|pk)[-_](?=[A-Za-z0-9_-]*[A-Z0-9])[A-Za-z0-9_-]{14,128}|(?:gh[opsu]_|xox[bp]-|glpat-)[A-Za-z0-9_-]{14,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{30,128})"
_MIXED = r"(?=[A-Za-z_]*[0-9])(?=[A-Z0-9_]*[a-z])(?=[a-z0-9_]*[A-Z])[A-Za-z0-9_]{20,128}"
_ASSIGNED = r"""(?i:(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key)["']?[ \t]*[:=][ \t]*["']?|key["']?[ \t]*=[ \t]*["']?)"""
_LOOKS = re.compile(f"{_PREFIXED}|{_MIXED}")
_AFTER_WORD = re.compile(_ASSIGNED + r"\Z")
_AFTER_BEARER = re.compile(r"(?i:\bbearer[ \t]+)\Z")
#: Where a piece holds or begins a secret by its looks.
_CUES = re.compile(f"(?<![A-Za-z0-9_]){_PREFIXED}".encode())
_WORDS = re.compile(f"{_ASSIGNED}|(?i:bearer[ \t]+)".encode())
_MIXED_CUE = re.compile(f"(?<![A-Za-z0-9_]){_MIXED}".encode())
#: Characters that a secret after a secret word, and one after "bearer", has at least.
LEAST_SECRET, LEAST_BEARER = 6, 16
N_FEATURES = len(_SHAPES) + 20


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def features(span: str, n_tokens: int, before: str, after: str, context: str) -> tuple[float, ...]:
    """What the model sees of a span; before and after: the characters beside it, context: the text to its left."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    n, secret = len(digits), _SECRET_WORDS.search(context) is not None
    return (
        *(float(p.fullmatch(span) is not None) for p in _SHAPES),
        1.0,
        float("@" in span),
        float(n == 16),
        float(13 <= n <= 19 and _luhn(digits)),
        float(7 <= n <= 15),
        float(span[0] == "+"),
        float(span.count("(") == span.count(")") == 1),
        float(before.isalnum() or before in "@_+" and before != ""),
        float(before in ".-(/" and before != ""),
        float(after[:1].isalnum() or after[:1] in "@_" and after[:1] != ""),
        float(after[:1] in ".-" and after[1:2].isalnum()),
        float(after[:1] == " " and after[1:2].isdigit()),
        float(not (span[0].isalnum() or span[0] in "+(")),
        float(not span[-1].isalnum()),
        float(secret),
        float(secret and n_tokens == 1 and len(span) >= 8),
        float(_NUMBER_WORDS.search(context) is not None),
        float(_LOOKS.fullmatch(span) is not None),
        float(_AFTER_WORD.search(context) is not None),
        float(n < LEAST_DIGITS),
    )


def _least_secret(context: str) -> int | None:
    """The characters that what follows must have to be a secret's candidate; None if there is no secret word."""
    if _AFTER_WORD.search(context):
        return LEAST_SECRET
    return LEAST_BEARER if _AFTER_BEARER.search(context) else None


def tokens_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """The token boundaries of an island, and the digits and "@" before each."""
    at, digits, ats = [0], [0], [0]
    for m in _TOKEN.finditer(text):
        t = m.group()
        at.append(m.end())
        digits.append(digits[-1] + len(_DIGITS.findall(t)))
        ats.append(ats[-1] + (t == "@"))
    return at, digits, ats


def spans(text: str, context: str, tokens: tuple[list[int], list[int], list[int]]) -> Iterator[tuple[int, int, tuple[float, ...]]]:
    """Every span (first token, end token, features) that may be an entity, by its first token."""
    at, digits, ats = tokens
    n = len(at) - 1
    for i in range(n):
        a, whole = at[i], True
        t = text[a : at[i + 1]]
        if t.isspace():
            continue
        before = text[max(0, a - 24) : a] if a >= 24 else (context + text[:a])[-24:]
        least = _least_secret(before) if t not in "\"'=:" else None
        for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
            if text[at[j - 1]].isspace():
                whole = False
                continue
            b = at[j]
            if ats[j] == ats[i] and digits[j] - digits[i] < LEAST_DIGITS:
                if not whole or not (least and b - a >= least or b - a >= 17 and _LOOKS.fullmatch(text, a, b)):
                    continue
            yield i, j, features(text[a:b], j - i, text[a - 1 : a] if a else "", text[b : b + 2], before)


def _hex(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def _mixed(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "th", "ou", "ch", "é", "ñ", "li", "st", "ä", "o")) for _ in range(rng.randint(1, 5)))


def _entity(rng: random.Random) -> tuple[str, str, str]:
    """(type, text, context)."""
    kind = rng.choice(TYPES)
    context = rng.choice(("", _word(rng) + " ", _word(rng) + ", "))
    if kind == "EMAIL":
        s = rng.choice((_word(rng), f"{_word(rng)}.{rng.randint(0, 99):02d}", f"{_word(rng)}_{_word(rng)}", f"{_word(rng)}+{_word(rng)}")) + "@" + rng.choice((f"mail{rng.randint(0, 9)}.example.com", "example.org", f"{_word(rng)}.net", f"a-{_word(rng)}.co.uk"))
    elif kind == "PHONE":
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        s = rng.choice((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)}{a}{b}{c}"))
        context = rng.choice((context, "phone: ", "call "))
    elif kind == "CARD":
        d = _number(rng, 16)
        if rng.random() < 0.5:
            d = next(d[:-1] + x for x in "0123456789" if _luhn(d[:-1] + x))
        s = rng.choice((d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))
    elif kind == "IP":
        s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "SECRET":
        s = rng.choice((_hex(rng, rng.choice((32, 40, 64))), "sk-" + _mixed(rng, 32), "ghp_" + _mixed(rng, 36), "glpat-" + _mixed(rng, 20), "AIza" + _mixed(rng, 35), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))))
        context = rng.choice(('token = "', "api_key: ", "secret=", context))
        if rng.random() < 0.5:
            s = rng.choice((_hex(rng, rng.randint(10, 24)), _mixed(rng, rng.randint(8, 24)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 16))) + _number(rng, rng.randint(0, 3))))
            context = rng.choice(("password=", "password: ", "secret=", "key = ", 'token = "', "api_key: "))
    elif kind == "SSN":
        s = f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}"
    else:
        d = _number(rng, 18)
        s = rng.choice(("DE", "FR", "ES")) + rng.choice(("", " ")).join((_number(rng, 2), d[:4], d[4:8], d[8:12], d[12:16], d[16:]))
    return kind, s, context


def _other(rng: random.Random) -> str:
    return rng.choice(
        (
            f"{rng.randint(0, 99)}.",
            str(rng.randint(0, 99999)),
            f"{rng.randint(0, 9)}.{_number(rng, rng.randint(1, 6))}",
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}",
            f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}",
            f"{rng.randint(1, 999)},{_number(rng, 3)},{_number(rng, 3)}",
            f"{rng.randint(1000, 9999)}{_word(rng)}",
            f"{_word(rng)}{rng.randint(1000, 99999)}",
            f"${rng.randint(1000, 999999)}",
            f"{rng.randint(1900, 2030)}",
            f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
        )
    )


def synthetic(n: int, seed: int) -> list[tuple[str, str, list[tuple[int, int, str]]]]:
    """Labelled islands: (context, text, [(start, end, type)])."""
    rng, out = random.Random(seed), []
    tails = ("", "", "", ".", ",", "!!", "###", "$$$", "%%%", "&&&", "***", ";", ")", '"', "'")
    for _ in range(n):
        text, gold, context = "", [], _word(rng) + " "
        for k in range(rng.choice((1, 1, 1, 2, 3))):
            if rng.random() < 0.65:
                kind, s, c = _entity(rng)
                if k == 0:
                    # what touches the entity is of its own piece
                    cut = c.rfind(" ") + 1
                    context, text = c[:cut], c[cut:]
                else:
                    # the pieces of an island hold no other white space
                    text += " " + (c if " " not in c else "secret=" if kind == "SECRET" else "")
                gold.append((len(text), len(text) + len(s), kind))
                text += s + ('"' if text == '"' else "") + rng.choice(tails)
            else:
                text += " " * (k > 0) + _other(rng) + rng.choice(tails)
        out.append((context, text, gold))
    return out


def _lattice(text: str, context: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    tokens = tokens_of(text)
    found = list(spans(text, context, tokens))
    if not found:
        return tokens[0], np.zeros(0, int), np.zeros(0, int), np.zeros((0, N_FEATURES))
    i, j, f = zip(*found)
    return tokens[0], np.array(i), np.array(j), np.array(f)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


@lru_cache(maxsize=4)
def train(n: int = TRAIN_ISLANDS, seed: int = 5) -> np.ndarray:
    """The weights, (types, features)."""
    lattices, gold = [], []
    for context, text, entities in synthetic(n, seed):
        at, i, j, f = _lattice(text, context)
        where = {(at[a], at[b]): k for k, (a, b) in enumerate(zip(i, j))}
        lattices.append((len(at) - 1, i, j, f))
        gold.append([(where[a, b], TYPES.index(t)) for a, b, t in entities])
    every = np.concatenate([x[3] for x in lattices])
    begin = np.r_[0, np.cumsum([len(x[1]) for x in lattices])]
    observed = np.zeros((len(TYPES), N_FEATURES))
    for named, b in zip(gold, begin):
        for k, t in named:
            observed[t] += every[b + k]
    weights = np.zeros((len(TYPES), N_FEATURES))
    squares = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS):
        scores = every @ weights.T
        top = scores.max(axis=1, keepdims=True)
        total = (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[:, 0]
        share = np.exp(scores - total[:, None])
        expected = np.zeros(len(every))
        for (n_tokens, i, j, _), b in zip(lattices, begin):
            s = total[b : b + len(i)].tolist()
            ends, starts = [[] for _ in range(n_tokens + 1)], [[] for _ in range(n_tokens + 1)]
            for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
                ends[q].append((p, s[k]))
                starts[p].append((q, s[k]))
            ahead, back = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)
            for q in range(1, n_tokens + 1):
                ahead[q] = _log_sum([ahead[q - 1], *(ahead[p] + x for p, x in ends[q])])
            for p in range(n_tokens - 1, -1, -1):
                back[p] = _log_sum([back[p + 1], *(back[q] + x for q, x in starts[p])])
            if len(i):
                expected[b : b + len(i)] = np.exp(np.array(ahead)[i] + s + np.array(back)[j] - ahead[n_tokens])
        slope = observed - (share * expected[:, None]).T @ every - 0.05 * weights
        squares += slope**2
        weights += 0.6 * slope / np.sqrt(squares)
    return weights


def decode(text: str, context: str, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """The best labelling's entities (start, end, type) of one island, of any length: spans are scored `SCORED` at a time, and those that score leave three numbers."""
    tokens = tokens_of(text)
    at = tokens[0]
    n = len(at) - 1
    ends: dict[int, list[tuple[int, int, float]]] = {}
    every = spans(text, context, tokens)
    while part := list(itertools.islice(every, SCORED)):
        scores = np.array([f for _, _, f in part]) @ weights.T
        kind = scores.argmax(axis=1)
        best = scores[np.arange(len(part)), kind]
        for k in np.flatnonzero(best > 0).tolist():  # a span that scores below its tokens apart is on no best path
            ends.setdefault(part[k][1], []).append((part[k][0], int(kind[k]), float(best[k])))
    if not ends:
        return []
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for q in range(1, n + 1):
        value[q] = value[q - 1]
        for i, kind, score in ends.get(q, ()):
            if (v := value[i] + score) > value[q]:
                value[q], back[q] = v, (i, kind)
    found, q = [], n
    while q:
        if back[q] is None:
            q -= 1
        else:
            i, kind = back[q]
            found.append((at[i], at[q], TYPES[kind]))
            q = i
    return found[::-1]


_PIECE = np.ones(256, bool)
_PIECE[[9, 10, 11, 12, 13, 32]] = False
_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), ord("@")]] = True


def find_block(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """Entities (start byte, end byte, type) by row."""
    hot = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_HOT[data], out=hot[1:])
    raw = data.tobytes()
    cues = [m.start() for m in _CUES.finditer(raw)]
    words = [(m.start(), m.end()) for m in _WORDS.finditer(raw)]
    if not hot[-1] and not cues and not words:
        return {}
    first, last, rows = word_spans(data, offsets, _PIECE)
    marked = np.zeros(len(first) + 1, bool)
    marked[np.searchsorted(first, cues, "right") - 1] = True
    for a, b in words:
        k, word = (int(np.searchsorted(first, x, "right")) - 1 for x in (b, a))
        if last[k] > b and rows[k] == rows[word]:
            marked[k] = True
    marks = np.r_[0, np.cumsum(marked[:-1])]
    live = (hot[last] > hot[first]) | marked[:-1]
    starts = np.flatnonzero(live & np.r_[True, ~live[:-1] | (rows[1:] != rows[:-1])])
    stops = np.flatnonzero(live & np.r_[~live[1:] | (rows[1:] != rows[:-1]), True])
    found = {}
    digit = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digit[1:])
    for s, e in zip(starts.tolist(), stops.tolist()):
        a, b = int(first[s]), int(last[e])
        if digit[b] - digit[a] < LEAST_DIGITS and marks[e + 1] == marks[s] and b"@" not in raw[a:b] and not (b - a >= 20 and _MIXED_CUE.search(raw, a, b)):
            continue
        text = raw[a:b].decode()
        left = int(first[s - min(3, s - int(np.searchsorted(rows, rows[s])))])
        context = raw[left:a].decode()
        for p, q, kind in decode(text, context, weights):
            x = a + len(text[:p].encode())
            found.setdefault(int(rows[s]), []).append((x, x + len(text[p:q].encode()), kind))
    return found


def find_column(column: pa.Array, weights: np.ndarray) -> tuple[list, list]:
    """Redacted texts and entities (characters) of a string column."""
    texts = column.to_pylist()
    entities = [None if x is None else [] for x in texts]
    for row, _, data, offsets in blocks(column):
        for r, spans_ in find_block(data, offsets, weights).items():
            if texts[row + r] is None:
                continue
            raw, out, at, chars = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0, 0
            for a, b, kind in spans_:
                a, b = a - int(offsets[r]), b - int(offsets[r])
                kept, gone = raw[at:a].decode(), raw[a:b].decode()
                chars += len(kept)
                entities[row + r].append({"start": chars, "length": len(gone), "type": kind})
                out += [kept, f"[{kind}]"]
                chars, at = chars + len(gone), b
            texts[row + r] = "".join(out) + raw[at:].decode()
    return texts, entities


def _finder():
    weights = train()

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        texts, entities = find_column(column, weights)
        release()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("type", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(entities, kind)], names=["text", "entities"])

    return find


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities, entities) of every row: the text with [TYPE] for each entity; places in characters of the text as it was."""
    found = lean(docs).select("doc_id", _finder()(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "found.text", F.coalesce(F.size("found.entities"), F.lit(0)).alias("n_entities"), "found.entities")


def redact(docs: DataFrame) -> DataFrame:
    """docs with redacted text; n_chars, where there is one, counts the new text. Other columns stay."""
    text = _finder()(F.col("text").cast("string"))["text"]
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return lean(docs).withColumns({k: v for k, v in new.items() if k in docs.columns})
