"""Personal data: fixed patterns, and a linear-chain conditional random field that finds more spans."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_names, whole_text

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
Span = tuple[int, int, int]  # start, end, number of the kind

# Patterns and limits of the contract (fixed values). A run that a number pattern fails on from its
# start it fails on from anywhere inside; the look-behind spares those attempts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in re.findall(r"[0-9]+", text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == 3 else True


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, without those that fail the kind's test."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), 0))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


# Labelled rows: <kind|text> marks a span; # stands for any digit and % for any word when rows are drawn.
LABELLED = """
write to <email|%.## at %.com> please
mail <email|% at % dot com> for more
contact <email|%_%(at)%.org> now
or <email|%.% [at] %.net>, thanks
reach <email|%##[at]%[dot]com> today
my address is <email|% (at) % (dot) org>.
send it to <email|%.##@mail#.%.com> or call
% <email|%@%.org> % %
we met at % at noon and dot the line
look at % dot dot dot
he is at home at ## and % at %.
from <ip|1##[.]2#[.]1##[.]#> came
host <ip|1## . ## . 1# . #> is down
blocked <ip|##[.]##[.]##[.]1#>
server <ip|1#.1##.##.#> answers
version #.#.# and #.##
release ##.# of ##.##.2019
card <card|####.####.####.####> on file
paid with <card|####_####_####_####> today
number <card|####/####/####/####> expires
card <card|#### #### #### ####> %
order ################ shipped
id ########## and ########
call <phone|(0##) ###-####> soon
phone <phone|0##-###-####> or visit
tel <phone|0## / #### ###> from nine
tel. <phone|00## ## ### ####> at night
ring <phone|0## ### ## ##> %
fax <phone|+# (0##) ###-####> %
% <phone|+## ## ### ## ##>, %
in 19## and 20## there were ### of ####
on ##/##/20## or 20##-##-## at ##:##
price ##.## and ###,### %
pages ###-### of % ##
score #-# in ## games
token = "##a#b##c###d#e##f"
% % % ## % %
#. % ## ( ### ) %
License, Version #.#.
the % of %, % and %.
write to <email|% at % dot % dot % dot %> today
write to <email|% at mail dot % dot % dot %> today
contact <email|% at mail dot % dot %> now
mail <email|% at % dot % dot %>, or later
at <email|% [at] % [dot] % [dot] %> please
ask <email|% (at) % (dot) % (dot) % (dot) %> for it
"""
LINES_DRAWN = 25
_MARK = re.compile(r"<(\w+)\|([^>]*)>")
_TOKEN = re.compile(r"[^\W_]+|\S")
_TRIGGER = re.compile(r"[0-9@]|[\[(\s]at[\])\s]", re.IGNORECASE)
_KNOWN = frozenset("at dot com org net mail email tel phone call fax ring card number ip host server version".split())
CONTEXT = 6
EDGE = 3  # labels so near a window's end make it grow
BUCKETS = 1 << 13
TOKENS_AT_ONCE = 50_000


def _shape(token: str) -> str:
    if token.isdecimal():
        return f"d{min(len(token), 9)}"
    if token.isalpha():
        low = token.lower()
        return low if low in _KNOWN else "w" if low == token else "W"
    return "m" if len(token) > 1 else token


@lru_cache(maxsize=1 << 16)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _features(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """Hashed features (tokens x 9): shapes of words near each other, and whether they touch."""
    shapes = ["^", "^", *[_shape(text[a:b]) for a, b in tokens], "$", "$"]
    touch = [" ", " ", *["" if i and tokens[i - 1][1] == a else " " for i, (a, _) in enumerate(tokens)], " ", " "]
    rows = []
    for i in range(2, len(shapes) - 2):
        p2, p, c, n, n2 = shapes[i - 2 : i + 3]
        tp2, tp, tc, tn, tn2 = touch[i - 2 : i + 3]
        rows.append(
            [
                _bucket(f"0{c}"), _bucket(f"1{p}{tc}"), _bucket(f"2{tn}{n}"), _bucket(f"3{p}{tc}{c}"),
                _bucket(f"4{c}{tn}{n}"), _bucket(f"5{p2}{tp}{p}{tc}{c}"), _bucket(f"6{c}{tn}{n}{tn2}{n2}"),
                _bucket(f"7{p}{tc}{c}{tn}{n}"), _bucket(f"8{p2}{tp}{p}{tc}{c}{tn}{n}{tn2}{n2}"),
            ]
        )
    return np.array(rows, np.int32).reshape(-1, 9)


def _drawn() -> list[tuple[str, list[Span]]]:
    """The labelled table: each row of LABELLED some times over with digits and words drawn."""
    draw = np.random.default_rng(7)
    syllables = "an be ca do er fi ga ho in ja ka lo me na or pe ra so te un".split()
    out = []
    for line in LABELLED.strip().splitlines():
        for _ in range(LINES_DRAWN):
            filled = "".join(
                str(draw.integers(10)) if c == "#" else "".join(draw.choice(syllables, draw.integers(1, 4))) if c == "%" else c
                for c in line
            )
            text, spans, last = "", [], 0
            for m in _MARK.finditer(filled):
                text += filled[last : m.start()]
                spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
                text += m[2]
                last = m.end()
            out.append((text + filled[last:], spans))
    return out


class Crf:
    """A linear chain over STATES: hashed emission weights and a transition matrix."""

    def __init__(self) -> None:
        k = len(STATES)
        self.emit, self.move = np.zeros((BUCKETS, k)), np.zeros((k, k))
        self.start, self.allowed = np.zeros(k), np.zeros((k, k))
        for j, to in enumerate(STATES):  # I-x only follows B-x or I-x
            if to[0] == "I":
                self.start[j] = -1e4
                self.allowed[:, j] = [0.0 if s[1:] == to[1:] and s != "O" else -1e4 for s in STATES]

    def fit(self, rows: list[tuple[str, list[Span]]], rounds: int = 60, ridge: float = 1e-3) -> Crf:
        """Maximum likelihood by adaptive gradient steps over all rows; padded forward and backward passes."""
        chains = []
        for text, spans in rows:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            gold = np.zeros(len(tokens), np.int64)
            for a, b, kind in spans:
                inside = [i for i, t in enumerate(tokens) if t[0] >= a and t[1] <= b]
                gold[inside] = 2 + 2 * kind
                gold[inside[0]] = 1 + 2 * kind
            chains.append((_features(text, tokens), gold))
        n, longest, k = len(chains), max(len(g) for _, g in chains), len(STATES)
        feature, gold = np.zeros((n, longest, 9), np.int64), np.zeros((n, longest), np.int64)
        live = np.zeros((n, longest), bool)
        for i, (f, g) in enumerate(chains):
            feature[i, : len(g)], gold[i, : len(g)], live[i, : len(g)] = f, g, True
        squares = [np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)]
        flat = feature[live]
        ahead = live[:, 1:]
        true = np.zeros((n, longest, k))
        true[live] = np.eye(k)[gold[live]]
        true_moves = np.einsum("itj,itk->jk", true[:, :-1] * ahead[..., None], true[:, 1:])
        for _ in range(rounds):
            score = self.emit[feature].sum(axis=2)
            score[:, 0] += self.start
            move = self.move + self.allowed
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for t in range(1, longest):
                new = _logsum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
                alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(live[:, t + 1, None], new, 0)
            whole = _logsum(alpha[:, -1], 1)
            prob = np.exp(alpha + beta - whole[:, None, None])
            moves = np.zeros((k, k))
            for t in range(longest - 1):
                both = alpha[:, t, :, None] + move + (score[:, t + 1] + beta[:, t + 1])[:, None, :] - whole[:, None, None]
                moves += np.exp(both[ahead[:, t]]).sum(axis=0)
            error = (true - prob)[live]
            step = np.zeros_like(self.emit)
            for f in range(9):
                np.add.at(step, flat[:, f], error)
            for weight, gradient, square in ((self.emit, step - ridge * self.emit, squares[0]), (self.move, true_moves - moves, squares[1])):
                square += gradient**2
                weight += 0.5 * gradient / np.sqrt(square)
        return self

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each chain of features: Viterbi over padded batches of like length."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        move = self.move + self.allowed
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and len(chains[order[high]]) * (high - low + 1) <= TOKENS_AT_ONCE:
                high += 1
            part = order[low:high]
            longest = len(chains[part[-1]])
            score = np.zeros((len(part), longest, len(STATES)))
            for i, c in enumerate(part):
                for f in range(9):
                    score[i, : len(chains[c])] += self.emit[chains[c][:, f]]
            sizes = np.array([len(chains[c]) for c in part])
            back = np.zeros((len(part), longest, len(STATES)), np.int8)
            best = score[:, 0] + self.start if longest else score[:, :0]
            for t in range(1, longest):
                through = best[:, :, None] + move
                back[:, t] = through.argmax(axis=1)
                new = through.max(axis=1) + score[:, t]
                best = np.where((t < sizes)[:, None], new, best)
            state = best.argmax(axis=1) if longest else np.zeros(len(part), int)
            path = np.zeros((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = t < sizes
                path[inside, t] = state[inside]
                state = np.where(inside, back[np.arange(len(part)), t, state], state)
            for i, c in enumerate(part):
                out[c] = path[i, : sizes[i]]
            low = high
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf().fit(_drawn())


Window = tuple[int, int]  # first token and the one after the last


def _near_triggers(text: str) -> list[tuple[list[tuple[int, int]], list[Window]]]:
    """Tokens of the lines that hold a digit, an @ or the word at, and windows CONTEXT tokens around those."""
    lines = []
    for line in re.finditer(r"[^\n]+", text):
        if not _TRIGGER.search(line[0]):
            continue
        tokens = [(line.start() + m.start(), line.start() + m.end()) for m in _TOKEN.finditer(line[0])]
        hot = [i for i, (a, b) in enumerate(tokens) if any("0" <= c <= "9" for c in text[a:b]) or text[a:b].lower() in ("@", "at")]
        if hot:
            lines.append((tokens, _merged([(max(i - CONTEXT, 0), min(i + CONTEXT + 1, len(tokens))) for i in hot])))
    return lines


def _merged(windows: list[Window]) -> list[Window]:
    out: list[Window] = []
    for begin, end in sorted(windows):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _window_features(text: str, tokens: list[tuple[int, int]], window: Window) -> np.ndarray:
    """As _features, of the tokens of a window, whose neighbours on the line are seen too."""
    begin, end = max(window[0] - 3, 0), window[1] + 2
    return _features(text, tokens[begin:end])[window[0] - begin : window[1] - begin]


def _decoded(texts: list[str], crf: Crf) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray]]:
    """Text, tokens and path of each window; one whose outer tokens are labelled grows and is decoded again."""
    lines = [(i, t, dict.fromkeys(w)) for i, text in enumerate(texts) if _TRIGGER.search(text) for t, w in _near_triggers(text)]
    while lines:
        todo = [(i, tokens, paths, w) for i, tokens, paths in lines for w, path in paths.items() if path is None]
        new = crf.decode([_window_features(texts[i], tokens, w) for i, tokens, _, w in todo])
        for (_, _, paths, w), path in zip(todo, new, strict=True):
            paths[w] = path
        again = []
        for i, tokens, paths in lines:
            grown = []
            for (begin, end), path in paths.items():
                n = end - begin
                low = max(begin - n, 0) if path[:EDGE].any() else begin
                grown.append((low, min(end + n, len(tokens)) if path[-EDGE:].any() else end))
            wanted = {w: paths.get(w) for w in _merged(grown)}
            if any(path is None for path in wanted.values()):
                again.append((i, tokens, wanted))
            else:
                yield from ((i, tokens[b:e], path) for (b, e), path in wanted.items())
        lines = again


def find(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and those the chain adds: none overlaps a base span."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    for i, chain, path in _decoded(texts, crf):
        begin = 0
        while begin < len(path):
            end = begin + 1
            if path[begin]:
                while end < len(path) and path[end] == path[begin] + 1 and path[begin] % 2:
                    end += 1
                span = (chain[begin][0], chain[end - 1][1], int(path[begin] - 1) // 2)
                if _plausible(span[2], texts[i][span[0] : span[1]]):
                    more[i].append(span)
            begin = end
    return [(b, _apart(b, m)) for b, m in zip(base, more, strict=True)]


def _plausible(kind: int, text: str) -> bool:
    """The tests of the base kinds hold for added spans too; an address needs an at and a dot."""
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.IGNORECASE) and re.search(r"\.|\bdot\b", text, re.IGNORECASE))
    if kind == 1:
        return len(re.findall(r"[0-9]+", text)) == 4 and _fits(1, text)
    return _fits(kind, text)


def _apart(base: list[Span], more: list[Span]) -> list[Span]:
    out, k, reach = [], 0, 0
    for span in sorted(more):
        while k < len(base) and base[k][0] < span[1]:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= span[0]:
            out.append(span)
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = _loaded(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def named(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]

        for batch in batches:
            found = find(batch.column(0).to_pylist(), crf)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([named(b) for b, _ in found], kind),
                    pa.array([named(b + m) for b, m in found], kind),
                ],
                [*batch.schema.names[1:], "base", "spans"],
            )

    return run


@lru_cache(maxsize=1)
def _loaded(data: bytes) -> Crf:
    return pickle.loads(data)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """All columns of docs, and base and spans: arrays of (kind, start, end) by start, then kind.

    Places are code points, ends exclusive. `base` holds the matches of the fixed patterns, `spans` also
    what the random field finds (such as `name at host dot org` or a phone number without its plus),
    where it overlaps no base span and passes the same tests. Null and empty texts have no spans.
    Texts are read whole, however long; a span of either kind must hold a digit, an @ or the word at, and
    the chain is decoded around those, in windows that grow while their ends are labelled. Repeated rows
    repeat; columns named like the results are replaced; an empty table gives none.
    """
    own = [c for c in docs.columns if c not in ("base", "spans")]
    (text,) = fresh_names(docs, "whole")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(trained()))  # 8,192 x 9 weights
    fields = [f for f in docs.schema.fields if f.name in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return arrow_map(
        docs.select(whole_text().alias(text), *own), _scan(shared), f"{schema}, base {spans}, spans {spans}"
    )
