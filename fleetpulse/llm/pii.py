"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans of emails, IP addresses, card and phone numbers. A conditional random
field labels tokens: unary weights of token shape and the word before, a potential between neighbouring
tokens, and a skip potential between tokens of one document that are equal or similar (same digits,
or same letters and digits), each linked to the one before it. Loopy sum-product messages pass along both
kinds of edges until they settle, so a repeated token takes the label its other mentions suggest, however many
mentions lie between. Tokens with neither a digit nor
``@`` are fixed to no entity, which cuts the chain there without changing the others' marginals.

The weights are learned by pseudo-likelihood from the base spans of at most ``SAMPLE_TOKENS`` tokens of documents
chosen by hash, each of at most ``SAMPLE_LONGEST`` tokens. A token outside every base span becomes a span of its own if its
marginal is at least ``SURE_LINKED`` and some token that skip links lead to, directly or over others, lies in a base span of
that kind, or if it is at least ``SURE_ALONE``. Base spans always stay.

Defined cases: a null or empty text has no spans. Positions are code points, ends exclusive. Equal rows get
equal spans. Where nothing can be learned only the base spans come out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TOKENS = 40_000
SAMPLE_DOCS = 4_000
#: Tokens of the longest document in the fit: long lists of numbers teach little.
SAMPLE_LONGEST = 400
FEATURES = 1 << 13
L = len(KINDS) + 1
SURE_LINKED, SURE_ALONE = 0.9, 0.995
#: Messages pass until none changes by more than this, or for so many rounds.
SETTLED, ROUNDS = 1e-4, 500
MARK = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPACE = re.compile(r"\s")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ backwards so that long runs are read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = emails(text) if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or @."""
    out, m = [], MARK.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        gap = SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        out.append((start, end))
        m = MARK.search(text, end)
    return out


def shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token)))


def features(text: str, token: tuple[int, int]) -> list[int]:
    word = text[token[0]:token[1]]
    before = text[max(0, token[0] - 24):token[0]].split()[-1:] or [""]
    digits = sum(c.isdigit() for c in word)
    names = ["1", "s" + shape(word)[:40], f"d{min(digits, 24)}", f"n{min(len(word), 32)}", f"@{word.count('@')}", f".{min(word.count('.'), 5)}",
             "p" + shape(word)[:3], "b" + shape(before[0])[:12], "f" + word[:1]]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def skip_links(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of each token with the one before it that is equal or similar."""
    last: dict[str, int] = {}
    out = set()
    for i, (a, b) in enumerate(tokens):
        word = text[a:b]
        digits = "".join(c for c in word if c.isdigit())
        for key in {"w" + "".join(c for c in word if c.isalnum()).lower(), *(["d" + digits[-10:]] if len(digits) >= 7 else [])}:
            if len(key) > 4:
                if key in last:
                    out.add((last[key], i))
                last[key] = i
    return sorted(out)


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The least of the tokens that links lead to from each of ``n``; links go from lower to higher, in order."""
    of = list(range(n))

    def top(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        of[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def truth(tokens: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """Label of each token: 1 + kind of a base span it overlaps, or 0."""
    y = np.zeros(len(tokens), np.int64)
    k, ordered = 0, sorted(spans, key=lambda s: s[1:])
    for i, (a, b) in enumerate(tokens):
        while k < len(ordered) and ordered[k][2] <= a:
            k += 1
        if k < len(ordered) and ordered[k][1] < b:
            y[i] = ordered[k][0] + 1
    return y


class Field:
    """Weights of the skip-chain field: unary [feature, label], chain and skip [label, label]."""

    def __init__(self):
        self.unary, self.chain, self.skip = np.zeros((FEATURES, L)), np.zeros((L, L)), np.zeros((L, L))

    def fit(self, docs: list[tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]], passes: int = 60, rate: float = 0.5) -> None:
        """Pseudo-likelihood over documents of (features, labels, chain links, skip links)."""
        if not docs:
            return
        rows, y, chain, skip, base = [], [], [], [], 0
        for f, labels, near, far in docs:
            rows += f
            y += labels
            chain += [(base + i, base + j) for i, j in near]
            skip += [(base + i, base + j) for i, j in far]
            base += len(f)
        x, y = np.array(rows), np.array(y)
        links = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
        tables, grads = [self.chain, self.skip], [np.full((L, L), 1e-2) for _ in range(2)]
        gu = np.full_like(self.unary, 1e-2)
        for _ in range(passes):
            score = self.unary[x].sum(axis=1)
            for table, e in zip(tables, links):
                np.add.at(score, e[:, 0], table.T[y[e[:, 1]]])
                np.add.at(score, e[:, 1], table[y[e[:, 0]]])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            miss = -p / p.sum(axis=1, keepdims=True)
            miss[np.arange(len(y)), y] += 1
            g = np.zeros_like(self.unary)
            np.add.at(g, x.ravel(), np.repeat(miss / len(y), x.shape[1], axis=0))
            g -= 1e-5 * self.unary
            gu += g * g
            self.unary += rate * g / np.sqrt(gu)
            for table, e, gt in zip(tables, links, grads):
                g = np.zeros((L, L))
                np.add.at(g.T, y[e[:, 1]], miss[e[:, 0]] / len(y))
                np.add.at(g, y[e[:, 0]], miss[e[:, 1]] / len(y))
                gt += g * g
                table += rate * g / np.sqrt(gt)

    def marginals(self, rows: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product marginals, all messages at once in each round, until they settle."""
        own = self.unary[np.array(rows)].sum(axis=1)
        edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        if not len(edges):
            p = np.exp(own - own.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)
        pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        send, take = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(send), L))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, take, message)
            out = total[send] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log((out[:, :, None] * pot).sum(axis=1) + 1e-300)
            new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            settled = np.abs(new - message).max() <= SETTLED
            message = new
            if settled:
                break
        total = own.copy()
        np.add.at(total, take, message)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def chain_links(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbours with nothing but white space between them; any other word is fixed to no entity."""
    return [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 8 and not text[tokens[i][1]:tokens[i + 1][0]].strip()]


def all_spans(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those the field adds."""
    if not MARK.search(text):
        return [], []
    base = base_spans(text)
    tokens = tokens_of(text)
    if field is None or not tokens:
        return base, base
    y, chain, skip = truth(tokens, base), chain_links(text, tokens), skip_links(text, tokens)
    p = field.marginals([features(text, t) for t in tokens], chain, skip)
    of, sure = components(len(tokens), skip), set()
    sure.update((c, int(label)) for c, label in zip(of, y) if label)
    joined = set(chain)
    added: list[Span] = []
    for i, label in enumerate(p.argmax(axis=1)):
        if label and not y[i] and p[i, label] >= (SURE_LINKED if (of[i], int(label)) in sure else SURE_ALONE):
            if added and added[-1][0] == label - 1 and (i - 1, i) in joined and added[-1][2] == tokens[i - 1][1]:
                added[-1] = (added[-1][0], added[-1][1], tokens[i][1])
            else:
                added.append((int(label) - 1, *tokens[i]))
    return base, sorted(base + added)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            tokens = tokens_of(text)
            base = base_spans(text)
            out.append({"n": len(tokens), "f": [features(text, t) for t in tokens], "y": truth(tokens, base).tolist(),
                        "c": [list(e) for e in chain_links(text, tokens)], "s": [list(e) for e in skip_links(text, tokens)]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int64()), ("f", pa.list_(pa.list_(pa.int64()))), ("y", pa.list_(pa.int64())),
                                                         ("c", pa.list_(pa.list_(pa.int64()))), ("s", pa.list_(pa.list_(pa.int64())))]))


def _find(field: Field | None, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        plain = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            found = [all_spans(t or "", field) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([plain(b) for b, _ in found], kind), pa.array([plain(s) for _, s in found], kind)],
                                             names=[*batch.schema.names, "base_spans", "spans"])

    return run


def find_personal_data(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of ``docs`` with base_spans and spans: lists of (kind, start, end)."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text", F.lit(5)).alias("draw"))
    n = marked.count()
    part = marked.where(F.pmod("draw", F.lit(1 << 30)) / (1 << 30) < SAMPLE_DOCS / max(n, 1)).select("text")
    learned = part.mapInArrow(_learn, "n long, f array<array<long>>, y array<long>, c array<array<long>>, s array<array<long>>")
    rows = learned.where(F.col("n").between(1, SAMPLE_LONGEST)).limit(SAMPLE_DOCS * 2).collect()
    rows = sorted(rows, key=lambda r: (r["f"], r["y"]))
    kept, total = [], 0
    for r in rows:
        total += r["n"]
        if total <= SAMPLE_TOKENS:
            kept.append((r["f"], r["y"], [tuple(e) for e in r["c"]], [tuple(e) for e in r["s"]]))
    field = None
    if any(any(r[1]) for r in kept):
        field = Field()
        field.fit(kept)
    out = docs.select(*[c for c in carry if c not in ("base_spans", "spans", "text")], "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    spans = "array<struct<kind:int,start:bigint,end:bigint>>"
    return out.mapInArrow(_find(field, out.columns.index("text")), f"{types}, base_spans {spans}, spans {spans}").drop("text")
