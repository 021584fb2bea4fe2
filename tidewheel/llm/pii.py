"""Personal data by a linear-chain conditional random field over word-shape features.

The field is trained when the operator is planned, from a small labelled table that ``labelled`` makes
from carriers and fillers under a fixed seed; all its weights are learned. Tokens are runs of word characters and single other
characters; features are the shapes of a token and its neighbours, where white space stands, what the run of tokens without white space holds, and how near an
assignment to a keyword such as password stands before; moves between labels have weights of their own where white space is between the tokens. Every token of every text is scored; texts go through numpy as arrays of characters and tokens.

Decoding gives the best labels of the whole text. A token's label OTHER is settled where no run of other labels around it could be worth more
than OTHER throughout, by the sums of the greatest gains of its tokens and moves: then no best path has another label there. What isn't settled is
left in short runs between settled tokens, and Viterbi's recursion goes over batches of these runs; a text in which
nothing is settled is one run.

Cost: one scan without a shuffle. Long texts are read in blocks that end before white space.

Kinds: e-mail addresses; phone numbers; IPv4 and IPv6 addresses; payment cards; secrets (hexadecimal and mixed keys, prefixed tokens, and values assigned to
a keyword); international account numbers; national numbers of the form ddd-dd-dddd. Names and postal addresses aren't found.

Defined cases: null and blank texts hold nothing and stay as they are; spans count characters of the text as
given; neighbouring tokens of one kind are one finding, for kinds without white space in them (WHOLE) as far as there is none; a null id is kept; rows that repeat an id each give their findings; an empty table gives
an empty result; other columns pass through redact() unchanged, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import crf
from tidewheel.llm.common import on_texts, pieces, table

KINDS = ["OTHER", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN", "NATIONAL_ID"]
WHOLE = np.array([k in ("EMAIL", "IP", "SECRET", "NATIONAL_ID") for k in KINDS])
#: Rows of the labelled table, and its seed.
ROWS, SEED = 1600, 11
STEPS, RATE = 60, 0.4
KEYWORDS = (
    "token key secret password passwd pwd passphrase apikey auth bearer api_key access_key secret_key private_key access_token auth_token api_token refresh_token "
    "client_secret secret_access_key aws_secret_access_key db_password user_password"
).split()
#: Characters of texts, and tokens, that numpy handles at once.
BLOCK_CHARS, BLOCK_TOKENS = 1 << 18, 1 << 16

#: Characters that are shapes of their own.
OWN = "@.,+-()=\"':/"
NAMES = [
    "edge", "sym", *OWN, "keyword", "d1", "d2", "d3", "d4", "d5", "d6-12", "d13-19", "d20+", "x1", "x2-8", "x9-15", "x16-31", "x32+", "X1", "X2-8", "X9-15", "X16-31", "X32+",
    "Xx2-8", "Xx9-15", "Xx16-31", "Xx32+", "hex1", "hex2-4", "hex5-15", "hex16-31", "hex32+", "mix2-4", "mix5-15", "mix16-31", "mix32+", "MIX2-4", "MIX5-15", "MIX16-31", "MIX32+", "UUdd", "iban",
]
_ID = {name: i for i, name in enumerate(NAMES)}
S = 52  # as many shapes as codes leave room for
_SPACE = re.compile(r"\s")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Chars:
    """Classes of all characters, made once in a process."""

    def __init__(self) -> None:
        n = 0x110000
        of = lambda f: np.fromiter((f(chr(i)) for i in range(n)), bool, n)
        self.space, self.digit, self.alpha, self.upper, self.lower = of(str.isspace), of(str.isdigit), of(str.isalpha), of(str.isupper), of(str.islower)
        self.word = of(str.isalnum)
        self.word[ord("_")] = True
        self.hex = np.zeros(n, bool)
        self.hex[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
        self.own = np.full(n, _ID["sym"], np.uint8)
        for c in OWN:
            self.own[ord(c)] = _ID[c]
        self.ascii = np.arange(n) < 128
        self.low = np.arange(128, dtype=np.uint8)
        self.low[65:91] += 32


@lru_cache(1)
def chars() -> _Chars:
    return _Chars()


def _hash(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of runs of ASCII characters in lower case."""
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    powers = np.multiply.accumulate(np.full(int(n.max()), _STEP))
    return np.add.reduceat((chars().low[codes[at]].astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(n) - n)


@lru_cache(1)
def _keywords() -> tuple[np.ndarray, np.ndarray]:
    """Which (length, first letter) keywords have, and their hashes."""
    known = np.zeros((32, 128), bool)
    for k in KEYWORDS:
        known[len(k), ord(k[0])] = True
    return known, np.sort(np.concatenate([_hash(np.frombuffer(k.encode("utf-32-le"), np.uint32), np.zeros(1, int), np.array([len(k)])) for k in KEYWORDS]))


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and shapes of the tokens in an array of characters."""
    c = chars()
    word = c.word[codes]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    other = np.flatnonzero(~word & ~c.space[codes])
    start, end = np.concatenate([edge[::2], other]), np.concatenate([edge[1::2], other + 1])
    shape = np.empty(len(start), np.uint8)
    n_words = len(edge) // 2
    shape[n_words:] = c.own[codes[other]]
    if n_words:
        a, b = start[:n_words], end[:n_words]
        n = b - a

        def count(kind: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind[codes], dtype=np.int32)])
            return total[b] - total[a]

        digits, letters, upper, lower, hexes = (count(k) for k in (c.digit, c.alpha, c.upper, c.lower, c.hex))
        size = np.searchsorted([1, 8, 15, 31], n)  # 1, 2-8, 9-15, 16-31, 32+
        mixed = np.searchsorted([4, 15, 31], n)  # to 4, 15, 31, more
        case = np.where(lower == n, _ID["x1"] + size, np.where(upper == n, _ID["X1"] + size, _ID["Xx2-8"] + np.maximum(size, 1) - 1))
        out = np.where((upper > 0) & (lower == 0), _ID["MIX2-4"], _ID["mix2-4"]) + mixed
        out = np.where(hexes == n, np.where(n == 1, _ID["hex1"], _ID["hex2-4"] + mixed), out)
        out = np.where(letters == n, case, out)
        out = np.where(digits == n, np.where(n < 6, _ID["d1"] - 1 + n, _ID["d6-12"] + np.searchsorted([12, 19], n)), out)
        four = np.flatnonzero((n >= 4) & (n <= 34) & (upper + digits == n) & (digits >= 2) & (upper >= 2))
        head = codes[a[four][:, None] + np.arange(4)] if len(four) else np.zeros((0, 4), codes.dtype)
        four = four[c.upper[head[:, :2]].all(1) & c.digit[head[:, 2:]].all(1)]
        out[four[n[four] == 4]] = _ID["UUdd"]
        out[four[n[four] >= 15]] = _ID["iban"]
        known, hashes = _keywords()
        first = codes[a]
        maybe = np.flatnonzero((n < 32) & (first < 128) & (count(c.ascii) == n))
        maybe = maybe[known[n[maybe], c.low[first[maybe]]]]
        if len(maybe):
            got = _hash(codes, a[maybe], n[maybe])
            out[maybe[hashes[np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)] == got]] = _ID["keyword"]
        shape[:n_words] = out
    order = np.argsort(start, kind="stable")
    return start[order], end[order], shape[order]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """The text in parts of about BLOCK_CHARS that end before white space."""
    lo = 0
    while lo < len(text):
        m = _SPACE.search(text, lo + BLOCK_CHARS) if lo + BLOCK_CHARS < len(text) else None
        hi = m.start() if m else len(text)
        yield lo, text[lo:hi]
        lo = hi


class Tokens:
    """The tokens of several texts in a row: doc (which text), start and end in it, shape, and what features need of their neighbours."""

    def __init__(self, texts: list[str | None]) -> None:
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, int, str]] = []  # text, offset, part
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                start, end, shape = tokens(_codes("\n".join(x for _, _, x in held)))
                begins = np.cumsum([0, *(len(x) + 1 for _, _, x in held)])
                at = np.searchsorted(begins, start, "right") - 1
                shift = np.array([o for _, o, _ in held])[at] - begins[at]
                parts.append((np.array([i for i, _, _ in held])[at], start + shift, end + shift, shape))
                held.clear()
                size = 0

        for i, text in enumerate(texts):
            for lo, part in blocks(text or ""):
                held.append((i, lo, part))
                size += len(part)
                if size >= BLOCK_CHARS:
                    flush()
        flush()
        none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint8))
        self.doc, self.start, self.end, self.shape = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        self.n = len(self.doc)
        self.first = np.ones(self.n, bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        self.glued = np.zeros(self.n, bool)
        self.glued[1:] = ~self.first[1:] & (self.start[1:] == self.end[:-1])
        before = self.beside(-1)
        assign = np.isin(self.shape, [_ID["="], _ID[":"]]) & ((before == _ID["keyword"]) | (np.isin(before, [_ID['"'], _ID["'"]]) & (self.beside(-2) == _ID["keyword"])))
        self.assigned = np.zeros(self.n, np.uint8)  # tokens from the assignment to a keyword, up to 3; 0 for none
        for k in (3, 2, 1):
            at = np.flatnonzero(assign) + k
            at = at[at < self.n]
            self.assigned[at[self.doc[at] == self.doc[at - k]]] = k

        # runs of tokens without white space: @, dots, dashes, colons and letters in them
        begins = np.flatnonzero(~self.glued)
        self.run = np.zeros(self.n, np.uint8)
        if self.n:
            count = lambda x, most: np.minimum(np.add.reduceat(x.astype(np.int32), begins), most)
            held = count(self.shape == _ID["@"], 1)
            for kind, most in ((self.shape == _ID["."], 4), (self.shape == _ID["-"], 3), (self.shape == _ID[":"], 2), (self.shape >= _ID["x1"], 1)):
                held = held * (most + 1) + count(kind, most)
            self.run = np.repeat(held, np.diff(np.append(begins, self.n))).astype(np.uint8)

    def beside(self, k: int) -> np.ndarray:
        """The shapes k tokens further in the same text; edge where there is none."""
        out = np.full(self.n, _ID["edge"], np.uint8)
        if k < 0 and self.n > -k:
            out[-k:] = np.where(self.doc[-k:] == self.doc[:k], self.shape[:k], _ID["edge"])
        elif k > 0 and self.n > k:
            out[:-k] = np.where(self.doc[:-k] == self.doc[k:], self.shape[k:], _ID["edge"])
        return out

    def features(self) -> np.ndarray:
        """Codes of the features, a column for each kind; each column has a range of its own."""
        s, g = self.shape.astype(np.int64), self.glued.astype(np.int64)
        p1, n1, p2, n2 = (self.beside(k).astype(np.int64) for k in (-1, 1, -2, 2))
        g1 = np.append(g[1:], 0)
        left, right = (p1 * 2 + g) * S + s, (s * 2 + g1) * S + n1
        return np.stack([s, S + p1, 2 * S + n1, 3 * S + p2, 4 * S + n2, _AT_LEFT + left, _AT_RIGHT + right, _AT_THREE + (left * 2 + g1) * S + n1, np.where(self.assigned > 0, _AT_KEY + self.assigned.astype(np.int64) * S + s, -1), _AT_RUN + self.run.astype(np.int64) * S + s], axis=1)


_AT_LEFT = 5 * S
_AT_RIGHT = _AT_LEFT + 2 * S * S
_AT_THREE = _AT_RIGHT + 2 * S * S
_AT_KEY = _AT_THREE + 4 * S * S * S
_AT_RUN = _AT_KEY + 4 * S
_CODES = _AT_RUN + 256 * S


def labelled(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A table of texts with the spans of personal data in them: public formats with random contents in invented prose."""
    r = random.Random(seed)
    syllables = "ka lo mi ne ru sta vel tor an es ing der ción que eau ung pre dos al um".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 6])))
    plain = lambda n: "".join(r.choice("kalomineustavelrtgdpb") for _ in range(n))
    of = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    digits = lambda n: of("0123456789", n)
    host = lambda: ".".join([*(word() + r.choice(["", "", digits(1)]) for _ in range(r.randint(1, 2))), r.choice(["com", "org", "net", "io", "example.com", "co.uk", "de"])])
    upper, lower, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    base = upper + lower + "0123456789"

    def email() -> str:
        name = r.choice([word(), word(), word(), of(lower, 1)]) + r.choice(["", "." + word(), "." + digits(2), digits(2), "_" + word(), "-" + word(), "+" + word(), "." + digits(2), "." + digits(3)])
        return name + "@" + host()

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}",
            f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{digits(11)}", f"0{digits(4)} {digits(6)}",
        ])

    def ip() -> str:
        if r.random() < 0.6:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        groups = [of(hexes, r.choice([4, 4, 3, 2, 1])) for _ in range(r.choice([8, 8, 6, 5, 4, 3]))]
        return ":".join(groups) if len(groups) == 8 else ":".join(groups[: r.randint(1, len(groups) - 1)]) + "::" + ":".join(groups[-1:])

    def iban() -> str:
        number = of(upper, 2) + digits(2) + r.choice([digits(18), digits(18), of(upper, 4) + digits(14), digits(20), digits(23)])
        return number if r.random() < 0.5 else " ".join(number[i : i + 4] for i in range(0, len(number), 4))

    def key() -> tuple[str, bool]:
        """A secret, and whether it tells itself without a keyword."""
        return r.choice([
            lambda: (of(hexes, r.choice([32, 40, 40, 64])), True), lambda: (of(hexes, r.choice([32, 40, 64])), True), lambda: (of(base, r.choice([32, 36, 40, 48])), True),
            lambda: (r.choice(["AKIA", "ASIA", ""]) + of(upper + "0123456789", r.choice([16, 20])), True), lambda: (r.choice(["ghp_", "gho_", "xoxb_", "pk_live_", "sk_test_", "glpat_"]) + of(base, r.choice([24, 36])), True),
            lambda: ("eyJ" + of(base, r.randint(17, 33)) + ".eyJ" + of(base, r.randint(20, 60)) + "." + of(base + "_", 43), True), lambda: (of(base, r.randint(20, 30)) + r.choice("+/") + of(base, r.randint(8, 20)) + "=" * r.randint(0, 2), False),
            lambda: (plain(r.randint(12, 30)), False), lambda: (of(lower, r.randint(16, 32)), False), lambda: (plain(r.randint(5, 14)) + digits(r.randint(1, 4)), False), lambda: (plain(4) + digits(1) + plain(8), False), lambda: (of(base, r.randint(8, 24)), False),
        ])()

    fill = {
        "EMAIL": email, "PHONE": phone, "IP": ip, "IBAN": iban, "NATIONAL_ID": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "CARD": lambda: r.choice([digits(16), digits(16), digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(15)]),
    }
    kinds = [*fill, "SECRET", "SECRET", "SECRET", "EMAIL", "PHONE"]
    harmless = [
        lambda: str(r.randint(1, 999)), lambda: digits(r.randint(1, 4)), lambda: f"{word()} {r.randint(1, 999)}.", lambda: f"{r.randint(1, 255)}. {word()}", lambda: f"{r.randint(1, 999)}, {r.randint(1, 999)}.",
        lambda: f"version {r.randint(1, 9)}", lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"BY-NC {r.randint(1, 4)}.0",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1900, 2030)}",
        lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(1, 99)}%", lambda: digits(r.randint(5, 10)), lambda: f"({r.randint(1, 40)})",
        lambda: f"{r.randint(1, 9)}-{r.randint(10, 20)}", lambda: f"{word()}{r.randint(1, 99)}", lambda: f"@{word()}", lambda: f"{r.randint(1, 999)},{digits(3)}", lambda: f'"{word()}"', lambda: f"({word()})",
        lambda: f"{word()}-{word()}", lambda: f"{word()} = {word()}", lambda: f"+{word()}", lambda: f"{r.choice(KEYWORDS)} {word()}", lambda: f"{r.randint(1, 9)}. {word()}", lambda: f"{word()}@ {word()}", lambda: f"{word()}: {word()}",
        lambda: f"{r.choice(KEYWORDS)}{r.choice([' = ', ': '])}{plain(r.randint(2, 7))}", lambda: f"{r.choice(KEYWORDS)}: {plain(r.randint(2, 8))} {word()}", lambda: f"the {r.choice(KEYWORDS)}, {word()}.", lambda: f"{r.choice(KEYWORDS)}.", lambda: f"{plain(5)}_{plain(6)}",
        lambda: f"https://{host()}/{word()}/{word()}", lambda: f"www.{host()}", lambda: f"{word()}.{r.choice(['py', 'txt', 'html'])}", lambda: f"{plain(4)}{plain(5).capitalize()}{plain(4).capitalize()}", lambda: f"{of(upper, r.randint(2, 5))}{r.randint(1, 999)}", lambda: plain(r.randint(16, 34)), lambda: of(hexes, 7),
        lambda: " ".join([r.choice("aeoyçß")] * r.randint(2, 9)), lambda: " ".join([word()] * r.randint(3, 9)), lambda: ", ".join([r.choice([word(), r.choice("aeoy")])] * r.randint(2, 6)), lambda: r.choice(["a", "e", "o", "y", "I", "de", "be"]),
        lambda: f"{r.randint(1, 99)}.{digits(3)}.{digits(3)}", lambda: f"{r.randint(1, 9)} {r.randint(1, 9)} {r.randint(1, 9)} {r.randint(1, 9)}", lambda: f"{word()}::{word()}", lambda: f"{digits(3)} {digits(3)}", lambda: f"pp. {digits(3)}-{digits(3)}",
    ]
    out = []
    for _ in range(rows):
        style = r.choice(["plain"] * 4 + ["upper", "noise", "pipe"])
        text, spans, n = "", [], r.randint(6, 24)
        slots = {r.randrange(n): r.choice(kinds) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}
        for i in range(n):
            if i:
                text += r.choice(["\n", " "]) if r.random() < 0.1 else " "
            tail = r.choice([".", ","]) if r.random() < 0.2 else ""
            noise = "!!" if style == "upper" else r.choice(["%%%", "***", "$$$", "###", "&&&"]) if style == "noise" else ""
            if i in slots:
                kind = slots[i]
                alone = False
                value, alone = key() if kind == "SECRET" else (fill[kind](), True)
                value = value.upper() if style == "upper" and r.random() < 0.8 else value
                before, after = "", ""
                if kind == "SECRET" and not (alone and r.random() < 0.2):
                    q = r.choice(['"', '"', '"', "'", ""])
                    name = r.choice(["token", "key", "password", "password", *KEYWORDS, word()] if alone else ["password", "password", "token", *KEYWORDS])
                    before = r.choice([name + r.choice([" = ", " = ", "=", ": ", ":"]), f'"{name}": ']) + q if r.random() < 0.9 or not alone else "bearer "
                    after = q if before[-1:] == q else ""
                    before = before.upper() if style == "upper" else before.capitalize() if r.random() < 0.1 else before
                elif r.random() < 0.15:
                    before, after = r.choice([("(", ")"), ("<", ">"), ('"', '"'), ("mail: ", ""), ("tel: ", "")])
                text += before
                spans.append((len(text), len(text) + len(value), kind))
                text += value + after
            elif r.random() < 0.25:
                text += r.choice(harmless)()
            else:
                text += word().capitalize() if r.random() < 0.15 else word().upper() if style == "upper" else word()
            text += tail + noise + (" |" if style == "pipe" else "")
        out.append((text, spans))
    return out


class Tagger:
    """A trained field with the ids of its features."""

    def __init__(self, rows: list[tuple[str, list[tuple[int, int, str]]]]) -> None:
        toks = Tokens([t for t, _ in rows])
        codes = toks.features()
        known, seen = np.unique(codes[codes >= 0], return_counts=True)
        known = known[seen > 1]
        self.ids = np.full(_CODES + 1, -1, np.int32)  # the last one is for none
        self.ids[known] = np.arange(len(known))
        marks = np.zeros(toks.n, int)
        for i, (_, found) in enumerate(rows):
            for a, b, kind in found:
                marks[(toks.doc == i) & (toks.start >= a) & (toks.end <= b)] = KINDS.index(kind)
        ends = np.flatnonzero(toks.first)[1:]
        self.model = crf.train(np.split(self.ids[codes], ends), np.split(marks, ends), len(known), len(KINDS), steps=STEPS, rate=RATE, moves_by=np.split(toks.glued.astype(np.int8), ends), n_classes=2)

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "model": self.model}

    def tables(self) -> tuple[np.ndarray, ...]:
        """The scores of a token with its neighbours, of the tokens beyond them, and of assignments; made once in a process."""
        if not hasattr(self, "_tables"):
            emit = self.model.emit.astype(np.float32)
            of = lambda lo, hi: emit[self.ids[lo:hi]]
            k = len(KINDS)
            three = of(_AT_THREE, _AT_KEY).reshape(S, 2, S, 2, S, k)
            three += of(_AT_LEFT, _AT_RIGHT).reshape(S, 2, S, 1, 1, k)
            three += of(_AT_RIGHT, _AT_THREE).reshape(1, 1, S, 2, S, k)
            three += of(0, S).reshape(1, 1, S, 1, 1, k)
            three += of(S, 2 * S).reshape(S, 1, 1, 1, 1, k)
            three += of(2 * S, 3 * S).reshape(1, 1, 1, 1, S, k)
            key = of(_AT_KEY, _AT_RUN).copy()
            key[:S] = 0  # no assignment near
            self._tables = three.reshape(-1, k), of(3 * S, 4 * S), of(4 * S, 5 * S), key, of(_AT_RUN, _CODES)
        return self._tables

    def scores(self, toks: Tokens) -> np.ndarray:
        """Tokens x labels."""
        three, before, after, key, run = self.tables()
        p1, n1, p2, n2 = (toks.beside(k) for k in (-1, 1, -2, 2))
        g1 = np.append(toks.glued[1:], False)
        out = np.empty((toks.n, len(KINDS)), np.float32)
        for lo in range(0, toks.n, BLOCK_TOKENS):
            x = slice(lo, lo + BLOCK_TOKENS)
            code = (((p1[x].astype(np.int32) * 2 + toks.glued[x]) * S + toks.shape[x]) * 2 + g1[x]) * S + n1[x]
            out[x] = three[code] + before[p2[x]] + after[n2[x]] + run[toks.run[x].astype(np.int32) * S + toks.shape[x]]
            near = np.flatnonzero(toks.assigned[x])
            out[lo + near] += key[toks.assigned[x][near].astype(np.int32) * S + toks.shape[x][near]]
        return out

    def unsettled(self, scores: np.ndarray, toks: Tokens) -> np.ndarray:
        """Tokens that a best path may label other than OTHER.

        A run of other labels is worth at most the sum of its tokens' greatest gains over OTHER and of the greatest gains of moves into, inside and out of
        a run. A token is settled if no run around it is worth more than 0: the best such run ends at the token, and starts there, by running maxima."""
        m, way = self.model, toks.glued.astype(np.int8)
        gain = (scores[:, 1:].max(axis=1) - scores[:, 0]).astype(float)
        rest = m.move[:, 0, 0]
        stay = (m.move[:, 1:, 1:].max(axis=(1, 2)) - rest)[way]  # of the move into each token
        into = np.where(toks.first, (m.first[1:] - m.first[0]).max(), (m.move[:, 0, 1:].max(axis=1) - rest)[way])
        leave = np.append((m.move[:, 1:, 0].max(axis=1) - rest)[way[1:]], 0.0)
        leave = np.where(np.append(toks.first[1:], True), (m.last[1:] - m.last[0]).max(), leave)

        def best(gain: np.ndarray, stay: np.ndarray, edge: np.ndarray, text: np.ndarray) -> np.ndarray:
            """The greatest worth of a run that ends at each token; texts are apart by more than any worth."""
            total = np.cumsum(gain + stay) - text * 1e6
            return total + np.maximum.accumulate(edge + gain - total)

        text = np.cumsum(toks.first).astype(float)
        ends = best(gain, stay, into, text)
        starts = best(gain[::-1], np.append(stay[1:], 0.0)[::-1], leave[::-1], text[-1] - text[::-1])[::-1]
        return ends + starts - gain > -1e-2

    def labels(self, toks: Tokens) -> np.ndarray:
        """The best label of every token."""
        out = np.zeros(toks.n, np.int8)
        if not toks.n:
            return out
        m, scores = self.model, self.scores(toks)
        last = np.append(toks.first[1:], True)
        at = np.flatnonzero(self.unsettled(scores, toks))
        if not len(at):
            return out
        begins = np.flatnonzero(np.append(True, (np.diff(at) > 1) | toks.first[at[1:]]))
        length = np.diff(np.append(begins, len(at)))
        from_ = at[begins]
        for size in np.unique(np.searchsorted(1 << np.arange(40), length)):
            mine = np.flatnonzero(np.searchsorted(1 << np.arange(40), length) == size)
            t = int(length[mine].max())
            for lo in range(0, len(mine), max(1, BLOCK_TOKENS // t)):
                some = mine[lo : lo + max(1, BLOCK_TOKENS // t)]
                a, n = from_[some], length[some]
                rows = np.minimum(a[:, None] + np.arange(t), toks.n - 1)
                e = scores[rows].astype(float)
                way = toks.glued[rows].astype(np.int8)
                ends = a + n - 1
                beyond = toks.glued[np.minimum(ends + 1, toks.n - 1)].astype(np.int8)
                e[:, 0] += np.where(toks.first[a][:, None], m.first, m.move[way[:, 0], 0])
                e[np.arange(len(some)), n - 1] += np.where(last[ends][:, None], m.last, m.move[beyond, :, 0])
                bare = crf.Model(m.emit, m.move, np.zeros(len(KINDS)), np.zeros(len(KINDS)))
                got = crf.viterbi(e, n, bare, way)
                inside = np.arange(t)[None] < n[:, None]
                out[rows[inside]] = got[inside]
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, from, to) in each text; neighbouring tokens of one kind make one finding."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        toks = Tokens(texts)
        labels = self.labels(toks)
        at = np.flatnonzero(labels)
        if len(at):
            new = np.append(True, (np.diff(at) > 1) | (labels[at[1:]] != labels[at[:-1]]) | toks.first[at[1:]] | (WHOLE[labels[at[1:]]] & ~toks.glued[at[1:]]))
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(at)) - 1
            for i, k, a, b in zip(toks.doc[at[begins]].tolist(), labels[at[begins]].tolist(), toks.start[at[begins]].tolist(), toks.end[at[ends]].tolist(), strict=True):
                found[i].append((KINDS[k], a, b))
        return found


@lru_cache(4)
def tagger(rows: int = ROWS, seed: int = SEED) -> Tagger:
    return Tagger(labelled(rows, seed))


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value): personal data in the texts; text[start:end] is the value."""
    tag = tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            rows = [(i, *f) for i, fs in enumerate(tag.find(texts)) for f in fs]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([texts[r[0]][r[2] : r[3]] for r in rows], pa.string()),
                ],
                ["doc_id", "kind", "start", "end", "value"],
            )

    light = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return light.mapInArrow(run, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, kind string, start long, end long, value string")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    for kind, a, b in reversed(found):
        text = f"{text[:a]}<{kind}>{text[b:]}"
    return text


def redact(docs: DataFrame) -> DataFrame:
    """docs with <KIND> in the place of each finding; all rows and columns stay."""
    tag = tagger()

    clean = on_texts("string", lambda texts: [masked(t, f) if f else t for t, f in zip(texts, tag.find(texts), strict=True)])
    return docs.withColumn("text", clean(F.col("text").cast("string")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
