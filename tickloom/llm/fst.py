"""Token counts by a deterministic transducer compiled from a byte-level BPE vocabulary.

The transducer reads code points. A state is the mode of the pre-token pattern, together with the state of the merges
inside the open pre-token: the longest suffix that begins some token, and for each of its suffixes that does so too the
last token before it and the tokens since. That determines how any continuation is tokenised, so the machine is finite;
each transition carries the change of the token count. States and transitions are compiled when a text first needs them
and kept by the worker; a table beyond MAX_STATES is dropped and compiled anew, which bounds memory and changes nothing.

Texts are cut into chunks. The map of a chunk is (head, count, exit): after the first white space that follows another
character the state no longer depends on the entry, so only the head is left open; it is run from the exit of the chunk
before when maps are composed. A chunk without such a place is all head. Composition is associative and is done as a
prefix scan in rounds of doubling distance.

Null text counts as empty (0 tokens); special tokens inside texts count as one token each, as the library does by
default. Rows repeat as they are; other columns are dropped. The stage is a narrow map without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.bpe import byte_characters
from tickloom.llm.common import id_text, map_arrow, read_bytes, texts_of

MAX_STATES = 200_000
MAX_PIECES = 500_000
CHUNK = 16_384
SPACES = frozenset([*map(chr, range(9, 14)), " ", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])
#: Second letters of contractions that have two: 're 've 'll.
LONG = {"r": "e", "v": "e", "l": "l"}
NEVER = 1 << 60


class Merges:
    """The merge rules as an automaton over bytes.

    A state is a node of the token trie (the longest suffix read that begins some token) with a mark for each of its
    suffixes that begins a token, longest first, and one for the end: (last token + 1) * 1024 + 512 + the tokens gained
    since then; last token + 1 is 0 at the pre-token's first byte.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its halves and the rank of their merge
        for rank, (a, b) in enumerate(merges):
            t = tokens[a + b]
            self.pair[tokens[a], tokens[b]] = (rank, t)
            self.parts.setdefault(t, (tokens[a], tokens[b], rank))
        self.byte = {b: tokens[bytes([b])] for b in range(256)}
        self.bytes = {t: b for b, t in tokens.items()}
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for word, t in tokens.items():
            node = 0
            for b in word:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = t
        self.fail = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            later = []
            for node in level:
                for b, to in self.child[node].items():
                    self.fail[to] = self._goto(self.fail[node], b)
                    later.append(to)
            level = later
        self.moves: dict[tuple[int, int], tuple] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.known = {(0, (512,)): 0}
        self.states = [(0, (512,))]

    def _goto(self, node: int, b: int) -> int:
        while node and b not in self.child[node]:
            node = self.fail[node]
        return self.child[node].get(b, 0)

    def _chain(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(node)
            node = self.fail[node]
        return [*out, 0]

    def _move(self, node: int, b: int) -> tuple:
        """The next node, where its marks stand among the old ones, and the tokens that may end here with their mark."""
        at = {self.depth[n]: i for i, n in enumerate(self._chain(node))}
        to = self._goto(node, b)
        chain = self._chain(to)[:-1]
        out = self.moves[node, b] = (to, [at[self.depth[n] - 1] for n in chain], [(at[self.depth[n] - 1], self.token[n]) for n in chain if self.token[n] >= 0])
        return out

    def merged(self, word: bytes) -> list[int]:
        """Plain merging, for single tokens when compiling."""
        out = [self.byte[b] for b in word]
        while len(out) > 1:
            best = min(((*self.pair[p], i) for i in range(len(out) - 1) if (p := (out[i], out[i + 1])) in self.pair), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def _fit(self, key: int) -> bool:
        """Whether a token may follow the last token before it (or begin the pre-token): it's what its own bytes merge to, and
        at no time would pieces that meet at the border have merged. A piece lives from its own merge to the one that uses it."""
        last, t = (key >> 32) - 1, key & 0xFFFFFFFF
        if t not in self.whole:
            self.whole[t] = self.merged(self.bytes[t]) == [t]
        ok = self.whole[t]
        if ok and last >= 0:
            made = lambda x: self.parts[x][2] if x in self.parts else -1
            a, b = self._border(last, 1), self._border(t, 0)
            i, j = len(a) - 1, len(b) - 1
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                hit = self.pair.get((x, y), (NEVER,))[0]
                if max(made(x), made(y)) < hit < x_ends and hit <= y_ends:  # at equal ranks the leftmost pair merges first
                    ok = False
                    break
                if i == 0 and j == 0:
                    break
                if j == 0 or (i > 0 and x_ends <= y_ends):
                    i -= 1
                else:
                    j -= 1
        self.fits[key] = ok
        return ok

    def _border(self, t: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one border of a token, largest first, with the rank of the merge that ends each."""
        out = [(t, NEVER)]
        while t in self.parts:
            rank = self.parts[t][2]
            t = self.parts[t][side]
            out.append((t, rank))
        return out

    def step(self, state: int, b: int) -> tuple[int, int]:
        """The state after one byte, and the change of the number of tokens."""
        node, marks = self.states[state]
        to, places, ends = self.moves.get((node, b)) or self._move(node, b)
        for i, t in ends:
            mark = marks[i]
            key = (mark >> 10) << 32 | t
            ok = self.fits.get(key)
            if ok or ok is None and self._fit(key):
                change = 513 - (mark & 1023)
                new = (to, (*[marks[k] + change for k in places], (t + 1) << 10 | 512))
                s = self.known.get(new)
                if s is None:
                    s = self.known[new] = len(self.states)
                    self.states.append(new)
                return s, change
        raise ValueError("no token ends at this byte")


class Machine:
    """The transducer: states are numbers, a transition is next state * 1024 + 512 + change of the count."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.merges = Merges(tokens, merges)
        self.pieces: dict[str, int] = {}
        self.kinds: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.merges.reset()
        self.table: dict[int, int] = {}
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[str, int, str]] = []
        self.start = self.state("start", 0, "")
        self.blank = self.state("space", 0, " ")

    def state(self, mode: str, open_: int, extra: str) -> int:
        key = (mode, open_, extra)
        s = self.known.get(key)
        if s is None:
            s = self.known[key] = len(self.states)
            self.states.append(key)
        return s

    def final(self, s: int) -> int:
        """Tokens that a text ending in this state has besides those counted."""
        mode, open_, extra = self.states[s]
        return self.feed(open_, extra)[1] if mode == "space" else int(mode == "two")

    def feed(self, open_: int, c: str) -> tuple[int, int]:
        """The merges after all bytes of a character."""
        change = 0
        for b in c.encode("utf-8", "surrogatepass"):
            open_, more = self.merges.step(open_, b)
            change += more
        return open_, change

    def kind(self, c: str) -> str:
        k = self.kinds.get(c)
        if k is None:
            k = "space" if c in SPACES else {"L": "letter", "N": "number"}.get(unicodedata.category(c)[0], "other")
            self.kinds[c] = k
        return k

    def begin(self, c: str) -> tuple[int, int]:
        """The first character of a pre-token."""
        kind = self.kind(c)
        if kind == "space":
            return self.state("space", 0, c), 0
        to, change = self.feed(0, c)
        return self.state("quote" if c == "'" else kind, to, ""), change

    def arc(self, s: int, c: str) -> tuple[int, int]:
        mode, open_, extra = self.states[s]
        kind = self.kind(c)
        if mode == "space":  # extra: the run's last character, not read yet
            if kind == "space":
                to, change = self.feed(open_, extra)
                return self.state("space", to, c), change
            if extra == " ":
                to, change = self.feed(0, " ")
                to, more = self.feed(to, c)
                return self.state(kind, to, ""), change + more
            alone = self.feed(0, extra)[1]
            to, change = self.begin(c)
            return to, alone + change
        if mode == "quote":
            if c in "stmd":
                return self.start, self.feed(open_, c)[1]
            if c in LONG:
                return self.state("two", open_, c), 0
            if kind == "other":
                to, change = self.feed(open_, c)
                return self.state("other", to, ""), change
            return self.begin(c)
        if mode == "two":  # a quote and the first letter of a contraction, which isn't counted yet
            if c == LONG[extra]:
                to, change = self.feed(open_, extra)
                return self.start, change + self.feed(to, c)[1]
            to, change = self.begin(extra)
            to, more = self.arc(to, c)
            return to, change + more
        if mode == kind:
            to, change = self.feed(open_, c)
            return self.state(kind, to, ""), change
        return self.begin(c)

    def run(self, s: int, text: str) -> tuple[int, int]:
        n, table = 0, self.table
        for c in text:
            key = s << 21 | ord(c)
            v = table.get(key)
            if v is None:
                to, change = self.arc(s, c)
                v = table[key] = to << 10 | (change + 512)
            s = v >> 10
            n += (v & 1023) - 512
        return s, n

    def body(self, text: str) -> tuple[int, int]:
        """run() from the state after a blank. What stands between two blanks takes that state to itself if it ends with no white
        space, so its count is a constant of the string; a bounded memo holds these maps."""
        *most, rest = text.split(" ")
        pieces, n, s = self.pieces, 0, self.blank
        try:
            n = sum(map(pieces.__getitem__, most))
        except KeyError:
            for piece in most:
                if s == self.blank and (v := pieces.get(piece)) is not None:
                    n += v
                    continue
                at = s
                s, v = self.run(at, piece + " ")
                n += v
                if s == self.blank == at:
                    pieces[piece] = v
        s, v = self.run(s, rest)
        return s, n + v

    # --- chunk maps --------------------------------------------------------------------------------------------------

    def chunk_map(self, text: str) -> tuple[str, int, int | None]:
        """(head, count of the rest, exit); exit None: the whole chunk is head."""
        for i in range(1, len(text)):
            if text[i] == " " and text[i - 1] not in SPACES:
                exit_, n = self.body(text[i + 1 :])
                return text[: i + 1], n, exit_
        return text, 0, None

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        exit_, n = self.run(a[2], b[0])
        return (a[0], a[1] + n + b[1], b[2]) if b[2] is not None else (a[0], a[1] + n, exit_)

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions; rounds of doubling distance."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, m: tuple) -> int:
        """The tokens of a text from the map of all of it."""
        s, n = self.run(self.start, m[0])
        if m[2] is not None:
            s, n = m[2], n + m[1]
        return n + self.final(s)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)] or [("", 0, None)]
        return self.total(self.scan(maps)[-1])


class Counter:
    """A machine and the special tokens, from a tokenizer file."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        back = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda s: bytes(back[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {t["content"] for t in spec["added_tokens"]}
        self.machine = Machine({raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}, [(raw(a), raw(b)) for a, b in pairs])
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if self.special is None or not self.special.search(text):
            return self.machine.count(text, chunk)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.machine.count(p, chunk) for p in parts)


_counters: dict[bytes, Counter] = {}


def counter(data: bytes) -> Counter:
    key = hashlib.md5(data).digest()
    if key not in _counters:
        _counters[key] = Counter(data)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    data = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = counter(data.value), texts_of(batch)
        n = [c.count(t) for t in texts]
        return pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                                pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(id_text(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
