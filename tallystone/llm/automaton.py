"""Operator 9: byte-pair encoding by a tokenization automaton.

The automaton reads tokens; a word's encoding is its one accepted spelling.  Each token
leads to a state of its own, so a state is the last token read, and the transition table
says of every state and token whether there is an arc.  It starts with arcs between all
base symbols and is compiled by one gadget a merge u v -> w, in order: the state behind w
becomes a copy of the state behind v, the state behind u loses its arc v, and w becomes an
arc wherever u is one.  A token that ends a word has no arcs behind it and no row.

The table is one bit a state and token, kept as an index of distinct blocks of bits: compiled
once on the driver, sent to each machine as a file, and mapped by its workers.  A word is encoded left to right by looking up arcs:
at each position exactly one token that ends there continues the accepted path of what
stands before it.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import shutil
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import LATIN_WORDS, LONG, Kept, byte_letters
from .common import freed, kept, ready, tokenizer_path

#: The longest word spelled beside others.
BESIDE = 24
#: Bytes of a block of the table.
WIDE = 64
#: Odd multipliers of the hashes of substrings and of pairs.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def compiled(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in the order they are made, and the transition table: for each of them a row of bits, one a state that has the arc.

    States are the tokens that don't end a word, in the same order.
    """
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    inner = lambda s: not suffix or not s.endswith(suffix)
    letters = byte_letters()
    base = [s for x in letters for s in dict.fromkeys((x, x + suffix)) if s in vocab]
    merges = [(m, "".join(m)) for m in (tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in model["merges"])]
    states = sum(map(inner, base)) + sum(inner(w) for _, w in merges)
    table = np.zeros((len(base) + len(merges), -(-states // 8)), np.uint8)
    arc = {s: i for i, s in enumerate(base)}  # a token's row of the table
    state = {s: i for i, s in enumerate(filter(inner, base))}
    table[: len(base)] = np.packbits(np.arange(table.shape[1] * 8) < len(state), bitorder="little")
    for (u, v), w in merges:
        if u not in state or v not in arc or not table[arc[v], state[u] >> 3] >> (state[u] & 7) & 1:
            continue  # no path through u and v: the gadget adds nothing
        if w in arc:
            raise ValueError(f"two merges make {w!r}")
        n, (at, bit) = len(arc), divmod(state[u], 8)
        if v in state:
            new, (old_at, old_bit) = len(state), divmod(state[v], 8)
            table[:n, new >> 3] |= (table[:n, old_at] >> old_bit & 1) << (new & 7)
            state[w] = new
        table[arc[v], at] &= 255 ^ 1 << bit
        table[n] = table[arc[u]]
        arc[w] = n
    return np.array([vocab[s] for s in arc], np.int64), table[: len(arc)]


def in_blocks(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same table as (index, blocks): block index[row, i] holds bytes i * WIDE .. of a row.  Most blocks are alike."""
    n, width = table.shape
    whole = np.zeros((n, -(-width // WIDE) * WIDE), np.uint8)
    whole[:, :width] = table
    blocks, index = np.unique(whole.reshape(-1, WIDE).view(f"V{WIDE}").ravel(), return_inverse=True)
    return index.astype(np.int32).reshape(n, -1), blocks.view(np.uint8).reshape(-1, WIDE)


class Automaton:
    """Compiled from the merges of a vocabulary file, or with the order, index and blocks that were compiled from it before."""

    def __init__(self, spec: dict, made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        n = max(self.vocab.values()) + 1
        if made is None:
            order, table = compiled(model)
            made = (order, *in_blocks(table))
        order, self.index, self.blocks = made
        self.label = [""] * n
        for s, t in self.vocab.items():
            self.label[t] = s
        self.made = {self.label[t]: t for t in order.tolist()}
        self.longest = max(map(len, self.made))
        #: Of each token its row of the table, and its state; -1 for none.
        self.arc, self.state = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.arc[order] = np.arange(len(order))
        inner = order[[not self.suffix or not self.label[t].endswith(self.suffix) for t in order.tolist()]]
        self.state[inner] = np.arange(len(inner))
        self._tables()

    def _tables(self) -> None:
        """Tokens by the hashes of their strings, for many words at once."""
        self.symbol = {x: i + 1 for i, x in enumerate(byte_letters())}
        tokens = list(self.made.items())
        hashes = np.array([self._hash(s) for s, _ in tokens], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two tokens have one hash")
        order = np.argsort(hashes)
        self.hashes, self.tokens = hashes[order], np.array([t for _, t in tokens], np.int64)[order]
        size = 1 << 20
        self.slot = np.full(size + 64, -1, np.int32)  # open addressing, runs of fewer than 64
        for i, h in enumerate((self.hashes >> np.uint64(44)).tolist()):
            while self.slot[h] >= 0:
                h += 1
            self.slot[h] = i

    def _hash(self, s: str) -> int:
        h, tail = 0, bool(self.suffix) and s.endswith(self.suffix)
        for c in s[: len(s) - len(self.suffix)] if tail else s:
            h = (h * int(BASE) + self.symbol[c]) & (2**64 - 1)
        h = h * int(SPREAD) + (int(BASE) >> 1) * tail & (2**64 - 1)
        return (h ^ h >> 29) * int(BASE) & (2**64 - 1)

    def _find(self, h: np.ndarray, tail: bool) -> np.ndarray:
        """Tokens with these polynomial hashes, -1 for none."""
        h = h * SPREAD + (BASE >> np.uint64(1)) * np.uint64(tail)
        h = (h ^ (h >> np.uint64(29))) * BASE
        at, out = (h >> np.uint64(44)).astype(np.int64), np.full(len(h), -1, np.int64)
        live = np.arange(len(h))
        while len(live):
            i = self.slot[at[live]]
            got = i >= 0
            live, i = live[got], i[got]
            same = self.hashes[i] == h[live]
            out[live[same]] = self.tokens[i[same]]
            live = live[~same]
            at[live] += 1
        return out

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Has the state behind each u the arc v?"""
        s = self.state[u]
        at = self.index[self.arc[v], s // (8 * WIDE)]
        return (self.blocks[at, (s >> 3) % WIDE] >> (s & 7).astype(np.uint8) & 1).astype(bool)

    def spell_many(self, words: list[str]) -> list[list[int]]:
        """spell() of each word: words of one length go through the automaton side by side."""
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (t := self.made.get(w + self.suffix)) is not None:
                out[i] = [t]
            elif len(w) > BESIDE:
                out[i] = self.spell(w)
            else:
                by.setdefault(len(w), []).append(i)
        power = np.array([pow(int(BASE), k, 2**64) for k in range(BESIDE + 1)], np.uint64)
        table = np.zeros(512, np.uint64)
        for c, i in self.symbol.items():
            table[ord(c)] = i
        for n, rows in by.items():
            codes = np.frombuffer("".join([words[i] for i in rows]).encode("utf-16-le"), "<u2").reshape(len(rows), n)
            sym = table[codes]
            head = np.zeros((n + 1, len(rows)), np.uint64)
            for i in range(n):
                head[i + 1] = head[i] * BASE + sym[:, i]
            last, size = np.full((n + 1, len(rows)), -1, np.int64), np.zeros((n + 1, len(rows)), np.int64)
            for i in range(1, n + 1):
                todo = np.arange(len(rows))
                for j in range(max(0, i - self.longest), i):
                    t = self._find(head[i, todo] - head[j, todo] * power[i - j], i == n and bool(self.suffix))
                    some = np.flatnonzero(t >= 0)
                    if len(some) and j:
                        some = some[self.arcs(last[j, todo[some]], t[some])]
                    if len(some):
                        last[i, todo[some]], size[i, todo[some]] = t[some], i - j
                        keep = np.ones(len(todo), bool)
                        keep[some] = False
                        todo = todo[keep]
                        if not len(todo):
                            break
            if not size[1:].all():
                raise ValueError("no accepted spelling")
            last, size = last.T.tolist(), size.T.tolist()
            for i, t, s in zip(rows, last, size, strict=True):
                ids, at = [], n
                while at:
                    ids.append(t[at])
                    at -= s[at]
                out[i] = ids[::-1]
        return out

    def open(self, u: int, v: int) -> bool:
        """arcs() of one state and token."""
        s = int(self.state[u])
        return bool(self.blocks[self.index[self.arc[v], s // (8 * WIDE)], (s >> 3) % WIDE] >> (s & 7) & 1)

    def spell(self, word: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        n, made = len(word), self.made
        if n == 0:
            return []
        last, size = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            low = max(0, i - self.longest)
            tail = self.suffix if i == n else ""
            for j in range(low, i):
                t = made.get(word[j:i] + tail)
                if t is not None and (j == 0 or self.open(last[j], t)):
                    last[i], size[i] = t, i - j
                    break
            else:
                raise ValueError("no accepted spelling")
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


class Encoder:
    """The whole path from text to ids for the lower-casing vocabulary: clean, cut, spell."""

    def __init__(self, path: str, made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.auto = Automaton(spec, made)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.words = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.letters = byte_letters()
        self.label = self.auto.label[:]
        for s, i in self.added.items():
            self.label += [""] * (i + 1 - len(self.label))
            self.label[i] = s
        self.kind = np.dtype("<u2" if len(self.label) < 65536 else "<u4")
        self.table = Kept(lambda w: self._spelled([w])[0])

    def _spelled(self, words: list[str]) -> list[bytes]:
        letters = self.letters
        coded = [w if w.isascii() and w.isalpha() else "".join([letters[b] for b in w.encode()]) for w in words]
        got = self.auto.spell_many(coded) if len(words) > 8 else list(map(self.auto.spell, coded))
        ends = np.cumsum([0, *map(len, got)]).tolist()
        whole, width = np.array([x for ids in got for x in ids], self.kind).tobytes(), self.kind.itemsize
        return [whole[width * a : width * b] for a, b in zip(ends, ends[1:])]

    def _words(self, text: str) -> list[str]:
        """Clean and cut."""
        try:
            text.encode("latin-1")  # composed already, and lower case by character
            return LATIN_WORDS.findall(text.lower())
        except UnicodeEncodeError:
            pass
        return self.words.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        parts, ends = [], []
        for t in texts:
            at = 0
            for m in self.cut.finditer(t or "") if self.cut is not None else ():
                parts += (self._words(t[at : m.start()]) if m.start() > at else [], self.added[m[0]])
                at = m.end()
            parts.append(self._words(t[at:]) if t and at < len(t) else [])
            ends.append(len(parts))
        table = self.table
        new = [w for w in set().union(*[x for x in parts if not isinstance(x, int)]) if w not in table]
        old = table.old  # as it is now: the generations may turn below
        for i in range(0, len(new), 50_000):  # so that words spelled beside each other take bounded memory
            some = [w for w in new[i : i + 50_000] if w not in old and len(w) <= LONG]
            made = dict(zip(some, self._spelled(some), strict=True))
            for w in new[i : i + 50_000]:
                if (x := made.get(w) or old.get(w)) is not None:
                    table.keep(w, x)
        get, kind = table.__getitem__, self.kind
        got = [np.array([x], kind).tobytes() if isinstance(x, int) else b"".join(map(get, x)) for x in parts]
        got = [got[b - 1] if b - a == 1 else b"".join(got[a:b]) for a, b in zip([0, *ends], ends)]
        return [np.frombuffer(x, kind).astype("<u4").tobytes() for x in got]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The arcs' labels, joined as the library does for a vocabulary without a decoder."""
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_sent: dict[tuple[str, str], str] = {}


def sent_table(spark, path: str) -> str:
    """Compile a vocabulary file's table, once a session, and send it to all machines; gives the name of the file.

    For 49,000 tokens of which 15,000 don't end a word: 92 MB of bits on the driver, once, and 14 MB of blocks that are sent.
    """
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        folder = tempfile.mkdtemp(prefix="tallystone-table-")  # the driver's own copy, which it serves
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = f"transitions-{uuid.uuid4().hex[:12]}"
        with open(path, encoding="utf-8") as f:
            order, table = compiled(json.load(f)["model"])
        with open(os.path.join(folder, name), "wb") as f:
            for x in (order, *in_blocks(table)):
                np.save(f, x)
        sc.addFile(os.path.join(folder, name))
        _sent[sc.applicationId, path] = name
    return _sent[sc.applicationId, path]


def encoder_for(path: str, name: str) -> Encoder:
    """A worker's encoder, with the machine's copy of the table mapped, not read."""

    def made() -> Encoder:
        from pyspark import SparkFiles

        parts = []
        with open(SparkFiles.get(name), "rb") as f:
            for _ in range(3):
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                at = f.tell()  # mapping moves it
                parts.append(np.asarray(np.memmap(f, dtype, "r", at, shape)))
                f.seek(at + parts[-1].nbytes)
        return Encoder(path, tuple(parts))

    return kept(("automaton", name), made)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe(docs: DataFrame, vocab: str = "word_bpe_49k.json", digest: bool = False) -> DataFrame:
    """Encode and decode doc_id, text: doc_id, n_tokens, ids (u32 little-endian), decoded; or sha256 of the last two.

    A null or empty text has no ids and decodes to an empty string.  Rows are neither
    joined nor merged, so repeated rows, null ids and clashing columns change nothing.
    """
    ready(docs.sparkSession)
    path = tokenizer_path(vocab)
    name = sent_table(docs.sparkSession, path)

    def run(rows):
        enc = encoder_for(path, name)
        for b in rows:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500).to_pydict()
                ids = enc.encode_many(c["text"])
                text = [enc.decode(x) for x in ids]
                n = [len(x) // 4 for x in ids]
                if digest:
                    sha = hashlib.sha256
                    yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(x.encode()).hexdigest() for x in text])], schema=DIGEST)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(text)], schema=OUT)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(freed(run), kind)
