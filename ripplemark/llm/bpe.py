"""Byte-level BPE by a prefix-sharing trie.

The last token of a prefix's encoding decides the whole encoding: take the
token off and the rest is the encoding of the shorter prefix. So each node
of a trie of distinct words holds one last token and the node where that
token starts. A node's token is the one vocabulary entry that ends there
and may stand after the last token of the node where it starts; prefixes
shared by many words are worked out once. A word's tokens are read by
walking back from its end. A worker keeps its trie until it has a fixed
number of nodes, also within a step; the words of a step are inserted in
order, so that nodes are made depth first. Only the first bytes of a word
make nodes, so memory grows with the word and not with its square.

Texts are cut before each space that a non-space follows. Such pieces are
tokenised independently of each other, so their encodings are cached by the
worker; the cache holds two generations of a fixed size.

Cases: a null text is empty and has no tokens; the vocabulary's special
strings in a text are encoded as their ids; texts of any length and words of
any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import kept_by_worker

#: Entries of one generation of a worker's piece cache, nodes at which its trie starts anew, and pairs it remembers.
CACHED_PIECES = 150_000
TRIE_NODES = 100_000
KNOWN_PAIRS = 170_000
#: Bytes of a word down to which its prefixes are nodes.
DEEP = 64
#: Last bytes of a prefix by which the sizes of its possible last tokens are known.
TAIL = 4
NEVER = 1 << 40
ROWS_AT_ONCE = 128

# The split pattern and white space of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = re.compile(f" (?=[^{SPACES}])")
LINE = re.compile(f"\n(?=[^{SPACES}])")


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(source: str) -> list[bytes]:
    """The bytes of every id; unused ids have none."""
    spec = json.loads(source)
    letters = byte_letters()
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    known = {i: bytes(map(letters.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in special} | special
    return [known.get(i, b"") for i in range(max(known) + 1)]


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file; remembers ``share`` of ``KNOWN_PAIRS``."""

    def __init__(self, source: str, share: float = 1.0):
        self.share = share
        spec = json.loads(source)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in ids.items() if t not in self.special}
        top = max([*self.ids.values(), *self.special.values()])
        # Bytes, length, the parts of its first merge and that merge's rank, by id.
        self.bytes, self.lengths, self.parts, self.born = [b""] * (top + 1), [0] * (top + 1), [None] * (top + 1), [-1] * (top + 1)
        for t, i in self.ids.items():
            self.bytes[i], self.lengths[i] = t, len(t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = ids[left], ids[right]
            made = ids[left + right]
            self.rank[pair] = n
            if self.parts[made] is None:
                self.parts[made], self.born[made] = pair, n
        ends: dict[bytes, set[int]] = defaultdict(set)
        for t in self.ids:
            ends[t[-TAIL:]].add(len(t))
        # Sizes of the entries that end a text whose last bytes are the key, longest first. A shorter key is a text of its
        # own or stands for longer ones that no entry as long as TAIL ends.
        keys = {end[k:] for end in ends for k in range(len(end))}
        shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        for key in keys:
            found = {n for n in range(2, len(key) + 1) if key[-n:] in self.ids} | {1}
            found |= ends[key] if len(key) == TAIL else set()
            sizes = tuple(sorted(found, reverse=True))
            self.sizes[key] = shared.setdefault(sizes, sizes)
        self.known: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side stay two tokens.

        Merges are undone from the youngest back. As long as both tokens at
        the boundary exist, a merge of the two would have come first if its
        rank is below the merges that used them up; of equal merges the
        leftmost comes first.
        """
        key = a << 20 | b
        end_a = end_b = NEVER
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < end_a and r <= end_b:
                answer = False
                break
            young_a, young_b = self.born[a], self.born[b]
            if young_a < 0 and young_b < 0:
                answer = True
                break
            if young_a > young_b:
                end_a, a = young_a, self.parts[a][1]
            else:
                end_b, b = young_b, self.parts[b][0]
        if len(self.known) > KNOWN_PAIRS * self.share:
            self.known.clear()
        self.known[key] = answer
        return answer


class Trie:
    """Words seen so far. A node is a prefix, and holds the last token of the prefix's encoding.

    Nodes are numbers, found by the node above and a byte. They are made down
    to a fixed depth; the rest of a long word has its last tokens in the
    word's own list only, four bytes for each byte of the word.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}
        self.last = array("i", [-1])

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words; sorted words make the nodes in depth-first order."""
        ids, lengths, sizes = self.vocabulary.ids, self.vocabulary.lengths, self.vocabulary.sizes.get
        most = TRIE_NODES * self.vocabulary.share
        apart, known = self.vocabulary.apart, self.vocabulary.known.get
        out = []
        for word in words:
            if len(self.last) > most:
                self.clear()
            below, last = self.below, self.last
            data = word.encode()
            size = len(data)
            # The last token of each prefix of this word.
            ends = [-1] if size <= DEEP else array("i", [-1])
            node = 0
            for byte in data:
                child = below.get(node << 8 | byte)
                if child is None:
                    break
                node = child
                ends.append(last[node])
            for depth in range(len(ends), size + 1):
                tail = data[depth - TAIL : depth] if depth > TAIL else data[:depth]
                for n in sizes(tail) or sizes(tail[-3:]) or sizes(tail[-2:]) or (1,):
                    if n >= depth:
                        if n > depth:
                            continue
                        token = ids.get(data[:depth])
                        if token is None:
                            continue
                        break
                    token = ids.get(data[depth - n : depth])
                    if token is None:
                        continue
                    before = ends[depth - n]
                    fits = known(before << 20 | token)
                    if fits or fits is None and apart(before, token):
                        break
                ends.append(token)
                if depth <= DEEP:
                    below[node << 8 | data[depth - 1]] = node = len(last)
                    last.append(token)
            coded = array("I")
            while size:
                token = ends[size]
                coded.append(token)
                size -= lengths[token]
            coded.reverse()
            out.append(coded.tobytes())
        return out


class Pieces:
    """A cache of two generations: what is used again moves to the newer one."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, pieces: set[str]) -> set[str]:
        """Those not held; the others are in the newer generation then."""
        absent = pieces.difference(self.recent)
        new = absent.difference(self.old)
        for piece in absent - new:
            self.recent[piece] = self.old[piece]
        return new

    def age(self, most: float) -> None:
        if len(self.recent) > most:
            self.old, self.recent = self.recent, {}


class Encoder:
    """Texts to packed ids, with a cache of pieces.

    ``share``: of the fixed sizes that it may fill; less of them is less memory and more work, with the same ids.
    """

    def __init__(self, source: str, share: float = 1.0):
        self.vocabulary = Vocabulary(source, share)
        self.bytes = self.vocabulary.bytes
        self.words = regex.compile(WORDS)
        self.trie = Trie(self.vocabulary)
        self.pieces = Pieces()
        special = self.vocabulary.special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def split(self, piece: str) -> list[str]:
        """Words of a piece; most are letters, with one sign behind them at most."""
        if piece[1:].isalpha() and piece[0] == " ":
            return [piece]
        if piece[-1] in ".,!?;:" and piece[1:-1].isalpha() and piece[0] == " ":
            return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces not held; a word that is a piece of its own, or was one, is not worked out again."""
        self.pieces.age(CACHED_PIECES * self.vocabulary.share)
        split = {p: self.split(p) for p in self.pieces.unknown(pieces)}
        distinct = sorted(self.pieces.unknown({w for words in split.values() for w in words}))
        coded = self.pieces.recent
        coded.update(zip(distinct, self.trie.encode(distinct)))
        for p, words in split.items():
            if len(words) > 1:
                coded[p] = b"".join([coded[w] for w in words])

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; a special string is a piece of its own, marked by its id."""
        if self.special is None or "<" not in text and not self.special.search(text):
            return self.plain(text)
        out: list = []
        for n, part in enumerate(self.special.split(text)):
            out.extend([self.vocabulary.special[part]] if n % 2 else self.plain(part))
        return out

    @staticmethod
    def plain(text: str) -> list[str]:
        out: list[str] = []
        for n, line in enumerate(LINE.split(text)):
            head, *rest = PIECE.split(line)
            if n:
                out.append("\n")
            if head:
                out.append(head)
            out += [" " + p for p in rest]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Works through the texts in steps, so that the pieces at hand stay few."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            step, size = [], 0
            while at < len(texts) and (not step or size < 1_000_000):
                step.append(self.cut(texts[at]))
                size += len(texts[at])
                at += 1
            distinct = set().union(*step)
            marks = {p: p.to_bytes(4, "little") for p in distinct if type(p) is int} if self.special else {}
            self.learn(distinct.difference(marks))
            known = self.pieces.recent.__getitem__
            for pieces in step:
                try:
                    out.append(b"".join(map(known, pieces)))
                except KeyError:
                    out.append(b"".join([marks[p] if type(p) is int else known(p) for p in pieces]))
        return out


def encoder_of(shared, mark: str, share: float = 1.0) -> Encoder:
    return kept_by_worker("encoder", mark, lambda: Encoder(shared.value, share))


def decoder_of(shared, mark: str) -> list[bytes]:
    return kept_by_worker("decoder", mark, lambda: token_bytes(shared.value))


def decoded(known: list[bytes], packed: bytes | None) -> str:
    """Text of packed ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
    ids = array("I", packed or b"")
    try:
        data = b"".join(map(known.__getitem__, ids))
    except IndexError:
        data = b"".join([known[i] for i in ids if i < len(known)])
    return data.decode("utf-8", "replace")


def encode(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids as little-endian unsigned 32-bit numbers in one binary value.

    ``source``: the tokenizer file's JSON text.
    """
    return round_trip(docs, source, id_col, text_col, back=False)


def round_trip(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text", back: bool = True, share: float = 1.0) -> DataFrame:
    """``doc_id, ids`` and, with ``back``, ``text`` decoded from the ids; in one pass of one worker. ``share``: see ``Encoder``."""
    shared = docs.sparkSession.sparkContext.broadcast(source)
    mark = uuid.uuid4().hex

    def read(batches):
        encoder = encoder_of(shared, mark, share)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(coded, pa.binary())]
                if back:
                    columns.append(pa.array([decoded(encoder.bytes, ids) for ids in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(read, "doc_id bigint, ids binary" + ", text string" * back)


def decode(tokens: DataFrame, source: str) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``."""
    shared = tokens.sparkSession.sparkContext.broadcast(source)
    mark = uuid.uuid4().hex

    def read(batches):
        known = decoder_of(shared, mark)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [decoded(known, ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(read, "doc_id bigint, ids binary, text string")


def ids_array(tokens: DataFrame) -> DataFrame:
    """``doc_id, ids`` with the ids as an array of numbers."""
    place = F.sequence(F.lit(0), (F.length("ids") / 4).cast("int") - 1)
    octet = lambda p, k: F.conv(F.hex(F.substr(F.col("ids"), p * 4 + k + 1, F.lit(1))), 16, 10).cast("bigint")
    number = lambda p: octet(p, 0) + octet(p, 1) * 256 + octet(p, 2) * 65536 + octet(p, 3) * 16777216
    return tokens.select("doc_id", F.when(F.length("ids") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(place, number)).alias("ids"))


def digests(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text", share: float = 1.0) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row. ``share``: see ``Encoder``."""
    return round_trip(docs, source, id_col, text_col, share=share).select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def tokenizer_source(path: str) -> str:
    """The tokenizer file's text, read on the driver from a local path."""
    with open(path, encoding="utf-8") as file:
        return file.read()
